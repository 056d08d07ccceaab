"""Licence notices by a trained paragraph classifier.

A paragraph is a line that is not blank, and is scored whole. Notices wrapped over lines, or inside long lines, are found in
windows: the lines up to one without words are joined, and overlapping windows of WINDOWS words of them are scored too. A
window counts if it holds enough of a template; one without any run of a template never can
and is not scored. Verdicts about the same words are one notice, of the family that shares most
runs; it is reported at the paragraph where its words begin.

The features of a paragraph or window are the single words and pairs of neighbouring
words that occur in licence templates. A softmax regression over them, with one class per licence family
and one for all other text, is trained on the templates (words dropped, words of the corpus
around them, names and years changed) and on paragraphs of the corpus that share no three-word run with a
template. Held-out examples calibrate it twice: a temperature for the probabilities, and the least
probability at which a prediction counts, below which a paragraph is unknown. A prediction is
confirmed if enough of a template of its family, or of the paragraph, is shared in three-word runs.

The corpus gives at most about `sample_rows` documents to the training, picked by a hash, and of each a
paragraph of SAMPLE_CHARS characters at most; there is no other bound. Every paragraph of every whole text is scored. Null and empty texts have no
paragraphs. Repeated rows get one row each. An empty table gives an empty result. Columns other than
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of public licence notices.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it under the terms of the gnu affero general public license",
    ],
    "apache": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "spdx-license-identifier apache-2.0",
    ],
    "bsd": [
        "licensed under the bsd license",
        "released under the 3-clause bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "spdx-license-identifier bsd-3-clause",
    ],
    "cc-by": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ],
    "cc-by-nc": [
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "spdx-license-identifier gpl-3.0-or-later",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it under the terms of the gnu lesser general public license",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "spdx-license-identifier mit",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
    ],
    "proprietary": [
        "all rights reserved",
        "copyright all rights reserved unauthorized copying of this file is strictly prohibited",
        "proprietary and confidential",
    ],
    "public-domain": [
        "this is free and unencumbered software released into the public domain",
        "released into the public domain under cc0 1.0 universal",
    ],
}

OTHER = "none"
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 4000
VARIANTS = 60
SIMILARITY = 0.5
# Every notice of up to 40 words is whole in a window of 48; the short ones part neighbouring notices.
WINDOWS = (6, 12, 24, 48)
# Letters A-Z become small; letters, digits, dots, dashes and bytes beyond ASCII are parts of words.
CLEAN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c in b".-\n" or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(line: bytes) -> list[bytes]:
    """Words of a cleaned line, without dots and dashes at their ends."""
    return [w for w in (x.strip(b".-") for x in line.split()) if w]


def _runs(words: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


@dataclass
class Model:
    classes: list[str]
    single: dict[bytes, int]
    pairs: dict[tuple[int, int], int]
    weights: np.ndarray  # (features + 1, classes); the last row is the bias
    temperature: float
    threshold: float
    templates: dict[str, list[set[tuple[bytes, ...]]]]

    def features(self, words: list[bytes]) -> list[int]:
        ids = [self.single.get(w, -1) for w in words]
        found = {i for i in ids if i >= 0}
        if found:
            found.update(self.pairs[p] for p in zip(ids, ids[1:]) if p in self.pairs)
        return sorted(found)

    def judge(self, words: list[bytes]) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of a paragraph, None if it is no licence notice."""
        found = self.features(words)
        if not found:
            return None
        scores = (self.weights[found].sum(axis=0) + self.weights[-1]) / self.temperature
        p = np.exp(scores - scores.max())
        p /= p.sum()
        best = int(p.argmax())
        if self.classes[best] == OTHER or p[best] < self.threshold:
            return None
        family = self.classes[best]
        mine = _runs(words)
        alike = max(len(mine & t) / min(len(mine), len(t)) for t in self.templates[family])
        return family, float(p[best]), float(alike)


def _softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, classes: int, decay: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights of a softmax regression, by gradient steps with momentum; every class weighs alike."""
    w = np.zeros((x.shape[1], classes))
    speed = np.zeros_like(w)
    sizes = np.bincount(y, minlength=classes)
    row = 1 / (sizes[y] * (sizes > 0).sum())
    goal = np.eye(classes)[y]
    for _ in range(rounds):
        slope = x.T @ ((_softmax(x @ w) - goal) * row[:, None]) + decay * w
        speed = 0.9 * speed - 2.0 * slope
        w += speed
    return w


def fit_model(others: list[list[bytes]], variants: int = VARIANTS, seed: int = 7) -> Model:
    """A model from the templates and paragraphs (as words) of other text."""
    rng = np.random.default_rng(seed)
    spelled = {family: [words_of(t.encode()) for t in texts] for family, texts in TEMPLATES.items()}
    templates = {family: [_runs(t) for t in texts] for family, texts in spelled.items()}
    known = set().union(*(t for texts in templates.values() for t in texts))
    others = [o for o in others if o and not _runs(o) & known]
    filler = sorted({w for o in others for w in o}) or [b"text"]
    vocabulary = sorted({w for texts in spelled.values() for t in texts for w in t})
    single = {w: i for i, w in enumerate(vocabulary)}
    couples = sorted({(single[a], single[b]) for texts in spelled.values() for t in texts for a, b in zip(t, t[1:])})
    pairs = {p: len(single) + i for i, p in enumerate(couples)}
    classes = [*sorted(TEMPLATES), OTHER]
    model = Model(classes, single, pairs, np.zeros((len(single) + len(pairs) + 1, len(classes))), 1.0, 0.0, templates)

    def around(words: list[bytes]) -> list[bytes]:
        some = lambda: [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 12))]
        return some() + words + some()

    examples: list[tuple[list[bytes], int]] = []
    for family, texts in spelled.items():
        for text in texts:
            examples += [(text, classes.index(family))] * 3
            for _ in range(variants):
                kept = [w for w in text if len(text) < 6 or rng.random() > 0.08]
                examples.append((around(kept), classes.index(family)))
    for other in others:
        examples.append((other, len(classes) - 1))
    for _ in range(variants * 20):  # the words of notices in other orders are no notices
        mixed = [vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(1, 8))]
        if not _runs(mixed) & known:
            examples.append((around(mixed), len(classes) - 1))
    x = np.zeros((len(examples), model.weights.shape[0]))
    for i, (words, _) in enumerate(examples):
        x[i, model.features(words)] = 1.0
    x[:, -1] = 1.0
    y = np.array([label for _, label in examples])
    held = np.arange(len(y)) % 5 == 4
    model.weights = _fit(x[~held], y[~held], len(classes))
    scores, truth = x[held] @ model.weights, y[held]
    loss = {t: -np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(loss, key=loss.get))
    p = _softmax(scores / model.temperature)
    wrong = p[:, :-1].max(axis=1)[truth == len(classes) - 1]
    model.threshold = float(np.clip(np.quantile(wrong, 0.995) if len(wrong) else 0.5, 0.5, 0.95))
    return model


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, **how) -> Model:
    """A model whose other class is learnt from about `sample_rows` documents."""
    rows = docs.select(F.xxhash64(*docs.columns).alias("h"), docs[text_col].cast("string").alias("text")).where(F.col("text").isNotNull())
    share = min(1.0, sample_rows / max(1, docs.count()))
    picked = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)
    # A paragraph of each picked document, by hash; the hash orders them the same way every time.
    lines = F.filter(F.split("text", "\n"), lambda s: F.length(F.trim(s)) > 0)
    picked = picked.where(F.size(lines) > 0).select("h", F.substring(F.get(lines, F.pmod(F.shiftright("h", 20), F.size(lines)).cast("int")), 1, SAMPLE_CHARS).alias("line"))
    found = picked.groupBy("line").agg(F.min("h").alias("h")).orderBy("h", "line").limit(2 * sample_rows)
    texts = [r["line"].encode("utf-8", "replace").translate(CLEAN).replace(b"\n", b" ") for r in found.collect()]
    return fit_model([words_of(t) for t in texts], **how)


FOUND = "array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"


def _held(words: list[bytes], runs: set[tuple[bytes, ...]]) -> dict[int, tuple[bytes, ...]]:
    """Runs that the words have, by position; templates of two words have one run of two."""
    return {i: run for n in {len(run) for run in runs} for i, run in enumerate(zip(*(words[k:] for k in range(n)))) if run in runs}


def _places(words: list[bytes], runs: set[tuple[bytes, ...]]) -> set[int]:
    """Positions of the words that are in one of the runs."""
    return {i + k for i, run in _held(words, runs).items() for k in range(len(run))}


def notices(model: Model, known: set[tuple[bytes, ...]], lines: list[list[bytes]], similarity: float) -> list[dict]:
    """Notices in lines (as words) that belong together; `known` has the runs of all templates."""
    words = [w for line in lines for w in line]
    line_of = [n for n, line in enumerate(lines) for _ in line]
    sure, unsure, at = [], [], 0
    for line in lines:
        if verdict := model.judge(line):
            family, p, alike = verdict
            if alike >= similarity:
                mine = _runs(line)
                best = max(model.templates[family], key=lambda t: len(mine & t) / min(len(mine), len(t)))
                sure.append((len(mine & best), p, alike, family, {at + i for i in _places(line, best) or range(len(line))}))
            else:
                unsure.append((p, alike, family, at, at + len(line)))
        at += len(line)
    hits = [(i, i + len(run)) for i, run in _held(words, known).items()]
    for size in WINDOWS:
        step = size // 6
        for start in sorted({s for a, b in hits for s in range(max(0, -((size - b) // step) * step), a + 1, step)}):
            window = words[start : start + size]
            if not (verdict := model.judge(window)):
                continue
            family, p, _ = verdict
            share, n, best = max(((len(mine) / len(t), len(mine), t) for t in model.templates[family] for mine in [set(_held(window, t).values())]), key=lambda x: x[:2])
            if n and share >= similarity:
                sure.append((n, p, share, family, {start + i for i in _places(window, best)}))
        if size >= len(words):
            break
    groups: list[dict | None] = []
    owner: dict[int, int] = {}
    for _, p, alike, family, places in sorted(sure, key=lambda c: (-c[0], -c[1], min(c[4]), c[3])):
        met = sorted({owner[i] for i in places if i in owner})
        if any(groups[g]["family"] != family for g in met):
            continue
        new = {"family": family, "probability": p, "similarity": alike, "places": set(places)}
        for g in met:
            new["probability"], new["similarity"] = max(new["probability"], groups[g]["probability"]), max(new["similarity"], groups[g]["similarity"])
            new["places"] |= groups[g]["places"]
            groups[g] = None
        owner.update(dict.fromkeys(new["places"], len(groups)))
        groups.append(new)
    out = [(min(g["places"]), g["family"], g["probability"], g["similarity"], True) for g in groups if g]
    out += [(a, family, p, alike, False) for p, alike, family, a, b in unsure if not any(i in owner for i in range(a, b))]
    return [{"paragraph": line_of[a], "family": f, "probability": p, "similarity": alike, "confirmed": ok} for a, f, p, alike, ok in sorted(out)]


def _scanner(shared, similarity: float):
    kind = pa.list_(pa.struct({"paragraph": pa.int32(), "family": pa.string(), "probability": pa.float64(), "similarity": pa.float64(), "confirmed": pa.bool_()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = set().union(*(t for texts in model.templates.values() for t in texts))
        for batch in batches:
            counts, found = [], []
            for data in batch.column("data"):
                n, mine, held = 0, [], []
                for line in [*(data.as_py() or b"").translate(CLEAN).split(b"\n"), b""]:
                    if words := words_of(line):
                        held.append(words)
                    elif held:
                        mine += [{**x, "paragraph": x["paragraph"] + n} for x in notices(model, known, held, similarity)]
                        n += len(held)
                        held = []
                counts.append(n)
                found.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_paragraphs", "found"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: doc_id, n_paragraphs, n_license (confirmed notices), families (of the
    confirmed ones, sorted), n_unconfirmed, found."""
    model = model or train(docs.select(docs[id_col], docs[text_col]), text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scanner(shared, similarity), f"doc_id {kind}, n_paragraphs long, found {FOUND}")
    sure = F.filter("found", lambda f: f["confirmed"])
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.size(sure).cast("long").alias("n_license"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"),
        (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        "found",
    )
