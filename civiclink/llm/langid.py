"""Language identification with language-bitmask n-gram filters.

A model is one array of 64-bit masks. A language owns the letter n-grams that occur in its training
texts at least `min_count` times and, per n-gram written, at least `ratio` times as often as in the
language that uses them most. Every n-gram is entered at PROBES slots with the bits of the
languages that own it, so one look-up, the AND of its slots, answers for up to 64 languages at once
(more languages take further arrays). Of a text, every n-gram is looked up; the counts per language are
corrected for the share of foreign n-grams that the language's bits let through by chance, and the
largest corrected share decides. Equal shares go to the language first in code point order.

N-grams are taken from lower-cased runs of letters with one blank at either end. A text that is null or
has no letters is "und" with score 0, and so is every text under a model without training rows.
The score is the corrected share of the winning language, 0 to 1.

Training uses about `sample_rows` rows of each language at most, picked by a hash. The model keeps every
n-gram a language owns, however many others there are: it has SPARE slots for each n-gram of the language that owns
most, and 2^SLOT_BITS at least. Only set slots come to the driver. More than MAX_LANGUAGES languages raise ValueError. Rows with a null text or language teach
nothing. Prediction reads the text alone, and every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from civiclink.llm.common import packed, stored, unpacked

SIZES = (3, 4)
PROBES = 3
SLOT_BITS = 20
SAMPLE_ROWS = 4000
SPARE = 4
MAX_LANGUAGES = 1024
MIN_COUNT = 3
RATIO = 0.25
CHUNK = 1 << 18
SLICE = 1024
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # (slices of 64 languages, slots)

    def chance(self) -> np.ndarray:
        """Per language, the share of arbitrary n-grams that all slots let through."""
        out = []
        for i in range(len(self.languages)):
            fill = float(((self.masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean())
            out.append(min(fill**PROBES, 0.999))
        return np.array(out)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, text number of each symbol) of many texts at a time; long texts come in slices that
    are cut at a character that is no letter. Symbols are lower-case letters, 0 for all else."""
    held, owners, size = [], [], 0

    def done() -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.array(owners, np.int64), [len(h) for h in held])
        codes = np.where(_letters()[codes], codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        return codes[keep].astype(np.uint64), owner[keep]

    for number, text in enumerate(texts):
        start = 0
        text = text or ""
        while start < len(text):
            end = start + CHUNK
            while end < len(text) and text[end].isalpha():
                end += 1
            part = " " + text[start:end].lower() + " "
            start = end
            held.append(part)
            owners.append(number)
            size += len(part)
            if size >= CHUNK:
                yield done()
                held, owners, size = [], [], 0
    if held:
        yield done()


def _grams(symbols: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text numbers) of the n-grams of each size; blanks stand only at the ends of one."""
    for n in SIZES:
        if len(symbols) < n:
            continue
        count = len(symbols) - n + 1
        h, good = np.full(count, n, np.uint64), np.ones(count, bool)
        for i in range(n):
            part = symbols[i : i + count]
            h = (h * np.uint64(0x100000001B3)) ^ (part * np.uint64(0x9E3779B97F4A7C15))
            if 0 < i < n - 1:
                good &= part != 0
        h, of = h[good], owner[:count][good]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        yield h, of


def _step(bits: int) -> int:
    """Distance of the parts of a hash that give its slots; they overlap where 64 bits are too few."""
    return min(bits, (64 - bits) // (PROBES - 1))


def _slots(h: np.ndarray, bits: int = SLOT_BITS) -> list[np.ndarray]:
    return [(h >> np.uint64(_step(bits) * i)) & np.uint64((1 << bits) - 1) for i in range(PROBES)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> (lang, gram, n), summed per batch."""
    for batch in batches:
        names = batch.column(1).to_pylist()
        by_lang: dict[str, list[str]] = {}
        for text, name in zip(batch.column(0).to_pylist(), names):
            by_lang.setdefault(name, []).append(text)
        for name, texts in by_lang.items():
            seen = [h for symbols, owner in _chunks(texts) for h, _ in _grams(symbols, owner)]
            if seen:
                gram, n = np.unique(np.concatenate(seen), return_counts=True)
                lang = pa.array([name] * len(gram), pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    min_count: int = MIN_COUNT,
    ratio: float = RATIO,
    spread_by: Sequence[str] = ("doc_id", "text"),
) -> Model:
    """A model from labelled rows. The hash that picks the sample is over the columns `spread_by`, so
    copies of a text under other ids are picked one by one."""
    spark = docs.sparkSession
    pick = F.pmod(F.xxhash64(*[docs[c] for c in spread_by]), F.lit(1_000_000)).alias("pick")
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), pick)
    rows = rows.where(F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = rows.where(F.col("text").isNotNull())
    # A share of each language, so that about sample_rows of its rows stay. A map of at most
    # MAX_LANGUAGES entries in the expression; texts that are not picked go nowhere.
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_rows / r["count"]))]) if sizes else F.create_map().cast("map<string,double>")
    picked = rows.where(F.col("pick") < F.try_element_at(shares, F.col("lang")) * 1_000_000)
    counts = picked.select("text", "lang").mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= min_count))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    rates = counts.join(totals, "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("rate"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("rates"))
    owned = stored(best.select("gram", F.explode(F.expr(f"transform(filter(rates, r -> r.rate >= {ratio} * best), r -> r.lang)")).alias("lang")))
    most = owned.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    bits = max(SLOT_BITS, (SPARE * most - 1).bit_length())
    masks = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
    for part in range(len(masks)):
        some = languages[64 * part : 64 * part + 64]
        bit = F.create_map(*[F.lit(x) for i, name in enumerate(some) for x in (name, i)]) if some else F.create_map().cast("map<string,int>")
        mine = owned.where(F.col("lang").isin(some)).select("gram", F.call_function("shiftleft", F.lit(1).cast("long"), F.try_element_at(bit, F.col("lang"))).alias("mask"))
        slots = F.array(*[F.shiftrightunsigned("gram", _step(bits) * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(PROBES)])
        for batch in mine.select(F.explode(slots).alias("slot"), "mask").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
            masks[part, batch.column("slot").to_numpy()] = batch.column("mask").to_numpy().view(np.uint64)
    return Model(languages, masks)


def classify(texts: list[str | None], model: Model, chance: np.ndarray) -> tuple[list[str], list[float]]:
    total = np.zeros(len(texts), np.int64)
    hits = np.zeros((len(model.languages), len(texts)), np.int64)
    letters = np.zeros(len(texts), bool)
    for symbols, owner in _chunks(texts):
        letters[owner[symbols != 0]] = True
        for h, of in _grams(symbols, owner):
            total += np.bincount(of, minlength=len(texts))
            slots = _slots(h, model.masks.shape[1].bit_length() - 1)
            for part, masks in enumerate(model.masks):
                found = masks[slots[0]]
                for s in slots[1:]:
                    found = found & masks[s]
                for i in range(64 * part, min(64 * part + 64, len(model.languages))):
                    of_it = of[(found >> np.uint64(i & 63)) & np.uint64(1) != 0]
                    hits[i] += np.bincount(of_it, minlength=len(texts))
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    share = (hits / np.maximum(total, 1) - chance[:, None]) / (1 - chance[:, None])
    winner = share.argmax(axis=0)
    score = np.clip(share[winner, np.arange(len(texts))], 0.0, 1.0)
    names = [model.languages[w] if there else UNKNOWN for w, there in zip(winner, letters)]
    return names, np.where(letters, score, 0.0).tolist()


def _predictor(shared, at: int, kept: list[int]):
    """Rows as one struct column -> the struct of the kept fields, lang_pred, score. The text is field
    `at`; it crosses to Python once, and is taken apart a slice of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        chance = model.chance()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                row = whole.slice(start, SLICE).column(0)
                fields = row.flatten()
                names, scores = classify(fields[at].cast(pa.string()).to_pylist(), model, chance)
                some = pa.StructArray.from_arrays([fields[i] for i in kept], [row.type.field(i).name for i in kept])
                columns = [some, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "lang_pred", "score"])

    return run


def _asked(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    rows = packed(docs)
    fields = rows.schema["_row"].dataType.fields
    kept = [docs.columns.index(c) for c in keep]
    schema = StructType([StructField("_row", StructType([fields[i] for i in kept])), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predictor(shared, docs.columns.index(text_col), kept), schema)


def predicted(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (default all), lang_pred and score."""
    columns = docs.columns if keep is None else keep
    out = _asked(docs.select(*dict.fromkeys([*columns, text_col])), model, text_col, columns)
    clash = ("lang_pred", "score")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in columns if c.lower() not in clash], *clash)


def identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.1) -> DataFrame:
    """Rows of `docs`, all columns, whose language is known with a score of min_score or more."""
    out = _asked(docs, model, text_col, docs.columns)
    return unpacked(out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)), docs.columns)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows with held_out teach nothing."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, spread_by=(id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predicted(rows, model, "text", ["doc_id", "held_out"])
