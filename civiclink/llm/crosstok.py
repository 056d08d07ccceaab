"""Two tokenizers aligned over the same text.

Tokenizer A (byte-level BPE, `tokenizers`) encodes a blank and the text, tokenizer B (`sentencepiece`)
encodes the text and puts the blank there itself. Byte offsets where a token of A and a token of B both end
cut the two sequences into groups, the smallest stretches both spell out in whole tokens; the last
tokens of a group are linked.

Offsets come from the tokenizers' own spans: character offsets of A and the spans of B's result are coarse cuts.
Several tokens may lie in one character (multibyte characters of A, byte pieces of B); between two cuts
their ends follow from the bytes each token stands for. A text counts only if the tokens' bytes, joined,
are a blank and the text; else it has no tokens, nor has a null or empty text.

Texts are aligned in units (units.py), distinct ones once per worker. Both tokenizers start a token at a unit's
blank if no piece of B has a blank behind another character, and end one before marks such as dots if no
piece has a letter before them; both is checked on the vocabulary, and whole texts are aligned where it fails.

Linked tokens end in the same bytes, so one is a suffix of the other: the pairs that can ever be linked follow from the two
vocabularies (`linkable`), some hundred thousand whatever the corpus. Their corpus-wide
counts are summed per task and then by Spark; that table, bounded by the vocabularies, goes to all
executors, and no link is ever shuffled. A document keeps its distinct pairs with their numbers.

Repeated rows count each. Null document ids are kept. An empty table gives an empty result. Other
columns are not used. Special tokens written out in a text are plain text.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclink.llm.common import stored
from civiclink.llm.units import ENDS, Units, cut, is_letter, no_collection, once, slices

BLANK = "▁"
BATCH_CHARS = 1 << 20
ROWS_AT_ONCE = 1024
ROWS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable Latin-1 ones for themselves, the others in
    order from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pair:
    """Both tokenizers and the bytes of their tokens."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    @staticmethod
    def load(a_spec: bytes, b_model: bytes) -> Pair:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(a_spec.decode())
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        a_bytes = [b""] * (max(a.get_vocab().values(), default=-1) + 1)
        for token, i in a.get_vocab().items():
            a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        return Pair(a, b, a_bytes, b_bytes)

    def cuts(self) -> tuple[bool, bool]:
        """Whether B always starts a token at a unit's blank, and before the marks of ENDS behind a letter."""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_control(i)]
        blank = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        return blank, blank and not any(is_letter(x) and y in ENDS for p in pieces for x, y in zip(p, p[1:]))

    def linkable(self) -> np.ndarray:
        """Every pair (id of A, id of B) that can be linked, as a * 2^32 + b, ascending."""

        def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
            out: dict[bytes, list[int]] = {}
            for i, token in enumerate(tokens):
                if token:
                    out.setdefault(token, []).append(i)
            return out

        found, of_a, of_b = set(), by_bytes(self.a_bytes), by_bytes(self.b_bytes)
        for token, ids in of_a.items():
            for k in range(len(token)):
                found.update((i << 32) + j for j in of_b.get(token[k:], ()) for i in ids)
        for token, ids in of_b.items():
            for k in range(1, len(token)):
                found.update((i << 32) + j for i in of_a.get(token[k:], ()) for j in ids)
        return np.array(sorted(found), np.int64)

    def encode(self, texts: list[str]) -> list[tuple | None]:
        """(ids of A, their ends, ids of B, their ends) of each text behind a blank; None if the bytes differ.
        Ends are byte offsets. In ASCII texts the spans alone say where tokens end."""
        out = []
        coded = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        bytes_of_a, bytes_of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for text, x, y in zip(texts, coded, self.b.encode(texts, return_type="offset_mapping", num_threads=1)):
            data, a, b = b" " + text.encode(), x.ids, y["ids"]
            if b"".join(map(bytes_of_a, a)) != data or b"".join(map(bytes_of_b, b)) != data:
                out.append(None)
            elif text.isascii():
                out.append((a, [end for _, end in x.offsets], b, [end + 1 for _, end in y["offsets"]]))
            else:
                at = list(accumulate([1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in " " + text], initial=0))
                a_ends = _ends(a, [(at[s], at[e]) for s, e in x.offsets], self.a_bytes)
                out.append((a, a_ends, b, _ends(b, [(at[s + 1], at[e + 1]) for s, e in y["offsets"]], self.b_bytes)))
        return out


def _ends(ids: list[int], spans: list[tuple[int, int]], known: list[bytes]) -> list[int]:
    """Byte offsets where tokens end. A span's end is a cut, unless the next token begins before it or
    the span is empty (a byte of a character that later tokens finish); from the last cut on, the bytes of the tokens tell."""
    ends, at, last = [], 0, len(ids) - 1
    for k, i in enumerate(ids):
        start, end = spans[k]
        at = end if start < end and (k == last or spans[k + 1][0] >= end) else at + len(known[i])
        ends.append(at)
    return ends


def groups(coded: tuple) -> list[tuple[list[int], list[int]]]:
    """The groups of (ids of A, ends, ids of B, ends); both end where the text ends."""
    a, a_ends, b, b_ends = coded
    if len(a) == 1 or len(b) == 1:
        return [(a, b)]
    out, p, q, j = [], 0, 0, 0
    for i, end in enumerate(a_ends, 1):
        while b_ends[j] < end:
            j += 1
        if b_ends[j] == end:
            out.append((a[p:i], b[q : j + 1]))
            p, q = i, j + 1
    return out


def _packed(coded: tuple | None) -> tuple | None:
    """Groups as text, links and counts as bytes, so that those of a text are joined quickly."""
    if coded is None:
        return None
    found = groups(coded)
    text = ";".join([",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found])
    return text, array("q", [(a[-1] << 32) + b[-1] for a, b in found]).tobytes(), array("i", (len(coded[0]), len(coded[2]), len(found))).tobytes()


def _joined(x: tuple | None, y: tuple | None) -> tuple | None:
    if x is None or y is None:
        return None
    return f"{x[0]};{y[0]}", x[1] + y[1], (np.frombuffer(x[2], np.int32) + np.frombuffer(y[2], np.int32)).tobytes()


def _aligner(a_spec: bytes, b_model: bytes) -> tuple:
    """(units or None, function from texts to packed groups)."""
    pair = Pair.load(a_spec, b_model)
    blank, tail = pair.cuts()
    whole = lambda texts: [_packed(c) for c in pair.encode(texts)]

    def tails(ends: list[str]) -> list[tuple | None]:
        """Tokens of marks, as they stand behind a letter."""
        out = []
        for (a, x, b, y), end in zip(pair.encode(["a" + e for e in ends]), ends):
            start = len(b" a")
            if start not in x or start not in y:
                raise ValueError(f"no cut before {end!r}")
            i, j = x.index(start) + 1, y.index(start) + 1
            out.append(_packed((a[i:], x[i:], b[j:], y[j:])))
        return out

    if not blank:
        return None, whole
    if not tail:
        return Units(lambda units: whole(units), lambda ends: [], _joined, ends=False), whole
    return Units(whole, tails, _joined), whole


class _Document:
    """Sums of one document over its slices."""

    def __init__(self, with_groups: bool):
        self.good, self.counts, self.links, self.digest = True, np.zeros(3, np.int64), [], hashlib.sha256()
        self.said = [] if with_groups else None

    def add(self, parts: list[tuple | None]) -> None:
        if None in parts:
            self.good = False
        if not self.good:
            return
        body = ";".join([p[0] for p in parts])
        if self.links:
            self.digest.update(b";")
        self.digest.update(body.encode())
        if self.said is not None:
            self.said.append(body)
        self.counts += np.frombuffer(b"".join([p[2] for p in parts]), np.int32).reshape(-1, 3).sum(axis=0, dtype=np.int64)
        self.links.append(np.unique(np.frombuffer(b"".join([p[1] for p in parts]), np.int64), return_counts=True))

    def row(self, places: np.ndarray) -> list:
        if not self.good or not self.links:
            return [0, 0, 0, 0, "", b"", b"", ""]
        names, times = self.links[0]
        if len(self.links) > 1:
            names, where = np.unique(np.concatenate([n for n, _ in self.links]), return_inverse=True)
            times = np.zeros(len(names), np.int64)
            np.add.at(times, where, np.concatenate([t for _, t in self.links]))
        n_a, n_b, n_groups = self.counts.tolist()
        at = np.searchsorted(places, names).astype("<i4").tobytes()
        return [n_a, n_b, n_groups, n_groups, self.digest.hexdigest(), at, times.astype("<i8").tobytes(), ";".join(self.said or ())]


def alignment(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> tuple[DataFrame, np.ndarray]:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (places of its distinct
    linked pairs among the linkable ones, 32-bit integers) and times (how often each); with `with_groups` also
    `groups`, the text `a1,a2|b1;a3|b2` itself. And the linkable pairs."""
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        specs = f.read(), g.read()
    pairs = Pair.load(*specs).linkable()
    context = docs.sparkSession.sparkContext
    shared, places = context.broadcast(specs), context.broadcast(pairs)
    key = ("aligner", *map(zlib.crc32, specs), *map(len, specs))
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, whole = once(key, lambda: _aligner(*shared.value))

        def flush(todo: list[tuple[_Document, list[str]]]) -> None:
            if units is None:
                for doc, some in todo:
                    doc.add(whole(some))
                return
            with no_collection():
                known = units.look_up(chain.from_iterable(some for _, some in todo)).__getitem__
            for doc, some in todo:
                doc.add(list(map(known, some)))

        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE)):
            found, todo, size = [], [], 0
            for text in batch.column("text"):
                text = text.as_py()
                found.append(doc := _Document(with_groups))
                for piece, _ in slices(text, BATCH_CHARS) if text and units else [(text, True)] if text else ():
                    todo.append((doc, cut(piece) if units else [piece]))
                    size += len(piece)
                    if size > BATCH_CHARS:
                        flush(todo)
                        todo, size = [], 0
            flush(todo)
            cells = list(zip(*[doc.row(places.value) for doc in found]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups"][: 8 + with_groups]
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(cells, kinds))]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, {ROWS}" + ", groups string" * with_groups), pairs


def pair_counts(aligned: DataFrame, pairs: np.ndarray) -> np.ndarray:
    """How many links of the corpus hold each linkable pair. Summed in each task, then by Spark; as many numbers
    as there are pairs come back."""
    n = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<i4")
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<i8")
            np.add.at(total, at, times)
        some = np.flatnonzero(total)
        for a in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[a : a + (1 << 16)]), pa.array(total[some[a : a + (1 << 16)]])], ["place", "links"])

    found = aligned.select("pairs", "times").mapInArrow(run, "place long, links long").groupBy("place").agg(F.sum("links").alias("links")).toArrow()
    out = np.zeros(n, np.int64)
    out[found.column("place").to_numpy()] = found.column("links").to_numpy()
    return out


def scored(aligned: DataFrame, pairs: np.ndarray, counts: np.ndarray) -> DataFrame:
    """`aligned` with n_best (links whose count is the highest of their B id) and count_sum (over links)."""
    b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == highest[b]))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            n_best, total = [], []
            for at, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                at, times = np.frombuffer(at, "<i4"), np.frombuffer(times, "<i8")
                n_best.append(int(times[best[at]].sum()))
                total.append(int((times * counts[at]).sum()))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*kept, "n_best", "count_sum"])

    id_type = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.select(*kept, "pairs", "times").mapInArrow(run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def token_links(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every document."""
    aligned, pairs = alignment(docs, a_file, b_file, id_col, text_col)
    aligned = stored(aligned)
    return scored(aligned, pairs, pair_counts(aligned, pairs))


def link_table(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, links, best: the corpus-wide links of every linked pair of token ids, which is the translation
    table between the tokenizers."""
    aligned, pairs = alignment(docs, a_file, b_file, id_col, text_col)
    counts = pair_counts(aligned, pairs)
    b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    some = np.flatnonzero(counts)
    table = pa.table({"a_id": pairs[some] >> 32, "b_id": b[some], "links": counts[some], "best": counts[some] == highest[b[some]]})
    return docs.sparkSession.createDataFrame(table)
