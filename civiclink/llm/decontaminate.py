"""Benchmark passages in training documents, found with one FM-index per training shard.

Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. A window is
`window` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

Each task cuts its documents into shards of about `shard_bytes`, indexes the words of each shard
(suffix array, wavelet matrix, sampled suffix positions) and the indexes are written as a table of
the shared folder. The windows come in blocks of at most `block_words` words; each block goes to
all indexes, which search its windows backward, locate the occurrences and merge the words they
cover into spans. A document longer than a shard goes into several, each beginning with the last
`window` - 1 words of the one before, and its spans are merged afterwards.

Null texts and texts without words have no hits; null and empty items have no windows. A
null item id reads "null". Repeated document rows get one row each, repeated items count once. Empty
tables are allowed on either side. Columns other than id and text are passed on by `decontaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from civiclink.llm.common import bound, packed, running, stored, unpacked
from civiclink.llm.fmindex import Index

WINDOW = 10
SHARD_BYTES = 6 << 20
BLOCK_WORDS = 1 << 18
ITEM_WORDS = 1 << 14
END = b"\n"

# Letters, digits and bytes beyond ASCII stay, A-Z becomes a-z, all else a blank.
CLEAN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

INDEX_SCHEMA = (
    "k1 array<bigint>, k2 array<bigint>, piece array<int>, start array<int>, skip array<int>, first array<bigint>, "
    "length int, vocabulary binary, rows binary, counts binary, marks binary, samples binary"
)
HIT_SCHEMA = "k1 long, k2 long, piece int, words long, spans array<struct<a:bigint,b:bigint>>, items array<string>"


def row_keys(id_value: Column, text: Column) -> list[Column]:
    """Two hashes that name a row; rows that share both have the same id and text."""
    return [F.xxhash64(id_value).alias("k1"), F.xxhash64(F.lit(1), text.cast("string")).alias("k2")]


def _pieces(clean: bytes, size: int, window: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of a long text and how many words each repeats from the one before. A piece has more
    words than it repeats, so each window of the text is whole in some piece."""
    start, repeated, end = 0, 0, 0
    while True:
        end = max(end, start) + size
        end = clean.find(b" ", end) if end < len(clean) else -1
        if end < 0:
            yield clean[start:], repeated
            return
        back = end
        for _ in range(window - 1):
            while back > start and clean[back - 1] == 0x20:
                back -= 1
            back = max(clean.rfind(b" ", start, back) + 1, start)
        if back > start and clean[start:back].strip():
            yield clean[start:end], repeated
            start, repeated = back, window - 1


def encoded(joined: bytes) -> tuple[np.ndarray, pa.Array]:
    """Words of a blank-separated text as numbers into the list of its distinct words."""
    data = np.frombuffer(joined, np.uint8)
    inside = data != 0x20
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    sizes = edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def _indexer(shard_bytes: int, window: int):
    def build(parts: list[tuple[int, int, int, bytes, int]], before: dict) -> pa.RecordBatch:
        joined = b"".join(clean + b" " + END + b" " for *_, clean, _ in parts)
        codes, words = encoded(joined)
        end = pc.index(words, pa.scalar(END, pa.large_binary())).as_py()
        # Symbol 0 is the end; the word that had number 0 takes the number of the end.
        seq = np.where(codes == end, 0, np.where(codes == 0, end, codes)) if end else codes
        spelled = words.to_pylist()
        spelled[0], spelled[end] = spelled[end], spelled[0]
        ends = np.flatnonzero(seq == 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        index = Index.build(seq, len(spelled), starts)
        first = []
        for (k1, k2, piece, _, skip), n in zip(parts, ends - starts):
            at = before.get((k1, k2), 0) if piece else 0
            first.append(at - skip)
            before.clear()
            before[(k1, k2)] = at - skip + int(n)
        row = {
            "k1": [p[0] for p in parts],
            "k2": [p[1] for p in parts],
            "piece": [p[2] for p in parts],
            "start": starts.tolist(),
            "skip": [p[4] for p in parts],
            "first": first,
            "length": len(seq),
            "vocabulary": END.join(spelled[1:]),
            **index,
        }
        return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, before = [], 0, {}
        for batch in batches:
            for k1, k2, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                clean = (data.as_py() or b"").translate(CLEAN)
                for piece, (text, skip) in enumerate(_pieces(clean, shard_bytes, window)):
                    parts.append((k1, k2, piece, text, skip))
                    size += len(text)
                    if size >= shard_bytes:
                        yield build(parts, before)
                        parts, size = [], 0
        if parts:
            yield build(parts, before)

    return run


def _arrow_schema() -> pa.Schema:
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    binary = dict.fromkeys(["vocabulary", "rows", "counts", "marks", "samples"], pa.binary())
    return pa.schema({"k1": longs, "k2": longs, "piece": ints, "start": ints, "skip": ints, "first": longs, "length": pa.int32()} | binary)


def index_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, window: int = WINDOW
) -> DataFrame:
    """Stored table of FM-indexes, one row per shard. It serves any benchmark with windows up to `window`."""
    data = docs[text_col].cast("string").cast("binary").alias("data")
    rows = docs.select(*row_keys(docs[id_col], docs[text_col]), data)
    return stored(rows.mapInArrow(_indexer(shard_bytes, window), INDEX_SCHEMA))


def _windows(items: list[tuple[str, bytes]], window: int) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """Distinct words; per window the item, the word numbers (right-aligned) and the length."""
    numbers: dict[bytes, int] = {}
    owners, lengths, rows = [], [], []
    for owner, (_, clean) in enumerate(items):
        codes = np.array([numbers.setdefault(w, len(numbers)) for w in clean.split()], np.int64)
        if not len(codes):
            continue
        n = min(window, len(codes))
        cut = np.lib.stride_tricks.sliding_window_view(codes, n)
        rows.append(np.pad(cut, ((0, 0), (window - n, 0))))
        owners.append(np.full(len(cut), owner))
        lengths.append(np.full(len(cut), n))
    if not rows:
        return [], [], np.zeros((0, window), np.int64), np.zeros(0, np.int64)
    return list(numbers), np.concatenate(owners).tolist(), np.concatenate(rows), np.concatenate(lengths)


def _searcher(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        words, owners, rows, lengths = _windows(items, window)
        owners = np.array(owners, np.int64)
        for batch in batches:
            for shard in batch.to_pylist():
                yield _hits(shard, [i for i, _ in items], words, owners, rows, lengths)

    return run


def _hits(shard: dict, ids: list[str], words: list[bytes], owners: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    n, start = shard["length"], np.array(shard["start"], np.int64)
    counts = np.frombuffer(shard["counts"], np.int32).astype(np.int64)
    vocabulary = pa.array(shard["vocabulary"].split(END) if len(counts) > 1 else [], pa.binary())
    symbol = pc.index_in(pa.array(words, pa.binary()), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    cover, seen = np.zeros(n + 1, np.int64), np.zeros((0, 2), np.int64)
    if len(rows) and len(vocabulary):
        phrases = symbol[rows]
        inside = np.arange(rows.shape[1])[None, :] >= rows.shape[1] - lengths[:, None]
        there = np.flatnonzero(((phrases > 0) | ~inside).all(axis=1))
        index = Index(n, shard["rows"], counts, shard["marks"], np.frombuffer(shard["samples"], np.int32).astype(np.int64))
        low, high = index.search(phrases[there], lengths[there])
        times = high - low
        which = np.repeat(there, times)
        row = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        at = index.locate(row)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + lengths[which], -1)
        doc = np.searchsorted(start, at, "right") - 1
        seen = np.unique(np.stack([doc, owners[which]], axis=1), axis=0)
    covered = (np.cumsum(cover) > 0).astype(np.int8)
    edges = np.flatnonzero(np.diff(covered, prepend=np.int8(0)))
    a, b = edges[::2], edges[1::2]
    doc = np.searchsorted(start, a, "right") - 1
    first = np.array(shard["first"], np.int64)
    spans = pa.StructArray.from_arrays([pa.array(x - start[doc] + first[doc]) for x in (a, b)], ["a", "b"])
    cuts = lambda of: pa.array(np.searchsorted(of, np.arange(len(start) + 1)).astype(np.int32))
    names = pa.array([ids[i] for i in seen[:, 1]], pa.string())
    sizes = np.diff(np.append(start, n)) - 1 - np.array(shard["skip"], np.int64)
    columns = [
        pa.array(shard["k1"], pa.int64()),
        pa.array(shard["k2"], pa.int64()),
        pa.array(shard["piece"], pa.int32()),
        pa.array(sizes),
        pa.ListArray.from_arrays(cuts(doc), spans),
        pa.ListArray.from_arrays(cuts(seen[:, 0]), names),
    ]
    return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "piece", "words", "spans", "items"])


def _item_pieces(window: int):
    """Items as cleaned texts of at most ITEM_WORDS words; later pieces repeat window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (data.as_py() or b"").translate(CLEAN).split()
                step = max(ITEM_WORDS, window)
                for i in range(0, max(1, len(words) - window + 1), step):
                    part = words[i : i + step + window - 1]
                    if part:
                        out.append({"item": item, "n": len(part), "clean": b" ".join(part)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema({"item": pa.string(), "n": pa.int64(), "clean": pa.binary()}))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of about `block_words` words, one at a time; at least one block."""
    rows = benchmark.select(
        F.coalesce(benchmark[item_col].cast("string"), F.lit("null")).alias("item"),
        benchmark[text_col].cast("string").cast("binary").alias("data"),
    )
    parts = stored(rows.mapInArrow(_item_pieces(window), "item string, n long, clean binary").distinct())
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for block in range(blocks):
        mine = parts.where(F.pmod(F.xxhash64("item", "clean"), F.lit(blocks)) == block)
        yield [(r["item"], bytes(r["clean"])) for r in mine.select("item", "clean").collect()]


def _merged(spans: Column) -> Column:
    """Spans sorted, with overlapping and touching ones joined: a span begins a new one if it begins
    behind the greatest end before it."""

    def join(both: Column) -> Column:
        ends, sorted_ = both["ends"], both["spans"]
        first = lambda s, i: (i == 0) | (s["a"] > F.get(ends, i - 1))
        begins = F.filter(F.transform(sorted_, lambda s, i: F.when(first(s, i), i)), lambda i: i.isNotNull())

        def whole(i: Column, n: Column, all_: Column) -> Column:
            last = F.coalesce(F.get(all_, n + 1), F.size(ends)) - 1
            return F.struct(F.get(sorted_, i)["a"].alias("a"), F.get(ends, last).alias("b"))

        return bound(begins, lambda all_: F.transform(all_, lambda i, n: whole(i, n, all_)))

    ordered = lambda s: F.struct(s.alias("spans"), running(F.transform(s, lambda x: x["b"]), F.greatest).alias("ends"))
    merged = bound(F.array_sort(spans), lambda s: bound(ordered(s), join))
    return F.when(F.size(spans) <= 1, spans).otherwise(merged)


def found_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per distinct (id, text): k1, k2, n_words, spans (word positions [a, b)), items (sorted)."""
    spark = docs.sparkSession
    index = index_shards(docs, id_col, text_col, shard_bytes, window)
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, window, block_words):
        hits = index.mapInArrow(_searcher(spark.sparkContext.broadcast(block), window), HIT_SCHEMA)
        found = hits if found is None else found.unionByName(hits)
    # Repeated rows and several blocks say the same words again: one row per piece first.
    some = lambda c: F.collect_set(F.when(F.size(c) > 0, F.col(c))).alias(c)
    pieces = found.groupBy("k1", "k2", "piece").agg(F.max("words").alias("words"), some("spans"), some("items"))
    every = lambda c: F.flatten(F.flatten(F.collect_list(c))).alias(c)
    whole = pieces.groupBy("k1", "k2").agg(F.sum("words").alias("n_words"), every("spans"), every("items"))
    return whole.select("k1", "k2", "n_words", _merged(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    found = stored(found_spans(docs, benchmark, id_col, text_col, **how))
    rows = docs.select(docs[id_col].alias("doc_id"), *row_keys(docs[id_col], docs[text_col]))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return rows.join(found, ["k1", "k2"]).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
    )


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for data, spans in zip(batch.column("data"), batch.column("spans").to_pylist()):
            data = data.as_py()
            clean = np.frombuffer(data.translate(CLEAN), np.uint8) != 0x20
            edges = np.flatnonzero(np.diff(clean.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            begins, ends = edges[::2], edges[1::2]
            kept, at = [], 0
            for s in spans:
                kept.append(data[at : begins[s["a"]]])
                at = ends[s["b"] - 1]
            texts.append(b"".join([*kept, data[at:]]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "cut"])


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **how
) -> DataFrame:
    """All rows and columns of `docs`; the words of removal spans, and what stands between them, are
    cut out of the text. Texts without hits are untouched. What a cut brings together is not searched
    again. `length_col` is set to the number of characters where a text was cut."""
    found = stored(found_spans(docs, benchmark, id_col, text_col, **how).where(F.size("spans") > 0).select("k1", "k2", "spans"))
    rows = packed(docs)
    row = lambda c: F.col("_row").getField(c)
    rows = rows.select("_row", *row_keys(row(id_col), row(text_col))).join(found, ["k1", "k2"], "left")
    hit = rows.where(F.col("spans").isNotNull()).select("_row", row(text_col).cast("string").cast("binary").alias("data"), "spans")
    schema = StructType([StructField("_row", hit.schema["_row"].dataType), StructField("cut", StringType())])
    new = {text_col: F.col("cut"), length_col: F.length("cut").cast(docs.schema[length_col].dataType) if length_col else None}
    cut = hit.mapInArrow(_cutter, schema).select(*[new.get(c, row(c)).alias(c) for c in docs.columns])
    clean = unpacked(rows.where(F.col("spans").isNull()), docs.columns)
    return clean.unionByName(cut)
