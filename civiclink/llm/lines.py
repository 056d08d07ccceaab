"""Line dedup by pairwise alignment: blocks of lines that an earlier document has go from the later one.

Documents are ordered by id (null ids last), repeated rows by their place in the table. Lines are compared
without outer and with single inner white space; blank lines count for nothing. Two documents are a pair if they
share a line. A rare line, of at most `rare` occurrences, makes pairs of all documents that have it; a more
frequent one pairs each document with the first that has it. The shortest run of lines from each line on that
reaches min_words does the same, so a block is found even if all its lines are frequent and came up
in different documents first. The pairs grow with the lines, not with the square of a group.

Each pair is aligned by patience diff over the lines that occur in more than one document: lines that are unique on both
sides and in common order are anchors, and the gaps between anchors are aligned the same way. A run of aligned
lines that are neighbours in both documents is a common block; from `min_words` words on it is
deleted from the later document. A diff aligns each line once and in order, and leaves gaps without unique lines; so the
lines of the later document that are still there are searched for every run of min_words words that the earlier
document has anywhere, until none is left: repeated, moved and swapped passages go too. Every deleted line has a copy in an earlier document, so the first one is
never lost.

Null and empty texts have no lines. A text that loses all its lines becomes empty, its row stays. An empty table
gives an empty result. Columns other than id and text are passed on by `without_common_blocks`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from civiclink.llm.common import packed, stored, unpacked
from civiclink.llm.decontaminate import _merged, row_keys

RARE = 8
MIN_WORDS = 50
Line = tuple[int, int, int]


def _lines(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, hash, words) of the lines of a text that are not blank; start and end in bytes."""
    at = 0
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            yield at, at + len(line), xxhash.xxh64_intdigest(b" ".join(words)), len(words)
        at += len(line) + 1


def runs(hashes: np.ndarray, words: list[int], min_words: int) -> list[int]:
    """Hash of the shortest run of lines from each line on that reaches min_words, where there is one."""
    packed_lines, out, end, total = hashes.tobytes(), [], 0, 0
    for start, n in enumerate(words):
        while end < len(words) and total < min_words:
            total += words[end]
            end += 1
        if total < min_words:
            break
        out.append(xxhash.xxh64_intdigest(packed_lines[8 * start : 8 * end]))
        total -= n
    return out


def _line_lists(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words, starts = [], [], []
            for data in batch.column("data"):
                lines = list(_lines(data.as_py() or b""))
                found = np.array([h for _, _, h, _ in lines], np.uint64)
                hashes.append(found.view(np.int64))
                words.append([n for *_, n in lines])
                starts.append(np.array(runs(found, words[-1], min_words), np.uint64).view(np.int64))
            longs = pa.list_(pa.int64())
            columns = [*batch.columns[:3], pa.array(hashes, longs), pa.array(words, pa.list_(pa.int32())), pa.array(starts, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "hashes", "words", "runs"])

    return run


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Stored: row (long), doc_id, k1, k2, hashes and words of the lines that are not blank, and hashes of
    the runs that reach min_words."""
    rows = docs.select(docs[id_col].alias("doc_id"), *row_keys(docs[id_col], docs[text_col]), docs[text_col].cast("string").cast("binary").alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = rows.mapInArrow(_line_lists(min_words), f"doc_id {kind}, k1 long, k2 long, hashes array<bigint>, words array<int>, runs array<bigint>")
    return stored(lists.select(F.monotonically_increasing_id().alias("row"), "*"))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at, there = _unique(a, a0, a1), _unique(b, b0, b1)
        anchors = _increasing([(i, there[x]) for x, i in at.items() if x in there])
        if not anchors:
            continue
        last_a, last_b = a0, b0
        for i, j in anchors:
            todo.append((last_a, i, last_b, j))
            out.append((i, j))
            last_a, last_b = i + 1, j + 1
        todo.append((last_a, a1, last_b, b1))
    return sorted(out)


def _unique(lines: list[int], start: int, end: int) -> dict[int, int]:
    """Position of each line that occurs once between start and end, in order."""
    at: dict[int, int] = {}
    for i in range(start, end):
        at[lines[i]] = -1 if lines[i] in at else i
    return {x: i for x, i in at.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first number) with increasing second numbers."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile:
            back[n] = piles[pile - 1]
        if pile == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[pile], piles[pile] = j, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _aligned(earlier: list[Line], later: list[Line], min_words: int) -> list[tuple[int, int]]:
    """Blocks that one patience diff finds."""
    found, run, words = [], [], 0

    def close() -> None:
        if words >= min_words:
            found.append((later[run[0]][0], later[run[-1]][0] + 1))

    before = None
    for i, j in patience([x[1] for x in earlier], [x[1] for x in later]):
        place = (earlier[i][0], later[j][0])
        if before is None or place != (before[0] + 1, before[1] + 1):
            if run:
                close()
            run, words = [], 0
        run.append(j)
        words += later[j][2]
        before = place
    if run:
        close()
    return found


def _pieces(lines: list[Line], gone: set[int]) -> list[list[Line]]:
    """Runs of lines that are neighbours, without the positions in `gone`."""
    out: list[list[Line]] = []
    last = -2
    for line in lines:
        if line[0] in gone:
            continue
        if line[0] == last + 1:
            out[-1].append(line)
        else:
            out.append([line])
        last = line[0]
    return out


def _run_set(piece: list[Line], min_words: int) -> set[int]:
    return set(runs(np.array([x[1] for x in piece], np.int64), [x[2] for x in piece], min_words))


class _Stretches:
    """Suffix automaton of the runs of lines of some pieces; its size grows with the lines."""

    def __init__(self, pieces: list[list[Line]]):
        self.next: list[dict] = [{}]
        self.link, self.size, self.last = [-1], [0], 0
        for number, piece in enumerate(pieces):
            for _, h, _ in piece:
                self._add(h)
            self._add(("end", number))

    def _add(self, symbol) -> None:
        now, at = len(self.next), self.last
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[at] + 1)
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = now
            at = self.link[at]
        if at >= 0:
            there = self.next[at][symbol]
            if self.size[there] == self.size[at] + 1:
                self.link[now] = there
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[there]))
                self.link.append(self.link[there])
                self.size.append(self.size[at] + 1)
                while at >= 0 and self.next[at].get(symbol) == there:
                    self.next[at][symbol] = copy
                    at = self.link[at]
                self.link[there] = self.link[now] = copy
        self.last = now

    def longest(self, piece: list[Line]) -> Iterator[int]:
        """For each line, how many lines up to it are one of the runs."""
        at = size = 0
        for _, h, _ in piece:
            while at and h not in self.next[at]:
                at = self.link[at]
                size = self.size[at]
            if h in self.next[at]:
                at, size = self.next[at][h], size + 1
            yield size


def _left(earlier: list[Line], later: list[Line], found: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """All blocks among the lines of the later document outside `found`."""
    pieces = _pieces(later, {i for a, b in found for i in range(a, b)})
    pieces = [p for p in pieces if sum(x[2] for x in p) >= min_words]
    if not pieces:
        return []
    there = _pieces(earlier, set())
    known = set().union(*(_run_set(p, min_words) for p in there))
    pieces = [p for p in pieces if not known.isdisjoint(_run_set(p, min_words))]
    if not pieces:
        return []
    stretches, out = _Stretches(there), []
    for piece in pieces:
        upto = [0, *accumulate(x[2] for x in piece)]
        for end, size in enumerate(stretches.longest(piece), 1):
            if upto[end] - upto[end - size] >= min_words:
                out.append((piece[end - size][0], piece[end - 1][0] + 1))
    return out


def blocks(earlier: list[Line], later: list[Line], min_words: int) -> list[tuple[int, int]]:
    """Common blocks as line ranges [a, b) of the later document, in order. Documents are lists of
    (line position, hash, words); positions that are missing are lines nobody shares."""
    found = _aligned(earlier, later, min_words)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found + _left(earlier, later, found, min_words)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _aligner(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triples = lambda lines: [(x["pos"], x["h"], x["n"]) for x in lines]
        for batch in batches:
            rows, spans = [], []
            for later, a, b in zip(*(batch.column(n).to_pylist() for n in ("later", "a_lines", "b_lines"))):
                if found := blocks(triples(a), triples(b), min_words):
                    rows.append(later)
                    spans.append([{"a": x, "b": y} for x, y in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.struct({"a": pa.int64(), "b": pa.int64()})))], ["row", "spans"]
            )

    return run


def common_blocks(table: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """row, spans: line ranges to delete, for the rows of a line table (of the same min_words) that have some."""
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row").alias("place")
    lines = table.select("row", place, F.posexplode(F.arrays_zip("hashes", "words")).alias("pos", "line"))
    lines = lines.select("row", "place", "pos", F.col("line.hashes").alias("h"), F.col("line.words").alias("n"))
    holders = lines.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("times"))
    # Stored, so that the join deals out both sides itself and can split a very common line.
    holders = stored(holders.where(F.col("first") != F.col("last")).drop("last"))
    shared = stored(lines.join(holders, "h"))
    few = shared.where(F.col("times") <= rare).groupBy("h").agg(F.sort_array(F.collect_set("place")).alias("p"))
    two = F.expr("explode(flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> struct(x.row AS earlier, y.row AS later)))))")
    many = shared.where((F.col("times") > rare) & (F.col("first") != F.col("place")))
    stretches = table.select("row", place, F.explode("runs").alias("h"))
    begun = stretches.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    begun = stored(begun.where(F.col("first") != F.col("last")).drop("last"))
    same = stretches.join(begun, "h").where(F.col("first") != F.col("place"))
    with_first = lambda rows: rows.select(F.col("first.row").alias("earlier"), F.col("row").alias("later"))
    pairs = few.select(two.alias("two")).select("two.*").unionByName(with_first(many)).unionByName(with_first(same))
    own = stored(shared.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "n"))).alias("lines")))
    # A pair can only have a block if either side has enough shared words at all.
    own = own.where(F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"]) >= min_words)
    pairs = pairs.distinct().join(own.select(F.col("row").alias("later"), F.col("lines").alias("b_lines")), "later")
    pairs = pairs.join(own.select(F.col("row").alias("earlier"), F.col("lines").alias("a_lines")), "earlier")
    found = pairs.select("later", "a_lines", "b_lines").mapInArrow(_aligner(min_words), "row long, spans array<struct<a:bigint,b:bigint>>")
    return found.groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("spans")).select("row", _merged(F.col("spans")).alias("spans"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, lines_removed, words_removed, removed (ranges a:b
    of lines that are not blank)."""
    table = line_table(docs, id_col, text_col, min_words)
    rows = table.join(common_blocks(table, rare, min_words), "row", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    number = lambda use: F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + use(x))
    inside = lambda x: F.aggregate(F.slice("words", x["a"].cast("int") + 1, (x["b"] - x["a"]).cast("int")), F.lit(0).cast("long"), lambda s, n: s + n)
    return rows.select(
        "doc_id",
        F.size("hashes").cast("long").alias("n_lines"),
        number(lambda x: x["b"] - x["a"]).alias("lines_removed"),
        number(inside).alias("words_removed"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",").alias("removed"),
    )


def _deleter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for data, spans in zip(batch.column("data"), batch.column("spans").to_pylist()):
            data = data.as_py()
            lines, kept, at = list(_lines(data)), [], 0
            for s in spans:
                kept.append(data[at : lines[s["a"]][0]])
                at = min(lines[s["b"] - 1][1] + 1, len(data))
            texts.append(b"".join([*kept, data[at:]]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "cut"])


def without_common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of `docs`, the common blocks deleted from the texts of later documents.

    Of repeated rows (same id and text) the first keeps its text; the others become empty if
    their lines reach min_words."""
    table = line_table(docs, id_col, text_col, min_words)
    found = table.select("row", "k1", "k2").join(common_blocks(table, rare, min_words), "row")
    times = table.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"))
    found = found.join(times, ["k1", "k2"]).groupBy("k1", "k2", "times").agg(F.collect_list("spans").alias("cuts"))
    rows = packed(docs)
    row = lambda c: F.col("_row").getField(c)
    rows = rows.select("_row", *row_keys(row(id_col), row(text_col))).join(stored(found), ["k1", "k2"], "left")
    # Rows of one name are exchangeable: each takes one of the cuts, those without stay whole.
    one = rows.where((F.col("times") == 1) | F.col("cuts").isNull()).select("_row", F.get("cuts", F.lit(0)).alias("spans"))
    many = rows.where(F.col("times") > 1).groupBy("k1", "k2", "times", "cuts").agg(F.first("_row").alias("_row"))
    many = many.select("_row", F.explode(F.expr("transform(sequence(0, int(times) - 1), i -> get(cuts, i))")).alias("spans"))
    rows = one.unionByName(many)
    hit = rows.where(F.col("spans").isNotNull()).select("_row", row(text_col).cast("string").cast("binary").alias("data"), "spans")
    schema = StructType([StructField("_row", hit.schema["_row"].dataType), StructField("cut", StringType())])
    cut = hit.mapInArrow(_deleter, schema).select(*[(F.col("cut") if c == text_col else row(c)).alias(c) for c in docs.columns])
    return unpacked(rows.where(F.col("spans").isNull()), docs.columns).unionByName(cut)
