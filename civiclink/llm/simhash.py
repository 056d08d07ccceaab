"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has one bit per position of a 64-bit shingle hash: set if more than half of the
shingles of the text (repeats included) have it. Two fingerprints are linked if they differ in at
most `distance` bits; documents reachable through links form a component.

Links are found by multi-index hashing. The 64 bits are cut into segments. By the pigeonhole
principle two linked fingerprints are close in at least one segment, so each fingerprint goes into
one table per segment, looks up the small Hamming ball around its own segment value there, and the
complete distance decides. Of two values that differ, only the smaller one looks up the larger, which
halves the look-ups and misses nothing. Work starts from distinct fingerprints: copies cost nothing.

A table entry in which more than `crowd` fingerprints may meet, those that look it up included, is looked up by part of the remaining bits as
well (a second index inside the entry). With two segments an entry of the second index fixes 48
bits, so at most 65,536 fingerprints are at home in it, and at most those of its ball visit it, whatever the size of the corpus. Inside an
entry fingerprints are joined into groups one by one, and each group leaves one row per member:
pairs are never listed.

Nulls and texts without words have fingerprint zero and are linked like any other. A null id is a
member of its component and never its name, unless all ids of a component are null. Repeated rows
get one row each. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.llm.common import packed, stored, unpacked, word_lists

SEED = 42
CROWD = 4096


def fingerprint(data: bytes | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_lists((data or b"").lower()):
        words = tail + words
        hashes = _shingle_hashes(words, shingle)
        counts += _bit_counts(hashes)
        total += len(hashes)
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not total and tail:
        counts, total = _bit_counts([xxhash.xxh64_intdigest(b" ".join(tail), SEED)]), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def _shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    if len(words) < shingle:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]


def _bit_counts(hashes: list[int]) -> np.ndarray:
    if not hashes:
        return np.zeros(64, np.int64)
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), fp for each row of `docs`."""
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("text_key"),
        docs[text_col].cast("string").cast("binary").alias("data"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), shingle) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]


def _cuts(width: int, parts: int, distance: int) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment that has to be looked at."""
    edges = [round(width * i / parts) for i in range(parts + 1)]
    whole, more = divmod(distance, parts)
    radii = [whole if i <= more else whole - 1 for i in range(parts)]
    return [(a, b - a, r) for a, b, r in zip(edges, edges[1:], radii) if r >= 0]


def _bits(value: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(value, offset).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(value: Column, masks: list[int]) -> Column:
    if not masks:
        return F.array().cast("array<bigint>")
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def _upward(value: Column, masks: list[int]) -> Column:
    return F.filter(_flipped(value, masks), lambda v: v > value)


def _outward(value: Column, masks: list[int], home: Column) -> Column:
    """Upward for entries at home, in both directions for visitors."""
    return F.filter(_flipped(value, masks), lambda v: ~home | (v > value))


def _entries(seg: int, value: Column, home: Column, probes: Column) -> Column:
    """Structs (part, value, home): the own entry and the looked-up ones."""
    item = lambda v, h: F.struct(F.lit(seg).alias("part"), v.alias("value"), h.alias("home"))
    return F.concat(F.array(item(value, home)), F.transform(probes, lambda v: item(v, F.lit(False))))


def _indexed(prints: DataFrame, segments: int, distance: int) -> DataFrame:
    """seg, value, home, fp, rest: each fingerprint under its own and the looked-up entries."""
    entries = []
    for seg, (offset, width, radius) in enumerate(_cuts(64, segments, distance)):
        own = _bits(F.col("fp"), offset, width)
        entries.append(_entries(seg, own, F.lit(True), _upward(own, _ball(width, radius))))
    rows = prints.select("fp", F.explode(F.concat(*entries)).alias("e"))
    return rows.select(F.col("e.part").alias("seg"), F.col("e.value").alias("value"), F.col("e.home").alias("home"), "fp")


def _split_crowds(rows: DataFrame, crowded: DataFrame, segments: int, distance: int) -> DataFrame:
    """Rows of crowded entries move to the second index: sub and subvalue are set there."""
    rows = rows.join(crowded.withColumn("full", F.lit(True)), ["seg", "value"], "left")
    inner, inner_width = [], {}
    for seg, (offset, width, _) in enumerate(_cuts(64, segments, distance)):
        low = _bits(F.col("fp"), 0, offset) if offset else F.lit(0).cast("long")
        high = F.shiftrightunsigned(F.col("fp"), offset + width) if offset + width < 64 else F.lit(0).cast("long")
        rest, inner_width[seg] = F.shiftleft(high, offset).bitwiseOR(low), 64 - width
        entries = []
        for sub, (o, w, r) in enumerate(_cuts(64 - width, 2, distance)):
            own = _bits(rest, o, w)
            entries.append(_entries(sub, own, F.col("home"), _outward(own, _ball(w, r), F.col("home"))))
        inner.append(F.when(F.col("seg") == seg, F.concat(*entries)))
    outside = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value"), F.col("home").alias("home")))
    spread = F.when(F.col("full"), F.coalesce(*inner)).otherwise(outside)
    rows = rows.select("seg", "value", "fp", F.explode(spread).alias("e"))
    return rows.select("seg", "value", F.col("e.part").alias("sub"), F.col("e.value").alias("subvalue"), F.col("e.home").alias("home"), "fp")


def _join_entry(home: np.ndarray, visiting: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int]]:
    """Groups of linked fingerprints of one entry: (members, smallest member)."""
    home, visiting = np.unique(home).view(np.uint64), np.unique(visiting).view(np.uint64)
    while len(home):
        queue, members = [home[0]], [home[0]]
        at_home = {int(home[0])}
        home = home[1:]
        while queue:
            one = queue.pop()
            near = np.bitwise_count(home ^ one) <= distance
            found = list(home[near])
            at_home.update(map(int, found))
            home = home[~near]
            if int(one) in at_home:
                near = np.bitwise_count(visiting ^ one) <= distance
                found += list(visiting[near])
                visiting = visiting[~near]
            queue += found
            members += found
        group = np.unique(np.array(members, np.uint64).view(np.int64))
        if len(group) > 1:
            yield group[1:], int(group[0])


def _linker(distance: int):
    """Arrow batches of sorted index rows -> (u, v): u belongs to the group of v."""
    keys = ["seg", "value", "sub", "subvalue"]

    def entries(columns: dict[str, np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
        fp, home = columns["fp"], columns["home"]
        sizes = np.diff(bounds)
        starts = bounds[:-1][(sizes >= 2) & home[bounds[:-1]]]
        sizes = sizes[(sizes >= 2) & home[bounds[:-1]]]
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        linked = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= distance)
        us, vs = [np.maximum(a, b)[linked]], [np.minimum(a, b)[linked]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            part, own = fp[start : start + size], home[start : start + size]
            for members, least in _join_entry(part[own], part[~own], distance):
                us.append(members)
                vs.append(np.full(len(members), least, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in [*keys, "home", "fp"]}
            held.append(now)
            if all(now[k][0] == now[k][-1] == held[0][k][-1] for k in keys):
                continue  # still the entry that was open before
            columns = {n: np.concatenate([h[n] for h in held]) for n in now}
            new = np.zeros(len(columns["fp"]), bool)
            new[0] = True
            for k in keys:
                new[1:] |= columns[k][1:] != columns[k][:-1]
            bounds = np.flatnonzero(new)
            yield entries(columns, bounds)
            held = [{n: c[bounds[-1] :] for n, c in columns.items()}]
        if held:
            columns = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            new = np.zeros(len(columns["fp"]), bool)
            new[0] = True
            for k in keys:
                new[1:] |= columns[k][1:] != columns[k][:-1]
            yield entries(columns, np.append(np.flatnonzero(new), len(new)))

    return run


def _crowded(rows: DataFrame, segments: int, distance: int, crowd: int) -> DataFrame:
    """seg, value of every entry that more than `crowd` rows may meet in, visitors included. An entry is at
    home to one value and visited from at most all of its ball; if neither its own fingerprints nor
    those of any value in the ball are more than their share of `crowd`, it is not crowded."""
    balls = [_ball(width, radius) for _, width, radius in _cuts(64, segments, distance)]
    share = crowd // (1 + max(map(len, balls)))
    many = rows.where("home").groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
    around = F.coalesce(*(F.when(F.col("seg") == seg, _upward(F.col("value"), ball)) for seg, ball in enumerate(balls)))
    return many.select("seg", F.explode(F.concat(F.array("value"), around)).alias("value")).distinct()


def links(prints: DataFrame, distance: int = 3, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """u, v (v < u): enough links between the distinct fingerprints `fp` to connect every component."""
    rows = _indexed(prints.select("fp"), segments, distance)
    crowded = stored(_crowded(rows, segments, distance, crowd))
    rows = _split_crowds(rows, crowded, segments, distance)
    keys = ["seg", "value", "sub", "subvalue"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("home").desc())
    return rows.mapInArrow(_linker(distance), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node of `edges` (u, v with v < u) that is not the smallest of its component.

    Large-star and small-star steps alternate until nothing changes; each round is written to the
    shared folder, only a count and a checksum come to the driver."""
    edges, before = stored(edges), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            return edges.withColumnRenamed("v", "root")
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 3,
    segments: int = 2,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, fp, component_id, and `first`, the (missing,
    doc_id, text_key) struct that names the row of the component to keep."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    name = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    distinct = stored(rows.groupBy("fp").agg(F.min(name).alias("first")))
    roots = components(links(distinct, distance, segments, crowd))
    distinct = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = distinct.groupBy("root").agg(F.min("first").alias("first"))
    named = distinct.select("fp", "root").join(firsts, "root").select("fp", "first")
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"), "first")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of `docs`, all columns, one per component: the row of the smallest id. Of repeated rows
    with that id and text one stays."""
    found = near_duplicates(docs, id_col, text_col, **how)
    chosen = found.where(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key") == F.col("first"))
    chosen = chosen.groupBy("doc_id", "text_key").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    chosen = stored(chosen).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "repeated")
    rows = packed(docs)
    key = F.xxhash64(F.col("_row").getField(text_col).cast("string"))
    rows = rows.join(chosen, (F.col("_row").getField(id_col).eqNullSafe(F.col("_id"))) & (key == F.col("_key")))
    single = rows.where(~F.col("repeated")).select("_row")
    again = rows.where("repeated").groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row")
    return unpacked(single.unionByName(again), docs.columns)
