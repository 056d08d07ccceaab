"""Token ids as files of compressed bit planes.

Every text is encoded by a byte-level tokenizer of the `tokenizers` library, an end id is appended, and
the ids of all documents, in ascending order of document id, become one stream that is cut into files.

File format (little-endian)::

    8 bytes   b"PLANES01"
    chunks    one after the other; a chunk has CHUNK ids, the last of a file fewer. Its ids are transposed
              into planes, plane 0 first, and each plane is one zstandard frame.
              bit planes: bit k of every id, eight ids a byte, first id in the highest bit.
              byte planes: byte k of every id.
              Planes beyond the largest id of the chunk are left out.
    documents Arrow IPC stream, zstandard: doc_id, n_tokens
    index     Arrow IPC stream: at (offset of the chunk in the file), n (ids), sizes (bytes of each
              plane), crc32 (of the ids as unsigned 32-bit integers)
    32 bytes  offsets of documents and index, ids in the file (unsigned 64-bit), b"PLANES01"

So ids `a` to `b` of a file are read by the index alone, and each chunk is checked when it is read. A file ends
with a document; it has FILE_IDS ids, unless one document is longer.

Ids are worked out once and stored, then ordered by ranges of document id; a task streams its range into
files and holds one chunk and one Arrow batch at a time, so neither the length of a document nor the size of a range
matters. Names of files carry a random part, and a file counts only if the row about it was committed
by Spark; what a lost executor leaves behind is never read. pyarrow opens the files, by the scheme of the folder.

Null text is empty: its document has the end id alone. A null document id comes first. Documents of the
same id are ordered by a hash of the text, repeated rows have a place each. Special tokens written out in a
text are encoded as the tokenizer does by itself. An empty table makes no file. Other columns are not used.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclink.llm.common import stored
from civiclink.llm.units import SLICE, Units, cut, cut_all, cut_lines, is_letter, numbered, once, slices

MAGIC = b"PLANES01"
TAIL = "<QQQ8s"
CHUNK = 1 << 16
FILE_IDS = 1 << 25
LEVEL = 3
BATCH_CHARS = 1 << 23
CODED_CHARS = 1 << 20
WRITE_ROWS = 1024
INDEX = pa.schema({"at": pa.int64(), "n": pa.int64(), "sizes": pa.list_(pa.int32()), "crc32": pa.int64()})
PARTS = ["doc_id", "tie", "uid", "part", "last", "n", "ids"]
FILES = "part int, file int, path string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of a chunk, uncompressed. Seven spare bits at the end of a bit plane are zero."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    used = -(-top // 8)
    if not bits:
        return [raw[:, k].tobytes() for k in range(used)]
    grid = np.unpackbits(raw[:, :used], axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(grid.T), axis=1)[:top]]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The ids again."""
    if not planes:
        return np.zeros(n, "<u4")
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.view("<u4").ravel()
    grid = np.unpackbits(np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1), axis=1, count=n)
    full = np.zeros((n, 32), np.uint8)
    full[:, : len(planes)] = grid.T
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


@dataclass
class Writer:
    """One file. `add` takes ids and, for documents that end in them, their lengths."""

    path: str
    bits: bool = False
    id_type: pa.DataType = field(default_factory=pa.int64)

    def __post_init__(self):
        files, place = pafs.FileSystem.from_uri(self.path)
        files.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(place)
        self.out.write(MAGIC)
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.n_ids, self.rest, self.n_docs = len(MAGIC), 0, np.zeros(0, "<u4"), 0
        self.index: list[tuple] = []
        self.docs: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.n_docs += len(lengths)
        self.docs.append((doc_ids, lengths))
        ids = np.concatenate([self.rest, ids.astype("<u4")])
        cut = len(ids) - len(ids) % CHUNK
        for a in range(0, cut, CHUNK):
            self._chunk(ids[a : a + CHUNK])
        self.rest = ids[cut:].copy()

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
        self.index.append((self.at, len(ids), [len(p) for p in planes], crc))
        data = b"".join(planes)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> int:
        """Bytes of the file."""
        if len(self.rest):
            self._chunk(self.rest)
        names = pa.concat_arrays([d for d, _ in self.docs]) if self.docs else pa.array([], self.id_type)
        counts = np.concatenate([c for _, c in self.docs]) if self.docs else np.zeros(0, np.int64)
        docs = self.zip.compress(_ipc(pa.table({"doc_id": names, "n_tokens": pa.array(counts, pa.int64())})))
        columns = list(zip(*self.index)) or [()] * len(INDEX)
        meta = {b"bits": b"1" if self.bits else b"0"}
        index = _ipc(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, INDEX.types)], schema=INDEX.with_metadata(meta)))
        self.out.write(docs + index + struct.pack(TAIL, self.at, self.at + len(docs), self.n_ids, MAGIC))
        self.out.close()
        return self.at + len(docs) + len(index) + struct.calcsize(TAIL)


class Reader:
    """One file: the chunk index, the documents, and any stretch of ids."""

    def __init__(self, path: str):
        files, place = pafs.FileSystem.from_uri(path)
        self.file, self.size = files.open_input_file(place), files.get_file_info(place).size
        docs_at, index_at, self.n_ids, magic = struct.unpack(TAIL, self._bytes(self.size - struct.calcsize(TAIL), struct.calcsize(TAIL)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of planes")
        index = pa.ipc.open_stream(self._bytes(index_at, self.size - struct.calcsize(TAIL) - index_at)).read_all()
        self.bits = index.schema.metadata[b"bits"] == b"1"
        self.index = list(zip(*(c.to_pylist() for c in index.columns)))
        self._docs = docs_at, index_at - docs_at
        self.unzip = zstandard.ZstdDecompressor()

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def documents(self) -> pa.Table:
        """doc_id, n_tokens in the order of the file."""
        data = self.unzip.decompressobj().decompress(self._bytes(*self._docs))
        return pa.ipc.open_stream(data).read_all()

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes, crc = self.index[k]
        data, planes = memoryview(self._bytes(at, sum(sizes))), []
        for size in sizes:
            planes.append(self.unzip.decompress(data[:size]))
            data = data[size:]
        ids = from_planes(planes, n, self.bits)
        if zlib.crc32(ids) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids `first` to `first + n` of the file; only the chunks that hold them are read."""
        if n <= 0:
            return np.zeros(0, "<u4")
        a, b = first // CHUNK, (first + n - 1) // CHUNK
        found = np.concatenate([self.chunk(k) for k in range(a, min(b, len(self.index) - 1) + 1)] or [np.zeros(0, "<u4")])
        return found[first - a * CHUNK : first - a * CHUNK + n]

    def close(self) -> None:
        self.file.close()


def _tokenizer(spec: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec.decode())


def _id_units(spec: bytes) -> tuple:
    """A function from texts to ids, as bytes of unsigned 32-bit integers, the same for units, and a function that cuts
    a text into units. A byte-level splitter takes a line break between other characters for a piece of its own, so
    there units begin with line breaks too, which stand behind no blank."""
    tokenizer, said = _tokenizer(spec), json.loads(spec)

    def coded(texts: list[str]) -> list[bytes]:
        """Some texts at a time, for the library's encodings take far more room than ids."""
        out, a, size = [], 0, 0
        for b, text in enumerate(texts, 1):
            size += len(text)
            if size > CODED_CHARS or b == len(texts):
                out += [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
                a, size = b, 0
        return out

    split = said["pre_tokenizer"] or {}
    plain = not said["normalizer"] and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    model, pieces = tokenizer.model, tokenizer.pre_tokenizer
    latin = {i: pieces.pre_tokenize_str(chr(i))[0][0] for i in range(128, 256) if is_letter(chr(i))} if plain else {}
    blank = pieces.pre_tokenize_str(" a")[0][0][0] if plain else ""
    (line_break,) = coded(["\n"])

    def words(units: list[str]) -> list[bytes]:
        """A blank and letters, or a blank and digits, are one piece to a byte-level splitter: the model alone encodes it."""
        if not plain:
            return coded([" " + u for u in units])
        tokenize, out, rest = model.tokenize, [], []
        for i, u in enumerate(units):
            before, ids = blank, b""
            if u[:1] == "\n":
                before, ids, u = "", line_break, u[1:]
            if u.isascii() and u.isalnum() and (u.isalpha() or u.isdigit()) or u.isalpha() and max(u) <= "ÿ":
                out.append(ids + array("I", [t.id for t in tokenize(before + (u if u.isascii() else u.translate(latin)))]).tobytes())
            else:
                out.append(b"")
                rest.append(i)
        for i, ids in zip(rest, coded([units[i] if units[i][:1] == "\n" else " " + units[i] for i in rest])):
            out[i] = ids
        return out

    return coded, Units(words, coded, lambda a, b: a + b, ends=False), cut_lines if plain else cut


def _pieces(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, long ones in slices, in arrays of about BATCH_CHARS bytes: the texts, and for each its row, the number of the
    slice, and whether it is the last."""
    ends = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
    a = 0
    while a < len(ends):
        done = int(ends[a - 1]) if a else 0
        if ends[a] - done > SLICE:
            for part, (piece, last) in enumerate(slices(column[a].as_py())):
                yield pa.array([piece], column.type), np.array([a]), np.array([part]), np.array([last])
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(ends, done + BATCH_CHARS, "right")))
        long_ones = np.flatnonzero(np.diff(ends[a:b], prepend=done) > SLICE)
        b = a + int(long_ones[0]) if len(long_ones) else b
        yield column.slice(a, b - a), np.arange(a, b), np.zeros(b - a, np.int64), np.ones(b - a, bool)
        a = b


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every document in parts of about a million characters of text: doc_id, tie, uid (one per row of
    `docs`), part, last, n, ids (of 16 bits each if the vocabulary allows, else of 32).
    `tokenizer_file` is on the driver; its text goes to the executors."""
    with open(tokenizer_file, "rb") as f:
        spec = f.read()
    kind = "<u2" if max(_tokenizer(spec).get_vocab_size(), end_id or 0) <= 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    key = ("ids", zlib.crc32(spec), len(spec))
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("tie"), F.coalesce(text, F.lit("")).alias("text"))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, units, cut_up = once(key, lambda: _id_units(shared.value))
        base = TaskContext.get().partitionId() << 40

        def ids_of(texts: pa.Array, part: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, pa.Array]:
            """Numbers of ids, and ids, of slices of texts."""
            listed = cut_all(texts, lines=cut_up is cut_lines)
            bounds = listed.offsets.to_numpy().astype(np.int64)
            # Only the first unit of a text stands behind nothing; further slices begin behind a blank.
            first = np.zeros(len(listed.values), bool)
            first[bounds[:-1][part == 0]] = True
            others, known = numbered(listed.values.filter(pa.array(~first)), units, coded)
            starts = coded(listed.values.filter(pa.array(first)).to_pylist())
            places = np.empty(len(first), np.int64)
            places[~first] = others
            places[first] = np.arange(len(known), len(known) + len(starts))
            places = np.insert(places, bounds[1:][last], len(known) + len(starts))
            bounds[1:] += np.cumsum(last)
            found = pa.concat_arrays([known, pa.array([*starts, end], pa.large_binary())]).take(pa.array(places))
            at = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1][bounds] >> 2
            data = np.frombuffer(found.buffers()[2] or b"", "<u4", at[-1]).astype(kind)
            offsets = (at * data.itemsize).astype(np.int32)
            return np.diff(at), pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

        for batch in batches:
            for texts, row, part, last in _pieces(batch.column("text")):
                counts, ids = ids_of(texts, part, last)
                at, uids, numbers, counts = pa.array(row), pa.array(base + row), pa.array(part, pa.int32()), pa.array(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), uids, numbers, pa.array(last), counts, ids], PARTS)
            base += batch.num_rows

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, tie long, uid long, part int, last boolean, n long, ids binary")


def write_ids(parts: DataFrame, folder: str, bits: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """Write what `encoded` made (as a stored table, for it is read twice) as files of `folder`. The table of
    files: part and file (their order), path, n_docs, n_ids, n_bytes."""
    tasks = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // file_ids))
    order = ["doc_id", "tie", "uid", "part"]
    ordered = parts.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    names = FILES.replace(",", " ").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, out, carried = TaskContext.get().partitionId(), 0, None, 0

        def closed() -> pa.RecordBatch:
            row = [task, made, out.path, out.n_docs, out.n_ids, out.close()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names)

        for batch in (b.slice(a, WRITE_ROWS) for b in batches for a in range(0, b.num_rows, WRITE_ROWS)):
            if out is None:
                out = Writer(f"{folder}/ids-{task:06d}-{made:04d}-{uuid.uuid4().hex}.planes", bits, batch.schema.field("doc_id").type)
            counts, last = batch.column("n").to_numpy(), batch.column("last").to_numpy(zero_copy_only=False)
            data = b"".join(batch.column("ids").to_pylist())
            ids = np.frombuffer(data, "<u4" if len(data) == 4 * counts.sum() else "<u2")
            total = np.cumsum(counts) + carried
            ends = total[last]
            out.add(ids, batch.column("doc_id").filter(pa.array(last)), np.diff(ends, prepend=0))
            carried = int(total[-1] - (ends[-1] if len(ends) else 0))
            if out.n_ids >= file_ids and last[-1]:
                yield closed()
                out, made = None, made + 1
        if out is not None:
            yield closed()

    return stored(ordered.select("doc_id", "last", "n", "ids").mapInArrow(run, FILES))


def read_documents(files: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and `ids` if asked
    for. A file is read chunk by chunk."""
    before = F.expr("sum(n_ids) OVER (ORDER BY part, file) - n_ids")  # one row per file
    starts = stored(files.select("path", before.alias("base")))
    count = starts.count()
    if count:
        starts = starts.repartitionByRange(count, "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                yield from _documents(path, base, with_ids)

    more = ", ids array<int>" if with_ids else ""
    return starts.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long{more}")


def _documents(path: str, base: int, with_ids: bool, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    reader = Reader(path)
    docs = reader.documents().combine_chunks()
    names, counts = docs.column("doc_id"), docs.column("n_tokens").to_numpy()
    ends = np.cumsum(counts)
    chunk, chunk_at, k = np.zeros(0, "<u4"), 0, 0
    for a in range(0, len(counts), rows):
        sums, lists = [], []
        for start, end in zip((ends[a : a + rows] - counts[a : a + rows]).tolist(), ends[a : a + rows].tolist()):
            crc, taken = 0, []
            while start < end:
                if start >= chunk_at + len(chunk):
                    chunk_at += len(chunk)
                    chunk, k = reader.chunk(k), k + 1
                some = chunk[start - chunk_at : end - chunk_at]
                crc = zlib.crc32(some, crc)
                if with_ids:
                    taken.append(some)
                start += len(some)
            sums.append(crc)
            lists.append(np.concatenate(taken).astype(np.int32) if taken else np.zeros(0, np.int32))
        columns = [names.slice(a, rows), pa.array(base + ends[a : a + rows] - counts[a : a + rows]), pa.array(counts[a : a + rows]), pa.array(sums, pa.int64())]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        if with_ids:
            columns.append(pa.array(lists, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
    reader.close()


def binary_ids(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int | None = None, bits: bool = False, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Encode, write, and read back: the documents as the files of `folder` have them."""
    parts = stored(encoded(docs, tokenizer_file, end_id, id_col, text_col))
    return read_documents(write_ids(parts, folder, bits, **how), parts.schema["doc_id"].dataType.simpleString())
