import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiclink.llm import planes, units
from civiclink.llm.queries import END_ID, op11_binary_ids

from .cases import empty, frame, odd, odd_rows, prose

FILE = public_tokenizers.path("byte_bpe_50k.json")


def coded(texts):
    return [np.array([*e.ids, END_ID], "<u4") for e in Tokenizer.from_file(FILE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [1], [65535, 0, 3], list(range(100)), [2**32 - 1, 5, 2**31], [7] * 9])
def test_planes_round_trip(bits, ids):
    ids = np.array(ids, "<u4")
    made = planes.to_planes(ids, bits)
    top = int(ids.max()).bit_length() if len(ids) else 0
    assert len(made) == (top if bits else -(-top // 8))
    assert planes.from_planes(made, len(ids), bits).tolist() == ids.tolist()


def test_bit_planes_hold_the_bits_of_the_ids():
    made = planes.to_planes(np.array([1, 2, 3, 4], "<u4"), True)
    assert [f"{p[0]:08b}" for p in made] == ["10100000", "01100000", "00010000"]


@pytest.mark.parametrize("bits", [True, False])
def test_a_file_and_stretches_of_it(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(planes, "CHUNK", 100)
    import pyarrow as pa

    r = np.random.default_rng(1)
    ids = r.integers(0, 50_000, 1234).astype("<u4")
    lengths = np.array([0, 700, 34, 500])
    out = planes.Writer(f"file://{tmp_path}/x/a.planes", bits)
    out.add(ids[:700], pa.array([5, 6]), lengths[:2])
    out.add(ids[700:], pa.array([7, None], pa.int64()), lengths[2:])
    assert out.close() == (tmp_path / "x/a.planes").stat().st_size
    got = planes.Reader(f"{tmp_path}/x/a.planes")
    assert got.n_ids == 1234 and len(got.index) == 13 and got.bits == bits
    assert got.documents().to_pydict() == {"doc_id": [5, 6, 7, None], "n_tokens": lengths.tolist()}
    for a, n in [(0, 1234), (99, 2), (100, 100), (1233, 1), (50, 0), (1200, 100), (333, 555)]:
        assert got.ids(a, n).tolist() == ids[a : a + n].tolist()
    got.close()
    data = bytearray((tmp_path / "x/a.planes").read_bytes())
    at, n, sizes, crc = got.index[3]
    (tmp_path / "x/b.planes").write_bytes(bytes(data[:at]) + planes.zstandard.ZstdCompressor().compress(b"\0") * 0 + bytes(data[at:]))
    index = planes.Reader(f"{tmp_path}/x/b.planes")
    index.index[3] = (at, n, sizes, crc ^ 1)
    with pytest.raises(ValueError):
        index.chunk(3)
    with pytest.raises(ValueError):
        (tmp_path / "x/c.planes").write_bytes(bytes(100))
        planes.Reader(f"{tmp_path}/x/c.planes")


def brute(rows):
    """(doc_id, start, n_tokens, crc) in the order of ids; rows are (doc_id, text)."""
    out, start = [], 0
    for (i, _), ids in zip(rows, coded([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [True, False])
def test_odd_rows(spark, tmp_path, bits, monkeypatch):
    got = planes.binary_ids(odd(spark), FILE, str(tmp_path / "ids"), END_ID, bits, file_ids=5000).collect()
    assert len(got) == len(odd_rows()) and got[0]["doc_id"] is None
    got = sorted(got, key=lambda r: r["start"])
    # Documents of one id stand in some order, so they are held against each other as a set.
    texts = {}
    for r in odd_rows():
        texts.setdefault(r[0], []).append(r[1])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(((i is not None, i or 0), len(c), zlib.crc32(c.tobytes())) for i, some in texts.items() for c in coded(some))
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)


def test_many_files_and_whole_ids(spark, tmp_path):
    r = random.Random(3)
    texts = [prose(i, r.randrange(1, 200)) + r.choice(["", "\n\n", " <|endoftext|> x", " it's 12.5, no. a b", "  z"]) for i in range(120)]
    docs = frame(spark, texts).repartition(5)
    parts = planes.stored(planes.encoded(docs, FILE, END_ID))
    files = planes.write_ids(parts, str(tmp_path / "ids"), file_ids=3000)
    assert files.count() > 5 and files.agg(F.sum("n_docs")).first()[0] == 120
    got = planes.read_documents(files, with_ids=True).orderBy("start").collect()
    want = brute(list(enumerate(texts)))
    assert [(x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) for x in got] == want
    assert [x["ids"] for x in got] == [c.tolist() for c in coded(texts)]


def test_units_give_what_whole_texts_give():
    tokenizer = Tokenizer.from_file(FILE)
    whole, units, cut = planes._id_units(open(FILE, "rb").read())
    units.most = 50
    r = random.Random(8)
    glue = ["a", "Éa", "ab", " ", " ", " ", "\n", "\n", "\t", "\r", "1", "23", "'s", "'", ".", "|", "|?", "ſ", "²", "ª", "漢", "\u0308", "\u00a0", "\x85", "<|endoftext|>"]
    texts = [*["".join(r.choices(glue, k=r.randrange(1, 12))) for _ in range(4000)], "", "a" * 50 + ".\nB c\nd. 12 ee."]
    plain = 0
    for a in range(0, len(texts), 40):
        some = [cut(t) for t in texts[a : a + 40]]
        plain += sum(any(u[:1] == "\n" for u in x[1:]) for x in some)
        firsts = whole([x[0] for x in some])
        known = units.look_up([u for x in some for u in x[1:]])
        for text, x, first in zip(texts[a:], some, firsts):
            got = np.frombuffer(first + b"".join(known[u] for u in x[1:]), "<u4").tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert plain > 100


def test_slices_of_a_long_text_are_one_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(planes, "BATCH_CHARS", 3000)
    from civiclink.llm import units

    cut = list(units.slices(prose(1, 4000), 1000))
    assert len(cut) > 20 and " ".join(p for p, _ in cut) == prose(1, 4000) and [last for _, last in cut].count(True) == 1
    long_text = " ".join([prose(7, 200_000), "x" * 30, "é 漢字. end"])
    rows = [(0, "first"), (1, long_text), (2, None), (3, "last " + long_text[:500])]
    got = planes.binary_ids(frame(spark, [t for _, t in rows]), FILE, str(tmp_path / "ids"), END_ID).orderBy("start").collect()
    assert [tuple(x) for x in got] == brute(rows)


def test_uncommitted_files_are_never_read(spark, tmp_path):
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids/ids-000000-0000-left.planes").write_bytes(b"half a file")
    got = planes.binary_ids(frame(spark, ["a b", "c"]), FILE, str(tmp_path / "ids"), END_ID).collect()
    assert len(got) == 2


def test_empty_tables_and_the_query(spark, tmp_path):
    assert planes.binary_ids(empty(spark), FILE, str(tmp_path / "none"), END_ID).collect() == []
    docs = frame(spark, [prose(i, 30) for i in range(40)] + [None, ""])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_binary_ids(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == brute([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])


class _Counting(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def test_known_units_are_looked_up_once():
    rows = [["a,", "b", "ccc", "b", "x" * 50], [], ["b", "d.", "a,", "e", "x" * 50], ["ccc", "f", "a"]]
    code = lambda texts: [f"<{t}>" for t in texts]
    for most in (1, 3, 100):
        found = units.Units(code, code, lambda a, b: a + b, most)
        for some in (rows, rows[::-1], rows):
            known = units.Units(code, code, lambda a, b: a + b).look_up(u for r in some for u in r)
            assert found.encodings(some) == [[known[u] for u in r] for r in some]
    found = units.Units(code, code, lambda a, b: a + b)
    found.encodings([["a", "b"]])
    found.kept = _Counting(found.kept)
    assert found.encodings([["a", "b", "a"]]) == [["<a>", "<b>", "<a>"]] and found.kept.asked == 3


GLUE = ["a", "Éa", "ab", " ", " ", " ", "\n", "\n", "\t", "\r", "1", "23", ".", ",!", "|", "ª", "漢", " ", "\x85", "\x1c", " ", "﻿"]


@pytest.mark.parametrize("seed", range(4))
def test_texts_of_an_array_are_cut_and_encoded_as_one_by_one(seed):
    import pyarrow as pa

    r = random.Random(seed)
    texts = ["", " ", "\n", "a\n", "a\n\nb", "a \nb", "plain\nlines, of words.\nend", *["".join(r.choices(GLUE, k=r.randrange(12))) for _ in range(3000)]]
    if seed == 0:
        texts = [t for t in texts if not t[:1].isspace() and not units.OTHER_BLANK.search(t) and not units.OTHER_BREAK.search(t)]
    assert units.cut_all(pa.array(texts)).to_pylist() == [units.cut(t) for t in texts]
    assert units.cut_all(pa.array(texts), lines=True).to_pylist() == [units.cut_lines(t) for t in texts]
    assert units.cut_all(pa.array([], pa.string())).to_pylist() == []
    some = [u for t in texts for u in units.cut_lines(t)[1:]]
    whole, known, _ = planes._id_units(open(FILE, "rb").read())
    at, coded_units = units.numbered(pa.array(some, pa.string()), known, whole)
    want = whole([u if u[:1] == "\n" else " " + u for u in some])
    assert coded_units.take(at).to_pylist() == want
    assert all(len(x) == 0 for x in units.numbered(pa.array([], pa.string()), known, whole))


def test_an_array_asks_for_each_word_once():
    import pyarrow as pa

    asked = []

    def code(some):
        asked.extend(some)
        return [f"<{t}>".encode() for t in some]

    store = units.Units(code, code, lambda a, b: a + b, ends=False)
    store.kept = _Counting()
    at, found = units.numbered(pa.array(["a", "a,", "b.", "a", "b", "12.", "a,"] * 50), store, lambda marks: [f"[{m}]".encode() for m in marks])
    assert found.take(at).to_pylist()[:7] == [b"<a>", b"<a>[,]", b"<b>[.]", b"<a>", b"<b>", b"<12.>", b"<a>[,]"]
    assert sorted(asked) == ["12.", "a", "b"] and store.kept.asked <= 6


def test_pieces_of_a_column(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(planes, "BATCH_CHARS", 20)
    monkeypatch.setattr(planes, "SLICE", 30)
    texts = ["", "a b", "c" * 19, "é" * 14, "x y " * 12, "d" * 40, "", "e"]
    got = [(t, i, p, last) for some in planes._pieces(pa.array(texts)) for t, i, p, last in zip(some[0].to_pylist(), *(x.tolist() for x in some[1:]))]
    assert [i for _, i, _, _ in got] == sorted(i for _, i, _, _ in got)
    for i, text in enumerate(texts):
        mine = [x for x in got if x[1] == i]
        assert " ".join(x[0] for x in mine) == text
        assert [x[2] for x in mine] == list(range(len(mine))) and [x[3] for x in mine] == [False] * (len(mine) - 1) + [True]
    assert len(list(planes._pieces(pa.array(texts)))) >= 5 and list(planes._pieces(pa.array([], pa.string()))) == []


def test_long_lists_are_encoded_in_bounded_calls(monkeypatch):
    monkeypatch.setattr(planes, "CODED_CHARS", 10)
    whole, _, _ = planes._id_units(open(FILE, "rb").read())
    texts = ["", "слово и дело", "a", "b", "", "漢字 " * 20, "end", ""]
    assert [np.frombuffer(x, "<u4").tolist() + [END_ID] for x in whole(texts)] == [x.tolist() for x in coded(texts)] and whole([]) == []
