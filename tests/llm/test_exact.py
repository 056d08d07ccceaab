import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from civiclink.llm import exact

from .cases import empty, frame, odd, odd_rows, prose


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256) of (doc_id, text) rows."""
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("generation_rows,slots", [(1 << 23, 16), (4, 16), (5, 1)])
def test_odd_rows_at_any_filter_size(spark, generation_rows, slots):
    got = exact.exact_duplicates(odd(spark), generation_rows=generation_rows, slots_per_row=slots).collect()
    names = ("doc_id", "keep_id", "group_size", "text_sha256")
    assert order(tuple(r[n] for n in names) for r in got) == order(plain([r[:2] for r in odd_rows()]))
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})
    assert all(r["kept"] is False or r["doc_id"] == r["keep_id"] for r in got)


def test_filter_passes_single_rows_straight_through(spark):
    texts = [prose(i, 20) for i in range(2000)] + [prose(7, 20)] * 500
    rows = exact.possibly_repeated(exact.stored(exact.hashed(frame(spark, texts))))
    again = {r["doc_id"] for r in rows.where("again").collect()}
    assert set(range(2000, 2500)) | {7} <= again
    assert len(again) < 2500 - 1900


@pytest.mark.parametrize("generation_rows", [1 << 23, 500, 60])
def test_every_hash_is_read_three_times(spark, monkeypatch, generation_rows):
    seen = {name: spark.sparkContext.accumulator(0) for name in ("_counted", "_suspected")}

    def counting(name, made):
        def make(*how):
            run = made(*how)

            def counted(batches):
                def passed():
                    for batch in batches:
                        seen[name].add(batch.num_rows)
                        yield batch

                yield from run(passed())

            return counted

        return make

    for name in seen:
        monkeypatch.setattr(exact, name, counting(name, getattr(exact, name)))
    texts = [prose(i, 6) for i in range(1000)] + [prose(7, 6)] * 500
    rows = exact.possibly_repeated(exact.stored(exact.hashed(frame(spark, texts))), generation_rows)
    # With several generations one more pass lays the hashes out.
    assert [seen[n].value for n in seen] == [1500, 1500]
    again = {r["doc_id"] for r in rows.where("again").collect()}
    assert rows.count() == 1500 and set(range(1000, 1500)) | {7} <= again and len(again) < 600


@pytest.mark.parametrize("blocks", [1, 3])
def test_few_hashes_and_bits_make_the_same_filter(blocks):
    r = np.random.default_rng(blocks)
    parts = [r.integers(-(2**62), 2**62, n) for n in (9000, 30, 20, 3)]
    parts[1][:5], parts[2][:4], parts[3][:] = parts[0][:5], parts[1][10:14], parts[3][0]
    made = []
    for h in parts:
        batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int64)), pa.array(h)], ["gen", "h"])
        made += list(exact._counted(blocks)([batch]))
    assert any(b.column("few")[0].is_valid for b in made) and any(b.column("once")[0].is_valid for b in made)
    made.sort(key=lambda b: b.column("block")[0].as_py())
    every = np.concatenate(parts)
    block, slots = exact._slots(every, blocks)
    for out in exact._merged(blocks)(made):
        mine = slots[block == out.column("block")[0].as_py()]
        assert out.column("twice")[0].as_py() == exact._bits(mine)[1].tobytes()


def test_drop(spark):
    docs = odd(spark)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t for *_, t in plain([r[:2] for r in odd_rows()])})


def test_empty_table(spark):
    assert exact.exact_duplicates(empty(spark)).count() == 0
    assert exact.drop_exact_duplicates(empty(spark)).count() == 0
