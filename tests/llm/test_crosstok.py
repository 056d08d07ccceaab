import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from civiclink.llm import crosstok
from civiclink.llm.queries import op12_token_alignment

from .cases import empty, frame, odd, odd_rows, prose

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "hello wo漢é  😀<|endoftext|> <s> x</s>", "a▁b plain", "ünï 漢字 😀 kelvin K ſ İ", "a.. b,,. c. d, e.f it's 1. 2, x\n\n\tz", " lead", "trail ", "\x00 a", "ﬁ　z",
    "a .b", "e. e. e.", "́a", "<0x41> A", "...", ",", " ", "\n", "x.", "x.,.,.,.,.,", "naïve café. señor, niño", "👩‍👩‍👧 z", "A" * 300, "ab " * 50, "1,234.5 6.7,", "﷽ ​ q",
]


@pytest.fixture(scope="module")
def pair():
    return crosstok.Pair.load(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())


@pytest.fixture(scope="module")
def aligner():
    return crosstok._aligner(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())


def brute(pair, text):
    """(group text, ids of A, ids of B, links) from the bytes of the tokens alone."""
    if not text:
        return "", [], [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    data = b" " + text.encode()
    if b"".join(pair.a_bytes[i] for i in a) != data or b"".join(pair.b_bytes[i] for i in b) != data:
        return "", [], [], []
    a_ends = np.cumsum([len(pair.a_bytes[i]) for i in a]).tolist()
    b_ends = np.cumsum([len(pair.b_bytes[i]) for i in b]).tolist()
    out, cuts = [], sorted({*a_ends} & {*b_ends})
    for x, y in ((a, a_ends), (b, b_ends)):
        group = np.searchsorted(cuts, y)
        out.append([",".join(str(x[k]) for k in range(i, j)) for i, j in zip(np.searchsorted(group, range(len(cuts))), np.searchsorted(group, range(len(cuts)), "right"))])
    out = ["|".join(pair) for pair in zip(*out)]
    links = [(i, j) for i, e in zip(a, a_ends) for j, f in zip(b, b_ends) if e == f] if len(a) < 3000 else None
    return ";".join(out), a, b, links


def test_bytes_of_tokens(pair):
    assert len(crosstok.byte_alphabet()) == 256 and crosstok.byte_alphabet()["Ġ"] == 32
    text = "naïve 漢字 😀 x\n"
    assert b"".join(pair.a_bytes[i] for i in pair.a.encode(text, add_special_tokens=False).ids) == text.encode()
    assert pair.b_bytes[pair.b.piece_to_id("<0x41>")] == b"A" and pair.b_bytes[pair.b.piece_to_id("▁a")] == b" a"
    assert pair.cuts() == (True, True)


def test_spans_and_bytes_agree_with_bytes_alone(pair):
    r = random.Random(2)
    texts = [*TEXTS, *["".join(r.choice("ab é漢😀.,' \n▁1<>|") for _ in range(r.randrange(1, 40))) for _ in range(300)]]
    for text, code in zip(texts, pair.encode(texts)):
        said, a, b, _ = brute(pair, text)
        if code is None:
            assert not a, text
        else:
            assert (code[0], code[2]) == (a, b), text
            assert ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in crosstok.groups(code)) == said, text


def test_units_give_what_whole_texts_give(pair, aligner):
    units, whole = aligner
    r = random.Random(5)
    words = ["alpha", "Niño", "b.", "c,.", "it's", "12", "x.y", "", "é", "漢", "▁", "z" * 60, "q" * 50 + ".", "\n", "|", "(a,", "'s", "-", "a\nB", "<s>", "\t", "~\u0308"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(200)]
    for text in [t for t in [*TEXTS, *texts] if t]:
        some = crosstok.cut(text)
        known = units.look_up(some)
        parts, want = [known[u] for u in some], brute(pair, text)
        if any(p is None for p in parts):
            assert want[1] == [], text
        else:
            assert ";".join(p[0] for p in parts) == want[0], text
            assert np.frombuffer(b"".join(p[2] for p in parts), np.int32).reshape(-1, 3).sum(0).tolist() == [len(want[1]), len(want[2]), want[0].count(";") + 1]


def test_every_linked_pair_is_among_the_linkable(pair):
    pairs = pair.linkable()
    assert (np.diff(pairs) > 0).all() and len(pairs) < 400_000
    for text in [*TEXTS, prose(3, 300)]:
        found = {(i << 32) + j for i, j in brute(pair, text)[3]}
        assert found <= set(pairs.tolist())


def expected(pair, texts):
    found = [brute(pair, t) for t in texts]
    count = Counter(x for f in found for x in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (len(a), len(b), len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else "")
        for said, a, b, links in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_documents_against_brute_force(spark, pair, tmp_path):
    texts = [*TEXTS, None, "", prose(1, 200), prose(1, 200), *[prose(i, 20) for i in range(30)]]
    docs = frame(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_token_alignment(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == expected(pair, texts)
    table = {(r["a_id"], r["b_id"]): (r["links"], r["best"]) for r in crosstok.link_table(docs, A_FILE, B_FILE).collect()}
    count = Counter(x for t in texts for x in brute(pair, t)[3])
    assert {k: v[0] for k, v in table.items()} == dict(count)
    with_text, _ = crosstok.alignment(docs, A_FILE, B_FILE, with_groups=True)
    assert [r["groups"] for r in with_text.orderBy("doc_id").collect()] == [brute(pair, t)[0] for t in texts]


def test_odd_rows_and_long_texts(spark, pair, monkeypatch):
    monkeypatch.setattr(crosstok, "BATCH_CHARS", 2000)
    got = crosstok.token_links(odd(spark), A_FILE, B_FILE).collect()
    want = []
    for r in odd_rows():
        said, a, b, _ = brute(pair, r[1])
        want.append((r[0] or 0, len(a), len(b), said.count(";") + 1 if said else 0, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    assert sorted((r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) for r in got) == sorted(want)
    assert all(r["n_links"] == r["n_groups"] and r["n_best"] <= r["n_links"] for r in got)
    assert crosstok.token_links(empty(spark), A_FILE, B_FILE).collect() == []


def test_whole_texts_where_a_vocabulary_joins_words(pair, monkeypatch):
    """If a piece had a blank inside, texts would not be cut."""
    monkeypatch.setattr(crosstok.Pair, "cuts", lambda self: (False, False))
    units, whole = crosstok._aligner(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())
    assert units is None and whole(["a b. c"])[0][0] == brute(pair, "a b. c")[0]
    monkeypatch.setattr(crosstok.Pair, "cuts", lambda self: (True, False))
    units, _ = crosstok._aligner(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())
    assert units.look_up(["b."])["b."][0] == brute(pair, "b.")[0]


def test_libraries_are_the_public_ones(pair):
    assert isinstance(pair.a, Tokenizer) and isinstance(pair.b, sentencepiece.SentencePieceProcessor)
