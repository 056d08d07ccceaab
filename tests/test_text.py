import pytest
from pyspark.sql import functions as F

from civiclink.functions import dates, filetypes, ids, text, urls


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, key",
    [
        ("- Itapage", "ITAPAGE"),
        ("• Sao Joao d'Alianca/GO", "SAO JOAO D ALIANCA GO"),
        ("São João d’Aliança", "SAO JOAO D ALIANCA"),
        ("1º Ofício", "1o OFICIO"),
        ("  — * Água  Boa-MT ", "AGUA BOA MT"),
        ("ﬁm…", "FIM"),
        (None, ""),
        ("état", "ETAT"),
    ],
)
def test_match_key(spark, raw, key):
    assert one(spark, raw, text.match_key) == key


def test_query_key_folds_before_upper(spark):
    assert one(spark, "1º Ofício-MG", text.query_key) == "1O OFICIO MG"


@pytest.mark.parametrize("raw", ["①", "㎡", "𝐀", "ｱ", "ﷺ", "가", "कु", "ß", "ǅ", "½", "ẛ̣", "e\u0301x", "plain", "é" * 50, "\u0345", "Ω", "İı"])
def test_folding_against_the_unicode_database(spark, raw):
    import unicodedata

    want = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c))
    assert one(spark, raw, text.fold_accents) == want


def test_slug(spark):
    assert one(spark, "  São João / 2ª ", text.slug) == "sao_joao_2a"
    assert one(spark, "São", lambda c: text.slug(c, fold=False)) == "s_o"
    assert one(spark, "!!", text.slug) == "item"
    assert len(one(spark, "a" * 200, text.slug)) == 80


def test_small_text_helpers(spark):
    assert one(spark, " a \n\t b c ", text.collapse_ws) == "a b c"
    assert one(spark, "Campinas ,;- ", text.trim_name_tail) == "Campinas"
    assert one(spark, "42", text.pad_code) == "0000042"
    assert one(spark, "123456789", text.pad_code) == "123456789"
    assert one(spark, " ce;BA", text.uf_key) == "CE"
    assert one(spark, "a", lambda c: text.join_notes(F.lit(""), c, F.lit(None).cast("string"), F.lit("b"))) == "a; b"
    assert one(spark, "ab", lambda c: text.keep_if(c, F.length(c) >= 3, F.lit("zz"))) == "zz"
    assert one(spark, None, lambda c: text.keep_if(c, F.length(c) >= 3, F.lit("zz"))) == "zz"


def test_dates(spark):
    assert str(one(spark, "06/03/2026", dates.day_first)) == "2026-03-06 00:00:00"
    assert str(one(spark, "6/3/2026", dates.day_first)) == "2026-03-06 00:00:00"
    for bad in ("31/02/2026", "2026-03-06", "x", "", None):
        assert one(spark, bad, dates.day_first) is None
    assert one(spark, "2020-01-15 00:00:00", lambda c: dates.iso_text(dates.any_date(c))) == "2020-01-15T00:00:00"


BASE = "https://www.gov.br/cgu/a/index?x=1#top"


@pytest.mark.parametrize(
    "href, full",
    [
        ("https://example.org/s-41", "https://example.org/s-41"),
        ("//cdn.x/y", "https://cdn.x/y"),
        ("/cgu/s-40#sec", "https://www.gov.br/cgu/s-40"),
        ("b.pdf", "https://www.gov.br/cgu/a/b.pdf"),
        ("../b/./c?q=1", "https://www.gov.br/cgu/b/c?q=1"),
        ("../../../z", "https://www.gov.br/z"),
        ("?p=2", "https://www.gov.br/cgu/a/index?p=2"),
        ("#x", "https://www.gov.br/cgu/a/index?x=1"),
        ("", "https://www.gov.br/cgu/a/index?x=1"),
        ("mailto:a@b", "mailto:a@b"),
    ],
)
def test_page_link(spark, href, full):
    assert one(spark, href, lambda c: urls.page_link(F.lit(BASE), c)) == full


def test_url_pieces(spark):
    assert one(spark, BASE, urls.origin) == "https://www.gov.br"
    for url, ext in [("http://a/b.PDF?x=.csv", ".pdf"), ("http://a.org", ""), ("http://a/.pdf", ""), ("http://a/x.tar.gz/", ".gz")]:
        assert one(spark, url, urls.extension) == ext


def test_download_urls_skip_equal_ids(spark):
    df = spark.createDataFrame([("9", "9"), ("9", "7"), ("9", None)], "t string, a string")
    got = [[u.url for u in r.u] for r in df.select(urls.download_urls("t", "a", F.lit("eaud")).alias("u")).collect()]
    head = "https://eaud.cgu.gov.br/relatorios/download/"
    assert got == [[head + "9"], [head + "9", head + "7"], [head + "9"]]


def test_file_kinds(spark):
    cases = [
        (b"%PDF-1.7\n" + b"0" * 20, "application/pdf", "pdf"),
        (b"PK\x03\x04000", "application/octet-stream", "docx"),
        (bytes.fromhex("D0CF11E0") + b"0", "application/msword", "doc"),
        (b"<html>", "text/html", "bin"),
        (b"<html>", "application/PDF", "pdf"),
    ]
    df = spark.createDataFrame(cases, "b binary, c string, want string")
    for r in df.select(filetypes.signature("b", "c").alias("got"), "want").collect():
        assert r.got == r.want
    assert one(spark, "attachment; filename*=UTF-8''\"a b.pdf\"", filetypes.disposition_filename) == "a b.pdf"
    assert one(spark, "inline", filetypes.disposition_filename) is None


def test_ids(spark):
    import hashlib

    want = "cand_" + hashlib.sha256(b"l|None|m|s").hexdigest()[:16]
    got = one(spark, "l", lambda c: ids.candidate_id(c, F.lit(None).cast("string"), F.lit("m"), F.lit("s")))
    assert got == want
