from pyspark.sql import functions as F

from civiclink.functions import markup
from civiclink.operators import elements, pages, reports

PAGE = "page_id int, url string, html string"


def frame(spark, html, url="https://www.gov.br/cgu/index"):
    return spark.createDataFrame([(1, url, html)], PAGE)


INDEX = """<div><a href="/edital/sorteio-7"> segundo aviso</a><p>texto</p>
<section class="box card"><span><a href="/edital/sorteio-7#lista"><i>Sétimo</i> sorteio, lista</a></span></section>
<ul class="accordion"><li><a href="https://portal.test/x/sorteio-8?p=1">oitavo</a></li></ul>
<!-- <a href="/sorteio-0">fora</a> --><style><a href="/sorteio-1">fora</a></style>
<a href="/contato">fale conosco</a><a href='/sorteio-9'></a></div>"""


def test_round_links_prefer_cards_and_drop_fragments(spark):
    rows = pages.round_links(frame(spark, INDEX), "page_id").orderBy("position").collect()
    assert [(r.url, r.round_label) for r in rows] == [
        ("https://www.gov.br/edital/sorteio-7", "Sétimo sorteio, lista"),
        ("https://portal.test/x/sorteio-8?p=1", "oitavo"),
        ("https://www.gov.br/sorteio-9", "round_link"),
    ]


def status(spark, html):
    src = frame(spark, html, "https://portal.test/edital/7").withColumn("extra", F.lit("kept"))
    state = pages.page_status(src, "page_id", keep=["extra"]).collect()
    assert len(state) == 1 and state[0].extra == "kept"
    return pages.page_places(src, "page_id").collect(), state[0]


def test_list_page(spark):
    places, state = status(spark, "<ol><li>Campo Alegre / GO (titular)</li><li>sem estado</li><li>Ilha/XX</li><li>Campo Alegre/GO</li></ol>")
    assert [(p.municipality_name_clean, p.uf, p.parse_method, p.confidence) for p in places] == [
        ("Campo Alegre", "GO", "li", "high")]
    assert (state.parse_status, state.primary_resource_type, state.parsed_municipalities_count) == ("parsed", "html", 1)


def test_page_with_a_document_link_only(spark):
    places, state = status(spark, '<div>A relação está no anexo.</div><a href="anexos/relacao.PDF#p2">anexo</a><a href="b.xlsx">planilha</a>')
    assert places == []
    assert (state.parse_status, state.primary_resource_type) == ("needs_pdf_parse", "pdf")
    assert state.parse_reason == "round_links_to_external_resource_no_html_list"


def test_table_page(spark):
    places, state = status(
        spark, "<table><tr><th>Nome e estado</th><th>n</th></tr><tr><td>Rio Claro - SP<td>31</tr><tr><td>x</td></tr></table>")
    assert [(p.municipality_name_clean, p.parse_method, p.source_snippet) for p in places] == [
        ("Rio Claro", "table", "Rio Claro - SP | 31")]
    assert state.parse_status == "parsed"


def test_pages_without_hits(spark):
    for html in ("<p>nada</p>", "", None):
        places, state = status(spark, html)
        assert places == [] and state.parse_status == "no_municipalities_extracted" and state.parsed_municipalities_count == 0


def test_status_counts_what_page_places_lists(spark):
    html = "<p>Lapa/PR e LAPA/PR</p><li>Lapa/PR</li><td>Fora/PR</td><table><tr><td>Lapa/PR</td></tr></table><div>X/ZZ - /PR</div>"
    places, state = status(spark, html)
    assert state.parsed_municipalities_count == len(places) > 2


def test_nothing_is_shuffled_within_pages(spark):
    src = frame(spark, INDEX)
    for df in (pages.pdf_links(src, "page_id"), pages.detail_pdf_links(src, "page_id"), pages.resource_links(src, "page_id"), pages.page_status(src, "page_id")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_resources_once_per_address(spark):
    html = '<a href="/a.pdf">1</a><a href="/b.CSV">2</a><a href="/a.pdf#x">3</a><a href="/c">4</a><a>5</a><a href="/a.pdf">6</a>'
    got = pages.resource_links(frame(spark, html), "page_id").orderBy("pos").collect()
    assert [(r.link, r.ext, r.pos) for r in got] == [("https://www.gov.br/a.pdf", ".pdf", 0), ("https://www.gov.br/b.CSV", ".csv", 1)]


def test_repeats_take_first_position_and_last_content(spark):
    html = "<p>Lapa/PR um</p><p>Assis - SP. e LAPA/PR dois</p><div>(Lapa/PR tres <span>x</span></div>"
    rows = pages.page_places(frame(spark, html), "page_id").orderBy("position").collect()
    got = [(r.municipality_name_clean, r.uf, r.source_snippet) for r in rows]
    assert got == [
        ("Lapa", "PR", "(Lapa/PR tres x"), ("Assis", "SP", "Assis - SP. e LAPA/PR dois"),
        (". e LAPA", "PR", "Assis - SP. e LAPA/PR dois")]
    kept = pages.round_places(pages.page_places(frame(spark, "<li>Lapa/PR</li><p>LAPA/PR</p>"), "page_id"), "page_id")
    assert sorted(r.municipality_name_clean for r in kept.collect()) == ["LAPA", "Lapa"]


def test_nested_elements_carry_their_whole_text():
    html = '<div>a <p>b<p>c</div><ul><li>d<ul><li>e</li></ul></li><li>f</ul><a href="/x?a=1&amp;b">g &lt;</a>'
    got = [(k, t) for k, _, _, _, _, t in elements.walk(html, frozenset(elements.KINDS))]
    assert got == [
        ("div", "a b c"), ("p", "b"), ("p", "c"), ("li", "d e"), ("li", "e"), ("li", "f"), ("a", "g <")]
    assert list(elements.walk(html, frozenset({"a"})))[0][4] == "/x?a=1&b"


def test_place_pattern_is_linear_on_long_text(spark):
    import time

    start = time.time()
    found = pages.page_places(frame(spark, "<p>" + "palavra " * 40_000 + "Lapa/PR</p>"), "page_id").collect()
    assert len(found) == 1 and time.time() - start < 30


def test_pdf_links_in_order(spark):
    html = """<a href="/a.PDF">x</a><a href=" /api/download/1 ">y</a><a href="/b">z</a>
      "https://q.org/c.pdf" "/api/arquivo/2" '/api/x/pdf' <a href="/a.PDF">again</a>"""
    got = pages.pdf_links(frame(spark, html), "page_id").orderBy("phase", "pos").collect()
    assert [r.link for r in got] == [
        "https://www.gov.br/a.PDF", "https://www.gov.br/api/download/1", "https://q.org/c.pdf",
        "https://www.gov.br/api/arquivo/2", "https://www.gov.br/api/x/pdf"]
    narrow = pages.detail_pdf_links(frame(spark, html), "page_id").orderBy("pos").collect()
    assert [r.link for r in narrow] == ["https://www.gov.br/a.PDF", "https://www.gov.br/api/download/1"]


def test_api_paths(spark):
    js = """fetch("/api/v2/busca"); x = '/api/v1/arquivo?id=3'; y = "/api/v2/busca"; z = "/other/api/";"""
    df = spark.createDataFrame([(js,)], "j string").select(markup.api_paths("j").alias("p"))
    assert df.first().p == ["/api/v1/arquivo?id=3", "/api/v2/busca"]


def test_entities(spark):
    df = spark.createDataFrame([("a&amp;lt;b &eacute;&#233;&#xE7; &nope; &nbsp;x",)], "t string")
    assert df.select(markup.unescape("t").alias("u")).first().u == "a&lt;b ééç &nope; \xa0x"


CONTEXT = "municipality_name string, uf string, ibge_municipality_code string, query_terms_used string, payload string"


def candidates(spark, payload):
    df = spark.createDataFrame([("Itapage", "CE", "2306306", "Itapage CE", payload)], CONTEXT)
    return reports.candidates_from_items(reports.search_items(df), "https://auditoria.cgu.gov.br", "eaud_api", "t")


def test_json_item_with_relative_pdf(spark):
    (r,) = candidates(spark, '[{"id": "77", "titulo": "Prefeitura de ITAPAGÉ: contas", "urlPdf": "../docs/77.pdf", "data": "01/02/2020"}]').collect()
    assert r.pdf_url == "https://auditoria.cgu.gov.br/docs/77.pdf"
    assert r.landing_url == "https://auditoria.cgu.gov.br/relatorio/77"
    assert (r.confidence, r.title_text, r.date_text) == ("high", "Prefeitura de ITAPAGÉ: contas", "01/02/2020")


def ids(spark, payload):
    return [r.landing_url.rsplit("/", 1)[1] for r in candidates(spark, payload).orderBy("item_order").collect()]


def test_nested_answers_in_reading_order(spark):
    payload = """{"id": 1, "data": {"items": [{"x": 1}, [{"id": 2}, 5, [[{"id": 3}]]], {"id": 4}], "titulo": ""}, "items": [{"id": 5}], "results": "no"}"""
    # "items" comes before "data", and an object comes behind what it holds.
    assert ids(spark, payload) == ["5", "auditoria.cgu.gov.br", "2", "3", "4", "auditoria.cgu.gov.br", "1"]
    assert candidates(spark, "not json").count() == 0


def test_the_outer_object_is_the_last_row_of_an_id(spark):
    found = candidates(spark, '{"id":1,"titulo":"A","items":[{"id":1,"titulo":"B"}]}')
    assert [r.title_text for r in found.orderBy("item_order").collect()] == ["B", "A"]
    assert [r.title_text for r in reports.unique_candidates(found, ["item_order"]).collect()] == ["A"]


def test_deep_answers(spark):
    for depth in (10, 33, 60):
        assert ids(spark, '{"data":' * depth + '{"id":9}' + "}" * depth) == ["9"]
        assert ids(spark, "[" * depth + '{"id":9}' + "]" * depth) == ["9"]


def test_zero_and_blank_values_fall_through(spark):
    (r,) = candidates(spark, '[{"id": 0, "relatorioId": "", "codigo": "c9", "titulo": null, "nome": " n ", "url": "/u"}]').collect()
    assert (r.landing_url, r.title_text, r.pdf_url) == ("https://auditoria.cgu.gov.br/u", "n", None)


def test_detail_page_fills_pdf(spark):
    found = candidates(spark, '[{"id": 1}, {"id": 2}, {"id": 3, "pdfUrl": "/p.pdf"}, {"id": 4}]')
    base = "https://auditoria.cgu.gov.br"
    details = spark.createDataFrame(
        [(f"{base}/relatorio/1", '<a href="x.pdf">p</a>'), (f"{base}/relatorio/2", "'/api/z' '/api/download/2'"),
         (f"{base}/relatorio/3", '<a href="y.pdf">p</a>')], "landing_url string, html string")
    for hot in ([], [(f"{base}/relatorio/1",)]):
        rows = reports.fill_missing_pdf(found, details, base, hot_left=hot).orderBy("landing_url").collect()
        assert [(r.pdf_url, r.notes) for r in rows] == [
            (f"{base}/relatorio/x.pdf", "json_result;pdf_from_detail"),
            (f"{base}/api/download/2", "json_result;pdf_api_candidate"), (f"{base}/p.pdf", "json_result"), (None, "json_result")]


def test_legacy_anchors(spark):
    html = '<a href="/r/itapage.pdf">Relatorio Itapagé</a><a href="/sobre">Sobre</a><a href="/x">Dados CE</a>'
    src = frame(spark, html).withColumns({"municipality_name": F.lit("Itapage"), "uf": F.lit("ce")})
    rows = reports.candidates_from_pages(src, "page_id", "auditoria", "t").orderBy("pos").collect()
    assert [r.title_text for r in rows] == ["Relatorio Itapagé", "Dados CE"]
    assert rows[0].pdf_url.endswith("itapage.pdf") and rows[1].pdf_url is None


def test_legacy_pages_searched_once_per_place_do_not_multiply(spark):
    html = '<a href="/r/um.pdf">Relatorio Um</a>'
    src = frame(spark, html)
    twice = src.withColumns({"municipality_name": F.lit("Um"), "uf": F.lit("ce")}).unionByName(src.withColumns({"municipality_name": F.lit("Dois"), "uf": F.lit("um")}))
    rows = reports.candidates_from_pages(twice, "page_id", "auditoria", "t").collect()
    assert sorted(r.municipality_name for r in rows) == ["Dois", "Um"]


def test_a_page_with_very_many_links_keeps_the_first_of_each(spark):
    n = 30_000
    hrefs = [f"/d/{i % 20_000}.pdf" for i in range(n)]
    html = "<html>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</html>"
    df = spark.createDataFrame([(1, "http://h.example/p", html), (2, "http://h.example/p", "<html></html>"), (3, None, None)], "k int, url string, html string")
    got = pages.pdf_links(df, "k").where("k = 1").orderBy("phase", "pos").collect()
    assert [(r.phase, r.pos) for r in got] == [(0, i) for i in range(20_000)]
    assert [r.link for r in got] == [f"http://h.example/d/{i}.pdf" for i in range(20_000)]
    assert pages.resource_links(df, "k").where("k = 1").count() == 20_000
