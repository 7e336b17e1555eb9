"""Parsing of pages, statements, tables, embedded data."""

import json

import pytest

from fieldspan.operators import embedded, html, statements


def said(page, **kw):
    return [(kind, text) for _, _, kind, _, text in statements.statements(page, **kw)]


def test_decode():
    assert html.decode("é".encode()) == ("é", "utf-8")
    assert html.decode(b'<meta charset="iso-8859-1">\xe9')[0].endswith("é")
    assert html.decode(b"\xef\xbb\xbfa") == ("a", "utf-8")
    assert html.decode(b"\x93a\x94") == ("“a”", "windows-1252")


@pytest.mark.parametrize("page, wanted", [('<html lang="fr"><meta http-equiv="Content-Language" content="de">', "fr"), ('<meta http-equiv="content-language" content="de">', "de"), ("<p>a", None), (None, None)])
def test_language(page, wanted):
    assert html.language(page) == wanted


def test_cleaner():
    page = '<body><nav>n</nav><header>h</header><div class="x navbar">n</div><div id="cookie-bar">c</div><div role="navigation">n</div><article><header>kept</header><p>p</p></article><script>x=1</script><script type="application/json">{}</script><footer>f</footer></body>'
    tree = html.Cleaner().clean(html.parse(page))
    assert tree.words() == "kept p" and sum(n.tag == "script" for n in tree.walk()) == 1


def test_visible_text():
    assert html.visible_text(html.parse("<title>T</title><h1>A\nb</h1><p>c<br>d<p>e<table><tr><td>1<td>2</table>")) == "T\n\nA b\nc\nd\ne\n1 2"


def test_components_and_trail():
    page = "<h1>A</h1><p>One. Two is here.</p><h2>B</h2><ul><li>x<li>Power: 5 kW</ul><h1>C</h1><dl><dt>k<dd>v</dl>loose <b>text</b>"
    rows = statements.statements(page)
    assert [(k, s, t) for _, _, k, s, t in rows] == [
        ("heading", "", "A"), ("sentence", "A", "One."), ("sentence", "A", "Two is here."), ("heading", "A", "B"), ("list_item", "A › B", "x"), ("key_value", "A › B", "Power: 5 kW"), ("heading", "", "C"), ("key_value", "C", "k: v"), ("sentence", "C", "loose text"),
    ]


def test_table():
    page = "<table><tr><th>Spec<th>1.5 TSI SE<th>2.0</tr><tr><th colspan=3>Performance</tr><tr><td>0-62 mph (s)<td>9.1<td>8.0</tr></table>"
    found = said(page)
    assert ("table_cell", "Performance › 0-62 mph (s) · 1.5 TSI SE: 9.1") in found


def test_spans_of_cells():
    cells = html.table_cells(html.parse("<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</tr><tfoot><tr><td>f</tfoot></table>").children[0])
    assert [(r, c, t) for r, c, _, _, _, t in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c"), (2, 0, "f")]


def test_sentences():
    assert statements.sentences("Dr. Smith paid approx. 3.5 km. It rained! Was it e.g. late? No.") == ["Dr. Smith paid approx. 3.5 km.", "It rained!", "Was it e.g. late?", "No."]
    assert statements.sentences("Das ist z.B. gut. Ja.", "de") == ["Das ist z.B. gut.", "Ja."]
    assert statements.sentences("") == []


def test_gate_units():
    units = statements.gate_units("<h1>A</h1>" + "".join(f"<p>{'w' * 300} {i}</p>" for i in range(20)))
    assert all(len(u) <= statements.UNIT and s == "A" for _, s, u in units) and len(units) == 4
    long = statements.gate_units(f"<p>{'x' * 7000}</p>")
    assert all(len(u) <= statements.UNIT for _, _, u in long) and len(long) == 4


def test_cut():
    assert all(len(p) <= 4000 for p in statements.cut("word " * 5000)) and "".join(statements.cut("word " * 5000)).replace(" ", "") == "word" * 5000


@pytest.mark.parametrize("value, wanted", [({"a": [1, {"b": "x"}], "@id": 1, "c": None, "d": " "}, [("$.a[0]", "$.a[]", "1"), ("$.a[1].b", "$.a[].b", "x")]), (5, [("$", "$", "5")]), ({"a.b": True}, [('$["a.b"]', '$["a.b"]', "true")])])
def test_leaves(value, wanted):
    assert list(embedded.leaves(value)) == wanted


def test_blobs():
    page = '<script type="application/ld+json">{"@type":"Car","name":"x"}</script><script>window.__DATA__ = {"a":1};</script><script type="application/ld+json">{bad</script><meta property="og:title" content="t"><div itemscope itemtype="http://schema.org/Offer"><span itemprop="price" content="5">five</span></div>'
    found = [(s, t, json.loads(b)) for s, t, b in embedded.read_blobs(page)]
    assert found == [("json_ld", "Car", {"@type": "Car", "name": "x"}), ("app_state", "__DATA__", {"a": 1}), ("microdata", "Offer", {"@type": "Offer", "price": "5"}), ("rdfa", "", {"og:title": "t"})]
    assert embedded.read_blobs(None) == []


@pytest.mark.parametrize("ahead", ["<style>" + "p{color:red} " * 5_000 + "</style>", "<script>" + "f('<p>'); " * 5_000 + "</script>", "<!-- " + "x" * 60_000 + " -->", '<noscript><img src="x"></noscript>' * 2_000])
def test_language_after_a_long_head(ahead):
    assert html.language(f'<html><head>{ahead}<meta http-equiv="Content-Language" content="de"></head><body>a') == "de"
    assert html.language(f'{ahead}<html lang="fr"><body>a') == "fr"
    assert html.language(f'<html>{ahead}<body><meta http-equiv="Content-Language" content="de">') is None
