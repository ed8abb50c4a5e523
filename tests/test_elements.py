from __future__ import annotations

from lodestone.sources import elements

BOLD = 'style="font-weight: bold; text-align:center"'
PAGES = {
    1: f'<body><div class="xforms"><span {BOLD}>One</span> text <script>x</script><div style="display: none">y</div><table><tr><td><h2>in a table</h2></td></tr></table><h1>Two<br>lines</h1><p>a<p>b</div></body>',
    2: f'<div class="xforms big"><span {BOLD}>not before a table</span><p>x</p><table></table><span {BOLD}>{"w" * 121}</span><table></table><span style="font-weight:700;TEXT-ALIGN: Center;text-align:left">left at last</span><table></table></div>',
    3: f'<div class="xforms"><span>정정 신고 (보고)</span><table></table><div class="a xforms_title"> The  title <b>here</b></div><table></table><table></table></div><span {BOLD}>outside</span><table></table>',
    4: f'<div><span {BOLD}>no form</span><table></table></div>',
    5: None,
    6: f'<div class="xforms"><span {BOLD}>holds <table></table></span><table></table><span style="font-weight:900;text-align:center">ok</span><!-- c --><table></table></div>',
}


def rows_of(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "doc_id long, source string")
    return pages, elements.elements(pages)


def test_headings(spark):
    _, rows = rows_of(spark)
    got = sorted((r.doc_id, r.position, r.title, r.kind) for r in elements.headings(rows).collect())
    assert [(d, t, k) for d, _, t, k in got] == [(1, "One", "STYLE"), (1, "Two\nlines", "TAG"), (3, elements.CORRECTION, "CORRECTION"), (3, "The title here", "CLASS"), (6, "ok", "STYLE")]


def test_sections_have_the_tables_behind_them(spark):
    _, rows = rows_of(spark)
    got = [(r.doc_id, r.title, r.n_tables) for r in elements.sections(rows).orderBy("doc_id", "position").collect()]
    assert got == [(1, "One", 1), (1, "Two\nlines", 0), (2, None, 3), (3, elements.CORRECTION, 1), (3, "The title here", 3), (4, None, 1), (6, None, 2), (6, "ok", 1)]


def test_pages_without_a_form(spark):
    pages, rows = rows_of(spark)
    assert sorted(r.doc_id for r in elements.problems(rows, pages).collect()) == [4, 5]
    assert elements.headings(rows.where("false")).count() == 0
