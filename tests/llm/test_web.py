from __future__ import annotations

import random
import re

import duckdb

from plumbline.llm import entries, hosts
from plumbline.llm.rendering import render_page, render_pages


def test_layout():
    page = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var t = "</p>";</script></head><body><nav><ul><li><a href=x>One</a><li>Two</ul></nav>
    <h1>Head &amp; more</h1><p>First <b>bold</b>   text<p>Second<br>line<div hidden>no</div><div style="display:none">no</div><!-- no --><ol start=3><li>three<ul><li>inner</ul><li>four</ol>
    <table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td colspan=2>Both</table><pre>  a
 b</pre><template>no</template><footer>&copy; end</footer>"""
    assert render_page(page) == "- One\n- Two\n\nHead & more\n\nFirst bold text\n\nSecond\nline\n\n3. three\n   - inner\n4. four\n\nCap\nName       Qty\nApple pie  3\nBoth\n\n  a\n b\n\n© end"


def test_odd_markup():
    assert render_page(None) == render_page("") == render_page("<div></div>") == ""
    assert render_page("a < b & c &am") == "a < b & c &am"
    assert render_page("x</b></div></p>y<span") == "x\n\ny"
    assert render_page("<p title=it's>a<p title=\"x>y\">b") == "a\n\nb"
    assert render_page("<td>cell<tr>row") == "cell\nrow"
    assert render_page("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert render_page("<div>" * 30_000 + "deep") == "deep"
    assert render_page("x<textarea> a\n<b></textarea>") == "x a\n<b>"
    for n in range(60):
        render_page("<ul><li>a<table><tr><td>&lt;b</td></table>"[:n])


def test_loose_content_of_tables_goes_before_them():
    assert render_page("a<table>loose <b>bold</b> text<tr><td>c</table>") == "aloose bold text\n\nc"
    assert render_page("<table><tbody>one<tr>two<td>a</td>three<td>b</td><div>four<p>five</div></tr>six</tbody>seven<tr><td>c<td>d</table>end") == "one two three\nfour\n\nfive\n\nsix seven\n\na  b\nc  d\n\nend"
    assert render_page("<table><tr><form action=x><td>cell</td><td>two</td></form></tr><form><tr><td>x</form><td>y</table>") == "cell  two\nx     y"
    assert render_page("<table><tr><form hidden>shown<td>cell</td></form><input type=hidden><script>no</script><td>z</table>") == "shown\n\ncell  z"
    assert render_page("<table><tr><div><td>cell</td></div><span>s<th>head</table>") == "s\n\ncell  head"
    assert render_page("<table><caption>Cap<colgroup><col>x<tr>&nbsp;<td>a<td><table>in<tr><td>b</table></table>") == "x\n\nCap\na  in\n   b"
    assert render_page("<table><tr><table><tr><td>inner</table><td>outer</table>") == "inner\n\nouter"
    assert render_page("<table><tr style=display:none>x<td>no</td><tr><td>yes</table>") == "x\n\nyes"
    assert render_page("<table><tr>" + "<div>" * 30_000 + "deep<td>c") == "deep\n\nc"
    for n in range(70):
        render_page("<table>a<colgroup>b<tr>c<form>d<li>e<td>f<caption>g<table>h</tr>i"[:n])


def test_no_text_is_lost_in_any_markup():
    r = random.Random(1)
    tags = ["table", "tr", "td", "th", "tbody", "thead", "form", "div", "b", "p", "caption", "colgroup", "col", "li", "ul"]
    for _ in range(3000):
        parts = [r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f"w{k}x"]) for k in range(r.randint(3, 25))]
        told = sorted(re.findall(r"w\d+x", render_page("".join(parts))))
        assert told == sorted(p for p in parts if p[0] == "w"), parts


def test_style_sheets_hide():
    css = "<style>/* .a{} */ .ad, p#x { color: red; DISPLAY : none } @media print { .b { display: none } } .c span {display:none} em{visibility:hidden}</style>"
    page = css + '<div class="big ad">no</div><p id=x>no<p id=y>yes<div id=x>kept</div><i class=b>b</i> <b class=c>c <span>d</span></b><em>no</em>'
    assert render_page(page) == "yes\n\nkept\nb c"
    css = "<style>.x > b, ul li.y i, #z.w {display:none} table td {visibility:hidden} .on{visibility:visible} a:hover, [q] {display:none}</style>"
    page = css + "<div class=x><b>no</b><p><b>yes</b></div><ul><li class='y q'><u><i>no</i>item</u><li><i>two</i></ul><i id=z class='w v'>no</i><table><tr><td>no <b class=on>but</b><th>head</table><a q>link</a>"
    assert render_page(page) == "yes\n\n- item\n- two\n\nbut  head\n\nlink"


def test_visibility_and_details():
    assert render_page("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b>too</b></p>no</div>end") == "yestoo\n\nend"
    assert render_page("<details>no<summary>Sum</summary>no<p>no</details><details open><summary>S</summary>yes</details>") == "Sum\nS\nyes"


def test_cells_of_any_width_align():
    long = "x" * 60
    assert render_page(f"<table><tr><td>{long}<td>b<tr><td>c<td>d</table>") == f"{long}  b\n{'c'.ljust(60)}  d"
    r = random.Random(2)
    for _ in range(200):  # against brute force: in every row the j-th cell begins where the j-th column does
        grid = [[f"r{i}c{j}" + "y" * r.choice([0, 1, 5, 70]) for j in range(r.randint(1, 5))] for i in range(r.randint(1, 6))]
        lines = render_page("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in grid) + "</table>").split("\n")
        starts = [sum(max((len(row[j]) for row in grid if j < len(row)), default=0) + 2 for j in range(k)) for k in range(6)]
        assert [[line.index(c) for c in row] for line, row in zip(lines, grid, strict=True)] == [starts[: len(row)] for row in grid]


def test_output_grows_with_the_input():
    deep = "<ul><li>x" * 50_000
    assert len(render_page(deep)) < 6 * len(deep)
    wide = "<table><tr>" + "<td>" + "w" * 3000 + "".join("<tr><td>a<td>b" for _ in range(3000)) + "</table>"
    assert len(render_page(wide)) < 3 * len(wide) and "\na  b\n" in render_page(wide)
    assert render_page("<table><tr><td colspan=1000>a<td>b<tr><td>c<td>d</table>") == "a     b\nc  d"
    nested = "<table><tr><td>x<td>" * 300
    assert len(render_page(nested)) < 20 * len(nested) and render_page(nested).count("x") == 300


def test_empty_tables_and_repeated_pages(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "y"), (None, None, "z")], "page_id long, html string, text string")
    assert sorted(map(tuple, render_pages(df).collect()), key=repr) == [(1, "a", 1, 1), (1, "a", 1, 1), (None, "", 0, 0)]
    assert render_pages(df.limit(0)).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, "<p>a<p>b", "x"), (2, None, "y"), (2, None, "y"), (None, "z", "")], "page_id long, html string, text string")
    assert sorted((tuple(r) for r in render_pages(df).collect()), key=repr) == sorted([(1, "a\n\nb", 4, 3), (2, "", 0, 0), (2, "", 0, 0), (None, "z", 1, 1)], key=repr)


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_rules(spark):
    urls = ["https://A.Example.org/es/1", "http://example.org/en/12?x=/fr/", "http://www.example.org/en/2", "http://x.com/fr/a", "http://x.com/de/a", "http://x.net/de/", None, "no-scheme/fr/", "ftp://notexample.org/es/", "http://org", "http://example.org/es", "x://example.org?/es/"]
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages(spark, urls), none).collect()}
    assert got == {
        0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("www.example.org", "/en/2", "org/", "allow"), 3: ("x.com", "/fr/a", "com/fr/", "allow"), 4: ("x.com", "/de/a", "com/de/", "block"), 5: ("x.net", "/de/", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.org", "/es/", "org/", "allow"), 9: ("org", "", None, "allow"), 10: ("example.org", "/es", "org/", "allow"), 11: ("example.org", "", None, "allow"),
    }


def test_reputation_is_shrunk_and_bounded(spark):
    urls = [f"http://bad.spam.net/{i}" for i in range(60)] + [f"http://good.site.net/{i}" for i in range(60)] + ["http://new.spam.net/1", "http://one.other.org/1", "http://bad.spam.net/x"] + [f"http://h{i % 9}.fine.org/{i}" for i in range(400)]
    labels = spark.createDataFrame([(i, int(i < 58)) for i in range(120)] + [(121, 1), (0, 0)] + [(i, 0) for i in range(123, 523)], "page_id long, bad int")
    got = {r.name: r for r in hosts.reputation(hosts.parsed(pages(spark, urls)), labels.groupBy("page_id").agg({"bad": "max"}).toDF("page_id", "bad")).collect()}
    assert got["bad.spam.net"].blocked and not got["good.site.net"].blocked and not got["one.other.org"].blocked
    assert got["good.site.net"].mean < got["new.spam.net"].mean < got["bad.spam.net"].mean
    assert {r.verdict for r in hosts.judge(pages(spark, urls), labels).where("host = 'bad.spam.net'").collect()} == {"block"}
    assert hosts.judge(pages(spark, urls).limit(0), labels).count() == 0


def test_registered_domains(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "x.y.com", "localhost", "", "10.0.0.7", "[::1]", "co.uk", "a.b.c.d.gov")], "h string")
    d, s = hosts.registered(F.col("h"), ("co.uk", "c.d.gov"))
    assert [tuple(r) for r in df.select(d, s).collect()] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.com", "com"), ("localhost", "localhost"), ("", ""), ("10.0.0.7", ""), ("[::1]", ""), ("co.uk", "co.uk"), ("b.c.d.gov", "c.d.gov")]
    names = spark.createDataFrame([(h,) for h in ("u:p@a.b:80", "a.b:", "x@y@z.org", "[::1]:8080", "")], "h string")
    assert [r[0] for r in names.select(hosts.name_of(F.col("h"))).collect()] == ["a.b", "a.b", "z.org", "[::1]", ""]


def test_query_and_sql_agree_on_ports_users_addresses_and_suffixes(spark, tmp_path):
    r = random.Random(4)
    names = ["a.b.co.uk", "c.co.uk", "co.uk", "x.y.com", "user@x.y.com", "x.y.com:8080", "10.0.0.1", "10.0.0.1:80", "[::1]:3", "EXAMPLE.org", "m.net", "n.net", ""]
    urls = [f"http://{r.choice(names)}{r.choice(['/de/', '/fr/', '/es/x', '?q', '#f', ''])}" for _ in range(400)] + [None, "nothing", "://"]
    spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, name string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(i, r.choice([0, 1]), r.choice([0, 0, 1])) for i in range(0, 400, 2)] + [(0, 0, 1), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = c.execute(f"select page_id, host, path, rule, verdict from ({entries.OP7_SQL})").fetchall()
    got = [tuple(x) for x in entries.op7_host_reputation(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got) == sorted(want) and {x[4] for x in got} == {"allow", "block"}
