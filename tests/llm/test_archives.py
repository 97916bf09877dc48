"""ARC conversion, page extraction and vector search against plain Python."""

import gzip
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import arc_convert, lsh_forest, style_tree

BODY = "<p>same text é \r\n\r\n WARC/1.1\r\n http://x 1 2 text/html 7\n" * 30


def expected(rows):
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        best[b] = max(best.get(b, -(2**62)), -(2**62) if i is None else i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and best[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None))
    return out


def test_pages_survive_both_formats(spark):
    rows = [
        (1, "http://a.example/x y\nz", BODY), (2, None, BODY), (9, "http://b.example/", BODY), (3, "", None), (4, "http://c", ""),
        (5, "http://c", "\n"), (6, "http://c", "x\n\n"), (7, "dns:c", "a" * 999), (8, "http://c", "a" * 999),
        (10, "http://d", "y" * 300_000), (11, "http://d", "y" * 300_000), (None, "http://e", "no id"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    df = df.withColumn("record_type", F.lit("x"))
    got = arc_convert.page_records(df).collect()
    key = lambda r: str(r[0])
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(found, key=key) == sorted(expected(rows), key=key)
    assert arc_convert.page_records(df.limit(0)).count() == 0


def test_both_versions_and_broken_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX-Archive-Row: 5\r\n\r\nbody\n"
    one = b"filedesc://o.arc 0.0.0.0 19970101 text/plain 20\n1 0 org\nURL IP-add\n\n"
    one += b"http://a/old url 1.2.3.4 19970102030405 text/html %d\n" % len(http) + http + b"\n"
    one += b"not a header line\n"
    one += b"dns:a 1.2.3.4 19970102 text/dns 4\nabcd\n"
    one += b"http://a/cut 1.2.3.4 19970102030405 text/html 100\nHTTP/1.0 200 OK\r\n\r\nshort"
    two = b"filedesc://t.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 t.arc 16\n2 0 org\nURL IP-\n\n"
    two += b"http://b/ 1.2.3.4 20010102030405 text/html 200 sum - 99 t.arc %d\n" % len(http) + http + b"\n"
    (tmp_path / "arcs").mkdir()
    for name, data in (("one", one), ("two", two)):
        (tmp_path / "arcs" / f"{name}.arc.gz").write_bytes(gzip.compress(data))
    index = arc_convert.arc_index(spark, str(tmp_path / "arcs")).collect()
    found = {r.uri: (r.kind, r.row, r.length, r.date, r.error) for r in index}
    assert found["http://a/old url"] == ("response", 5, 5, "1997-01-02T03:04:05Z", "")
    assert found["http://b/"] == ("response", 5, 5, "2001-01-02T03:04:05Z", "")
    assert found["dns:a"] == ("resource", None, 4, "1997-01-02T00:00:00Z", "")
    assert found["http://a/cut"][4] == "cut off" and found["not"][4] == "unreadable header line"
    assert found["filedesc://o.arc"][0] == found["filedesc://t.arc"][0] == "warcinfo"
    arc_convert.convert(spark, str(tmp_path / "arcs"), str(tmp_path / "warcs"))
    back = {r.uri: r for r in arc_convert.read_warcs(spark, str(tmp_path / "warcs")).collect() if r.uri}
    assert back["http://b/"].payload_digest == hashlib.sha1(b"body\n").hexdigest()
    assert back["http://a/cut"].payload_bytes == 5 and "not" not in back
    assert len({r.id for r in index}) == len(index)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content">{main}</div><div class="comments"><article class="comment"><p>Nice!</p></article></div>
<aside>Side</aside><form><label>Mail</label><input name=q></form><script>var x="<p>no</p>";</script>
<footer>&copy; 2024</footer></body></html>"""


def test_article_without_its_surroundings():
    main = "<article><header><h1>A &amp; B</h1></header><p>One\n  two&nbsp;<b>th</b>ree<br>four<p>Five<div class='share'>Tell</div></article>"
    assert style_tree.main_text(PAGE.format(main=main)) == "A & B\nOne two three four\nFive"
    assert style_tree.main_text(PAGE.format(main="<h2>H</h2>text <i>in</i>line<ul><li>a<li>b</ul>")) == "H\ntext inline\na\nb"
    assert style_tree.main_text("<p>cut <b>off</b> he<p") == "cut off he"
    for empty in (None, "", "   ", "<nav>x</nav>", "<!-- a <p>b"):
        assert style_tree.main_text(empty) == ""
    assert style_tree.main_text("1 < 2 & 3 > 2 &lt;p&gt;") == "1 < 2 & 3 > 2 <p>"
    assert style_tree.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_marked_branches_that_hold_the_text_stay():
    main = "<h2>Title of it</h2>" + "".join(f"<p>Paragraph {i} says a few words about the matter.</p>" for i in range(6))
    want = style_tree.main_text(main)
    assert want.count("\n") == 6
    nav = "<nav><a href='/'>Home</a></nav><div class='share'>Tell a friend</div>"
    for around in (
        "<form id='aspnetForm' method=post><input type=hidden name=x>{}</form>",
        "<div id='page' class='has-sidebar'>{}</div>",
        "<div class='content search-page'>{}<div class='related'><article>Other one</article></div></div>",
        "<div class='related-work'>{}</div>",
        "<div class='page-header'>{}</div>",
        "<form id=f><div class='wrap widget'>{}</div></form>",
        "<div data-title='a hidden gem'>{}</div>",
        "<div title=\"the hidden cost\" data-x = ' hidden '>{}</div>",
    ):
        assert style_tree.main_text(f"<body>{around.format(nav + main)}<footer>Imprint</footer></body>") == want, around
    form = "<form><p>Write to us, we answer all letters soon and gladly.</p><input name=a><textarea></textarea></form>"
    links = "<div class='related'>" + "<a href='/x'>Another story of this paper with a long name</a> " * 20 + "</div>"
    for other in (form, links, "<div hidden>No</div>", "<div class=x hidden=''>No</div>", "<div title='a'hidden>No</div>"):
        assert style_tree.main_text(f"<body>{other}{main}</body>") == want, other
    comments = "<div class='comments'>" + "<p>I think so, too, and say it at length.</p>" * 20 + "</div>"
    assert style_tree.main_text(f"<body><article>{main}</article>{comments}</body>") == want
    half = "<form>" + "<p>This form is a long text with a single field.</p>" * 5 + "<input name=q></form>"
    assert style_tree.main_text(f"<body>{main}{half}</body>").count("single field") == 5


def test_repeated_branches_of_a_host_are_found(spark):
    r = random.Random(0)
    text = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        paragraphs = [text(12) for _ in range(3)]
        extra = "<div class='x7'><p>Buy our magazine now</p></div>" if i < 30 else ""
        host = "h.example" if i < 30 else f"h{i}.example"
        rows.append((i, f"http://{host}/{i}", f"<body>{extra}<div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div></body>"))
        want[i] = "\n".join(paragraphs)
    rows += [(100 + i, "http://h.example/same", rows[0][2]) for i in range(30)]  # copies are no template
    rows += [(200, None, None), (201, "::bad", "<p>x"), (201, "::bad", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("low", F.lit(2))
    got = [(x.page_id, x.text, x.n_chars) for x in style_tree.extract(df).collect()]
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    by_id = {i: t for i, t, _ in got}
    assert {i: by_id[i] for i in want} == want
    assert all(by_id[100 + i] == want[0] for i in range(30))
    assert (by_id[200], by_id[201]) == ("", "x")
    assert style_tree.extract(df.limit(0)).count() == 0


def test_repeated_blocks_of_any_tag_are_found(spark):
    r = random.Random(1)
    text = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i, host in enumerate(["big.example"] * 30 + ["two.example"] * 2 + ["one.example"]):
        head, *paragraphs = [text(4), *(text(12) for _ in range(3))]
        again = "" if i in (3, 4) else "<p>All rights belong to us</p>"
        marked = [paragraphs[0], f"<b>{paragraphs[1]}</b>", f"<i>{paragraphs[2]}</i>"]  # three presentations of a node
        rows.append((i, f"http://{host}/{i}", f"<body><article><h1>{head}</h1>{again}{''.join(f'<p>{p}</p>' for p in marked)}</article>"))
        want[i] = "\n".join([head, *(["All rights belong to us"] if host == "one.example" else []), *paragraphs])
    # two versions of a text on a small host, and a quotation on 3 of 30 pages, are no template
    shared = [text(20) for _ in range(4)]
    for i in (40, 41):
        body = [*shared, text(10)]
        rows.append((i, f"http://copy.example/{i}", "<article>" + "".join(f"<p>{p}</p>" for p in body)))
        want[i] = "\n".join(body)
    quote = text(9)
    for i in (7, 8, 9):
        rows[i] = (*rows[i][:2], rows[i][2].replace("</article>", f"<blockquote>{quote}</blockquote></article>"))
        want[i] += "\n" + quote
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in style_tree.extract(df).collect()} == want


@pytest.mark.parametrize("copies, pages", [(2, 2), (7, 7), (9, 9), (9, 12), (12, 20)])
def test_near_copies_keep_their_article(spark, copies, pages):
    """Pages that share most of their article keep it, however many pages their host has."""
    shared = [f"Paragraph {i} of the press release tells what many readers wanted to know." for i in range(8)]
    rows, want = [], {}
    for i in range(pages):
        body = [f"Title {i}", *(shared if i < copies else [f"Page {i} has sentence {k} of its own." for k in range(8)]), f"Printed by site {i}."]
        rows.append((i, f"http://m.example/{i}", "<article>" + "".join(f"<p>{p}</p>" for p in body) + "</article>"))
        want[i] = "\n".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in style_tree.extract(df).collect()} == want


def test_unclosed_tags_are_scanned_once():
    deep = "<b>" * 20_000 + "x<div>y</div>" * 20_000, "<div>x" * 20_000, "<p>x" * 20_000 + "</div>" * 20_000
    for page in ("<a " * 70_000, "<a x='" * 40_000, "<p>text " + "<b y=\"" * 40_000, "<a" * 100_000, *deep):
        start = time.perf_counter()
        style_tree.parse(page)
        assert time.perf_counter() - start < 1


def test_forest_recall_and_order(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((700, 16)).astype(np.float32)
    x[5:20] = x[4]
    x[30] = x[100] * 2
    rows = [(i, [float(v) for v in row], "c") for i, row in enumerate(x)]
    rows += [(700, None, "c"), (750, [0.0] * 16, "c"), (800, [float("nan")] + [1.0] * 15, "c"), (801, [None] + [1.0] * 15, "c")]
    rows += [(None, rows[0][1], "c"), (802, [float("inf")] + [1.0] * 15, "c"), (4, rows[4][1], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = lsh_forest.nearest_vectors(df, df.filter("vec_id % 50 = 0 or vec_id = 4"), rows=200, queries_per_block=9).collect()
    full = x.astype(np.float64)
    hits = asked = 0
    for q in [4, *range(0, 700, 50)]:
        score = lsh_forest.cosine(full, full[q])
        want = [int(i) for i in sorted(range(700), key=lambda i: (-score[i], i)) if i != q][:5]
        mine = sorted((m for m in found if m.query_id == q), key=lambda m: m["rank"])
        assert [m["rank"] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(m["score"] - score[m.vec_id]) < 1e-12 for m in mine)
        assert [(-m["score"], m.vec_id) for m in mine] == sorted((-m["score"], m.vec_id) for m in mine)
        hits += len({m.vec_id for m in mine} & set(want))
        asked += 5
        if q == 4:
            assert [m.vec_id for m in mine] == [5, 6, 7, 8, 9]
    assert hits / asked >= 0.9 and {m.query_id for m in found} == {4, *range(0, 700, 50)}
    few = df.filter("vec_id in (0, 1, 2)")
    assert lsh_forest.nearest_vectors(few, few.filter("vec_id = 0")).count() == 2
    assert lsh_forest.nearest_vectors(df.limit(0), df.limit(0)).count() == 0
