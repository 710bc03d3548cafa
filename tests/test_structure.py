"""Page trees, files, runs over a site and routes of questions, on small cases."""

import random

from pyspark.sql import functions as F

from loamix.operators import dom, routing, upkeep


def page(html, url="https://x.org/a", contact=False, path="/a"):
    return dom.content(html, url, path, "x.org", contact, "main-content", "data-faq", "data-semesters", "University")


def test_main_block():
    long = "word " * 30
    assert page(f"<nav>m</nav><div id='page-content'>{long}</div>")["main"] == "id content"
    assert page(f"<article>short</article><div class='x post-content y'>{long}</div>")["main"] == "class post-content"
    assert page(f"<body><main>short</main>{long}</body>")["main"] == "body"
    out = page(f"<header>h</header><main id=main-content><header>Title</header><p>{long}</p><aside>details</aside></main><footer>f</footer>")
    assert (out["main"], out["empty"], out["lines"]) == ("marked", False, ["Title", long.strip(), "details"])
    assert page(f"<aside><main id=main-content>{long}</main></aside>")["lines"] == [long.strip()]
    assert page("<main id=main-content><header>" + long * 9 + "</header>few words</main>")["empty"]
    assert page("<main id=main-content>We could not find the requested page. " + long * 9 + "</main>")["empty"]
    assert page(None)["lines"] == page("")["lines"] == [] and page("<p>a<p>b")["lines"] == ["a", "b"]
    assert page("<head><title>t</title><p>no head end")["lines"] == ["no head end"] and page("<head><meta x><p>text")["lines"] == ["text"]


def test_landmarks():
    wide = "y" * 2001
    assert page(f"<footer>{wide}</footer><nav>{wide[1:]}</nav>t")["lines"] == [wide, "t"]
    html = "<header>Menu</header><footer><a href='tel:12'>Call us</a></footer>t"
    assert page(html)["lines"] == ["t"] and page(html, contact=True)["lines"] == ["Call us (12)", "t"]


def test_guard():
    inner = "<div><button>All Items</button><button>" + "z" * 200 + "</button></div>some text"
    out = page(f"<main id=main-content>{inner}</main>")
    assert out["dropped"] == ["filter"] and out["spared"] == ["filter"] and "z" * 200 in out["lines"][0]
    assert page("<main id=main-content><p>Image Unavailable</p></main>")["spared"] == ["placeholder"]
    assert page("<main id=main-content><p>Image Unavailable is a long sentence</p></main>")["lines"] == ["Image Unavailable is a long sentence"]
    assert page("<main id=main-content><div><button>Allied</button><button>B</button></div>text of it</main>")["dropped"] == []


def test_copies():
    body = "<p>" + "long text " * 20 + "</p>"
    table = "<div><div><button>Sem 1</button><button>Sem 2</button></div><table><tr><td>x</td></tr></table></div>"
    out = page(f"<main id=main-content>{body}{table}<section data-semesters><h3>Semester 1</h3><table><tr><td>x</td></tr></table></section></main>")
    assert out["dropped"] == ["courses"] and out["lines"][1:] == ["# Semester 1", "| x |"]
    assert page(f"<main id=main-content>{body}{table}</main>")["dropped"] == []
    asks = "<ul><li><button><span>1</span>How?</button><p>So.</p></li><li><button><span>2</span>Why?</button><p>No answer</p></li></ul>"
    out = page(f"<main id=main-content>{body}{asks}<section data-faq><h3>How?</h3><p>So.</p></section></main>")
    assert out["dropped"] == ["question"] and out["lines"][1:] == ["• 2Why?", "No answer", "# How?", "So."]


def test_addresses():
    of = lambda words, href: dom.address(words, href, "https://x.org/a/b", "x.org")
    assert of("mail", "mailto:a@b.org?subject=x") == "a@b.org" and of("A@b.org", "mailto:a@b.org") == ""
    assert of("call", "tel:+12 34") == "+12 34" and of("0 34", "tel:+1234") == "" and of("x", "tel:") == ""
    assert of("w", "/c") == of("w", "https://www.x.org/c") == of("w", "c") == of("w", "http://[bad") == ""
    assert of("w", "c d.pdf") == "https://x.org/a/c%20d.pdf" and of("w", "https://notx.org/") == "https://notx.org/"
    out = page("<main id=main-content><a href='https://y.org/'>https://y.org</a> <a href='https://y.org/'></a><a href='#p'>p</a><a href='/q'><span>Read more</span> of the rest of this long and winding story</a></main>")
    assert out["addresses"] == ["https://y.org/"] and out["dropped"] == ["leftover"]


def test_staff():
    card = lambda inner, kind="c": f"<div class={kind}>{inner}</div>"
    roster = [
        "<h3>Ms. A</h3><p>Clerk</p>", "<h3>Mr. B</h3><p>Directorate of X</p><p>Head</p><a href='mailto:b@x.org?s=1'>m</a>", "<h3>ms. a</h3><p>Clerk</p><a href='mailto:a@x.org'>m</a><i>0824 410051 (Ext. 3)</i>",
        "<h4>C</h4><p>Helper</p><a href='mailto:A@X.org'>m</a>", "<h4></h4><p>registrar</p><a href='tel:+92 12'>t</a>",
    ]
    html = "<main id=main-content><h1>Office</h1><section><h2>Dr. R</h2><p>Registrar</p></section><div>" + "".join(map(card, roster)) + "</div><div><h3>Hours</h3><p>9 to 5</p></div></main>"
    lines = [
        "# Office", "# Dr. R", "Registrar", "Mr. B — Head, Directorate of X. Email: b@x.org.", "ms. a — Clerk, Office. Email: a@x.org. Phone: 0824 410051 (Ext. 3).",
        "C — Helper, Office. Email not listed.", "Dr. R — registrar, Office. Email not listed. Phone: +92 12.", "# Hours", "9 to 5",
    ]
    assert page(html, path="/offices/r")["lines"] == lines
    assert "Mr. B" in " ".join(page(html)["lines"]) and "Email" not in " ".join(page(html)["lines"])


def test_deep_and_odd_pages(spark):
    deep = "<div>" * 5000 + "<button>All x</button><button>y</button>" + "text " * 50 + "</div>" * 5000
    wide = "".join(f"<a href='/{i}'>word{i}<b>" for i in range(3000))
    rows = [(1, deep, "u", 7), (1, wide, None, 7), (2, None, "http://[", 8), (3, "</p></div><![CDATA[<p>&#xFFFFFFFF;<", "u", 9)]
    out = dom.page_content(spark.createDataFrame(rows, "page_id long, html string, url string, page long"))
    found = sorted((r["page_id"], r["main"], len(r["lines"])) for r in out.collect())
    assert [f[:2] for f in found] == [(1, "page"), (1, "page"), (2, "page"), (3, "page")] and dom.page_content(spark.createDataFrame([], "page_id long, html string, url string")).count() == 0


def test_picked(spark):
    pages = [(f"a{i:03}", i % 3 == 0) for i in range(40)] + [("a001", False), ("a005", True)]
    picks = [("any", 4, lambda a: True), ("odd", 5, lambda a: int(a[1:]) % 2 == 1), ("few", 3, lambda a: a in ("a001", "a039")), ("none", 1, lambda a: False)]
    rules = [F.lit(True), F.substring("address", 2, 3).cast("int") % 2 == 1, F.col("address").isin("a001", "a039"), F.lit(False)]
    seen = {}
    for a, s in pages:
        seen[a] = seen.get(a, False) or s
    want, taken = [], set()
    for name, n, rule in picks:
        pool = sorted((s, a) for a, s in seen.items() if rule(a) and a not in taken)[:n]
        taken |= {a for _, a in pool}
        want += [(name, a, s) for s, a in pool]
    frame = spark.createDataFrame(random.Random(1).sample(pages, len(pages)), "address string, seen boolean").repartition(5)
    out = upkeep.picked(frame, [(name, n, rule) for (name, n, _), rule in zip(picks, rules)])
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_paragraph_windows(spark):
    rows = [(1, i, "Normal", t) for i, t in enumerate("a b c d e f".split())] + [(1, 6, "Heading 3 x", "H"), (1, 7, "Heading 1", " I "), (1, 8, None, "g"), (1, 9, "Normal", " "), (2, 0, None, None)]
    out = upkeep.paragraph_runs(spark.createDataFrame(rows, "doc_id int, pos int, style string, text string")).orderBy("doc_id", "chunk_no").collect()
    assert [(r["chunk_no"], r["kind"], r["text"]) for r in out] == [(1, "prose", "a b c"), (2, "prose", "c d e"), (3, "prose", "e f"), (4, "headings", "### H\n# I"), (5, "prose", "g")]


def test_runs_and_notes(spark):
    visits = [("a", 1, 0.0, 2.0, "ok"), ("a", 2, 5.0, 6.0, "unreachable"), ("a", 3, 6.0, 7.0, "ok"), ("b", 1, 0.0, 1.0, "dead")]
    out = {r["run"]: tuple(r)[1:] for r in upkeep.watched(spark.createDataFrame(visits, "run string, seq int, started double, ended double, reason string")).collect()}
    assert out == {"a": (2, 1, 3.0), "b": (1, 0, None)}
    facts = [
        ("s", 2, 0, False, "contact", None, "+1 234 567 890"), ("s", 1, 1, True, "contact", None, "+1 (234) 567890"), ("s", 1, 0, False, "contact", None, "A@b.org"),
        ("s", 1, 2, False, "other", None, "Email: a@b.org"), ("s", 1, 3, False, "pdf", "Form", "u"), ("s", 3, 3, False, "pdf", "Other words", "u"), ("s", 1, 0, False, "unknown", None, "x"), ("t", 1, 0, False, "other", None, " "),
    ]
    notes = upkeep.site_note(spark.createDataFrame(facts, "site string, page_id int, pos int, on_home boolean, kind string, words string, value string"), "Org").collect()
    assert [tuple(n) for n in notes] == [("s", "Org — official links and contacts\nContact:\nPhone: +1 (234) 567890\nEmail: A@b.org\n\nRules, policies and forms:\nForm: u")]


def test_routes(spark):
    frame = spark.createDataFrame([("where is the hall", "bus"), ("garee", None), ("garee", " bus times "), ("garee", "w " * 13)], "q string, r string")
    assert [r[0] for r in frame.select(routing.campus_query(F.col("q"), F.col("r"))).collect()] == ["where is the hall", "garee", "bus times", "garee"]
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    first = spark.createDataFrame([(1, 9, 0.4), (2, 9, -1.0), (4, 8, None)], "query_id int, doc_id int, score double")
    second = spark.createDataFrame([(i, 5, 0.1) for i in (1, 2, 3, 4)], "query_id int, doc_id int, score double")
    assert sorted((r["query_id"], r["doc_id"]) for r in routing.retried(asked, first, second).collect()) == [(1, 9), (2, 5), (3, 5), (4, 8)]
    told = spark.createDataFrame([("how many students?",), ("Which departments in science, latest news",), ("the dean",)], "q string").select(routing.general_branch(F.col("q")).alias("b")).collect()
    assert [(r["b"]["branches"], r["b"]["search"] == routing.NEWS_QUERY) for r in told] == [(["populations", "search"], False), (["departments", "search"], True), (["search"], False)]
