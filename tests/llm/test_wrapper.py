from loamix.llm import wrapper as W


def page(host_part, title, paragraphs, extra="", inner=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<nav><ul><li><a href=/a>{host_part}</a><li><a href=/b>Menu</a></ul></nav><!-- x --><div class=\"ad\">Buy {title}</div>{extra}"
        f"<div id=wrap><div class='post-body'><h1>{title}</h1>{inner}{body}</div><div class=sidebar>More {title}</div>"
        f"<div class='comments'><p>I disagree {title}</p></div></div><footer>&copy; {host_part}</footer></body></html>"
    )


def test_article_without_furniture(spark):
    rows = [(i, f"https://Blog.example.org/p/{i}?x#y", page("Home", f"Title {i}", [f"First &amp; foremost {i}.", f"Second\n  line\t{i} &eacute;"], inner="<p>Read our daily letter</p>")) for i in range(40)]
    rows += [(100, "https://lone.example.com/", page("Lone", "Only", ["One paragraph of the lone page, long enough."])), (101, None, "<p>no host<p>second"), (102, "u", None), (103, "u", ""), (103, "u", "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    out = {r["page_id"]: r for r in W.extracted(frame).collect()}
    for i in range(40):
        assert out[i]["text"] == f"Title {i}\nFirst & foremost {i}.\nSecond line {i} é"
        assert out[i]["n_chars"] == len(out[i]["text"])
    assert out[100]["text"] == "Only\nOne paragraph of the lone page, long enough."
    assert out[101]["text"] == "no host\nsecond" and out[102]["text"] == "" and out[103]["n_chars"] == 0
    assert W.extracted(frame.limit(0)).count() == 0


def test_copies_of_one_article_are_no_template(spark):
    html = page("H", "Same", ["The very same article on every page of this host."])
    frame = spark.createDataFrame([(i, "http://c.example.net/x", html) for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in W.extracted(frame).collect()} == {"Same\nThe very same article on every page of this host."}


def test_broken_markup():
    cases = {
        "<article><h1>T</h1><p><b>One.<br><p>Two</article><footer>f": "T\nOne.\nTwo",
        "<main>a<aside>x</aside> b <form><p>q</p></form><ul><li>i<li>j</ul></main>": "a\nb\ni\nj",
        "<article><header><h1>Head</h1></header><p>x&nbsp;&lt;y</p><script>if(a<b)": "Head\nx <y",
        "<article><p>cut off<p": "cut off",
        "<div>" * 300 + "deep" + "</div>" * 300: "deep",
        "no markup at all": "no markup at all",
        "<article><p>a</p><div class='cookie-notice'>c</div><div role=complementary>d</div><p hidden>e</p><p>f</p></article>": "a\nf",
    }
    for html, text in cases.items():
        assert W.extract(html, None) == text, html


def test_tree_matching():
    def tree(kind, *children):
        return [kind, 1, 0, 1, 0, 0, list(children), 0, 0, 0, {}, 0, 0, len(children), 1]

    a = tree("r", tree("x"), tree("y", tree("z")), tree("w"))
    b = tree("r", tree("y", tree("z")), tree("v"), tree("w"))
    assert W.matched(a, b) == 4
    both = W.fold(a, b)
    assert [c[W.KEY] for c in both[W.KIDS]] == ["x", "y", "v", "w"] and [c[W.PAGES] for c in both[W.KIDS]] == [1, 2, 1, 2]


def extracted_of(spark, pages):
    frame = spark.createDataFrame([(i, "http://h.example.org/", html) for i, html in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in W.extracted(frame).orderBy("page_id").collect()]


def test_text_beside_the_body_stays(spark):
    menu, foot = "<nav><a href=/>Home</a></nav>", "<footer>All rights reserved</footer>"
    body = "".join(f"<p>Sentence {k} of the story {{i}}, as long as all others.</p>" for k in range(9))
    told = [f"Sentence {k} of the story {{i}}, as long as all others." for k in range(9)]
    shapes = {
        "<div class=post><h1>Title {i}</h1><p class=lead>Lead {i}</p><div class=body>" + body + "</div></div>": ["Title {i}", "Lead {i}", *told],
        "<main><section class=intro><p>Intro {i}</p></section><section class=story>" + body + "</section></main>": ["Intro {i}", *told],
        "<div class=post><h1>Title {i}</h1><article>" + body + "</article></div>": ["Title {i}", *told],
        "<div class=post><header><h1>Title {i}</h1></header><div class=body>" + body + "</div></div>": ["Title {i}", *told],
        "<header><h1>Title {i}</h1></header><div class=body>" + body + "</div>": ["Title {i}", *told],
        "<div class=note>The same on every page</div><div class=post>" + body + "</div>": told,
    }
    for shape, text in shapes.items():
        assert extracted_of(spark, [(menu + shape + foot).replace("{i}", f"{i}") for i in range(30)]) == ["\n".join(text).replace("{i}", f"{i}") for i in range(30)], shape


def test_one_page_with_its_text_elsewhere(spark):
    usual = "<div id=a class=x><p>The story {i} in the usual place, rather long.</p></div><div class=y></div>"
    other = "<div id=a class=x><p>See below</p></div><div class=y><p>All of this page's text is in the other place</p></div>"
    out = extracted_of(spark, [usual.replace("{i}", f"{i}") for i in range(30)] + [other])
    assert out[3] == "The story 3 in the usual place, rather long." and out[30] == "See below\nAll of this page's text is in the other place"


def test_copies_with_a_stamp_keep_their_text(spark):
    pages = [f"<div class=a><p>{'The very same article on every page. ' * 20}</p></div><div class=b>{i % 10}</div>" for i in range(30)]
    assert all("The very same article" in text for text in extracted_of(spark, pages))


def test_names_are_evidence_only(spark):
    words = "A paragraph of running text that is long enough to stand for the story."
    cases = {
        # the end of the head is optional
        f"<html><head><title>t</title><meta charset=utf-8><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{words}</p></article>": f"T\n{words}",
        # a form around the whole page
        f"<form id=aspnet><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{words}</p></article></form>": f"T\n{words}",
        f"<body><form><h1>T</h1><p>{words}</p></form></body>": f"T\n{words}",
        f"<article><p>{words}</p><section class='related-work'><p>{words}</p></section></article>": f"{words}\n{words}",
        f"<article><div class='post-header'><h1>T</h1></div><p>{words}</p></article>": f"T\n{words}",
        f"<article><p>{words}</p><p class='legal'>L</p><p id='notice'>N</p></article>": f"{words}\nL\nN",
        f"<article><p>{words}</p><ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a></ul></article>": f"{words}\nOne\nTwo\nThree",
        f"<article><p>{words}</p><form><p>Your name</p></form><div class=share-buttons>Share</div></article>": words,
        f"<article><p>{words}</p></article><div class=comments><p>{words * 20}</p></div>": words,
        f"<p>{words}</p><button>press<p>{words}</p>": f"{words}\npress\n{words}",
    }
    for html, text in cases.items():
        assert W.extract(html, None) == text, html
    shapes = ["<form><nav><a href=/>Home</a></nav><div class=story><h1>Title {i}</h1><p>The story {i} " + words + "</p></div></form>", "<div class=notice><h1>Title {i}</h1><p>The story {i} " + words + "</p></div>"]
    for shape in shapes:
        assert extracted_of(spark, [shape.replace("{i}", str(i)) for i in range(30)]) == [f"Title {i}\nThe story {i} {words}" for i in range(30)]


def test_deep_and_long_pages(spark):
    deep = "".join(f"<div>at {i}" for i in range(5000))
    assert W.extract(deep, None) == "\n".join(f"at {i}" for i in range(5000))
    inner = "<div>" * 5000 + "<nav>menu</nav><p>one<div class=ad>Buy</div><p>two" + "</div>" * 5000
    assert W.extract(inner, None) == "one\ntwo"
    long = ["<article>" + "".join(f"<h2>Part {i} of {k}</h2><p>Text {i} of {k}</p>" + ("<ul><li>x</ul>" if (i * k) % 7 == 3 else "") for i in range(4000)) + "</article>" for k in (1, 2)]
    pages = [*long, deep, "x" * 3_000_000]
    out = extracted_of(spark, pages)
    assert out[0].startswith("Part 0 of 1\nText 0 of 1\n") and out[0].count("\n") == 8000 + sum(i % 7 == 3 for i in range(4000)) - 1
    assert out[2].count("\n") == 4999 and out[3] == pages[3]


def brute_matched(a, b):
    """Simple tree matching by its defining recursion."""
    if a[W.KEY] != b[W.KEY]:
        return 0
    xs, ys = a[W.KIDS], b[W.KIDS]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_matched(x, y))
    return 1 + best[-1][-1]


def test_matching_and_folding_against_brute_force(monkeypatch):
    import random

    rng = random.Random(7)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randint(0, 5))] if depth else []
        return [rng.choice("abc"), 1, 0, 1, 0, 0, kids, 0, 0, 0, {}, 0, 0, len(kids), 1]

    for cells in (W.CELLS, 4):
        monkeypatch.setattr(W, "CELLS", cells)
        for _ in range(150):
            a, b = tree(3), tree(3)
            a[W.KEY] = b[W.KEY] = "r"
            assert W.matched(a, b) == brute_matched(a, b)
            both = W.fold(a, b)
            kinds = lambda t: [c[W.KEY] for c in t[W.KIDS]]
            for one in (a, b):  # each page's children stand in the folded ones in their order
                rest = iter(kinds(both))
                assert all(k in rest for k in kinds(one))
            assert sum(c[W.PAGES] for c in both[W.KIDS]) == len(a[W.KIDS]) + len(b[W.KIDS])


def test_frequent_members_are_never_let_go():
    import random

    rng = random.Random(3)
    whole = None
    for i in range(600):
        html = "<main>" + "".join(f"<p>own {i} {rng.random()}</p>" for _ in range(rng.randint(1, 9))) + ("<p>the usual line</p>" if i % 20 else "") + "".join(f"<div class=c{rng.choice('abcdefghij')}x>{rng.random()}</div><h{rng.randint(3, 6)}>x</h3>" for _ in range(12)) + "</main>"
        root = W.parse(html)
        W.summed(root)
        new = W.slot([root])
        whole = new if whole is None else W.fold(whole, new)
    main = whole[W.KIDS][0]
    paragraphs = next(c for c in main[W.KIDS] if c[W.KEY] == "p")
    assert len(paragraphs[W.MEMBERS]) < 400
    line = W.parse("<p>the usual line</p>")
    W.summed(line)
    crc = line.parts[0].crc
    assert 570 - paragraphs[W.LOST] <= paragraphs[W.MEMBERS][crc] <= 570 and paragraphs[W.LOST] <= 600 / 8


def test_sliced_batches():
    import pyarrow as pa
    from loamix.llm.common import sliced

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 25, "", "c"]), pa.array([1, 2, 3, 4, 5])], ["t", "n"])
    parts = [p.column("n").to_pylist() for p in sliced(batch, "t", most=20)]
    assert parts == [[1, 2], [3], [4, 5]] and list(sliced(batch.slice(0, 0), "t")) == []
