import random

from loamix.operators import html as H
from loamix.operators import scorers


def test_page_lines():
    html = (
        "<html><head><title>t</title></head><body><nav>menu</nav><h2>Fees &amp; dates</h2><p>One<br>two</p><ul><li>first<li>second</ul>"
        "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td> 2 </td></tr></table><script>var a='<p>';</script><footer>f</footer></body>"
    )
    assert H.page_lines(html) == ["# Fees & dates", "One", "two", "• first", "• second", "| A | B |", "| 1 | 2 |"]
    assert H.page_lines(None) == [] and H.page_lines("<p>open") == ["open"]


def test_page_text_and_filter(spark):
    html = "<h3>Semester 1</h3><table><tr><td>Course</td></tr></table><h3>Semester 2</h3><table><tr><td>Course</td></tr></table><p>ab</p><p>HOD</p><p>12+</p><p>12+</p><p>same line</p><p>Same  line</p><p>a{b;}</p><p>https://x.org/a</p>"
    frame = spark.createDataFrame([(1, html), (2, None), (3, "<nav>x</nav>")], "page_id long, html string")
    rows = {r["page_id"]: r["text"].split("\n") for r in H.page_text(frame).collect()}
    assert rows == {1: ["# Semester 1", "| Course |", "# Semester 2", "| Course |", "HOD", "12+", "12+", "same line"]}


def test_running_lines(spark):
    body = ["Rules on fees apply to all", "The library opens at nine", "Transport is free of charge", "Hostel rooms are shared"]
    pages = [(1, n, f"UNIVERSITY of Example, no {n}\nIntro {body[n]}\n{body[n]}\nmid {n}\nwords\n| a | b |\nlast of {body[n]}\nPage {n} of 4") for n in range(4)] + [(2, 0, "Head\ntext"), (2, 1, "Head\nmore")]
    out = {(r["d"], r["p"]): r["t"] for r in H.running_lines(spark.createDataFrame(pages, "d int, p int, t string"), "d", "p", "t").collect()}
    assert out[1, 2] == f"Intro {body[2]}\n{body[2]}\nmid 2\nwords\n| a | b |\nlast of {body[2]}"
    assert out[2, 0] == "Head\ntext"


def test_recurring_lines_take_few_ratios(monkeypatch):
    """Every verdict is that of the ratios of all pairs, though few of those are taken."""
    taken = []
    ratio = scorers.gestalt_ratio
    monkeypatch.setattr(scorers, "gestalt_ratio", lambda a, b: taken.append(a) or ratio(a, b))
    monkeypatch.setattr(H, "PAGES_AT_ONCE", 7)
    monkeypatch.setattr(H, "LINES_AT_ONCE", 5)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr" if kind else "kumwyzbqx") for _ in range(rng.randint(2, 7)))
    for case in range(6):
        pages = []
        for n in range(60):
            kind = n % 2
            own = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(3)]
            head = ["faculty of arts", f"faculty of arts {n}", f"the {word()} faculty of arts"][case % 3]
            pages.append([*own, *([head] if rng.random() < 0.7 else []), "", *(["also here"] if n % 3 else [])])
        asked = {k for p in pages for k in p if k}
        hits = lambda a: sum(any(b and ratio(a, b) >= 0.75 for b in p) for p in pages)
        taken.clear()
        assert H.recurring(pages, asked, 36, 0.75) == {a for a in asked if hits(a) >= 36}
        assert len(taken) < 60 * len(asked) / 2
    assert H.recurring([["a"], [""], []], {"a"}, 2, 0.75) == set()
