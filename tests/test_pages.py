from corvane.functions import dom
from corvane.operators import chunking, pages

WORDS = "These are plain words that only fill a paragraph up to a useful length for the test at hand. "
PORTAL = "https://x.teamdynamix.com/TDClient/2/Dept/KB/ArticleDet?ID=1"
WIKI = "https://github.com/o/r/wiki/Setup"


def read(spark, *rows, **more):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, body string")
    return pages.read_pages(df, **more).orderBy("i").collect()


def test_branches(spark):
    article = f"<html><head><title>Article - Sleep | Base</title></head><body><nav>menu</nav><div id=divMainContent><h2>One</h2><p>{WORDS}</p><footer>end</footer><h2>Two</h2><p>{WORDS}</p></div></body></html>"
    wiki = f"<title>Setup</title><div class='x markdown-body'><h2>Install</h2><p>{WORDS}</p></div>"
    main = f"<title>Hi</title><main><h3>About</h3>{WORDS}</main>"
    rows = read(
        spark,
        (PORTAL, article), (WIKI, wiki), ("https://github.com/o/r", wiki), ("https://github.com/o/r/releases/tag/v1", wiki), ("https://a.org", main),
        ("https://a.org", "<title></title><h1>Shown</h1><article>x</article>"), ("https://a.org", "<h1>Top <b>line</b></h1><main></main>"), ("https://a.org", None), (PORTAL, "<div id='divMainContent'><nav>x</nav></div>"),
    )
    assert [r["title"] for r in rows] == ["Sleep", "Setup", "Setup", "Setup", "Hi", "", "Top line", "Untitled", "Untitled"]
    assert [s["heading"] for s in rows[0]["sections"]] == [None, "One", "Two"]
    assert "end" not in rows[0]["sections"][1]["text"] and rows[0]["sections"][0]["text"] == ""
    assert [r["sections"] is None for r in rows] == [False, False, True, False, False, True, False, True, True]
    assert rows[6]["sections"][0]["text"] == ""  # a generic page's content may be empty


def test_title_may_go_with_noise(spark):
    r = read(spark, ("https://a.org", "<main><header><h1>Gone</h1></header><h1>Left</h1></main>"))[0]
    assert (r["site_title"], r["title"]) == ("Gone", "Left")


def test_links(spark):
    body = '<nav><a href="/kb/other">x</a></nav><a href="https://x.org/page#frag">y</a><a>no</a><a href="?q=1">z</a><a href="../up/">u</a><a href="/kb/other">x</a><a href="http://[bad">b</a><a href="mailto:a@b.org">m</a>'
    r = read(spark, ("https://example.org/kb/article", body))[0]
    assert r["links"] == ["https://example.org/kb/other", "https://x.org/page", "https://example.org/kb/article?q=1", "https://example.org/up", "https://example.org/kb/other", "mailto:a@b.org"]


def test_raw_files(spark):
    md = "# Setup Notes\n\nIntro *text* here.\n\n## Needs\n\n- one\n- two `x<y`\n\n```python\ndef f():\n    return 1\n```\n\n| Name | Value |\n| --- | --- |\n| alpha | 1 |\n\n[link](other.md) & <b>bold</b>\n"
    base = "https://github.com/o/r/blob/main/docs/"
    rows = read(spark, (base + "setup.md", md), (base + "release-notes.txt", "  a < b\n\nand <i>more</i>  "), (base + "empty.txt", " \n"))
    assert [r["title"] for r in rows] == ["Setup Notes", "Release Notes", "Empty"]
    assert [s["heading"] for s in rows[0]["sections"]] == [None, "Needs"]
    needs = rows[0]["sections"][1]["text"]
    for part in ("one two x<y", "return 1", "Name", "alpha", "link & bold"):
        assert part in " ".join(needs.split())
    assert rows[0]["links"] == [base + "other.md"]
    assert rows[1]["sections"][0]["text"] == "a < b\n\nand <i>more</i>" and rows[2]["sections"] is None
    files = spark.createDataFrame([(base + "release-notes.txt", "  a < b\n\nand <i>more</i>  "), (base + "empty.txt", None)], "url string, body string")
    same = pages.read_texts(files).collect()
    assert same[0]["sections"][0]["text"] == rows[1]["sections"][0]["text"] and same[0]["title"] == "Release Notes" and same[1]["sections"] is None


def test_tree_rules():
    root = dom.parse("<p><b>one<br><p>two</b></i></p>three<!-- c --><script>var x='</p>'</script><style>s</style>four&amp;<x/>five")
    assert root.text() == "one two three four& five"
    assert [n.name for n in root.walk() if n.name != "!"] == ["p", "b", "br", "p", "script", "style", "x"]
    nested = dom.parse("<main><div><h2>In</h2><p>text</p></div>tail</main>").find("main")
    assert dom.sections(nested) == [(None, "In text tail"), ("In", "text")]
    assert dom.sections(dom.parse("<main><p>a</p>\n<p>b</p></main>").find("main")) == [(None, "a\nb")]
    assert dom.sections(dom.parse("<main>pre<h2>H</h2> <p>a</p> <p>b</p></main>").find("main")) == [(None, "pre"), ("H", " a  b")]
    assert len(dom.select(dom.parse("<a id=x class='p q' data-region='r'></a>"), "[data-region='r']")) == 1
    assert [len(dom.select(dom.parse("<a id=x class='p q'></a>"), s)) for s in ("a", ".q", "#x", ".pq", "b")] == [1, 1, 1, 0, 0]


def brute_parents(text):
    import re

    text, out = re.sub(r"\n{3,}", "\n\n", text).strip(), []
    if len(text) < 60:
        return out
    while len(text) > 1200:
        cut = text.rfind("\n", 0, 1200)
        cut = 1200 if cut < 60 else cut
        out.append(text[:cut])
        text = text[cut:].strip()
    return [*out, text] if text else out


def brute_children(x):
    if len(x) <= 350:
        return [x]
    out, s = [], 0
    while True:
        end = min(s + 350, len(x))
        cut = x.rfind("\n", s, end) if end < len(x) else end
        cut = end if cut <= s else cut
        if len(x[s:cut].strip()) >= 60:
            out.append(x[s:cut].strip())
        if end >= len(x):
            return out or [x]
        s += 297


def test_chunks_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    texts = ["", "x" * 59, "x" * 60, "x" * 1200, "x" * 1201, "x" * 3000, "a\n" * 900, "y" * 1199 + "\n" + "z" * 100, "y" * 1200 + "\n" + "z" * 100, " \n\n\n\n " + "w " * 900, "".join(str(i % 10) for i in range(1000)), ("\n" + "x" * 400) * 3, "é😀 " * 700, "a" * 50 + "\n" + "b" * 1300]
    texts += ["".join(rng.choice(list("ab \n\n"), int(rng.integers(0, 5000)), p=[0.45, 0.4, 0.1, 0.025, 0.025])) for _ in range(60)]
    from corvane.functions.text import squeeze_breaks
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.cut_parent(squeeze_breaks(F.col("t"))).alias("p"))
    got = {r["i"]: r for r in df.select("i", "p", F.transform("p", lambda x: chunking.child_windows(x)).alias("c")).collect()}
    for i, t in enumerate(texts):
        expected = brute_parents(t)
        assert got[i]["p"] == expected, i
        assert got[i]["c"] == [brute_children(x) for x in expected], i


def test_window_places(spark):
    from pyspark.sql import functions as F

    text = "".join(str(i % 10) for i in range(1000))
    got = spark.createDataFrame([(text,)], "x string").select(chunking.child_windows(F.col("x"))).first()[0]
    assert got == [text[0:350], text[297:647], text[594:944], text[891:1000]]


def test_pids_run_over_pages(spark):
    rows = [(i, f"https://a.org/{i}", f"<title>T{i}</title><main>" + "".join(f"<h2>S{k}</h2><p>{WORDS}</p>" for k in range(i)) + "</main>") for i in range(4)]
    df = spark.createDataFrame(rows, "seq int, url string, body string")
    parents = chunking.number_parents(chunking.parents(pages.read_pages(df), "seq"), "seq")
    got = [(r["pid"], r["seq"], r["t"]) for r in parents.orderBy("pid").collect()]
    assert got == [(0, 1, "T1 -- S0"), (1, 2, "T2 -- S0"), (2, 2, "T2 -- S1"), (3, 3, "T3 -- S0"), (4, 3, "T3 -- S1"), (5, 3, "T3 -- S2")]


def test_references_without_a_semicolon(spark):
    r = read(spark, ("https://a.org", "<title>A &amp;&amp; B &amp</title><main>C &amp</main>"), ("https://a.org", "<title>A &amp;&am</title>"))
    assert [x["title"] for x in r] == ["A && B &", "A &&am"] and r[0]["sections"][0]["text"] == "C &"
