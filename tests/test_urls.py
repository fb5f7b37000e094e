import pytest
from pyspark.sql import functions as F

from corvane.functions import urls


@pytest.fixture(scope="module")
def ask(spark):
    def run(column, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
        return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").select("x").collect()]

    return run


U = None


@pytest.fixture(scope="module", autouse=True)
def column(spark):
    global U
    U = F.col("u")


def test_normalise(ask):
    assert ask(urls.normalise(U), "https://a.org/x/#frag", " https://a.org/x// ", "https://a.org", "#top", "\thttps://a.org/y\n") == ["https://a.org/x", "https://a.org/x", "https://a.org", "", "https://a.org/y"]


def test_origin_and_prefix(ask):
    assert ask(urls.origin(U), "HTTPS://me@Host.org:8080/a?b", "http://x.org") == ["https://me@Host.org:8080", "http://x.org"]
    assert ask(urls.auto_prefix(U), "https://p.teamdynamix.example/TDClient/210/Dept/Home/", "https://p.example/TDClient/210/Dept", "https://a.org/x/") == ["https://p.teamdynamix.example/TDClient/210/Dept/", "https://p.example", "https://a.org"]


def test_git_hosts(ask):
    hosts = ["https://github.com/a/b", "https://GitLab.com/a", "https://git.dept.edu/a", "https://me.github.io/x", "https://github.io", "https://github.com.evil.org/a", "https://git.a.b.com/x", "https://example.org"]
    assert ask(urls.is_git_host(U), *hosts) == [True, True, True, True, True, False, False, False]
    files = ["https://github.com/a/b/blob/main/docs/x.md", "https://github.com/a/b/blob/main/x.PY", "https://github.com/a/b/blob/main/d/x.TXT?raw=1", "https://example.org/a/b/blob/main/x.md"]
    assert ask(urls.is_git_text(U), *files) == [True, False, True, False]
    assert ask(urls.git_raw_url(U), files[0], files[2]) == ["https://raw.githubusercontent.com/a/b/main/docs/x.md", "https://raw.githubusercontent.com/a/b/main/d/x.TXT"]
    assert ask(urls.blob_title(U), "https://github.com/a/b/blob/main/docs/release-notes.txt", "https://github.com/a/b/blob/main/o'neil_3d--x.md", "https://github.com/a/b/blob/main/-.md") == ["Release Notes", "O'Neil 3D X", "Untitled"]


def test_kind(ask):
    assert ask(urls.kind(U), "https://github.com/a", "https://x.TeamDynamix.com/TDClient/1/a/", "https://example.org/a") == ["code", "kb", "page"]


def test_assets(ask):
    assert ask(urls.is_asset(U), "https://a.org/x.PDF", "https://a.org/x.pdf?v=1", "https://a.org/x.pdf/y", "https://get.sh", "https://a.org/x.md", "https://a.org/x.css#a") == [True, True, False, True, False, False]


def test_scope(ask):
    scope = lambda includes=(), excludes=(): urls.in_scope(U, "https://a.org/docs", "https://a.org", list(includes), list(excludes))
    links = ["https://a.org/docs/x", "https://a.org/other", "https://b.org/docs", "https://a.org.evil.com/docs", "https://a.org/docs/x.pdf"]
    assert ask(scope(), *links) == [True, False, False, False, False]
    # Includes replace the prefix rule and open other origins; excludes win over them.
    assert ask(scope([r"b\.org/"]), *links) == [False, False, True, False, False]
    assert ask(scope([r"a\.org"], ["/OTHER"]), *links) == [True, False, False, True, False]
    assert ask(urls.in_scope(U, "https://a.org", "https://a.org"), links[3]) == [True]  # origins are compared as text


def test_excludes(ask):
    tails = ["/Search", "/Search/", "/Search?q=1", "/issues/3", "/issues", "/CategoryID=3", "/tree/main", "/a.md", "/wiki/_edit", "/x.yml"]
    assert ask(urls.matches(U, urls.CRAWL_EXCLUDES), *tails) == [False, True, True, True, False, False, False, False, True, True]
    assert ask(urls.matches(U, urls.INDEX_EXCLUDES), *tails) == [False, True, True, True, False, True, True, False, True, True]
    with pytest.raises(Exception, match="unterminated|missing"):
        urls.compiled(["("])
    assert ask(urls.matches(U, []), "x") == [False]


def test_titles_and_ids(ask):
    portal = urls.page_title(U, F.lit("https://x.teamdynamix.com/a"))
    assert ask(portal, "Article - Sleep", "Question Detail - Why", "Article - Question Detail - Both") == ["Sleep", "Why", "Both"]
    assert ask(urls.page_title(U, F.lit("https://a.org")), "Article - Sleep") == ["Article - Sleep"]
    assert ask(urls.cache_path(U), "abc") == [".kb_cache/pages/a9993e364706816aba3e25717850c26c9cd0d89d.html"]
    assert len(ask(urls.stable_id(U, F.lit("h")), "https://a.org/")[0]) == 16
