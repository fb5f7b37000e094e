"""Pages to titles, links and sections.

Which part of a page counts is a table of selectors by kind of URL, chosen in SQL; one Arrow UDF walks the HTML tree; plain
text needs no UDF at all.
"""

from __future__ import annotations

import itertools
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dom, urls
from ..functions.text import strip
from ..schemas import SECTION
from ..session import spread

# Where content is, by kind of page, and what is noise in it.
PORTAL_CONTENT = ["#divMainContent", "#questionsContent"]
RAW_CONTENT = ["body"]
WIKI_CONTENT = [".markdown-body", "#wiki-content", "article", "main"]
RELEASE_CONTENT = [".markdown-body"]
GENERIC_CONTENT = ["#tdBodyContent", ".kb-article-body", ".td-page-body", "[data-region='article-body']", "#articleBody", ".article-content", "main"]
NOISE = ["script", "style", "noscript", "nav", "footer", "header", "aside", ".breadcrumb", ".td-utility-bar", ".td-nav", ".pager", ".pagination", "#tdBreadcrumb", "#tdNavigation", "#tdSideMenu", ".td-side-menu"]

#: Bytes of bodies that are Python objects at a time, with what is found in them: a batch of rows may hold far more.
WALK_BYTES = 1 << 20


def profile(url: Column, generic: list[str] | None = None) -> Column:
    """struct<selectors, noise, need_text> of a page; selectors are empty for pages that hold links only."""

    def row(selectors: list[str], noise: list[str], need_text: bool) -> Column:
        texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        return F.struct(texts(selectors).alias("selectors"), texts(noise).alias("noise"), F.lit(need_text).alias("need_text"))

    path = F.lower(F.regexp_replace(urls.path(url), "/+$", ""))
    git = (
        F.when(path.contains("/wiki"), row(WIKI_CONTENT, NOISE, True))
        .when(path.rlike("(?d)/releases/tag/[^/]+$"), row(RELEASE_CONTENT, NOISE, True))
        .otherwise(row([], [], True))
    )
    return (
        F.when(urls.is_portal(url), row(PORTAL_CONTENT, NOISE, True))
        .when(urls.is_git_text(url), row(RAW_CONTENT, [], True))
        .when(urls.is_git_host(url), git)
        .otherwise(row(GENERIC_CONTENT if generic is None else generic, NOISE, False))
    )


_SECTIONS = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())]))
_FOUND = T.StructType([*[T.StructField(n, T.StringType()) for n in ("title", "h1", "title_left", "h1_left")], T.StructField("links", T.ArrayType(T.StringType())), T.StructField("sections", _SECTIONS)])


def _walk(url: str | None, body: str | None, form: str, selectors: list[str], noise: list[str], need_text: bool) -> dict | None:
    if body is None:
        return None
    root = dom.parse(body if form == "html" else f"<body>{dom.markdown_html(body) if form == 'markdown' else dom.plain_html(body)}</body>")

    def text(name: str) -> str | None:
        found = root.find(name)
        return None if found is None else found.text()

    links = []
    for a in root.walk():
        if a.name == "a" and "href" in a.attrs:
            try:
                links.append(urljoin(url or "", a.attrs["href"]))
            except ValueError:
                continue
    out = {"title": text("title"), "h1": text("h1"), "links": links}
    node = dom.content(root, selectors, noise, need_text)
    out["sections"] = None if node is None else [{"heading": h, "text": t} for h, t in dom.sections(node)]
    return out | {"title_left": text("title"), "h1_left": text("h1")}


@F.arrow_udf(_FOUND)
def _walked(url: pa.Array, body: pa.Array, form: pa.Array, selectors: pa.Array, noise: pa.Array, need_text: pa.Array) -> pa.Array:
    strings = pa.list_(pa.string())
    kind = pa.struct([("title", pa.string()), ("h1", pa.string()), ("title_left", pa.string()), ("h1_left", pa.string()), ("links", strings), ("sections", pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])))])
    columns = (url, body, form, selectors, noise, need_text)

    def some(start: int, end: int) -> pa.Array:
        return pa.array([_walk(*r) for r in zip(*(x.slice(start, end - start).to_pylist() for x in columns), strict=True)], kind)

    part = np.cumsum(pc.fill_null(pc.binary_length(body), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // WALK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(body)]
    return pa.concat_arrays([some(*cut) for cut in itertools.pairwise(cuts)])


def title_of(title: Column, h1: Column, url: Column) -> Column:
    """From the first <title> (without what follows a bar), else the first <h1>, else a code host's file name, else Untitled."""
    from_title = F.regexp_replace(title, r"(?dU)\s*[|]\s*.+$", "")
    return F.when(title.isNotNull(), urls.page_title(from_title, url)).when(h1.isNotNull(), urls.page_title(h1, url)).when(urls.is_git_text(url), urls.blob_title(url)).otherwise("Untitled")


def form_of(url: Column, raw: Column | None = None) -> Column:
    """html, markdown or text; raw as in read_pages."""
    raw = urls.is_git_text(url) if raw is None else raw
    markdown = F.lower(url).endswith(".md") | F.lower(url).endswith(".markdown")
    return F.when(~raw, "html").when(markdown, "markdown").otherwise("text")


def prepared(pages: DataFrame, url: str = "url", body: str = "body", generic: list[str] | None = None) -> DataFrame:
    """pages with what page_sections takes: url, body, form, selectors, noise, need_text."""
    u = F.col(url)
    rest = [c for c in pages.columns if c not in (url, body, "form", "selectors", "noise", "need_text", "_p")]
    return spread(pages).withColumn("_p", profile(u, generic)).select(*rest, u.alias("url"), F.col(body).alias("body"), form_of(u).alias("form"), "_p.selectors", "_p.noise", "_p.need_text")


@F.udtf(returnType="place bigint, heading string, text string", useArrow=True)
class PageSections:
    """A page's sections as rows; none without content or body."""

    def eval(self, url: str, body: str, form: str, selectors: list, noise: list, need_text: bool):
        found = _walk(url, body, form, list(selectors or []), list(noise or []), need_text)
        for place, s in enumerate((found or {}).get("sections") or []):
            yield place, s["heading"], s["text"]


def register_sections(spark: SparkSession) -> None:
    """SQL function page_sections, to be joined laterally with rows of prepared()."""
    spark.udtf.register("page_sections", PageSections)


def read_pages(pages: DataFrame, url: str = "url", body: str = "body", generic: list[str] | None = None, raw: Column | None = None) -> DataFrame:
    """pages with site_title (before noise goes), title, links (resolved, normalised, in order, with repeats) and sections (null if no content) added.

    raw marks bodies that are a file's text (Markdown by the URL's ending, else plain); by default code hosts' text files.
    A null body gives nulls.
    """
    u, b = F.col(url), F.col(body)
    form, p = form_of(u, raw), profile(u, generic)
    df = spread(pages).withColumn("_d", _walked(u, b, form, p["selectors"], p["noise"], p["need_text"]))
    links = F.filter(F.transform(F.col("_d.links"), urls.normalise), lambda x: x != "")
    return df.select(*pages.columns, title_of(F.col("_d.title"), F.col("_d.h1"), u).alias("site_title"), title_of(F.col("_d.title_left"), F.col("_d.h1_left"), u).alias("title"), links.alias("links"), F.col("_d.sections").alias("sections"))


def read_texts(files: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Plain-text files, without any UDF: as read_pages gives for them."""
    u = F.col(url)
    text = strip(F.coalesce(F.col(body), F.lit("")))
    none = F.lit(None).cast("string")
    sections = F.when(text != "", F.array(F.struct(none.alias("heading"), text.alias("text"))))
    return spread(files).select(*files.columns, title_of(none, none, u).alias("site_title"), title_of(none, none, u).alias("title"), F.array().cast("array<string>").alias("links"), sections.cast(SECTION).alias("sections"))

