"""URL functions and the crawl-scope predicate as column expressions (no UDF; all stay in generated code)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and patterns that decide which URLs are in scope.
BINARY_EXTENSIONS = [
    "pdf", "zip", "gz", "exe", "rar", "7z", "tar", "bin", "dmg", "iso", "apk",
    "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "tiff", "tif", "ico", "avif", "heic",
    "mp4", "mp3", "wav", "ogg", "m4a", "flac", "webm", "mov", "avi", "wmv", "mkv",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "woff", "woff2", "ttf", "eot", "otf",
]
SOURCE_EXTENSIONS = [
    "py", "js", "ts", "jsx", "tsx", "java", "go", "rb", "php", "c", "cpp", "h", "hpp",
    "cs", "swift", "kt", "rs", "sh", "ps1", "sql", "yml", "yaml", "lock", "toml", "ini", "cfg",
]
PAGE_ASSET_EXTENSIONS = ["ico", "css", "js", "xml", "json"]
GIT_HOST = r"^(?:github\.com|gitlab\.com|git\.[^.]+\.(?:com|edu|org|io)|(?:[^.]+\.)?github\.io)$"
GIT_TEXT_FILE = r"/blob/[^/]+/.+\.(md|markdown|txt)$"
PORTAL_MARK, PORTAL_PREFIX = "teamdynamix.", r"/TDClient/\d+/[^/]+/"
_SHARED_EXCLUDES = [
    r"/Search[/?$]", r"/Login[/?$]", r"/Login\.aspx", r"/Tags[/?$]", r"/Print[/?$]", r"/PrintArticle\?ID=", r"\?print=", r"/Archive[/?$]", r"/FileOpen[/?$]", r"/FileDownload[/?$]",
    r"/pulse$", r"/tags$", r"/tagged$", r"/TagID=", r"/TagID/[0-9]+", r"&tab=",
    r"/issues?[/?]", r"/projects?[/?]", r"/pulls?[/?]", r"/pushes?[/?]", r"/forks?[/?]", r"/network[/?]", r"/commits?[/?]", r"/discussions?[/?]", r"/categories[/?]",
    r"/announcements?[/?]", r"/settings[/?]", r"/contribs?[/?]", r"/contributions?[/?]", r"/checks?[/?]", r"/comments?[/?]", r"/author[/?]", r"/profile[/?]",
    r"/watchers[/?]", r"/stargazers[/?]", r"/stars[/?]", r"/graphs[/?]", r"/actions[/?]", r"/security[/?]", r"/compare[/?]", r"/blame/", r"/raw/", r"/find/",
    r"/deployments[/?]", r"/environments[/?]", r"/packages[/?]", r"/sponsors[/?]", r"/people[/?]", r"/followers[/?]", r"/following[/?]",
    r"/_edit$", r"/_history$", r"/_new$", r"/_access$",
]
CRAWL_EXCLUDES = _SHARED_EXCLUDES + [rf"\.{e}$" for e in BINARY_EXTENSIONS + SOURCE_EXTENSIONS]
INDEX_EXCLUDES = ["/CategoryID=", "/CategoryID/[0-9]+", "/Category/", "/tree/", *CRAWL_EXCLUDES]
ASSET = rf"\.({'|'.join(BINARY_EXTENSIONS + SOURCE_EXTENSIONS + PAGE_ASSET_EXTENSIONS)})(\?|$)"

_SCHEME, _NETLOC, _PATH = r"^([^:/?#]+)://", r"^[^:/?#]+://([^/?#]*)", r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"


def compiled(patterns: list[str]) -> str | None:
    """One case-insensitive alternation of patterns (plain substrings are patterns too); None for none. `.` and `$` mind only line feeds."""
    for p in patterns:
        re.compile(p)
    return "(?di)" + "|".join(f"(?:{p})" for p in patterns) if patterns else None


def matches(url: Column, patterns: list[str]) -> Column:
    one = compiled(patterns)
    return F.lit(False) if one is None else url.rlike(one)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def host(url: Column) -> Column:
    return F.lower(netloc(url))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def origin(url: Column) -> Column:
    """scheme://netloc, user-info and port included."""
    return F.concat(F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lit("://"), netloc(url))


def auto_prefix(seed: Column) -> Column:
    """Default scope of a seed: its origin, with a portal's client prefix if it has one."""
    return F.concat(origin(seed), F.regexp_extract(seed, f"({PORTAL_PREFIX})", 1))


def normalise(url: Column) -> Column:
    """Without fragment, blanks at the ends and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), r"(?U)^\s+|\s+$", ""), "/+$", "")


def is_git_host(url: Column) -> Column:
    return host(url).rlike("(?di)" + GIT_HOST)


def is_portal(url: Column) -> Column:
    return F.lower(url).contains(PORTAL_MARK)


def is_git_text(url: Column) -> Column:
    """A Markdown or plain-text file of a code host."""
    return is_git_host(url) & path(url).rlike("(?di)" + GIT_TEXT_FILE)


def git_raw_url(url: Column) -> Column:
    """Where such a file's text is served; query and fragment go."""
    return F.concat(F.lit("https://raw.githubusercontent.com"), F.regexp_replace(path(url), "^/([^/]+)/([^/]+)/blob/", "/$1/$2/"))


def is_asset(url: Column) -> Column:
    return url.rlike("(?di)" + ASSET)


def in_scope(url: Column, prefix: Column | str, seed_origin: Column | str, includes: list[str] = (), excludes: list[str] = ()) -> Column:
    """Another origin needs an include; assets are out; includes replace the prefix rule; excludes win."""
    prefix, seed_origin = (F.lit(x) if isinstance(x, str) else x for x in (prefix, seed_origin))
    wanted = matches(url, list(includes))
    near = wanted if includes else F.startswith(url, prefix)
    return (F.startswith(url, seed_origin) | wanted) & ~is_asset(url) & near & ~matches(url, list(excludes))


def kind(url: Column) -> Column:
    return F.when(is_git_host(url), "code").when(is_portal(url), "kb").otherwise("page")


def blob_title(url: Column) -> Column:
    """A title from a file's name."""
    from .text import strip, title_case

    name = F.element_at(F.split(path(url), "/"), -1)
    stem = F.regexp_replace(name, r"(?di)\.(md|markdown|txt)$", "")
    title = title_case(strip(F.regexp_replace(stem, "[-_]+", " ")))
    return F.when(title == "", "Untitled").otherwise(title)


def page_title(title: Column, url: Column) -> Column:
    """A portal's kind-of-page prefixes go, in this order."""
    bare = F.regexp_replace(F.regexp_replace(title, "^Article - ", ""), "^Question Detail - ", "")
    return F.when(is_portal(url), bare).otherwise(title)


def cache_path(url: Column, folder: str = ".kb_cache/pages") -> Column:
    return F.concat(F.lit(folder + "/"), F.sha1(url.cast("binary")), F.lit(".html"))


def stable_id(url: Column, heading_path: Column) -> Column:
    from .text import sha1_id

    return sha1_id(normalise(url), heading_path)
