"""A small HTML tree for content extraction, on the standard library's tokenizer.

End tags close up to the nearest open tag of that name and are ignored without one; nothing is closed by implication.
Strings in script, style, template, rt and rp are no text, nor are comments and declarations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser

# Elements without content, and elements whose strings are no text.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
SILENT = frozenset("script style template rt rp".split())


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attrs, self.parent = name, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))

    def find(self, *names: str) -> Node | None:
        return next((x for x in self.walk() if x.name in names), None)

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in SILENT:
                stack.extend(reversed(x.children))

    def text(self, between: str = " ") -> str:
        """All strings, stripped, without empty ones."""
        return between.join(t for s in self.strings() if (t := s.strip()))

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [x for x in self.parent.children if x is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        held = self.open[-1].children
        if held and isinstance(held[-1], str):
            held[-1] += data
        else:
            held.append(data)

    def handle_comment(self, data: str) -> None:
        # A comment parts the strings around it.
        self.open[-1].children.append(Node("!", None, self.open[-1]))

    def unknown_decl(self, data: str) -> None:
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def select(node: Node, selector: str) -> list[Node]:
    """Descendants matching `tag`, `.class`, `#id` or `[attr='value']`, in document order."""
    if m := re.fullmatch(r"\[([\w-]+)=['\"]?([^'\"\]]*)['\"]?\]", selector):
        return [x for x in node.walk() if x.attrs.get(m[1]) == m[2]]
    if selector[0] == ".":
        return [x for x in node.walk() if selector[1:] in x.attrs.get("class", "").split()]
    if selector[0] == "#":
        return [x for x in node.walk() if x.attrs.get("id") == selector[1:]]
    return [x for x in node.walk() if x.name == selector and selector != "!"]


def content(root: Node, selectors: list[str], strip: list[str], need_text: bool) -> Node | None:
    """The first selected node, without its noise; with need_text one that has any text left."""
    for selector in selectors:
        found = select(root, selector)
        if not found:
            continue
        for noise in strip:
            for x in select(found[0], noise):
                x.drop()
        if not need_text or found[0].text():
            return found[0]
    return None


def sections(node: Node) -> list[tuple[str | None, str]]:
    """(heading, text) of each h2/h3 section, the preamble first with heading None; the whole node if it has no headings."""
    heads = [x for x in node.walk() if x.name in ("h2", "h3")]
    if not heads:
        return [(None, node.text("\n"))]

    def until_heading(items: list[Node | str]) -> str:
        parts = []
        for x in items:
            if isinstance(x, Node) and x.name in ("h2", "h3"):
                break
            parts.append(x.strip() if isinstance(x, str) else x.text())
        return " ".join(parts)

    out: list[tuple[str | None, str]] = [(None, until_heading(node.children))]
    for h in heads:
        siblings = h.parent.children
        at = next(i for i, x in enumerate(siblings) if x is h)
        out.append((h.text(), until_heading(siblings[at + 1 :])))
    return out


def markdown_html(text: str) -> str:
    """HTML of the Markdown that documentation uses: headings, paragraphs, fenced and indented code, lists, tables, quotes, rules, links, images, emphasis, inline code; HTML passes."""
    out: list[str] = []
    lines = text.expandtabs(4).split("\n")
    i = 0

    def inline(s: str) -> str:
        kept: list[str] = []

        def keep(html: str) -> str:
            kept.append(html)
            return f"\x02{len(kept) - 1}\x03"

        s = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(f"<code>{escape(m[2].strip(), quote=False)}</code>"), s)
        s = re.sub(r"\\([\\`*_{}\[\]()#+\-.!|>])", lambda m: keep(escape(m[1], quote=False)), s)
        s = re.sub(r"<((?:https?|ftp):[^ >]+)>", lambda m: keep(f'<a href="{escape(m[1])}">{escape(m[1], quote=False)}</a>'), s)
        s = re.sub(r"</?[A-Za-z][^<>]*>|<!--.*?-->", lambda m: keep(m[0]), s, flags=re.S)
        s = re.sub(r"&(?!#?\w+;)", "&amp;", s).replace("<", "&lt;").replace(">", "&gt;")
        s = re.sub(r"!\[([^\]]*)\]\(\s*<?([^)\s>]*)>?(?:\s+[^)]*)?\)", lambda m: keep(f'<img alt="{escape(unescape(m[1]))}" src="{escape(unescape(m[2]))}">'), s)
        s = re.sub(r"\[([^\]]+)\]\(\s*<?([^)\s>]*)>?(?:\s+[^)]*)?\)", lambda m: keep(f'<a href="{escape(unescape(m[2]))}">') + m[1] + keep("</a>"), s)
        s = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"<strong>\2</strong>", s, flags=re.S)
        s = re.sub(r"\*(?=\S)(.+?)(?<=\S)\*|(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", lambda m: f"<em>{m[1] or m[2]}</em>", s, flags=re.S)
        s = re.sub(r" {2,}\n", "<br>\n", s)
        while "\x02" in s:
            s = re.sub("\x02(\\d+)\x03", lambda m: kept[int(m[1])], s)
        return s

    def cells(row: str) -> list[str]:
        row = row.strip().removeprefix("|")
        row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
        return [c.strip() for c in re.split(r"(?<!\\)\|", row)]

    def starts_block(k: int) -> bool:
        s = lines[k]
        return not s.strip() or bool(re.match(r"#{1,6}\s|#{1,6}$|(```|~~~)|\s{0,3}>|\s*([-*_]\s*){3,}$", s))

    while i < len(lines):
        s = lines[i]
        if not s.strip():
            i += 1
        elif m := re.match(r"(`{3,}|~{3,})\s*[\w+#.{}:-]*\s*$", s):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].rstrip() == m[1]), None)
            if end is None:
                out.append(f"<p>{inline(s)}</p>")
                i += 1
                continue
            out.append("<pre><code>" + escape("\n".join(lines[i + 1 : end]) + "\n", quote=False) + "</code></pre>")
            i = end + 1
        elif m := re.match(r"(#{1,6})\s*(.*?)\s*#*$", s):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif i + 1 < len(lines) and re.fullmatch(r"(=+|-+)\s*", lines[i + 1]) and not re.match(r"\s*[-*+]\s", s):
            level = 1 if lines[i + 1][0] == "=" else 2
            out.append(f"<h{level}>{inline(s.strip())}</h{level}>")
            i += 2
        elif re.fullmatch(r"\s{0,3}([-*_]\s*){3,}", s):
            out.append("<hr>")
            i += 1
        elif "|" in s and i + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]) and "|" in lines[i + 1]:
            head, k = cells(s), i + 2
            out.append("<table>\n<thead>\n<tr>\n" + "\n".join(f"<th>{inline(c)}</th>" for c in head) + "\n</tr>\n</thead>\n<tbody>")
            while k < len(lines) and "|" in lines[k] and lines[k].strip():
                row = (cells(lines[k]) + [""] * len(head))[: len(head)]
                out.append("<tr>\n" + "\n".join(f"<td>{inline(c)}</td>" for c in row) + "\n</tr>")
                k += 1
            out.append("</tbody>\n</table>")
            i = k
        elif s.lstrip().startswith(">"):
            k = i
            while k < len(lines) and lines[k].strip():
                k += 1
            inner = "\n".join(re.sub(r"^\s{0,3}> ?", "", x) for x in lines[i:k])
            out.append(f"<blockquote>\n{markdown_html(inner)}\n</blockquote>")
            i = k
        elif m := re.match(r"\s{0,3}([-*+]|\d+\.)\s+", s):
            kind, items, k = ("ol" if m[1][0].isdigit() else "ul"), [], i
            while k < len(lines):
                if n := re.match(r"\s{0,3}([-*+]|\d+\.)\s+(.*)", lines[k]):
                    items.append([n[2]])
                elif lines[k].strip() and (lines[k].startswith(" ") or not starts_block(k)):
                    items[-1].append(lines[k].strip())
                elif not lines[k].strip() and k + 1 < len(lines) and re.match(r"\s{0,3}([-*+]|\d+\.)\s+|\s{2,}\S", lines[k + 1]):
                    pass
                else:
                    break
                k += 1
            out.append(f"<{kind}>\n" + "\n".join(f"<li>{inline(chr(10).join(x))}</li>" for x in items) + f"\n</{kind}>")
            i = k
        elif s.startswith("    "):
            k = i
            while k < len(lines) and (lines[k].startswith("    ") or not lines[k].strip()):
                k += 1
            out.append("<pre><code>" + escape("\n".join(x[4:] for x in lines[i:k]).rstrip() + "\n", quote=False) + "</code></pre>")
            i = k
        elif re.match(r"<(!--|/?(address|article|aside|blockquote|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|noscript|ol|p|pre|script|section|style|table|ul)\b)", s, re.I):
            k = i
            stop = "-->" if s.startswith("<!--") else None
            while k < len(lines) and (stop not in lines[k] if stop else lines[k].strip()):
                k += 1
            out.append("\n".join(lines[i : k + bool(stop)]))
            i = k + 1
        else:
            k = i + 1
            while k < len(lines) and not starts_block(k) and not (k + 1 < len(lines) and re.fullmatch(r"=+\s*", lines[k + 1])):
                k += 1
            out.append(f"<p>{inline(chr(10).join(x.strip() if n else x.lstrip() for n, x in enumerate(lines[i:k])))}</p>")
            i = k
    return "\n".join(out)


def plain_html(text: str) -> str:
    return f"<pre>{escape(text)}</pre>"
