"""Whole pages as Markdown where elements stand in each other.

A page is small, so its tree is walked inside the task that holds it; Spark deals the pages out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- HTML ----------------------------------------------------------------------

# Element names of HTML by what they are here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "head", "nav", "svg", "template", "noscript"}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}
BLOCKS = {"html", "body", "article", "section", "main", "header", "footer", "aside", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "hr", "table", "figure", "details", "summary", "dl", "dt", "dd"}
#: An opening tag that ends an open element of these names, up to the element they lie in.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, BLOCKS - {"p"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


class _Tree(HTMLParser):
    """Nodes are ``(name, attributes, children)``; texts are strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = [("", {}, [])]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        over, within = ENDS.get(tag, ((), ()))
        names = [n[0] for n in self.open]
        at = next((k for k in range(len(names) - 1, 0, -1) if names[k] in over or names[k] in within), 0)
        if at and names[at] in over:
            while at > 1 and names[at - 1] in over:
                at -= 1
            del self.open[at:]
        node = (tag, dict(attrs), [])
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _raw(node) -> str:
    return node if isinstance(node, str) else "\n" if node[0] == "br" else "".join(map(_raw, node[2]))


def _classes(node) -> set[str]:
    return set((node[1].get("class") or "").split())


def _inline(node) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    name, attrs, inner = node
    if name in DROPPED:
        return ""
    if name == "br":
        return "\n"
    if name == "img":
        return f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})" if attrs.get("src") else ""
    if name == "input" or "checkbox" in _classes(node):
        return ("[x] " if "checked" in attrs or "checkbox-on" in _classes(node) else "[ ] ") if attrs.get("type", "checkbox") == "checkbox" else ""
    text = "".join(map(_inline, inner))
    if name == "code":
        return f"`{text.strip()}`" if text.strip() else ""
    if name in MARKS and text.strip():
        # White space stands outside the marks, and a mark inside the same mark is none.
        mark, bare = MARKS[name], text.strip()
        bare = bare.replace(mark, "") if len(mark) == 2 else bare
        return re.match(r"\s*", text)[0] + mark + bare + mark + re.search(r"\s*$", text)[0]
    if name == "a" and attrs.get("href") and text.strip():
        return f"[{text.strip()}]({attrs['href'].replace(chr(92), '/')})"
    return text


def _indented(text: str, by: str) -> str:
    return "\n".join(line and by + line if k else line for k, line in enumerate(text.split("\n")))


def _list(node) -> str:
    items, number = [], int(node[1].get("start") or 1) if re.fullmatch(r"-?\d+", node[1].get("start") or "1") else 1
    for child in node[2]:
        if isinstance(child, str) or child[0] in DROPPED:
            continue
        parts = list(_blocks(child[2])) if child[0] == "li" else [(_list(child), True)] if child[0] in ("ul", "ol") else list(_blocks([child]))
        text = ""
        for part, tight in parts:
            text += ("" if not text else "\n" if tight else "\n\n") + part
        mark = f"{number}. " if node[0] == "ol" else "- "
        items.append(mark + _indented(text, "    "))
        number += 1
    return "\n".join(items)


def _rows(node) -> Iterator[list[str]]:
    for child in node[2]:
        if isinstance(child, str):
            continue
        if child[0] == "tr":
            yield [re.sub(r"\s*\n\s*", "<br>", "\n".join(t for t, _ in _blocks(c[2]))).replace("|", "\\|") for c in child[2] if not isinstance(c, str) and c[0] in ("td", "th")]
        elif child[0] in ("thead", "tbody", "tfoot"):
            yield from _rows(child)


def _table(node) -> str:
    rows = [r for r in _rows(node) if r]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines else ""


def _quote(text: str) -> str:
    return "\n".join("> " + line if line else ">" for line in text.split("\n"))


def _join(parts: Iterator[tuple[str, bool]]) -> str:
    return "\n\n".join(text for text, _ in parts)


def _one(node) -> Iterator[tuple[str, bool]]:
    """A block element as blocks, each with whether it may follow an item's text without an empty line."""
    name, attrs, inner = node
    if name in DROPPED:
        return
    if re.fullmatch("h[1-6]", name):
        text = re.sub(r"\s+", " ", "".join(map(_inline, inner))).strip()
        made = "#" * int(name[1]) + " " + text if text else ""
    elif name in ("ul", "ol"):
        made = _list(node)
    elif name == "blockquote":
        made = _quote(_join(_blocks(inner))) if inner else ""
    elif name == "figure" and "callout" in _classes(node):
        made = "> [!important]\n" + _quote(_join(_blocks(inner)))
    elif name == "details":
        head = [c for c in inner if not isinstance(c, str) and c[0] == "summary"]
        body = _join(_blocks([c for c in inner if c not in head]))
        made = "> [!note] " + " ".join("".join(map(_inline, h[2])).strip() for h in head) + ("\n" + _quote(body) if body else "")
    elif name == "pre":
        language = next((c[9:] for x in inner if not isinstance(x, str) for c in _classes(x) if c.startswith("language-")), "")
        made = f"```{language}\n" + "".join(map(_raw, inner)).strip("\n") + "\n```"
    elif name == "hr":
        made = "---"
    elif name == "table":
        made = _table(node)
    else:
        yield from _blocks(inner)
        return
    if made:
        yield made, name in ("ul", "ol")


def _holds_block(node) -> bool:
    return not isinstance(node, str) and "checkbox" not in _classes(node) and (node[0] in BLOCKS or node[0] not in VOID and any(map(_holds_block, node[2])))


def _blocks(nodes: list) -> Iterator[tuple[str, bool]]:
    for block, run in groupby(nodes, _holds_block):
        if block:
            for node in run:
                yield from _one(node)
        else:
            text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(map(_inline, run)))).strip()
            if text:
                yield text, False


def page_to_markdown(html: str) -> str:
    """One page's body as Markdown; elements may stand in each other to any depth that a page has."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return _join(_blocks(tree.open[0][2]))


def page_tree_markdown(html: Column) -> Column:
    """Pages as Markdown with nested lists, quotes, tables, marks, callouts and toggles; null stays null."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else page_to_markdown(h))

    return run(html)
