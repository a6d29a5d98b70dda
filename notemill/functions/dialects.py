"""Text dialects of note applications as Markdown: code kept apart, titles, image sizes, underlines, tags, mentions and marks of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.text import ILLEGAL_TAG

Change = Callable[[Column], Column]

#: A fenced block up to its closing fence or the end, or a code span within a line.
CODE = r"(?m)^ {0,3}(`{3,}|~{3,})[^\n]*(?:\n(?s:.*?)(?:^ {0,3}\1[`~]*[ \t]*\r?$|\z)|\z)|(?<!`)(`+)(?!`)[^\n]*?(?<!`)\2(?!`)"
IMAGE_SIZE = r"!\[[^\]]*\]\([^()\s]*\)<!--\s*\{[^}]*\}\s*-->"
UNDERLINE = r"(?<![~\\])~([^~\s\\](?:[^~\n]*[^~\s\\])?)~(?!~)"
_ILLEGAL = ILLEGAL_TAG[1:-1]
_EDGE, _BODY, _WORDS = (f"[^{_ILLEGAL}{more}]" for more in (r"\s\x00/-", r"\s\x00", r"\t-\r\x00"))
#: ``#several words#``; and a run of characters behind a mark.
SPACED_TAG = rf"(?<!\S)#({_EDGE}{_WORDS}*{_EDGE}|{_EDGE})#(?!{_BODY})"
TAG_RUN = r"[^\S\n]?(?<!\S)#[^\s#\x00]+"


def once(value: Column, use: Change) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def each(text: Column, pattern: str, change: Change) -> Column:
    """``change`` applied to every match of a pattern (which matches no empty text); time grows with the text alone."""

    def changed(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(change(b), F.lit("")))), "")

    return once(text, changed)


def around_code(text: Column, change: Change) -> Column:
    """``change`` applied to a text whose code blocks and code spans are hidden from it, each behind a number between two NULs.

    NULs of the text itself become U+FFFD. ``change`` must leave the numbers in place.
    """

    def shown(t: Column, code: Column) -> Column:
        between = F.split(t, CODE, -1)
        hidden = F.array_join(F.transform(between, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit("\x00"), (k - 1).cast("string"), F.lit("\x00"), p))), "")
        return F.array_join(F.transform(F.split(change(hidden), "\x00", -1), lambda p, k: F.when(k % 2 == 0, p).otherwise(F.get(code, p.try_cast("int")))), "")

    clean = F.replace(text, F.lit("\x00"), F.lit("�"))
    return once(clean, lambda t: once(F.regexp_extract_all(t, F.lit(CODE), F.lit(0)), lambda code: shown(t, code)))


def without_title(text: Column, title: Column) -> Column:
    """A text without its first line where that is a top heading that is empty or says the title."""

    def rest(t: Column, first: Column) -> Column:
        heading = F.trim(F.substring(first, 3, 2_147_483_647))
        same = t.startswith("# ") & ((heading == F.trim(title)) | (heading == ""))
        return F.when(same, F.substr(t, F.length(first) + 2)).otherwise(t)

    return once(text, lambda t: once(F.substring_index(t, "\n", 1), lambda first: rest(t, first)))


def tables_apart(text: Column) -> Column:
    """An empty line before every table that follows a line of text."""
    return F.regexp_replace(text, r"(?m)(^[^\S\n]*+\S[^\n]*+\n)(?=[^\n|]*+\|[^\n]*+\n(?=[^\n-]*+-)(?=[^\n|]*+\|)[ \t\r|:-]*+$)", "$1\n")


def image_sizes(text: Column) -> Column:
    """``![alt](file)<!-- {"width": w, "height": h} -->`` as ``![alt|wxh](file)``; comments without a width above zero stay."""

    def sized(image: Column) -> Column:
        given = F.regexp_extract(image, r"<!--\s*(\{[^}]*\})\s*-->$", 1)
        size = lambda name: F.get_json_object(given, f"$.{name}").try_cast("double")
        plain = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
        width, height = size("width"), size("height")
        says = F.concat(plain(width), F.when(height > 0, F.concat(F.lit("x"), plain(height))).otherwise(""))
        alt = F.regexp_extract(image, r"^!\[([^\]]*)\]", 1)
        target = F.regexp_extract(image, r"^!\[[^\]]*\]\(([^()\s]*)\)", 1)
        return F.when(width > 0, F.concat(F.lit("!["), F.when(alt == "", says).otherwise(F.concat(alt, F.lit("|"), says)), F.lit("]("), target, F.lit(")"))).otherwise(image)

    return each(text, IMAGE_SIZE, sized)


def underlines(text: Column) -> Column:
    """``~underlined~`` as HTML; double tildes stay."""
    return F.regexp_replace(text, UNDERLINE, "<u>$1</u>")


def _is_tag(body: Column) -> Column:
    """Neither nothing, nor digits, nor a colour with a digit in it."""
    colour = body.rlike(r"(?i)^(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$") & body.rlike(r"\d")
    return (body != "") & ~body.rlike(r"^\d+$") & ~colour


def _tag_parts(run: Column) -> tuple[Column, Column, Column]:
    """What stands before the mark, the tag's body, and what trails it."""
    body = F.regexp_extract(run, rf"#([^\s#\x00]*{_EDGE})", 1)
    before = F.substring_index(run, "#", 1)
    return before, body, F.substr(run, F.length(before) + F.length(body) + 2)


def joined_tags(text: Column) -> Column:
    """``#several words#`` as ``#several_words``, and characters that no tag may hold as ``_``."""

    def clean(run: Column) -> Column:
        before, body, tail = _tag_parts(run)
        made = F.regexp_replace(F.regexp_replace(body, ILLEGAL_TAG, "_"), "_+", "_")
        return F.when(_is_tag(body), F.concat(before, F.lit("#"), made, tail)).otherwise(run)

    spaced = each(text, SPACED_TAG, lambda t: F.regexp_replace(F.regexp_replace(t, "#$", ""), r"\s+", "_"))
    return each(spaced, TAG_RUN, clean)


def without_tags(text: Column) -> Column:
    """A text without its tags; lines of tags alone go, and white space at the end."""
    def gone(run: Column) -> Column:
        _, body, tail = _tag_parts(run)
        return F.when(_is_tag(body), F.concat(F.lit("\x01"), tail)).otherwise(run)

    marked = each(F.replace(text, F.lit("\x01"), F.lit("�")), TAG_RUN, gone)
    lines = F.filter(F.split(marked, "\n", -1), lambda s: ~s.rlike(r"^[\s\x01]*\x01[\s\x01]*$"))
    lines = F.transform(lines, lambda s: F.when(F.contains(s, F.lit("\x01")), F.regexp_replace(F.replace(s, F.lit("\x01")), r"[ \t]+$", "")).otherwise(s))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", "")


def app_markdown(text: Column, title: Column, keep_tags: bool = True) -> Column:
    """A note of a Markdown application in the target's form, code untouched.

    The title goes, tables stand apart, image sizes move into the link, single
    tildes underline, tags become single words or (``keep_tags`` false) go.
    Null is null; white space at the end goes with the tags only.
    """

    def change(t: Column) -> Column:
        t = joined_tags(underlines(image_sizes(tables_apart(t))))
        return t if keep_tags else without_tags(t)

    return around_code(without_title(text, F.coalesce(title, F.lit(""))), change)


def tags_match(tags: Column, every: tuple[str, ...] = (), some: tuple[str, ...] = (), none: tuple[str, ...] = ()) -> Column:
    """Whether a list of tags has all of ``every``, one of ``some`` (if given) and nothing of ``none``, whatever their case.

    A saved query of nested conditions is such columns under ``&``, ``|`` and ``~``.
    """
    known = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))
    has = lambda t: F.array_contains(known, t.lower())
    out = F.lit(True)
    for t in every:
        out = out & has(t)
    for t in none:
        out = out & ~has(t)
    if some:
        one = F.lit(False)
        for t in some:
            one = one | has(t)
        out = out & one
    return out


def mention(kind: Column, target: Column, plain: Column, start: Column, end: Column, href: Column, title: Column, name: Column, email: Column) -> Column:
    """A mention in rich text: placeholders ``[[DB:id]]`` and ``[[PAGE:id]]`` for later joins; dates, links, people as text.

    A null kind, or one that is not known, is its plain text.
    """
    text = F.coalesce(plain, F.lit(""))
    shown = F.coalesce(F.nullif(name, F.lit("")), text)
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    link = lambda label, to: F.concat(F.lit("["), label, F.lit("]("), to, F.lit(")"))
    url = F.coalesce(href, F.lit(""))
    return (
        F.when(kind.isNull(), text)
        .when(kind == "database", F.concat(F.lit("[[DB:"), target, F.lit("]]")))
        .when(kind == "page", F.concat(F.lit("[[PAGE:"), target, F.lit("]]")))
        .when(kind == "date", spaced(F.coalesce(F.concat_ws(" → ", start, F.when(start.isNotNull(), end)), F.lit(""))))
        .when(kind == "link_mention", link(F.coalesce(F.nullif(title, F.lit("")), F.nullif(text, F.lit("")), url), url))
        .when(kind == "user", F.when(F.coalesce(email, F.lit("")) != "", spaced(link(shown, F.concat(F.lit("mailto:"), email)))).otherwise(spaced(shown)))
        .otherwise(spaced(text))
    )


# Numbers of note tags that are callouts.
CALLOUT_SHAPES = {13: "important", 15: "question", 17: "danger", 21: "tip", 111: "question"}


def line_mark(style: Column, ordered: Column, level: Column, tags: Column) -> Column:
    """What goes before a paragraph: a task's box, else a list mark, else a heading's; ``ordered`` is null outside lists.

    ``tags``: structs with ``checkable, completed, shape, label``; the first that can be checked makes a task.
    """
    task = F.get(F.filter(tags, lambda t: t["checkable"]), F.lit(0))
    pad = F.repeat(F.lit("\t"), F.coalesce(level, F.lit(0)))
    in_list = ordered.isNotNull()
    box = F.concat(F.when(in_list, pad).otherwise(""), F.when(task["completed"], "- [x] ").otherwise("- [ ] "))
    size = F.regexp_extract(F.lower(style), "^h([1-6])$", 1).try_cast("int")
    return F.when(task.isNotNull(), box).when(in_list, F.concat(pad, F.when(ordered, "1. ").otherwise("- "))).when(size.isNotNull(), F.concat(F.repeat(F.lit("#"), size), F.lit(" "))).otherwise("")


def line_callout(tags: Column) -> Column:
    """``type, title`` of the first tag that is a callout; null if there is none."""
    kinds = F.create_map(*[F.lit(x) for pair in CALLOUT_SHAPES.items() for x in pair])
    typed = F.transform(F.filter(tags, lambda t: ~t["checkable"] & t["shape"].isNotNull()), lambda t: F.struct(F.try_element_at(kinds, t["shape"]).alias("type"), t["label"].alias("title")))
    return F.get(F.filter(typed, lambda t: t["type"].isNotNull()), F.lit(0))
