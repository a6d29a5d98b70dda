"""Blocks, tables and web pages as Markdown, in column functions and ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import rich_text
from notemill.operators.ordering import block_spacing, number_list


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^", "> ")


def callout(kind: str, title: Column, body: Column) -> Column:
    head = F.concat(F.lit(f"> [!{kind}] "), F.coalesce(title, F.lit("")))
    return F.when(F.coalesce(body, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n"), quoted(body)))


def pipe_table(rows: DataFrame, table: str, ordinal: str, cells: str) -> DataFrame:
    """Rows of cells as one pipe table each, the first row its head; short rows are padded to the widest."""
    widest = F.max(F.size(cells)).over(Window.partitionBy(table))
    clean = F.transform(cells, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    padded = F.concat(clean, F.array_repeat(F.lit(""), (F.col("_w") - F.size(cells)).cast("int")))
    line = lambda v: F.concat(F.lit("| "), F.array_join(v, " | "), F.lit(" |"))
    lined = rows.withColumn("_w", widest).select(table, F.col(ordinal).alias("_o"), line(padded).alias("_l"), "_w")
    out = lined.groupBy(table).agg(F.array_sort(F.collect_list(F.struct("_o", "_l"))).alias("_r"), F.max("_w").alias("_w"))
    lines = F.transform("_r", lambda x: x["_l"])
    rule = line(F.array_repeat(F.lit("---"), F.col("_w").cast("int")))
    return out.select(table, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n").alias("markdown"))


def block_markdown(kind: Column, text: Column, depth: Column, number: Column, checked: Column, language: Column, url: Column) -> Column:
    """One block as Markdown; kinds without a form of their own are their text, unknown ones nothing."""
    t = F.coalesce(text, F.lit(""))
    pad = F.repeat(F.lit("    "), F.coalesce(depth, F.lit(0)))
    linked = F.concat(F.lit("["), F.when(t == "", url).otherwise(t), F.lit("]("), url, F.lit(")"))
    return (
        F.when(kind == "paragraph", t)
        .when(kind.startswith("heading_"), F.concat(F.repeat(F.lit("#"), F.substring(kind, 9, 1).try_cast("int")), F.lit(" "), t))
        .when(kind == "bulleted_list_item", F.concat(pad, F.lit("- "), t))
        .when(kind == "numbered_list_item", F.concat(pad, F.coalesce(number, F.lit(1)).cast("string"), F.lit(". "), t))
        .when(kind == "to_do", F.concat(pad, F.when(checked, "- [x] ").otherwise("- [ ] "), t))
        .when(kind == "quote", quoted(t))
        .when(kind == "callout", callout("info", F.lit(""), t))
        .when(kind == "toggle", callout("note", t, F.lit("")))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), t, F.lit("\n```")))
        .when(kind == "equation", F.concat(F.lit("$$\n"), t, F.lit("\n$$")))
        .when(kind == "divider", "---")
        .when(kind.isin("image", "video", "audio", "pdf", "file"), F.concat(F.lit("!"), linked))
        .when(kind.isin("bookmark", "embed", "link_preview"), linked)
        .otherwise("")
    )


def page_markdown(blocks: DataFrame, page: str = "page_id", ordinal: str = "ordinal") -> DataFrame:
    """Blocks (``type, text, depth, checked, language, url`` in order) as one text per page."""
    items = blocks.withColumn("_item", F.col("type") == "numbered_list_item")
    numbered = number_list(items, page, ordinal, "depth", "_item")
    spaced = block_spacing(numbered, page, ordinal, "type")
    made = spaced.withColumn("_md", F.concat(block_markdown(F.col("type"), F.col("text"), F.col("depth"), F.col("number"), F.col("checked"), F.col("language"), F.col("url")), F.col("after")))
    return made.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), "_md"))), lambda x: x["_md"]), "").alias("markdown"))


def nested_marks(runs: DataFrame, paragraph: str, ordinal: str, text: str, marks: dict[str, str]) -> DataFrame:
    """``paragraph, markdown``: styled runs in order as text whose marks are well nested, and no more than needed.

    ``marks``: columns that tell whether a run has a style, outermost first, with the mark to write. Where
    styles change, those from the first changed one inward are closed, and those that go on or
    begin are opened. White space stands outside of marks that begin or end beside it; a run of white space alone keeps the styles before it.
    """
    order = Window.partitionBy(paragraph).orderBy(ordinal)
    own = F.coalesce(text, F.lit(""))
    blank = F.trim(F.regexp_replace(own, r"\s", " ")) == ""
    styles = F.array(*[F.coalesce(F.col(c), F.lit(False)) for c in marks])
    rows = runs.select(paragraph, ordinal, own.alias("_text"), F.when(~blank, styles).alias("_styles"))
    none = F.array(*[F.lit(False)] * len(marks))
    # The styles of the last run that is not blank, up to each run and before it.
    held = F.coalesce(F.last("_styles", ignorenulls=True).over(order), none)
    rows = rows.withColumn("_now", held)
    rows = rows.withColumn("_was", F.coalesce(F.lag("_now").over(order), none)).withColumn("_after", F.lead("_now").over(order).isNull())
    signs = list(marks.values())
    changed = F.array_position(F.transform(F.arrays_zip("_was", "_now"), lambda x: x["_was"] != x["_now"]), True)
    inward = lambda held, k: (changed > 0) & (changed <= k + 1) & F.get(held, F.lit(k))
    close = F.concat(*[F.when(inward(F.col("_was"), k), signs[k]).otherwise("") for k in reversed(range(len(signs)))])
    opened = F.concat(*[F.when(inward(F.col("_now"), k), signs[k]).otherwise("") for k in range(len(signs))])
    # White space at the end waits for the marks that close there; that of a blank run too.
    lead = F.when(F.col("_styles").isNull(), "").otherwise(F.regexp_extract("_text", r"^(\s*)", 1))
    tail = F.when(F.col("_styles").isNull(), F.col("_text")).otherwise(F.regexp_extract("_text", r"(\s*)$", 1))
    core = F.regexp_replace("_text", r"^\s+|\s+$", "")
    rows = rows.withColumns({"_tail": tail, "_lead": lead, "_core": core})
    before = F.coalesce(F.lag("_tail").over(order), F.lit(""))
    end = F.concat(*[F.when(F.get("_now", F.lit(k)), signs[k]).otherwise("") for k in reversed(range(len(signs)))])
    piece = F.concat(close, before, F.col("_lead"), opened, F.col("_core"), F.when(F.col("_after"), F.concat(end, F.col("_tail"))).otherwise(""))
    made = rows.select(paragraph, F.col(ordinal).alias("_o"), piece.alias("_piece"))
    return made.groupBy(paragraph).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_piece"))), lambda x: x["_piece"]), "").alias("markdown"))


def nearest_colour(rgb: Column, inks: dict[str, tuple[int, int, int]]) -> Column:
    """The name of the ink nearest to a ``RRGGBB`` colour by squared distance; ties to the first."""
    part = lambda i: F.conv(F.substring(rgb, 1 + 2 * i, 2), 16, 10).cast("int")
    far = lambda c: sum(((part(i) - c[i]) * (part(i) - c[i]) for i in range(3)), F.lit(0))
    return F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, c) in enumerate(inks.items())]))["n"]


# --- web pages -----------------------------------------------------------------

# Named character references that occur in exports.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def stripped(html: Column) -> Column:
    """Text of a fragment: tags gone, references resolved, white space collapsed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", "")), r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.nullif(stripped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos, level, anchor, text`` of every heading; ``anchor`` is null without an id."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))).alias("pos", "h"))
    anchor = F.nullif(F.regexp_extract("h", r"""(?is)^<h[1-6][^>]*\bid\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    return found.select(key, "pos", F.substring("h", 3, 1).cast("int").alias("level"), anchor.alias("anchor"), stripped(F.col("h")).alias("text"))


def hyperlinks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos, href, text`` of every link, backslashes in addresses turned to slashes."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("pos", "a"))
    href = F.regexp_extract("a", r"""(?is)^<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']""", 1)
    return found.select(key, "pos", unescaped(F.replace(href, F.lit("\\"), F.lit("/"))).alias("href"), stripped(F.col("a")).alias("text")).where("href <> ''")


def media(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, src``: distinct images, sounds and films of each page, without ``data:`` addresses."""
    pattern = r"""(?is)<(?:img|audio|video|source)\b[^>]*\bsrc\s*=\s*["']([^"']*)["']"""
    found = pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))).alias("src"))
    return found.where((F.col("src") != "") & ~F.col("src").rlike("(?i)^data:"))


#: Rewrites of a page's body, in order; spelled so that Java and RE2 agree.
HTML_STEPS = [
    *[(rf"(?is)<{tag}\b.*?</{tag}>", "") for tag in ("script", "style", "head", "nav", "svg")],
    (r"(?is)<!--.*?-->|<!doctype[^>]*>", ""),
    (r"(?is)<pre[^>]*>\s*(?:<code[^>]*>)?(.*?)(?:</code>)?\s*</pre>", "\n\n```\n\\1\n```\n\n"),
    (r"(?is)<code[^>]*>(.*?)</code>", r"`\1`"),
    *[(rf"(?is)<h{n}[^>]*>\s*(.*?)\s*</h{n}>", "\n\n" + "#" * n + " \\1\n\n") for n in range(1, 7)],
    (r"(?is)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>", r"**\1**"),
    (r"(?is)<(?:em|i)\b[^>]*>(.*?)</(?:em|i)>", r"*\1*"),
    (r"(?is)<(?:del|s|strike)\b[^>]*>(.*?)</(?:del|s|strike)>", r"~~\1~~"),
    (r"(?is)<mark[^>]*>(.*?)</mark>", r"==\1=="),
    (r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["'][^>]*>""", r"![](\1)"),
    (r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""", r"[\2](\1)"),
    (r"(?is)<li[^>]*>\s*(.*?)\s*</li>", "\n- \\1"),
    (r"(?is)<blockquote[^>]*>\s*(.*?)\s*</blockquote>", "\n\n> \\1\n\n"),
    (r"(?i)<hr\s*/?>", "\n\n---\n\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|ul|ol|table|tr|section|article)>", "\n\n"), (r"(?i)</t[dh]>", " "),
    (r"(?s)<[^>]*>", ""), (r"[ \t]+\n", "\n"), (r"\n[ \t]+([^-\s])", "\n\\1"), (r"\n{3,}", "\n\n"),
]


def html_markdown(html: Column) -> Column:
    """A page's body as Markdown, by an ordered list of rewrites: headings, emphasis, code, links, images, lists, quotes, rules, paragraphs.

    Elements of one name nested in each other are beyond such rules; ``notemill.operators.pages`` follows them.
    """
    out = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), html)
    for pattern, new in HTML_STEPS:
        out = F.regexp_replace(out, pattern, new.replace("\\", "$"))
    return F.regexp_replace(unescaped(out), r"^\s+|\s+$", "")


# Sections of meeting notes, in order.
MEETING_SECTIONS = ("Summary", "Notes", "Transcript")


def meeting_notes(meetings: DataFrame, sections: DataFrame, meeting: str = "block_id") -> DataFrame:
    """Add ``markdown`` to meetings (``title, status`` and ``summary_id, notes_id, transcript_id``).

    ``sections``: ``section_id, markdown``, joined by id. Blank or missing sections are
    left out; notes that are not ready (a status other than ``notes_ready``) are their title alone.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    ready = F.coalesce(F.nullif("status", F.lit("")), F.lit("notes_ready")) == "notes_ready"
    rows = meetings.withColumn("_top", F.when(title != "", F.concat(F.lit("## "), title)))
    ids = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.col(f"{name.lower()}_id").cast("string").alias("id")) for k, name in enumerate(MEETING_SECTIONS)])
    asked = meetings.where(ready).select(F.col(meeting).alias("_m"), (title != "").alias("_titled"), F.inline(ids)).where("id IS NOT NULL")
    held = sections.where("trim(markdown) <> ''").select(F.col("section_id").cast("string").alias("id"), "markdown")
    heading = F.concat(F.when(F.col("_titled"), "### ").otherwise("## "), "name")
    parts = asked.join(held, "id").groupBy("_m").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(heading, F.lit("\n\n"), "markdown").alias("t")))).alias("_parts"))
    body = F.array_join(F.transform("_parts", lambda p: p["t"]), "\n\n")
    return rows.join(parts, F.col(meeting) == F.col("_m"), "left").withColumn("markdown", F.concat_ws("\n\n", "_top", body)).drop("_m", "_parts", "_top")


def sized_lines(lines: DataFrame, note: str = "note", ordinal: str = "ordinal", title: str = "title", todo: bool = True) -> DataFrame:
    """Add ``markdown``: lines of styled sections (``sections``: structs of ``path, text``) as list items, tasks, headings or text.

    Lines that are bold, large or huge all through are headings. List items below a
    heading (or the note's title, at level 1) that says to-do are tasks, done where all is struck
    out, up to the next heading of that level or above: for one of the levels the last
    heading of that level or above says to-do.
    """
    s = F.col("sections")
    every = lambda part: F.forall(s, lambda x: F.contains(x["path"], F.lit(part)))
    item = F.coalesce(F.contains(F.get(s, F.lit(0))["path"], F.lit("list-item")), F.lit(False))
    says = lambda t: t.rlike("(?i)to ?do")
    bold, huge, large, struck = every("bold"), every("size:huge"), every("size:large"), every("strikethrough")
    level = F.lit(6) - F.when(huge, 4).when(large, 2).otherwise(0) - F.when(bold, 1).otherwise(0)
    text = F.array_join(F.transform(s, lambda x: x["text"]), "")
    rows = lines.withColumn("_item", item).withColumn("_level", F.when(~item & (F.size(s) > 0) & (bold | huge | large), level)).withColumn("_says", says(text))
    before = Window.partitionBy(note).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    mode = F.lit(False)
    if todo:
        for k in range(1, 7):
            mode = mode | F.coalesce(F.last(F.when(F.col("_level") <= k, F.col("_says")), ignorenulls=True).over(before), says(F.col(title)), F.lit(False))
    rows = rows.withColumn("_todo", mode & F.col("_item"))
    done = F.col("_todo") & struck
    head = F.col("_level").isNotNull()
    run = lambda x: F.struct(
        x["text"].alias("text"), (F.contains(x["path"], F.lit("bold")) & ~(head & bold)).alias("bold"), F.contains(x["path"], F.lit("italic")).alias("italic"),
        (F.contains(x["path"], F.lit("strikethrough")) & ~done).alias("strikethrough"), F.contains(x["path"], F.lit("monospace")).alias("code"), F.lit(None).cast("string").alias("href"),
    )
    made = rich_text(F.transform(s, run))
    depth = F.size(F.regexp_extract_all(F.get(s, F.lit(0))["path"], F.lit("/list/"), F.lit(0)))
    bullet = F.concat(F.repeat(F.lit("    "), depth), F.lit("- "), F.when(done, "[x] ").when(F.col("_todo"), "[ ] ").otherwise(""))
    out = F.when(F.col("_item"), F.concat(bullet, made)).when(head, F.concat(F.repeat(F.lit("#"), F.col("_level")), F.lit(" "), F.trim(made))).otherwise(made)
    return rows.withColumn("markdown", out).drop("_item", "_level", "_says", "_todo")
