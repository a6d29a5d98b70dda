"""Records as notes: front matter, body, anchors, fragments and what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import fill_template, title_of, yaml_scalar


def as_text(value: Column, kind: str) -> Column:
    """A property as text: lists joined by a comma, null as nothing."""
    return F.array_join(value, ", ") if kind == "multitext" else F.coalesce(value.cast("string"), F.lit(""))


def property_lines(values: dict[str, tuple[Column, str]]) -> Column:
    """YAML lines of properties (name to value and kind); null and empty ones are left out, lists stand item by item."""
    lines = []
    for name, (value, kind) in values.items():
        if kind == "multitext":
            items = F.transform(value, lambda x: F.concat(F.lit("  - "), yaml_scalar(x)))
            lines.append(F.when(F.size(value) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(items, "\n"))))
        else:
            text = value.cast("string")
            lines.append(F.when(text != "", F.concat(F.lit(f"{name}: "), yaml_scalar(text))))
    return F.concat_ws("\n", *lines)


def render(records: DataFrame, title: str, values: dict[str, str], body: str = "", id_: str | None = None, id_name: str = "id") -> DataFrame:
    """Add ``title`` and ``content`` (front matter, then the body template) to typed records; ``values`` is column to kind."""
    props = {n: (F.col(n), k) for n, k in values.items()}
    if id_:
        props = {id_name: (F.col(id_), "text")} | props
    lines = property_lines(props)
    head = F.when(lines != "", F.concat(F.lit("---\n"), lines, F.lit("\n---\n"))).otherwise("")
    text = fill_template(body, {n: as_text(F.col(n), k) for n, k in values.items()}) if body else F.lit("")
    return records.withColumn("_title", title_of(F.col(title).cast("string"))).withColumn("content", F.concat(head, text)).withColumnRenamed("_title", "note_title")


def kept_and_skipped(rows: DataFrame, name: str, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that no reason leaves out, and a log ``outcome, name, reason`` of the others (the first reason that holds)."""
    why = None
    for reason, test in reasons.items():
        hit = F.coalesce(test, F.lit(False))
        why = F.when(hit, reason) if why is None else why.when(hit, reason)
    marked = rows.withColumn("_why", why if why is not None else F.lit(None).cast("string"))
    log = marked.where("_why IS NOT NULL").select(F.lit("skipped").alias("outcome"), F.col(name).cast("string").alias("name"), F.col("_why").alias("reason"))
    return marked.where("_why IS NULL").drop("_why"), log


def with_anchors(blocks: DataFrame, mentioned: DataFrame, block: str = "block_id", text: str = "text") -> DataFrame:
    """Blocks that are referred to get ``^id`` after their text; the others stay."""
    wanted = mentioned.select(F.col(block).alias("_m")).distinct()
    anchored = F.when(F.col("_m").isNotNull(), F.concat(text, F.lit(" ^"), F.col(block))).otherwise(F.col(text))
    return blocks.join(wanted, F.col(block) == F.col("_m"), "left").withColumn(text, anchored).drop("_m")


def resolve_fragments(links: DataFrame, headings: DataFrame, doc: str = "doc", fragment: str = "fragment") -> DataFrame:
    """Add ``heading``: the text of the heading that a link's fragment names in its target document."""
    named = headings.where("anchor IS NOT NULL").groupBy(F.col(doc), F.col("anchor").alias(fragment)).agg(F.min_by("text", "pos").alias("heading"))
    return links.join(named, [doc, fragment], "left")


def standard_links(text: Column, wiki: bool = True) -> Column:
    """Markdown links to notes as wiki links, or the other way."""
    if wiki:
        return F.regexp_replace(text, r"(?<!!)\[([^\]]+)\]\((?![a-z][a-z0-9+.-]*:)([^)\s]+?)\.md\)", "[[$2|$1]]")
    return F.regexp_replace(F.regexp_replace(text, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2]($1.md)"), r"\[\[([^\]|]+)\]\]", "[$1]($1.md)")


def tidy_markdown(text: Column, indent: str = "    ") -> Column:
    """One bullet character, one indent unit, no trailing white space, at most one empty line in a row."""
    for pattern, new in ((r"(?m)^(\s*)[*+](?=\s)", "$1-"), (r"(?m)^\t", indent), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return text


def log_report(log: DataFrame, most: int = 5) -> DataFrame:
    """Counts of each outcome and reason, with its first few names."""
    by = ["outcome", "reason"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("name"))
    few = log.select(*by, "name").distinct().withColumn("_n", place).where(F.col("_n") <= most)
    names = few.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    counts = log.groupBy(*by).agg(F.count("*").alias("n"))
    same = F.col("outcome").eqNullSafe(F.col("_outcome")) & F.col("reason").eqNullSafe(F.col("_reason"))
    return counts.join(names.withColumnsRenamed({"outcome": "_outcome", "reason": "_reason"}), same, "left").drop("_outcome", "_reason")


def image_size(content: Column) -> tuple[Column, Column]:
    """Width and height of PNG, GIF and BMP images from their heads; null for other files, which no size filter drops."""
    part = lambda a, n: F.hex(F.substring(content, a, n))
    big = lambda a: F.conv(part(a, 4), 16, 10).cast("int")
    little = lambda a, n: F.conv(F.concat(*[part(a + k, 1) for k in reversed(range(n))]), 16, 10).cast("int")
    png, gif, bmp = part(1, 4) == "89504E47", part(1, 4) == "47494638", part(1, 2) == "424D"
    width = F.when(png, big(17)).when(gif, little(7, 2)).when(bmp, little(19, 4))
    return width, F.when(png, big(21)).when(gif, little(9, 2)).when(bmp, little(23, 4))
