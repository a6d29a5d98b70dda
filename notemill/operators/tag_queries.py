"""Saved queries of tags, nested by and, or and not, answered from posting lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = re.compile(r"\s*(?:\[\[(?P<page>[^\[\]]+)\]\]|#\[\[(?P<wide>[^\[\]]+)\]\]|#(?P<tag>[^\s{}\[\]()]+)|\{\s*(?P<open>and|or|not)\s*:|(?P<close>\}))", re.I)
_AROUND = re.compile(r"^\s*\{\{\s*(?:\[\[query\]\]|query)\s*:(.*)\}\}\s*$", re.I | re.S)


#: Tags that one word of bits tells of.
_WORD = 63


class QueryError(ValueError):
    """A saved query that is not well formed."""


def parse(text: str) -> tuple:
    """``("and" | "or" | "not", part, ...)`` with tags, in lower case, as ``("tag", name)``; ``not`` excludes each of its parts."""
    around = _AROUND.match(text)
    body = around[1] if around else text
    stack: list[list] = [[]]
    at, end = 0, len(body.rstrip())
    while at < end:
        m = _PIECE.match(body, at)
        if not m:
            raise QueryError(f"unexpected {body[at:].strip()[:10]!r}")
        at = m.end()
        if m["open"]:
            stack.append([m["open"].lower()])
        elif not m["close"]:
            stack[-1].append(("tag", (m["page"] or m["wide"] or m["tag"]).strip().lower()))
        elif len(stack) == 1 or len(stack[-1]) == 1:
            raise QueryError("a group is empty or was not opened")
        else:
            stack[-2].append(tuple(stack.pop()))
    if len(stack) > 1 or len(stack[0]) != 1 or stack[0][0][0] == "tag":
        raise QueryError("a query is one whole group")
    return stack[0][0]


def tags_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tag" else set().union(*map(tags_of, query[1:]))


def holds(query: tuple, present: dict[str, Column]) -> Column:
    """Whether the query holds; ``present`` tells of each tag whether it is there."""
    if query[0] == "tag":
        return present[query[1]]
    out = None
    for part in (holds(q, present) for q in query[1:]):
        part = ~part if query[0] == "not" else part
        out = part if out is None else out | part if query[0] == "or" else out & part
    return out


def _bare(query: tuple) -> bool:
    """Whether the query holds where no tag is present."""
    if query[0] == "tag":
        return False
    parts = [_bare(q) for q in query[1:]]
    return any(parts) if query[0] == "or" else not any(parts) if query[0] == "not" else all(parts)


def matching(postings: DataFrame, queries: dict[str, str], block: str = "block_id", tag: str = "tag") -> DataFrame:
    """``query, block_id``: the blocks that each saved query finds.

    ``postings`` has a row per block and tag, ``queries`` are texts by name. Each tag that a query names is a
    bit; the bits of a block are gathered once, whatever the number of queries, and each query is then one
    expression over them. Postings of other tags only count if some query holds where none of its tags is.
    Tags count whatever their case; a block without a row is not known.
    """
    known = {name: parse(text) for name, text in queries.items()}
    if not known:
        return postings.select(F.lit("").alias("query"), block).limit(0)
    tags = sorted(set().union(*map(tags_of, known.values())))
    spark = postings.sparkSession
    # 63 bits a word: sums of bits in words need no room that grows, as lists of tags would.
    wanted = spark.createDataFrame([(t, k // _WORD, 1 << k % _WORD) for k, t in enumerate(tags)], "_tag string, _word int, _bit long")
    every = any(map(_bare, known.values()))
    found = postings.select(block, F.lower(tag).alias("_tag")).join(F.broadcast(wanted), "_tag", "left" if every else "inner")
    words = [f"_w{k}" for k in range(-(-len(tags) // _WORD))]
    bits = [F.bit_or(F.when(F.col("_word") == k, F.col("_bit")).otherwise(F.lit(0))).alias(w) for k, w in enumerate(words)]
    have = found.groupBy(block).agg(*bits)
    present = {t: F.col(words[k // _WORD]).bitwiseAND(F.lit(1 << k % _WORD)) != 0 for k, t in enumerate(tags)}
    held = F.array_compact(F.array(*[F.when(holds(q, present), F.lit(name)) for name, q in known.items()]))
    return have.select(F.explode(held).alias("query"), block)
