import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemill.operators import documents, grouping, links, ordering, trees


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "A", "a 1", "a 2", "b", "a 1 1", "b 1"]), min_size=1, max_size=9), st.lists(st.sampled_from(["a", "a 1", "B"]), max_size=2, unique=True))
def test_names_are_unique_and_in_order(spark, names, taken):
    df = spark.createDataFrame([("f", n, i) for i, n in enumerate(names)], "folder string, name string, ordinal int")
    held = spark.createDataFrame([("f", n) for n in taken], "folder string, name string")
    got = [r.unique_name for r in ordering.unique_names(df, "folder", "name", "ordinal", held).orderBy("ordinal").collect()]
    used = [n.lower() for n in got] + [t.lower() for t in taken]
    assert len(set(used)) == len(used)
    seen = {t.lower() for t in taken}
    for given_name, made in zip(names, got):
        assert made == given_name or made.startswith(given_name + " ")
        assert (made == given_name) == (given_name.lower() not in seen)
        seen.add(given_name.lower())


def test_links(spark):
    records = spark.createDataFrame([("r1", ["a", "b", "c"]), ("r2", []), ("r3", None)], "record string, linked array<string>")
    edges = links.edges(records, "record", "linked")
    notes = spark.createDataFrame([("a", "T/A.md")], "target string, path string")
    titles = spark.createDataFrame([("b", "B/1")], "target string, title string")
    got = links.gathered(links.resolve_links(edges, notes, titles), "record")
    assert rows(got, "record", "link") == [("r1", ["[[T/A]]", "B-1", "Unknown record c"]), ("r2", []), ("r3", [])]
    assert rows(links.missing_targets(edges, notes), "target") == [("b",), ("c",)]
    found = spark.createDataFrame([("1", "workspace", None), ("2", "block_id", "x"), ("3", "page_id", "2"), ("4", "page_id", "1")], "id string, parent_type string, parent_id string")
    assert rows(links.discovered(found), "id") == [("1",), ("4",)]
    blocks = spark.createDataFrame([("b1", "p"), ("b2", "p")], "block_id string, page string")
    assert rows(links.defined_and_mentioned(blocks, spark.createDataFrame([("b1",), ("b1",), ("b9",)], "block_id string")), "block_id") == [("b1",)]


def test_items_of_one_parent_are_dealt_out(spark):
    """All top pages name one workspace, a database its rows: a join on the parent alone would give them to one task."""
    n, no_broadcast = 4_000, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    found = spark.range(n).selectExpr(
        "concat('i', id) AS id", "CASE WHEN id IN (3, 7, 13) THEN 'block_id' WHEN id % 2 = 0 THEN 'workspace' WHEN id % 4 = 1 THEN 'page_id' ELSE 'database_id' END AS parent_type",
        "CASE WHEN id IN (3, 7, 13) THEN 'b' WHEN id % 40 = 0 THEN NULL WHEN id % 2 = 0 THEN 'true' WHEN id % 100 = 1 THEN 'i13' WHEN id % 4 = 1 THEN 'i5' WHEN id % 500 < 300 THEN 'i3' ELSE concat('i', id - 4) END AS parent_id",
    )
    found = found.unionByName(found.where("id IN ('i3', 'i8')"))  # results can come twice
    rows_ = [tuple(r) for r in found.collect()]
    gone = {i for i, kind, _ in rows_ if kind == "block_id"}
    want = sorted(i for i, _, p in rows_ if i not in gone and p not in gone)
    before = {k: spark.conf.get(k) for k in no_broadcast}
    try:
        for k, v in no_broadcast.items():
            spark.conf.set(k, v)
        for most in (0, 100, n):
            assert sorted(r.id for r in links.discovered(found, most=most).collect()) == want
        spread = [r["count"] for r in links.discovered(found, most=100).groupBy(F.spark_partition_id()).count().collect()]
        assert len(spread) == 4 and max(spread) < 0.4 * len(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_paths_resolve_in_turn(spark):
    files = spark.createDataFrame([("d/a.md",), ("b.html",), ("X.md",), ("x.md",), ("d/sub/Pic.png",)], "path string")
    hrefs = spark.createDataFrame([("a", "d"), ("/b#top", "d"), ("X.md", ""), ("../d/sub/pic.png", "d"), ("none", "d"), ("a%2Emd", "d")], "href string, folder string")
    got = {r.href: r.path for r in links.resolve_paths(hrefs, files).collect()}
    assert got == {"a": "d/a.md", "/b#top": "b.html", "X.md": "X.md", "../d/sub/pic.png": "d/sub/Pic.png", "none": None, "a%2Emd": "d/a.md"}


def test_attachments_resources_tasks(spark):
    placed = spark.createDataFrame([("x/a.png", "out/a.png"), ("y/b.png", "out/b.png"), ("z/b.png", "out/b 1.png")], "name string, path string")
    wanted = spark.createDataFrame([("x/a.png",), ("q/a.png",), ("q/b.png",)], "name string")
    assert rows(links.attachment_paths(wanted, placed), "name", "path") == [("q/a.png", "out/a.png"), ("q/b.png", "q/b.png"), ("x/a.png", "out/a.png")]
    resources = spark.createDataFrame([("aGVs\nbG8=", "r")], "data string, id string")
    mentions = spark.createDataFrame([("5d41402abc4b2a76b9719d911017c592", "n"), ("0", "n")], "hash string, note string")
    assert rows(links.resources_by_hash(resources, mentions), "hash", "id") == [("0", None), ("5d41402abc4b2a76b9719d911017c592", "r")]
    tasks = spark.createDataFrame([("g", "B", "old", 1), ("g", "B", "new", 2), ("g", "A", "first", 3)], "group_id string, sort_weight string, line string, ordinal int")
    assert rows(links.task_groups(tasks), "text") == [("first\nnew",)]


def test_longest_first_replacement(spark):
    df = spark.createDataFrame([("ab abc", [("ab", "1"), ("abc", "2")])], "t string, p array<struct<from:string,to:string>>")
    assert df.select(links.replace_all(F.col("t"), F.col("p")).alias("x")).first().x == "1 2"


def test_what_is_put_in_is_not_searched(spark):
    pairs = [("longer-id", "PAGE:b"), ("b", "real"), ("b", "second"), ("", "empty"), ("lon", None)]
    df = spark.createDataFrame([(1, "see longer-id and b, lonb", pairs), (2, None, pairs), (3, "b", None), (4, "", []), (5, "x" * 50_000 + "k999", [(f"k{k}", f"<k{k + 1}>") for k in range(10_000)])], "i int, t string, p array<struct<from:string,to:string>>")
    got = {r.i: r.x for r in df.select("i", links.replace_all(F.col("t"), F.col("p")).alias("x")).collect()}
    assert got == {1: "see PAGE:b and real, real", 2: None, 3: "b", 4: "", 5: "x" * 50_000 + "<k1000>"}


def test_mentions_where_they_stand(spark):
    notes = spark.createDataFrame([(1, "see [[PAGE:longer-id]] and [[PAGE:b]]"), (2, "[[PAGE:b]][[PAGE:?]]"), (3, "none"), (4, None), (2, "[[PAGE:b]][[PAGE:?]]"), (2, "other [[PAGE:b]]")], "note int, text string")
    targets = spark.createDataFrame([("longer-id", "PAGE:b.md"), ("b", "real.md")], "target string, path string")
    got = sorted((r.note, r.text or "") for r in links.rewrite_mentions(notes, targets, "note", "text", r"\[\[PAGE:([^\]]+)\]\]").collect())
    assert got == [(1, "see [[PAGE:b]] and [[real]]"), (2, "[[real]]Untitled ?"), (2, "[[real]]Untitled ?"), (2, "other [[real]]"), (3, "none"), (4, "")]


def test_runs_and_numbers(spark):
    runs = spark.createDataFrame([("g", 1, "b", "x"), ("g", 2, "b", "y"), ("g", 3, None, "z"), ("g", 4, None, None), ("g", 5, "b", "w")], "g string, o int, s string, t string")
    assert rows(ordering.merge_runs(runs, "g", ["o"], ["s"], "t"), "run", "t", "n") == [(1, "xy", 2), (2, "z", 2), (3, "w", 1)]
    items = [(1, 0, True), (2, 1, True), (3, 1, True), (4, 0, True), (5, 1, True), (6, 0, False), (7, 0, True), (8, 1, False), (9, 0, True)]
    df = spark.createDataFrame([("g", *i) for i in items], "g string, o int, level int, item boolean")
    got = [r.number for r in ordering.number_list(df, "g", "o", "level", "item").orderBy("o").collect()]
    assert got == [1, 1, 2, 2, 1, None, 1, None, 2]
    pages = spark.createDataFrame([("s", 1, 0, "A"), ("s", 2, 1, "B"), ("s", 3, 2, "C"), ("s", 4, 1, "D"), ("s", 5, 0, "E"), ("s", 6, 2, "F")], "s string, o int, level int, title string")
    assert [r.path for r in ordering.page_paths(pages, "s", "o", "level", "title").orderBy("o").collect()] == ["A", "A/B", "A/B/C", "A/D", "E", "E/F"]


def test_sets(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int"), spark.createDataFrame([("y", 3), ("z", 4)], "name string, v int")
    assert rows(ordering.first_wins(a, b, key="name"), "name", "v") == [("x", 1), ("y", 2), ("z", 4)]
    assert rows(ordering.merged_views(a, b, value="v"), "name", "v") == [("x", 1), ("y", 3), ("z", 4)]
    paths = spark.createDataFrame([("a/b/c",), ("ab/c",), ("a",)], "path string")
    assert rows(ordering.without(paths, spark.createDataFrame([("a",)], "path string")), "path") == [("ab/c",)]
    assert rows(ordering.folders(paths), "folder") == [("a",), ("a/b",), ("ab",)]


@pytest.fixture(scope="module")
def tree(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, f"t{i}") for i in range(20)]
    return spark.createDataFrame(chain + [("side", "n3", "Side"), ("orphan", "gone", "Orphan")], "id string, parent_id string, title string")


def test_trees(spark, tree):
    reach = {(r.node, r.ancestor): r.distance for r in trees.closure(tree).collect()}
    assert reach["n19", "n0"] == 19 and reach["side", "n0"] == 4 and reach["orphan", "orphan"] == 0 and ("n0", "n1") not in reach
    assert {r.node: r.path for r in trees.paths(tree).collect()}["side"] == "t0/t1/t2/t3/Side"
    sums = {r.id: r.total for r in trees.subtree_sums(tree, tree.select("id", F.lit(1).alias("n"))).collect()}
    assert (sums["n0"], sums["n3"], sums["n19"], sums["orphan"]) == (21, 18, 1, 1)
    assert len(rows(trees.search(tree, "SIDE"), "id")) == 5
    assert rows(trees.selected(tree, tree.where("id = 'n18'").select("id")), "id") == [("n18",), ("n19",)]
    roots = {r.id: (r.parent_id, r.is_root) for r in trees.forest(tree).collect()}
    assert roots["orphan"] == (None, True) and roots["n1"] == ("n0", False)
    cells = {r.node: r.cells for r in trees.leaf_rows(tree).collect()}
    assert set(cells) == {"n19", "side", "orphan"} and {len(c) for c in cells.values()} == {20}


def test_cycles_end(spark):
    loop = spark.createDataFrame([("a", "b", "A"), ("b", "c", "B"), ("c", "a", "C")], "id string, parent_id string, title string")
    assert trees.closure(loop).count() == 9
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert rows(trees.crawl(spark.createDataFrame([("a",)], "id string"), edges), "id", "round") == [("a", 0), ("b", 1), ("c", 2)]


def test_outline(spark):
    blocks = spark.createDataFrame([("p", [0], "a"), ("p", [0, 1], "c\nd"), ("p", [0, 0], "b"), ("p", [1], None)], "page string, path array<int>, text string")
    assert trees.outline(blocks, "page", "path", "text").first().markdown == "- a\n    - b\n    - c\n  d\n- "


def test_documents(spark):
    kinds = [("heading_2", "H"), ("bulleted_list_item", "x"), ("bulleted_list_item", "y"), ("numbered_list_item", "1st"), ("numbered_list_item", "2nd"), ("code", "c"), ("divider", None), ("quote", "q\nr"), ("odd", "z")]
    df = spark.createDataFrame([("p", i, k, t, 0, False, "py", None) for i, (k, t) in enumerate(kinds)], "page_id string, ordinal int, type string, text string, depth int, checked boolean, language string, url string")
    assert documents.page_markdown(df).first().markdown == "## H\n\n- x\n- y\n\n1. 1st\n2. 2nd\n\n```py\nc\n```\n\n---\n\n> q\n> r\n\n"
    table = spark.createDataFrame([("t", 0, ["a", "b"]), ("t", 1, ["x|y"]), ("t", 2, ["l\nm", None])], "t string, o int, cells array<string>")
    assert documents.pipe_table(table, "t", "o", "cells").first().markdown == "| a | b |\n| --- | --- |\n| x\\|y |  |\n| l<br>m |  |"
    inks = {"red": (255, 0, 0), "blue": (0, 0, 255)}
    assert spark.range(1).select(documents.nearest_colour(F.lit("F01020"), inks).alias("x")).first().x == "red"
    html = "<html><head><title> A &amp; B </title></head><body><h1 id='top'>Hi <b>you</b></h1><p>One<br>two <a href='x\\y'>link</a></p><ul><li>i</li><li>j</li></ul><img src='p.png'><img src='data:x'></body></html>"
    page = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert page.select(documents.page_title(F.col("html")).alias("x")).first().x == "A & B"
    assert rows(documents.headings(page), "level", "anchor", "text") == [(1, "top", "Hi you")]
    assert rows(documents.hyperlinks(page), "href", "text") == [("x/y", "link")]
    assert rows(documents.media(page), "src") == [("p.png",)]
    assert page.select(documents.html_markdown(F.col("html")).alias("x")).first().x.startswith("# Hi **you**\n\nOne\ntwo [link](x\\y)\n\n- i\n- j")


def test_grouping(spark):
    df = spark.createDataFrame([(1, " ", "b"), (2, "x", None), (3, "y", "c")], "o int, p string, q string")
    assert tuple(grouping.first_examples(df, "o", "p", "q").first()) == ("x", "b")
    tags = spark.createDataFrame([("d", "A", 1), ("d", "a", 2), ("d", "b", 3)], "d string, tag string, o int")
    assert grouping.distinct_tags(tags, "d", "tag", "o").first().tags == ["A", "b"]
    assert tuple(grouping.progress(spark.createDataFrame([(10,), (20,), (None,)], "fetched int")).first()) == (30, 45.0)


def test_crawl_ends_or_raises(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(4)] + [(4, 0)], "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "id int")
    assert {(r.id, r.round) for r in trees.crawl(seeds, edges, max_rounds=5).collect()} == {(k, k) for k in range(5)}
    with pytest.raises(RuntimeError):
        trees.crawl(seeds, edges, max_rounds=3)


def test_pages_and_lists_of_any_depth(spark):
    rows = [("s", k, k, f"p{k}") for k in range(9)] + [("s", 9, 2, "q"), ("s", 10, 5, "r"), ("t", 0, 0, "only")]
    pages = spark.createDataFrame(rows, "s string, o int, level int, title string")
    got = {(r.s, r.o): r.path for r in ordering.page_paths(pages, "s", "o", "level", "title").collect()}
    assert got["s", 8] == "/".join(f"p{k}" for k in range(9)) and got["s", 9] == "p0/p1/q" and got["s", 10] == "p0/p1/q/r" and got["t", 0] == "only"

    rng = random.Random(3)
    rows = [(g, k, rng.randrange(7), rng.random() < 0.8) for g in range(4) for k in range(60)]
    want, now = {}, {}
    for g, k, level, item in rows:
        if k == 0:
            now = {}
        now = {lev: n for lev, n in now.items() if lev < level or (item and lev == level)}
        if item:
            now[level] = now.get(level, 0) + 1
            want[g, k] = now[level]
    df = spark.createDataFrame(rows, "g int, k int, level int, item boolean")
    assert {(r.g, r.k): r.number for r in ordering.number_list(df, "g", "k", "level", "item").collect() if r.item} == want


def test_tree_sums_with_and_without_cycles(spark):
    rng = random.Random(4)
    parent = {i: rng.randrange(i) if i % 9 else None for i in range(200)} | {k: k - 1 for k in range(300, 420)} | {300: None, 500: 999}
    nodes = spark.createDataFrame(list(parent.items()), "id int, parent_id int")
    counts = spark.createDataFrame([(i, i % 5) for i in parent if i % 3] + [(7, 100)], "id int, n long")
    total = {i: 0 for i in parent}
    for i in parent:
        up = i
        while up in parent:
            total[up] += (i % 5 if i % 3 else 0) + (100 if i == 7 else 0)
            up = parent[up]
    assert {r.id: r.total for r in trees.subtree_sums(nodes, counts).collect()} == total
    wanted = {15, 419, 150}
    above = set()
    for i in wanted:
        up = parent[i]
        while up in parent:
            above.add(up)
            up = parent[up]
    assert {r.id for r in trees.has_descendant(nodes, spark.createDataFrame([(i,) for i in wanted], "id int")).collect()} == above
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id int, parent_id int")
    ones = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4)], "id int, n long")
    assert {r.id: r.total for r in trees.subtree_sums(ring, ones).collect()} == {1: 4, 2: 4, 3: 4, 4: 1}


def test_first_imports_and_repeated_rows(spark):
    rows = spark.createDataFrame([("a/b", 1), ("a/b", 1), ("a/c", 2), ("d", 3)], "path string, n int")
    assert sorted(tuple(r) for r in ordering.without(rows, spark.createDataFrame([("a/b",)], "path string")).collect()) == [("a/c", 2), ("d", 3)]
    found = links.resolve_paths(
        spark.createDataFrame([("f", "x.md", 1), ("f", "x.md", 2), (None, "/g/Y", 3), ("f", "none", 4)], "folder string, href string, n int"),
        spark.createDataFrame([("f/x.md",), ("g/y.md",), ("x.md",)], "path string"),
    )
    assert {r.n: r.path for r in found.collect()} == {1: "f/x.md", 2: "f/x.md", 3: "g/y.md", 4: None}


def test_siblings_by_a_readers_order(spark):
    rows = [(1, None, "zebra"), (2, None, "Äpfel"), (3, None, "apple"), (4, 3, "éclair"), (5, 3, "Eclair"), (6, 3, "echo"), (7, 5, "b"), (8, 5, "B"), (9, 99, "apple"), (10, 3, "ECLAIR"), (11, 1, None), (12, 8, "x")]
    df = spark.createDataFrame(rows, "id int, parent_id int, title string").repartition(3)
    got = [r.id for r in trees.in_order(df).orderBy("place").collect()]
    # Of the children of 3 echo, then eclair by accent and case; the roots are Äpfel, apple twice by id, zebra.
    assert got == [2, 3, 6, 5, 7, 8, 12, 10, 4, 9, 1, 11]
    assert trees.in_order(df.limit(0)).collect() == []
    deep = spark.range(300).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id", "'t' AS title")
    assert [r.place for r in trees.in_order(deep).orderBy("id").collect()] == list(range(1, 301))
