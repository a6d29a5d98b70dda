import random

from notemill.operators.outlines import prose, shaped


def test_outlines_as_prose(spark):
    blocks = {
        (0,): "Intro", (0, 0): "goes on", (0, 0, 0): "and on",
        (1,): "# Part", (1, 0): "a", (1, 1): "b\nb2", (1, 1, 0): "c",
        (2,): "[ ] task", (3,): "[x] done", (3, 0): "why",
        (4,): None, (4, 0): "inner", (4, 1): "## Sub",
        (5,): "Mixed", (5, 0): "## No list", (5, 1): "then",
    }
    rows = [("P", list(k), t) for k, t in blocks.items()] + [("Q", [0], ""), ("Q", [1], "only")]
    df = spark.createDataFrame(rows, "page string, path array<int>, text string").repartition(3)
    got = {r.page: r.markdown for r in prose(df).collect()}
    assert got["P"].split("\n\n") == ["Intro", "goes on", "and on", "# Part", "- a\n- b\n  b2\n    - c", "- [ ] task\n- [x] done\n    - why", "inner", "## Sub", "Mixed", "## No list", "then"]
    assert got["Q"] == "only"
    assert prose(df.limit(0)).collect() == []


def test_task_runs_anchors_and_fences(spark):
    rows = [
        ([0], "[ ] a", None), ([1], None, None), ([2], "[ ] b", "id1"), ([3], "x", "id2"), ([3, 0], "one", None), ([3, 1], "two\n```\n\ncode\n```", "id3"), ([3, 1, 0], "[x] deep", None), ([3, 1, 0, 0], "# below a task", None), ([7, 4], "orphan", None),
    ]
    df = spark.createDataFrame([("P", p, t, a) for p, t, a in rows], "page string, path array<int>, text string, anchor string")
    assert prose(df, anchor="anchor").first().markdown == "- [ ] a\n\n- [ ] b ^id1\n\nx ^id2\n\n- one\n- two\n  ```\n  \n  code\n  ```\n  ^id3\n    - [x] deep\n        - # below a task\n\norphan"


def test_shapes_by_definition(spark):
    """Flags of random trees against their definition, deep ones too."""
    rng = random.Random(5)
    rows = []
    for page in range(12):
        nodes = [()]
        for _ in range(40):
            up = nodes[-1] if page % 3 == 0 else rng.choice(nodes)
            nodes.append((*up, sum(n[:-1] == up for n in nodes if n)))
        rows += [(page, list(n), rng.choice(["plain", "plain", "plain", "[ ] task", "# head", None])) for n in nodes[1:]]
    text = {(p, tuple(n)): t for p, n, t in rows}
    below = {k: [o for o in text if o[0] == k[0] and o[1][:-1] == k[1]] for k in text}
    task = lambda k: (text[k] or "").startswith("[")

    def item(k):
        return text[k] is not None and not text[k].startswith("#") and (task(k) or all(map(item, below[k])))

    df = spark.createDataFrame(rows, "page int, at array<int>, says string")
    blocks = df.selectExpr("struct(page, at) AS node", "CASE WHEN size(at) > 1 THEN struct(page, slice(at, 1, size(at) - 1) AS at) END AS parent", "says", "coalesce(says LIKE '[%', false) AS task", "coalesce(says LIKE '#%', false) AS heading")
    got = {(r.node.page, tuple(r.node["at"])): (r["item"], r.in_list) for r in shaped(blocks).collect()}
    siblings = lambda k: below.get((k[0], k[1][:-1]), [])
    assert got == {k: (item(k), len(siblings(k)) > 1 and text[k[0], k[1][:-1]] is not None and all(map(item, siblings(k)))) for k in text}


def test_a_large_page(spark):
    df = spark.range(20_000).selectExpr("'P' AS page", "CASE WHEN id % 4 = 0 THEN array(CAST(id DIV 4 AS INT)) ELSE array(CAST(id DIV 4 AS INT), CAST(id % 4 AS INT)) END AS path", "concat('b', id) AS text")
    plan = prose(df)
    text = plan.first().markdown
    assert text.startswith("b0\n\n- b1\n- b2\n- b3\n\nb4\n\n- b5") and text.count("\n- ") == 15_000 and text.count("\n\n") == 9_999
