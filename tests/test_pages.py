import pytest

from notemill.operators.pages import page_to_markdown, page_tree_markdown

CASES = [
    ("<ul><li>a<ul><li>b<ol start=3><li>c</li><li>d</li></ol></li></ul></li><li>e</li></ul>", "- a\n    - b\n        3. c\n        4. d\n- e"),
    ("<blockquote><p>a</p><blockquote>b <b>c</b></blockquote><ul><li>d</ul></blockquote>", "> a\n>\n> > b **c**\n>\n> - d"),
    ("<table><tr><th>a<th>b<tr><td><p>x</p><p>y|z</p><td><ul><li>k</ul><tr><td>1</table>", "| a | b |\n| --- | --- |\n| x<br>y\\|z | - k |\n| 1 |  |"),
    ("<body><head><title>t</title></head><p>a <strong> b <b>c</b> </strong>d<p>e<script>x</script></body>", "a **b c** d\n\ne"),
    ("<pre><code class='language-py'>if a:\n  <b>b</b></code></pre><hr>x<br>y", "```py\nif a:\n  b\n```\n\n---\n\nx\ny"),
    ("<figure class='callout'>note<p>more</p></figure><details><summary>T</summary><p>in</p></details>", "> [!important]\n> note\n>\n> more\n\n> [!note] T\n> in"),
    ("<ul><li><div class='checkbox checkbox-on'></div>done</li><li><input type=checkbox>open <a href='b\\c'>l</a> <img src='i.png' alt='p'></li></ul>", "- [x] done\n- [ ] open [l](b/c) ![p](i.png)"),
    ("", ""),
    ("plain &amp; <unknown>text", "plain & text"),
    ("<li>a<p>b</p></ul></div>", "a\n\nb"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_nested_pages(html, want):
    assert page_to_markdown(html) == want


def test_pages_as_columns(spark):
    df = spark.createDataFrame([(0, None), *[(i + 1, h) for i, (h, _) in enumerate(CASES)]], "i int, html string")
    got = {r.i: r.m for r in df.select("i", page_tree_markdown(df.html).alias("m")).collect()}
    assert got == {0: None, **{i + 1: m for i, (_, m) in enumerate(CASES)}}
