"""Blocks of hand-made pages, and what neighbours tell of them."""

import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.functions import html

LONG = "these are the many words of a real paragraph that goes on and on until nobody can take it for a menu entry at all"


@pytest.mark.parametrize(
    "page, blocks",
    [
        (None, []), ("", []), ("plain", [("", 0, 1, 0, "plain")]),
        ("<p>a &amp; b&nbsp;c &#233;<p>next <b>bold</b> end", [("p", 1, 5, 0, "a & b c é"), ("p", 2, 3, 0, "next bold end")]),
        ("<div>one<script>var x = '<p>no</p>';</script> two<!-- <p>three</p> --></div>", [("div", 1, 2, 0, "one two")]),
        ("<style>p {}</style><noscript><p>no</p></noscript><svg><text>no</text></svg><p>yes</p>", [("p", 1, 1, 0, "yes")]),
        ("<ul><li><a href=x>home page</a></li><li><a>two</a> more</li></ul>", [("li", 2, 2, 2, "home page"), ("li", 2, 2, 1, "two more")]),
        ("<div>a<br>b<br/>c<img src=x>d</div>tail", [("div", 1, 1, 0, "a"), ("div", 1, 1, 0, "b"), ("div", 1, 1, 0, "cd"), ("", 0, 1, 0, "tail")]),
        ("</div><p>x</b></p><b><p>y</b>z", [("p", 1, 1, 0, "x"), ("p", 2, 1, 0, "y"), ("", 0, 1, 0, "z")]),
        ("<title>t</title><h1>T</h1><table><tr><td>1<td>2</table>", [("h1", 1, 1, 0, "T"), ("td", 3, 1, 0, "1"), ("td", 4, 1, 0, "2")]),
    ],
)
def test_blocks(page, blocks):
    assert [tuple(b.values()) for b in html.page_blocks(page)] == blocks


def test_boilerplate_goes_by_its_neighbours(spark):
    menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(6)) + "</ul></nav>"
    page = f"<html><head><title>t</title></head><body>{menu}<h1>A heading</h1><p>{LONG}</p><p>short one</p><p>{LONG} again</p><div>Contact <a href=x>imprint and legal notes</a></div><p>end</p></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>lone</p>")], "id int, html string").select("id", html.blocks(F.col("html")).alias("b"))
    got = {r.id: r.text for r in df.select("id", html.content(df["b"]).alias("text")).collect()}
    assert got == {1: f"A heading\n{LONG}\nshort one\n{LONG} again", 2: "", 3: ""}


def test_query(spark, sf_dir):
    rows = plans.queries()["html_blocks"](spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.blocks == len(html.page_blocks(pages[r.page_id])) and 0 <= r.kept <= r.blocks for r in rows)
    assert any(r.kept for r in rows)
