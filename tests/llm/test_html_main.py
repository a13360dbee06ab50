import html
import re

from pyspark.sql import functions as F

from lakewright.llm.html_main import extract, main_text
from lakewright.sources.tables import table

PROSE = "The cat is in the house and it was not on the table of the other one that we have seen."


def test_pages(spark, folder):
    """The pages' articles, cut out with a pattern, are the main text."""
    pages = table(spark, folder, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for row in extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[row.page_id], re.S)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p|br)>", " ", inner))
        assert row.text == " ".join(html.unescape(inner).split())
        assert row.n_chars == len(row.text)


def test_rules():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header>Site of the day</header>
    <nav><a href=1>The home of it</a></nav><div id="cookie-notice">{PROSE}</div>
    <main><h1>Title&nbsp;&amp; more</h1><p>{PROSE}<br>Line&#33;<p>Short.</p>
    <ul><li><a href=2>see the list of it</a></li></ul><form><p>{PROSE}</p></form><script>var x = "<p>no</p>"</script>
    <!-- {PROSE} --><div class="ad box">{PROSE}</div><p>End</p></main>
    <aside>{PROSE}</aside><section class="comments"><article><p>{PROSE}</p></article></section><footer>{PROSE}</footer>"""
    assert main_text(page) == f"Title & more {PROSE} Line! Short. End"


def test_open_blocks_follow_their_neighbours():
    links = "<p><a href=1>many links are in the row of it</a></p>"
    assert main_text(f"<body><p>{PROSE}</p><p>near one</p>{links}<p>near two</p>{links}</body>") == f"{PROSE} near one"
    assert main_text("<body><p>only this</p></body>") == ""
    assert main_text("<body><article><p>only this</p></article></body>") == "only this"


def test_hard_rows(spark):
    rows = [
        (1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<article>" + "<p>x</p>" * 20000),
        (4, "u", "<article><p>a &lt;b&gt; &unknown; &#x1F600; &amp"), (5, "u", "no markup <"), (6, "u", "<script>never closed"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in extract(pages).collect()]
    assert got[0] == (1, "", 0) and got[1] == got[2] == (2, "", 0)
    assert got[3] == (None, "x" + " x" * 19999, 39999)
    assert got[4] == (4, "a <b> &unknown; \U0001f600 &", 19)
    assert got[5][1] in ("", "no markup <") and got[6] == (6, "", 0)
    assert extract(pages.limit(0)).count() == 0
