from pyspark.sql import functions as F

from feedspark.functions.html import page_description, page_full_text, remove_noise


def describe(spark, htmls):
    df = spark.createDataFrame([(h,) for h in htmls], "html string")
    return [r[0] for r in df.select(page_description(remove_noise(F.col("html")))).collect()]


def test_description_fixtures(spark):
    long_p = "x" * 400
    htmls = ['<meta name="description" content=" Hi ">',
             '<meta content="Hi" name="description">',
             '<meta name="description" content=""><p>Text</p>',
             f"<p>{long_p}</p>",
             "<p></p><p>Second</p>",
             "<p> </p>",
             '<meta name="description" content=" "><p>Text</p>',
             "<div>neither</div>",
             '<script>var t="<p>no</p>";</script><p>Real &amp; text</p>']
    assert describe(spark, htmls) == ["Hi", "Hi", "Text...", "x" * 300 + "...", None, "...", "", None,
                                      "Real & text..."]


def test_description_of_bare_attributes_and_references(spark):
    htmls = ['<meta name=description content="Hi there">', '<META NAME="description" CONTENT=\'a > b\'>', "<meta content='x' name=keywords><meta name='description' content=bare>",
             '<meta name="Description" content="other case"><p>P</p>', '<p>It&#8217;s caf&eacute; &#x27;q&#x27; &amp;lt; &unknown; &#0; &#55296; R&D; &euro;</p>']
    assert describe(spark, htmls) == ["Hi there", "a > b", "bare", "P...", "It’s café 'q' &lt; &unknown; \ufffd \ufffd R&D; €..."]


def test_full_text_article_then_paragraphs(spark):
    htmls = ["<nav>menu</nav><article><h1>T</h1><p>One</p><p>Two &middot; 2</p></article><footer>f</footer>",
             "<body><p>First<p>Second</p><div>x</div></body>"]
    df = spark.createDataFrame([(h,) for h in htmls], "html string")
    got = [r[0] for r in df.select(page_full_text(remove_noise(F.col("html")))).collect()]
    assert got == ["T\n\nOne\n\nTwo · 2", "First\n\nSecond"]
