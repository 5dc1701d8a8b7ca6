"""License wordings whatever the line breaks."""
import pytest

from feedspark.llm import licenses


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["labels"], r["score"], r["n_blocks"]) for r in licenses.scan(df).collect()}


def wrapped(text, n, start=""):
    words = text.split()
    return "\n".join(start + " ".join(words[i:i + n]) for i in range(0, len(words), n))


@pytest.mark.parametrize("n", [3, 7, 12])
def test_wrapped_wordings(spark, n):
    got = scan(spark, [f"some words before\n{wrapped(t, n, '# ')}\nand after" for t, _ in licenses.TEMPLATES])
    assert got == {i: (label, 1.0, 1) for i, (_, label) in enumerate(licenses.TEMPLATES)}


def test_scattered_words_are_no_wording(spark):
    far = " filler" * 60 + " "
    got = scan(spark, [far.join(t.split()) for t, _ in licenses.TEMPLATES])
    assert got == {i: ("", 0.0, 0) for i in range(len(licenses.TEMPLATES))}


def test_blocks_of_repeated_wordings(spark):
    bsd = licenses.TEMPLATES[7][0]
    words = bsd.split()
    got = scan(spark, ["\n".join([bsd] * 15), " ".join([bsd] * 3), " ".join(words[1:]), " ".join(words[3:])])
    assert got[0] == ("bsd", 1.0, 15) and got[1] == ("bsd", 1.0, 3)
    assert got[2] == ("bsd", 12 / 13, 1) and got[3] == ("", 0.0, 0)
