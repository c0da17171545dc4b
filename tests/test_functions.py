"""Text and address functions: golden cases, properties and brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_tokens(spark):
    assert one(spark, tx.tokens, "Ñboa ÉZ2 the x 42!") == ["boa", "z2", "42"]
    assert one(spark, tx.tokens, None) == []


def windows_by_loop(text, size=1400, overlap=200):
    out, i = [], 0
    while text:
        out.append(text[i : i + size].strip(" "))
        if i + size >= len(text):
            break
        i += size - overlap
    return out


def test_windows_for_every_length(spark):
    lengths = [0, 1, 199, 1399, 1400, 1401, 2600, 2601, 3800, 3801, 9999]
    df = spark.createDataFrame([("x" * n,) for n in lengths], "v string")
    for n, row in zip(lengths, df.select(tx.windows(F.col("v")).alias("r")).collect()):
        assert row["r"] == windows_by_loop("x" * n)
    rnd = random.Random(1)
    texts = [" ".join("ab" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 900))) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r["r"] for r in df.select(tx.windows(F.col("v"), 100, 30).alias("r")).collect()] == [windows_by_loop(t, 100, 30) for t in texts]
    with pytest.raises(ValueError):
        tx.windows(F.col("v"), 100, 100)


def test_blanks_truncation_sentences(spark):
    assert one(spark, tx.collapse, "  a   \n b ") == "a b"
    assert one(spark, tx.truncate, "a" * 4001) == "a" * 4000 + "..."
    assert one(spark, tx.meaningful, "short") is None
    assert one(spark, tx.sentences, "24 ways to store the lamp in May. Too short. Is the second sentence long enough? Yes") == [
        "24 ways to store the lamp in May.",
        "Is the second sentence long enough?",
    ]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://e.com/a?UTM_Source=x&q=1#f", "https://e.com/a?q=1"), ("not a url", None), (None, None), ("ftp://e.com/", None), ("HTTP://WWW.E.com:80", "http://www.e.com/"),
        ("https://e.com:443/a/../b/./c", "https://e.com/b/c"), ("https://e.com:8443/ä b", "https://e.com:8443/%C3%A4%20b"), ("http://bücher.example/", "http://xn--bcher-kva.example/"),
        ("https://e.com/?utm_id=1", "https://e.com/"), ("https://e.com/a?b=%20c", "https://e.com/a?b=%20c"), ("http://exa mple.com/", None), ("https://e.com:99999/", None),
    ],
)
def test_canonical(raw, want):
    assert urls.canonical(raw) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_canonical_is_idempotent(tail):
    first = urls.canonical("https://Host.example/" + tail)
    if first is not None:
        assert urls.canonical(first) == first


def test_plain_form_equals_full_form(spark):
    raws = ["https://E.com/a?gclid=1&q=2&utm_term=x", "http://e.com", "https://e.com:443/x#y", "http://e.com:80/?fbclid=3", "mailto:a@b", "", None, "https://e.com/a/?x=1"]
    df = spark.createDataFrame([(r,) for r in raws], "u string")
    for row in df.select("u", urls.plain_canonical(F.col("u")).alias("a"), urls.canonical_url("u").alias("b")).collect():
        assert row["a"] == row["b"], row


def test_links(spark):
    cases = {"#x": False, "mailto:a@b": False, "/f.PDF?x=1": False, "/pdf": True, "MAILTO:a@b": True, "": False, "/a.png": False, "/a.pngx": True}
    df = spark.createDataFrame(list(cases.items()), "h string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", urls.crawlable(F.col("h"))).collect())
    assert one(spark, urls.administrative, "https://e.com/wp-admin/x") and not one(spark, urls.administrative, "https://e.com/wp-administer")
    got = spark.createDataFrame([("../b?x#f", "https://e.com/a/c")], "h string, b string").select(urls.resolve_url("h", "b").alias("r")).first()["r"]
    assert got == "https://e.com/b?x"
