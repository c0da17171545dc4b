"""Index, ranking, summaries and rules: golden cases and a loop as second opinion."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions.text import STOPWORDS
from corpusloom.operators import dedup, index, retrieval, rules, summaries

DOCS = [
    (0, "Acme sells red widgets. Widgets ship fast to every region we serve today."),
    (1, "Contact Acme support for blue gadgets and spare parts at any hour."),
    (2, "Pricing plans for widgets: basic and pro tiers are billed monthly."),
]


def frame(spark, docs=DOCS):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, question string")


def test_known_scores(spark):
    built = index.build_index(frame(spark))
    got = {r["doc_id"]: round(r["score"], 6) for r in retrieval.bm25(built, retrieval.question_terms(asked(spark, "What widgets does Acme sell?"))).collect()}
    assert got == {0: 1.053357, 1: 0.476972, 2: 0.499176}
    assert [r["dl"] for r in built.lengths.orderBy("doc_id").collect()] == [11, 9, 8]


def test_fallback_and_order(spark):
    built = index.build_index(frame(spark))
    rows = retrieval.retrieve(built, asked(spark, "What widgets does Acme sell?", "zzz", "")).orderBy("qid", "rank").collect()
    assert [r["doc_id"] for r in rows if r["qid"] == 0] == [0, 2, 1]
    assert [r["doc_id"] for r in rows if r["qid"] == 1] == [0, 1, 2] == [r["doc_id"] for r in rows if r["qid"] == 2]


def test_scores_against_a_loop(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice("alpha beta gamma delta epsilon zeta the of".split()) for _ in range(rnd.randint(0, 30)))) for i in range(50)]
    terms = [[w for w in t.split() if w not in STOPWORDS] for _, t in docs]
    df = Counter(w for t in terms for w in set(t))
    avg = sum(map(len, terms)) / len(terms)
    want = {}
    for (i, _), t in zip(docs, terms):
        score = sum(
            math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * max(1, len(t)) / avg)) for w in ("alpha", "zeta") if w in t
        )
        if score:
            want[i] = round(score, 9)
    got = retrieval.bm25(index.build_index(frame(spark, docs), keep=False), retrieval.question_terms(asked(spark, "Alpha or zeta? alpha"))).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in got} == want


def test_index_survives_a_write(spark, tmp_path):
    built = index.build_index(frame(spark))
    built.write(str(tmp_path))
    again = index.Index.read(spark, str(tmp_path))
    terms = retrieval.question_terms(asked(spark, "widgets"))
    assert sorted(map(tuple, retrieval.bm25(built, terms).collect())) == sorted(map(tuple, retrieval.bm25(again, terms).collect()))


def test_summary_and_answers(spark):
    questions = asked(spark, "What widgets does Acme sell?", "zzz")
    built = index.build_index(frame(spark))
    found = retrieval.retrieve(built, questions).join(frame(spark), "doc_id").join(questions, "qid").select("qid", "question", "rank", F.col("text").alias("content"), F.lit("https://a").alias("source"))
    rows = [r["sentence"] for r in summaries.summary_sentences(found).where("qid = 0").orderBy("rank").collect()]
    assert [r.split()[0] for r in rows] == ["Pricing", "Contact", "Widgets"]
    answers = {r["qid"]: r for r in summaries.local_answers(found, questions.unionByName(asked(spark, "x").withColumn("qid", F.lit(9)))).collect()}
    assert answers[0]["answer"].startswith(summaries.ANSWER_LEAD) and answers[0]["sources"] == ["https://a"]
    assert answers[9]["answer"] == summaries.NOTHING_FOUND and answers[9]["sources"] == []


def test_prefix_dedup(spark):
    start = "p" * 260
    blocks = spark.createDataFrame([(1, 0, start + " a"), (1, 1, "other"), (1, 2, start.upper() + "  longer one"), (1, 3, " "), (2, 0, "other")], "page_id bigint, pos int, block string")
    text = {r["page_id"]: r["text"] for r in dedup.joined_blocks(dedup.prefix_dedup(blocks)).collect()}
    assert text == {1: start.upper() + " longer one\nother", 2: "other"}


def test_site_rules(spark):
    df = spark.createDataFrame([("www.my-site_name.com",), ("example.co.uk",), ("",)], "h string")
    assert [r[0] for r in df.select(rules.name_of_host(F.col("h"))).collect()] == ["My Site Name", "Example.Co", "this site"]
    pages = spark.createDataFrame(
        [("s", "s.example", "Home", "a network", None, 1), ("s", "s.example", "Jean-Luc - Portfolio", "x", ["l"], 2), ("t", "t.example", None, "y", None, 1)],
        "site string, host string, title string, text string, links array<string>, ord bigint",
    )
    names = {r["site"]: r["site_name"] for r in rules.site_names(pages).collect()}
    assert names == {"s": "Jean", "t": "T"}
    got = {r["site"]: r["suggestions"] for r in rules.suggestions(rules.site_corpora(pages.where("ord = 1")), rules.site_names(pages)).collect()}
    assert got["s"][0] == "What projects or work samples does Jean showcase?" and len(got["s"]) == 3
    assert got["t"][0] == "What is the main purpose of T?"


def test_follow_ups(spark):
    texts = ["Why should I hire him?", "Why should I use this website for my project?", "is it a good fit", "éneed would this work for me", "hello", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(rules.follow_up(F.col("t"))).collect()]
    assert got[0].startswith("What role") and got[1] is None and got[2].startswith("What role, task") and got[3] is None and got[4] is None and got[5] is None


def test_scan_equals_the_index(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice("alpha beta gamma delta epsilon zeta the of".split()) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(99, None)]
    built = index.build_index(frame(spark, docs), keep=False)
    for text in ("Alpha, beta: alpha", "nothing here", "the of"):
        want = {r["doc_id"]: round(r["score"], 9) for r in retrieval.bm25(built, retrieval.question_terms(asked(spark, text))).collect()}
        assert {r["doc_id"]: round(r["score"], 9) for r in retrieval.scan(frame(spark, docs), text).collect()} == want
