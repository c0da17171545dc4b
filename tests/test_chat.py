"""Frames, the chat machine, providers, settings, ordinals and the command line."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as command
from corpusloom.operators import crawl, index, providers, retrieval, rules, summaries
from corpusloom.sources import settings
from corpusloom.streaming import sessions

AT = datetime(2024, 5, 1, 12)
NAMES = ("groq", "ollama")


def run(*events, state=("awaiting_url", None, 0, {})):
    said = []
    for i, e in enumerate(events):
        state, out = sessions.chat_step(state, AT + timedelta(seconds=i), *e[:2], NAMES, *e[2:])
        said.append([(t, x, a) if a else (t, x) for t, x, a in out])
    return state, said


def test_a_chat_prepares_answers_and_resets():
    state, said = run(
        ("user_message", " "), ("user_message", " https://a.example "), ("user_message", "hello?"), ("prepared", "Done."), ("user_message", "What?"), ("answered", "This."),
        ("user_message", "And?"), ("unknown", "x"), ("reset", None),
    )
    assert said == [
        [], [("crawl", "https://a.example")], [("status", sessions.PREPARING)], [("assistant_message", "Done.")], [("status", sessions.THINKING), ("answer", "What?", ["groq", "ollama"])],
        [("assistant_message", "This.")], [("status", sessions.THINKING), ("answer", "And?", ["ollama", "groq"])], [], [("assistant_message", sessions.WAS_RESET)],
    ]
    assert state == ("awaiting_url", None, 0, {})


def test_a_failed_site_resets_and_a_bad_frame_does_not():
    state, said = run(("user_message", "no address"), ("failed", "No page."), (None, None, False), ("prepared", "late"), ("answered", "late"))
    assert state == ("awaiting_url", None, 0, {})
    assert said[1] == [("error", "No page."), ("assistant_message", sessions.ASK_ADDRESS)] and said[2] == [("error", sessions.BAD_FRAME)] and said[3] == said[4] == []


def test_failed_providers_rest():
    ready = ("ready", "https://a.example", 0, {})
    state, said = run(("provider_failed", "groq: slow down", True, 429), ("user_message", "Q"), ("provider_failed", "ollama: api key missing"), ("user_message", "Q"), state=ready)
    assert state[3] == {"groq": AT + timedelta(seconds=600), "ollama": AT + timedelta(seconds=902)}
    assert said[1][1] == ("answer", "Q", ["ollama"]) and said[3][1] == ("answer", "Q", ["groq", "ollama"])
    assert [providers.rest_of(None, m) for m in (None, "quota", "Too many requests")] == [120, 900, 600]


def test_a_question_no_provider_answers():
    state, said = run(("unanswered", "From the site."), state=("ready", "https://a.example", 3, {}))
    assert state == ("ready", "https://a.example", 3, {}) and said == [[("status", sessions.UNAVAILABLE), ("assistant_message", "From the site.")]]


def test_frames_read_and_written(spark):
    raw = ['{"type":"user_message","text":"a"}', '{"type":"reset"}', "{", "", None, "5", "null", '{"text":3,"type":null,"x":[1]}']
    got = sessions.parsed_frames(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "id int, value string")).orderBy("id").collect()
    assert [(r["type"], r["text"], r["valid"]) for r in got] == [
        ("user_message", "a", True), ("reset", None, True), (None, None, False), (None, None, False), (None, None, False), (None, None, True), (None, None, True), (None, "3", True),
    ]
    m = spark.createDataFrame([("s", "status", None), ("s", "error", 'a "b"')], "session_id string, type string, text string")
    assert [r["value"] for r in sessions.frames(m, "type", "text").collect()] == ['{"type":"status"}', '{"type":"error","text":"a \\"b\\""}']


def test_frames_are_sent_from_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    out.mkdir()
    m = spark.createDataFrame([("s", "status", "a"), ("t", "error", "b")], "session_id string, type string, text string")
    m.write.parquet(source)

    def send(session, frame, folder=str(out)):
        open(f"{folder}/{session}", "w").write(frame)

    query = sessions.write_frames(spark.readStream.schema(m.schema).parquet(source), send, str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert {p.name: p.read_text() for p in out.iterdir()} == {"s": '{"type":"status","text":"a"}', "t": '{"type":"error","text":"b"}'}


def test_the_chat_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("s", AT, "user_message", "https://a.example"), ("s", AT + timedelta(seconds=1), "prepared", "Done."), ("s", AT + timedelta(seconds=2), "user_message", "Q"), ("t", AT, "user_message", "  ")]
    events = spark.createDataFrame(rows, "session_id string, ts timestamp, type string, text string")
    events.write.parquet(str(tmp_path / "in"))
    query = sessions.chat(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), NAMES).writeStream.format("memory").queryName("said").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["type"], r["stage"], r["attempts"]) for r in spark.table("said").orderBy("ts", F.desc("type")).collect()] == [
        ("crawl", "crawling", None), ("assistant_message", "ready", None), ("status", "ready", None), ("answer", "ready", ["groq", "ollama"]),
    ]


def test_error_messages(spark):
    bodies = ['{"error":"a"}', '{"error":{"message":"b"},"message":"c"}', '{"error":5,"message":"c"}', '{"x":1}', " plain ", "x" * 300, "", None, "[1]"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    got = [r["e"] for r in df.orderBy("id").select(providers.error_message(F.col("body")).alias("e")).collect()]
    assert got == ["a", "b", "c", '{"x":1}', "plain", "x" * 240 + "...", "Empty error response", "Empty error response", "[1]"]


def test_available_and_active(spark):
    assert providers.available({}) == ["ollama"] and providers.available({"GROQ_API_KEY": "k", "OLLAMA_BASE_URL": ""}) == ["groq"]
    df = spark.sql("select map('b', timestamp'2024-05-01 12:00:01', 'a', timestamp'2024-05-01 13:00:00', 'c', timestamp'2024-05-01 12:00:00') as m, timestamp'2024-05-01 12:00:00' as now")
    assert df.select(providers.active(F.col("m"), F.col("now")).alias("r")).first()["r"] == ["a", "b"]
    report = providers.failure_report(spark.createDataFrame([("a", True), ("a", False), ("b", True)], "provider string, ok boolean")).collect()
    assert {tuple(r) for r in report} == {("a", 2, 1, 1), ("b", 1, 0, 0)}


def test_settings_of_an_environment(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("Open Router - one\nGemini - two\nopenrouter - three\nother - x\ngroq -\n")
    keys = {r["provider"]: r["value"] for r in settings.read_keys(spark, str(tmp_path / "keys.txt")).collect()}
    assert keys == {"openrouter": "three", "google": "two"}
    chosen, texts = settings.of_environment({"CRAWL_MAX_PAGES": "7", "GROQ_API_KEY": "from outside", "GROQ_MODEL": "m", "HOME": "/"}, keys)
    assert chosen == settings.Settings(max_pages=7) and texts["OPENROUTER_API_KEY"] == "three" and "GROQ_API_KEY" not in texts and texts["GROQ_MODEL"] == "m" and texts["OLLAMA_MODEL"]
    with pytest.raises(ValueError):
        settings.of_environment({"PORT": "0"})


def test_ordinals(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b"))
    got = index.ordinals(rows.repartition(7), "a", "b").collect()
    assert [r["ordinal"] for r in sorted(got, key=lambda r: (r["a"], r["b"]))] == list(range(1000))
    assert index.ordinals(rows.limit(0), "a", "b").count() == 0


def test_best_documents_equal_the_index(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else " ".join(rnd.choice("alpha beta gamma delta eps the of x1".split()) for _ in range(rnd.randint(0, 30)))) for i in range(400)], "doc_id bigint, text string").repartition(5)
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "gamma?"), (3, ""), (4, None), (5, "nothing here"), (6, "alpha alpha eps")], "qid bigint, question string")
    plain = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    want = plain(retrieval.retrieve(index.build_index(docs), questions))
    assert plain(retrieval.retrieve_documents(docs, questions)) == want
    monkeypatch.setattr(retrieval, "ASKED_PAIRS", 2)
    assert plain(retrieval.retrieve_documents(docs, questions)) == want
    assert retrieval.retrieve_documents(docs.limit(0), questions).count() == 0


def test_context_prompt_and_follow_up(spark):
    found = spark.createDataFrame([(1, "Should I use this website?", 2, "b" * 40 + ".", None), (1, "Should I use this website?", 1, "The site has forty lamps in two colours.", "https://a.example/")], "qid bigint, question string, rank int, content string, source string")
    questions = spark.createDataFrame([(1, "Should I use this website?"), (2, "What is it?")], "qid bigint, question string")
    context = summaries.context_blocks(found).first()["context"]
    assert context == "---\nSource: https://a.example/\nChunk 1:\nThe site has forty lamps in two colours.\n\n---\n\nChunk 2:\n" + "b" * 40 + "."
    answers = {r["qid"]: r["answer"] for r in summaries.follow_up_answers(found, questions, rules.follow_up).collect()}
    assert set(answers) == {1} and answers[1].startswith("The site points to ") and answers[1].endswith(". To make this specific, What day-to-day task do you want this website to help with?") and ".. " not in answers[1]
    asked = {r["qid"]: r for r in summaries.prompts(found, questions, F.to_timestamp(F.lit("2024-05-01 12:00:00"))).collect()}
    assert context in asked[1]["user"] and "Wednesday, May 1, 2024" in asked[1]["system"] and asked[2]["user"].endswith("What is it?")
    assert summaries.answerer("local").answers(found, questions).count() == 2
    with pytest.raises(ValueError):
        summaries.answerer("groq")


def snapshot(spark):
    body = "<html><head><title>Home</title></head><body><p>The workshop repairs forty lamps a week.</p><a href='/b'>b</a><a href='/c'>c</a></body></html>"
    other = "<html><head><title>Other</title></head><body><p>The other page speaks of kettles at length.</p></body></html>"
    rows = [("https://a.example/", "html", 200, "text/html", body), ("https://a.example/b", "html", 200, None, other), ("https://a.example/c", "html", 200, None, "<html></html>"), ("https://a.example/d", "html", 404, None, None),
            ("https://a.example/sitemap.xml", "text", 200, None, "<sitemapindex><loc>https://a.example/s1.xml</loc><loc>https://a.example/s2.xml</loc></sitemapindex>"),
            ("https://a.example/s1.xml", "text", 200, None, "<loc>https://a.example/b</loc><loc>https://other.example/</loc>"), ("https://a.example/s2.xml", "text", 200, None, "<loc>https://a.example/z</loc>")]
    return spark.createDataFrame(rows, "url string, kind string, status int, content_type string, body string")


def test_crawl_order_log_and_sitemaps(spark):
    rows = snapshot(spark)
    assert crawl.discover_sitemaps(rows, "https://a.example/") == ["https://a.example/b", "https://a.example/z"]
    for sitemaps in (True, False):
        got = [(r["page_ord"], r["depth"], r["title"]) for r in crawl.crawl(rows, "https://a.example/", use_sitemaps=sitemaps).orderBy("page_ord").collect()]
        assert got == [(0, 0, "Home"), (1, 1, "Other")]
    assert {tuple(r) for r in crawl.crawl_log(rows).collect()} == {
        ("https://a.example/", "accepted"), ("https://a.example/b", "accepted"), ("https://a.example/c", "dropped_empty"), ("https://a.example/d", "fetch_failed")
    }


def test_the_command(spark, tmp_path, capsys):
    snapshot(spark).write.parquet(str(tmp_path / "s"))
    assert command.arguments(["--snapshot", "x"]).address == command.DEFAULT_ADDRESS
    assert command.main(["https://a.example/", "--snapshot", str(tmp_path / "s"), "--question", "How many lamps does the workshop repair?"]) == 0
    said = capsys.readouterr().out
    assert "2 pages from" in said and "forty lamps" in said and "https://a.example/" in said
