"""Sessions of a chat over a site: one state a session, in batch replay and as a stream.

A session waits for an address, prepares that site, and then answers. Preparing is done by whoever consumes the output, so
in replay a site counts as ready from the next message on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.functions.text import SPACE
from corpusloom.operators import providers

#: Stages of a session (fixed values).
AWAITING, READY = "awaiting_url", "ready"
_PYTHON_SPACE = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE)
EVENTS = "session_id string, seq bigint, stage string, action string, seed_url string"


#: Blanks at either end, as everywhere in this package.
_BLANKS = re.compile(rf"\A{_PYTHON_SPACE}+|{_PYTHON_SPACE}+\Z")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def step(stage: str, seed: str | None, kind: str, text: str | None) -> tuple[str, str | None, str]:
    """``(stage, seed, action)`` after one message."""
    if kind == "reset":
        return AWAITING, None, "reset"
    t = _BLANKS.sub("", text or "")
    if kind != "user_message" or not t:
        return stage, seed, "ignored"
    if stage == AWAITING:
        address = t if t.lower().startswith(("http://", "https://")) else None
        return (READY, address, "crawl") if address else (AWAITING, None, "ask_url")
    return stage, seed, "answer"


#: How long a stream remembers messages to know their copies.
LATENESS = "7 days"
#: Messages of one session are gathered by this span of time, never the whole session.
SPAN = "hour"


def replay(messages: DataFrame) -> DataFrame:
    """``session_id, seq, stage, action, seed_url`` of every message, exact copies once, in order of time.

    The state after a message depends on the last reset and the first address after it. Each span of a session is read by
    itself; what it hands on (its length, whether it has a reset, its first address after that) is one row, and running
    over those rows gives what every span starts with. So a session that holds a third of all messages is spread over its
    spans.
    """
    m = messages.select("session_id", "ts", "type", "text").distinct().withColumn("span", F.date_trunc(SPAN, "ts"))
    t = trimmed(F.col("text"))
    order = Window.partitionBy("session_id", "span").orderBy("ts", "type", F.coalesce("text", F.lit("")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumns({"at": F.row_number().over(order), "era": F.sum(F.when(F.col("type") == "reset", 1).otherwise(0)).over(upto)})
    address = (F.col("type") == "user_message") & t.rlike("(?i)^https?://")
    era = Window.partitionBy("session_id", "span", "era").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("own", F.min(F.when(address, F.struct("at", t.alias("u")))).over(era))
    # A span's last message has seen its whole last era.
    spans = m.groupBy("session_id", "span").agg(F.count("*").alias("n"), F.max("era").alias("resets"), F.max_by("own", "at").alias("left"))
    later = Window.partitionBy("session_id").orderBy("span")
    spans = spans.withColumn("spell", F.sum(F.when(F.col("resets") > 0, 1).otherwise(0)).over(later.rowsBetween(Window.unboundedPreceding, 0)))
    spell = Window.partitionBy("session_id", "spell").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("after", F.first("left.u", ignorenulls=True).over(spell))
    spans = spans.select(
        "session_id", "span", F.lag("after").over(later).alias("before"), F.coalesce(F.sum("n").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("passed")
    )
    m = m.join(spans, ["session_id", "span"])
    brought = (F.col("era") == 0) & F.col("before").isNotNull()
    seed = F.when(brought, F.col("before")).otherwise(F.col("own.u"))
    action = (
        F.when(F.col("type") == "reset", "reset")
        .when((F.col("type") != "user_message") | (t == ""), "ignored")
        .when(seed.isNull(), "ask_url")
        .when(~brought & (F.col("own.at") == F.col("at")), "crawl")
        .otherwise("answer")
    )
    stage = F.when(seed.isNull(), AWAITING).otherwise(READY)
    return m.select("session_id", (F.col("passed") + F.col("at")).cast("bigint").alias("seq"), stage.alias("stage"), action.alias("action"), seed.alias("seed_url"))


class SessionProcessor(StatefulProcessor):
    """The same machine on a stream: a session's stage, address and count are its state.

    Messages of one batch are put in order of time; one that comes in a later batch than its successors counts when it comes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "stage string, seed string, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        stage, seed, seq = self.state.get() if self.state.exists() else (AWAITING, None, 0)
        batch = pd.concat([r[["ts", "type", "text"]] for r in rows]).sort_values(["ts", "type"], kind="stable")
        out = []
        for kind, text in zip(batch["type"], batch["text"]):
            seq += 1
            stage, seed, action = step(stage, seed, kind, text if isinstance(text, str) else None)
            out.append((key[0], seq, stage, action, seed))
        self.state.update((stage, seed, seq))
        yield pd.DataFrame(out, columns=["session_id", "seq", "stage", "action", "seed_url"])

    def close(self) -> None:
        pass


def stream(messages: DataFrame) -> DataFrame:
    """``replay`` of a streaming table of messages; needs the RocksDB state store.

    Exact copies within ``LATENESS`` of the newest message count once; later ones are messages again, as their first is forgotten.
    """
    messages = messages.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["session_id", "ts", "type", "text"])
    return messages.groupBy("session_id").transformWithStateInPandas(statefulProcessor=SessionProcessor(), outputStructType=EVENTS, outputMode="Update", timeMode="None")


# ---- frames: what goes over the wire

def safe_json(raw: Column) -> Column:
    """The value a JSON text stands for, NULL for any other text."""
    return F.try_parse_json(raw)


def parsed_frames(frames: DataFrame, column: str = "value") -> DataFrame:
    """``frames`` with ``type, text, valid``: both NULL where the frame or the field can't be read, ``valid`` false where the frame can't."""
    value = safe_json(F.col(column))
    field = lambda name: F.try_variant_get(value, f"$.{name}", "string").alias(name)
    return frames.select(*[c for c in frames.columns if c != column], field("type"), field("text"), F.coalesce(value.isNotNull(), F.lit(False)).alias("valid"))


def frames(messages: DataFrame, *columns: str) -> DataFrame:
    """``session_id, value``: each message as one JSON text of ``columns``; NULL fields are left out."""
    return messages.select("session_id", F.to_json(F.struct(*columns)).alias("value"))


def write_frames(messages: DataFrame, send: Callable[[str, str], None], checkpoint: str, columns: Sequence[str] = ("type", "text")) -> StreamingQuery:
    """Send the frames of a streaming table from the executors, ``send(session_id, frame)`` for each, in batches that start once a
    batch is complete. A batch that is repeated after a failure is sent again."""

    def deliver(batch: DataFrame, _: int) -> None:
        frames(batch, *columns).foreachPartition(lambda rows: [send(r["session_id"], r["value"]) for r in rows] and None)

    return messages.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()


# ---- the whole chat: preparing a site takes time and may fail, and providers rest

CRAWLING = "crawling"
#: Texts that a session sends (fixed values).
ASK_ADDRESS = "Paste the website URL you want me to learn (example: https://example.com)."
WAS_RESET = "Session reset. Paste the website URL you want me to learn."
PREPARING = "Still preparing. Please wait..."
BAD_FRAME = "Invalid message format."
THINKING = "Thinking..."
UNAVAILABLE = "External AI providers are currently rate-limited or unavailable. Falling back to local website-context answering."

#: State of a chat: stage, address, successful answers, and until when each provider rests.
CHAT_STATE = "stage string, seed string, answered bigint, resting map<string, timestamp>"
CHAT_EVENTS = "session_id string, ts timestamp, stage string, type string, text string, seed_url string, attempts array<string>"


def route(kind: str | None, text: str | None, valid: bool = True) -> str:
    """What a message is to a session: ``invalid``, ``reset``, ``text``, an outcome of its own work, or ``ignored``."""
    if not valid:
        return "invalid"
    if kind in ("reset", "prepared", "failed", "answered", "unanswered", "provider_failed"):
        return kind
    return "text" if kind == "user_message" and _BLANKS.sub("", text or "") else "ignored"


def chat_step(state: tuple, at: datetime, kind: str | None, text: str | None, names: Sequence[str], valid: bool = True, status: int | None = None) -> tuple[tuple, list[tuple]]:
    """``(state, messages)`` after one event; messages are ``(type, text, attempts)``.

    Events are messages of the user and outcomes of the work the session asked for: ``prepared`` and ``failed`` (text: the error)
    of a site, ``answered``, ``provider_failed`` (text: provider and message, apart by a colon) and ``unanswered`` (no provider
    succeeded; text: the answer from the site's own sentences) of an answer.
    """
    stage, seed, answered, resting = state
    what = route(kind, text, valid)
    bare = _BLANKS.sub("", text or "")
    say = lambda *texts: [(t, x, None) for t, x in texts]
    if what == "invalid":
        return state, say(("error", BAD_FRAME))
    if what == "reset":
        return (AWAITING, None, 0, {}), say(("assistant_message", WAS_RESET))
    if what == "text" and stage == AWAITING:
        return (CRAWLING, bare, answered, resting), [("crawl", bare, None)]
    if what == "text" and stage == CRAWLING:
        return state, say(("status", PREPARING))
    if what == "text":
        start = answered % len(names) if names else 0
        turned = [*names[start:], *names[:start]]
        awake = [p for p in turned if not (p in resting and resting[p] > at)]
        return state, [("status", THINKING, None), ("answer", bare, awake or turned)]
    if what == "prepared" and stage == CRAWLING:
        return (READY, seed, answered, resting), say(("assistant_message", text))
    if what == "failed" and stage == CRAWLING:
        return (AWAITING, None, 0, {}), say(("error", text), ("assistant_message", ASK_ADDRESS))
    if what == "answered" and stage == READY:
        return (stage, seed, answered + 1, resting), say(("assistant_message", text))
    if what == "unanswered" and stage == READY:
        return state, say(("status", UNAVAILABLE), ("assistant_message", text))
    if what == "provider_failed" and stage == READY:
        name, _, message = (text or "").partition(":")
        return (stage, seed, answered, {**resting, name: at + timedelta(seconds=providers.rest_of(status, message))}), []
    return state, []


class ChatProcessor(StatefulProcessor):
    """``chat_step`` on a stream of ``session_id, ts, type, text`` and, where they exist, ``valid`` and ``status``."""

    def __init__(self, names: Sequence[str]):
        self.names = tuple(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chat", CHAT_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (AWAITING, None, 0, {})
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for row in batch.to_dict("records"):
            text = row["text"] if isinstance(row["text"], str) else None
            status = row.get("status")
            state, said = chat_step(state, row["ts"].to_pydatetime(), row["type"], text, self.names, bool(row.get("valid", True)), int(status) if status == status and status is not None else None)
            out += [(key[0], row["ts"], state[0], kind, words, state[1], attempts) for kind, words, attempts in said]
        self.state.update(state)
        yield pd.DataFrame(out, columns=["session_id", "ts", "stage", "type", "text", "seed_url", "attempts"])

    def close(self) -> None:
        pass


def chat(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """What sessions say and ask for, from a streaming table of events; ``crawl`` and ``answer`` rows are work for others."""
    return events.groupBy("session_id").transformWithStateInPandas(statefulProcessor=ChatProcessor(names), outputStructType=CHAT_EVENTS, outputMode="Update", timeMode="None")
