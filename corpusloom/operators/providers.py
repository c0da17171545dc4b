"""Answer providers: rotation, failover, reasons and cooldowns as plans over outcome rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a provider rests, by kind of failure (fixed values).
RATE_LIMIT_REST, SETUP_REST, OTHER_REST = 600, 900, 120
SETUP_WORDS = "(?i)quota|credit balance|billing|model .*not found|api key|invalid_request_error"
#: Attempts of one key are gathered by this span of time.
SPAN = "hour"
RATE_WORDS = "(?i)rate limit|too many requests|429"


def is_rate_limit(status: Column, message: Column) -> Column:
    return F.coalesce(status == 429, F.lit(False)) | F.coalesce(message.rlike(RATE_WORDS), F.lit(False))


def rest_seconds(status: Column, message: Column) -> Column:
    """How long a failed provider is left alone."""
    return F.when(is_rate_limit(status, message), RATE_LIMIT_REST).when(F.coalesce(message.rlike(SETUP_WORDS), F.lit(False)), SETUP_REST).otherwise(OTHER_REST)


def rest_of(status: int | None, message: str | None) -> int:
    """``rest_seconds`` of one failure at hand."""
    text = message or ""
    if status == 429 or re.search(RATE_WORDS, text):
        return RATE_LIMIT_REST
    return SETUP_REST if re.search(SETUP_WORDS, text) else OTHER_REST


def rotated(providers: Column, start: Column) -> Column:
    """The list begun at ``start``, counted round in either direction."""
    n = F.size(providers)
    i = F.pmod(start, F.greatest(n, F.lit(1)))
    return F.when(n == 0, providers).otherwise(F.concat(F.slice(providers, i + 1, F.greatest(n, F.lit(1))), F.slice(providers, F.lit(1), i)))


def attempt_order(providers: Column, resting: Column) -> Column:
    """The providers that don't rest; all of them if every one does."""
    awake = F.filter(providers, lambda p: ~F.array_contains(resting, p))
    return F.when(F.size(awake) > 0, awake).otherwise(providers)


def failover(outcomes: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """What ordered attempts lead to, by ``keys``: runs of failures end with the next success.

    Successes are counted by spans of time and within them, so that no key's attempts are gathered in one task.

    ``keys, run, provider`` (of the success, NULL if none came), ``had_to_fallback, fallback_reason`` (of the last failure),
    ``failures`` (a text ``provider: message`` for each, joined).
    """
    timed = outcomes.withColumn("span", F.date_trunc(SPAN, "ts"))
    earlier = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = timed.groupBy(*keys, "span").agg(F.count_if("ok").alias("n")).select(*keys, "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("passed"))
    order = Window.partitionBy(*keys, "span").orderBy("ts", "outcome_id")
    run = F.col("passed") + F.coalesce(F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outcomes = timed.join(spans, [*keys, "span"])
    kind = F.when(is_rate_limit(F.col("status"), F.col("message")), "rate_limit").otherwise("error")
    rows = outcomes.withColumn("run", run).withColumn("kind", kind)
    failed = F.filter(F.array_sort(F.collect_list(F.struct("ts", "outcome_id", "ok", "provider", F.coalesce("message", F.lit("")).alias("message"), "kind"))), lambda x: ~x["ok"])
    grouped = rows.groupBy(*keys, "run").agg(F.max(F.when(F.col("ok"), F.col("provider"))).alias("provider"), failed.alias("f"))
    return grouped.select(
        *keys, F.col("run").cast("bigint").alias("run"), "provider", (F.size("f") > 0).alias("had_to_fallback"),
        F.when(F.size("f") > 0, F.element_at("f", -1)["kind"]).alias("fallback_reason"),
        F.array_join(F.transform("f", lambda x: F.concat(x["provider"], F.lit(": "), x["message"])), " | ").alias("failures"),
    )


def cooldowns(outcomes: DataFrame) -> DataFrame:
    """``session_id, provider, until``: when each provider's last rest ends."""
    failed = outcomes.where("not ok").withColumn("until", F.col("ts") + F.make_dt_interval(secs=rest_seconds(F.col("status"), F.col("message")).cast("decimal(18,6)")))
    return failed.groupBy("session_id", "provider").agg(F.max_by("until", F.struct("ts", "outcome_id")).alias("until"))


def active(cooldowns: Column, now: Column) -> Column:
    """The providers of a map ``provider -> until`` that still rest at ``now``, in order of name."""
    return F.array_sort(F.map_keys(F.map_filter(cooldowns, lambda _, until: until > now)))


#: The providers in the order they are tried, and what each needs (fixed values).
PROVIDERS = {"openrouter": "OPENROUTER_API_KEY", "gemini": "GOOGLE_API_KEY", "groq": "GROQ_API_KEY", "ollama": "OLLAMA_BASE_URL"}


def available(settings: dict[str, str | None]) -> list[str]:
    """The providers whose key is set; the local one has an address by default."""
    known = {"OLLAMA_BASE_URL": "http://localhost:11434", **settings}
    return [p for p, need in PROVIDERS.items() if known.get(need)]


#: An error text is cut to so many characters.
SNIPPET = 240


def error_message(body: Column) -> Column:
    """What an error body says: its ``error`` text, ``error.message``, ``message``, or else its beginning."""
    parsed = F.try_parse_json(body)
    text = F.trim(F.coalesce(body, F.lit("")))
    string = lambda path: F.when(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING", F.try_variant_get(parsed, path, "string"))
    snippet = F.when(F.length(text) > SNIPPET, F.concat(F.substring(text, 1, SNIPPET), F.lit("..."))).otherwise(text)
    return F.when(text == "", "Empty error response").otherwise(F.coalesce(string("$.error"), string("$.error.message"), string("$.message"), snippet))


def failure_report(checks: DataFrame) -> DataFrame:
    """``provider, checks, failures, exit_code`` of rows ``provider, ok``."""
    failures = F.count_if(~F.col("ok"))
    return checks.groupBy("provider").agg(F.count("*").alias("checks"), failures.alias("failures"), (failures > 0).cast("int").alias("exit_code"))


def call_with_fallback(call: Callable[[str], str], providers: Sequence[str], start: int = 0, resting: Sequence[str] = ()) -> tuple[str, str, list[tuple[str, str]]]:
    """``(provider, text, failures)`` of the first provider whose call succeeds; raises if none does."""
    n = len(providers)
    turned = [providers[(start + i) % n] for i in range(n)]
    failures: list[tuple[str, str]] = []
    for p in [p for p in turned if p not in set(resting)] or turned:
        try:
            return p, call(p), failures
        except Exception as error:  # noqa: BLE001  # any failure of a provider leads to the next
            failures.append((p, str(error)))
    raise RuntimeError("no provider succeeded: " + " | ".join(f"{p}: {m}" for p, m in failures))
