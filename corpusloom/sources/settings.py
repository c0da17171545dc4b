"""Settings and key files."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a label in a key file may be called (fixed values).
LABELS = {"openrouter": "openrouter", "open router": "openrouter", "gemini": "google", "google": "google", "google gemini": "google", "groq": "groq"}
#: Settings in the environment, and keys, which only the key file may supply (fixed values).
VARIABLES = {"CRAWL_MAX_DEPTH": "max_depth", "CRAWL_MAX_PAGES": "max_pages", "CRAWL_TIMEOUT_MS": "timeout_ms", "CRAWL_CONCURRENCY": "concurrency", "PORT": "port"}
KEY_VARIABLES = {"openrouter": "OPENROUTER_API_KEY", "google": "GOOGLE_API_KEY", "groq": "GROQ_API_KEY"}
DEFAULTS = {
    "OPENROUTER_MODEL": "openrouter/auto", "OPENROUTER_BASE_URL": "https://openrouter.ai/api/v1", "GEMINI_MODEL": "gemini-2.5-flash", "GROQ_MODEL": "llama-3.3-70b-versatile",
    "GROQ_BASE_URL": "https://api.groq.com/openai/v1", "OLLAMA_BASE_URL": "http://localhost:11434", "OLLAMA_MODEL": "qwen2.5-coder:7b",
}


@dataclass(frozen=True)
class Settings:
    """Limits of a crawl, with their defaults."""

    max_depth: int = 3
    max_pages: int = 100
    timeout_ms: int = 12_000
    concurrency: int = 4
    port: int = 3000

    @staticmethod
    def of(values: dict[str, str]) -> Settings:
        """Settings from text values; each must be a whole number above 0."""
        chosen = {}
        for f in fields(Settings):
            if f.name in values:
                number = float(values[f.name])
                if number != int(number) or number < 1:
                    raise ValueError(f"{f.name} must be a whole number above 0")
                chosen[f.name] = int(number)
        return Settings(**chosen)


def of_environment(environment: dict[str, str], keys: dict[str, str] | None = None) -> tuple[Settings, dict[str, str]]:
    """The crawl's settings and all other text settings, from an environment and the keys of a key file.

    Key variables of the environment are dropped: keys come from ``keys`` (``provider -> value``, as ``read_keys`` gives) alone.
    """
    own = {VARIABLES[k]: v for k, v in environment.items() if k in VARIABLES}
    texts = {**DEFAULTS, **{k: v for k, v in environment.items() if k in DEFAULTS}}
    return Settings.of(own), {**texts, **{KEY_VARIABLES[p]: v for p, v in (keys or {}).items() if p in KEY_VARIABLES}}


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """``provider, value`` of a key file with lines ``label - value``; unknown labels are left out, the last line of a label counts."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    parts = lines.select("n", F.lower(F.trim(F.split("value", " - ", 2)[0])).alias("label"), F.trim(F.get(F.split("value", " - ", 2), F.lit(1))).alias("value"))
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return parts.withColumn("provider", F.try_element_at(names, F.col("label"))).where("provider is not null and value != ''").groupBy("provider").agg(F.max_by("value", "n").alias("value"))
