"""Documents as segments, their metering and budgets, and first-seen distinct segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import FREE_CHARS
from vellum.functions import text as T


def bodies(text: Column) -> Column:
    """The translatable lines of a text in order, trimmed, as array<struct<pos,body>>."""
    numbered = F.transform(T.lines(text), lambda line, i: F.struct(i.alias("pos"), T.trim(line).alias("body")))
    return F.filter(numbered, lambda s: T.translatable(s["body"]))


def segments(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each segment of each row of df, with pos and body; other columns but the text stay."""
    return df.select(*[c for c in df.columns if c != text], F.inline(bodies(F.col(text))))


def meter(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of segments and of their code points of each row. Nothing is shuffled."""
    metered = df.withColumn("_bodies", bodies(F.col(text)))
    chars = F.aggregate("_bodies", F.lit(0).cast("long"), lambda n, s: n + F.char_length(s["body"]))
    return metered.withColumn("segments", F.size("_bodies").cast("long")).withColumn("chars", chars).drop("_bodies")


def budget_gate(metered: DataFrame, left: Column | int = FREE_CHARS) -> DataFrame:
    """Verdict before any request is sent: over if a job has more characters than are left, empty if it has none."""
    left = F.lit(left) if isinstance(left, int) else left
    return metered.withColumn("verdict", F.when(F.col("segments") == 0, "empty").when(F.col("chars") > left, "over").otherwise("pass"))


def unique(segs: DataFrame, job: list[str], at: list[str]) -> DataFrame:
    """Distinct bodies of each job with their number and first place; at: the columns that order segments."""
    return segs.groupBy(*job, "body").agg(F.count("*").alias("copies"), F.min(F.struct(*at)).alias("first")).select(*job, "body", "copies", "first.*")


def expand(segs: DataFrame, translated: DataFrame, job: list[str]) -> DataFrame:
    """Each segment with the translation of its body; a body without one keeps its text."""
    done = translated.select(*job, "body", F.col("translated").alias("_translated"))
    return segs.join(done, [*job, "body"], "left").withColumn("translated", F.coalesce("_translated", "body")).drop("_translated")
