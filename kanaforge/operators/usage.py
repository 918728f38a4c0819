"""Usage accounts: requests, words and tokens by kind and session, day and in total; costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["requests", "ok", "failures", "words", "chars", "prompt_tokens", "completion_tokens"]
KINDS = ("model", "free")


def clean(events: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Known kinds only; negative, missing and not-a-number counts become 0."""
    return events.where(F.col("kind").isin(*kinds)).select("ts", "session_id", "kind", *[F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias(c) for c in FIELDS])


def report(events: DataFrame, price: float, completion_price: float, kinds: tuple[str, ...] = KINDS, priced: str = "model") -> DataFrame:
    """(scope, bucket, kind, fields..., cost): a row for each session, day and in total of each kind, in one pass.

    Prices are for a million tokens that were sent and that came back."""
    rows = clean(events, kinds).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sums = rows.groupingSets([[F.col("kind"), F.col("session_id")], [F.col("kind"), F.col("day")], [F.col("kind")]], "kind", "session_id", "day").agg(*[F.sum(c).alias(c) for c in FIELDS], F.grouping("session_id").alias("_s"), F.grouping("day").alias("_d"))
    scope = F.when(F.col("_s") == 0, "session").when(F.col("_d") == 0, "day").otherwise("total")
    bucket = F.when(F.col("_s") == 0, F.col("session_id")).when(F.col("_d") == 0, F.col("day")).otherwise("all")
    cost = F.when(F.col("kind") == priced, (F.col("prompt_tokens") * price + F.col("completion_tokens") * completion_price) / 1e6).otherwise(0.0)
    return sums.select(scope.alias("scope"), bucket.alias("bucket"), "kind", *FIELDS, cost.alias("cost"))
