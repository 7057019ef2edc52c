"""BLEU as counts of n-grams: no row is scored on its own, counts are added up over a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Share of a hit that stands for none, so that its logarithm exists.
SMOOTHING = 0.1


def gram_counts(pairs: DataFrame, key: str, pred: str, gt: str, longest: int = 4) -> DataFrame:
    """``key``, n, gram and how often it stands in either text; n from 1 to ``longest``."""
    sides = pairs.select(key, F.inline(F.array(F.struct(F.lit(1).alias("is_pred"), T.words(F.col(pred)).alias("w")), F.struct(F.lit(0).alias("is_pred"), T.words(F.col(gt)).alias("w")))))
    sized = sides.select(key, "is_pred", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.size("w") >= F.col("n"))
    grams = sized.select(key, "is_pred", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("gram"))
    return grams.groupBy(key, "n", "gram").agg(F.sum("is_pred").alias("pred"), F.sum(1 - F.col("is_pred")).alias("gt"))


def bleu_scores(pairs: DataFrame, key: str, pred: str, gt: str) -> DataFrame:
    """``key`` (unique in ``pairs``) and ``bleu``: 4-gram BLEU in percent over white-space words, smoothed; 0 if a side is empty or no word matches.

    Null texts count as empty. A gram that a text repeats a million times is one row after the partial count.
    """
    counts = gram_counts(pairs, key, pred, gt)
    by_n = counts.groupBy(key, "n").agg(F.sum(F.least("pred", "gt")).alias("hits"), F.sum("pred").alias("pred"), F.sum("gt").alias("gt"))
    log = F.log(F.when(F.col("hits") > 0, F.col("hits").cast("double")).otherwise(SMOOTHING) / F.greatest("pred", F.lit(1)))
    at = lambda n, c: F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0))
    # a length that neither text reaches has no row: no hit of one
    summed = by_n.groupBy(key).agg(F.sum(log).alias("logs"), F.count("*").alias("ns"), at(1, F.col("hits")).alias("matched"), at(1, F.col("pred")).alias("p"), at(1, F.col("gt")).alias("g"))
    logs = F.col("logs") + (4 - F.col("ns")) * F.log(F.lit(SMOOTHING))
    brevity = F.when(F.col("p") > F.col("g"), F.lit(1.0)).otherwise(F.exp(1 - F.col("g") / F.col("p")))
    score = F.when((F.col("p") > 0) & (F.col("g") > 0) & (F.col("matched") > 0), F.round(100 * brevity * F.exp(logs / 4) + F.lit(1e-9), 2)).otherwise(F.lit(0.0))
    return pairs.select(key).join(summed.select(key, score.alias("bleu")), key, "left").select(key, F.coalesce("bleu", F.lit(0.0)).alias("bleu"))
