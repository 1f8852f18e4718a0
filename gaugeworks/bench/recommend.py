"""Scores of layouts: how much slower than the fastest, weighed by the workload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EXPECTED_WINNERS


def recommend(runs: DataFrame, mix: DataFrame, scale: str) -> DataFrame:
    """runs: scale, query, layout, median_ns; mix: query, weight. Rows of layout, score (1 is best), coverage of the mix.

    Weights of a query that the mix names more than once are added. A layout
    without a query's run is scored over the rest.
    """
    weights = mix.groupBy("query").agg(F.sum("weight").alias("weight"))
    total = weights.agg(F.sum("weight").alias("total"))
    rows = runs.filter(F.col("scale") == scale).join(F.broadcast(weights), "query")
    rows = rows.withColumn("slower", F.col("median_ns") / F.min("median_ns").over(Window.partitionBy("query")))
    scores = rows.groupBy("layout").agg((F.sum(F.col("weight") * F.col("slower")) / F.sum("weight")).alias("score"), F.sum("weight").alias("covered"))
    return scores.crossJoin(F.broadcast(total)).select("layout", "score", (F.col("covered") / F.col("total")).alias("coverage"))


def winner(scores: DataFrame) -> str:
    """The layout of the lowest score, ``none`` without any."""
    best = scores.orderBy("score", "layout").first()
    return best.layout if best else "none"


def winners(runs: DataFrame) -> DataFrame:
    """By scale and query the fastest layout, the runner-up, and whether the fastest was expected (null: nothing was)."""
    expected = runs.sparkSession.createDataFrame([(k, v) for k, v in EXPECTED_WINNERS.items()], "query string, expected array<string>")
    order = Window.partitionBy("scale", "query").orderBy("median_ns", "layout")
    ranked = runs.withColumn("rank", F.row_number().over(order)).withColumn("runner_up", F.lead("layout").over(order)).withColumn("runner_up_ns", F.lead("median_ns").over(order))
    best = ranked.filter("rank = 1").drop("rank").join(F.broadcast(expected), "query", "left")
    matches = F.when(F.size("expected") > 0, F.array_contains("expected", F.col("layout")))
    return best.select("scale", "query", F.col("layout").alias("winner"), "median_ns", "runner_up", "runner_up_ns", matches.alias("as_expected"))
