"""Best fuzzy match of distinct keys against a catalog of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio, sort_tokens


def best_match(keys: DataFrame, candidates: DataFrame, floor: int = 80) -> DataFrame:
    """(key, candidate, score) for the keys whose best token-sorted ratio reaches the floor.

    keys: distinct key; candidates: distinct candidate with pos, which breaks ties (smallest first).
    A score of the floor or more bounds the distance by the longer length, hence the difference of
    lengths: keys and candidates meet by length instead of all with all.
    """
    slack = 1 - (floor - 0.5) / 100
    k = keys.select("key", sort_tokens(F.col("key")).alias("ks")).withColumn("kn", F.length("ks"))
    c = candidates.select("candidate", "pos", sort_tokens(F.col("candidate")).alias("cs")).withColumn("n", F.length("cs"))
    shortest, longest = F.ceil(F.col("kn") * (1 - slack)), F.floor(F.col("kn") / (1 - slack))
    k = k.withColumn("n", F.explode(F.sequence(shortest.cast("int"), longest.cast("int"))))
    scored = k.join(c, "n").withColumn("score", ratio(F.col("ks"), F.col("cs"))).where(F.col("score") >= floor)
    best = scored.groupBy("key").agg(F.max_by(F.struct("candidate", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("key", "b.candidate", "b.score")
