"""Evidence bundled by theme, without forming pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.retrieval import norm


def bundles(evidence: DataFrame, least: int = 2, kinds: int = 10) -> DataFrame:
    """(theme, n, coherence, coverage, consensus, stance) of the entities that `least` pieces of evidence share.

    evidence: (id, entities, v, relevance, kind, stance). Pieces without an entity have the theme `general`. Coherence is the
    mean cosine of all pairs, from the sum of the unit vectors alone: (|sum|^2 - m) / (m (m - 1)) for m vectors, 0.7 for fewer
    than two. Coverage is .7 mean relevance + .3 distinct kinds over `kinds`, at most 1; consensus the share of the commonest
    stance (absent: neutral; of equals the first by name). All of it are partial sums, whatever the size of a theme.
    """
    themes = F.when(F.size(F.coalesce("entities", F.array().cast("array<string>"))) > 0, F.array_distinct("entities")).otherwise(F.array(F.lit("general")))
    d = evidence.select("id", F.explode(themes).alias("theme"), F.transform("v", lambda x: x.cast("double")).alias("v"), "relevance", "kind", F.coalesce("stance", F.lit("neutral")).alias("stance"))
    units = d.withColumn("l", norm(F.col("v"))).where("l > 0").select("theme", F.posexplode(F.transform("v", lambda x: x / F.col("l"))).alias("i", "x"))
    sums = units.groupBy("theme", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("m")).groupBy("theme").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("m").alias("m"))
    votes = d.groupBy("theme", "stance").agg(F.count(F.lit(1)).alias("c")).groupBy("theme").agg(F.max("c").alias("most"), F.min_by("stance", F.struct(-F.col("c"), F.col("stance"))).alias("stance"))
    g = d.groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("relevance", F.lit(0.0))).alias("relevance"), F.count_distinct("kind").alias("kinds")).where(F.col("n") >= least)
    out = g.join(votes, "theme").join(sums, "theme", "left")
    coherence = F.when(F.coalesce(F.col("m"), F.lit(0)) > 1, (F.col("ss") - F.col("m")) / (F.col("m") * (F.col("m") - 1.0))).otherwise(0.7)
    return out.select("theme", "n", coherence.alias("coherence"), F.least(F.lit(1.0), 0.7 * F.col("relevance") + 0.3 * F.col("kinds") / kinds).alias("coverage"), (F.col("most") / F.col("n")).alias("consensus"), "stance")
