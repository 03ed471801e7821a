"""Conflicts inside mappings: one right value for each left, by order or by votes, and confidence scores."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAP = "partition"


def exploded(maps: DataFrame) -> DataFrame:
    """(partition, l, r)."""
    return maps.select(MAP, F.explode("pairs").alias("p")).select(MAP, "p.l", "p.r")


def find_conflicts(rows: DataFrame) -> DataFrame:
    """(partition, l, rights) of lefts with more than one right."""
    return rows.groupBy(MAP, "l").agg(F.array_sort(F.collect_set("r")).alias("rights")).where(F.size("rights") > 1)


def resolve(rows: DataFrame) -> DataFrame:
    """(partition, l, r): each left keeps its largest right. Removing, again and again, the pair with the most conflicts (the smallest right of
    equals) ends there, for all rights of a left conflict equally."""
    return rows.groupBy(MAP, "l").agg(F.max("r").alias("r"))


def pair_support(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(partition, l, r, support): how many candidates of the partition hold the pair."""
    return parts.join(pairs, "cand").groupBy(MAP, "l", "r").agg(F.count("*").alias("support"))


def majority(rows: DataFrame, support: DataFrame) -> DataFrame:
    """(partition, l, r, support): each left keeps its best supported right, the smallest of equals; pairs without support count once."""
    s = rows.join(support, [MAP, "l", "r"], "left").withColumn("support", F.coalesce("support", F.lit(1)))
    w = Window.partitionBy(MAP, "l").orderBy(F.desc("support"), "r")
    return s.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def nested(rows: DataFrame, before: DataFrame) -> DataFrame:
    """(partition, pairs, size, num_conflicts_removed)."""
    kept = rows.groupBy(MAP).agg(F.array_sort(F.collect_list(F.struct("l", "r"))).alias("pairs"))
    was = before.groupBy(MAP).agg(F.count_distinct("l", "r").alias("was"))
    return kept.join(was, MAP).select(MAP, "pairs", F.size("pairs").alias("size"), (F.col("was") - F.size("pairs")).alias("num_conflicts_removed"))


def report(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count("*").alias("mappings"), F.count_if(F.col("num_conflicts_removed") > 0).alias("with_conflicts"), F.coalesce(F.sum("num_conflicts_removed"), F.lit(0)).alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("kept"))


def compare(rows: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Two resolvers over the same pairs: lefts, conflicting lefts, pairs kept by each, lefts on which they differ."""
    conflicts = find_conflicts(rows).select(MAP, "l", F.lit(1).alias("c"))
    j = a.select(MAP, "l", F.col("r").alias("ra")).join(b.select(MAP, "l", F.col("r").alias("rb")), [MAP, "l"], "full_outer").join(conflicts, [MAP, "l"], "left")
    return j.agg(F.count("*").alias("lefts"), F.coalesce(F.sum("c"), F.lit(0)).alias("conflicting"), F.count("ra").alias("kept_a"), F.count("rb").alias("kept_b"), F.count_if(~F.col("ra").eqNullSafe(F.col("rb"))).alias("disagreements"))


def confidence(rows: DataFrame, parts: DataFrame, cands: DataFrame, pairs: DataFrame, resolved: DataFrame | None = None, weights=(0.5, 0.3, 0.2), bonus: float = 1.0, penalty: float = 0.3) -> DataFrame:
    """(partition, l, r, support, avg_theta, survived, confidence): support relative to the partition's best, mean theta above 0.95 and whether
    the pair survived resolution, weighted and rounded to 4 places. Where a partition has no resolved pairs, all survive."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    seen = parts.join(pairs, "cand").join(cands.select("cand", "theta"), "cand").groupBy(MAP, "l", "r").agg(F.count("*").alias("support"), F.avg("theta").alias("avg_theta"))
    s = rows.join(seen, [MAP, "l", "r"], "left").withColumn("support", F.coalesce("support", F.lit(0))).withColumn("avg_theta", F.coalesce("avg_theta", F.lit(0.0)))
    if resolved is not None:
        some = resolved.select(MAP).distinct().withColumn("some", F.lit(True))
        s = s.join(resolved.select(MAP, "l", "r").withColumn("kept", F.lit(True)), [MAP, "l", "r"], "left").join(some, MAP, "left")
        s = s.withColumn("survived", F.col("some").isNull() | F.col("kept").isNotNull()).drop("kept", "some")
    else:
        s = s.withColumn("survived", F.lit(True))
    top = F.greatest(F.max("support").over(Window.partitionBy(MAP)), F.lit(1))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    raw = weights[0] * F.col("support") / top + weights[1] * clip((F.col("avg_theta") - 0.95) / 0.05) + weights[2] * F.when(F.col("survived"), bonus).otherwise(penalty)
    return s.withColumn("confidence", F.round(clip(raw), 4))


def confidence_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy(MAP).agg(F.count("*").alias("size"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def scored_mappings(scored: DataFrame) -> DataFrame:
    """(partition, size, avg_confidence, min_confidence, max_confidence, scored_pairs): each mapping's pairs by confidence, descending; pairs of equal
    confidence in order."""
    each = F.struct((-F.col("confidence")).alias("place"), "l", "r", "confidence", F.col("support").alias("support_count"), F.round("avg_theta", 4).alias("avg_theta"), F.col("survived").alias("survived_conflict"))
    kept = ("l", "r", "confidence", "support_count", "avg_theta", "survived_conflict")
    pairs = scored.groupBy(MAP).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.struct(*[x[k].alias(k) for k in kept])).alias("scored_pairs"))
    return confidence_summary(scored).join(pairs, MAP)


def confidence_bands(summary: DataFrame) -> DataFrame:
    band = F.when(F.col("avg_confidence") >= 0.8, "high").when(F.col("avg_confidence") >= 0.5, "medium").otherwise("low")
    return summary.groupBy(band.alias("band")).agg(F.count("*").alias("mappings"))


def preview(resolved: DataFrame, n: int = 8) -> DataFrame:
    short = F.forall("pairs", lambda p: (F.length(p["l"]) < 35) & (F.length(p["r"]) < 35))
    return resolved.where(F.col("size").between(3, 8) & short).orderBy(MAP).limit(n)


def distinct_mappings(maps: DataFrame) -> DataFrame:
    """How many mappings, pairs, distinct pair sets, and distinct sets regardless of direction."""
    flat = F.array_sort(F.array_distinct(F.transform("pairs", lambda p: F.struct(F.least(p["l"], p["r"]).alias("a"), F.greatest(p["l"], p["r"]).alias("b")))))
    return maps.agg(F.count("*").alias("mappings"), F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("pairs"), F.countDistinct(F.array_sort(F.array_distinct("pairs"))).alias("distinct_sets"), F.countDistinct(flat).alias("distinct_undirected"))
