"""Precision and recall against gold pairs, coverage of gold pairs by a corpus, and samples that keep a cover."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.text import unordered


def undirected(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct pairs without direction; equal sides go."""
    return pairs.select(unordered(F.col("l"), F.col("r")).alias("p")).where("p IS NOT NULL").select("p.a", "p.b").distinct()


def gold_pairs(pairs: DataFrame) -> DataFrame:
    return undirected(pairs.where("l <> '' AND r <> ''"))


def values_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()


def _both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    return pairs.join(values.toDF("a"), "a", "left_semi").join(values.toDF("b"), "b", "left_semi").select("a", "b")


def _ratio(x, y):
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def evaluate(gold: DataFrame, predicted: DataFrame, cells: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """One row of counts and ratios: global, achievable (both values are in the corpus), covered and scoped (both values are in the gold set)."""
    g, p = gold_pairs(gold), undirected(predicted)
    corpus = cells.where("value <> ''").select(F.col("value").alias("v")).distinct()
    scoped = _both(p, values_of(g))
    # every pair once with its memberships: one union and one aggregate instead of many joins
    tag = lambda df, name: df.select("a", "b", F.lit(name).alias("k"))
    parts = tag(g, "g").union(tag(p, "p")).union(tag(_both(g, corpus), "ach")).union(tag(scoped, "sc"))
    if covered is not None:
        parts = parts.union(tag(gold_pairs(covered), "cov"))
    m = parts.groupBy("a", "b").agg(*[F.bool_or(F.col("k") == k).alias(k) for k in ("g", "p", "ach", "sc", "cov")])
    n = {f"n_{'_'.join(ks)}": F.count_if(F.expr(" AND ".join(ks))) for ks in (("g",), ("p",), ("p", "g"), ("ach",), ("p", "ach"), ("cov",), ("p", "cov"), ("sc",), ("sc", "g"), ("sc", "ach"))}
    out = m.agg(*[v.alias(k) for k, v in n.items()])
    c = F.col
    out = out.withColumn("precision", _ratio(c("n_p_g"), c("n_p"))).withColumn("recall", _ratio(c("n_p_g"), c("n_g"))).withColumn("f1", _f1(c("precision"), c("recall")))
    out = out.withColumn("achievable_recall", _ratio(c("n_p_ach"), c("n_ach"))).withColumn("covered_recall", _ratio(c("n_p_cov"), c("n_cov"))).withColumn("scoped_precision", _ratio(c("n_sc_g"), c("n_sc")))
    return out.withColumn("scoped_f1", _f1(_ratio(c("n_sc_ach"), c("n_sc")), _ratio(c("n_sc_ach"), c("n_ach"))))


def coverage(gold: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b, status): covered if both values occur in one row, split if both occur at all, else absent."""
    g = gold_pairs(gold)
    rows = cells.where("value <> ''").select("table_idx", "row_idx", F.col("value").alias("v")).join(values_of(g), "v", "left_semi").select("table_idx", "row_idx", "v").distinct()
    met = g.join(rows.toDF("t", "i", "a"), "a").join(rows.toDF("t", "i", "b"), ["b", "t", "i"]).select("a", "b").distinct().withColumn("met", F.lit(True))
    seen = _both(g, rows.select("v").distinct()).withColumn("seen", F.lit(True))
    out = g.join(met, ["a", "b"], "left").join(seen, ["a", "b"], "left")
    return out.select("a", "b", F.when(F.col("met"), "covered").when(F.col("seen"), "split").otherwise("absent").alias("status"))


def cover_tables(gold: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_idx, pairs): tables with a row that holds both sides of a gold pair, and how many such pairs."""
    g = gold_pairs(gold)
    rows = cells.where("value <> ''").select("table_idx", "row_idx", F.col("value").alias("v")).join(values_of(g), "v", "left_semi").select("table_idx", "row_idx", "v").distinct()
    met = g.join(rows.toDF("t", "i", "a"), "a").join(rows.toDF("t", "i", "b"), ["b", "t", "i"])
    return met.groupBy(F.col("t").alias("table_idx")).agg(F.countDistinct("a", "b").alias("pairs"))


def table_keys(tables: DataFrame) -> DataFrame:
    """The tables with `key`, the digest of their columns as JSON, which identifies equal tables whatever their cells hold."""
    return tables.withColumn("key", F.md5(F.to_json("columns", {"ignoreNullFields": "false"})))


def covered_sample(cover: DataFrame, tables: DataFrame, n: int) -> DataFrame:
    """(table_idx, key, source): all cover tables, and filler tables with other contents in order of key, up to n tables together."""
    own = cover.select("table_idx", "key", F.lit("cover").alias("source"))
    room = own.agg(F.greatest(F.lit(0), F.lit(n) - F.count("*")).alias("room"))
    filler = tables.join(cover.select("key").distinct(), "key", "left_anti").orderBy("key", "table_idx").limit(n)
    ranked = filler.select("table_idx", "key").withColumn("i", F.row_number().over(_by_key())).crossJoin(F.broadcast(room))  # one row
    return own.union(ranked.where("i <= room").select("table_idx", "key", F.lit("filler").alias("source")))


def _by_key():
    from pyspark.sql import Window

    return Window.orderBy("key", "table_idx")  # over n rows at most
