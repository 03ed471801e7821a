"""The read-only views of a results server, as queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_tables(tables: DataFrame, lines: int = 15, most: int = 4) -> DataFrame:
    """(table_idx, num_cols, num_rows, hint): up to `most` of the first `lines` tables with two columns; hint is the first of the first columns
    whose values (two at least) are all distinct, and which another follows."""
    first = tables.orderBy("table_idx").limit(lines).where(F.size("columns") >= 2).orderBy("table_idx").limit(most)
    shown = F.slice("columns", 1, 4)
    unique = F.transform(shown, lambda c, i: F.when((i < F.size(shown) - 1) & (F.size(F.filter(c, lambda v: v != "")) >= 2) & (F.size(F.array_distinct(F.filter(c, lambda v: v != ""))) == F.size(F.filter(c, lambda v: v != ""))), i))
    return first.select("table_idx", F.size("columns").alias("num_cols"), F.size(F.col("columns")[0]).alias("num_rows"), F.get(F.filter(unique, lambda x: x.isNotNull()), F.lit(0)).alias("hint"))


def extraction(rebuilt: DataFrame, cands: DataFrame) -> DataFrame:
    """Totals of tables, columns before and after the filter, and candidates."""
    a = rebuilt.agg(F.count("*").alias("tables"), F.coalesce(F.sum(F.size("kept_columns")), F.lit(0)).alias("columns_after"), F.coalesce(F.sum(F.size("rejected_columns")), F.lit(0)).alias("columns_removed"))
    b = cands.agg(F.count("*").alias("candidates"))
    return a.crossJoin(b).withColumn("columns_before", F.col("columns_after") + F.col("columns_removed"))  # a row each


def kept_examples(scored: DataFrame, cells: DataFrame, threshold: float = 0.3, k: int = 3, values: int = 5) -> DataFrame:
    """(kind, table_idx, col_idx, score, examples): of the kept and of the removed columns the first k by place, with their first values."""
    mark = scored.withColumn("kind", F.when(F.col("score") >= threshold, "kept").otherwise("removed"))
    first = mark.where("kind = 'kept'").orderBy("table_idx", "col_idx").limit(k).union(mark.where("kind = 'removed'").orderBy("table_idx", "col_idx").limit(k))
    head = cells.join(F.broadcast(first.select("table_idx", "col_idx")), ["table_idx", "col_idx"], "left_semi")  # 2 * k rows
    head = head.groupBy("table_idx", "col_idx").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), 1, values), lambda x: x["value"]).alias("examples"))
    return first.join(head, ["table_idx", "col_idx"]).select("kind", "table_idx", "col_idx", "score", "examples")


def candidate_examples(cands: DataFrame, k: int = 5, pairs: int = 3) -> DataFrame:
    """(cand, theta, sample): the first k candidates with their first pairs."""
    return cands.orderBy("cand").limit(k).select("cand", "theta", F.slice("pairs", 1, pairs).alias("sample"))


def resolution(resolved: DataFrame) -> DataFrame:
    """Totals of mappings, of those that lost pairs, and of the pairs lost."""
    lost = F.col("num_conflicts_removed")
    return resolved.agg(F.count("*").alias("total_mappings"), F.count_if(lost > 0).alias("mappings_with_conflicts"), F.coalesce(F.sum(lost), F.lit(0)).alias("total_pairs_removed"))


def resolved_largest(resolved: DataFrame, k: int = 5, pairs: int = 3) -> DataFrame:
    """(partition, size, num_conflicts_removed, sample): the k largest resolved mappings."""
    return resolved.orderBy(F.desc("size"), "partition").limit(k).select("partition", "size", "num_conflicts_removed", F.slice("pairs", 1, pairs).alias("sample"))


def synthesis(maps: DataFrame) -> DataFrame:
    single = F.count_if(F.col("num_source_tables") == 1)
    return maps.agg(F.count("*").alias("total"), single.alias("singletons"), (F.count("*") - single).alias("multi"), F.round(F.coalesce(F.avg("size"), F.lit(0.0)), 1).alias("avg_pairs"))


def largest(maps: DataFrame, k: int = 6) -> DataFrame:
    return maps.orderBy(F.desc("size"), "partition").limit(k)


def conflict_examples(before: DataFrame, after: DataFrame, k: int = 4) -> DataFrame:
    """(partition, l, r): pairs that resolution removed, of the first k mappings that lost any."""
    gone = before.select("partition", "l", "r").distinct().join(after.select("partition", "l", "r"), ["partition", "l", "r"], "left_anti")
    first = gone.select("partition").distinct().orderBy("partition").limit(k)
    return gone.join(F.broadcast(first), "partition", "left_semi")
