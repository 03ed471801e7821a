"""Co-occurrence of values in columns, NPMI, column coherence and the column filter."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.text import is_noise_value
from mapweave.operators.graph import checkpointed

COLUMN = ["table_idx", "col_idx"]
#: Scores of pairs that are sent to all executors at most (some 100 bytes each); beyond, the join is left to a shuffle.
BROADCAST_PAIRS = 200_000


def column_values(cells: DataFrame, skip_noise: bool = True) -> DataFrame:
    """(table_idx, col_idx, vals): sorted distinct non-empty values of each column, one row a column."""
    rows = cells.where("value IS NOT NULL AND value <> ''")
    if skip_noise:
        rows = rows.where(~is_noise_value(F.col("value")))
    # repeated values go before the shuffle: that takes plain hashing, where sets would be sorted
    return rows.select(*COLUMN, "value").distinct().groupBy(*COLUMN).agg(F.array_sort(F.collect_list("value")).alias("vals"))


def value_counts(columns: DataFrame) -> DataFrame:
    """(value, n_cols): in how many columns (with two values at least) a value occurs."""
    return columns.where(F.size("vals") >= 2).select(F.explode("vals").alias("value")).groupBy("value").agg(F.count("*").alias("n_cols"))


def total_columns(columns: DataFrame) -> DataFrame:
    return columns.where(F.size("vals") >= 2).agg(F.count("*").alias("n"))


def value_pairs(columns: DataFrame) -> DataFrame:
    """(table_idx, col_idx, u, v) with u < v, made inside each column's row: no join and no shuffle."""
    vals, i = F.col("vals"), F.col("i")
    first = columns.where(F.size("vals") >= 2).select(*COLUMN, "vals", F.posexplode("vals").alias("i", "u"))
    return first.where(i < F.size(vals) - 1).select(*COLUMN, "u", F.explode(F.expr("slice(vals, i + 2, size(vals))")).alias("v"))


def cooccurrence(columns: DataFrame) -> DataFrame:
    """(u, v, n): in how many columns two values occur together."""
    return value_pairs(columns).groupBy("u", "v").agg(F.count("*").alias("n"))


def npmi_column(n_uv, n_u, n_v, total):
    """Normalised pointwise mutual information, clipped to [-1, 1]; -1 where the pair never occurs."""
    p = n_uv / total
    raw = F.ln(p / ((n_u / total) * (n_v / total))) / -F.ln(p)
    return F.when(n_uv.isNull() | (n_uv == 0), -1.0).when(p >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def npmi(columns: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(u, v, n, npmi) for all pairs that occur. index: value and pair counts of the same columns, where they are kept."""
    (counts, pairs), total = index or (value_counts(columns), cooccurrence(columns)), total_columns(columns)
    x, y = counts.toDF("u", "n_u"), counts.toDF("v", "n_v")
    joined = pairs.join(x, "u").join(y, "v").crossJoin(F.broadcast(total.toDF("total")))  # one row
    return joined.select("u", "v", "n", npmi_column(F.col("n"), F.col("n_u"), F.col("n_v"), F.col("total")).alias("npmi"))


def coherence(cells: DataFrame, skip_noise: bool = True, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(table_idx, col_idx, score) for every column: the mean NPMI of its value pairs, -1 below two values."""
    columns = checkpointed(column_values(cells, skip_noise))  # used four times
    scores = checkpointed(npmi(columns, index).select("u", "v", "npmi"))
    scores = F.broadcast(scores) if scores.count() <= BROADCAST_PAIRS else scores  # else every column's pairs go through a shuffle
    scored = value_pairs(columns).join(scores, ["u", "v"]).groupBy(*COLUMN).agg(F.avg("npmi").alias("score"))
    return cells.select(*COLUMN).distinct().join(scored, COLUMN, "left").select(*COLUMN, F.coalesce("score", F.lit(-1.0)).alias("score"))


def keep_columns(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def rebuild(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(table_idx, kept_columns, kept_scores, rejected_columns) of tables with at least one column left."""
    each = F.struct("col_idx", "score")
    out = scored.groupBy("table_idx").agg(F.array_sort(F.collect_list(each)).alias("c"))
    kept, gone = F.filter("c", lambda x: x["score"] >= threshold), F.filter("c", lambda x: x["score"] < threshold)
    return out.select("table_idx", F.transform(kept, lambda x: x["col_idx"]).alias("kept_columns"), F.transform(kept, lambda x: x["score"]).alias("kept_scores"), F.transform(gone, lambda x: x["col_idx"]).alias("rejected_columns")).where(F.size("kept_columns") > 0)


def threshold_sweep(scored: DataFrame, thresholds=(0.1, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """(threshold, kept, removed, pct_kept): all thresholds in one pass."""
    sums = scored.agg(F.count("*").alias("n"), *[F.count_if(F.col("score") >= t).alias(f"k{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k{i}").alias("kept"), (F.col("n") - F.col(f"k{i}")).alias("removed"), F.round(F.when(F.col("n") > 0, 100.0 * F.col(f"k{i}") / F.col("n")).otherwise(0.0), 1).alias("pct_kept")) for i, t in enumerate(thresholds)]))
    return sums.select(rows.alias("r")).select("r.*")


def histogram(scored: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, n): columns by score in equal bins over [-1, 1]."""
    at = F.least(F.lit(bins - 1), F.floor((F.col("score") + 1) * bins / 2)).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def filtering_report(scored: DataFrame, threshold: float = 0.3, k: int = 5) -> DataFrame:
    """The k lowest removed and k highest kept columns with their ranks."""
    removed, kept = scored.where(F.col("score") < threshold), keep_columns(scored, threshold)
    low = removed.orderBy("score", *COLUMN).limit(k).withColumn("kind", F.lit("removed"))
    high = kept.orderBy(F.desc("score"), *COLUMN).limit(k).withColumn("kind", F.lit("kept"))
    sign = F.when(F.col("kind") == "kept", -F.col("score")).otherwise(F.col("score"))
    return low.union(high).withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(sign, *COLUMN)))


def top_pairs(columns: DataFrame, k: int = 20) -> DataFrame:
    return cooccurrence(columns).orderBy(F.desc("n"), "u", "v").limit(k)


def corpus_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.countDistinct("table_idx").alias("tables"), F.countDistinct(*COLUMN).alias("columns"), F.countDistinct("value").alias("unique_values"))
