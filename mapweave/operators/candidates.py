"""Approximate functional dependencies between columns, and the rules that drop uninformative candidates.

A candidate's id is its number in the order of (table, left column, right column), found without a task that sees all candidates.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions import text as T
from mapweave.operators.graph import numbered

DEPENDENCY = ["table_idx", "left_col", "right_col"]


def column_pairs(cells: DataFrame) -> DataFrame:
    """(table_idx, left_col, right_col, row_idx, x, y) for all pairs of columns, the smaller first, and rows with both values; one shuffle, by
    table, after which nothing about a table needs another."""
    rows = cells.where("value IS NOT NULL AND value <> ''").repartition("table_idx").groupBy("table_idx", "row_idx").agg(F.collect_list(F.struct("col_idx", "value")).alias("c"))
    left = rows.select("table_idx", "row_idx", "c", F.explode("c").alias("a")).select("table_idx", "row_idx", "a", F.explode("c").alias("b"))
    return left.where("a.col_idx < b.col_idx").select("table_idx", F.col("a.col_idx").alias("left_col"), F.col("b.col_idx").alias("right_col"), "row_idx", F.col("a.value").alias("x"), F.col("b.value").alias("y"))


def witnesses(cells: DataFrame) -> DataFrame:
    """For each left value of a column pair, in both directions, its most frequent right value (the first seen of equals): x, y, cnt, rows_x,
    first_row (of x), low_y and high_y (its smallest and largest right value)."""
    once = column_pairs(cells).groupBy(*DEPENDENCY, "x", "y").agg(F.count("*").alias("cnt"), F.min("row_idx").alias("seen"))
    turned = F.struct(F.col("right_col").alias("left_col"), F.col("left_col").alias("right_col"), F.col("y").alias("x"), F.col("x").alias("y"))
    counts = once.select("table_idx", "cnt", "seen", F.explode(F.array(F.struct("left_col", "right_col", "x", "y"), turned)).alias("p")).select("table_idx", "p.*", "cnt", "seen")
    best = F.max_by(F.struct("y", "cnt"), F.struct("cnt", (-F.col("seen")).alias("s")))
    return counts.groupBy(*DEPENDENCY, "x").agg(best.alias("w"), F.sum("cnt").alias("rows_x"), F.min("seen").alias("first_row"), F.min("y").alias("low_y"), F.max("y").alias("high_y")).select(*DEPENDENCY, "x", "w.y", "w.cnt", "rows_x", "first_row", "low_y", "high_y")


def approximate_fds(cells: DataFrame, min_rows: int = 3) -> DataFrame:
    """(table_idx, left_col, right_col, theta, row_count, covered_rows, pairs) for all column pairs that meet the minima; pairs in order of first rows."""
    pair = F.struct("first_row", F.col("x").alias("l"), F.col("y").alias("r"))
    out = witnesses(cells).groupBy(*DEPENDENCY).agg(F.sum("rows_x").alias("row_count"), F.sum("cnt").alias("covered_rows"), F.count("*").alias("n_x"), (F.min("low_y") < F.max("high_y")).alias("two_y"), F.array_sort(F.collect_list(pair)).alias("p"))
    out = out.where((F.col("row_count") >= min_rows) & (F.col("n_x") >= 2) & F.col("two_y"))
    pairs = F.transform("p", lambda z: F.struct(z["l"].alias("l"), z["r"].alias("r")))
    return out.select(*DEPENDENCY, (F.col("covered_rows") / F.col("row_count")).alias("theta"), "row_count", "covered_rows", pairs.alias("pairs"))


def candidates(cells: DataFrame, theta: float = 0.95, min_rows: int = 3) -> DataFrame:
    found = approximate_fds(cells, min_rows).where(F.col("theta") >= theta)
    return numbered(found, DEPENDENCY, "cand")


def explode_pairs(cands: DataFrame) -> DataFrame:
    """(cand, pos, l, r)."""
    return cands.select("cand", F.posexplode("pairs").alias("pos", "p")).select("cand", "pos", "p.l", "p.r")


def _runs(values, low, high, n, distinct):
    """Whether values are a run of consecutive integers without repeats."""
    return values & (high - low + 1 == n) & (distinct == n)


def noise_reasons(pairs: DataFrame) -> DataFrame:
    """(cand, reason): the first rule that holds for all pairs of a candidate, null for those to keep. One pass over (cand, l, r)."""
    l, r = F.col("l"), F.col("r")
    both = lambda f: F.bool_and(f(l) & f(r))
    either = lambda f: F.bool_and(f(l) | f(r))
    as_int = lambda c: F.when(T.strip(c).rlike(r"^[+-]?\d{1,18}$"), F.regexp_replace(T.strip(c), r"^\+", "").try_cast("long"))
    named = [
        ("identity", F.bool_and(l == r)),
        ("int->int", both(T.is_number)),
        ("rank->rank", both(T.is_integer)),
        ("hex_pair", both(T.is_hex)),
        ("placeholder_dominated", either(T.is_placeholder)),
        ("numeric_string", either(T.is_numeric_string)),
        ("currency_value", either(T.is_currency)),
        ("number_dominated", either(T.is_number_dominated)),
        ("boolean_pair", either(T.is_boolean)),
        ("uuid_pair", either(T.is_uuid)),
        ("url_or_path", either(T.is_url_or_path)),
        ("repeated_char", either(T.is_repeated_char)),
    ]
    sides = [agg(f(c)).alias(f"{name}_{side}") for side, c in (("l", l), ("r", r)) for name, f, agg in (("all", lambda x: as_int(x).isNotNull(), F.bool_and), ("low", as_int, F.min), ("high", as_int, F.max))]
    found = pairs.groupBy("cand").agg(*[x.alias(f"k{i}") for i, (_, x) in enumerate(named)], F.count("*").alias("n"), F.countDistinct("l").alias("nl"), F.countDistinct("r").alias("nr"), F.countDistinct(as_int(l)).alias("il"), F.countDistinct(as_int(r)).alias("ir"), *sides)
    run = {s: _runs(F.col(f"all_{s}"), F.col(f"low_{s}"), F.col(f"high_{s}"), F.col("n"), F.col(f"i{s}")) for s in "lr"}
    ranks = F.col("k2") & (F.col("n") >= 3) & run["l"] & run["r"] & F.col("low_l").isin(0, 1) & F.col("low_r").isin(0, 1)
    reason = F.when(F.col("n") == 0, "empty")
    for i, (name, _) in enumerate(named):
        reason = reason.when(ranks if name == "rank->rank" else F.col(f"k{i}"), name)
    reason = reason.when((F.col("nl") == 1) | (F.col("nr") == 1), "constant_pair").when(run["l"] & run["r"], "index_offset_pair")
    return found.select("cand", reason.alias("reason"))


def drop_noise(cands: DataFrame) -> DataFrame:
    """Candidates no rule drops; those without pairs are dropped, too."""
    kept = noise_reasons(explode_pairs(cands)).where("reason IS NULL").select("cand")
    return cands.join(kept, "cand", "left_semi")


def noise_counts(pairs: DataFrame) -> DataFrame:
    return noise_reasons(pairs).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def summary(cands: DataFrame) -> DataFrame:
    return cands.agg(F.count("*").alias("candidates"), F.min("theta").alias("min_theta"), F.avg("theta").alias("mean_theta"), F.max("theta").alias("max_theta"), F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("pairs"))


def top_candidates(cands: DataFrame, k: int = 5) -> DataFrame:
    return cands.orderBy(F.desc(F.size("pairs")), "cand").limit(k).select("cand", F.size("pairs").alias("n_pairs"), "theta").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_pairs"), "cand")))
