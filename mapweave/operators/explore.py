"""Exploration of a cell store (tableid, colid, rowid, tokenized): counts, token classes, pivots, samples and header rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = "^[0-9]+$"
# Fixed tokens that stand for no value in header searches.
NULL_TOKENS = ["", "null", "none", "nan", "n/a", "na", "-"]


def tokens_per_table(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tableid").agg(F.count("*").alias("tokens"))


def table_shapes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tableid").agg(F.count("*").alias("tokens"), F.countDistinct("rowid").alias("rows"), F.countDistinct("colid").alias("cols"))


def _empty(c):
    return c.isNull() | (F.trim(c) == "")


def token_classes(cells: DataFrame) -> DataFrame:
    t = F.col("tokenized")
    return cells.groupBy("tableid").agg(F.count("*").alias("total_rows"), F.count_if(_empty(t)).alias("null_tokens"), F.count_if(t.rlike(DIGITS)).alias("numeric_tokens"), F.count_if(~_empty(t) & ~t.rlike(DIGITS)).alias("string_tokens"))


def null_cells(cells: DataFrame) -> DataFrame:
    return cells.where(_empty(F.col("tokenized")))


def numeric_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("tokenized").rlike(DIGITS))


def string_cells(cells: DataFrame) -> DataFrame:
    return cells.where(~_empty(F.col("tokenized")) & ~F.col("tokenized").rlike(DIGITS))


def pivot(cells: DataFrame, columns: list[int]) -> DataFrame:
    """(tableid, rowid, col_0, ...): each row's largest token of each column, in one aggregate."""
    return cells.groupBy("tableid", "rowid").agg(*[F.max(F.when(F.col("colid") == k, F.col("tokenized"))).alias(f"col_{k}") for k in columns])


def pivot_all(cells: DataFrame, most: int = 1000) -> DataFrame:
    """The same with the columns that occur; more than `most` raise an error."""
    found = [r[0] for r in cells.select("colid").distinct().orderBy("colid").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} columns")
    return pivot(cells, found)


def listing(cells: DataFrame, tableid, n: int = 100) -> DataFrame:
    """The first n cells of a table in order of rows and columns."""
    return cells.where(F.col("tableid") == F.lit(tableid)).orderBy("rowid", "colid").limit(n).select("rowid", "colid", "term", "tokenized")


def medium_tables(cells: DataFrame, low: int = 150, high: int = 800, n: int = 5) -> DataFrame:
    return tokens_per_table(cells).where(F.col("tokens").between(low, high)).orderBy(F.desc("tokens"), "tableid").limit(n)


def header_rows(cells: DataFrame, keywords: list[str]) -> DataFrame:
    """(tableid, header_row): the first row with a token that holds one of the keywords."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.lower("tokenized"), F.lit(k.lower()))
    return cells.where(hit).groupBy("tableid").agg(F.min("rowid").alias("header_row"))


def last_full_row(cells: DataFrame) -> DataFrame:
    """(tableid, header_row): the last row with any token that stands for a value."""
    full = cells.where(F.col("tokenized").isNotNull() & ~F.lower(F.trim("tokenized")).isin(NULL_TOKENS))
    return full.groupBy("tableid").agg(F.max("rowid").alias("header_row"))


def without_nulls(cells: DataFrame) -> DataFrame:
    """Null tokens as nulls; rows and columns that hold nothing else go."""
    t = F.when(~F.lower(F.trim("tokenized")).isin(NULL_TOKENS), F.col("tokenized"))
    c = cells.withColumn("tokenized", t)
    full = c.where("tokenized IS NOT NULL")
    return c.join(full.select("tableid", "rowid").distinct(), ["tableid", "rowid"], "left_semi").join(full.select("tableid", "colid").distinct(), ["tableid", "colid"], "left_semi")


def server_side_sample(cells: DataFrame, n: int, order=None) -> DataFrame:
    """(tableid, colid, rowid, val): quotes stripped, columns kept with two values and some that are no number, hex code or placeholder, tables
    with two such columns; n tables in the order of `order` (by default a hash of the id)."""
    val = F.regexp_replace("term", "^'+|'+$", "")
    s = cells.select("tableid", "colid", "rowid", val.alias("val"))
    full = F.col("val") != ""
    some = lambda c: F.count_if(full & ~c)
    v = F.col("val")
    stats = s.groupBy("tableid", "colid").agg(F.countDistinct(F.when(full, v)).alias("uniq"), some(v.rlike("^-?[0-9]+([.,][0-9]+)?$")).alias("a"), some(v.rlike("^(#|0x)[0-9a-fA-F]+$")).alias("b"), some(F.lower(v).isin("-", "--", "n/a", "na", "null", "none", "?")).alias("c"))
    cols = stats.where("uniq >= 2 AND a > 0 AND b > 0 AND c > 0").select("tableid", "colid")
    tables = cols.groupBy("tableid").count().where("count >= 2").select("tableid").orderBy(F.xxhash64("tableid") if order is None else order, "tableid").limit(n)
    return s.join(cols, ["tableid", "colid"], "left_semi").join(F.broadcast(tables) if n <= 100_000 else tables, "tableid", "left_semi").select("tableid", "colid", "rowid", "val")
