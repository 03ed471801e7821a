"""A table corpus made of the star schema: fragments of `lineitem` with its dimensions, as small tables.

Columns: 0 nation, 1 region (some fragments use another coding, some rows are noisy), 2 part name, 3 part type, 4 size (numbers only), 5 return
flag, 6 a mixture (every twentieth fragment). A fragment is `width` consecutive order keys.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate"]
#: Order keys of a fragment: for coherence and candidates, and for the synthesis of mappings.
FINE, COARSE = 32, 320


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, width: int = FINE) -> DataFrame:
    """One row for each row of a fragment: table_idx, row_idx, c0 to c6."""
    li = table(spark, sf_dir, "lineitem").select(*ORDER)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    rows = li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    frag = F.expr(f"l_orderkey div {width}")
    region_name = F.when((frag % 3 == 0) & (F.col("n_nationkey") % 4 == 0), F.concat(F.lit("alt "), F.lower("r_name"))).when(F.col("l_orderkey") % 97 == 0, F.concat(F.lit("x"), F.lower("r_name"))).otherwise(F.lower("r_name"))
    out = rows.select(frag.alias("table_idx"), *ORDER, F.lower("n_name").alias("c0"), region_name.alias("c1"), F.col("p_name").alias("c2"), F.lower("p_type").alias("c3"), F.col("p_size").cast("string").alias("c4"), F.lower("l_returnflag").alias("c5"))
    out = out.withColumn("row_idx", (F.row_number().over(Window.partitionBy("table_idx").orderBy(*ORDER)) - 1).cast("long"))
    k = F.col("row_idx") % 4
    mixed = F.when(F.col("table_idx") % 20 == 0, F.when(k == 0, F.col("c0")).when(k == 1, F.col("c1")).when(k == 2, F.col("c2")).otherwise(F.col("c3")))
    return out.select("table_idx", "row_idx", *[f"c{i}" for i in range(6)], mixed.alias("c6"))


def cells(spark: SparkSession, sf_dir: str, width: int = FINE) -> DataFrame:
    """table_idx, col_idx, row_idx, value."""
    each = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.col(f"c{i}").alias("value")) for i in range(7)])
    rows = wide(spark, sf_dir, width).select("table_idx", "row_idx", F.explode(each).alias("x"))
    return rows.select("table_idx", "x.col_idx", "row_idx", "x.value").where("value IS NOT NULL")


def sql(width: int = FINE) -> str:
    """The same in ANSI SQL: WITH clauses `wide` and `cells`."""
    return f"""base AS (
  SELECT l_orderkey // {width} AS table_idx, l_orderkey, n_nationkey, lower(n_name) AS c0, lower(r_name) AS region, p_name AS c2, lower(p_type) AS c3,
    CAST(p_size AS VARCHAR) AS c4, lower(l_returnflag) AS c5,
    row_number() OVER (PARTITION BY l_orderkey // {width} ORDER BY {', '.join(ORDER)}) - 1 AS row_idx
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
), coded AS (
  SELECT *, CASE WHEN table_idx % 3 = 0 AND n_nationkey % 4 = 0 THEN 'alt ' || region WHEN l_orderkey % 97 = 0 THEN 'x' || region ELSE region END AS c1 FROM base
), wide AS (
  SELECT table_idx, row_idx, c0, c1, c2, c3, c4, c5,
    CASE WHEN table_idx % 20 = 0 THEN CASE row_idx % 4 WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END END AS c6 FROM coded
), cells AS (
  {' UNION ALL '.join(f"SELECT table_idx, CAST({i} AS INTEGER) AS col_idx, row_idx, c{i} AS value FROM wide WHERE c{i} IS NOT NULL" for i in range(7))}
)"""
