"""Table corpora: readers, the long table of cells, and sinks.

A corpus is a DataFrame `tables(table_idx, meta, columns)` with columns as arrays in reading order, or the long table
`cells(table_idx, col_idx, row_idx, value)` that the operators work on. `table_idx` grows with the place in the source.
"""

import io
import json
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.text import WIKI_NULLS, clean_value, strip, wiki_clean
from mapweave.operators.graph import checkpointed, numbered

_RECORD = "relation array<array<string>>, tableType string, hasHeader boolean, headerRowIndex int"


def _placed(lines: DataFrame, column: str) -> DataFrame:
    """Lines in order of file and place; the place needs no single task."""
    return lines.select(F.col(column).alias("line"), F.monotonically_increasing_id().alias("table_idx"))


def _once(c):
    """A column that is computed once for each row: the optimiser would copy a costly expression to each place where it is used, down to single
    cells, but copies nothing through a generator."""
    return F.explode(F.array(c))


def kept_columns(columns):
    """Arrays of clean values without those of fewer than two distinct values."""
    return F.filter(columns, lambda c: F.size(F.array_distinct(F.filter(c, lambda v: v != ""))) >= 2)


def load_jsonl(spark: SparkSession, path: str, table_types=("RELATION",), strip_headers: bool = True) -> DataFrame:
    """tables from JSON lines; blank and malformed lines, other types and empty tables are skipped. meta is the line itself."""
    rows = _placed(spark.read.text(path), "value").where(F.trim("line") != "")
    rows = rows.select("table_idx", "line", _once(F.from_json("line", _RECORD, {"mode": "PERMISSIVE"})).alias("r")).where(F.col("r.tableType").isin(*table_types))
    header = F.when(F.lit(strip_headers) & F.col("r.hasHeader") & (F.col("r.headerRowIndex") >= 0), F.col("r.headerRowIndex")).otherwise(-1)
    rows = rows.select("table_idx", "line", header.alias("header"), F.col("r.relation").alias("relation"))
    cut = F.transform(F.coalesce("relation", F.array()), lambda c: F.filter(c, lambda v, i: i != F.col("header")))
    clean = kept_columns(F.transform(cut, lambda c: F.transform(c, clean_value)))
    return rows.select("table_idx", F.col("line").alias("meta"), _once(clean).alias("columns")).where(F.size("columns") > 0)


def load_raw_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """tables(table_idx, domain, columns) from JSON lines as they are, for the baselines: nothing is cleaned or left out but blank lines; domain is the
    page's id, null where there is none. A line that is no JSON is an error, as nothing tells what it held."""
    rows = _placed(spark.read.text(path), "value").where(F.trim("line") != "")
    r = F.from_json("line", "relation array<array<string>>, pgId string", {"mode": "FAILFAST"})
    return rows.select("table_idx", _once(r).alias("r")).select("table_idx", F.col("r.pgId").alias("domain"), F.coalesce("r.relation", F.array().cast("array<array<string>>")).alias("columns"))


def load_csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """tables from a folder of CSV files, one table each in order of names; the first row is data, short rows are padded."""
    import csv

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(path)

    def parsed(batches):
        for batch in batches:
            out = []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(csv.reader(io.StringIO(content.decode("utf-8", "ignore"), newline="")))
                width = max(map(len, rows), default=0)
                out.append((p, [[r[i] if i < len(r) else "" for r in rows] for i in range(width)]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.list_(pa.list_(pa.string())))], ["path", "raw"])

    raw = files.select("path", "content").mapInArrow(parsed, "path string, raw array<array<string>>")
    name = F.element_at(F.split("path", "/"), -1)
    out = checkpointed(raw.select(name.alias("name"), kept_columns(F.transform("raw", lambda c: F.transform(c, clean_value))).alias("columns")).where(F.size("columns") > 0))
    return out.join(numbered(out.select("name"), ["name"], "table_idx"), "name").select("table_idx", F.to_json(F.struct(F.col("name").alias("source"))).alias("meta"), "columns")


def load_corpus(spark: SparkSession, path: str, table_types=("RELATION",), strip_headers: bool = True) -> DataFrame:
    """A folder is read as CSV files, anything else as JSON lines; a missing path raises FileNotFoundError."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(path)
    return load_csv_folder(spark, path) if fs.getFileStatus(fs_path).isDirectory() else load_jsonl(spark, path, table_types, strip_headers)


def wiki_column_kept(vals, top: float = 0.70, nulls: float = 0.5, digits: float = 0.5):
    """The five column filters of wiki tables on an array of clean values."""
    full = F.filter(vals, lambda v: v != "")
    distinct = F.array_distinct(full)
    share = F.array_max(F.transform(distinct, lambda d: F.size(F.filter(full, lambda v: v == d)))) / F.greatest(F.size(full), F.lit(1))
    whole = F.forall(full, lambda v: v.rlike(r"^[+-]?\d{1,18}$"))
    first = F.get(full, F.lit(0)).try_cast("long")
    run = whole & F.forall(F.transform(full, lambda v, i: v.try_cast("long") == first + i), lambda x: x)
    not_null = F.filter(vals, lambda v: ~F.lower(strip(v)).isin(WIKI_NULLS))
    null_share = 1 - F.size(not_null) / F.greatest(F.size(vals), F.lit(1))
    digit_share = F.size(F.filter(not_null, lambda v: v.rlike(r"\p{Nd}"))) / F.greatest(F.size(not_null), F.lit(1))
    return (F.size(full) >= 3) & (share <= top) & ~F.coalesce(run, F.lit(False)) & (F.size(distinct) >= 2) & (null_share < nulls) & (F.size(not_null) > 0) & (digit_share < digits)


def load_wikipedia(spark: SparkSession, path: str, most: int | None = 5000) -> DataFrame:
    """tables from JSON lines of wiki tables (row-major cells with a text); `most` tables at most, None for all."""
    schema = "tableData array<array<struct<text:string>>>, tableHeaders string"
    rows = _placed(spark.read.text(path), "value").select("table_idx", "line", _once(F.from_json("line", schema)).alias("r")).where(F.size("r.tableData") > 0)
    width = F.array_min(F.transform("r.tableData", lambda x: F.size(x)))  # columns end with the shortest row
    cols = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform("r.tableData", lambda x: wiki_clean(F.coalesce(F.get(x, i)["text"], F.lit(""))))))
    out = rows.select("table_idx", "line", _once(F.coalesce(cols, F.array().cast("array<array<string>>"))).alias("raw"))
    out = out.select("table_idx", F.col("line").alias("meta"), _once(F.filter("raw", lambda c: wiki_column_kept(c))).alias("columns")).where(F.size("columns") > 0)
    return out if most is None else out.orderBy("table_idx").limit(most)


def load_archives(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """Lines of one-table JSON files in (nested) tar.gz archives; `most` records at most, 0 for all."""

    def members(data: bytes):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
            for m in tar:
                if not m.isfile():
                    continue
                body = tar.extractfile(m).read()
                if m.name.endswith((".tar", ".tar.gz", ".tgz")):
                    yield from members(body)
                elif m.name.endswith(".json"):
                    try:
                        yield json.dumps(json.loads(body.decode("utf-8", "ignore")), ensure_ascii=False)
                    except ValueError:
                        continue

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                held = []
                for line in members(content):
                    held.append(line)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
    return lines.limit(most) if most > 0 else lines


def read_cells_jdbc(spark: SparkSession, options: dict[str, str], partitions: int = 1, key: str = "tableid") -> DataFrame:
    """A tokenised cell store (tableid, colid, rowid, term, tokenized) over JDBC; the caller gives url, dbtable and login. With more than one
    partition, the store is read in that many ranges of an integer key at once, whose bounds the store tells."""
    if partitions > 1:
        own = {k: v for k, v in options.items() if k != "dbtable"}
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(key)
        bounds = spark.read.format("jdbc").options(**own).option("query", f"SELECT min({name}) AS low, max({name}) AS high FROM {options['dbtable']}").load().first()
        if bounds[0] is not None and bounds[0] < bounds[1]:
            options = options | {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()


def to_cells(tables: DataFrame) -> DataFrame:
    cols = tables.select("table_idx", F.posexplode("columns").alias("col_idx", "vals"))
    return cols.select("table_idx", "col_idx", F.posexplode("vals").alias("row_idx", "value"))


def to_tables(cells: DataFrame) -> DataFrame:
    """Cells nested again; gaps in rows and nulls become empty strings. Of cells in one place the last in order of values counts."""
    cols = cells.groupBy("table_idx", "col_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", F.coalesce("value", F.lit("")).alias("value")))).alias("v"))
    # each value brings the empty rows before it, so that no cell is looked up
    filled = F.aggregate("v", F.array().cast("array<string>"), lambda out, x: F.concat(F.when(F.size(out) > x["row_idx"], F.slice(out, 1, x["row_idx"].cast("int"))).otherwise(F.concat(out, F.array_repeat(F.lit(""), (x["row_idx"] - F.size(out)).cast("int")))), F.array(x["value"])))
    dense = F.size(F.array_distinct(F.transform("v", lambda x: x["row_idx"]))) == F.greatest(F.element_at("v", -1)["row_idx"] + 1, F.size("v"))
    cols = cols.select("table_idx", "col_idx", F.when(dense, F.transform("v", lambda x: x["value"])).otherwise(filled).alias("vals"))
    return cols.groupBy("table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "vals"))), lambda x: x["vals"]).alias("columns"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_index(counts: DataFrame, pairs: DataFrame, path: str, skip_noise: bool = True) -> None:
    """The co-occurrence index; the two variants are not interchangeable, so they have their own places."""
    at = f"{path}/{'skipnoise' if skip_noise else 'full'}"
    counts.write.mode("overwrite").parquet(f"{at}/values")
    pairs.write.mode("overwrite").parquet(f"{at}/pairs")


def read_index(spark: SparkSession, path: str, skip_noise: bool = True) -> tuple[DataFrame, DataFrame]:
    at = f"{path}/{'skipnoise' if skip_noise else 'full'}"
    return spark.read.parquet(f"{at}/values"), spark.read.parquet(f"{at}/pairs")
