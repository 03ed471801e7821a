"""What a run leaves behind, each artefact as JSON lines (or Parquet) in a folder of its own, and how it is read again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "array<struct<l:string,r:string>>"
#: Name of the folder and schema.
SCHEMAS = {
    "filtered_corpus": "table_idx long, meta string, relation array<array<string>>, coherence_scores array<double>, rejected_column_indices array<int>",
    "candidates": f"cand long, table_idx long, left_col int, right_col int, theta double, row_count long, covered_rows long, pairs {PAIRS}",
    "edges": "ci long, cj long, w_pos double, w_neg double",
    "partitions": "cand long, partition long",
    "synthesized_mappings": f"partition long, candidates array<long>, pairs {PAIRS}, size int, num_source_tables int",
    "resolved_mappings": f"partition long, pairs {PAIRS}, size int, num_conflicts_removed int",
    "majority_mappings": f"partition long, pairs {PAIRS}, size int, num_conflicts_removed int",
    "scored_mappings": "partition long, size long, avg_confidence double, min_confidence double, max_confidence double, scored_pairs array<struct<l:string,r:string,confidence:double,support_count:long,avg_theta:double,survived_conflict:boolean>>",
    "baselines": f"group_id string, method string, num_source_tables long, pairs {PAIRS}, size int",
    "synonyms": "value string, canonical string",
}


def save(df: DataFrame, out: str, name: str) -> None:
    """Write an artefact below `out`, over an older one; columns by the names of its schema, others are left out."""
    wanted = [part.split(" ")[0] for part in _parts(SCHEMAS[name])]
    df.select(*[F.col(f"`{c}`") for c in wanted]).write.mode("overwrite").json(f"{out}/{name}")


def load(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).json(f"{out}/{name}")


def _parts(schema: str) -> list[str]:
    """The columns of a schema; commas inside of types don't part them."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def filtered_corpus(scored: DataFrame, cells: DataFrame, tables: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(table_idx, meta, relation, coherence_scores, rejected_column_indices) of tables with a column left. scored: every column's score."""
    kept = cells.join(scored.where(F.col("score") >= threshold), ["table_idx", "col_idx"]).groupBy("table_idx", "col_idx", "score").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]).alias("vals"))
    each = F.array_sort(F.collect_list(F.struct("col_idx", "score", "vals")))
    nested = kept.groupBy("table_idx").agg(each.alias("c")).select("table_idx", F.transform("c", lambda x: x["vals"]).alias("relation"), F.transform("c", lambda x: x["score"]).alias("coherence_scores"))
    gone = scored.where(F.col("score") < threshold).groupBy("table_idx").agg(F.array_sort(F.collect_list(F.col("col_idx").cast("int"))).alias("rejected_column_indices"))
    out = nested.join(gone, "table_idx", "left").join(tables.select("table_idx", "meta"), "table_idx", "left")
    return out.withColumn("rejected_column_indices", F.coalesce("rejected_column_indices", F.array().cast("array<int>")))
