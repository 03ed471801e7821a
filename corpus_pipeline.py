"""A corpus pipeline over `documents`: each stage is written as Parquet and read again as the next one's input.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null and empty
texts go in the first stage, for their language cannot be told. Repeated rows count as copies, of which one stays. An empty table stays empty.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import decontamination, jaccard_join, language_id, secret_scan, sentencepiece_codec
from mapweave.llm.common import free_name, keep_batches_small, residue, small_batches, stored, table
from mapweave.llm.queries import piece_model, token_digests

#: Ids that are sent to all executors at most (8 bytes each, some 30 MB with their index); beyond, the join is left to a shuffle.
BROADCAST_IDS = 500_000


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def _shielded(docs: DataFrame, taken) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with other names for the columns that an operator would replace, and those names by the old ones."""
    away = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(away), away


def _restored(df: DataFrame, away: dict[str, str], docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told. Arrow batches stay small for the session: the result is computed later, as other stages' are."""
    keep_batches_small(spark)
    own, away = _shielded(docs, language_id.COLUMNS)
    found = language_id.identify(own, usable=residue("doc_id", 3) != 1)
    return _restored(found.where(language_id.accepted(F.col("lang_pred"), F.col("score"))), away, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group (null ids last; of equal ids, the first stored row). Rows are told apart by a number."""
    number = free_name(docs, "row_number")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(number).alias("number"))
    found = stored(jaccard_join.near_duplicates(rows.select(place.alias("place"), "text"), row_id="place"))
    name = free_name(rows, "gone")
    gone = found.where("component_id.number <> place.number").select(F.col("place.number").alias(name))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return _as_documents(rows.join(gone, F.col(number) == F.col(name), "left_anti"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that aren't contaminated by the benchmark."""
    own, away = _shielded(docs, decontamination.COLUMNS)
    found = decontamination.find_contamination(own, table(spark, sf_dir, "benchmark"))
    return _restored(found.where(~decontamination.contaminated(F.col("n_words"), F.col("n_hit"))), away, docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    own, away = _shielded(docs, secret_scan.COLUMNS)
    found = secret_scan.scan(own)
    changed = F.size("findings") > 0
    text = F.when(changed, F.col("redacted")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[text.alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each text's pieces and of what they decode to."""
    with small_batches(spark):
        return stored(token_digests(sentencepiece_codec.encode_decode(docs.select("doc_id", "text"), piece_model())))


STAGES = [
    ("language identification", identify_languages),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("piece encoding", encode),
]

#: Language identification, the secret scan's forest and the pieces can't be said in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
