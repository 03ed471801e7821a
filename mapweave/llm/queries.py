"""The registered queries of this subpackage and their SQL."""

from mapweave.llm import decontamination, jaccard_join, language_id, lm_scoring, quality, secret_scan, sentencepiece_codec, sharding, topk, warc
from mapweave.llm.common import residue, table  # noqa: F401

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(sentencepiece_codec.encode_decode(docs, piece_model()))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    out = decontamination.find_contamination(docs, items)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


QUERIES = {"op6_sentencepiece": op6_sentencepiece, "op7_decontamination": op7_decontamination}
ORACLE_SQL: dict[str, str] = {}


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(residue("doc_id", 3) == 1, F.lit(False))
    out = language_id.identify(docs, usable=residue("doc_id", 3) != 1)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "shares")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.rank(docs, table(spark, sf_dir, "labels"), usable=residue("doc_id", 4) != 2)
    return out.select("doc_id", F.coalesce(residue("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES |= {"op3_language_id": op3_language_id, "op5_quality": op5_quality}


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES["op1_topk"] = op1_topk
ORACLE_SQL["op1_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op2_warc"] = op2_warc


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


QUERIES["op10_sharding"] = op10_sharding


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_candidates", F.size("findings").alias("n_findings"), "findings", F.sha2("redacted", 256).alias("redacted_sha256"))


QUERIES["op9_secrets"] = op9_secrets


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op8_jaccard_join"] = op8_jaccard_join


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scoring.score(docs, piece_model(), residue("doc_id", 10) != 0)
    return out.select("doc_id", F.coalesce(residue("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op4_lm_scoring"] = op4_lm_scoring


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[{g + 1}] >> {b}) & 31) + 1, 1)" for g in range(8) for b in (15, 10, 5, 0))
_HEX = ", ".join(f"CAST('0x' || substr(x, {5 * g + 1}, 5) AS INTEGER)" for g in range(8))
ORACLE_SQL["op2_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM p),
e AS (SELECT *, [{_HEX}] AS v FROM d)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM e
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL["op7_decontamination"] = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT item, least(13, len(w)) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS g FROM iw),
lens AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, i, a.n, item FROM spots a JOIN win ON win.n = a.n AND g = array_to_string(w[i:i + a.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
ORACLE_SQL["op8_jaccard_join"] = f"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM dw),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
ln AS (SELECT a, b FROM pr JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(v, w) AS (SELECT doc_id, doc_id FROM dw UNION SELECT r.v, ln.b FROM reach r JOIN ln ON ln.a = r.w)
SELECT v AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(w) AS component_id FROM reach LEFT JOIN sz ON sz.doc_id = v GROUP BY v
"""
