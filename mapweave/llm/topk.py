"""Exact top-k search by inner product.

Vectors are turned by the right singular vectors of the whole table (from its Gram matrix), which gathers most of a product in the
first coordinates, and sorted by length in descending order, cut into blocks. Queries are cut into blocks as well, and each block of
queries meets each block of vectors in one task. A vector's partial product over the leading coordinates plus the product of the
lengths of the rests (Cauchy-Schwarz) bounds its score from above; a block whose largest length times the query's length lies below the
query's k-th best score so far is skipped, and so are vectors whose bound does. The first block, with the longest vectors, is searched
first: its k-th scores are the floor for all others. What is left is scored exactly in integers.

Results: each query row gets min(k, other vectors) rows, by score descending, ties to the smaller id. Vectors that are null, empty or hold
null or non-finite components take no part, nor do rows with null ids. Vectors of differing lengths are padded with zeros. Rows with the
query's id are not its partners; repeated rows count repeatedly (a repeated query row is searched once). Scores must lie below 2**63.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import stored

#: Rows in a block of vectors (and in one of a large table at most) and in a block of queries; coordinates in the leading partial sums.
BLOCK, MOST, QUERY_BLOCK, LEADING = 4096, 65_536, 1024, 24
_EXACT = 2.0**53


def quantised(vector, scale: float):
    """floor(scale * x) for each component as long; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _blob(m: np.ndarray) -> bytes:
    """A matrix in the shortest integers that hold it."""
    most = int(max(-m.min(initial=0), m.max(initial=0)))
    return m.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"i{len(blob) // (n * dim)}").reshape(n, dim).astype(np.int64)


def _gathered(batches, dim: int, size: int):
    """Ids and vectors of each `size` rows, across batches."""
    held, n = [], 0
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            part = batch.slice(i, size - n)
            i += part.num_rows
            lengths = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
            flat = part.column(1).flatten().to_numpy()
            if (lengths == dim).all():
                m = flat.reshape(-1, dim)
            else:
                m = np.zeros((len(lengths), dim), dtype=np.int64)
                m[np.arange(dim) < lengths[:, None]] = flat
            held.append((part.column(0).to_numpy(), m))
            n += part.num_rows
            if n == size:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _packed(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of rows as they come: b (a number; stable once the blocks are stored), top (largest squared length), ids, m."""

    def run(batches):
        from pyspark import TaskContext

        b = TaskContext.get().partitionId() << 32
        for ids, m in _gathered(batches, dim, size):
            top = float((m.astype(float) ** 2).sum(axis=1).max())
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([top]), pa.array([ids.tobytes()], pa.binary()), pa.array([_blob(m)], pa.binary())], ["b", "top", "ids", "m"])
            b += 1

    return rows.mapInArrow(run, "b long, top double, ids binary, m binary")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _product(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: floats where they hold every partial sum, else integers."""
    if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * v.shape[1] < _EXACT:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return v @ q


def _search(qids, q, ids, m, rotation, k, floors):
    """The k best of a block for each query, as (query place, id, score) arrays; floors: scores below are useless."""
    order = np.argsort(-(m.astype(float) ** 2).sum(axis=1), kind="stable")
    ids, m = ids[order], m[order]
    lead = min(LEADING, m.shape[1])
    turned, qt = m @ rotation, q @ rotation
    length = np.linalg.norm(turned, axis=1)
    rest = np.linalg.norm(turned[:, lead:], axis=1)
    qlength, qrest = np.linalg.norm(qt, axis=1), np.linalg.norm(qt[:, lead:], axis=1)
    head, qhead = turned[:, :lead].copy(), qt[:, :lead].copy()
    slack = 1e-9
    out = []
    for i in range(len(q)):
        best_s, best_i, floor = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), floors[i]
        for a in range(0, len(m), 1024):
            tol = slack * (1 + qlength[i] * length[a])
            if length[a] * qlength[i] + tol < floor:
                break  # vectors only get shorter
            bound = head[a : a + 1024] @ qhead[i] + rest[a : a + 1024] * qrest[i]
            live = np.flatnonzero((bound + tol >= floor) & (ids[a : a + 1024] != qids[i])) + a
            if not len(live):
                continue
            s, who = np.concatenate([best_s, _product(m[live], q[i])]), np.concatenate([best_i, ids[live]])
            keep = _best(s, who, k)
            best_s, best_i = s[keep], who[keep]
            if len(best_s) == k:
                floor = max(floor, float(best_s[-1]))
        out.append((best_i, best_s))
    return out


def top_k(vectors: DataFrame, is_query, row_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with every other row. is_query: a condition on `vectors`."""
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col(row_id).cast("long").alias("i"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("i").isNotNull() & F.col("v").isNotNull()))
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    dim = shape["dim"]

    def gram(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            for ids, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = _matrix(v, len(ids) // 8, dim).astype(float)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    def added(batches):
        total = np.zeros(dim * dim)
        for batch in batches:
            for g in batch.column(0).to_pylist():
                total += np.frombuffer(g)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    size = max(BLOCK, min(MOST, shape["n"] // 64))  # the queries go to each block: fewer blocks, less to send
    parts = max(1, -(-shape["n"] // (2 * size)))
    blocks = stored(_packed(rows.select("i", "v", norm.alias("s")).repartitionByRange(parts, F.desc("s")).sortWithinPartitions(F.desc("s"), "i").select("i", "v"), dim, size))
    sums = blocks.select("ids", "m").mapInArrow(gram, "g binary").repartition(max(1, int(parts**0.5))).mapInArrow(added, "g binary")  # a matrix a task, twice
    total = sum((np.frombuffer(r["g"]) for r in sums.collect()), np.zeros(dim * dim)).reshape(dim, dim)
    rotation = np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])  # the right singular vectors, largest first
    keys = blocks.select("b", "top").toPandas()  # two numbers for each BLOCK vectors
    longest = keys.sort_values(["top", "b"], ascending=[False, True])["b"].iloc[0]
    first = blocks.where(F.col("b") == int(longest)).select("ids", "m").first()  # by number: sorting would send a block of each task to the driver
    sent = spark.sparkContext.broadcast((bytes(first["ids"]), bytes(first["m"]), rotation, keys["b"].to_numpy(), np.sqrt(keys["top"].to_numpy())))
    queries = rows.where("q").select("i", "v").distinct().repartition(max(1, -(-shape["n"] // (50 * QUERY_BLOCK))))
    asked_schema = "b long, q_ids binary, q_m binary, floors binary"

    def asked(batches):
        """For each block those queries that may have a partner there, with the scores that count."""
        ids0, m0, turn, b_of, top_of = sent.value
        ids = np.frombuffer(ids0, dtype=np.int64)
        m = _matrix(m0, len(ids), dim)
        for batch in batches:
            for q_ids, q_m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                qids, q = np.frombuffer(q_ids, dtype=np.int64), _matrix(q_m, len(q_ids) // 8, dim)
                found = _search(qids, q, ids, m, turn, k, np.full(len(q), -np.inf))
                floors = np.array([float(s[-1]) if len(s) == k else -np.inf for _, s in found])
                length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
                for b, top in zip(b_of.tolist(), top_of.tolist()):
                    live = length * top * (1 + 1e-9) + 1e-9 >= floors
                    if live.any():
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x], pa.binary()) for x in (qids[live].tobytes(), _blob(q[live]), floors[live].tobytes()))], ["b", "q_ids", "q_m", "floors"])

    def searched(batches):
        turn = sent.value[2]
        for batch in batches:
            for q_ids, q_m, fl, b_ids, b_m in zip(*(c.to_pylist() for c in batch.columns)):
                qids, q = np.frombuffer(q_ids, dtype=np.int64), _matrix(q_m, len(q_ids) // 8, dim)
                found = _search(qids, q, np.frombuffer(b_ids, dtype=np.int64), _matrix(b_m, len(b_ids) // 8, dim), turn, k, np.frombuffer(fl))
                n = [len(s) for _, s in found]
                row = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), 'little', signed=True) for x in q]  # tells queries of one id with different vectors apart
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.repeat(np.array(row, dtype=np.int64), n)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "q", "vec_id", "score"])

    pairs = _packed(queries, dim, QUERY_BLOCK).mapInArrow(asked, asked_schema).join(blocks.select("b", "ids", "m"), "b").select("q_ids", "q_m", "floors", "ids", "m")
    best = pairs.mapInArrow(searched, "query_id long, q long, vec_id long, score long")
    # each block leaves k rows of a query at most; the best are found without bringing a query's rows together unreduced
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
