"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to `BITS` bits each by their quantiles over all rows: numbers, dates and times as such, anything else by
the first bytes of its text, so that cells keep the order of values and frequent values get more room. The index of the cell on a Hilbert
curve through all dimensions orders the rows; equal texts count as one group, which lies where its lowest cell is, and follow each other by
digest and id. Runs of this order are the shards: law `rows` cuts it so that counts differ by one at most, and only such a cut divides
a group. So a shard covers a compact region of all dimensions, and files can be pruned by the minima and maxima of each of them.

The order is global and is found without a single task that sees all rows: rows are range-partitioned and sorted, positions are taken
inside partitions, and the partitions' offsets (one number each) are added. The sorted rows are stored first, so that positions
cannot change when a task is repeated. A cell or a group may hold any share of the rows, for the digest and the id split it.

Results: null texts have size 8 and the crc32 of no bytes (0); null ids come first among equals; nulls in a dimension are cell 0, NaN is in the
last. Repeated rows get slots of their own. Shards that get no rows are just absent, and an empty table has none.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import free_name, stored

#: Bits for each dimension, and bytes by which texts are put in order.
BITS, TEXT_BYTES = 5, 6


def curve_states(n: int) -> list[int]:
    """The curve through 2**n halves as a table: at (state, corner) the next state and the corner's place on the curve, packed as
    state << n | place. A state is an entry corner and a direction: direction << n | entry."""
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    place_of = {g: i for i, g in enumerate(gray)}
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & (size - 1)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    axis = [0] + [ones(i if i % 2 else i - 1) % n for i in range(1, size)]
    out = []
    for state in range(n * size):
        direction, start = state >> n, state & (size - 1)
        for corner in range(size):
            place = place_of[turn(corner ^ start, n - (direction + 1) % n)]
            nxt = start ^ turn(entry[place], direction + 1)
            out.append(((((direction + axis[place] + 1) % n) << n | nxt) << n) | place)
    return out


def hilbert(dims: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of integer columns in [0, 2**bits): one look-up in the table of states for each bit, the highest first."""
    n = len(dims)
    table = F.array(*map(F.lit, curve_states(n)))
    index, at = F.lit(0).cast("long"), F.lit(0)
    for b in range(bits - 1, -1, -1):
        corner = F.lit(0)
        for j, d in enumerate(dims):
            corner = corner.bitwiseOR(F.shiftleft(F.shiftright(d.cast("int"), b).bitwiseAND(1), j))
        at = F.get(table, F.shiftleft(F.shiftright(at, n), n).bitwiseOR(corner))
        index = F.shiftleft(index, n).bitwiseOR(at.bitwiseAND((1 << n) - 1).cast("long"))
    return index


def ordered(df: DataFrame, name: str) -> Column:
    """A dimension as a double that keeps the order of its values; of texts only the first bytes count, as for quantiles of any kind."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal"):
        return c.cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    head = F.substring(F.concat(c.cast("string").cast("binary"), F.lit(b"\0" * TEXT_BYTES)), 1, TEXT_BYTES)
    return F.conv(F.hex(head), 16, 10).cast("double")


def cell(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie below a value (equal cuts count each); 0 for null, all of them for NaN. A tree of comparisons."""
    steps = sorted(set(cuts))
    below = [sum(c < s for c in cuts) for s in steps] + [len(cuts)]

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(below[a])
        mid = (a + b) // 2
        return F.when(value <= steps[mid], tree(a, mid)).otherwise(tree(mid + 1, b))

    return F.when(value.isNull(), 0).otherwise(tree(0, len(steps)))


def shard(docs: DataFrame, dimensions: list[str], shards: int, row_id: str = "doc_id", text: str = "text", partition_rows: int = 250_000) -> DataFrame:
    """id, size, text_crc32, curve (the Hilbert index of the row's group), the dimensions' cells, shard, slot (from 0 in each shard)."""
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    values, cells = [f"value_{i}" for i in range(len(dimensions))], [f"cell_{i}" for i in range(len(dimensions))]
    marks = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    plain = docs.select(*[ordered(docs, d).alias(v) for d, v in zip(dimensions, values)])
    cuts = plain.agg(*[F.percentile_approx(F.when(~F.isnan(v), F.col(v)), marks, 4000).alias(v) for v in values]).first()  # 31 numbers each
    rows = docs.select(F.col(row_id).alias("row_id"), (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("digest"), *[ordered(docs, d).alias(v) for d, v in zip(dimensions, values)])
    rows = rows.select("row_id", "size", "text_crc32", "digest", *[cell(F.col(v), list(cuts[v] or [])).alias(c) for v, c in zip(values, cells)])
    base = stored(rows.withColumn("own", hilbert([F.col(c) for c in cells])))
    n = base.count()
    # equal texts in different cells move to the lowest one; few texts are meant, and each of their groups is one row
    same = ["digest", "size", "text_crc32"]
    groups = stored(base.groupBy(*same).agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select(*[F.col(c).alias(f"g_{c}") for c in same], "low"))
    if groups.limit(1).count():
        base = base.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("size") == F.col("g_size")) & (F.col("text_crc32") == F.col("g_text_crc32")), "left")
        base = base.withColumn("curve", F.coalesce("low", "own"))
    else:
        base = base.withColumn("curve", F.col("own"))
    order = ["curve", "digest", "size", "text_crc32", "row_id"]
    parts = max(1, -(-n // partition_rows), min(64, n // 2000))
    placed = stored(base.select(*order, *cells).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    before = counts.select(F.col("part").alias("o_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    ranked = placed.join(F.broadcast(before), part == F.col("o_part")).withColumn("rank", F.col("offset") + at)  # a row for each partition
    exact = F.expr(f"CAST((rank * {shards}) div {max(1, n)} AS INT)")
    first = F.expr(f"({n} * CAST(shard AS BIGINT) + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", exact).withColumn("slot", F.col("rank") - first).select(F.col("row_id").alias(row_id), "size", "text_crc32", "curve", *[F.col(c).alias(f"{d}_cell") for c, d in zip(cells, dimensions)], "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, row_id: str = "doc_id", partition_rows: int = 250_000) -> DataFrame:
    """Write the rows with their shard and slot as Parquet, a folder for each shard with files in order of slots, and return the minima and
    maxima of the cells for pruning. Rows are found by id, so null or repeated ids are an error; `shard_files` takes any rows."""
    ids = docs.agg(F.count("*").alias("n"), F.count(row_id).alias("some")).first()
    if ids["n"] != ids["some"] or docs.groupBy(row_id).count().where("count > 1").limit(1).count():
        raise ValueError("ids are null or repeated")
    name = free_name(docs, "placed_id")
    joined = docs.join(placed.select(F.col(row_id).alias(name), "shard", "slot"), F.col(row_id) == F.col(name)).drop(name)
    joined.repartitionByRange(max(1, -(-ids["n"] // partition_rows)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    cells = [c for c in placed.columns if c.endswith("_cell")]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{f.__name__}_{c}") for c in cells for f in (F.min, F.max)])


def shard_files(docs: DataFrame, dimensions: list[str], shards: int, path: str, text: str = "text") -> DataFrame:
    """Shard any rows, null and repeated ids included, into files below `path`; the minima and maxima of the cells of each shard."""
    name = free_name(docs, "file_row")
    numbered = stored(docs.withColumn(name, F.monotonically_increasing_id()))
    return write_shards(numbered, stored(shard(numbered, dimensions, shards, name, text)), path, name)
