"""Helpers shared by the operators of this subpackage."""

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII lower case only; every other character keeps its form.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Documents handled at once inside a Python worker, so that working memory follows texts and not Arrow batches.
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    return F.translate(col, _UPPER, _LOWER)


def residue(id_col, modulus: int):
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share. Where the setting is missing, a folder of our own in local
    mode, as in tests; elsewhere that would lose data, and is an error. All such folders go when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="mapweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/mapweave/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and nothing is computed twice."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def keep_batches_small(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session have some hundred rows: for frames that are computed after their function has returned, and
    which a copy on disk would be too dear for. A smaller bound of the session stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= _BATCH_ROWS:
        spark.conf.set(_BATCH, str(_BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, Arrow batches have some hundred rows, for texts are long: that keeps memory low on both sides of the pipe. What is read later
    isn't affected, so everything that Python works on must be stored inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(_BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def relax() -> None:
    """Give free memory back to the system; a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, or a variation of it that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def text_first(docs: DataFrame, text: str, kept: list[str], name: str) -> tuple[DataFrame, list[int]]:
    """The text as `name` and the columns `kept` of `docs`, and the place of each of these. The text isn't sent a second time where it is
    among them as it is: Arrow batches hold thousands of texts on both sides of the pipe."""
    once = text in kept and dict(docs.dtypes)[text] == "string"
    others = [c for c in kept if not (once and c == text)]
    place = {c: i for i, c in enumerate(others, 1)} | ({text: 0} if once else {})
    return docs.select(F.col(text).cast("string").alias(name), *[F.col(f"`{c}`") for c in others]), [place[c] for c in kept]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of bounded count and bounded text size (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= SLICE_ROWS or size + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield batch.slice(start)


def map_slices(df: DataFrame, text: int, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """mapInArrow over slices; `text` is the position of the text column. `work` sees one slice at a time."""

    def run(batches):
        relax()  # what earlier stages left
        for batch in batches:
            for part in slices(batch, text):
                yield work(part)
        relax()

    return df.mapInArrow(run, schema)
