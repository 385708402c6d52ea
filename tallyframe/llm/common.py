"""What several of these operators need: the shared folder, staged tables, byte rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes that the contracts name: space and \t \n \v \f \r.
WS_CLASS = "[\\x20\\x09-\\x0D]+"
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Longer keys are not remembered.
_LONGEST_REMEMBERED = 64
#: Bytes of a batch that an operator's Python sees at once.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Remembered(dict):
    """Text to value by ``make``; at most two generations of ``most`` entries."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(key) > _LONGEST_REMEMBERED:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def squeeze(raw: bytes) -> bytes:
    """Every run of the six white-space bytes becomes one space."""
    raw = raw.translate(_TO_SPACE)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def binary(column) -> list[bytes | None]:
    """The bytes of an Arrow string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():  # else it came in an archive that Spark was given
        target = Path(tempfile.mkdtemp()) / f"{package.name}_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


_RESIDENT: dict = {}


def resident(key, make):
    """What a worker keeps from task to task of one operator: made once, let go when another
    operator's tasks begin, so that a worker never holds the memories of two."""
    if key not in _RESIDENT:
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def let_go() -> None:
    """Give memory that Python has freed back to the system, cycles too."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Give freed memory back to the system: an executor's processes share its memory, and what
    a worker keeps for later the others can't have."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _begin(owner: str) -> None:
    if _RESIDENT.get("owner") != owner:
        _RESIDENT.clear()
        _RESIDENT["owner"] = owner
        let_go()


def _slices(batches, most_bytes: int = BATCH_BYTES):
    """The rows of Arrow batches in parts of about so many bytes; a row is never cut. What large
    batches took is given back before the next one is read."""
    seen = 0
    for batch in batches:
        rows = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        seen += batch.nbytes
        del batch
        if seen > most_bytes:
            give_back()
            seen = 0


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package's code at hand; for ``df.transform``."""
    ship(df.sparkSession)
    owner = f"{function.__module__}.{function.__qualname__}"

    def run(batches):
        _begin(owner)
        yield from function(_slices(batches))
        give_back()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session without that setting gets a checkpoint folder of its own: a temporary one
    in local mode, one inside the warehouse on a cluster.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp() if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it is computed once,
    survives lost executors and has a short plan."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
