"""The accounting system as a sink and a source of DataFrames.

A client is an object that tasks can be sent, with

* ``find(txn_type, doc_number)``: the id of what is posted under a key, or None;
* ``create(txn_type, doc_number, document, row_id)``: posts a document and returns its id;
* ``pages(wanted)`` and ``page(wanted, n, columns)``: how many pages of posted transactions there are
  and the rows of one, where ``wanted`` has the values asked for, by column.

``find`` and ``create`` raise ``Refused`` for what won't get better and ``Busy`` for what may. All
other exceptions end the task, and Spark runs it again.
"""

from __future__ import annotations

import base64
import os
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from ..schema import POSTED
from ..ship import ship

SINK, SCAN = "ledger_creates", "ledger_posted"
OUTCOMES = "txn_type string, doc_number string, attempt int, id string, error string"
_FIELDS = pa.schema([("txn_type", pa.string()), ("doc_number", pa.string()), ("attempt", pa.int32()), ("id", pa.string()), ("error", pa.string())])
KEY = ("txn_type", "doc_number")
#: What a scan of the remote system yields; position is its own order.
REMOTE_POSTED = StructType([*POSTED.fields, StructField("position", LongType())])
#: Keys that one lookup asks for.
KEYS_AT_ONCE = 100


class Refused(Exception):
    """The remote system says no."""


class Busy(Exception):
    """The remote system can't answer now."""


def packed(client) -> str:
    return base64.b64encode(cloudpickle.dumps(client)).decode()


def _unpacked(text: str):
    return cloudpickle.loads(base64.b64decode(text))


# creates


@dataclass
class _Done(WriterCommitMessage):
    name: str
    rows: int


class CreateWriter(DataSourceArrowWriter):
    """Tries rows of (txn_type, doc_number, turn, row_id, document), sorted by key and turn.

    Of a key the first row is tried; if that fails the next one, until one is posted; the rest are
    passed over. A try asks for the key before it creates, so a task that runs again finds what
    it created before. What a task has found out is one file, which counts once the driver
    commits it. If the job fails, the files of tasks that ended count too: what they say is so.
    """

    def __init__(self, options) -> None:
        self.client, self.folder = _unpacked(options["client"]), options["path"]
        self.attempts, self.pause = int(options.get("attempts", "3")), float(options.get("pause", "1"))

    def _try(self, row: dict) -> tuple[str | None, str | None]:
        for k in range(1, self.attempts + 1):
            try:
                found = self.client.find(row["txn_type"], row["doc_number"])
                return found or self.client.create(row["txn_type"], row["doc_number"], row["document"], row["row_id"]), None
            except Refused as e:
                return None, str(e)
            except Busy as e:
                if k == self.attempts:
                    return None, str(e)
                time.sleep(self.pause * 2 ** (k - 1))
        return None, "never tried"

    def write(self, iterator) -> WriterCommitMessage:
        settled, out = None, []
        for batch in iterator:
            for row in batch.to_pylist():
                key = row["txn_type"], row["doc_number"]
                if key != settled:
                    ident, error = self._try(row)
                    out.append({"txn_type": key[0], "doc_number": key[1], "attempt": row["turn"], "id": ident, "error": error})
                    if ident:
                        settled = key
        name = f"{uuid.uuid4().hex}.parquet"
        store, at = fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{at}/_tried", recursive=True)
        pq.write_table(pa.Table.from_pylist(out, _FIELDS), f"{at}/_tried/{name}", filesystem=store)
        return _Done(name, len(out))

    def commit(self, messages) -> None:
        store, at = fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{at}/outcomes", recursive=True)
        for m in messages:
            if m is not None:
                store.move(f"{at}/_tried/{m.name}", f"{at}/outcomes/{m.name}")

    def abort(self, messages) -> None:
        self.commit(messages)


class CreateSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema, overwrite):
        return CreateWriter(self.options)


def _uri(spark: SparkSession, path: str) -> str:
    """A path as PyArrow takes it too: with its scheme, and three slashes after ``file:``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of the tries of a run: txn_type, doc_number, attempt, id or error."""
    if not _exists(spark, f"{folder}/outcomes"):
        return spark.createDataFrame([], OUTCOMES)
    return spark.read.schema(OUTCOMES).parquet(f"{folder}/outcomes")


def push(plan: DataFrame, documents: DataFrame, client, folder: str, attempts: int = 3, pause: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Create what a plan says, and give the plan as it was carried out with the outcomes, for ``with_outcomes``.

    ``plan`` is of ``plan_postings``, ``documents`` (row_id, document) of ``postings.documents``.
    ``folder``, which tasks must be able to write by its URI, belongs to one run: the plan is kept
    there first, so a run that was killed and is started again with the same folder goes on
    with its own plan, and its tries find what is posted already. Rows of a key are tried in the order
    of their turns: the first of every key, then, of keys without success, the next 2, 4, 8 and
    so on, so keys with many rows send on only those that are needed. Tasks of keys that many
    rows share try one after the other, which is what the order asks for. Speculation should be
    off unless the remote system refuses a second document under a key.
    """
    spark = plan.sparkSession
    folder = _uri(spark, folder)
    ship(spark)
    spark.dataSource.register(CreateSink)
    if not _exists(spark, f"{folder}/plan/_SUCCESS"):
        plan.write.mode("overwrite").parquet(f"{folder}/plan")
    kept = spark.read.schema(plan.schema).parquet(f"{folder}/plan")
    rows = kept.where("posted_id IS NULL AND turn IS NOT NULL").select(*KEY, "turn", "row_id")
    low = high = 1
    while True:
        known = outcomes(spark, folder)
        settled = known.where("id IS NOT NULL").select(*KEY).distinct()
        open_ = rows.join(settled, list(KEY), "left_anti")
        tried = open_.where(F.col("turn").between(low, high)).join(documents.select("row_id", "document"), "row_id").select(*KEY, "turn", "row_id", "document")
        dealt = tried.repartition(*KEY).sortWithinPartitions(*KEY, "turn")
        dealt.write.format(SINK).mode("append").options(client=packed(client), path=folder, attempts=str(attempts), pause=str(pause)).save()
        settled = outcomes(spark, folder).where("id IS NOT NULL").select(*KEY).distinct()
        if rows.where(F.col("turn") > high).join(settled, list(KEY), "left_anti").isEmpty():
            return kept, outcomes(spark, folder)
        low, high = high + 1, 2 * high + 1


# scans and lookups


@dataclass
class _Page(InputPartition):
    n: int


class PostedReader(DataSourceReader):
    """One partition for each page that the remote system has for the values asked for."""

    def __init__(self, options, schema: StructType) -> None:
        self.client, self.schema = _unpacked(options["client"]), schema
        self.can = tuple(c for c in options.get("filters", ",".join(KEY)).split(",") if c)
        self.wanted: dict[str, list] = {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.can and column not in self.wanted and isinstance(f, EqualTo | In):
                self.wanted[column] = [f.value] if isinstance(f, EqualTo) else list(f.value)
            elif not (isinstance(f, IsNotNull) and column in KEY):  # keys never are null
                yield f

    def partitions(self):
        return [_Page(n) for n in range(self.client.pages(self.wanted))]

    def read(self, partition):
        names = self.schema.names
        for row in self.client.page(self.wanted, partition.n, names):
            yield tuple(row.get(c) for c in names)


class PostedSource(DataSource):
    """Option ``columns`` names those to fetch; all of ``REMOTE_POSTED`` otherwise."""

    @classmethod
    def name(cls) -> str:
        return SCAN

    def schema(self):
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return StructType([f for f in REMOTE_POSTED if not wanted or f.name in wanted])

    def reader(self, schema):
        return PostedReader(self.options, schema)


def scan(spark: SparkSession, client, *columns: str, filters: tuple[str, ...] = KEY) -> DataFrame:
    """What is posted, read page by page. Equality and IN on ``filters`` go to the client; only ``columns`` are fetched."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PostedSource)
    return spark.read.format(SCAN).options(client=packed(client), columns=",".join(columns), filters=",".join(filters)).load()


def lookup(keys: DataFrame, client, at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """Of (txn_type, doc_number), each key asked for once: txn_type, doc_number, id, position, error.

    Keys that aren't posted have no row. A key may have several; ``postings.posted_once`` chooses. If a
    request fails, each of its keys has a row with the error, for ``lookup_errors`` of a plan.
    """
    ship(keys.sparkSession)

    def ask(batches):
        fields = pa.schema([("txn_type", pa.string()), ("doc_number", pa.string()), ("id", pa.string()), ("position", pa.int64()), ("error", pa.string())])
        for batch in batches:
            by_type: dict[str, list[str]] = {}
            for row in batch.to_pylist():
                by_type.setdefault(row["txn_type"], []).append(row["doc_number"])
            out = []
            for kind, names in by_type.items():
                for k in range(0, len(names), at_once):
                    some = names[k : k + at_once]
                    wanted = {"txn_type": [kind], "doc_number": some}
                    try:
                        out += [{**r, "error": None} for n in range(client.pages(wanted)) for r in client.page(wanted, n, fields.names[:4])]
                    except (Refused, Busy) as e:
                        out += [{"txn_type": kind, "doc_number": d, "error": str(e)} for d in some]
            yield from pa.Table.from_pylist(out, fields).to_batches()

    return keys.select(*KEY).distinct().mapInArrow(ask, "txn_type string, doc_number string, id string, position long, error string")


class FolderRemote:
    """A remote system kept in a folder that all tasks can write, for trials and tests: a file for
    each transaction, named by its key, made in one step and never made anew."""

    def __init__(self, folder: str, rows_a_page: int = 1000) -> None:
        self.folder, self.rows_a_page = folder, rows_a_page

    def _at(self, *names: str) -> str:
        os.makedirs(self.folder, exist_ok=True)
        return os.path.join(self.folder, *names)

    def find(self, txn_type: str, doc_number: str) -> str | None:
        try:
            with open(self._at(f"{txn_type}-{doc_number}")) as f:
                return f.read().partition("\n")[0]
        except FileNotFoundError:
            return None

    def create(self, txn_type: str, doc_number: str, document: str, row_id: int) -> str:
        at, ident = self._at(f"{txn_type}-{doc_number}"), f"{row_id}-1"
        draft = self._at(f".{uuid.uuid4().hex}")
        with open(draft, "w") as f:
            f.write(f"{ident}\n{document}")
        try:
            os.link(draft, at)  # fails if the key is there
        except FileExistsError:
            raise Refused(f"{txn_type} {doc_number} is there already") from None
        finally:
            os.unlink(draft)
        return ident

    def _rows(self, wanted: dict[str, list]) -> list[dict]:
        names = sorted(n for n in os.listdir(self._at()) if not n.startswith("."))
        rows = [dict(zip(KEY, n.split("-", 1), strict=True)) | {"position": k, "_name": n} for k, n in enumerate(names)]
        return [r for r in rows if all(r[c] in values for c, values in wanted.items())]

    def pages(self, wanted: dict[str, list]) -> int:
        return -(-len(self._rows(wanted)) // self.rows_a_page)

    def page(self, wanted: dict[str, list], n: int, columns) -> list[dict]:
        out = []
        for r in self._rows(wanted)[n * self.rows_a_page : (n + 1) * self.rows_a_page]:
            with open(self._at(r["_name"])) as f:
                out.append({c: v for c, v in (r | {"id": f.readline().rstrip("\n")}).items() if c in columns})
        return out
