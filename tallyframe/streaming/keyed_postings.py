"""An extension: the posting plan of rows that keep arriving, kept by key.

State of a key is the id under which it is posted, the try that is under way and the rows that
wait for its outcome. Rows and outcomes of creates come as one stream of events; what goes out
are the rows whose status they settle or change, numbered, so that the last of a row counts.
Taken together they are what ``with_outcomes`` makes of ``plan_postings`` over all rows so far.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.postings import CREATE_FAILED, CREATED, ERROR, SKIPPED, SKIPPED_DETAIL, with_keys
from ..schema import POSTED
from ..ship import ship
from ..sources.remote import KEY, OUTCOMES

EVENTS = "txn_type string, doc_number string, row_id long, attempt int, id string, error string"
CHANGES = "txn_type string, doc_number string, row_id long, turn int, status string, detail string, posted_id string, change long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyedPostings(StatefulProcessor):
    """Events of one key to changes of its rows. State that nothing has touched for ``keep_ms`` goes,
    and with it the memory that a key is posted; without it state stays."""

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.posted = handle.getValueState("posted", "id string", self.keep_ms)
        # last: turns given; open: the turn that is being tried, 0 if none; changes: changes told
        self.tries = handle.getValueState("tries", "last int, open int, open_row long, changes long", self.keep_ms)
        self.waiting = handle.getListState("waiting", "row_id long, turn int", self.keep_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.posted.update((initialState.id,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        posted = self.posted.get()[0] if self.posted.exists() else None
        last, opened, open_row, changes = self.tries.get() if self.tries.exists() else (0, 0, 0, 0)
        events = sorted(rows, key=lambda r: (r.attempt is None, r.attempt or 0, r.row_id or 0))  # outcomes first
        waiting, more = None, []
        out = []

        def tell(row_id: int, turn: int, status: str, detail: str = "", ident: str | None = None) -> None:
            nonlocal changes
            changes += 1
            out.append(Row(txn_type=key[0], doc_number=key[1], row_id=row_id, turn=turn, status=status, detail=detail, posted_id=ident, change=changes))

        for e in events:
            if e.attempt is None:
                last += 1
                if posted is not None:
                    tell(e.row_id, last, SKIPPED, SKIPPED_DETAIL, posted)
                elif opened:
                    tell(e.row_id, last, SKIPPED, SKIPPED_DETAIL)
                    more.append((e.row_id, last))
                else:
                    opened, open_row = last, e.row_id
                    tell(e.row_id, last, CREATED)
                continue
            if posted is not None or e.attempt != opened:  # told before
                continue
            waiting = list(self.waiting.get()) if waiting is None else waiting
            if e.id is not None and e.error is None:
                posted = e.id
                tell(open_row, opened, CREATED, "", posted)
                for w in waiting:
                    tell(w[0], w[1], SKIPPED, SKIPPED_DETAIL, posted)
                waiting, opened = [], 0
            else:
                tell(open_row, opened, ERROR, CREATE_FAILED + (e.error or ""))
                if waiting:
                    open_row, opened = waiting.pop(0)
                    tell(open_row, opened, CREATED)
                else:
                    opened = 0
        if posted is not None:
            self.posted.update((posted,))
        if waiting is not None:
            if waiting or more:
                self.waiting.put([tuple(w) for w in waiting] + more)
            else:
                self.waiting.clear()
        elif more:
            self.waiting.appendList(more)
        self.tries.update((last, opened, open_row, changes))
        yield from out

    def close(self) -> None:
        pass


def events(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ledger rows and outcomes of creates, streams or not, as one."""
    rows = with_keys(ledger.select("row_id", "date", "description", "amount")).select(*KEY, "row_id", F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(outcomes.select(*KEY, F.lit(None).cast("long").alias("row_id"), "attempt", "id", "error"))


def changes(stream: DataFrame, posted: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """Changes (``CHANGES``) of a stream of ``events``. ``posted`` (txn_type, doc_number, id), one row for
    each key, is what is posted when the stream begins. Rows of a key that come together take
    their turns by row_id; those of a later batch come after. With ``keep_ms`` Spark runs batch after
    batch to see what has expired, so a query with it doesn't end by itself at availableNow."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    first = (spark.createDataFrame([], POSTED) if posted is None else posted).select(*KEY, "id").groupBy(*KEY)  # without one Spark 4.1 can't copy its plan
    return stream.groupBy(*KEY).transformWithState(KeyedPostings(keep_ms), CHANGES, "Update", "ProcessingTime" if keep_ms else "None", first)


def outcome_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes as the create sink commits them to the folder of a run."""
    return spark.readStream.schema(OUTCOMES).parquet(f"{folder}/outcomes")


def standing(told: DataFrame) -> DataFrame:
    """The last change of each row: the plan as it stands."""
    newest = F.row_number().over(Window.partitionBy(*KEY, "row_id").orderBy(F.desc("change")))
    return told.withColumn("_n", newest).where("_n = 1").drop("_n", "change")
