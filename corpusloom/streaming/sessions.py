"""Chat sessions of owners, kept from a stream of events with keyed state.

An event is (owner, seq, session, kind, role, text): `new` begins a session (text: its title), `append` adds a message, `title` renames,
`remove` takes a session away and `clear` all of the owner's; events for sessions that are not there, and `new` for one that
is, change nothing. Where `remove` or `clear` leaves an owner without a session, one is begun in its place, named by
`replacement` if the event has one. An owner's events come in the order of seq from batch to batch and in any order
within one; an event whose seq is not above the last one seen has been there before and is left out, so that a
source may send events again.

Per owner the state holds a row for each session, never its messages: what a removal has to take away are the numbers up to the
session's count. Each batch's changes go into a bucketed table with snapshots (see `operators.snapshots`), one row for each session
(n = 0, text: the title) and message (n from 1); a batch that is run again writes the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from corpusloom.operators import snapshots
from corpusloom.operators.ordered import stored

EVENT = "owner string, seq bigint, session string, kind string, role string, text string, replacement string"
CHANGE = "owner string, session string, n bigint, role string, text string, seq bigint, gone boolean"
TABLE = ["owner", "session", "n", "role", "text", "seq"]
#: The state store that keyed state of several variables needs.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_TOLD = ["seq", "session", "kind", "role", "text", "replacement"]


def _known(x):
    """A text; None for what pandas has in place of null."""
    return x if isinstance(x, str) else None


class Sessions(StatefulProcessor):
    """Events of an owner to changes of rows."""

    def init(self, handle) -> None:
        self.own = handle.getValueState("own", "seq bigint, counts map<string, bigint>")  # one call to read an owner, one to write

    def handleInputRows(self, key, rows, timer_values):
        events = sorted((e for part in rows for e in zip(*[part[c].tolist() for c in _TOLD])), key=lambda e: e[0])
        last, counts = self.own.get() or (None, {})
        counts, seen, changes = dict(counts), last, {}
        for seq, session, kind, role, text, replacement in events:
            if last is not None and seq <= last:
                continue
            last = seq
            if kind == "new" and session not in counts:
                counts[session] = 0
                changes[session, 0] = (None, _known(text), seq, False)
            elif kind == "append" and session in counts:
                counts[session] += 1
                changes[session, counts[session]] = (_known(role), _known(text), seq, False)
            elif kind == "title" and session in counts:
                changes[session, 0] = (None, _known(text), seq, False)
            elif kind in ("remove", "clear"):
                gone = [s for s in counts if kind == "clear" or s == session]
                for s in gone:
                    for n in range(counts.pop(s) + 1):
                        changes[s, n] = (None, None, seq, True)
                if gone and not counts and _known(replacement) is not None:
                    counts[replacement] = 0
                    changes[replacement, 0] = (None, None, seq, False)
        if last != seen:
            self.own.update((int(last), counts))
        if changes:
            yield pd.DataFrame([(key[0], s, n, *c) for (s, n), c in changes.items()], columns=["owner", "session", "n", "role", "text", "seq", "gone"])

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """The rows that a stream (or, without earlier state, a table) of events changes; the last word on each of a batch."""
    own = events.where(F.col("owner").isNotNull() & F.col("seq").isNotNull()).select("owner", "seq", "session", "kind", "role", "text", "replacement")
    return own.groupBy("owner").transformWithStateInPandas(Sessions(), CHANGE, "Update", "None")


def session_stream(events: DataFrame, path: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Takes up what has arrived and stops; run again with the same checkpoint, it goes on where it stopped."""
    spark = events.sparkSession
    if not snapshots.newest(spark, path):
        none = spark.createDataFrame([], CHANGE).select(*TABLE)
        snapshots.create(none, path, ["owner", "session", "n"], buckets)

    def put(batch: DataFrame, _: int) -> None:
        rows = stored(batch)
        if not rows.isEmpty():
            snapshots.upsert(batch.sparkSession, path, rows.where("not gone").select(*TABLE), rows.where("gone").select("owner", "session", "n"))

    had = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:  # a query keeps the settings with which it was started
        return changes(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE[0], had) if had else spark.conf.unset(_STORE[0])


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(owner, session, n, role, text, seq) of the messages that are there."""
    return snapshots.load(spark, path).where("n > 0")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """(owner, session, title, messages, updated), the last updated first where they are ordered by it."""
    rows = snapshots.load(spark, path)
    return rows.groupBy("owner", "session").agg(F.max(F.when(F.col("n") == 0, F.col("text"))).alias("title"), F.count_if(F.col("n") > 0).alias("messages"),
        F.max("seq").alias("updated"))
