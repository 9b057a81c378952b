"""Registering a stream of results by keyed state: one entry a document in a store on disk, no ids read again.

Two stateful operators follow each other, so a document that a third of all results name gathers in no task. The first
is keyed by document and a part of its results, dealt by content and place of reading: it lets one candidate a part
through, the best of the micro-batch that the part first appears in, and answers all others at once. The second is keyed
by document alone, meets at most ``parts`` candidates of it ever, and registers the best of those that come together;
what the first answered keeps its part there. Both hold a candidate and read the rest as a stream, so memory is that of
two rows a key. Results that are bad, or of unknown documents, meet no state.

Who loses in a part may be answered without the second operator: a good result of the document is then registered, or
becomes so in the same micro-batch. What earlier runs registered is the second operator's initial state.

Defined results: as ``registry.register_results`` judges a micro-batch. The first micro-batch that brings a good result
of a known document decides; within it the first arrival wins, a null one being last, then the payload with the least
SHA-256, and of equal rows any one. What comes later is 409, however early its arrival; a null document_id is 404.
Extra columns are ignored. The state keeps registered documents for good, as registering is for good. After a restart
from the same checkpoint everything goes on as if there had been none. ``documents`` are those of the start; the
stream is restarted to learn of new ones. The session's ``spark.sql.shuffle.partitions`` of the first start deals the
state and stays, so it is to be chosen for the size that the registry will have.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerleaf.operators import registry

#: Parts that the results of one document are dealt to.
PARTS = 32
#: The state store: on disk, its changes written to the checkpoint rather than whole copies.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Places of a document in the second operator: that of its candidates; what is answered already has its part.
CANDIDATES = -1


class FirstOfKey(StatefulProcessor):
    """The best candidate (outcome 201) that a key first appears with stays one; the key's others become 409."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "taken boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        taken, best = None, None
        for row in rows:
            if row.outcome != 201:
                yield row
                continue
            if taken is None:
                taken = self.taken.exists()
            if taken:
                yield lost(row)
            elif best is None:
                best = row
            else:
                best, other = (row, best) if rank(row) < rank(best) else (best, row)
                yield lost(other)
        if best is not None:
            self.taken.update((True,))
            yield best

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self.taken.update((True,))

    def close(self) -> None:
        pass


def rank(row: Row) -> tuple:
    return (row.arrival is None, row.arrival or 0, row.mark)


def lost(row: Row) -> Row:
    return Row(**(row.asDict() | {"outcome": 409}))


def judged(documents: DataFrame, incoming: DataFrame, parts: int) -> DataFrame:
    """Incoming results with what their content and the documents alone tell: 400, 404, or 201 for a candidate."""
    reason, stored = registry.check_result_payload(F.col("payload"))
    good = F.col("reason").isNull()
    read = incoming.select("document_id", "arrival", "payload", reason.alias("reason"), stored.alias("stored"))
    read = read.withColumns({"stored": F.when(good, F.col("stored")), "mark": F.when(good, F.sha2("payload", 256))})
    # Rows that are equal in everything are parted by the place they are read at; a task that is repeated parts them alike.
    read = read.withColumn("part", F.pmod(F.xxhash64("arrival", "mark") + F.spark_partition_id(), F.lit(parts)).cast("int"))
    known = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("known")).where("document_id is not null").dropDuplicates(["document_id"])
    outcome = F.when(~good, 400).when(F.col("known").isNull(), 404).otherwise(201)
    return read.join(known, "document_id", "left").withColumn("outcome", outcome).drop("known")


def register_results_keyed(documents: DataFrame, results: DataFrame, incoming: DataFrame, parts: int = PARTS) -> DataFrame:
    """A stream of results (document_id, arrival, payload) with reason, stored and outcome (201, 400, 404 or 409).

    ``results``: the document_id of what is registered already, read when the stream first starts. The stream is
    written with the settings of ``STORE``, as ``write_results_keyed`` does.
    """
    every = judged(documents, incoming, parts)
    ours = {"outputStructType": every.schema, "outputMode": "append", "timeMode": "none"}
    first = every.where("outcome = 201").groupBy("document_id", "part").transformWithState(FirstOfKey(), **ours)
    slot = F.when(F.col("outcome") == 201, CANDIDATES).otherwise(F.col("part"))
    taken = results.select("document_id", F.lit(CANDIDATES).alias("slot")).where("document_id is not null").distinct()
    second = first.withColumn("slot", slot).groupBy("document_id", "slot").transformWithState(FirstOfKey(), **ours, initialState=taken.groupBy("document_id", "slot"))
    return every.where("outcome <> 201").unionByName(second).drop("mark", "part")


def write_results_keyed(documents: DataFrame, results: DataFrame, incoming: DataFrame, store: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Append every outcome to ``store`` as Parquet, each once whatever is repeated, until the input is read."""
    with settings(incoming.sparkSession, STORE):  # a query keeps those it starts with
        return register_results_keyed(documents, results, incoming, parts).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(store, "parquet")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings while something is started; they are as before afterwards."""
    earlier = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in earlier.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
