"""Result rows that arrive in any order, joined to whole facts by a stateful operator: a fact's metrics are emitted once.

A fact's states are held until all are there; then one row leaves and the state goes, but for a mark that it left, until
the fact's timer ends. A fact that stays incomplete leaves as such at that time, so what is held is bounded by the facts
of one horizon, not by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memaudit.operators import metrics

#: The state store that keeps map states and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCORES = tuple(metrics.ROW_SCORES.values())
OUT = "fact_id string, complete boolean, missing array<string>, f boolean, n boolean, o boolean, rows long, " + ", ".join(f"{s} double" for s in SCORES)


_FACT = Row(*(part.split()[0] for part in OUT.split(", ")))


class Complete(StatefulProcessor):
    """Holds the last row of each state of a fact (by row_index) until the watermark is horizon_ms beyond its first row."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "state string", "row_index long, correct boolean, scores array<double>")
        self.left = handle.getValueState("left", "complete boolean")

    def _row(self, fact: str) -> Row:
        rows = {name[0]: value for name, value in self.held.iterator()}
        missing = [s for s in metrics.STATES if s not in rows]
        right = [rows[s][1] if s in rows else None for s in metrics.STATES]
        sums = [float(sum(value[2][i] for value in rows.values())) for i in range(len(SCORES))]
        return _FACT(fact, not missing, missing, *right, len(rows), *sums)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = list(rows)  # a fact's rows in one batch: three, and repeats
        if self.left.exists():
            return iter(())  # a repeat of a fact that has left
        if not self.held.exists():
            self.handle.registerTimer(max(min(r.at_ms for r in arrived), timerValues.getCurrentWatermarkInMs()) + self.horizon_ms)
        for r in arrived:
            old = self.held.getValue((r.state,)) if self.held.containsKey((r.state,)) else None
            if old is None or r.row_index >= old[0]:
                self.held.updateValue((r.state,), (r.row_index, r.correct, list(r.scores)))
        if not all(self.held.containsKey((s,)) for s in metrics.STATES):
            return iter(())
        out = self._row(key[0])
        self.held.clear()
        self.left.update((True,))
        return iter([out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What is held leaves incomplete; the mark of a fact that left goes, so that nothing stays of it."""
        out = [self._row(key[0])] if self.held.exists() else []
        self.held.clear()
        self.left.clear()
        return iter(out)

    def close(self) -> None:
        pass


def complete_facts(results: DataFrame, time: str, late: str = "1 day", horizon_ms: int = 24 * 3_600_000) -> DataFrame:
    """A stream of result rows (fact_id, state, ground_truth, object_aliases, model_output, row_index, and the timestamp
    `time`) as rows of whole facts (OUT): f, n, o, how many states were scored and the sums of their scores.

    A fact leaves once: complete, or with what is missing when the watermark (`late` behind the latest time) is horizon_ms
    beyond its first row. Later rows of it are ignored, unless they come so late that it was forgotten. Rows behind the
    watermark and other states are left out; a null row_index counts as 0.
    """
    spark = results.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = metrics.scored(results.withWatermark(time, late)).where(F.col("state").isin(*metrics.STATES))
    rows = rows.select(F.col("fact_id").cast("string").alias("fact_id"), "state", F.coalesce(F.col("row_index").cast("long"), F.lit(0).cast("long")).alias("row_index"), "correct", F.array(*[F.col(f"scores.{s}").cast("double") for s in SCORES]).alias("scores"), F.unix_millis(time).alias("at_ms"), time)
    return rows.groupBy("fact_id").transformWithState(Complete(horizon_ms), OUT, "Append", "EventTime")


def totals(facts: DataFrame) -> DataFrame:
    """metrics_total(traces=False) of the table that complete_facts() filled."""
    means = [F.coalesce(F.try_divide(F.sum(s), F.sum("rows")), F.lit(0.0)).alias(name) for name, s in metrics.ROW_SCORES.items()]
    return facts.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("count"), *means, *metrics.pair_aggregates())
