"""Counters of running streams, taken as the rows pass (observe), one row for each micro-batch: no second pass over anything."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Ranks that are counted: 2**40 batches.
RANKS = 40


def counted(answers: DataFrame, name: str = "counters") -> DataFrame:
    """answers of stream_coresets(), which count shards that answered, points given and coresets made of each rank as they pass."""
    made = [F.sum(F.coalesce(F.get("reduced", r), F.lit(0))).alias(f"rank{r}") for r in range(RANKS)]
    return answers.observe(name, F.sum(F.col("reduced").isNotNull().cast("long")).alias("answers"), F.count("*").alias("points"), *made)


class Counters(StreamingQueryListener):
    """Gathers what streams report under a name; add with spark.streams.addListener()."""

    def __init__(self, name: str = "counters"):
        self.name, self.rows, self.lock = name, {}, threading.Condition()
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        with self.lock:
            if self.name in p.observedMetrics:
                self.rows[str(p.runId), p.batchId] = (p.batchId, p.numInputRows, p.observedMetrics[self.name].asDict())
            self.lock.notify_all()

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            self.ended.add(str(event.runId))
            self.lock.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Until a run's last report is here: they come a moment after the run."""
        with self.lock:
            if not self.lock.wait_for(lambda: str(run_id) in self.ended, seconds):
                raise TimeoutError(f"no end of run {run_id} was reported")

    def frame(self, spark: SparkSession) -> DataFrame:
        """batch, rows (read), counter, n."""
        rows = [(batch, read, k, int(v or 0)) for batch, read, own in self.rows.values() for k, v in own.items()]
        return spark.createDataFrame(rows, "batch long, rows long, counter string, n long")
