"""State of a stream as tables: one of the state and one of the results for every micro-batch.

For operators whose work on a micro-batch needs more than one key (orders, newest rows, ranks): the micro-batch and the
state before it are DataFrames, the batch operators give the results and the state after it. A micro-batch that is run
again after a failure reads the state that stood before it and overwrites its own tables, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepane.functions.timegrid import duration_us, micros
from tidepane.operators import profile
from tidepane.operators.merge import adaptive_limit
from tidepane.operators.ordered import neighbour_in, ordinal_in, to_blocks
from tidepane.session import drop_folder, staging_path, versions


class TableState:
    """A function for ``foreachBatch``; ``folder`` is on storage that all executors share."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def answer(self, rows: DataFrame, known: DataFrame | None, batch_id: int) -> None:
        """Put the tables ``out`` and ``known`` of a micro-batch that has rows, from the state before it."""
        raise NotImplementedError

    def at(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/batch={batch_id}"

    def put(self, kind: str, df: DataFrame, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.at(kind, batch_id))
        return df.sparkSession.read.schema(df.schema).parquet(self.at(kind, batch_id))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = self.put("given", batch, batch_id)  # read several times, taken from the stream once
        if not rows.isEmpty():
            before = [n for n in versions(spark, f"{self.folder}/known") if n < batch_id]
            self.answer(rows, spark.read.parquet(self.at("known", before[-1])) if before else None, batch_id)
            for old in before[:-1]:  # the last one stays, for this micro-batch to be run again
                drop_folder(spark, self.at("known", old))
        drop_folder(spark, self.at("given", batch_id))

    def results(self, spark: SparkSession) -> DataFrame | None:
        """All results so far with their ``batch``; None before the first."""
        done = versions(spark, f"{self.folder}/out")
        return spark.read.option("basePath", f"{self.folder}/out").parquet(*[self.at("out", n) for n in done]) if done else None

    def start(self, stream: DataFrame, available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
        """Started again with the same folder, the stream goes on where it stopped."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()

    def drain(self, stream: DataFrame) -> DataFrame | None:
        """Run over all data present and return the results so far."""
        self.start(stream, available_now=True).awaitTermination()
        return self.results(stream.sparkSession)


class LiveProfile(TableState):
    """Signatures of a live stream: ``out`` has those of every topic that got rows in the micro-batch.

    The state is the buffer of the ``points`` newest rows of each topic, whatever order rows arrive in. Of a
    micro-batch's rows no more than that many leave a task for a topic, so a hot topic meets no single task with its
    rows. A signature equals the batch one over all rows so far.
    """

    def __init__(self, folder: str, points: int = profile.BUFFER_POINTS):
        super().__init__(folder)
        self.points = points

    def answer(self, rows: DataFrame, known: DataFrame | None, batch_id: int) -> None:
        given = rows.select("topic", "subject", "ts", "value")
        every = given if known is None else given.unionByName(known.select(given.columns))
        buffer = self.put("known", profile.last_n(every, self.points), batch_id)
        touched = buffer.join(given.select("topic").distinct(), "topic", "left_semi")
        self.put("out", profile.stream_signature(touched, points=self.points), batch_id)


class LiveGaps(TableState):
    """Alerts for topics that stay silent longer than their adaptive timeout: ``topic, silent_us, timeout_ms, resumed_us``.

    A result that ends a longer silence gives its own time. A silence without an end is reported when the newest
    time of all topics less ``max_delay`` has passed it, once; ``resumed_us`` is null then. Results older than that
    line are left out. The state is five numbers per topic.
    """

    def __init__(
        self, folder: str, max_delay: str, min_samples: int = 3, multiplier: float = 0.5, fallback_ms: float = 5000, max_ms: float = 15000
    ):
        super().__init__(folder)
        self.delay_ms = duration_us(max_delay) // 1000
        self.rule = {"min_samples": min_samples, "multiplier": multiplier, "fallback_ms": fallback_ms, "max_ms": max_ms}

    def answer(self, rows: DataFrame, known: DataFrame | None, batch_id: int) -> None:
        us = rows.select("topic", micros("ts").alias("us")).filter(F.col("us").isNotNull())
        if known is None:
            known = rows.sparkSession.createDataFrame([], "topic string, first bigint, last bigint, seen bigint, alerted boolean, mark bigint")
        mark = known.agg(F.max("mark")).first()[0]
        if mark is not None:
            us = us.filter(F.col("us") >= mark * 1000)
        blocks = to_blocks(us, ["topic"], ["us"])
        # a row's number and predecessor come from the same blocks, joined back to the topic's state
        placed = neighbour_in(to_blocks(ordinal_in(blocks, "i"), ["topic"], ["us", "i"]), {"before": "us"}, step=-1)
        held = placed.join(known.select("topic", "first", "last", "seen", "alerted"), "topic", "left")
        figures = us.groupBy("topic").agg(F.min("us").alias("least"), F.max("us").alias("most"), F.count(F.lit(1)).alias("n"))
        held = held.join(figures.select("topic", "least"), "topic")
        seen = F.coalesce("seen", F.lit(0)) + F.col("i") - 1
        newest = F.greatest("last", "before")
        oldest = F.when(F.col("i") > 1, F.least("first", "least")).otherwise(F.col("first"))
        told = F.coalesce("alerted", F.lit(False)) & F.coalesce(F.col("before") <= F.col("last"), F.lit(True))
        gaps = held.select("topic", newest.alias("silent_us"), adaptive_limit(oldest, newest, seen, **self.rule).alias("timeout_ms"), F.col("us").alias("resumed_us"), told.alias("told"))
        silence = (F.col("resumed_us") - F.col("silent_us")) / F.lit(1000)
        ended = gaps.filter(~F.col("told") & (silence > F.col("timeout_ms"))).drop("told")
        state = known.join(figures, "topic", "full").select(
            "topic",
            F.least("first", "least").alias("first"),
            F.greatest("last", "most").alias("last"),
            (F.coalesce("seen", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen"),
            (F.coalesce("alerted", F.lit(False)) & ~F.coalesce(F.col("most") > F.col("last"), F.lit(False))).alias("alerted"),
        )
        state = self.put("moved", state, batch_id)
        now = state.agg(F.max("last")).first()[0]
        line = now // 1000 - self.delay_ms
        limit = adaptive_limit(F.col("first"), F.col("last"), F.col("seen"), **self.rule)
        due = F.floor(F.col("last") / F.lit(1000) + limit) + 1 < line
        open_ended = state.filter(~F.col("alerted") & due).select("topic", F.col("last").alias("silent_us"), limit.alias("timeout_ms"), F.lit(None).cast("bigint").alias("resumed_us"))
        self.put("out", ended.unionByName(open_ended), batch_id)
        self.put("known", state.withColumn("alerted", F.col("alerted") | due).withColumn("mark", F.lit(line).cast("bigint")), batch_id)
        drop_folder(state.sparkSession, self.at("moved", batch_id))


def stream_profile(obs: DataFrame, folder: str | None = None, points: int = profile.BUFFER_POINTS) -> DataFrame | None:
    """:class:`LiveProfile` over all data present."""
    return LiveProfile(folder or staging_path(obs.sparkSession, "profile"), points).drain(obs)


def stream_gaps(results: DataFrame, max_delay: str, folder: str | None = None, **rule: float) -> DataFrame | None:
    """:class:`LiveGaps` over all data present, with times as ``silent_since`` and ``resumed_at``."""
    found = LiveGaps(folder or staging_path(results.sparkSession, "gaps"), max_delay, **rule).drain(results)
    return found and found.select(
        "topic",
        F.timestamp_micros("silent_us").alias("silent_since"),
        "timeout_ms",
        F.timestamp_micros("resumed_us").alias("resumed_at"),
    )
