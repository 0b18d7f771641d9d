"""Job state, deduplicated ingest, sessions and rate limits, as batches and as streams."""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


def job_states(events: DataFrame) -> DataFrame:
    """The newest state of each job, its events and their sum. Runs on streams in update or complete mode too."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"), F.sum("value").alias("total"))


def counters(events: DataFrame, job: str, outcome: str, outcomes: list[str], at: str) -> DataFrame:
    """job, n_<outcome> .., cursor: what a job has done so far and the last event counted. Runs on streams in update or complete mode too."""
    return events.groupBy(job).agg(*[F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes], F.max(at).alias("cursor"))


def resumed_counters(saved: DataFrame, events: DataFrame, job: str, outcome: str, outcomes: list[str], at: str) -> DataFrame:
    """Saved counters and the events after each job's cursor: an event that was counted before a stop is not counted again."""
    held = saved.select(F.col(job).alias("__job"), F.col("cursor").alias("__cursor"))
    fresh = events.join(held, F.col(job) == F.col("__job"), "left").filter(F.col("__cursor").isNull() | (F.col(at) > F.col("__cursor"))).drop("__job", "__cursor")
    both = saved.select(job, *[f"n_{o}" for o in outcomes], "cursor").unionByName(counters(fresh, job, outcome, outcomes, at))
    return both.groupBy(job).agg(*[F.sum(f"n_{o}").alias(f"n_{o}") for o in outcomes], F.max("cursor").alias("cursor"))


def first_by_hash(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.min(key).alias(key)).select(key, "content_hash")


def new_content(stream: DataFrame, text: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream without contents seen before within the watermark; state stays bounded by it."""
    return stream.withWatermark(at, late).withColumn("content_hash", F.sha2(text, 256)).dropDuplicatesWithinWatermark(["content_hash"])


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Write each micro-batch as a new version of a keyed Parquet table: path/v=<batch>, the newest wins.

    A batch that runs again after a failure writes the same version, so rows
    are neither lost nor doubled.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates([key]).withColumn("__epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def newest_versions(table: DataFrame, key: str) -> DataFrame:
    """The last written row of each key of an upsert table."""
    rest = [c for c in table.columns if c not in (key, "v", "__epoch")]
    g = table.groupBy(key).agg(F.max_by(F.struct(*rest), "__epoch").alias("r"))
    return g.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def sessions(df: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """Number the runs of an unchanged item: a change opens a new session."""
    w = Window.partitionBy(key).orderBy(order)
    changed = ~F.col(item).eqNullSafe(F.lag(item).over(w)) | F.lag(F.lit(1)).over(w).isNull()
    return df.withColumn("__new", F.when(changed, 1).otherwise(0)).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def requests_in_window(df: DataFrame, user: str, at: str, seconds: int) -> DataFrame:
    """How many requests of the user lie in the seconds up to each request, itself included."""
    w = Window.partitionBy(user).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return df.withColumn("in_window", F.count("*").over(w))


def accepted(df: DataFrame, user: str, at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """tie, accepted: at most ``limit`` accepted requests in any ``seconds``; refused ones do not count.

    The rule is sequential in each user. Users are dealt to tasks and sorted;
    a task folds their requests one after another and carries at most ``limit``
    times, however many requests a user has.
    """

    def run(batches):
        who, live = object(), deque()
        for b in batches:
            out = []
            for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if u != who:
                    who, live = u, deque()
                while live and live[0] <= t - seconds:
                    live.popleft()
                ok = len(live) < limit
                if ok:
                    live.append(t)
                out.append(ok)
            yield pa.record_batch([b.column(2), pa.array(out, pa.bool_())], names=[tie, "accepted"])

    kind = dict(df.dtypes)[tie]
    rows = df.select(F.col(user).alias("u"), F.col(at).cast("timestamp").cast("double").alias("t"), F.col(tie)).filter("t IS NOT NULL")
    return rows.repartition("u").sortWithinPartitions("u", "t", tie).mapInArrow(run, f"{tie} {kind}, accepted boolean")


def accepted_stream(stream: DataFrame, user: str, at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """user, tie, accepted of a stream: the rule of ``accepted`` in order of arrival; state is a user's live times."""
    out = StructType([StructField(user, _type(stream, user)), StructField(tie, _type(stream, tie)), StructField("accepted", BooleanType())])

    def run(key, frames, state: GroupState):
        live = deque(state.get[0]) if state.exists else deque()
        for f in frames:
            ok = []
            f = f.sort_values(["t", tie])
            for t in f["t"]:
                while live and live[0] <= t - seconds:
                    live.popleft()
                ok.append(len(live) < limit)
                if ok[-1]:
                    live.append(t)
            yield pd.DataFrame({user: [key[0]] * len(f), tie: f[tie].to_numpy(), "accepted": ok})
        state.update((list(live),))

    rows = stream.select(F.col(user), F.col(tie), F.col(at).cast("timestamp").cast("double").alias("t"))
    return rows.groupBy(user).applyInPandasWithState(run, out, "live array<double>", "append", GroupStateTimeout.NoTimeout)


def _type(df: DataFrame, name: str):
    return df.schema[name].dataType
