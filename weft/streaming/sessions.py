"""Streaming operators: deduplicated ingestion, template deltas with hash preconditions, caches and latches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.registry import query, read


def once(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"))


def apply_diffs(stream: DataFrame) -> DataFrame:
    """Session dictionaries: rows (session, epoch, key, value) are accepted if epoch is the next one and the
    key is new or says the same; everything else is refused with its reason."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, table = state.get if state.exists else (0, "")
        known = dict(x.split("=", 1) for x in table.split("\n") if x)
        out = []
        for f in frames:
            for r in f.sort_values("epoch").itertuples(index=False):
                reason = "wrong epoch" if r.epoch != epoch + 1 else "conflict" if known.get(str(r.key), r.value) != r.value else None
                if reason is None:
                    epoch, known[str(r.key)] = r.epoch, r.value
                out.append((key[0], int(r.epoch), reason or "accepted", epoch))
        state.update((epoch, "\n".join(f"{k}={v}" for k, v in known.items())))
        yield pd.DataFrame(out, columns=["session", "epoch", "answer", "at_epoch"])

    return stream.groupBy("session").applyInPandasWithState(run, "session string, epoch long, answer string, at_epoch long", "epoch long, known string", "append", GroupStateTimeout.NoTimeout)


def with_store(stream: DataFrame, store: str, sink: str, checkpoint: str):  # noqa: ANN201
    """Rows with the pattern of their template_id. The store is read anew for every batch, so what was added or
    retired in between counts; a batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(store).groupBy("template_id").agg(F.max("pattern").alias("pattern"))
        batch.join(known, "template_id", "left").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def learn(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Counts and sums of ratio per method, one small folder a batch, so that running a batch twice counts once."""

    def each(batch: DataFrame, number: int) -> None:
        g = batch.groupBy("method").agg(F.count("ratio").alias("n"), F.sum("ratio").alias("total"))
        g.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def learnt(spark: SparkSession, path: str) -> DataFrame:
    """method, n and mean_ratio over all batches."""
    g = spark.read.parquet(path).groupBy("method").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return g.select("method", "n", F.try_divide("total", "n").alias("mean_ratio"))


@query("str_once_per_key", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("str_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("str_resume_lookup", "SELECT user_id, max_by(event_id, ts) AS state FROM events WHERE event_type = 'view' GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("state"))
