"""Structured Streaming scoring and churn-rate monitoring (engine addition).

New customer files arriving in a folder are scored with the frozen plans of
a trained pipeline (clean -> features -> preprocessing -> model): all narrow
transformations, so every micro-batch is scored independently and the
stream result equals the batch result for the same files. The monitor keeps
running counts in state (one row per stream) and reports the predicted churn
rate against the historical one, per micro-batch, through ``foreachBatch``
into a Parquet table in the shared output folder. A query that is given the
``sink`` and ``checkpoint`` folders of an earlier one resumes where that stopped;
without them it gets new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.operators import score as S
from churnspark.plans.pipeline import new_rows
from churnspark.sources.io import new_output_path


def scored_stream(stream: DataFrame, result, threshold: float | None = None) -> DataFrame:
    """SCR1-3 on a streaming frame with a fitted ``PipelineResult``."""
    batch = new_rows(result, stream)
    scored = result.trainer.score(result.final, batch)
    t = result.threshold if threshold is None else threshold
    return S.predictions(scored, result.trainer.key, t)


def run_scoring(spark: SparkSession, source_dir: str, schema, result, fmt: str = "parquet",
                max_files: int = 1, sink: str | None = None, checkpoint: str | None = None) -> tuple[str, str]:
    """Score every file in ``source_dir`` (availableNow) into a Parquet sink; returns (sink, checkpoint)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt)
              .load(source_dir))
    out = scored_stream(stream, result)
    sink = sink or new_output_path(spark, "stream-predictions")
    ckpt = checkpoint or new_output_path(spark, "stream-checkpoint")
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return sink, ckpt


def run_monitor(spark: SparkSession, source_dir: str, schema, result, fmt: str = "parquet",
                max_files: int = 1, sink: str | None = None, checkpoint: str | None = None) -> str:
    """SCR5 on a stream: running predicted churn rate vs the historical rate after each micro-batch."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt)
              .load(source_dir))
    preds = scored_stream(stream, result)
    running = preds.groupBy().agg(F.count(F.lit(1)).alias("total"),
                                  F.count_if(F.col("churn_prediction") == "Yes").alias("churning"))
    hist = float(result.churn_rate or 0.0)
    sink = sink or new_output_path(spark, "stream-monitor")
    ckpt = checkpoint or new_output_path(spark, "stream-monitor-checkpoint")

    def emit(batch: DataFrame, batch_id: int):
        rate = F.col("churning") / F.greatest(F.col("total"), F.lit(1))
        # a folder per batch, overwritten when the batch is repeated after a failure
        batch.select("total", "churning", *S.churn_monitor(rate, F.lit(hist))).write.mode("overwrite").parquet(
            f"{sink}/batch_id={batch_id}")

    q = (running.writeStream.outputMode("complete").foreachBatch(emit).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def run_windowed_monitor(spark: SparkSession, source_dir: str, schema, result, time_col: str = "signup_date",
                         window: str = "30 days", watermark: str | None = None, fmt: str = "parquet",
                         max_files: int = 1, sink: str | None = None, checkpoint: str | None = None) -> str:
    """SCR5 per event-time window: predicted churn share of each window (e.g. signup cohorts) against the
    historical rate. Every window stays in state (as many as the cohorts have months), so rows count in
    whatever order the files come; a ``watermark`` may be given where event times arrive in order. Updates
    go to a Parquet table, one row per (batch, window)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt)
              .load(source_dir))
    batch = new_rows(result, stream)
    t_col = time_col.strip().lower().replace(" ", "_").replace("-", "_")
    scored = result.trainer.score(result.final, batch, keep=[t_col])
    t = F.to_timestamp(F.col(t_col))
    thr = float(result.threshold)
    timed = scored.withColumn("__t", t)
    windows = ((timed.withWatermark("__t", watermark) if watermark else timed)
               .groupBy(F.window("__t", window).alias("w"))
               .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p") >= thr).alias("churning")))
    hist = float(result.churn_rate or 0.0)
    sink = sink or new_output_path(spark, "stream-window-monitor")
    ckpt = checkpoint or new_output_path(spark, "stream-window-monitor-checkpoint")

    def emit(b: DataFrame, batch_id: int):
        rate = F.col("churning") / F.greatest(F.col("total"), F.lit(1))
        b.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "churning",
                 *S.churn_monitor(rate, F.lit(hist))).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (windows.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def latest_windows(spark: SparkSession, sink: str) -> DataFrame:
    """The last update of every window (one row per window)."""
    from pyspark.sql import Window
    df = spark.read.parquet(sink)
    w = Window.partitionBy("window_start").orderBy(F.col("batch_id").desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "batch_id")
