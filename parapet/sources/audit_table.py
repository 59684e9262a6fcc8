"""The audit sink: an append-only parquet table, split by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parapet.policy import Policy


def write_audit(audit: DataFrame, path: str, policy: Policy | None = None) -> bool:
    """Append the events under ``path``, partitioned by ``dt``; does nothing if the policy turns audit events off.

    The rebalance hint lets adaptive execution split a busy day over many writers and join quiet ones, so neither one
    task nor a swarm of tiny files results.
    """
    if policy is not None and not policy.emit_audit:
        return False
    dated = audit.withColumn("dt", F.to_date("started_at"))
    dated.hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)
    return True


def write_run(audit: DataFrame, path: str, run: str, policy: Policy | None = None) -> bool:
    """Write one run's events under ``path``, partitioned by ``run`` and ``dt``; a rerun takes the place of the run.

    A job that failed half way, or is started twice, leaves what it would have left once: the run's own folder is
    overwritten and other runs are not touched. Days of an earlier try that the rerun does not have go too.
    """
    if policy is not None and not policy.emit_audit:
        return False
    if not run or any(c in run for c in "/\\=:*?") or run.startswith("."):
        raise ValueError("a run's name is part of a folder's")
    dated = audit.drop("run").withColumn("dt", F.to_date("started_at"))
    dated.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(f"{path.rstrip('/')}/run={run}")
    return True


def append_once(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Start writing a stream's events as runs named by their micro-batch: one that is repeated after a failure replaces
    what it wrote before."""
    def write(batch: DataFrame, number: int) -> None:
        write_run(batch, path, f"batch-{number:09d}")

    return (stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start())


def read_audit(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
