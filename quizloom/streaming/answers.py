"""Answer events as streams: latest-wins merges and the progress state of each learner and question."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import latest_by


def merge_into(path: str, keys: Sequence[str], stamps: Sequence[str] = ("answered_at", "id"), parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the newest row of each key, whatever the order of arrival.

    The table is kept in parts by a hash of the key; a batch rewrites only the parts that it touches, each from
    the version before to a new one, so replaying a batch gives the same table. The new rows are written beside the table first: what
    overwrites a part never reads it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = latest_by(batch, keys, stamps).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        try:
            touched = [r["part"] for r in batch.select("part").distinct().collect()]  # at most parts numbers
            if not touched:
                return
            try:
                old = spark.read.parquet(path).filter(F.col("part").isin(touched))
                merged = latest_by(old.unionByName(batch), keys, stamps)
            except Exception as e:  # the first batch
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                merged = batch
            merged.write.mode("overwrite").parquet(f"{path}-next")
            fresh = spark.read.schema(merged.schema).parquet(f"{path}-next")
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        finally:
            batch.unpersist()

    return run


def start_merge(events: DataFrame, path: str, checkpoint: str, keys: Sequence[str], stamps: Sequence[str] = ("answered_at", "id")) -> StreamingQuery:
    return events.writeStream.foreachBatch(merge_into(path, keys, stamps)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "seen long, ok boolean, at array<timestamp>, id array<long>, right array<boolean>"
PROGRESS = "student_id long, question_id string, seen long, ok boolean, mistakes long"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Mistakes since the last right answer don't depend on the order of arrival: the state holds that answer and those after it."""
    seen, ok, at, ids, right = state.get if state.exists else (0, False, [], [], [])
    rows = list(zip(at, ids, right))
    for b in batches:
        fresh = list(zip(b["answered_at"], b["id"], b["correct"].astype(bool)))
        seen += len(fresh)
        rows += fresh
    rows.sort(key=lambda r: (pd.Timestamp(r[0]), r[1]))
    hits = [i for i, r in enumerate(rows) if r[2]]
    ok = bool(ok or hits)
    if hits:
        rows = rows[hits[-1] :]
    state.update((seen, ok, [r[0] for r in rows], [int(r[1]) for r in rows], [bool(r[2]) for r in rows]))
    yield pd.DataFrame({"student_id": [key[0]], "question_id": [key[1]], "seen": [seen], "ok": [ok], "mistakes": [sum(not r[2] for r in rows)]})


def progress(events: DataFrame) -> DataFrame:
    """The state of each learner and question after each batch that touches it."""
    rows = events.select("student_id", "question_id", "answered_at", "id", "correct")
    return rows.groupBy("student_id", "question_id").applyInPandasWithState(fold, PROGRESS, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_activity(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Answers and learners by window of event time, late ones within the watermark."""
    return events.withWatermark("answered_at", late).groupBy(F.window("answered_at", size)).agg(F.count("*").alias("n"), F.approx_count_distinct("student_id").alias("students"))
