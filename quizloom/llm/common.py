"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quizloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quizloom/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quizloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that no later plan reads."""
    path = getattr(df, "_quizloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_row_each(rows: DataFrame) -> DataFrame:
    """Of each doc_id one row, the one whose content has the smallest hash, so that repeated ids don't outgrow a bounded sample."""
    others = [c for c in rows.columns if c != "doc_id"]
    (place,) = free(rows, "place")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*others), *others)
    return rows.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)


def id_crc(col: Column) -> Column:
    """crc32 of the decimal text of an id; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def text_parts(docs: DataFrame, per_part: int = 8 << 20, least: int = 1) -> int:
    """Number of partitions that hold about per_part bytes of text each; grows with the input."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(least, -(-int(total) // per_part))


def sliced(batches, rows: int = 512):
    """The same rows in small batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i], starts[i]+1, ... of lengths[i] each."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash, on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
