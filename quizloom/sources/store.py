"""A versioned store of keyed texts: each version holds only what changed, and what went as a tombstone.

A version is a folder of Parquet files that Spark commits as a whole; one that lost its job has no success mark and is not read. The
state is the last row of each path; a base holds all of it, so that readers need no version before it. One writer at a time.
"""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ROWS = "path string, kind string, value string, digest string, gone boolean"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for files that all executors see; a temporary one where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quizloom-")
    return root


def named(spark: SparkSession, path: str) -> str:
    """The path with its store. One without is in Spark's default store, and tasks cannot ask which that is."""
    if re.match(r"[a-zA-Z][\w+.-]*:/", path):
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/(?!/)", "file:///", whole)


def local(path: str) -> str | None:
    """The folder of a local path, whose signs stand for themselves as they do to Spark; None in other stores."""
    found = re.fullmatch("(?:file:(?://(?=/))?)?(/(?!/).*)", path, re.DOTALL)
    return found and found[1]


def reached(path: str) -> tuple:
    """(store, folder) of a path, for tasks."""
    from pyarrow import fs

    folder = local(path)
    return (fs.LocalFileSystem(), folder) if folder else fs.FileSystem.from_uri(path)


SHARE = 500_000  #: rows that a task holds


def shares(spark: SparkSession, rows: int = 0) -> int:
    """Partitions for work that takes its time or memory by the row, as with files: small rows would else meet in few tasks."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-rows // SHARE))


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows that several plans read, written once to the shared folder."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/quizloom/{uuid.uuid4().hex}/{name}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _folders(spark: SparkSession, root: str) -> list[str]:
    """Committed versions and bases, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [f.getPath().getName() for f in system.listStatus(path)]
    done = [n for n in names if n[:1] in "vb" and n[1:].isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(done, key=lambda n: (int(n[1:]), n[0] == "v"))


def current(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, value, digest): the last state of the store."""
    names = _folders(spark, root)
    base = max((i for i, n in enumerate(names) if n[0] == "b"), default=0)
    if not names:
        return spark.createDataFrame([], ROWS).drop("gone")
    rows = spark.read.schema(ROWS).parquet(*[f"{root}/{n}" for n in names[base:]])
    rows = rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"/[vb](\d+)/[^/]+$", 1).cast("long"))
    last = rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version")))).filter("nth = 1 and not gone")
    return last.select("path", "kind", "value", "digest")


def changes(notes: DataFrame, before: DataFrame) -> DataFrame:
    """What has to be written for notes (path, kind, value), of distinct paths, to replace the state before: new, changed and gone rows, by digest."""
    fresh = notes.select("path", "kind", "value", F.sha2("value", 256).alias("digest"))
    old = before.select("path", F.col("kind").alias("old_kind"), F.col("digest").alias("old_digest"))
    met = fresh.join(old, "path", "full")
    change = F.when(F.col("digest").isNull(), "gone").when(F.col("old_digest").isNull(), "new").when(F.col("digest") != F.col("old_digest"), "changed")
    return met.withColumn("change", change).filter("change is not null").select("path", F.coalesce("kind", "old_kind").alias("kind"), "value", "digest", (F.col("change") == "gone").alias("gone"), "change")


def publish(notes: DataFrame, root: str) -> DataFrame:
    """Writes what changed as the next version and gives it back, read from there; nothing is written where nothing changed."""
    spark = notes.sparkSession
    names = _folders(spark, root)
    target = f"{root}/v{1 + max((int(n[1:]) for n in names), default=0):08d}"
    changes(notes, current(spark, root)).write.mode("overwrite").parquet(target)  # over what a lost job may have left
    out = spark.read.schema(ROWS + ", change string").parquet(target)
    if out.isEmpty():
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return spark.createDataFrame([], ROWS + ", change string")
    return out


def compact(spark: SparkSession, root: str) -> None:
    """Writes the whole state as a base with the number of the last version; the folders before it are no longer read."""
    names = _folders(spark, root)
    if names and names[-1][0] == "v":
        current(spark, root).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{root}/b{int(names[-1][1:]):08d}")


class Done(WriterCommitMessage):
    pass


class NoteFiles(DataSource):
    """Format "note_files": writes rows (path, value, gone) as files below the folder given by the option path; a row that is gone removes its file."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def writer(self, schema, overwrite: bool) -> "NoteWriter":
        return NoteWriter(self.options["path"])


class NoteWriter(DataSourceArrowWriter):
    """A file is written whole under another name and then moved, so that a repeated task or a lost one leaves no half note."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator) -> Done:
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = reached(self.root)
        attempt = TaskContext.get().taskAttemptId()
        made = set()
        for batch in iterator:
            for path, value, gone in zip(*[batch.column(c).to_pylist() for c in ("path", "value", "gone")]):
                clean = posixpath.normpath(path)
                if clean.startswith(("/", "..")) or clean != path:
                    raise ValueError(f"no path inside the folder: {path!r}")
                target = f"{folder}/{clean}"
                if gone:
                    if system.get_file_info(target).type != fs.FileType.NotFound:
                        system.delete_file(target)
                    continue
                if (parent := posixpath.dirname(target)) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                draft = f"{parent}/.{posixpath.basename(target)}.{attempt}"
                with system.open_output_stream(draft, compression=None) as out:
                    out.write((value or "").encode())
                system.move(draft, target)
        return Done()


def write_files(changed: DataFrame, folder: str) -> None:
    """The rows of publish() as files below a folder."""
    spark = changed.sparkSession
    spark.dataSource.register(NoteFiles)
    changed.select("path", "value", "gone").repartition(shares(spark), "path").write.format("note_files").mode("append").save(named(spark, folder))
