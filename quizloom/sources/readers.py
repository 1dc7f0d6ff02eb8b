"""Readers of question records, notes, vocabularies, registries and answer facts.

Small driver files (rules, vocabulary, registry) are YAML that the driver parses; everything that grows is
read by Spark.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from typing import Any

import pyarrow as pa
import yaml
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import front_and_body
from ..plans.rules import RuleError, SelectRules
from . import store

FOUND = "path string, size long, folder boolean"
BATCH_FILES, BATCH_BYTES = 1000, 8 << 20  #: a batch of contents ends with the file that reaches one of them


def listed_by_tasks(root: str, pattern: str) -> bool:
    """Whether tasks can list a folder themselves: it is there, they know its store, and neither name nor pattern needs Spark's globs."""
    if any(c in root for c in "*?[]{}\\" + "%#" * (not store.local(root))) or any(c in pattern for c in "[]{}\\"):
        return False
    try:
        system, folder = store.reached(root)
        return system.get_file_info(folder).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _within(root: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, folder) of what lies directly in each folder; what is hidden to Spark's readers is left out."""
    system, top = store.reached(root)
    top = top.rstrip("/")
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            inside = folder.removeprefix(root.rstrip("/"))
            found = [i for i in system.get_file_info(fs.FileSelector(top + inside)) if not (n := i.base_name).startswith(".") and not n.endswith("._COPYING_") and ("=" in n or not n.startswith("_"))]
            found = [i for i in found if i.type == fs.FileType.Directory or i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, pattern)]
            for at in range(0, len(found), 10000):
                some = found[at : at + 10000]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i in some], pa.string()),
                    "size": pa.array([i.size for i in some], pa.int64()),
                    "folder": pa.array([i.type == fs.FileType.Directory for i in some], pa.bool_()),
                })


def _contents(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_path, value): the bytes of each file, in the order of the rows."""
    system, top = store.reached(root)
    top = top.rstrip("/")
    for batch in batches:
        paths, values, size = [], [], 0
        for path in batch.column("path").to_pylist():
            with system.open_input_stream(top + path.removeprefix(root.rstrip("/")), compression=None) as f:
                value = f.read()
            paths.append(path)
            values.append(value)
            size += len(value)
            if len(paths) >= BATCH_FILES or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pydict({"_path": paths, "value": pa.array(values, pa.binary())})
                paths, values, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_pydict({"_path": paths, "value": pa.array(values, pa.binary())})


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size) of the files below a folder, without their contents.

    Folders are listed level by level, each by one task, so that no file passes through the driver. Stores and patterns
    that only Spark knows are listed by Spark's driver, which leaves out empty files."""
    root = store.named(spark, root)
    if not listed_by_tasks(root, pattern):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        return rows.select(F.col("path"), F.col("length").alias("size"))
    level, files = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path")), []
    while not files or not folders.isEmpty():
        found = store.kept(level.mapInArrow(partial(_within, root, pattern), FOUND), "listing")
        files.append(found.filter("not folder").select("path", "size"))
        folders = found.filter("folder").select("path")
        level = folders.repartition(store.shares(spark), "path")
    return reduce(DataFrame.unionByName, files)


def contents(files: DataFrame, root: str) -> DataFrame:
    """(_path, value): the files of a listing of the folder with their texts, in the order of the rows."""
    rows = files.select("path").mapInArrow(partial(_contents, root), "_path string, value binary")
    return rows.select("_path", F.col("value").cast("string").alias("value"))


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(_path, value): files below a folder whose name fits."""
    root = store.named(spark, root)
    if listed_by_tasks(root, pattern):
        return contents(listing(spark, root, pattern).repartition(store.shares(spark), "path"), root)
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # blanks and signs of a name are encoded
    return rows.select(plain.alias("_path"), "value")


def question_columns(value: Column) -> list[Column]:
    """The fields of a record, each tolerant of a wrong type; arrays keep their values as text."""
    out = []
    for f in schemas.QUESTION.fields:
        kind = "array<string>" if isinstance(f.dataType, T.ArrayType) else f.dataType.simpleString()
        out.append(F.try_variant_get(value, f"$.{f.name}", kind).alias(f.name))
    return out


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Tagged records below a folder: files that aren't an object with an id are left out; the path orders them."""
    files = whole_files(spark, root, "q*.json").filter(F.col("_path").rlike(r"/tagged/q[^/]*\.json$"))
    parsed = files.select("_path", F.try_parse_json("value").alias("v"))
    objects = parsed.filter(F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    rows = objects.select(*question_columns(F.col("v")), "_path", "v")
    rows = rows.filter(F.coalesce("id", F.lit("")) != "")
    return rows.withColumn("syllabus_codes", F.coalesce("syllabus_codes", F.array().cast("array<string>"))).withColumnRenamed("v", "extra")


def rejected_questions(spark: SparkSession, root: str) -> DataFrame:
    """The files that questions() leaves out, and why."""
    files = whole_files(spark, root, "q*.json").filter(F.col("_path").rlike(r"/tagged/q[^/]*\.json$"))
    v = F.try_parse_json("value")
    why = F.when(v.isNull(), "not_json").when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_object").when(F.coalesce(F.try_variant_get(v, "$.id", "string"), F.lit("")) == "", "no_id")
    return files.select("_path", why.alias("reason")).filter("reason is not null")


def notes(spark: SparkSession, root: str, stems: Sequence[str] = ()) -> DataFrame:
    """Notes with front matter and body; stems keep those whose file name holds one of them."""
    rows = whole_files(spark, root, "*.md").withColumn("stem", F.regexp_extract("_path", r"([^/]+)\.md$", 1))
    if stems:
        rows = rows.filter(F.exists(F.array(*map(F.lit, stems)), lambda s: F.contains(F.col("stem"), s)))
    return rows.select("_path", "stem", front_and_body(F.col("value")).alias("n")).select("_path", "stem", "n.front", "n.body")


def yaml_of(spark: SparkSession, path: str) -> Any:
    """A small YAML file, by any path that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    try:
        return yaml.safe_load(rows[0]["value"]) if rows else None
    except yaml.YAMLError as e:
        raise RuleError(f"{path}: {e}") from e


def rules(spark: SparkSession, path: str) -> SelectRules:
    return SelectRules.of(yaml_of(spark, path))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Topics with subtopics and outcomes, as nested rows."""
    tree = yaml_of(spark, path)
    if not isinstance(tree, dict) or not tree.get("topics"):
        raise RuleError(f"{path}: topics are missing")
    text = lambda x: None if x is None else str(x)
    rows = [
        (text(t.get("code")), text(t.get("title")), text(t.get("level")), text(t.get("group")),
         [(text(s.get("code")), text(s.get("title")), [(text(o.get("id")), text(o.get("text"))) for o in s.get("learning_outcomes") or []]) for s in t.get("subtopics") or []])
        for t in tree["topics"]
    ]
    kind = "code string, title string, level string, `group` string, subtopics array<struct<code:string,title:string,learning_outcomes:array<struct<id:string,text:string>>>>"
    return spark.createDataFrame(rows, kind)


def registry(spark: SparkSession, path: str) -> DataFrame:
    raw = yaml_of(spark, path) or {}
    names = schemas.REGISTRY.names
    rows = [tuple(int(r[n]) if n == "year" and r.get(n) is not None else None if r.get(n) is None else str(r[n]) for n in names) for r in raw.get("papers") or []]
    return spark.createDataFrame(rows, schemas.REGISTRY)


def pick(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a pick list with their places."""
    kinds = {f.name: f for f in schemas.QUESTION.fields}
    entry = T.StructType([*[kinds[n] for n in schemas.PICK_FIELDS], *[T.StructField(n, T.StringType()) for n in ("category", "source")]])
    whole = T.StructType([T.StructField("title", T.StringType()), T.StructField("slug", T.StringType()), T.StructField("questions", T.ArrayType(entry))])
    head = spark.read.schema(whole).option("multiLine", True).json(path)
    return head.select("title", "slug", F.posexplode("questions").alias("ord", "q")).select("title", "slug", "ord", "q.*")


def drafts(spark: SparkSession, root: str, only: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """(question, text, _path) of the drafts q*.txt of a folder in the order of the first number in their names; only keeps some questions.

    Names alone decide which drafts are read and in what order, so texts are read last, once and where they stay."""
    root = store.named(spark, root)
    apart = listed_by_tasks(root, "q*.txt")
    rows = listing(spark, root, "q*.txt").select(F.col("path").alias("_path")) if apart else whole_files(spark, root, "q*.txt")
    stem = F.regexp_extract("_path", r"/q([^/]+)\.txt$", 1)
    question = F.when(stem.rlike(r"^\d+$"), F.regexp_replace(stem, r"^0+(?=\d)", "")).otherwise(stem)
    rows = rows.withColumn("question", question).filter("question <> ''")
    if only:
        rows = rows.filter(F.col("question").isin(*map(str, only)))
    number = F.coalesce(F.regexp_extract("question", r"\d+", 0).try_cast("int"), F.lit(0))
    rows = rows.orderBy(number, "_path")
    rows = rows.limit(limit) if limit is not None else rows
    if apart:
        rows = contents(rows.select(F.col("_path").alias("path")), root).withColumn("question", question)
    return rows.select("question", F.col("value").alias("text"), "_path")


def code_titles(spark: SparkSession, root: str) -> DataFrame:
    """(code, title) of hub notes whose front matter (JSON flow) has a code; a note without a title is called by its file."""
    rows = notes(spark, root).select("_path", "stem", F.get_json_object("front", "$.code").alias("code"), F.get_json_object("front", "$.title").alias("title"))
    last = rows.filter("code is not null").groupBy("code").agg(F.max_by(F.struct("stem", "title"), "_path").alias("n"))
    return last.select("code", F.coalesce(F.nullif("n.title", F.lit("")), F.col("n.stem")).alias("title"))
