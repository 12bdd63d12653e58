"""Readers of result files: whole JSON documents and JSON lines, gzip by suffix.

Rows of ``read_posts``:

* ``src_file``, ``src_stem`` -- where the post comes from;
* ``src_block``, ``pos`` -- order inside the file (``FILE_ORDER`` sorts by arrival);
* ``raw`` -- the post's JSON text.

JSON-lines files that are not compressed are split over tasks. A JSON document and a
gzip file are one unit for Spark, as for any reader: keep such files small enough for
one task, or store big captures as plain JSON lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedframe.constants import DOCUMENT_EXTENSIONS, INPUT_EXTENSIONS, LINE_EXTENSIONS
from feedframe.functions.once import computed, exploded
from feedframe.functions.json import is_json, strip
from feedframe.functions.scalars import input_stem
from feedframe.schemas import RUN_DOCUMENT_SCHEMA

FILE_ORDER = ("src_file", "src_block", "pos")


class Runs(NamedTuple):
    """Tables of saved result documents: one row per run, per post and per user."""

    runs: DataFrame
    posts: DataFrame
    users: DataFrame


def _inside(path: str, extensions: tuple[str, ...]) -> str:
    """A pattern for the files of a folder's own level with one of the extensions; hidden ones are none."""
    return f"{path.rstrip('/')}/[^_.]{_named(extensions)}"


def _named(extensions: tuple[str, ...]) -> str:
    return f"*{{{','.join(extensions)}}}"


def inputs(spark: SparkSession, path: str, extensions=INPUT_EXTENSIONS) -> Iterator[str]:
    """The input files of a directory (its own level only), in no order, as far as they are asked for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_inside(path, extensions))
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return (f.getPath().toString() for f in found if f.isFile())


def list_inputs(spark: SparkSession, path: str, extensions=INPUT_EXTENSIONS) -> list[str]:
    """The input files of a directory (its own level only), sorted."""
    return sorted(inputs(spark, path, extensions))


def _has_folders(spark: SparkSession, path: str) -> bool:
    """Whether a directory has others in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place)
    return summary.getDirectoryCount() > 1


def is_directory(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder rather than one file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether there is nothing at ``path``, or a folder with nothing in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(place) or len(files.listStatus(place)) == 0


def _text(spark: SparkSession, path: str, whole: bool, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Texts of a file, or with ``extensions`` of the files of a folder's own level.

    A folder is read as one path: named file by file, each would be looked up by itself and
    compared with all others in every step of the plan. Only where folders lie below, which
    must not be taken for partitions of the table, the files are named.
    """
    reader = spark.read
    if extensions and _has_folders(spark, path):
        path = _inside(path, extensions)
    elif extensions:
        reader = reader.option("pathGlobFilter", _named(extensions))
    return reader.text(path, wholetext=whole).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.col("value"),
    )


def _checked(good: Column, value: Column, mode: str) -> Column:
    """``value``; where it is not good JSON, an error (failfast) or null (permissive)."""
    if mode == "permissive":
        return F.when(good, value)
    if mode != "failfast":
        raise ValueError(f"Unknown mode: {mode}")
    message = F.concat(F.lit("Not valid JSON: "), F.col("src_file"))
    return F.when(good, value).otherwise(F.raise_error(message).cast("string"))


def document_posts(text: Column, strict_envelope: bool = False) -> Column:
    """Array of post texts in one JSON document.

    An object with ``posts`` gives that list (null gives none), another object is one
    post, a list gives its items, anything else gives none. With ``strict_envelope``
    only the first form counts.
    """
    none = F.array().cast("array<string>")
    listed = F.coalesce(F.from_json(text, "posts ARRAY<STRING>")["posts"], none)
    if strict_envelope:
        return F.when(text.startswith("{"), listed).otherwise(none)
    has_posts = F.array_contains(F.json_object_keys(text), "posts")
    bare = F.coalesce(F.from_json(text, "ARRAY<STRING>"), none)
    return (
        F.when(text.startswith("{") & has_posts, listed)
        .when(text.startswith("{"), F.array(text))
        .when(text.startswith("["), bare)
        .otherwise(none)
    )


def _documents(spark, path, strict_envelope, mode, extensions=None) -> DataFrame:
    text = strip(F.col("value"))
    documents = computed(
        _text(spark, path, True, extensions), value=_checked(is_json(text), text, mode)
    )
    posts = exploded(documents, document_posts(F.col("value"), strict_envelope), "pos", "raw")
    return posts.select("src_file", F.lit(0).cast("bigint").alias("src_block"), F.col("pos").cast("bigint").alias("pos"), "raw")


def _lines(spark, path, mode, extensions=None) -> DataFrame:
    # The id grows along the lines of a task, and a task reads a block from its start
    # to its end, so (src_file, src_block, pos) is the order of the lines.
    lines = _text(spark, path, False, extensions).withColumn("value", strip(F.col("value")))
    value = F.col("value")
    posts = computed(lines.where(value != ""), raw=_checked(is_json(value), value, mode))
    return posts.where(F.col("raw").isNotNull()).select(
        "src_file", "src_block", F.monotonically_increasing_id().alias("pos"), "raw"
    )


def read_posts(
    spark: SparkSession,
    path: str,
    strict_envelope: bool = False,
    mode: str = "failfast",
    lines: bool = False,
) -> DataFrame:
    """Posts of one result file, or of all result files in a folder.

    ``lines`` reads every file as JSON lines, whatever its name says: Spark names the
    parts of a JSON-lines table ``.json`` or ``.txt``.
    """
    if lines:
        posts = _lines(spark, path, mode)
    elif not is_directory(spark, path):
        posts = (
            _lines(spark, path, mode)
            if path.endswith(LINE_EXTENSIONS) and not strict_envelope
            else _documents(spark, path, strict_envelope, mode)
        )
    else:
        documents, lines_ = (any(True for _ in inputs(spark, path, e)) for e in (DOCUMENT_EXTENSIONS, LINE_EXTENSIONS))
        if not documents and not lines_:
            raise ValueError(f"No .json/.jsonl result files found in {path}")
        parts = []
        if strict_envelope or documents:
            parts.append(_documents(spark, path, strict_envelope, mode, DOCUMENT_EXTENSIONS))
        if not strict_envelope and lines_:
            parts.append(_lines(spark, path, mode, LINE_EXTENSIONS))
        posts = concat_inputs(*parts)
    return posts.select("src_file", input_stem(F.col("src_file")).alias("src_stem"), "src_block", "pos", "raw")


def sort_inputs(posts: DataFrame) -> DataFrame:
    """Posts in input order. A global sort: only for callers that need ordered output."""
    return posts.orderBy(*FILE_ORDER)


def concat_inputs(*posts: DataFrame) -> DataFrame:
    """All posts of several inputs in one table."""
    first, *rest = posts
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def split_run_documents(documents: DataFrame) -> Runs:
    """Tables of run documents given as rows of ``(src_file, value)``, and ``place`` within the file.

    A document without ``run_id`` is a run of its own, named by its file and place.
    ``pos`` counts along the run, over all its documents.
    """
    place = F.concat_ws("#", "src_file", *(["place"] if "place" in documents.columns else []))
    doc = computed(documents, doc=F.from_json("value", RUN_DOCUMENT_SCHEMA)).withColumn("run_id", F.coalesce(F.col("doc.run_id"), place))
    # Each document of a run says the same about it.
    runs = doc.where(F.coalesce(F.col("doc.part"), F.lit(0)) == 0).select(
        "run_id",
        F.col("doc.query.endpoint").alias("endpoint"),
        F.col("doc.query.query").alias("query"),
        F.col("doc.query.params").alias("params"),
        F.col("doc.query.start_date").alias("start_date"),
        F.col("doc.query.end_date").alias("end_date"),
        F.col("doc.result").alias("result"),
        F.try_to_timestamp(F.col("doc.time_started")).alias("time_started"),
        F.col("doc.time_taken").alias("time_taken"),
    )

    def children(field: str) -> DataFrame:
        rows = exploded(doc, F.col(f"doc.{field}"), "_pos", "raw")
        first = F.coalesce(F.col("doc.first"), F.lit(0))
        return rows.select("run_id", "src_file", (first + F.col("_pos")).cast("bigint").alias("pos"), "raw")

    return Runs(runs, children("posts"), children("users"))


def read_runs(spark: SparkSession, path: str, lines: bool = False, mode: str = "failfast") -> Runs:
    """Saved result documents (one file or a folder) as tables.

    A file holds one document, or with ``lines`` one per line, which splits over tasks.
    Text that is no JSON object is an error, or with ``mode="permissive"`` left out.

    A run saved in several documents, as ``save_runs`` does for long runs, comes back as
    one run: its documents carry the same ``run_id``, and its rows their ``pos`` in it.
    """
    extensions = DOCUMENT_EXTENSIONS if is_directory(spark, path) else None
    text = _text(spark, path, not lines, extensions).withColumn("value", strip(F.col("value")))
    if lines:
        text = text.withColumn("place", F.concat_ws(".", "src_block", F.monotonically_increasing_id()))
    good = is_json(F.col("value")) & F.col("value").startswith("{")
    documents = computed(text.where(F.col("value") != ""), value=_checked(good, F.col("value"), mode))
    return split_run_documents(documents.where(F.col("value").isNotNull()))
