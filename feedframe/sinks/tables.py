"""Writers of the flat table. Spark writes a folder of part files, so targets are folders."""

from __future__ import annotations

import os
from itertools import islice

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedframe.constants import OUTPUT_SUFFIXES
from feedframe.operators.flatten import flatten_posts
from feedframe.session import MANY_FILES, materialize, release
from feedframe.sources.files import inputs, is_directory, is_empty, read_posts


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled inside quoted text. No rows is an error."""
    if df.isEmpty():
        raise ValueError("No rows to write")
    _writer(df, "csv").save(path)


def write_parquet(df: DataFrame, path: str) -> None:
    _writer(df, "parquet").save(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, nulls written out; replaces what is there."""
    _writer(df, "jsonl").save(path)


def append_jsonl(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add rows as JSON lines; no rows is no write.

    A frame whose only column is ``raw`` holds posts and is written as it is. With a
    ``batch_id`` the rows go to a folder of their own, which a repeated batch replaces,
    so that a retry adds nothing twice.
    """
    if df.isEmpty():
        return
    mode = "append"
    if batch_id is not None:
        path, mode = f"{path.rstrip('/')}/batch_id={batch_id}", "overwrite"
    if df.columns == ["raw"]:
        df.write.mode(mode).text(path)
    else:
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _writer(df: DataFrame, fmt: str):
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        return writer.format("csv").options(header=True, escape='"')
    if fmt == "jsonl":
        return writer.format("json").option("ignoreNullFields", "false")
    if fmt == "parquet":
        return writer.format("parquet")
    raise ValueError(f"Unknown format: {fmt}")


def _formats(fmt: str) -> list[str]:
    if fmt == "all":
        return list(OUTPUT_SUFFIXES)
    if fmt not in OUTPUT_SUFFIXES:
        raise ValueError(f"Unknown format: {fmt}")
    return [fmt]


def write_flat(flat: DataFrame, targets: dict[str, str], partition_by: tuple[str, ...] = ()) -> int:
    """Write a flat table to one target per format; returns rows times formats.

    The table is computed once: with several formats it is stored, and each is written
    from there. Written by ``partition_by``, a target keeps its other partitions: only
    those that the table has are replaced. Into a target with nothing to replace, tasks move
    their partitions themselves, as the driver would take them one by one.
    """
    counted = Observation()
    source = stored = flat.observe(counted, F.count(F.lit(1)).alias("rows"))
    if len(targets) > 1:
        source = stored = materialize(source, "flat")
    for fmt, target in targets.items():
        writer = _writer(source, fmt)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
            if is_empty(flat.sparkSession, target):
                writer = writer.mode("append").options(**MANY_FILES)
            else:
                writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.save(target)
    release(stored)
    return counted.get["rows"] * len(targets)


def _file_like(output: str) -> bool:
    return os.path.splitext(output)[1].lower() in OUTPUT_SUFFIXES.values()


def _named_targets(output: str, formats: list[str]) -> dict[str, str]:
    base = os.path.splitext(output)[0]
    return {f: base + OUTPUT_SUFFIXES[f] for f in formats}


def flatten_paths(
    spark: SparkSession,
    input_path: str,
    output: str | None = None,
    fmt: str = "csv",
    concat: bool = False,
    resolve: bool = False,
) -> int:
    """Flatten a result file or a folder of them; returns rows written over all formats.

    * ``concat``: everything into the one target named by ``output``;
    * one input and an ``output`` named like a file: that target;
    * otherwise one target per input, ``<folder>/<format>/src_stem=<input>``, in the
      ``output`` folder or, without one, beside the input. Inputs without posts give
      nothing, and outputs of other inputs stay.
    """
    formats = _formats(fmt)
    folder = is_directory(spark, input_path)
    several = folder and len(list(islice(inputs(spark, input_path), 2))) > 1
    named = output is not None and not output.endswith("/") and _file_like(output)
    if concat and not named:
        raise ValueError("concat requires an output named like a file")
    if several and named and not concat:
        raise ValueError("Multiple input files: output must be a folder (or use concat)")

    posts = read_posts(spark, input_path)
    if named:
        flat = flatten_posts(posts, resolve=resolve)
        if flat.isEmpty():
            raise ValueError("No posts found across inputs" if concat else "No rows to write")
        return write_flat(flat, _named_targets(output, formats))

    if output is None:
        output = input_path if folder else os.path.dirname(input_path) or "."
    targets = {f: f"{output.rstrip('/')}/{f}" for f in formats}
    flat = flatten_posts(posts, keep=("src_stem",), resolve=resolve)
    return write_flat(flat, targets, partition_by=("src_stem",))


def export_posts(spark: SparkSession, input_path: str, output: str, resolve: bool = False) -> int:
    """Flatten the ``posts`` of one result document; Parquet by suffix, else CSV."""
    fmt = "parquet" if output.lower().endswith(".parquet") else "csv"
    flat = flatten_posts(read_posts(spark, input_path, strict_envelope=True), resolve=resolve)
    if fmt == "csv" and flat.isEmpty():
        raise ValueError("No rows to write")
    return write_flat(flat, {fmt: output})
