"""Stored API responses: which ones count, and what their bodies hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.constants import API_PREFIXES, API_RESOURCE_TYPE
from feedframe.functions.once import computed, exploded
from feedframe.functions.json import (
    LINE_BREAK,
    child,
    is_json,
    is_object,
    non_empty,
    strip,
    text_at,
)

_ERROR = "array<struct<message:string,raw:string>>"
_RESPONSE = "array<struct<data:variant,errors:array<variant>,status:string,message:string>>"


def filter_api_responses(pages: DataFrame) -> DataFrame:
    """Pages fetched by script from one of the API addresses."""
    from_api = reduce(Column.__or__, [F.col("url").startswith(p) for p in API_PREFIXES])
    return pages.where((F.col("resource_type") == API_RESOURCE_TYPE) & from_api)


def _values(text: Column) -> Column:
    """The JSON value of a text as an array of one, read in one pass; null if the text is
    not exactly one value (which brackets and braces make an error)."""
    return F.from_json(F.concat(F.lit('{"a":['), text, F.lit("]}")), f"a {_RESPONSE}")["a"]


def _errors_of(obj: Column) -> Column:
    listed = F.transform(
        F.filter(F.coalesce(obj["errors"], F.array().cast("array<variant>")), is_object),
        lambda e: F.struct(text_at(e, "$.message").alias("message"), F.to_json(e).alias("raw")),
    )
    message = F.coalesce(non_empty(obj["message"]), F.lit("status: fail"))
    failed = F.array(F.struct(message.alias("message"), message.alias("raw")))
    return F.when(obj["status"] == "fail", F.concat(listed, failed)).otherwise(listed)


def payload_nodes(body: Column) -> Column:
    """The payloads of a body as ``(t, v)``: text with the keys of objects in their own order, and VARIANT."""
    text = strip(body)
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    values = F.when(is_json(text), F.array(text)).otherwise(F.filter(lines, is_json))
    # A string that looks like an object is none.
    responses = F.filter(F.transform(values, F.try_parse_json), is_object)
    texts = F.filter(values, lambda v: is_object(F.try_parse_json(v)))
    made = F.zip_with(texts, responses, lambda t, v: F.struct(F.get_json_object(t, "$.data").alias("t"), child(v, "$.data").alias("v")))
    return F.filter(made, lambda n: is_object(n["v"]))


def parse_responses(pages: DataFrame) -> DataFrame:
    """Add ``payloads`` (the ``data`` objects), ``errors``, and ``single``: whether the body is one JSON value.

    A body is one JSON value or JSON lines; unreadable lines and values that are no
    objects are skipped. A ``status`` of ``fail`` adds an error of its own.
    """
    read = computed(pages, _read=_values(strip(F.col("body"))))
    lines = F.transform(F.split(strip(F.col("body")), LINE_BREAK), lambda line: _values(strip(line)))
    of_lines = F.flatten(F.filter(lines, lambda v: F.size(v) == 1))
    values = F.when(F.size("_read") == 1, F.col("_read")).otherwise(of_lines)
    objects = read.withColumn("_objects", F.filter(values, lambda o: o.isNotNull()))
    payloads = F.filter(F.transform("_objects", lambda o: o["data"]), is_object)
    errors = F.flatten(F.transform("_objects", _errors_of))
    return computed(
        objects,
        payloads=F.coalesce(payloads, F.array().cast("array<variant>")),
        errors=F.coalesce(errors, F.array().cast(_ERROR)).cast(_ERROR),
        single=F.coalesce(F.size("_read") == 1, F.lit(False)),
    ).drop("_read", "_objects")


def payload_rows(parsed: DataFrame) -> DataFrame:
    """One row per payload: ``run_id, page_seq, payload_idx, payload``."""
    rows = exploded(parsed.select("run_id", "page_seq", "payloads"), F.col("payloads"), "payload_idx", "payload")
    return rows.drop("payloads")


def error_text(errors: Column, transport_error: Column | None = None) -> Column:
    """Error text of a page: the transport error, else the messages joined by ``; ``."""
    messages = F.transform(errors, lambda e: F.coalesce(non_empty(e["message"]), e["raw"]))
    joined = non_empty(F.array_join(messages, "; "))
    return joined if transport_error is None else F.coalesce(non_empty(transport_error), joined)
