"""Checks of collection requests."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedframe.constants import REQUIRED_QUERY_KEYS


class CheckedRequests(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``is_valid``, ``missing`` (required keys not in the query) and ``reason``."""
    entries = []
    for endpoint, keys in REQUIRED_QUERY_KEYS.items():
        entries += [F.lit(endpoint), F.array(*[F.lit(k) for k in keys])]
    required = F.try_element_at(F.create_map(*entries), F.col("endpoint"))
    given = F.coalesce(F.map_keys("query"), F.array().cast("array<string>"))
    missing = F.filter(required, lambda k: ~F.array_contains(given, k))
    return (
        requests.withColumn("missing", missing)
        .withColumn(
            "reason",
            F.when(F.col("missing").isNull(), F.concat(F.lit("unsupported endpoint: "), F.coalesce("endpoint", F.lit("none"))))
            .when(F.size("missing") > 0, F.concat(F.lit("missing required fields: "), F.array_join("missing", ", "))),
        )
        .withColumn("is_valid", F.col("reason").isNull())
    )


def split_requests(requests: DataFrame) -> CheckedRequests:
    """Valid requests, and the others with their reason."""
    checked = validate_requests(requests)
    return CheckedRequests(
        checked.where("is_valid").drop("is_valid", "missing", "reason"), checked.where("NOT is_valid")
    )
