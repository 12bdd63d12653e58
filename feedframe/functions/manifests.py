"""Column functions over streaming manifests (XML text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedframe.functions.json import non_empty, to_long
from feedframe.schemas import MANIFEST_SCHEMA


def parse_manifest(xml: Column) -> Column:
    """Struct view of a manifest. Malformed XML gives null fields, not a failed job."""
    return F.from_xml(xml, MANIFEST_SCHEMA, {"ignoreSurroundingSpaces": "false"})


def _sets(manifest: Column) -> Column:
    return F.flatten(
        F.transform(
            F.coalesce(manifest["Period"], F.array()),
            lambda p: F.coalesce(p["AdaptationSet"], F.array()),
        )
    )


def representations(manifest: Column) -> Column:
    """Array of ``(mime, bandwidth, url)`` in document order, without those lacking a URL.

    The mime type falls back to the enclosing set's; an unreadable bandwidth counts 0.
    """

    def of_set(s: Column) -> Column:
        return F.transform(
            F.coalesce(s["Representation"], F.array()),
            lambda r: F.struct(
                F.coalesce(non_empty(r["_mimeType"]), s["_mimeType"]).alias("mime"),
                F.coalesce(to_long(r["_bandwidth"]), F.lit(0)).alias("bandwidth"),
                non_empty(F.get(r["BaseURL"], F.lit(0))).alias("url"),
            ),
        )

    found = F.flatten(F.transform(_sets(manifest), of_set))
    return F.filter(found, lambda r: r["url"].isNotNull())


def best_video(reps: Column) -> Column:
    """URL of the video representation highest by bandwidth, then by URL."""
    videos = F.filter(reps, lambda r: r["mime"].startswith("video/"))
    return F.array_max(F.transform(videos, lambda r: F.struct(r["bandwidth"], r["url"])))["url"]


def audio_track(reps: Column) -> Column:
    """URL of the last audio representation."""
    audios = F.filter(reps, lambda r: r["mime"].startswith("audio/"))
    return F.try_element_at(audios, F.lit(-1))["url"]


def distinct_base_urls(manifest: Column) -> Column:
    """Distinct base URLs at every level of the manifest, sorted."""
    none = F.array().cast("array<string>")

    def urls(node: Column) -> Column:
        return F.coalesce(node["BaseURL"], none)

    def below(nodes: Column, found: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.flatten(F.transform(nodes, found)), none)

    def of_set(s: Column) -> Column:
        return F.concat(urls(s), below(s["Representation"], urls))

    def of_period(p: Column) -> Column:
        return F.concat(urls(p), below(p["AdaptationSet"], of_set))

    found = F.concat(urls(manifest), below(manifest["Period"], of_period))
    unwanted = F.array(F.lit(None).cast("string"), F.lit(""))
    return F.sort_array(F.array_except(found, unwanted))
