"""Searches at any depth of JSON payloads, as column expressions.

A payload is carried as its text, which keeps the keys of objects in their order, and as
VARIANT, which tells an object from a string that looks like one. A search goes down level
by level inside one row, as far as there are levels, so nothing is shuffled and no depth is
too great. Rows with nothing to search have no levels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedframe.functions.json import child

#: A node of a payload: its JSON text and its value.
_NODES = "array<struct<t:string,v:variant>>"
#: A node with its path: the position under each of its ancestors, the payload's first.
_PLACED = "array<struct<path:array<int>,t:string,v:variant>>"
_FOUND = "array<struct<code:array<int>,value:string>>"
#: Stands behind the path of a node, above any position.
_LAST = (1 << 31) - 1


def _nodes(texts: Column, values: Column) -> Column:
    return F.zip_with(texts, values, lambda t, v: F.struct(t.alias("t"), v.alias("v")))


def _below(node: Column) -> Column:
    """Children of an object or array, in their order; of any other value none."""
    fields = F.map_entries(F.from_json(node["t"], "map<string,string>"))
    values = F.try_variant_get(node["v"], "$", "map<string,variant>")
    of_object = F.transform(fields, lambda e: F.struct(e["value"].alias("t"), F.try_element_at(values, e["key"]).alias("v")))
    items = F.try_variant_get(node["v"], "$", "array<variant>")
    of_array = _nodes(F.from_json(node["t"], "array<string>"), items)
    return F.when(values.isNotNull(), of_object).when(items.isNotNull(), of_array).otherwise(F.array()).cast(_NODES)


def _levels(wanted: Column, nodes: Column) -> Column:
    """As many steps as there can be levels: no value lies deeper than brackets open."""
    opened = F.aggregate(nodes, F.lit(0), lambda n, x: n + F.length(x["t"]) - F.length(F.translate(x["t"], "{[", "")))
    return F.when(wanted, F.sequence(F.lit(0), opened)).otherwise(F.array().cast("array<int>"))


def shallowest(wanted: Column, payloads: Column, path: str, is_it) -> Column:
    """VARIANT at ``path`` of the least deep node for which ``is_it`` holds there; the first in the text on a tie.

    ``payloads`` are nodes (see ``payload_nodes``); rows without ``wanted`` give null.
    """
    start = F.struct(payloads.cast(_NODES).alias("nodes"), F.lit(None).cast("variant").alias("found"))

    def step(state: Column, _) -> Column:
        here = F.filter(F.transform(state["nodes"], lambda n: child(n["v"], path)), is_it)
        below = F.flatten(F.transform(state["nodes"], _below))
        going = F.struct(F.when(F.size(here) > 0, F.array().cast(_NODES)).otherwise(below).alias("nodes"), F.get(here, F.lit(0)).alias("found"))
        return F.when(F.size(state["nodes"]) > 0, going).otherwise(state)

    return F.aggregate(_levels(wanted, payloads), start, step, lambda state: state["found"])


def last_branch_first(wanted: Column, payloads: Column, *keys: str) -> Column:
    """Struct of the JSON texts under each of ``keys``, of the node that comes first where the
    last payload comes before the others, and so does the last child of a node; a node comes
    before what it holds.

    That node has the greatest path, when a path ends in something greater than any place:
    one maximum for each key, over all nodes, in one descent.
    """
    placed = F.transform(payloads, lambda n, i: F.struct(F.array(i).alias("path"), n["t"].alias("t"), n["v"].alias("v"))).cast(_PLACED)
    none = F.array().cast(_FOUND)
    start = F.struct(placed.alias("nodes"), *[none.alias(f"of_{k}") for k in keys])

    def best(state: Column, key: str) -> Column:
        met = F.transform(
            F.filter(state["nodes"], lambda n: child(n["v"], f"$.{key}").isNotNull()),
            lambda n: F.struct(F.concat(n["path"], F.array(F.lit(_LAST))).alias("code"), F.to_json(child(n["v"], f"$.{key}")).alias("value")),
        )
        every = F.concat(state[f"of_{key}"], met)
        return F.when(F.size(every) > 0, F.array(F.array_max(every))).otherwise(none).cast(_FOUND)

    def step(state: Column, _) -> Column:
        def children(n: Column) -> Column:
            return F.transform(_below(n), lambda c, i: F.struct(F.concat(n["path"], F.array(i)).alias("path"), c["t"].alias("t"), c["v"].alias("v")))

        below = F.flatten(F.transform(state["nodes"], children)).cast(_PLACED)
        going = F.struct(below.alias("nodes"), *[best(state, k).alias(f"of_{k}") for k in keys])
        return F.when(F.size(state["nodes"]) > 0, going).otherwise(state)

    return F.aggregate(
        _levels(wanted, payloads), start, step, lambda state: F.struct(*[F.get(state[f"of_{k}"], F.lit(0))["value"].alias(k) for k in keys])
    )

