"""Stop rules on a live stream of pages.

The bodies are parsed without state, over all tasks. Then come three steps with state. Ids
of posts are known by (run, part of the id's hash), so a run with any number of posts, and
a backlog of its pages, spread over ``PARTS`` places; each gives a few numbers per page. Those
of a run's parts meet in one place per run, which holds no ids. The last step ends a run
at its first stop.

A call for each place would cost far more than the pages of most of them. Places share
``BUCKETS`` state keys by hash, and the state of a key has an entry for each of its places.

Pages that overtake one another on their way wait for a stated delay, in both of the first
steps, and are handled in their order.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from feedframe.functions.json import bound
from feedframe.functions.once import computed
from feedframe.functions.posts import id_of, time_of
from feedframe.operators.paging import page_facts, with_stop_code
from feedframe.operators.routing import post_nodes, route_of
from feedframe.schemas import POST_KEYS_SCHEMA, POST_TIME_SCHEMA
from feedframe.sources.responses import parse_responses

# Workers get the processors by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The one state store that processors with several states work on.
_STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
#: Places that the posts of a run are spread over, and state keys that all places share.
PARTS, BUCKETS = 16, 1024

_FACTS = (
    "run_id string, page_seq bigint, endpoint string, start_unix bigint, cursor_sent string, "
    "end_cursor string, has_next_page boolean, error string, connection_present boolean"
)
_COUNTED = _FACTS + ", parts int, new_count bigint, timestamped_count bigint, oldest_in_batch_unix bigint"
_STATE = _FACTS + (
    ", iter_index bigint, new_count bigint, timestamped_count bigint, oldest_in_batch_unix bigint, "
    "all_count bigint, no_progress_streak bigint, late boolean"
)
_STOPPED = _STATE + ", stop_code string"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def stream_page_rows(pages: DataFrame) -> DataFrame:
    """Per page its facts and the ``(id, ts)`` of its posts in order. Keeps no state."""
    parsed = parse_responses(pages)
    nodes = F.flatten(F.transform("payloads", lambda p: bound(route_of(p), lambda name: post_nodes(name, p))))
    raw = F.transform(nodes, lambda n: F.to_json(n))
    facts = page_facts(computed(parsed, _raw=raw), carry=("_raw",))

    def post(r: Column) -> Column:
        # Inside a lambda nothing is shared: each text is read once for its id and once for its time.
        post_id, ts = bound(F.from_json(r, POST_KEYS_SCHEMA), id_of), bound(F.from_json(r, POST_TIME_SCHEMA), lambda node: time_of(node))
        return F.struct(post_id.alias("id"), ts.alias("ts"))

    posts = F.when(F.col("rate_limited"), F.array()).otherwise(F.transform("_raw", post))
    return computed(facts, posts=posts.cast("array<struct<id:string,ts:bigint>>")).drop("_raw", "rate_limited")


def _sorted(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _plain(value):
    """A cell of a frame as a plain value, null as None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
        return None
    value = value.item() if hasattr(value, "item") else value
    # All numbers here are whole; a column with nulls in it holds them as floats.
    return int(value) if isinstance(value, float) else value


def _place(run: str | None, part: int | None = None) -> str:
    """Name of a run, or of a part of one, in the state of a bucket. A run may have no name."""
    return f"{'' if part is None else part}/{'' if run is None else '=' + run}"


def _bucket(*columns: str) -> Column:
    # In a struct, so that a null is a value as any other.
    return F.pmod(F.xxhash64(F.struct(*columns), F.lit(len(columns))), F.lit(BUCKETS)).cast("int")


def _by_place(pages: list[dict], place) -> dict[str, list[dict]]:
    places: dict[str, list[dict]] = {}
    for page in pages:
        places.setdefault(place(page), []).append(page)
    return places


class _InOrder(StatefulProcessor):
    """Handles the pages of a place in the order of ``page_seq``; with a delay they wait for those before them."""

    def __init__(self, delay_ms: int):
        self._delay = delay_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "since bigint, page_seq bigint, page string")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pages = [self.page(r) for r in _sorted(rows, "page_seq").itertuples(index=False)]
        if not self._delay:
            yield self.handled(pages)
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self._waiting.exists():
            self._handle.registerTimer(now + self._delay)
        self._waiting.appendList([(now, p["page_seq"], json.dumps(p)) for p in pages])
        yield self.handled([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        places: dict[str, list[tuple]] = {}
        for since, seq, page in sorted((tuple(w) for w in self._waiting.get()), key=lambda w: w[1]):
            read = json.loads(page)
            places.setdefault(self.place(read), []).append((since, seq, page, read))
        ready, left = [], []
        for waiting in places.values():
            ripe = [seq for since, seq, *_ in waiting if since + self._delay <= now]
            # What stands before a page whose time has come goes with it.
            due = [read for _, seq, _, read in waiting if ripe and seq <= max(ripe)]
            whole = self.whole(due)
            ready += due[:whole]
            left += [w[:3] for w in waiting[whole:]]
        self._waiting.clear()
        if left:
            self._waiting.put(left)
            self._handle.registerTimer(max(now + 1, min(w[0] for w in left) + self._delay))
        yield self.handled(ready)

    def whole(self, pages: list[dict]) -> int:
        """How many of the first rows can be handled."""
        return len(pages)

    def handled(self, pages: list[dict]) -> pd.DataFrame:
        out = []
        for place, mine in _by_place(pages, self.place).items():
            out += self.of_place(place, mine)
        return _frame(out, self.columns)

    def close(self) -> None:
        pass


class _NewPosts(_InOrder):
    """Counts, for each page, the posts of one part of the ids that are new to the run. Keeps the ids."""

    columns = _names(_COUNTED)

    def open(self, handle) -> None:
        self._seen = handle.getMapState("seen", "place string, id string", "one int")
        self._last = handle.getMapState("last", "place string", "page_seq bigint")

    @staticmethod
    def place(page: dict) -> str:
        return _place(page["run_id"], page["part"])

    @staticmethod
    def page(row) -> dict:
        page = {c: _plain(getattr(row, c, None)) for c in _names(_FACTS + ", parts int, part int")}
        page["posts"] = [[p["id"], _plain(p["ts"])] for p in row.posts]
        return page

    def of_place(self, place: str, pages: list[dict]) -> list[dict]:
        known = self._last.getValue((place,))
        last = known[0] if known is not None else None
        # Ids met here, so that none is asked for twice. A place without pages so far knows none.
        met, asks = set(), last is not None

        def is_new(post_id) -> bool:
            if post_id is None:
                return True
            if post_id in met:
                return False
            met.add(post_id)
            if asks and self._seen.containsKey((place, post_id)):
                return False
            self._seen.updateValue((place, post_id), (1,))
            return True

        out = []
        for page in pages:
            # A page that comes too late changes nothing that is known.
            in_time = last is None or page["page_seq"] > last
            stamps = [ts for post, ts in page.pop("posts") if in_time and is_new(post)]
            dated = [ts for ts in stamps if ts is not None]
            out.append({**page, "new_count": len(stamps), "timestamped_count": len(dated), "oldest_in_batch_unix": min(dated, default=None)})
            last = page["page_seq"] if in_time else last
        if last is not None:
            self._last.updateValue((place,), (last,))
        return out


class _PageStates(_InOrder):
    """Turns the counts of a run's pages, which come in parts, into page states. Keeps a few numbers."""

    columns = _names(_STATE)

    def open(self, handle) -> None:
        self._last = handle.getMapState(
            "last", "place string", "page_seq bigint, index bigint, total bigint, streak bigint, cursor string"
        )

    @staticmethod
    def place(page: dict) -> str:
        return _place(page["run_id"])

    @staticmethod
    def page(row) -> dict:
        return {c: _plain(getattr(row, c, None)) for c in _names(_COUNTED)}

    def whole(self, pages: list[dict]) -> int:
        """Rows of the pages in front of the first one that still lacks a part."""
        done = 0
        while done < len(pages) and done + pages[done]["parts"] <= len(pages) and pages[done + pages[done]["parts"] - 1]["page_seq"] == pages[done]["page_seq"]:
            done += pages[done]["parts"]
        return done

    def of_place(self, place: str, pages: list[dict]) -> list[dict]:
        last = self._last.getValue((place,))
        out = []
        for _, group in groupby(pages, key=lambda p: p["page_seq"]):
            parts = list(group)
            row = {c: parts[0].get(c) for c in _names(_FACTS)}
            row["late"] = last is not None and row["page_seq"] <= last[0]
            if row["late"]:
                out.append(row)
                continue
            new = sum(p["new_count"] for p in parts)
            before = last or (None, -1, 0, 0, row["cursor_sent"])
            row.update(
                cursor_sent=before[4],
                iter_index=before[1] + 1,
                new_count=new,
                timestamped_count=sum(p["timestamped_count"] for p in parts),
                oldest_in_batch_unix=min((p["oldest_in_batch_unix"] for p in parts if p["oldest_in_batch_unix"] is not None), default=None),
                all_count=before[2] + new,
                no_progress_streak=0 if new else before[3] + 1,
            )
            last = (row["page_seq"], row["iter_index"], row["all_count"], row["no_progress_streak"], row["end_cursor"])
            out.append(row)
        if last is not None:
            self._last.updateValue((place,), tuple(last))
        return out


class _UntilStop(StatefulProcessor):
    """Passes the states of a run up to the first with a stop code, then nothing more."""

    def init(self, handle) -> None:
        self._stopped = handle.getMapState("stopped", "place string", "code string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states = _sorted(rows, "iter_index")
        codes = states["stop_code"].tolist()
        places: dict[str, list[int]] = {}
        for at, run in enumerate(states["run_id"].tolist()):
            places.setdefault(_place(_plain(run)), []).append(at)
        passed = []
        for place, mine in places.items():
            if self._stopped.containsKey((place,)):
                continue
            for at in mine:
                passed.append(at)
                code = _plain(codes[at])
                if code is not None:
                    self._stopped.updateValue((place,), (code,))
                    break
        yield states.iloc[passed][_names(_STOPPED)]

    def close(self) -> None:
        pass


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)


def in_parts(page_rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """A row for each page and each part of the ids that its posts belong to; pages without posts have one."""
    posts = F.transform("posts", lambda p: F.struct(p.alias("post"), F.pmod(F.xxhash64(F.coalesce(p["id"], F.lit(""))), F.lit(parts)).cast("int").alias("part")))
    none = F.pmod(F.xxhash64("page_seq"), F.lit(parts)).cast("int")
    of_posts = F.array_distinct(F.transform("_posts", lambda p: p["part"]))
    found = F.when(F.size("_posts") > 0, of_posts).otherwise(F.array(none))
    rows = computed(computed(page_rows, _posts=posts), _of=found).withColumn("parts", F.size("_of")).withColumn("part", F.explode("_of"))
    mine = F.transform(F.filter("_posts", lambda p: p["part"] == F.col("part")), lambda p: p["post"])
    known = [c for c in _names(_FACTS) if c in page_rows.columns]
    return rows.select(*known, "parts", "part", mine.alias("posts"))


def stream_page_states(page_rows: DataFrame, delay_ms: int = 0, parts: int = PARTS) -> DataFrame:
    """Page states of arriving pages, each run in the order of ``page_seq``.

    A page waits ``delay_ms`` for pages that stand before it in its run, once where its
    posts are counted and once where its counts meet. One that comes later than that,
    after a page behind it was handled, is passed on with ``late`` set and without counts.
    Without a delay pages are handled as each batch brings them.
    """
    page_rows.sparkSession.conf.set(*_STATE_STORE)
    timers = "ProcessingTime" if delay_ms else "None"
    counted = in_parts(page_rows, parts).withColumn("bucket", _bucket("run_id", "part")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_NewPosts(delay_ms), outputStructType=_COUNTED, outputMode="Append", timeMode=timers
    )
    return counted.withColumn("bucket", _bucket("run_id")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_PageStates(delay_ms), outputStructType=_STATE, outputMode="Append", timeMode=timers
    )


def stream_stop(page_rows: DataFrame, delay_ms: int = 0, **caps) -> DataFrame:
    """Page states with ``stop_code``; nothing of a run comes after its first stop.

    The rules are those of the batch form; ``delay_ms`` as in ``stream_page_states``.
    """
    coded = with_stop_code(stream_page_states(page_rows, delay_ms), **caps).withColumn(
        "stop_code", F.when(~F.col("late"), F.col("stop_code"))
    )
    return coded.withColumn("bucket", _bucket("run_id")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_UntilStop(), outputStructType=_STOPPED, outputMode="Append", timeMode="None"
    )
