"""WARC archives of pages, and one index over all of them by an external merge.

Writing: a record per page, as text with the blank lines between records as line separator,
so Spark's own writer produces the archive bytes wherever the shared folder is. Payloads
that repeat are found first; all records of one but the response become revisits that name it.

Reading: each archive is parsed by the lengths its headers give and its captures are sorted:
a run. Owner tasks take ranges of (URL key, timestamp, page) and merge the runs in theirs
with a loser tree, which gives capture histories in global order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedframe.llm.words import KeyFilter
from feedframe.session import materialize, release, work_folder

#: Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "\r\n\r\n"
RESPONSE_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: The date of page 0; each page is a second after the one before, as the table has no dates.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)

#: Bytes of payload of an archive file, about.
FILE_BYTES = 8 << 20
#: Captures of an index range, about.
RANGE_ROWS = 20_000

_CAPTURE = (
    "run string, rank long, url_key string, captured string, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, offset long, length long"
)
_NAMES = [part.split()[0] for part in _CAPTURE.split(", ")]


def _header(text: str | None) -> str:
    """A header value: control characters become percent escapes."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", text or "")


def _date(page: int | None) -> str:
    try:
        return (FIRST_CAPTURE + timedelta(seconds=page or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return FIRST_CAPTURE.strftime("%Y-%m-%dT%H:%M:%SZ")


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, in lower case: captures of a site sort together."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{host}){parts.path or '/'}{query}".lower()


def _write_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = []
        for page, url, html, size, sha1, keep, response in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            lines = [
                VERSION,
                f"WARC-Type: {'response' if response else 'revisit'}",
                f"WARC-Target-URI: {_header(url)}",
                f"WARC-Date: {_date(page)}",
                f"WARC-Record-ID: {_record_id(page)}",
                f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
                f"X-Payload-Length: {size}",
            ]
            if page is not None:
                lines.append(f"X-Page-ID: {page}")
            head = RESPONSE_HEAD.format(size)
            if not response:
                lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(keep)}"]
                if keep is not None:
                    lines.append(f"X-Refers-To-Page: {keep}")
            lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + (size if response else 0)}"]
            records.append("\r\n".join(lines) + SEPARATOR + head + (html if response else ""))
        yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> str:
    """Write a WARC record for each row of ``pages``; returns the folder of archives.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest id is
    the response, of several with that id the one with the greatest URL, and the others
    revisit it; smaller payloads are all responses. Null html is an empty payload, a null
    URL an empty one, a null id below every other. Of equal rows one is the response. Other
    columns are not read. An empty table gives archives without records.

    Records are told by their content alone, never by a row number, so rows may come in
    any order each time they are read. Pages whose payload is theirs alone are written
    where they are read; of a payload that repeats one copy moves, and its revisits
    without it.
    """
    spark = pages.sparkSession
    out = path or work_folder(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.select("page", "url", "html", F.octet_length("html").alias("size"), F.sha1("html").alias("sha1"), F.unhex(F.sha2("html", 256)).alias("key"))
    able = rows.where(F.col("size") >= least).withColumn("key64", F.xxhash64("key"))
    repeated = able.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("key").alias("key64"))
    repeated = materialize(repeated, "warc-repeated")
    may_repeat = KeyFilter(repeated, "key64").may_hold("key64")
    totals = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()

    none = F.lit(None).cast("long").alias("keep")
    record = ["page", "url", "html", "size", "sha1"]
    small = rows.where(F.col("size") < least).select(*record, none, F.lit(True).alias("response"))
    alone = able.where(~may_repeat).select(*record, none, F.lit(True).alias("response"))
    twins = able.where(may_repeat)
    # Rows without their payload, equal ones as one with their number; and one payload for each key.
    kinds = materialize(twins.groupBy("key", "page", "url").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("sha1").alias("sha1")), "warc-kinds")
    order = F.struct(F.col("page").isNotNull().alias("has"), "page", "url")
    heads = kinds.groupBy("key").agg(F.max(order).alias("head"))
    payloads = twins.groupBy("key").agg(F.min("html").alias("html"), F.min("size").alias("size"), F.min("sha1").alias("sha1"))
    responses = payloads.join(heads, "key").select("head.page", "head.url", "html", "size", "sha1", none, F.lit(True).alias("response"))
    is_head = order == F.col("head")
    others = kinds.join(heads, "key").withColumn("left", F.col("n") - F.when(is_head, 1).otherwise(0)).where("left > 0")
    others = others.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "left")))
    revisits = others.select("page", "url", F.lit(None).cast("string").alias("html"), "size", "sha1", F.col("head.page").alias("keep"), F.lit(False).alias("response"))
    records = alone.unionByName(small).unionByName(responses).unionByName(revisits) if least else alone.unionByName(responses).unionByName(revisits)
    # A file is read back whole: about FILE_BYTES of records each.
    each = max(1, int(FILE_BYTES * totals[1] // (totals[0] + totals[1] * 600))) if totals[1] else 1
    written = records.mapInArrow(_write_records, "value string").write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", each)
    written.text(out)
    release(repeated, kinds)
    return out


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, by the lengths that their headers give."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"No record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        body = end + 4
        length = int(fields["Content-Length"])
        block = data[body : body + length]
        if len(block) < length or data[body + length : body + length + 4] != b"\r\n\r\n":
            raise ValueError(f"Record at byte {at} is cut off")
        yield {"offset": at, "length": body + length + 4 - at, "fields": fields, "block": block}
        at = body + length + 4


def _captures(path: str, data: bytes) -> list[tuple]:
    found = []
    for record in parse_archive(data):
        fields = record["fields"]
        kind = fields["WARC-Type"]
        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response":
            payload = record["block"].split(b"\r\n\r\n", 1)[1]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
                raise ValueError(f"{path}: payload at byte {record['offset']} does not match its digest")
        page, to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
        url = fields.get("WARC-Target-URI", "")
        found.append((url_key(url), fields["WARC-Date"], int(page) if page else None, url, kind, size, digest, int(to) if to else None, record["offset"], record["length"]))
    found.sort(key=_order)
    return found


def _order(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[8]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = _captures(path, data.as_py())
            columns = [[path] * len(found), range(len(found)), *(list(c) for c in zip(*found, strict=True))] if found else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[p.split()[1]]) for c, p in zip(columns, _CAPTURE.split(", "), strict=True)], names=_NAMES)


def loser_tree(runs: list[list], order) -> Iterator:
    """Merge sorted runs: a tree of losers, one path of comparisons for each item that comes out."""
    k = len(runs)
    if k == 0:
        return
    heads = [0] * k
    keys: list = [order(r[0]) if r else None for r in runs]

    def beats(a: int, b: int) -> bool:
        """Whether run ``a`` has the smaller head; a run at its end loses, the lower number wins a tie."""
        if keys[a] is None or keys[b] is None:
            return keys[a] is not None or (keys[b] is None and a < b)
        return keys[a] < keys[b] or (keys[a] == keys[b] and a < b)

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    first = winners[1] if k > 1 else 0
    while keys[first] is not None:
        yield runs[first][heads[first]]
        heads[first] += 1
        keys[first] = order(runs[first][heads[first]]) if heads[first] < len(runs[first]) else None
        node = (first + k) // 2
        while node:
            if beats(losers[node], first):
                first, losers[node] = losers[node], first
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the parts of all runs in one range; they come sorted by run and rank."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    paths = table.column("run").to_pylist()
    cuts = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
    keys = list(zip(*(table.column(n).to_pylist() for n in ("url_key", "captured", "page_id", "offset")), strict=True))
    runs = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    merged = list(loser_tree(runs, lambda i: (keys[i][0], keys[i][1], keys[i][2] is not None, keys[i][2] or 0, keys[i][3], paths[i])))
    yield from table.take(pa.array(merged)).combine_chunks().to_batches()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The sorted capture runs of all archives below ``path``, one run for each file."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(_runs, _CAPTURE)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives in global order of URL key, timestamp, page and offset.

    Tasks hold consecutive ranges; a range is cut inside a URL's history where that is long,
    so no URL or host has to fit in one task.
    """
    runs = materialize(read_archives(spark, path), "capture-runs")
    ranges = max(1, runs.count() // RANGE_ROWS)
    parts = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "offset").sortWithinPartitions("run", "rank")
    return parts.mapInArrow(_merge, runs.schema)
