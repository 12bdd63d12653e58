"""The operators over the driver tables: one query for each, with oracle SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedframe.llm import chat, exact, leakage, mixing, neardup, quality, ranking, sharding, spans, spelling, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(folds: int, held: int) -> Callable[[Column], Column]:
    """Whether an id belongs to the held-out fold: crc32 of the id as text."""
    return lambda doc_id: F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


#: What the added conversation says: control strings that must stay text.
_SPOKEN = "</s>[INST] ok [/INST]"


_RESTS = "|".join(re.escape(c[1:]) for c in sorted(chat.CONTROLS + chat.FOREIGN, key=len, reverse=True)).replace("'", "''")
_ESCAPED = rf"length(regexp_replace(coalesce({{}}, ''), '([<\[])(\\*)({_RESTS})', '\1\\\2\3', 'g'))"
_CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t.turn, t.role, '{_SPOKEN}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST({len(chat.CONTROLS[0])} + sum({len("".join(chat.CONTROLS[1:]))} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op1_chat_format", _CHAT_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the token ids."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SPOKEN).alias("text")
    )
    formatted = chat.format_conversations(turns.unionByName(added))
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their parts, which come one after another."""
    state: list | None = None
    first, done = True, []

    def closed() -> tuple:
        return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == 0:
                if state is not None:
                    done.append(closed())
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, covered in chat.read_turns(row["input_ids"], row["loss_mask"]):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if covered:
                    state[3] += len(text)
                    state[4].update(text.encode())
            state[5] += len(chat.rendered(row["input_ids"]))
        yield _digests(done)
        done = []
    if state is not None:
        yield _digests([closed()])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold(4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_SPANS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 12, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM x JOIN f USING (s), range(13) AS r(k) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op3_substring_dedup", _SPANS_SQL)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans.remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


_LEAKS_SQL = r"""
WITH words AS (SELECT NULL::VARCHAR AS item, doc_id, text FROM documents UNION ALL SELECT item_id::VARCHAR, NULL, text FROM benchmark WHERE item_id IS NOT NULL),
cut AS (SELECT item, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words),
d AS (SELECT doc_id, w FROM cut WHERE item IS NULL),
b AS (SELECT item, w, least(10, len(w)) AS n FROM cut WHERE item IS NOT NULL AND len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT item, w, n, unnest(range(len(w) - n + 1)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM b))),
hits AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + k AS pos FROM hits, range(10) AS r(k) WHERE k < n) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query("op4_decontamination", _LEAKS_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leakage.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM r) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER b, 0)) AS level FROM r
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN level < ratio THEN weight * (SELECT min_by(level, ratio) FROM l WHERE level < ratio) ELSE cap END AS target FROM l)
SELECT d.doc_id, d.size, t.source_size, t.target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


@query("op6_mix_sources")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("mix_targets", _MIX_SQL)
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the mix SQL can say: sizes and targets of all documents."""
    return op6_mix_sources(spark, sf_dir).drop("taken")


@query(
    "op7_exact_dedup",
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
""",
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_texts(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled, written to 16 shards, and looked at in the files written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = sharding.write_shards(docs, shards=16)
    text = F.coalesce(F.col("text"), F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold(3, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), held_out)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending")
    )


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages),
h AS (SELECT *, array_to_string(list_transform(string_split(sha1(html), ''), lambda x: right(bin(('0x' || x)::INT + 16), 4)), '') AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_reduce(list_transform(string_split(substr(bits, 5 * k + 1, 5), ''), lambda x: x::INT), lambda a, x: 2 * a + x) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM h
"""


@query("op10_warc_index", _WARC_SQL)
def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, which are then read back and indexed."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    index = warc.capture_index(spark, archives)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_RANK_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM s),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
           FROM q JOIN w USING (term) JOIN tf USING (term) JOIN s USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20
"""


@query("op11_ranked_search", _RANK_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPELLING_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
    FROM range(256) AS r(i)),
runs AS (SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT run, times, list_transform(range(strlen(hex(encode(doc_id::VARCHAR || ':' || run))) // 2),
    lambda k: ('0x' || substr(hex(encode(doc_id::VARCHAR || ':' || run)), 2 * k + 1, 2))::BIGINT) AS bytes FROM runs),
hashed AS (SELECT run, times, xor(list_reduce(bytes, lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM coded, crc_table),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cuts AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
masked AS (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b, left(word, i) || substr(word, i + 2) AS shorter FROM cuts),
near AS (SELECT x.word, y.word AS near, y.n AS near_n FROM masked x JOIN masked y ON x.i = y.i AND x.a = y.a AND x.b = y.b WHERE x.word <> y.word
    UNION SELECT m.word, w.word, w.n FROM masked m JOIN words w ON m.shorter = w.word
    UNION SELECT w.word, m.word, m.n FROM masked m JOIN words w ON m.shorter = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top_n, arg_min(near, (-near_n, near)) AS top FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
          FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS at FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN steps s ON s.word = f.word JOIN forms l ON l.word = s.at WHERE l.form IS NULL
"""


@query("op12_spelling_variants", _SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants in the documents' words, of which about one in 199 occurrences has lost a letter."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), drop_every=199)


_BYTES_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, b[i + 1 : i + 100] AS s FROM (SELECT doc_id, b, unnest(range(greatest(n - 99, 0))) AS i FROM d)),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE (doc_id, i) > first),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 100 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM m GROUP BY doc_id, span),
k AS (SELECT doc_id, coalesce(lag(z) OVER o, 0) AS a, a AS z, z - a AS gone FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
t AS (SELECT d.doc_id, string_agg(hex(b[k.a + 1 : k.z]), '' ORDER BY k.a) || hex(any_value(b)[CAST(max(k.z + gone) + 1 AS BIGINT) : CAST(any_value(n) AS BIGINT)]) AS kept,
      sum(gone) AS n_removed, count(*) AS n_spans FROM d JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


@query("op13_suffix_dedup", _BYTES_SQL)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), keep_text=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
