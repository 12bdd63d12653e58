"""Saving runs: whole result documents, or their posts as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.operators.running import running
from feedframe.session import MANY_FILES, materialize

POSTS_PER_DOCUMENT = 10_000


def _sliced(children: DataFrame, order: tuple[str, ...], size: int) -> tuple[DataFrame, DataFrame]:
    """Children as ``run_id, part, _i, raw``: the document of at most ``size`` they go to and their position; and as stored.

    Positions are worked out of the columns of the order alone. Texts are stored once, since
    both sides of the join read them, and move once to meet their position.
    """
    rows = children.where(F.col("run_id").isNotNull()).select("run_id", *order, "raw")
    stored = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "children")
    places = running(stored.select("run_id", *order, "_id"), seq=order, index="_i")
    places = places.select("_id", "_i", F.floor(F.col("_i") / size).cast("bigint").alias("part"))
    return stored.select("_id", "run_id", "raw").join(places, "_id").select("run_id", "part", "_i", "raw"), stored


def run_documents(
    runs: DataFrame,
    posts: DataFrame,
    users: DataFrame,
    order: tuple[str, ...] = ("pos",),
    user_order: tuple[str, ...] = ("pos",),
    posts_per_document: int = POSTS_PER_DOCUMENT,
) -> DataFrame:
    """Result documents as rows: the run, its posts and its users, dates as text.

    A document holds at most ``posts_per_document`` posts and as many users, so that a run
    of any length never has to fit into one row. Each carries its ``run_id``, its number
    ``part`` and the position ``first`` of its first post and user in the run, which
    ``read_runs`` reads as one run in its order.
    """
    (posts, all_posts), (users, all_users) = _sliced(posts, order, posts_per_document), _sliced(users, user_order, posts_per_document)
    query = F.struct(
        "endpoint",
        "query",
        *[F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in ("params", "start_date", "end_date")],
    )
    said = F.struct(query.alias("query"), "result", F.col("time_started").cast("string").alias("time_started"), "time_taken")
    # A row for each document of a run: as many as its posts or users fill, and at least one.
    n_posts, n_users = (c.groupBy("run_id").agg(F.count(F.lit(1)).alias(n)) for c, n in ((all_posts, "n_posts"), (all_users, "n_users")))
    sized = runs.join(n_posts, "run_id", "left").join(n_users, "run_id", "left")
    last = F.floor((F.greatest(F.coalesce("n_posts", F.lit(1)), F.coalesce("n_users", F.lit(1))) - 1) / posts_per_document).cast("bigint")
    # Runs without a name are no group.
    alone = F.when(F.col("run_id").isNull(), F.monotonically_increasing_id())
    heads = sized.select("run_id", alone.alias("_alone"), said.alias("_said"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))

    # One table of all that goes into documents: texts move once, to the document they belong to.
    def entries(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("run_id", "part", F.struct("_i", "raw").alias(name))

    both = entries(posts, "_post").unionByName(entries(users, "_user"), allowMissingColumns=True)
    dealt = both.unionByName(heads, allowMissingColumns=True).repartitionByRange("run_id", "part")
    gathered = dealt.groupBy("run_id", "part", "_alone").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("_said", "_post", "_user")])

    def texts(name: str) -> Column:
        return F.transform(F.array_sort(name), lambda r: F.parse_json(r["raw"]))

    # Each row of a run gives its documents; what belongs to no run gives none.
    documents = gathered.withColumn("_said", F.explode("_saids")).select(
        "run_id",
        "part",
        (F.col("part") * posts_per_document).alias("first"),
        "_said.query",
        "_said.result",
        texts("_posts").alias("posts"),
        texts("_users").alias("users"),
        "_said.time_started",
        "_said.time_taken",
    )
    documents._in_ranges = True
    return documents


def save_runs(documents: DataFrame, path: str, file_per_run: bool = False) -> None:
    """Write documents as JSON, one per line, each run's together and in its order.

    With ``file_per_run`` each document gets a file of its own in the folder: handy for a
    few runs, but millions of runs make millions of files. Tasks then move their files into
    place themselves, as the driver would take them one by one; a write that fails may
    leave some, without the mark of a whole one (``_SUCCESS``).
    """
    # Those of ``run_documents`` lie in ranges of run and part already.
    dealt = documents if getattr(documents, "_in_ranges", False) else documents.repartitionByRange("run_id", "part")
    ordered = dealt.sortWithinPartitions("run_id", "part")
    writer = ordered.write
    if file_per_run:
        writer = writer.option("maxRecordsPerFile", 1).options(**MANY_FILES)
    writer.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_posts(posts: DataFrame, path: str, order: tuple[str, ...] = ("pos",)) -> None:
    """Write raw posts as JSON lines, a folder per run, in the order of the run.

    Tasks take ranges of (run, order), so a long run is written by several, whose files
    follow each other by name.
    """
    ordered = posts.repartitionByRange("run_id", *order).sortWithinPartitions("run_id", *order)
    ordered.select("run_id", "raw").write.mode("overwrite").partitionBy("run_id").text(path)


def save_all(
    runs: DataFrame,
    posts: DataFrame,
    users: DataFrame,
    base: str,
    order: tuple[str, ...] = ("pos",),
    user_order: tuple[str, ...] = ("pos",),
    posts_per_document: int = POSTS_PER_DOCUMENT,
) -> tuple[str, str]:
    """Write documents to ``<base>.json`` and posts to ``<base>.jsonl``; returns both paths."""
    json_path, jsonl_path = f"{base}.json", f"{base}.jsonl"
    save_runs(run_documents(runs, posts, users, order, user_order, posts_per_document), json_path)
    save_posts(posts, jsonl_path, order)
    return json_path, jsonl_path
