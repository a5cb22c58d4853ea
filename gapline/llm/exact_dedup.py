"""Exact deduplication against a persistent digest index.

Two texts are equal when they are the same after deleting every character of
``[\\x20\\x09-\\x0D]``.  The index is a Parquet table bucketed and sorted by the
SHA-256 of the normalised text, one row per digest.  ``DigestIndex.add`` reduces
a new batch to one row per digest (partial aggregation before the shuffle, so a
digest with a third of all rows costs one row per task), finds the digests that
the index lacks by a sort-merge anti-join, and appends them.

Of equal texts the row with the most code points stays, then the one with the
smallest id; a null id comes last, and between repeated rows an arbitrary one
stays.  A digest that the index held before the batch keeps its earlier row, so
no row of the batch is kept.  Null text counts as empty; empty texts are equal.
An empty batch adds nothing.  Other columns stay, whatever their names.  Only
built-in column functions run here.

The number of buckets is stored with the index and read when it is opened again;
another number is refused.  A batch may have a name.  Adding a named batch again,
after a driver was lost in its first attempt, say, gives the same result and
appends only what the first attempt did not.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm.rows import fresh
from gapline.llm.store import Scratch, read_text, write_text

WHITESPACE = " \t\n\x0b\x0c\r"
FACTS = "_index.json"


def squeeze(text: Column) -> Column:
    """The text without the characters that equality ignores."""
    for char in WHITESPACE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def text_digest(text: Column) -> Column:
    return F.sha2(squeeze(F.coalesce(text, F.lit(""))), 256)


class DigestIndex:
    """A bucketed digest table at ``location``, reopened if it is there already.

    ``buckets`` of a new index is the session's number of shuffle partitions unless given.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.scratch = Scratch(spark, "digests")
        self.location = (location or self.scratch.path("index")).rstrip("/")
        facts = read_text(spark, f"{self.location}/{FACTS}")
        stored = json.loads(facts)["buckets"] if facts else None
        if stored and buckets not in (None, stored):
            raise ValueError(f"the index at {self.location} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not stored:
            write_text(spark, f"{self.location}/{FACTS}", json.dumps({"buckets": self.buckets}))
        self.name = f"gapline_digests_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id BIGINT, keep_chars BIGINT, "
            f"group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the table out of the session's catalogue; the index stays at its location."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Append the new digests of ``df``; return a row for each of its rows.

        Columns: ``id_col``, keep_id, group_size, kept, text_sha256, n_chars.
        ``group_size`` counts the rows of the batch and, for a digest that was
        known, the rows it was first seen with.
        """
        rows, found = self._judge(df, id_col, text_col, batch)
        return _annotate(rows, found).select(
            F.col("__id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", "n_chars"
        )

    def _judge(self, df: DataFrame, id_col: str, text_col: str, batch: str | None) -> tuple[DataFrame, DataFrame]:
        """The rows with their digests, and for each digest what stays; both written."""
        work, again = uuid.uuid4().hex[:12], batch is not None
        batch = batch if again else work
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = self.scratch.keep(
            df.select(
                F.col(id_col).cast("bigint").alias("__id"),
                F.char_length(text).cast("bigint").alias("n_chars"),
                text_digest(F.col(text_col)).alias("text_sha256"),
                F.monotonically_increasing_id().alias("__row"),
            ),
            f"rows-{work}",
        )
        # ~x reverses the order of integers without overflow
        order = F.struct(
            F.col("n_chars"), F.col("__id").isNotNull(), F.bitwise_not("__id").alias("a"), F.bitwise_not("__row").alias("b")
        )
        groups = rows.groupBy("text_sha256").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n"))
        # written, or else Spark would move the anti-join below the aggregation and shuffle every row
        groups = self.scratch.keep(groups, f"groups-{work}")
        known = self.table().filter(F.col("batch") != batch) if again else self.table()
        seen = self.scratch.keep(
            groups.join(known.select("text_sha256").hint("merge"), "text_sha256", "left_anti").select(
                "text_sha256",
                F.bitwise_not("best.a").alias("keep_id"),
                F.col("best.n_chars").alias("keep_chars"),
                F.bitwise_not("best.b").alias("keep_row"),
                F.col("n").alias("group_size"),
                "n",
            ),
            f"new-{work}",
        )
        old = known.select("text_sha256", F.col("keep_id").alias("old_id"), "keep_chars", F.col("group_size").alias("old_size"))
        repeated = groups.join(old.hint("merge"), "text_sha256").select(
            "text_sha256", F.col("old_id").alias("keep_id"), "keep_chars", F.lit(None).cast("bigint").alias("keep_row"),
            (F.col("n") + F.col("old_size")).alias("group_size"), "n",
        )
        found = self.scratch.keep(seen.unionByName(repeated), f"found-{work}")
        new = seen.drop("keep_row", "n")
        if again:  # what an earlier attempt has appended stays
            done = self.table().filter(F.col("batch") == batch).select("text_sha256")
            new = new.join(done.hint("merge"), "text_sha256", "left_anti")
        new = new.withColumn("batch", F.lit(batch)).select(self.table().columns)
        new.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256").write.insertInto(self.name)
        self.scratch.drop(f"groups-{work}", f"new-{work}")
        return rows, found


def _annotate(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Join each row to its digest.

    A digest with more than a thousandth of the rows is hot.  There are at most
    a thousand of those, so they are broadcast; the others, none of which can
    unbalance a task, go through a shuffle join.
    """
    limit = max(100, -(-rows.count() // 1000))
    hot = F.broadcast(found.filter(F.col("n") > limit))
    cold = rows.join(hot.select("text_sha256"), "text_sha256", "left_anti")
    both = rows.join(hot, "text_sha256").unionByName(cold.join(found, "text_sha256"))
    return both.withColumn("kept", F.coalesce(F.col("__row") == F.col("keep_row"), F.lit(False)))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, one for each digest."""
    index = DigestIndex(df.sparkSession)
    _, found = index._judge(df, id_col, text_col, None)
    index.close()
    names = fresh(df, "digest", "key", "chars")
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = (text_digest(F.col(text_col)), F.col(id_col).cast("bigint"), F.char_length(text).cast("bigint"))
    marked = df.withColumns(dict(zip(names, made, strict=True)))
    kept = found.select("text_sha256", "keep_id", "keep_chars")
    on = (marked[names[0]] == kept["text_sha256"]) & marked[names[1]].eqNullSafe(kept["keep_id"]) & (marked[names[2]] == kept["keep_chars"])
    return marked.join(kept, on, "left_semi").dropDuplicates(names).drop(*names)
