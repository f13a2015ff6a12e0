"""Exact deduplication with a persistent digest index, bucketed and sorted by digest.

New rows are reduced to one row per digest, sort-merge anti-joined with the index and appended.
All steps are DataFrame operations.

Defined cases: a null text is the empty text; a null id never wins against another id; rows
that repeat both id and text count in `group_size`, are all marked with the same `keep_id`, and
`deduplicated` leaves one of them; an empty table gives no rows; other columns are not read by
`add` and pass through `deduplicated`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import stored, with_groups

#: A digest with more than this share of the rows is joined by broadcast: there are at most 1 / SHARE.
SHARE = 1 / 500


def normal_text(column: str) -> Column:
    """The text with every run of white space replaced by one space; null is empty."""
    return F.regexp_replace(
        F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(column: str) -> Column:
    return F.sha2(normal_text(column).cast("binary"), 256)


class DigestIndex:
    """Digests already seen, kept as a Parquet table bucketed and sorted by digest.

    `path` is a folder that all executors share; the table is registered in the session's
    catalog under a name made of the path, so a later session finds the same rows again.
    One writer at a time; an append that fails leaves nothing, and repeating it adds nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark = spark
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS "
            f"LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the unseen digests of `docs`; return per row id, keep_id (the id that stays,
        from an earlier batch where there is one), group_size (rows of this batch with that
        text), kept and text_sha256."""
        seen = stored(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                                  digest(text_col).alias("digest")), "digests")
        groups = stored(seen.groupBy("digest").agg(F.min("doc_id").alias("first_id"),
                                                   F.count(F.lit(1)).alias("group_size")), "groups")
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        fresh.select("digest", F.col("first_id").alias("keep_id")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        held = groups.drop("first_id").join(self.rows().hint("merge"), "digest")
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        return with_groups(seen, held, "digest", max(2, int(total * SHARE))).select(
            "doc_id", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None) -> DataFrame:
    """`DigestIndex.add` on the index at `path`; without one, on a new index in the shared folder."""
    spark = docs.sparkSession
    index = DigestIndex(spark, path or f"{scratch_dir(spark, 'digest-index')}/index")
    return index.add(docs, id_col, text_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, all columns, one row per text."""
    kept = exact_groups(docs, id_col, text_col, path).where("kept").select("doc_id", "text_sha256")
    own, sha = "__own_id__", "__own_sha__"
    marked = docs.withColumn(own, F.col(f"`{id_col}`").cast("bigint")).withColumn(sha, digest(text_col))
    kept = kept.distinct().select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha))
    joined = marked.join(kept, marked[own].eqNullSafe(kept[own]) & (marked[sha] == kept[sha]), "left_semi")
    return joined.dropDuplicates([own, sha]).drop(own, sha)
