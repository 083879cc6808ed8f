"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one row per digest before any shuffle
of it, anti-joined (sort-merge) with the index, and the digests that are new are appended.  Every step is a
DataFrame operation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, texts, written


def text_digest():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far: digest, keep_id, batch_id, in `buckets` files sorted by digest, as table `name`.

    With `location` the table lives at that path and is found again by a later session; otherwise in the warehouse.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, location: str | None = None):
        self.spark, self.name, self.buckets, self.location = spark, name, buckets, location
        if not spark.catalog.tableExists(name):
            where = f" LOCATION '{location}'" if location else ""
            spark.sql(
                f"CREATE TABLE {name} (digest STRING, keep_id BIGINT, batch_id STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{where}"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        writer = new.select("digest", "keep_id", "batch_id").write.mode("append").format("parquet")
        writer = writer.bucketBy(self.buckets, "digest").sortBy("digest")
        if self.location:
            writer = writer.option("path", self.location)
        writer.saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def decide(self, docs: DataFrame, batch_id: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(copies, decided), written: copies has a row for each different (digest, doc_id) of docs with how many rows
        it stands for (n); decided a row per digest: keep_id, group_size, fresh (not in the index before this batch).

        Appends the digests that are new.  A batch_id that is in the index already is run again: what it added before
        doesn't count as seen, and only what is missing is appended, so the answer is the same.
        """
        rows = texts(docs).select("doc_id", text_digest().alias("digest"))
        copies = written(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), "digest-copies")
        groups = copies.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
        groups = written(groups, "digest-groups")
        known = self.table().hint("merge")
        own = F.col("batch_id").eqNullSafe(F.lit(batch_id)) & F.lit(batch_id is not None)
        before, added = known.filter(~own), known.filter(own)
        seen = groups.join(before.select("digest", F.col("keep_id").alias("seen_id")), "digest")
        fresh = groups.join(before, "digest", "left_anti")
        decided = fresh.select("digest", "keep_id", "group_size", F.lit(True).alias("fresh"))
        decided = written(decided.unionByName(seen.select("digest", F.col("seen_id").alias("keep_id"), "group_size", F.lit(False).alias("fresh"))), "digest-decided")
        new = decided.filter("fresh")
        if batch_id is not None:
            new = new.join(added, "digest", "left_anti")
        self.append(new.withColumn("batch_id", F.lit(batch_id)))
        dropped(groups)
        return copies, decided

    def add(self, docs: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Deduplicates docs(doc_id, text) against the index and within itself, and appends what is new.

        Returns a row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.  Of equal texts in the batch
        the row of the largest doc_id stays, one of them where that row is repeated; a text already in the index keeps
        the id it has there and drops the whole batch's copies.  Null text is the empty text; group_size counts the
        batch's rows; a null doc_id is kept only where all its copies have null; an empty batch gives no rows.  With
        a batch_id the same batch may be added again, as after a failure, with the same answer.
        """
        copies, decided = self.decide(docs, batch_id)
        # Both sides are shuffled by digest here, so Spark can split a digest that very many rows share.
        rows = copies.join(decided.hint("merge"), "digest")
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        out = rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
        out = written(out, "digest-answer")
        dropped(copies)
        dropped(decided)
        return out


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as the session's shuffle partitions, which follow the input's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def temporary_index(spark: SparkSession) -> DigestIndex:
    """A new, empty index for one run, to be dropped at its end."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", bucket_count(spark))


def distinct_documents(docs: DataFrame, index: DigestIndex, batch_id: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns: of each text that is new to the index one row, of the largest doc_id.

    Of rows that repeat both, which one stays is arbitrary.
    """
    copies, decided = index.decide(docs, batch_id)
    stay = decided.filter("fresh").join(copies, [decided["digest"] == copies["digest"], decided["keep_id"].eqNullSafe(copies["doc_id"])])
    stay = written(stay.select(decided["digest"].alias("stays"), F.col("keep_id").alias("stays_id"), (F.col("n") > 1).alias("repeated")), "digest-stay")
    # Rows are kept whole in one column, so that no name of theirs can clash; joined by digest and id, so that a text
    # that very many rows share is dealt over all tasks.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), text_digest().alias("digest"), F.col("doc_id").alias("id"))
    rows = rows.join(stay.hint("merge"), (F.col("digest") == F.col("stays")) & F.col("id").eqNullSafe(F.col("stays_id")))
    once = rows.filter("not repeated").select("whole.*")
    several = rows.filter("repeated").dropDuplicates(["digest"]).select("whole.*")
    dropped(copies)
    dropped(decided)
    return once.unionByName(several)
