"""How text filters overlap: counts for every order of the filters, from a stream of the corpus's files.

The files are read as micro-batches until none is left.  State keyed by text holds the smallest id seen and whose it
is; a smaller id that arrives later takes its place, and what was counted for the earlier one is retracted: one less
under its old mask of failed filters, one more under the mask of a copy.  Each micro-batch adds its changes to the
counters by part and mask, which say all that any order of the filters does.  The state is a table to which each
micro-batch adds the texts that it changes, as Python's state functions take milliseconds for each text.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, dropped, new_path, written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of files in a micro-batch for each core of the session, or more where there would be more micro-batches than
#: this: each reads the state that there is.
BATCH_BYTES, MOST_BATCHES = 16 << 20, 16

COUNTS = "part string, mask int, good boolean, toxic boolean, change long"
HOLDER = "part: string, good: boolean, toxic: boolean, n: long"
STATE = f"digest binary, least long, holders array<struct<{HOLDER}>>"


def failed_by_text(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: short, repetitive, upper-case, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < 100, 100 * different < 80 * n, 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    bits = F.lit(0)
    for i, f in enumerate(failed):
        bits = bits + F.when(f, F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def _marks(labels: DataFrame) -> DataFrame:
    """A row per labelled id: whether one of its labels says good, or toxic."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def _by_text(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """digest, mask, groups: what a micro-batch holds of each text, by part and labels.

    A group has its smallest id (least), the rows of that id (n_least), all rows (n) and those without an id (n_null).
    Rows are counted before each shuffle, so a text of very many copies is a few rows by the time it meets.
    """
    ids = rows.groupBy("digest", "mask", "part", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # A null id matches no label; with the text's hash for a key, such rows don't meet in one task.
    key, known = F.coalesce("doc_id", F.xxhash64("digest")), F.col("doc_id").isNotNull()
    marked = ids.join(marks.withColumn("known", F.lit(True)), (key == F.col("label_id")) & (known == F.col("known")), "left")
    marked = marked.select(*ids.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    groups = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    group = F.struct("part", "good", "toxic", F.col("first.doc_id").alias("least"), F.col("first.n").alias("n_least"), "n", "n_null")
    return groups.groupBy("digest", "mask").agg(F.collect_list(group).alias("groups"))


def _merged(texts: DataFrame, state: DataFrame) -> DataFrame:
    """texts with their new state (least, holders) and the changes of the counters that it makes."""
    latest = state.groupBy("digest").agg(F.max_by(F.struct("least", "holders"), "batch").alias("old"))
    both = texts.join(latest, "digest", "left")
    none = F.array().cast(f"array<struct<{HOLDER}>>")
    both = both.withColumn("least", F.least(F.array_min(F.col("groups.least")), F.col("old.least")))
    held = F.coalesce(F.col("old.holders"), none)
    beaten = F.when(F.col("old.least") > F.col("least"), held).otherwise(none)
    at_least = lambda g: F.when(g["least"] == F.col("least"), g["n_least"]).otherwise(F.lit(0))

    def change(x: Column, mask: Column, n: Column) -> Column:
        return F.struct(x["part"].alias("part"), mask.alias("mask"), x["good"].alias("good"), x["toxic"].alias("toxic"), n.cast("long").alias("change"))

    mask, copy = F.col("mask"), F.col("mask").bitwiseOR(F.lit(COPY))
    changes = F.flatten(F.array(
        F.transform(beaten, lambda h: change(h, mask, -h["n"])), F.transform(beaten, lambda h: change(h, copy, h["n"])),
        F.transform("groups", lambda g: change(g, mask, at_least(g) + g["n_null"])), F.transform("groups", lambda g: change(g, copy, g["n"] - g["n_null"] - at_least(g))),
    ))
    new = F.transform(F.filter("groups", lambda g: g["least"] == F.col("least")), lambda g: F.struct(g["part"].alias("part"), g["good"].alias("good"), g["toxic"].alias("toxic"), g["n_least"].alias("n")))
    holders = F.concat(F.when(F.col("old.least") == F.col("least"), held).otherwise(none), new)
    return both.select("digest", "least", holders.alias("holders"), F.filter(changes, lambda c: c["change"] != 0).alias("changes"))


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, folder: str, bytes_per_batch: int | None = None) -> DataFrame:
    """part, mask, good, toxic, n: rows of documents by their failed filters (bits, A first) and labels.

    Streams the parquet files under `path`, of documents (doc_id, text, lang, ...), with its checkpoint, state and
    counters under `folder`.  Called again with the same folder, it goes on where a broken run ended, or takes in files
    that are new: what a micro-batch writes replaces that of its first try.  State is a table by text, to which each
    micro-batch adds the texts that it has changed.
    """
    given = spark.read.parquet(path)
    if bytes_per_batch is None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        bytes_per_batch = max(BATCH_BYTES * spark.sparkContext.defaultParallelism, -(-size // MOST_BATCHES))
    source = spark.readStream.schema(given.schema).option("maxBytesPerTrigger", bytes_per_batch).option("maxFileAge", "36500d")
    files = source.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, which may name a file as well as a folder
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = files.select(
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failed_by_text(text).alias("mask"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"), "doc_id",
    )
    marks = written(_marks(labels), "audit-marks")
    state, counters = f"{folder}/state", f"{folder}/counters"
    spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{state}/batch=-1")
    spark.createDataFrame([], COUNTS).write.mode("overwrite").parquet(f"{counters}/batch=-1")

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        before = own.read.schema(f"{STATE}, batch int").parquet(state).filter(F.col("batch") < number)
        merged = _merged(_by_text(batch, marks), before)
        merged.write.mode("overwrite").parquet(f"{state}/batch={number}")
        changes = own.read.schema(merged.schema).parquet(f"{state}/batch={number}").select(F.explode("changes").alias("c")).select("c.*")
        sums = changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("change"))
        sums.write.mode("overwrite").parquet(f"{counters}/batch={number}")

    writer = docs.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(add)
    writer.trigger(availableNow=True).start().awaitTermination()
    dropped(marks)
    sums = spark.read.schema(COUNTS).parquet(counters).groupBy("part", "mask", "good", "toxic")
    return sums.agg(F.sum("change").alias("n"))


ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
SHARES = {k: len(ORDERS) // k for k in range(1, len(FILTERS) + 1)}


def _orders(counts: pd.DataFrame) -> pd.DataFrame:
    """What each step of each order does to one part; counts has a row per mask."""
    part, mask = counts["part"].iloc[0], counts["mask"].to_numpy()
    n, good, toxic = (counts[c].to_numpy() for c in ("n", "good", "toxic"))
    first_in = np.array([0, *SHARES.values()])[[bin(m).count("1") for m in mask]]  # orders in which a failed filter is the first
    out = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, gone = (mask & bit) != 0, (mask & before) != 0
            here = fails & ~gone
            left = n[~fails & ~gone].sum(), n[here].sum(), n[fails & gone].sum(), n[mask == bit].sum(), good[here].sum(), toxic[here].sum()
            out.append((part, order, step, *left, (n * first_in)[fails].sum()))
            before |= bit
    return pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_orders(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from mask_counts(): at most 32 masks a part."""
    by_mask = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    return by_mask.groupBy("part").applyInPandas(_orders, AUDIT)


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, bytes_per_batch: int | None = None) -> DataFrame:
    """The audit of the documents under `path`: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    Filters: A under 100 words; B different words under 80 % of the words; C over 10 % capitals; D a symbol of
    `#$%&*|`; E a copy of the text of a smaller id.  Null text is the empty text (fails A only, and E as a copy), null
    lang the part ''.  A null doc_id is smaller or larger than none, so its row never fails E nor makes another fail.
    Rows that repeat the smallest id of a text all pass E.  Repeated labels count if one says so.  Other columns are
    ignored; an empty table has no parts, so no rows.
    """
    folder = new_path(spark, "filter-audit")
    out = written(audit_orders(mask_counts(spark, path, labels, folder, bytes_per_batch)), "filter-audit-answer")
    drop_path(spark, folder)
    return out
