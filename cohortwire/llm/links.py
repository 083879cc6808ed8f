"""Linking of like items that share a key, and connected components, without pairs of whole groups.

A key that more items share than one task should compare is replaced by several finer keys, of which like items
still share one, again and again until each holds a bounded number.  A task compares the members of one key and
returns a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Members of a key that one task compares at most, where finer keys can be made.
BLOCK = 256


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _compare(like):
    """mapInArrow function: rows (ids, payloads) of one key -> links."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for ids, payloads in zip(batch["ids"], batch["payloads"], strict=True):
                ids, payloads = ids.as_py(), payloads.as_py()
                forest = Forest(len(ids))
                for i, j in like(payloads):
                    if forest.join(i, j):
                        a.append(min(ids[i], ids[j]))
                        b.append(max(ids[i], ids[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links_within_keys(members: DataFrame, like, finer: list[Callable[[DataFrame], DataFrame]], block: int = BLOCK) -> DataFrame:
    """Links (a, b), a < b, that connect what `like` connects among members(key, id, payload binary, ...) of one key.

    like(payloads) yields index pairs of items that are alike.  The members of keys that more than `block` share go to
    the keys that finer[0] makes of them, those of still too large ones to finer[1]'s and so on; each must keep any
    two like items in a common key, and the last must leave groups that fit into a task.  id is a long and unique
    within a key.
    """
    ready, left = [], []
    for level in range(len(finer) + 1):
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sizes = written(sizes.select("key", (F.col("size") > block).alias("large")), "key-sizes")
        large = F.col("large") if level < len(finer) else F.lit(False)
        kept = members.join(sizes.hint("merge"), "key")
        ready.append(kept.filter(~large).select("key", "id", "payload"))
        left.append(sizes)
        if level == len(finer) or sizes.filter("large").isEmpty():
            break
        members = written(finer[level](kept.filter(large).drop("large")), "finer-keys")
        left.append(members)
    found = None
    for part in ready:
        groups = part.groupBy("key").agg(F.collect_list(F.struct("id", "payload")).alias("m"))
        links = groups.select(F.col("m.id").alias("ids"), F.col("m.payload").alias("payloads")).mapInArrow(_compare(like), "a long, b long")
        found = links if found is None else found.unionByName(links)
    out = written(found.distinct(), "links")
    for x in left:
        dropped(x)
    return out


def components(links: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """node, component: the smallest node reachable over links(a, b).  nodes adds those without a link.

    Large-star and small-star rounds (every node is linked to the smallest node it knows of), each written to the
    shared folder; their number grows with the logarithm of a component's size.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        # Large star: larger neighbours of a node are linked to its smallest neighbour, or to itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        least = written(least, "least")  # read back, so that Spark can split a node of very many neighbours
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        large = written(large, "large-star")
        small_least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_least.hint("merge"), "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.filter("a <> b").distinct(), "edges")
        # Done when every node has one smaller neighbour, which itself has none.
        up = after.select("a").distinct()
        done = after.count() == up.count() and after.join(up.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        for x in (edges, least, large, small_least):
            dropped(x)
        edges = after
        if done:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    if nodes is None:
        return named
    return nodes.select("node").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
