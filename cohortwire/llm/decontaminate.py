"""Benchmark decontamination by greedy string tiling.

Runs of `seed` tokens are hashed by a Karp-Rabin rolling hash.  Documents are matched with the benchmark, read in
blocks of bounded size, by shared seeds; for a pair that shares one, the longest match of unmarked tokens is marked
again and again until none of `seed` tokens is left.  A document is contaminated if the marked tiles cover enough
of an item, in whatever order the passages stand.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, bounded_batches, open_stream, per_worker, written

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(chunk: str) -> bytes:
    return b"".join(xxhash.xxh64_intdigest(w, 7).to_bytes(8, "little") for w in _WORD.findall(chunk.lower()))


def token_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each token: lower-cased runs of letters, digits and underscores."""
    cache = per_worker("words", lambda: BoundedCache(_word_hashes))
    return np.frombuffer(b"".join(map(cache.__getitem__, (text or "").split())), dtype=np.uint64)


def rolling(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `size` tokens, modulo 2**64."""
    n = len(tokens) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _BASE + tokens[i : i + n]
    return out ^ (out >> np.uint64(29))


#: Pairs of equal seeds that are looked at at once.
PAIRS_AT_ONCE = 1 << 20


def matching_runs(in_document: np.ndarray, in_item: np.ndarray, places: np.ndarray, n_places: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(-length, document start, item start) of the maximal runs of matches.

    in_document: places of seeds in the document, ascending; the k-th stands at n_places[k] places of the item, which
    follow one another in in_item from places[k] on.  Pairs are made PAIRS_AT_ONCE at a time, or those of one seed, so
    memory follows the runs, of which a text with repeats has far fewer than pairs.
    """
    runs: list[tuple[int, int, int]] = []
    open_runs = np.zeros((0, 3), np.int64)  # diagonal, first and last place in the document
    done, total = 0, np.cumsum(n_places)
    while done < len(in_document):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE, side="right")))
        n = n_places[done:stop]
        i = np.repeat(in_document[done:stop], n)
        j = in_item[np.repeat(places[done:stop] - (np.cumsum(n) - n), n) + np.arange(len(i))]
        diagonal = np.concatenate([open_runs[:, 0], i - j])
        first = np.concatenate([open_runs[:, 1], i])
        last = np.concatenate([open_runs[:, 2], i])
        order = np.lexsort((first, diagonal))
        diagonal, first, last = diagonal[order], first[order], last[order]
        new = np.ones(len(order), bool)
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (first[1:] != last[:-1] + 1)
        begin = np.flatnonzero(new)
        open_runs = np.stack([diagonal[begin], first[begin], last[np.append(begin[1:], len(order)) - 1]], axis=1)
        closed = open_runs[:, 2] < in_document[stop - 1] - 1 if stop < len(in_document) else np.ones(len(open_runs), bool)
        runs += [(-(b - a + size), a, a - d) for d, a, b in open_runs[closed].tolist()]
        open_runs = open_runs[~closed]
        done = stop
    return runs


def _longest_free(taken: np.ndarray) -> int:
    edges = np.flatnonzero(np.concatenate([[True], taken, [True]]))
    return int(np.diff(edges).max()) - 1


def tile(document: np.ndarray, item: np.ndarray, runs: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document start, item start, length), longest first, of `size` tokens at least, from maximal runs of
    matches (-length, document start, item start)."""
    heap = list(runs)
    heapq.heapify(heap)
    in_document, in_item = np.zeros(len(document), bool), np.zeros(len(item), bool)
    tiles = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        taken = in_item[j : j + length] | in_document[i : i + length]
        if not taken.any():
            if np.array_equal(document[i : i + length], item[j : j + length]):
                tiles.append((i, j, length))
                in_item[j : j + length] = True
                in_document[i : i + length] = True
                if _longest_free(in_item) < size:
                    break  # no further tile fits into the item
            continue
        free = np.flatnonzero(~taken)
        for part in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1):
            if len(part) >= size:
                heapq.heappush(heap, (-len(part), i + int(part[0]), j + int(part[0])))
    return tiles


class Benchmark:
    """Items and the places of their seeds, for one bounded block."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.seed = seed
        self.set_items([(item_id, token_hashes(text)) for item_id, text in items])

    def set_items(self, items: list[tuple[int, np.ndarray]]) -> None:
        seed, self.items = self.seed, {}
        self.short: dict[bytes, list[int]] = defaultdict(list)
        hashes, keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for key, (item_id, tokens) in enumerate(items):
            if 0 < len(tokens) < seed:
                self.short[tokens.tobytes()].append(item_id)
            elif len(tokens):
                self.items[key] = (item_id, tokens)
                hashes.append(rolling(tokens, seed))
                keys.append(np.full(len(hashes[-1]), key))
                at.append(np.arange(len(hashes[-1])))
        hashes, keys, at = map(np.concatenate, (hashes, keys, at))
        # Sorted by hash, item and place: the places of one seed in one item stand together.
        order = np.lexsort((at, keys, hashes))
        hashes, keys, self.at = hashes[order], keys[order], at[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(order)))
        self.group_key, group_hash = keys[self.first], hashes[self.first]
        self.hashes, self.group = np.unique(group_hash, return_index=True)
        self.groups = np.diff(np.append(self.group, len(group_hash)))
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def coverage(self, text: str) -> list[tuple[int, float]]:
        """(item id, share of its tokens under tiles) for the items that share a seed with the text; an item of fewer
        tokens than a seed is covered by a text of just these tokens."""
        return self.coverage_by_tokens(token_hashes(text))

    def coverage_by_tokens(self, document: np.ndarray) -> list[tuple[int, float]]:
        if len(document) < self.seed:
            return [(item_id, 1.0) for item_id in self.short.get(document.tobytes(), ())]
        if not len(self.hashes):
            return []
        seeds = rolling(document, self.seed)
        likely = np.flatnonzero(self.filter[(seeds >> np.uint64(42)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.hashes, seeds[likely]), len(self.hashes) - 1)
        hit = self.hashes[where] == seeds[likely]
        likely, where = likely[hit], where[hit]
        # A row for each place in the document and item that share a seed.
        n = self.groups[where]
        i = np.repeat(likely, n)
        group = np.repeat(self.group[where] - (np.cumsum(n) - n), n) + np.arange(len(i))
        key = self.group_key[group]
        order = np.argsort(key, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(rows):
                item_id, item = self.items[int(key[rows[0]])]
                runs = matching_runs(i[rows], self.at, self.first[group[rows]], self.n[group[rows]], self.seed)
                covered = sum(length for _, _, length in tile(document, item, runs, self.seed))
                if covered:
                    out.append((item_id, covered / len(item)))
        return out


def coverage_of(document: np.ndarray, item: np.ndarray, seed: int) -> float:
    """Share of an item's tokens that tiles of a document cover, both as token hashes."""
    known = Benchmark([], seed)
    known.set_items([(0, item)])
    return sum(c for _, c in known.coverage_by_tokens(document))


def benchmark_blocks(benchmark: DataFrame, block_chars: int) -> tuple[str, int]:
    """(folder, n): the benchmark in the shared folder, dealt by hash over n blocks of about block_chars characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    return written(rows.withColumn("block", block), "benchmark", ["block"])._written_path, n


def load_block(folder: str, number: int, seed: int) -> Benchmark:
    """One block of the benchmark, read by a task."""
    system, path = open_stream(f"{folder}/block={number}")
    items = []
    if system.get_file_info(path).type == fs.FileType.Directory:
        for file in system.get_file_info(fs.FileSelector(path)):
            if file.path.endswith(".parquet"):
                table = pq.read_table(file.path, filesystem=system, columns=["item_id", "text"], partitioning=None)
                items += zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)
    return Benchmark(items, seed)


_FOUND = "coverage double, item_ids array<long>"
#: Blocks that a worker keeps.
KEPT_BLOCKS = 2


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5, block_chars: int = 4_000_000) -> DataFrame:
    """docs with the struct column `leak`: coverage (of the most covered item, 0 if none), item_ids (array of the
    items covered by `threshold` or more), contaminated.

    The benchmark is a query set taken against all documents in blocks: a task reads a block of about block_chars
    characters at a time and matches a batch of documents with it, so neither the driver nor a broadcast holds the
    benchmark.  Null or empty texts, and items without a token, match nothing; an item shorter than `seed` tokens is
    matched by a document of just its tokens; repeated items each count; an item without id takes part in coverage
    and is left out of item_ids; all columns of docs are kept, but one named leak, which is replaced.
    """
    bounded_batches(docs)
    folder, n = benchmark_blocks(benchmark, block_chars)

    @F.pandas_udf(_FOUND)
    def matches(text: pd.Series) -> pd.DataFrame:
        most, ids = np.zeros(len(text)), [set() for _ in range(len(text))]
        for number in range(n):
            known = per_worker((folder, number), lambda: load_block(folder, number, seed), KEPT_BLOCKS)  # noqa: B023
            for i, t in enumerate(text):
                for item_id, covered in known.coverage(t) if t else ():
                    most[i] = max(most[i], covered)
                    if covered >= threshold and item_id is not None:
                        ids[i].add(item_id)
        return pd.DataFrame({"coverage": most, "item_ids": [sorted(x) for x in ids]})

    found = docs.withColumn("leak", matches("text"))
    return found.withColumn("leak", F.struct("leak.coverage", "leak.item_ids", (F.col("leak.coverage") >= threshold).alias("contaminated")))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, coverage, item_ids: a row per row of docs; see contamination()."""
    found = contamination(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", "leak.contaminated", "leak.coverage", "leak.item_ids")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    found = contamination(docs.withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_whole", "text"), benchmark, **options)
    return found.filter(~F.col("leak.contaminated")).select("_whole.*")
