"""Token counts by byte-pair merging with a heap and a linked list.

For one word, the pair of neighbours with the lowest rank is popped from a heap, merged in a doubly linked list,
and the pairs it forms with its neighbours are pushed; the count is the initial symbols minus the merges.  No ids
are made.  Each different unit of a batch is merged once; counts of units that recur are kept, boundedly, per worker.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, texts
from .tokens import Units, slices


def symbols_after_merging(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no neighbouring pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i] = left + right
        symbols[j] = ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
        merges += 1
    return n - merges


class WordCounter(Units):
    """Tokens of texts under a vocabulary file of the tokenizers library, without ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.normalize = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.counts = np.zeros(0, np.int64)

    def _piece(self, piece: str) -> int:
        return symbols_after_merging([*piece[:-1], piece[-1] + self.suffix], self.ranks)

    def _plain(self, text: str) -> int:
        return sum(self._piece(piece) for piece, _ in self.split(self.normalize(text))) if text else 0

    def _unit(self, unit: str) -> int:
        if self.special_pattern and self.special_pattern.search(unit):
            parts = self.special_pattern.split(unit)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(unit)

    def _learn(self, units: pa.Array, words: np.ndarray) -> None:
        self.counts = np.concatenate([self.counts, np.fromiter(map(self._unit, units.to_pylist()), np.int64, len(units))])
        self.units = pa.concat_arrays([self.units, units])

    def _select(self, places: np.ndarray) -> None:
        self.counts = self.counts[places]

    def texts(self, texts: pa.Array) -> np.ndarray:
        """How many tokens each text has: the sum over its chunks' units, each different one merged once."""
        out = [np.zeros(0, np.int64)]
        for part in slices(texts):
            units, chunks, bounds = self.cut(part)
            each = self.counts[units].reshape(-1, 2).sum(axis=1)
            out.append(np.diff(np.concatenate([[0], np.cumsum(each[chunks])])[bounds]))
            self.forget(units, chunks)
        return np.concatenate(out)

    def __call__(self, text: str) -> int:
        return int(self.texts(pa.array([text]))[0])


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per row of docs.

    Null text is the empty text (0, 0, false).  Strings of special tokens inside a text count as one token each.
    Repeated rows are each counted; an empty table gives no rows; other columns are ignored.
    """

    def count(batches):
        counter = per_worker(("count", vocabulary), lambda: WordCounter(vocabulary))
        for batch in batches:
            n_bytes = pc.binary_length(batch["text"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], n_bytes, pa.array(counter.texts(batch["text"]))], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
