"""Katz backoff language model over whole corpora.

The corpus is written once as chunks of word numbers, in a table bucketed by chunk.  For each order the n-grams of a
chunk go, one row of packed keys for each bucket of the hash space, to where all chunks' counts are summed; the
sums come back in the same packed form and are stored in tables partitioned by what they hold.  From them follow
Good-Turing discounts (counts of counts), then the backoff weight of every history, exactly normalised (two sums for
each history, gathered the same way), then the probability of each token by recursion from the highest order down.
Nothing as large as the vocabulary is ever in one task or on the driver.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, new_path, per_worker, shuffle_files_dropped, texts

#: Tokens of a chunk, at least, unless its task ends; a chunk is at most this and one document.
CHUNK_TOKENS = 600_000
#: Distinct n-grams summed in one group, about.
BUCKET_KEYS = 2_000_000
#: Bytes of text of a bucket of the corpus table, beyond the session's number of shuffle partitions, and most buckets.
PARTITION_BYTES, MOST_PARTITIONS = 256 << 20, 50_000
#: Counts up to this are discounted.
DISCOUNTED = 5

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11)


#: Keys that no word can have, as words hold no space.
BEGIN, END = word_key(b" begin"), word_key(b" end")


def joined_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the keys of its history and its last word."""
    x = history * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(31)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def begin_key(level: int) -> int:
    key = np.array([BEGIN], np.uint64)
    for _ in range(level - 1):
        key = joined_keys(key, np.array([BEGIN], np.uint64))
    return int(key[0])


class Level:
    """The different n-grams of one length in a chunk."""

    def __init__(self, keys, at, history, last, shorter):
        self.keys, self.at, self.history, self.last, self.shorter = keys, at, history, last, shorter


class Chunk:
    """Documents of a chunk: ids (0 for null), what each is (flags), tokens (numbers into words), and their n-grams by
    level.  The flags: 1 for one that trains, 2 for a null id."""

    def __init__(self, ids: np.ndarray, flags: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, words: np.ndarray):
        self.ids, self.flags, self.lengths, self.tokens, self.words = ids, flags, lengths, tokens, words
        self.trains, self.no_id = (flags & 1) == 1, (flags & 2) == 2

    @classmethod
    def of_texts(cls, rows: list[tuple[int | None, bool, np.ndarray]]) -> Chunk:
        """rows: doc id, whether it trains, its word keys without the end."""
        end = np.array([END], np.uint64)
        keys = np.concatenate([part for _, _, words in rows for part in (words, end)])
        words, tokens, counts = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which store well
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        lengths = np.array([len(words) + 1 for _, _, words in rows], np.int32)
        flags = np.array([bool(r[1]) | 2 * (r[0] is None) for r in rows], np.uint8)
        return cls(np.array([r[0] or 0 for r in rows], np.int64), flags, lengths, place[tokens], words[order])

    def levels(self, order: int) -> dict[int, Level]:
        """Levels 1 to order.  Each document has order - 1 begin marks before its tokens."""
        pads = order - 1
        starts = np.concatenate([[0], np.cumsum(self.lengths.astype(np.int64))])
        document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        at = np.arange(len(self.tokens)) + (document + 1) * pads
        stream = np.full(len(self.tokens) + len(self.lengths) * pads, len(self.words), np.int64)
        stream[at] = self.tokens
        self.token_at = at
        self.first_at = starts[:-1] + np.arange(len(self.lengths)) * pads
        offset = np.arange(len(stream)) - np.repeat(self.first_at, self.lengths + pads)
        counted = offset >= pads - 1 if pads else np.ones(len(stream), bool)
        self.counted = counted & np.repeat(self.trains, self.lengths + pads)
        out = {1: Level(np.append(self.words, np.uint64(BEGIN)) if pads else self.words, stream, None, None, None)}
        for level in range(2, order + 1):
            below = out[level - 1]
            valid = np.flatnonzero(offset >= level - 1)
            pair = below.at[valid - 1] * np.int64(len(self.words) + 1) + stream[valid]
            _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
            where = np.full(len(stream), -1, np.int64)
            where[valid] = inverse
            history, last = below.at[valid[first] - 1], stream[valid[first]]
            out[level] = Level(joined_keys(below.keys[history], out[1].keys[last]), where, history, last, below.at[valid[first]])
        return out

    def counts(self, level: Level) -> np.ndarray:
        at = level.at[self.counted]
        return np.bincount(at[at >= 0], minlength=len(level.keys)).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, places of its keys), in a fixed order."""
    bucket = ((keys >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, edges):
        if len(places):
            yield int(bucket[places[0]]), places


def put_back(parts, keys: np.ndarray, buckets: int, kind) -> np.ndarray:
    """Inverse of by_bucket: values of the keys from (bucket, bytes)."""
    out = np.zeros(len(keys), kind)
    got = dict(parts)
    for bucket, places in by_bucket(keys, buckets):
        out[places] = np.frombuffer(got[bucket], kind)
    return out


# ---------------------------------------------------------------------------------------------- discounts


def good_turing(counts: list[int]) -> np.ndarray:
    """Factors for counts 0 to DISCOUNTED + 1 (the last is 1), from how many types have count 1, 2, ...

    Katz's factors where all are in (0, 1); else absolute discounting by n1 / (n1 + 2 n2), or by a half without data.
    """
    n = [0, *counts]
    k = DISCOUNTED
    factors = np.ones(k + 2)
    if all(n[1 : k + 2]):
        over = (k + 1) * n[k + 1] / n[1]
        if over < 1:
            katz = [((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in katz):
                factors[1 : k + 1] = katz
                return factors
    amount = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    factors[1 : k + 1] = [(r - amount) / r for r in range(1, k + 1)]
    return factors


def discounted(count: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return count * factors[np.minimum(count, DISCOUNTED + 1)]


class Unigrams:
    """Discounted unigrams; what the discounts leave is the probability of the one unknown type."""

    def __init__(self, tokens: int, counts: list[int], factors: np.ndarray):
        self.tokens, self.factors = tokens, factors
        left = sum((1 - factors[r]) * r * counts[r - 1] for r in range(1, DISCOUNTED + 1))
        self.total = tokens if left > 0 else tokens + 1
        self.unknown = (left if left > 0 else 1.0) / self.total

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.factors) / self.total, self.unknown)


def ngram_probabilities(levels, counts, weights, factors, unigrams, order):
    """P of each different n-gram of a chunk, level by level.  weights: of histories, negative where the history's
    counts are all above the discounted ones, whose total is then one more."""
    p = {1: unigrams(counts[1])}
    for level in range(2, order + 1):
        x = levels[level]
        history = counts[level - 1][x.history]
        weight = weights[level][x.history]
        total = history + (weight < 0)
        seen = discounted(counts[level], factors[level]) / np.maximum(total, 1)
        backed = np.where(history > 0, np.abs(weight), 1.0) * p[level - 1][x.shorter]
        p[level] = np.where(counts[level] > 0, seen, backed)
    return p


# --------------------------------------------------------------------------------------------------- Spark jobs


def _binary(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


class KatzJob:
    """One training and scoring run; its tables are dropped at the end."""

    def __init__(self, docs: DataFrame, trains: Column, order: int):
        self.spark, self.order = docs.sparkSession, order
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        least = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.partitions = max(least, min(MOST_PARTITIONS, -(-size // PARTITION_BYTES)))
        self.corpus_name = f"katz_corpus_{uuid.uuid4().hex}"
        self.tables = new_path(self.spark, "katz")
        self._encode(docs, trains)
        sizes = self.spark.table(self.corpus_name).agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
        self.buckets = max(self.partitions, -(-sizes // BUCKET_KEYS))

    def _encode(self, docs: DataFrame, trains: Column) -> None:
        def encode(batches):
            from pyspark import TaskContext

            part, number = TaskContext.get().partitionId(), 0
            cache = per_worker("katz words", lambda: BoundedCache(lambda w: word_key(w).to_bytes(8, "little")))
            rows, tokens = [], 0

            def chunk():
                c = Chunk.of_texts(rows)
                return _binary(
                    chunk=[(part << 32) | number], n_tokens=[len(c.tokens)], ids=[c.ids.tobytes()], flags=[c.flags.tobytes()],
                    lengths=[c.lengths.tobytes()], tokens=[c.tokens.tobytes()], words=[c.words.tobytes()],
                )

            for batch in batches:
                for doc_id, text, train in zip(batch["doc_id"].to_pylist(), batch["text"], batch["trains"].to_pylist(), strict=True):
                    words = text.as_py().encode().lower().split()
                    rows.append((doc_id, train, np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint64)))
                    tokens += len(words) + 1
                    if tokens >= CHUNK_TOKENS:
                        yield chunk()
                        rows, tokens, number = [], 0, number + 1
            if rows:
                yield chunk()

        rows = texts(docs.withColumn("_trains", trains), "_trains")
        rows = rows.select("doc_id", "text", F.col("_trains").alias("trains"))
        schema = "chunk long, n_tokens long, ids binary, flags binary, lengths binary, tokens binary, words binary"
        chunks = rows.mapInArrow(encode, schema)
        chunks.write.format("parquet").option("compression", "zstd").bucketBy(self.partitions, "chunk").saveAsTable(self.corpus_name)

    def corpus(self) -> DataFrame:
        return self.spark.table(self.corpus_name)

    def _stored(self, df: DataFrame, what: str) -> DataFrame:
        """Stores sums as the partition `what` of the run's tables."""
        path = f"{self.tables}/what={what}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _summed(self, parts: DataFrame, what: str, level: int) -> list[int]:
        """Sums counts by key over all chunks, stores them, and returns [types with count 1, 2, ..., all types, sum].

        A stored count is doubled, plus one in the one chunk that stands for the n-gram.
        """
        skip, most = begin_key(level), DISCOUNTED + 1

        def total(group: pa.Table) -> pa.Table:
            keys = [np.frombuffer(x.as_py(), np.uint64) for x in group["keys"]]
            counts = [np.frombuffer(x.as_py(), np.int32) for x in group["values"]]
            different, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(different)).astype(np.int64)
            out = 2 * sums[inverse]
            out[first] += 1
            real = sums[different != np.uint64(skip)]
            real = real[real > 0]
            tally = np.append(np.bincount(np.minimum(real, most + 1), minlength=most + 2)[1 : most + 1], [len(real), real.sum()])
            edges = np.cumsum([len(k) for k in keys])[:-1]
            values = [x.tobytes() for x in np.split(out, edges)] + [tally.astype(np.int64).tobytes()]
            bucket = group["bucket"][0].as_py()
            return pa.table({"chunk": [*group["chunk"].to_pylist(), -1], "bucket": [bucket] * len(values), "values": values}, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("values", pa.binary())]))

        sums = self._stored(parts.groupBy("bucket").applyInArrow(total, "chunk long, bucket int, values binary"), what)

        def tallies(batches):
            for batch in batches:
                found = [np.frombuffer(x.as_py(), np.int64) for x in batch["values"]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, axis=0).tolist()])], ["tally"])

        rows = sums.filter("chunk = -1").mapInArrow(tallies, "tally array<long>")
        one = rows.agg(*[F.sum(F.col("tally")[i]).alias(f"n{i}") for i in range(most + 2)]).first()
        return [int(x or 0) for x in one]

    def _count(self, level: int) -> list[int]:
        order, buckets = self.order, self.buckets

        def parts(batches):
            for chunk, c, _ in chunks_of(batches):
                x = c.levels(order)[level]
                counts = c.counts(x).astype(np.int32)
                for bucket, places in by_bucket(x.keys, buckets):
                    yield _binary(chunk=[chunk], bucket=pa.array([bucket], pa.int32()), keys=[x.keys[places].tobytes()], values=[counts[places].tobytes()])

        df = self.corpus().mapInArrow(parts, "chunk long, bucket int, keys binary, values binary")
        return self._summed(df, f"count{level}", level)

    def _with_sums(self, wanted: list[str]) -> DataFrame:
        """The corpus's chunks, each with the stored sums that belong to it."""
        stored = None
        for what in wanted:
            rows = self.spark.read.schema("chunk long, bucket int, values binary").parquet(f"{self.tables}/what={what}")
            rows = rows.filter("chunk >= 0").withColumn("what", F.lit(what))
            stored = rows if stored is None else stored.unionByName(rows)
        sums = stored.groupBy("chunk").agg(F.collect_list(F.struct("what", "bucket", "values")).alias("sums"))
        # Sorted and merged, so that a partition of any size can be spilled.
        return self.corpus().join(sums.hint("merge"), "chunk")

    def _weigh(self, level: int, factors, unigrams) -> None:
        """Backoff weights of the histories of length level - 1."""
        order, buckets = self.order, self.buckets

        def parts(batches):
            for chunk, c, sums in chunks_of(batches):
                levels = c.levels(order)
                counts, own, weights = read_sums(levels, sums, buckets, level)
                p = ngram_probabilities(levels, counts, weights, factors, unigrams, level - 1)
                x = levels[level]
                mine = own[level] & (counts[level] > 0)
                if order > 1:
                    mine &= levels[1].keys[x.last] != np.uint64(BEGIN)
                history = np.maximum(counts[level - 1][x.history], 1)
                n = len(levels[level - 1].keys)
                seen = np.bincount(x.history[mine], weights=(discounted(counts[level], factors[level]) / history)[mine], minlength=n)
                below = np.bincount(x.history[mine], weights=p[level - 1][x.shorter][mine], minlength=n)
                for bucket, places in by_bucket(levels[level - 1].keys, buckets):
                    yield _binary(chunk=[chunk], bucket=pa.array([bucket], pa.int32()), keys=[levels[level - 1].keys[places].tobytes()], values=[np.stack([seen[places], below[places], counts[level - 1][places]]).tobytes()])

        def weigh(group: pa.Table) -> pa.Table:
            keys = [np.frombuffer(x.as_py(), np.uint64) for x in group["keys"]]
            values = np.concatenate([np.frombuffer(x.as_py(), np.float64).reshape(3, -1) for x in group["values"]], axis=1)
            different, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            seen = np.bincount(inverse, weights=values[0], minlength=len(different))
            below = np.bincount(inverse, weights=values[1], minlength=len(different))
            total = values[2][first]
            none_left = (1 - seen <= 1e-9) & (total > 0)
            seen = np.where(none_left, seen * total / np.maximum(total + 1, 1), seen)
            weight = (1 - seen) / np.maximum(1 - below, 1e-300)
            weight = np.where(none_left, -weight, weight)[inverse]
            edges = np.cumsum([len(k) for k in keys])[:-1]
            return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "values": pa.chunked_array([[x.tobytes() for x in np.split(weight, edges)]], pa.binary())})

        wanted = [f"count{k}" for k in range(1, level + 1)] + [f"weight{k}" for k in range(2, level)]
        df = self._with_sums(wanted).mapInArrow(parts, "chunk long, bucket int, keys binary, values binary")
        self._stored(df.groupBy("bucket").applyInArrow(weigh, "chunk long, bucket int, values binary"), f"weight{level}")

    def scores(self) -> DataFrame:
        order, buckets = self.order, self.buckets
        tallies = {level: self._count(level) for level in range(1, order + 1)}
        factors = {level: good_turing(tallies[level][: DISCOUNTED + 1]) for level in tallies}
        types, tokens = tallies[1][-2:]
        unigrams = Unigrams(tokens, tallies[1], factors[1])
        for level in range(2, order + 1):
            self._weigh(level, factors, unigrams)

        def score(batches):
            for _, c, sums in chunks_of(batches):
                levels = c.levels(order)
                counts, _, weights = read_sums(levels, sums, buckets, order)
                p = ngram_probabilities(levels, counts, weights, factors, unigrams, order)[order]
                starts = np.concatenate([[0], np.cumsum(c.lengths.astype(np.int64))[:-1]])
                seen = counts[1][c.tokens]
                base = np.log10((seen + 0.1) / (tokens + 0.1 * (types + 1)))
                logs = np.log10(p[levels[order].at[c.token_at]])
                add = lambda x: np.add.reduceat(x, starts)
                yield _binary(
                    doc_id=pa.array(c.ids, mask=c.no_id), held_out=~c.trains, n_tokens=c.lengths.astype(np.int64), n_known=add((seen > 0).astype(np.int64)),
                    train_tokens=np.full(len(c.ids), tokens, np.int64), base_score=add(base), score=add(logs),
                )

        wanted = [f"count{k}" for k in range(1, order + 1)] + [f"weight{k}" for k in range(2, order + 1)]
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        path = new_path(self.spark, "katz-scores")
        self._with_sums(wanted).mapInArrow(score, schema).write.parquet(path)
        self._drop()
        return self.spark.read.schema(schema).parquet(path)

    def _drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.corpus_name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.tables)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def chunks_of(batches):
    """(chunk, Chunk, stored sums by what) for each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(batch[name][i].as_py(), kind)  # noqa: B023, E731
            c = Chunk(get("ids", np.int64), get("flags", np.uint8), get("lengths", np.int32), get("tokens", np.int32), get("words", np.uint64))
            sums: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
            if "sums" in batch.schema.names:
                for row in batch["sums"][i].as_py():
                    sums[row["what"]].append((row["bucket"], row["values"]))
            yield batch["chunk"][i].as_py(), c, sums


def read_sums(levels, sums, buckets: int, most: int):
    """Counts, ownership and history weights of the chunk's n-grams, as far as they're stored."""
    counts, own, weights = {}, {}, {}
    for level in range(1, most + 1):
        both = put_back(sums[f"count{level}"], levels[level].keys, buckets, np.int64)
        counts[level], own[level] = both >> 1, (both & 1) == 1
        if f"weight{level}" in sums:
            weights[level] = put_back(sums[f"weight{level}"], levels[level - 1].keys, buckets, np.float64)
    return counts, own, weights


def katz_scores(docs: DataFrame, trains: Column, order: int = 2) -> DataFrame:
    """Scores every text by a Katz model of the given order, learnt from the rows where `trains` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row per row of docs.  A text's
    tokens are its words, A-Z lower-cased, and one end; null is the empty text, which is the end alone.  base_score
    is the additive unigram score, score the model's log10 probability.  All words that the training rows lack are
    one unknown type.  Words and n-grams stand as 64-bit hashes: two that collide, of which one in a corpus of 2**32
    different n-grams is to be expected, count as one.  A document is scored in one piece, so memory of a task follows
    its longest document (about 200 bytes a token).  With no training row every token has probability 1 for the model (there is one type).
    Repeated rows each count; an empty table gives no rows; null doc_ids stay null; other columns are ignored.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    with shuffle_files_dropped(docs.sparkSession):
        return KatzJob(docs, F.coalesce(trains, F.lit(False)), order).scores()
