"""Product codes of vectors by exact integer k-means over flat blocks.

Vectors are cut into parts.  The points of each part are sorted along a Hilbert curve and stored in flat blocks with
their box (least and largest value of each component) and their sum.  In a round a block's box bounds how near and how
far any of its points can be from each codebook entry, so only a shortlist of entries is compared with the points, by a
small exact kernel; a block with one entry left adds its stored sum, unread.  Codebooks are of a fixed size; they go to
the tasks with the function that uses them, and sums by entry come back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points of a block.
BLOCK = 64
#: Scaled components must be below it; a block's sums then fit into 64 bits.
LARGEST = 1 << 53
LONGEST = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of cells, each component of `bits` bits; neighbours on it are neighbours."""
    x = cells.astype(np.int64, copy=True)
    dims = x.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[:, -1] & q, q - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


@dataclass(frozen=True)
class Shape:
    """What the kernels must know of all points: components of a vector, and their least and largest value."""

    size: int
    low: int
    high: int
    parts: int

    @property
    def dims(self) -> int:
        return self.size // self.parts

    @property
    def stored(self) -> str:
        most = max(-self.low, self.high)
        return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"

    @property
    def exact(self):
        """A type in which every squared distance of a part is exact; the first has fast products."""
        most = 4 * self.dims * max(-self.low, self.high, 1) ** 2
        return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object

    def keys(self, points: np.ndarray) -> np.ndarray:
        """Hilbert keys of at most 63 bits: of the first 63 components where there are more."""
        dims = min(self.dims, 63)
        bits = min(63 // dims, 16)
        cells = ((points[:, :dims] - self.low).astype(np.float64) * ((1 << bits) / (self.high - self.low + 1.0))).astype(np.int64)
        return hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (of equals the first) and its squared distance, for each point; exact in their type."""
    d = (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(at)), at]


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that may be the nearest to a point of the box: no farther at best than some entry is at worst."""
    short = np.maximum(np.maximum(low - entries, entries - high), 0)
    long = np.maximum(np.abs(entries - low), np.abs(high - entries))
    return np.flatnonzero((short * short).sum(1) <= (long * long).sum(1).min())


def _kept(vectors: DataFrame, vec_id: str, vector: str, label: str, parts: int) -> DataFrame:
    """row (unique), vec_id, label and the scaled components q, of the vectors that can be coded; written."""
    v = F.col(vector)
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < LARGEST)
    ok = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, fit)
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("q"),
    )
    return written(rows, "vector-rows")


def _blocks(rows: DataFrame, shape: Shape) -> DataFrame:
    """part, n, rows, points, low, high, sums: flat blocks in the order of the curve; written."""

    def points(batches):
        for batch in batches:
            q = batch["q"].flatten().to_numpy().reshape(batch.num_rows, shape.parts, shape.dims)
            for part in range(shape.parts):
                own = np.ascontiguousarray(q[:, part])
                raw, width = memoryview(own.astype(shape.stored).tobytes()), shape.dims * np.dtype(shape.stored).itemsize
                each = pa.array([raw[i * width : (i + 1) * width] for i in range(len(own))], pa.binary())
                columns = [pa.array(np.full(len(own), part, np.int32)), pa.array(shape.keys(own)), batch["row"], each]
                yield pa.RecordBatch.from_arrays(columns, ["part", "key", "row", "point"])

    def block(part, ids, own):
        own = own.astype(np.int64)
        return part, len(ids), ids.tobytes(), own.astype(shape.stored).tobytes(), own.min(0).tobytes(), own.max(0).tobytes(), own.sum(0).tobytes()

    def cut(batches):
        waiting: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out = []
            part, ids = batch["part"].to_numpy(), batch["row"].to_numpy()
            own = np.frombuffer(b"".join(batch["point"].to_pylist()), shape.stored).reshape(-1, shape.dims)
            for p in np.unique(part).tolist():
                now, points = ids[part == p], own[part == p]
                if p in waiting:
                    now, points = np.concatenate([waiting[p][0], now]), np.concatenate([waiting[p][1], points])
                whole = len(now) // BLOCK * BLOCK
                out += [block(p, now[i : i + BLOCK], points[i : i + BLOCK]) for i in range(0, whole, BLOCK)]
                waiting[p] = now[whole:], points[whole:]
            yield from _batch(out)
        yield from _batch([block(p, *rest) for p, rest in waiting.items() if len(rest[0])])

    def _batch(out):
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), *[pa.binary()] * 5], strict=True)], names)

    names = ["part", "n", "rows", "points", "low", "high", "sums"]
    laid = written(rows.select("row", "q").mapInArrow(points, "part int, key long, row long, point binary"), "vector-points")
    # The row is part of the order, so that a vector of very many copies is dealt over many tasks.
    ordered = laid.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row").select("part", "row", "point")
    out = written(ordered.mapInArrow(cut, "part int, n int, rows binary, points binary, low binary, high binary, sums binary"), "vector-blocks")
    dropped(laid)
    return out


def _shortlisted(batch, shape: Shape, books: np.ndarray):
    """part, number of points, shortlisted entries, sums and points of each block of a batch."""
    for part, n, low, high, sums, points in zip(*[batch[c].to_pylist() for c in ("part", "n", "low", "high", "sums", "points")], strict=True):
        low, high = (np.frombuffer(x, np.int64).astype(shape.exact) for x in (low, high))
        chosen = shortlist(low, high, books[part])
        yield part, n, chosen, sums, points


def _round(blocks: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the points nearest to it."""
    parts, entries, dims = books.shape
    most = max(1, LONGEST // max(1, -shape.low, shape.high))  # points whose sums fit into 64 bits

    def add_up(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dims), np.int64)
        exact = books.astype(shape.exact)

        def totals():
            p, e = np.nonzero(n)
            out = pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])
            n[:], sums[:] = 0, 0
            return out

        for batch in batches:
            for part, count, chosen, total, points in _shortlisted(batch, shape, exact):
                if n.sum() + count > most:
                    yield totals()
                if len(chosen) == 1:
                    n[part, chosen[0]] += count
                    sums[part, chosen[0]] += np.frombuffer(total, np.int64)
                    continue
                own = np.frombuffer(points, shape.stored).reshape(count, dims)
                at = chosen[nearest(own.astype(shape.exact), exact[part][chosen])[0]]
                np.add.at(n[part], at, 1)
                np.add.at(sums[part], at, own.astype(np.int64))
        yield totals()

    found = blocks.select("part", "n", "low", "high", "sums", "points").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)])
    after = books.copy()
    for row in found.collect():  # a row per part and entry at most
        after[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return after


def _codes(blocks: DataFrame, shape: Shape, books: np.ndarray) -> DataFrame:
    """row, code0.., error: the nearest entry of each part and the squared distances' sum (null where no long holds it)."""

    def assign(batches):
        exact = books.astype(shape.exact)
        for batch in batches:
            out = []
            ids = batch["rows"].to_pylist()
            for raw, (part, n, chosen, _, points) in zip(ids, _shortlisted(batch, shape, exact), strict=True):
                own = np.frombuffer(points, shape.stored).reshape(n, shape.dims).astype(shape.exact)
                at, error = nearest(own, exact[part][chosen])
                out.append((np.frombuffer(raw, np.int64), np.full(n, part), chosen[at], error))
            if out:
                row, part, code, error = (np.concatenate(x) for x in zip(*out, strict=True))
                fits = pa.array([None if e > LONGEST else int(e) for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(part.astype(np.int32)), pa.array(code.astype(np.int32)), fits], ["row", "part", "code", "error"])

    each = blocks.select("part", "n", "rows", "low", "high", "sums", "points").mapInArrow(assign, "row long, part int, code int, error long")
    total = F.when(F.count("error") == shape.parts, F.sum(F.col("error").cast("decimal(20,0)")))
    codes = [F.max(F.when(F.col("part") == p, F.col("code"))).alias(f"code{p}") for p in range(shape.parts)]
    return each.groupBy("row").agg(*codes, _long(total).alias("error"))


def _long(total: Column) -> Column:
    return F.when(total <= LONGEST, total).cast("long")


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """Product codes of the vectors, and the codebooks (parts x entries x components; None without vectors).

    Components are scaled to integers floor(1024 x).  Codebooks start as the parts of the first `entries` vectors by id
    (nulls last; repeated ids by their components), fewer if there are fewer.  Each round assigns every point to the
    nearest entry (of equally near ones the first) and replaces entries by the floored means of theirs; unused ones stay.

    Returns a row per vector: vec_id, code, error (null where no long holds it), label_error (sum over all vectors of
    the label, nulls together), codebooks_sha256.  Dropped: null vectors, those with null or non-finite components or
    ones whose 1024-fold is 2^53 or more, and those whose length isn't that of the first kept id or no multiple of
    `parts`.  Rows that repeat an id are coded each; other columns are ignored; an empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: at most 256 entries")
    bounded_batches(vectors)
    kept = _kept(vectors, vec_id, vector, label, parts)
    sizes = kept.groupBy(F.size("q").alias("size")).agg(F.min("vec_id").alias("first"), F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high"))
    first = sizes.orderBy(F.col("first").asc_nulls_last(), "size").first()
    schema = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    shape = Shape(first["size"], first["low"], first["high"], parts)
    rows = kept.filter(F.size("q") == shape.size)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()  # of a fixed number
    books = np.array([r["q"] for r in start], np.int64).reshape(len(start), parts, shape.dims).transpose(1, 0, 2)
    blocks = _blocks(rows, shape)
    for _ in range(rounds):
        books = _round(blocks, shape, books)
    codes = rows.select("row", "vec_id", "label").join(_codes(blocks, shape, books), "row")
    code = F.concat(*[F.lpad(F.lower(F.hex(f"code{p}")), 2, "0") for p in range(parts)])
    codes = written(codes.select("vec_id", "label", code.alias("code"), "error"), "vector-codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"))
    by_label = written(by_label.select("of", _long(F.col("total")).alias("label_error")), "label-errors")
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    out = out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
    out = written(out, "vector-codes-answer")
    for x in (kept, blocks, codes, by_label):
        dropped(x)
    return out, books
