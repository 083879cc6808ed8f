"""Token ids in binary shard files of fixed-width bits.

A shard holds, in this order: blocks of ids, each id in the fewest bits that hold the vocabulary's largest id, each
block starting at a byte; the table of documents (id, number of tokens, 1 if the id is null); the table of block offsets; a footer.
Any id is read by one look into the block table, and a whole block is unpacked by numpy at once.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, new_path, open_stream, shuffle_files_dropped, texts, written
from .tokens import chunk_ids, vocabulary_size

MAGIC = b"BITIDS02"
FOOTER = struct.Struct("<QQQQQQ8s")  # bits, ids in a block, ids, documents, blocks, bytes of blocks, magic
BLOCK_IDS = 8192
#: A shard is closed when it holds this many ids, so no reader has to hold more.
SHARD_IDS = 1 << 23


def id_bits(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Least significant bit first, one id after the other, zeros up to a whole byte."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack_ids(data, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard to a stream; memory holds one block and the tables."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.waiting: list[np.ndarray] = []
        self.waiting_ids = self.ids = self.at = 0
        self.documents: list[tuple[int, int, bool]] = []
        self.blocks: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, len(ids), doc_id is None))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.waiting_ids += len(ids)
        if self.waiting_ids >= self.block_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for at in range(0, end, self.block_ids):
            data = pack_ids(ids[at : min(at + self.block_ids, end)], self.bits)
            self.blocks.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.waiting, self.waiting_ids = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(last=True)
        self.stream.write(np.array(self.documents, dtype="<i8").reshape(-1, 3).tobytes())
        self.stream.write(np.array(self.blocks, dtype="<u8").tobytes())
        self.stream.write(
            FOOTER.pack(self.bits, self.block_ids, self.ids, len(self.documents), len(self.blocks), self.at, MAGIC)
        )


class Shard:
    """Reads a shard, its tables at once and its ids block by block: from bytes, or from read(start, length) and a size."""

    def __init__(self, data, size: int | None = None):
        if size is None:
            whole, size = memoryview(data), len(data)
            data = lambda start, length: whole[start : start + length]
        self.read = data
        self.bits, self.block_ids, self.ids, documents, blocks, end, magic = FOOTER.unpack(data(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        tables = data(end, size - FOOTER.size - end)
        self.documents = np.frombuffer(tables, "<i8", 3 * documents).reshape(-1, 3)
        self.offsets = np.append(np.frombuffer(tables, "<u8", blocks, 24 * documents), np.uint64(end)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.documents[:, 1])]).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first to last, by one read."""
        at = int(self.offsets[first])
        data = self.read(at, int(self.offsets[last + 1]) - at)
        parts = []
        for k in range(first, last + 1):
            n = min(self.block_ids, self.ids - k * self.block_ids)
            begin = int(self.offsets[k]) - at
            parts.append(unpack_ids(data[begin : begin + (n * self.bits + 7) // 8], n, self.bits))
        return np.concatenate(parts)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, reading the blocks that hold them only."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        ids = self.blocks(first, last)
        return ids[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


#: Bytes of text of a task that writes shards, and the most tasks there are: beyond these, tasks write more shards.
PART_BYTES, MOST_PARTS = 16 << 20, 20_000


def range_cuts(docs: DataFrame) -> list[int]:
    """Cuts of doc_id into parts of about PART_BYTES of text each, at approximate percentiles; sorted, with repeats."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-size // PART_BYTES)))
    if parts == 1:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return sorted(docs.agg(F.percentile_approx("doc_id", shares, F.lit(10 * parts)).alias("c")).first()["c"] or [])


def token_ids(docs: DataFrame, vocabulary: str, cuts: list[int]) -> DataFrame:
    """doc_id, part and ids (little-endian, in 2 bytes each if the vocabulary's ids fit, else 4), the end id included.

    Parts are ranges of doc_id between the cuts, in order, null first.  A doc_id that is a cut may stand on both
    sides of it, so one that very many rows share is dealt in turn over all parts between its first and its last cut.
    """

    def encode(batches):
        encoder, edges, row = chunk_ids(vocabulary), np.array(cuts, np.int64), 0
        kind = "<u2" if id_bits(encoder.size) <= 16 else "<u4"
        for batch in batches:
            ids, bounds = encoder.documents(batch["text"])
            raw, width = memoryview(ids.astype(kind).tobytes()), np.dtype(kind).itemsize
            ends = (bounds * width).tolist()
            each = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            doc_id = batch["doc_id"].fill_null(0).to_numpy()
            low, high = np.searchsorted(edges, doc_id, "left"), np.searchsorted(edges, doc_id, "right")
            part = low + (row + np.arange(len(doc_id))) % (high - low + 1)
            part[batch["doc_id"].is_null().to_numpy(zero_copy_only=False)] = 0
            row += len(doc_id)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(part.astype(np.int32)), each], ["doc_id", "part", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, part int, ids binary")


def write_token_files(docs: DataFrame, vocabulary: str, path: str) -> DataFrame:
    """Writes the documents' ids, end id included, to shards under `path`, in ascending doc_id.

    Returns the written manifest: part, seq, file, n_docs, n_ids; shards in order of (part, seq) ascend in doc_id,
    null ids first.  Null text is the empty text, so the end id alone; rows that repeat a doc_id follow each other,
    over several shards if they are many; an empty table writes no shard; other columns are ignored.  A shard gets
    its name when it is whole, so a task that is run again replaces it.
    """
    rows = texts(docs)
    cuts = range_cuts(rows)

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        forget(("ids", vocabulary))  # the encoder's tables, which this stage has no use for
        bits = id_bits(vocabulary_size(vocabulary))
        kind = "<u2" if bits <= 16 else "<u4"
        system, folder = open_stream(path)
        system.create_dir(folder, recursive=True)
        done, writer, stream = [], None, None

        def close():
            writer.close()
            stream.close()
            name = f"part-{part:06d}-{len(done):05d}.ids"
            system.move(f"{folder}/{temporary}", f"{folder}/{name}")
            done.append((part, len(done), name, len(writer.documents), writer.ids))

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                if writer is None:
                    temporary = f"_{part}-{len(done)}-{attempt}"
                    stream = system.open_output_stream(f"{folder}/{temporary}")
                    writer = ShardWriter(stream, bits)
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
                if writer.ids >= SHARD_IDS:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["part", "seq", "file", "n_docs", "n_ids"]).astype({"part": "int32", "seq": "int32"}))

    # The packed ids are shuffled, not the texts.
    ordered = token_ids(rows, vocabulary, cuts).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("doc_id")
    with shuffle_files_dropped(docs.sparkSession):
        return written(ordered.select("doc_id", "ids").mapInArrow(write, "part int, seq int, file string, n_docs long, n_ids long"), "manifest")


#: Ids that a reader holds at once, or those of one document.
READ_IDS = 1 << 20


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """A row per document in the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Tasks take shards from the manifest and read them by ranges, so that no shard is in memory whole.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard only
    bases = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    bases = bases.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")

    def decode(batches):
        system, folder = open_stream(path)
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with system.open_input_file(f"{folder}/{name}") as stream:
                    shard = Shard(lambda at, n: stream.read_at(n, at), stream.size())  # noqa: B023
                    yield from _documents(shard, base)

    return bases.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(shard: Shard, base: int):
    at = 0
    while at < len(shard.documents):
        stop = max(at + 1, int(np.searchsorted(shard.starts, shard.starts[at] + READ_IDS, side="right")) - 1)
        first = int(shard.starts[at])
        raw = memoryview(shard.slice(first, int(shard.starts[stop])).tobytes())
        bounds = shard.starts[at : stop + 1] - first
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        doc_id = pa.array(shard.documents[at:stop, 0], mask=shard.documents[at:stop, 2] == 1)
        columns = [doc_id, pa.array(base + first + bounds[:-1]), pa.array(shard.documents[at:stop, 1]), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
        at = stop


def shard_bytes(documents: list[tuple[int, np.ndarray]], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A shard in memory, as for tests and small exports."""
    stream = io.BytesIO()
    writer = ShardWriter(stream, bits, block_ids)
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    writer.close()
    return stream.getvalue()


def token_file_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes docs to new shards in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    return read_token_files(spark, path, write_token_files(docs, vocabulary, path))
