"""Token ids of a vocabulary file, for the packing and the output operators.

The tokenizer drops white space and never joins symbols across it, so a text's ids are the ids of its white-space
chunks in order.  A batch of texts is split, and its chunks are numbered and cut into a Latin word and the marks
after it, by Arrow; each different word is encoded once, by the library; numpy gathers the ids of the texts.  Nothing
is done in Python per word of the text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import per_worker

END_ID = 1
#: Units (words, marks, other chunks) whose ids a worker keeps between batches, and units joined in one library call.
KEPT_UNITS, JOINED_UNITS = 400_000, 1_000
#: Bytes of text that are encoded at once, or one text.
SLICE_BYTES = 4 << 20
#: A word of Latin letters (each of which has one lower-case letter), and marks: the tokenizer separates and
#: lower-cases these anyway.
_WORD = "^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[.,;:!?]*)$"


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[starts[i] : starts[i] + sizes[i]] for each i of `chosen`, one after the other, and where each ends."""
    n = sizes[chosen]
    ends = np.cumsum(n)
    at = np.repeat(starts[chosen] - (ends - n), n)
    at += np.arange(len(at), dtype=np.int64)
    return flat[at], ends


class Units:
    """Cuts batches of texts into chunks and those into units, and keeps what a subclass knows of units that recur.

    A subclass has _learn(units, words), which appends to self.units and to its own tables, and _select(places), which
    keeps these places of its tables only.
    """

    def __init__(self, kept: int = KEPT_UNITS):
        self.kept, self.units = kept, pa.array([], pa.large_string())

    def _places(self, units: pa.Array, words: np.ndarray) -> np.ndarray:
        """Where each of the different units is among those known, once the others are learnt."""
        new = pc.index_in(units, value_set=self.units).is_null()
        if pc.any(new).as_py():
            self._learn(units.filter(new), words[new.to_numpy(zero_copy_only=False)])
        return pc.index_in(units, value_set=self.units).to_numpy().astype(np.int64)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units, chunks, bounds): places of the two units of each different chunk, one after the other, the numbers
        of the texts' chunks in order, and where each text's chunks begin and end."""
        pieces = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        # White space at the ends of a text makes empty pieces, which have no ids.
        numbered = pc.dictionary_encode(pieces.flatten())
        chunks = numbered.dictionary
        found = pc.extract_regex(chunks, pattern=_WORD)
        is_word = found.is_valid()
        first = pc.dictionary_encode(pc.if_else(is_word, pc.utf8_lower(pc.struct_field(found, "word")), chunks))
        second = pc.dictionary_encode(pc.fill_null(pc.struct_field(found, "marks"), ""))
        plain = np.zeros(len(first.dictionary), bool)
        plain[first.indices.to_numpy()[is_word.to_numpy(zero_copy_only=False)]] = True
        head = self._places(first.dictionary, plain)
        # Learning adds at the end only, so places stay.
        tail = self._places(second.dictionary, np.zeros(len(second.dictionary), bool))
        units = np.stack([head[first.indices.to_numpy()], tail[second.indices.to_numpy()]], axis=1).reshape(-1)
        return units, numbered.indices.to_numpy(), bounds - bounds[0]

    def forget(self, units: np.ndarray, chunks: np.ndarray) -> None:
        """Beyond `kept` units, only those seen more than once in the last batch stay."""
        if len(self.units) > self.kept:
            counts = np.repeat(np.bincount(chunks, minlength=len(units) // 2), 2)
            seen = np.bincount(units, weights=counts, minlength=len(self.units))
            stay = np.flatnonzero(seen > 1)[: self.kept]
            self.units = self.units.take(pa.array(stay))
            self._select(stay)


def slices(texts: pa.Array):
    """Slices of about SLICE_BYTES, of one text at least."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


class ChunkIds(Units):
    """Ids of texts."""

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        from tokenizers import Tokenizer

        super().__init__(kept)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        #: Whether an id ends a word; without such ids in the vocabulary words are encoded one by one.
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids and how many each has, from one call: of each word's ids the last, and no other, ends a word."""
        ids = self._encoded([" ".join(words)])[0]
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encoded(units)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _learn(self, units: pa.Array, words: np.ndarray) -> None:
        """`words` says which units are Latin words."""
        for some, encode in ((units.filter(pa.array(words)), self._joined), (units.filter(pa.array(~words)), self._each)):
            parts = [encode(some.slice(at, JOINED_UNITS).to_pylist()) for at in range(0, len(some), JOINED_UNITS)]
            sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
            self.units = pa.concat_arrays([self.units, some])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])

    def _select(self, places: np.ndarray) -> None:
        self.flat, ends = gathered(self.flat, self.starts, self.sizes, places)
        self.sizes = self.sizes[places]
        self.starts = ends - self.sizes

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        units, chunks, bounds = self.cut(texts)
        # Each chunk's ids are those of its two units; then each text's are those of its chunks.
        chunk_flat, ends = gathered(self.flat, self.starts, self.sizes, units)
        ends = ends[1::2]
        sizes = np.diff(ends, prepend=0)
        ids, at = gathered(chunk_flat, ends - sizes, sizes, chunks)
        self.forget(units, chunks)
        return ids, np.concatenate([[0], at])[bounds]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's ids (one more than there are texts)."""
        parts, bounds = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for part in slices(texts):
            ids, edges = self._slice(part)
            parts.append(ids)
            bounds.append(edges[1:] + bounds[-1][-1])
        return np.concatenate(parts), np.concatenate(bounds)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As texts(), with the end id after each text's ids."""
        ids, bounds = self.texts(texts)
        n = len(bounds) - 1
        out = np.full(len(ids) + n, END_ID, "<u4")
        ours = np.ones(len(out), bool)
        ours[bounds[1:] + np.arange(n)] = False
        out[ours] = ids
        return out, bounds + np.arange(n + 1)

    def __call__(self, text: str) -> bytes:
        return self.texts(pa.array([text]))[0].tobytes()


def vocabulary_size(path: str) -> int:
    """How many ids there are, added tokens included; the vocabulary itself isn't kept."""

    def size():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path).get_vocab_size()

    return per_worker(("size", path), size)


def chunk_ids(path: str) -> ChunkIds:
    return per_worker(("ids", path), lambda: ChunkIds(path), keep=1)  # in a pipeline, earlier stages' models go


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
