"""Language of texts and of the spans within them.

The script of a word's letters narrows the candidate languages; each candidate scores the word by the character
trigrams of its language; Viterbi with a penalty for every switch labels the words; the language with most labelled
letters is the text's.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, per_worker, written

#: First and last code points of scripts, in order of the first.
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x309F, "hiragana"),
    (0x30A0, 0x30FF, "katakana"),
    (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
_STARTS = [first for first, _, _ in SCRIPTS]

#: Different labelled rows that training reads, about: of one language, and of all; those of smallest hash.
TRAINING_ROWS, ALL_TRAINING_ROWS = 1_500, 60_000
SWITCH_PENALTY = 12.0
#: A word's log-likelihood ratio counts at most this much, so that one odd word doesn't make a span.
WORD_BOUND = 6.0
UNKNOWN = "und"
#: Words whose scores a worker keeps, and scores: with many languages fewer words.
CACHED_WORDS, CACHED_SCORES = 200_000, 8_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


_NAMES = sorted({name for _, _, name in SCRIPTS}) + ["other"]
_RANGE_ENDS = np.array([last for _, last, _ in SCRIPTS], np.int64)
_RANGE_NAMES = np.array([_NAMES.index(name) for _, _, name in SCRIPTS])


def scripts_of(words: list[str]) -> list[str]:
    """The script of most letters of each word, the first in order of names if several."""
    codes = _codes("".join(words)).astype(np.int64)
    k = np.searchsorted(_STARTS, codes, side="right") - 1
    script = np.where((k >= 0) & (codes <= _RANGE_ENDS[k]), _RANGE_NAMES[k], len(_NAMES) - 1)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(word * len(_NAMES) + script, minlength=len(words) * len(_NAMES)).reshape(len(words), len(_NAMES))
    return [_NAMES[i] for i in counts.argmax(axis=1)]


def script_of(word: str) -> str:
    return scripts_of([word])[0]


def letters_of(chunk: str) -> str:
    return chunk.lower() if chunk.isalpha() else "".join(c for c in chunk if c.isalpha()).lower()


def ngrams(word: str) -> list[str]:
    """The trigrams of a word with its ends marked: as many as it has letters."""
    marked = f"^{word}$"
    return [marked[i : i + 3] for i in range(len(word))]


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n, scripts: summed over docs whose lang isn't null."""

    def count(batches):
        sums: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            for t, language in zip(batch["text"], batch["lang"], strict=True):
                words: dict[str, int] = defaultdict(int)
                for chunk in t.split():
                    words[chunk] += 1
                lettered = [(word, n) for chunk, n in words.items() if (word := letters_of(chunk))]
                for (word, n), script in zip(lettered, scripts_of([w for w, _ in lettered]), strict=True):
                    sums[language, "=" + script] += n
                    for gram in ngrams(word):
                        sums[language, gram] += n
        rows = [(language, gram, n) for (language, gram), n in sums.items()]
        yield pd.DataFrame(rows, columns=["lang", "gram", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    return rows.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Scores of words by language, from n-gram counts (lang, gram, n)."""

    def __init__(self, counts: list[tuple[str, str, int]], switch_penalty: float = SWITCH_PENALTY):
        self.languages = sorted({lang for lang, _, _ in counts})
        self.penalty = switch_penalty
        index = {lang: k for k, lang in enumerate(self.languages)}
        n = len(self.languages)
        self.scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        grams, langs, ns = [], [], []
        for lang, gram, count in counts:
            if gram[0] == "=" and len(gram) > 3:
                self.scripts[gram][index[lang]] += count
            else:
                grams.append(gram)
                langs.append(index[lang])
                ns.append(count)
        code = _codes("".join(grams)).reshape(-1, 3)
        key = code[:, 0] << np.uint64(42) | code[:, 1] << np.uint64(21) | code[:, 2]
        langs, ns = np.array(langs, np.int64), np.array(ns, float)
        order = np.lexsort((langs, key))
        #: The known trigrams in order; of each its languages and how much more than an unknown one it scores there.
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(order))
        totals = np.bincount(langs, weights=ns, minlength=n)
        smooth = 0.5
        self.unknown = np.log(smooth / (totals + smooth * (len(self.keys) + 1)))
        self.gram_langs = langs[order]
        self.gram_scores = np.log((ns[order] + smooth) / smooth)
        words = sum(self.scripts.values(), np.zeros(n))
        #: A language is a candidate for a script that at least a hundredth of its words are in.
        self.candidates = {s[1:]: c >= 0.01 * np.maximum(words, 1) for s, c in self.scripts.items()}
        #: For each chunk a row of scores, letters and letters in a script of any candidate; -1 for one without a letter.
        self.index: dict[str, int] = {}
        self.row_of_word: dict[str, int] = {}
        self.table = np.zeros((1024, n + 2), np.float32)
        self.filled = 0
        self.cached = max(1_000, min(CACHED_WORDS, CACHED_SCORES // (n + 2)))

    def word_scores(self, words: list[str], scripts: list[str]) -> np.ndarray:
        """Scores of the candidates, the best 0, none under -WORD_BOUND; all 0 if no candidate has the script."""
        codes = _codes("".join(f"^{w}$" for w in words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 2) - lengths - 2
        key = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
        word = np.repeat(np.arange(len(words)), lengths + 2)[: len(key)]
        own = np.arange(len(key)) - starts[word] < lengths[word]  # not those over two words
        key, word = key[own], word[own]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        at, word = at[known], word[known]
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        size = len(self.languages)
        score = np.bincount(np.repeat(word, n) * size + self.gram_langs[entry], weights=self.gram_scores[entry], minlength=len(words) * size)
        score = score.reshape(len(words), size) + lengths[:, None] * self.unknown
        none = np.zeros(size, bool)
        allowed = np.array([self.candidates.get(s, none) for s in scripts])
        unknown = ~allowed.any(axis=1)
        score[~allowed] = -np.inf
        score[unknown] = 0
        return np.maximum(score - score.max(axis=1, keepdims=True), -WORD_BOUND)

    def _learn(self, chunks: list[str]) -> None:
        """Adds chunks to the cache, which is emptied first if it would hold too many."""
        if len(self.index) + len(chunks) > self.cached:
            self.index.clear()
            self.row_of_word.clear()
            self.filled = 0
        words = [letters_of(c) for c in chunks]
        self.index.update((c, -1) for c, w in zip(chunks, words, strict=True) if not w)
        lettered = [(c, w) for c, w in zip(chunks, words, strict=True) if w]
        words = [w for w in dict.fromkeys(w for _, w in lettered) if w not in self.row_of_word]
        end = self.filled + len(words)
        self.row_of_word.update(zip(words, range(self.filled, end), strict=True))
        self.index.update((c, self.row_of_word[w]) for c, w in lettered)
        if not words:
            return
        scripts = scripts_of(words)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(end, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
        self.table[self.filled : end, :-2] = self.word_scores(words, scripts)
        self.table[self.filled : end, -2] = [len(w) for w in words]
        self.table[self.filled : end, -1] = [len(w) * self.scripted(s) for w, s in zip(words, scripts, strict=True)]
        self.filled = end

    def scripted(self, script: str) -> bool:
        """Whether some language is a candidate for the script."""
        candidates = self.candidates.get(script)
        return candidates is not None and bool(candidates.any())

    def _rows(self, text: str) -> np.ndarray:
        """The table's rows of the words with a letter."""
        chunks, parts = text.split(), []
        for at in range(0, len(chunks), self.cached):  # a text may have more words than the cache holds
            part = chunks[at : at + self.cached]
            new = [c for c in dict.fromkeys(part) if c not in self.index]
            if new:
                self._learn(new if len(self.index) + len(new) <= self.cached else list(dict.fromkeys(part)))
            rows = np.fromiter(map(self.index.__getitem__, part), np.int64, len(part))
            parts.append(self.table[rows[rows >= 0]])
        return np.concatenate(parts) if parts else self.table[:0]

    def label(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The language's number for each word with a letter, and the words' letters."""
        found = self._rows(text)
        return self.best_path(found[:, :-2].astype(float)), found[:, -2]

    def can_tell(self, text: str | None) -> bool:
        """Whether at least half of the letters are in words of a script that some learnt language is written in."""
        if not text or not self.languages:
            return False
        found = self._rows(text)
        letters = found[:, -2].sum(dtype=float)
        return bool(letters and 2 * found[:, -1].sum(dtype=float) >= letters)

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi over the words: the labels of largest sum of scores less the penalty for each switch."""
        n, languages = scores.shape
        if n == 0 or languages <= 1:
            return np.zeros(n, np.int64)
        totals = scores.sum(0)
        leader = int(totals.argmax())
        gain = np.cumsum(scores - scores[:, leader : leader + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, languages)), gain[:-1]]), axis=0), 0)
        # No stretch of words gains half a penalty by another language: no path with switches is better.
        if (gain - low).max() < self.penalty / 2:
            return np.full(n, leader)
        best, back = scores[0].tolist(), []
        penalty, span = self.penalty, range(languages)
        for row in scores[1:].tolist():
            top = max(best)
            k = best.index(top)
            switched = top - penalty
            back.append([j if best[j] >= switched else k for j in span])
            best = [(best[j] if best[j] >= switched else switched) + row[j] for j in span]
        path = np.zeros(n, np.int64)
        path[-1] = k = best.index(max(best))
        for i in range(n - 2, -1, -1):
            path[i] = k = back[i][k]
        return path

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) over the words that have a letter."""
        path, _ = self.label(text)
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)] if len(path) else [0]
        return [(a, b, self.languages[path[a]]) for a, b in zip(edges, edges[1:])]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most letters, and its share of them; `und` and 0 without a letter or a model."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        path, letters = self.label(text)
        if not len(path):
            return UNKNOWN, 0.0
        by_language = np.bincount(path, weights=letters, minlength=len(self.languages))
        k = int(by_language.argmax())
        return self.languages[k], float(min(1.0, by_language[k] / by_language.sum()))


def train(docs: DataFrame, training: Column, rows: int = TRAINING_ROWS, all_rows: int = ALL_TRAINING_ROWS) -> list[tuple[str, str, int]]:
    """N-gram counts of each language, all that there are in the labelled rows read, where `training` holds.

    Read are about `rows` different rows of a language, fewer if all languages would come to more than all_rows: those
    of smallest hash of id and text, and rows that repeat these once.
    """
    usable = docs.filter(training & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = written(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("there")), "language-sizes")
    languages = sizes.count()
    each = min(rows, all_rows / max(languages, 1))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(sizes, "lang").filter(share * F.col("there") < each)
    # Rows that repeat one another are in the sample together or not at all, and count once.
    counts = ngram_counts(sample.select("doc_id", "lang", "text").dropDuplicates())
    found = [(r["lang"], r["gram"], r["n"]) for r in counts.orderBy("lang", "gram").collect()]  # bounded by the rows read
    dropped(sizes)
    return found


def predictor(docs: DataFrame, counts: list[tuple[str, str, int]], penalty: float = SWITCH_PENALTY):
    """A column function: text -> struct(lang_pred, score)."""
    shared, tag = docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        model = per_worker(("language", tag), lambda: LanguageModel(shared.value, penalty))
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang_pred", "score"])

    return predict


def span_labeller(docs: DataFrame, counts: list[tuple[str, str, int]], penalty: float = SWITCH_PENALTY):
    """A column function: text -> array of struct(first_word, end_word, lang)."""
    shared, tag = docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    @F.pandas_udf("array<struct<first_word:int,end_word:int,lang:string>>")
    def spans(text: pd.Series) -> pd.Series:
        model = per_worker(("language", tag), lambda: LanguageModel(shared.value, penalty))
        return text.map(lambda t: [{"first_word": a, "end_word": b, "lang": lang} for a, b, lang in (model.spans(t) if t and model.languages else [])])

    return spans


def identify(docs: DataFrame, held_out: Column, counts: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row per row of docs, from a model learnt where `held_out` is false.

    lang_pred is a learnt lang value, `und` (score 0) where text is null or has no letter or nothing was learnt;
    ties go to the language first in order; repeated rows are each labelled; an empty table gives no rows; columns
    other than doc_id, text and lang are ignored.
    """
    counts = train(docs, ~held_out) if counts is None else counts
    bounded_batches(docs)
    predict = predictor(docs, counts)
    found = docs.select("doc_id", held_out.alias("held_out"), predict("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def with_known_language(docs: DataFrame, held_out: Column) -> DataFrame:
    """The documents whose language can be told, with all their columns; texts without a letter go, and those of which
    over half of the letters are in scripts that no learnt language is written in.

    Where nothing could be learnt (no lang at all), no text can be told and all go.
    """
    bounded_batches(docs)
    shared, tag = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out)), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        model = per_worker(("language", tag), lambda: LanguageModel(shared.value))
        return pd.Series([model.can_tell(t) and model.predict(t)[0] != UNKNOWN for t in text], dtype=bool)

    return docs.filter(known("text"))
