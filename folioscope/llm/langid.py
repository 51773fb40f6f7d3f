"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, by a
forward algorithm; a text's log-likelihood is the sum over its words.  The
probabilities are fitted by expectation-maximisation (forward-backward) on a
bounded sample of labelled rows.

Edge cases: null, empty and letterless texts are ``und`` with score 0; ties go
to the language first in order; repeated rows score alike; an empty table gives
an empty table; other columns are ignored.  Without a labelled row to learn
from, every text is ``und``.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, crc32_of_id, portions, small_batches, with_columns

#: Labelled rows per language that the model is fitted on, about; the sample's only bound besides SAMPLE_CHARS.
SAMPLE_ROWS = 200
#: Longer texts are not learned from (they are scored whole).
SAMPLE_CHARS = 20_000
UND = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_START = "▁"
#: A character outside the vocabulary has this probability in every language.
_UNKNOWN = 1e-7
#: Each character is scaled up by this, so that long products stay in range.
_SCALE = 30.0
_LONG = 48


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Lower-case pieces of a sentencepiece vocabulary file, numbered; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return {x: k for k, x in enumerate(sorted(x for x in found if x == x.lower()))}


#: Odd multipliers of the rolling hash, one for each character from the last to the first.
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(_LONG + 2)], np.uint64)


@functools.lru_cache(maxsize=2)
def _hashed(path: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the pieces' hashes, sorted, and their numbers."""
    grouped: dict[int, list[tuple[int, int]]] = {}
    for piece, number in pieces(path).items():
        value = sum(ord(c) * int(_POWERS[k]) for k, c in enumerate(reversed(piece))) % (1 << 64)
        grouped.setdefault(len(piece), []).append((value, number))
    return {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([k for _, k in sorted(x)], np.int64)) for n, x in grouped.items() if n < _LONG}


class Model:
    """Languages, and for each piece its probability in each; the last row is for characters outside."""

    def __init__(self, path: str, langs: list[str], table: np.ndarray):
        self.path, self.langs, self.table = path, langs, table

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language, summed over all segmentations.

        All words go through the forward algorithm at once, one character
        further at each step.  Which pieces end where is found for a piece
        length at a time: substrings are 64-bit rolling hashes, looked up among
        the sorted hashes of the pieces of that length.
        """
        index = pieces(self.path)
        out = np.zeros((len(words), len(self.langs)))
        short = [k for k, w in enumerate(words) if len(w) < _LONG]
        for k, w in enumerate(words):
            if len(w) >= _LONG:
                out[k] = self._long(_START + w, index)
        short.sort(key=lambda k: -len(words[k]))
        step = max(500, 160_000 // max(8, len(self.langs)))  # so that the forward sums take the same room for any number of languages
        for start in range(0, len(short), step):
            rows = short[start : start + step]
            out[rows] = self._forward([_START + words[k] for k in rows], index)
        return out

    def _forward(self, texts: list[str], index: dict[str, int]) -> np.ndarray:
        """For texts in order of falling length."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        by_length = _hashed(self.path)
        size = np.array([len(t) for t in texts])
        most = int(size[0])
        chars = np.zeros((most, len(texts)), np.uint64)  # one row per position
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        chars[at, np.repeat(np.arange(len(texts)), size)] = flat
        alive = [int((size >= j).sum()) for j in range(most + 1)]
        scaled = self.table * _SCALE ** self._lengths(index)[:, None]
        alpha = np.zeros((most + 1, len(texts), len(self.langs)))
        alpha[0] = 1.0
        rolling = np.zeros((most, len(texts)), np.uint64)  # hash of the length characters that end at a position
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(most + 1)]
        for length in range(1, most + 1):
            rolling[length - 1 :] = rolling[length - 1 :] + chars[: most - length + 1] * _POWERS[length - 1]
            known = by_length.get(length)
            if known is None and length > 1:
                continue
            for j in range(length, most + 1):
                here = rolling[j - 1, : alive[j]]
                if known is None:
                    hit = np.zeros(len(here), bool)
                    number = np.zeros(len(here), np.int64)
                else:
                    hashes, numbers = known
                    spot = np.minimum(np.searchsorted(hashes, here), len(hashes) - 1)
                    hit = hashes[spot] == here
                    number = numbers[spot]
                if length == 1:
                    number = np.where(hit, number, len(index))
                    ends[j].append((1, np.arange(len(here)), number))
                else:
                    where = np.flatnonzero(hit)
                    if len(where):
                        ends[j].append((length, where, number[where]))
            if length >= max(by_length, default=1):
                break
        for j in range(1, most + 1):
            for length, where, number in ends[j]:
                alpha[j, where] += alpha[j - length, where] * scaled[number]
        return np.log(np.maximum(alpha[size, np.arange(len(texts))], 1e-300)) - size[:, None] * np.log(_SCALE)

    def _lengths(self, index: dict[str, int]) -> np.ndarray:
        return np.array([*map(len, index), 1], float)

    def _long(self, text: str, index: dict[str, int]) -> np.ndarray:
        """The same for a long word: the window of the forward sums is rescaled at each step."""
        longest = max(map(len, index), default=1)
        window, log = [np.ones(len(self.langs))], np.zeros(len(self.langs))
        for j in range(1, len(text) + 1):
            total = np.zeros(len(self.langs))
            for back in range(1, min(longest, j, len(window)) + 1):
                k = index.get(text[j - back : j])
                if k is not None:
                    total += window[-back] * self.table[k]
                elif back == 1:
                    total += window[-1] * self.table[-1]
            window.append(total)
            del window[: -longest - 1]
            top = np.max(window, axis=0)
            window = [x / top for x in window]
            log += np.log(top)
        return log + np.log(window[-1])


def fit(path: str, counts: dict[str, Counter], rounds: int = 2) -> Model:
    """Piece probabilities from word counts of each language, by expectation-maximisation."""
    index = pieces(path)
    langs = sorted(counts)
    if not langs:
        return Model(path, [], np.zeros((len(index) + 1, 0)))
    longest = max(map(len, index), default=1)
    table = np.zeros((len(index) + 1, len(langs)))
    for at, lang in enumerate(langs):
        # Start: every piece that occurs, longer ones as likely as shorter ones.
        spans = []
        start = np.full(len(index), 1e-3)
        for word, n in counts[lang].items():
            text = _START + word
            found = [(i, j, k) for i in range(len(text)) for j in range(i + 1, min(len(text), i + longest) + 1) if (k := index.get(text[i:j])) is not None or j == i + 1]
            spans.append((len(text), n, found))
            for _, _, k in found:
                if k is not None:
                    start[k] += n
        p = start / start.sum()
        for _ in range(rounds):
            expected = np.zeros(len(index))
            for size, n, found in spans:
                forward, backward = [1.0] + [0.0] * size, [0.0] * size + [1.0]
                weights = [_UNKNOWN if k is None else p[k] for _, _, k in found]
                for (i, j, _), w in zip(found, weights):  # by start: forward[i] is complete
                    forward[j] += forward[i] * w
                for (i, j, _), w in zip(reversed(found), reversed(weights)):
                    backward[i] += backward[j] * w
                if forward[size] > 0:
                    for (i, j, k), w in zip(found, weights):
                        if k is not None:
                            expected[k] += n * forward[i] * w * backward[j] / forward[size]
            p = (expected + 1e-12) / (expected.sum() + 1e-12 * len(index))
        table[:-1, at] = p
    shared = table[:-1].mean(axis=1, keepdims=True)
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    mix = np.array([[min(0.5, 200.0 / (200.0 + total[lang]))] for lang in langs]).T
    table[:-1] = (1 - mix) * table[:-1] + mix * shared + 1e-8
    table[:-1] /= table[:-1].sum(axis=0)
    table[-1] = _UNKNOWN
    return Model(path, langs, table)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def train(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on about ``sample_rows`` labelled rows a language, none of them held out."""
    rows = df.where(F.col(lang_col).isNotNull() & (crc32_of_id(id_col) % 4 != 2))
    sample = bounded_sample(rows.select(id_col, lang_col, text_col), lang_col, id_col, sample_rows).where(F.length(text_col) <= SAMPLE_CHARS)
    counts: dict[str, Counter] = {}
    for r in sample.select(lang_col, text_col).toLocalIterator():
        counts.setdefault(r[0], Counter()).update(words_of(r[1]))
    return fit(path, {k: c for k, c in counts.items() if c})


class Scorer:
    """A model with a bounded cache of words."""

    def __init__(self, model: Model, cache: int = 600_000):
        self.model, self.cache = model, cache * 8 // max(8, len(model.langs))
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))

    def learn(self, texts: list[list[str]]) -> None:
        """Scores the words not seen yet, of some texts at once."""
        if len(self.rows) > self.cache:
            self.clear()
        new = list({w for t in texts for w in t} - self.rows.keys())
        if not new:
            return
        start = len(self.rows)
        while len(self.table) < start + len(new):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[start : start + len(new)] = self.model.words(new)
        self.rows.update(zip(new, range(start, start + len(new))))

    def predict(self, words: list[str]) -> tuple[str, float]:
        if not self.model.langs or not words:
            return UND, 0.0
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        log = self.table[at].sum(axis=0)
        odds = np.exp(log - log.max())
        return self.model.langs[int(np.argmax(log))], float(1 / odds.sum())


def identify(df: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """df with the predicted language of every whole text and its posterior probability; no shuffle."""
    small_batches(df.sparkSession)
    schema = with_columns(df.schema, (pred_col, T.StringType()), (score_col, T.DoubleType()))
    kept = [f.name for f in schema.fields[:-2]]
    src = df.select(*kept, df[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found: list[tuple[str, float]] = []
            for some in portions(texts):
                words = [words_of(t or "") for t in some]
                scorer.learn(words)
                found += [scorer.predict(w) for w in words]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, pred_col, score_col])

    return src.mapInArrow(run, schema)
