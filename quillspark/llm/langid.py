"""Language identification by unigram pieces, summed over all segmentations of each word.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, by the forward algorithm; a text's
is the product over its words. Probabilities are fitted by expectation-maximisation on the
words of a bounded sample of labelled documents. Words are lower-cased runs of letters with a
word-start mark before them, so words are scored once per task however often they occur.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many labelled documents of each language are used for the fit.
SAMPLE_PER_LANGUAGE = 1500
EM_ROUNDS = 4
SMOOTHING = 0.05
#: Probability of a letter that the vocabulary doesn't have, in every language.
UNKNOWN = 1e-7
#: Mean log probability of a letter or word start in the best language below which none is identified.
#: Clean and even spoilt texts of sf0.1 have -3.1 or more, letters that no fitted language uses about -16.
LEAST = -9.0
#: Letters of a word that are scored together; the rest of a longer run is a word of its own.
LONGEST = 48
#: Words that a task remembers.
CACHE_WORDS = 600_000
_WORD = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if not all(map(str.isalpha, found)):  # numerals that are no digits, such as superscripts
        found = [w for w in ("".join(filter(str.isalpha, x)) for x in found) if w]
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


class Vocabulary:
    """Piece numbers of all substrings of many words at once."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.slots = 1 << 20
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.ids = np.full(self.slots, -1, dtype=np.int32)
        self.probes = 1
        for n, p in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    h = (h + np.uint64(ord(c) + 1)) * _MULT
                    h ^= h >> np.uint64(29)
            at, probe = int(h >> np.uint64(44)), 1
            while self.keys[at]:
                at, probe = (at + 1) % self.slots, probe + 1
            self.keys[at], self.ids[at], self.probes = h, n, max(self.probes, probe)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(44)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.ids[at], -1)
        go = np.flatnonzero((key != h) & (key != 0))
        for _ in range(self.probes - 1):
            if not len(go):
                break
            at[go] = (at[go] + 1) % self.slots
            key = self.keys[at[go]]
            hit = key == h[go]
            out[go[hit]] = self.ids[at[go[hit]]]
            go = go[~hit & (key != 0)]
        return out

    def spans(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in words of one length, given as code points."""
        n, length = words.shape
        for i in range(length):
            h = np.zeros(n, dtype=np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = (h + words[:, j] + np.uint64(1)) * _MULT
                h ^= h >> np.uint64(29)
                ids = self.find(h)
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    yield i, j + 1, rows, ids[rows]
                if j == i:
                    rows = np.flatnonzero(ids < 0)
                    if len(rows):
                        yield i, j + 1, rows, np.full(len(rows), -1, dtype=np.int32)


def public_pieces(model_file: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary that can occur in lower-cased words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return [p for p in found if p == p.lower() and (p.lstrip("▁").isalpha() or p == "▁") and p.count("▁") <= 1]


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # pieces + 1 by languages; the last row is for unknown letters


def _grouped(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of the words of each length, in blocks."""
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lens, kind="stable")
    cuts = np.flatnonzero(np.diff(lens[order])) + 1
    for place in np.split(order, cuts):
        for at in range(0, len(place), 20_000):
            own = place[at : at + 20_000]
            length = int(lens[own[0]]) + 1
            codes = np.array(["▁" + words[k] for k in own], dtype=f"U{length}").view(np.uint32).reshape(len(own), length)
            yield own, codes.astype(np.uint64)


def log_likelihood(words: list[str], vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations."""
    out = np.empty((len(words), prob.shape[1]))
    for place, codes in _grouped(words):
        n, length = codes.shape
        alpha = np.zeros((length + 1, n, prob.shape[1]))
        alpha[0] = 1.0
        for i, j, rows, ids in vocabulary.spans(codes):
            alpha[j, rows] += alpha[i, rows] * prob[ids]
        out[place] = np.log(np.maximum(alpha[length], 1e-300))
    return out


def _expected(words: list[str], counts: np.ndarray, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece: forward, backward, posterior."""
    out = np.zeros(len(prob))
    for place, codes in _grouped(words):
        n, length = codes.shape
        spans = list(vocabulary.spans(codes))
        alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        alpha[0] = beta[length] = 1.0
        for i, j, rows, ids in spans:
            alpha[j, rows] += alpha[i, rows] * prob[ids]
        for i, j, rows, ids in reversed(spans):
            beta[i, rows] += beta[j, rows] * prob[ids]
        scale = counts[place] / np.maximum(alpha[length], 1e-300)
        for i, j, rows, ids in spans:
            out += np.bincount(ids % len(prob), weights=alpha[i, rows] * beta[j, rows] * prob[ids] * scale[rows], minlength=len(prob))
    return out


def fit(counts: dict[str, dict[str, int]], pieces: list[str]) -> Model:
    """Piece probabilities of each language from its word counts."""
    vocabulary = Vocabulary(pieces)
    languages = sorted(counts)
    prob = np.empty((len(pieces) + 1, len(languages)))
    for k, lang in enumerate(languages):
        words = sorted(counts[lang])
        n = np.array([counts[lang][w] for w in words], dtype=float)
        own = np.full(len(pieces) + 1, 1.0 / len(pieces))
        own[-1] = UNKNOWN
        for _ in range(EM_ROUNDS):
            uses = _expected(words, n, vocabulary, own)[:-1] + SMOOTHING
            own[:-1] = uses / uses.sum()
        prob[:, k] = own
    return Model(languages, pieces, prob)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen.setdefault(lang, Counter()).update(words_of(text.as_py() or ""))
    rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
    for at in range(0, len(rows), 50_000):
        lang, word, n = zip(*rows[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def held_out(id_col: str) -> F.Column:
    """Whether a document is kept from the fit: crc32 of its key as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(
    docs: DataFrame, pieces: list[str], *, id_col: str = "doc_id", text_col: str = "text", per_language: int = SAMPLE_PER_LANGUAGE
) -> Model:
    """Fit on about ``per_language`` documents of each language, chosen by a hash of the key.

    Labels are the non-null ``lang`` of documents that aren't held out. The sample is bounded,
    whatever the corpus, so its word counts fit the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    parts = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(per_language / r["n"]))])
    dice = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = known.filter(dice < parts[F.col("lang")]).select("lang", text_col)
    counted = chosen.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {r["lang"]: {} for r in sizes}
    table = counted.toArrow()
    for lang, word, n in zip(*(table[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    return fit({k: v for k, v in counts.items() if v}, pieces)


class _Scorer(dict):
    """Numbers of words, and their scores in one array; both grow as words are met."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.vocabulary = model, Vocabulary(model.pieces)
        self.fresh: list[str] = []
        self.scores = np.empty((1 << 16, len(model.languages)), dtype=np.float64)
        self.lengths = np.empty(1 << 16, dtype=np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def _numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > CACHE_WORDS:
            self.clear()
        of = self.__getitem__
        ids = [np.fromiter(map(of, words_of(t)), dtype=np.int64) if t else np.empty(0, dtype=np.int64) for t in texts]
        if self.fresh:
            first = len(self) - len(self.fresh)
            if len(self) > len(self.scores):
                self.scores = np.concatenate([self.scores[:first], np.empty((2 * len(self) - first, self.scores.shape[1]))])
                self.lengths = np.concatenate([self.lengths[:first], np.empty(2 * len(self) - first, dtype=np.int64)])
            self.scores[first : len(self)] = log_likelihood(self.fresh, self.vocabulary, self.model.prob)
            self.lengths[first : len(self)] = [len(w) + 1 for w in self.fresh]
            self.fresh = []
        return ids

    def text_scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        return [self.scores[i].sum(axis=0) if len(i) else None for i in self._numbers(texts)]

    def identified(self, texts: list[str | None], least: float) -> list[tuple[bool, str | None]]:
        """Whether a text has letters, and its best language explains them, and that language; with no languages, letters are enough."""
        out: list[tuple[bool, str | None]] = []
        for i in self._numbers(texts):
            if not len(i) or not self.model.languages:
                out.append((len(i) > 0, None))
                continue
            sums = self.scores[i].sum(axis=0)
            best = int(np.argmax(sums))
            out.append((bool(sums[best] >= least * self.lengths[i].sum()), self.model.languages[best]))
        return out


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pred, score = [], []
            for s in scorer.text_scores(part.column(2).to_pylist()):
                if s is None or not len(s):
                    pred.append("und")
                    score.append(0.0)
                    continue
                best = int(np.argmax(s))
                pred.append(model.languages[best])
                score.append(float(1.0 / np.exp(np.minimum(s - s[best], 0.0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; no shuffle.

    ``score`` is the posterior of the language under equal priors. ``und`` with score 0 stands
    for a null text, a text without a letter, and a model without languages. Ties go to the
    first language by name. Long texts are scored whole; repeated rows each get a row.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(
        lambda it: _predict(it, model), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """The documents whose language is identified; a null ``lang_col`` becomes the predicted language, a given one stays.

    Rejected are null texts, texts without a letter, and texts whose letters have a mean log
    probability below ``least`` in every language, as those of a script that no fitted language
    has. Close languages do not spoil a text. A model without languages rejects no text with letters, and fills no null.
    A table without ``lang_col`` stays without it.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                found = scorer.identified(texts, least)
                at = part.schema.get_field_index(lang_col)
                if at >= 0 and part.column(at).null_count:
                    field = part.schema.field(at)
                    langs = [best if given is None else given for given, (_, best) in zip(part.column(at).to_pylist(), found, strict=True)]
                    part = part.set_column(at, field, pa.array(langs, field.type))
                yield part.filter(pa.array([kept for kept, _ in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
