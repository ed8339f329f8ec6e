"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, which
a forward pass finds; a text's is the product over its words. Probabilities
are fitted by expectation maximisation: forward and backward passes give each
piece's expected count over the segmentations of the training words.

Words are maximal runs of letters, lower-cased; pieces are all pieces of the
vocabulary that are letters, lower-cased. A letter that no piece covers
counts as an unknown piece of one letter. All distinct words of a batch go
through the passes at once, position by position. Values are rescaled by a
power of two at each position, whose exponents are carried, so that words of
any length keep their probabilities.

Training reads text and language of labelled rows only. It is bounded: about
TRAIN_DOCS rows of each language, chosen by a hash of the text, and of those
the words. Predictions read whole texts of all rows, and nothing but texts.

Defined results: null texts and texts without a letter get `und` and 0; so
does every text if no language was learned; ties go to the language that
sorts first; repeated rows get equal answers; other columns pass through
unless they clash with `lang_pred` or `score`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.kernels import blocks
from orrery.llm.session import prepare

#: Bound of the training sample, rows of each language.
TRAIN_DOCS = 1000
ROUNDS = 4
#: Probability of an unknown letter, and what each piece's count starts from.
UNKNOWN, PRIOR = 1e-6, 0.05
UNDETERMINED = "und"
CHUNK = 1 << 21
_LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[str]:
    """Distinct lower-cased pieces of letters in a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if _LETTERS.fullmatch(p))


def distinct_words(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """(distinct words, and for each text the numbers of its words)."""
    code: dict[str, int] = {}
    each = [np.array([code.setdefault(w, len(code)) for w in _LETTERS.findall(t.lower())] if t else [], np.int64) for t in texts]
    return list(code), each


class Lattice:
    """Pieces at every place of a list of words, as arrays by length."""

    def __init__(self, words: list[str], number: dict[str, int]):
        size = np.array([len(w) for w in words], np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        self.words = [words[i] for i in self.order]
        top = int(self.size[-1]) if len(words) else 0
        # piece[t][k]: for words of t letters or more, the piece that ends there
        # and has k letters; -1: none. Words are sorted, so these are a suffix.
        self.first = [int(np.searchsorted(self.size, t)) for t in range(top + 1)]
        self.top, self.piece = top, [{}]
        get = number.get
        self.longest = max(map(len, number), default=1)
        for t in range(1, top + 1):
            suffix = self.words[self.first[t] :]
            found = {1: np.fromiter((get(w[t - 1 : t], -1) for w in suffix), np.int32, len(suffix))}
            for k in range(2, min(t, self.longest) + 1):
                at = np.fromiter((get(w[t - k : t], -1) for w in suffix), np.int32, len(suffix))
                if at.max() >= 0:
                    found[k] = at
            # by length: those of which some word has a piece here, and one letter
            self.piece.append(found)

    def chances(self, prob: np.ndarray, t: int, k: int) -> np.ndarray:
        """Probabilities (word, language) of the pieces of k letters ending at t."""
        at = self.piece[t][k]
        return np.where((at >= 0)[:, None], prob[at], UNKNOWN if k == 1 else 0.0)

    def forward(self, prob: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """alpha[t][word - first[t], language] and exponents e[t]: the sum over
        segmentations of the first t letters is alpha[t] * 2**e[t]."""
        shape = (len(self.words), prob.shape[1])
        alpha, power = [np.ones(shape)], [np.zeros(shape, np.int32)]
        for t in range(1, self.top + 1):
            lengths = [*self.piece[t]]
            shifts = [self.first[t] - self.first[t - k] for k in lengths]
            base = power[t - 1][shifts[0] :]
            total = 0.0
            for k, shift in zip(lengths, shifts, strict=True):
                before = alpha[t - k][shift:] * self.chances(prob, t, k)
                total = total + (before if k == 1 else np.ldexp(before, power[t - k][shift:] - base))
            total, up = np.frexp(total)
            alpha.append(total)
            power.append(base + up)
        return alpha, power

    def _whole(self, each: list[np.ndarray]) -> np.ndarray:
        """The value of each word (in the lattice's order) at its last letter."""
        edges = [*self.first, len(self.words)]
        return np.concatenate([each[t][: edges[t + 1] - edges[t]] for t in range(self.top + 1)])

    def log_likelihood(self, prob: np.ndarray) -> np.ndarray:
        """(word, language), in the order the words came."""
        alpha, power = self.forward(prob)
        out = np.empty((len(self.words), prob.shape[1]))
        out[self.order] = np.log(self._whole(alpha)) + self._whole(power) * math.log(2)
        return out

    def expected(self, prob: np.ndarray, weight: np.ndarray, pieces: int) -> np.ndarray:
        """Expected counts of pieces in one language (a column), words weighted."""
        alpha, power = self.forward(prob)
        n = len(self.words)
        whole, last = self._whole(alpha)[:, 0], self._whole(power)[:, 0]
        scale = weight[self.order] / whole
        # beta[t] * 2**back[t]: sum over segmentations of the letters after t
        edges = [*self.first, n]
        beta: list[np.ndarray] = [np.zeros(0)] * (self.top + 1)
        back: list[np.ndarray] = [np.zeros(0, np.int32)] * (self.top + 1)
        counts = np.zeros(pieces + 1)
        for t in range(self.top, -1, -1):
            ends = edges[t + 1] - edges[t]
            own, exponent = np.zeros(n - self.first[t]), np.zeros(n - self.first[t], np.int32)
            own[:ends] = 1.0  # words of t letters end here
            if t < self.top:
                exponent[ends:] = back[t + 1]
            for k in range(1, min(self.top - t, self.longest) + 1):
                if k not in self.piece[t + k]:
                    continue
                shift = self.first[t + k] - self.first[t]
                step = self.chances(prob, t + k, k)[:, 0] * beta[t + k]
                own[shift:] += step if k == 1 else np.ldexp(step, back[t + k] - exponent[shift:])
                at = self.piece[t + k][k]
                mass = np.ldexp(alpha[t][shift:, 0] * step * scale[self.first[t + k] :], power[t][shift:, 0] + back[t + k] - last[self.first[t + k] :])
                counts += np.bincount(np.where(at >= 0, at, pieces), mass, pieces + 1)
            beta[t], up = np.frexp(own)
            back[t] = exponent + up
        return counts[:pieces]


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities (piece, language)) from word counts."""
    number = {p: i for i, p in enumerate(pieces)}
    languages = sorted(counts)
    prob = np.empty((len(pieces), len(languages)))
    for j, lang in enumerate(languages):
        words = sorted(counts[lang])
        lattice, weight = Lattice(words, number), np.array([counts[lang][w] for w in words], float)
        own = np.full((len(pieces), 1), 1 / len(pieces))
        for _ in range(rounds):
            got = lattice.expected(own, weight, len(pieces)) + PRIOR
            own = (got / got.sum())[:, None]
        prob[:, j] = own[:, 0]
    return languages, prob


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    total: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total.update((lang, w) for w in _LETTERS.findall(text.lower()))
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, vocab: list[str], most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Fit on about `most` rows of each language of docs (text, lang)."""
    prepare(docs.sparkSession)
    labelled = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    have = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not have:
        return [], np.zeros((len(vocab), 0))
    share = F.create_map(*[x for k, n in have.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))])
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where(unit < share[F.col("lang")]).mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in rows:
        counts.setdefault(lang, {})[word] = n
    return fit(counts, vocab) if counts else ([], np.zeros((len(vocab), 0)))


class Scorer:
    """Log-likelihoods of words, remembered up to a bound."""

    def __init__(self, pieces: list[str], prob: np.ndarray, most: int = 400_000):
        self.number, self.prob, self.most = {p: i for i, p in enumerate(pieces)}, prob, most
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, prob.shape[1]))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods (text, language), numbers of words)."""
        words, each = distinct_words(texts)
        if len(self.known) > self.most:
            self.known, self.rows = {}, self.rows[:0]
        fresh = [w for w in words if w not in self.known]
        if fresh:
            base = len(self.known)
            self.known.update((w, base + i) for i, w in enumerate(fresh))
            self.rows = np.concatenate((self.rows, Lattice(fresh, self.number).log_likelihood(self.prob)))
        place = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        total = np.stack([self.rows[place[w]].sum(0) for w in each]) if each else np.zeros((0, self.prob.shape[1]))
        return total, np.array([len(w) for w in each])


def _predict(batches: Iterator[pa.RecordBatch], pieces: list[str], languages: list[str], prob: np.ndarray) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(pieces, prob)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        names, scores = [], []
        for part in blocks(np.array([len(t or "") for t in texts]), CHUNK):
            total, n = scorer.texts(texts[part])
            for row, k in zip(total, n, strict=True):
                if not k or not languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                best = int(row.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(row - row[best]).sum()))
        rest = [i for i, c in enumerate(batch.schema.names) if c not in ("lang_pred", "score")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(batch.schema.names[i] for i in rest), "lang_pred", "score"])


def predict(docs: DataFrame, pieces: list[str], languages: list[str], prob: np.ndarray) -> DataFrame:
    """docs (text, ...) with lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    kept = [f"`{n}` {t}" for n, t in docs.dtypes if n not in ("lang_pred", "score")]
    model = spark.sparkContext.broadcast((pieces, languages, prob))

    def run(batches):
        return _predict(batches, *model.value)

    return docs.mapInArrow(run, ", ".join([*kept, "lang_pred string", "score double"]))
