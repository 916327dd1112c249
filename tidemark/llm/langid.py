"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary supplies the pieces. Each language has piece probabilities, fitted by
expectation maximisation over all segmentations of its words; a word's probability is the sum
over all its segmentations, by the forward algorithm. A text's score for a language is the product over
its words, and the reported score is the posterior of the best language.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialize

MARK = "▁"  # begins a word, in the vocabulary's pieces
WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word up to which its probabilities cannot underflow; longer words are summed as logarithms.
SHORT = 40
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-6
#: Letters of words whose probabilities a worker keeps, and letters that are segmented at once.
CACHE_LETTERS, CELLS = 10_000_000, 1 << 19

# Bound of the fit: expected labelled documents of each language. All their words are used.
FIT_DOCUMENTS = 1000
FIT_ROUNDS = 4
#: Languages of a model; more raise, as each has a probability of every piece on the driver and in every task.
MAX_LANGUAGES = 1000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a SentencePiece vocabulary, lower-cased, each once."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if WORD.fullmatch(p.removeprefix(MARK) or "a"))


def _hash_strings(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of equally long strings, given as a matrix of code points."""
    out = np.zeros(len(words), dtype=np.uint64)
    for j in range(words.shape[1]):
        out = out * _BASE + words[:, j].astype(np.uint64)
    return out


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


@dataclass
class Pieces:
    """Sorted hashes of the pieces; a piece's number is its place, the last number is unknown."""

    hashes: np.ndarray
    sizes: list[int]

    @classmethod
    def of(cls, vocab: list[str]) -> Pieces:
        by_size: dict[int, list[str]] = {1: []}
        for p in vocab:
            by_size.setdefault(len(p), []).append(p)
        found = [_hash_strings(_codes(group)) * np.uint64(64) + np.uint64(size) for size, group in by_size.items() if group]
        return cls(np.unique(np.concatenate(found)), sorted(by_size))

    def spans(self, codes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For equally long words and each piece size: numbers of the pieces by start, -1 for none, and the starts of any."""
        n = codes.shape[1]
        wide, rolling, out = codes.astype(np.uint64), None, []
        for size in range(1, min(n, self.sizes[-1]) + 1):
            rolling = wide.copy() if rolling is None else rolling[:, :-1] * _BASE + wide[:, size - 1 :]
            if size not in self.sizes:
                continue
            keys = rolling * np.uint64(64) + np.uint64(size)
            at = np.searchsorted(self.hashes, keys)
            np.minimum(at, len(self.hashes) - 1, out=at)
            at[self.hashes[at] != keys] = -1
            out.append((size, at, (at >= 0).any(axis=0) | (size == 1)))
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and code points of the marked words of each length."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(size).tolist():
        own, step = np.flatnonzero(size == n), max(1, CELLS // n)
        for a in range(0, len(own), step):
            part = own[a : a + step]
            yield part, _codes([words[i] for i in part])


def _weights(table: np.ndarray, number: np.ndarray, size: int, logs: bool) -> np.ndarray:
    """Probabilities, or their logarithms, of numbered pieces per language; unknown single letters get a floor."""
    out = table[number]  # the last row, number -1, is zero
    if size == 1:
        out = np.where((number < 0)[:, None], UNKNOWN, out)
    if logs:
        with np.errstate(divide="ignore"):
            return np.log(out)
    return out


def _step(j: int, spans, table: np.ndarray, before, logs: bool) -> np.ndarray:
    """Sum over the pieces that end at j of what is before them; ``before(size)`` gives that."""
    total = None
    for size, at, any_ in spans:
        if size <= j and any_[j - size]:
            w = _weights(table, at[:, j - size], size, logs)
            part = before(size) + w if logs else before(size) * w
            total = part if total is None else np.logaddexp(total, part) if logs else total + part
    return total


def forward(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of each marked word, of any length, in each language, summed over all segmentations."""
    out = np.empty((len(words), table.shape[1]))
    for own, codes in _by_length(words):
        n, spans = codes.shape[1], pieces.spans(codes)
        logs = n > SHORT
        alpha = deque([np.full((len(own), table.shape[1]), 0.0 if logs else 1.0)], maxlen=pieces.sizes[-1])
        for j in range(1, n + 1):
            alpha.append(_step(j, spans, table, lambda size: alpha[-size], logs))
        out[own] = alpha[-1] if logs else np.log(alpha[-1])
    return out


def expected_pieces(words: list[str], counts: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words of one language, over all their segmentations."""
    expected = np.zeros(len(table))
    for own, codes in _by_length(words):
        n, spans = codes.shape[1], pieces.spans(codes)
        logs = n > SHORT
        one, none = (0.0, -np.inf) if logs else (1.0, 0.0)
        alpha = [np.full((len(own), 1), one)]
        for j in range(1, n + 1):
            alpha.append(_step(j, spans, table, lambda size: alpha[-size], logs))
        beta = [np.full((len(own), 1), none) for _ in range(n)] + [np.full((len(own), 1), one)]
        for j in range(n, 0, -1):
            for size, at, any_ in spans:
                if size <= j and any_[j - size]:
                    number = at[:, j - size]
                    w = _weights(table, number, size, logs)
                    if logs:
                        mass = np.exp(alpha[j - size] + w + beta[j] - alpha[n])
                        beta[j - size] = np.logaddexp(beta[j - size], w + beta[j])
                    else:
                        mass = alpha[j - size] * w * beta[j] / alpha[n]
                        beta[j - size] += w * beta[j]
                    expected += np.bincount(number % len(table), mass[:, 0] * counts[own], len(table))
    return expected


@dataclass
class LanguageModel:
    """Languages in order, log priors, pieces and their probabilities (pieces x languages)."""

    langs: list[str]
    priors: np.ndarray
    pieces: Pieces
    table: np.ndarray

    def __post_init__(self):
        self._clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    def _clear(self) -> None:
        self._letters, self._code = 0, {}
        self._logs = np.zeros((1 << 12, len(self.langs)))

    def _learn(self, words: list[str]) -> None:
        logs = forward([MARK + w for w in words], self.pieces, self.table)
        self._letters += sum(map(len, words))
        base = len(self._code)
        while base + len(words) > len(self._logs):
            self._logs = np.concatenate([self._logs, np.zeros_like(self._logs)])
        self._logs[base : base + len(words)] = logs
        self._code.update(zip(words, range(base, base + len(words))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language (``und`` without a letter or without languages) and its posterior."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        if self._letters > CACHE_LETTERS:
            self._clear()
        missing = {w for own in words for w in own if w not in self._code}
        if missing:
            self._learn(sorted(missing))
        for i, own in enumerate(words):
            if own:
                codes = np.fromiter(map(self._code.__getitem__, own), dtype=np.int64, count=len(own))
                logs = self._logs[codes].sum(axis=0) + self.priors
                best = int(np.argmax(logs))
                langs[i], scores[i] = self.langs[best], 1.0 / np.exp(logs - logs[best]).sum()
        return langs, scores


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    found: dict[str, Counter] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
    rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
    columns = zip(*rows) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def fit_language_model(
    rows: DataFrame, vocab_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", documents: int = FIT_DOCUMENTS
) -> LanguageModel:
    """Fit on ``rows``: per language the documents whose id hash lies in the lowest share that holds ``documents``
    of them on average (all, if there are no more), with all their words. Expectation maximisation starts from equal
    probabilities; the tasks share the words of all languages, and only piece sums come to the driver. Rows
    without a language or text are left out; no rows give a model without languages."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    shares = materialize(rows.groupBy("lang").agg((F.lit(float(documents)) / F.count(F.lit(1))).alias("share")), "shares")
    langs = [r.lang for r in shares.select("lang").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"the rows have more than {MAX_LANGUAGES} languages")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / float(1 << 52)
    sample = rows.withColumn("place", place).join(F.broadcast(shares), "lang").where("place < share").select("lang", "text")
    counts = map_arrow(sample, _counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    tasks = max(8, 2 * rows.sparkSession.sparkContext.defaultParallelism)  # the rows are few but long work
    counts = materialize(counts.repartition(tasks, "lang", "word"), "words")
    pieces = Pieces.of(vocabulary(vocab_path))
    v = len(pieces.hashes)
    table = np.vstack([np.full((v, len(langs)), 1.0 / v), np.zeros((1, len(langs)))])
    for _ in range(FIT_ROUNDS if langs else 0):

        def expect(batch: pa.RecordBatch, table: np.ndarray = table) -> pa.RecordBatch:
            out = []
            own, words, n = (c.to_pylist() for c in batch.columns)
            for k, lang in enumerate(langs):
                at = [i for i, x in enumerate(own) if x == lang]
                if at:
                    mass = expected_pieces([MARK + words[i] for i in at], np.array([n[i] for i in at], dtype=float), pieces, table[:, k : k + 1])[:-1]
                    hit = np.flatnonzero(mass)
                    out.append(pa.record_batch([pa.array(np.full(len(hit), k)), pa.array(hit), pa.array(mass[hit])], names=["k", "piece", "mass"]))
            kind = pa.schema([("k", pa.int64()), ("piece", pa.int64()), ("mass", pa.float64())])
            return pa.Table.from_batches(out, kind)

        sums = map_arrow(counts, expect, "k long, piece long, mass double").groupBy("k", "piece").agg(F.sum("mass").alias("mass")).toPandas()
        expected = np.full((v + 1, len(langs)), 0.01)  # smooths pieces that a language lacks
        np.add.at(expected, (sums["piece"].to_numpy(), sums["k"].to_numpy()), sums["mass"].to_numpy())
        expected[-1] = 0.0
        table = expected / expected.sum(axis=0)
    return LanguageModel(langs, np.full(len(langs), -np.log(max(1, len(langs)))), pieces, table)


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves the remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


_MODELS: dict[int, LanguageModel] = {}


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per input row, from the whole text alone.

    Texts that are null or have no letter give ``und`` and score 0. Letters are those of Unicode;
    case is ignored. Equal scores go to the language that sorts first. Rows with null or repeated ids
    are scored like any other; an empty table gives an empty result; other columns are ignored.
    """
    import uuid

    name = uuid.uuid4().int

    def run(batch: pa.RecordBatch) -> pa.Table:
        if name not in _MODELS:  # one model a worker: its words stay known between batches and tasks
            _MODELS.clear()
            _MODELS[name] = model
        langs, scores = [], []
        for a in range(0, batch.num_rows, 1000):
            found = _MODELS[name].predict(batch.column(1).slice(a, 1000).to_pylist())
            langs += found[0]
            scores.append(found[1])
        return pa.table({"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.concatenate([*scores, np.zeros(0)]))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, lang_pred string, score double")


def identify_held_out(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Fit on the documents whose crc32(doc_id) mod 4 is not 2, and score all of them."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit_language_model(docs.where(fold != 2), vocab_path)
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
