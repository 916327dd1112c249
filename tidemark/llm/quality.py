"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Random cosine features approximate a Gaussian kernel over statistics of a document's text. Tasks
sum the normal equations of their rows, the driver adds the sums and solves the ridge system, and an
isotonic fit on rows that the ridge has not seen maps raw scores to probabilities.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialize, utf8
from tidemark.llm.langid import held_out

FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "high", "common_mark", "symbol", "bar", "line_rate",
    "distinct_words", "top_word", "repeated_lines", "long_words", "marked_words", "repeat_next", "entropy", "capitalised", "log_lines",
]
#: Cosine features, kernel width in standard deviations a statistic, ridge penalty, seed.
COSINES, WIDTH, RIDGE, SEED = 256, 1.5, 1e-3, 20240101
#: Labelled rows used, at most (those of smallest id hash), and tasks that sum them.
FIT_ROWS, FIT_TASKS = 200_000, 16

_CLASS = np.zeros((256, 7))
for _i, _set in enumerate((range(65, 91), range(48, 58), [32, *range(9, 14)], range(128, 256), b".,;:'\"-()?", b"#$%&*!@<>{}[]=+/\\^~_", b"|")):
    _CLASS[list(_set), _i] = 1.0


def statistics(text: bytes) -> list[float]:
    """The statistics named in FEATURES, of UTF-8 bytes and white-space words; an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    bins = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = bins @ _CLASS / n
    p = bins[bins > 0] / n
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return [
        np.log1p(n),
        np.log1p(len(words)),
        sum(map(len, words)) / m,
        *share,
        k / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        1 - len(set(lines)) / k,
        sum(map((20).__le__, map(len, words))) / m,
        sum(w[-1] in b"#$%&*!|" for w in words) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        float(-(p * np.log2(p)).sum()),
        sum(65 <= w[0] < 91 for w in words) / m,
        np.log1p(k),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x array<double>)`` per input row; null texts are empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, x array<double>")


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (mean score, mean label) of a non-decreasing fit."""
    blocks: list[list[float]] = []  # weight, mean label, mean score
    for i in np.argsort(score, kind="stable").tolist():
        blocks.append([1.0, float(label[i]), float(score[i])])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
            w, y, s = blocks.pop()
            v = blocks[-1]
            total = v[0] + w
            v[1], v[2], v[0] = (v[1] * v[0] + y * w) / total, (v[2] * v[0] + s * w) / total, total
    return np.array([b[2] for b in blocks]), np.array([b[1] for b in blocks])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, with a constant."""
        draw = np.random.default_rng(SEED)
        directions = draw.standard_normal((len(FEATURES), COSINES)) / (WIDTH * np.sqrt(len(FEATURES)))
        phase = draw.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2.0 / COSINES) * np.cos(z @ directions + phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated score in 0..1; a thousandth of the raw score keeps the order inside flat parts."""
        raw = self.raw(x)
        if not len(self.knots[0]):
            return np.full(len(x), 0.5)
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(len(column), len(FEATURES))


def fit_quality(rows: DataFrame) -> QualityModel:
    """Fit on ``rows`` (doc_id, x, y), y in 0..1. A quarter of them, by id hash, calibrates.

    Without rows the model scores 0.5.
    """
    rows = rows.where("y is not null").withColumn("h", F.xxhash64("doc_id"))
    if rows.count() > FIT_ROWS:
        rows = rows.orderBy("h").limit(FIT_ROWS)
    rows = materialize(rows.withColumn("calibrates", F.pmod("h", F.lit(4)) == 0), "fit-rows")
    d = len(FEATURES)
    moments = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    if moments["m0"] is None:
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(COSINES + 1), (np.zeros(0), np.zeros(0)))
    mean = np.array([moments[f"m{i}"] for i in range(d)])
    scale = np.array([moments[f"s{i}"] for i in range(d)])
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(COSINES + 1), (np.zeros(0), np.zeros(0)))

    def sums(batches):
        size = COSINES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.cosines(_matrix(batch.column(0)))
            y = np.array(batch.column(1).to_pylist(), dtype=float)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    fitted = rows.where("not calibrates").select("x", "y").coalesce(FIT_TASKS).mapInArrow(sums, "part binary")
    total = sum(np.frombuffer(r.part).reshape(COSINES + 1, COSINES + 2) for r in fitted.collect())
    gram = total[:, :-1]
    model.weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.eye(COSINES + 1) * np.append(np.ones(COSINES), 1e-6) + 1e-9 * np.eye(COSINES + 1), total[:, -1])
    check = rows.where("calibrates").select("x", "y")

    def raws(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], names=["s", "y"])

    pairs = map_arrow(check, raws, "s double, y double").collect()  # at most about FIT_ROWS / 4
    model.knots = isotonic(np.array([p.s for p in pairs]), np.array([p.y for p in pairs]))
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score, predicted`` of a table of statistics."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(_matrix(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
        )

    return map_arrow(stats.select("doc_id", "x"), run, "doc_id long, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document, from its whole text alone.

    Labels are learned from documents whose crc32(doc_id) mod 3 is not 1; repeated labels of a
    document are averaged, null ones ignored. Null and empty texts are scored as texts without
    bytes. Rows with a null id are scored and count as not held out; repeated rows are scored each. An
    empty table gives an empty result; other columns are ignored.
    """
    stats = materialize(document_statistics(docs), "statistics")
    known = (
        labels.where("quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    )
    model = fit_quality(stats.join(known, "doc_id"))
    return score_quality(stats, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
