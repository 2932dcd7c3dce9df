"""Quality classifier: ridge regression on random Fourier features of document statistics.

Every text is read whole once and becomes a short vector of statistics. Random Fourier features
approximate a Gaussian kernel over the standardised vectors; each partition sums its part of the
normal equations, so the fit moves one small matrix per partition whatever the number of rows.
Isotonic regression on counts per score cell turns ridge values into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.llm.base import id_remainder, query, table
from studyspark.llm.wordbytes import Spans, chunks, covered, mix, repeated, windows
from studyspark.operators.lineage import cut

FEATURES = 192
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations of a statistic
RIDGE = 1e-3
CLIP = 6.0
CELLS = 1000  # score cells for the calibration
THRESHOLD = 0.3
FOLDS, HELD = 5, 0

STATISTICS = (
    "log_words", "word_length", "word_length_sd", "upper", "digit", "symbol", "bang", "pipe",
    "stop", "comma", "non_ascii", "white", "line_words", "distinct_words", "same_as_last",
    "commonest", "dup_windows", "dup_lines", "symbol_end", "caps_words", "short_words", "quotes",
    "byte_entropy",
)


def _table(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


_CLASSES = {
    "upper": _table(range(0x41, 0x5B)),
    "digit": _table(range(0x30, 0x3A)),
    "symbol": _table("#*$%&|<>=+~^_\\{}[]@/"),
    "bang": _table("!?"),
    "pipe": _table("|"),
    "stop": _table(".:;"),
    "comma": _table(","),
    "non_ascii": _table(range(0x80, 0x100)),
    "white": _table(" \t\n\r\x0b\x0c"),
    "quotes": _table("\"'()"),
}
_SYMBOL_END = _table("#*$%&|<>=+~^_\\{}[]@/!")


def _statistics(chunk) -> np.ndarray:
    n = chunk.n
    out = {}
    size = np.maximum(chunk.end - chunk.begin, 1).astype(float)
    counts = np.zeros((n, 256))
    cells = np.repeat(np.arange(n), chunk.end - chunk.begin) * 256 + chunk.data
    counts = np.bincount(cells, minlength=n * 256).reshape(n, 256).astype(float)
    for name, mask in _CLASSES.items():
        out[name] = counts[:, mask].sum(axis=1) / size
    share = counts / size[:, None]
    out["byte_entropy"] = -np.sum(share * np.log2(np.where(share > 0, share, 1)), axis=1)
    start, end, own = chunk.words()
    by = lambda weight=None: np.bincount(own, weights=weight, minlength=n)
    words = np.maximum(by(), 1)
    length = (end - start).astype(float)
    out["log_words"] = np.log1p(by())
    out["word_length"] = by(length) / words
    out["word_length_sd"] = np.sqrt(np.maximum(by(length**2) / words - out["word_length"] ** 2, 0))
    out["short_words"] = by(length <= 3) / words
    out["symbol_end"] = by(_SYMBOL_END[chunk.data[end - 1]]) / words if len(end) else by()
    letters = np.concatenate([[0], np.cumsum(_CLASSES["upper"][chunk.data])])
    out["caps_words"] = by((letters[end] - letters[start]) * 2 > length) / words
    hashes = Spans(chunk.data).hash(start, end)
    last = np.zeros(len(hashes), bool)
    last[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    out["same_as_last"] = by(last) / words
    key = np.sort(mix(hashes) >> np.uint64(24) | (own.astype(np.uint64) << np.uint64(40)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(first)
    of = (key[heads] >> np.uint64(40)).astype(np.int64)
    runs = np.diff(np.append(heads, len(key)))
    out["distinct_words"] = np.bincount(of, minlength=n) / words
    most = np.zeros(n)
    np.maximum.at(most, of, runs)
    out["commonest"] = most / words
    at, gram = windows(hashes, own, 5)
    out["dup_windows"] = by(covered(at[repeated(gram, own[at])], 5, len(own))) / words
    _, _, line_own = chunk.lines()
    lines = np.maximum(np.bincount(line_own, minlength=n), 1)
    out["line_words"] = np.log1p(words / lines)
    begin, stop, line_own = chunk.lines()
    full = stop > begin
    again = repeated(Spans(chunk.data).hash(begin[full], stop[full]), line_own[full])
    out["dup_lines"] = np.bincount(line_own[full], weights=again, minlength=n) / lines
    return np.column_stack([out[name] for name in STATISTICS])


def _as_lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def document_statistics(text: Column) -> Column:
    """The statistics named in `STATISTICS`, of each whole text; null counts as empty."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        parts = [_statistics(c) for c in chunks(texts)]
        return _as_lists(np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS))))

    return measure(text.cast("string"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class QualityModel:
    """Everything a task needs to score: a few hundred kilobytes whatever the corpus."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(standardised(stats, self.centre, self.scale)) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.levels[0])
        return np.interp(self.raw(stats), self.knots, self.levels)


def standardised(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((stats - centre) / scale, -CLIP, CLIP)


def fourier(x: np.ndarray) -> np.ndarray:
    """A constant and cosines at fixed random frequencies; inner products approximate the kernel."""
    draw = np.random.default_rng(7)
    frequency = draw.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
    phase = draw.uniform(0, 2 * np.pi, FEATURES)
    waves = np.sqrt(2 / FEATURES) * np.cos(x @ frequency + phase)
    return np.column_stack([np.ones(len(x)), waves])


def isotonic(value: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool adjacent violators over values in ascending order: (block centres, levels)."""
    blocks: list[list[float]] = []
    for v, t, w in zip(value, target, weight, strict=True):
        blocks.append([v * w, t * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def fit_quality(train: DataFrame) -> QualityModel:
    """Fit on rows (stats array<double>, label double in 0..1).

    No rows: every score is 0.5. One class only: every score is that class.
    """
    spark_row = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("label").alias("prior"),
        *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(len(STATISTICS))],
        *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(len(STATISTICS))],
    ).first()
    k = len(STATISTICS)
    if not spark_row["n"] or spark_row["prior"] in (0.0, 1.0):
        flat = 0.5 if not spark_row["n"] else spark_row["prior"]
        return QualityModel(np.zeros(k), np.ones(k), None, np.zeros(1), np.array([flat]))
    prior = spark_row["prior"]
    centre = np.array([spark_row[f"m{i}"] for i in range(k)])
    scale = np.array([spark_row[f"s{i}"] for i in range(k)])
    scale[scale < 1e-9] = 1.0
    size = FEATURES + 1

    def partial(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = fourier(standardised(_matrix(batch.column(0)), centre, scale))
            y = np.asarray(batch.column(1), float) - prior
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), _as_lists(total)], ["line", "sums"]
        )

    def add(pdf):
        return pdf.iloc[:1].assign(sums=[np.sum(np.stack(pdf["sums"].to_list()), axis=0)])

    parts = train.select("stats", "label").mapInArrow(partial, "line bigint, sums array<double>")
    lines = parts.groupBy("line").applyInPandas(add, "line bigint, sums array<double>").collect()
    system = np.array([r["sums"] for r in sorted(lines, key=lambda r: r["line"])])
    penalty = RIDGE * spark_row["n"] / FEATURES * np.eye(size)
    penalty[0, 0] = 0
    weights = np.linalg.solve(system[:, :size] + penalty, system[:, size])
    model = QualityModel(centre, scale, weights, np.zeros(1), np.zeros(1))

    @F.arrow_udf("bigint")
    def cell(stats: pa.Array) -> pa.Array:
        return pa.array(np.rint(model.raw(_matrix(stats)) * CELLS).astype(np.int64))

    held = (
        train.select(cell("stats").alias("cell"), "label")
        .groupBy(F.least(F.greatest("cell", F.lit(-CELLS)), F.lit(CELLS)).alias("cell"))
        .agg(F.avg("label").alias("target"), F.count(F.lit(1)).alias("weight"))
        .collect()
    )
    held.sort(key=lambda r: r["cell"])
    knots, levels = isotonic(
        np.array([r["cell"] / CELLS for r in held]),
        np.array([r["target"] for r in held]),
        np.array([float(r["weight"]) for r in held]),
    )
    return QualityModel(centre, scale, weights, knots, np.clip(levels, 0, 1))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, `held_out`, `score` and `predicted`.

    Rows whose crc32 of the id as text leaves 0 modulo 5 are held out: their labels are not read.
    Several labels of one id count as their mean; null labels don't count. Null text is empty text
    and gets a score like any other. Rows with null ids are scored and never learnt from.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (id_remainder(F.col(id_col), FOLDS) == HELD).alias("held_out"),
            document_statistics(F.col(text_col)).alias("stats"),
        )
    )
    known = (
        labels.where(F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.avg(label_col).cast("double").alias("label"))
    )
    train = cut(rows.where(~F.col("held_out")).join(known, "id").select("stats", "label"))
    model = fit_quality(train)

    @F.arrow_udf("double")
    def score(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(stats)))

    return rows.select(
        F.col("id").alias(id_col), "held_out", score("stats").alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query()
def op3_quality_classifier(spark, folder):
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
