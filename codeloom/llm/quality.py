"""Operator 1: a quality classifier.

Statistics of the whole text (never its label, language, source or id) are standardised and mapped by random Fourier
features, which approximate a Gaussian kernel; ridge regression is fitted from normal equations that each partition
sums up, and isotonic regression turns its output into a probability.

For scores, documents are read once: their statistics are written to the shared folder, from which fitting and scoring
read.  The filter computes statistics for labelled documents first and for all in its own pass.  The fit uses at most
``MOST_LABELS`` labelled documents (those whose hashed ids come first), three quarters of them for the ridge, one quarter
for the calibration; everything else covers all rows.

Defined results: an empty or null text is scored from its statistics as any other (all zero); labels that are null, have
a null id or name no document are not used, of repeated labels the larger counts; of an id that stands at several texts
the smallest statistics are fitted, once; without both classes among the labels every score is the share of class 1 (one
half without any); equal texts have equal scores, and each row is scored; a null id is not held out; an empty table gives
no rows; other columns are not read, and kept by the filter.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import by_batch, fresh_path, mapped, renamed, table

MOST_LABELS = 40_000
FEATURES = 384
RIDGE = 1e-3
THRESHOLD = 0.3
SEED = 11
#: Marks of prose; every other ASCII mark is counted as a symbol.
_PROSE = b".,;:'\"()-?!"
#: Pieces of a text whose symbols and repeats are looked at one by one.
_PIECES = 8

STATISTICS = (
    "symbols", "marks of prose", "doubled marks", "upper case", "lower case", "digits", "white space", "line ends", "full stops", "commas", "beyond ASCII", "entropy of bytes", "entropy of marks", "log bytes", "log words", "mean word length", "distinct words", "most frequent word", "equal neighbours", "distinct word pairs",
    "distinct lines", "words that end in a symbol or doubled mark", "upper-case words", "least symbols of a piece", "most symbols of a piece", "most doubled marks of a piece", "most upper case of a piece", "fewest distinct words of a piece", "longest word",
)


def _class(members) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


_MARKS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_IS_MARK, _IS_PROSE, _IS_UPPER = _class(_MARKS), _class(_PROSE), _class(range(65, 91))
_IS_SYMBOL = _IS_MARK & ~_IS_PROSE & 1
_MARK_SET, _SYMBOL_SET = frozenset(_MARKS), frozenset(_MARKS) - frozenset(_PROSE)


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def statistics(raw: bytes) -> list[float]:
    """Of the UTF-8 bytes of a text, one number for each of STATISTICS."""
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    a = np.frombuffer(raw, np.uint8)
    counts = np.bincount(a, minlength=256)
    h = counts / n
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    doubled = np.zeros(n, np.uint8)
    doubled[1:] = (a[1:] == a[:-1]) & _IS_MARK[a[1:]]
    marked = sum(w[-1] in _SYMBOL_SET or len(w) > 1 and w[-1] == w[-2] and w[-1] in _MARK_SET for w in words)
    caps = sum(map(bytes.isupper, words))
    top = Counter(words).most_common(1)[0][1] if words else 0
    size = max(1, -(-n // _PIECES))
    starts = np.arange(0, n, size)
    lens = np.minimum(size, n - starts)
    symbols, twice, upper = (np.add.reduceat(x, starts, dtype=np.int64) / lens for x in (_IS_SYMBOL[a], doubled, _IS_UPPER[a]))
    step = max(1, -(-len(words) // _PIECES))
    fewest = min((len(set(words[i : i + step])) / len(words[i : i + step]) for i in range(0, len(words), step)), default=0.0)
    pairs = max(1, len(words) - 1)
    return [
        float(h[_IS_SYMBOL == 1].sum()), float(h[_IS_PROSE == 1].sum()), float(doubled.sum() / n), float(h[65:91].sum()), float(h[97:123].sum()), float(h[48:58].sum()), float(h[32] + h[9:14].sum()), float(h[10]), float(h[46]), float(h[44]), float(h[128:].sum()), _entropy(counts), _entropy(counts[_MARKS]),
        math.log1p(n), math.log1p(len(words)), n / m / 10, len(set(words)) / m, top / m, sum(map(eq, words, words[1:])) / pairs, len(set(zip(words, words[1:], strict=False))) / pairs, len(set(lines)) / len(lines), marked / m, caps / m,
        float(symbols.min()), float(symbols.max()), float(twice.max()), float(upper.max()), fewest, math.log1p(max(map(len, words), default=0)),
    ]


class Model:
    """Standardisation, random Fourier features, ridge weights and the calibration's knots; or one constant."""

    def __init__(self, mean, scale, constant=0.5, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale, self.constant = np.asarray(mean, float), np.asarray(scale, float), constant
        self.w = rng.standard_normal((d, features)) / math.sqrt(d / 2)
        self.b = rng.uniform(0, 2 * math.pi, features)
        self.beta = self.knots = self.values = None

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(x), 1))], axis=1)

    def normal_sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Z'Z and Z'y of some rows, side by side; sums over partitions are those of all rows."""
        z = self.mapped(x)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)

    def solve(self, sums: np.ndarray, rows: int, ridge: float = RIDGE) -> None:
        self.beta = np.linalg.solve(sums[:, :-1] + ridge * rows * np.eye(len(sums)) * 0.01, sums[:, -1])

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Isotonic regression by pooling neighbours that are out of order; each pool's centre is a knot."""
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # weight, sum of labels, sum of raw scores
        for r, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            pools.append([1.0, t, r])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                w, t2, r2 = pools.pop()
                pools[-1] = [pools[-1][0] + w, pools[-1][1] + t2, pools[-1][2] + r2]
        p = np.array(pools)
        self.knots, self.values = p[:, 2] / p[:, 0], p[:, 1] / p[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.constant)
        raw = (self.mapped(x) * self.beta).sum(axis=1)
        p = np.interp(raw, self.knots, self.values)
        # a thousandth of the raw order is left inside pools, so that they are not all ties
        return np.clip(p * 0.999 + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def held_out(doc_id: str) -> Column:
    """Every fifth id by its hash is kept out of fitting."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def document_statistics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of double, as STATISTICS)."""

    def work(batch):
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            x = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return by_batch(renamed(df, id_col, text_col), work, "doc_id long, x array<double>")


def chosen_labels(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", most: int = MOST_LABELS) -> DataFrame:
    """doc_id, y of the labels that are fitted: ``most`` rows of two numbers at most, small enough to broadcast."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)


def fit(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", most: int = MOST_LABELS, features: int = FEATURES) -> Model:
    """From statistics and labels of rows that are not held out; all but O(features**2) numbers stay in the cluster."""
    spark, chosen = stats.sparkSession, chosen_labels(labels, label_col, id_col, most)
    path = fresh_path(spark, "labelled")
    # an id may stand at any number of rows; each is fitted once
    once = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    once.select("y", "x", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate")).repartition(8).write.parquet(path)
    rows = spark.read.schema("y double, x array<double>, calibrate boolean").parquet(path)
    d = len(STATISTICS)
    moments = rows.where("not calibrate").agg(F.count("*").alias("n"), F.sum("y").alias("y"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    constant = (total["y"] / total["n"]) if total["n"] else 0.5
    if not moments["n"] or moments["y"] in (0, moments["n"]):
        return Model(np.zeros(d), np.ones(d), constant, features)
    model = Model([moments[f"m{i}"] for i in range(d)], [moments[f"s{i}"] or 1.0 for i in range(d)], constant, features)

    def sums(batches):
        out = None
        for b in batches:
            if b.num_rows:
                s = model.normal_sums(np.array(b.column(1).to_pylist()), b.column(0).to_numpy(zero_copy_only=False))
                out = s if out is None else out + s
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["sums"])

    size = features + d + 1
    parts = mapped(rows.where("not calibrate").select("y", "x"), sums, "sums binary").collect()  # at most 8 partitions
    model.solve(sum(np.frombuffer(r["sums"], "<f8").reshape(size, size + 1) for r in parts), moments["n"])

    def raw(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((model.mapped(x) * model.beta).sum(axis=1))], names=["y", "r"])

    pairs = mapped(rows.where("calibrate").select("y", "x"), raw, "y double, r double").collect()  # a quarter of the sample
    if pairs and 0 < sum(p["y"] for p in pairs) < len(pairs):
        model.calibrate(np.array([p["r"] for p in pairs]), np.array([p["y"] for p in pairs]))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def work(batch):
        x = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return by_batch(stats.select("doc_id", "x"), work, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "statistics")
    document_statistics(docs, id_col=id_col, text_col=text_col).write.parquet(path)
    stats = spark.read.schema("doc_id long, x array<double>").parquet(path)
    model = fit(stats, labels)
    return scored(stats, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text is predicted 1, with all their columns; each row is scored from its own text."""
    chosen = chosen_labels(labels).select(F.col("doc_id").alias(id_col))
    # statistics of the labelled documents alone; all others are computed once, where they are scored
    few = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).join(F.broadcast(chosen), id_col, "left_semi")
    model = fit(document_statistics(few, id_col=id_col, text_col=text_col), labels)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(at)])
                yield b.filter(pa.array(model.score(x) >= threshold))

    return mapped(docs, run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality": op1_quality}
ORACLE_SQL: dict[str, str] = {}
