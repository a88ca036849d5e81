"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Every document gets a row of statistics (sizes, shares of letter kinds, repetition, and how many of its words
belong to word lists learnt from the labels). cos(xW + b) approximates a Gaussian kernel over them. Each partition
sums Z'Z and Z'Y of its labelled documents; the driver adds these matrices and solves two ridge regressions, for
`quality` and for `toxic`. Scores of labelled documents that were held out are calibrated by isotonic regression.
A document is rejected if its calibrated quality is under 0.5 or its calibrated toxicity is over 0.5.

The classifier is fitted on at most `FIT_ROWS` labelled documents, those with the least hash of doc_id; every other
step covers every document and whole texts.

Defined cases: a null or empty text counts as a text without words and gets its score like any other. A label is
used if doc_id, quality and toxic are all there; of several labels of a doc_id the least (quality, toxic) counts, and of several texts of it the one
of the least hash. A text of any length is read whole, as one row of a batch. Without labels of both kinds nothing can be learnt: every
document gets quality 1, toxicity 0 and stays; where labels hold one kind of one target only, that target is constant.
An empty table gives an empty table. Other columns, of whatever name, pass through the stage unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.core import chunks, column, distinct_in_rows, fresh, string_bytes, table, words
from lexweave.ship import map_arrow

FIT_ROWS = 20_000
FEATURES = 256
GAMMA = 0.03
CLIP = 3.0  # standard deviations: texts of no usual size are still compared by their other statistics
RIDGE = 1.0
BUCKETS = 1 << 18
WORD_PARTS, RIDGE_PARTS, CALIBRATION_PART = (1, 2), (3, 4), 0  # of the fifths of the labelled documents: no part is used twice
MIN_DOCS = 4
MIN_ODDS = 2.0

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'\"()-"]] = True
_COUNTED = (("upper", 65, 91), ("lower", 97, 123), ("digit", 48, 58), ("line", 10, 11), ("space", 32, 33), ("wide", 128, 256))
STATISTICS = 16


class Lexicon(NamedTuple):
    """Words of low quality and toxic ones, as marked buckets: a word is listed if both of its buckets are marked, so that one that shares a bucket with a listed word isn't taken for it."""

    low: np.ndarray  # (2, BUCKETS)
    toxic: np.ndarray


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(46)).astype(np.int64), (h >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64)


def listed(marks: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return marks[0][at[0]] & marks[1][at[1]]


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def statistics(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    out = np.zeros((len(offs) - 1, STATISTICS))
    for lo, hi in chunks(offs):
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        w = words(d, o)
        size = np.diff(o)
        n = np.maximum(size, 1)
        count = np.diff(w.rows)
        m = np.maximum(count, 1)
        distinct, rows = distinct_in_rows(w.hash, w.rows)
        at = buckets(distinct)
        kinds = np.diff(rows)
        toxic, low = _per_row(listed(lexicon.toxic, at), rows), _per_row(listed(lexicon.low, at), rows)
        shares = {k: _per_row((d >= a) & (d < b), o) / n for k, a, b in _COUNTED}
        same = np.zeros(len(w.hash), bool)
        same[1:] = w.hash[1:] == w.hash[:-1]
        same[w.rows[:-1][count > 0]] = False
        punct = _per_row(_PUNCT[d], o)
        plain = _per_row(_STOP[d], o)
        letters = _per_row(w.size, w.rows)
        out[lo:hi] = np.stack(
            [
                np.log1p(size), np.log1p(count), letters / m / 8, shares["upper"] * 4, shares["lower"], shares["digit"] * 8, np.minimum(shares["line"] * 50, 4), shares["space"] * 4, shares["wide"] * 4,
                plain / n * 10, (punct - plain) / n * 10, kinds / m, _per_row(same, w.rows) / m * 4, np.log1p(toxic), np.log1p(low), np.minimum(low / np.maximum(kinds, 1) * 4, 4),
            ],
            axis=1,
        )
    return out


class Model(NamedTuple):
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray  # (FEATURES + 1, 2)
    steps: tuple  # for quality and toxic: (scores, probabilities) of the isotonic fit


def _projection(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * GAMMA), (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    w, b = _projection()
    z = np.cos(np.clip((x - mean) / scale, -CLIP, CLIP) @ w + b) * np.sqrt(2 / FEATURES)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: each block's least and greatest score with its mean, for interpolation between them."""
    score, at = np.unique(score, return_inverse=True)
    weight = np.bincount(at).astype(float)
    value = np.bincount(at, weights=y) / weight
    blocks: list[list[float]] = []
    for k in range(len(score)):
        blocks.append([value[k], weight[k], k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, end = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + v * n) / (p[1] + n), p[1] + n, p[2], end]
    xs = np.array([score[int(e)] for b in blocks for e in (b[2], b[3])])
    return xs, np.repeat([b[0] for b in blocks], 2)


def _rounds(rows: DataFrame, run, kind: type = np.float64) -> np.ndarray | None:
    """The sum over partitions of the arrays that run yields."""
    total = None
    for r in map_arrow(rows, run, "part binary").toLocalIterator():
        a = np.frombuffer(r["part"], kind).astype(float)
        total = a.copy() if total is None else total + a
    return total


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, quality, toxic) of at most so many labelled documents."""
    clean = labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, "quality").cast("int").alias("quality"), column(labels, "toxic").cast("int").alias("toxic")).dropna()
    one = clean.groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "l.quality", "l.toxic")
    slim = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    joined = slim.join(F.broadcast(some), "doc_id")  # `most` rows of 16 bytes at most, whatever the input
    return joined.groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text")).select("doc_id", "text", "quality", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model | None:
    """The model, or None where no labelled documents are found."""
    train = labelled(docs, labels, most).select("text", F.col("quality"), F.col("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int").alias("part")).persist()
    try:

        def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # documents of each bucket by (low quality, toxic) = 00, 01, 10, 11, and their number
            seen, n = np.zeros((4, 2, BUCKETS)), np.zeros(4)
            for b in batches:
                data, offs = string_bytes(b.column(0))
                kind = (1 - np.clip(b.column(1).to_numpy(), 0, 1)) * 2 + np.clip(b.column(2).to_numpy(), 0, 1)
                free = np.isin(b.column(3).to_numpy(), WORD_PARTS)
                for lo, hi in chunks(offs):
                    w = words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    h, rows = distinct_in_rows(w.hash, w.rows)
                    k, ok = np.repeat(kind[lo:hi], np.diff(rows)), np.repeat(free[lo:hi], np.diff(rows))
                    for j, at in enumerate(buckets(h)):
                        seen[:, j] += np.bincount((k * BUCKETS + at)[ok], minlength=4 * BUCKETS).reshape(4, BUCKETS)
                n += np.bincount(kind[free], minlength=4)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([n, seen.ravel()]).astype(np.float32).tobytes()], pa.binary())], ["part"])

        total = _rounds(train.coalesce(8), vocabulary, np.float32)
        if total is None:
            return None
        n, seen = total[:4], total[4:].reshape(4, 2, BUCKETS)
        lexicon = Lexicon(*(_marked(seen[list(a)].sum(0), n[list(a)].sum(), seen[list(b)].sum(0), n[list(b)].sum()) for a, b in (((2, 3), (0, 1)), ((1, 3), (0, 2)))))

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3, STATISTICS))
            for b in batches:
                x = statistics(*string_bytes(b.column(0)), lexicon)
                out += np.stack([np.full(STATISTICS, len(x)), x.sum(0), (x * x).sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

        count, s1, s2 = _rounds(train.coalesce(8), moments).reshape(3, STATISTICS)
        if not count[0]:
            return None
        mean = s1 / count
        scale = np.sqrt(np.maximum(s2 / count - mean * mean, 1e-4))
        width = FEATURES + 1

        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            zz, zy = np.zeros((width, width)), np.zeros((width, 2))
            for b in batches:
                free = np.isin(b.column(3).to_numpy(), RIDGE_PARTS)
                z = features(statistics(*string_bytes(b.column(0)), lexicon), mean, scale)[free]
                y = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)[free].astype(float)
                zz, zy = zz + z.T @ z, zy + z.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([zz.ravel(), zy.ravel()]).tobytes()], pa.binary())], ["part"])

        both = _rounds(train.coalesce(8), normal)
        if not both[width * width - 1]:
            return None
        coef = solved(both[: width * width].reshape(width, width), both[width * width :].reshape(width, 2))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = features(statistics(*string_bytes(b.column(0)), lexicon), mean, scale) @ coef
                yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), b.column(1), b.column(2)], ["s0", "s1", "quality", "toxic"])

        held = train.filter(F.col("part") == CALIBRATION_PART)
        rows = map_arrow(held, scored, "s0 double, s1 double, quality int, toxic int").toPandas()
        if rows.empty:
            rows = map_arrow(train, scored, "s0 double, s1 double, quality int, toxic int").toPandas()
        steps = tuple(isotonic(rows[s].to_numpy(), rows[y].to_numpy().astype(float)) for s, y in (("s0", "quality"), ("s1", "toxic")))
        return Model(lexicon, mean, scale, coef, steps)
    finally:
        train.unpersist()


def solved(zz: np.ndarray, zy: np.ndarray) -> np.ndarray:
    """Ridge coefficients from the summed normal equations; the constant, the last one, isn't shrunk."""
    penalty = np.eye(len(zz)) * RIDGE
    penalty[-1, -1] = 1e-6
    return np.linalg.solve(zz + penalty, zy)


def _marked(with_: np.ndarray, n: float, without: np.ndarray, m: float) -> np.ndarray:
    """Buckets that stand in enough documents of the first kind and far more often than in the second, by more than so many buckets would show by chance."""
    if not n or not m:
        return np.zeros(with_.shape, bool)
    odds = np.log((with_ + 0.5) / (n + 1)) - np.log((without + 0.5) / (m + 1))
    both = with_ + without
    with np.errstate(divide="ignore", invalid="ignore"):
        g = with_ * np.log(with_ / (both * n / (n + m))) + np.where(without > 0, without * np.log(without / (both * m / (n + m))), 0)
    return (with_ >= min(MIN_DOCS, n)) & (odds >= MIN_ODDS) & (g >= np.log(max((both > 0).sum() / 2, 1)) + 2)


def predict(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated quality and toxicity of each text."""
    s = features(statistics(data, offs, model.lexicon), model.mean, model.scale) @ model.coef
    q, t = (np.interp(s[:, k], *model.steps[k]) for k in (0, 1))
    return q, t


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[DataFrame, Model | None]:
    """docs with two columns in front, calibrated quality and toxicity, and the model."""
    model = fit(docs, labels, most)
    front = [fresh(docs, "quality"), fresh(docs, "toxicity")]
    names = [f"`{c.replace('`', '``')}` {f.dataType.simpleString()}" for c, f in zip(docs.columns, docs.schema)]
    at = docs.columns.index("text")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            q, t = (np.ones(b.num_rows), np.zeros(b.num_rows)) if m is None else predict(m, *string_bytes(b.column(at)))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(t), *b.columns], schema=pa.schema([*((c, pa.float64()) for c in front), *b.schema]))

    return map_arrow(docs, run, ", ".join([*(f"{c} double" for c in front), *names])), model


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject. Columns as in docs."""
    found, _ = scores(spark, docs, table(spark, sf_dir, "labels"))
    q, t = found.columns[:2]
    return found.filter((column(found, q) >= 0.5) & (column(found, t) <= 0.5)).drop(q, t)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated quality and toxicity, and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = scores(spark, docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "quality", "toxicity", F.expr("quality >= 0.5 and toxicity <= 0.5").alias("keep"))
