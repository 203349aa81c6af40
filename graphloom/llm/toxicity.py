"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are words and word stems (leading bytes), lower-cased, hashed to 2 ** BITS buckets; all those whose
document frequency differs by LEAST_Z standard errors between toxic and other labelled documents are selected,
2 ** BITS at most. A document's values are occurrences per hundred words, so one quoted insult in a long text
weighs little.

Labels are 0 or 1. Toxic documents are graded 1 to 3 by the terciles of how dense the selected features are
in them, others are grade 0. The model is P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector,
three ordered thresholds. Output is the expected severity, the sum over k of P(grade >= k).

Fitting uses at most `max_labelled` labelled documents, those of smallest id hash, and of these the first whose
texts fill `max_bytes`; they are written down once. All documents are scored, whole, in one pass that ships only
the selected weights.

Defined results: null or wordless text has severity 0; without both classes of labels every severity is 0;
of several labels of an id the largest counts; null labels are ignored. Of rows that repeat a labelled id the
greatest text is learned from, once; every row is scored by its own text alone, so equal texts tie exactly and
texts of any length are read whole. drop_toxic keeps all columns, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Words, mixed, plain, staged, steps

BITS = 20
STEMS = (4, 5, 6, 7, 8)
MAX_LABELLED = 20_000
MAX_LABELLED_BYTES = 64 << 20
#: Least standardised log-odds of a feature, and documents it must be in.
LEAST_Z, LEAST_DOCS = 3.2, 4
GRADES = 3
#: Expected severity from which a document is rejected.
LIMIT = 0.5

GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text of each) for words, then for the stems of longer words."""
    mask = np.uint64((1 << BITS) - 1)
    yield (words.hashes() & mask).astype(np.int64), words.doc
    lengths = words.ends - words.starts
    for n in STEMS:
        long = lengths > n
        yield (mixed(words.heads(n)[long] + np.uint64(n)) & mask).astype(np.int64), words.doc[long]


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, other): documents of each class that have it, per step."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, _, data, offsets in steps(batch, "text"):
            words = Words(data, offsets, lower=True, gaps=GAPS)
            pairs = [d << BITS | f for f, d in _features(words)]
            pairs = np.unique(np.concatenate(pairs))
            f, bad = pairs & ((1 << BITS) - 1), toxic[i + (pairs >> BITS)]
            own, at = np.unique(f, return_inverse=True)
            hits = np.bincount(at, bad, len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(hits), pa.array(np.bincount(at, minlength=len(own)) - hits)], names=["feature", "toxic", "other"]
            )


@dataclass
class Model:
    features: np.ndarray  # buckets
    weights: np.ndarray
    thresholds: np.ndarray  # rising

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to GRADES."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _values(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, selected feature, value) entries; table maps a bucket to its number or -1."""
    found = [(d[table[f] >= 0], table[f][table[f] >= 0]) for f, d in _features(words)]
    d, f = (np.concatenate(x) for x in zip(*found, strict=True))
    return d, f, 100 / np.maximum(words.counts, 1)[d]


def _rows(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << BITS, -1, np.int64)
        table[features] = np.arange(len(features))
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in steps(batch, "text"):
                d, f, v = _values(Words(data, offsets, lower=True, gaps=GAPS), table)
                pairs, at = np.unique(d * len(features) + f, return_inverse=True)
                v = np.bincount(at, v, len(pairs))
                cuts = np.searchsorted(pairs // max(1, len(features)), np.arange(j - i + 1))
                ends = pa.array(cuts.astype(np.int32))
                entries = ((pairs % max(1, len(features))).astype(np.int32), v.astype(np.float32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in entries]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[i:j].astype(np.int32)), *lists], names=["toxic", "f", "v"])

    return run


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, n_features: int, rounds: int = 400, ridge: float = 2e-4):
    """Weights and thresholds of the cumulative-link model, by full-batch Adam on the mean log-likelihood."""
    n = len(grade)
    w = np.zeros(n_features)
    shares = np.array([(grade < k).mean() for k in range(1, GRADES + 1)]).clip(1e-3, 1 - 1e-3)
    first, gaps = np.log(shares[0] / (1 - shares[0])), np.log(np.maximum(np.diff(np.log(shares / (1 - shares))), 0.05))
    p = np.concatenate((w, [first], gaps))
    m, s = np.zeros_like(p), np.zeros_like(p)
    above = np.arange(n), grade
    for t in range(1, rounds + 1):
        w, first, gaps = p[:n_features], p[n_features], np.exp(p[n_features + 1 :])
        theta = np.concatenate(([first], first + np.cumsum(gaps)))
        score = np.bincount(row, w[col] * val, n)
        low = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -40, 40)))  # P(grade < k)
        steep = low * (1 - low)
        c = np.concatenate((np.zeros((n, 1)), low, np.ones((n, 1))), 1)
        z = np.zeros((n, 1))
        slope = np.concatenate((z, steep, z), 1)
        chance = np.maximum((c[:, 1:] - c[:, :-1])[above], 1e-9)
        up, down = slope[:, 1:][above] / chance, slope[:, :-1][above] / chance
        g_score = (up - down) / n  # of minus the log-likelihood
        g_theta = np.zeros(GRADES + 2)
        np.add.at(g_theta, grade + 1, -up / n)
        np.add.at(g_theta, grade, down / n)
        g_theta = g_theta[1:-1]
        g = np.concatenate((np.bincount(col, g_score[row] * val, n_features) + ridge * w, [g_theta.sum()], g_theta[::-1].cumsum()[::-1][1:] * gaps))
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    first, gaps = p[n_features], np.exp(p[n_features + 1 :])
    return p[:n_features], np.concatenate(([first], first + np.cumsum(gaps)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_LABELLED_BYTES
) -> Model | None:
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    own = own.agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own), "id")
    rows = staged(rows.groupBy("id", "toxic").agg(F.max("text").alias("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    upto = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)  # max_labelled short rows
    first = rows.select("id", size.alias("size")).withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    rows = rows.join(F.broadcast(first.where(F.col("before") < max_bytes).select("id")), "id", "left_semi").select("text", "toxic")
    classes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = classes.get(1, 0), classes.get(0, 0)
    if not bad or not good:
        return None
    counts = rows.mapInArrow(_present, "feature long, toxic long, other long").groupBy("feature")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (bad + 1 - a)) - F.log(b / (good + 1 - b))
    z = odds / F.sqrt(1 / a + 1 / (bad + 1 - a) + 1 / b + 1 / (good + 1 - b))
    chosen = counts.select("feature", z.alias("z")).where(F.abs("z") >= LEAST_Z)
    picked = sorted((r["feature"], r["z"]) for r in chosen.collect())  # 2 ** BITS rows at most
    if not picked:
        return None
    features, strength = np.array([f for f, _ in picked]), np.array([s for _, s in picked])
    # Arrow keeps the sample's entries as flat arrays; max_labelled and max_bytes bound it.
    found = rows.mapInArrow(_rows(features), "toxic int, f array<int>, v array<float>").toArrow().combine_chunks()
    toxic = found.column("toxic").to_numpy()
    entries = [found.column(c).combine_chunks() for c in ("f", "v")]
    row = np.repeat(np.arange(len(toxic)), np.diff(np.asarray(entries[0].offsets)))
    col, val = entries[0].flatten().to_numpy().astype(np.int64), entries[1].flatten().to_numpy().astype(float)
    val = np.minimum(val, 10.0)
    density = np.bincount(row, val * (strength[col] > 0), len(toxic))
    cuts = np.quantile(density[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, density, "right"), 0)
    weights, thresholds = fit(row, col, val, grade, len(features))
    return Model(features, weights, thresholds)


def _scorer(model: Model | None, column: str):
    """All columns of a batch, then expected_severity and grade of the text in `column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << BITS, -1, np.int64)
        if model:
            table[model.features] = np.arange(len(model.features))
        for batch in batches:
            severity, grade = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for i, j, data, offsets in steps(batch, column) if model else ():
                d, f, v = _values(Words(data, offsets, lower=True, gaps=GAPS), table)
                n = len(model.features)
                pairs, at = np.unique(d * n + f, return_inverse=True)
                v = np.minimum(np.bincount(at, v, len(pairs)), 10.0)
                p = model.chances(np.bincount(pairs // n, model.weights[pairs % n] * v, j - i))
                has = np.bincount(pairs // n, minlength=j - i) > 0
                severity[i:j] = np.where(has, p.sum(axis=1), 0.0)
                grade[i:j] = np.where(has, (p >= 0.5).sum(axis=1), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(severity), pa.array(grade)], names=[*batch.schema.names, "expected_severity", "grade"]
            )

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int
) -> DataFrame:
    """One row per document: id, expected_severity (0 to 3), grade (thresholds passed)."""
    model = train(docs, labels, id_col, text_col, label_col, **bounds)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(model, "text"), f"id {kind}, text string, expected_severity double, grade int")
    return scored.drop("text")


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: float = LIMIT, **bounds: int
) -> DataFrame:
    """The documents below the limit, with all their columns."""
    model = train(docs, labels, id_col, text_col, label_col, **bounds)
    rows, names = plain(docs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    scorer = _scorer(model, names[docs.columns.index(text_col)])
    out = rows.mapInArrow(scorer, f"{schema}, expected_severity double, grade int").where(F.col("expected_severity") < limit)
    return out.select(*names).toDF(*docs.columns)
