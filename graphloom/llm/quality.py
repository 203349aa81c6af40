"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each document gets counts (words, their characters, symbols, duplicate lines, repeated words, capitals) and
from them a vector of transformed statistics. Over the documents that pass the base rules, the minimum
covariance determinant is estimated per (language, source), in its regularised form: the COVERAGE share of the
documents whose covariance, scaled and with FLOOR variances added, has the least determinant. The floor keeps
statistics that are constant in most documents (no symbols at all) from making every exception an outlier.

The search is nested, as in FAST-MCD. A group is dealt into chunks of about CHUNK documents. In each, concentration
steps (refit mean and covariance on the nearest share) run from several starts, three from robust moments and
RANDOM_STARTS from a few documents, until they stand still, and the least determinant wins. The CANDIDATES best of a
group's chunks then take steps over the whole group, all of its documents, until they stand still too, and the
least determinant is the estimate; for a group of one chunk these steps only confirm it. Steps over a whole group
take the share by a quantile sketch of ACCURACY ranks, which is exact below so many documents.

A document is rejected if its squared Mahalanobis distance exceeds the quantile that a new document exceeds with a
chance of TAIL: k (n^2 - 1) / (n (n - k)) times that of F(k, n - k), n being the documents fitted, so estimates from few
documents reject less. A group has an estimate of its own once that limit is at most WIDEST times what it would be
with unlimited documents; smaller groups use their language's estimate, and small languages that of all documents.

Defined results: null text has no words and fails the base rules; null language and source are values of
their own. Equal rows get equal results and ties at the cut-off stay. Texts of any length count whole. An empty
table, or one without sound documents, gives distances of 0. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, Words, mixed, staged, steps

LEAST_WORDS = 20
REPEAT_WINDOW, REPEAT_PERCENT = 8, 30
COVERAGE = 0.75
CHUNK = 4096
RANDOM_STARTS = 4
CANDIDATES = 2
ACCURACY = 10_000
WIDEST = 1.5
#: Chance of a document of the fitted normal to lie beyond the cut-off.
TAIL = 1e-6
#: Fall of a determinant, as a share, below which it stands still.
STILL = 1e-9
#: Groups whose estimates may be broadcast; with more, the join shuffles.
BROADCAST_GROUPS = 20_000
#: Statistics and the least standard deviation of each.
FLOOR = {"length": 0.5, "word": 0.08, "symbols": 0.045, "lines": 0.15, "repeats": 0.13, "capitals": 0.06}
NAMES = list(FLOOR)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    n, seen = 0, set()
    for line in text.split(b"\n"):
        if line and (line in seen or line.strip(b" \t\n\x0b\x0c\r")):
            n += 1
            seen.add(line)
    return n, n - len(seen)


def count_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, text, replaced by COUNTS."""
    for batch in batches:
        out = np.zeros((len(COUNTS), batch.num_rows), np.int64)
        for i, j, data, offsets in steps(batch, "text"):
            words = Words(data, offsets)
            spaces = SPACE[data]
            windows, ok = words.windows(words.hashes(), REPEAT_WINDOW)
            at = np.flatnonzero(ok)
            keys = windows[at] ^ mixed(words.doc[at].astype(np.uint64) + np.uint64(1))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(words.doc) + 1, np.int64)
            np.add.at(cover, at[twice], 1)
            np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
            repeated = np.cumsum(cover)[:-1] > 0
            whole = data.tobytes()
            lines = [_lines(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            out[:, i:j] = [
                words.counts,
                _per_text(~spaces & (data & 0xC0 != 0x80), offsets),
                _per_text(SYMBOL[data], offsets),
                [d for _, d in lines],
                np.bincount(words.doc, repeated, j - i),
                [n for n, _ in lines],
                _per_text(CAPITAL[data], offsets),
            ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], names=[*batch.schema.names[:-1], *COUNTS])


def _vector() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(words),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_capitals") / chars),
    ]


def cut_off(n: int, k: int, p: float = TAIL) -> float:
    """The squared distance that a new document exceeds with chance p, after a fit of n; k must be even.

    P(F(k, n - k) > f) is the incomplete beta function I_x(a, b) at x = (n - k) / (n - k + k f), a = (n - k) / 2, b = k / 2.
    """
    if n <= k + 1:
        return float("inf")
    a, low, high = (n - k) / 2, -700.0, 0.0
    for _ in range(200):  # for the log of x
        x = (low + high) / 2
        terms, term = 0.0, 1.0
        for j in range(k // 2):
            terms += term
            term *= (a + j) / (j + 1) * -np.expm1(x)
        if a * x + np.log(terms) > np.log(p):
            high = x
        else:
            low = x
    f = (n - k) / k * np.expm1(-low)
    return float(k * (n * n - 1) / (n * (n - k)) * f)


def _consistency(k: int) -> float:
    """Factor that makes the covariance of the nearest COVERAGE share of a normal sample unbiased."""
    rng = np.random.default_rng(0)
    d = np.sort((rng.standard_normal((200_000, k)) ** 2).sum(axis=1))
    return float(k / d[: int(COVERAGE * len(d))].mean())


def _share(n: int, k: int) -> int:
    return min(n, max(int(np.ceil(COVERAGE * n)), k + 1))


def _least(tail: float) -> int:
    """Documents from which a group's cut-off is at most WIDEST times that of an unlimited group."""
    n, most = DIMS + 1, WIDEST * cut_off(10**9, DIMS, tail)
    while cut_off(_share(n, DIMS), DIMS, tail) > most:
        n += 1
    return n


def _distances(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,ij->i", d @ np.linalg.inv(scatter), d)


def mcd(x: np.ndarray, floor: np.ndarray, factor: float, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """(log determinant, mean, scatter) of the share of the rows of x found with the least determinant."""
    n, k = x.shape
    h = _share(n, k)

    def fit(rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        scatter = np.cov(rows, rowvar=False, bias=True).reshape(k, k) * factor + floor
        return np.linalg.slogdet(scatter)[1], rows.mean(axis=0), scatter

    def step(found):
        return fit(x[np.argpartition(_distances(x, *found[1:]), h - 1)[:h]])

    middle = np.median(x, axis=0)
    spread = np.maximum(np.subtract(*np.percentile(x, [75, 25], axis=0)) / 1.349, np.sqrt(np.diag(floor)))
    z = (x - middle) / spread
    length = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    signs = (z / length).T @ (z / length) / n * k
    ranks = np.tanh(z)
    shapes = [np.eye(k), signs, np.cov(ranks, rowvar=False, bias=True).reshape(k, k) / max(np.var(ranks, axis=0).max(), 1e-12)]
    starts = [(np.inf, middle, spread[:, None] * s * spread + floor) for s in shapes]
    rng = np.random.default_rng(seed)
    starts += [fit(x[rng.choice(n, min(n, k + 1), replace=False)]) for _ in range(RANDOM_STARTS)]
    best = None
    for found in starts:
        found = step(found)
        while (nearer := step(found))[0] < found[0] - STILL:
            found = nearer
        best = found if best is None or found[0] < best[0] else best
    return best


DIMS = len(NAMES)
ESTIMATE = ", ".join(["logdet double", *[f"m{i} double" for i in range(DIMS)], *[f"p{i}_{j} double" for i, j in PAIRS]])


def _floor() -> np.ndarray:
    return np.diag(np.square(list(FLOOR.values())))


def _row(logdet: float, mean: np.ndarray, scatter: np.ndarray) -> list[float]:
    precision = np.linalg.inv(scatter)
    return [logdet, *mean, *[precision[i, j] for i, j in PAIRS]]


def _chunk_estimate(factor: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(f"x{i}").to_numpy() for i in range(DIMS)])
        x = x[np.lexsort(x.T)]  # the order of arrival is nobody's
        row = _row(*mcd(x, _floor(), factor))
        names = ["group", "chunk", *[c.split()[0] for c in ESTIMATE.split(", ")]]
        return pa.table([pa.array([v.as_py()]) for v in key] + [pa.array([v]) for v in row], names=names)

    return run


def _refit(factor: float):
    """(group, candidate, estimate) from sums of moments."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(DIMS)]) / r["n"]
                scatter = _floor()
                for i, j in PAIRS:
                    v = (r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]) * factor
                    scatter[i, j] += v
                    scatter[j, i] += v if i != j else 0.0
                rows.append([r["group"], r["candidate"], *_row(np.linalg.slogdet(scatter)[1], mean, scatter)])
            yield pd.DataFrame(rows, columns=["group", "candidate", *[c.split()[0] for c in ESTIMATE.split(", ")]])

    return run


def _distance(of: str = "") -> Column:
    d = [F.col(f"x{i}") - F.col(f"{of}m{i}") for i in range(DIMS)]
    terms = [F.col(f"{of}p{i}_{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def _distances_of(vectors: DataFrame, current: DataFrame, few: bool) -> DataFrame:
    """A row for each vector of the groups in current, with its distance far0, far1, ... from each of the group's candidates, null without."""
    estimate = F.struct(*[c for c in current.columns if c not in ("group", "candidate", "logdet")])
    beside = [F.first(F.when(F.col("candidate") == n, estimate), ignorenulls=True).alias(f"e{n}") for n in range(CANDIDATES)]
    wide = current.groupBy("group").agg(*beside)
    far = [_distance(f"e{n}.").alias(f"far{n}") for n in range(CANDIDATES)]
    return vectors.join(F.broadcast(wide) if few else wide, "group").select("group", *far, *[f"x{i}" for i in range(DIMS)])


def _moments(far: DataFrame, few: bool) -> DataFrame:
    """(group, candidate, n, sums, sums of products) of the vectors within the COVERAGE share of each candidate."""
    numbers = range(CANDIDATES)
    limit = staged(far.groupBy("group").agg(*[F.percentile_approx(f"far{n}", COVERAGE, ACCURACY).alias(f"limit{n}") for n in numbers]))
    near = [F.col(f"far{n}") <= F.col(f"limit{n}") for n in numbers]
    values = {"n": F.lit(1)} | {f"s{i}": F.col(f"x{i}") for i in range(DIMS)} | {f"q{i}_{j}": F.col(f"x{i}") * F.col(f"x{j}") for i, j in PAIRS}
    rows = far.join(F.broadcast(limit) if few else limit, "group").where(reduce(or_, near))
    total = rows.groupBy("group").agg(*[F.sum(F.when(near[n], v)).alias(f"{name}of{n}") for n in numbers for name, v in values.items()])
    each = [F.struct(F.lit(n).alias("candidate"), *[F.col(f"{name}of{n}").alias(name) for name in values]) for n in numbers]
    return total.select("group", F.inline(F.array(*each))).where("n IS NOT NULL")


def _whole_steps(vectors: DataFrame, candidates: DataFrame, few: bool, factor: float) -> DataFrame:
    """The candidates (group, candidate, estimate) after steps over all vectors of their groups until none falls.

    A step meets each vector once, for all candidates of its group together.
    """
    settled, current = None, staged(candidates.withColumn("logdet", F.lit(float("inf"))))
    while True:
        total = _moments(_distances_of(vectors, current, few), few)
        fitted = staged(total.mapInPandas(_refit(factor), f"group string, candidate int, {ESTIMATE}"))
        was = current.select("group", "candidate", F.col("logdet").alias("was"))
        fitted = fitted.join(was, ["group", "candidate"])
        falls = F.col("logdet") < F.col("was") - STILL
        still = staged(fitted.where(~falls).drop("was"))
        settled = still if settled is None else settled.unionByName(still)
        current = staged(fitted.where(falls).drop("was"))
        if current.isEmpty():
            return settled


def _estimates(vectors: DataFrame, sizes: DataFrame, few: bool, tail: float) -> DataFrame:
    """(group, estimate, cut) of vectors (group, row, x...); sizes has (group, count)."""
    factor = _consistency(DIMS)
    sizes = staged(sizes.withColumn("chunks", F.ceil(F.col("count") / CHUNK)))
    dealt = vectors.join(F.broadcast(sizes) if few else sizes, "group")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")))
    schema = f"group string, chunk long, {ESTIMATE}"
    first = staged(dealt.select("group", "chunk", *[f"x{i}" for i in range(DIMS)]).groupBy("group", "chunk").applyInArrow(_chunk_estimate(factor), schema))
    # The least of each group by aggregates: one after the other, as there are few candidates.
    left, picked = first, None
    for nth in range(CANDIDATES):
        names = [c for c in first.columns if c != "group"]
        best = left.groupBy("group").agg(F.min(F.struct("logdet", "chunk")).alias("b")).select("group", F.col("b.chunk").alias("chunk"))
        own = left.join(best, ["group", "chunk"]).select("group", *names).withColumn("candidate", F.lit(nth))
        picked = own if picked is None else picked.unionByName(own)
        left = left.join(best, ["group", "chunk"], "left_anti")
    picked = staged(picked.drop("chunk"))
    settled = _whole_steps(vectors, picked, few, factor)
    least = settled.groupBy("group").agg(F.min(F.struct("logdet", "candidate")).alias("b")).select("group", F.col("b.candidate").alias("candidate"))
    done = settled.join(least, ["group", "candidate"])
    done = done.drop("candidate", "logdet").join(sizes.select("group", "count"), "group")

    def cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["cut"] = [cut_off(_share(int(n), DIMS), DIMS, tail) for n in frame["count"]]
            yield frame

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in done.schema.fields)
    return staged(done.mapInPandas(cuts, f"{schema}, cut double").drop("count"))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL
) -> DataFrame:
    """One row per document: id, the base counts, base_failed, distance (squared), kept."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    rows = docs.select(F.col(id_col).alias("id"), name(lang_col).alias("lang"), name(source_col).alias("source"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    stats = rows.mapInArrow(count_stats, f"id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    stats = staged(stats.select("*", *[c.alias(f"x{i}") for i, c in enumerate(_vector())]))

    stats = stats.withColumn("row", F.monotonically_increasing_id())
    least = _least(tail)
    sizes = stats.where("NOT base_failed").groupBy("lang", "source").count()
    sizes = staged(sizes.withColumn("in_lang", F.sum("count").over(Window.partitionBy("lang"))))
    # Lengths keep a language and a source apart, whatever characters they hold.
    pair = F.concat(F.lit("2:"), F.length("lang").cast("string"), F.lit(":"), "lang", "source")
    lang, every = F.concat(F.lit("1:"), "lang"), F.lit("0:")
    group = F.when(F.col("count") >= least, pair).when(F.col("in_lang") >= least, lang).otherwise(every)
    groups = staged(sizes.select("lang", "source", "count", "in_lang", group.alias("own")))
    few = groups.count() <= BROADCAST_GROUPS
    stats = stats.join((F.broadcast(groups) if few else groups).drop("count", "in_lang"), ["lang", "source"], "left").withColumn("own", F.coalesce("own", every))

    # A group that only its language or all documents serve is estimated from all of those.
    wanted = groups.select(F.col("own").alias("group")).distinct()
    used = lambda p, l: F.explode(F.array(p, l, every))
    counts = groups.select(used(pair, lang).alias("group"), "count").groupBy("group").agg(F.sum("count").alias("count"))
    counts = staged(counts.join(wanted, "group", "left_semi"))
    vectors = stats.where("NOT base_failed").select(used(pair, lang).alias("group"), "row", *[f"x{i}" for i in range(DIMS)])
    vectors = vectors.join(F.broadcast(counts.select("group")) if few else counts.select("group"), "group", "left_semi")
    estimates = _estimates(staged(vectors), counts, few, tail)

    final = stats.withColumnRenamed("own", "group").join(F.broadcast(estimates) if few else estimates, "group", "left")
    final = final.withColumn("distance", F.coalesce(_distance(), F.lit(0.0)))
    kept = ~F.col("base_failed") & (F.col("distance") <= F.coalesce("cut", F.lit(0.0)))
    return final.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
