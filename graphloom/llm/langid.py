"""Language identification by rank-order profiles (the out-of-place measure of Cavnar and Trenkle, 1994).

n-grams are 1 to 3 characters (code points) of the lower-cased text, letters only, each word between spaces. The
profile of a language is its PROFILE most frequent n-grams over all of its training texts, in rank order. A
document's own n-grams are ranked likewise, all of them, before any profile is looked at; each of the RANKS most
frequent adds how far its rank is from the language's, or PROFILE where the language lacks it. The smallest sum wins,
ties to the first by name; n-grams of equal count rank in code point order.

Counting covers every training text; profiles, PROFILE rows a language, are all that is shipped, for MOST_LANGUAGES at
most: more are an error. Score is 1 - distance / worst distance.

Defined results: null text or text without a letter is `und` with score 0; so is everything if nothing was
learned. Training rows need a non-null language. Rows that repeat count as often as they occur in training and
are judged alike; texts of any length are counted whole, SLICE characters at a time. An empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged, steps

PROFILE = 400
RANKS = 300
UNKNOWN = "und"
MOST_LANGUAGES = 10_000
#: Characters that are sorted at once.
SLICE = 1 << 20
SPACE = 32
#: Bits of a code point in an n-gram's number: the first character on top, none being 0.
POINT = 21


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a run of texts and how many each has; bytes that are no UTF-8 become replacement characters."""
    raw = data.tobytes()
    try:
        text = raw.decode()
        counts = np.add.reduceat(np.append(data & 0xC0 != 0x80, 0).astype(np.int64), offsets[:-1])
        counts[offsets[1:] == offsets[:-1]] = 0
    except UnicodeDecodeError:
        parts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, counts = "".join(parts), np.array([len(p) for p in parts])
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64), counts


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, text of each): other than lower-case ASCII and what lies beyond it is one space; texts are between spaces."""
    x, counts = _points(data, offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    x = np.where((x >= 128) | ((x >= 97) & (x <= 122)), x, SPACE)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != SPACE) | (x[:-1] != SPACE) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    if not len(x):
        return x, doc
    # A space after and before each text; where two meet, the first one's comes first.
    edges = np.flatnonzero(np.diff(doc)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(x)]))
    owners = doc[starts]
    at = np.concatenate((ends, starts))
    return np.insert(x, at, SPACE), np.insert(doc, at, np.concatenate((owners, owners)))


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs, or the sums of counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[new], np.diff(np.append(new, len(keys)))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def count_grams(x: np.ndarray, doc: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) in order of owner and n-gram, of the texts of each owner."""
    none = np.zeros(0, np.int64)
    if not len(x):
        return none, none, none
    # Characters and owners are numbered within the run, in order, so that all of an entry fits one integer.
    points = np.zeros(1 << POINT, bool)
    points[x] = True
    present = np.flatnonzero(points)
    number = np.zeros(1 << POINT, np.int64)
    number[present] = np.arange(1, len(present) + 1)
    bits, owners = len(present).bit_length(), owner[doc]
    if 3 * bits + int(owners.max()).bit_length() > 63:
        if owners.max() == 0:
            raise ValueError("more characters than code points")
        halves = [owners <= owners.max() // 2, owners > owners.max() // 2]
        parts = [count_grams(x[h], doc[h], owner - (k * (owners.max() // 2 + 1))) for k, h in enumerate(halves)]
        parts[1] = (parts[1][0] + owners.max() // 2 + 1, *parts[1][1:])
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    c, found = number[x], []
    for first in range(0, len(x), SLICE):
        y, d = c[first : first + SLICE + 2], doc[first : first + SLICE + 2]
        z, m = x[first : first + SLICE + 2], min(SLICE, len(x) - first)
        base = owners[first : first + SLICE + 2] << 3 * bits | y << 2 * bits
        two_ok = (d[:-1] == d[1:]) & ((z[:-1] != SPACE) | (z[1:] != SPACE))
        two = base[:-1] | y[1:] << bits
        three_ok = two_ok[:-1] & two_ok[1:] & (z[1:-1] != SPACE)
        three = two[:-1] | y[2:]
        found.append(_summed(np.concatenate((base[:m][z[:m] != SPACE], two[:m][two_ok[:m]], three[:m][three_ok[:m]]))))
    keys, counts = found[0] if len(found) == 1 else _summed(*(np.concatenate(p) for p in zip(*found, strict=True)))
    mask = (1 << bits) - 1
    points = np.concatenate(([0], present))
    grams = points[keys >> 2 * bits & mask] << 2 * POINT | points[keys >> bits & mask] << POINT | points[keys & mask]
    return keys >> 3 * bits, grams, counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed over a partition."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for i, j, data, offsets in steps(batch, "text"):
            names, number = np.unique(langs[i:j].astype(str), return_inverse=True)
            owner, grams, counts = count_grams(*_letters(data, offsets), number.astype(np.int64))
            cuts = np.searchsorted(owner, np.arange(len(names) + 1))
            for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True):
                own = grams[a:b], counts[a:b]
                if name in held:
                    own = _summed(np.concatenate((held[name][0], own[0])), np.concatenate((held[name][1], own[1])))
                if len(own[0]):
                    held[name] = own
        if len(held) > 200:  # many languages: hand on what there is
            yield from _flush(held)
    yield from _flush(held)


def _flush(held: dict) -> Iterator[pa.RecordBatch]:
    for lang, (grams, counts) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
    held.clear()


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> DataFrame:
    """(lang, gram, rank), rank from 0, of the most frequent n-grams of each language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The plain comparison lets Spark keep the best of each partition before the shuffle by language.
    best = counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= profile)
    return best.select("lang", "gram", (F.col("nth") - 1).alias("rank"))


def _top(owner: np.ndarray, counts: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, rank of each) of the `ranks` most frequent entries of each owner; entries are in order of owner and n-gram."""
    most = int(counts.max())
    cb, ib = most.bit_length(), len(counts).bit_length()
    if int(owner.max()).bit_length() + cb + ib <= 63:
        order = np.sort(owner << cb + ib | (most - counts) << ib | np.arange(len(counts))) & ((1 << ib) - 1)
    else:
        order = np.lexsort((-counts, owner))
    own = owner[order]
    new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    rank = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
    keep = rank < ranks
    return order[keep], rank[keep]


def _classifier(profiles: dict[str, list[int]], profile: int, ranks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted(profiles)
        grams_of = {lang: np.array(profiles[lang], np.int64) for lang in langs}
        places = {lang: np.argsort(grams_of[lang]) for lang in langs}
        for batch in batches:
            letters = batch.column(batch.schema.get_field_index("has_letter")).to_numpy(zero_copy_only=False)
            names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for i, j, data, offsets in steps(batch, "text") if langs else ():
                owner, grams, counts = count_grams(*_letters(data, offsets), np.arange(j - i))
                best, name, used = np.full(j - i, np.iinfo(np.int64).max), np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                if len(owner):
                    chosen, rank = _top(owner, counts, ranks)
                    owner, grams = owner[chosen], grams[chosen]
                    used = np.bincount(owner, minlength=j - i)
                for k, lang in enumerate(langs):
                    far = np.zeros(j - i, np.int64)
                    if len(owner):
                        at = np.minimum(np.searchsorted(grams_of[lang], grams, sorter=places[lang]), len(places[lang]) - 1)
                        place = places[lang][at]
                        off = np.where(grams_of[lang][place] == grams, np.abs(place - rank), profile)
                        far = np.bincount(owner, off, j - i).astype(np.int64)
                    name[far < best] = k
                    best = np.minimum(best, far)
                spoken = letters[i:j]
                names[i:j][spoken] = np.array(langs, object)[name[spoken]]
                scores[i:j] = np.where(spoken & (used > 0), 1 - best / (profile * np.maximum(used, 1)), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"]
            )

    return run


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile: int = PROFILE, ranks: int = RANKS) -> DataFrame:
    """One row per document: id, lang_pred, score."""
    profiles = staged(profiles)
    if profiles.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"profiles of more than {MOST_LANGUAGES} languages")
    learned: dict[str, list[int]] = {}
    for r in profiles.orderBy("lang", "rank").collect():  # `profile` rows a language
        learned.setdefault(r["lang"], []).append(r["gram"])
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
        F.lower(text_col).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_classifier(learned, profile, ranks), f"id {kind}, lang_pred string, score double")


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2
