"""Substring deduplication with automata of repeated phrases.

A window is `window` consecutive words; words covered by a window that also starts in a document with a
smaller id go. Three steps find them, all linear in the text:

1. Candidates. Each window is represented by the smallest hash among its ANCHOR-word shingles, so equal
   windows have equal anchors, and about one word in eighteen carries one. Anchors of two or more documents
   are counted; every other window is unique and drops out here.
2. Confirmation. The remaining windows are counted by hash. Those of two or more documents recur; the
   smallest document of each owns it. Runs of windows that a document owns are its passages.
3. Automata. Passages and the candidate stretches of all documents are dealt by the owner of their anchor
   to bins of bounded passage text. A task compiles the passages of a bin, cut into HALF-word phrases (any
   window over a passage spans a whole phrase), into Aho-Corasick automata over word codes and streams the
   stretches through them. The windows around each phrase found are confirmed as a whole; those that a
   smaller document owns are the words to remove.

Anchors of very many documents spread their stretches over several bins that all get the passages, and the
stretches are streamed, not gathered, so no task depends on the size of a group of copies.

Defined results: null or wordless text has no words; a document without an id neither removes nor loses words;
ids may be of any orderable type, and smaller means smaller in its order. Rows that repeat an id never remove
words from each other. Windows are equal when two independent 64-bit hashes of their words are, from the count
of windows to the last confirmation. Texts of any length are read whole. An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, mixed, named, numbered, signed, staged, steps

WINDOW = 50
ANCHOR = 16
#: Passage words that one automaton holds, and about how many go to a bin.
AUTOMATON_WORDS = 400_000
BIN_WORDS = 30_000
#: Documents of an anchor that share a bin; those of more frequent ones are dealt over several.
SPREAD = 128
#: Pieces and their bytes that a task holds before it hands them on.
PIECES_AT_ONCE, PIECE_BYTES = 4096, 4 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _window_anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window from each word, and which words start a window."""
    m = len(hashes) - window + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    shingles, _ = words.windows(hashes, ANCHOR)
    return sliding_min(shingles, window - ANCHOR + 1)[:m], words.doc[:m] == words.doc[window - 1 :]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offsets in steps(batch, "text"):
                words = Words(data, offsets)
                anchors, ok = _window_anchors(words, words.hashes(), window)
                anchors, doc = anchors[ok], words.doc[: len(ok)][ok]
                if not len(anchors):
                    continue
                new = np.ones(len(anchors), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
                anchors, doc = anchors[new], doc[new]
                order = np.lexsort((anchors, doc))
                anchors, doc = anchors[order], doc[order]
                new = np.ones(len(anchors), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
                anchors, doc = anchors[new], doc[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchors)), pa.array(ids[i + doc])], names=["anchor", "id"]
                )

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0], column.values.slice(offsets[0], offsets[-1] - offsets[0])


def _member(doc: np.ndarray, values: np.ndarray, lists: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Place in flat of (doc, value), -1 if that document's list has no such value."""
    if not len(flat) or not len(doc):
        return np.full(len(doc), -1)
    owner = np.repeat(np.arange(len(lists) - 1), np.diff(lists))
    salt = lambda d: mixed(d.astype(np.uint64) + np.uint64(1))
    have = flat.view(np.uint64) ^ salt(owner)
    order = np.argsort(have)
    want = values ^ salt(doc)
    at = np.minimum(np.searchsorted(have, want, sorter=order), len(flat) - 1)
    place = order[at]
    return np.where((have[place] == want) & (owner[place] == doc), place, -1)


def _candidate_windows(window: int):
    """(whash, wcheck, id) of every window whose anchor recurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists, flat = _lists(batch.column(2))
            flat = np.asarray(flat.field("anchor"))
            for i, j, data, offsets in steps(batch, "text"):
                words = Words(data, offsets)
                hashes = words.hashes()
                anchors, ok = _window_anchors(words, hashes, window)
                at = np.flatnonzero(ok)
                own = lists[i : j + 1]
                found = _member(words.doc[at], anchors[at], own - own[0], flat[own[0] : own[-1]]) >= 0
                at = at[found]
                if not len(at):
                    continue
                (whole, _), (check, _) = words.windows(hashes, window), words.windows(words.hashes(1), window, 1)
                doc, whole, check = words.doc[at], whole[at], check[at]
                order = np.lexsort((check, whole, doc))
                doc, whole, check = doc[order], whole[order], check[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1]) | (check[1:] != check[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(whole[new])), pa.array(signed(check[new])), pa.array(ids[i + doc[new]])], names=["whash", "wcheck", "id"]
                )

    return run


PIECES = "bin long, passage boolean, id long, key long, start int, words int, text binary"


def _pieces(window: int, bins: int):
    """Candidate stretches of documents and the passages they own, each with the bins it goes to.

    A passage may hold a window more that shares the first hash of an owned one; its document has that window
    too, so the confirmation by both hashes stays right.
    """

    def handed(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bin", "passage", "id", "key", "start", "words", "text"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            lists, structs = _lists(batch.column(2))
            anchor, owner, level = (np.asarray(structs.field(c)) for c in ("anchor", "owner", "level"))
            owned_lists, owned = _lists(batch.column(4))
            owned = np.asarray(owned)
            for i, j, data, offsets in steps(batch, "text"):
                words = Words(data, offsets)
                hashes = words.hashes()
                anchors, ok = _window_anchors(words, hashes, window)
                at = np.flatnonzero(ok)
                own = lists[i : j + 1]
                place = _member(words.doc[at], anchors[at], own - own[0], anchor[own[0] : own[-1]])
                at, place = at[place >= 0], place[place >= 0] + own[0]
                if not len(at):
                    continue
                doc, whose, lev = words.doc[at], owner[place], level[place]
                whole, _ = words.windows(hashes, window)
                mine = owned_lists[i : j + 1]
                first = _member(doc, whole[at], mine - mine[0], owned[mine[0] : mine[-1]])
                keep = np.zeros(len(at), bool)  # of equal windows of a document one is enough
                keep[np.unique(first, return_index=True)[1]] = True
                keep &= first >= 0
                out: list[tuple] = []
                held = 0
                for passage, chosen in ((False, np.arange(len(at))), (True, np.flatnonzero(keep))):
                    if not len(chosen):
                        continue
                    p, d, o, v = at[chosen], doc[chosen], whose[chosen], lev[chosen]
                    new = np.ones(len(p), bool)
                    new[1:] = (np.diff(p) != 1) | (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (v[1:] != v[:-1])
                    heads = np.flatnonzero(new)
                    tails = np.append(heads[1:], len(p)) - 1
                    for a, b in zip(heads, tails, strict=True):
                        w0, w1 = int(p[a]), int(p[b]) + window
                        row = i + int(d[a])
                        text = data[words.starts[w0] : words.ends[w1 - 1]].tobytes()
                        spread = 1 << max(0, int(v[a]) - SPREAD.bit_length() + 1)
                        group = int(o[a]) * 64 + int(v[a])
                        salts = range(spread) if passage else (int(ids[row]) % spread,)
                        for salt in salts:
                            to = int(mixed(np.array([group * 1_000_003 + salt], np.int64).view(np.uint64))[0] % np.uint64(bins))
                            out.append((to, passage, int(ids[row]), int(keys[row]), w0 - int(words.first[d[a]]), w1 - w0, text))
                            held += len(text)
                            if len(out) >= PIECES_AT_ONCE or held >= PIECE_BYTES:
                                yield handed(out)
                                out, held = [], 0
                if out:
                    yield handed(out)

    return run


def _letters(hashes: np.ndarray) -> str:
    """A word's code: one of a million characters above the surrogates."""
    return ((hashes >> np.uint64(44)) + np.uint64(0x10000)).astype("<u4").tobytes().decode("utf-32-le")


class Automaton:
    """Passages of a bin, compiled: their phrases, and the owner of each of their windows."""

    def __init__(self, half: int, window: int):
        self.half, self.window, self.words = half, window, 0
        self.machine = ahocorasick.Automaton()
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.keys = self.checks = self.owners = None

    def add(self, owner: int, hashes: np.ndarray, windows: np.ndarray, checks: np.ndarray) -> None:
        letters = _letters(hashes)
        for at in range(0, len(hashes) - self.half + 1, self.half):
            self.machine.add_word(letters[at : at + self.half], True)
        self.parts.append((windows, checks, owner))
        self.words += len(hashes)

    def _compile(self) -> None:
        self.machine.make_automaton()
        keys, checks = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        owners = np.repeat(np.array([o for *_, o in self.parts], np.int64), [len(w) for w, *_ in self.parts])
        order = np.lexsort((owners, checks, keys))
        keys, checks, owners = keys[order], checks[order], owners[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        self.keys, self.checks, self.owners = keys[first], checks[first], owners[first]

    def locate(self, doc: int, hashes: np.ndarray, windows: np.ndarray, checks: np.ndarray, gone: np.ndarray) -> None:
        """Mark in gone the window starts of a stretch of `doc` that a smaller document owns.

        A phrase found makes the windows that span it candidates; each is then confirmed as a whole.
        """
        if self.keys is None:
            self._compile()
        ends = np.fromiter((e for e, _ in self.machine.iter(_letters(hashes))), np.int64)
        if not len(ends):
            return
        span = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(span, np.maximum(ends + 1 - self.window, 0), 1)
        np.add.at(span, ends - self.half + 2, -1)
        at = np.flatnonzero(np.cumsum(span)[: len(windows)] > 0)
        place = np.searchsorted(self.keys, windows[at])
        while len(at):
            inside = place < len(self.keys)
            at, place = at[inside], place[inside]
            same = self.keys[place] == windows[at]
            at, place = at[same], place[same]
            equal = self.checks[place] == checks[at]
            gone[at[equal & (self.owners[place] < doc)]] = True
            at, place = at[~equal], place[~equal] + 1  # another window of that first hash


def _spans(window: int, automaton_words: int):
    """(id, key, start, end) of removed words, from rows sorted by bin with passages before stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, book = None, []
        for batch in batches:
            bins, passages, docs, keys, begins = (batch.column(c).to_pylist() for c in range(5))
            out: list[tuple[int, int, int, int]] = []
            for i, j, data, offsets in steps(batch, "text"):
                words = Words(data, offsets)
                hashes = words.hashes()
                (whole, _), (check, _) = words.windows(hashes, window), words.windows(words.hashes(1), window, 1)
                for r in range(i, j):
                    if bins[r] != current:
                        current, book = bins[r], []
                    a, b = words.first[r - i], words.first[r - i + 1]
                    own, windows, checks = hashes[a:b], whole[a : b - window + 1], check[a : b - window + 1]
                    if passages[r]:
                        if not book or book[-1].words and book[-1].words + len(own) > automaton_words:
                            book.append(Automaton(window // 2, window))
                        book[-1].add(docs[r], own, windows, checks)
                        continue
                    gone = np.zeros(len(windows), bool)
                    for automaton in book:
                        automaton.locate(docs[r], own, windows, checks, gone)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                    for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                        out.append((docs[r], keys[r], begins[r] + x, begins[r] + y + window - 1))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                    names=["id", "key", "start", "end"],
                )

    return run


def _rest():
    """(id, n_words, n_removed, kept_sha256, kept) of each text less its removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            counts, removed, digests, kept_texts = [], [], [], []
            for key, text, cut in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                cut = [x for x in cut or () if x["key"] == key]
                words = (text or "").encode().split()
                n = len(words)
                if cut:
                    gone = np.zeros(n + 1, np.int64)
                    for s in cut:
                        gone[s["start"]] += 1
                        gone[s["end"]] -= 1
                    gone = np.cumsum(gone)[:n] > 0
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                kept = b" ".join(words)
                counts.append(n)
                removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept_texts)],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, kept_text."""
    text = F.col(text_col)
    rows, names = numbered(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")))
    with_id = rows.where("id IS NOT NULL")
    anchors = with_id.select("id", "text").mapInArrow(_anchors(window), "anchor long, id long")
    recurring = anchors.groupBy("anchor").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n"))
    recurring = recurring.where("owner < last")
    level = F.floor(F.log2(F.col("n"))).cast("int")
    recurring = staged(recurring.select("anchor", "owner", level.alias("level")))
    found = anchors.join(recurring, "anchor").groupBy("id")
    found = staged(found.agg(F.collect_set(F.struct("anchor", "owner", "level")).alias("anchors")))

    # All joins with the texts are by id alone, so their one exchange is reused.
    near = with_id.join(found, "id").select("id", "key", "anchors", "text")
    windows = near.mapInArrow(_candidate_windows(window), "whash long, wcheck long, id long")
    owned = windows.groupBy("whash", "wcheck").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id < last")
    owned = owned.groupBy("id").agg(F.collect_list("whash").alias("owned"))
    bins = max(1, recurring.count() * ANCHOR // BIN_WORDS)
    both = near.join(owned, "id", "left")
    both = both.select("id", "key", "anchors", "text", F.coalesce("owned", F.array().cast("array<long>")).alias("owned"))
    pieces = both.mapInArrow(_pieces(window, bins), PIECES)
    pieces = pieces.repartition("bin").sortWithinPartitions("bin", F.col("passage").desc(), "id")
    spans = pieces.mapInArrow(_spans(window, AUTOMATON_WORDS), "id long, key long, start int, end int")
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("key", "start", "end")).alias("spans"))
    out = with_id.join(spans, "id", "left").select("id", "key", "text", "spans")
    no_id = rows.where("id IS NULL").select("id", "key", "text", F.lit(None).cast(out.schema["spans"].dataType).alias("spans"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return named(out.mapInArrow(_rest(), schema).unionByName(no_id.mapInArrow(_rest(), schema)), names, "id")
