"""Small tables with every edge case, and plain versions of the operators' definitions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, shard string, kept string, size int"


def words(text):
    return WORD.findall(text or "")


def make_rows(seed=0, n=60, vocabulary=400):
    """(doc_id, text, lang, source) rows: copies, near copies, shared passages, nulls, empty and long texts."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghijklmnopéü") for _ in range(rnd.randint(2, 9))) for _ in range(vocabulary)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    base, passage = say(120), say(70)
    texts = [say(rnd.randint(1, 150)) for _ in range(n)]
    texts += [base] * 7 + [base + " tail " + say(2) for _ in range(5)] + [base.upper()]
    texts += [f"{say(20)} {passage}\n{say(15)}" for _ in range(6)] + [say(3), "", None, " \t\n ", "x", "x y", "x y", "é" * 5]
    texts += ["ab " * 300, "ab " * 260, say(5000), say(30) + " " + say(3), "one\x0btwo\x0cthree four"]
    rows = [[i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", "c", "Z", None])] for i, t in enumerate(texts)]
    rows += [list(rows[3]), list(rows[n + 1])]  # rows that repeat
    rnd.shuffle(rows)
    return [tuple(r) for r in rows]


def frame(spark, rows):
    """documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "shard", "kept", 5) for r in rows], SCHEMA)


def shingles(text, k):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = words(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_components(rows, k=4, percent=80):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def removed_words(rows, window=50):
    first = {}
    for d, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def base_counts(text, window=8):
    w = words(text)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    hit = [False] * len(w)
    for i in range(len(w) - window + 1):
        if c[tuple(w[i : i + window])] > 1:
            hit[i : i + window] = [True] * window
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, sum(hit)


def water_fill(sizes, weights=(5, 2, 1), percent=150, repeats=2):
    """Targets by the contract's own words: share, cap, reshare until none is above."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), sum(sizes.values()) * percent / 100, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > repeats * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        free -= over
    return target


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out
