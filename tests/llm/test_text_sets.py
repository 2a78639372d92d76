"""Jaccard join and substring removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from dyadic.llm import jaccard, substrings


def _shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _components(rows):
    sets, n = [_shingles(t) for _, t in rows], len(rows)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    root = [find(i) for i in range(n)]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out, [r for r, s in zip(root, sets, strict=True) if s], sets


def _copies(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    doc = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage, out = doc(60), []
    for _ in range(5):
        base = doc(rnd.randrange(30, 150))
        now = base[:]
        for _ in range(rnd.randrange(3, 20)):
            if rnd.random() < 0.5:
                now = base[:]
            for _ in range(rnd.randrange(0, 4)):
                now[rnd.randrange(len(now))] = rnd.choice(vocab)
            out.append(" ".join(now))
    for _ in range(25):
        a = doc(rnd.randrange(10, 120))
        out += [" ".join(a + passage + doc(30)), " ".join(a[:5] + passage + a[5:8])]
    return out


@pytest.mark.parametrize("seed,levels,many,cell", [(1, (16, 256, 4096), 32, 1024), (2, (2, 4, 8), 2, 4)])
def test_jaccard_components(docs_of, edge_texts, monkeypatch, seed, levels, many, cell):
    for name, value in (("LEVELS", levels), ("MANY", many), ("CELL", cell)):
        monkeypatch.setattr(jaccard, name, value)
    docs = docs_of(edge_texts + _copies(seed))
    docs = docs.union(docs.limit(1))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want, roots, sets = _components(rows)
    got = [tuple(r) for r in jaccard.join(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    left = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    assert len(left) == len(set(roots)) + sum(not s for s in sets)
    _, left_roots, _ = _components(left)
    assert len(left_roots) == len(set(left_roots))


def test_jaccard_empty_table(docs_of, edge_texts):
    docs = docs_of(edge_texts).limit(0)
    assert jaccard.join(docs).count() == 0 and jaccard.keep_one(docs).count() == 0


def test_profile_distance_is_a_lower_bound():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rnd.choices(words, k=n)) for n in (10, 300, 300, 2500, 3000)]
    texts.append(texts[-1] + " end")
    sets = [jaccard.shingles(t) for t in texts]
    for a in sets:
        for b in sets:
            real = len(set(a.tolist()) ^ set(b.tolist()))
            assert jaccard.profile_distances([jaccard.profile(a)], [jaccard.profile(b)])[0] <= real


def test_shingles_do_not_depend_on_segments(monkeypatch):
    text = "Ab c\nd  e f g é h " * 300
    want = jaccard.shingles(text)
    monkeypatch.setattr(jaccard, "SEGMENT", 7)
    assert (jaccard.shingles(text) == want).all()


def _cut(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _passages():
    rnd = random.Random(5)
    words = lambda n: "".join(rnd.choice(["the ", "of ", "aé ", "ion", "z", "qq ", "\n"]) for _ in range(n))
    base, out = [words(300) for _ in range(5)], []
    for _ in range(45):
        a = rnd.choice(base)
        p = rnd.randrange(len(a))
        t = words(rnd.randrange(120)) + a[p:p + rnd.choice([150, 199, 200, 201, 260, 500])] + words(rnd.randrange(120))
        out.append(t)
        if rnd.random() < 0.2:
            out.append(t)
        if rnd.random() < 0.3:
            k = rnd.randrange(len(t))
            out.append(t[:k] + "X" + t[k + 1:])
    return out


@pytest.mark.parametrize("options", [{}, {"CROWD": 3}, {"SHARD_BYTES": 3000}])
def test_repeated_substrings(docs_of, edge_texts, monkeypatch, options):
    whole = substrings.repeated_ranges
    monkeypatch.setattr(substrings, "repeated_ranges", lambda d, n: whole(
        d, n, crowd=options.get("CROWD", substrings.CROWD), shard_bytes=options.get("SHARD_BYTES", substrings.SHARD_BYTES)))
    texts = edge_texts + _passages()
    docs = docs_of(texts)
    got = substrings.cut_repeats(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(_cut(texts))


def test_without_repeats_keeps_rows_and_columns(docs_of, edge_texts):
    texts = edge_texts + _passages()
    docs = docs_of(texts)
    out = substrings.without_repeats(docs)
    assert out.schema == docs.schema
    cut = _cut(texts)
    want = sum(1 for t, c in zip(texts, cut, strict=True) if c[1] < c[0] or c[0] == 0)
    assert abs(out.count() - want) <= sum(0 < c[0] - c[1] < 4 for c in cut)
    untouched = sorted(t or "" for t, c in zip(texts, cut, strict=True) if not c[1])
    left = [r[0] or "" for r in out.select("text").collect()]
    assert all(t in left for t in untouched)
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_matching_statistics_of_the_run_length_index():
    rnd = random.Random(9)
    strings = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(5, 40))) for _ in range(30)})
    index = substrings.RunLengthIndex(strings, 4)
    text = b"\0".join(strings) + b"\0"
    stats = index.matching_statistics()
    for i in range(len(text)):
        best = max((next((k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), 0)
                    for j in range(len(text)) if j != i))
        rest = text.index(b"\0", i) - i  # beyond a string's end matches mean nothing
        assert min(stats[i], rest) == min(best, rest), i
    assert len(index.run) < len(text)


def test_blocks_give_links_not_pairs():
    """Near copies that do not link give no rows, ones that do at most one less
    than members, and the components are those of all pairs."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 40, 400).astype(np.uint64)
    for edits in (5, 30, 60, 140):
        sets = []
        for _ in range(80):
            s = base.copy()
            s[rnd.choice(400, edits, replace=False)] = rnd.integers(0, 1 << 40, edits)
            sets.append(np.unique(s))
        n = np.array([len(s) for s in sets])
        c, cells = np.arange(80), [np.array([1], np.int64)] * 80
        links = jaccard._links_of_blocks(np.zeros(80, np.int64), True, c, c, n, cells, sets)
        assert len(links) <= 79
        want = {(i, j) for i in range(80) for j in range(i + 1, 80)
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        assert set(links) <= want

        def groups(pairs):
            label = list(range(80))
            for a, b in pairs:
                label = [label[b] if x == label[a] else x for x in label]
            return [label.index(x) for x in label]
        assert groups(links) == groups(want)
        # members that no cell has left together are not compared
        apart = jaccard._links_of_blocks(np.zeros(80, np.int64), True, c, c, n, [np.array([i], np.int64) for i in range(80)], sets)
        assert apart == []


def _smallest_reached(links):
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_few_links_take_few_jobs(spark):
    """The driver holds plans and threads of every job: a long chain of links
    settles inside its partition, not in a round of joins per doubling."""
    rnd = random.Random(3)
    names = rnd.sample(range(-10**9, 10**9), 130)
    links = list(zip(names[:100], names[1:101], strict=True)) + [(names[k], names[k + 1]) for k in range(101, 129, 3)]
    links += [links[0], links[0][::-1], (names[129], names[129])]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup("few-links", "components")
    try:
        got = jaccard.components(df).collect()
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert {r["c"]: r["comp"] for r in got} == _smallest_reached(links) and len(got) == 121
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 8
    assert jaccard.components(df.filter("a is null")).collect() == []


def test_components_across_partitions(spark, monkeypatch):
    """Links of more than one partition go on in rounds of joins."""
    monkeypatch.setattr(jaccard, "ROWS", 8)
    rnd = random.Random(4)
    names = rnd.sample(range(10**6), 60)
    links = [(names[k], names[k + 1]) for k in range(59) if k % 20 != 19]
    rnd.shuffle(links)
    got = jaccard.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()
    assert {r["c"]: r["comp"] for r in got} == _smallest_reached(links) and len(got) == 60


def test_joins_on_classes_broadcast_nothing(docs_of):
    """Small tables joined by class stay out of the driver's memory."""
    docs = docs_of(_copies(1)[:40])
    j = jaccard._Join(docs)
    sets = j.sets_of(j.classes.select("c").limit(3))
    assert sets.count() == 3
    sets.collect()
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
