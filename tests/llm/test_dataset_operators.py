"""Conversation repair, Merkle manifest and source mixing against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from dyadic.llm import merkle, mixing, repair

WORD = re.compile("[^\x20\x09-\x0D]")


# ---------------------------------------------------------------- conversations
def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def brute_edits(rows):
    """Dijkstra-free search: least (cost, audit, lines) by dynamic programming
    over whole audits, states as strings put out so far reduced to what matters."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        if not WORD.search(text):
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        elif WORD.findall(text)[-1] not in ".!?":
            kinds.append("truncated")
        else:
            kinds.append("")
        seen.add((role, text))

    def accepts(initials):
        return re.fullmatch("(s?(ua)+)?", initials)

    # states: role initials put out so far, folded to "", s, u, a
    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))
    table = {"": (0, "", ())}

    def inserts(table):
        table = dict(table)
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    to = step(state, role[0])
                    if to:
                        new = (cost + 2, audit + "I", lines + (role + ":",))
                        table[to] = min(table.get(to, new), new)
        return table
    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        table, new = inserts(table), {}
        for state, (cost, audit, lines) in table.items():
            options = [(state, (cost + 3, audit + "D", lines))]
            if kind not in ("blank", "duplicate"):
                more = kind == "truncated"
                options.append((step(state, role[:1]), (cost + more, audit + "K", lines + (f"{role}:{text}",))))
                options += [(step(state, x[0]), (cost + 2 + more, audit + "R", lines + (f"{x}:{text}",))) for x in ("user", "assistant")]
            for to, value in options:
                if to is not None:
                    new[to] = min(new.get(to, value), value)
        table = new
    table = inserts(table)
    best = min(v for s, v in table.items() if s in ("", "a"))
    assert accepts("".join(x[0] for x in best[2]))
    return kinds, best


def brute_repair(conv):
    out = []
    for c in {r[0] for r in conv}:
        rows = damage([r for r in conv if r[0] == c])
        kinds, (cost, audit, lines) = brute_edits(rows)
        turns = [r[1] for r in rows if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, part int, cost string"


def conversations(n, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 5, 9, 30 if c % 10 == 0 else 3])):
            rows.append((c if c % 7 else None, rnd.choice([t, t, t, None, t + 3]), rnd.choice(["user", "assistant", "system", None, "", "tool", "user"]),
                         rnd.choice([None, "", "  \n", "Yes.", "no", "Same words here!", f"text {t}?", "é" * 40 + ". ", "x" * 5000 if t == 2 else "?"])))
    return rows + rows[:5]


@pytest.mark.parametrize("block", [3, 20_000])
def test_repair_is_the_least_audit(spark, block):
    rows = conversations(60, 5)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in repair.damage_and_repair(df, block).collect()), key=repr)
    assert got == brute_repair(rows)


def test_one_long_conversation_spans_blocks_and_partitions(spark):
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), f"line {t}{rnd.choice(['.', ''])}") for t in range(700)]
    rows += [(2, 0, "user", "Hello."), (2, 1, "assistant", "Hi.")]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA).repartition(5)
    for block in (10, 64):
        got = sorted((tuple(r) for r in repair.damage_and_repair(df, block).collect()), key=repr)
        assert got == brute_repair(rows)


def test_copies_of_one_row(spark):
    rows = [(4, 1, "user", "Again.")] * 500 + [(4, 2, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in repair.damage_and_repair(df, 40).collect()), key=repr)
    assert got == brute_repair(rows)


def test_empty_conversations(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranks_choose_among_equal_costs():
    # two rows of the wrong role: either may be deleted, rerolled or surrounded
    for tokens in ("uu", "aa", "xx", "U", "sss", "dada", "usua", "AuUa"):
        cost, audits, _ = repair.cheapest(tokens)
        best = None
        for n in range(2 * len(tokens) + 4):
            for audit in itertools.product("DIKR", repeat=n):
                c, i, s = 0, 0, 0
                for e in audit:
                    if e == "I":
                        c, s = c + 2, repair.NEXT[s]
                        continue
                    options = {o[0]: o for o in repair.CHOICES[tokens[i]][s]} if i < len(tokens) else {}
                    if e not in options:
                        break
                    c, s, i = c + options[e][1], options[e][2], i + 1
                else:
                    if i == len(tokens) and s in (0, 3):
                        best = min(best or (99, ""), (c, "".join(audit)))
            if n > 7:
                break
        assert (cost[0], audits[0]) == best


# ---------------------------------------------------------------- Merkle manifest
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def brute_tree(nodes, fanout):
    """(root, [sides per level] per node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for p, i in zip(paths, at, strict=True):
            run = runs[i // fanout]
            p.append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
        nodes, at = [H(*run) for run in runs], [i // fanout for i in at]
    return nodes[0], paths


def brute_manifest(docs, fanout):
    by = {}
    for r in docs:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"]), i) for i, r in enumerate(by[s])))
        leaves = [x[2] for x in rows]
        subs[s] = ([by[s][x[3]] for x in rows], leaves, *brute_tree(leaves, fanout))
    root, tops = brute_tree([subs[s][2] for s in names], fanout)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, leaf, path in zip(subs[s][0], subs[s][1], subs[s][3], strict=True):
            path = path + top
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = brute_leaf(r, r["text"] and r["text"].translate(lower)) if hit else leaf
            for a, b in path:
                node = H(a, node, b)
            out.append((r["doc_id"], leaf, subs[s][2], root, H(*[x for side in path for x in side]), node, node == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root long"


def documents(sizes, seed=1):
    rnd = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i if i % 40 else None, s, rnd.choice(["en", None]), rnd.choice([None, 5]),
                         rnd.choice([None, "", "Some Text", "plain", "É Ünder", "long " * 3000]), "clash", 7))
    rows += rows[:2]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("fanout,depth,sizes", [
    (16, 3, {"a": 300, "b": 1, None: 17, "": 16, "é": 2}),
    # many blocks: three and four rounds of the exchange, ragged subtrees, subtrees of a single block
    (2, 1, {"a": 37, "b": 1, "c": 2, None: 5, "d": 16, "e": 9}),
    (3, 1, {"a": 100, "b": 82, "c": 28, "d": 7}),
    (2, 2, {f"s{i}": 1 + i % 3 for i in range(21)}),
])
def test_manifest(spark, monkeypatch, fanout, depth, sizes):
    rows = documents(sizes)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    hit = merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(df, merkle.F.when(hit, merkle.leaf_of(merkle.lowered())), fanout, depth)
    names = DOCS.replace(" long", "").replace(" string", "").split(", ")
    want = brute_manifest([dict(zip(names, r, strict=True)) for r in rows], fanout)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


def test_empty_manifest(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- mixing
def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / max(sum(w[s] for s in names if s not in full), 1e-9)
        more = {s for s in names if 2 * sizes[s] <= level * w[s]}
        if more <= full:
            return {s: 2.0 * sizes[s] if s in full else level * w[s] for s in names}
        full |= more


MIX = "doc_id long, source string, text string, size long, taken string"


def mix_rows(seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        s = rnd.choice(["hot"] * 6 + ["b", None, "", "é"])
        rows.append((i if i % 50 else None, s, rnd.choice([None, "", " \t", "one", "two words\x0bhere", "w " * rnd.randrange(1, 80), "w\n" * 400]), 3, "clash"))
    return rows + [rows[3]] * 40 + [(7000, "big", "x " * 20000, 1, ""), (7001, "big", "y", 1, ""), (7002, "none", None, 1, "")]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, MIX).repartition(5)
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((r[0], size(r[2])) for r in rows if r[0] is not None)
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + size(r[2])
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert len(mine) == sum(r[1] == s for r in rows)
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(abs(r.target - want[s]) <= 1e-9 * (1 + want[s]) for r in mine)
        assert all(r.taken in (0, r.size, 2 * r.size) and r.copies in (0, 1, 2) for r in mine)
        left = want[s] - sum(r.taken for r in mine)
        open_ = [r.size for r in mine if r.size and r.copies < want[s] / max(sizes[s], 1)]
        assert -1e-6 <= left < max(1.0, 0.01 * want[s]) or s == "big" or left < min(open_, default=1)
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_order_is_pareto(spark):
    """A source at half its size: a document's chance is a half, whatever its place."""
    rows = [(i, "a", "w w", 0, "") for i in range(4000)] + [(9000, "b", "w " * 16000, 0, "")]
    got = mixing.mix(spark.createDataFrame(rows, MIX), weights=(1, 5), share=(1, 1)).filter("source = 'a'").collect()
    target = got[0].target
    assert abs(sum(r.taken for r in got) - target) < 2
    taken = [r.taken > 0 for r in sorted(got, key=lambda r: r.doc_id)]
    halves = [sum(taken[i:i + 1000]) / 1000 for i in range(0, 4000, 1000)]
    assert all(abs(h - target / 8000) < 0.08 for h in halves)


def test_preference_moves_chances_and_keeps_the_target(spark):
    rows = [(i, "a", "w w w", 0, "") for i in range(3000)] + [(9000, "b", "w " * 9000, 0, "")]
    df = spark.createDataFrame(rows, MIX).withColumn("pref", mixing.F.expr("CASE doc_id % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 1.0 END"))
    got = mixing.mix(df.withColumn("pref", mixing.F.expr("CASE WHEN source = 'b' THEN 1.0 ELSE pref END")), weights=(1, 2), share=(1, 2), preference="pref")
    got = got.filter("source = 'a'").collect()
    by = [sum(r.taken for r in got if r.doc_id % 3 == k) for k in range(3)]
    assert by[2] == 0 and abs(sum(by) - got[0].target) < 3 and 3 < by[0] / by[1] < 5
    assert all(r.taken <= 2 * r.size for r in got)


def test_empty_mix(spark):
    assert mixing.mix(spark.createDataFrame([], MIX)).count() == 0
