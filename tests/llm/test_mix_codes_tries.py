"""Conversation tries, vector codes and source mixing against brute force, and on nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidymill.llm import tries
from tidymill.llm.codes import vector_codes
from tidymill.llm.mixing import fit_counts, mix_sources
from tidymill.llm.tries import conversation_trie, rebuilt_turns

WORD = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, place string, key string"
VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error string, vector string"
DOCS = "doc_id bigint, text string, source string, size string, target string, key string, n bigint"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- conversations ----------------------------------------------------------------------------

TRIE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(turns):
    """All nodes by walking every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[: d - 1]].add(p[:d])
        ends[p].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own_cost = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = own_cost + sum(saved[x] for x in children[node])
    return sorted(
        (
            (
                min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
                hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
            for node, m in members.items()
        ),
        key=repr,
    )


def conversations(seed: int):
    """Families with common beginnings, a large group of copies, one very long conversation with a fork deep inside."""
    draw, out = np.random.default_rng(seed), []
    say = [f"{'word ' * (i % 4)}{i}" for i in range(6)]
    for c in range(-3, 150):
        length = int(draw.integers(1, 9))
        out += [(c, t, "user" if t % 2 else None, say[int(draw.integers(0, 3))]) for t in range(length)]
    out += [(c, t, "user", say[t]) for c in range(2000, 2300) for t in range(3)]
    for c, fork in ((400, 999), (420, 150), (440, 64), (460, 128), (480, 192)):
        out += [(c, t, "user", say[t % 5] if t < fork else "other") for t in range(min(210, fork + 8))]
    out += [(500, t, "user", say[t % 5]) for t in range(64)] + [(520, t, "user", say[t % 5]) for t in range(128)]
    out += [(600, None, "a", "null first"), (600, 1, "a", None), (600, 1, "a", "tie"), (600, 1, "a", "tie"), (600, 2, None, "")]
    return out + [(None, 1, "user", "of no conversation"), (700, 5, "x", ""), (39, 0, None, None)]


def trie_of(spark, turns, **sizes):
    frame = spark.createDataFrame([(*t, "x", "y", "z") for t in turns], TURNS)
    return rows_of(conversation_trie(*rebuilt_turns(frame), **sizes), *TRIE_COLUMNS)


def test_trie_equals_brute_force(spark):
    turns = conversations(3)
    assert trie_of(spark, turns) == brute_trie(turns)


def test_trie_with_short_segments_and_many_shards(spark):
    turns = conversations(5)
    assert trie_of(spark, turns, segment=3, shard_turns=40) == brute_trie(turns)


def test_trie_of_nothing_and_of_one(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    assert trie_of(spark, [(7, 1, "user", "x")]) == brute_trie([(7, 1, "user", "x")])


def test_splitters_are_in_the_skeleton_and_only_their_prefixes():
    head = bytes(tries.HEAD)
    a, b = head + b"a" * 16 + b"b" * 16, head + b"a" * 16 + b"c" * 16
    skeleton = tries.Skeleton([a, b])
    assert skeleton.parents == [-1, 0, 1, 1] and skeleton.levels == [0, 1, 2, 2]


# --- vectors ----------------------------------------------------------------------------------

CODE_COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def brute_codes(rows, entries=64, parts=16):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fit = [r for r in ordered if r[1] and len(r[1]) % parts == 0]
    dim = len(fit[0][1])
    ints = [(i, [min(max(math.floor(256 * x), -(1 << 24)), 1 << 24) for x in v], label) for i, v, label in fit if len(v) == dim]
    w = dim // parts
    book = [[v[p * w : p * w + w] for _, v, _ in ints[:entries]] for p in range(parts)]

    def nearest(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book[p]]
        return far.index(min(far)), min(far)

    for _ in range(2):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in ints:
                groups[nearest(p, v[p * w : p * w + w])[0]].append(v[p * w : p * w + w])
            for e, members in groups.items():
                book[p][e] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    found = []
    for i, v, label in ints:
        best = [nearest(p, v[p * w : p * w + w]) for p in range(parts)]
        found.append((i, "".join(f"{b:02x}" for b, _ in best), sum(d for _, d in best), label))
    found += [(i, None, None, label) for i, v, label in kept if len(v) != dim]
    totals = Counter()
    for _, _, error, label in found:
        totals[label] += error or 0
    coded = {label for _, code, _, label in found if code}
    return sorted(((i, c, e, totals[label] if label in coded else None, digest) for i, c, e, label in found), key=repr)


def vectors_of(seed: int, n: int, dim: int = 32):
    draw = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in draw.normal(0, 0.1, dim)], int(draw.integers(0, 3))) for i in draw.permutation(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.0] * (dim - 1), 1), (n + 2, [float("nan")] * dim, 2), (n + 3, [float("inf")] * dim, None)]
    rows += [(n + 4, [0.0] * dim, None), (n + 5, [0.0] * dim, None), (0, [0.5] * dim, 0), (None, [0.25] * dim, 9), (n + 6, [0.1] * 16, 1)]
    return rows + [(n + 7, [], 1), (n + 8, [0.1] * 5, 7), (n + 9, [3.0e38, -3.0e38] + [1e-30] * (dim - 2), 4)]


def codes_of(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in rows], VECTORS)
    return rows_of(vector_codes(frame, **options), *CODE_COLUMNS)


def test_codes_equal_brute_force(spark):
    rows = vectors_of(1, 300)
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = brute_codes(single)
    assert codes_of(spark, rows) == want
    assert codes_of(spark, rows, block_rows=7) == want


def test_codes_of_few_equal_and_no_vectors(spark):
    few = [(i, [0.1 * i] * 16, i) for i in range(5)]
    assert codes_of(spark, few) == brute_codes([(i, [float(np.float32(x)) for x in v], label) for i, v, label in few])
    equal = [(i, [1.0] * 16, None) for i in range(100)]
    assert codes_of(spark, equal) == brute_codes(equal)
    assert codes_of(spark, []) == [] and codes_of(spark, [(1, None, 1)]) == []


# --- mixing -----------------------------------------------------------------------------------


def brute_targets(sizes: dict) -> dict:
    """Shares by weight, stopped at three times the source, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= above


def mixed_docs(seed: int):
    draw = np.random.default_rng(seed)
    rows = [(i, "w " * int(draw.integers(0, 40)), f"s{int(draw.integers(0, 5)) ** 2}") for i in range(600)]
    rows += [(1000 + i, "same length", "s0") for i in range(400)] + [(5000, "a  b\tc", "tiny"), (5001, "x " * 5000, "long")]
    return rows + [(6000, None, "void"), (6001, "", None), (6002, "of null", None), (None, "no id here", ""), (6003, "twice", "s1"), (6003, "twice", "s1")]


def mix_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], DOCS)
    return rows_of(mix_sources(frame), "doc_id", "size", "source_size", "target", "taken")


def test_mix_meets_targets(spark):
    rows = mixed_docs(2)
    found = mix_of(spark, rows)
    assert found == mix_of(spark, rows[::-1])
    sizes, source = Counter(), {}
    for i, text, s in rows:
        sizes[s] += len(WORD.findall(text or ""))
        source[i] = s
    want, taken, docs = brute_targets(sizes), Counter(), Counter()
    for i, size, source_size, target, words in found:
        s = source[i]
        assert source_size == sizes[s] and target == pytest.approx(want[s])
        assert words == 0 if size == 0 else words % size == 0 and 0 <= words <= 3 * size
        taken[s] += words
        docs[i, size] += 1
    assert docs == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    # every source but the one of a single long document can be met to the word
    assert {s: abs(taken[s] - want[s]) <= 1 for s in want if s != "long"} == dict.fromkeys(set(want) - {"long"}, True)
    assert abs(taken["long"] - want["long"]) <= 2500


def test_mix_of_nothing(spark):
    assert mix_of(spark, []) == []
    assert mix_of(spark, [(1, None, "a"), (2, " ", None)]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mix_of(spark, [(1, "all of it", None)]) == [(1, 3, 3, 3.0, 3)]


def test_fit_counts_equals_exhaustive_search():
    draw = np.random.default_rng(7)
    sizes, have = np.arange(1, 300), np.arange(300, 1, -1)
    for table in (10, 500, 1 << 16):
        take = fit_counts(sizes, have, 1_234_567, table)
        assert (take <= have).all() and (sizes * take).sum() == 1_234_567
    for _ in range(150):
        sizes = draw.choice(np.arange(2, 40), int(draw.integers(1, 6)), replace=False)
        have = draw.integers(1, 5, len(sizes))
        budget = int(draw.integers(0, int((sizes * have).sum()) + 3))
        take = fit_counts(sizes, have, budget)
        assert (take >= 0).all() and (take <= have).all()
        sums = {0}
        for s, h in zip(sizes, have):
            sums = {x + int(s) * k for x in sums for k in range(int(h) + 1)}
        assert abs(int((sizes * take).sum()) - budget) == min(abs(x - budget) for x in sums)
