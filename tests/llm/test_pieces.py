"""Characters without a piece, spelt in bytes."""

from __future__ import annotations

import numpy as np

from tidymill.llm import pieces
from tidymill.llm.queries import merge_pieces


def test_bytes_of_missing_characters_in_one_step():
    own = merge_pieces()
    edges = [0x09, 0x0A, 0x7F, 0x80, 0x7FF, 0x800, 0x2581, 0xFFFF, 0x10000, 0x10FFFF]
    ids = np.array([5, *(-c - 1 for c in edges), 7, 7, -0x0A - 1, 9])
    parts = [[x] if x >= 0 else own.bytes_[list(chr(-x - 1).encode())].tolist() for x in ids.tolist()]
    got, bounds = pieces._spelt(ids, own)
    assert got.tolist() == sum(parts, [])
    assert bounds.tolist() == np.cumsum([0, *map(len, parts)]).tolist()
    none, bounds = pieces._spelt(np.zeros(0, np.int64), own)
    assert none.tolist() == [] and bounds.tolist() == [0]


def test_texts_of_missing_characters_keep_their_bounds():
    own = merge_pieces()
    texts = ["", "\n\n", "a\nb", "", "\U0001f9ff x\t▁", "plain words", "\x01"]
    encoded = pieces.encode_all(texts, np.arange(len(texts), dtype=np.uint64), own, 1, 0.2)
    assert [pieces.decode(x, own) for x in encoded] == texts
    assert [len(x) for x in encoded][::3] == [0, 0, len(encoded[6])]


def test_pairs_by_hash_are_those_of_the_vocabulary():
    own = merge_pieces()
    pairs = {(i * 7919 % 5000) << 32 | i * 104729 % 5000: i for i in range(20000)}
    keys, joins = pieces._by_hash(pairs)
    small = pieces.Pieces(own.texts, own.ranks, own.single, own.bytes_, keys, joins, {}, 0)
    rng = np.random.default_rng(5)
    asked = np.concatenate([np.array(list(pairs)), rng.integers(0, 5000, 20000) << 32 | rng.integers(0, 5000, 20000)])
    left, right = asked >> 32, asked & 0xFFFFFFFF
    assert small.join(left, right).tolist() == [pairs.get(k, -1) for k in asked.tolist()]
    assert small.join(np.array([-1, -1, 3]), np.array([-1, 4, -1])).tolist() == [-1, -1, -1]


def test_remembered_candidates_do_not_change_ids(monkeypatch):
    own = merge_pieces()
    texts = ["the station of the nation " * 40, "a nation the the station " * 40]
    drawn = np.array([3, 4], np.uint64)
    first = [x.tolist() for x in pieces.encode_all(texts, drawn, own, 1, 0.3)]
    assert own.known
    monkeypatch.setattr(pieces, "KNOWN", 1)
    own.known.clear()
    assert [x.tolist() for x in pieces.encode_all(texts, drawn, own, 1, 0.3)] == first
    assert len(own.known) == 1
