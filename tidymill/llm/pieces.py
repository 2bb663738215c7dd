"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidymill.llm.common import mixed, slices, texts

MARK = "▁"  # stands for a space in pieces
LONG_UNIT = 128  # characters from which a unit has an agenda of its own
SCALE = 1 << 20
OFTEN = 4  # occurrences in a slice from which a unit's are compared, so that those cut alike are merged once
DRAWS = 1 << 19  # candidates whose hashes are held at once
SLICE = 1 << 19  # bytes of text encoded at once
KNOWN = 1 << 16  # units whose candidates a worker remembers


@dataclass(frozen=True)
class Pieces:
    """Merge-type pieces, their ranks and the tables that encoding looks up."""

    texts: list[bytes]
    ranks: np.ndarray  # the lower, the earlier merged
    single: np.ndarray  # piece of each code point, -1: none
    bytes_: np.ndarray  # piece of each byte
    keys: np.ndarray  # left * 2^32 + right, of all pairs that join to a piece, by hash (-1: nothing there)
    joins: np.ndarray
    longer: dict[str, int]  # pieces of several characters by their names
    longest: int
    known: dict[str, np.ndarray] = field(default_factory=dict)  # candidates of units seen before

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of two neighbours, -1 where there is none."""
        key = (left << 32) | right  # negative if one of them is no piece
        at = _slot(key, len(self.keys))
        there = self.keys[at]
        out = np.where(there == key, self.joins[at], -1)
        # another pair stands there: the next places up to an empty one
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            there = self.keys[at[more]]
            hit = there == key[more]
            out[more[hit]] = self.joins[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out

    def candidates(self, unit: str) -> np.ndarray:
        """Hashes of all merges a unit can have."""
        out = self.known.get(unit)
        if out is None:
            places, found = [], []
            for i in range(len(unit) - 1):
                for j in range(i + 2, min(i + self.longest, len(unit)) + 1):
                    piece = self.longer.get(unit[i:j])
                    if piece is not None:
                        places.append(i)
                        found.append(piece)
            if len(self.known) >= KNOWN:
                self.known.clear()
            out = self.known[unit] = _candidate(np.array(places, np.int64), np.array(found, np.int64))
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    """The first place of a pair among ``size`` (a power of two)."""
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).view(np.int64)


def _by_hash(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and what they join to, each at the first free place from its own on; at most one place in four is taken."""
    size = 1 << (4 * len(pairs) + 1).bit_length()
    keys, joins = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    left = np.array(sorted(pairs), np.int64)
    at = _slot(left, size)
    while len(left):
        free = np.flatnonzero(keys[at] < 0)
        put = free[np.unique(at[free], return_index=True)[1]]
        keys[at[put]] = left[put]
        joins[at[put]] = [pairs[k] for k in left[put].tolist()]
        stay = np.ones(len(left), bool)
        stay[put] = False
        left, at = left[stay], (at[stay] + 1) & (size - 1)
    return keys, joins


@cache
def load_pieces(path: str) -> Pieces:
    """Read a model of the merge type with byte pieces, once per Python worker."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(count)]
    special = {i for i in range(count) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    ids = {name: i for i, name in enumerate(names) if i not in special}
    single = np.full(0x110000, -1, np.int64)
    pairs = {}
    for name, i in ids.items():
        if len(name) == 1:
            single[ord(name)] = i
        for cut in range(1, len(name)):
            left, right = ids.get(name[:cut]), ids.get(name[cut:])
            if left is not None and right is not None:
                pairs[(left << 32) | right] = i
    raw = [b"" if i in special else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    for b, i in enumerate(byte_ids):
        raw[i] = bytes([b])
    ranks = np.array([-model.get_score(i) for i in range(count)], np.float64)
    keys, joins = _by_hash(pairs)
    longer = {name: i for name, i in ids.items() if len(name) > 1}
    return Pieces(raw, ranks, single, byte_ids, keys, joins, longer, max(map(len, longer), default=0))


def _candidate(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return mixed(place.astype(np.uint64) * np.uint64(SCALE) + piece.astype(np.uint64))


def _skips(unit_key: np.ndarray, candidate: np.ndarray, dropout: float) -> np.ndarray:
    return (mixed(unit_key ^ candidate) >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def skipped(unit_key: np.ndarray, place: np.ndarray, piece: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the keyed hash of a candidate (its unit's key, first character and piece) skips the merge."""
    return _skips(unit_key, _candidate(place, piece), dropout)


def _patterns(units: list[str], same: np.ndarray, keys: np.ndarray, pieces: Pieces, dropout: float) -> np.ndarray:
    """A hash of the set of candidates that each occurrence skips, of all that its unit (``units[same]``) can have.

    Occurrences that skip the same ones are cut alike, so one of them can be merged for all.
    """
    own = [pieces.candidates(unit) for unit in units]
    candidates, sizes = np.concatenate(own), np.array([len(x) for x in own], np.int64)
    begin, sizes = (np.cumsum(sizes) - sizes)[same], sizes[same]
    ends = np.cumsum(sizes)
    out, first = np.zeros(len(same), np.uint64), 0
    while first < len(same):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + DRAWS, side="right")))
        block = slice(first, last)
        owners = np.repeat(np.arange(first, last), sizes[block])
        at = np.arange(len(owners)) + np.repeat(begin[block] - ends[block] + sizes[block] + done, sizes[block])
        drawn = candidates[at]
        hit = np.flatnonzero(_skips(keys[owners], drawn, dropout))
        if len(hit):
            owners = owners[hit]
            starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            out[owners[starts]] = np.add.reduceat(drawn[hit], starts)
        first = last
    return out


def agenda(symbols: list[int], unit_key: int, pieces: Pieces, dropout: float) -> list[int]:
    """Merge one unit: the best candidate first, the leftmost of equals; candidates the hash skips are passed over."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    now: list[int | None] = list(symbols)
    key = np.array([unit_key], np.uint64)
    queue: list[tuple[float, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if 0 <= i else len(now)
        if i < 0 or j >= len(now):
            return
        piece = int(pieces.join(np.array([now[i]]), np.array([now[j]]))[0])
        if piece >= 0:
            heapq.heappush(queue, (pieces.ranks[piece], i, piece, now[i], now[j]))

    for i in range(len(symbols)):
        offer(i)
    while queue:
        _, i, piece, left, right = heapq.heappop(queue)
        j = after[i]
        if now[i] != left or j >= len(now) or now[j] != right:
            continue
        if dropout and skipped(key, np.array([i]), np.array([piece]), dropout)[0]:
            continue
        now[i], now[j], after[i] = piece, None, after[j]
        if after[j] < len(now):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [x for x in now if x is not None]


def _merge_all(symbols: np.ndarray, units: np.ndarray, places: np.ndarray, keys: np.ndarray, pieces: Pieces, dropout: float):
    """The same agenda for many units at once: each round pops the best candidate of every unit that has one."""
    done = [(units[:0], symbols[:0])]
    joins, ranks = np.full(len(symbols), -1, np.int64), np.full(len(symbols), np.inf)

    def offer(at: np.ndarray) -> None:
        """Candidates that begin at these symbols, without those the hash skips."""
        inside = at[at + 1 < len(symbols)]
        inside = inside[units[inside] == units[inside + 1]]
        joins[at], ranks[at] = -1, np.inf
        found = pieces.join(symbols[inside], symbols[inside + 1])
        inside, found = inside[found >= 0], found[found >= 0]
        if dropout and len(inside):
            wanted = ~skipped(keys[units[inside]], places[inside], found, dropout)
            inside, found = inside[wanted], found[wanted]
        joins[inside], ranks[inside] = found, pieces.ranks[found]

    offer(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
        sizes = np.diff(np.append(starts, len(units)))
        best = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
        live = best < np.inf
        at = np.flatnonzero((ranks == best) & live)
        at = at[np.concatenate([[True], units[at[1:]] != units[at[:-1]]])] if len(at) else at
        symbols[at] = joins[at]
        done.append((units[~live], symbols[~live]))
        stay = live.copy()
        stay[at + 1] = False
        moved = (np.cumsum(stay) - 1)[at]
        symbols, units, places, joins, ranks = (x[stay] for x in (symbols, units, places, joins, ranks))
        offer(moved)
        left = moved[moved > 0] - 1
        offer(left[units[left] == units[left + 1]])
    owners, out = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(owners, kind="stable")
    return owners[order], out[order]


def _spelt(ids: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the characters that have no piece (negative: -code point - 1) in byte pieces, and where each begins."""
    at = np.flatnonzero(ids < 0)
    codes = -ids[at] - 1
    tails = (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    sizes = np.ones(len(ids), np.int64)
    sizes[at] += tails
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out, begin = np.repeat(ids, sizes), bounds[at]
    lead = np.array([0, 0xC0, 0xE0, 0xF0])[tails]
    out[begin] = pieces.bytes_[lead | (codes >> 6 * tails)]
    for i in range(1, 4):
        more = tails >= i
        out[begin[more] + i] = pieces.bytes_[0x80 | (codes[more] >> 6 * (tails[more] - i) & 0x3F)]
    return out.astype(np.uint32), bounds


def encode_all(strings: list[str], drawn: np.ndarray, pieces: Pieces, seed: int, dropout: float) -> list[np.ndarray]:
    """Ids of each text. A unit is a run of spaces with what follows; each has draws of its own, by the seed, the
    number ``drawn`` of its text and its place there."""
    lengths = np.array([len(t) + 1 if t else 0 for t in strings], np.int64)
    whole = "".join(" " + t for t in strings if t)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not len(codes):
        return [np.zeros(0, np.uint32) for _ in strings]
    space = codes == 32
    starts_at = np.cumsum(lengths) - lengths
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[starts_at[lengths > 0]] = True
    # a mark that stands in the text itself is spelt in bytes, so that decoding tells it from a space
    symbols = np.where(space, pieces.single[ord(MARK)], np.where(codes == ord(MARK), -1, pieces.single[codes]))
    symbols = np.where(symbols < 0, -codes - 1, symbols)
    unit_starts = np.flatnonzero(begin)
    sizes = np.diff(np.append(unit_starts, len(codes)))
    units = np.repeat(np.arange(len(unit_starts)), sizes)
    places = np.arange(len(codes)) - unit_starts[units]
    doc_of_unit = np.searchsorted(starts_at[lengths > 0], unit_starts, side="right") - 1
    sums = np.add.reduceat(mixed(codes.astype(np.uint64) + mixed(places.astype(np.uint64) + np.uint64(9))), unit_starts)
    alike = mixed(sums)
    keys = np.zeros(len(unit_starts), np.uint64)
    if dropout:
        text_keys = mixed(drawn[np.flatnonzero(lengths > 0)].astype(np.uint64) + np.uint64(seed * 65537 + 1))
        keys = mixed(text_keys[doc_of_unit] + (unit_starts - starts_at[lengths > 0][doc_of_unit]).astype(np.uint64))
        _, first, same, often = np.unique(alike, return_index=True, return_inverse=True, return_counts=True)
        often = (often >= OFTEN) & (sizes[first] < LONG_UNIT)
        spelt = [
            whole[a : a + n].replace(MARK, "\0").replace(" ", MARK) if b else ""
            for a, n, b in zip(unit_starts[first].tolist(), sizes[first].tolist(), often.tolist(), strict=True)
        ]
        # long and rare units are merged one by one
        alike = mixed(alike + np.where(often[same], _patterns(spelt, same, keys, pieces, dropout), keys))
    # units that are spelt alike and skip alike share a 64-bit hash: one of them is merged for all
    unique, first, same = np.unique(alike, return_index=True, return_inverse=True)
    short = sizes[first] < LONG_UNIT
    number = np.full(len(unit_starts), -1, np.int64)
    number[first] = np.arange(len(first))
    chosen = number[units] >= 0
    small = chosen & short[np.maximum(number[units], 0)]
    owners, out = _merge_all(symbols[small].copy(), number[units][small], places[small], keys[first], pieces, dropout)
    for n in np.flatnonzero(~short):
        at = unit_starts[first[n]]
        ids = np.array(agenda(symbols[at : at + sizes[first[n]]].tolist(), int(keys[first[n]]), pieces, dropout), np.int64)
        owners, out = np.concatenate([owners, np.full(len(ids), n)]), np.concatenate([out, ids])
    order = np.argsort(owners, kind="stable")
    owners, out = owners[order], out[order]
    bounds = np.searchsorted(owners, np.arange(len(unique) + 1))
    counts = np.diff(bounds)[same]
    total = np.cumsum(counts)
    take = np.arange(int(total[-1])) - np.repeat(total - counts, counts) + np.repeat(bounds[:-1][same], counts)
    ids = out[take]
    ends = np.searchsorted(doc_of_unit, np.arange(int((lengths > 0).sum())), side="right")
    doc_ends = total[ends - 1]
    ids, bounds = _spelt(ids, pieces)
    doc_ends = bounds[doc_ends]
    result, at, row = [], 0, 0
    for size in lengths:
        if not size:
            result.append(np.zeros(0, np.uint32))
            continue
        result.append(ids[at : doc_ends[row]])
        at, row = int(doc_ends[row]), row + 1
    return result


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ids: pieces and bytes in a row, without the space before the first word."""
    return b"".join(map(pieces.texts.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def encode_pieces(
    docs: DataFrame,
    load: Callable[[], Pieces],
    dropout: float = 0.1,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, ids`` (little-endian 32-bit) for every row.

    Merges follow the model's ranks, but each candidate is skipped when a hash of the seed, the id, the place of its
    unit in the text, its place there and its piece falls below ``dropout``, so each occurrence of a word is drawn by
    itself. The same seed always gives the same ids. Dropout 0 is the plain encoding. Decoding gives back the text whatever was skipped.

    Defined cases: null and empty texts have no ids. Characters without a piece, and the mark for spaces itself, are
    spelt in byte pieces. Rows are encoded alone: repeated rows agree, a null id counts as 0. Units of any length
    are merged whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load()
        for part in slices(batches, limit=SLICE):
            drawn = mixed(part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(seed))
            found = encode_all(part.column("text").to_pylist(), drawn, pieces, seed, dropout)
            raw = [x.astype("<u4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in found], pa.int64())]
                + [pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                ["doc_id", "n_tokens", "ids_crc32", "ids"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def decode_pieces(encoded: DataFrame, load: Callable[[], Pieces]) -> DataFrame:
    """``encoded`` with a column ``text`` decoded from ``ids`` (null ids: null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load()
        for part in slices(batches, "ids", 1 << 20):
            out = [None if x is None else decode(np.frombuffer(x, "<u4"), pieces) for x in part.column("ids").to_pylist()]
            yield part.append_column("text", pa.array(out, pa.string()))

    return encoded.mapInArrow(run, encoded.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", text string")
