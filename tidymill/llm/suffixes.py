"""Removal of repeated byte strings by suffix arrays, built by induced sorting in shards of what may repeat."""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidymill.llm.common import seeded, slices, text_bytes, texts
from tidymill.llm.shingles import lowest, sequences

GRAM = 20  # bytes of the run that stands for a window in the sketch
CELL_BITS = 40  # shuffled for each stretch of the text; cells that meet by chance cost work, never a result
SHARD_BYTES = 4 << 20  # of stretches sorted together; a larger cell is split by window
ROW_BYTES = 40  # of a stretch's row, besides its bytes
TAKEN_BYTES = 104  # what a cell takes is counted to the nearest block, about what a stretch takes on average
SLICE = 1 << 19  # bytes of text worked on at once
QUEUE_BYTES = 64 << 20  # of a queue's tuples held in memory
UNKNOWN = 1 << 40  # common prefix of suffixes not told apart yet
PLACE, STEP, TIMES = 31, 12, 20  # bits of a row of equal windows at equal distances


class Queue:
    """Suffix tuples (place, common prefix with the one before) by batch of symbols, first in first out within one.

    Symbols come in order, so this is a priority queue with one list per key; what passes the bound in memory goes to
    an unnamed file.
    """

    def __init__(self) -> None:
        self.runs: dict[int, list] = defaultdict(list)
        self.held, self.file = 0, None

    def push(self, keys: np.ndarray, places: np.ndarray, common: np.ndarray) -> None:
        """Tuples in order of their keys."""
        if not len(places):
            return
        both = np.stack([places, common])
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
        for key, start, end in zip(keys[cuts].tolist(), cuts, [*cuts[1:], len(places)], strict=True):
            self.runs[key].append(both[:, start:end])
        self.held += both.nbytes
        if self.held > QUEUE_BYTES:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for key, runs in self.runs.items():
            for i, run in enumerate(runs):
                if isinstance(run, np.ndarray):
                    at = self.file.tell()
                    self.file.write(np.ascontiguousarray(run, np.int64).tobytes())
                    self.runs[key][i] = (at, run.shape[1])
        self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        out = [np.zeros((2, 0), np.int64)]
        for run in self.runs.pop(key, ()):
            if isinstance(run, tuple):
                self.file.seek(run[0])
                out.append(np.frombuffer(self.file.read(16 * run[1]), np.int64).reshape(2, -1))
            else:
                self.held -= run.nbytes
                out.append(run)
        places, common = np.concatenate(out, axis=1)
        return places, common


def _stored(values: np.ndarray) -> np.ndarray:
    """The same values, in a mapped unnamed file of the task if they pass the bound in memory."""
    if values.nbytes <= QUEUE_BYTES:
        return values
    mapped = np.memmap(tempfile.TemporaryFile(), values.dtype, "w+", shape=values.shape)
    mapped[:] = values
    return mapped


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum of ``values[first..last]`` for many ranges, from minima over doubling spans."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out, span = np.empty(len(first), np.int64), 1
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(values[first[here]], values[last[here] - span + 1])
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return out


def _among(common: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Common prefixes between neighbours of a subset (ascending positions) of suffixes in order."""
    if not len(chosen):
        return common[:0]
    return np.minimum.reduceat(common[: chosen[-1] + 1], np.concatenate([[0], chosen[:-1] + 1]))


def _backwards(places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return places[::-1], np.concatenate([common[:0] if not len(common) else [0], common[1:][::-1]]).astype(np.int64)


def _batches(text: np.ndarray, wanted: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the batch of each symbol, and which batches lead to themselves.

    The suffixes of a batch induce only suffixes of later batches, so they can be taken at once; a symbol that follows
    itself is a batch of its own.
    """
    reach = np.full(count, count, np.int64)
    at = np.flatnonzero(wanted[:-1])
    np.minimum.at(reach, text[at + 1], text[at])
    own = reach == np.arange(count)
    starts, bound = np.zeros(count, bool), 0
    opened = []
    for symbol, (least, loops) in enumerate(zip(np.maximum(reach, np.arange(1, count + 1)).tolist(), own.tolist(), strict=True)):
        if loops or symbol >= bound:
            opened.append(symbol)
            bound = least
        elif least < bound:
            bound = least
    starts[opened] = True
    number = np.cumsum(starts) - 1
    return number, own[opened]


def _induce(text: np.ndarray, wanted: np.ndarray, count: int, run: np.ndarray, given, first: np.ndarray):
    """One sweep over the symbols: the ``wanted`` suffixes in order, each induced by the suffix after it.

    ``given`` are ordered suffixes of the other kind; in a symbol they come after the wanted ones. Returns the wanted
    ones, and both together, with common prefixes. The prefix two induced suffixes share is one longer than what their
    sources share, the minimum over what lies between them; suffixes of different kinds share the shorter run of
    their symbol.
    """
    number, own = _batches(text, wanted, count)
    queue = Queue()
    queue.push(number[text[first]], first, np.zeros(len(first), np.int64))
    given_places, given_common = given
    ends = np.searchsorted(number[text[given_places]], np.arange(len(own) + 1)).tolist()
    small = np.uint16 if count < 1 << 16 else np.int64
    induced, everything = [], []
    for batch, loops in enumerate(own.tolist()):
        places, common = queue.pop(batch)
        if len(places):
            symbols = text[places]
            if len(symbols) > 1 and not (loops or (symbols[1:] >= symbols[:-1]).all()):
                order = np.argsort(symbols.astype(small), kind="stable")
                places, common, symbols = places[order], common[order], symbols[order]
            common[0] = 0
            common[1:][symbols[1:] != symbols[:-1]] = 0
        if loops and len(places):
            parts, now, shared, symbol = [(places, common)], places, common, text[places[0]]
            while True:
                if len(now) == 1:
                    # a lone suffix: its whole run at once
                    back = int(run_length_before(text, run, int(now[0])))
                    chain = now[0] - np.arange(1, back + 1)
                    parts.append((chain, run[chain + 1].astype(np.int64)))
                    break
                chosen = np.flatnonzero((now > 0) & (text[now - 1] == symbol) & wanted[now - 1])
                if not len(chosen):
                    break
                shared = _among(shared, chosen) + 1
                last, now = now[-1], now[chosen] - 1
                shared[0] = min(run[last], run[now[0]])
                parts.append((now, shared))
            places, common = (np.concatenate(x) for x in zip(*parts))
        induced.append((places, common))
        more = slice(ends[batch], ends[batch + 1])
        if more.start < more.stop:
            mine = len(places)
            places = np.concatenate([places, given_places[more]])
            common = np.concatenate([common, given_common[more]])
            symbols = text[places]
            kind = np.arange(len(places)) >= mine
            if mine:
                order = np.argsort(symbols.astype(small), kind="stable")
                places, common, symbols, kind = places[order], common[order], symbols[order], kind[order]
                turn = 1 + np.flatnonzero((kind[1:] != kind[:-1]) & (symbols[1:] == symbols[:-1]))
                common[turn] = np.minimum(run[places[turn - 1]], run[places[turn]])
            common[0] = 0
            common[1:][symbols[1:] != symbols[:-1]] = 0
        everything.append((places, common))
        chosen = np.flatnonzero((places > 0) & wanted[places - 1])
        targets = text[places[chosen] - 1]
        if loops:
            other = targets != text[places[chosen]]
            chosen, targets = chosen[other], targets[other]
        if len(chosen):
            order = np.argsort(targets.astype(small), kind="stable")
            chosen, targets = chosen[order], targets[order]
            shared = np.ones(len(chosen), np.int64)
            same = 1 + np.flatnonzero(targets[1:] == targets[:-1])
            shared[same] += _least(common, chosen[same - 1] + 1, chosen[same])
            queue.push(number[targets], places[chosen] - 1, shared)
    return tuple(tuple(np.concatenate(x) for x in zip(*parts)) for parts in (induced, everything))


def run_length_before(text: np.ndarray, run: np.ndarray, place: int) -> int:
    """How many equal symbols stand right before a place that holds the same symbol."""
    low, span = place, 1
    while low > 0:
        at = max(low - span, 0)
        if text[at] == text[place] and run[at] >= place - at:
            low, span = at, span * 2
        elif span == 1:
            break
        else:
            span = 1
    return place - low


def _sorted(text: np.ndarray, larger: np.ndarray, count: int, run: np.ndarray, stars: np.ndarray, common: np.ndarray):
    """All suffixes in order with common prefixes, from those of ``stars`` (which follow a larger suffix)."""
    down, _ = _induce(text, larger, count, run, (stars, common), np.array([len(text) - 1]))
    _, both = _induce(count - 1 - text, ~larger, count, run, _backwards(*down), np.zeros(0, np.int64))
    return _backwards(*both)


def sorted_suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a sequence of numbers in order (a suffix comes before those it begins), each with the length of
    the prefix it has in common with the one before."""
    length = len(text)
    if length < 2:
        return np.arange(length), np.zeros(length, np.int64)
    values, text = np.unique(text, return_inverse=True)
    text, count = _stored(text.astype(np.int64)), len(values)
    step = np.append(np.sign(text[:-1] - text[1:]), 1)
    place = np.where(step != 0, np.arange(length), length)
    change = np.minimum.accumulate(place[::-1])[::-1]
    larger = step[change] > 0
    run = _stored(change - np.arange(length) + 1)
    stars = 1 + np.flatnonzero(~larger[1:] & larger[:-1])
    shared = np.zeros(len(stars), np.int64)
    if len(stars) > 1:
        order = np.argsort(text[stars], kind="stable")
        seeds = stars[order]
        shared[1:] = np.where(text[seeds[1:]] == text[seeds[:-1]], UNKNOWN, 0)
        places, common = _sorted(text, larger, count, run, seeds, shared)
        is_star = np.zeros(length, bool)
        is_star[stars] = True
        chosen = np.flatnonzero(is_star[places])
        common = _among(common, chosen)
        number = np.zeros(length, np.int64)
        number[stars] = np.arange(len(stars))
        at = number[places[chosen]]
        new = common < UNKNOWN
        new[0] = True
        names = np.zeros(len(stars), np.int64)
        names[at] = np.cumsum(new) - 1
        between = common[new]
        del places, chosen, number, is_star
        if new.all():
            order, blocks = at, np.zeros(len(stars), np.int64)
        else:
            order, blocks = sorted_suffixes(names)
        # whole equal blocks, then what the first different ones share; at the end of a block, the runs decide
        left, right, blocks = order[:-1], order[1:], blocks[1:]
        one, two = left + blocks, right + blocks
        part = _least(between, np.minimum(names[one], names[two]) + 1, np.maximum(names[one], names[two]))
        sizes = np.append(stars[1:] + 1, length) - stars
        shorter = np.minimum(sizes[one], sizes[two])
        part = np.minimum(part, shorter)
        tail = np.flatnonzero(part == shorter)
        ends = [stars[x[tail]] + shorter[tail] - 1 for x in (one, two)]
        part[tail] += np.minimum(run[ends[0]], run[ends[1]]) - 1
        stars, shared = stars[order], np.concatenate([[0], stars[one] - stars[left] + part])
    return _sorted(text, larger, count, run, stars, shared)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes alone."""
    return sorted_suffixes(text)[0]


def _cells(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, document and sketch cell of each window: the hash of its least twenty-byte run."""
    lengths = np.maximum(np.diff(offsets) - size + 1, 0)
    owners = np.repeat(np.arange(len(lengths)), lengths)
    at = offsets[:-1][owners] + np.arange(len(owners)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if not len(at):
        return at, owners, np.zeros(0, np.int64)
    gram = min(GRAM, size)
    runs = sequences(seeded(256, 53)[data], gram)
    return at, owners, (lowest(runs, size - gram + 1)[at] >> np.uint64(64 - CELL_BITS)).view(np.int64)


def _changes(owners: np.ndarray, cells: np.ndarray) -> np.ndarray:
    new = np.ones(len(owners), bool)
    new[1:] = (cells[1:] != cells[:-1]) | (owners[1:] != owners[:-1])
    return new


def _own_cells(size: int):
    """The cells of each document, once for every document of a slice, with what their stretches take in a shard.

    Most of the shuffled rows are these. They come by document and differ from the row before in the last
    column only, mostly, so that the shuffle's compression leaves little besides the hash.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            part = part.filter(pc.is_valid(part.column("doc_id")))
            if not part.num_rows:
                continue
            _, owners, cells = _cells(*text_bytes(part.column("text")), size)
            if not len(cells):
                continue
            first = np.flatnonzero(_changes(owners, cells))
            taken = np.diff(np.append(first, len(cells))) + size - 1 + ROW_BYTES
            owners, cells = owners[first], cells[first]
            order = np.lexsort((cells, owners))
            owners, cells = owners[order], cells[order]
            first = np.flatnonzero(_changes(owners, cells))
            ids = part.column("doc_id").to_numpy()[owners[first]]
            taken = np.maximum((np.add.reduceat(taken[order], first) + TAKEN_BYTES // 2) // TAKEN_BYTES, 1) * TAKEN_BYTES
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(taken), pa.array(cells[first])], ["doc_id", "taken", "cell"])

    return run


SEGMENTS = pa.schema([("cell", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("segment", pa.binary())])


def _regular(owners: np.ndarray, places: np.ndarray, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One row for equal windows of a document at equal distances (a repeated phrase): which windows stand for such
    rows, and their places, where several are packed into one negative number (see ``_unpacked``)."""
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(x, len(known)) for x in windows], np.int64)
    order = np.lexsort((places, codes, owners))
    codes, owners, sorted_places = codes[order], owners[order], places[order]
    step = np.diff(sorted_places)
    same = (codes[1:] == codes[:-1]) & (owners[1:] == owners[:-1])
    linked = same & (step < 1 << STEP)
    linked[1:] &= ~same[:-1] | (step[1:] == step[:-1])
    new = np.append(True, ~linked)
    new[:: 1 << TIMES] = True
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(new)))
    packed = sorted_places[first]
    several = np.flatnonzero(times > 1)
    packed[several] = ~(packed[several] | step[first[several]] << PLACE | times[several] - 1 << PLACE + STEP)
    return order[first], packed


def _unpacked(packed: int) -> range:
    """The places of a row of equal windows."""
    place, step, times = (~packed >> low & (1 << bits) - 1 for low, bits in ((0, PLACE), (PLACE, STEP), (PLACE + STEP, TIMES)))
    return range(place, place + step * times + 1, step)


def _segments(size: int):
    """Stretches of bytes whose windows may repeat, cut where their cell changes.

    In a large cell each window is a stretch by itself, in the cell of the hash of all its bytes; equal ones of a
    document at equal distances are one row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            part = part.filter(pc.is_valid(part.column("hot")))
            if not part.num_rows:
                continue
            data, offsets = text_bytes(part.column("text"))
            at, owners, cells = _cells(data, offsets, size)
            hot, large = np.zeros(len(at), bool), np.zeros(len(at), bool)
            ends = np.searchsorted(owners, np.arange(part.num_rows + 1))
            for i, (own, most) in enumerate(zip(part.column("hot").to_pylist(), part.column("large").to_pylist(), strict=True)):
                hot[ends[i] : ends[i + 1]] = np.isin(cells[ends[i] : ends[i + 1]], np.array(own, np.int64))
                if most:
                    large[ends[i] : ends[i + 1]] = np.isin(cells[ends[i] : ends[i + 1]], np.array(most, np.int64))
            at, owners, cells, large = at[hot], owners[hot], cells[hot], large[hot]
            if not len(at):
                continue
            if large.any():
                cells[large] = sequences(seeded(256, 53)[data], size)[at[large]].view(np.int64)
            new = _changes(owners, cells) | large
            new[1:] |= at[1:] != at[:-1] + 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            raw = data.tobytes()
            found = [raw[a : b + size] for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)]
            cells, owners, large = cells[first], owners[first], large[first]
            places = at[first] - offsets[:-1][owners]
            if large.any():
                alone = np.flatnonzero(large)
                kept, packed = _regular(owners[alone], places[alone], [found[i] for i in alone.tolist()])
                kept, rest = alone[kept], np.flatnonzero(~large)
                places = np.concatenate([places[rest], packed])
                kept = np.concatenate([rest, kept])
                cells, owners, found = cells[kept], owners[kept], [found[i] for i in kept.tolist()]
            ids = part.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(ids[owners]), pa.array(places), pa.array(found, pa.binary())],
                schema=SEGMENTS,
            )

    return run


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers among ascending ones."""
    new = np.ones(len(marked), bool)
    new[1:] = marked[1:] != marked[:-1] + 1
    first = np.flatnonzero(new)
    return marked[first], marked[np.append(first[1:], len(marked)) - 1] if len(marked) else marked


def _pieces(segments: list[bytes], docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs of windows whose hash comes from several documents: their stretch, first byte in it, and bytes.

    Equal windows have equal hashes, so none that repeats is lost; what else shares a hash is told apart by the sort.
    """
    raw = b"".join(segments)
    lengths = np.array([len(s) for s in segments])
    base, windows = np.cumsum(lengths) - lengths, lengths - size + 1
    whose = np.repeat(np.arange(len(segments)), windows)
    at = np.arange(len(whose)) + np.repeat(base - np.cumsum(windows) + windows, windows)
    hashes = sequences(seeded(256, 53)[np.frombuffer(raw, np.uint8)], size)[at]
    order = np.argsort(hashes)
    hashes = hashes[order]
    group = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    by_hash = docs[whose[order]]
    several = np.minimum.reduceat(by_hash, group) < np.maximum.reduceat(by_hash, group)
    wanted = np.zeros(len(at), bool)
    wanted[order] = np.repeat(several, np.diff(np.append(group, len(order))))
    at, whose = at[wanted], whose[wanted]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (whose[1:] != whose[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    parts = [raw[a : b + size] for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)] if len(at) else []
    return whose[first], at[first] - base[whose[first]], parts


def _settle(docs: np.ndarray, code: np.ndarray, segments: list[bytes], size: int, find) -> np.ndarray:
    """Windows of stretches that a smaller document holds, as rows (number of the stretch, first, last).

    ``code`` numbers the distinct stretches, whose bytes are ``segments``. An equal stretch lies in a smaller document
    as a whole; ``find`` gives the windows of the distinct ones, each in its smallest document.
    """
    lengths = np.array([len(s) for s in segments])
    least = np.full(len(segments), np.iinfo(np.int64).max)
    np.minimum.at(least, code, docs)
    whole = np.flatnonzero(docs > least[code])
    part, first, last = find(least)
    rows = np.flatnonzero(docs == least[code])
    low = np.searchsorted(part, code[rows])
    count = np.searchsorted(part, code[rows], side="right") - low
    run = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    settled = np.stack([whole, np.zeros_like(whole), lengths[code[whole]] - size])
    return np.concatenate([settled, np.stack([np.repeat(rows, count), first[run], last[run]])], axis=1)


def _by_sort(segments: list[bytes], docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of distinct stretches that a stretch of a smaller document holds, from the order of their suffixes."""
    raw = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    lengths = np.array([len(s) for s in segments])
    # a zero ends each stretch
    text = np.zeros(len(raw) + len(segments), np.int64)
    text[np.arange(len(raw)) + np.repeat(np.arange(len(segments)), lengths)] = raw
    base = np.cumsum(lengths + 1) - lengths - 1
    order, common = sorted_suffixes(text)
    whose = np.repeat(np.arange(len(segments)), lengths + 1)
    inside = np.arange(len(text)) - base[whose]
    chosen = np.flatnonzero((inside <= lengths[whose] - size)[order])
    order, new = order[chosen], _among(common, chosen) < size
    new[0] = True
    docs = docs[whose[order]]
    smallest = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
    gone = np.zeros(len(text), bool)
    gone[order[docs > smallest]] = True
    first, last = _runs(np.flatnonzero(gone))  # the zero between two stretches is never marked
    return whose[first], inside[first], inside[last]


def _repeats(cell: np.ndarray, doc: np.ndarray, start: np.ndarray, code: np.ndarray, segments: list[bytes], size: int) -> np.ndarray:
    """Windows of a shard that a smaller document holds, as rows (document, first start, last start).

    ``code`` numbers the distinct stretches, whose bytes are ``segments``.
    """
    # equal windows share their cell, so the only stretch of a cell has no partner
    cell_of = np.zeros(len(segments), np.int64)
    cell_of[code] = cell
    _, kind, kinds = np.unique(cell_of, return_inverse=True, return_counts=True)
    own = np.flatnonzero(kinds[kind] > 1)
    none = np.zeros((3, 0), np.int64)

    def among(least: np.ndarray) -> np.ndarray:
        """Of the distinct stretches only the pieces that may repeat are sorted, one copy of each."""
        if not len(own):
            return none
        whose, place, parts = _pieces([segments[i] for i in own.tolist()], least[own], size)
        if not parts:
            return none
        known: dict[bytes, int] = {}
        codes = np.array([known.setdefault(x, len(known)) for x in parts], np.int64)
        distinct = list(known)
        row, first, last = _settle(least[own[whose]], codes, distinct, size, lambda docs: _by_sort(distinct, docs, size))
        found = np.stack([own[whose[row]], place[row] + first, place[row] + last])
        return found[:, np.argsort(found[0], kind="stable")]

    row, first, last = _settle(doc, code, segments, size, among)
    return np.stack([doc[row], start[row] + first, start[row] + last], axis=1)


def _resolve(size: int):
    """Repeats of each shard: whole cells one after the other until their stretches pass a bound.

    Rows come by cell and document, so a stretch comes first from its smallest document; rows of later ones are gone
    as a whole at once, and only those of the smallest are held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        segments: dict[bytes, int] = {}
        owner = np.zeros(0, np.int64)  # smallest document of each segment
        last, amount = None, 0

        def flush() -> pa.RecordBatch:
            found = _repeats(*np.concatenate(held, axis=1), list(segments), size)
            held.clear()
            segments.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found.T], ["doc_id", "first", "last"])

        for batch in batches:
            while batch.num_rows:
                cell = batch.column("cell").to_numpy()
                coded = batch.column("segment").dictionary_encode()
                known, local = len(segments), coded.indices.to_numpy()
                codes = np.array([segments.setdefault(x, len(segments)) for x in coded.dictionary.to_pylist()], np.int64)
                first = np.ones(len(local), bool)
                first[1:] = local[1:] > np.maximum.accumulate(local)[:-1]  # places of a dictionary follow the rows
                sizes = pc.binary_length(batch.column("segment")).to_numpy()
                grown = amount + np.cumsum(np.where(first & (codes[local] >= known), sizes, 0) + ROW_BYTES)
                turn = np.ones(len(cell), bool)
                turn[1:] = cell[1:] != cell[:-1]
                turn[0] = last is not None and cell[0] != last
                before = np.concatenate([[amount], grown[:-1]])
                full = np.flatnonzero(turn & (before > SHARD_BYTES))
                end = int(full[0]) if len(full) else len(cell)
                if end:
                    ids, starts = (batch.column(c).to_numpy()[:end] for c in ("doc_id", "start"))
                    own = codes[local[:end]]
                    owner = np.append(owner, np.full(max(len(segments) - len(owner), 0), np.iinfo(np.int64).max))
                    np.minimum.at(owner, own, ids)
                    stays = ids == owner[own]
                    gone = ~stays
                    if gone.any():
                        spans = [ids[gone], starts[gone], starts[gone] + sizes[:end][gone] - size]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], ["doc_id", "first", "last"])
                    held.append(np.stack([cell[:end][stays], ids[stays], starts[stays], own[stays]]))
                    last, amount = int(cell[end - 1]), int(grown[end - 1])
                if len(full):
                    taken = int(local[:end].max(initial=-1)) + 1
                    for extra in list(segments)[max(known, int(codes[:taken].max(initial=-1)) + 1) :]:
                        del segments[extra]
                    yield flush()
                    owner = owner[:0]
                    last, amount = None, 0
                batch = batch.slice(end)
        if held:
            yield flush()

    return run


def _cut(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            out = []
            for doc_id, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw, runs = text.encode(), []
                marked = [(x["first"], x["last"] + size) for x in spans or ()]
                if any(first < 0 for first, _ in marked):
                    several = [place for first, _ in marked if first < 0 for place in _unpacked(first)]
                    marked = [x for x in marked if x[0] >= 0] + [(place, place + size) for place in several]
                for first, last in sorted(marked):
                    last = min(last, len(raw))
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], last)
                    elif first < last:
                        runs.append([first, last])
                edges = [0, *(x for run_ in runs for x in run_), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema, strict=True)], schema=schema)

    return run


def repeated_bytes(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by ``size`` bytes that also start in a document with a smaller id.

    Returns ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept`` (the bytes that stay) for every row.

    A text equal to that of a smaller document (by digest) goes as a whole and takes no further part. Of the others,
    cells tell which windows may repeat (a window is in the cell of its least twenty-byte run, so none is lost).
    Only stretches of such windows are sent on, by cell, and form shards of bounded size. A cell above that size is
    split into its windows, by the hash of all their bytes, and equal ones meet without a sort. A shard keeps one copy of
    equal stretches and sorts the suffixes of those that share a cell with others by recursive induction. The tuples in its queues, which spill to disk beyond a
    bound, carry the prefix a suffix shares with the one before, so the groups of windows follow from the order at once.

    Defined cases: null texts and texts below ``size`` bytes lose nothing. Strings repeated within one document only
    stay. Rows that repeat an id are one document to each other and lose what any of them loses, at the same
    places. Rows with a null id are left as they are and do not count. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    digest = F.unhex(F.sha2("text", 256))
    digests = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= size)).select(
        "doc_id", digest.alias("digest"), F.octet_length("text").alias("n")
    )
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    later = digests.join(least, "digest").filter("doc_id > least")
    copies = later.groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))
    # one exchange of the texts by id serves all joins below, so no filter may reach under it
    copied = F.coalesce(F.array_contains("copied", digest), F.lit(False))
    base = rows.join(copies, "doc_id", "left").withColumn("copied", copied)
    first = base.filter("NOT copied").select("doc_id", "text")
    own = first.mapInArrow(_own_cells(size), "doc_id bigint, taken bigint, cell bigint")
    everywhere = Window.partitionBy("cell")
    shared = own.select(
        "cell", "doc_id", *(f("doc_id").over(everywhere).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))), F.sum("taken").over(everywhere).alias("taken")
    )
    large = F.when(F.col("taken") > SHARD_BYTES, F.col("cell"))
    hot_cells = shared.filter("least < most").groupBy("doc_id").agg(F.collect_set("cell").alias("hot"), F.collect_set(large).alias("large"))
    found = first.join(hot_cells, "doc_id", "left").mapInArrow(_segments(size), "cell bigint, doc_id bigint, start bigint, segment binary")
    settled = found.repartition("cell").sortWithinPartitions("cell", "doc_id").mapInArrow(_resolve(size), "doc_id bigint, first bigint, last bigint")
    whole = later.select("doc_id", F.lit(0).cast("bigint").alias("first"), (F.col("n") - size).cast("bigint").alias("last"))
    settled = settled.union(whole)
    spans = settled.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return rows.join(spans, "doc_id", "left").mapInArrow(
        _cut(size), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
