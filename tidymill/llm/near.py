"""Near-duplicates by word shingles: a Hamming join of b-bit MinHash signatures over several indexes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymill.llm.common import mixed, pin, seeded, slices, text_bytes, texts
from tidymill.llm.graph import components
from tidymill.llm.shingles import shingle_sets

VALUES = 64  # minima per signature, of 16 bits each
CHUNK = 4  # minima per chunk; one of them may differ
BINS = 512  # of the finer sketch that candidates between components pass
GROUP_ROWS = 2048  # members of a key that one block compares with another
FEW_BITS = 26  # of 64 minima cut to two bits, those that may differ; links at 0.75 exceed it once in 100,000

_FACTORS = seeded(VALUES, 21) | np.uint64(1)
_SHIFTS = seeded(VALUES, 22)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        values, bounds = shingle_sets(*text_bytes(part.column("text")))
        counts = np.diff(bounds)
        full = np.flatnonzero(counts > 0)
        minima = np.zeros((len(full), VALUES), np.uint16)
        if len(full):
            at = bounds[:-1][full]
            for k in range(VALUES):
                least = np.minimum.reduceat((values ^ _SHIFTS[k]) * _FACTORS[k], at)
                minima[:, k] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
        raw = values.tobytes()
        digests = [xxhash.xxh3_128_digest(raw[8 * bounds[i] : 8 * bounds[i + 1]]) for i in full]
        pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        two = (minima & 3).astype(np.uint64)
        place = (2 * (np.arange(VALUES) % 32)).astype(np.uint64)
        halves = [np.bitwise_or.reduce(two[:, h : h + 32] << place[h : h + 32], axis=1).view(np.int64) for h in (0, 32)]
        none = pa.nulls(part.num_rows - len(full), pa.int64())
        order = np.concatenate([full, np.flatnonzero(counts == 0)])
        columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(halves[0]), pa.array(halves[1])]
        columns = [pa.concat_arrays([c, none]) for c in columns]
        signs = pa.array([*(x.tobytes() for x in minima), *[None] * len(none)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(order)), pa.array(counts[order].astype(np.int64)), *columns, signs],
            ["doc_id", "n", "hi", "lo", "s0", "s1", "signature"],
        )


def _index_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk and each value left out of it, a hash of the others: equal if at most that one differs."""
    for part in slices(batches, "signature", 1 << 19):
        raw = part.column("signature")
        minima = np.frombuffer(b"".join(raw.to_pylist()), np.uint16).reshape(-1, VALUES // CHUNK, CHUNK).astype(np.uint64)
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        for left_out in range(CHUNK):
            packed = np.zeros(minima.shape[:2], np.uint64)
            for k in range(CHUNK):
                if k != left_out:
                    packed = (packed << np.uint64(16)) | minima[:, :, k]
            keys = _keyed(packed, np.arange(minima.shape[1])[None, :], np.array(left_out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "node"]
            )


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(slices(batches, "text_a"), "text_b"):
            (a, at_a), (b, at_b) = (shingle_sets(*text_bytes(part.column(c))) for c in ("text_a", "text_b"))
            linked = np.zeros(part.num_rows, bool)
            for i in range(part.num_rows):
                left, right = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                both = np.sort(np.concatenate([left, right]))
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = common > 0 and 100 * common >= percent * (len(both) - common)
            yield part.select(["a", "b"]).filter(pa.array(linked))

    return run


def _confirmed(pairs: DataFrame, store: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    left = pairs.join(store.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(store.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a bigint, b bigint")


def _differing(x: Column, y: Column) -> Column:
    unequal = x.bitwiseXOR(y)
    return F.bit_count(unequal.bitwiseOR(F.shiftrightunsigned(unequal, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _possible(percent: int) -> Column:
    """Sizes and cut signatures allow a link (columns of both sides end in 1 and 2)."""
    sizes = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    return sizes & ((_differing(F.col("s01"), F.col("s02")) + _differing(F.col("s11"), F.col("s12"))) <= FEW_BITS)


def _bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least shingle of each of 512 bins, cut to 1-255 (0: the bin is empty)."""
    for part in slices(batches):
        values, bounds = shingle_sets(*text_bytes(part.column("text")))
        out = np.zeros((part.num_rows, BINS), np.uint8)
        spread = mixed(values + np.uint64(5))
        bins, owners = (spread % np.uint64(BINS)).astype(np.int64), np.repeat(np.arange(part.num_rows), np.diff(bounds))
        order = np.lexsort((spread, bins, owners))
        first = order[np.unique(owners[order] * BINS + bins[order], return_index=True)[1]]
        out[owners[first], bins[first]] = (spread[first] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([x.tobytes() for x in out], pa.binary())], ["node", "bins"]
        )


def _keyed(packed: np.ndarray, chunk: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    return mixed(packed ^ mixed((chunk * CHUNK + left_out).astype(np.uint64) + np.uint64(77)))


def _first_shared(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The first of the keys that a signature shares with others, so that a pair is listed under that one only."""
    same = (mine[None, :] == theirs).reshape(len(theirs), -1, CHUNK)
    chunk = np.argmax(same.sum(axis=2) >= CHUNK - 1, axis=1)
    left_out = np.argmin(same[np.arange(len(theirs)), chunk], axis=1)  # the one that differs, else the first
    values = mine.reshape(-1, CHUNK)[chunk].astype(np.uint64)
    packed = np.zeros(len(theirs), np.uint64)
    for k in range(CHUNK):
        packed = np.where(left_out == k, packed, (packed << np.uint64(16)) | values[:, k])
    return _keyed(packed, chunk, left_out)


def _close(rows: dict[str, np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """Pairs of a group in different parts that may be linked, by sizes, cut signatures and bins."""
    node, part, n = rows["node"], rows["part"], rows["n"].astype(np.float64)
    cut, low = rows["cut"].view(np.uint64), np.uint64(0x5555555555555555)
    share = percent / 100
    for i in range(len(node) - 1):
        rest = slice(i + 1, None)
        unequal = cut[i] ^ cut[rest]
        apart = np.bitwise_count((unequal | (unequal >> np.uint64(1))) & low).sum(axis=1)
        least, most = np.minimum(n[i], n[rest]), np.maximum(n[i], n[rest])
        at = i + 1 + np.flatnonzero((part[rest] != part[i]) & (apart <= FEW_BITS) & (least >= share * most))
        if len(at):
            mine, theirs = rows["bins"][i], rows["bins"][at]
            used = ((mine | theirs) > 0).sum(axis=1)
            agree = ((mine == theirs) & (mine > 0)).sum(axis=1)
            # bins are a sample without replacement of a union that links make this large
            union = np.maximum((n[i] + n[at]) / (1 + share), used)
            spread = np.sqrt(share * (1 - share) * used * np.maximum(1 - used / union, 0.05))
            at = at[agree >= share * used - 4.5 * spread - 2]
        if len(at):
            at = at[_first_shared(rows["minima"][i], rows["minima"][at]) == rows["key"][i]]
            if len(at):
                yield np.stack([np.minimum(node[i], node[at]), np.maximum(node[i], node[at])], axis=1)


def _close_pairs(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(group)
            rows = {c: table.column(c).to_numpy() for c in ("node", "part", "n")}
            rows["cut"] = np.stack([table.column("s0").to_numpy(), table.column("s1").to_numpy()], axis=1)
            rows["bins"] = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
            rows["minima"] = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
            rows["key"] = table.column("key").to_numpy().view(np.uint64)
            found = [np.zeros((0, 2), np.int64), *_close(rows, percent)]
            pairs = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(1 + np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1))), len(marks)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                mark = marks[start].tolist()
                if mark != last and held:
                    yield closed(held)
                    held = []
                last = mark
                held.append(batch.slice(start, end - start))
        if held:
            yield closed(held)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Link documents whose sets of five-word shingles overlap by ``percent`` of their union at least.

    Returns ``doc_id, n_shingles, component_id, kept`` for every row: the smallest id reachable by links, and whether
    it is the row's own.

    Documents with equal sets are one class. A class's signature is 64 minima of 16 bits, in 16 chunks of
    four. Signatures that differ in at most 31 minima have a chunk in which at most one differs; each
    chunk is indexed once per value left out, so every such pair meets under a key. A link at 0.75
    differs in 16 on average and in over 31 once in 100,000; any candidate is confirmed on full sets.

    Members of a key are first compared with its hub only, the member that meets most others under all
    its keys (in a group of near copies mostly their original), and linked. What then still
    lies in different components is compared within each key, in blocks of bounded size, by sizes, cut
    signatures and a finer sketch; pairs that may be links are confirmed on full sets. So no link between
    components is lost, and links inside one are not listed. Only the comparisons of a family of
    mutually dissimilar texts under one key grow with its square; they stay inside the blocks.

    Defined cases: null texts and texts without words have no shingles and link with nothing; shorter texts
    than five words are one shingle. Rows that repeat an id are one node and share its links; of its
    different texts one may stand for all in the comparison between components. Null ids link with nothing,
    with a null component and kept true. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    signed = pin(
        rows.mapInArrow(
            _signatures, "doc_id bigint, n bigint, hi bigint, lo bigint, s0 bigint, s1 bigint, signature binary"
        )
    )
    usable = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = pin(usable.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")))
    same = usable.join(classes.filter("node < last"), ["n", "hi", "lo"]).filter("doc_id <> node")
    leaders = usable.join(classes, ["n", "hi", "lo"]).filter("doc_id = node").dropDuplicates(["n", "hi", "lo"])
    leaders = pin(leaders.select("doc_id", "n", "s0", "s1", "signature"))

    keys = leaders.select("doc_id", "signature").mapInArrow(_index_keys, "key bigint, node bigint")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = pin(keys.join(shared, "key"))
    weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = met.join(weight, "node").select("key", "node", F.struct("weight", (-F.col("node")).alias("back")).alias("rank"))
    hubs = weighed.groupBy("key").agg(F.max("rank").alias("rank")).select("key", (-F.col("rank")["back"]).alias("hub"))
    members = pin(met.select("key", "node").join(hubs, "key"))
    facts = leaders.dropDuplicates(["doc_id"])
    first, second = (facts.drop("signature").toDF(f"node{i}", f"n{i}", f"s0{i}", f"s1{i}") for i in (1, 2))
    involved = members.select(F.col("node").alias("doc_id")).distinct()
    store = pin(rows.join(involved, "doc_id").dropDuplicates(["doc_id", "text"]))

    ends = F.least("hub", "node").alias("node1"), F.greatest("hub", "node").alias("node2")
    stars = members.filter("node <> hub").select(*ends).distinct()
    stars = stars.join(first, "node1").join(second, "node2").filter(_possible(percent))
    links = pin(_confirmed(stars.select(F.col("node1").alias("a"), F.col("node2").alias("b")), store, percent))
    equal = same.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(links.union(equal))

    placed = members.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    split = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("key")
    sizes = split.join(placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    blocks = F.ceil(F.col("size") / GROUP_ROWS).cast("int")
    details = facts.withColumnRenamed("doc_id", "node").join(store.mapInArrow(_bins, "node bigint, bins binary"), "node")
    own = placed.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "part"
    )
    dealt = dealt.join(details.dropDuplicates(["node"]), "node").repartition("key", "i", "j")
    met_again = dealt.sortWithinPartitions("key", "i", "j").mapInArrow(_close_pairs(percent), "a bigint, b bigint")
    pairs = pin(met_again.distinct())
    more = pin(_confirmed(pairs, store, percent))
    final = components(links.union(equal).union(more))
    return signed.select("doc_id", "n").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
