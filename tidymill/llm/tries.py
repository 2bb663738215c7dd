"""A trie of conversations: sorted shards build what lies inside them, the skeleton of their splitters joins the rest."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidymill.llm.common import pin

WORD = r"[^\x20\x09-\x0D]+"
SEGMENT = 64  # turns of one path
DIGEST = 16  # bytes of a turn in a path
HEAD = 4 + DIGEST  # bytes before them: number of the segment, digest of all turns before it
SHARD_TURNS = 200_000
OVERSAMPLE = 16  # sampled paths for each shard

NODES = (
    "slot bigint, parent_slot bigint, root binary, words bigint, segment bigint, depth bigint, conv_id bigint, parent_conv_id bigint,"
    " n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt_turns(
    conversations: DataFrame,
    id_col: str = "conv_id",
    order_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    family: int = 20,
    heads: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin like the first one of their family, and one row per conversation.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % family`` (all if it has fewer, none if it is
    absent) and goes on with its own turns after its first ``h``; ``h`` is the CRC-32 of its decimal id modulo
    ``heads``. Returns ``(conv_id, place, digest, words)`` with places from 0, and ``(conv_id, n_turns)``.

    Turns are digested once and written; positions come from a range-partitioned sort of the digests that is written
    as well: rows of a partition are counted per conversation, and offsets run over those counts. So a
    conversation of any length is spread over tasks.

    Defined cases: null roles and texts are empty; a null turn comes first; turns that tie are ordered by the
    digest of role and text; repeated rows are turns of their own; rows without an id belong to no conversation.
    """
    role = F.coalesce(conversations[role_col].cast("string"), F.lit(""))
    text = F.coalesce(conversations[text_col].cast("string"), F.lit(""))
    digested = conversations.select(
        conversations[id_col].cast("bigint").alias("conv_id"),
        conversations[order_col].cast("bigint").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("at"),
    ).filter("conv_id IS NOT NULL")
    # the sort samples its input before it runs
    turns = pin(digested)
    order = ["conv_id", "turn", "digest", "at"]
    ordered = pin(
        turns.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("mid"))
    )
    part = F.shiftright("mid", 33)
    runs = ordered.groupBy("conv_id", part.alias("part")).agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    lengths = runs.groupBy("conv_id").agg(F.sum("n").alias("own"))
    founders = lengths.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("founder"), F.col("own").alias("given"))
    convs = pin(
        lengths.withColumn("founder", F.col("conv_id") - F.col("conv_id") % family)
        .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads)
        .join(founders, "founder", "left")
        .withColumn("borrowed", F.least("h", F.coalesce("given", F.lit(0))))
        .select("conv_id", "founder", "h", "borrowed", (F.col("borrowed") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))
    )
    offsets = runs.select("conv_id", "part", "first", before.alias("before")).join(
        convs.select("conv_id", "h", "borrowed"), "conv_id"
    )
    placed = ordered.withColumn("part", part).join(offsets, ["conv_id", "part"])
    place = F.col("before") + F.col("mid") - F.col("first")
    own = placed.filter(place >= F.col("h")).select(
        "conv_id", (place - F.col("h") + F.col("borrowed")).alias("place"), "digest", "words"
    )
    first_turns = placed.filter((F.col("conv_id") % family == 0) & (place < heads)).select(
        F.col("conv_id").alias("founder"), place.alias("place"), "digest", "words"
    )
    lent = convs.select("conv_id", "founder", "borrowed").join(first_turns, "founder").filter("place < borrowed")
    return own.unionByName(lent.select("conv_id", "place", "digest", "words")), convs.select("conv_id", "n_turns")


def _bytes(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def _segments(turns: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """Conversations as paths of at most ``size`` turns: ``conv_id, segment, root, key, below, words, ended``.

    ``root`` stands for all turns before the segment and ``below`` for all up to its end. Both are running
    exclusive ors of 128 bits of hash, each bound to its place, so they need no walk along the turns. A
    conversation whose length is a multiple of ``size`` has one more, empty segment.
    """
    segment = F.floor(F.col("place") / size).cast("bigint")
    filled = (
        turns.groupBy("conv_id", segment.alias("segment"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("turns"))
        .select("conv_id", "segment", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("words"))
    )
    hollow = convs.filter(F.col("n_turns") % size == 0).select(
        "conv_id",
        F.floor(F.col("n_turns") / size).cast("bigint").alias("segment"),
        F.lit(b"").alias("path"),
        F.array().cast("array<bigint>").alias("words"),
    )
    by_place = Window.partitionBy("conv_id").orderBy("segment")

    def digest_to(end: int) -> Column:
        halves = [
            F.bit_xor(F.xxhash64(F.lit(i), "segment", "path")).over(by_place.rowsBetween(Window.unboundedPreceding, end))
            for i in (1, 2)
        ]
        return F.concat(*(_bytes(F.coalesce(h, F.lit(0)), 8) for h in halves))

    following = F.lead(F.length("path")).over(by_place)
    return (
        filled.unionByName(hollow)
        .select(
            "conv_id",
            "segment",
            "path",
            "words",
            F.concat(_bytes(F.col("segment"), 4), digest_to(-1)).alias("root"),
            F.concat(_bytes(F.col("segment") + 1, 4), digest_to(0)).alias("below"),
            (((F.length("path") > 0) | (F.col("segment") == 0)) & (F.coalesce(following, F.lit(0)) == 0)).alias("ended"),
        )
        .select("conv_id", "segment", "root", F.concat("root", "path").alias("key"), "below", "words", "ended")
    )


def _ends(segments: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the digest of the sorted ids that end at a path.

    Ids are joined in blocks of 1,024 first; a digest has to be taken in order, so the blocks of one path stream
    through one task that holds the state of the digest and nothing else.
    """
    blocks = (
        segments.filter("ended")
        .groupBy("key", F.shiftright("conv_id", 10).alias("block"))
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    )

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, shas = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        shas.append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"]
            )

    return (
        blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(digests, "key binary, ends_sha256 string")
    )


class Skeleton:
    """The trie of the splitter paths: a slot for each prefix, in sorted order, so parents come before children."""

    def __init__(self, splitters: list[bytes], segment: int = SEGMENT):
        self.splitters = splitters
        self.segment = segment
        self.child: dict[tuple[int, bytes], int] = {}
        self.parents: list[int] = []
        self.levels: list[int] = []
        self.segments: list[int] = []
        self.roots: list[bytes | None] = []
        for path in splitters:
            slot = -1
            for level in range((len(path) - HEAD) // DIGEST + 1):
                unit = _unit(path, level)
                if (slot, unit) not in self.child:
                    self.child[slot, unit] = len(self.parents)
                    self.parents.append(slot)
                    self.levels.append(level)
                    self.segments.append(int.from_bytes(path[:4], "big"))
                    self.roots.append(unit if level == 0 else None)
                slot = self.child[slot, unit]


def _unit(key: bytes, level: int) -> bytes:
    """The part of a key that leads to a level: its head, then turn by turn."""
    return key[HEAD + DIGEST * (level - 1) : HEAD + DIGEST * level] if level else key[:HEAD]


def _skeleton(paths: DataFrame, segment: int, shard_turns: int) -> Skeleton:
    """Splitters that cut the sorted paths into shards of about ``shard_turns`` turns.

    They come from a sample of ``OVERSAMPLE`` paths for each shard, each at most ``segment`` turns long, so what is
    collected and broadcast is bounded by the number of shards. A splitter is the shortest prefix that still tells
    its path from the one sampled before it.
    """
    turns = paths.agg(F.sum(F.length("key") - HEAD + DIGEST)).first()[0] or 0
    shards = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // (DIGEST * shard_turns) + 1)
    sample = sorted(bytes(r[0]) for r in paths.select("key").orderBy(F.xxhash64("key"), "key").limit(shards * OVERSAMPLE).collect())
    share, taken, splitters = max(1, sum(map(len, sample)) // shards), 0, []
    for before, path in zip(sample, sample[1:]):
        taken += len(before)
        if taken >= share * (len(splitters) + 1):
            level = 0
            while path[: HEAD + DIGEST * level] <= before:
                level += 1
            splitters.append(path[: HEAD + DIGEST * level])
    return Skeleton(splitters, segment)


class _Shard:
    """The trie of the paths of one shard; paths are added in sorted order."""

    def __init__(self, skeleton: Skeleton):
        self.child, self.full = skeleton.child, skeleton.segment
        self.parent, self.slot, self.level, self.words, self.segment, self.roots = [], [], [], [], [], []
        self.n, self.conv, self.children, self.leaves, self.saved, self.ends = [], [], [], [], [], []
        self.open, self.last = [], b""

    def add(self, row: dict) -> None:
        key, last = row["key"], self.last
        length = (len(key) - HEAD) // DIGEST
        level = 0
        while level < len(self.open) and level <= length and _unit(key, level) == _unit(last, level):
            level += 1
        del self.open[level:]
        for at in range(level, length + 1):
            parent = self.open[-1] if at else -1
            above = self.slot[parent] if at else -1
            inside = at == 0 or above >= 0
            self.open.append(len(self.parent))
            self.parent.append(parent)
            self.slot.append(self.child.get((above, _unit(key, at)), -1) if inside else -1)
            self.level.append(at)
            self.words.append(row["words"][at - 1] if at else 0)
            self.segment.append(row["segment"])
            self.roots.append(key[:HEAD] if at == 0 else None)
            for values, start in ((self.n, 0), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.conv, None), (self.ends, None)):
                values.append(start)
        at = self.open[-1]
        self.n[at] += row["n"]
        self.conv[at] = row["conv_id"]
        self.ends[at] = row["ends_sha256"]
        self.children[at] += row["n_children"] or 0
        self.leaves[at] += row["n_leaves"] or 0
        self.saved[at] += row["saved_tokens"] or 0
        self.last = key

    def rows(self) -> Iterator[tuple]:
        """Nodes with all their aggregates; those of the skeleton with what this shard adds to them."""
        for i in range(len(self.parent) - 1, -1, -1):
            if self.slot[i] < 0:
                _close(self, i)
                if self.level[i]:
                    _add(self, self.parent[i], self, i)
        for i, parent in enumerate(self.parent):
            known = self.slot[i] < 0 and self.level[i]
            yield (
                self.slot[i], self.slot[parent] if known else -1, self.roots[i], self.words[i], self.segment[i], self.level[i],
                self.conv[i], self.conv[parent] if known else None,
                self.n[i], self.children[i], self.leaves[i], self.saved[i], self.ends[i],
            )


def _close(nodes: _Shard, i: int) -> None:
    """Add what a node counts for itself, once all its children are in. A full path goes on below its segment."""
    if nodes.children[i] == 0 and nodes.level[i] < nodes.full:
        nodes.leaves[i] = 1
    if nodes.level[i]:
        nodes.saved[i] += (nodes.n[i] - 1) * nodes.words[i]


def _add(parents: _Shard, p: int, nodes: _Shard, i: int) -> None:
    parents.n[p] += nodes.n[i]
    parents.children[p] += 1
    parents.leaves[p] += nodes.leaves[i]
    parents.saved[p] += nodes.saved[i]
    if nodes.conv[i] is not None and (parents.conv[p] is None or nodes.conv[i] < parents.conv[p]):
        parents.conv[p] = nodes.conv[i]


def _batches(rows: Iterable[tuple], size: int = 8192) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in NODES.split(", "))])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _in_shards(skeleton, roots_only: bool) -> Callable:
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished() -> Iterator[tuple]:
            shard, now = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["shard"] != now:
                        if shard:
                            yield from shard.rows()
                        shard, now = _Shard(skeleton.value), row["shard"]
                    shard.add(row)
            if shard:
                yield from shard.rows()

        yield from _batches(r for r in finished() if not roots_only or r[0] >= 0 or r[5] == 0)

    return build


def _reduced(skeleton) -> Callable:
    """Completes the skeleton from its reduced partial aggregates, children before parents."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, nodes = skeleton.value, _Shard(skeleton.value)
        size = len(frame.parents)
        nodes.level, nodes.n, nodes.children, nodes.leaves, nodes.saved = frame.levels, *([0] * size for _ in range(4))
        nodes.words, nodes.conv, nodes.ends = [0] * size, [None] * size, [None] * size
        for batch in batches:
            for row in batch.to_pylist():
                i = row["slot"]
                nodes.n[i], nodes.children[i], nodes.leaves[i] = row["n_convs"], row["n_children"], row["n_leaves"]
                nodes.saved[i], nodes.words[i], nodes.conv[i], nodes.ends[i] = row["saved_tokens"], row["words"], row["conv_id"], row["ends_sha256"]
        for i in range(size - 1, -1, -1):
            _close(nodes, i)
            if frame.parents[i] >= 0:
                _add(nodes, frame.parents[i], nodes, i)
        yield from _batches(
            (
                i, frame.parents[i], frame.roots[i], nodes.words[i], frame.segments[i], frame.levels[i], nodes.conv[i],
                nodes.conv[frame.parents[i]] if frame.parents[i] >= 0 else None,
                nodes.n[i], nodes.children[i], nodes.leaves[i], nodes.saved[i], nodes.ends[i],
            )
            for i in range(size) if nodes.n[i]
        )

    return build


def _nodes(paths: DataFrame, segment: int, shard_turns: int, roots_only: bool = False) -> DataFrame:
    """The nodes of the tries of all roots among distinct ``paths``, in columns ``NODES``; depth counts from the root."""
    skeleton = _skeleton(paths, segment, shard_turns)
    shared = paths.sparkSession.sparkContext.broadcast(skeleton)

    def to_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [bisect.bisect_right(shared.value.splitters, k) for k in batch.column("key").to_pylist()]
            yield batch.append_column("shard", pa.array(shards, pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema)
    sorted_shards = (
        paths.mapInArrow(to_shards, f"{fields}, shard bigint")
        .repartition(len(skeleton.splitters) + 1, "shard")
        .sortWithinPartitions("shard", "key")
    )
    found = pin(sorted_shards.mapInArrow(_in_shards(shared, roots_only), NODES))
    totals = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    partial = found.filter("slot >= 0").groupBy("slot").agg(
        *(F.sum(c).alias(c) for c in totals), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    frame = pin(partial.repartition(1).mapInArrow(_reduced(shared), NODES))
    local = found.filter("slot < 0")
    if not roots_only:
        # at most one row per turn of a splitter
        above = F.broadcast(frame.select(F.col("slot").alias("parent_slot"), F.col("conv_id").alias("above")))
        local = local.join(above, "parent_slot", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return local.select(*frame.columns).unionByName(frame)


def _below(roots: DataFrame, segments: DataFrame) -> DataFrame:
    """``below, n_children, n_leaves, saved_tokens`` of everything under the end of each full path.

    Each trie below the first one has its own totals. Its smallest member is charged with them; a sum along each
    conversation from its end, and one over the members of a root, then count every trie below once.
    """
    charges = roots.select("root", "conv_id", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    to_end = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, 0)
    along = (
        segments.filter("segment > 0")
        .select("conv_id", "segment", "root")
        .join(charges, ["root", "conv_id"], "left")
        .select("root", *(F.sum(F.coalesce(c, F.lit(0))).over(to_end).alias(c) for c in ("leaves", "saved")))
    )
    totals = along.groupBy("root").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return roots.select("root", "n_children").join(totals, "root").withColumnRenamed("root", "below")


def conversation_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of conversations: one row for each distinct sequence of first turns.

    ``turns`` has ``conv_id, place, digest, words`` (places from 0 without gaps, a turn's digest as 32 hex digits),
    ``convs`` one row per conversation with ``n_turns``. Returns ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Conversations are counted by path first, so a group of copies is one row. Splitters cut the sorted paths into
    shards. Only prefixes of splitters have members in more than one shard, so each shard finishes all its other
    nodes, and the partial aggregates of the skeleton are reduced and summed along it. Long conversations are cut
    into segments of ``segment`` turns with tries of their own, so no row or task holds a whole one.

    Defined cases: an empty table has no nodes; conversations without turns are members of the root alone; equal
    conversations share all their nodes.
    """
    segments = pin(_segments(turns, convs, segment))
    counted = segments.groupBy("key").agg(
        F.first("segment").alias("segment"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("conv_id"), F.first("below").alias("below"),
    )
    full = F.when(F.length("key") == HEAD + segment * DIGEST, F.col("below"))
    paths = pin(counted.join(_ends(segments), "key", "left").withColumn("below", full))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    roots = pin(_nodes(paths.filter("segment > 0").select("*", *none), segment, shard_turns, roots_only=True).filter("depth = 0"))
    inner = paths.join(_below(roots, segments), "below", "left").drop("below")
    nodes = _nodes(inner, segment, shard_turns).filter("depth > 0 OR segment = 0")
    return nodes.select(
        "conv_id",
        (F.col("segment") * segment + F.col("depth")).alias("depth"),
        "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
