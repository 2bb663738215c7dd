"""Near-duplicate vectors: inverted lists with product quantization, confirmed by exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymill.llm.common import pin
from tidymill.llm.graph import components

SUBSPACES = 8
WORDS = 64  # code words per subspace
GROUP_ROWS = 2048  # vectors of a list that one block compares with another
PAIRS = 1 << 16  # candidates whose cosine is computed at once


def _means(points: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's method; a centre without points is put on a random one."""
    count = min(count, len(points))
    centres = points[rng.choice(len(points), count, replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points[rng.integers(0, len(points), count)])
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)


@dataclass(frozen=True)
class Quantizer:
    """Coarse centres and the code words of residuals in each subspace, for unit vectors of one length."""

    centres: np.ndarray
    words: np.ndarray  # subspace, word, part of the vector

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 5) -> Quantizer:
        rng = np.random.default_rng(seed)
        width = math.ceil(sample.shape[1] / SUBSPACES) * SUBSPACES
        sample = np.pad(sample, ((0, 0), (0, width - sample.shape[1])))
        centres = _means(sample, lists, 8, rng)
        residuals = (sample - centres[_nearest(sample, centres)]).reshape(len(sample), SUBSPACES, -1)
        return cls(centres, np.stack([_means(np.resize(residuals[:, m], (max(len(sample), WORDS), width // SUBSPACES)), WORDS, 8, rng) for m in range(SUBSPACES)]))

    def padded(self, units: np.ndarray) -> np.ndarray:
        return np.pad(units, ((0, 0), (0, self.centres.shape[1] - units.shape[1])))

    def probes(self, units: np.ndarray, count: int) -> np.ndarray:
        """The nearest lists of each vector, its own first."""
        far = (self.centres**2).sum(axis=1)[None, :] - 2 * self.padded(units) @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :count]

    def codes(self, units: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The code of each residual, and the smallest estimate of a query whose cosine is at least ``least``.

        What an estimate lacks is the query times the error of the code. Of the error, the part along the vector counts
        by the cosine and the part across it by the sine at most, so no such query has a lower estimate.
        """
        residuals = (self.padded(units) - self.centres[own]).reshape(len(units), SUBSPACES, -1)
        codes = np.stack([_nearest(residuals[:, m], self.words[m]) for m in range(SUBSPACES)], axis=1)
        decoded = np.stack([self.words[m][codes[:, m]] for m in range(SUBSPACES)], axis=1)
        errors = (residuals - decoded).reshape(len(units), -1)
        along, square = (errors * self.padded(units)).sum(axis=1), (errors**2).sum(axis=1)
        across = np.sqrt(np.maximum(square - along**2, 0))
        sine = math.sqrt(max(1 - least**2, 0))
        # it grows with the cosine as long as the error along the vector is below one
        bound = np.where((along < 1) & (least >= 0), least * (1 - along) - sine * across, least - np.sqrt(square))
        return codes.astype(np.uint8), bound - 1e-6

    def estimates(self, units: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded vectors of one list, looked up in tables of the queries."""
        queries = self.padded(units)
        tables = np.einsum("qmd,mkd->mqk", queries.reshape(len(units), SUBSPACES, -1), self.words)
        out = np.repeat((queries @ self.centres[centre])[:, None], len(codes), axis=1)
        for m in range(SUBSPACES):
            out += tables[m][:, codes[:, m]]
        return out


def _units(raw: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _placed(quantizers: dict[int, Quantizer], probes: int, least: float):
    """Each vector once in its own list (with code) and as a query in all lists it probes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for length in np.unique(dims):
                part = batch.filter(pa.array(dims == length))
                model, raw = quantizers[int(length)], part.column("vector").to_pylist()
                units = _units(raw)
                lists = model.probes(units, probes)
                codes, bound = model.codes(units, lists[:, 0], least)
                count = lists.shape[1]
                rows = np.repeat(np.arange(len(raw)), count + 1)
                is_query = np.tile([False] + [True] * count, len(raw))
                where = np.concatenate([lists[:, :1], lists], axis=1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array(rows)) for c in ("node", "label", "dims", "vector")]
                    + [pa.array(where.astype(np.int32)), pa.array(is_query)]
                    + [pa.array([codes[r].tobytes() for r in rows], pa.binary()), pa.array(bound[rows])],
                    ["node", "label", "dims", "vector", "list", "is_query", "code", "bound"],
                )

    return run


def _linked(quantizers: dict[int, Quantizer], least: float):
    """Pairs of one block: estimated by table look-up, then confirmed by exact cosine in double precision."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        is_query = group.column("is_query").to_numpy()
        queries, base = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query))
        if not queries.num_rows or not base.num_rows:
            return schema.empty_table()
        model = quantizers[group.column("dims")[0].as_py()]
        q, x = _units(queries.column("vector").to_pylist()), _units(base.column("vector").to_pylist())
        codes = np.frombuffer(b"".join(base.column("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        bound = base.column("bound").to_numpy()
        qn, xn = queries.column("node").to_numpy(), base.column("node").to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for start in range(0, len(q), 256):
            block = slice(start, start + 256)
            i, j = np.nonzero(model.estimates(q[block], group.column("list")[0].as_py(), codes) >= bound[None, :])
            i += start
            apart = qn[i] != xn[j]
            i, j = i[apart], j[apart]
            parts = [slice(k, k + PAIRS) for k in range(0, len(i), PAIRS)]
            sure = np.concatenate([np.zeros(0, bool), *((q[i[p]] * x[j[p]]).sum(axis=1) >= least for p in parts)])
            i, j = i[sure], j[sure]
            found.append(np.stack([np.minimum(qn[i], xn[j]), np.maximum(qn[i], xn[j])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    least: float = 0.93,
    probes: int = 16,
    sample: int = 10_000,
) -> DataFrame:
    """Link vectors of one label whose cosine is at least ``least``.

    Returns ``vec_id, n_links, component_id, kept`` for every row: the other vectors linked directly, the smallest
    id reachable, and whether it is the row's own.

    Equal vectors of a label are one class, counted before the shuffle and never expanded into pairs. Classes lie
    in coarse lists, about half the square root of their number, with the codes of their residuals. Each class
    probes its ``probes`` nearest lists; candidates by table look-up are confirmed by exact cosine, so
    no link is false, and the look-up drops no candidate that the cosine would confirm: a link is lost only if neither
    end probes the list of the other. Lists are cut into blocks of bounded size, and only vectors of one label meet. The
    quantizer is fitted on at most ``sample`` classes (the smallest hashes of their ids), all are indexed.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null label or id, link with nothing. Vectors of different lengths never link. Rows that repeat an id
    and a vector count as other vectors. An empty table gives an empty result.
    """
    numbers = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite
    usable &= F.exists("vector", lambda x: x != 0)
    rows = pin(numbers.withColumn("usable", F.coalesce(usable, F.lit(False))))
    classes = pin(
        rows.filter("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size"))
    )
    lengths = [r["dims"] for r in classes.select(F.size("vector").alias("dims")).distinct().collect()]  # one row per length
    coded = classes.select("node", "label", F.size("vector").alias("dims"), "vector")
    quantizers = {}
    for length in lengths:
        of_length = coded.filter(F.col("dims") == length)
        lists = min(4096, max(1, round(of_length.count() ** 0.5 / 2)))
        drawn = of_length.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").collect()
        points = np.array([r["vector"] for r in drawn])
        quantizers[length] = Quantizer.fit(points / np.sqrt((points * points).sum(axis=1, keepdims=True)), lists)
    shared = vectors.sparkSession.sparkContext.broadcast(quantizers)  # at most 4,096 centres per length of vectors
    packed = coded.mapInArrow(_packed, "node bigint, label string, dims int, vector binary")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _placed(shared.value, probes, least)(batches)

    def link(group: pa.Table) -> pa.Table:
        return _linked(shared.value, least)(group)

    placed = packed.mapInArrow(
        place, "node bigint, label string, dims int, vector binary, list int, is_query boolean, code binary, bound double"
    )
    key = ["label", "dims", "list"]
    placed = pin(placed)
    sizes = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("blocks"))
    own = placed.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.when(F.col("is_query"), F.col("own")).otherwise(F.col("other")))
    dealt = dealt.withColumn("j", F.when(F.col("is_query"), F.col("other")).otherwise(F.col("own")))
    links = pin(dealt.drop("blocks", "own", "other").groupBy(*key, "i", "j").applyInArrow(link, "a bigint, b bigint").distinct())
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes_of = classes.select(F.col("node").alias("b"), "size")
    counts = both.join(sizes_of, "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("others"))
    member = classes.join(counts, "node", "left").join(components(links), "node", "left")
    member = member.select(
        "label", "vector", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    joined = rows.filter("usable").join(member, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.array(v, np.float64).tobytes() for v in batch.column("vector").to_pylist()]
        yield batch.set_column(3, "vector", pa.array(raw, pa.binary()))
