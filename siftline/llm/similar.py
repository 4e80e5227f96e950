"""Most similar vectors for every vector: vantage-point trees per shard, pruned by a relaxed triangle inequality.

Shards are cut along principal directions at sparse places, so that few vectors lie near a border and have copies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import shipped, stored


class VantageTree:
    """A vantage-point tree over unit vectors, searched for whole blocks of queries at a time.

    A node halves its rows at the median distance to its vantage point. A query with search radius r must visit the
    other side only if its own distance lies within r of that median (triangle inequality); ``factor`` scales r for
    that test only. 1 is exact; less prunes more.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = 256, seed: int = 7):
        self.vectors, self.leaf = np.ascontiguousarray(vectors, np.float32), leaf
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows, self.vectors[rows]
        sample = self.vectors[self.random.choice(rows, min(len(rows), 256), replace=False)]
        points = sample[: min(24, len(sample))]
        point = points[np.argmax(distances(sample, points).var(axis=0))]
        d = distances(self.vectors[rows], point[None])[:, 0]
        middle = float(np.median(d))
        near = d < middle
        if not near.any():
            near = d <= middle
        if near.all():  # all at one distance: no use in halving
            return rows, self.vectors[rows]
        return point, middle, self._build(rows[near]), self._build(rows[~near])

    def search(self, queries: np.ndarray, cosine: float, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, cosine) of all pairs found at or above the cosine."""
        radius = math.sqrt(max(0.0, 2 - 2 * cosine))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def walk(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 2:
                base, vectors = node
                if len(base):
                    score = queries[rows] @ vectors.T
                    i, j = np.nonzero(score >= cosine - 1e-5)
                    found.append((rows[i], base[j], score[i, j]))
                return
            point, middle, near, far = node
            d = distances(queries[rows], point[None])[:, 0]
            walk(near, rows[d < middle + radius * factor])
            walk(far, rows[d >= middle - radius * factor])

        walk(self.root, np.arange(len(queries)))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Router:
    """Cuts the space of unit vectors into shards: each node parts a sample by its principal direction, at the sparsest
    place between ``low`` and ``high`` of it. A projection moves by no more than the distance of two vectors, so what
    lies within a radius of a border goes to both sides."""

    def __init__(self, sample: np.ndarray, leaf: int, slack: float, low: float = 0.35, high: float = 0.65):
        self.leaf, self.slack, self.low, self.high = max(1, leaf), slack, low, high
        self.leaves = 0
        self.root = self._build(np.asarray(sample, np.float32))

    def _build(self, x: np.ndarray):
        cut = self._cut(x) if len(x) > self.leaf else None
        if cut is None:
            self.leaves += 1
            return None
        direction, place, near = cut
        return direction, place, self._build(x[near]), self._build(x[~near])

    def _cut(self, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        centred = x - x.mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1].astype(np.float32)
        z = x @ direction
        inner = np.sort(z)
        places = inner[int(len(z) * self.low) : max(int(len(z) * self.low) + 1, int(len(z) * self.high))]
        crowd = np.searchsorted(inner, places + self.slack) - np.searchsorted(inner, places - self.slack)
        place = float(places[crowd.argmin()])
        near = z < place
        return (direction, place, near) if near.any() and not near.all() else None  # all equal: no use in cutting

    def route(self, vectors: np.ndarray, slack: float) -> list[np.ndarray]:
        """For each shard in order, the rows of ``vectors`` that come within slack of it."""
        out: list[np.ndarray] = []

        def walk(node, rows: np.ndarray) -> None:
            if node is None:
                out.append(rows)
                return
            direction, place, near, far = node
            z = vectors[rows] @ direction
            walk(near, rows[z < place + slack])
            walk(far, rows[z >= place - slack])

        walk(self.root, np.arange(len(vectors)))
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def usable(vectors: DataFrame, group: str, key: str, vec: str) -> DataFrame:
    """(grp, key, unit): vectors of the size that most rows of their group have, scaled to length 1. Null, empty,
    wrongly sized, all-zero and non-finite ones are left out; repeated rows are kept, similar_keys drops them. A key
    that comes with different vectors is searched with one of them in each shard."""
    shipped(vectors.sparkSession)
    v = vectors.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(vec).cast("array<float>").alias("vec")).where("key is not null and size(vec) > 0")
    sizes = v.groupBy("grp", F.size("vec").alias("size")).count()
    usual = {r["grp"]: r["usual"] for r in sizes.groupBy("grp").agg(F.max_by("size", F.struct("count", "size")).alias("usual")).collect()}  # one row for each model

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, key_, vec_ = batch.columns
            names, sizes = np.asarray(grp.to_pylist(), object), np.asarray(vec_.value_lengths())
            for name in dict.fromkeys(names):
                size = usual[name]
                rows = np.flatnonzero((names == name) & (sizes == size))
                flat = vec_.take(pa.array(rows)).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
                length = np.sqrt((x * x).sum(axis=1))
                ok = np.isfinite(length) & (length > 0)
                x = (x[ok] / length[ok, None]).astype(np.float32)
                kept = pa.array(rows[ok])
                yield pa.RecordBatch.from_arrays([grp.take(kept), key_.take(kept), pa.array([r.tobytes() for r in x], pa.binary())], names=["grp", "key", "unit"])

    kind = v.schema["key"].dataType.simpleString()
    return v.mapInArrow(scale, f"grp string, key {kind}, unit binary")


#: Sampled vectors for each shard, and in all for a group.
SHARD_SAMPLE, SAMPLE_LIMIT = 40, 2_000_000


def similar_keys(vectors: DataFrame, cosine: float, k: int = 5, factor: float = 0.12, route_factor: float = 0.065, shards: int = 16, shard_rows: int = 200_000, sample_rows: int = 20_000, leaf: int = 1536) -> DataFrame:
    """(grp, key, other, cosine): for every vector its up to k most similar others of the group at or above the cosine,
    ties in favour of the smaller key.

    vectors: what usable() returns; it is read again rather than stored. A Router fitted on a bounded sample of each
    group (sample_rows, or SHARD_SAMPLE a shard, SAMPLE_LIMIT at most) cuts its space into shards: ``shards``, or as many
    as hold shard_rows each; more shards than SAMPLE_LIMIT can tell apart are an error that asks for larger ones. Every
    vector is indexed in its home shard; it is searched there and in each shard within route_factor of the search radius. In a
    shard a VantageTree with ``factor`` finds partners, and a query keeps its k best there, ties included. What either
    of two vectors finds counts for both, so that a pair is lost only if both miss it. Both factors 1: exact.

    Of vectors that are equal byte for byte only the k + 1 with the smallest keys are searched: they are the k most
    similar others of the rest, and come before the rest for any other vector. Batches are thinned to them before the
    shuffle, shards after it, so that a vector that a third of all rows share fills no shard.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["key"].dataType.simpleString()
    marks = stored(vectors.select("grp", "key", F.xxhash64("unit").alias("h1"), F.hash("unit").alias("h2")))
    counts = {r["grp"]: r["n"] for r in marks.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # one row for each model
    many = marks.groupBy("grp", "h1", "h2").agg(F.count_distinct("key").alias("n")).where(F.col("n") > k + 1).drop("n")
    copies = stored(marks.join(many, ["grp", "h1", "h2"], "left_semi").distinct())
    smallest = F.row_number().over(Window.partitionBy("grp", "h1", "h2").orderBy("key"))
    heads = stored(copies.withColumn("rank", smallest).where(F.col("rank") <= k + 1))  # each task keeps k + 1 before the shuffle
    extra = copies.join(heads.select("grp", "key", "h1", "h2"), ["grp", "key", "h1", "h2"], "left_anti")
    trees: dict[str, tuple[int, Router | None]] = {}
    slack = math.sqrt(max(0.0, 2 - 2 * cosine)) * route_factor
    first = 0
    for grp, n in sorted(counts.items()):
        wanted = 1 if n <= 2 * leaf else max(shards, -(-n // shard_rows))
        tree = None
        if wanted > 1:
            part = vectors.where(F.col("grp") == grp)
            rows = max(sample_rows, SHARD_SAMPLE * wanted)
            if rows > SAMPLE_LIMIT:
                raise ValueError(f"{wanted} shards for {n} vectors; give a larger shard_rows")
            some = part.select("unit").sample(min(1.0, 1.2 * rows / n), seed=11).limit(rows).toPandas()["unit"]
            tree = Router(np.stack([np.frombuffer(u, np.float32) for u in some]), math.ceil(len(some) / wanted), slack) if len(some) else None
        trees[grp] = (first, tree)
        first += tree.leaves if tree else 1
    shared = spark.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = np.asarray(batch.column(0).to_pylist(), object)
            for g in dict.fromkeys(grp):
                rows = np.flatnonzero(grp == g)
                some = pa.array(rows)
                rows = rows[fewer_copies(batch.column(2).take(some), batch.column(1).take(some), k + 1)]
                start, tree = shared.value[g]
                if tree is None:
                    at, shard, home = rows, np.full(len(rows), start), np.ones(len(rows), bool)
                else:
                    x = unpacked(batch.column(1).take(pa.array(rows)))
                    own = np.empty(len(rows), int)
                    for s, r in enumerate(tree.route(x, 0.0)):
                        own[r] = s
                    near = tree.route(x, slack)
                    at = np.concatenate(near)
                    shard = np.repeat(np.arange(len(near)), [len(r) for r in near])
                    home = own[at] == shard
                    at, shard = rows[at], shard + start
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(home), batch.column(0).take(take), batch.column(2).take(take), batch.column(1).take(take)], names=["shard", "home", "grp", "id", "unit"])

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in rows if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()  # one shard
        del batches
        t = t.take(pa.array(fewer_copies(t.column("id").combine_chunks(), t.column("unit").combine_chunks(), k + 1))).combine_chunks()
        x = unpacked(t.column("unit").combine_chunks())
        home = np.flatnonzero(t.column("home").to_numpy(zero_copy_only=False))
        if not len(home):
            return
        tree = VantageTree(x[home], leaf=leaf)
        ids, grp = t.column("id").combine_chunks(), t.column("grp")[0].as_py()
        for at in range(0, len(x), 16_384):
            q, b, score = tree.search(x[at : at + 16_384], cosine, factor)
            q, b = q + at, home[b]
            exact = np.einsum("ij,ij->i", x[q].astype(np.float64), x[b].astype(np.float64))
            ok = (q != b) & (exact >= cosine - 1e-7)
            q, b, exact = q[ok], b[ok], exact[ok]
            order = np.lexsort((-exact, q))
            q, b, exact = q[order], b[order], exact[order]
            begin = np.searchsorted(q, q)
            kth = exact[np.minimum(begin + k - 1, np.searchsorted(q, q, side="right") - 1)]
            hit = exact >= kth - 1e-9
            q, b, exact = q[hit], b[hit], exact[hit]
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(q), pa.string()), ids.take(pa.array(q)), ids.take(pa.array(b)), pa.array(exact)], names=["grp", "p", "q", "cosine"])

    routed = vectors.select("grp", "unit", F.col("key").alias("id")).mapInArrow(route, f"shard int, home boolean, grp string, id {kind}, unit binary")
    found = stored(routed.repartitionById(max(1, first), "shard").mapInArrow(search, f"grp string, p {kind}, q {kind}, cosine double"))
    links = found.union(found.select("grp", F.col("q"), F.col("p"), "cosine")).groupBy("grp", F.col("p").alias("key"), F.col("q").alias("other")).agg(F.max("cosine").alias("cosine"))
    rest = extra.join(heads.where(F.col("rank") <= k).select("grp", "h1", "h2", F.col("key").alias("other")), ["grp", "h1", "h2"]).select("grp", "key", "other", F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("grp", "key").orderBy(F.round("cosine", 9).desc(), "other")
    return links.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def fewer_copies(ids: pa.Array, units: pa.Array, most: int) -> np.ndarray:
    """Rows without repeats, and of equal vectors those with the ``most`` smallest keys."""
    frame = pd.DataFrame({"id": ids.to_pylist(), "unit": [xxhash.xxh3_64_intdigest(u) for u in units.to_pylist()]})
    if not frame["unit"].duplicated().any():
        return np.arange(len(frame))
    frame = frame.drop_duplicates("id").sort_values("id")
    return np.sort(frame.index[frame.groupby("unit").cumcount() < most].to_numpy())


def unpacked(units: pa.Array) -> np.ndarray:
    """Rows of equal length from packed unit vectors."""
    start, stop = (int.from_bytes(units.buffers()[1][4 * i : 4 * i + 4], "little") for i in (units.offset, units.offset + len(units)))
    return np.frombuffer(units.buffers()[2], np.float32, (stop - start) // 4, start).reshape(len(units), -1)


#: Bytes of reference vectors that go to every worker at once.
BLOCK_BYTES = 64 << 20


def nearest_reference(vectors: DataFrame, reference: DataFrame, name: str, vec: str, cosine: float, size: int, leaf: int = 1024, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, ref, cosine): for each unit vector the most similar entry of a reference list (smallest name on a tie) if
    it reaches the cosine. Entries that are null, empty, all-zero, not finite or not of ``size`` numbers are left out.

    A block of the list of up to block_bytes is one exact vantage-point tree on every worker; a longer list takes a pass
    over the vectors for each block, and the best of all blocks counts, so a list of any length gives the same rows."""
    shipped(vectors.sparkSession)
    kind = vectors.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ref string, cosine double"
    entries = reference.select(F.col(name).cast("string").alias("ref"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("ref").isNotNull() & (F.size("vec") == size))
    found = None
    for names, matrix in _blocks(entries, size, block_bytes):
        part = vectors.select("key", "unit").mapInArrow(_nearest(vectors, names, matrix, cosine, leaf), schema)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return found.groupBy("key").agg(F.min(F.struct((-F.round("cosine", 9)).alias("c"), "ref", "cosine")).alias("m")).select("key", "m.ref", "m.cosine")


def _blocks(entries: DataFrame, size: int, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names and unit vectors of the list in blocks; one block at a time is in the driver."""
    names, rows = [], []

    def block() -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(np.array(names, object), kind="stable")
        return np.array(names, object)[order], np.stack(rows)[order]

    for r in entries.toLocalIterator():
        v = np.array(r["vec"], np.float64)
        length = np.linalg.norm(v) if np.isfinite(v).all() else 0.0
        if length > 0:
            names.append(r["ref"])
            rows.append((v / length).astype(np.float32))
        if len(rows) * size * 4 >= block_bytes:
            yield block()
            names, rows = [], []
    if rows:
        yield block()


def _nearest(vectors: DataFrame, names: np.ndarray, matrix: np.ndarray, cosine: float, leaf: int):
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, x_ref = shared.value
        tree = VantageTree(x_ref, leaf=leaf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column(1))
            q, b, _ = tree.search(x, cosine, 1.0)
            exact = np.einsum("ij,ij->i", x[q].astype(np.float64), x_ref[b].astype(np.float64))
            hits = pd.DataFrame({"q": q, "ref": refs[b] if len(b) else [], "c": exact})
            hits = hits[hits.c >= cosine - 1e-7].sort_values(["q", "c", "ref"], ascending=[True, False, True]).drop_duplicates("q")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hits.q.to_numpy(np.int64))), pa.array(list(hits.ref), pa.string()), pa.array(hits.c.to_numpy(np.float64))], names=["key", "ref", "cosine"])

    return run
