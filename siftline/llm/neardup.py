"""Near-duplicate records: SuperMinHash signatures, banding, exact verification, grouping.

Ertl's SuperMinHash gives slot p_x(j) of the signature the value j + r_x(j), where p_x is a random permutation of the
slots that belongs to element x; the signature holds the smallest value in each slot. Ranks of one element are thus
correlated (no two of its values share a slot or an integer part), which lowers the variance against independent
permutations. Steps are made level by level over all elements of a batch at once: after level j a signature whose
values are all below j + 1 cannot change any more and leaves, which is the early stopping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import union_find
from ..runtime import shipped, stored
from . import words as W

CHUNK = 24_000


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (one row of m uint64 for each set): the level in the top 8 bits, the random part below. m <= 256.

    Sets must not be empty; equal sets give equal signatures, and two signatures agree in a slot with the probability
    of the Jaccard similarity of their sets.
    """
    if not 1 < m <= 256:
        raise ValueError("m must be from 2 to 256")
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    begin = 0
    while begin < len(sets):
        end, total = begin, 0
        while end < len(sets) and (end == begin or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        _levels(np.concatenate(sets[begin:end]), np.repeat(np.arange(begin, end), [len(x) for x in sets[begin:end]]), out, flat, m)
        begin = end
    return out


def _levels(x: np.ndarray, owner: np.ndarray, out: np.ndarray, flat: np.ndarray, m: int) -> None:
    order: np.ndarray | None = None
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = W.mixed(x + np.uint64(j + 1) * W.GOLDEN)
        at = (j + (((draw >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32))).astype(np.int64)
        if j:
            rows = np.arange(len(x))
            slot = order[rows, at].astype(np.int64)
            order[rows, at] = order[:, j]
        else:
            slot = at
        np.minimum.at(flat, owner * m + slot, (np.uint64(j) << np.uint64(56)) | (W.mixed(draw) >> np.uint64(8)))
        docs = np.unique(owner)
        open_ = docs[(out[docs] >= (np.uint64(j + 1) << np.uint64(56))).any(axis=1)] if j < m - 1 else docs[:0]
        if not len(open_):
            return
        keep = np.isin(owner, open_) if len(open_) < len(docs) else np.ones(len(x), bool)
        if order is None:
            x, owner, first = x[keep], owner[keep], slot[keep]
            order = np.empty((len(x), m), np.uint8)
            order[:] = np.arange(m, dtype=np.uint8)
            order[np.arange(len(x)), first] = 0
        elif not keep.all():
            x, owner, order = x[keep], owner[keep], order[keep]


def _band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    n, m = signature.shape
    bands = m // rows
    cut = signature[:, : bands * rows].reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)) * W.GOLDEN
        for i in range(rows):
            key = W.mixed(key ^ cut[:, :, i]) + W.GOLDEN
    return key.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, k: int, slots: int, rows: int) -> DataFrame:
    """(key, n, mark, bands): size and 128-bit fingerprint of the shingle set, and its band keys. Texts with fewer than
    k words have no shingle and no row."""
    shipped(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Vocabulary()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [W.shingles(t.as_py(), k, known) for t in part.column(1)]
                live = [i for i, s in enumerate(sets) if len(s)]
                if not live:
                    continue
                sets = [sets[i] for i in live]
                bands = _band_keys(superminhash(sets, slots), rows)
                with np.errstate(over="ignore"):
                    mark = [np.array([s.sum(), W.mixed(s).sum()], np.uint64).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(live)), pa.array([len(s) for s in sets], pa.int32()), pa.array(mark, pa.binary()), pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), bands.reshape(-1))],
                    names=["key", "n", "mark", "bands"],
                )

    return docs.select(F.col(key), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, f"key {kind}, n int, mark binary, bands array<bigint>")


def _sets(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Vocabulary()
        for batch in batches:
            found = [W.shingles(t.as_py(), k, known).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "set"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, set binary")


def near_duplicates(docs: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, slots: int = 200, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate records as (members, links).

    members: (key, class), one row for each record with at least one shingle; records with equal shingle sets share a
    class, named by its smallest key. links: (a, b, jaccard), a < b, between class names whose sets of k consecutive
    words have a Jaccard similarity of at least the threshold. No link is expanded to the copies in a class.

    Candidates are classes that share a band of a SuperMinHash signature; with 40 bands of 5 slots a pair at 0.7 is
    missed with a probability of 0.0006, at 0.8 of 1e-7. Every candidate is verified on its whole sets. Buckets have no
    cap: bands meet in one equi-join, whose hot keys adaptive execution splits.
    Null keys and null texts are left out; repeated rows count once; an empty table gives empty results.
    """
    seen = stored(signatures(docs, key, text, k, slots, rows))
    reps = seen.groupBy("mark").agg(F.min("key").alias("class"))
    members = seen.select("key", "mark").distinct().join(reps, "mark").select("key", "class")
    heads = seen.groupBy("mark").agg(F.min_by(F.struct("key", "n", "bands"), "key").alias("head"))
    band = heads.select(F.col("head.key").alias("id"), "head.n", F.explode("head.bands").alias("band"))
    a, b = band.alias("a"), band.alias("b")
    fits = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    pairs = stored(a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id")) & fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = stored(_sets(docs.join(wanted.withColumnRenamed("key", key), key, "left_semi").select(key, text), key, text, k).dropDuplicates(["key"]))
    with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    kind = docs.schema[key].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                score[i] = common / (len(p) + len(q) - common)
            hit = pa.array(score >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["a", "b", "jaccard"]).filter(hit)

    return members, both.mapInArrow(verify, f"a {kind}, b {kind}, jaccard double")


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of records, copies within a class included. For results that must name each pair."""
    m = members.select("key", "class")
    within = m.alias("x").join(m.alias("y"), (F.col("x.class") == F.col("y.class")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    across = (
        links.join(m.select(F.col("class").alias("a"), F.col("key").alias("p")), "a")
        .join(m.select(F.col("class").alias("b"), F.col("key").alias("q")), "b")
        .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    )
    return within.union(across)


def near_duplicate_groups(docs: DataFrame, key: str, text: str, **params) -> DataFrame:
    """(key, class, group, links): one row for each record with a shingle. group is the smallest class of its connected
    component, links the number of other classes its class is linked to. Nulls, empties and repeats as in
    near_duplicates."""
    members, links = near_duplicates(docs, key, text, **params)
    links = stored(links)
    roots = union_find(links)
    degree = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    return (
        members.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        .join(degree, "class", "left")
        .select("key", "class", F.coalesce("root", "class").alias("group"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )
