"""Near copies among embeddings, by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a fast Walsh-Hadamard transform; a vector's hash is the axis, with its sign,
that lies nearest to the rotated vector. K such hashes make a cell, each of TABLES tables has rotations of its own. With
multiprobe a vector stands in 2^K cells of each table: those it would reach by taking the second or third nearest axis
where these are about as near. K is the least number whose cells are as many as the distinct vectors of the largest label,
so cells hold a few unrelated vectors however large the table is. At the threshold one table finds a pair of 64 components
with 98 % or more, all four miss fewer than one in a million (the tests measure it against brute force).

Pairs are verified, not listed: a cell's members meet in blocks of PART by PART, and a block yields the number of links of
each of its vectors and as many connections as join them. A pair counts in the first of the cells that both stand in, which
the block sees from the cells of its members. Equal vectors of a label are one class from the start: copies cost nothing.
A cloud of m vectors that differ takes m^2 / 2 inner products in each table, dealt to (m / PART)^2 / 2 tasks.

Linked are vectors of equal labels and equal length with a cosine of at least LEAST in double precision. Nulls, zero
vectors, empty ones, those with a null or non-finite component and those without a label are linked with nothing. Null ids
count as larger than all others; ids are integers. Rows equal in id, label and vector are judged alike, and linked.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jaccard

LEAST = 0.98
TABLES, AXES, SEED = 4, 4, 12
PART = 1024
"""So many members of a cell, about, meet so many others in a task."""
GROUP = 2048
"""Vectors hashed together."""


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; rows have a power of two columns."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def nearest_axes(x: np.ndarray, table: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The AXES nearest axes (with sign) of rotated rows, and how far each lies behind the nearest one, squared."""
    signs = np.random.default_rng([SEED, x.shape[1], table, k]).choice([-1.0, 1.0], (3, x.shape[1]))
    for own in signs:
        x = hadamard(x * own)
    size = np.abs(x)
    axes = np.argsort(-size, axis=1, kind="stable")[:, :AXES]
    near = np.take_along_axis(size, axes, 1)
    return axes * 2 + (np.take_along_axis(x, axes, 1) > 0), (near[:, :1] - near) ** 2


def width(dim: int) -> int:
    """Components after padding with zeros."""
    return max(16, 1 << (dim - 1).bit_length())


def hashes_for(vectors: int, dim: int) -> int:
    """How many hashes make a cell: so many that there are as many cells as vectors."""
    return max(1, math.ceil(math.log(max(vectors, 1)) / math.log(2 * width(dim)) - 1e-9))


def cells(x: np.ndarray, n_hashes: int) -> np.ndarray:
    """The cells of unit rows: TABLES times 2^n_hashes numbers each, no number twice."""
    own = np.zeros((len(x), width(x.shape[1])))
    own[:, : x.shape[1]] = x
    ways = np.array(list(itertools.product(range(AXES), repeat=n_hashes)))
    out = []
    for table in range(TABLES):
        found = [nearest_axes(own, table, k) for k in range(n_hashes)]
        cost = sum(cost[:, ways[:, k]] for k, (_, cost) in enumerate(found))
        best = np.argsort(cost, axis=1, kind="stable")[:, : 1 << n_hashes]
        code = np.full(best.shape, (x.shape[1] << 8) + table, dtype=np.uint64)
        for k, (axes, _) in enumerate(found):
            code = common.mix64(code * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(axes, ways[best, k], 1).astype(np.uint64) + np.uint64(1))
        out.append(code)
    return np.concatenate(out, axis=1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


SURVEY = "oid long, label {label}, s1 long, s2 long, vec binary"


def _survey(kind: type):
    """Rows (id, label, vector) with the hash of the vector and its bytes; null where it cannot be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, vec = [], [], []
            labelled = batch.column(1).is_valid().to_pylist()
            column = batch.column(2)
            offsets, values = np.asarray(column.offsets), column.values
            gaps = values.is_null().to_numpy(zero_copy_only=False)
            numbers = values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
            usable = np.isfinite(np.where(gaps, np.nan, numbers))
            for ok, there, a, b in zip(labelled, column.is_valid().to_pylist(), offsets, offsets[1:], strict=False):
                own = numbers[a:b] + kind(0)  # no negative zeros
                if not (ok and there and b > a and usable[a:b].all() and own.any()):
                    s1.append(None), s2.append(None), vec.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(own.tobytes())
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:], "little", signed=True))
                vec.append(own.tobytes())
            arrays = [*batch.columns[:2], pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=common.names_of(SURVEY))

    return run


def _cells(kind: type, most: int):
    """Rows (node, vector) with the vector's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                rows = [np.frombuffer(v, dtype=kind) for v in batch.column(1).slice(at, GROUP).to_pylist()]
                out: list = [None] * len(rows)
                for dim in {len(r) for r in rows}:
                    own = [i for i, r in enumerate(rows) if len(r) == dim]
                    found = cells(units(np.stack([rows[i] for i in own])), hashes_for(most, dim))
                    for i, x in zip(own, found, strict=True):
                        out[i] = x
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, GROUP), common.int_lists([common.signed(x) for x in out], pa.int64(), np.int64)], names=["node", "cells"])

    return run


def first_met(members: list[np.ndarray], cell: int, left: slice, right: slice) -> np.ndarray:
    """Which pairs of members, each given by its cells, stand together in no cell with a smaller number than this."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    own = np.concatenate(members)
    owner, own = owner[own < cell], own[own < cell]
    _, place, times = np.unique(own, return_inverse=True, return_counts=True)
    often = times > 1
    keep = often[place]
    stands = np.zeros((len(members), int(often.sum())), dtype=np.float32)
    stands[owner[keep], (np.cumsum(often) - 1)[place[keep]]] = 1
    return stands[left] @ stands[right].T == 0


def connections(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of names that connect what the links between a (rows) and b (columns) connect, at most one a name."""
    far = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(link, lb[None, :], far).min(axis=1, initial=far))
        nb = np.minimum(lb, np.where(link, na[:, None], far).min(axis=0, initial=far))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return sorted({(x, y) for x, y in zip([*a.tolist(), *b.tolist()], [*la.tolist(), *lb.tolist()], strict=True) if x != y})


FOUND = "a long, b long, n long"


def _verify(kind: type, least: float):
    """From rows (label, cell, pa, pb, part, node, rows, vec, cells), sorted: n links of a node (a), or a connection (a, b)."""

    def block(key: tuple, rows: list[tuple]) -> list[tuple]:
        _, cell, pa_, pb_ = key
        if len(rows) < 2:
            return []
        rows.sort(key=lambda r: r[0])
        n_left = sum(r[0] == pa_ for r in rows)
        left, right = (slice(0, n_left), slice(n_left, len(rows))) if pa_ < pb_ else (slice(0, len(rows)),) * 2
        x = units(np.stack([np.frombuffer(r[3], dtype=kind) for r in rows]))
        link = x[left] @ x[right].T >= least
        if pa_ == pb_:
            link = np.triu(link, 1)
        if not link.any():
            return []
        link &= first_met([np.asarray(r[4], dtype=np.int64) for r in rows], cell, left, right)
        nodes, sizes = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
        n = np.zeros(len(rows), dtype=np.int64)
        n[left] += link @ sizes[right]
        n[right] += sizes[left] @ link
        counts = [(int(nodes[i]), None, int(n[i])) for i in np.flatnonzero(n)]
        return counts + [(x, y, None) for x, y in connections(link, nodes[left], nodes[right])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []
        for key, own in itertools.groupby(rows(), key=lambda r: r[:4]):
            out += block(key, [r[4:] for r in own])
            if len(out) > 50_000:
                yield _found(out)
                out = []
        yield _found(out)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=common.names_of(FOUND))


class Links:
    """The steps of the join. members: a row per row of the table (oid, n_links, component: the smallest oid reachable)."""

    def __init__(self, table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> None:
        types = {f.name: f.dataType for f in table.schema.fields}
        single = types[vector].simpleString() == "array<float>"
        kind, named = np.float32 if single else np.float64, types[label].simpleString()
        source = table.select(
            common.order_id(key).alias("oid"), F.col(f"`{label}`").alias("label"),
            F.col(f"`{vector}`").cast("array<float>" if single else "array<double>").alias("vec")
        )
        self.survey = common.materialize(common.map_batches(source, _survey(kind), SURVEY.format(label=named)))
        classes = self.survey.filter("s1 is not null").groupBy("label", "s1", "s2").agg(
            F.min("oid").alias("oid"), F.count("*").alias("rows"), F.first("vec").alias("vec")
        )
        self.classes = common.materialize(classes.withColumn("node", F.monotonically_increasing_id()))
        self.kind, self.least = kind, least

    def found(self) -> DataFrame:
        """FOUND for all cells."""
        most = self.classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        made = common.map_batches(self.classes.select("node", "vec"), _cells(self.kind, most), "node long, cells array<long>")
        stands = common.materialize(self.classes.select("node", "label").join(made, "node"))
        each = stands.select("label", "node", F.explode("cells").alias("cell"))
        shared = each.groupBy("label", "cell").agg(F.count("*").alias("m")).filter("m > 1")
        shared = shared.select("label", "cell", F.expr(f"cast((m + {PART - 1}) div {PART} as int)").alias("parts"))
        places = each.join(common.materialize(shared), ["label", "cell"]).groupBy("node").agg(F.collect_list(F.struct("cell", "parts")).alias("places"))
        own = self.classes.select("node", "label", "rows", "vec").join(stands.select("node", "cells"), "node").join(places, "node")
        sent = own.select("label", "node", "rows", "vec", "cells", F.explode("places").alias("p")).select(
            "label", "p.cell", F.expr("cast(pmod(xxhash64(node, p.cell), p.parts) as int)").alias("part"), "p.parts", "node", "rows", "vec", "cells"
        )
        sent = sent.withColumn("with", F.explode(F.expr("sequence(0, parts - 1)"))).select(
            "label", "cell", F.expr("least(part, with)").alias("pa"), F.expr("greatest(part, with)").alias("pb"), "part", "node", "rows", "vec", "cells"
        )
        met = sent.repartition("label", "cell", "pa", "pb").sortWithinPartitions("label", "cell", "pa", "pb")
        return common.materialize(common.map_batches(met, _verify(self.kind, self.least), FOUND))

    def members(self) -> DataFrame:
        found = self.found()
        near = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
        joined = jaccard.components(found.filter("b is not null").select("a", "b"))
        nodes = self.classes.select("label", "s1", "s2", "oid", "rows", "node").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        nodes = common.materialize(nodes.join(near, "node", "left"))
        least = nodes.groupBy("comp").agg(F.min("oid").alias("component"))
        links = (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")
        nodes = jaccard.salted(nodes, least, "comp", "node").select("label", "s1", "s2", "component", links)
        linked = self.survey.filter("s1 is not null").select("oid", "label", "s1", "s2").join(nodes, ["label", "s1", "s2"]).select("oid", "n_links", "component")
        alone = self.survey.filter("s1 is null").select("oid", F.lit(0).cast("long").alias("n_links"), F.col("oid").alias("component"))
        return linked.unionByName(alone)


def keep_first(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """table, all columns, with the rows of the smallest id of each component."""
    (own,) = common.free_names(table, "_own")
    kept = Links(table, key, vector, label, least).members().filter("oid = component").select(F.col("oid").alias(own)).distinct()
    return table.withColumn(own, common.order_id(key)).join(kept, own, "left_semi").drop(own)


def op12(spark, sf_dir: str) -> DataFrame:
    members = Links(common.table(spark, sf_dir, "embeddings")).members()
    ids = {"vec_id": "oid", "component_id": "component"}
    return members.select(
        "n_links", (F.col("oid") == F.col("component")).alias("kept"), *(F.nullif(F.col(c), F.lit(2**63 - 1)).alias(name) for name, c in ids.items())
    ).select("vec_id", "n_links", "component_id", "kept")


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
     u AS (SELECT *, list_dot_product(e, e) AS s FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u AS x JOIN u AS y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
           WHERE x.s > 0 AND y.s > 0 AND list_dot_product(x.e, y.e) / (sqrt(x.s) * sqrt(y.s)) >= {LEAST}),
     r AS (SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
     m AS (SELECT node AS vec_id, min(seen) AS least_id FROM r GROUP BY node)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(least_id, vec_id)) AS BIGINT) AS component_id,
       least(vec_id, coalesce(least_id, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a) AS k USING (vec_id) LEFT JOIN m USING (vec_id)
"""
