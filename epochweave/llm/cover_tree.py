"""Embedding near-dedup: all pairs of vectors above a cosine, by dual traversal of cover trees.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2t). Points are taken farthest first, so that the first
few cover all others within a radius, more of them within half of it, and so on: the nested levels of a cover tree. Distributed, the
upper level comes from a bounded sample; every vector goes to its nearest centre, and each cell's covering radius is taken over
all its vectors. Cells of over `block` vectors are cut by hash. Every vector is written once, with its block; a task takes the pairs
of two short runs of blocks and reads these from the shared folder, so that what is shuffled and kept follows the input, however many
blocks a vector is compared with. A pair of blocks is left out if the radii keep them apart, and a vector joins only those pairs that
the radius of the other block and the plane between the two centres leave open.

Within a pair both sides get trees of their own. A pair of nodes is dropped if its bounds exceed the distance, taken as a whole if
its bounds are within it, split otherwise, and at the leaves multiplied in double precision. A task returns a count for each vector
and a forest of its links, so that a group of n like vectors costs n rows, not all its pairs.

In high dimensions vectors without near neighbours are all about equally far apart, and no metric tree can prune these; then the
leaves do the work as blocked matrix products, whose number grows with the square of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.llm.components import Forest, connected_components
from epochweave.llm.shared import discard, fresh_path, written
from epochweave.places import filesystem, remove

LEAF = 256
FANOUT = 16
SLACK = 1e-7
#: Blocks on a side of a task, and bytes of their vectors, at most.
SIDE = 8
SIDE_BYTES = 1 << 26


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that aren't null or empty, scaled to length one, end to end; and how long each is. They're scaled first, so that no square overflows."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy()
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    with np.errstate(all="ignore"):
        flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), first), lengths)
        flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, first)), lengths)
    return flat, lengths


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles of length one, shorter ones filled with zeros."""
    out = np.zeros((len(column), width))
    if len(column):
        flat, lengths = _unit(column)
        out[np.arange(width) < lengths[:, None]] = flat
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def farthest_first(x: np.ndarray, most: int, radius: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres until all points are within radius or there are `most`; for each point its nearest centre, and how far it is."""
    centres, nearest = [0], np.zeros(len(x), np.int64)
    far = distances(x, x[:1])[:, 0]
    while len(centres) < most and far.max() > radius:
        centres.append(int(far.argmax()))
        d = distances(x, x[centres[-1:]])[:, 0]
        closer = d < far
        nearest[closer], far[closer] = len(centres) - 1, d[closer]
    return centres, nearest, far


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray, whole: float) -> Node:
    """Children cover their node at half its radius, or as far as FANOUT of them do.

    Nodes within `whole` aren't split, nor those whose points stay about as far from the children's centres as they were.
    """
    centre = x[rows[0]]
    out = Node(centre, float(distances(x[rows], centre[None])[:, 0].max()) + SLACK, rows)
    if len(rows) > LEAF and 2 * out.radius > whole:
        _, nearest, far = farthest_first(x[rows], FANOUT, out.radius / 2)
        if far.mean() < 0.6 * out.radius:
            parts = [rows[nearest == k] for k in range(nearest.max() + 1)]
            out.children = [cover_tree(x, p, whole) for p in parts if len(p)] if max(map(len, parts)) < len(rows) else []
    return out


def near_pairs(x: np.ndarray, ids: np.ndarray, dims: np.ndarray, sides: np.ndarray, least: float, cross: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many others each row links with, and a forest of the links; in a cross task rows of side 0 with side 1 (with none, no pairs), else all with all."""
    theta, counts, forest, edges = math.sqrt(2 - 2 * least), np.zeros(len(x), np.int64), Forest(), []
    low = x.astype(np.float32)

    def join(a: int, b: int) -> None:
        if forest.join(a, b):
            edges.append((int(ids[a]), int(ids[b])))

    def base(p: np.ndarray, q: np.ndarray, same: bool) -> None:
        for i in range(0, len(p), 4 * LEAF):
            for j in range(i if same else 0, len(q), 4 * LEAF):
                a, b = p[i : i + 4 * LEAF], q[j : j + 4 * LEAF]
                r, c = np.nonzero(low[a] @ low[b].T >= least - 1e-4)  # in single precision, with room for its error
                r, c = a[r], b[c]
                keep = (ids[r] != ids[c]) & (dims[r] == dims[c])
                for k in range(0, len(r), 1 << 16):
                    keep[k : k + (1 << 16)] &= np.einsum("ij,ij->i", x[r[k : k + (1 << 16)]], x[c[k : k + (1 << 16)]]) >= least
                if same and i == j:
                    keep &= r < c
                r, c = r[keep], c[keep]
                np.add.at(counts, r, 1)
                np.add.at(counts, c, 1)
                for one in (r, c):  # each row with one partner first: then few pairs are still apart
                    _, first = np.unique(one, return_index=True)
                    for k, m in zip(r[first].tolist(), c[first].tolist(), strict=True):
                        join(k, m)
                top = np.arange(len(x))
                for k in np.unique(np.concatenate([r, c])).tolist():
                    top[k] = forest.root(k)
                apart = top[r] != top[c]
                for k, m in zip(r[apart].tolist(), c[apart].tolist(), strict=True):
                    join(k, m)

    def uniform(rows: np.ndarray) -> bool:
        return len(set(dims[rows].tolist())) == 1 and len(np.unique(ids[rows])) == len(rows)

    def visit(a: Node, b: Node) -> None:
        todo = [(a, b)]  # a function that calls itself would keep x until garbage is collected
        while todo:
            a, b = todo.pop()
            same = a is b
            apart = 0.0 if same else float(np.linalg.norm(a.centre - b.centre))
            if apart - a.radius - b.radius > theta + SLACK:
                continue
            if apart + a.radius + b.radius < theta - SLACK and uniform(a.rows if same else np.concatenate([a.rows, b.rows])):
                counts[a.rows] += len(b.rows) - same
                if not same:
                    counts[b.rows] += len(a.rows)
                for row in [*a.rows.tolist(), *([] if same else b.rows.tolist())]:
                    join(int(a.rows[0]), row)
            elif same and a.children:
                todo += [(c, d) for i, c in enumerate(a.children) for d in a.children[i:]]
            elif a.children and (not b.children or a.radius >= b.radius):
                todo += [(c, b) for c in a.children]
            elif b.children:
                todo += [(a, d) for d in b.children]
            else:
                base(a.rows, b.rows, same)

    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if cross and len(left) and len(right):
        visit(cover_tree(x, left, theta), cover_tree(x, right, theta))
    elif not cross and len(left) > 1:
        tree = cover_tree(x, left, theta)
        visit(tree, tree)
    return counts, edges


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector can be scaled to length one."""
    for batch in batches:
        batch = batch.filter(batch.column(1).is_valid())
        batch = batch.filter(pa.array(batch.column(1).value_lengths().to_numpy() > 0))
        if batch.num_rows:
            flat, lengths = _unit(batch.column(1))
            yield batch.filter(pa.array(np.logical_and.reduceat(np.isfinite(flat), np.cumsum(lengths) - lengths)))


def _nearest(column: pa.Array, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its nearest centre, and how far it is."""
    parts = [distances(as_matrix(column.slice(at, 1000), centres.shape[1]), centres) for at in range(0, len(column), 1000)]
    return np.concatenate([d.argmin(1) for d in parts]), np.concatenate([d.min(1) for d in parts])


def _cells(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(batch.column(0), centres)[0], pa.int32())], ["cell"])

    return run


def _placed(centres: np.ndarray, parts: np.ndarray):
    """Rows vec_id, e, part with block and cell, and far (from the cell's centre)."""
    first = np.cumsum(parts) - parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = _nearest(batch.column(1), centres)
                block = first[cell] + batch.column(2).to_numpy() % parts[cell]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block, pa.int32()), pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "e", "block", "cell", "far"])

    return run


@dataclass
class Block:
    """The vectors of one block, how long each is, and how many others each links with as far as is known."""

    x: np.ndarray
    ids: np.ndarray
    dims: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, folder: str, block: int, width: int) -> Block:
        files, where = filesystem(folder)
        rows = ds.dataset(f"{where}/block={block}", filesystem=files, format="parquet").to_table(columns=["vec_id", "e"], use_threads=False)
        e = rows.column("e").combine_chunks()
        return cls(as_matrix(e, width), rows.column("vec_id").to_numpy(), e.value_lengths().to_numpy(), np.zeros(len(e), np.int64))


def _linked(folder: str, centres: np.ndarray, blocks: np.ndarray, cells: np.ndarray, radius: np.ndarray, side: int, least: float):
    """Rows a, b, n of each task: its vectors a with links, and how many; or its links a, b that join what was apart. blocks: numbers, with their cells and radii."""
    theta, between = math.sqrt(2 - 2 * least), distances(centres, centres)

    def facing(x: np.ndarray, i: int, j: int) -> np.ndarray:
        """Which rows of block i may have a partner in block j."""
        own, other = distances(x, centres[[cells[i], cells[j]]]).T
        return np.flatnonzero((other <= radius[j] + theta + SLACK) & (other**2 - own**2 <= 2 * theta * between[cells[i], cells[j]] + SLACK))

    def pair(i: int, j: int, a: Block, b: Block) -> list[tuple[int, int]]:
        if i == j:
            counts, edges = near_pairs(a.x, a.ids, a.dims, np.zeros(len(a.x), np.int64), least, False)
            a.counts += counts
            return edges
        p, q = facing(a.x, i, j), facing(b.x, j, i)
        if not (len(p) and len(q)):
            return []
        both = [np.concatenate([u[p], v[q]]) for u, v in ((a.x, b.x), (a.ids, b.ids), (a.dims, b.dims))]
        counts, edges = near_pairs(*both, np.repeat([0, 1], [len(p), len(q)]), least, True)
        a.counts[p] += counts[: len(p)]
        b.counts[q] += counts[len(p) :]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for batch in batches for t in batch.column(0).to_pylist()):
            high = (math.isqrt(8 * task + 1) - 1) // 2  # tasks are numbered along a triangle's rows
            low = task - high * (high + 1) // 2
            held, forest, edges = {}, Forest(), []

            def read(k: int, held=held) -> Block:
                if k not in held:
                    held[k] = Block.read(folder, int(blocks[k]), centres.shape[1])
                return held[k]

            for i in range(low * side, min(low * side + side, len(blocks))):
                for j in range(max(i, high * side), min(high * side + side, len(blocks))):
                    if i == j or between[cells[i], cells[j]] <= radius[i] + radius[j] + theta + SLACK:
                        edges += [e for e in pair(i, j, read(i), read(j)) if forest.join(*e)]
            ids, n = (np.concatenate([getattr(b, c) for b in held.values()] or [np.zeros(0, np.int64)]) for c in ("ids", "counts"))
            some = np.flatnonzero(n)
            a = np.concatenate([ids[some], np.array([e[0] for e in edges], np.int64)])
            b = pa.array([None] * len(some) + [e[1] for e in edges], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.concatenate([n[some], np.zeros(len(edges), np.int64)]))], ["a", "b", "n"])

    return run


def embedding_near_dedup(embeddings: DataFrame, least: float = 0.9, block: int = 8192, sample: int = 2048, cells: int = 512) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept: one row for each row of embeddings (vec_id, embedding).

    Vectors link whose cosine, in double precision, is at least `least` (0.5 at least). Null, empty and zero vectors, and those with
    null or non-finite components, link with nothing, nor do vectors of different lengths. A null vec_id links with nothing and has no
    component. Rows that repeat a vec_id share their result; they aren't links of each other. The upper level is fitted on the
    `sample` vectors whose ids hash lowest (at most `cells` centres); it decides what is compared where, never what links.
    """
    if not 0.5 <= least < 1:
        raise ValueError("least must be within 0.5 and 1")
    spark = embeddings.sparkSession
    kind = "array<float>" if embeddings.select("embedding").dtypes[0][1] == "array<float>" else "array<double>"  # kept as short as they came
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"))
    rows = every.where("vec_id is not null").mapInArrow(_usable, f"vec_id long, e {kind}")
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)).cast("int")), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("e")), F.lit(0))).first()
    if not n:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("e").toArrow()
    some = as_matrix(some.column("e").combine_chunks(), width)
    centres = some[farthest_first(some, max(1, min(cells, n // block)))[0]]

    parts = np.ones(len(centres), np.int64)
    for r in rows.select("e").mapInArrow(_cells(centres), "cell int").groupBy("cell").count().collect():  # a row for each centre
        parts[r["cell"]] = -(-r["count"] // block)
    folder = fresh_path(spark, "blocks")
    placed = rows.mapInArrow(_placed(centres, parts), f"vec_id long, e {kind}, block int, cell int, far double").repartitionById(int(parts.sum()), "block")
    placed.write.partitionBy("block").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(folder)
    discard(rows)
    known = spark.read.schema("cell int, far double, block int").parquet(folder).groupBy("block").agg(F.max("cell").alias("cell"), F.max("far").alias("radius")).orderBy("block").collect()  # a row for each block
    # runs of several blocks where there are many, so that each is read less often, but enough tasks for all cores
    side = max(1, min(SIDE, SIDE_BYTES // (8 * block * width), len(known) // max(16, math.ceil(4 * math.sqrt(spark.sparkContext.defaultParallelism)))))
    sides = -(-len(known) // side)
    tasks = spark.range(0, sides * (sides + 1) // 2, 1, min(sides * (sides + 1) // 2, 100_000))
    run = _linked(folder, centres, *(np.array([r[c] for r in known]) for c in ("block", "cell", "radius")), side, least)
    linked = written(tasks.mapInArrow(run, "a long, b long, n long"), "links")
    remove(spark, folder)
    counts = linked.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    found = connected_components(linked.where("b is not null")).toDF("vec_id", "component_id")
    out = every.select("vec_id").join(counts, "vec_id", "left").join(found, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
