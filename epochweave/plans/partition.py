"""Dealing positions 0..n-1 over the grid (node, rank, worker, batch, slot), each cell computed by itself from its coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = ["node", "rank", "worker", "batch", "slot"]
#: What the closed form needs, by name; see Grid.scalars.
SCALARS = ["n", "c", "p", "r", "w", "b", "s", "q", "pad", "d", "total", "u", "m", "batches"]


@dataclass(frozen=True)
class Grid:
    """n positions over canonical nodes, then physical nodes x ranks x workers, in batches; the first `drop` in order were seen."""

    n: int
    canonical: int
    nodes: int
    ranks: int
    workers: int
    batch_size: int
    drop: int = 0

    def __post_init__(self) -> None:
        if self.canonical % self.nodes and self.nodes % self.canonical:
            raise ValueError("of canonical and physical nodes one must divide the other")
        per = self.nodes * self.ranks
        if self.n + (per - self.n % per) < self.drop:
            raise ValueError("more samples are to be dropped than there are")

    @property
    def scalars(self) -> dict[str, int]:
        """What the closed form needs: row length s, its padding, dropped d, row steps total, unbalanced u, batches."""
        n, c, p, r = self.n, self.canonical, self.nodes, self.ranks
        s, d = -(-n // c), self.drop - self.drop % p
        q = p // c if c < p else 0
        pad = (q - s % q) % q if q else 0
        total = (c * (s + pad) - d) // p
        u = (r - total % r) % r
        m = (total + u) // r
        return {"n": n, "c": c, "p": p, "r": r, "w": self.workers, "b": self.batch_size, "s": s, "q": q, "pad": pad, "d": d, "total": total, "u": u, "m": m, "batches": -(-m // (self.workers * self.batch_size))}

    def cells(self, spark: SparkSession) -> DataFrame:
        """Columns order (of traversal), node, rank, worker, batch, slot, pos; nothing is shuffled."""
        v = self.scalars
        df = spark.range(v["batches"] * v["w"] * v["p"] * v["r"] * v["b"]).select(F.col("id").alias("order"))
        df = df.select("order", *[c.cast("long").alias(k) for k, c in coordinates(F.col("order"), self.nodes, self.ranks, self.workers, self.batch_size).items()])
        return df.withColumn("pos", position({k: F.lit(x).cast("long") for k, x in v.items()}, {c: F.col(c) for c in CELLS}).cast("long"))

    @property
    def filled(self) -> int:
        """How many entries a device has, repeats among them, before padding begins."""
        return self.scalars["m"]


def coordinates(order: Column, nodes: int, ranks: int, workers: int, batch_size: int) -> dict[str, Column]:
    """Where a place of the global order of traversal is: by batch, worker, node, rank, then slot."""
    i, b, r, p, w = order, batch_size, ranks, nodes, workers
    return {"node": F.floor(i / (b * r)) % p, "rank": F.floor(i / b) % r, "worker": F.floor(i / (b * r * p)) % w, "batch": F.floor(i / (b * r * p * w)), "slot": i % b}


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def position(v: dict[str, Column], x: dict[str, Column]) -> Column:
    """The position in a cell x of the grid whose scalars are v, -1 where there is none."""
    m = (x["batch"] * v["w"] + x["worker"]) * v["b"] + x["slot"]
    t = m * v["r"] + x["rank"]
    more = v["r"] + v["u"] - 1
    back = F.when(more <= v["total"], t - more).otherwise((t - v["total"]) % F.greatest(v["total"], F.lit(1)))
    place = F.when(t >= v["total"], back).otherwise(t) * v["p"] + x["node"] + v["d"]
    c, j = place % v["c"], _div(place, v["c"])
    own = F.when((v["q"] > 0) & (j >= v["s"]), j - v["q"] + 1 - v["pad"]).otherwise(j)
    start, stop = _div(c * v["n"], v["c"]), _div((c + 1) * v["n"], v["c"])
    dealt = start + own - ((own == v["s"] - 1) & (stop - start < v["s"])).cast("long")
    # too few samples for the canonical nodes: rows are cut from 0..n-1 over and over
    tiled = (v["n"] < v["c"]) | ((v["n"] == v["c"]) & (v["pad"] > 0))
    return F.when(m < v["m"], F.when(tiled, (c * (v["s"] + v["pad"]) + j) % v["n"]).otherwise(dealt)).otherwise(F.lit(-1).cast("long"))


def _fits(canonical: int, nodes: int) -> bool:
    return canonical % nodes == 0 or nodes % canonical == 0


def initial_grid(grid: dict, initial_nodes: int | None) -> dict:
    """The grid that sets the global order: the one given, or, if its nodes don't fit the canonical ones, that of the nodes a run began on."""
    if initial_nodes is None or _fits(grid["canonical"], grid["nodes"]):
        return grid
    whole = grid["nodes"] * grid["ranks"] * grid["batch_size"]
    if whole % (initial_nodes * grid["ranks"]):
        raise ValueError("the global batch size must be a multiple of the devices at the start, and can't change during a run")
    return grid | {"nodes": initial_nodes, "batch_size": whole // (initial_nodes * grid["ranks"])}


def relaxed_cells(spark: SparkSession, grid: dict, initial_nodes: int | None) -> DataFrame:
    """Cells for the nodes of `grid` (arguments of Grid) when a run began on another number of nodes: the same global order, dealt anew."""
    first = initial_grid(grid, initial_nodes)
    cells = Grid(**first).cells(spark)
    if first is grid:
        return cells
    now = coordinates(F.col("order"), grid["nodes"], grid["ranks"], grid["workers"], grid["batch_size"])
    return cells.select("order", *[c.cast("long").alias(k) for k, c in now.items()], "pos")


def grouped_cells(groups: DataFrame, grid: dict, chunk: int = 1 << 16) -> DataFrame:
    """Columns g, order, node, pos: the cells of a grid for each group (g, and the scalars of its Grid), all in one pass, groups cut in chunks."""
    cells = groups.withColumn("_size", F.col("batches") * F.col("w") * F.col("p") * F.col("r") * F.col("b")).where("_size > 0")
    cells = cells.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / chunk)))).repartition("g", "_chunk")
    order = F.explode(F.sequence(F.col("_chunk") * chunk, F.least(F.col("_size"), (F.col("_chunk") + 1) * chunk) - 1))
    cells = cells.withColumn("order", order)
    x = coordinates(F.col("order"), grid["nodes"], grid["ranks"], grid["workers"], grid["batch_size"])
    return cells.select("g", "order", x["node"].cast("long").alias("node"), position({k: F.col(k) for k in SCALARS}, x).cast("long").alias("pos"))
