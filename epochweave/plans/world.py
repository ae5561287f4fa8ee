"""The grid of nodes, ranks and workers that an epoch is dealt over."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class World:
    nodes: int = 1
    ranks_per_node: int = 1
    workers_per_rank: int = 1

    @property
    def ranks(self) -> int:
        return self.nodes * self.ranks_per_node

    @property
    def workers(self) -> int:
        return self.ranks * self.workers_per_rank

    def coordinates(self, worker: Column) -> dict[str, Column]:
        """Where a global worker number is: node, rank (global), worker of its rank, and whether it leads its node."""
        node = self.workers_per_rank * self.ranks_per_node
        return {
            "node": F.floor(worker / node), "rank": F.floor(worker / self.workers_per_rank), "rank_of_node": F.floor(worker / self.workers_per_rank) % self.ranks_per_node,
            "worker_of_rank": worker % self.workers_per_rank, "is_local_leader": worker % node == 0,
        }

    def replicate(self, replication: int) -> World:
        """The smaller world of ranks that see different samples when each run of `replication` ranks sees the same ones."""
        if replication < 1 or self.ranks % replication:
            raise ValueError("the number of ranks must be a multiple of the replication")
        ranks = self.ranks // replication
        if self.ranks_per_node % replication == 0:
            return replace(self, ranks_per_node=self.ranks_per_node // replication)
        if ranks % self.nodes == 0:
            return replace(self, ranks_per_node=ranks // self.nodes)
        return World(1, ranks, self.workers_per_rank)


def replicated(plan: DataFrame, replication: int) -> DataFrame:
    """A plan with a column rank (global), fanned out so that each of its ranks becomes `replication` ranks in a row."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(replication - 1)))
    return plan.withColumn("_copy", copies).withColumn("rank", F.col("rank") * replication + F.col("_copy")).drop("_copy")
