"""Connected components of a link table by hooking and contraction; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.storage import materialize, scratch

BROADCAST_ROWS = 200_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) for each node that isn't its tree's smallest one: as many links as connect the same nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
    return [(x, root(x)) for x in parent if root(x) != x]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forest = spanning_forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in forest], pa.int64()), pa.array([r for _, r in forest], pa.int64())], ["a", "b"])


def broadcast_few(rows: DataFrame) -> DataFrame:
    """``rows`` of two longs (of a stored table), broadcast if there are at most BROADCAST_ROWS; else joined over a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of (a, b), two longs; the label is the same for all nodes of a component, and one of them.

    Links are thinned to local forests first. Then, in rounds: every node hooks to its smallest neighbour, hooks are
    followed once more, and links between the hooked-to nodes go to the next round, until none is left. A round
    shortens chains at least by half; its tables are stored in the shared folder.
    """
    with scratch(links.sparkSession):
        return _rounds(links)


def _rounds(links: DataFrame) -> DataFrame:
    edges = materialize(links.select("a", "b").where("a <> b").mapInArrow(_thin, "a long, b long"), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to")), "hooks")
        # nodes that hook to themselves change nothing; what many nodes hook to is mostly such a node
        after = broadcast_few(hook.where("a <> to").select(F.col("a").alias("to"), F.col("to").alias("next")))
        step = materialize(hook.join(after, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "hooks")
        steps.append(step)
        moves = step.where("a <> to")
        moved = edges
        for c in ("a", "b"):
            side = broadcast_few(moves.select(F.col("a").alias(c), F.col("to").alias("t")))
            moved = moved.join(side, c, "left").withColumn(c, F.coalesce("t", c)).drop("t")
        edges = materialize(moved.select("a", "b").where("a <> b").mapInArrow(_thin, "a long, b long"), "links")
    if not steps:
        return links.sparkSession.createDataFrame([], "node long, label long")
    labels = steps[0].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for step in steps[1:]:
        later = step.select(F.col("a").alias("label"), "to")
        labels = labels.join(later, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(labels, "components", keep=True)
