"""Connected components of an edge table, as joins and sums that Spark distributes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import released, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of `edges` (a, b, both long): label is the least node that can be reached.

    Edges that lie together are contracted where they lie, before and after a shuffle, and again between the
    steps; a graph that fits a partition is thus known before the first step. Two steps alternate until no
    edge changes. Large star: every neighbour of a node that is greater than it is tied to the least of
    its neighbourhood. Small star: a node and its lesser neighbours are tied to the least of these. Neither
    takes a component apart or makes more edges than there were, and a path of n nodes ends after some
    log n rounds (of any graph, at most its square). Least nodes are summed up before they are shuffled
    and joins can split large keys, so a node with very many edges is no hot spot. Each round's edges are
    stored, and those before them removed. Rows with a null end are skipped, an edge from a node to
    itself names the node, repeated edges count once; an empty table has no components."""
    known = edges.filter("a is not null and b is not null").select("a", "b")
    links, state = _observed(_contract(_contract(known).distinct()), "links")
    now, before = links.filter("u > v").select("u", "v"), None
    while state[0]:
        new, found = _observed(_small_star(_large_star(now)), "stars")
        if before is not None:
            released(before)
        now = before = new
        if found == state:
            break
        state = found
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    loops = links.filter("u = v").select(F.col("u").alias("node")).distinct()
    if loops.limit(1).count():
        ends = now.select("u").union(now.select("v")).distinct()
        labels = labels.union(loops.join(ends, F.col("node") == F.col("u"), "left_anti").select("node", F.col("node").alias("label")))
    out = stored(labels, "labels")  # its readers join it several times
    released(links, *[x for x in (before,) if x is not None])
    return out


#: Edges that a task holds to contract them together.
_HELD = 500_000


def _contract(edges: DataFrame) -> DataFrame:
    """(u, v): the edges of each partition contracted together, some _HELD at a time."""
    arrow = to_arrow_schema(StructType.fromDDL("u long, v long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in (0, 1)]))
            size += batch.num_rows
            if size >= _HELD:
                held = [_contracted(np.concatenate(held, axis=1))]
                size = held[0].shape[1]
                if 2 * size > _HELD:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), schema=arrow)
                    size = 0
        if size:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _contracted(np.concatenate(held, axis=1)))), schema=arrow)

    return edges.mapInArrow(run, "u long, v long")


def _contracted(edges: np.ndarray) -> np.ndarray:
    """Edges (a row of each end) as (node, least node that they tie it to)."""
    ends, place = np.unique(edges, return_inverse=True)
    a, b = place.reshape(edges.shape)
    label = np.arange(len(ends))
    while True:  # labels only fall, along edges and then to their own labels
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, old[a], low)
        np.minimum.at(label, old[b], low)
        label = label[label]
        if (label == old).all():
            break
    roots = label == np.arange(len(ends))
    alone = roots & (np.bincount(label, minlength=len(ends)) == 1)
    keep = ~roots | alone
    return np.stack((ends[keep], ends[label[keep]]))


def _observed(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The stored table of edges, with the number of those between two nodes and their order-free digest: equal tables
    have equal ones."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count_if(F.expr("u > v")).alias("n"), F.expr("bit_xor(if(u > v, xxhash64(u, v), 0L))").alias("digest")), label)
    return out, (seen.get["n"], seen.get["digest"])


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u > v) -> (u > v): of each node, every greater neighbour beside the least of its neighbourhood, contracted."""
    # a node's least neighbour is below it unless it is the least itself, and then it is what its greater neighbours get
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    up = edges.join(least.select(F.col("u").alias("w"), "m"), edges["v"] == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
    return _contract(up.distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (u > v) -> (u > v): a node and its lesser neighbours beside the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    wide = edges.join(least.select(F.col("u").alias("w"), "m"), edges["u"] == F.col("w")).select("u", "v", "m")
    return wide.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
