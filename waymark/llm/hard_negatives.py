"""Hard negatives by inner product: rows of another label that score close to, but below, a positive.

Rows are dealt to units by a hash of their id and anchors to blocks; every pair of a unit and a block
is one Arrow group. In a unit, rows lie in buckets of like length, the longest first, and a bucket
keeps for each coordinate the sorted list of its rows' values over their lengths. What an anchor
still needs (a score above its k-th best so far, or inside a positive's window) bounds the angle to
a row; the angle bounds each coordinate, most tightly where the anchor's own share is large. Rows in
the feasible ranges of those focus coordinates are scored exactly, no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Kept between bounds and what they bound, above the rounding of products of unit vectors.
_SLACK = 1e-9


@dataclass(frozen=True)
class Sizes:
    """How the work is cut. None of them changes a result."""

    unit_rows: int = 8192
    block_anchors: int = 8192
    bucket_rows: int = 1024
    #: coordinates of an anchor whose ranges are looked up
    focus: int = 4
    #: where the narrowest range holds more than this share of a bucket, all of it is scored
    dense: float = 0.5


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of one matrix, short ones filled up with zeros."""
    out = np.zeros((len(column), width))
    sizes = np.asarray(column.combine_chunks().value_lengths()) if len(column) else np.zeros(0, int)
    flat = np.asarray(column.combine_chunks().flatten()) if len(column) else np.zeros(0)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((int(x) for c in columns for x in c.combine_chunks().value_lengths()), default=0)


class Bucket:
    """Rows of like length with their sorted coordinate lists; ids ascend, so a stable sort by score breaks ties."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, z: np.ndarray, lengths: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.z = ids[order], labels[order], z[order]
        self.least, self.most = float(lengths.min()), float(lengths.max())
        self.unit = self.z / np.maximum(lengths[order], 1e-300)[:, None]
        self.lists = np.argsort(self.unit, axis=0)
        self.values = np.take_along_axis(self.unit, self.lists, axis=0)

    def candidates(self, q: np.ndarray, length: float, focus: np.ndarray, low: float, high: float, dense: float) -> np.ndarray | None:
        """Rows whose score with `q` may lie in [low, high]; None: most of them may.

        cos of the angle is the score over both lengths, so with the bucket's extremes it lies in
        [near, far]; a coordinate's arc differs from the anchor's by no more than that angle."""
        if length == 0 or self.most == 0:
            return None if low <= 0 <= high else np.empty(0, np.int64)
        near = low / (length * (self.most if low > 0 else self.least or 1e-300)) - _SLACK
        far = high / (length * (self.least or 1e-300 if high > 0 else self.most)) + _SLACK
        if near > 1 or far < -1 or near > far:
            return np.empty(0, np.int64)
        wide, tight = np.arccos(max(near, -1.0)), np.arccos(min(far, 1.0))
        arc = np.arccos(np.clip(q[focus] / length, -1, 1))
        lower = np.cos(np.minimum(np.pi, arc + wide)) - _SLACK
        upper = np.cos(np.maximum(0, np.maximum(arc - wide, tight - arc))) + _SLACK
        spans = [(np.searchsorted(self.values[:, f], a), np.searchsorted(self.values[:, f], b, side="right")) for f, a, b in zip(focus, lower, upper, strict=True)]
        best = min(range(len(spans)), key=lambda k: spans[k][1] - spans[k][0], default=None)
        if best is None or spans[best][1] - spans[best][0] > dense * len(self.ids):
            return None
        rows = np.sort(self.lists[spans[best][0] : spans[best][1], focus[best]])
        for k, f in enumerate(focus):
            if k != best and len(rows):
                v = self.unit[rows, f]
                rows = rows[(v >= lower[k]) & (v <= upper[k])]
        return rows


def buckets_of(ids: np.ndarray, labels: np.ndarray, z: np.ndarray, rows: int) -> list[Bucket]:
    lengths = np.sqrt((z * z).sum(1))
    order = np.argsort(-lengths, kind="stable")
    return [Bucket(ids[at], labels[at], z[at], lengths[at]) for at in (order[k : k + rows] for k in range(0, len(order), rows))]


class Best:
    """The k best (score, id) in [low, high] so far: greater scores first, ties by smaller id."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        if not len(hit):
            return
        s, i = np.concatenate((self.scores, scores[hit])), np.concatenate((self.ids, ids[hit]))
        if len(s) > 4 * self.k:
            worth = s >= -np.partition(-s, self.k - 1)[self.k - 1]
            s, i = s[worth], i[worth]
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[order], i[order]
        if len(s) >= self.k:
            self.low = max(self.low, float(self.scores[-1]))


def search(buckets: list[Bucket], q: np.ndarray, wants: list[Best], allowed, sizes: Sizes) -> None:
    """Fill `wants` for the anchor `q` from the rows that `allowed(bucket)` marks."""
    length = float(np.sqrt(q @ q))
    focus = np.argsort(-np.abs(q), kind="stable")[: sizes.focus]
    for b in buckets:
        low, high = min(w.low for w in wants), max(w.high for w in wants)
        if low > 0 and length * b.most * (1 + _SLACK) < low:
            return  # all later rows are shorter
        rows = None if low == -np.inf else b.candidates(q, length, focus, low, high, sizes.dense)
        mask = allowed(b)
        if rows is not None:
            rows = rows[mask[rows]]
            scores, ids = b.z[rows] @ q, b.ids[rows]
        else:
            scores, ids = (b.z @ q)[mask], b.ids[mask]
        for w in wants:
            w.add(scores, ids)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of any type as numbers, the same in both."""
    known: dict = {}
    return tuple(np.array([known.setdefault(x, len(known)) for x in c.to_pylist()], np.int64) for c in (a, b))


def _deal(rows: DataFrame, key: str, groups: Column) -> DataFrame:
    return rows.withColumn(key, F.pmod(F.xxhash64("id"), groups))


def _dealt(rows: DataFrame, searchers: DataFrame, sizes: Sizes):
    """Both sides as groups of (block, unit): each pair of a unit of rows and a block of anchors meets once."""
    units = F.greatest(F.lit(1), F.ceil(rows.agg(F.count("*")).scalar() / sizes.unit_rows))
    blocks = F.greatest(F.lit(1), F.ceil(rows.agg(F.count_if("is_anchor")).scalar() / sizes.block_anchors))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    # columns of new names, for both sides may come from one table
    left = _deal(searchers, "block", blocks).withColumn("unit", every(units)).toDF(*(f"a_{c}" for c in searchers.columns), "a_block", "a_unit")
    right = _deal(rows, "unit", units).withColumn("block", every(blocks))
    return left.groupBy("a_block", "a_unit").cogroup(right.groupBy("block", "unit"))


def _positives(sizes: Sizes, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = _width(anchors["a_vec"], rows["vec"])
        q, z, a_ids, ids = _matrix(anchors["a_vec"], width), _matrix(rows["vec"], width), anchors["a_id"].to_numpy(), rows["id"].to_numpy()
        a_labels, labels = _codes(anchors["a_label"], rows["label"])
        out: list[tuple] = []
        for label in np.unique(a_labels):
            mine = labels == label
            lists = buckets_of(ids[mine], labels[mine], z[mine], sizes.bucket_rows)
            for a in np.flatnonzero(a_labels == label):
                best = Best(k)
                search(lists, q[a], [best], lambda b, own=a_ids[a]: b.ids != own, sizes)
                out += [(int(a_ids[a]), int(i), float(s)) for s, i in zip(best.scores, best.ids, strict=True)]
        fields = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"anchor_id": pa.array(fields[0], pa.int64()), "positive_id": pa.array(fields[1], pa.int64()), "positive_score": pa.array(fields[2], pa.float64())})

    return run


def _negatives(sizes: Sizes, k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = _width(anchors["a_vec"], rows["vec"])
        q, z, a_ids = _matrix(anchors["a_vec"], width), _matrix(rows["vec"], width), anchors["a_id"].to_numpy()
        a_labels, labels = _codes(anchors["a_label"], rows["label"])
        lists = buckets_of(rows["id"].to_numpy(), labels, z, sizes.bucket_rows)
        out: list[tuple] = []
        for a, positives in enumerate(anchors["a_positives"].to_pylist()):
            windows = [(p, -(-low * int(p["positive_score"]) // 100), high * int(p["positive_score"]) // 100) for p in positives]
            windows = [x for x in windows if x[1] <= x[2]]
            wants = [Best(k, least, most) for _, least, most in windows]
            if wants:
                search(lists, q[a], wants, lambda b, own=a_labels[a]: b.labels != own, sizes)
            for w, (p, _, _) in zip(wants, windows, strict=True):
                out += [(int(a_ids[a]), p["positive_id"], int(i), p["positive_score"], float(s)) for s, i in zip(w.scores, w.ids, strict=True)]
        fields = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("positive_score", pa.float64()), ("negative_score", pa.float64()))
        return pa.table({name: pa.array(f, kind) for (name, kind), f in zip(kinds, fields, strict=True)})

    return run


def _first(rows: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), ident)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sizes: Sizes = Sizes(),
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "vec",
) -> DataFrame:
    """For each row that `anchor` marks and each of its `positives` best other rows of the same label: the
    `negatives` best rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.

    Vectors hold whole numbers (as doubles), so scores are exact. Greater scores come first, ties by smaller id.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label, vector or component take no part. A repeated id is one row: that of the least
    label, then vector. Short vectors are filled up with zeros. An anchor with fewer others of its label has
    fewer positives; where no row lies in the window there is no row; an empty table gives an empty one.
    Other columns are not read. A group holds a unit of rows and a block of anchors, whose sizes don't
    depend on labels, so a label or a vector that a third of the rows share makes no group larger."""
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), anchor.alias("is_anchor"))
    clean = clean.filter("id is not null and label is not null and vec is not null and not exists(vec, x -> x is null)")
    one = clean.groupBy("id").agg(F.min(F.struct("label", "vec", "is_anchor")).alias("r")).select("id", "r.*")
    table = stored(one, "vectors")
    anchors = table.filter("is_anchor").select("id", "label", "vec")
    found = _dealt(table, anchors, sizes).applyInArrow(_positives(sizes, positives), "anchor_id long, positive_id long, positive_score double")
    best = _first(found, ["anchor_id"], "positive_score", "positive_id", positives)
    mine = best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    hits = _dealt(table, anchors.join(mine, "id"), sizes).applyInArrow(
        _negatives(sizes, negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score double, negative_score double"
    )
    return _first(hits, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
