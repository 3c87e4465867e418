"""Oversampling of minority classes by interpolation between near neighbours.

Neighbours are exact. The points of a class are cut into leaves of a k-d tree, each with its bounding box. A point first finds its
nearest in its own leaf; then it visits only the leaves whose boxes its k-th distance can reach.
"""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from claimloom.operators.numbering import number_rows, running_totals
from claimloom.sizing import broadcast_small, reuse

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# No leaf has more distinct points, and no task looks at more visitors of a leaf at a time.
CELL = 512
VISITORS = 2_048
# So many points are held against a leaf at once.
TOGETHER = 256
# A node is cut into at most FAN parts at once, by about SAMPLE points for each.
FAN, SAMPLE = 64, 24
MIN_CLASS = 6
PIECE = 10_000


def split_tree(points: np.ndarray, parts: int) -> list[tuple[int, float, int, int]]:
    """Nodes (feature, cut, left, right) of a tree with ``parts`` leaves, fewer if there are fewer points: always the largest part is
    cut, at the median of its widest feature; points below the cut go left. A negative child -1 - i is leaf i."""
    nodes: list[list] = []
    leaves = [(points, None, 0)]  # points, parent node, side
    while len(leaves) < parts:
        at = max(range(len(leaves)), key=lambda i: len(leaves[i][0]))
        own, parent, side = leaves[at]
        spread = np.ptp(own, axis=0)
        f = int(spread.argmax())
        if not spread[f] > 0:
            break
        values = np.sort(own[:, f])
        cut = values[len(values) // 2]
        if cut == values[0]:
            cut = values[np.searchsorted(values, cut, side="right")]
        nodes.append([f, float(cut), 0, 0])
        if parent is not None:
            nodes[parent][2 + side] = len(nodes) - 1
        right = own[:, f] >= cut
        leaves[at] = own[~right], len(nodes) - 1, 0
        leaves.append((own[right], len(nodes) - 1, 1))
    for i, (_, parent, side) in enumerate(leaves):
        if parent is not None:
            nodes[parent][2 + side] = -1 - i
    return [tuple(n) for n in nodes]


def leaf_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The number of the leaf each point falls into."""
    if not nodes:
        return np.zeros(len(points), dtype=np.int64)
    feature, cut, left, right = (np.array(x) for x in zip(*nodes))
    at, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
    while (at >= 0).any():
        inner = np.maximum(at, 0)
        down = np.where(points[rows, feature[inner]] >= cut[inner], right[inner], left[inner])
        at = np.where(at >= 0, down, at)
    return -1 - at


def _near(query: np.ndarray, pool: np.ndarray, copies: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances to the k nearest in ``pool``, which counts copies, for each query, these points' places in it, and how many there
    are; with ``own``, query i is pool point i, which isn't its own neighbour but whose copies are."""
    far, near, found = np.zeros((len(query), k)), np.zeros((len(query), k), dtype=np.int64), np.zeros(len(query), dtype=np.int64)
    for start in range(0, len(query), TOGETHER):
        points = query[start : start + TOGETHER]
        d2 = np.zeros((len(points), len(pool)))
        for f in range(pool.shape[1]):
            gap = points[:, f, None] - pool[None, :, f]
            d2 += gap * gap
        few = np.argpartition(d2, k, axis=1)[:, : k + 1] if len(pool) > k + 1 else np.broadcast_to(np.arange(len(pool)), d2.shape)
        few = np.take_along_axis(few, np.argsort(np.take_along_axis(d2, few, 1), axis=1, kind="stable"), 1)
        slots = copies[few]
        if own:
            self_at = np.arange(start, start + len(points))[:, None]
            lost = ~(few == self_at).any(axis=1)
            few[lost] = np.concatenate([self_at[lost], few[lost, :-1]], axis=1)
            slots = copies[few] - (few == self_at)
        upto = np.minimum(slots, k).cumsum(axis=1)
        pick = np.minimum((upto[:, :, None] <= np.arange(k)).sum(axis=1), few.shape[1] - 1)
        places = np.take_along_axis(few, pick, 1)
        block = slice(start, start + len(points))
        far[block], near[block], found[block] = np.take_along_axis(d2, places, 1), places, np.minimum(upto[:, -1], k)
    return far, near, found


FOUND = "label int, point_no long, far array<double>, near array<array<double>>"


def _found(label: pa.Array, point_no: pa.Array, pool: np.ndarray, far: np.ndarray, near: np.ndarray, held: np.ndarray) -> pa.Table:
    """Rows of ``FOUND`` from the neighbours that ``held`` marks."""
    ends = np.concatenate([[0], held.sum(axis=1).cumsum()]).astype(np.int32)
    points = pool[near[held]]
    inner = pa.ListArray.from_arrays(np.arange(len(points) + 1, dtype=np.int32) * pool.shape[1], pa.array(points.ravel()))
    return pa.table({"label": label, "point_no": point_no, "far": pa.ListArray.from_arrays(ends, pa.array(far[held])), "near": pa.ListArray.from_arrays(ends, inner)})


def _matrix(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows[f].to_numpy() for f in names], axis=1)


def _in_leaf(features: list[str], k: int):
    def search(rows: pa.Table) -> pa.Table:
        points = _matrix(rows, features)
        far, near, found = _near(points, points, rows["copies"].to_numpy(), k, True)
        return _found(rows["label"], rows["point_no"], points, far, near, np.arange(k) < found[:, None])

    return search


def _of_visitors(features: list[str], k: int):
    """Only neighbours within a visitor's reach go back, as others can't be among its k nearest."""
    def search(rows: pa.Table) -> pa.Table:
        guest = rows["guest"].to_numpy()
        points, reach = _matrix(rows, features), rows["reach"].to_numpy()[guest]
        pool = points[~guest]
        far, near, found = _near(points[guest], pool, rows["copies"].to_numpy()[~guest], k, False)
        held = (np.arange(k) < found[:, None]) & (np.isnan(reach)[:, None] | (far <= reach[:, None]))
        some = held.any(axis=1)
        of = rows.filter(pa.array(guest)).filter(pa.array(some))
        return _found(of["label"], of["point_no"], pool, far[some], near[some], held[some])

    return search


def _build(features: list[str]):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = split_tree(rows[features].to_numpy(float), int(rows["parts"].iloc[0]))
        return rows[:1][["label", "node"]].assign(tree=[pickle.dumps(tree)])

    return build


def _descend(width: int):
    """(label, point_no, copies, node, tree, features): a point of a node that was cut goes to one of its parts."""

    def task(batches):
        for batch in batches:
            points = np.stack([batch.column(5 + i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
            node, trees = batch.column(3).to_numpy().copy(), batch.column(4).to_pylist()
            for packed in {t for t in trees if t is not None}:
                here = np.array([t == packed for t in trees])
                node[here] = node[here] * FAN + 1 + leaf_of(pickle.loads(packed), points[here])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node), *batch.columns[5:]], [*batch.schema.names[:4], *batch.schema.names[5:]])

    return task


def build_leaves(points: DataFrame, features: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """``points(label, point_no, copies, features)`` with their leaf as ``node``, and per round the parts of the nodes it cut:
    (label, node, part, n, lo and hi of each feature). Nodes are numbered as in a heap, 0 is all of a class."""
    kinds = "label int, point_no long, copies long, node long, " + ", ".join(f"{f} double" for f in features)
    now = reuse(points.select("label", "point_no", "copies", F.lit(0).cast("long").alias("node"), *features))
    levels: list[DataFrame] = []
    while True:
        sizes = now.groupBy("label", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
        if levels:  # only parts that were just made can be too large
            sizes = sizes.join(broadcast_small(levels[-1].select("label", F.col("part").alias("node"))), ["label", "node"], "left_semi")
        sizes = reuse(sizes.withColumn("parts", F.least(F.lit(FAN), F.pow(2, F.ceil(F.log2(2 * F.col("n") / CELL))).cast("int"))))
        if sizes.isEmpty():
            return now, levels
        lot = F.pmod(F.xxhash64("label", "point_no", F.lit(len(levels))), F.lit(1 << 30).cast("long")) / (1 << 30)
        sample = now.join(broadcast_small(sizes), ["label", "node"]).filter(lot < SAMPLE * F.col("parts") / F.col("n"))
        trees = sample.groupBy("label", "node").applyInPandas(_build(features), "label int, node long, tree binary")
        placed = now.join(broadcast_small(trees), ["label", "node"], "left").select("label", "point_no", "copies", "node", "tree", *features)
        now = reuse(placed.mapInArrow(_descend(len(features)), kinds))
        boxes = [fn(f).alias(f"{side}_{f}") for f in features for side, fn in (("lo", F.min), ("hi", F.max))]
        parts = now.groupBy("label", "node").agg(F.count(F.lit(1)).alias("n"), *boxes).withColumnRenamed("node", "part")
        parts = parts.withColumn("node", F.floor((F.col("part") - 1) / FAN))
        levels.append(reuse(parts.join(broadcast_small(sizes.select("label", "node")), ["label", "node"], "left_semi")))


def _within(features: list[str]) -> Column:
    """Whether a box is as near as a point's k-th neighbour, both squared; a point without k neighbours yet reaches everywhere."""
    gap = lambda f: F.greatest(F.col(f"lo_{f}") - F.col(f), F.lit(0.0), F.col(f) - F.col(f"hi_{f}"))
    total = sum((gap(f) * gap(f) for f in features), F.lit(0.0))
    return F.col("reach").isNull() | (total <= F.col("reach") * (1 + 1e-12))


def visits(points: DataFrame, levels: list[DataFrame], features: list[str]) -> DataFrame:
    """(label, point_no, features, node, reach): the leaves other than its own that each of ``points(label, point_no, features, own, reach)`` has to look at,
    found from the root down; parts of a node out of reach aren't followed."""
    front = points.withColumn("node", F.lit(0).cast("long"))
    found: DataFrame | None = None
    for level in levels:
        inside = front.join(broadcast_small(level), ["label", "node"]).filter(_within(features))
        inside = inside.select("label", "point_no", "own", "reach", *features, F.col("part").alias("node"), (F.col("n") <= CELL).alias("leaf"))
        inside = reuse(inside)
        ends = inside.filter(F.col("leaf") & (F.col("node") != F.col("own"))).select("label", "point_no", *features, "node", "reach")
        found = ends if found is None else found.unionByName(ends)
        front = inside.filter(~F.col("leaf")).drop("leaf")
    return found


def nearest_neighbours(points: DataFrame, features: list[str], k: int) -> DataFrame:
    """Distinct points (label, features, copies) with their k nearest of the same label, nearest first, and the squared distances as ``far``."""
    points = reuse(points)  # numbering reads them three times
    numbered = number_rows(points, features, "point_no", ["label"])
    leaves, levels = build_leaves(numbered, features)
    home = reuse(leaves.groupBy("label", "node").applyInArrow(_in_leaf(features, k), FOUND))
    told = home
    if levels:
        reach = F.when(F.size("far") == k, F.element_at("far", -1)).alias("reach")
        asking = leaves.join(home.select("label", "point_no", reach), ["label", "point_no"]).select("label", "point_no", *features, F.col("node").alias("own"), "reach")
        guests = visits(asking, levels, features)
        # A leaf with very many visitors is looked at by several tasks, each with all of its points.
        shares = reuse(guests.groupBy("label", "node").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("shares")))
        salted = guests.join(broadcast_small(shares), ["label", "node"]).withColumn("share", F.pmod(F.xxhash64("point_no"), F.col("shares")).cast("int"))
        hosts = leaves.join(broadcast_small(shares), ["label", "node"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        both = salted.select("label", "node", "share", "point_no", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("guest"), "reach", *features).unionByName(
            hosts.select("label", "node", "share", "point_no", "copies", F.lit(False).alias("guest"), F.lit(None).cast("double").alias("reach"), *features))
        told = home.unionByName(both.groupBy("label", "node", "share").applyInArrow(_of_visitors(features, k), FOUND))
    zipped = F.transform(F.arrays_zip("far", "near"), lambda x: F.struct(x["far"].alias("far"), x["near"].alias("near")))
    merged = told.groupBy("label", "point_no").agg(F.slice(F.array_sort(F.flatten(F.collect_list(zipped))), 1, k).alias("best"))
    return leaves.drop("node").join(merged, ["label", "point_no"]).select(
        "label", "point_no", "copies", *features, F.transform("best", lambda x: x["near"]).alias("neighbours"), F.transform("best", lambda x: x["far"]).alias("far"))


def smote(examples: DataFrame, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Raise every class to the size of the largest one; (label, features) rows.

    The data is returned as it is when there is one class only or a class has fewer than 6 rows.
    """
    rows = examples.select(F.col("label").cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < MIN_CLASS:
        return rows
    k = min(k, min(counts.values()) - 1)
    top = max(counts.values())
    short = [c for c, n in sorted(counts.items()) if n < top]
    if not short:
        return rows
    points = rows.filter(F.col("label").isin(short)).groupBy("label", *features).agg(F.count(F.lit(1)).alias("copies"))
    near = nearest_neighbours(points, features, k)

    # Shares per row: the same whole number for every row of the class, and one more for as many
    # rows, in hash order, as the remainder asks for.
    code = F.create_map(*[F.lit(x) for c in short for x in (c, counts[c])])
    size = F.element_at(code, F.col("label"))
    missing = F.lit(top) - size
    hashed = near.withColumn("h", F.xxhash64("label", "point_no", F.lit(seed)))
    placed = running_totals(hashed, {"upto": F.col("copies")}, ["h", "point_no"], ["label"], F.shiftright("h", 56))
    extra = F.least(F.col("upto"), missing % size) - F.least(F.col("upto") - F.col("copies"), missing % size)
    wanted = placed.withColumn("n_new", F.col("copies") * F.floor(missing / size) + extra).filter(F.col("n_new") > 0)

    pieces = wanted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_new") - 1) / PIECE)))) \
        .repartition("label", "point_no", "piece")
    new = pieces.withColumn("i", F.explode(F.sequence(
        F.col("piece") * PIECE, F.least(F.col("piece") * PIECE + PIECE, F.col("n_new")) - 1)))

    def draw(purpose: str, n: int):
        return F.pmod(F.xxhash64("label", "point_no", "i", F.lit(purpose), F.lit(seed)), F.lit(n).cast("long"))

    picked = new.withColumns({
        "to": F.get("neighbours", draw("neighbour", k).cast("int")), "step": draw("step", 1_000_000) / 1_000_000,
    })
    made = picked.select("label", *[
        (F.col(f) + F.col("step") * (F.get("to", F.lit(j)) - F.col(f))).alias(f) for j, f in enumerate(features)
    ])
    return rows.unionByName(made)
