"""Near-duplicate vectors by lattice hashing: projections decoded to points of the E8 lattice."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimloom.llm.graph import components
from claimloom.llm.storage import Workspace, with_row_key
from claimloom.llm.text import split_mix

TABLES = 4
PROBES = 2
SCALE = 6.0
SEED = 5
# Vectors of one cell are compared in blocks of at most about this many.
BLOCK = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all entries +-1/2 with an even number of minuses."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.stack(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer entries of even sum: round, and if the sum is odd, round the worst entry the other way."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
    gap = x[odd] - f[odd]
    worst = np.abs(gap).argmax(axis=1)
    f[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def cells(unit: np.ndarray, group: np.ndarray, tables: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell in each table (n x tables), and per table the home followed by its ``probes`` closest neighbouring
    cells (n x tables * (1 + probes)), as 64-bit keys that also hold the table and ``group``."""
    short, homes, looks = minimal_vectors(), [], []
    dims = unit.shape[1]
    for t in range(tables):
        rng = np.random.Generator(np.random.PCG64([SEED, t, dims]))
        basis = np.linalg.qr(rng.normal(size=(max(dims, 8), 8)))[0][:dims]
        y = unit @ basis * (scale * np.sqrt(max(dims, 8) / 64))
        home = nearest_e8(y)
        closest = np.argsort(-((y - home) @ short.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + short[closest]], axis=1)
        key = np.full(points.shape[:2], np.uint64(t + 1)) ^ group[:, None]
        for k in range(8):
            key = split_mix(key + (points[:, :, k] * 2).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        homes.append(key[:, 0])
        looks.append(key)
    return np.stack(homes, axis=1).view(np.int64), np.concatenate(looks, axis=1).view(np.int64)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _keyed(reps: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    schema = pa.schema([("rep", pa.int64()), ("grp", pa.int64()), ("vec", pa.list_(pa.float64())), ("weight", pa.int64()), ("homes", pa.list_(pa.int64())), ("looks", pa.list_(pa.int64()))])

    def task(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(2)])
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = _matrix(part.column(2), np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                home, look = cells(x, part.column(1).to_numpy().view(np.uint64), tables, probes, scale)
                lists = [pa.array(list(m), f.type) for m, f in ((x, schema.field(2)), (home, schema.field(4)), (look, schema.field(5)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists[0], part.column(3), *lists[1:]], schema=schema)

    return reps.mapInArrow(task, "rep long, grp long, vec array<double>, weight long, homes array<long>, looks array<long>")


def _block(at: np.ndarray, members: dict, visitors: dict, cosine: float, tables: int):
    """Links between the visitors and the members of one block of a cell: (rep, added links) and tree edges."""
    sims = (visitors["vec"] @ members["vec"].T >= cosine) & (visitors["grp"][:, None] == members["grp"][None, :]) & (visitors["rep"][:, None] != members["rep"][None, :])
    v, m = np.nonzero(sims)
    if not len(v):
        return None
    # A pair counts where it is seen first: by table, then with the smaller id as the visitor.
    first = np.ones(len(v), dtype=bool)
    width = visitors["looks"].shape[1] // tables
    ordered = visitors["rep"][v] < members["rep"][m]
    for t in range(tables):
        looks = slice(t * width, (t + 1) * width)
        forth = (visitors["looks"][v][:, looks] == members["homes"][m][:, t, None]).any(axis=1)
        back = (members["looks"][m][:, looks] == visitors["homes"][v][:, t, None]).any(axis=1)
        first &= ~(np.where(at[v] > t, forth | back, (at[v] == t) & ~ordered & back))
    size = len(visitors["rep"])
    reps = np.concatenate([visitors["rep"], members["rep"]])
    added = np.bincount(v[first], members["weight"][m[first]], len(reps)) + np.bincount(size + m[first], visitors["weight"][v[first]], len(reps))
    label = np.arange(len(reps))
    while True:  # the smallest place in each component of this block
        low = label.copy()
        np.minimum.at(low, v, label[size + m])
        np.minimum.at(low, size + m, label[v])
        low = low[low]
        if (low == label).all():
            break
        label = low
    tree = np.flatnonzero(reps != reps[label])
    return reps, added.astype(np.int64), reps[tree], reps[label[tree]]


def _compare(cosine: float, tables: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def pieces(batches):
        """Batches cut where (cell, mb, vb) changes; rows of one block can come in two batches."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            keys = np.stack([table.column(k).to_numpy() for k in ("cell", "mb", "vb")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            edges = [0, *cuts]
            for lo, hi in zip(edges, edges[1:]):
                yield table.slice(lo, hi - lo)
            held = table.slice(last)
        if held is not None:
            yield held

    def side(table: pa.Table) -> dict:
        table = table.combine_chunks()
        one = {k: table.column(k).to_numpy() for k in ("rep", "grp", "weight", "tab")}
        columns = {k: table.column(k).chunk(0) for k in ("vec", "homes", "looks")}
        return one | {"vec": _matrix(columns["vec"], np.float64), "homes": _matrix(columns["homes"], np.int64), "looks": _matrix(columns["looks"], np.int64)}

    def task(batches):
        a, b, n = [], [], []
        for piece in pieces(batches):
            role = piece.column("role").to_numpy()
            if piece.num_rows < 2 or role.min() == role.max():
                continue
            sizes = np.diff(piece.column("vec").combine_chunks().offsets.to_numpy()) if piece.column("vec").num_chunks == 1 else np.array([len(x) for x in piece.column("vec")])
            for dims in np.unique(sizes):
                members, visitors = (piece.take(pa.array(np.flatnonzero((role == r) & (sizes == dims)))) for r in (0, 1))
                if not members.num_rows or not visitors.num_rows:
                    continue
                visiting = side(visitors)
                found = _block(visiting["tab"], side(members), visiting, cosine, tables)
                if found:
                    reps, added, left, right = found
                    some = added > 0
                    a += [reps[some], left]
                    b += [np.full(some.sum(), -1), right]
                    n += [added[some], np.full(len(left), -1)]
            if sum(map(len, a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, n)], schema=out)
                a, b, n = [], [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, n)], schema=out)

    return task


def near_vectors(
    vectors: DataFrame, ws: Workspace, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Two rows link if their labels are equal and not null and the cosine of their vectors is at least ``cosine``, in
    double precision. n_links counts the other rows linked directly, component_id is the smallest id that links reach,
    and kept says that this is the row's own. A vector that is null, empty or zero, or holds a null, NaN or infinity,
    links with nothing, and so do vectors of different length. A null id is in no minimum. Rows with equal ids are rows
    of their own; equal vectors of one label are compared once, with a weight. An empty table gives an empty result;
    further columns are not read.

    ``tables`` projections to eight dimensions, times ``scale``, decode to E8 cells; a vector looks into its own cell and
    the ``probes`` neighbouring ones nearest to it. Members and visitors of a cell meet in blocks of bounded size; a
    block gives counts and a spanning forest, never its pairs. A pair seen in several tables counts in the first.
    """
    rows, by_id = with_row_key(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")), "id", ws, "row")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0), F.lit(False))
    reps = ws.save(rows.where(usable).groupBy("label", "vec").agg(F.min("row").alias("rep"), F.count("*").alias("weight")))
    keyed = ws.save(_keyed(reps.select("rep", F.xxhash64("label", F.size("vec")).alias("grp"), "vec", "weight"), tables, probes, scale))

    homes = keyed.select("rep", F.posexplode("homes").alias("tab", "cell"))
    looks = keyed.select("rep", F.posexplode("looks").alias("look", "cell")).withColumn("tab", F.floor(F.col("look") / (1 + probes)).cast("int"))
    full = homes.groupBy("cell").agg(F.count("*").alias("members")).join(looks.groupBy("cell").agg(F.count("*").alias("visitors")), "cell")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    full = ws.save(full.where("visitors > 1").select("cell", blocks("members").alias("mbs"), blocks("visitors").alias("vbs")))
    mine, other = F.pmod(F.xxhash64("rep"), F.col("mbs")).cast("int"), F.pmod(F.xxhash64("rep"), F.col("vbs")).cast("int")
    members = homes.join(full, "cell").select("rep", "tab", "cell", F.lit(0).alias("role"), mine.alias("mb"), F.explode(F.sequence(F.lit(0), F.col("vbs") - 1)).alias("vb"))
    visits = looks.join(full, "cell").select("rep", "tab", "cell", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"), other.alias("vb"))
    spread = members.unionByName(visits).join(keyed, "rep").repartition("cell", "mb", "vb").sortWithinPartitions("cell", "mb", "vb")
    spread = spread.select("cell", "mb", "vb", "role", "tab", "rep", "grp", "weight", "vec", "homes", "looks")
    found = ws.save(spread.mapInArrow(_compare(cosine, tables), "a long, b long, n long"))

    degree = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.where("n < 0").select("a", "b"), ws)
    about = reps.join(degree, "rep", "left").join(parts, reps.rep == parts.node, "left").select(
        "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part"))
    all_rows = rows.where(usable).select("row", "id", "label", "vec").join(about, ["label", "vec"]).select("row", "id", "n_links", "part")
    if by_id:
        linked = all_rows.select("id", "n_links", F.col("part").alias("component_id"))
    else:
        low = all_rows.groupBy("part").agg(F.min("id").alias("component_id"))
        linked = all_rows.join(low, "part").select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), Workspace(spark))


OP8_SQL = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and list_dot_product(embedding::double[], embedding::double[]) > 0
), links as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(x, y) as (
  select vec_id, vec_id from embeddings union select r.x, l.y from reach r join links l on r.y = l.x
), part as (select x, min(y) as component_id from reach group by x),
degree as (select x, count(*) as n from links group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join part on part.x = vec_id left join degree on degree.x = vec_id
"""
