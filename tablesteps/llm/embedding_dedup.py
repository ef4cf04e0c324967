"""Near-duplicate embeddings by a subspace pigeonhole join.

Two vectors of cosine ``c`` lie ``2 - 2c`` apart (squared, at unit length).  A
rotation spreads every vector evenly over its coordinates; they are split into
blocks of ``BLOCK_DIMS``, and a pair within the whole budget is within the budget
of its share of the dimensions in at least one block.

1. Equal vectors of a label become one class with its number of copies.  Its
   rotated unit vector is rounded to integers once and stored, so that all later
   sums are exact wherever they are made; the budget grows by the rounding.
2. Range join of each block: a grid of cells four budget radii wide.  A vector is
   at home in one cell, and is copied to the neighbours that its ball reaches (of
   two cells only to the later one, so a pair meets once in a block).
3. In each cell, rows within the block's budget are kept with their cell (eight
   numbers travel, no vector).
4. The union of the candidates is verified: kept rows fetch their vectors, and a
   pair belongs to the first block that finds it, where its cosine is taken in
   double precision.  Tasks send numbers of links and a spanning forest, no pairs.
5. Connected components over the forest edges.

Cells of many rows are cut into tiles (``tiles``); a cluster of near copies costs
its pairs in time, as every link counts, but never a row for each.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing.  Vectors of different
length have no cosine and never link.  An empty table gives no rows.  Rows that
repeat an id are rows of their own and count as links like others; the
component is named by the smallest id of its rows (null ids last).  Only the three
named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType

from .common import forget, prepare_workers, quoted, saved
from .components import component_ids
from .tiles import over_tiles, tiled

#: The lowest cosine of a link.
MIN_COSINE = 0.98
#: Dimensions of a block.
BLOCK_DIMS = 8
#: Width of a grid cell in budget radii (at least 3: then a ball reaches one neighbour at most in each dimension).
CELL_RADII = 4
#: Rounded coordinates are whole numbers of 1 / SCALE.
SCALE = 1 << 14
#: Rows of a cell slice: two slices meet in a tile.
TILE_ROWS = 1024
#: Candidate pairs verified at a time.
PAIR_ROWS = 1 << 14
_SEED = 20


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, block_dims: int) -> list[slice]:
    return [slice(i, min(i + block_dims, dims)) for i in range(0, dims, block_dims)]


def budgets(dims: int, block_dims: int, min_cosine: float) -> np.ndarray:
    """The squared distance allowed in each block, in rounded coordinates: shares of the whole budget by dimension.

    Rounding moves each coordinate of a difference by one at most.
    """
    reach = SCALE * np.sqrt(max(2 - 2 * min_cosine, 0.0)) * (1 + 1e-9) + 1.001 * np.sqrt(dims)
    return np.array([np.floor(reach**2 * (s.stop - s.start) / dims) for s in blocks_of(dims, block_dims)])


def rounded(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in whole numbers."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    return np.rint(unit @ rotation(vectors.shape[1]) * SCALE).astype("<i2")


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: their numbers and their vectors as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    found = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        found.append((rows, values[starts[rows][:, None] + np.arange(n)]))
    return found


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each different vector of a label: ``node``, ``l``, ``e``, ``least`` (id), ``copies``, ``q``."""
    spark = rows.sparkSession
    prepare_workers(spark)
    grouped = rows.groupBy("l", "e").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    source = grouped.select(F.monotonically_increasing_id().alias("node"), "l", "e", "least", "copies")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q: list = [b""] * batch.num_rows
            for at, vectors in matrices(batch.column(2)):
                for i, x in zip(at.tolist(), rounded(vectors)):
                    q[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.binary())], names=[*batch.schema.names, "q"])

    schema = StructType([*source.schema.fields, StructField("q", BinaryType())])
    return saved(spark, source.mapInArrow(run, schema), "embedding-classes")


def cells_of(classes: DataFrame, min_cosine: float, block_dims: int) -> DataFrame:
    """``l``, ``cell``, ``home``, ``node``, ``x``: each vector in its own cell of every block, and in the later cells
    that its ball reaches; ``x`` is its part in the block."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            label, node = batch.column(0), batch.column(1)
            parts = batch.column(2).to_pylist()
            sizes = np.array([len(p) // 2 for p in parts])
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                q = np.frombuffer(b"".join(parts[i] for i in rows), dtype="<i2").reshape(len(rows), dims).astype(np.int64)
                for b, (span, budget) in enumerate(zip(blocks_of(dims, block_dims), budgets(dims, block_dims, min_cosine))):
                    at, cell, home = reached(q[:, span], budget)
                    head = np.array([dims, b], dtype=">u4").tobytes()
                    took = rows[at]
                    block = np.ascontiguousarray(q[:, span].astype("<i2"))[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            label.take(pa.array(took)),
                            pa.array([head + c.tobytes() for c in cell.astype(">i4")], pa.binary()),
                            pa.array(home),
                            node.take(pa.array(took)),
                            pa.array([x.tobytes() for x in block], pa.binary()),
                        ],
                        names=["l", "cell", "home", "node", "x"],
                    )

    schema = "l string, cell binary, home boolean, node bigint, x binary"
    return classes.select("l", "node", "q").mapInArrow(run, schema)


def reached(x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, cells and whether it is the row's own, for every cell to hold the row."""
    n, k = x.shape
    radius = np.sqrt(budget)
    width = int(CELL_RADII * radius) + 2
    own = x // width
    inside = x - own * width
    up = width - inside <= inside + 1
    gap = np.where(up, width - inside, inside + 1).astype(np.float64)  # to the nearer neighbour of each dimension
    subsets = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(np.float64)
    fits = gap**2 @ subsets.T <= budget
    # A copy goes to the later of two cells only: the first dimension that changes goes up.
    first = np.argmax(subsets, axis=1)
    fits &= up[:, first]
    fits[:, 0] = True
    at, which = np.nonzero(fits)
    step = np.where(up[at], 1, -1) * subsets[which].astype(np.int64)
    return at, own[at] + step, which == 0


def within(a: np.ndarray, b: np.ndarray, budget: float) -> np.ndarray:
    """Pairs of rows within the budget; whole numbers, so exact."""
    apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return apart <= budget


def pairs_to_test(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile: which rows are at home, their slice, and the two slices that meet."""
    home = tile.column("home").to_numpy()
    own = tile.column("own").to_numpy()
    lo, hi = tile.column("lo")[0].as_py(), tile.column("hi")[0].as_py()
    return home, own, lo, hi


def candidate_mask(tile: pa.Table, x: np.ndarray, budget: float) -> np.ndarray:
    """Row i, row j: j at home, i at home and before j or a copy, of the two slices that meet, within the budget."""
    home, own, lo, hi = pairs_to_test(tile)
    mask = within(x, x, budget)
    mask &= home[None, :]
    mask &= ~home[:, None] | np.tri(len(x), k=-1, dtype=bool).T
    if lo != hi:
        mask &= own[:, None] != own[None, :]
    return mask


def budget_of(cell: bytes, block_dims: int, min_cosine: float) -> tuple[int, int, np.ndarray]:
    dims, block = np.frombuffer(cell[:8], dtype=">u4").tolist()
    return dims, block, budgets(dims, block_dims, min_cosine)


def candidates(cells: DataFrame, min_cosine: float, block_dims: int, tile_rows: int) -> DataFrame:
    """``l``, ``cell``, ``home``, ``node`` of the rows that have a partner within the block's budget in their cell."""

    def make(tile: pa.Table) -> pa.Table | None:
        if tile.num_rows < 2:
            return None
        _, block, limits = budget_of(tile.column("cell")[0].as_py(), block_dims, min_cosine)
        x = np.frombuffer(b"".join(tile.column("x").to_pylist()), dtype="<i2").reshape(tile.num_rows, -1).astype(np.float64)
        mask = candidate_mask(tile, x, limits[block])
        found = mask.any(axis=0) | mask.any(axis=1)
        return tile.select(["l", "cell", "home", "node"]).filter(pa.array(found)) if found.any() else None

    rows = tiled(cells, ["l", "cell"], "node", tile_rows)
    return over_tiles(rows, ["l", "cell"], make, "l string, cell binary, home boolean, node bigint").distinct()


def verified(kept: DataFrame, classes: DataFrame, min_cosine: float, block_dims: int, tile_rows: int) -> DataFrame:
    """``node``, ``links`` (to rows of other classes), ``other`` (a node of the same component) for each node and tile."""

    def make(tile: pa.Table) -> pa.Table | None:
        if tile.num_rows < 2:
            return None
        dims, block, limits = budget_of(tile.column("cell")[0].as_py(), block_dims, min_cosine)
        n = tile.num_rows
        q = np.frombuffer(b"".join(tile.column("q").to_pylist()), dtype="<i2").reshape(n, dims).astype(np.float64)
        [(_, e)] = matrices(tile.column("e"))
        e = e / np.abs(e).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", e, e))
        copies = tile.column("copies").to_numpy().astype(np.float64)
        spans = blocks_of(dims, block_dims)
        left, right = np.nonzero(candidate_mask(tile, q[:, spans[block]], limits[block]))
        links, root, linked = np.zeros(n), np.arange(n), np.zeros(n, dtype=bool)
        for s in range(0, len(left), PAIR_ROWS):
            i, j = left[s : s + PAIR_ROWS], right[s : s + PAIR_ROWS]
            apart = np.add.reduceat((q[i] - q[j]) ** 2, [x.start for x in spans], axis=1)
            mine = np.argmax(apart <= limits, axis=1) == block  # the first block that finds the pair
            i, j = i[mine], j[mine]
            good = np.einsum("ij,ij->i", e[i], e[j]) / (norm[i] * norm[j]) >= min_cosine
            i, j = i[good], j[good]
            links += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            linked[i] = linked[j] = True
            root = joined_roots(root, i, j)
        if not linked.any():
            return None
        node = tile.column("node").to_numpy()
        return pa.table(
            {"node": node[linked], "links": links[linked].astype(np.int64), "other": node[root[linked]]}
        )

    wide = kept.join(classes.select("node", "e", "q", "copies"), "node")
    rows = tiled(wide, ["l", "cell"], "node", tile_rows)
    return over_tiles(rows, ["l", "cell"], make, "node bigint, links bigint, other bigint")


def joined_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable, after the links ``i``-``j`` are added to a forest of roots."""
    i, j = np.concatenate([i, np.arange(len(root))]), np.concatenate([j, root])
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = MIN_COSINE,
    block_dims: int = BLOCK_DIMS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row per row: the id, ``n_links``, ``component_id`` (smallest id reachable), ``kept`` (id = component)."""
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be over 0 and at most 1")
    if not 1 <= block_dims <= 12:
        raise ValueError("block_dims must be between 1 and 12")
    spark = vectors.sparkSession
    e = F.col(quoted(vector_col))
    kind = vectors.select(e).schema.fields[0].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)):
        e = e.cast("array<double>")
    every = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("string").alias("l"), e.alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("l").isNotNull() & ~bad & F.exists("e", lambda x: x != 0), F.lit(False))
    classes = classes_of(every.filter(sound))
    kept = saved(spark, candidates(cells_of(classes, min_cosine, block_dims), min_cosine, block_dims, tile_rows), "embedding-candidates")
    found = saved(spark, verified(kept, classes, min_cosine, block_dims, tile_rows), "embedding-links")
    forget(kept)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = component_ids(found.filter("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = classes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    about = named.join(names, "component").select("node", "name")
    told = (
        classes.select("node", "l", "e", "copies")
        .join(about, "node")
        .join(links, "node", "left")
        .select("l", "e", "name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    told = saved(spark, told, "embedding-told")
    forget(found)
    forget(classes)
    in_class = every.filter(sound).join(told, ["l", "e"]).select("id", "n_links", "name")
    alone = every.filter(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("name"))
    out = in_class.unionAll(alone)
    return out.select("id", "n_links", "name", F.col("id").eqNullSafe(F.col("name"))).toDF(
        id_col, "n_links", "component_id", "kept"
    )


def keep_one(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """The rows whose id names their component; all columns as they were."""
    kept = near_vectors(vectors, id_col, **options).toDF("i", "n", "c", "k").filter("k").select("i").distinct()
    marked = vectors.toDF(*[f"c{i}" for i in range(len(vectors.columns))])
    own = f"c{vectors.columns.index(id_col)}"
    return marked.join(kept, F.col(own).eqNullSafe(F.col("i")), "left_semi").toDF(*vectors.columns)
