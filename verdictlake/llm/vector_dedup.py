"""Embedding near-duplicates: spherical k-means cells, blocked products, one representative kept.

Unit vectors go to the cell of the centroid with the largest cosine. Each vector is written once, into the file of
a block of whole cells or of a part of a large one; tasks get pairs of blocks and read their files, so vectors travel
no further, whatever is compared. Of two cells, only vectors meet whose distances from the boundary between
them add up to no more than the longest chord that links. A product of single-precision vectors, turned and cut to
the dimensions in which they differ most, leaves out pairs that are too far apart in these already; the others are
decided in double precision. A pair of blocks hands on link counts and a spanning forest of its links, never the links.

Vectors that are bit for bit the same after scaling are merged first and counted, so that a large
group of copies costs no more than one vector.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches, ship_package
from .common import get, new_folder, put, written
from .components import components, forest

#: Vectors of the k-means sample (about), rounds, vectors a cell should hold, most cells.
SAMPLE_VECTORS, ROUNDS, CELL_VECTORS, MOST_CELLS = 20_000, 12, 2_000, 4_096
#: Most vectors of a block, bytes of its vectors in double precision, blocks that a table should have at least.
BLOCK, BLOCK_BYTES, LEAST_BLOCKS = 8_192, 4 << 20, 32
#: Rows of a product, and pairs of blocks of a task.
ROWS, PAIRS = 512, 64
#: Dimensions that are compared first: the fewest that leave this share of a sample's pairs, or the last.
CUTS, LEFT = (8, 16, 24, 32, 48, 64), 1e-3
#: More than single precision may err in these products, which are of unit vectors.
SLACK = 2e-5
#: Cells are compared as far as the distances from their boundary add up to this share of the longest chord that links, sqrt(2 - 2 cosine).
#: 1 loses no link whatever the data; less loses links along the line between two centroids.
MARGIN = 1.0


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all 0, as unit vectors; a row's bits depend on nothing but the row."""
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow, no underflow
    return v / np.sqrt((v * v).sum(1, keepdims=True)) + 0.0


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, raw (the numbers as bytes, null for vectors that link with nothing) and same (a digest of the unit vector) for every row."""
    single = vectors.schema[column].dataType.elementType.typeName() == "float"
    kind = np.dtype(np.float32 if single else np.float64)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                lists = batch.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)  # nulls are not a number
                ends = np.cumsum(sizes)
                raws: list = [None] * len(sizes)
                sames: list = [None] * len(sizes)
                for n in np.unique(sizes[sizes > 0]).tolist():
                    rows = np.flatnonzero(sizes == n)
                    v = values[(ends[rows] - n)[:, None] + np.arange(n)]
                    fit = np.isfinite(v).all(1) & (v != 0).any(1)
                    rows, v = rows[fit], v[fit]
                    for k, raw, unit in zip(rows.tolist(), v, _scaled(v.astype(np.float64))):
                        raws[k], sames[k] = raw.tobytes(), hashlib.blake2b(unit.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raws, pa.binary()), pa.array(sames, pa.binary())], names=["vec_id", "raw", "same"])

    numbers = F.col(column) if single else F.col(column).cast("array<double>")
    return map_batches(vectors.select("vec_id", numbers.alias("embedding")), scaled, "vec_id long, raw binary, same binary")


def _units(raws: list[bytes], single: bool) -> np.ndarray:
    return _scaled(np.frombuffer(b"".join(raws), np.float32 if single else np.float64).reshape(len(raws), -1).astype(np.float64))


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell keeps its centroid. The start is spread evenly over the rows."""
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norms = np.sqrt((sums * sums).sum(1))
        moved = norms > 1e-12
        centroids[moved] = sums[moved] / norms[moved, None]
    return centroids


class Cells:
    """Centroids of vectors of one length, and the basis in which vectors are compared first."""

    def __init__(self, x: np.ndarray, cells: int, cosine: float):
        """x: unit vectors of a sample."""
        self.centroids = spherical_kmeans(x, max(1, min(MOST_CELLS, len(x), cells))) if len(x) else np.zeros((1, x.shape[1]))
        sample = x[np.linspace(0, len(x) - 1, min(len(x), 1000)).astype(int)] if len(x) else np.eye(1, x.shape[1])
        self.basis = np.linalg.svd(sample, full_matrices=False)[2][: CUTS[-1]].T
        for k in CUTS:
            y = sample @ self.basis[:, :k]
            near = (y * y).sum(1)[:, None] + (y * y).sum(1) - 2 * y @ y.T <= 2 - 2 * cosine
            if near.mean() - 1 / len(y) <= LEFT or k >= self.basis.shape[1]:
                break
        self.basis = self.basis[:, :k]


def _fit_cells(vectors: DataFrame, lengths: list[int], count: int, per_cell: int, cosine: float, single: bool) -> dict[int, Cells]:
    """Cells for each vector length (bytes), learned from a hash sample of about SAMPLE_VECTORS vectors in all."""
    share = min(1 << 20, (SAMPLE_VECTORS << 20) // max(1, count) + 1)
    rows = vectors.where(F.pmod(F.xxhash64("same"), F.lit(1 << 20)) < share).groupBy("same").agg(F.first("raw").alias("raw")).collect()
    found = {}
    for n in lengths:
        sample = [r for _, r in sorted((bytes(r["same"]), bytes(r["raw"])) for r in rows if len(r["raw"]) == n)]
        x = _units(sample, single) if sample else np.zeros((0, n // (4 if single else 8)))
        found[n] = Cells(x, -(-count // per_cell), cosine)
    return found


def _place(cells: dict[int, Cells], single: bool):
    """Adds each vector's cell, numbered over all lengths."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, start = {}, 0
        for n in sorted(cells):
            base[n], start = start, start + len(cells[n].centroids)
        for batch in batches:
            raws = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raws])
            home = np.zeros(len(raws), np.int32)
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                x = _units([raws[k] for k in rows], single)
                for low in range(0, len(rows), 1024):
                    home[rows[low : low + 1024]] = (x[low : low + 1024] @ cells[n].centroids.T).argmax(1) + base[n]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "cell"])

    return place


class Block:
    """Vectors of a file, by cell."""

    def __init__(self, uri: str, cells: Cells, base: int, single: bool):
        with np.load(io.BytesIO(get(uri))) as f:
            self.same, self.n, cell, raw = f["same"], f["n"], f["cell"], f["raw"]
        self.x = _scaled(raw.astype(np.float64))
        self.cells, start = np.unique(cell - base, return_index=True)
        self.slices = [slice(a, b) for a, b in zip(start, [*start[1:], len(cell)])]
        self.own = (self.x * cells.centroids[cell - base]).sum(1)
        y = self.x @ cells.basis
        half, one = -(y * y).sum(1, keepdims=True) / 2, np.ones((len(y), 1))
        self.left, self.right = (np.concatenate(z, 1).astype(np.float32) for z in ((y, half, one), (y, one, half)))

    def beyond(self, other: Block, cells: Cells) -> np.ndarray:
        """Distances of the vectors from the boundary to each cell of the other block."""
        c = cells.centroids
        between = np.repeat(np.linalg.norm(c[self.cells][:, None, :] - c[other.cells][None, :, :], axis=2), [s.stop - s.start for s in self.slices], 0)
        gap = self.own[:, None] - self.x @ c[other.cells].T
        return np.where(between > 1e-9, gap / np.maximum(between, 1e-9), 0.0)


def _linked(a: Block, b: Block, i: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of vectors i of a and j of b that link."""
    far = (a.left[i] @ b.right[j].T).ravel() < cosine - 1 - SLACK
    at = np.flatnonzero(~far)
    if len(at) * 16 > len(far):
        k, m = np.nonzero(a.x[i] @ b.x[j].T >= cosine)
        return i[k], j[m]
    k, m = i[at // len(j)], j[at % len(j)]
    if not len(at):
        return k, m
    step = max(1, (1 << 21) // a.x.shape[1])
    fit = np.concatenate([np.einsum("ij,ij->i", a.x[k[low : low + step]], b.x[m[low : low + step]]) >= cosine for low in range(0, len(k), step)])
    return k[fit], m[fit]


def _pairs(a: Block, b: Block, cells: Cells, cosine: float, chord: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that link, as places in a and in b, each pair once where a is b; some at a time."""
    off, back = a.beyond(b, cells), b.beyond(a, cells)
    for p, (home, own) in enumerate(zip(a.cells.tolist(), a.slices)):
        for q, (cell, others) in enumerate(zip(b.cells.tolist(), b.slices)):
            if a is b and cell < home:
                continue
            i, j = np.arange(own.start, own.stop), np.arange(others.start, others.stop)
            if cell == home:
                for low in range(0, len(i), ROWS):
                    k, m = _linked(a, b, i[low : low + ROWS], j[low:] if a is b else j, cosine)
                    yield (k[k < m], m[k < m]) if a is b else (k, m)
                continue
            d, e = off[own, q], back[others, p]
            i, d = (x[d <= chord - min(e.min(), 0)] for x in (i, d))
            j, e = (x[e <= chord - min(off[own, q].min(), 0)] for x in (j, e))
            by_d, by_e = np.argsort(d), np.argsort(e)
            i, d, j, e = i[by_d], d[by_d], j[by_e], e[by_e]
            for low in range(0, len(i), ROWS):
                near = int(np.searchsorted(e, chord - d[low], "right"))
                if not near:
                    break
                yield _linked(a, b, i[low : low + ROWS], j[:near], cosine)


def _meet(load, starts: np.ndarray, cosine: float, chord: float):
    """For each number of a pair of blocks, (same, links, null) of its linked vectors and (same, null, other) of a spanning forest."""

    def met(a: Block, b: Block, cells: Cells) -> pa.RecordBatch | None:
        same, n = (a.same, a.n) if a is b else (np.concatenate([a.same, b.same]), np.concatenate([a.n, b.n]))
        shift, links, edges = 0 if a is b else len(a.n), np.zeros(len(n), np.int64), []
        for i, j in _pairs(a, b, cells, cosine, chord):
            if len(i):
                j = j + shift
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                edges.append(forest(i, j, len(n)))
        if not edges:
            return None
        u, v = forest(*(np.concatenate(x) for x in zip(*edges)), len(n))
        k = np.flatnonzero(links)
        names = [x.tobytes() for x in same]
        return pa.RecordBatch.from_arrays(
            [pa.array([names[x] for x in [*k, *u]], pa.binary()), pa.array(np.concatenate([links[k], np.zeros(len(u), np.int64)])), pa.array([*[None] * len(k), *(names[x] for x in v)], pa.binary())], names=["same", "links", "other"]
        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple[Block, Cells] | None] = OrderedDict()

        def block(k: int):
            if k not in held:
                while len(held) > 1:
                    held.popitem(last=False)
                held[k] = load(k)
            held.move_to_end(k)
            return held[k]

        for batch in batches:
            for pair in batch.column(0).to_pylist():
                i = int(np.searchsorted(starts, pair, "right")) - 1
                j = i + pair - int(starts[i])
                if (b := block(j)) and (a := block(i)) and (out := met(a[0], b[0], a[1])):
                    yield out

    return meet


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, margin: float = MARGIN, per_cell: int = CELL_VECTORS, block: int = BLOCK, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding).

    Links are pairs found with a cosine of at least ``cosine`` in double precision. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths don't link. Repeated rows are vectors of their own, and link. A null vec_id
    keeps its row, and is a component_id only where there is no other. An empty table gives none.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    single = vectors.schema[column].dataType.elementType.typeName() == "float"
    whole = unit_vectors(vectors, column)
    units = written(whole.select("vec_id", "same", F.length("raw").alias("bytes")), "units")
    distinct = written(units.where("same is not null").groupBy("same").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("bytes").alias("bytes")), "distinct")
    lengths = {r.bytes: r.n for r in distinct.groupBy("bytes").agg(F.count("*").alias("n")).collect()}
    count, whole = sum(lengths.values()), whole.where("same is not null").select("same", "raw")
    cells = _fit_cells(whole, sorted(lengths), count, per_cell, cosine, single)
    chord = margin * float(np.sqrt(2 - 2 * cosine)) + 1e-9

    # A row for each cell: at most MOST_CELLS for each vector length. Sizes only deal vectors out; copies count in them.
    sizes = {r.cell: r.n for r in map_batches(whole, _place(cells, single), "same binary, raw binary, cell int").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    of, ends, homes, blocks, number = [], [], [], 0, 0  # of: a cell's first block and its parts; ends, homes: for each block
    for n in sorted(cells):
        base, first, room = number, blocks, 0
        most = max(1, min(block, max(256, BLOCK_BYTES // (n * (2 if single else 1))), max(256, -(-lengths[n] // LEAST_BLOCKS))))
        for _ in cells[n].centroids:
            held = sizes.get(number, 0)
            if held > room or blocks == first:  # the cell begins a block
                parts, room = max(1, -(-held // most)), most
                of.append((blocks, parts))
                blocks += parts
                room = room - held if parts == 1 else 0
            else:
                of.append((blocks - 1, 1))
                room -= held
            number += 1
        ends += [blocks] * (blocks - first)
        homes += [(n, base)] * (blocks - first)
    folder, place = new_folder(spark, "blocks"), np.array(of, np.int64).reshape(-1, 2)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _place(cells, single)(batches):
            cell = batch.column(3).to_numpy()
            part = np.array([int.from_bytes(x[:7], "little") for x in batch.column(0).to_pylist()], np.int64) % place[cell, 1] if len(cell) else cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place[cell, 0] + part, pa.int64())], names=["same", "raw", "n", "cell", "block"])

    def store(table: pa.Table) -> pa.Table:
        number, table, out = table.column("block")[0].as_py(), table.sort_by([("cell", "ascending"), ("same", "ascending")]), io.BytesIO()
        same, raw = (np.frombuffer(b"".join(table.column(c).to_pylist()), t).reshape(len(table), -1) for c, t in (("same", np.uint8), ("raw", np.float32 if single else np.float64)))
        np.savez(out, same=same, raw=raw, n=table.column("n").to_numpy(), cell=table.column("cell").to_numpy())
        put(f"{folder}/{number}.npz", out.getvalue())
        return pa.table({"block": pa.array([number], pa.int64())})

    def load(k: int) -> tuple[Block, Cells] | None:
        n, base = homes[k]
        try:
            return Block(f"{folder}/{k}.npz", cells[n], base, single), cells[n]
        except FileNotFoundError:  # no vector fell into this part of its cell
            return None

    if blocks:
        once = whole.groupBy("same").agg(F.first("raw").alias("raw"), F.count("*").alias("n"))
        once = map_batches(once, dealt, "same binary, raw binary, n long, cell int, block long")
        once.groupBy("block").applyInArrow(store, "block long").agg(F.count("*")).first()
    partners = np.array(ends, np.int64) - np.arange(blocks)
    starts, pairs = np.cumsum(partners) - partners, int(partners.sum())
    tasks = max(1, min(pairs, max(2 * spark.sparkContext.defaultParallelism, -(-pairs // PAIRS))))
    met = written(map_batches(spark.range(0, pairs, 1, tasks), _meet(load, starts, cosine, chord), "same binary, links long, other binary"), "met")
    links = met.where("other is null").groupBy("same").agg(F.sum("links").alias("links"))
    roots = components(met.where("other is not null").select("same", "other"), "same", "other")
    grouped = distinct.select("same", "n", "least").join(roots.withColumnRenamed("node", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_same = grouped.join(least, "root").join(links, "same", "left")
    by_same = by_same.select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    rows = units.select("vec_id", "same").join(by_same, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


#: DuckDB SQL for near_duplicates() on tables of a few thousand finite vectors: all pairs, then everything reachable.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
