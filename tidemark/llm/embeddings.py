"""Embedding near-duplicates by E8 lattice hashing.

In each table a vector is rotated at random into blocks of eight dimensions, scaled, and
each block is decoded to its nearest point of the E8 lattice; the points together are the
vector's cell.  A vector is also listed under its nearest neighbouring cells, reached by
the lattice's minimal vectors.  Two vectors meet where one's own cell is among the other's
listed cells, and are linked if their cosine in double precision reaches the threshold.

More vectors need more blocks, or cells would fill up: blocks are added so that a cell
holds some ``CELL_MEMBERS`` evenly spread vectors at any size, and tables so that recall stays.  Two
vectors at cosine 0.95 meet in one table with probability 0.46, 0.28 and 0.18 for 2, 3 and
4 blocks (measured in a test), so a pair is missed with 5e-6 at most, less above 0.95.

Equal vectors collapse to one with a multiplicity.  Crowded cells are compared in blocks of
``PART`` vectors; tasks return counts of links and a spanning forest of each block, never
all pairs.  A pair counts in the first cell where it meets.  Vectors of each length are
searched among their own.

Defined edge results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, and no vector links with one of another length; rows of one
id are separate vectors with links of their own (to each other too), but share a component;
a null id has no component and is kept; labels and other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, discard, tasks_for, written
from tidemark.llm.near_dedup import _cell_pairs
from tidemark.llm.shingles import mix

#: Tables by number of blocks: (1 - meeting rate) ** tables is 5e-6 at most.
TABLES = {2: 20, 3: 36, 4: 64}
#: Cells of one block that matter: the origin and the first shell.
BLOCK_CELLS = 200
CELL_MEMBERS = 64
SCALE = 4.0
PART = 192
_SEED = 20260101


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of size 1, or eight of 1/2 with an even sign count."""
    ones = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(ones + halves)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer point of even sum: round, and if odd move the worst coordinate."""
    out = np.rint(y)
    error = y - out
    rows = np.flatnonzero(out.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(error[rows]).argmax(axis=1)
    out[rows, worst] += np.where(error[rows, worst] >= 0, 1.0, -1.0)
    return out


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point: E8 is D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Lattice:
    def __init__(self, dim: int, blocks: int, scale: float = SCALE):
        rng, tables = np.random.default_rng(_SEED), TABLES[blocks]
        stretch = scale * np.sqrt(max(dim, 8) / 64)  # projections onto 8 of dim axes shrink with dim
        self.rotations = [[np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim] * stretch for _ in range(blocks)] for _ in range(tables)]
        self.moves = minimal_vectors()
        self.choices = np.array(list(itertools.product((0, 1), repeat=blocks)))
        self.listed = len(self.choices)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(table, listed, vector) cell keys; listed 0 is the vector's own cell."""
        out = np.empty((len(self.rotations), self.listed, len(unit)), np.int64)
        place = mix(np.arange(1, 9, dtype=np.uint64))
        for t, table in enumerate(self.rotations):
            own, other, gaps = [], [], []
            for rotation in table:
                y = unit @ rotation
                point = nearest_e8(y)
                along = (y - point) @ self.moves.T
                best = along.argmax(axis=1)
                gaps.append(2 - 2 * along[np.arange(len(unit)), best])
                for keys, p in ((own, point), (other, point + self.moves[best])):
                    keys.append(mix((np.rint(2 * p).astype(np.int64).view(np.uint64) * place).sum(axis=1)))
            order = np.argsort(self.choices @ np.array(gaps), axis=0, kind="stable")[: self.listed]
            for k in range(self.listed):
                key = np.full(len(unit), t, np.uint64)
                for b in range(len(table)):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(self.choices[order[k], b] == 1, other[b], own[b]))
                out[t, k] = key.view(np.int64)
        return out


def blocks_for(vectors: int) -> int:
    """Blocks that leave some ``CELL_MEMBERS`` of so many vectors in a cell."""
    blocks = min(TABLES)
    while blocks < max(TABLES) and vectors > CELL_MEMBERS * BLOCK_CELLS**blocks:
        blocks += 1
    return blocks


_lattices: dict[tuple[int, int], Lattice] = {}


def _lattice(dim: int, blocks: int) -> Lattice:
    if (dim, blocks) not in _lattices:
        if len(_lattices) >= 64:
            _lattices.clear()
        _lattices[(dim, blocks)] = Lattice(dim, blocks)
    return _lattices[(dim, blocks)]


def _stack(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(1).to_pylist():
            v = np.array(x, np.float64) if x and None not in x else np.zeros(0)
            size = np.sqrt(v @ v) if len(v) and np.isfinite(v).all() else 0.0
            if len(v) and np.isfinite(v).all() and not (size > 1e-140 and np.isfinite(size)):
                top = np.abs(v).max()  # out of the range of squares: scale first
                v = v / top if top > 0 else v
                size = np.sqrt(v @ v)
            out.append((v / size).tobytes() if size > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "unit"])


def _keys(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy()
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                for lo in range(0, len(mine), 1000):
                    part = batch.take(pa.array(mine[lo : lo + 1000]))
                    cells = _lattice(int(size) // 8, blocks).cells(_stack(part.column(1)))
                    cells = mix(cells.view(np.uint64) ^ np.uint64(size)).view(np.int64)
                    own = np.zeros(cells.shape, bool)
                    own[:, 0] = True
                    rep = np.broadcast_to(part.column(0).to_numpy(), cells.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(rep.ravel()), pa.array(own.ravel())], names=["key", "rep", "own"])

    return run


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given pairs."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _links(threshold: float, blocks: int):
    """Link counts (a, null, n) and forest edges (a, b, 0) of rows sorted by cell."""

    def by_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = pc.binary_length(table.column("unit")).to_numpy()
        for size in np.unique(sizes):
            yield found(table.filter(pa.array(sizes == size)))

    def found(table: pa.Table) -> pa.RecordBatch:
        cell, key, rep, copies = (table.column(c).to_numpy() for c in ("cell", "key", "rep", "copies"))
        part, crossed, own = (table.column(c).to_numpy() for c in ("part", "crossed", "own"))
        unit = _stack(table.column("unit").combine_chunks())
        cells = None
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for x, y in _cell_pairs(cell):
            fits = (own[x] | own[y]) & (crossed[x] == (part[x] != part[y])) & (rep[x] != rep[y])
            x, y = x[fits], y[fits]
            near = np.concatenate([np.einsum("ij,ij->i", unit[x[i : i + 65536]], unit[y[i : i + 65536]]) for i in range(0, len(x), 65536)] or [np.empty(0)]) >= threshold
            x, y = x[near], y[near]
            if not len(x):
                continue
            if cells is None:
                cells = _lattice(unit.shape[1], blocks).cells(unit)
                cells = mix(cells.view(np.uint64) ^ np.uint64(8 * unit.shape[1])).view(np.int64)
            first = np.zeros(len(x), bool)
            for lo in range(0, len(x), 8192):
                a, b = x[lo : lo + 8192], y[lo : lo + 8192]
                swap = rep[a] > rep[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                # meetings in order: per table, the cell of the smaller id, then of the larger
                at_a = (cells[:, :, b] == cells[:, :1, a]).any(axis=1)
                at_b = (cells[:, :, a] == cells[:, :1, b]).any(axis=1)
                meets = np.stack([at_a, at_b], axis=1).reshape(-1, len(a))
                where = np.stack([cells[:, 0, a], cells[:, 0, b]], axis=1).reshape(-1, len(a))
                first[lo : lo + 8192] = where[meets.argmax(axis=0), np.arange(len(a))] == key[a]
            x, y = x[first], y[first]
            for v, w in ((x, y), (y, x)):
                ids, at = np.unique(rep[v], return_inverse=True)
                for i, n in zip(ids.tolist(), np.bincount(at, copies[w]).astype(np.int64).tolist()):
                    counts[i] = counts.get(i, 0) + n
            edges += _forest(rep[x], rep[y])
        a = [*counts, *[e[0] for e in edges]]
        b = [*[None] * len(counts), *[e[1] for e in edges]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*counts.values(), *[0] * len(edges)], pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cell = table.column("cell").to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))
            held = table.slice(whole)
            if whole:
                yield from by_length(table.slice(0, whole))
        if held is not None:
            yield from by_length(held)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept): links at cosine ``threshold`` or more, and classes."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(base.mapInArrow(_units, "id long, unit binary"), "units")
    reps = rows.where("unit is not null and id is not null").groupBy("unit").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps, "unit-reps")
    twice = written(rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "repeated-ids")
    unique = twice.isEmpty()
    if unique:
        reps = reps.withColumn("rep", F.col("first"))
    else:  # an id of several vectors names none of them: those get negative hashes
        clashes = reps.groupBy("first").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("first").alias("clash"))
        own = F.xxhash64("unit").bitwiseOR(F.lit(-(1 << 63)))
        reps = reps.join(clashes, F.col("first") == F.col("clash"), "left").withColumn("rep", F.when(F.col("clash").isNull(), F.col("first")).otherwise(own))
        reps = written(reps.drop("clash"), "unit-numbers")
    blocks = blocks_for(reps.count())

    keys = written(reps.select("rep", "unit").mapInArrow(_keys(blocks), "key long, rep long, own boolean"), "cells")
    crowds = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("own").alias("used")).where("members > 1 and used")
    near = keys.join(crowds.select("key", F.ceil(F.col("members") / PART).cast("long").alias("parts")), "key")
    near = near.join(reps.select("rep", "copies", "unit"), "rep")
    near = near.withColumn("part", F.pmod(F.xxhash64("rep", F.lit("part")), F.col("parts")))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    near = near.select(cell.alias("cell"), "key", "rep", "own", "copies", "part", (F.col("part") != F.col("other")).alias("crossed"), "unit")
    near = near.repartition(tasks_for(vectors.sparkSession), "cell").sortWithinPartitions("cell")
    found = written(near.mapInArrow(_links(threshold, blocks), "a long, b long, n long"), "vector-links")
    discard(keys)

    links = found.where("b is not null").select("a", "b")
    if not unique:
        named = rows.join(twice, "id").join(reps.select("unit", "rep"), "unit").select("id", "rep").distinct()
        least = named.groupBy("id").agg(F.min("rep").alias("a"))
        links = links.unionByName(named.join(least, "id").where("a <> rep").select("a", F.col("rep").alias("b")))
    labels = connected_components(links)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    known = reps.join(counts, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("unit", "first", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    if not unique:
        known = written(known, "named-vectors")
        known = known.join(known.groupBy("component").agg(F.min("first").alias("least")), "component").select("unit", "n_links", F.col("least").alias("component"))
    out = rows.join(known.select("unit", "n_links", "component"), "unit", "left").select("id", "n_links", "component")
    if not unique:
        one = out.join(twice, "id").groupBy("id").agg(F.min("component").alias("shared"))
        out = out.join(one, "id", "left").select("id", "n_links", F.coalesce("shared", "component").alias("component"))
    some = F.col("id").isNotNull()
    n_links, component = F.when(some, F.col("n_links")), F.when(some, F.coalesce("component", "id"))
    return out.select("id", F.coalesce(n_links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
