"""MinHash near-duplicates over HyperMinHash registers.

Every text becomes 128 registers, one per hash bucket, each holding the leading-zero
count and ten mantissa bits of the bucket's smallest hash.  Bands of four registers
propose pairs; the Jaccard estimate, corrected for chance register collisions, drops
the clearly different; full shingle sets (64-bit hashes of all shingles) decide the rest.

Sets too small to fill the buckets (``SMALL_TO`` shingles at most) would have registers
that depend on each other, so each of theirs takes the smallest of all the set's hashes
under a salt of its own.  Sets of more than ``SMALL_FROM`` have both kinds up to that size,
so that any two sets of 0.75 similarity meet in one kind, the one of the larger set.

Large groups never become all pairs.  Identical sets collapse to one representative
first.  Then, in a part of the band buckets, members are compared with two centres only,
linked ones are contracted, and this repeats with other buckets and centres; what is still
in different components of any bucket is compared exhaustively in small register blocks.

What may be missed: two sets at Jaccard 0.75 exactly share no band with probability
(1 - 0.75**4)**32, about 5e-6, at every set size, less above 0.75.  The estimates are cut six
standard errors below ``similarity`` (some 1e-9); sets of ``LOW_HASHES`` at most are
compared whole instead of estimated in the exhaustive comparison.

Defined edge results: null, empty and white-space texts have no shingles and link with
nothing; a null id gets no component and is kept, and its text links nothing; rows of one
id are one document, whichever of its texts links it, and have one component; equal texts
share one component; texts of any length are hashed whole, segment by segment; ties at
``similarity`` link; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, discard, tasks_for, written
from tidemark.llm.shingles import hashed_shingles, in_pieces, mix

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND_ROWS = 4
BANDS = REGISTERS // BAND_ROWS
#: Sets of up to SMALL_TO shingles have salted registers, those of more than SMALL_FROM bucket
#: registers; SMALL_FROM is under 0.75 * SMALL_TO.
SMALL_FROM, SMALL_TO = 144, 256
#: Estimates below ``similarity`` by more than this (over six standard errors) are dropped.
ESTIMATE_SLACK = 0.25
#: Members of a bucket that meet in one task of the exhaustive comparison, from each side.
BLOCK = 256
#: Smallest shingle hashes kept for that comparison: whole sets up to this size.
LOW_HASHES = 512
#: Their estimate has a standard error under 0.02; whole sets need room for chance equalities only.
LOW_SLACK = 0.13
#: Each round of centres takes one bucket in so many; the exhaustive comparison takes all.
STAR_PART = 4
_BYTES = 2 * REGISTERS


def _cells_of(hashes: np.ndarray) -> np.ndarray:
    """Register values: leading zeros of the hashes and the bits that follow, from 1 on."""
    fraction, exponent = np.frexp(hashes.astype(np.float64))
    zeros = np.minimum(64 - exponent, 62).astype(np.int64)
    steps = np.clip((fraction * 2 - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1)
    return (1 + zeros * (1 << MANTISSA_BITS) + steps.astype(np.int64)).astype(np.uint16)


def bucket_registers(rows: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """(text, bucket) registers of sorted distinct hashes; empty buckets borrow from filled ones.

    Which one is lent follows from an order of the buckets that every place has for itself,
    so borrowed registers depend on each other no more than their donors' number forces.
    """
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = rows * REGISTERS + bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    own = np.zeros(n_texts * REGISTERS, np.uint16)
    own[cell[first]] = _cells_of(hashes[first] << np.uint64(BUCKET_BITS))
    own = own.reshape(n_texts, REGISTERS)
    for text in np.flatnonzero((own == 0).any(axis=1) & (own != 0).any(axis=1)):
        mine = own[text]
        empty, filled = np.flatnonzero(mine == 0), np.flatnonzero(mine)
        turn = mix((empty[:, None] * REGISTERS + filled).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        mine[empty] = mine[filled[turn.argmin(axis=1)]]
    return own


_SALTS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x51ED270B51ED270B))


def salted_registers(hashes: np.ndarray) -> np.ndarray:
    """Registers of one small set: each the smallest of all hashes under its own salt."""
    return _cells_of(mix(hashes[:, None] ^ _SALTS).min(axis=0))


def registers_of(rows: np.ndarray, hashes: np.ndarray, n_texts: int) -> list[bytes]:
    """Bucket registers, salted registers or both, by set size; empty for empty sets."""
    bounds = np.searchsorted(rows, np.arange(n_texts + 1))
    sizes = np.diff(bounds)
    large = np.flatnonzero(sizes > SMALL_FROM)
    at = np.full(n_texts, -1)
    at[large] = np.arange(len(large))
    mine = np.flatnonzero(at[rows] >= 0)
    buckets = bucket_registers(at[rows[mine]], hashes[mine], len(large))
    out = []
    for text, (lo, n) in enumerate(zip(bounds[:-1].tolist(), sizes.tolist())):
        raw = buckets[at[text]].tobytes() if n > SMALL_FROM else b""
        out.append(raw + salted_registers(hashes[lo : lo + n]).tobytes() if 0 < n <= SMALL_TO else raw)
    return out


def _matrix(raw: list[bytes], small: bool) -> np.ndarray:
    """The salted registers of texts that have them, or the bucket registers."""
    return np.frombuffer(b"".join(r[-_BYTES:] if small else r[:_BYTES] for r in raw), np.uint16).reshape(-1, REGISTERS)


def band_keys(registers: np.ndarray, small: bool) -> np.ndarray:
    """(text, band) keys: four registers side by side, mixed with the band's number and kind."""
    packed = np.ascontiguousarray(registers).view(np.uint64)
    number = np.arange(BANDS, dtype=np.uint64) + np.uint64(BANDS * small)
    return mix(packed + number * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def chance_collision(load_a: np.ndarray, load_b: np.ndarray) -> np.ndarray:
    """Probability that two different minima fall into one register cell.

    A minimum is exponential with the register's load, the number of hashes that it is the
    least of, as rate.  Inside octave z all cells have one width, so the product of both
    densities integrates in closed form.
    """
    a, b = np.broadcast_arrays(np.maximum(load_a, 1 / REGISTERS), np.maximum(load_b, 1 / REGISTERS))
    top = 2.0 ** -np.arange(32)
    both = (a + b)[..., None]
    octaves = top / 2 / (1 << MANTISSA_BITS) * (np.exp(-both * top / 2) - np.exp(-both * top))
    return np.clip(octaves.sum(axis=-1) * a * b / (a + b), 0, 0.5)


def estimate(reg_a: np.ndarray, reg_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, small: bool) -> np.ndarray:
    """Jaccard estimate: the share of equal registers, less the share that chance explains."""
    same = (reg_a == reg_b).mean(axis=-1)
    per = 1 if small else REGISTERS
    chance = chance_collision(np.asarray(n_a, np.float64) / per, np.asarray(n_b, np.float64) / per)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in in_pieces(texts):
            rows, hashes = hashed_shingles(texts[lo:hi])
            n, sign_a, sign_b = _signs(rows, hashes, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sign_a), pa.array(sign_b), pa.array(registers_of(rows, hashes, hi - lo), pa.binary())],
                names=["id", "n", "sign_a", "sign_b", "registers"],
            )


def _signs(rows: np.ndarray, hashes: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes and two 64-bit sums that tell sets apart."""
    signs = [np.zeros(n_texts, np.uint64) for _ in range(2)]
    for sign, salt in zip(signs, (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
        np.add.at(sign, rows, mix(hashes ^ np.uint64(salt)))
    return np.bincount(rows, minlength=n_texts), signs[0].view(np.int64), signs[1].view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, sign_a, sign_b, registers): set size, 128-bit set signature, register bytes."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_sketch, "id long, n long, sign_a long, sign_b long, registers binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, raw = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for small in (False, True):
            at = np.flatnonzero((n <= SMALL_TO) if small else (n > SMALL_FROM))
            if len(at):
                keys = band_keys(_matrix([raw[i] for i in at], small), small)
                node = np.repeat(batch.column(0).to_numpy()[at], BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.full(len(node), small)), pa.array(node)], names=["band", "small", "node"])


def _likely(similarity: float):
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n_a, n_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            reg_a, reg_b = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            for small in (False, True):
                at = np.flatnonzero(sized & ((np.maximum(n_a, n_b) <= SMALL_TO) == small))
                if len(at):
                    likeness = estimate(_matrix([reg_a[i] for i in at], small), _matrix([reg_b[i] for i in at], small), n_a[at], n_b[at], small)
                    at = at[likeness >= similarity - ESTIMATE_SLACK]
                    yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], names=["a", "b"])

    return run


def _confirmed(similarity: float):
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, text_a, text_b = batch.columns
            at = {}
            for keys, column in ((a.to_pylist(), 2), (b.to_pylist(), 3)):
                at.update((k, (column, i)) for i, k in enumerate(keys) if k not in at)
            sets: dict[int, np.ndarray] = {}
            names = list(at)
            texts = [batch.column(c)[i].as_py() for c, i in at.values()]
            for lo, hi in in_pieces(texts):
                rows, hashes = hashed_shingles(texts[lo:hi])
                bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
                sets.update((names[lo + k], hashes[bounds[k] : bounds[k + 1]]) for k in range(hi - lo))
            keep = []
            for i, j in zip(a.to_pylist(), b.to_pylist()):
                x, y = sets[i], sets[j]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "sign_a", "sign_b", "n", "registers", "low", "text"]
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in in_pieces(texts):
            rows, hashes = hashed_shingles(texts[lo:hi])
            bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
            low = [(hashes[a:b][:LOW_HASHES] >> np.uint64(32)).astype(np.uint32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            n, sign_a, sign_b = _signs(rows, hashes, hi - lo)
            reg = pa.array(registers_of(rows, hashes, hi - lo), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sign_a), pa.array(sign_b), pa.array(n), reg, pa.array(low, pa.binary()), batch.column(1).slice(lo, hi - lo)], names=names)


def _low_jaccard(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, bool]:
    """Jaccard over the hashes known of both sets, and whether those are whole sets."""
    whole = n_a <= LOW_HASHES and n_b <= LOW_HASHES
    if not whole:
        top = min(x[-1] for x, n in ((a, n_a), (b, n_b)) if n > LOW_HASHES)
        a, b = a[a <= top], b[b <= top]
    common = len(np.intersect1d(a, b))
    return common / max(len(a) + len(b) - common, 1), whole


def _cell_pairs(cell: np.ndarray, at_once: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y), x < y, of rows that share a cell; ``cell`` is sorted."""
    end = np.searchsorted(cell, cell, side="right")
    after = end - np.arange(len(cell)) - 1
    edges = np.searchsorted(np.cumsum(after), np.arange(at_once, after.sum() + at_once, at_once)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)]):
        n = after[lo:hi]
        x = np.repeat(np.arange(lo, min(hi, len(cell))), n)
        if len(x):
            yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)


def _block_pairs(similarity: float):
    """Pairs to confirm, from rows sorted by cell; a cell may span two batches."""
    cut, percent = similarity - ESTIMATE_SLACK, round(similarity * 100)

    def likely(table: pa.Table, small: bool) -> pa.RecordBatch:
        cell, band, part, node, comp, n = (table.column(c).to_numpy() for c in ("cell", "band", "part", "node", "comp", "n"))
        crossed = table.column("crossed").to_numpy()
        reg, low = _matrix(table.column("registers").to_pylist(), small), table.column("low").to_pylist()
        keys = band_keys(reg, small)
        found = []
        for x, y in _cell_pairs(cell):
            larger = np.maximum(n[x], n[y])
            fits = (comp[x] != comp[y]) & (crossed[x] == (part[x] != part[y])) & (100 * np.minimum(n[x], n[y]) >= percent * larger) & ((larger <= SMALL_TO) == small)
            x, y = x[fits], y[fits]
            same = keys[x] == keys[y]  # a pair belongs to the first band that it shares
            first = keys[x, same.argmax(axis=1)] == band[x]
            x, y = x[first], y[first]
            close = estimate(reg[x], reg[y], n[x], n[y], small) >= cut
            for i, j in zip(x[close].tolist(), y[close].tolist()):
                likeness, whole = _low_jaccard(np.frombuffer(low[i], np.uint32), np.frombuffer(low[j], np.uint32), n[i], n[j])
                if likeness >= similarity - (0.01 if whole else LOW_SLACK):
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def of_kinds(table: pa.Table) -> Iterator[pa.RecordBatch]:
        small = table.column("small").to_numpy()
        for kind in (False, True):
            if (small == kind).any():
                yield likely(table.filter(pa.array(small == kind)), kind)

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
                yield from of_kinds(table.slice(0, whole))
        if held is not None:
            yield from of_kinds(held)

    return run


def _node(first: Column, clash: Column) -> Column:
    """A set's number: its smallest id, or a negative hash where that id has other sets too."""
    own = F.xxhash64("sign_a", "sign_b", "n").bitwiseOR(F.lit(-(1 << 63)))
    return F.when(clash.isNotNull(), own).otherwise(first)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, star_rounds: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept): near-duplicate classes of whole texts.

    Links join texts whose distinct five-word shingle sets have Jaccard similarity of
    ``similarity`` (whole percents) or more; components are their transitive closure, named
    by the smallest id, whose row is ``kept``.
    """
    spark = docs.sparkSession
    rows = written(sketches(docs, id_col, text_col), "sketches")
    sign = ["sign_a", "sign_b", "n"]
    twice = written(rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "repeated-ids")
    unique = twice.isEmpty()

    filled = rows.where("n > 0 and id is not null")
    sets = filled.groupBy(*sign).agg(F.min(F.struct("id", "registers")).alias("least")).select(*sign, F.col("least.id").alias("first"), F.col("least.registers").alias("registers"))
    if unique:
        reps = written(sets.withColumn("node", F.col("first")), "reps")
        clashes = None
    else:
        sets = written(sets, "sets")
        clashes = written(sets.groupBy("first").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("first").alias("clash")), "clashes")
        reps = written(sets.join(clashes, F.col("first") == F.col("clash"), "left").select(*sign, "first", "registers", _node(F.col("first"), F.col("clash")).alias("node")), "reps")

    bands = reps.select("node", "n", "registers").mapInArrow(_bands, "band long, small boolean, node long")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band")
    bands = written(bands.join(shared, "band"), "bands")
    members = bands.select("node").distinct()
    members = members.withColumnRenamed("node", "id") if unique else members.join(reps.select("node", "first"), "node").select(F.col("first").alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(members, "id", "left_semi")
    if not unique:
        texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).select("id", "text")
    traits = texts.mapInArrow(_traits, "id long, sign_a long, sign_b long, n long, registers binary, low binary, text string")
    if unique:
        traits = traits.withColumnRenamed("id", "node")
    else:
        traits = traits.join(reps.select(*sign, F.col("first").alias("id"), "node"), [*sign, "id"]).dropDuplicates(["node"])
    traits = written(traits.select("node", "n", "registers", "low", "text"), "traits")

    def confirmed(pairs: DataFrame, estimated: bool) -> DataFrame:
        if not estimated:
            at_a = traits.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("reg_a"))
            at_b = traits.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("reg_b"))
            with_both = pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "n_a", "reg_a", "n_b", "reg_b")
            pairs = with_both.mapInArrow(_likely(similarity), "a long, b long")
        at_a = traits.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        at_b = traits.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        with_text = pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "text_a", "text_b")
        return written(with_text.mapInArrow(_confirmed(similarity), "a long, b long"), "links")

    links: DataFrame | None = None
    if not unique:  # the sets of one id are linked by it
        named = rows.where("n > 0").join(twice, "id").join(reps.select(*sign, "node"), sign).select("id", "node").distinct()
        least = named.groupBy("id").agg(F.min("node").alias("a"))
        links = written(named.join(least, "id").where("a <> node").select("a", F.col("node").alias("b")), "id-links")
    labels = connected_components(links) if links is not None else None
    for turn in range(star_rounds + 1):
        if labels is None:
            placed = bands.withColumn("comp", F.col("node"))
        else:
            placed = bands.join(labels.withColumnRenamed("id", "node"), "node", "left")
            placed = placed.select("band", "small", "node", F.coalesce("component", "node").alias("comp"))
        place = F.struct("comp", F.xxhash64("node", F.lit(turn)).alias("h"), "node")
        ends = placed.groupBy("band").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("members"))
        ends = ends.where("lo.comp < hi.comp")
        if turn < star_rounds:
            # a quarter of the buckets joins most of a large group at a quarter of the pairs
            ends = ends.where(F.pmod(F.xxhash64("band", F.lit("turn")), F.lit(STAR_PART)) == turn % STAR_PART)
            near = placed.join(ends.select("band", "lo", "hi"), "band")
            centres = F.filter(F.array("lo", "hi"), lambda c: c["comp"] != F.col("comp"))
            pairs = near.select("node", F.explode(centres).alias("c"))
            pairs = pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
            found = confirmed(pairs, estimated=False)
        else:
            parts = F.ceil(F.col("members") / BLOCK).cast("long")
            near = placed.join(ends.select("band", parts.alias("parts")), "band").join(traits.drop("text"), "node")
            near = near.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")))
            near = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            cell = F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other"))
            near = near.select(cell.alias("cell"), (F.col("part") != F.col("other")).alias("crossed"), "band", "small", "part", "node", "comp", "n", "registers", "low")
            near = near.repartition(tasks_for(spark), "cell").sortWithinPartitions("cell")
            pairs = near.mapInArrow(_block_pairs(similarity), "a long, b long").distinct()
            found = confirmed(pairs, estimated=True)
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
    discard(bands, traits)

    known = reps.select(*sign, "first", "node").join(labels.withColumnRenamed("id", "node"), "node", "left")
    known = known.select(*sign, "first", F.coalesce("component", "node").alias("component"))
    if not unique:  # a component's name may be a set's number that is no id
        known = written(known, "named-sets")
        known = known.join(known.groupBy("component").agg(F.min("first").alias("least")), "component").select(*sign, F.col("least").alias("component"))
    out = rows.select("id", *sign).join(known.select(*sign, "component"), sign, "left").select("id", "n", "component")
    if not unique:
        one = out.join(twice, "id").groupBy("id").agg(F.min("component").alias("shared"))
        out = out.join(one, "id", "left").select("id", "n", F.coalesce("shared", "component").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
