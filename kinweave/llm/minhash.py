"""Near-duplicate documents: MinHash bands, signature check, exact check on full shingle sets, star components.

Equal shingle sets collapse to a class first, so exact copies cost one row; classes, not ids, are what is linked.
Classes meet in the buckets of their bands. A bucket compares its members with one pivot, and only buckets whose members
then still fall into several components go on: to a second pivot, and after that to a grid of the members outside the
largest component against all members, in cells of bounded size. A cell first compares signatures, then briefs (sets of
numbers cut short: what they have in common is never too few), and names the members that have a partner; only for these
are full sets fetched, and the cell then gives a forest of links, never all pairs. Pairs of pivots take the same steps.
Every link is confirmed on the full sets. Stars are dealt in salted parts (the pivot's row is copied, not its members'),
and buckets and classes with many rows are joined by broadcast, so no key is one task's.

With 32 bands of 5 minima a pair at similarity 0.8 is missed with probability 3e-6 (less above), and a pair that shares
a bucket passes the signature check unless its estimate is more than five standard deviations low.

Defined results: null and empty texts have no shingles and stand alone; texts that share an id are judged each by its
own text, so rows of one id may fall into different components; rows without an id take part, link others, and are never
kept (a component of such rows only has a null component_id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, grouped, join_hot, narrow, release, slices, small_batches, utf8
from .components import components
from .words import LOWER, digest, hash_spans, mix, spans, windows

BANDS, ROWS = 32, 5
#: Shingles that go through the hash functions at a time.
CHUNK = 1 << 15
#: Members of a bucket in one block of the grid.
BLOCK = 256
#: Members of one part of a pivot's star.
STAR = 2048
#: Rounds with one pivot a bucket before the grid.
PIVOT_ROUNDS = 2
#: Most bits of the map of wanted sets (32 MB).
MAP_BITS = 1 << 28
#: Members of a set from which its brief has 32 bits each, not 16.
MANY = 1 << 12

_rng = np.random.Generator(np.random.PCG64(20260202))
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words than ``width`` is one shingle."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    data = LOWER[data]
    starts, ends, at = spans(data, offsets)
    words = hash_spans(data, starts, ends)
    every = windows(words, width)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(every[lo : hi - width + 1]))
        elif hi > lo:
            out.append(windows(words[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each hash function a * x + b (modulo 2 ** 64) over each set; all sets have members."""
    out = np.empty((len(sets), len(_A)), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= CHUNK:
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        first = np.cumsum([0, *map(len, sets[at : to - 1])])
        work = np.empty_like(flat)
        for k in range(len(_A)):
            np.multiply(flat, _A[k], out=work)
            np.add(work, _B[k], out=work)
            out[at:to, k] = np.minimum.reduceat(work, first)
        at = to
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, n_shingles, set digest (hi, lo), bucket keys of the bands, and one byte of each minimum; of (doc_id, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(batch, width)
            full = [k for k, s in enumerate(sets) if len(s)]
            low = minima([sets[k] for k in full]) >> np.uint64(24)
            keys = mix(np.einsum("nbr,br->nb", low.reshape(-1, BANDS, ROWS), _BAND) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            short = (mix(low) & np.uint64(255)).astype(np.uint8)
            marks = [digest(s) for s in sets]
            bands: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            for row, k in enumerate(full):
                bands[k], sigs[k] = keys[row], short[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sigs, pa.binary()),
                ],
                ["doc_id", "mark", "n_shingles", "hi", "lo", "bands", "sig"],
            )

    schema = "doc_id long, mark long, n_shingles long, hi long, lo long, bands array<long>, sig binary"
    return docs.select("doc_id", "mark", "text").mapInArrow(run, schema)


def _bitmap(spots: DataFrame, n: int) -> np.ndarray:
    """A map of about 16 bits a number for ``n`` numbers (spot), so one in 16 others passes it. It is put together by the
    executors; beyond MAP_BITS more others pass, none is lost."""
    bits = min(MAP_BITS, 64 << max(0, (16 * n // 64).bit_length()))
    at = F.pmod("spot", F.lit(bits))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    found = spots.select(F.floor(at / 64).cast("long").alias("at"), word.alias("word")).groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return out


def full_sets(docs: DataFrame, reps: DataFrame, n: int, width: int) -> DataFrame:
    """(node, members): the whole shingle set as 8-byte numbers, of each of the ``n`` rows (node, rep_id, rep_mark) of reps.

    All texts are read; only sets that pass a map of what is wanted are moved to meet their node.
    """
    spot = lambda *c: F.xxhash64(*c).alias("spot")
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(reps.select(spot("rep_id", "rep_mark")), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for whole in batches:
            at = whole.column(3).to_numpy() % (64 * len(words))
            hit = (words[at >> 6] >> (at & 63)) & 1 > 0
            for batch in slices(iter([whole.filter(pa.array(hit))]), "text", 1 << 20):
                sets = [s.tobytes() for s in shingle_sets(batch, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sets, pa.binary())], ["doc_id", "mark", "members"])

    found = docs.select("doc_id", "mark", "text", spot("doc_id", "mark")).mapInArrow(run, "doc_id long, mark long, members binary")
    same = (F.col("mark") == F.col("rep_mark")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    return found.join(reps, same).select("node", "members")


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from bytes of minima (equal bytes of unequal minima, 1 in 256, taken off)."""
    return ((a == b).mean(-1) * 256 - 1) / 255


def similar(left: np.ndarray, right: np.ndarray, per_hundred: int) -> bool:
    """Whether 100 * common >= per_hundred * union, for sorted distinct sets."""
    small, large = (left, right) if len(left) < len(right) else (right, left)
    if not len(small) or 100 * len(small) < per_hundred * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= per_hundred * (len(left) + len(right) - common)


def brief(members: np.ndarray) -> bytes:
    """The first 16 (of large sets 32) bits of each member of a sorted set, as steps, byte by byte; at the end their width."""
    width = 2 if len(members) < MANY else 4
    steps = np.diff(members >> np.uint64(64 - 8 * width), prepend=np.uint64(0)).astype(f"<u{width}")
    return steps.view(np.uint8).reshape(-1, width).T.tobytes() + bytes([width])


def read_brief(data: bytes) -> np.ndarray:
    width = data[-1]
    steps = np.frombuffer(data, np.uint8, len(data) - 1).reshape(width, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(f"<u{width}").ravel(), dtype=f"<u{width}")


def possible(left: np.ndarray, right: np.ndarray, per_hundred: int) -> bool:
    """False only where the sets of two briefs are not similar: equal members are equal when cut, so the members of one whose
    cut number the other has are no fewer than the common ones."""
    small, large = (left, right) if len(left) < len(right) else (right, left)
    if not len(small) or 100 * len(small) < per_hundred * len(large):
        return False
    if small.itemsize != large.itemsize:
        small, large = ((x if x.itemsize == 2 else (x >> 16).astype("<u2")) for x in (small, large))
    if small.itemsize == 2:
        has = np.zeros(1 << 16, bool)
        has[large] = True
        common = int(np.count_nonzero(has[small]))
    else:
        common = int(np.isin(small, large).sum())
    return 100 * common >= per_hundred * (len(left) + len(right) - common)


def briefs(sets: DataFrame) -> DataFrame:
    """(node, brief) of (node, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [brief(np.frombuffer(m.as_buffer(), np.uint64)) for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], ["node", "brief"])

    return sets.select("node", "members").mapInArrow(run, "node long, brief binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Signatures as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _stars(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """(u, part, v, data) in runs of (u, part): the pivot's own row (null v) first, then its members'.

    A star of many members is dealt to several parts, and each part gets a copy of the pivot's row.
    """
    sizes = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / STAR).cast("int"))
    part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    data = payload.columns[1]
    dealt = join_hot(pairs, sizes, ["u"], "n").select("u", part.alias("part"), "v")
    members = dealt.join(payload.select(F.col("node").alias("v"), data), "v").select("u", "part", "v", data)
    pivots = sizes.join(payload.withColumnRenamed("node", "u"), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), data)
    return pivots.union(members).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())


def _alike(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least that share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.asarray(batch.column(2).is_null())
            sig = _matrix(batch.column(3))
            spots = np.flatnonzero(head)
            source = np.searchsorted(spots, np.arange(len(head)), "right") - 1
            base = sig[spots[np.maximum(source, 0)]] if len(spots) else np.empty_like(sig)
            if pivot is not None:
                base[source < 0] = pivot
            keep = ~head & (agree(base, sig) >= least)
            if len(spots):
                pivot = sig[spots[-1]]
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return _stars(pairs, sigs.select("node", "sig")).mapInArrow(run, "u long, v long")


def _compared(pairs: DataFrame, payload: DataFrame, read: Callable[[pa.Scalar], np.ndarray], same: Callable[..., bool], per_hundred: int) -> DataFrame:
    """Pairs (u, v) whose payloads are the same. A payload is one row of a star, the pivot's is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            head, keep = np.asarray(batch.column(2).is_null()), np.zeros(batch.num_rows, bool)
            for k, data in enumerate(batch.column(3)):
                own = read(data)
                if head[k]:
                    pivot = own.copy()
                else:
                    keep[k] = same(pivot, own, per_hundred)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return _stars(pairs, payload).mapInArrow(run, "u long, v long")


def confirm(pairs: DataFrame, sets: DataFrame, per_hundred: int) -> DataFrame:
    """Pairs (u, v) whose full sets have 100 * common >= per_hundred * union."""
    return _compared(pairs, sets, lambda data: np.frombuffer(data.as_buffer(), np.uint64), similar, per_hundred)


def _plausible(pairs: DataFrame, cut: DataFrame, per_hundred: int) -> DataFrame:
    """Pairs (u, v) that their briefs don't rule out."""
    return _compared(pairs, cut, lambda data: read_brief(data.as_py()), possible, per_hundred)


def _cells(known: DataFrame) -> DataFrame:
    """(key, i, j, side, node, component): members outside a bucket's largest component (side 0) against all (side 1)."""
    each = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("own"))
    sizes = each.groupBy("key").agg(F.sum("own").alias("n"), F.max(F.struct("own", "component")).alias("top"))
    sizes = sizes.select("key", "n", F.col("top.component").alias("most"), (F.col("n") - F.col("top.own")).alias("few"))
    sizes = sizes.withColumn("rows", F.ceil(F.col("few") / BLOCK).cast("int")).withColumn("cols", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = join_hot(known.select("key", "node", "component"), sizes, ["key"], "n")

    def side(which: int, own: str, other: str) -> Column:
        mine = F.pmod(F.xxhash64("node", F.lit(which)), F.col(own)).cast("int")
        spots = F.sequence(F.lit(0), F.col(other) - 1)
        cell = (lambda x: F.struct(mine.alias("i"), x.alias("j"), F.lit(0).alias("side"))) if which == 0 else (lambda x: F.struct(x.alias("i"), mine.alias("j"), F.lit(1).alias("side")))
        return F.transform(spots, cell)

    spots = F.when(F.col("component") == F.col("most"), side(1, "cols", "rows")).otherwise(F.concat(side(0, "rows", "cols"), side(1, "cols", "rows")))
    return dealt.select("key", "node", "component", F.explode(spots).alias("cell")).select("key", "cell.i", "cell.j", "cell.side", "node", "component")


def _sorted_cells(cells: DataFrame) -> DataFrame:
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _partnered(cells: DataFrame, sigs: DataFrame, least: float, per_hundred: int) -> DataFrame:
    """The rows of cells whose member has a partner in another component, as far as sizes and signatures tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, 3):
            side, component, size = (cell.column(k).to_numpy() for k in (3, 5, 6))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            sig = _matrix(cell.column(7))
            found = np.zeros(len(side), bool)
            for row in left.tolist():
                other = right[component[right] != component[row]]
                other = other[100 * np.minimum(size[other], size[row]) >= per_hundred * np.maximum(size[other], size[row])]
                other = other[agree(sig[other], sig[row]) >= least]
                if len(other):
                    found[other] = found[row] = True
            if found.any():
                yield from cell.select(list(range(6))).filter(pa.array(found)).combine_chunks().to_batches()

    dealt = _sorted_cells(cells.join(sigs.select("node", "n_shingles", "sig"), "node").select(*cells.columns, "n_shingles", "sig"))
    return dealt.mapInArrow(run, cells.schema)


def _unruled(cells: DataFrame, sigs: DataFrame, cut: DataFrame, least: float, per_hundred: int) -> DataFrame:
    """The rows of cells whose member has a partner in another component that neither signatures nor briefs rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, 3):
            side, component = cell.column(3).to_numpy(), cell.column(5).to_numpy()
            sig = _matrix(cell.column(6))
            own = [read_brief(b) for b in cell.column(7).to_pylist()]
            right = np.flatnonzero(side == 1)
            found = np.zeros(len(side), bool)
            for row in np.flatnonzero(side == 0).tolist():
                other = right[component[right] != component[row]]
                for col in other[agree(sig[other], sig[row]) >= least].tolist():
                    if not (found[row] and found[col]) and possible(own[row], own[col], per_hundred):
                        found[row] = found[col] = True
            if found.any():
                yield from cell.select(list(range(6))).filter(pa.array(found)).combine_chunks().to_batches()

    dealt = cells.join(sigs.select("node", "sig"), "node").join(cut, "node").select(*cells.columns, "sig", "brief")
    return _sorted_cells(dealt).mapInArrow(run, cells.schema)


def _forest(cells: DataFrame, sigs: DataFrame, sets: DataFrame, least: float, per_hundred: int) -> DataFrame:
    """Confirmed links (u, v) of cells: only pairs that the links so far leave in different components are compared, so
    a cell gives fewer links than it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, 3):
            side, node = cell.column(3).to_numpy(), cell.column(4).to_numpy()
            # components as small numbers, merged as links are found
            merged = np.unique(cell.column(5).to_numpy(), return_inverse=True)[1]
            sig = _matrix(cell.column(6))
            full = [np.frombuffer(m.as_buffer(), np.uint64) for chunk in cell.column(7).chunks for m in chunk]
            size = np.array([len(f) for f in full])
            right = np.flatnonzero(side == 1)
            us, vs = [], []
            for row in np.flatnonzero(side == 0).tolist():
                other = right[merged[right] != merged[row]]
                other = other[100 * np.minimum(size[other], size[row]) >= per_hundred * np.maximum(size[other], size[row])]
                alike = agree(sig[other], sig[row])
                for col in other[np.argsort(-alike, kind="stable")][: int((alike >= least).sum())].tolist():
                    if merged[col] != merged[row] and similar(full[row], full[col], per_hundred):
                        us.append(min(node[row], node[col]))
                        vs.append(max(node[row], node[col]))
                        merged[merged == merged[col]] = merged[row]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    dealt = cells.join(sigs.select("node", "sig"), "node").join(sets, "node").select(*cells.columns, "sig", "members")
    return _sorted_cells(dealt).mapInArrow(run, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, per_hundred: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(narrow(docs, id_col, text_col), width, per_hundred)


def _near_duplicates(rows: DataFrame, width: int, per_hundred: int) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "minhash")
    margin = 5 * (per_hundred / 100 * (1 - per_hundred / 100) / (BANDS * ROWS)) ** 0.5
    least = per_hundred / 100 - margin

    # a class is a shingle set; its text is read again by the id and the text's hash of one of its rows
    marked = rows.withColumn("mark", F.xxhash64("text"))
    give_back(rows.sparkSession)
    signed = scratch.save(signatures(marked, width), "signed")
    classes = signed.where("n_shingles > 0").groupBy("hi", "lo", "n_shingles").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "mark")).alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    give_back(rows.sparkSession)
    posted = classes.select(F.explode("bands").alias("key"), "node")
    buckets = scratch.save(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1"), "buckets")
    members = scratch.save(join_hot(posted, buckets, ["key"], "n").select("key", "node", "pivot"), "members")
    ids = members.select("node").distinct()
    sigs = scratch.save(classes.join(ids, "node", "left_semi").select("node", "n_shingles", "sig", "rep"), "sigs")
    give_back(rows.sparkSession)
    reps = sigs.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("rep_mark"))
    n = sigs.count()
    sets = scratch.save(full_sets(marked, reps, n, width), "sets")
    if sets.count() > n:  # a row that is there twice
        sets = scratch.save(sets.dropDuplicates(["node"]), "sets_once")
        scratch.drop("sets")
    cut = scratch.save(briefs(sets), "briefs")

    give_back(rows.sparkSession)
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    links = [_links(pairs, sigs, cut, sets, least, per_hundred, scratch, 0)]
    found = scratch.save(components(links[0], scratch, "a"), "found0")
    for step in range(1, PIVOT_ROUNDS + 1):
        known = members.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spread = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
        known = scratch.save(join_hot(known, spread, ["key"], "n"), f"open{step}")
        if known.isEmpty():
            break
        give_back(rows.sparkSession)
        if step < PIVOT_ROUNDS:
            pivots = known.where("component = high").groupBy("key").agg(F.min("node").alias("pivot"))
            others = known.where("component <> high")
            pivots = pivots.join(others.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
            pairs = join_hot(others, pivots, ["key"], "n").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
            more = _links(pairs, sigs, cut, sets, least, per_hundred, scratch, step)
        else:
            cells = scratch.save(_partnered(_cells(known), sigs, least, per_hundred), "cells")
            cells = scratch.save(_unruled(cells, sigs, cut, least, per_hundred), "unruled")
            more = scratch.save(_forest(cells, sigs, sets, least, per_hundred), f"links{step}")
        links.append(more)
        if more.isEmpty():
            continue
        every = links[0]
        for more in links[1:]:
            every = every.union(more)
        found = scratch.save(components(every, scratch, f"b{step}_"), f"found{step}")

    give_back(rows.sparkSession)
    of_class = classes.select("hi", "lo", "n_shingles", "node", "least_id", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_ids = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = scratch.save(join_hot(of_class, least_ids, ["component"], "n").select("hi", "lo", "n_shingles", "component_id", "copies"), "of_class")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = signed.where("n_shingles > 0").select("doc_id", "hi", "lo", "n_shingles")
    linked = join_hot(linked, of_class, ["hi", "lo", "n_shingles"], "copies").select("doc_id", "n_shingles", "component_id")
    done = alone.union(linked).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    done = scratch.save(done, "done")
    scratch.drop("signed", "classes", "buckets", "members", "sigs", "sets", "briefs", "of_class")
    release(rows.sparkSession)
    return done


def _links(pairs: DataFrame, sigs: DataFrame, cut: DataFrame, sets: DataFrame, least: float, per_hundred: int, scratch: Scratch, step: int) -> DataFrame:
    """Confirmed pairs, written, that connect whatever the alike pairs would; what passed signatures and briefs is written too.

    A node first meets its least partner. Pairs whose nodes are then linked to the same one would connect nothing more;
    the rest is confirmed too. So most full sets are moved once, not once a pair.
    """
    pairs = scratch.save(pairs, f"pairs{step}")
    alike = scratch.save(_plausible(_alike(pairs, sigs, least), cut, per_hundred), f"alike{step}")
    first = alike.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    tight = scratch.save(confirm(first, sets, per_hundred), f"tight{step}")
    rest = alike.join(first, ["u", "v"], "left_anti")
    for end in ("u", "v"):
        rest = rest.join(tight.select(F.col("v").alias(end), F.col("u").alias(f"{end}_root")), end, "left")
    rest = rest.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    rest = scratch.save(rest, f"rest{step}")
    links = scratch.save(tight.union(confirm(rest, sets, per_hundred)), f"links{step}")
    scratch.drop(f"pairs{step}", f"alike{step}", f"tight{step}", f"rest{step}")
    return links
