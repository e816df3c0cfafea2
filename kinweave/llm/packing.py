"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents are taken by classes of length, longest first; a class holds the lengths above half of its bound (the last one all that are left). In a round
the class's documents and the gaps that may hold one are sorted together by ranges of size. A sweep down the sizes gives
each document its successor, the smallest gap at hand that holds it: each range is swept by itself, and what a range
leaves open (documents first, then gaps) is settled by rank between ranges, so that every document gets the very gap
that one sweep over all would give it. A gap that holds several of the class's documents takes as many in one round.
Then gaps shrink, and the next round takes the documents that found none, with new sequences opened by their
tokens; once none is left, the next class follows. The driver sees three numbers per range and the histogram of lengths (one
number per length up to the capacity).

Defined results: null text counts as empty (one piece, the end token); null and repeated ids are packed row by row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, narrow, release, slices, small_batches
from .tokens import tokens

#: Documents and gaps that one task sweeps.
SWEEP_ROWS = 200_000
#: Lengths up to this part of the capacity are one class.
SMALL = 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MATCH, DOCUMENT, GAP, SUMMARY = 0, 1, 2, 3
SWEPT = "part int, kind int, row long, sequence long, length long, rank long, slots long"


def pieces(docs: DataFrame, vocabulary: str, kind: str = "bytes", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Tokenises whole texts and cuts those above the capacity; of (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = tokens(vocabulary, kind)
        for batch in slices(batches, "text", 2 << 20):
            ids, counts = vocab.encode([t or "" for t in batch.column(1).to_pylist()])
            at = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=at[1:])
            rows: list[list] = [[], [], [], [], []]
            for doc, lo, hi in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                head = len(own) % capacity or capacity
                edges = [0, *range(head, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    for col, v in zip(rows, (doc, k, a, b - a, zlib.crc32(own[a:b].tobytes()))):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def sweep(size: list[int], kind: list[int], name: list[int], slots: list[int]) -> tuple[list, list, list]:
    """One pass down the sizes (gaps before documents of their size): matches (document, gap, length), documents that
    found no gap, and gaps with the slots they have left, as (name, size) and (name, slots)."""
    stack: list[list[int]] = []
    matches, alone = [], []
    for s, k, n, m in zip(size, kind, name, slots):
        if k == GAP:
            stack.append([n, m])
        elif stack:
            top = stack[-1]
            matches.append((n, top[0], s))
            top[1] -= 1
            if not top[1]:
                stack.pop()
        else:
            alone.append((n, s))
    return matches, alone, [(n, m) for n, m in stack]


def _swept(events: DataFrame, ranges: int) -> DataFrame:
    """Every range of sizes swept by itself; of (size, kind, name, slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], []]
        for batch in batches:
            for c, col in zip(cols, batch.columns):
                c += col.to_pylist()
        matches, alone, open_ = sweep(*cols)
        part = TaskContext.get().partitionId()
        rows = [(part, MATCH, d, g, s, None, None) for d, g, s in matches]
        rows += [(part, DOCUMENT, d, None, s, r, None) for r, (d, s) in enumerate(alone)]
        first = 0
        for g, m in open_:
            rows.append((part, GAP, None, g, None, first, m))
            first += m
        rows.append((part, SUMMARY, None, None, sum(s for _, s in alone), len(alone), first))
        types = (pa.int32(), pa.int32(), *[pa.int64()] * 5)
        names = [c.split()[0] for c in SWEPT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    order = [F.col("size").desc(), F.col("kind").desc(), F.col("name")]
    return events.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, SWEPT)


def settle(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranks matched between ranges, from the largest sizes down: (part, first rank, one past last, gaps' part, slot of
    the first; slots go down as ranks go up). left: documents and slots that each range left open."""
    stack: list[list[int]] = []
    runs = []
    for part in sorted(left):
        documents, slots = left[part]
        rank = 0
        while rank < documents and stack:
            other, top = stack[-1]
            n = min(documents - rank, top)
            runs.append((part, rank, rank + n, other, top - 1))
            rank += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if slots:
            stack.append([part, slots])
    return runs


class _Packer:
    """The state between rounds: one row per sequence that has room, and a table of places per round."""

    def __init__(self, scratch: Scratch, capacity: int):
        self.scratch, self.spark, self.capacity = scratch, scratch.spark, capacity
        self.gaps = self.spark.createDataFrame([], "sequence long, free long")
        self.opened = self.step = 0
        self.places: list[DataFrame] = []

    def round(self, todo: DataFrame, count: int, least: int, bound: int, more: int) -> tuple[DataFrame, int, float]:
        """Places what it can of ``todo`` (row, length from ``least`` to ``bound``) after opening ``more`` sequences.

        Gives the rest, its number and about how many tokens it has."""
        scratch, k = self.scratch, self.step
        self.step += 1
        gaps = self.gaps
        if more:
            gaps = gaps.union(self.spark.range(self.opened, self.opened + more).select(F.col("id").alias("sequence"), F.lit(self.capacity).cast("long").alias("free")))
            self.opened += more
        slots = F.greatest(F.lit(1), F.floor(F.col("free") / bound)).cast("long")
        events = gaps.where(F.col("free") >= least).select(F.col("free").alias("size"), F.lit(GAP).alias("kind"), F.col("sequence").alias("name"), slots.alias("slots"))
        events = events.union(todo.select("length", F.lit(DOCUMENT), "row", F.lit(0).cast("long")))
        ranges = max(self.spark.sparkContext.defaultParallelism, -(-(count + self.opened) // SWEEP_ROWS))
        swept = scratch.save(_swept(events, ranges), f"swept{k}")
        # three numbers for each range come to the driver
        left = {r["part"]: (r["rank"], r["slots"], r["length"]) for r in swept.where(F.col("kind") == SUMMARY).collect()}
        runs = settle({p: (documents, slots) for p, (documents, slots, _) in left.items()})
        upto = {p: max((r[2] for r in runs if r[0] == p), default=0) for p in left}
        matches = swept.where(F.col("kind") == MATCH).select("row", "sequence", "length")
        rest = swept.where(F.col("kind") == DOCUMENT)
        if runs:
            table = F.broadcast(self.spark.createDataFrame(runs, "part int, low long, high long, other int, top long"))  # two rows a range at most
            asked = rest.join(table, "part").where("rank >= low and rank < high")
            asked = asked.select("row", "length", F.col("other").alias("part"), (F.col("top") - (F.col("rank") - F.col("low"))).alias("slot"))
            offered = swept.where(F.col("kind") == GAP).select("part", "sequence", F.explode(F.sequence("rank", F.col("rank") + F.col("slots") - 1)).alias("slot"))
            matches = matches.union(asked.join(offered, ["part", "slot"]).select("row", "sequence", "length"))
            rest = rest.join(F.broadcast(self.spark.createDataFrame(list(upto.items()), "part int, upto long")), "part").where("rank >= upto")
        # a sequence takes its documents in the order of their rows
        taken = matches.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("own"))
        state = gaps.join(taken, "sequence", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<row:bigint,length:bigint>>")))
        used = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["length"])
        files = max(self.spark.sparkContext.defaultParallelism, -(-self.opened // SWEEP_ROWS))
        state = scratch.save(state.select("sequence", (F.col("free") - used).alias("free"), F.col("free").alias("before"), "own").coalesce(files), f"state{k}")
        if k % 4 == 3:
            release(self.spark)
        self.gaps = state.where("free > 0").select("sequence", "free")
        self.places.append(state.where(F.size("own") > 0).select("sequence", "before", "own"))
        if k:
            scratch.drop(f"swept{k - 1}")
        count = sum(d - upto[p] for p, (d, _, _) in left.items())
        return rest.select("row", "length"), count, sum(n * (d - upto[p]) / d for p, (d, _, n) in left.items() if d)

    def placed(self) -> DataFrame:
        """(row, sequence_id, offset) of all rounds."""
        every = self.places[0]
        for more in self.places[1:]:
            every = every.union(more)
        capacity = F.lit(self.capacity).cast("long")
        ahead = F.transform("own", lambda x, i: F.struct(x["row"].alias("row"), F.aggregate(F.slice("own", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["length"]).alias("ahead")))
        every = every.select("sequence", (capacity - F.col("before")).alias("start"), F.explode(ahead).alias("at"))
        return every.select("at.row", F.col("sequence").alias("sequence_id"), (F.col("start") + F.col("at.ahead")).alias("offset"))


def pack(
    docs: DataFrame,
    vocabulary: str,
    kind: str = "bytes",
    end_id: int = 0,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    with small_batches(spark):
        cut = pieces(narrow(docs, id_col, text_col), vocabulary, kind, end_id, capacity)
        cut = scratch.save(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    give_back(spark)
    # one number for each length up to the capacity
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    packer = _Packer(scratch, capacity)
    bound = capacity
    while bound:
        least = bound // 2 + 1 if bound * SMALL > capacity else 1
        own = {n: c for n, c in counts.items() if least <= n <= bound}
        left, tokens_left = sum(own.values()), sum(n * c for n, c in own.items())
        todo = cut.where(F.col("length").between(least, bound)).select("row", "length")
        more = 0 if packer.opened else _openings(left, tokens_left, bound, capacity)
        while left:
            todo, left, tokens_left = packer.round(todo, left, least, bound, more)
            more = _openings(left, int(tokens_left), bound, capacity)
        bound = least - 1
    if not packer.step:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = scratch.save(packer.placed(), "places")
    scratch.drop(*(f"state{k}" for k in range(packer.step)), f"swept{packer.step - 1}")
    return cut.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _openings(count: int, tokens_left: int, bound: int, capacity: int) -> int:
    """Sequences to open for documents that found no gap: one each above half the capacity, as many as their tokens fill
    down to a quarter, and half as many below, where the gaps that they leave are soon too small for what still comes."""
    if bound * 2 > capacity:
        return count
    return max(1, tokens_left // (capacity if bound * 4 > capacity else 2 * capacity)) if count else 0
