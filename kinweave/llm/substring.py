"""Exact repeats of word sequences across documents, by fixed-block anchors.

Non-overlapping reference blocks of half a window index every document, and every rolling run of that many words probes
the index: whatever two documents share over a whole window, an aligned block of one lies inside it and is hit by the
other. Hits are extended to all windows that contain them; a window that a smaller id also has goes with all its words,
so what is removed is the union of the windows of maximal repeats. Windows are equal when two independent 64-bit hashes
(of words by two hash functions, and of their order) agree, 128 bits in all.

Probes and blocks travel as packed arrays, one per slice of rows and hash partition. Equal runs within a slice are
settled there: all are hits, two of them go on to meet other slices; of equal windows only those of the smallest id go
on. So a passage in a third of all documents costs two probes a slice, and no partition sees it more often. Beyond
``COARSE`` partitions packets are dealt in two steps, so their number grows with the corpus and not with its square.

A row is known by its id and the hash of its text. Defined results: null and empty texts have no words; a window repeats
when a smaller id has it, so rows with one id, and repeats inside one document, keep their words; a null id counts as
the largest; rows alike in id and text have the same result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, narrow, partitions, slices, small_batches, text_bytes, utf8
from .words import hash_spans, mix, second, spans, windows

#: Bytes of text whose probes meet in one hash partition.
PROBE_BYTES = 16 << 20
#: Partitions that packets are dealt to in one step.
COARSE = 2048
SLICE = 6 << 20
NO_ID = np.iinfo(np.int64).max
PACKET = "part int, docs binary, counts binary, hashes binary, steps binary"
REPLY = "bucket int, docs binary, counts binary, at binary"


def _docs(batch: pa.RecordBatch) -> np.ndarray:
    """Rows (id, mark) of a batch."""
    return np.stack([pc.fill_null(batch.column(0), int(NO_ID)).to_numpy(), batch.column(1).to_numpy()], axis=1)


def _inside(at: np.ndarray, width: int, total: int) -> np.ndarray:
    """Marks, for each word, whether a run of ``width`` words of its document starts there."""
    ok = np.zeros(max(0, total - width + 1), bool)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            ok[lo : hi - width + 1] = True
    return ok


def _varint(values: np.ndarray) -> bytes:
    """Small numbers in a byte; 255 says that four bytes follow in the tail."""
    small = np.minimum(values, 255).astype(np.uint8)
    tail = values[values >= 255].astype("<u4")
    return len(small).to_bytes(4, "little") + small.tobytes() + tail.tobytes()


def _unvarint(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    big = out == 255
    if big.any():
        out[big] = np.frombuffer(data, "<u4", -1, 4 + n)
    return out


def _packets(part: np.ndarray, docs: np.ndarray, row: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None) -> list[tuple]:
    """One packet per partition of probes (row of docs, position, hash), in order of rows and positions within each.

    Without hashes, packets are bare positions."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    part, row, pos = part[order], row[order], pos[order]
    hashes = None if hashes is None else hashes[order]
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    # a document's positions within a packet are steps of a byte or so
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    new[begin] = True
    step = np.diff(pos, prepend=0)
    step[new] = pos[new]
    out = []
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
        first = np.flatnonzero(new[lo:hi])
        counts = np.diff(np.append(first, hi - lo)).astype(np.uint32)
        own = b"" if hashes is None else hashes[lo:hi].tobytes()
        out.append((int(part[lo]), docs[row[lo:hi][first]].tobytes(), counts.tobytes(), own, _varint(step[lo:hi])))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    types = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "docs", "counts", "hashes", "steps"])


def _positions(docs: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The (id, mark) and the position of every probe of a packet."""
    each = np.frombuffer(counts, np.uint32).astype(np.int64)
    pos = np.cumsum(_unvarint(steps))
    first = np.cumsum(each) - each
    base = np.zeros(len(each), np.int64)
    base[1:] = pos[first[1:] - 1]
    return np.repeat(np.frombuffer(docs, np.int64).reshape(-1, 2), each, axis=0), pos - np.repeat(base, each)


def _opened(group: pd.DataFrame, dtype: type, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, mark), position and hash of all probes of some packets; packets without hashes are left out."""
    group = group[group["hashes"].str.len() > 0]
    if not len(group):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros((0, width), dtype)
    spots = [_positions(*x) for x in zip(group["docs"], group["counts"], group["steps"])]
    hashes = np.concatenate([np.frombuffer(h, dtype) for h in group["hashes"]]).reshape(-1, width)
    return np.concatenate([s[0] for s in spots]), np.concatenate([s[1] for s in spots]), hashes


def _bare(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(id, mark) and position of the packets that were settled in their slice."""
    group = group[group["hashes"].str.len() == 0]
    spots = [_positions(*x) for x in zip(group["docs"], group["counts"], group["steps"])]
    return np.concatenate([np.zeros((0, 2), np.int64), *[s[0] for s in spots]]), np.concatenate([np.zeros(0, np.int64), *[s[1] for s in spots]])


def _part(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _bucket(docs: np.ndarray, n: int) -> np.ndarray:
    return (mix(docs[:, 0].astype(np.uint64) ^ mix(docs[:, 1].astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def _dealt(packets: DataFrame, n: int, width: int = 1) -> DataFrame:
    """Packets of 64-bit hashes (``width`` to a probe) in their partitions: at once, or by way of ``COARSE`` of them."""
    if n <= COARSE:
        return packets.repartitionById(n, F.col("part"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.to_pandas()
            docs, pos, hashes = _opened(group, np.uint64, width)
            out = [tuple(r) for r in group[group["hashes"].str.len() == 0].itertuples(index=False)]
            if len(pos):
                row = np.cumsum(np.append(0, (docs[1:] != docs[:-1]).any(axis=1) | (np.diff(pos) <= 0)))
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out += _packets(_part(hashes[:, 0], n), docs[first], row, pos, hashes)
            yield _batch(out)

    return packets.repartitionById(COARSE, F.col("part") % COARSE).mapInArrow(again, PACKET).repartitionById(n, F.col("part"))


def _probe(docs: DataFrame, block: int, n: int) -> DataFrame:
    """Packets of probes: every rolling run of every document. Of (doc_id, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = utf8(batch.column(2))
            starts, ends, at = spans(data, offsets)
            words = hash_spans(data, starts, ends)
            ok = np.flatnonzero(_inside(at, block, len(words)))
            if not len(ok):
                continue
            runs = windows(words, block)[ok]
            row = np.searchsorted(at, ok, "right") - 1
            pos = ok - at[row]
            own = _docs(batch)
            code, distinct = pd.factorize(runs.view(np.int64))
            often = np.flatnonzero((np.bincount(code) > 1)[code])
            ids = own[row[often], 0]
            low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), -NO_ID)
            np.minimum.at(low, code[often], ids)
            np.maximum.at(high, code[often], ids)
            met = often[(low < high)[code[often]]]  # runs that two ids of the slice have: hits as they are
            send = np.ones(len(runs), bool)
            send[met] = False
            met = met[np.lexsort((pos[met] % block != 0, code[met]))]  # an aligned one first
            for _ in range(2):  # one, and one of another id, stand for them
                first = met[np.flatnonzero(np.diff(code[met], prepend=-1))]
                send[first] = True
                stands = np.zeros(len(distinct), np.int64)
                stands[code[first]] = own[row[first], 0]
                met = met[own[row[met], 0] != stands[code[met]]]
            local = often[(low < high)[code[often]]]
            out = _packets(_bucket(own, n)[row[local]] % COARSE, own, row[local], pos[local], None)
            send = np.flatnonzero(send)
            part = _part(runs[send], n)
            keys = runs[send].astype(np.uint32) if n <= COARSE else runs[send]
            yield _batch(out + _packets(part if n <= COARSE else part % COARSE, own, row[send], pos[send], keys))

    return docs.select("doc_id", "mark", "text").mapInArrow(run, PACKET)


def _replies(docs: np.ndarray, pos: np.ndarray, n: int) -> pd.DataFrame:
    """Positions packed by bucket of documents, one row a bucket, so replies don't multiply with the partitions."""
    bucket = _bucket(docs, n)
    order = np.lexsort((pos, docs[:, 1], docs[:, 0], bucket))
    bucket, docs, pos = bucket[order], docs[order], pos[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows: list[tuple] = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(docs)]):
        own = docs[lo:hi]
        begin = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(axis=1)))
        counts = np.diff(np.append(begin, hi - lo)).astype(np.uint32)
        rows.append((int(bucket[lo]), own[begin].tobytes(), counts.tobytes(), pos[lo:hi].astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "docs", "counts", "at"])


def _hits(packets: DataFrame, block: int, n: int) -> DataFrame:
    """Replies (document, position): probes whose hash is that of an aligned block and occurs in two documents at least."""
    dtype = np.uint32 if n <= COARSE else np.uint64

    def run(group: pd.DataFrame) -> pd.DataFrame:
        docs, pos, hashes = _opened(group, dtype)
        hashes = hashes[:, 0]
        indexed = np.unique(hashes[pos % block == 0])  # the reference blocks
        if len(indexed):
            code = np.searchsorted(indexed, hashes)
            code[code == len(indexed)] = 0
            hit = np.flatnonzero(indexed[code] == hashes)
            code, docs, pos = code[hit], docs[hit], pos[hit]
            low, high = np.full(len(indexed), NO_ID), np.full(len(indexed), -NO_ID)
            np.minimum.at(low, code, docs[:, 0])
            np.maximum.at(high, code, docs[:, 0])
            shared = np.flatnonzero((low < high)[code])
            docs, pos = docs[shared], pos[shared]
        else:
            docs, pos = docs[:0], pos[:0]
        known, where = _bare(group)
        return _replies(np.concatenate([docs, known]), np.concatenate([pos, where]), n)

    return packets.groupBy("part").applyInPandas(run, REPLY)


def _twofold(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each pair of hashes, and how many there are."""
    first, second_ = pd.factorize(a.view(np.int64))[0], pd.factorize(b.view(np.int64))
    code, distinct = pd.factorize(first.astype(np.int64) * (len(second_[1]) + 1) + second_[0])
    return code, len(distinct)


def _spread(docs: DataFrame, block: int, window: int, n: int) -> DataFrame:
    """Packets of whole windows that contain a hit; of (doc_id, mark, text, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = utf8(batch.column(2))
            starts, ends, at = spans(data, offsets)
            total = len(starts)
            mark = np.zeros(total + 1, np.int32)
            for row, hits in enumerate(batch.column(3).to_pylist()):
                size = int(at[row + 1] - at[row])
                if size >= window:
                    pos = np.frombuffer(hits, "<u4").astype(np.int64)
                    np.add.at(mark, at[row] + np.maximum(0, pos - (window - block)), 1)
                    np.add.at(mark, at[row] + np.minimum(pos, size - window) + 1, -1)
            room = _inside(at, window, total)
            ok = np.flatnonzero((np.cumsum(mark)[: len(room)] > 0) & room)
            if not len(ok):
                continue
            keys = np.stack([windows(f(data, starts, ends), window)[ok] for f in (hash_spans, second)], axis=1)
            row = np.searchsorted(at, ok, "right") - 1
            pos = ok - at[row]
            own = _docs(batch)
            ids = own[row, 0]
            code, distinct = _twofold(keys[:, 0], keys[:, 1])
            low = np.full(distinct, NO_ID)
            np.minimum.at(low, code, ids)
            late = np.flatnonzero(ids > low[code])  # a smaller id of the slice has the window
            out = _packets(_bucket(own, n)[row[late]] % COARSE, own, row[late], pos[late], None)
            send = np.flatnonzero(ids == low[code])
            part = _part(keys[send, 0], n)
            yield _batch(out + _packets(part if n <= COARSE else part % COARSE, own, row[send], pos[send], keys[send]))

    return docs.select("doc_id", "mark", "text", "hits").mapInArrow(run, PACKET)


def _repeated(packets: DataFrame, n: int) -> DataFrame:
    """Replies (document, position): starts of windows that a smaller id also has."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        docs, pos, hashes = _opened(group, np.uint64, 2)
        if len(pos):
            code, distinct = _twofold(hashes[:, 0].copy(), hashes[:, 1].copy())
            low = np.full(distinct, NO_ID)
            np.minimum.at(low, code, docs[:, 0])
            late = np.flatnonzero(low[code] < docs[:, 0])
            docs, pos = docs[late], pos[late]
        known, where = _bare(group)
        return _replies(np.concatenate([docs, known]), np.concatenate([pos, where]), n)

    return packets.groupBy("part").applyInPandas(run, REPLY)


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Removes covered words; of (doc_id, text, hits), where hits may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            data, offsets = utf8(batch.column(1))
            starts, ends, at = spans(data, offsets)
            gone = np.zeros(len(starts) + 1, np.int32)
            for row, hits in enumerate(batch.column(2).to_pylist()):
                if hits:
                    pos = np.frombuffer(hits, "<u4").astype(np.int64)
                    size = int(at[row + 1] - at[row])
                    pos = at[row] + pos[pos <= size - window]
                    np.add.at(gone, pos, 1)
                    np.add.at(gone, pos + window, -1)
            keep = np.cumsum(gone)[: len(starts)] <= 0
            rows: list[list] = [[], [], [], []]
            raw = data.tobytes()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                lo, hi = int(at[k]), int(at[k + 1])
                own = keep[lo:hi]
                if own.all():  # the text's words as they are
                    left = b" ".join(raw[int(offsets[k]) : int(offsets[k + 1])].translate(_TO_SPACE).split())
                else:
                    kept = np.flatnonzero(own) + lo
                    left = b" ".join(raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist()))
                for col, v in zip(rows, (doc, hi - lo, hi - lo - int(own.sum()), hashlib.sha256(left).hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.select("doc_id", "text", "hits").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_TO_SPACE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def _gathered(replies: DataFrame, n: int) -> DataFrame:
    """(hit_id, hit_mark, hits): all positions of a document in one binary, ascending."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        docs = np.concatenate([np.repeat(np.frombuffer(i, np.int64).reshape(-1, 2), np.frombuffer(c, np.uint32), axis=0) for i, c in zip(group["docs"], group["counts"])])
        pos = np.concatenate([np.frombuffer(x, "<u4") for x in group["at"]])
        order = np.lexsort((pos, docs[:, 1], docs[:, 0]))
        docs, pos = docs[order], pos[order]
        first = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]).any(axis=1)))
        hits = [np.unique(x).tobytes() for x in np.split(pos, first[1:])]
        return pd.DataFrame({"hit_id": docs[first, 0], "hit_mark": docs[first, 1], "hits": hits})

    return replies.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInPandas(run, "hit_id long, hit_mark long, hits binary")


def _own(hits: DataFrame) -> Column:
    """The rows that some positions belong to."""
    return (F.coalesce(F.col("doc_id"), F.lit(int(NO_ID))) == hits["hit_id"]) & (F.col("mark") == hits["hit_mark"])


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    block = window // 2
    rows = narrow(docs, id_col, text_col)
    n = partitions(spark, text_bytes(rows, "text"), PROBE_BYTES)
    rows = rows.withColumn("mark", F.xxhash64("text"))
    with small_batches(spark):
        hits = scratch.save(_gathered(_hits(_dealt(_probe(rows, block, n), n), block, n), n), "hits")
        marked = scratch.save(rows.join(hits, _own(hits)).select("doc_id", "mark", "text", "hits"), "marked")
        late = scratch.save(_gathered(_repeated(_dealt(_spread(marked, block, window, n), n, 2), n), n), "late")
        scratch.drop("hits", "marked")
    return _cut(rows.join(late, _own(late), "left"), window)
