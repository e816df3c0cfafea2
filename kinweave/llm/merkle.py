"""Document fingerprints: Merkle trees over sections and paragraphs.

A paragraph is a line; a section ends at a blank line, before a heading (``#``) or at a paragraph whose digest says so
(one in eight, so an edit moves no border far from it). A paragraph's digest covers its bytes, a section's its
paragraphs' digests, the root's its sections'. Below a paragraph stand its leaves, one per byte: the hash of the eight
bytes that end there (fewer where the paragraph begins). Equal roots mean equal texts; where roots differ, the branches
that differ tell where, and the leaves tell how much.

A fingerprint keeps the leaves whose hash is below a power of two, the largest that leaves ``LEAVES`` distinct ones at
most; two fingerprints are compared below the smaller of their bounds. So likeness means the same at every length (twice
the shared distinct leaves over the sum of both numbers), exact up to ``LEAVES`` leaves and estimated beyond.

A fingerprint is a string of hexadecimal digits: root, sections, paragraphs, and the bound's exponent with the leaves.

Defined results: null text counts as empty; the next document of the last is the first (of a single one, itself); null
ids come first; repeated ids are ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, partitions, place, ranges, slices, text_bytes
from .words import mix

SECTION = 8
LEAVES = 128
LEAF = 10  # hexadecimal digits of a leaf
NODE = 16  # of a paragraph or section: 8 of its digest, then 8 of how many children


def leaves(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the eight bytes (of one line) that end at each byte of all texts, and where each text begins."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    n = len(data)
    eight = np.ndarray(n, "<u8", buffer=np.concatenate([np.zeros(7, np.uint8), data, np.zeros(1, np.uint8)]), strides=(1,))
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    begins[1:] |= data == 10
    where = np.arange(n)
    room = np.minimum(where - np.maximum.accumulate(np.where(begins[:n], where, 0)), 7)  # bytes of the line before this one
    return mix(eight & _TOP[room]), at


_TOP = np.array([~((1 << 8 * (7 - k)) - 1) & (1 << 64) - 1 for k in range(8)], np.uint64)


def sampled(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The exponent of the bound, and the distinct hashes below it, sorted."""
    guess = 1 << 64
    if len(hashes) > 8 * LEAVES:  # most are above the bound
        guess = (1 << 64) * 6 * LEAVES // len(hashes)
        some = np.unique(hashes[hashes < np.uint64(guess)])
        if len(some) <= LEAVES:
            some = np.unique(hashes)
    else:
        some = np.unique(hashes)
    if len(some) <= LEAVES:
        return 64, some
    bits = int(some[LEAVES]).bit_length() - 1
    return bits, some[: int(np.searchsorted(some, np.uint64(1 << bits)))]


def _tree(text: bytes) -> tuple[bytes, list[tuple[bytes, int]], list[bytes]]:
    """Root, sections (digest, number of paragraphs), paragraphs (digest) of a text."""
    paragraphs, sections, own = [], [], []

    def close() -> None:
        if own:
            sections.append((hashlib.blake2b(b"s" + b"".join(own), digest_size=16).digest(), len(own)))
            own.clear()

    for line in text.split(b"\n"):
        digest = hashlib.blake2b(b"p" + line, digest_size=16).digest()
        if line.startswith(b"#"):
            close()
        paragraphs.append(digest)
        own.append(digest)
        if not line.strip() or digest[0] % SECTION == 0:
            close()
    close()
    root = hashlib.blake2b(b"r" + b"".join(s for s, _ in sections), digest_size=16).digest()
    return root, sections, paragraphs


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    raw = [t.encode() for t in texts]
    hashes, at = leaves(raw)
    out = []
    for k, bytes_ in enumerate(raw):
        root, sections, paragraphs = _tree(bytes_)
        bits, kept = sampled(hashes[at[k] : at[k + 1]])
        digits = (kept >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()
        parts = (root.hex(), "".join(f"{d[:4].hex()}{n:08x}" for d, n in sections), "".join(d[:4].hex() for d in paragraphs), f"{bits:02x}{digits}")
        out.append("|".join(parts))
    return out


def _pieces(digits: str, size: int) -> list[str]:
    return [digits[i : i + size] for i in range(0, len(digits), size)]


def likeness(a: str, b: str) -> float:
    """0 to 1: twice the shared leaves over the sum of both numbers, below the smaller bound; 1 for equal roots."""
    left, right = a.split("|"), b.split("|")
    if left[0] == right[0]:
        return 1.0
    bound = min(int(left[3][:2], 16), int(right[3][:2], 16))
    below = f"{(1 << bound) - 1 >> 24:010x}"  # digits compare as the numbers do
    x, y = ({leaf for leaf in _pieces(f[3][2:], LEAF) if leaf <= below} for f in (left, right))
    # texts that differ are never wholly alike, even if the sampled leaves agree
    return min(2 * len(x & y) / max(1, len(x) + len(y)), 1 - 1e-6)


def locate(a: str, b: str) -> list[tuple[int, int]]:
    """Where two texts differ: (first, one past last) paragraphs of ``a``, found by walking down differing branches."""
    left, right = a.split("|"), b.split("|")
    if left[0] == right[0]:
        return []
    sections = Counter(_pieces(right[1], NODE))
    kept = Counter(_pieces(right[2], 8))
    paragraphs = _pieces(left[2], 8)
    at, changed = 0, []
    for node in _pieces(left[1], NODE):
        size = int(node[8:], 16)
        if sections[node]:
            sections[node] -= 1
        else:
            for k in range(at, min(at + size, len(paragraphs))):
                if kept[paragraphs[k]]:
                    kept[paragraphs[k]] -= 1
                else:
                    changed.append(k)
        at += size
    spans_: list[tuple[int, int]] = []
    for k in changed:
        if spans_ and spans_[-1][1] == k:
            spans_[-1] = (spans_[-1][0], k + 1)
        else:
            spans_.append((k, k + 1))
    return spans_


def edit(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, which only follows."""
    edited = [edit(t, u) for t, u in zip(texts, texts[1:])]
    own, other = fingerprints(texts), fingerprints(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(own[:-1]),
            pa.array(other),
            pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to it and to the next document's.

    Documents are dealt once, by ranges of ids; the first document of a range also goes to the range before it, where
    the last document needs it.
    """
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("ord"))
    n = partitions(spark, text_bytes(rows, "text"))
    starts = ranges(rows.select("ord"), "ord", n)
    if not len(starts):
        return spark.createDataFrame([], OUT)
    n = len(starts)
    # the range of an id, twice, and one more if the id begins its range
    placed = rows.withColumn("spot", place(spark, "ord", starts))
    part = F.shiftright("spot", 1).cast("int")
    home = F.struct(part.alias("part"), F.lit(0).alias("guard"))
    ahead = F.struct(F.pmod(part - 1, F.lit(n)).alias("part"), F.lit(1).alias("guard"))
    spots = F.when(F.col("spot") % 2 == 1, F.array(home, ahead)).otherwise(F.array(home))
    dealt = placed.select("doc_id", "text", "ord", F.explode(spots).alias("spot")).select("spot.part", "spot.guard", "ord", "doc_id", "text")
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guard", "ord", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        ended = False
        for batch in slices(batches, "text", 1 << 20):
            guard = batch.column(1).to_numpy()
            keep = int((guard == 0).sum())
            if keep:
                ids += batch.column(3).slice(0, keep).to_pylist()
                texts += [t or "" for t in batch.column(4).slice(0, keep).to_pylist()]
            if keep < batch.num_rows and not ended:  # the least of the rows that begin the next range
                ended = True
                ids.append(None)
                texts.append(batch.column(4)[keep].as_py() or "")
            if len(texts) > 1:
                yield _neighbours(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    return dealt.mapInArrow(run, OUT)
