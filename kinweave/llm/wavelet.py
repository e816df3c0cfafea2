"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds the documents of one range of ids in ascending order. Its ids are split into bit-planes, highest bit
first, each plane stably partitioned by the bits before it; with ones counted per block of 512 bits, a plane answers
rank in constant time and select by binary search. A file is a JSON header and zstd frames (one per section), so access, counting and
occurrence lookup decompress only the sections they use.

Defined results: null text counts as empty (the end token alone); null ids come before all others; repeated ids keep
their rows, ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, narrow, partitions, slices, text_bytes
from .tokens import tokens

MAGIC = b"KWWM1\n"
BLOCK = 512
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def build(ids: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed bit-planes (little bit order) from the highest bit on, and the number of zeros in each."""
    planes, zeros = [], []
    for level in range(levels - 1, -1, -1):
        bit = (ids >> ids.dtype.type(level)) & ids.dtype.type(1) != 0
        planes.append(np.packbits(bit, bitorder="little"))
        ids = np.concatenate([ids[~bit], ids[bit]])
        zeros.append(len(ids) - int(np.count_nonzero(bit)))
    return planes, zeros


class WaveletFile:
    """Reads one shard. Sections are decompressed when first used."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self._file = fs.open_input_file(path)
        head = self._file.read_at(len(MAGIC) + 8, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a wavelet shard: {uri}")
        size = int.from_bytes(head[len(MAGIC) :], "little")
        meta = json.loads(self._file.read_at(size, len(head)))
        self._base = len(head) + size
        self.n, self.levels, self.zeros, self._where = meta["n"], meta["levels"], meta["zeros"], meta["sections"]
        self._have: dict[str, np.ndarray] = {}

    def close(self) -> None:
        self._file.close()

    def section(self, name: str) -> np.ndarray:
        if name not in self._have:
            at, size, kind = self._where[name]
            raw = zstandard.ZstdDecompressor().decompress(self._file.read_at(size, self._base + at))
            self._have[name] = np.frombuffer(raw, kind)
        return self._have[name]

    def _ones(self, level: int, at: int) -> int:
        """Ones in a plane before a position."""
        plane = self.section(f"plane{level}")
        block = at // BLOCK
        lo, hi = block * BLOCK // 8, at // 8
        tail = int(plane[hi]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(self.section(f"rank{level}")[block]) + int(np.bitwise_count(plane[lo:hi]).sum()) + tail.bit_count()

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.levels):
            bit = int(self.section(f"plane{level}")[at // 8]) >> at % 8 & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id in positions low .. high - 1."""
        if token >> self.levels:
            return 0
        a, b = self._range(token, max(0, low), self.n if high is None else min(high, self.n))
        return max(0, b - a)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        if token >> self.levels:
            raise IndexError(k)
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th one or zero of a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the lowest bit up."""
        ids = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            plane = self.section(f"plane{level}")
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            self._have.pop(f"plane{level}", None)
            out = np.empty_like(ids)
            out[~bit] = ids[: self.zeros[level]]
            out[bit] = ids[self.zeros[level] :] | ids.dtype.type(1 << (self.levels - 1 - level))
            ids = out
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order."""
        ids = self.decode().astype("<u4")
        known = self.section("known")
        for doc, ok, part in zip(self.section("docs").tolist(), known.tolist(), np.split(ids, self.section("ends")[:-1])):
            yield (doc if ok else None), part


def write_file(uri: str, docs: list[int | None], counts: np.ndarray, ids: np.ndarray, levels: int) -> None:
    """Writes one shard file: header, then zstd sections."""
    pack = zstandard.ZstdCompressor(level=1).compress
    dtype = np.uint16 if levels <= 16 else np.uint32
    planes, zeros = build(ids.astype(dtype), levels)
    sections: list[tuple[str, np.ndarray]] = [
        ("docs", np.array([d or 0 for d in docs], np.int64)),
        ("known", np.array([d is not None for d in docs], bool)),
        ("ends", np.cumsum(counts, dtype=np.int64)),
    ]
    for level, plane in enumerate(planes):
        padded = np.zeros(-(-(len(ids) + 1) // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        sections += [(f"plane{level}", padded), (f"rank{level}", np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32))]
    where, frames, at = {}, [], 0
    for name, values in sections:
        frame = pack(values.tobytes())
        where[name] = (at, len(frame), values.dtype.str)
        frames.append(frame)
        at += len(frame)
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "sections": where}).encode()
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(MAGIC + len(head).to_bytes(8, "little") + head)
        for frame in frames:
            out.write(frame)


def write_shards(
    docs: DataFrame, path: str, vocabulary: str, kind: str = "words", end_id: int = 2, levels: int = 16,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Writes shard files under ``path`` and gives their manifest (shard, path, n_docs, n_tokens), in id order.

    A file is named by the attempt that wrote it, and only finished attempts are in the manifest.
    """
    rows = narrow(docs, id_col, text_col)
    n = partitions(docs.sparkSession, text_bytes(rows, "text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab = tokens(vocabulary, kind)
        names, counts, parts = [], [], []
        end = np.array([end_id], np.uint16 if levels <= 16 else np.uint32)
        for batch in slices(batches, "text", 2 << 20):
            ids, each = vocab.encode([t or "" for t in batch.column(1).to_pylist()])
            names += batch.column(0).to_pylist()
            counts.append(each + 1)
            parts.append(np.insert(ids.astype(end.dtype), np.cumsum(each), end[0]))
        if names:
            shard, uri = TaskContext.get().partitionId(), f"{path}/{uuid.uuid4().hex}.kww"
            ids = np.concatenate(parts)
            parts.clear()
            write_file(uri, names, np.concatenate(counts), ids, levels)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uri], "n_docs": [len(names)], "n_tokens": [len(ids)]})

    return ordered.mapInArrow(write, MANIFEST)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Reads all shards back: doc_id, start (ids before it), n_tokens, ids_crc32."""
    before = F.sum("n_tokens").over(W.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, starts, sizes, sums = [], [], [], []
                file = WaveletFile(uri)
                for doc, ids in file.documents():
                    names.append(doc)
                    starts.append(start)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    start += len(ids)
                file.close()
                types = pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(x, types) for x in (names, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    return placed.repartition(max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes all texts, reads the files back, and gives what was read; the files go once that is stored."""
    scratch = Scratch(docs.sparkSession, "wavelet")
    manifest = scratch.save(write_shards(docs, scratch.at("files"), vocabulary, **options), "manifest")
    back = scratch.save(read_shards(manifest), "back")
    scratch.drop("files")
    return back
