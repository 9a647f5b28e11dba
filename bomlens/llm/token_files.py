"""Token ids in wavelet matrix files.

One file holds the ids of consecutive documents as a wavelet matrix: a bit plane for each bit of an id, from
the highest, where each plane's order is that of the plane before, stably parted by its bits. Planes are stored
in compressed blocks; the header has each block's place and the number of ones before it, so a token, a
rank or a select reads one block for each plane and no others.

Layout: magic, header length (unsigned 32-bit), header (JSON), documents (compressed: null flags, ids and
lengths), blocks.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_path, shuffle_partitions, tokenizer_path
from .tokens import encoder

MAGIC = b"WVM1"
#: Bits of a plane in one compressed block, and ids of one file.
BLOCK_BITS, FILE_IDS = 1 << 18, 8_000_000


def build(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """The file for these documents' ids, which stand one after another in ``ids``."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    comp = zstandard.ZstdCompressor(level=1)
    row, planes, blocks, at = ids, [], [], 0
    for level in range(bits - 1, -1, -1):
        bit = (row >> level) & 1 == 1
        ones, table = 0, []
        for i in range(0, len(bit), BLOCK_BITS):
            part = bit[i : i + BLOCK_BITS]
            data = comp.compress(np.packbits(part).tobytes())
            table.append([at, len(data), ones])
            ones += int(part.sum())
            at += len(data)
            blocks.append(data)
        planes.append({"zeros": len(bit) - ones, "blocks": table})
        row = np.concatenate([row[~bit], row[bit]])
    null = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    docs = comp.compress(null.tobytes() + names.tobytes() + np.array(lengths, "<i8").tobytes())
    head = json.dumps({"n": len(ids), "bits": bits, "docs": len(doc_ids), "docs_bytes": len(docs), "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, docs, *blocks])


class WaveletFile:
    """Reads a file made by ``build``; blocks are opened when they are needed."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", data[4:8])
        self.head = json.loads(bytes(data[8 : 8 + size]))
        self.n, self.bits, self.planes = self.head["n"], self.head["bits"], self.head["planes"]
        self.data, self.base = data, 8 + size + self.head["docs_bytes"]
        raw, k = zstandard.ZstdDecompressor().decompress(bytes(data[8 + size : self.base])), self.head["docs"]
        null = np.frombuffer(raw, np.uint8, k)
        self.doc_ids = [None if x else int(d) for x, d in zip(null, np.frombuffer(raw, "<i8", k, k))]
        self.lengths = np.frombuffer(raw, "<i8", k, 9 * k)
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def block(self, plane: int, b: int) -> np.ndarray:
        if (plane, b) not in self._open:
            at, size, _ = self.planes[plane]["blocks"][b]
            raw = zstandard.ZstdDecompressor().decompress(bytes(self.data[self.base + at : self.base + at + size]))
            self._open[plane, b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=min(BLOCK_BITS, self.n - b * BLOCK_BITS))
        return self._open[plane, b]

    def ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place ``i``."""
        if i >= self.n:
            return self.n - self.planes[plane]["zeros"]
        b, r = divmod(i, BLOCK_BITS)
        return self.planes[plane]["blocks"][b][2] + (int(np.count_nonzero(self.block(plane, b)[:r])) if r else 0)

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            bit = int(self.block(p, i // BLOCK_BITS)[i % BLOCK_BITS])
            before = self.ones(p, i)
            i = self.planes[p]["zeros"] + before if bit else i - before
            out = out << 1 | bit
        return out

    def _span(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, min(i, self.n)
        for p in range(self.bits):
            a, b = self.ones(p, low), self.ones(p, high)
            zeros = self.planes[p]["zeros"]
            low, high = (zeros + a, zeros + b) if token >> (self.bits - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before place ``i``."""
        if token >> self.bits:
            return 0
        low, high = self._span(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._span(token, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            zeros, one = self.planes[p]["zeros"], token >> (self.bits - 1 - p) & 1
            at = self._select_bit(p, one, at - zeros if one else at)
        return at

    def _select_bit(self, plane: int, one: int, k: int) -> int:
        table = self.planes[plane]["blocks"]
        before = [t[2] if one else b * BLOCK_BITS - t[2] for b, t in enumerate(table)]
        b = int(np.searchsorted(before, k, side="right")) - 1
        return b * BLOCK_BITS + int(np.flatnonzero(self.block(plane, b) == one)[k - before[b]])

    def occurrences(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def all(self) -> np.ndarray:
        """Every token, in order."""
        out = np.zeros(self.n, np.uint32)
        for p in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self.block(p, b) for b in range(len(self.planes[p]["blocks"]))] or [np.zeros(0, np.uint8)]).view(bool)
            row, zeros = np.empty(self.n, np.uint32), self.planes[p]["zeros"]
            row[~bit] = out[:zeros]
            row[bit] = out[zeros:] | np.uint32(1 << (self.bits - 1 - p))
            out = row
            for b in range(len(self.planes[p]["blocks"])):
                self._open.pop((p, b), None)
        return out


def store(folder: str):
    """A file system and path for a folder's URI."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def write_files(docs: DataFrame, folder: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write all texts' ids in ascending order of the document id and return the manifest: for each file its
    path, ids and the ids before it. A file is written under another name and then renamed, so a task that runs
    twice leaves one whole file. Null ids come first; a null or empty text has the end id alone; ties and
    repeated rows are ordered by their texts; other columns are ignored; no rows, no files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary, spaces=True), TaskContext.get().partitionId()
        names, lens, ids, total, k = [], [], [], 0, 0
        system, path = store(folder)

        def close() -> pa.RecordBatch:
            name = f"{path}/part-{part:06d}-{k:06d}.wvm"
            body = build(np.concatenate(ids), names, lens)
            with system.open_output_stream(temp := f"{name}.{uuid.uuid4().hex}") as f:
                f.write(body)
            system.move(temp, name)
            return pa.RecordBatch.from_pydict({"path": [name], "part": pa.array([part], pa.int64()), "k": pa.array([k], pa.int64()), "n_ids": pa.array([total], pa.int64()), "n_bytes": pa.array([len(body)], pa.int64())})

        for b in batches:
            of = iter(b.column(0).to_pylist())
            for found, n in enc.ended(b.column(1)):
                upto = np.cumsum(n)
                i = 0
                while i < len(n):  # a file is closed with the document that fills it
                    before = int(upto[i - 1]) if i else 0
                    j = min(len(n), int(np.searchsorted(upto, before + FILE_IDS - total)) + 1)
                    names += itertools.islice(of, j - i)
                    lens += n[i:j].tolist()
                    ids.append(found[before : upto[j - 1]])
                    total += len(ids[-1])
                    i = j
                    if total >= FILE_IDS:
                        yield close()
                        names, lens, ids, total, k = [], [], [], 0, k + 1
        if names:
            yield close()

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "path string, part long, k long, n_ids long, n_bytes long").collect()  # a row for each file
    out, before = [], 0
    for r in sorted(found, key=lambda r: (r["part"], r["k"])):
        out.append({"path": r["path"], "first": before, "n_ids": r["n_ids"], "n_bytes": r["n_bytes"]})
        before += r["n_ids"]
    return out


def read_files(spark, folder: str, manifest: list[dict]) -> DataFrame:
    """One row per document from the files: doc_id, start, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(folder)
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_input_stream(path) as f:
                    file = WaveletFile(f.read())
                ids, ends = file.all().astype("<u4"), np.cumsum(file.lengths)
                for i in range(0, len(ends), 1024):
                    at = range(i, min(i + 1024, len(ends)))
                    begin = [int(ends[j] - file.lengths[j]) for j in at]
                    parts = [ids[s : int(ends[j])].tobytes() for s, j in zip(begin, at)]
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[i : i + 1024], pa.int64()), pa.array([first + s for s in begin], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])

    files = spark.createDataFrame([(m["path"], m["first"]) for m in manifest], "path string, first long")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, "doc_id long, start long, ids binary")


def op5_wavelet_files(spark, sf_dir: str) -> DataFrame:
    """All documents' ids as the files hold them; see ``write_files`` for nulls, ties and odd rows."""
    folder = shared_path(spark, "wavelet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_files(docs, folder, tokenizer_path("byte_bpe_50k.json"))
    ids = read_files(spark, folder, manifest)
    return ids.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
