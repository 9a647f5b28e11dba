"""Alignment of two tokenizers' tokens, and how often ids of the two are linked in the corpus.

Tokens are aligned by the bytes they stand for: where tokens of both end, a group ends, and the two tokens that end there are linked. No
token of either tokenizer crosses a space or line feed that follows another character, so a text is the row of the
pieces between such places, and each distinct piece is encoded and aligned once in a batch.

Linked ids are packed into one 64-bit key, the B id above the A id. Tasks count keys with ``np.unique``; their partial counts are
range-partitioned by key, sorted, and runs of a key are summed. Each range is a pair of files in the shared folder (keys, counts),
which workers map into memory and search by bisection.
"""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import pieces, slices
from .shared import discard, shared_path, shuffle_partitions, tokenizer_path, written
from .token_files import store
from .tokens import WIDE, spread

#: Pieces that a worker keeps (then it starts anew), bytes of text handled at once, and distinct keys held by a counting task.
CACHE_PIECES, BATCH_BYTES, HELD = 600_000, 4_000_000, 2_000_000
SPACE = "▁"
#: Byte-level entries spell a byte by a character: printable ones by themselves, the others by those from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_open: dict[tuple, "Aligner"] = {}


@dataclass
class Aligned:
    """Rows of aligned strings: tokens of both, groups, links as keys, and the groups' text with a closing semicolon. A string whose
    tokens don't spell it isn't ``ok`` and has none of these."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_keys: np.ndarray
    keys: np.ndarray
    text: pa.Array

    @classmethod
    def none(cls) -> "Aligned":
        return cls(np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(4)), pa.array([], pa.large_string()))

    def __add__(self, other: "Aligned") -> "Aligned":
        return Aligned(*(pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate([x, y]) for x, y in zip(vars(self).values(), vars(other).values())))


class Aligner:
    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        entries = self.a.get_vocab(with_added_tokens=True)
        spelt = {i: bytes(BYTE_OF[c] for c in t) if all(c in BYTE_OF for c in t) else t.encode() for t, i in entries.items()}
        self.a_bytes = pa.array([spelt.get(i, b"") for i in range(max(spelt) + 1)], pa.large_binary())
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)], pa.large_binary())
        self.a_size, self.b_size = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.a_bytes, self.b_bytes))
        self.alone = self.b.piece_to_id(SPACE)
        # Cuts need entries that hold a space at their beginning only, and no line feed.
        free = [p for i, p in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i))]
        self.at_spaces, self.at_lines = not any(SPACE in p.lstrip(SPACE) for p in free), not any("\n" in p for p in free)
        ids = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        #: Decimal ids with what follows them: a comma, a bar (the last A id of a group), a semicolon (the last B id).
        self.spelt = pa.array([i + c for c in ",|;" for i in ids], pa.large_string())
        self.ids = len(ids)
        self.clear()

    def clear(self) -> None:
        self.known, self.have, self.first = pa.array([], pa.large_string()), Aligned.none(), np.zeros(0, np.int64)

    def cuts(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces begin: at each text, and before a space or line feed that follows another character. After a character outside ASCII that
        may be white space itself there is no cut, which is always right."""
        cut = np.zeros(len(raw), bool)
        if self.at_spaces:
            cut |= raw == 32
            if self.at_lines:
                cut |= raw == 10
            cut[1:] &= raw[:-1] > 32
            at = np.flatnonzero(cut[1:] & (raw[:-1] >= 0x80)) + 1
            cut[at[WIDE[raw[np.maximum(at - 2, 0)]] | WIDE[raw[np.maximum(at - 3, 0)]]]] = False
        cut[begins] = True
        return np.flatnonzero(cut)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of strings that begin with a space or line feed, and how many each has: of A, then of B (which adds a space itself)."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            if t == " ":
                b[i] = [self.alone]
            elif t[0] == "\n":
                b[i] = b[i][1:]  # the space that was added
        flat = lambda x: np.fromiter(itertools.chain.from_iterable(x), np.int64, sum(map(len, x)))
        return flat(a), np.array([len(x) for x in a], np.int64), flat(b), np.array([len(x) for x in b], np.int64)

    def align(self, texts: pa.Array) -> Aligned:
        """Strings that begin with a space or line feed, none of them empty."""
        out = Aligned.none()
        for s in range(0, len(texts), 50_000):
            some = texts[s : s + 50_000]
            out += self._align(some, *self.encoded(some.to_pylist()))
        return out

    def _align(self, texts: pa.Array, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Aligned:
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        want = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        ok = self._spell(a, n_a, self.a_bytes, self.a_size, size, want) & self._spell(b, n_b, self.b_bytes, self.b_size, size, want)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = n_a * ok, n_b * ok
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        met = lambda x, y: y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
        last_a, last_b = met(end_a, end_b), met(end_b, end_a)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")] = a + self.ids * last_a
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b + 2 * self.ids * last_b
        spelt = self.spelt.take(pa.array(order))
        edges = np.frombuffer(spelt.buffers()[1], np.int64)[: len(spelt) + 1] if len(spelt) else np.zeros(1, np.int64)
        edges = edges[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        text = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(edges), spelt.buffers()[2] if len(spelt) else pa.py_buffer(b""))
        keys = b[last_b] << 32 | a[last_a]
        upto = np.concatenate([[0], np.cumsum(last_a)])
        n_keys = np.diff(upto[np.concatenate([[0], np.cumsum(n_a)])])
        return Aligned(ok, n_a, n_b, n_keys, keys, text)

    @staticmethod
    def _spell(ids: np.ndarray, n: np.ndarray, table: pa.Array, sizes: np.ndarray, size: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Whether each row's tokens join to the bytes of its string."""
        upto = np.concatenate([[0], np.cumsum(sizes[ids])])
        ends = upto[np.cumsum(n)]
        ok = np.diff(ends, prepend=0) == size
        got = table.take(pa.array(ids[np.repeat(ok, n)]))
        got = np.frombuffer(b"" if not len(got) else got.buffers()[2], np.uint8)
        wrong = got != want[np.repeat(ok, size)]
        if wrong.any():
            ok[np.repeat(np.flatnonzero(ok), size[ok])[wrong]] = False
        return ok

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts (a space before each) in a row: the row of ``have`` that each piece is, and the first piece of each text, with the end. A text with
        a piece that isn't spelt by its tokens is one piece."""
        begins = offsets[:-1]
        at = self.cuts(raw, begins)
        found = pieces(raw, np.append(at, len(raw))).dictionary_encode()
        if len(self.known) > CACHE_PIECES:
            self.clear()
        slot = self._slots(found.dictionary)[found.indices.to_numpy()]
        text_of = np.searchsorted(at, offsets)
        bad = np.unique(np.searchsorted(text_of, np.flatnonzero(~self.have.ok[slot]), side="right") - 1)
        if len(bad):
            whole = pa.array([raw[offsets[t] : offsets[t + 1]].tobytes() for t in bad], pa.large_binary()).cast(pa.large_string())
            new = self._slots(whole)
            keep = np.ones(len(slot), bool)
            for t, s in zip(bad, new):
                slot[text_of[t]] = s
                keep[text_of[t] + 1 : text_of[t + 1]] = False
            slot, text_of = slot[keep], np.concatenate([[0], np.cumsum(keep)])[text_of]
        return slot, text_of

    def _slots(self, distinct: pa.Array) -> np.ndarray:
        slot = pc.index_in(distinct, value_set=self.known)
        if slot.null_count:
            new = distinct.filter(slot.is_null())
            self.known = pa.concat_arrays([self.known, new])
            self.have += self.align(new)
            self.first = np.cumsum(self.have.n_keys) - self.have.n_keys
            slot = pc.index_in(distinct, value_set=self.known)
        return slot.to_numpy().astype(np.int64)


def aligner(a: str, b: str) -> Aligner:
    """The worker's aligner of these files, opened once."""
    if (a, b) not in _open:
        _open[a, b] = Aligner(a, b)
    return _open[a, b]


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i to j, which of them hold text, and these with a space before each: bytes and places."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    for i, j, raw, offsets in slices(column, BATCH_BYTES):
        full = np.diff(offsets) > 0
        to = np.cumsum(np.diff(offsets)[full] + 1)
        spaced = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
        letters = np.ones(len(spaced), bool)
        letters[np.concatenate([[0], to[:-1]])[: len(to)].astype(np.int64)] = False
        spaced[letters] = raw
        yield i, j, full, spaced, np.concatenate([[0], to]).astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, at, n)
    return distinct, out


def count_links(docs: DataFrame, a: str, b: str, *, text_col: str = "text") -> DataFrame:
    """``key``, ``n``: partial counts of links, of each task its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, keys, n = aligner(a, b), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hand = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
        for batch in batches:
            for _, _, _, raw, offsets in _texts(batch.column(0)):
                if not len(raw):
                    continue
                slot, times = np.unique(al.batch(raw, offsets)[0], return_counts=True)
                many = al.have.n_keys[slot]
                some = al.have.keys[spread(al.first[slot], many)]
                keys, n = _summed(np.concatenate([keys, some]), np.concatenate([n, np.repeat(times, many)]))
                if len(keys) > HELD:
                    yield hand()
                    keys, n = keys[:0], n[:0]
        if len(keys):
            yield hand()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, n long")


class CountFiles:
    """The counts of all linked pairs, in files of ascending ranges of keys, and each B id's highest count."""

    def __init__(self, folder: str, shards: list[tuple[int, int, int]], best: np.ndarray):
        """``shards``: part, n, first key; in ascending order of keys. ``best``: by B id, as long as its vocabulary at most."""
        self.folder, self.shards, self.best = folder, shards, best
        self.firsts = np.array([s[2] for s in shards], np.int64)
        self._maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def _map(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._maps:
            system, path = store(self.folder)
            found = []
            for kind in ("keys", "counts"):
                name = f"{path}/{kind}-{self.shards[k][0]:06d}.i64"
                if system.type_name == "local":
                    found.append(np.memmap(name, "<i8", "r"))
                else:  # a copy without a name: it goes with the worker
                    with tempfile.TemporaryFile() as f, system.open_input_stream(name) as source:
                        while block := source.read(8_000_000):
                            f.write(block)
                        f.flush()
                        found.append(np.memmap(f, "<i8", "r"))
            self._maps[k] = tuple(found)
        return self._maps[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of keys in any order; 0 for pairs that are never linked."""
        out = np.zeros(len(keys), np.int64)
        of = np.searchsorted(self.firsts, keys, side="right") - 1
        for k in np.unique(of[of >= 0]):
            mine = np.flatnonzero(of == k)
            held, n = self._map(int(k))
            at = np.minimum(np.searchsorted(held, keys[mine]), len(held) - 1)
            out[mine] = np.where(held[at] == keys[mine], n[at], 0)
        return out

    def pairs(self, spark: SparkSession) -> DataFrame:
        """All pairs: a_id, b_id, n."""
        shards = spark.createDataFrame([(k,) for k in range(len(self.shards))], "shard int").repartition(max(1, len(self.shards)))
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    held, n = me._map(k)
                    for s in range(0, len(held), 500_000):
                        some = np.array(held[s : s + 500_000])
                        yield pa.RecordBatch.from_arrays([pa.array(some & 0xFFFFFFFF), pa.array(some >> 32), pa.array(np.array(n[s : s + 500_000]))], names=["a_id", "b_id", "n"])

        return shards.mapInArrow(run, "a_id long, b_id long, n long")


def write_counts(partial: DataFrame, folder: str) -> CountFiles:
    """Sum partial counts into files. A file is written under another name and then renamed, so a task that runs twice leaves whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, first = TaskContext.get().partitionId(), 0, -1
        best: dict[int, int] = {}
        system, path = store(folder)
        temp = {kind: f"{path}/{kind}-{part:06d}.{uuid.uuid4().hex}" for kind in ("keys", "counts")}
        with system.open_output_stream(temp["keys"]) as keys_to, system.open_output_stream(temp["counts"]) as counts_to:

            def put(keys: np.ndarray, n: np.ndarray) -> None:
                nonlocal total, first
                if not len(keys):
                    return
                first = int(keys[0]) if first < 0 else first
                total += len(keys)
                keys_to.write(keys.astype("<i8").tobytes())
                counts_to.write(n.astype("<i8").tobytes())
                ids = keys >> 32
                at = np.flatnonzero(np.diff(ids, prepend=-1))
                for i, most in zip(ids[at].tolist(), np.maximum.reduceat(n, at).tolist()):
                    best[i] = max(best.get(i, 0), most)

            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in batches:  # ascending keys; the last run may go on in the next batch
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                n = np.concatenate([n, batch.column(1).to_numpy()])
                if len(keys):
                    at = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
                    keys, n = keys[at], np.add.reduceat(n, at)
                    put(keys[:-1], n[:-1])
                    keys, n = keys[-1:], n[-1:]
            put(keys, n)
        for kind, name in temp.items():
            if total:
                system.move(name, f"{path}/{kind}-{part:06d}.i64")
            else:
                system.delete_file(name)
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([total], pa.int64()), "first": pa.array([first], pa.int64()), "ids": pa.array([list(best)], pa.list_(pa.int64())), "best": pa.array([list(best.values())], pa.list_(pa.int64()))})

    rows = partial.repartitionByRange(shuffle_partitions(partial.sparkSession), "key").sortWithinPartitions("key")
    # A row for each range; an id is in more than one range only where ranges meet, so the vocabulary bounds them all.
    found = sorted(rows.mapInArrow(run, "part long, n long, first long, ids array<long>, best array<long>").collect(), key=lambda r: r["first"])
    best = np.zeros(1 + max((i for r in found for i in r["ids"]), default=-1), np.int64)
    for r in found:
        np.maximum.at(best, r["ids"], r["best"])
    return CountFiles(folder, [(r["part"], r["n"], r["first"]) for r in found], best)


def link_counts(docs: DataFrame, a: str, b: str, *, text_col: str = "text") -> CountFiles:
    """How often ids of the two tokenizers are linked in all texts. Repeated rows count as often as they come."""
    partial = written(count_links(docs, a, b, text_col=text_col), "link-counts")
    files = write_counts(partial, shared_path(docs.sparkSession, "links"))
    discard(partial)
    return files


def align(docs: DataFrame, a: str, b: str, files: CountFiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is their B id's highest), count_sum, and ``groups``, the
    ids of both by group (``a1,a2|b1;a3|b2``). ``a``: a byte-level file of the tokenizers library, applied to a space and the text; ``b``: a
    sentencepiece model that adds the space. Null and empty texts, and texts that one of the two doesn't spell byte by byte, have zeros
    and an empty string. Null ids and repeated rows stay; other columns are ignored. A text's groups must fit an Arrow string (2 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a, b)
        for batch in batches:
            for i, j, full, raw, offsets in _texts(batch.column(1)):
                out = np.zeros((6, j - i), np.int64)
                texts = pa.array([""] * (j - i), pa.string())
                if len(raw):
                    slot, first = al.batch(raw, offsets)
                    distinct, of = np.unique(slot, return_inverse=True)
                    many = al.have.n_keys[distinct]
                    keys = al.have.keys[spread(al.first[distinct], many)]
                    n = files.counts(keys)
                    upto = np.concatenate([[0], np.cumsum(many)])
                    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])[of]  # noqa: E731, B023
                    columns = [al.have.n_a[slot], al.have.n_b[slot], al.have.n_keys[slot], al.have.n_keys[slot], sums((n > 0) & (n == files.best[keys >> 32])), sums(n)]
                    for row, x in zip(out, columns):
                        row[full] = np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                    spelt = al.have.text.take(pa.array(slot))
                    ends = np.frombuffer(spelt.buffers()[1], np.int64)[first]
                    body = np.frombuffer(spelt.buffers()[2] or b"", np.uint8)
                    edges = np.stack([ends[:-1], np.maximum(ends[1:] - 1, ends[:-1])], axis=1).ravel()
                    inner = pieces(body, np.append(edges, ends[-1])).take(pa.array(np.arange(len(first) - 1) * 2))
                    place = np.where(full, np.cumsum(full) - 1, len(inner))
                    texts = pa.concat_arrays([inner, pa.array([""], pa.large_string())]).take(pa.array(place)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *map(pa.array, out), texts], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def op13_pair_keys(spark, sf_dir: str) -> DataFrame:
    """Alignments of all documents; see ``align`` for nulls, ties and odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    found = align(docs, a, b, link_counts(docs, a, b))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
