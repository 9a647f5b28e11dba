"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces.

Both tokenizers part a text before white space that follows a character that is none, so a text's ids are those of
the pieces between such places in a row. The pieces of a batch are slices of its one text buffer; Arrow finds the distinct
ones, only these are looked up or encoded, and their ids are gathered for all pieces at once.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces and ids kept by one worker, then it starts anew. They bound memory and change no result.
CACHE_PIECES, CACHE_IDS = 1_000_000, 8_000_000
END_ID = 2
#: New pieces are encoded so many at a time, as one text, and parted by the lengths of their tokens.
TOGETHER = 64
#: Bytes of text that are cut at once.
BATCH_BYTES = 8_000_000
#: Lead bytes of the characters outside ASCII that may be white space.
JOINED = r"^[ \n][^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"
WIDE = np.zeros(256, bool)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

_open: dict[tuple, "Encoder"] = {}


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of runs of these lengths, one run after another (less than 2 ** 31 in all)."""
    ends = np.cumsum(n)
    out = np.repeat((first - ends + n).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Encoder:
    def __init__(self, path: str, spaces: bool):
        """``spaces``: white space has tokens of its own (byte-level); else it is dropped."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaces = spaces
        # Bytes of each token: the byte-level alphabet has one character for a byte; an end of word is none.
        self.sizes = np.zeros(65536, np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token.removesuffix("</w>") if not spaces else token)
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.first, self.count = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cuts(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces begin: at each text, and before white space that follows another character."""
        cut = (raw == 32) | (raw == 10)
        if self.spaces:
            cut[1:] &= raw[:-1] > 32
            # A character outside ASCII before it may be white space itself: no cut is always right.
            at = np.flatnonzero(cut[1:] & (raw[:-1] >= 0x80)) + 1
            cut[at[WIDE[raw[np.maximum(at - 2, 0)]] | WIDE[raw[np.maximum(at - 3, 0)]]]] = False
        cut[begins] = True
        return np.flatnonzero(cut)

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``raw``: the bytes of texts in a row, which begin at ``offsets`` (and end at its last). All ids in a row, and how
        many each text has."""
        texts = len(offsets) - 1
        begins = offsets[:-1][np.diff(offsets) > 0]
        if not len(begins):
            return np.zeros(0, np.uint16), np.zeros(texts, np.int64)
        at = self.cuts(raw, begins)
        edges = np.append(at, offsets[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(raw)).dictionary_encode()
        if len(self.known) > CACHE_PIECES or len(self.flat) > CACHE_IDS:
            self.clear()
        found, had = pc.index_in(pieces.dictionary, value_set=self.known), len(self.known)
        slot, which = found.fill_null(0).to_numpy().copy(), pieces.indices.to_numpy()
        if found.null_count:
            missing = found.is_null()
            new = pieces.dictionary.filter(missing)
            self.learn(new)
            slot[missing.to_numpy(zero_copy_only=False)] = had + pc.index_in(new, value_set=self.known[had:]).to_numpy()
        n = self.count[slot][which]
        ids = self.flat[spread(self.first[slot][which], n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(upto[np.searchsorted(at, offsets)])

    def sizes_of(self, pieces: pa.Array) -> np.ndarray:
        """How many bytes each piece's tokens stand for."""
        if self.spaces:
            return pc.binary_length(pieces).to_numpy().astype(np.int64)
        out = pc.binary_length(pc.ascii_trim_whitespace(pieces)).to_numpy().astype(np.int64)
        for i in np.flatnonzero(~pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False)):
            out[i] = len(unicodedata.normalize("NFC", pieces[int(i)].as_py().strip()).lower().encode())
        return out

    def learn(self, new: pa.Array) -> None:
        """Add pieces to the cache."""
        alone = pa.array([], pa.string())
        if self.spaces:  # a space or line feed and characters that are no white space may stand after another such piece
            apart = pc.match_substring_regex(new, JOINED)
            alone, new = new.filter(pc.invert(apart)), new.filter(apart)
        want = self.sizes_of(new)
        if not want.all():
            alone, new, want = pa.concat_arrays([alone, new.filter(pa.array(want == 0))]), new.filter(pa.array(want > 0)), want[want > 0]
        names, flat, counts = [], [], []
        edges = np.append(np.arange(0, len(new), TOGETHER), len(new)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), new), "" if self.spaces else " ").to_pylist() if len(new) else []
        for at in range(0, len(joined), 400):
            for i, e in zip(range(at, at + 400), self.tok.encode_batch_fast(joined[at : at + 400], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint16)
                ends, bounds = np.cumsum(self.sizes[ids]), np.cumsum(want[edges[i] : edges[i + 1]])
                last = np.searchsorted(ends, bounds)
                group = new[edges[i] : edges[i + 1]]
                if len(ids) and last[-1] == len(ids) - 1 and np.array_equal(ends[last], bounds):
                    names.append(group)
                    flat.append(ids)
                    counts.append(np.diff(last, prepend=-1))
                else:
                    alone = pa.concat_arrays([alone, group])
        for at in range(0, len(alone), 20_000):
            some = alone[at : at + 20_000]
            names.append(some)
            found = [np.array(e.ids, np.uint16) for e in self.tok.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
            flat += found
            counts.append(np.array([len(f) for f in found], np.int64))
        n = np.concatenate(counts)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
        self.count, self.flat = np.concatenate([self.count, n]), np.concatenate([self.flat, *flat])
        self.known = pa.concat_arrays([self.known, *names])

    def all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``batch`` over an array of strings without nulls, about BATCH_BYTES at a time (a longer text alone)."""
        if not len(texts):
            return
        wide = pa.types.is_large_string(texts.type)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH_BYTES, side="right")) - 1)
            yield self.batch(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j

    def ended(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``all``, with the end id after each text's ids."""
        for ids, n in self.all(texts):
            yield np.insert(ids, np.cumsum(n), END_ID), n + 1


def encoder(path: str, spaces: bool) -> Encoder:
    """The worker's encoder for this file, opened once."""
    if (path, spaces) not in _open:
        _open[path, spaces] = Encoder(path, spaces)
    return _open[path, spaces]
