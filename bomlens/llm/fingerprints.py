"""Chroma fingerprints of recordings in media columns, and their alignment.

A recording's samples become frames of twelve pitch classes. Filters over the frames, six shapes of rectangles summed in an integral
image, give two bits each; sixteen filters make a 32-bit integer for each position. Two recordings align where the histogram of
offsets between equal integers peaks, and the share of differing bits at that offset tells whether they are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import shuffle_partitions, written


@dataclass(frozen=True)
class Params:
    """Samples a second, samples of a frame and from one frame to the next, and the pitches that count."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    low_hz: float = 28.0
    high_hz: float = 3520.0


#: The sixteen classifiers of the published Chromaprint fingerprint (its second algorithm, the default one): shape of the filter, lowest
#: class, classes, frames, limits of its four values (fixed values).
FILTERS = [
    (0, 4, 3, 15, (1.98215, 2.35817, 2.63523)),
    (4, 4, 6, 15, (-1.03809, -0.651211, -0.282167)),
    (1, 0, 4, 16, (-0.298702, 0.119262, 0.558497)),
    (3, 8, 2, 12, (-0.105439, 0.0153946, 0.135898)),
    (3, 4, 4, 8, (-0.142891, 0.0258736, 0.200632)),
    (4, 0, 3, 5, (-0.826319, -0.590612, -0.368214)),
    (1, 2, 2, 9, (-0.557409, -0.233035, 0.0534525)),
    (2, 7, 3, 4, (-0.0646826, 0.00620476, 0.0784847)),
    (2, 6, 2, 16, (-0.192387, -0.029699, 0.215855)),
    (2, 1, 3, 2, (-0.0397818, -0.00568076, 0.0292026)),
    (5, 10, 1, 15, (-0.53823, -0.369934, -0.190235)),
    (3, 6, 2, 10, (-0.124877, 0.0296483, 0.139239)),
    (2, 1, 1, 14, (-0.101475, 0.0225617, 0.231971)),
    (3, 5, 6, 4, (-0.0799915, -0.00729616, 0.063262)),
    (1, 9, 2, 12, (-0.272556, 0.019424, 0.302559)),
    (3, 4, 2, 14, (-0.164292, -0.0321188, 0.0846339)),
]
WIDTH = max(f[3] for f in FILTERS)
#: At most so many classes of copies are split over tasks.
LARGE = 100_000
#: Neighbouring values differ in one bit.
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Recordings are the same if at the best offset at most this share of bits differs over this share of the shorter one.
BIT_ERROR, OVERLAP, LEAST = 0.15, 0.5, 8


def chroma(samples: np.ndarray, p: Params) -> np.ndarray:
    """Twelve pitch-class energies of each frame, each frame of length one."""
    n = (len(samples) - p.frame) // p.hop + 1
    if n <= 0:
        return np.zeros((0, 12))
    freq = np.fft.rfftfreq(p.frame, 1 / p.rate)
    use = np.flatnonzero((freq >= max(p.low_hz, p.rate / p.frame)) & (freq <= p.high_hz))
    pitch = np.round(12 * np.log2(freq[use] / 440.0)).astype(np.int64) % 12
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), pitch] = 1
    window = np.hanning(p.frame)
    frames = np.lib.stride_tricks.sliding_window_view(samples, p.frame)[:: p.hop]
    out = np.empty((n, 12))
    for i in range(0, n, 256):
        out[i : i + 256] = np.abs(np.fft.rfft(frames[i : i + 256] * window, axis=1)[:, use]) ** 2 @ fold
    # A short smoothing over frames, then unit length; silence stays zero.
    if n >= 5:
        kernel = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
        out = np.stack([np.convolve(out[:, c], kernel, mode="same") for c in range(12)], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def fingerprint(samples: np.ndarray, p: Params = Params()) -> np.ndarray:
    """A 32-bit integer for each position; recordings that are too short have none."""
    c = chroma(samples, p)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(c, axis=0), axis=1)
    x = np.arange(n)

    def area(x1, y1, x2, y2):
        return image[x2, y2] - image[x1, y2] - image[x2, y1] + image[x1, y1]

    out = np.zeros(n, np.uint32)
    for shape, y, h, w, limits in FILTERS:
        x2, y2, xm, ym = x + w, y + h, x + w // 2, y + h // 2
        all_ = area(x, y, x2, y2)
        if shape == 0:
            plus, minus = all_, 0.0
        elif shape == 1:
            plus = area(x, ym, x2, y2)
            minus = all_ - plus
        elif shape == 2:
            plus = area(xm, y, x2, y2)
            minus = all_ - plus
        elif shape == 3:
            plus = area(x, ym, xm, y2) + area(xm, y, x2, ym)
            minus = all_ - plus
        elif shape == 4:
            third = h // 3
            plus = area(x, y + third, x2, y2 - third)
            minus = all_ - plus
        else:
            third = w // 3
            plus = area(x + third, y, x2 - third, y2)
            minus = all_ - plus
        value = np.log((1.0 + plus) / (1.0 + minus)) if shape else np.log1p(plus) + 0 * x
        out = out << np.uint32(2) | GRAY[np.searchsorted(limits, value)]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float, int]:
    """Offset of ``b`` against ``a`` at the peak of the histogram of offsets, the share of differing bits there, and
    the positions compared. Without equal integers: offset 0, error 1.0 over 0 positions."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, side="right")
    n = high - low
    if not n.sum():
        return 0, 1.0, 0
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    offsets, counts = np.unique(i - j, return_counts=True)
    # Neighbouring offsets back each other up; ties go to the smallest shift.
    best = offsets[np.lexsort((offsets, np.abs(offsets), -counts))[0]]
    s, e = max(0, best), min(len(a), len(b) + best)
    error = np.bitwise_count(a[s:e] ^ b[s - best : e - best]).mean() / 32
    return int(best), float(error), int(e - s)


def same(a: np.ndarray, b: np.ndarray) -> bool:
    _, error, n = align(a, b)
    return n >= max(LEAST, OVERLAP * min(len(a), len(b))) and error <= BIT_ERROR


def decode(data: bytes | None) -> np.ndarray:
    """8-bit unsigned samples to numbers from -1 to 1; null has none."""
    return (np.frombuffer(data or b"", np.uint8).astype(np.float64) - 128) / 128


def fingerprints(media: DataFrame, params: Params) -> DataFrame:
    """``media``: id columns and ``data`` (binary, 8-bit samples). Adds ``prints`` (little-endian unsigned 32-bit integers)
    and drops ``data``. Null, empty and short recordings have empty prints; repeated rows and null ids stay rows."""
    kept = [f for f in media.schema.fields if f.name not in ("data", "prints")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(decode(x), params).astype("<u4").tobytes() for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, pa.binary())], names=[*names, "prints"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return media.drop("prints").mapInArrow(run, f"{fields}, prints binary")


def matches(rows: DataFrame) -> DataFrame:
    """``rows``: rec (unique long), prints. Returns rec, match, offset, bit_error: for every recording the smallest
    recording that it joins by alignments, and the alignment with the one that it was compared to (nulls for those with no match).

    Equal prints are one class. Recordings that ``same`` accepts have an integer in common. Those of an integer are compared with the first
    of them, so a list of many copies costs one comparison a copy; then all of its pairs whose ends aren't joined yet."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    rows = written(rows.select("rec", "prints", F.sha2("prints", 256).alias("digest")), "prints")
    filled = rows.filter("octet_length(prints) > 0")
    classes = written(filled.groupBy("digest").agg(F.min("rec").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    # Only classes of many copies are split: those with more than a hundred-thousandth of all rows, so there are no more than LARGE of them.
    bar, salts = max(1000, (classes.agg(F.sum("n")).first()[0] or 0) // LARGE), 64
    split = lambda d: d.withColumn("salt", F.explode(F.when(F.col("n") > bar, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    salt = lambda large: F.when(large, F.pmod(F.xxhash64("rec"), F.lit(salts)).cast("int")).otherwise(F.lit(0)).alias("salt")
    large = F.broadcast(classes.filter(F.col("n") > bar).select("digest", F.lit(True).alias("large")))
    member = filled.join(large, "digest", "left").select("rec", "prints", "digest", salt(F.col("large")))
    member = written(member.join(split(classes), ["digest", "salt"]).select("rec", "rep", "n", "prints"), "members")
    reps = member.filter("rec = rep").select("rec", "prints")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            recs, words = [], []
            for rec, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                distinct = np.unique(np.frombuffer(data, "<u4")).astype(np.int64)
                recs.append(np.full(len(distinct), rec))
                words.append(distinct)
            if recs:
                r, w = np.concatenate(recs), np.concatenate(words)
                for i in range(0, len(r), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(r[i : i + 100_000]), pa.array(w[i : i + 100_000])], names=["rec", "word"])

    words = reps.mapInArrow(keys, "rec long, word long")
    lists = words.groupBy("word").agg(F.min("rec").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A frequent word's rows are split by adaptive execution: the other side has one row a word.
    words = written(words.join(lists.select("word", "first"), "word"), "words")
    stars = written(words.filter("rec <> first").select("first", "rec").distinct(), "pairs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first, rec, x, y in zip(*(c.to_pylist() for c in b.columns)):
                a, c = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                offset, error, k = align(a, c)
                if k >= max(LEAST, OVERLAP * min(len(a), len(c))) and error <= BIT_ERROR:
                    out.append((first, rec, offset, error))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["first", "rec", "offset", "bit_error"])

    def compared(pairs: DataFrame) -> DataFrame:
        right = pairs.join(reps, "rec").select("first", "rec", F.col("prints").alias("y"))
        both = right.join(reps.select(F.col("rec").alias("first"), F.col("prints").alias("x")), "first").select("first", "rec", "x", "y")
        return written(both.mapInArrow(check, "first long, rec long, offset long, bit_error double"), "aligned")

    def linked(aligned: DataFrame) -> DataFrame:
        return components(aligned.select(F.col("first").alias("a"), F.col("rec").alias("b"))).withColumnRenamed("node", "rec")

    near = compared(stars)
    held = words.join(linked(near), "rec", "left").select("word", "rec", F.coalesce("component", "rec").alias("component"))
    several = held.groupBy("word").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("word")
    held = written(held.join(several, "word"), "held")
    # A recording meets the other components of a list, then their recordings: pairs within a component are never made.
    other = held.select("word", F.col("component").alias("further")).distinct()
    met = held.join(other, "word").filter("component < further").select("word", "further", F.col("rec").alias("one"))
    crossed = met.join(held.select("word", F.col("component").alias("further"), F.col("rec").alias("two")), ["word", "further"])
    crossed = crossed.select(F.least("one", "two").alias("first"), F.greatest("one", "two").alias("rec")).distinct()
    far = compared(written(crossed.join(stars, ["first", "rec"], "left_anti"), "pairs"))
    aligned = near.union(far)
    joined = linked(aligned)
    # Alignments with smaller recordings come first; the smallest of a component has none.
    turned = aligned.select(F.col("rec").alias("first"), F.col("first").alias("rec"), (-F.col("offset")).alias("offset"), "bit_error")
    best = aligned.union(turned).groupBy("rec").agg(F.min_by(F.struct("first", "offset", "bit_error"), F.struct(F.col("first") > F.col("rec"), "bit_error", "first")).alias("best"))
    best = best.join(joined, "rec").filter("component < rec").select("rec", "best")
    own = member.filter("rec = rep").select("rec", "n").join(best, "rec", "left").join(joined, "rec", "left")
    own = own.select(F.col("rec").alias("rep"), "n", F.coalesce("component", "rec").alias("match"), F.col("best.offset").alias("offset"), F.col("best.bit_error").alias("bit_error"))
    of_member = member.select("rec", "rep", salt(F.col("n") > bar)).join(split(own), ["rep", "salt"])
    of_member = of_member.select("rec", "match", F.when(F.col("rec") == F.col("rep"), F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"), F.when(F.col("rec") == F.col("rep"), F.col("bit_error")).otherwise(F.lit(0.0)).alias("bit_error"))
    return rows.select("rec", "prints").join(of_member, "rec", "left").withColumn("match", F.coalesce("match", "rec"))


def op3_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    """No table holds audio: the UTF-8 bytes of each turn of a conversation stand in for 8-bit samples, at a rate and with frames that
    fit their lengths. Returns per turn: rec, conv_id, turn, n_prints, prints_crc32, match, offset, bit_error. A recording is known by a hash
    of its row, so equal rows are one recording and results don't depend on how the table is split. Null, empty and short
    texts have no prints and match nothing; other columns are ignored; no rows give no rows."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rec = F.xxhash64(F.to_json(F.struct("conv_id", "turn", "text")))
    media = turns.select(rec.alias("rec"), "conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    rows = written(fingerprints(media, Params(rate=1000, frame=128, hop=16, low_hz=8.0, high_hz=500.0)), "fingerprints")
    found = matches(rows.select("rec", "prints").dropDuplicates(["rec"])).select("rec", "match", "offset", "bit_error")
    return rows.join(found, "rec").select("rec", "conv_id", "turn", F.expr("octet_length(prints) div 4").cast("long").alias("n_prints"), F.crc32("prints").alias("prints_crc32"), "match", "offset", "bit_error")
