"""Language identification by a convolutional network over bytes, trained with numpy on labelled texts.

A window of WINDOW bytes is embedded byte by byte; filters of several widths slide over it, the largest response of
each filter is kept, and a softmax over these gives the languages. A text is cut into windows from its beginning to its end, each
sees the next bytes as far as the widest filter needs them, and the text's probabilities are the mean of its windows',
weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import slices

#: Texts of a language that the network is fitted on at most (those with the smallest hashes), and windows of each of them.
SAMPLE, VIEWS = 1000, 4
WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4, 5), 16, 8
WIDEST = max(WIDTHS)
#: The symbol after a text's last byte; its embedding is zero.
END = 256
STEPS, BATCH, RATE, DECAY = 900, 96, 4e-3, 1e-4
#: Windows that are scored at once.
TOGETHER = 128
UNKNOWN = "und"


@dataclass
class Network:
    """``names``: the languages in code-point order; the arrays are the embedding, the filters (offset and depth, filter), their
    bias, and the softmax's weights and bias."""

    names: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, names: list[str], seed: int = 12) -> "Network":
        r, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        embedding = r.normal(0, 1, (END + 1, DEPTH)).astype(np.float32)
        embedding[END] = 0
        filters = r.normal(0, 1, (WIDEST, DEPTH, n)) * np.sqrt(2 / (np.repeat(WIDTHS, FILTERS) * DEPTH)) * cls.reach()[:, None, :]
        return cls(names, embedding, filters.reshape(WIDEST * DEPTH, n).astype(np.float32), np.zeros(n, np.float32), r.normal(0, 0.1, (n, len(names))).astype(np.float32), np.zeros(len(names), np.float32))

    @staticmethod
    def reach() -> np.ndarray:
        """Which offsets each filter sees."""
        return np.arange(WIDEST)[:, None] < np.repeat(WIDTHS, FILTERS)

    def responses(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows of WINDOW + WIDEST - 1 symbols: what each filter sees at each place, and its response there."""
        x = self.embedding[symbols]
        step = x.strides
        seen = np.lib.stride_tricks.as_strided(x, (len(x), WINDOW, WIDEST * DEPTH), (step[0], step[1], step[2])).reshape(len(x) * WINDOW, -1)
        return seen, (seen @ self.filters).reshape(len(x), WINDOW, -1)

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        _, out = self.responses(symbols)
        z = np.maximum(out.max(axis=1) + self.bias, 0) @ self.weights + self.offset
        z = np.exp((z - z.max(axis=1, keepdims=True)).astype(np.float64))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, symbols: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean loss and its gradients, in the order of the arrays. Only the place of its largest response moves a filter."""
        seen, out = self.responses(symbols)
        at = out.argmax(axis=1)
        pooled = np.take_along_axis(out, at[:, None, :], 1)[:, 0] + self.bias
        held = np.maximum(pooled, 0)
        z = held @ self.weights + self.offset
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        n = len(y)
        loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-12)).mean())
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.weights.T) * (pooled > 0)
        patch = seen.reshape(n, WINDOW, -1)[np.arange(n)[:, None], at]
        to_filters = np.einsum("nf,nfk->kf", back, patch, optimize=True) * np.repeat(self.reach(), DEPTH, axis=0)
        to_patch = (back[:, :, None] * self.filters.T[None]).reshape(n, -1, WIDEST, DEPTH)
        who = symbols[np.arange(n)[:, None, None], at[:, :, None] + np.arange(WIDEST)].ravel()
        to_embedding = np.stack([np.bincount(who, to_patch[..., d].ravel(), END + 1) for d in range(DEPTH)], axis=1).astype(np.float32)
        to_embedding[END] = 0
        return loss, [to_embedding, to_filters, back.sum(axis=0), held.T @ p, p.sum(axis=0)]

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]


def symbols_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows of ``raw`` from each start, with the end sign from each end on."""
    at = start[:, None] + np.arange(WINDOW + WIDEST - 1)
    if not len(raw):
        return np.full(at.shape, END, np.int16)
    return np.where(at < end[:, None], raw[np.minimum(at, len(raw) - 1)].astype(np.int16), np.int16(END))


def train(names: list[str], views: list[bytes], labels: np.ndarray, seed: int = 12) -> Network:
    """Adam over random batches of all languages alike. Half of the views are cut to a random length, so short texts are known too, and a few
    are upper-cased."""
    net = Network.start(names, seed)
    if len(names) < 2:
        return net
    r = np.random.default_rng(seed)
    by = [np.flatnonzero(labels == k) for k in range(len(names))]
    raw = np.frombuffer(b"".join(views), np.uint8)
    size = np.array([len(v) for v in views], np.int64)
    first = np.cumsum(size) - size
    upper = np.arange(END + 1, dtype=np.int16)
    upper[97:123] -= 32
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    for step in range(1, STEPS + 1):
        y = r.integers(0, len(names), BATCH)
        some = np.array([by[k][r.integers(len(by[k]))] for k in y])
        length = np.where(r.random(BATCH) < 0.5, r.integers(10, WINDOW + 1, BATCH), WINDOW + WIDEST)
        skip = (r.random(BATCH) * np.maximum(size[some] - length, 0)).astype(np.int64)
        symbols = symbols_of(raw, first[some] + skip, first[some] + np.minimum(skip + length, size[some]))
        loud = r.random(BATCH) < 0.05
        symbols[loud] = upper[symbols[loud]]
        _, grads = net.gradients(symbols, y)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for a, g, (m, v) in zip(net.arrays(), grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * a)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    """Whether a document's label is never learnt from. A null id is an empty text there."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, *, seed: int = 12) -> Network:
    """Fit on at most SAMPLE texts of each language that aren't held out, VIEWS windows of each. Rows without text, without letters or without a language take no
    part; the languages' names come to the driver, and so do at most SAMPLE * VIEWS windows for each."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Network.start([])
    span = 2**30
    bars = docs.sparkSession.createDataFrame([(k, min(span, span * 2 * SAMPLE // n + 1)) for k, n in counts.items()], "lang string, bar long")  # a row for each language
    rows = rows.withColumn("place", F.xxhash64("id", "text"))
    rows = rows.join(F.broadcast(bars), "lang").filter(F.pmod("place", F.lit(span)) < F.col("bar")).filter(F.col("text").rlike(r"\p{L}"))  # about twice the sample
    body = F.col("text").cast("binary")
    room = F.greatest(F.octet_length("text") - (WINDOW + WIDEST - 1), F.lit(0)) + 1
    views = [F.substring(body, F.pmod(F.xxhash64("place", F.lit(k)), room).cast("int") + 1, F.lit(WINDOW + WIDEST - 1)) for k in range(VIEWS)]
    rows = rows.select("lang", "place", F.array(*views).alias("views"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(span)), "place"))
    found = rows.withColumn("nth", first).filter(F.col("nth") <= SAMPLE).select("lang", "nth", "views").collect()
    found.sort(key=lambda r: (r["lang"], r["nth"]))
    names = sorted({r["lang"] for r in found})
    pairs = [(names.index(r["lang"]), bytes(v)) for r in found for v in r["views"]]
    return train(names, [v for _, v in pairs], np.array([k for k, _ in pairs], np.int64), seed)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the probability of that language), and without its text. Texts that are null or hold no letter, and all texts
    of a network that knows no language, are ``und`` with score 0; ties go to the name first in code-point order. Other columns and repeated
    rows stay; columns of the two names are replaced. The whole text counts."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size for each language
    docs = docs.drop("lang_pred", "score")
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for i, j, raw, offsets in slices(b.column(b.num_columns - 1)):
                size = np.diff(offsets)
                p = np.zeros((j - i, max(1, len(net.names))))
                if len(net.names):
                    n = -(-size // WINDOW)
                    text = np.repeat(np.arange(j - i), n)
                    start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
                    end = offsets[text + 1]
                    share = np.minimum(end - start, WINDOW) / np.maximum(size[text], 1)
                    for s in range(0, len(text), TOGETHER):
                        some = slice(s, s + TOGETHER)
                        np.add.at(p, text[some], net.probabilities(symbols_of(raw, start[some], end[some])) * share[some, None])
                best = p.argmax(axis=1)
                known = (size > 0) & (len(net.names) > 0)
                names = [net.names[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                score = np.where(known, np.clip(p[np.arange(j - i), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(b.num_columns - 1)), pa.array(names, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(run, f"{fields}lang_pred string, score double")


def op12_byte_convolutions(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; see ``learn`` and ``predict`` for nulls, ties and odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
