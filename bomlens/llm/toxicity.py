"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares two words by the letter triples that both hold in this order, each weighted down by
the gaps inside it, so a word with inserted or missing letters stays close to itself. Landmarks are telling
words of labelled texts; words map to kernel values with them (whitened, Nyström) and a linear machine is
fitted there. Since the kernel is an inner product of explicit triple weights, the fitted machine is the same as one weight
for each letter triple, and words are scored that way. A text's score is that of its worst word.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Labelled texts that the model is fitted on at most; those with the smallest hashes of their ids.
SAMPLE = 12_000
COPY_HASHES, PASSAGE_WORDS = 4, 16
#: Near copies agree in more than two thirds of BANDS * BAND minhashes over runs of words.
SHINGLE, BANDS, BAND = 3, 21, 3
SALTS, ODD = np.random.default_rng(0).integers(0, 2**64, (2, BANDS * BAND), np.uint64)
ODD |= np.uint64(1)
LANDMARKS, NEGATIVES = 160, 4000
DECAY, SYMBOLS = 0.7, 64
#: Letters scored at a time; longer words are scored in overlapping parts.
PART, STEP = 20, 10
CACHE_WORDS = 250_000
SLOPE = 4.0
#: Rounds in which words that come too near to the insults become examples.
MINING = 5

#: Digits and signs that stand for letters (fixed values).
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def plain(word: str) -> str:
    """A word's letters, lower-cased; lookalikes inside it count as the letters, other signs go."""
    word = word.lower()
    if word.isalpha():
        return word
    letters = word.strip("!?.,;:$@#*%&\"'()[]{}|<>-_+=~`/\\")
    return "".join(filter(str.isalpha, letters.translate(LOOKALIKES)))


def words(text: str) -> set[str]:
    """The distinct words of a text, and runs of three or more single characters as one word."""
    parts = text.split()
    out = set(parts)
    if " " in text and any(len(p) == 1 for p in out):
        run: list[str] = []
        for p in [*parts, "--"]:
            if len(p) == 1:
                run.append(p)
            elif run:
                if len(run) >= 3:
                    out.add("".join(run))
                run = []
    return out


def parts(letters: str) -> list[str]:
    if len(letters) <= PART:
        return [letters]
    return [letters[i : i + PART] for i in range(0, len(letters) - PART + STEP, STEP)]


def codes(ws: list[str]) -> np.ndarray:
    """Words of one length as symbol numbers: an edge sign, a-z, other letters by code point, an edge sign."""
    c = np.array([[ord(x) for x in w] for w in ws], np.int64)
    c = np.where((c >= 97) & (c <= 122), c - 97, 26 + c % (SYMBOLS - 27))
    edge = np.full((len(ws), 1), SYMBOLS - 1)
    return np.concatenate([edge, c, edge], axis=1)


_triples: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def triples(length: int):
    if length not in _triples:
        at = np.array(list(itertools.combinations(range(length), 3)), np.int64).reshape(-1, 3)
        _triples[length] = (at[:, 0], at[:, 1], at[:, 2], DECAY ** (at[:, 2] - at[:, 0] + 1.0))
    return _triples[length]


def features(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples of words of one length: numbers, summed weights (a repeated triple once), by word."""
    c = codes(ws)
    i, j, k, w = triples(c.shape[1])
    idx = (c[:, i] * SYMBOLS + c[:, j]) * SYMBOLS + c[:, k]
    order = np.argsort(idx, axis=1, kind="stable")
    idx, weight = np.take_along_axis(idx, order, 1), w[order]
    total = np.cumsum(weight, axis=1)
    last = np.concatenate([idx[:, 1:] != idx[:, :-1], np.ones((len(ws), 1), bool)], axis=1)
    row, col = np.nonzero(last)
    ends = total[row, col]
    prev = np.concatenate([[0.0], ends[:-1]])
    prev[np.concatenate([[True], row[1:] != row[:-1]])] = 0
    return idx[row, col], ends - prev, row


class Words:
    """Normed explicit features of a list of words, as a sparse matrix by rows."""

    def __init__(self, ws: list[str]):
        self.n = len(ws)
        by: dict[int, list[int]] = {}
        for p, w in enumerate(ws):
            by.setdefault(len(w), []).append(p)
        got = []
        for length, at in by.items():
            if length >= 3:
                for s in range(0, len(at), 500):
                    some = at[s : s + 500]
                    idx, val, row = features([ws[p] for p in some])
                    norm = np.sqrt(np.bincount(row, val * val, len(some)))
                    got.append((idx, val / norm[row], np.array(some)[row]))
        self.idx, self.val, self.row = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.idx] * self.val, self.n)

    def kernel(self, others: "Words") -> np.ndarray:
        out = np.zeros((self.n, others.n), np.float64)
        for j in range(others.n):
            w = np.zeros(SYMBOLS**3)
            s = others.row == j
            w[others.idx[s]] = others.val[s]
            out[:, j] = self.dot(w)
        return out


class Model:
    """A weight for each letter triple, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def margins(self, ws: list[str]) -> np.ndarray:
        """Of normal words of any lengths; the worst part counts."""
        flat = [(p, x) for p, w in enumerate(ws) for x in parts(w)]
        got = np.concatenate([Words([x for _, x in flat[s : s + 2_000]]).dot(self.weights) + self.bias for s in range(0, len(flat), 2_000)])
        out = np.full(len(ws), -np.inf)
        np.maximum.at(out, [p for p, _ in flat], got)
        return out


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps on its active examples."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        a = x1[active] * weight[active, None]
        new = np.linalg.solve(ridge + 2 * c * a.T @ x1[active], 2 * c * a.T @ y[active])
        now = y * (x1 @ new) < 1
        done = np.array_equal(now, active)
        w, active = new, now
        if done or not active.any():
            break
    return w[:-1], float(w[-1])


def fit(stats: list[tuple[str, int, int]], base_rate: float) -> Model:
    """From words with the numbers of toxic and of other texts that hold them.

    Words are positive if they stand in toxic texts alone and more often than chance lets any word of the sample do."""
    merged: dict[str, list[int]] = {}
    for w, pos, neg in stats:
        for p in parts(plain(w)):
            if len(p) >= 3:
                m = merged.setdefault(p, [0, 0])
                m[0] += pos
                m[1] += neg
    rate = min(max(base_rate, 1e-6), 1 - 1e-6)
    bar = math.log(max(2, len(merged))) + 2
    telling = lambda pos, neg: pos * math.log((pos / (pos + neg)) / rate) + (neg * math.log((neg / (pos + neg)) / (1 - rate)) if neg else 0)
    positive = sorted((w for w, (p, n) in merged.items() if p > 4 * n and telling(p, n) > bar), key=lambda w: (-merged[w][0], w))
    if not positive:
        return Model(np.zeros(SYMBOLS**3), -1.0)
    landmarks = positive[:LANDMARKS]
    others = sorted((w for w, (_, n) in merged.items() if n and w not in set(positive)), key=lambda w: (-merged[w][1], w))
    some = positive[: 4 * LANDMARKS]
    negative = others[: NEGATIVES // 2]
    for _ in range(MINING):
        lm = Words(landmarks)
        value, vector = np.linalg.eigh(lm.kernel(lm))
        keep = value > 1e-6 * value.max()
        white = vector[:, keep] / np.sqrt(value[keep])
        x = Words(some + negative).kernel(lm) @ white
        y = np.array([1.0] * len(some) + [-1.0] * len(negative))
        # An example weighs as many texts as it stands in, damped.
        weight = np.log1p([merged[w][0] for w in some] + [merged[w][1] for w in negative])
        weight[: len(some)] *= max(1.0, weight[len(some) :].sum() / weight[: len(some)].sum()) / 4
        w, bias = train_svm(x, y, weight)
        explicit = np.zeros(SYMBOLS**3)
        np.add.at(explicit, lm.idx, lm.val * (white @ w)[lm.row])
        # Other words that come too near join the examples, and the worst of them the landmarks.
        margin = Model(explicit, bias).margins(others)
        worst = [others[i] for i in np.argsort(-margin, kind="stable")[:NEGATIVES] if margin[i] > -1]
        if not worst or margin.max() < 0:
            break
        negative = list(dict.fromkeys([*negative, *worst[: NEGATIVES // 4]]))
        landmarks = list(dict.fromkeys([*landmarks, *worst[: LANDMARKS // 2]]))
    return Model(explicit, bias)


_cache: dict[int, dict[str, float]] = {}  # of one model: a worker's older ones go


def probabilities(model: Model, key: int, texts: list[str | None]) -> np.ndarray:
    if key not in _cache or len(_cache[key]) > CACHE_WORDS:
        _cache.clear()
        _cache[key] = {}
    cache = _cache[key]
    sets = [words(t or "") for t in texts]
    new = list(set().union(*sets) - cache.keys())
    for at in range(0, len(new), 20_000):
        some = [(w, plain(w)) for w in new[at : at + 20_000]]
        cache.update((w, -9.0) for w, p in some if len(p) < 3)
        some = [(w, p) for w, p in some if len(p) >= 3]
        if some:
            cache.update(zip((w for w, _ in some), model.margins([p for _, p in some]).tolist()))
    get = cache.__getitem__
    margin = np.array([max(map(get, s), default=-9.0) for s in sets])
    return 1 / (1 + np.exp(-SLOPE * margin))


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def without_passages(found: list[tuple]) -> list[tuple[str, int, int]]:
    """Words with counts and minhashes of the texts that hold them, without those of which many agree in two
    minhashes: they belong to a passage that texts share, and their texts are no independent evidence."""
    pairs = list(itertools.combinations(range(3, 3 + COPY_HASHES), 2))
    size = lambda r: round(math.log2(r[1] + 1))
    # Spellings of a word count once, and only words of about as many texts.
    together = [Counter(at for at, _ in {((r[i], r[j], size(r)), plain(r[0])) for r in found}) for i, j in pairs]
    return [r[:3] for r in found if all(c[r[i], r[j], size(r)] <= PASSAGE_WORDS for c, (i, j) in zip(together, pairs))]


def signature(text: str) -> np.ndarray:
    """Minhashes of a text's runs of SHINGLE words (of all its words if they are fewer), as 32-bit integers."""
    ws = text.lower().split()
    hashed = np.array([xxhash.xxh64_intdigest(" ".join(ws[i : i + SHINGLE])) for i in range(max(1, len(ws) - SHINGLE + 1))], np.uint64)
    least = np.full(len(SALTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashed), 10_000):
        least = np.minimum(least, ((hashed[at : at + 10_000, None] ^ SALTS) * ODD).min(axis=0))
    return (least >> np.uint64(16)).astype("<u4")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [signature(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("toxic").cast(pa.int32()), pa.array(found, pa.binary())], names=["row", "toxic", "signature"])


def copy_groups(labels: list[int], signatures: np.ndarray) -> list[int]:
    """For each text the first text of its label that agrees with it in all but BANDS - 1 minhashes at most, or itself.

    Two such texts agree in all of some band, so the index by bands misses none. Only first texts are compared to."""
    index: dict[tuple, list[int]] = {}
    out = []
    for i, (label, s) in enumerate(zip(labels, signatures)):
        keys = [(label, k, s[k * BAND : (k + 1) * BAND].tobytes()) for k in range(BANDS)]
        met = np.array(sorted({j for key in keys for j in index.get(key, ())}), np.int64)
        near = met[(signatures[met] != s).sum(axis=1) < BANDS]
        if len(near):
            out.append(int(near[0]))
            continue
        out.append(i)
        for key in keys:
            index.setdefault(key, []).append(i)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most SAMPLE labelled texts that aren't held out. Labels of other values than 0 and 1, null
    ids and null texts take no part; texts labelled both ways count as often as they are labelled."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(labels), "doc_id")  # at most SAMPLE rows
    split = F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "toxic", "text", split.alias("words")), "labelled")
    # Near copies would make all their words look telling: a word counts once in a group of them.
    found = sorted(tuple(r) for r in rows.select("row", "toxic", "text").mapInArrow(_signed, "row long, toxic int, signature binary").collect())
    of = copy_groups([t for _, t, _ in found], np.array([np.frombuffer(x, "<u4") for _, _, x in found]).reshape(-1, BANDS * BAND))
    groups = [(row, found[g][0]) for (row, _, _), g in zip(found, of)]
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(groups, "row long, copies long")), "row").select("copies", "toxic", "words")
    by_word = rows.select("copies", "toxic", F.explode("words").alias("w")).filter("w <> ''").distinct()
    where = [F.min(F.xxhash64("copies", F.lit(k))).alias(f"at{k}") for k in range(COPY_HASHES)]
    by_word = by_word.groupBy("w").agg(F.sum("toxic").cast("long").alias("pos"), F.sum(1 - F.col("toxic")).cast("long").alias("neg"), *where)
    # Words of the bounded sample: all that toxic texts repeat, and the most common of the others.
    telling = by_word.filter("pos >= 2 AND pos > neg").orderBy(F.desc("pos"), "neg", "w").limit(20_000)
    common = by_word.filter("neg >= 1 AND pos <= neg").orderBy(F.desc("neg"), F.xxhash64("w"), "w").limit(80_000)
    stats = [tuple(r[:3]) for r in common.collect()] + without_passages([tuple(r) for r in telling.collect()])
    n, toxic = len(set(of)), sum(found[g][1] for g in set(of))
    return fit(stats, toxic / n if n else 0.5)


def score(docs: DataFrame, model: Model, *, keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text if ``keep_text`` is off) with ``score`` (0 to 1) from whole texts; null and empty texts get the score of no words (close to 0). A
    column of that name is replaced; other columns, nulls in them and repeated rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = hash(model.weights.tobytes()) ^ hash(model.bias)
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, got, some, chars = b.column(b.schema.get_field_index("text")).to_pylist(), [], [], 0
            for t in texts:
                some.append(t)
                chars += len(t or "")
                if chars > 1_000_000:
                    got.append(probabilities(shared.value, key, some))
                    some, chars = [], 0
            got.append(probabilities(shared.value, key, some))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.concatenate(got))], names=[*(b.schema.names[c] for c in kept), "score"])
        _cache.clear()  # the worker may serve other stages next
        pa.default_memory_pool().release_unused()

    kept = [i for i, c in enumerate(docs.columns) if keep_text or c != "text"]
    fields = ", ".join(f"`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}" for i in kept)
    return docs.mapInArrow(run, f"{fields}, score double")


def op10_string_kernel_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; see ``learn`` and ``score`` for nulls, ties and odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
