"""Edit distance of JSON documents as trees, with lower bounds that spare most pairs the exact computation.

A document is a tree of objects, arrays, keys and values. Objects' members have no order, arrays' items have one. Nodes are deleted and
inserted, and their children move up; a node is renamed to one of its own kind only; and disjoint subtrees stay disjoint
(the constrained edit distance, for which the forest and tree recurrences below are exact). Every traversal has its own
stack, so depth is bounded by memory alone.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomlens.functions.scalars import rename_cost

OBJECT, ARRAY, KEY, VALUE = range(4)
KINDS = ("object", "array", "key", "value")
FORBIDDEN = 1e9

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))')
_WORD = {"true": True, "false": False, "null": None}


def parse(text: str):
    """A JSON text as Python values, without recursion; of repeated keys the last counts. Raises ValueError for other texts."""
    at, top, stack, want = 0, [], [], "value"  # stack: containers with the key that waits for a value
    here: list | dict = top
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            break
        at, sign = m.end(), m.group(1)
        if sign and sign in "{[" and want in ("value", "value or ]"):
            new: list | dict = {} if sign == "{" else []
            stack.append((here, None))
            here, want = new, "key or }" if sign == "{" else "value or ]"
            continue
        if sign and sign in "}]":
            if want not in ((", or }", "key or }") if sign == "}" else (", or ]", "value or ]")):
                raise ValueError(at)
            value = here
            here, _ = stack.pop()
        elif m.group(2) and want in ("key or }", "key"):
            key, at = scanstring(text, at)
            colon = _TOKEN.match(text, at)
            if not colon or colon.group(1) != ":":
                raise ValueError(at)
            at, want = colon.end(), "value"
            here = _Pending(here, key)
            continue
        elif sign == "," and want in (", or }", ", or ]"):
            want = "key" if want == ", or }" else "value"
            continue
        elif m.group(2) and want in ("value", "value or ]"):
            value, at = scanstring(text, at)
        elif m.group(3) is not None and want in ("value", "value or ]"):
            value = m.group(3)
            value = int(value) if value.lstrip("-").isdigit() and len(value) < 4000 else float(value)
        elif m.group(4) and want in ("value", "value or ]"):
            value = _WORD[m.group(4)]
        else:
            raise ValueError(at)
        if isinstance(here, _Pending):
            here.owner[here.key] = value
            here = here.owner
        else:
            here.append(value)
        if here is top:
            break
        want = ", or }" if isinstance(here, dict) else ", or ]"
    if len(top) != 1 or stack or text[at:].strip(" \t\n\r"):
        raise ValueError(at)
    return top[0]


@dataclass
class _Pending:
    """An object whose key waits for its value."""

    owner: dict
    key: str


def plain(text: str) -> str:
    """ASCII without white space."""
    return "".join(c for c in text if c.isascii() and not c.isspace())


@dataclass
class Tree:
    """Nodes with children before parents: kinds, labels, children, and sizes of subtrees; the root is last."""

    kind: list[int]
    label: list[str]
    children: list[list[int]]
    size: list[int]

    @classmethod
    def of(cls, value) -> "Tree":
        """Labels are those of the bracket notation: ASCII without white space, strings in quotes, keys with a colon."""
        kind: list[int] = []
        label: list[str] = []
        below: list[list] = []
        todo = [(value, None)]
        while todo:  # parents first, children from the last to the first: the reverse of children before parents
            v, key = todo.pop()
            kids: list = []
            if key is not None:
                kids = [(v, None)]
                kind.append(KEY)
                label.append(f'"{plain(key)}":')
            elif isinstance(v, dict):
                kids = [(x, str(k)) for k, x in v.items()]
                kind.append(OBJECT)
                label.append("{}")
            elif isinstance(v, list):
                kids = [(x, None) for x in v]
                kind.append(ARRAY)
                label.append("[]")
            else:
                kind.append(VALUE)
                label.append("null" if v is None else f'"{plain(v)}"' if isinstance(v, str) else str(v))
            below.append(kids)
            todo.extend(kids)
        n = len(kind)
        children: list[list[int]] = [[] for _ in range(n)]
        size, open_ = [1] * n, []
        for i in range(n):  # in the order of the visits; a node's parent is the last one that still waits for children
            while open_ and open_[-1][1] == 0:
                open_.pop()
            if open_:
                children[open_[-1][0]].append(i)
                open_[-1][1] -= 1
            open_.append([i, len(below[i])])
        for i in range(n - 1, -1, -1):
            size[i] += sum(size[c] for c in children[i])
        flip = lambda i: n - 1 - i
        return cls(kind[::-1], label[::-1], [[flip(c) for c in reversed(children[flip(i)])] for i in range(n)], size[::-1])

    @classmethod
    def read(cls, text: str | None) -> "Tree | None":
        try:
            return cls.of(parse(text)) if text is not None else None
        except ValueError:
            return None


@functools.lru_cache(200_000)
def edits(a: str, b: str) -> int:
    """Levenshtein distance of two strings: what they share at both ends goes, and short rests are compared letter by letter."""
    least = min(len(a), len(b))
    i = next((k for k in range(least) if a[k] != b[k]), least)
    j = next((k for k in range(least - i) if a[-1 - k] != b[-1 - k]), least - i)
    a, b = sorted((a[i : len(a) - j], b[i : len(b) - j]), key=len)
    if not a:
        return len(b)
    if len(b) <= 24:
        row = list(range(len(b) + 1))
        for n, x in enumerate(a, 1):
            last, row[0] = row[0], n
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
        return row[-1]
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for n, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = n
        np.minimum(row[1:] + 1, row[:-1] + (codes != ord(x)), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps  # insertions run on to the right
    return int(row[-1])


def rename(kind: int, a: str, b: str) -> float:
    """F24 for two nodes of one kind."""
    if a == b:
        return 0.0
    return 0.5 + edits(a, b) / max(len(a), len(b))


@dataclass(frozen=True)
class Costs:
    """An exchangeable cost model. ``rename`` takes a kind and two labels; ``least`` is below any cost of renaming to another label and
    bounds pairs without computing them (0 is always right)."""

    delete: float = 1.0
    insert: float = 1.0
    rename: Callable[[int, str, str], float] = rename
    least: float = 0.5


JSON_COSTS = Costs()


def best_match(cost: list[list[float]]) -> float:
    """The least sum of entries of a matrix, at most one in each row and column, none if they are positive."""
    if len(cost) > len(cost[0]):
        cost = [list(c) for c in zip(*cost)]
    n, m = len(cost), len(cost[0])
    if n == 1:
        return min(0.0, *cost[0])
    least = [min(row) for row in cost]
    at = [row.index(x) for row, x in zip(cost, least) if x < 0]
    if len(set(at)) == len(at):  # each row's best is its own
        return sum(x for x in least if x < 0)
    # Shortest augmenting paths; each row has a column of its own that costs nothing.
    u, v = [0.0] * (n + 1), [0.0] * (m + n + 1)
    owner, before = [0] * (m + n + 1), [0] * (m + n + 1)
    for r in range(1, n + 1):
        owner[0], j = r, 0
        least, seen = [float("inf")] * (m + n + 1), [False] * (m + n + 1)
        while owner[j]:
            seen[j] = True
            i, row = owner[j], cost[owner[j] - 1]
            step, nxt = float("inf"), 0
            for k in range(1, m + n + 1):
                if not seen[k]:
                    c = (row[k - 1] if k <= m else 0.0 if k - m == i else FORBIDDEN) - u[i] - v[k]
                    if c < least[k]:
                        least[k], before[k] = c, j
                    if least[k] < step:
                        step, nxt = least[k], k
            for k in range(m + n + 1):
                if seen[k]:
                    u[owner[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = nxt
        while j:
            owner[j] = owner[before[j]]
            j = before[j]
    return sum(cost[owner[k] - 1][k - 1] for k in range(1, m + 1) if owner[k])


def tree_distance(a: Tree, b: Tree, costs: Costs = JSON_COSTS) -> float:
    """The least cost of turning ``a`` into ``b``. Rows of finished children are dropped, so memory is that of the widest level times
    the size of ``b``."""
    gone, made = costs.delete, costs.insert
    n = len(b.kind)
    renames: dict[tuple[int, str, str], float] = {}
    trees: dict[int, list[float]] = {}
    forests: dict[int, list[float]] = {}

    def swap(i: int, j: int) -> float:
        key = (a.kind[i], a.label[i], b.label[j])
        if key not in renames:
            renames[key] = costs.rename(*key)
        return renames[key]

    def sequence(xs: list[int], ys: list[int]) -> float:
        row = [0.0]
        for y in ys:
            row.append(row[-1] + made * b.size[y])
        for x in xs:
            new = [row[0] + gone * a.size[x]]
            of = trees[x]
            for k, y in enumerate(ys):
                new.append(min(row[k + 1] + gone * a.size[x], new[k] + made * b.size[y], row[k] + of[y]))
            row = new
        return row[-1]

    whole_b = [made * z for z in b.size]
    below = [made * (z - 1) for z in b.size]
    for i in range(len(a.kind)):
        xs, whole_a, kind = a.children[i], gone * a.size[i], a.kind[i]
        tree_row, forest_row = [0.0] * n, [0.0] * n
        rows = [(trees[x], forests[x], gone * a.size[x]) for x in xs]
        for j in range(n):
            ys = b.children[j]
            forest = whole_a - gone + below[j]
            best = inner = 0.0  # what is gained over deleting one and inserting the other
            for tree_x, forest_x, size_x in rows:
                best = min(best, tree_x[j] - size_x - whole_b[j])
                inner = min(inner, forest_x[j] - size_x + gone - below[j])
            for y in ys:
                best = min(best, tree_row[y] - whole_a - whole_b[y])
                inner = min(inner, forest_row[y] - whole_a + gone - below[y])
            if xs and ys:
                # The children of one lie below one child of the other, or they are matched with each other.
                if kind == ARRAY and b.kind[j] == ARRAY:
                    inner = min(inner, sequence(xs, ys) - forest)
                else:
                    gains = [[tree_x[y] - size_x - whole_b[y] for y in ys] for tree_x, _, size_x in rows]
                    inner = min(inner, best_match(gains))
            forest += inner
            whole = whole_a + whole_b[j]
            tree_row[j] = min(whole + best, forest + gone + made)  # roots of two kinds both go, and what is below them is matched
            if kind == b.kind[j] and forest < tree_row[j]:
                tree_row[j] = min(tree_row[j], forest + swap(i, j))
            forest_row[j] = forest
        for x in xs:
            del trees[x], forests[x]
        trees[i], forests[i] = tree_row, forest_row
    return trees[len(a.kind) - 1][n - 1]


_PROFILE = T.StructType([T.StructField("size", T.IntegerType()), *[T.StructField(k, T.ArrayType(T.StringType())) for k in KINDS], *[T.StructField(f"{k}_codes", T.ArrayType(T.LongType())) for k in KINDS], T.StructField("shape", T.StringType())])


@F.pandas_udf(_PROFILE)
def tree_profile(texts):
    """A document's nodes, its labels by kind (the second and further ones of a label carry their number), digests of these labels in numbers, and its shape: a digest of all kinds and
    sizes of subtrees, which tell a tree but for its labels. Null for texts that are no JSON."""
    rows, known = [], {}
    for t in texts:
        if t not in known:
            tree = Tree.read(t)
            if tree is not None:
                seen: Counter = Counter()
                labels: list[list[str]] = [[] for _ in KINDS]
                for k, x in zip(tree.kind, tree.label):
                    seen[k, x] += 1
                    labels[k].append(x if seen[k, x] == 1 else f"{x}\0{seen[k, x]}")
                shape = hashlib.sha256(repr((tree.kind, tree.size)).encode()).hexdigest()
                codes = [[int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in xs] for xs in labels]
                tree = (len(tree.kind), *labels, *codes, shape)
            known[t] = tree
        rows.append(known[t] or (None,) * len(_PROFILE))
    return pd.DataFrame(rows, columns=_PROFILE.names)


def _shared(a: Column, b: Column) -> Column:
    """Of each kind, how many labels two documents with these profiles have in common; never too few, should digests agree."""
    return F.array(*[F.size(F.array_intersect(a[f"{k}_codes"], b[f"{k}_codes"])) for k in KINDS])


def lower_bound(a: Column, b: Column, costs: Costs = JSON_COSTS, shared: Column | None = None) -> Column:
    """Never above the distance of two documents with these profiles: of each kind, the nodes that one has more are deleted or inserted, and
    of the others those with labels that the other lacks are renamed at least."""
    total = F.lit(0.0)
    spare = min(costs.delete, costs.insert)
    shared = _shared(a, b) if shared is None else shared
    for n, k in enumerate(KINDS):
        x, y = F.size(a[k]), F.size(b[k])
        total = total + F.greatest(x - y, F.lit(0)) * costs.delete + F.greatest(y - x, F.lit(0)) * costs.insert + (F.least(x, y) - shared[n]) * min(costs.least, 2 * spare)
    return total


def tree_cost(costs: Costs = JSON_COSTS):
    """A function of two columns of JSON texts; null where one of them is none. Equal documents cost nothing; a text is read once in a batch."""

    @F.pandas_udf(T.DoubleType())
    def cost(xs, ys):
        trees: dict[str, Tree | None] = {}
        done: dict[tuple, float | None] = {}

        def of(t):
            if t not in trees:
                trees[t] = Tree.read(t)
            return trees[t]

        def one(x, y) -> float | None:
            if (x, y) not in done:
                a, b = of(x), of(y)
                done[x, y] = None if a is None or b is None else 0.0 if a == b else tree_distance(a, b, costs)
            return done[x, y]

        return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype="float64")

    return cost


tree_edit_cost = tree_cost()


def _renamed(costs: Costs, kind: Column, x: Column, y: Column) -> Column:
    """The cost of renaming, as an expression where it is F24."""
    if costs.rename is rename:
        return rename_cost(F.lit(""), x, F.lit(""), y)

    @F.pandas_udf(T.DoubleType())
    def cost(kinds, xs, ys):
        return pd.Series([None if k is None or k != k else costs.rename(int(k), a, b) for k, a, b in zip(kinds, xs, ys)], dtype="float64")

    return cost(kind, x, y)


def tree_pairs(pairs: DataFrame, a: str, b: str, threshold: float, costs: Costs = JSON_COSTS) -> DataFrame:
    """``pairs`` with ``cost`` where it is at most the threshold; other pairs are left out. ``a``, ``b``: names of text columns that have
    profiles beside them (``a_profile``, ``b_profile``). Texts that are no JSON pair with nothing.

    Trees of one shape with a single other label cost its renaming, if that is no more than two other renamings or a deletion and an insertion: without
    those, the nodes are mapped one to one, and the labels' counts leave that renaming alone. Of all other pairs, the exact distance is computed only where the lower bound
    allows it to be in reach, and once for each two texts."""
    near = pairs.filter(F.col(f"{a}_profile.size").isNotNull() & F.col(f"{b}_profile.size").isNotNull())
    p, q = F.col(f"{a}_profile"), F.col(f"{b}_profile")
    near = near.withColumn("__shared", _shared(p, q)).filter(lower_bound(p, q, costs, F.col("__shared")) <= threshold)
    least = min(2 * costs.least, costs.delete + costs.insert)
    other = lambda n, k: F.filter(F.zip_with(p[k], q[k], lambda x, y: F.when(x != y, F.struct(F.lit(n).alias("kind"), x.alias("x"), y.alias("y")))), lambda z: z.isNotNull())
    few = p["size"] - sum(F.col("__shared")[n] for n in range(len(KINDS))) <= 1
    others = F.when((p["shape"] == q["shape"]) & few, F.concat(*[other(n, k) for n, k in enumerate(KINDS)]))
    # A number behind a label means that there are more of it.
    plain_ = ~F.exists("__others", lambda z: z["x"].contains("\0") | z["y"].contains("\0"))
    near = near.withColumn("__others", others)
    near = near.withColumn("__other", F.when((F.size("__others") == 1) & plain_, F.col("__others")[0]).when(F.size("__others") == 0, F.struct(F.lit(None).cast("int").alias("kind"), F.lit("").alias("x"), F.lit("").alias("y"))))
    drop = ("__shared", "__others", "__other", f"{a}_profile", f"{b}_profile")
    one = near.filter("__other IS NOT NULL").withColumn("cost", F.when(F.col("__other.kind").isNull(), 0.0).otherwise(_renamed(costs, F.col("__other.kind"), F.col("__other.x"), F.col("__other.y"))))
    sure = one.filter((F.col("cost") <= least) & (F.col("cost") <= threshold)).drop(*drop)
    rest = near.filter("__other IS NULL")
    if threshold >= least:  # else those that cost more are out of reach anyhow
        rest = rest.unionByName(one.filter(F.col("cost") > least).drop("cost"))
    rest = rest.drop(*drop)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in the pairs, not in their bytes
    texts = rest.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct().repartition(n, "__a", "__b").withColumn("cost", tree_cost(costs)("__a", "__b")).filter(F.col("cost") <= threshold)
    return sure.unionByName(rest.join(texts, (rest[a] == texts["__a"]) & (rest[b] == texts["__b"])).drop("__a", "__b"))


def cheapest(a: Tree, others: Iterator[Tree], costs: Costs = JSON_COSTS) -> float:
    """The least distance of ``a`` to any of the others."""
    return min((tree_distance(a, b, costs) for b in others), default=float("inf"))
