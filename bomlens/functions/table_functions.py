"""Table functions for SQL: n-way matching with an exchangeable cost model, and producers over a table of jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from bomlens.operators.assigning import THRESHOLD, match_edges
from bomlens.operators.trees import JSON_COSTS, Costs, Tree, tree_distance

from . import registry

#: Cost models by name; users add their own before they register the functions.
COST_MODELS: dict[str, Costs] = {"json": JSON_COSTS, "unit": Costs(rename=lambda kind, a, b: float(a != b), least=1.0)}


def _matching(pivot: bool, models: dict[str, Costs]):
    class Match:
        """The components of one project: columns file, component, text, and the project's own ones, which are the result's first columns. Texts that are no JSON
        match nothing. A chain is named by its first member; a member's cost is the least of its matches."""

        def __init__(self):
            self.rows: list[Row] = []
            self.model, self.threshold = "json", THRESHOLD

        @staticmethod
        def analyze(elements: AnalyzeArgument, cost: AnalyzeArgument | None = None, threshold: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not elements.isTable:
                raise ValueError("the first argument is a table: TABLE(...) PARTITION BY the project")
            there = {f.name: f.dataType for f in elements.dataType.fields}
            if missing := {"file", "component", "text"} - there.keys():
                raise ValueError(f"the table lacks {sorted(missing)}")
            if cost is not None and cost.value not in models:
                raise ValueError(f"no cost model {cost.value!r}; there are {sorted(models)}")
            schema = StructType()
            for name, kind in there.items():
                if name not in ("file", "component", "text"):
                    schema = schema.add(name, kind)
            return AnalyzeResult(schema.add("chain", StringType()).add("file", LongType()).add("component", LongType()).add("cost", DoubleType()))

        def eval(self, elements: Row, cost: str = "json", threshold: float = THRESHOLD) -> None:
            self.rows.append(elements)
            self.model, self.threshold = cost, float(threshold)

        def terminate(self) -> Iterator[tuple]:
            files: dict[int, list[tuple[int, Tree]]] = {}
            own: tuple = ()
            for r in self.rows:
                d = r.asDict()
                own = tuple(v for k, v in d.items() if k not in ("file", "component", "text"))
                tree = Tree.read(d["text"])
                if tree is not None:
                    files.setdefault(int(d["file"]), []).append((int(d["component"]), tree))
            first = min(files, key=lambda f: (-len(files[f]), f), default=None)
            label: dict[tuple[int, int], tuple[int, int]] = {}
            least: dict[tuple[int, int], float] = {}
            root = lambda x: x if label[x] == x else root(label[x])
            for f in sorted(files):
                for g in sorted(files):
                    if f == g or (pivot and f != first):
                        continue
                    a, b = sorted(files[f], key=lambda c: c[0]), sorted(files[g], key=lambda c: c[0])
                    i, j = (x.ravel() for x in np.indices((len(a), len(b))))
                    cost = np.array([tree_distance(a[x][1], b[y][1], models[self.model]) for x, y in zip(i, j)])
                    at, _, _ = match_edges(i, j, cost, len(a), len(b))
                    for x, y in enumerate(at):
                        c = float(cost[x * len(b) + y]) if y >= 0 else float("inf")
                        if c <= self.threshold:
                            ends = [(f, a[x][0]), (g, b[y][0])]
                            for e in ends:
                                label.setdefault(e, e)
                                least[e] = min(c, least.get(e, c))
                            low, high = sorted(map(root, ends))
                            label[high] = low
            for e in sorted(label):
                f, c = root(e)
                yield (*own, f"{f}:{c}", *e, least[e])

    return Match


def _producing(name: str, produce: Callable):
    class Produce:
        """A producer over the rows of a table of jobs, each with a job_id. A failure is a row with its error."""

        def eval(self, job: Row) -> Iterator[tuple]:
            began = time.monotonic()
            d = job.asDict()
            try:
                got = produce(d)
                text, seconds = got if isinstance(got, tuple) else (got, time.monotonic() - began)
                yield str(d["job_id"]), name, "ok", text, float(seconds), len(text.encode()), None
            except TimeoutError as e:
                yield str(d["job_id"]), name, "timeout", "{}", time.monotonic() - began, 0, str(e)
            except Exception as e:  # noqa: BLE001  what a plug-in raises is its result
                yield str(d["job_id"]), name, "error", "{}", time.monotonic() - began, 0, str(e)

    return Produce


def register(spark: SparkSession) -> None:
    """``n_way_match_pivot`` and ``n_way_match_all`` (``TABLE(...) PARTITION BY project``, ``cost => name``, ``threshold => number``), and ``produce_<name>``
    (``TABLE(jobs)``) for each producer."""
    models = dict(COST_MODELS)
    spark.udtf.register("n_way_match_pivot", udtf(_matching(True, models)))
    spark.udtf.register("n_way_match_all", udtf(_matching(False, models)))
    for name, f in registry.PRODUCERS.items():
        spark.udtf.register(f"produce_{name}", udtf(_producing(name, f), returnType=registry.RESULT))
