"""Functions on whole JSON values whose key order or depth VARIANT can't keep: Arrow batches of texts, texts out.

Text that is no JSON gives null."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _on_texts(f: Callable[[Any], Any], kind: T.DataType) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts):
        def one(t):
            try:
                return f(json.loads(t))
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run


def _dumped(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def mapped(value: Any, leaf: Callable[[Any], Any]) -> Any:
    """The value with every leaf replaced; keys stay as they are."""
    if isinstance(value, dict):
        return {k: mapped(v, leaf) for k, v in value.items()}
    if isinstance(value, list):
        return [mapped(v, leaf) for v in value]
    return leaf(value)


def harmonized_text(s: Any) -> Any:
    if not isinstance(s, str):
        return s
    lines = "\n".join(line.split("@", 1)[0] for line in s.lower().split("\n"))
    return "".join(c for c in lines if c.isascii() and c.isalnum())


def found(value: Any, key: str) -> tuple[list[str], Any] | None:
    """The path and value of the first key of this name in document order, whatever its case; lists add nothing to a path."""
    todo: list[tuple[list[str], Any]] = [([], value)]
    while todo:
        path, v = todo.pop()
        if path and path[-1].lower() == key and isinstance(v, _Hit):
            return path, v.value
        v = v.value if isinstance(v, _Hit) else v
        if isinstance(v, dict):
            todo += [(path + [k], _Hit(w)) for k, w in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(path, w) for w in reversed(v)]
    return None


class _Hit:
    """A value that stands under a key itself, not in a list under it."""

    __slots__ = ("value",)

    def __init__(self, value: Any):
        self.value = value


def placed(target: dict, path: list[str], value: Any) -> dict:
    """Set a value at a path; what isn't an object on the way is replaced by one."""
    at = target
    for k in path[:-1]:
        if not isinstance(at.get(k), dict):
            at[k] = {}
        at = at[k]
    at[path[-1]] = value
    return target


def minimal(component: Any) -> dict | None:
    """Type and name, and the first asset type and primitive wherever they stand, at their own paths, harmonized. Null
    for what is no object."""
    if not isinstance(component, dict):
        return None
    out: dict = {k: component[k] for k in ("type", "name") if k in component}
    for key in ("assettype", "primitive"):
        hit = found(component, key)
        if hit:
            placed(out, *hit)
    return mapped(out, harmonized_text)


def lowered(component: Any) -> dict:
    """P10: type, name and crypto properties, their strings in lower case; lists directly in lists stay as they are."""

    def low(v: Any, in_list: bool = False) -> Any:
        if isinstance(v, str):
            return v.translate(_LOWER)
        if isinstance(v, dict):
            return {k: low(w) for k, w in v.items()}
        if isinstance(v, list) and not in_list:
            return [low(w, True) for w in v]
        return v

    return {k: low(component[k]) for k in ("type", "name", "cryptoProperties") if k in component}


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def leaf_paths(value: Any) -> list[str]:
    """The way to each leaf and its value, joined by slashes; lists add nothing."""
    out, todo = [], [([], value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(path + [str(k)], w) for k, w in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(path, w) for w in reversed(v)]
        else:
            out.append("/".join([*path, str(v)]))
    return out


def with_context(report: Any) -> Any:
    """Every region of an analysis report gets a context region beside and inside it, and both a snippet."""
    for run in report.get("runs") or []:
        for result in run.get("results") or []:
            for place in [*(result.get("locations") or []), *(result.get("relatedLocations") or [])]:
                physical = (place or {}).get("physicalLocation")
                region = physical.get("region") if isinstance(physical, dict) else None
                if not isinstance(region, dict) or not region:
                    continue
                bare = dict(region)
                physical.setdefault("contextRegion", dict(bare))
                region.setdefault("contextRegion", dict(bare))
                for r in (region, physical["contextRegion"]):
                    if isinstance(r, dict) and not isinstance(r.get("snippet"), dict):
                        r["snippet"] = {"text": ""}
    return report


def unwrapped(value: Any) -> str:
    """The document inside its ``bom`` wrapper, keys sorted, two spaces deep."""
    if isinstance(value, dict) and isinstance(value.get("bom"), dict):
        value = value["bom"]
    return json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True)


harmonized_json = _on_texts(lambda v: _dumped(mapped(v, harmonized_text)), T.StringType())
minimal_json = _on_texts(lambda v: _dumped(m) if (m := minimal(v)) is not None else None, T.StringType())
lowered_json = _on_texts(lambda v: _dumped(lowered(v)) if isinstance(v, dict) else None, T.StringType())
paths_of = _on_texts(leaf_paths, T.ArrayType(T.StringType()))
context_regions = _on_texts(lambda v: _dumped(with_context(v)) if isinstance(v, dict) else _dumped(v), T.StringType())
pretty = _on_texts(unwrapped, T.StringType())


def key_path(text: Column, key: str) -> Column:
    """J06 on a column: the path of the first such key, joined by dots."""
    return _on_texts(lambda v: ".".join(hit[0]) if (hit := found(v, key.lower())) else None, T.StringType())(text)
