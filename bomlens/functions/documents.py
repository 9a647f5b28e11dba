"""Loosely structured JSON documents as components.

Text is parsed as VARIANT where only values matter, and kept as text where key order or spelling does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import asset_label, name_before_at, type_label

#: Where a components list may stand: for counting, and for matching, which takes a list of documents too.
COUNTED_ROOTS = ("$.components", "$.bom.components", "$[0].bom.components")
MATCHED_ROOTS = (*COUNTED_ROOTS, "$[0].components")


def parsed(text: Column) -> Column:
    """Null for text that is no JSON, for empty text and for text after the document's end."""
    whole = F.trim(text)
    closed = F.when(whole.startswith("{"), whole.endswith("}")).when(whole.startswith("["), whole.endswith("]")).otherwise(F.lit(True))
    return F.when(closed, F.try_parse_json(text))


def normalized(text: Column) -> tuple[Column, Column]:
    """The compact text with its keys in order, and what is wrong: empty_json or invalid_json."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    good = parsed(text).isNotNull()
    # White space outside strings: strings are matched first and kept.
    compact = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|\s+', "$1")
    return F.when(blank | ~good, "{}").otherwise(compact), F.when(blank, "empty_json").when(~good, "invalid_json")


def components(doc: Column, roots: tuple[str, ...] = COUNTED_ROOTS) -> Column:
    """The list of components, an empty one if no root holds a list."""
    return F.coalesce(*[F.try_variant_get(doc, r, "array<variant>") for r in roots], F.array().cast("array<variant>"))


def field(component: Column, path: str) -> Column:
    return F.try_variant_get(component, path, "string")


def exploded(docs: DataFrame, text: str, roots: tuple[str, ...] = COUNTED_ROOTS) -> DataFrame:
    """One row per component with its place, and one with a null place for a document without any."""
    rows = docs.withColumn("__c", components(parsed(F.col(text)), roots))
    rows = rows.select(*docs.columns, F.posexplode_outer("__c").alias("pos", "component"))
    kind, name = field(F.col("component"), "$.type"), field(F.col("component"), "$.name")
    asset, primitive = field(F.col("component"), "$.cryptoProperties.assetType"), field(F.col("component"), "$.cryptoProperties.algorithmProperties.primitive")
    some = F.col("pos").isNotNull()
    return rows.select(*docs.columns, "pos", F.when(some, type_label(kind)).alias("type"), F.when(some, asset_label(asset, primitive)).alias("asset"), F.when(some, name_before_at(name)).alias("name"))


def minimized(component: Column) -> Column:
    """P03 for known paths: type, name, asset type and primitive, harmonized, as JSON text without missing parts."""
    from .scalars import harmonized

    f = lambda p: harmonized(field(component, p))
    primitive = f("$.cryptoProperties.algorithmProperties.primitive")
    asset = f("$.cryptoProperties.assetType")
    props = F.when(asset.isNotNull() | primitive.isNotNull(), F.struct(asset.alias("assetType"), F.when(primitive.isNotNull(), F.struct(primitive.alias("primitive"))).alias("algorithmProperties")))
    return F.to_json(F.struct(f("$.type").alias("type"), f("$.name").alias("name"), props.alias("cryptoProperties")))


def included(text: Column, types: list[str]) -> Column:
    """The document without components of other types; unchanged text if there is nothing to drop, no type to
    include, or no document to read."""
    doc = parsed(text)
    have = components(doc)
    keep = F.filter(have, lambda c: F.coalesce(F.lower(F.trim(field(c, "$.type"))).isin([t.lower() for t in types]), F.lit(False)))
    if not types:
        return text
    return F.when(doc.isNull() | (F.size(keep) == F.size(have)), text).otherwise(F.concat(F.lit('{"components":['), F.array_join(F.transform(keep, lambda c: F.to_json(c)), ","), F.lit("]}")))


def fenced(text: Column) -> Column:
    """The JSON inside a fenced answer; a list becomes a document of its components."""
    inner = F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), text))
    return F.when(inner.startswith("["), F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.6","components":'), inner, F.lit("}"))).otherwise(inner)


def sarif_results(text: Column) -> Column:
    """Results over all runs of an analysis report."""
    runs = F.coalesce(F.try_variant_get(parsed(text), "$.runs", "array<variant>"), F.array().cast("array<variant>"))
    return F.aggregate(runs, F.lit(0), lambda n, r: n + F.coalesce(F.size(F.try_variant_get(r, "$.results", "array<variant>")), F.lit(0)))
