"""Scalar rules on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bomlens.functions import documents as D
from bomlens.functions import scalars as S
from bomlens.operators import rollup as R


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


def v():
    return F.col("v")


@pytest.mark.parametrize("value,want", [("SHA-256@1.2", "sha256"), ("secret-key@6812", "secretkey"), ("", ""), (None, None)])
def test_harmonized(spark, value, want):
    assert one(spark, S.harmonized(v()), value) == want


@pytest.mark.parametrize("value,want", [("a@b@c", "a"), ("@x", ""), (None, "")])
def test_name_before_at(spark, value, want):
    assert one(spark, S.name_before_at(v()), value) == want


@pytest.mark.parametrize("value,strict,loose", [("12.7", 0, 12), ("12", 12, 12), ("x", 0, 0), (None, 0, 0)])
def test_int_coercions(spark, value, strict, loose):
    assert one(spark, S.int_or_zero(v()), value) == strict
    assert one(spark, S.int_or(v()), value) == loose


@pytest.mark.parametrize("value,want", [(5.0, "<5 seconds"), (5.5, "5-5 seconds"), (7.0, "5-10 seconds"), (59.0, "55-60 seconds"), (60.0, "1-2 minutes"), (7200.0, "2-4 hours"), (14400.0, ">4 hours"), (None, "unknown")])
def test_runtime_band(spark, value, want):
    assert one(spark, S.runtime_band(v()), value, "double") == want


@pytest.mark.parametrize("value,want", [(0.0, "0s"), (0.25, "250ms"), (65.0, "1m 05s"), (3600.0, "1h 0m 00s"), (90061.0, "1d 1h 1m 01s"), (None, "0s")])
def test_human_duration(spark, value, want):
    assert one(spark, S.human_duration(v()), value, "double") == want


@pytest.mark.parametrize("value,want", [(None, False), (" Crypto-Asset ", True), ("library", False)])
def test_crypto_type(spark, value, want):
    assert one(spark, S.is_crypto_type(v()), value) is want


@pytest.mark.parametrize("value,want", [("https://github.com/a/b.git/", "a/b.git"), (" a/b ", "a/b"), ("http://x.org/p/q/r", "q/r")])
def test_url_line(spark, value, want):
    assert one(spark, S.owner_and_repo(v()), value) == want


@pytest.mark.parametrize("value,want", [("git@github.com:o/r.git", "github.com/o/r"), ("https://h.org/o/r.git", "h.org/o/r"), ("h/o/r/", "h/o/r")])
def test_host_path(spark, value, want):
    assert one(spark, S.host_path(v()), value) == want


def test_rename_cost(spark):
    assert one(spark, F.round(S.rename_cost(F.lit("k"), F.lit("kitten"), F.lit("k"), F.lit("sitting")), 6), "") == 0.928571
    assert one(spark, S.rename_cost(F.lit("k"), F.lit("a"), F.lit("v"), F.lit("a")), "") == 1e9


def test_hash_bucket_is_the_whole_number(spark):
    import hashlib

    for text in ("", "a", "owner/name"):
        for n in (11, 13):
            assert one(spark, S.hash_bucket(v(), n), text) == int(hashlib.md5(text.encode()).hexdigest(), 16) % n


@pytest.mark.parametrize("value,want", [("", ("{}", "empty_json")), (None, ("{}", "empty_json")), ("{bad", ("{}", "invalid_json")), ("{} x", ("{}", "invalid_json")), ('{ "b": 1 }', ('{"b":1}', None)), ('{"k": "a  b", "a": [1, 2]}', ('{"k":"a  b","a":[1,2]}', None))])
def test_normalized(spark, value, want):
    text, err = D.normalized(v())
    assert (one(spark, text, value), one(spark, err, value)) == want


def test_rollup_of_a_document(spark):
    doc = '{"components":[{"type":"library","name":"cryptography"},{"type":"cryptographic-asset","name":"AES-128@x","cryptoProperties":{"assetType":"algorithm","algorithmProperties":{"primitive":"block-cipher"}}},{"type":"cryptographic-asset","name":"AES-256","cryptoProperties":{"assetType":"algorithm","algorithmProperties":{"primitive":"block-cipher"}}},{"type":"","name":null},7]}'
    rows = D.exploded(spark.createDataFrame([(doc,)], "doc string"), "doc").drop("doc")
    got = {(r["level"], r["type"], r["asset"], r["name"]): r["n"] for r in R.component_rollup(rows).collect()}
    assert got[0, None, None, None] == 5
    assert got[1, "unknown", None, None] == 2
    assert got[2, "cryptographic-asset", "algorithm (block-cipher)", None] == 2
    assert got[3, "cryptographic-asset", "algorithm (block-cipher)", "AES-128"] == 1
    assert got[3, "unknown", "", ""] == 2


@pytest.mark.parametrize("doc", ["", "null", "5", "{}", '{"components":{}}', '{"components":[]}', "{} x"])
def test_documents_without_components(spark, doc):
    assert D.exploded(spark.createDataFrame([(doc,)], "doc string"), "doc").collect()[0]["pos"] is None


@pytest.mark.parametrize("names,want", [([("AES-128", "t1", 1), ("AES-256", "t2", 1)], ("AES (-128, -256)", 1, 1)), ([("AES-128", "t1", 2)], ("AES-128", 2, 0)), ([("AES", "t1", 1), ("AES-128", "t2", 1)], ("AES (-128)", 1, 1)), ([("-x", "t1", 1)], ("-x", 1, 0)), ([("abc-", "t1", 1)], ("abc", 1, 0))])
def test_display_names(spark, names, want):
    rows = spark.createDataFrame([("r", w, "t", "a", n, k) for n, w, k in names], "repo string, worker string, type string, asset string, name string, n long")
    r = R.comparison_table(rows, ["t1", "t2"]).collect()
    assert [(x["name"], x["t1"], x["t2"]) for x in r] == [want]
