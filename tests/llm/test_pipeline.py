from __future__ import annotations

import corpus_pipeline
from bomlens.llm.shared import written

from ..conftest import SMALL


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 0 and docs.select("doc_id").distinct().count() <= counts[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.filter("start = 0").count() == counts[3]


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, shard int, row_id string, copies int"


def _odd(spark):
    """Nulls in every column, empty, blank and long texts, near and exact copies, a repeated id and repeated rows, and clashing names."""
    near = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(near)), (2, " ".join([*near[:59], "other"])), (3, None), (4, ""), (5, " \n "), (6, "word " * 20_000), (None, "no id here"), (7, "same row"), (7, "same row"), (8, "one text of an id"), (8, "quite another one"), (9, " ".join(near)), (10, "no source at all")]
    rows = [(i, t, None if i == 3 else "en", None if i in (3, 10, None) else f"s{(i or 0) % 3}", len(t) if t else None, 0.5, 1, 2, "x", None) for i, t in texts]
    return spark.createDataFrame(rows, ODD).repartition(3)


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for docs, empty in ((_odd(spark), False), (_odd(spark).limit(0), True)):
        for name in ("toxicity", "near_duplicates", "mixing"):
            out = stages[name](spark, docs, str(tmp_path))
            assert out.schema.names == docs.schema.names
            assert (out.count() == 0) if empty else out.count() > 0
        assert (stages["packing"](spark, docs, str(tmp_path)).count() == 0) == empty
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in stages["near_duplicates"](spark, _odd(spark), str(tmp_path)).collect())
    ids = [i for i, _ in kept]
    assert ids.count("1") == 1 and "2" not in ids and "9" not in ids and ids.count("7") == 1 and ids.count("8") == 2 and {"3", "4", "5", "6", "10", "None"} <= set(ids)


def test_the_mix_takes_its_targets_and_reruns_agree(spark, tmp_path):
    rows = [(i, f"{'alpha beta gamma ' * (i % 40 + 1)}", "en", f"s{i % 3}", None, 0.0, 0, 0, "", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, ODD)
    got = [sorted((r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.mix_sources(spark, docs.repartition(k), str(tmp_path)).collect()) for k in (1, 7)]
    assert got[0] == got[1]
    size = {i: len(t.split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, *_ in rows}
    per = {s: sum(n for i, n in size.items() if source[i] == s) for s in ("s0", "s1", "s2")}
    taken = {s: sum(len(t.split()) for i, t, _ in got[0] if source[i] == s) for s in per}
    assert abs(sum(taken.values()) - 1.5 * sum(per.values())) <= 3 and all(taken[s] <= 2 * per[s] for s in per)
    assert all(n == len(t) for _, t, n in got[0])
