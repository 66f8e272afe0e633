"""The pipeline's stages against plain versions."""

import os
from collections import Counter

import pytest
from helpers import documents
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from orefield.llm import mixing, sharding  # noqa: E402
from orefield.llm.common import shared_dir, stage, table  # noqa: E402


def test_stages(spark, data):
    from test_operators import plain_components, plain_hits

    docs = table(spark, data, "documents")
    for name, function in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(function(spark, docs, data), f"test-{name}")
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name == "near_duplicates":
            assert sorted(i for i, _ in got) == sorted(i for i, _, c in plain_components(rows, 5, 80) if i == c or c is None)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
            assert sorted(i for i, _ in got) == sorted(h[0] for h in plain_hits(rows, items) if not h[5])
        if name in ("quality", "near_duplicates", "decontamination"):
            assert not Counter(got) - Counter(rows) and out.columns == docs.columns
        if name == "mixing":
            assert set(got) <= set(rows) and max(Counter(got).values()) <= 3 and out.columns == docs.columns
        if name == "sharding":
            assert sorted(got) == sorted(rows) and out.columns == [*docs.columns, "size", "shard", "slot"]
        docs = out


def test_run_gives_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.where(F.col("shard").between(0, 23)).count() == out.count() > 0


def files_in(folder):
    return {f for f in os.listdir(folder) if not f.startswith(".")}


def test_run_deletes_what_it_no_longer_reads(spark, data):
    folder = shared_dir(spark).removeprefix("file:")
    before = files_in(folder)
    corpus_pipeline.run(spark, data)
    left = {f.rsplit("-", 1)[0] for f in files_in(folder) - before}
    assert left == {"pipeline-mixing", "shard-keys", "shard-order"}


def test_stages_of_empty_tables(spark, data, tmp_path):
    docs = table(spark, data, "documents").where("false")
    columns = docs.columns
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, data), "test-empty")
    assert docs.count() == 0 and docs.columns == [*columns, "size", "shard", "slot"]
    for name in ("labels", "benchmark"):
        table(spark, data, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = documents(spark)
    for name, function in corpus_pipeline.STAGES[:3]:
        out = stage(function(spark, docs, str(tmp_path)), "test-empty")
        assert out.columns == docs.columns and (name == "near_duplicates" or out.count() == docs.count())
        docs = out


def test_mixing_and_sharding_stages_against_plain_versions(spark):
    """What the last two stages return is what mix and shard of the same rows say."""
    from test_operators import plain_shards

    rows = [(k, f"word{k % 37} " * (1 + k * 7 % 50)) for k in range(300)]
    docs = documents(spark, rows)
    plan = {r.doc_id: r for r in mixing.mix(docs, shapes=mixing.CURRICULUM).collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    got = [r.doc_id for r in mixed.collect()]
    assert Counter(got) == {i: r.copies for i, r in plan.items() if r.copies}
    first = [i for i in dict.fromkeys(got) if i in plan]
    places = [plan[i].position for i in first]
    assert places == sorted(places)  # in training order
    sharded = corpus_pipeline.STAGES[4][1](spark, docs, "")
    want = plain_shards(sharding.keyed(docs).collect(), 24)
    assert sorted((r.doc_id, r.size, r.shard, r.slot) for r in sharded.collect()) == sorted(want)


def test_stages_of_odd_cases(spark, data):
    docs = documents(spark).withColumns({"n_words": F.lit(1), "contaminated": F.lit("no"), "position": F.lit(2)})
    columns = docs.columns
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, data), "test-odd")
    assert docs.count() > 0 and docs.columns == [*("size_input" if c == "size" else c for c in columns), "size", "shard", "slot"]
    assert all(r.n_words == 1 and r.contaminated == "no" and r.position == 2 and r._maybe for r in docs.collect())
