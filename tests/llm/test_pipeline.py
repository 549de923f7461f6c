import duckdb
import pytest
from pathlib import Path

import corpus_pipeline
from meldwork.llm.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(SF)), f"test-{name}")
        assert docs.columns == columns
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        assert (after == before) == (name == "line_dedup") or name == "near_dedup"
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == before


def test_registered_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


def test_line_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(map(tuple, con.execute(ORACLES["op1_line_dedup"]).fetchall()))
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in QUERIES["op1_line_dedup"](spark, str(SF)).collect()) == want


def test_near_dedup_of_null_and_equal_ids(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    made = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("c")), (7, text("d")), (9, text("d")), (None, text("c")), (None, ""), (None, None), (3, "")]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, frame, "").collect()), key=str)
    assert got == sorted([(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (None, ""), (None, None), (3, "")], key=str)


def test_stages_keep_null_ids_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    words = lambda x: " ".join(f"{x}{i}" for i in range(60))
    frame = spark.createDataFrame([(None, words("a")), (1, words("b")), (2, words("b")), (3, None), (4, "")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    clash = ["_row", "_found_id", "_kept_row", "_keep", "_low", "_host", "_drops", "_drop_id", "c0", "a.b"]
    frame = frame.withColumns({c: F.lit(c) for c in clash})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(SF))
        if name in ("quality", "line_dedup"):
            clash = [c for c in clash if c != "_keep"] if name == "quality" else clash
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in clash if c in out.columns)
        assert any(r["doc_id"] is None for r in rows) and out.columns[:2] == ["doc_id", "text"]


def _shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_dedup_leaves_texts_in_place(spark, tmp_path):
    """Only texts that may have near copies or may go are moved, also where no table is small enough to be broadcast unasked."""
    import random

    rnd = random.Random(3)
    made = [(i, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(900))) for i in range(300)]
    made += [(300 + i, made[i][1] + " again") for i in range(10)]
    spark.createDataFrame(made, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    frame = spark.read.parquet(f"{tmp_path}/d")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = _shuffled(spark)
        got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()]
        moved = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(got) == list(range(300))
    assert moved < sum(len(t) for _, t in made) / 2


def test_among_and_without_equal_plain_joins(spark, monkeypatch):
    """The bitmap decides nothing: with 64 bits for 400 keys, with null keys, and with two keys."""
    from pyspark.sql import functions as F

    from meldwork.llm import components

    rows = spark.range(2000).select(F.when(F.col("id") % 9 > 0, F.col("id") % 700).alias("a"), (F.col("id") % 3).alias("b"), F.col("id").alias("n"))
    table = components.written(spark.range(0, 1200, 3).select(F.col("id").alias("a"), (F.col("id") % 2).alias("b")), "test-keys")
    for bits in (64, components.MOST_BITS):
        monkeypatch.setattr(components, "MOST_BITS", bits)
        for keys in (["a"], ["a", "b"]):
            for f, how in ((components.among, "left_semi"), (components.without, "left_anti")):
                got = f(rows, table, keys)
                assert got.columns == rows.columns
                assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in rows.join(table, keys, how).collect())
    assert components.without(rows, components.written(table.limit(0), "test-none"), ["a"]).count() == 2000
