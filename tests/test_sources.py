import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from meldwork.functions import schema
from meldwork.operators import clean, merge, project, score
from meldwork.plans import store
from meldwork.plans.engine import Engine
from meldwork.sources import csv_rows, files


def parsed_json(spark, *bodies, kind="ats_json"):
    frame = spark.createDataFrame([("r", str(i), kind, i, b if isinstance(b, bytes) else b.encode()) for i, b in enumerate(bodies)], "run_id string, source_file string, source_type string, file_seq long, content binary")
    return files.parse_files(frame)


def test_json_files_that_are_none(spark):
    bad = [b"\xff", "﻿{}", '{"name": ', '{"name":"a"} x', '{"name":"a"},{"name":"b"}', "[1],[2", "", "[" * 5000, '{"name":"a","name":"b"}']
    got = parsed_json(spark, *bad, "null", "3", "[]").select("file_seq", "kind", F.split("error", ":")[0].alias("e")).orderBy("file_seq").collect()
    assert [(r["file_seq"], r["kind"], r["e"]) for r in got] == [(i, "error", "UnicodeDecodeError" if i == 0 else "RecursionError" if i == 7 else "JSONDecodeError") for i in range(len(bad))]


def test_json_records_that_cannot_be_used(spark):
    body = r'[{"name":"ok"},{"name":"😀"},{"name":"x \ud800"},{"name":"\udc00 y"},{"name":"a\\ud800"},{"name":"n","headline":5},{"name":"n","yoe":Infinity},{"name":"n","yoe":3e9},{"name":"n","degrees":[{"school":"s","endYear":1e12}]},{"name":0},7,{"name":NaN}]'
    rows = parsed_json(spark, body).orderBy("row_seq").collect()
    assert [(r["row_seq"], r["full_name"]) for r in rows if r["kind"] == "json"] == [(0, "ok"), (1, "😀"), (4, r"a\ud800")]
    assert [(r["row_seq"], r["error"]) for r in rows if r["kind"] == "error"] == [(2, "record 2: half a character"), (3, "record 3: half a character"), (5, "record 5: headline isn't a text"), *((i, f"record {i}: a number is too large") for i in (6, 7, 8))]


def test_json_values(spark):
    body = json.dumps([
        {"name": {"a": [1, None, True, "x, y"]}, "yoe": " 7.9 ", "education": [{"school": True, "endYear": 2011.9}, {"degree": "d", "endYear": "2011.5"}]},
        {"name": "  y  ", "years_experience": -3.7, "skills": "a, b ,,c", "positions": [{"title": 5, "startDate": {"year": 2020, "month": 3}}, {"title": "t", "start": "x", "end": {"year": 2021, "month": None}}, {"summary": "no"}]},
        {"name": ["@"], "emails": {"a": 1}, "phones": 7, "skills": [{"name": None}, {"skill": 3}, {"x": 1}, None]},
    ])
    a, b, c = parsed_json(spark, body).orderBy("row_seq").collect()
    assert (a["full_name"], a["years_experience"]) == ("{'a': [1, None, True, 'x, y']}", 7)
    assert [tuple(e) for e in a["education"]] == [("True", None, None, 2011), (None, "d", None, None)]
    assert (b["full_name"], b["years_experience"], b["skills"]) == ("y", -3, ["a", "b", "c"])
    assert [tuple(e) for e in b["experience"]] == [(None, "5", "2020-03", None, None), (None, "t", "x", "2021-None", None)]
    assert (c["full_name"], c["emails"], c["phones"], c["skills"]) == ("['@']", [], [], ["None", "3"])


def test_json_is_read_without_python_and_once(spark):
    plan = files.extract(parsed_json(spark, '{"name":"a"}'))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1


def test_large_json_is_cut_before_it_is_parsed(spark, monkeypatch):
    from meldwork.sources import json_records

    monkeypatch.setattr(json_records, "LARGE", 40)
    rows = [{"name": f"n{i}", "skills": ["x"] * 9} for i in range(30)]
    got = parsed_json(spark, json.dumps(rows), json.dumps({"candidates": rows})).orderBy("file_seq", "row_seq").collect()
    assert [(r["file_seq"], r["row_seq"], r["full_name"]) for r in got] == [(f, i, f"n{i}") for f in (0, 1) for i in range(30)]


@pytest.fixture
def many(tmp_path):
    rnd = random.Random(4)
    cells = ["a", "Zoë", "1,5", 'say "hi"', "", "NA", " x ", "0x", "b;c", "日本"]
    for k, end in enumerate(["\n", "\r\n", "\n", "\n"]):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["Name", " Email ", "name", "skills"][: 4 - k % 2])
        for i in range(400):
            writer.writerow([rnd.choice(cells) for _ in range(rnd.choice([2, 3, 4, 5]))] if i % 50 else [])
        (tmp_path / f"f {k}.csv").write_bytes(out.getvalue().encode("utf-16-le" if k == 9 else "utf-8-sig" if k == 2 else "latin-1" if k == 3 else "utf-8", "replace"))
    (tmp_path / "lines.csv").write_text('name,email\n"A\nB",x\nC,y\n')
    (tmp_path / "UPPER.CSV").write_text("name\nU\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("name,email")
    return tmp_path


def test_csv_by_lines_equals_the_whole_file(spark, many):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        found = files.read_files(spark, str(many))
        got = files.parse_files(found, None, str(many)).filter("kind = 'csv'").orderBy("file_seq", "row_seq").select("source_file", "cells", "row_seq").collect()
        assert csv_rows.text_lines(spark, str(many)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by_file = {}
    for r in got:
        by_file.setdefault(r["source_file"], []).append(r["cells"])
    want = {p.name: [r["cells"] for r in csv_rows.whole_rows(p.read_bytes())] for p in many.iterdir()}
    assert by_file == {k: v for k, v in want.items() if v}
    assert len({(r["source_file"], r["row_seq"]) for r in got}) == len(got)
    assert [r["name"] for r in by_file["lines.csv"]] == ["A\nB", "C"]


def test_contents_are_not_shuffled(spark, many):
    (many / "n.txt").write_text("Name: Ann")
    plan = files.read_files(spark, str(many)).select("source_file", "content")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or "Exchange SinglePartition" in line]
    assert all("content" not in line for line in dealt)
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize(
    ("module", "name", "stage"),
    [(merge, "merge", "Merge"), (merge, "candidates", "Conflict Resolution"), (score, "confidence", "Confidence"), (project, "project_json", "Projection"), (score, "validate", "Validation"), (clean, "canonicalize", "Canonicalization"), (clean, "parse", "Parsing")],
)
@pytest.mark.parametrize("when", ["planned", "run"])
def test_the_run_goes_on_after_any_stage(spark, monkeypatch, module, name, stage, when):
    rows = [("r", "a.csv", "recruiter_csv", 0, 0, "Ann", ["K8S"]), ("r", "b.json", "ats_json", 1, 0, "Ann B", ["js"])]
    records = schema.as_records(spark.createDataFrame(rows, "run_id string, source_file string, source_type string, file_seq long, row_seq long, full_name string, skills array<string>"), "run_id")
    real = getattr(module, name)

    def broken(*args, **more):
        if when == "planned":
            raise ValueError("broken")
        return real(*args, **more).filter(F.expr("raise_error('broken')").cast("boolean"))

    monkeypatch.setattr(module, name, broken)
    out = Engine(spark, countries={}).consolidate(records, {"fields": [{"path": "full_name"}]})
    assert stage in {s.name for s in out.stages if s.status == "error"}
    assert {s.name for s in out.stages if s.status == "error"} <= {stage, "Normalization", "Canonicalization"}
    assert any(e["level"] == "ERROR" and "broken" in e["message"] and e["stage"] == stage for e in out.log)
    row = out["canonical"].first()
    assert row["full_name"] == ("" if stage == "Merge" else "Ann")
    assert out["records"].count() == 2
    for table in out.tables.values():
        table.collect()
    out.release()


def test_stage_lookup_and_all_warnings(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.xyz").write_text("?")
    (tmp_path / "a.csv").write_text("name,yoe\nAnn,3\nBob,inf\n")
    out = Engine(spark, countries={}, keep_messages=5).run(str(tmp_path))
    assert out.stage("merge") is out.stage(out.stage("Merge").index)
    with pytest.raises(KeyError):
        out.stage("none")
    assert (out.stage("Input Detection").warning_count, len(out.stage("Input Detection").warnings)) == (30, 5)
    assert out["warnings"].groupBy("stage").count().collect() and out["warnings"].filter("stage = 'Input Detection'").count() == 30
    assert [r["warning"] for r in out["warnings"].filter("stage = 'Extraction'").collect()] == ["a.csv: row 1: years of experience are infinite"]
    assert out["counters"].first()["warnings"] == 31


def test_runs_count_once_they_are_whole(spark, tmp_path):
    one, two = spark.range(1), spark.range(2)
    store.write({"t": one}, str(tmp_path), "run10")
    store.write({"t": two}, str(tmp_path), "run9")
    assert store.read(spark, str(tmp_path))["t"].count() == 2
    assert store.read(spark, str(tmp_path), "run10")["t"].count() == 1
    (tmp_path / "run99" / "x" / "t").mkdir(parents=True)  # a write that was killed
    assert store.read(spark, str(tmp_path))["t"].count() == 2
    with pytest.raises(Exception, match="broken"):
        store.write({"t": spark.range(3), "u": spark.range(1).select(F.expr("raise_error('broken')").cast("string").alias("x"))}, str(tmp_path), "run11")
    assert [m["run_id"] for m in store.runs(spark, str(tmp_path))] == ["run10", "run9"]
    store.write({"t": spark.range(4)}, str(tmp_path), "run10")
    assert store.read(spark, str(tmp_path))["t"].count() == 4
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "none"))


def test_chains_end_with_the_conflicts(spark):
    rows = [("r", "a.csv", "recruiter_csv", 0, 0, "Ann", "India"), ("r", "b.json", "ats_json", 1, 0, "Ann B", "uk of x")]
    records = schema.as_records(spark.createDataFrame(rows, "run_id string, source_file string, source_type string, file_seq long, row_seq long, full_name string, country string"), "run_id")
    out = Engine(spark, countries={}).consolidate(records)
    got = {r["field"]: r for r in out["chains"].collect()}
    assert (got["full_name"]["total"], got["full_name"]["final"], got["full_name"]["steps"][0]["before"]) == (1, "Ann", '["Ann","Ann B"]')
    assert [s["stage"] for s in got["location.country"]["steps"]] == ["normalization", "normalization"]
    totals = {r["field"]: (r["total"], r["final"]) for r in clean.chain_totals(out["rule_log"], "run_id", conflicts=out["conflicts"]).collect()}
    assert totals == {k: (r["total"], r["final"]) for k, r in got.items()}


def test_ranks_over_ranges_equal_the_window(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, "a", "b"]) if i % 3 else "hot", rnd.choice("fg"), (rnd.randint(1, 3), i), f"v{i}") for i in range(900)]
    frame = spark.createDataFrame(rows, "entity string, field string, o struct<p:int,i:int>, value string").repartition(5)
    head = F.struct("value", "o.p")
    got = merge.ranked_by_range(frame, ["entity", "field"], "o", head, parts=9)
    want = merge.ranked_by_window(frame, ["entity", "field"], "o", head)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    placed = [p for p in got.inputFiles() if "ranges" in p]
    assert len(placed) >= 8
    one = spark.read.parquet(*placed).filter("entity = 'hot' AND field = 'f'").select("_range").distinct().count()
    assert one >= 2
    assert merge.ranked_by_range(frame.limit(0), ["entity", "field"], "o", head).count() == 0


def test_an_engine_that_spreads_gives_the_same(spark):
    rows = [("r", f"f{i % 3}.csv", "recruiter_csv" if i % 2 else "ats_json", i % 3, i, f"Ann {i % 5}", None if i % 4 else "h") for i in range(60)]
    records = schema.as_records(spark.createDataFrame(rows, "run_id string, source_file string, source_type string, file_seq long, row_seq long, full_name string, headline string"), "run_id")
    one, two = (Engine(spark, countries={}, spread=n).consolidate(records) for n in (10, 1000))
    for table in ("candidates", "conflicts", "field_provenance", "canonical", "output"):
        assert sorted(map(str, one[table].collect())) == sorted(map(str, two[table].collect()))
