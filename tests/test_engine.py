import io
import json
import zipfile

import pytest

from meldwork.functions import schema
from meldwork.operators import clean, merge, project, score
from meldwork.plans.engine import Engine
from meldwork.sources import files as sources
from meldwork.streaming import ingest

CSV = 'name,email,phone,current_title,current_company,skills,city,country,years_experience\nAnn Lee,ann@x.io,98765-43210,Dev,Acme,"js, python",Pune,India,8.7\nBob Ray,bob@x.io,,,,,,IN,inf\n,no@name.io,,,,,,,\nCy Fox,NA,+91-9988776655,,,Go,,,x\n'
ATS = {"candidates": [{"name": None, "candidate_name": "X"}, {"candidateName": "Ann Lee", "emailAddress": "ANN@y.io", "jobTitle": "Lead", "skillList": ["a", 5, {"skill": "b"}], "workExperience": [{"companyName": "Z", "position": "P", "startDate": {"year": 2020}}], "yearsExperience": "9.9", "linkedinUrl": "https://linkedin.com/in/a"}, {"name": "Bad", "headline": 5}, {"name": "Inf", "yoe": "inf"}, 7]}
LINKEDIN = {"firstName": "Ann", "lastName": "Lee", "headline": "Boss", "location": {"name": "Goa", "country": "India"}, "skills": [{"name": "k8s"}]}
NOTES = "Name: Ann Lee, candidate\nPhone: 011-2345-6789\nLikes python and sql."


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    for name, body in {"a.csv": CSV.encode(), "b.json": json.dumps(ATS).encode(), "c.json": json.dumps(LINKEDIN).encode(), "d.txt": NOTES.encode(), "e.docx": docx(["Ann Lee", "ann@z.io", "Skills", "docker"]), "f.pdf": b"no pdf", "g.xyz": b"?"}.items():
        (d / name).write_bytes(body)
    return str(d)


@pytest.fixture(scope="module")
def result(spark, folder):
    return Engine(spark, countries={}).run(folder, {"fields": [{"path": "full_name"}, {"path": "mail", "from": "emails[0]"}, {"path": "none", "from": "phones[9]"}, {"path": "s", "from": "skills[].name"}], "on_missing": "omit"}, "r1")


def test_sources(spark, folder, result):
    kinds = {r["source_file"]: r["source_type"] for r in result["files"].collect()}
    assert kinds == {"a.csv": "recruiter_csv", "b.json": "ats_json", "c.json": "linkedin_json", "d.txt": "recruiter_notes", "e.docx": "resume_docx", "f.pdf": "resume_pdf", "g.xyz": "unknown"}
    rows = result["records"].orderBy("file_seq", "row_seq").collect()
    assert [(r["source_file"], r["full_name"]) for r in rows] == [("a.csv", "Ann Lee"), ("a.csv", "Cy Fox"), ("b.json", "Ann Lee"), ("c.json", "Ann Lee"), ("d.txt", "Ann Lee"), ("e.docx", "Ann Lee")]
    assert rows[0]["years_experience"] == 8
    assert (rows[1]["years_experience"], rows[1]["emails"]) == (None, [])
    assert (rows[2]["skills"], rows[2]["years_experience"]) == (["A", "B"], 9)
    assert rows[2]["experience"][0]["start"] == "2020-00"
    assert {r["source_file"]: r["error"].split(":")[0] for r in result["rejects"].collect() if r["source_file"] == "a.csv"} == {"a.csv": "row 1"}
    assert rows[5]["skills"] == ["Docker"]
    assert sorted((r["source_file"], r["error"].split(":")[0]) for r in result["rejects"].filter("source_file <> 'a.csv'").collect()) == [("b.json", "record 2"), ("b.json", "record 3"), ("f.pdf", "RuntimeError"), ("g.xyz", "Unknown file type for 'g.xyz' (ext")]


def test_canonical(result):
    row = result["canonical"].first()
    assert (row["full_name"], row["headline"], row["years_experience"], row["location"]["country"], row["location"]["city"]) == ("Ann Lee", "Dev", 8, "IN", "Pune")
    assert row["emails"] == ["ann@x.io", "ann@y.io", "ann@z.io"]
    assert row["phones"] == ["+911123456789", "+919876543210", "+919988776655"]
    assert next(s for s in row["skills"] if s["name"] == "Python")["sources"] == ["recruiter_csv", "recruiter_notes"]
    assert all(0 <= f["confidence"] <= 1 for f in row["field_confidences"])


def test_conflicts_cover_the_candidates(result):
    for c in result["conflicts"].collect():
        assert [c["winner"], *c["rejected"]] == c["candidates"]
    names = {c["field"]: len(c["candidates"]) for c in result["conflicts"].collect()}
    assert names["full_name"] == 6
    assert names["headline"] == 3
    accepted = result["provenance"].filter("accepted").collect()
    assert {r["field"] for r in accepted} >= {"full_name", "emails", "phones", "headline"}
    assert all(r["confidence"] == 0 for r in result["provenance"].filter("NOT accepted").collect())


def test_projection_omits_only_own_nulls(result):
    out = json.loads(result["output"].first()["json"])
    assert out["mail"] == "ann@x.io"
    assert "none" not in out
    assert out["s"] == sorted(out["s"])


def test_counters_and_stages(result):
    row = result["counters"].first()
    assert (row["files_processed"], row["records_parsed"], row["success"]) == (7, 6, True)
    assert (row["fields_parsed"] > 0, row["warnings"], row["processing_time_ms"] > 0) == (True, 5, True)
    assert {s.name: s.status for s in result.stages if s.status != "success"} == {"Input Detection": "warning", "Extraction": "warning"}
    assert [s.index for s in result.stages] == list(range(len(result.stages)))
    work = {s.name: (s.records_processed, s.fields_transformed) for s in result.stages}
    assert work["Parsing"][0] == 6 and work["Parsing"][1] > 6 and work["Normalization"][1] > 0
    assert {"Stage 'Merge' started", "Unknown file type for 'g.xyz' (ext: .xyz)"} <= {e["message"] for e in result.log}
    assert {r["stage"] for r in result["changes"].select("stage").distinct().collect()} == {"Input Detection", "Extraction", "Parsing", "Normalization", "Conflict Resolution"}
    assert result["chains"].filter("total > 0").count() > 0


def test_rules_are_described(result):
    rows = {r["rule"]: r for r in result["rule_log"].collect()}
    assert rows["skill_canonicalize"]["description"].startswith("Skill 'k8s' canonicalized to 'Kubernetes'") or "canonicalized to" in rows["skill_canonicalize"]["description"]
    assert (rows["skill_canonicalize"]["stage"], rows["convert_to_e164"]["stage"]) == ("canonicalization", "normalization")
    assert all(r["description"] for r in rows.values())


BAD = {
    "bom.json": "\ufeff{}".encode(), "deep.json": b"[" * 200_000, "cut.json": b'{"name": ', "latin.json": b'{"name": "\xff"}', "null.json": b"null", "long.csv": f"name,skills\nAnn,{'x' * 300_000}\n".encode(), "nul.csv": b"na\0me\n\0", "zip.docx": b"PK",
    "odd.json": json.dumps([{"name": 7, "workExperience": [{"companyName": "Z", "startDate": {"year": 2020, "month": "March"}}]}, {"name": "I", "education": [{"school": "S", "endYear": float("inf")}]}, {"name": "B", "yoe": 1e30}, {"name": ["x"], "skills": [{"name": None}, {"skill": 3}]}]).encode(),
}


def test_no_file_fails_the_run(spark, tmp_path):
    for name, body in BAD.items():
        (tmp_path / name).write_bytes(body)
    out = Engine(spark, countries={}).run(str(tmp_path))
    got = {r["full_name"]: r for r in out["records"].collect()}
    assert set(got) == {"Ann", "7", "['x']"}
    assert got["7"]["experience"][0]["start"] == "2020-03"  # 2020-March in the file
    assert len(got["Ann"]["skills"][0]) == 300_000
    assert got["['x']"]["skills"] == ["3", "None"]
    failed = {}
    for r in out["rejects"].collect():
        failed.setdefault(r["source_file"], []).append(r["error"].split(":")[0])
    assert {k: sorted(v) for k, v in failed.items()} == {"bom.json": ["JSONDecodeError"], "deep.json": ["RecursionError"], "cut.json": ["JSONDecodeError"], "latin.json": ["UnicodeDecodeError"], "zip.docx": ["BadZipFile"], "odd.json": ["record 1", "record 2"]}
    out.release()
    assert not out.held


def test_pdf_by_a_given_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Ann Lee|ann@x.io|Skills|python")
    (tmp_path / "b.pdf").write_bytes(b" ")
    out = Engine(spark, countries={}, pdf=lambda body: body.decode().replace("|", "\n")).run(str(tmp_path))
    row = out["records"].first()
    assert (row["source_type"], row["full_name"], row["emails"], row["skills"]) == ("resume_pdf", "Ann Lee", ["ann@x.io"], ["Python"])
    assert [(r["source_file"], r["error"]) for r in out["rejects"].collect()] == [("b.pdf", "no extractable text")]


def test_a_stage_that_fails_is_recorded_and_passed_over(spark, monkeypatch):
    from pyspark.sql import functions as F

    records = schema.as_records(spark.createDataFrame([("r", "Ann", ["K8S"])], "run_id string, full_name string, skills array<string>"), "run_id")
    normalize = clean.normalize
    monkeypatch.setattr(clean, "normalize", lambda *a: normalize(*a).withColumn("_changed", F.expr("IF(full_name IS NULL, 0, raise_error('broken'))").cast("int")))
    out = Engine(spark, countries={}).consolidate(records)
    assert {s.name for s in out.stages if s.status == "error"} == {"Normalization", "Canonicalization"}
    assert out["canonical"].first()["full_name"] == "Ann"
    assert any(e["level"] == "ERROR" and "broken" in e["message"] for e in out.log)


def test_schema_errors(spark):
    frame = spark.sql("SELECT 'r' AS run_id, CAST(NULL AS STRING) AS candidate_id, '' AS full_name, array(named_struct('name', 'a', 'confidence', 1.5D), named_struct('name', NULL, 'confidence', 0D)) AS skills, array(named_struct('field', 'f', 'confidence', -1D)) AS field_confidences, 2D AS overall_confidence")
    got = sorted((r["field"], r["type"], r["input"]) for r in score.schema_errors(frame, ["run_id"]).collect())
    assert got == [("candidate_id", "string_type", "None"), ("field_confidences → 0 → confidence", "greater_than_equal", "-1.0"), ("overall_confidence", "less_than_equal", "2.0"), ("skills → 0 → confidence", "less_than_equal", "1.5"), ("skills → 1 → name", "string_type", "None")]


def test_export_of_many_rows(spark, tmp_path):
    from meldwork.plans.engine import to_json

    assert len(json.loads(to_json(spark.range(1500)))) == 1500
    with pytest.raises(ValueError, match="rows"):
        to_json(spark.range(11), most=10)


def test_write_and_load(spark, result, tmp_path):
    result.write(str(tmp_path), "r1")
    assert Engine(spark, countries={}).load(str(tmp_path))["canonical"].first()["full_name"] == "Ann Lee"


def test_no_records(spark):
    empty = schema.as_records(spark.createDataFrame([], "run_id string"), "run_id")
    out = Engine(spark, countries={}).consolidate(empty)
    assert out["canonical"].count() == out["validation_errors"].count() == out["rule_log"].count() == 0


def test_ties_go_by_upload_order(spark):
    rows = [("r", "b.docx", "resume_docx", 1, 0, "Second", "h2"), ("r", "a.pdf", "resume_pdf", 0, 0, "First", None)]
    records = schema.as_records(spark.createDataFrame(rows, "run_id string, source_file string, source_type string, file_seq long, row_seq long, full_name string, headline string"), "run_id")
    row = merge.merge(records, ["run_id"]).first()
    assert (row["full_name"], row["headline"]) == ("First", "h2")


def test_paths(spark):
    frame = spark.sql("SELECT 1 AS id, array('a') AS emails, array(named_struct('f', 1, 'g', array(named_struct('c', 2)))) AS a, named_struct('x', 'y') AS s")
    wanted = project.OutputConfig.parse({"fields": [{"path": p} for p in ("emails[0]", "emails[9]", "emails[-1]", "a[]", "a[].f", "a[].g[].c", "s.x", "s.z")]})
    assert list(project.project(frame, ["id"], wanted).first())[1:] == ["a", None, None, None, [1], [None], "y", None]


def test_config_falls_back():
    assert project.OutputConfig.parse({"on_missing": "explode"}) == project.OutputConfig()
    assert project.OutputConfig.parse({"fields": [{"from": "x"}]}) == project.OutputConfig()
    assert project.OutputConfig.parse(None) == project.OutputConfig()


def test_id_falls_back_to_the_file(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(None, None, "f.csv"), ("A", [], "f.csv")], "n string, e array<string>, f string")
    ids = [r[0] for r in frame.select(clean.entity_id(F.col("n"), F.col("e"), F.col("f"))).collect()]
    assert ids[0] != ids[1]
    assert all(i.startswith("CND-") and len(i) == 16 for i in ids)


def test_validation_finds_each_kind(spark):
    frame = spark.createDataFrame([("r", "", ["bad"], ["12"], 1.5)], "run_id string, full_name string, emails array<string>, phones array<string>, overall_confidence double")
    assert sorted(r["type"] for r in score.validate(frame, ["run_id"]).collect()) == ["format_error", "format_error", "missing_value", "range_error"]


def test_detection_by_name(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("a.DOC", ""), ("x", ""), ("b.json", "[1]"), ("c.json", '{"headline": 1}'), ("d.json", "{")], "n string, b string")
    assert [r[0] for r in frame.select(sources.source_type(F.col("n"), F.col("b"))).collect()] == ["resume_docx", "unknown", "ats_json", "linkedin_json", "ats_json"]


def test_streaming_ingest(spark, tmp_path):
    records = schema.as_records(spark.createDataFrame([("r", "Ann", ["A@B.CO"])], "run_id string, full_name string, emails array<string>"), "run_id")
    records.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
    ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), countries={}).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["emails"] == ["a@b.co"]
