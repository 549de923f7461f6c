"""Files to records: detection by extension and content, then one reader a source type.

parse_files() makes rows of the files table (run_id, file_seq, source_file, source_type, content, and path where a file is read by
lines); extract() makes records of its rows. JSON and plain text are read in columns, CSV by lines, and only archives of
documents in Python, a file at a time. A file or record that can't be read is a row of rejects; a record without a name is no record.
"""

from __future__ import annotations

import importlib
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.functions import dims, text
from meldwork.functions.schema import RECORD, as_records, priority
from meldwork.functions.text import WHITE, blank_to_null, non_empty, split_list
from meldwork.sources import csv_rows
from meldwork.sources.json_records import json_rows


def read_files(spark: SparkSession, paths: str | list[str], run_id: str = "run") -> DataFrame:
    """The files under paths, in the order of their paths; a file name that comes again replaces the earlier one.

    Names and order are settled on the paths alone and sent to where contents are read, up to
    csv_rows.MAX_BROADCAST_FILES of them, so no content is shuffled; beyond, contents meet them by path. file_seq rises with the
    path. The content of a CSV file isn't read here: its read_by is lines.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    by_lines = F.lower("_metadata.file_name").endswith(".csv")
    name = F.element_at(F.split("path", "/"), -1)
    last = scan.select(name.alias("source_file"), F.struct("path", F.col("_metadata.file_path").alias("place")).alias("p")).groupBy("source_file").agg(F.max("p").alias("p")).select("source_file", "p.path", "p.place")
    few = is_few(spark, paths)
    parts = 1 if few else int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = last.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("file_seq", F.monotonically_increasing_id())
    order = order.select("source_file", "place", "file_seq") if few else order.select("source_file", "place", "file_seq").persist()
    def part(of: Column, content: Column, by: str) -> DataFrame:
        found = scan.filter(of).select(F.col("_metadata.file_path").alias("place"), "length", content.alias("content"))
        return found.join(F.broadcast(order) if few else order, "place").select(F.lit(run_id).alias("run_id"), "file_seq", "source_file", "content", "length", F.col("place").alias("path"), F.lit(by).alias("read_by"))

    return detect(part(~by_lines, F.col("content"), "content").unionByName(part(by_lines, F.lit(None).cast("binary"), "lines")))


def is_few(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether the files under paths are few enough for a row of each to go to every task."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return scan.select("path").limit(csv_rows.MAX_BROADCAST_FILES + 1).count() <= csv_rows.MAX_BROADCAST_FILES


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^.]+$", 0))


def json_type(body: Column) -> Column:
    """linkedin_json if the top object has any of its keys, else ats_json; a list or bad JSON is ats_json."""
    keys = F.json_object_keys(body)
    return F.when(F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, dims.LINKEDIN_KEYS))), F.lit(False)), "linkedin_json").otherwise("ats_json")


def source_type(name: Column, body: Column) -> Column:
    by_extension = F.lit(None).cast("string")
    for ext, (kind, _) in dims.EXTENSIONS.items():
        by_extension = F.when(extension(name) == ext, json_type(body) if kind == "json" else F.lit(kind)).otherwise(by_extension)
    return F.coalesce(by_extension, F.lit("unknown"))


def mime_type(name: Column) -> Column:
    found = F.lit(None).cast("string")
    for ext, (_, mime) in dims.EXTENSIONS.items():
        found = F.when(extension(name) == ext, F.lit(mime)).otherwise(found)
    return found


def detect(files: DataFrame) -> DataFrame:
    """files with source_type, mime_type, size and priority."""
    kind = source_type(F.col("source_file"), F.when(extension(F.col("source_file")) == ".json", F.col("content").cast("string")))
    return files.withColumns({"source_type": kind, "mime_type": mime_type(F.col("source_file")), "size": (F.col("length") if "length" in files.columns else F.octet_length("content")).cast("long")}).drop("length").withColumn("priority", priority(F.col("source_type")))


def unknown_files(files: DataFrame) -> DataFrame:
    return files.filter("source_type = 'unknown'").select("run_id", "source_file", F.concat(F.lit("Unknown file type for '"), "source_file", F.lit("' (ext: "), extension(F.col("source_file")), F.lit(")")).alias("warning"))


KEYS = ["run_id", "source_file", "source_type", "file_seq"]
def _cells() -> Callable[[str], Column]:
    def cell(name: str) -> Column:
        aliases = F.array(*map(F.lit, dims.CSV_ALIASES[name]))
        return F.try_element_at("cells", F.get(F.filter(aliases, lambda a: F.map_contains_key("cells", a)), F.lit(0)))

    return cell


def _number(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


_ENDLESS = [float("inf"), float("-inf")]


def csv_projection(rows: DataFrame) -> DataFrame:
    """Records from rows with `cells`, a map of lower-cased header to cell; the first alias that is a header decides."""
    cell = _cells()
    scalars = {n: blank_to_null(cell(n)) for n in ("full_name", "headline", "city", "region", "country", "linkedin", "github")}
    lists = {n: split_list(cell(n)) for n in ("emails", "phones", "skills")}
    company, headline = blank_to_null(cell("company")), blank_to_null(cell("headline"))
    none = F.lit(None).cast("string")
    entry = F.struct(company.alias("company"), headline.alias("title"), none.alias("start"), none.alias("end"), none.alias("summary"))
    step = rows.withColumn("y", _number(cell("years_experience"))).withColumns(scalars | lists)
    step = step.withColumn("experience", F.when(company.isNotNull() | headline.isNotNull(), F.array(entry)))
    step = step.filter(non_empty(F.col("full_name")) & ~F.coalesce(F.col("y").isin(_ENDLESS), F.lit(False)))
    return as_records(step.withColumn("years_experience", F.col("y").try_cast("int")), "run_id")


def _endless(cell: Callable[[str], Column]) -> Column:
    return blank_to_null(cell("full_name")).isNotNull() & _number(cell("years_experience")).isin(_ENDLESS)


def csv_rejects(rows: DataFrame) -> DataFrame:
    """Rows with a name whose years can't be a whole number."""
    cell = _cells()
    return rows.filter(_endless(cell)).select("run_id", "source_file", F.concat(F.lit("row "), "row_seq", F.lit(": years of experience are infinite")).alias("error"))


_JSON_FIELDS = ["full_name", "headline", "city", "region", "country", "years_experience", "linkedin", "github", "portfolio", "emails", "phones", "skills", "experience", "education"]


#: One row for every record, text or failure of a file; one of cells, text, error or the JSON fields is set, by `kind`.
PARSED = {"reader": "string", "run_id": "string", "source_file": "string", "source_type": "string", "file_seq": "long", "row_seq": "long", "kind": "string", "cells": "map<string,string>", "text": "string", "error": "string"} | {f: RECORD[f] for f in _JSON_FIELDS}


def _as_parsed(rows: DataFrame, reader: str) -> DataFrame:
    """rows with all PARSED columns. The reader is a constant of its rows, so what asks for one leaves the others out of its plan."""
    rows = rows.withColumn("reader", F.lit(reader))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in PARSED.items()])


def _in_python(files: DataFrame, kinds: list[str], rows: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """PARSED rows of the files of some kinds, read a file at a time; what a file raises is its error, behind the rows that came before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        for frame in frames:
            for r in frame.itertuples(index=False):
                own = {k: getattr(r, k) for k in KEYS}
                try:
                    for row in rows(r.source_type, bytes(r.content)):
                        out.append({"row_seq": 0} | row | own)
                        if len(out) == BATCH_ROWS:
                            yield _frame(out)
                            out = []
                except Exception as e:  # noqa: BLE001  whatever a file holds, it is a reject
                    out.append(own | {"row_seq": 0, "kind": "error", "error": f"{type(e).__name__}: {e}".encode("utf-8", "replace").decode()})
        yield _frame(out)

    only = files.filter(F.col("source_type").isin(kinds) & F.col("content").isNotNull()).select(*KEYS, "content")
    return _as_parsed(only.mapInPandas(run, ", ".join(f"{k} {PARSED[k]}" for k in _PYTHON)), "csv" if kinds == ["recruiter_csv"] else "document")


#: Rows that a task gathers before it sends them on.
BATCH_ROWS = 1000
_PYTHON = [*KEYS, "row_seq", "kind", "cells", "text", "error"]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([tuple(map(r.get, _PYTHON)) for r in rows], columns=_PYTHON, dtype=object)


def _csv(source_type: str, content: bytes) -> Iterator[dict]:
    for row in csv_rows.whole_rows(content):
        yield row | {"kind": "csv"}


def _text_rows(files: DataFrame) -> DataFrame:
    """A note is UTF-8, or else Latin-1."""
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return _as_parsed(files.filter("source_type = 'recruiter_notes'").select(*KEYS, F.lit(0).alias("row_seq"), F.lit("note").alias("kind"), body.alias("text")), "note")


def _by_lines(files: DataFrame, paths: str | list[str]) -> DataFrame:
    """PARSED rows of the CSV files that read_files() has not read: by lines, or whole where a cell spans lines."""
    spark = files.sparkSession
    listed = files.filter("read_by = 'lines'").select(*KEYS, "path")
    few = is_few(spark, paths)
    lines = csv_rows.text_lines(spark, paths)
    found = csv_rows.survey(lines)
    rows = csv_rows.csv_lines(lines, found, few).join(F.broadcast(listed) if few else listed, "path").withColumn("kind", F.lit("csv"))
    spanned = [r["path"] for r in found.filter("spans").select("path").collect()]  # names of files, all of which the driver has listed already
    if not spanned:
        return _as_parsed(rows, "csv")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).filter(F.col("_metadata.file_path").isin(spanned)).select(F.col("_metadata.file_path").alias("path"), "content")
    return _as_parsed(rows, "csv").unionByName(_in_python(whole.join(F.broadcast(listed) if few else listed, "path"), ["recruiter_csv"], _csv))


def readers(files: DataFrame, pdf: Callable[[bytes], str] | None = None, paths: str | list[str] | None = None) -> dict[str, DataFrame]:
    """PARSED rows by the reader that makes them. `pdf` turns a PDF's bytes into text, by default pdf_text; `paths` are those that read_files() was given."""

    def document(source_type: str, content: bytes) -> Iterator[dict]:
        body = ((pdf or pdf_text) if source_type == "resume_pdf" else docx_text)(content)
        body.encode()  # half a character is an error of this file
        yield {"kind": "document", "text": body} if body.strip() else {"kind": "error", "error": "no extractable text"}

    by_content = _in_python(files, ["recruiter_csv"], _csv)
    return {
        "csv": by_content if paths is None else by_content.unionByName(_by_lines(files, paths)), "note": _text_rows(files), "document": _in_python(files, ["resume_pdf", "resume_docx"], document),
        "json": _as_parsed(json_rows(files.filter(F.col("source_type").isin("ats_json", "linkedin_json")).select(*KEYS, "content"), *KEYS), "json"),
    }


def parse_files(files: DataFrame, pdf: Callable[[bytes], str] | None = None, paths: str | list[str] | None = None) -> DataFrame:
    """PARSED rows of all files of known type, as readers() makes them."""
    found = list(readers(files, pdf, paths).values())
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def document_record(rows: DataFrame, keep: int = 5000) -> DataFrame:
    """Records from rows with `text`, a résumé's whole text: every field by pattern."""
    t = F.col("text")
    exp = F.filter(F.transform(text.blocks(text.section(t, "experience")), lambda b: text.experience_block(b)), lambda x: non_empty(x["title"]) | non_empty(x["company"]))
    edu = F.filter(F.transform(text.blocks(text.section(t, "education")), lambda b: text.education_block(b)), lambda x: non_empty(x["institution"]) | non_empty(x["degree"]))
    return as_records(rows.withColumns({
        "full_name": text.name_line(t), "emails": text.emails(t), "phones": text.phones(t), "skills": text.keywords(t), "linkedin": text.first_match(t, dims.LINKEDIN_URL),
        "github": text.first_match(t, dims.GITHUB_URL), "other_links": text.urls(t), "experience": exp, "education": edu, "raw_text": F.substring(t, 1, keep), "row_seq": F.lit(0),
    }), "run_id")


def notes_records(rows: DataFrame, keep: int = 1000) -> DataFrame:
    """One record a note that isn't blank, from rows with `text`."""
    t = F.col("text")
    return as_records(rows.filter(~t.rlike(f"^{WHITE}*$")).withColumns({
        "full_name": text.labelled_name(t), "emails": text.emails(t), "phones": text.phones(t), "skills": text.keywords(t), "raw_text": F.substring(t, 1, keep), "row_seq": F.lit(0),
    }), "run_id")


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then all table cells, a line each."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")

    def words(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{w}t"))

    lines = [words(p) for p in body.findall(f"{w}p")]
    for table in body.findall(f"{w}tbl"):
        lines += ["\n".join(words(p) for p in cell.findall(f"{w}p")) for cell in table.iter(f"{w}tc")]
    return "\n".join(x for x in lines if x.strip())


def pdf_text(content: bytes) -> str:
    """Page texts, a page that fails left out; needs pypdf or PyPDF2."""
    for name in ("pypdf", "PyPDF2"):
        try:
            reader = importlib.import_module(name).PdfReader(io.BytesIO(content))
            break
        except ImportError:
            continue
    else:
        raise RuntimeError("no PDF parser is installed")
    pages = []
    for page in reader.pages:
        try:
            pages.append(page.extract_text())
        except Exception:  # noqa: BLE001, S112  a page may hold anything
            continue
    return "\n".join(x for x in pages if x)


def _records(by_reader: dict[str, DataFrame]) -> DataFrame:
    def of(kind: str) -> DataFrame:
        return by_reader[kind].filter(F.col("kind") == kind)

    csv = csv_projection(of("csv").select(*KEYS, "row_seq", "cells"))
    texts = document_record(of("document").select(*KEYS, "text")).unionByName(notes_records(of("note").select(*KEYS, "text")))
    return csv.unionByName(texts).unionByName(as_records(of("json").drop("reader", "cells", "text", "error"), "run_id"))


def extract(parsed: DataFrame) -> DataFrame:
    """Records of all PARSED rows."""
    return _records({r: parsed.filter(F.col("reader") == r) for r in ("csv", "note", "document", "json")})


def records(files: DataFrame, pdf: Callable[[bytes], str] | None = None, paths: str | list[str] | None = None) -> DataFrame:
    """Records of the files, where nobody asks for what was rejected: no reader's plan goes through those of the others."""
    return _records(readers(files, pdf, paths))


def is_reject() -> Column:
    """Whether a PARSED row gives no record for a reason that rejects() tells."""
    cell = _cells()
    return (F.col("kind") == "error") | ((F.col("kind") == "csv") & F.coalesce(_endless(cell), F.lit(False)))


def rejects(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(run_id, source_file, error): files and records that gave nothing, and why."""
    failed = parsed.filter("kind = 'error'").select("run_id", "source_file", "error")
    return failed.unionByName(csv_rejects(parsed.filter("reader = 'csv' AND kind = 'csv'"))).unionByName(unknown_files(files).withColumnRenamed("warning", "error"))
