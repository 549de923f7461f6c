"""The engine: files or records in, a set of tables, stages and a log out."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.functions.normalize import iso_countries
from meldwork.operators import clean, merge, project, score
from meldwork.plans import store
from meldwork.sources import files as sources
from meldwork.sources import scratch


logger = logging.getLogger(__name__)


@dataclass
class Stage:
    """What a stage did. A status is the worst of what it met: error, warning or success; metrics are what its job has counted."""

    name: str
    index: int
    status: str = "success"
    start: str = ""
    end: str = ""
    ms: float = 0.0
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warning_count: int = 0
    fields_transformed: int = 0
    records_processed: int = 0
    metrics: dict = field(default_factory=dict)

    def settle(self) -> None:
        self.status = "error" if self.errors else "warning" if self.warning_count else "success"


@dataclass
class Result:
    """The tables of a run by name, the stages and the log. release() deletes the tables that the stages have written, on which all others rest."""

    tables: dict[str, DataFrame]
    stages: list[Stage] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)
    held: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def stage(self, which: str | int) -> Stage:
        """A stage by its name, in any case, or by its index."""
        for s in self.stages:
            if which == s.index or (isinstance(which, str) and which.lower() == s.name.lower()):
                return s
        raise KeyError(which)

    def write(self, path: str, run_id: str) -> None:
        """Every table as Parquet under path/run_id. The manifest comes last, under its own name only once it is whole; without it the run doesn't count."""
        store.write(self.tables, path, run_id)

    def write_json(self, path: str) -> None:
        """The projected objects as JSON lines, one an entity, however many there are."""
        self.tables["output"].select(F.col("json").alias("value")).write.mode("overwrite").text(path)

    def release(self) -> None:
        spark = next(iter(self.tables.values())).sparkSession
        for path in self.held:
            scratch.delete(spark, path)
        self.held.clear()


class Engine:
    """Consolidates records. `by` is the entity key: the run, unless given otherwise.

    Every stage computes its table in one job, which writes it to the shared folder and counts what the stage reports on the way. What goes wrong
    in a stage, while it is planned or while it runs, is recorded there, and the run goes on with the stage's fallback: the last
    table that could be computed, or a table that says nothing. The stages before Canonicalization are computed with it. With the
    default key, all records of a run meet in one row, as the one entity of a run demands; a large table needs a key of its own in `by`.
    """

    def __init__(self, spark: SparkSession, by: list[str] | None = None, region: str = "IN", countries: dict[str, str] | None = None, pdf: Callable[[bytes], str] | None = None, keep_messages: int = 100, spread: int = 1_000_000) -> None:
        self.spark, self.by, self.region, self.pdf, self.keep_messages = spark, by or ["run_id"], region, pdf, keep_messages
        self.spread = spread  # above so many records candidates are ranked over ranges, which several tasks share, instead of by entity
        self.countries = iso_countries(spark) if countries is None else countries
        self._reset()

    def _reset(self) -> None:
        self.stages: list[Stage] = []
        self.log: list[dict] = []
        self.held: list[str] = []
        self.warned: list[DataFrame] = []

    def _say(self, stage: Stage, level: str, message: str) -> None:
        self.log.append({"timestamp": _now(), "level": level, "stage": stage.name, "stage_index": stage.index, "message": message})
        logger.log(getattr(logging, level), "[%s] %s", stage.name, message)

    def _failed(self, stage: Stage, e: Exception) -> None:
        stage.errors.append(f"Unhandled error: {e}")
        self._say(stage, "ERROR", f"Stage '{stage.name}' failed: {e}")
        stage.settle()

    def _kept(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
        out, path, seen = scratch.written(df, name, **metrics)
        self.held.append(path)
        return out, seen

    def _stage(self, name: str, build: Callable[[], DataFrame], otherwise: Callable[[], DataFrame] | None = None, plan_only: bool = False, **metrics: Column) -> DataFrame:
        """Run one stage: plan its table and compute it, with the metrics, unless a later stage does. After an error the run goes on with `otherwise`, if there is one."""
        stage = Stage(name, len(self.stages), start=_now())
        self.stages.append(stage)
        self._say(stage, "INFO", f"Stage '{name}' started")
        began = time.perf_counter()
        try:
            out = build()
            if not plan_only:
                out, stage.metrics = self._kept(out, name, records=F.count(F.lit(1)), **metrics)
                stage.records_processed = stage.metrics["records"]
            return out
        except Exception as e:
            self._failed(stage, e)
            if otherwise is None:
                raise
            return otherwise()
        finally:
            stage.ms, stage.end = round((time.perf_counter() - began) * 1000, 2), _now()
            stage.settle()
            self._say(stage, "INFO", f"Stage '{name}' completed in {stage.ms:.1f}ms")

    def _warn(self, stage: Stage, number: int, messages: DataFrame) -> None:
        """Note the stage's warnings, a table of one text column: all of them for the table of warnings, and the first `keep_messages` in order for the stage and its log."""
        self.warned.append(messages.select(F.lit(stage.name).alias("stage"), F.col(messages.columns[0]).alias("warning")))
        stage.warning_count = number
        stage.warnings = [r[0] for r in messages.orderBy(messages.columns[0]).limit(self.keep_messages).collect()] if number else []
        for m in stage.warnings:
            self._say(stage, "WARNING", m)
        stage.settle()

    def run(self, paths: str | list[str], config: dict | None = None, run_id: str = "run") -> Result:
        """Read files, extract their records, and consolidate them."""
        self._reset()
        began = time.perf_counter()
        found = sources.read_files(self.spark, paths, run_id)
        files = self._stage("Input Detection", lambda: found.drop("content", "read_by"), unknown=F.count_if(F.col("source_type") == "unknown"))
        parsed = self._stage("Extraction", lambda: sources.parse_files(found, self.pdf, paths), rejects=F.count_if(sources.is_reject()))
        rejects = sources.rejects(files, parsed)
        detection, extraction = self.stages
        self._warn(detection, detection.metrics["unknown"], sources.unknown_files(files).select("warning"))
        self._warn(extraction, extraction.metrics["rejects"], rejects.filter("NOT startswith(error, 'Unknown file type')").select(F.concat("source_file", F.lit(": "), "error").alias("warning")))
        out = self._consolidated(sources.extract(parsed), config)
        out.tables |= {"files": files.drop("path"), "rejects": rejects, "changes": changes(files, out["records"], out["candidates"], *self.by)}
        out.tables["counters"] = self._counters(out, detection.metrics["records"], began)
        return out

    def _counters(self, out: Result, files: int, began: float) -> DataFrame:
        """The run's counters, from what the stages' jobs have counted."""
        def of(name: str, metric: str = "records") -> int | float | None:
            return out.stage(name).metrics.get(metric)

        work, errors, conflicts = out.stage("Canonicalization").metrics, of("Validation") or 0, of("Conflict Resolution", "conflicts") or 0
        counts = {"files_processed": files, "records_parsed": work["records"], "fields_normalized": work["changed"], "duplicates_removed": work["duplicates"], "fields_parsed": work["parsed"], "conflicts_detected": conflicts, "conflicts_resolved": conflicts, "validation_errors": errors, "warnings": sum(s.warning_count for s in out.stages)}
        row = [F.lit(v or 0).cast("long").alias(k) for k, v in counts.items()]
        means = [F.lit(of("Confidence", k)).cast("double").alias(k) for k in ("average_confidence", "quality_score")]
        return self.spark.range(1).select(*row, F.lit(errors == 0).alias("success"), *means, F.lit(round((time.perf_counter() - began) * 1000, 2)).alias("processing_time_ms"))

    def consolidate(self, records: DataFrame, config: dict | None = None) -> Result:
        """From records to canonical rows, conflicts, provenance, scores, errors and the projected JSON."""
        self._reset()
        return self._consolidated(records, config)

    def _consolidated(self, records: DataFrame, config: dict | None) -> Result:
        by, wanted = self.by, project.OutputConfig.parse(config)
        parsed = self._stage("Parsing", lambda: clean.parse(clean.parsed_fields(records)), lambda: records, plan_only=True)
        normal = self._stage("Normalization", lambda: clean.normalize(parsed, self.region, self.countries), lambda: parsed, plan_only=True)
        ready = self._stage("Canonicalization", lambda: clean.canonicalize(normal), lambda: self._last_good(normal, parsed, records), **_work())
        self._share_work()
        records = next(s for s in self.stages if s.name == "Canonicalization").metrics["records"]
        merged = self._stage("Merge", lambda: merge.merge(ready, by, *merge.lead(), *score.contributions()), lambda: merge.unmerged(ready, by, *merge.lead(), *score.contributions()))
        contested = self._stage("Conflict Resolution", lambda: merge.candidates(ready, by, spread=records > self.spread), lambda: merge.no_candidates(ready, by), conflicts=F.count_if(F.col("rank") == 1))
        means = {"average_confidence": F.bround(F.avg("overall_confidence") * 100, 1), "quality_score": F.bround(F.avg("quality_score.overall_score"), 1)}
        scored = self._stage("Confidence", lambda: _with_provenance(contested, score.quality(score.confidence(merged)), by), lambda: _with_provenance(None, score.unscored(merged), by), **means)
        rows = score.backfill(merge.provenance(contested, scored, by), scored, by)
        full = scored.drop(*[c for c in scored.columns if c.startswith("_")])
        projected = self._stage("Projection", lambda: project.project_json(full, by, wanted), lambda: full.select(*by, F.lit(None).cast("string").alias("json")))
        errors = self._stage("Validation", lambda: validation_errors(full, by, wanted), lambda: no_errors(full, by))
        log = clean.rule_log(ready, *by).withColumn("timestamp", F.lit(_now()))
        stage = {s.name: s for s in self.stages}
        if not stage["Canonicalization"].metrics.get("records"):
            self._warn(stage["Merge"], 1, self.spark.sql("SELECT 'No records to merge' AS warning"))
        self._warn(stage["Validation"], stage["Validation"].metrics.get("records", 0), errors.select(F.concat(F.lit("Validation error on '"), "field", F.lit("': "), "error").alias("warning")))
        conflicts = merge.conflicts(contested, by)
        warnings = self.warned[0]
        for w in self.warned[1:]:
            warnings = warnings.unionByName(w)
        return Result({
            "records": ready, "canonical": full, "candidates": contested, "conflicts": conflicts, "provenance": rows, "field_provenance": merge.field_provenance(rows, by),
            "rule_log": log, "chains": clean.chains(log, *by, conflicts=conflicts), "output": projected, "validation_errors": errors, "warnings": warnings,
        }, self.stages, self.log, self.held)

    def _share_work(self) -> None:
        """What Canonicalization's job has counted for the stages that it computes."""
        work = next(s for s in self.stages if s.name == "Canonicalization").metrics
        for s in self.stages:
            of = {"Parsing": "parsed", "Normalization": "changed", "Canonicalization": "rules"}.get(s.name)
            if of:
                s.records_processed, s.fields_transformed = work["records"], work[of] or 0

    def _last_good(self, *tables: DataFrame) -> DataFrame:
        """The first of the tables that can be computed, with the columns of a canonicalized one; the stages of the others are in error."""
        names, stage = ["Normalization", "Parsing"], {s.name: s for s in self.stages}
        for i, table in enumerate(tables):
            try:
                out = table if "_rules" in table.columns else clean.unnormalized(table)
                out = out if "parsed_fields" in out.columns else out.withColumn("parsed_fields", F.lit(0))
                out, stage["Canonicalization"].metrics = self._kept(out, "Canonicalization", records=F.count(F.lit(1)), **_work())
                return out
            except Exception as e:
                if i == len(names):
                    raise
                if not stage[names[i]].errors:
                    self._failed(stage[names[i]], e)
        raise ValueError("no table is given")

    def load(self, path: str, run_id: str = "latest") -> dict[str, DataFrame]:
        """The tables of a run that was written whole; `latest` is the one committed last."""
        return store.read(self.spark, path, run_id)


def _work() -> dict[str, Column]:
    """What the job that computes the records counts for the stages that it holds."""
    return {"parsed": F.sum("parsed_fields"), "changed": F.sum("_changed"), "duplicates": F.sum("_duplicates"), "rules": F.sum(F.size("_rules"))}


def _with_provenance(contested: DataFrame | None, scored: DataFrame, by: list[str]) -> DataFrame:
    """scored with provenance: the accepted entries of each entity; without contested candidates, none."""
    kind = "array<struct<field:string,source:string,method:string>>"
    if contested is None:
        return scored.withColumn("provenance", F.lit(None).cast(kind))
    rows = score.backfill(merge.provenance(contested, scored, by), scored, by)
    accepted = rows.filter("accepted").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("field", "source", F.lit("direct").alias("method")))).cast(kind).alias("provenance"))
    return scored.join(accepted, by, "left")


def config_schema() -> dict:
    """A JSON schema of the output config."""
    item = {"type": "object", "required": ["path"], "properties": {"path": {"type": "string"}, "from": {"type": "string"}, "type": {"type": "string"}, "required": {"type": "boolean"}, "normalize": {"type": "string"}}}
    flags = {k: {"type": "boolean", "default": True} for k in ("include_confidence", "include_provenance", "include_analytics")}
    return {"type": "object", "properties": {"fields": {"type": "array", "items": item}, **flags, "on_missing": {"enum": ["null", "omit", "error"], "default": "null"}}}


def _now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


def validation_errors(full: DataFrame, by: list[str], wanted: project.OutputConfig) -> DataFrame:
    """(by, field, error, type, input): the schema's, the business rules' and the projection's errors."""
    none = F.lit(None).cast("string").alias("input")
    rules = score.validate(full, by).select(*by, "field", "error", "type", none)
    missing = project.missing_errors(full, by, wanted).select(*by, "field", "error", F.lit("required").alias("type"), none)
    return score.schema_errors(full, by).unionByName(rules).unionByName(missing)


def no_errors(full: DataFrame, by: list[str]) -> DataFrame:
    """validation_errors() of nothing."""
    return full.select(*by, *[F.lit(None).cast("string").alias(c) for c in ("field", "error", "type", "input")]).filter("false")


def changes(files: DataFrame, records: DataFrame, contested: DataFrame, *keys: str) -> DataFrame:
    """(stage, item, change): what each stage has changed, as maps of texts."""
    def row(df: DataFrame, stage: str, item: Column, **values: Column) -> DataFrame:
        pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
        return df.select(F.lit(stage).alias("stage"), item.alias("item"), F.create_map(*pairs).alias("change"))

    file = F.col("source_file")
    out = row(files, "Input Detection", file, detected_type=F.col("source_type"), size_bytes=F.col("size"))
    out = out.unionByName(row(records.groupBy("source_file", "source_type").agg(F.count("*").alias("n")), "Extraction", file, source_type=F.col("source_type"), records_extracted=F.col("n")))
    out = out.unionByName(row(records, "Parsing", file, source_type=F.col("source_type"), candidate_id=F.col("candidate_id"), fields_parsed=F.col("parsed_fields")))
    out = out.unionByName(row(records.filter("_changed > 0 OR _duplicates > 0"), "Normalization", file, fields_normalized=F.col("_changed"), duplicates_removed=F.col("_duplicates")))
    won = contested.filter("rank = 1")
    return out.unionByName(row(won, "Conflict Resolution", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], "field"), winner=F.col("value"), winner_source=F.col("source_file"), candidates=F.col("n")))


def to_json(df: DataFrame, most: int = 100_000) -> str:
    """A small result as indented JSON, for export; one row is one object. Above `most` rows it raises: write_json() has no bound."""
    rows = [json.loads(r) for r in df.toJSON().take(most + 1)]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use Result.write_json()")
    return json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, ensure_ascii=False)
