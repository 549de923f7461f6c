"""The merge: all records of an entity become one row, scalars by source priority, lists as sets.

Everything is one aggregation by the entity key. Scalars are min_by over the order (priority, file,
row), which combines before the shuffle; only the candidates of conflicting scalars need a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meldwork.functions import dims
from meldwork.functions.schema import RECORD, display_name, priority
from meldwork.sources import scratch

#: Scalar, and the record's column it comes from.
SCALAR_COLUMNS = {
    "full_name": "full_name", "headline": "headline", "location.city": "city", "location.region": "region", "location.country": "country",
    "years_experience": "years_experience", "links.linkedin": "linkedin", "links.github": "github", "links.portfolio": "portfolio",
}


def ordered(records: DataFrame) -> DataFrame:
    """records with _ord: priority, then upload order, then row order."""
    return records.withColumn("_ord", F.struct(priority(F.col("source_type")).alias("priority"), F.col("file_seq"), F.col("row_seq")))


def _present(column: str) -> str:
    return f"{column} IS NOT NULL" if column == "years_experience" else f"{column} IS NOT NULL AND {column} <> ''"


def lead() -> list[Column]:
    """For merge(): what provenance() asks of an entity: its first file, and how many records have each plain scalar."""
    first = F.min_by(F.struct("source_file", "source_type"), F.struct("_ord.priority", "_ord.file_seq")).alias("_lead")
    return [first, *[F.count_if(F.expr(_present(c))).alias(f"_n_of_{c}") for c in ("full_name", "headline")]]


def merge(records: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """One canonical row an entity, with more aggregates of its records. An entity without records has no row.

    All records of an entity meet in one row, and its lists in one buffer: a large table needs a key that divides it.
    """
    rows = ordered(records)
    scalars = [F.expr(f"min_by({c}, _ord) FILTER (WHERE {_present(c)})").alias(f"_{c}") for c in SCALAR_COLUMNS.values()]

    def union(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))

    def concat(c: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("_ord", F.col(c).alias("xs")))))
        return F.flatten(F.transform(listed, lambda x: x["xs"]))

    lowered = F.transform(F.filter("emails", lambda x: x != ""), lambda x: F.lower(F.trim(x)))
    base = rows.groupBy(*by).agg(
        F.coalesce(F.min_by("candidate_id", "_ord"), F.lit("CND-UNKNOWN")).alias("candidate_id"), *scalars,
        union(lowered).alias("emails"), union(F.col("phones")).alias("phones"), union(F.col("other_links")).alias("other_links"),
        concat("experience").alias("experience"), concat("education").alias("education"), F.count("*").alias("n_records"), *more,
    )
    known = {*by, "candidate_id", *(f"_{c}" for c in SCALAR_COLUMNS.values()), "emails", "phones", "other_links", "experience", "education", "n_records"}
    skills = skill_rollup(records, by)
    out = base.join(skills, by, "left")
    return out.select(
        *by, "candidate_id", F.coalesce("_full_name", F.lit("")).alias("full_name"), "emails", "phones",
        F.struct(F.col("_city").alias("city"), F.col("_region").alias("region"), F.col("_country").alias("country")).alias("location"),
        F.struct(F.col("_linkedin").alias("linkedin"), F.col("_github").alias("github"), F.col("_portfolio").alias("portfolio"), F.col("other_links").alias("other")).alias("links"),
        F.col("_headline").alias("headline"), F.col("_years_experience").alias("years_experience"),
        F.coalesce("skills", F.array().cast(_SKILLS)).alias("skills"), "experience", "education", "n_records",
        *[c for c in base.columns if c not in known],
    )


_SKILLS = "array<struct<name:string,confidence:double,sources:array<string>>>"


def unmerged(records: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """The rows and columns of merge() with nothing in them but the number of records and `more`, for a run that goes on without a merge."""
    def empty(kind: str) -> Column:
        return F.array().cast(kind)

    none, texts = F.lit(None).cast("string"), "array<string>"
    base = ordered(records).groupBy(*by).agg(F.count("*").alias("n_records"), *more)
    return base.select(
        *by, F.lit("CND-UNKNOWN").alias("candidate_id"), F.lit("").alias("full_name"), empty(texts).alias("emails"), empty(texts).alias("phones"),
        F.struct(*[none.alias(c) for c in ("city", "region", "country")]).alias("location"), F.struct(*[none.alias(c) for c in ("linkedin", "github", "portfolio")], empty(texts).alias("other")).alias("links"),
        none.alias("headline"), F.lit(None).cast("int").alias("years_experience"), empty(_SKILLS).alias("skills"), empty(RECORD["experience"]).alias("experience"), empty(RECORD["education"]).alias("education"), "n_records",
        *[c for c in base.columns if c not in (*by, "n_records")],
    )


def no_candidates(records: DataFrame, by: list[str]) -> DataFrame:
    """candidates() of nothing."""
    kinds = {"field": "string", "value": "string", "source_file": "string", "source_type": "string", "priority": "int", "rank": "int", "n": "long", "winner": "struct<value:string,source_type:string,priority:int>"}
    return records.select(*by, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).filter("false")


def skill_rollup(records: DataFrame, by: list[str]) -> DataFrame:
    """Per entity its skills: grouped by lower case, named as first seen, with their source types in the order seen."""
    each = ordered(records).select(*by, "source_type", "_ord", F.posexplode("skills").alias("_pos", "name")).withColumns({"_ord": F.struct("_ord", "_pos"), "_key": F.lower("name")})
    typed = each.groupBy(*by, "_key", "source_type").agg(F.min("_ord").alias("_first"), F.min_by("name", "_ord").alias("name"))
    named = typed.groupBy(*by, "_key").agg(F.min_by("name", "_first").alias("name"), F.array_sort(F.collect_list(F.struct("_first", "source_type"))).alias("_s"))
    entry = F.struct("name", F.lit(0.0).alias("confidence"), F.transform("_s", lambda x: x["source_type"]).alias("sources"))
    return named.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("skills"))


def candidates(records: DataFrame, by: list[str], spread: bool = False) -> DataFrame:
    """Every non-empty contribution to a scalar, ranked, for scalars that have two or more. With `spread`, several tasks share the candidates of one entity."""
    rows = ordered(records)
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.when(F.expr(_present(c)), F.col(c).cast("string")).alias("value")) for n, c in SCALAR_COLUMNS.items()])
    long = rows.select(*by, "source_file", "source_type", "_ord", F.explode(pairs).alias("p")).select(*by, "source_file", "source_type", "_ord", "p.field", "p.value").filter("value IS NOT NULL")
    head = F.struct("value", "source_type", F.col("_ord.priority").alias("priority"))
    ranked = ranked_by_range(long, [*by, "field"], "_ord", head) if spread else ranked_by_window(long, [*by, "field"], "_ord", head)
    return ranked.filter("n > 1").select(*by, "field", "value", "source_file", "source_type", F.col("_ord.priority").alias("priority"), "rank", "n", "winner")


def ranked_by_window(rows: DataFrame, group: list[str], order: str, head: Column) -> DataFrame:
    """rows with rank, n (the group's rows) and winner (head of its first row). A group is sorted in one task."""
    own = Window.partitionBy(*group)
    return rows.withColumns({"n": F.count("*").over(own), "rank": F.row_number().over(own.orderBy(order)), "winner": F.first(head).over(own.orderBy(order))})


def ranked_by_range(rows: DataFrame, group: list[str], order: str, head: Column, parts: int | None = None) -> DataFrame:
    """The same as ranked_by_window(), where tasks share a group: rows lie in ranges of (group, order), and a row's rank is its place in its range and what lies in the ranges before.

    The ranges are written once, so that counts and rows agree; the counts are one row a group and range that holds some of it.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_head", head).repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *group, order).sortWithinPartitions(*group, order)
    placed, _, _ = scratch.written(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    counts = placed.groupBy(*group, "_range").agg(F.count("*").alias("_count"), F.min("_at").alias("_from"), F.min_by("_head", "_at").alias("_first"))
    ranges = Window.partitionBy(*group).orderBy("_range")
    before = F.coalesce(F.sum("_count").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "n": F.sum("_count").over(Window.partitionBy(*group)), "winner": F.first("_first").over(ranges)})
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]
    met = placed.alias("r").join(counts.alias("c"), [F.col("r._range") == F.col("c._range"), *same])
    return met.select(*[F.col(f"r.{c}") for c in rows.columns], F.col("c.n"), (F.col("c._before") + F.col("r._at") - F.col("c._from") + 1).cast("int").alias("rank"), F.col("c.winner"))


def provenance(contested: DataFrame, canonical: DataFrame, by: list[str]) -> DataFrame:
    """Accepted and rejected contributions of contested scalars, and the plain fields that nobody contests; canonical was merged with lead()."""
    mine, best = display_name(F.col("source_type")), display_name(F.col("winner.source_type"))
    won = F.concat(F.lit("Selected from "), mine, F.lit(" — highest priority source."))
    lost = F.concat(F.lit("Rejected: "), mine, F.lit(" (priority "), F.col("priority"), F.lit(") lost to "), best, F.lit(" (priority "), F.col("winner.priority"), F.lit(")."))
    rows = contested.select(
        *by, "field", "value", F.col("winner.value").alias("winning_value"), F.col("source_file").alias("source"), "source_type", "priority", (F.col("rank") == 1).alias("accepted"), F.lit(True).alias("contested"),
        F.lit("direct").alias("method"), F.array(F.lit("priority_based_conflict_resolution")).alias("rules_applied"), F.when(F.col("rank") == 1, won).otherwise(lost).alias("explanation"),
    )
    plain = F.array(*[F.struct(F.lit(c).alias("field"), v.alias("value")) for c, v in (
        ("full_name", F.when(F.col("_n_of_full_name") == 1, F.col("full_name"))), ("emails", F.when(F.size("emails") > 0, F.to_json("emails"))),
        ("phones", F.when(F.size("phones") > 0, F.to_json("phones"))), ("headline", F.when(F.col("_n_of_headline") == 1, F.col("headline"))))])
    single = canonical.select(*by, F.col("_lead").alias("f"), F.explode(plain).alias("p")).select(*by, "f", "p.*").filter("value IS NOT NULL")
    single = single.select(
        *by, "field", "value", F.col("value").alias("winning_value"), F.col("f.source_file").alias("source"), F.col("f.source_type").alias("source_type"), F.lit(dims.DEFAULT_PRIORITY).alias("priority"), F.lit(True).alias("accepted"), F.lit(False).alias("contested"),
        F.lit("direct").alias("method"), F.array().cast("array<string>").alias("rules_applied"), F.concat(F.lit("Single source value from "), F.col("f.source_file"), F.lit(". No conflict.")).alias("explanation"),
    )
    return rows.unionByName(single)


def conflicts(contested: DataFrame, by: list[str]) -> DataFrame:
    """One row a contested scalar: candidates in order, winner, rejected and an explanation."""
    entry = F.struct("rank", "value", F.col("source_file").alias("source"), "priority", display_name(F.col("source_type")).alias("name"))
    listed = contested.groupBy(*by, "field").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    def shown(x: Column) -> Column:
        return F.struct(x["value"].alias("value"), x["source"].alias("source"), x["priority"].alias("priority"))

    top, rest = F.col("c")[0], F.slice("c", F.lit(2), F.size("c"))
    head = F.concat(F.lit("'"), F.col("field"), F.lit("' selected from "), top["name"], F.lit(" (priority "), top["priority"], F.lit(") because it has higher source priority."))
    tail = F.transform(rest, lambda x: F.concat(F.lit("Rejected '"), x["value"], F.lit("' from "), x["name"], F.lit(" (priority "), x["priority"], F.lit(").")))
    return listed.select(
        *by, "field", F.transform("c", shown).alias("candidates"), shown(top).alias("winner"), F.transform(rest, shown).alias("rejected"),
        F.concat_ws(" ", head, F.array_join(tail, " ")).alias("explanation"), F.lit(0.0).alias("confidence"),
    )


def field_provenance(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per field the winning entry, the rejected ones and how many there are."""
    entry = F.struct("value", "source", "source_type", "priority")
    return rows.groupBy(*by, "field").agg(
        F.min_by(entry, F.when(F.col("accepted"), F.lit(0))).alias("winner"), F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.struct("priority", "source", "value")))).alias("rejected"), F.count("*").alias("entries"),
    ).withColumns({"conflict_count": F.size("rejected"), "has_conflicts": F.size("rejected") > 0})
