"""Cleaning, ids, and the two normalizing stages, record by record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meldwork.functions import dims
from meldwork.functions import normalize as N
from meldwork.functions.text import non_empty, strip

TEXT_LISTS = ["emails", "phones", "skills", "other_links"]


def entity_id(name: Column, emails: Column, source_file: Column) -> Column:
    """CND- and 12 hex digits of the SHA-256 of name|first email; of the file's name where both are missing."""
    first = F.get(emails, F.lit(0))
    parts = F.concat_ws("|", F.when(non_empty(name), F.lower(strip(name))), F.when(non_empty(first), F.lower(strip(first))))
    return F.concat(F.lit("CND-"), F.upper(F.substring(F.sha2(F.when(parts != "", parts).otherwise(source_file), 256), 1, 12)))


def parse(records: DataFrame) -> DataFrame:
    """Strip scalars, lists and nested strings; fix candidate_id from the raw name and first e-mail."""
    def items(c: str) -> Column:
        return F.transform(F.filter(c, lambda x: non_empty(x)), strip)

    def nested(c: str, fields: list[str]) -> Column:
        def one(x: Column) -> Column:
            for f in fields:
                x = x.withField(f, strip(x[f]))
            return x

        return F.transform(c, one)

    return records.withColumns({
        "candidate_id": entity_id(F.col("full_name"), F.col("emails"), F.col("source_file")),
        "full_name": strip(F.col("full_name")), "headline": strip(F.col("headline")),
        **{c: items(c) for c in TEXT_LISTS},
        "experience": nested("experience", ["company", "title", "summary"]), "education": nested("education", ["institution", "degree", "field"]),
    })


def parsed_fields(records: DataFrame) -> DataFrame:
    """Records with parsed_fields: how many scalars, list items and nested strings parse() has to clean."""
    def texts(c: str, fields: list[str]) -> Column:
        values = F.flatten(F.transform(c, lambda x: F.array(*[x[f] for f in fields])))
        return F.size(F.filter(values, lambda x: non_empty(x)))

    scalars = sum(F.when(non_empty(F.col(c)), 1).otherwise(0) for c in ("full_name", "headline"))
    lists = sum(F.size(F.filter(c, lambda x: non_empty(x))) for c in ("emails", "phones", "skills"))
    nested = texts("experience", ["company", "title", "summary"]) + texts("education", ["institution", "degree", "field"])
    return records.withColumn("parsed_fields", scalars + lists + nested)


def unnormalized(records: DataFrame) -> DataFrame:
    """records as they are, with nothing logged, for a run that goes on without a stage."""
    return records.withColumns({"_rules": F.array().cast(f"array<{N.RULE}>"), "_duplicates": F.lit(0), "_changed": F.lit(0)})


def normalize(records: DataFrame, region: str = "IN", countries: dict[str, str] | None = None) -> DataFrame:
    """E-mails, phones, country and dates normalized; _rules, _duplicates and _changed say what that did."""
    step = records.withColumns({"_e": N.email_list(F.col("emails")), "_p": N.phone_list(F.col("phones"), region), "_c": N.country(F.col("country"), countries)})
    step = step.withColumn("_x", F.transform("experience", lambda x: F.struct(N.date(x["start"], "experience.start").alias("s"), N.date(x["end"], "experience.end").alias("e"))))
    dated = F.zip_with("experience", "_x", lambda x, d: x.withField("start", d["s"]["value"]).withField("end", d["e"]["value"]))
    changed = (F.col("_e.value") != F.col("emails")).cast("int") + (F.col("_p.value") != F.col("phones")).cast("int")
    changed = changed + F.when(non_empty(F.col("country")) & ~F.col("_c.value").eqNullSafe(F.col("country")), 1).otherwise(0) + (dated != F.col("experience")).cast("int")
    rules = F.concat("_e.rules", "_p.rules", F.coalesce("_c.rules", F.array().cast(f"array<{N.RULE}>")), F.flatten(F.transform("_x", lambda d: F.concat(d["s"]["rules"], d["e"]["rules"]))))
    return step.withColumns({
        "_rules": rules, "_duplicates": F.col("_e.duplicates") + F.col("_p.duplicates"), "_changed": changed,
        "emails": F.col("_e.value"), "phones": F.col("_p.value"), "country": F.col("_c.value"), "experience": dated,
    }).drop("_e", "_p", "_c", "_x")


def canonicalize(records: DataFrame) -> DataFrame:
    """Skills canonicalized; adds to _rules and _duplicates."""
    step = records.withColumn("_s", N.skill_list(F.col("skills")))
    return step.withColumns({"_rules": F.concat("_rules", "_s.rules"), "_duplicates": F.col("_duplicates") + F.col("_s.duplicates"), "skills": F.col("_s.value")}).drop("_s")


def described(rule: Column, before: Column, after: Column) -> Column:
    """What a rule has done, in words."""
    def say(*parts: object) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in parts])

    region = F.lit("unknown")
    for name, (code, *_) in sorted(dims.PHONE_RULES.items(), key=lambda r: len(r[1][0])):  # the longest code is asked first
        region = F.when(after.startswith("+" + code), name).otherwise(region)
    texts = {
        "email_validation_failed": say("Email '", before, "' failed RFC validation"), "trim_whitespace": say("Email trim whitespace"), "lowercase": say("Email lowercase"), "remove_duplicate_email": say("Duplicate email '", before, "' removed"),
        "convert_to_e164": say("Converted to E.164 format (detected country: ", region, ")"), "phone_validation_failed": say("Phone '", before, "' is not a valid number"),
        "phone_parse_failed": say("Phone '", before, "' could not be parsed"), "remove_duplicate_phone": say("Duplicate phone '", before, "' removed"),
        "country_code_uppercase": say("Country code '", before, "' uppercased to '", after, "'"), "country_alias_resolve": say("Country '", before, "' resolved to ISO-3166 '", after, "' via alias"),
        "country_name_resolve": say("Country '", before, "' resolved to ISO-3166 '", after, "'"), "country_fuzzy_resolve": say("Country '", before, "' fuzzy-matched to ISO-3166 '", after, "'"),
        "country_resolve_failed": say("Country '", before, "' could not be resolved to ISO-3166"), "skill_canonicalize": say("Skill '", before, "' canonicalized to '", after, "'"),
        "skill_title_case": say("Skill '", before, "' title-cased to '", after, "'"), "remove_duplicate_skill": say("Duplicate skill '", before, "' removed"),
        "date_year_only": say("Year-only date '", before, "' defaulted to January"), "date_format_normalize": say("Date '", before, "' normalized to YYYY-MM format"), "date_parse_failed": say("Date '", before, "' could not be parsed"),
    }
    out = F.lit("")
    for name, text in texts.items():
        out = F.when(rule == name, text).otherwise(out)
    return out


def rule_log(records: DataFrame, *keys: str) -> DataFrame:
    """One row for every rule that was applied, with its description and stage."""
    log = records.select(*keys, "source_file", "file_seq", "row_seq", F.posexplode("_rules").alias("step", "r")).select(*keys, "source_file", "file_seq", "row_seq", "step", "r.*")
    stage = F.when(F.col("category") == "skill", "canonicalization").otherwise("normalization")
    return log.withColumns({"description": described(F.col("rule"), F.col("before"), F.col("after")), "stage": stage})


#: The stages that change a field, in their order.
STAGES = ["normalization", "canonicalization", "conflict_resolution"]
_ORDER = ["stage_order", "file_seq", "row_seq", "step"]


def steps(log: DataFrame, *keys: str, conflicts: DataFrame | None = None) -> DataFrame:
    """(keys, field, order, and what happened): every transformation of a field in the order of the stages, conflicts as steps that give their winner; dates have none."""
    number = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")
    out = log.filter("category <> 'date'").select(*keys, "field", number.alias("stage_order"), F.col("file_seq").cast("long"), F.col("row_seq").cast("long"), F.col("step").cast("int"), "stage", "rule", "before", "after", "description")
    if conflicts is None:
        return out
    values = F.to_json(F.transform("candidates", lambda c: c["value"]))
    settled = conflicts.select(
        *keys, "field", F.lit(len(STAGES)).alias("stage_order"), F.lit(0).cast("long").alias("file_seq"), F.lit(0).cast("long").alias("row_seq"), F.lit(0).alias("step"), F.lit(STAGES[-1]).alias("stage"),
        F.lit("priority_based_conflict_resolution").alias("rule"), values.alias("before"), F.col("winner.value").alias("after"), F.col("explanation").alias("description"),
    )
    return out.unionByName(settled)


def chain_totals(log: DataFrame, *keys: str, conflicts: DataFrame | None = None) -> DataFrame:
    """Per field the number of its transformations, the first rule and the last value; no list of them is gathered, so a field may have any number."""
    order = F.struct(*_ORDER)
    last, begin = F.max_by(F.struct("after"), order), F.min_by(F.struct("rule"), order)
    return steps(log, *keys, conflicts=conflicts).groupBy(*keys, "field").agg(F.count("*").cast("int").alias("total"), begin.alias("_first"), last.alias("_last")).select(*keys, "field", "total", F.col("_first.rule").alias("first_rule"), F.col("_last.after").alias("final"))


def chains(log: DataFrame, *keys: str, conflicts: DataFrame | None = None) -> DataFrame:
    """Per field, its transformations in order, their number and the last value: a fold over the ordered steps."""
    listed = F.array_sort(F.collect_list(F.struct(*_ORDER, "stage", "rule", "before", "after", "description")))
    folded = F.aggregate("steps", F.struct(F.lit(0).alias("total"), F.lit(None).cast("string").alias("final")), lambda a, s: F.struct((a["total"] + 1).alias("total"), s["after"].alias("final")))
    out = steps(log, *keys, conflicts=conflicts).groupBy(*keys, "field").agg(listed.alias("steps")).withColumn("_f", folded)
    return out.select(*keys, "field", "steps", "_f.total", "_f.final")
