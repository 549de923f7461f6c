"""Registered queries: every operator on the driver's tables, flat columns, and the SQL that states the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.functions import dims, normalize, schema, text
from meldwork.operators import analytics, clean, merge, project, score
from meldwork.plans import reader_queries
from meldwork.sources import files

BY = ["entity_id"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, *choices: Column) -> Column:
    """The choice that key modulo their number says."""
    out = choices[-1]
    for i, c in enumerate(choices[:-1]):
        out = F.when(key % len(choices) == i, c).otherwise(out)
    return out


def _pick_sql(key: str, *choices: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(choices)} = {i} THEN {c}" for i, c in enumerate(choices[:-1])) + f" ELSE {choices[-1]} END"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in pairs.items()) + "}"


SKILL_RAW = ["js", "ReactJS", "graph theory", "K8s", "foo.bar", "3d", "python3", "Go"]
COUNTRY_RAW = ["uk", "India", "U.K.", "zz", "England", "nowhere land", " usa ", "Germany"]
ALIAS = dims.SKILLS
COUNTRY = dims.COUNTRIES
_EMAILS = f"list_sort(list_distinct(regexp_extract_all(text, {_q(dims.EMAIL)})))"
_PHONES = f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, {_q(dims.PHONE)}), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)))))"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from four tables of different trust: suppliers, customers, documents, conversations."""
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))  # 25 rows
    supplier = _t(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("entity_id"), F.lit("recruiter_csv").alias("source_type"), F.lit("supplier").alias("source_file"), F.lit(0).alias("file_seq"), F.col("s_suppkey").alias("row_seq"),
        F.col("s_name").alias("full_name"), "country", F.floor(F.abs("s_acctbal") / 1000).cast("int").alias("years_experience"))
    customer = _t(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 100).alias("entity_id"), F.lit("ats_json").alias("source_type"), F.lit("customer").alias("source_file"), F.lit(1).alias("file_seq"), F.col("c_custkey").alias("row_seq"),
        F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("headline"), F.array(_pick(F.col("c_custkey"), *map(F.lit, SKILL_RAW)), F.lit("SQL")).alias("skills"),
        F.array(F.struct(F.col("c_name").alias("company"), F.col("c_mktsegment").alias("title"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("summary"))).alias("experience"))
    documents = _t(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 100).alias("entity_id"), F.lit("resume_pdf").alias("source_type"), F.lit("documents").alias("source_file"), F.lit(2).alias("file_seq"), F.col("doc_id").alias("row_seq"),
        F.col("lang").alias("headline"), text.emails(F.col("text")).alias("emails"), text.phones(F.col("text")).alias("phones"))
    talks = _t(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 100).alias("entity_id"), F.lit("recruiter_notes").alias("source_type"), F.lit("conversations").alias("source_file"), F.lit(3).alias("file_seq"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_seq"),
        F.col("role").alias("headline"))
    out = schema.as_records(supplier, *BY)
    for part in (customer, documents, talks):
        out = out.unionByName(schema.as_records(part, *BY))
    return out.withColumn("candidate_id", clean.entity_id(F.col("full_name"), F.col("emails"), F.col("source_file")))


EVIDENCE = f"""
WITH evidence AS (
  SELECT s_suppkey AS entity_id, 'recruiter_csv' AS source_type, 2 AS priority, 0.95 AS weight, 'supplier' AS source_file, 0 AS file_seq, s_suppkey AS row_seq, s_name AS full_name, CAST(NULL AS VARCHAR) AS headline, n_name AS country,
         CAST(floor(abs(s_acctbal) / 1000) AS INTEGER) AS years, CAST([] AS VARCHAR[]) AS emails, CAST([] AS VARCHAR[]) AS phones, CAST([] AS VARCHAR[]) AS skills, CAST(NULL AS VARCHAR) AS title
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT c_custkey % 100, 'ats_json', 3, 0.9, 'customer', 1, c_custkey, c_name, c_mktsegment, NULL, NULL, [], [], [{_pick_sql("c_custkey", *map(_q, SKILL_RAW))}, 'SQL'], c_mktsegment FROM customer
  UNION ALL
  SELECT doc_id % 100, 'resume_pdf', 5, 0.8, 'documents', 2, doc_id, NULL, lang, NULL, NULL, {_EMAILS}, {_PHONES}, [], NULL FROM documents
  UNION ALL
  SELECT conv_id % 100, 'recruiter_notes', 6, 0.7, 'conversations', 3, conv_id * 1000 + turn, NULL, role, NULL, NULL, [], [], [], NULL FROM conversations
), ranked AS (SELECT *, [priority, file_seq, row_seq] AS ord FROM evidence)
"""
_LONG = """
, long AS (
  SELECT entity_id, source_file, source_type, priority, ord, 'full_name' AS field, full_name AS value FROM ranked WHERE full_name <> ''
  UNION ALL SELECT entity_id, source_file, source_type, priority, ord, 'headline', headline FROM ranked WHERE headline <> ''
  UNION ALL SELECT entity_id, source_file, source_type, priority, ord, 'location.country', country FROM ranked WHERE country <> ''
  UNION ALL SELECT entity_id, source_file, source_type, priority, ord, 'years_experience', CAST(years AS VARCHAR) FROM ranked WHERE years IS NOT NULL
), contested AS (
  SELECT *, count(*) OVER (PARTITION BY entity_id, field) AS n, row_number() OVER (PARTITION BY entity_id, field ORDER BY ord) AS rank FROM long QUALIFY n > 1
)
"""
_CANON = """
, canon AS (
  SELECT entity_id, arg_min(full_name, ord) FILTER (full_name <> '') AS full_name, arg_min(headline, ord) FILTER (headline <> '') AS headline, arg_min(country, ord) FILTER (country <> '') AS country,
         arg_min(years, ord) FILTER (years IS NOT NULL) AS years, list_sort(list_distinct(list_transform(flatten(list(emails)), lambda x: lower(x)))) AS emails, list_sort(list_distinct(flatten(list(phones)))) AS phones,
         count(DISTINCT file_seq) AS files, count(title) AS n_exp, count(*) AS n_records, count(*) FILTER (len(skills) > 0) AS n_skills
  FROM ranked GROUP BY entity_id
)
"""
_SCORES = """
, share AS (
  SELECT entity_id, count(DISTINCT file_seq) AS files,
         count(*) FILTER (full_name <> '') AS n1, max(weight) FILTER (full_name <> '') AS w1, count(*) FILTER (len(emails) > 0) AS n2, max(weight) FILTER (len(emails) > 0) AS w2,
         count(*) FILTER (len(phones) > 0) AS n3, max(weight) FILTER (len(phones) > 0) AS w3, count(*) FILTER (country <> '') AS n4, max(weight) FILTER (country <> '') AS w4,
         count(*) FILTER (headline <> '') AS n5, max(weight) FILTER (headline <> '') AS w5, count(*) FILTER (len(skills) > 0) AS n6, max(weight) FILTER (len(skills) > 0) AS w6,
         count(*) FILTER (title IS NOT NULL) AS n7, max(weight) FILTER (title IS NOT NULL) AS w7
  FROM ranked GROUP BY entity_id
), conf AS (
  SELECT entity_id, unnest(['full_name', 'emails', 'phones', 'location', 'headline', 'skills', 'experience', 'education', 'links']) AS field, unnest([n1, n2, n3, n4, n5, n6, n7, 0, 0]) AS n,
         unnest(list_transform([[n1, w1], [n2, w2], [n3, w3], [n4, w4], [n5, w5], [n6, w6], [n7, w7], [0, 0.5], [0, 0.5]],
           lambda x: CASE WHEN x[1] > 0 THEN round_even(CAST(x[2] AS DOUBLE) * greatest(0.5::DOUBLE, least(1.0::DOUBLE, CAST(x[1] AS DOUBLE) / files)), 4) ELSE 0.0::DOUBLE END)) AS confidence
  FROM share
)
"""


def q_source_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    key = F.col("page_id")
    name = F.concat(F.lit("f"), key, _pick(key, *map(F.lit, [".csv", ".PDF", ".docx", ".doc", ".txt", ".json", ".xyz"])))
    body = _pick(key, F.lit('{"headline": 1}'), F.lit("[1]"), F.lit("bad"), F.lit('{"name": 1}'))
    step = pages.select("page_id", files.source_type(name, body).alias("source_type"), files.mime_type(name).alias("mime"))
    return step.withColumn("priority", schema.priority(F.col("source_type")))


_DETECT = "CASE page_id % 7 WHEN 0 THEN 'recruiter_csv' WHEN 1 THEN 'resume_pdf' WHEN 2 THEN 'resume_docx' WHEN 3 THEN 'resume_docx' WHEN 4 THEN 'recruiter_notes' WHEN 5 THEN CASE WHEN page_id % 4 = 0 THEN 'linkedin_json' ELSE 'ats_json' END ELSE 'unknown' END"
SQL_SOURCE_DETECT = f"""
SELECT page_id, source_type, CASE page_id % 7 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'application/pdf' WHEN 2 THEN {_q(dims.EXTENSIONS[".docx"][1])} WHEN 3 THEN 'application/msword' WHEN 4 THEN 'text/plain' WHEN 5 THEN 'application/json' END AS mime,
       CASE source_type WHEN 'recruiter_csv' THEN 2 WHEN 'ats_json' THEN 3 WHEN 'linkedin_json' THEN 4 WHEN 'resume_pdf' THEN 5 WHEN 'resume_docx' THEN 5 WHEN 'recruiter_notes' THEN 6 ELSE 7 END AS priority
FROM (SELECT page_id, {_DETECT} AS source_type FROM pages)
"""


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path into JSON with a guarded cast."""
    k = F.get_json_object("props", "$.k")
    return _t(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"), F.coalesce(F.array_join(F.json_object_keys("props"), ","), F.lit("")).alias("keys"), k.isNotNull().alias("present"))


SQL_JSON_PROPS = "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(array_to_string(json_keys(props), ','), '') AS keys, json_extract_string(props, '$.k') IS NOT NULL AS present FROM events"


def q_csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV header aliases over a map of cells: the first alias that is a header decides; lists split and stripped."""
    part = _t(spark, sf_dir, "part")
    header = _pick(F.col("p_partkey"), *map(F.lit, ["skills", "key_skills", "other"]))
    cells = F.create_map(F.lit("name"), _pick(F.col("p_partkey"), F.col("p_name"), F.lit("  "), F.col("p_brand")), header, F.regexp_replace("p_name", " ", " , "), F.lit("yoe"), F.col("p_retailprice").cast("string"), F.lit("current_company"), F.col("p_brand"))
    rows = part.select(F.lit("r").alias("run_id"), F.lit("f").alias("source_file"), F.lit("recruiter_csv").alias("source_type"), F.lit(0).alias("file_seq"), F.col("p_partkey").alias("row_seq"), cells.alias("cells"))
    out = files.csv_projection(rows)
    return out.select(F.col("row_seq").alias("p_partkey"), "full_name", F.array_join("skills", "|").alias("skills"), "years_experience", F.col("experience")[0]["company"].alias("company"))


SQL_CSV_SPLIT = """
SELECT p_partkey, full_name, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE replace(p_name, ' ', '|') END AS skills, CAST(floor(p_retailprice) AS INTEGER) AS years_experience, p_brand AS company
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN NULL ELSE p_brand END AS full_name FROM part) WHERE full_name IS NOT NULL
"""


def q_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    join = lambda c: F.array_join(c, "|")
    return _t(spark, sf_dir, "documents").select("doc_id", join(text.emails(t)).alias("emails"), join(text.phones(t)).alias("phones"), join(text.urls(t)).alias("urls"), text.first_match(t, dims.LINKEDIN_URL).alias("linkedin"))


SQL_EXTRACT = f"""
SELECT doc_id, array_to_string({_EMAILS}, '|') AS emails, array_to_string({_PHONES}, '|') AS phones,
       array_to_string(list_filter(regexp_extract_all(text, {_q(dims.URL)}), lambda x: NOT contains(lower(x), 'linkedin') AND NOT contains(lower(x), 'github')), '|') AS urls, nullif(regexp_extract(text, {_q(dims.LINKEDIN_URL)}), '') AS linkedin
FROM documents
"""


def q_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(text.urls(F.concat_ws(" ", "url", F.lit("https://github.com/x"), "url")), "|").alias("urls"), text.first_match(F.concat(F.lit("see github.com/me/repo "), "url"), dims.GITHUB_URL).alias("github"))


SQL_PAGE_URLS = f"""
SELECT page_id, array_to_string(list_filter(regexp_extract_all(url || ' https://github.com/x ' || url, {_q(dims.URL)}), lambda x: NOT contains(lower(x), 'linkedin') AND NOT contains(lower(x), 'github')), '|') AS urls,
       nullif(regexp_extract('see github.com/me/repo ' || url, {_q(dims.GITHUB_URL)}), '') AS github FROM pages
"""


def q_extract_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.name_line(F.col("text")).alias("name"))


SQL_EXTRACT_NAME = f"""
SELECT doc_id, list_filter(list_transform(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1:5], lambda x: trim(x, ' ' || chr(9) || chr(13))),
  lambda x: length(x) BETWEEN 2 AND 49 AND NOT regexp_matches(x, {_q(dims.EMAIL)}) AND NOT regexp_matches(x, {_q(dims.URL)}) AND NOT (regexp_matches(x, {_q(dims.PHONE)}) AND length(x) < 20) AND regexp_matches(x, {_q(dims.NAME_LINE)}))[1] AS name
FROM documents
"""


def q_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), "|").alias("keywords"))


def _keyword_sql(word: str) -> str:
    """Whether the word stands in the text between word boundaries, by regular expression of DuckDB's own."""
    escaped = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in word)
    behind = "($|[^\\p{L}\\p{N}_])" if word[-1].isalnum() else "[\\p{L}\\p{N}_]"
    return f"regexp_matches(lower(text), {_q('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])' + escaped + behind)})"


SQL_KEYWORDS = "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_keyword_sql(k)} THEN {_q(k)} END" for k in sorted(dims.KEYWORDS)) + "], lambda x: x IS NOT NULL), '|') AS keywords FROM documents"


def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-line blocks of a text and the experience entry of the first."""
    found = text.blocks(F.regexp_replace("text", r"\. ", ".\n\n"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_blocks"), text.experience_block(F.get(found, F.lit(0)))["title"].alias("title"))


SQL_BLOCKS = """
SELECT doc_id, len(b) AS n_blocks, list_filter(list_transform(string_split(b[1], chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1] AS title
FROM (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(text, '\\. ', '.' || chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), '\\n[ \\t\\n\\f\\r]*\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS b FROM documents)
"""


def q_entity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _pick(F.col("c_custkey"), F.concat(F.lit(" "), "c_name"), F.lit(None).cast("string"), F.lit(""))
    emails = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.upper("c_name"), F.lit("@X.io")))).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf_dir, "customer").select("c_custkey", clean.entity_id(name, emails, F.lit("file.csv")).alias("candidate_id"))


SQL_ENTITY_ID = """
SELECT c_custkey, 'CND-' || upper(substr(sha256(CASE WHEN p <> '' THEN p ELSE 'file.csv' END), 1, 12)) AS candidate_id
FROM (SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) END, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name || '@x.io') END) AS p FROM customer)
"""


def _mails() -> Column:
    n = F.lower(F.regexp_replace("c_name", "#", "."))
    return F.array(_pick(F.col("c_custkey"), F.concat(F.lit(" "), F.upper(n), F.lit("@X.IO ")), F.concat(n, F.lit("@x")), F.concat(n, F.lit("@x.io")), F.lit("")), F.concat(n, F.lit("@x.io")), F.lit("a@a.org"))


def q_email_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _t(spark, sf_dir, "customer").withColumn("r", normalize.email_list(_mails()))
    return out.select("c_custkey", F.array_join("r.value", "|").alias("emails"), F.col("r.duplicates").alias("duplicates"), F.array_join(F.transform("r.rules", lambda x: x["rule"]), "|").alias("rules"))


SQL_EMAIL_LIST = """
SELECT c_custkey, 'a@a.org|' || n || '@x.io' AS emails, CASE WHEN c_custkey % 4 IN (0, 2) THEN 1 ELSE 0 END AS duplicates,
       CASE c_custkey % 4 WHEN 0 THEN 'trim_whitespace|lowercase|remove_duplicate_email' WHEN 1 THEN 'email_validation_failed' WHEN 2 THEN 'remove_duplicate_email' ELSE 'email_validation_failed' END AS rules
FROM (SELECT c_custkey, lower(replace(c_name, '#', '.')) AS n FROM customer)
"""


def q_phone_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    raw = _pick(F.col("c_custkey"), F.concat(F.lit("9"), d), F.concat(F.lit("+91-9"), d), F.concat(F.lit("09"), d), F.concat(F.lit("0044 7"), d), F.concat(F.lit("+1 (2)"), d), F.lit("call me"), F.lit("12345"))
    out = _t(spark, sf_dir, "customer").withColumn("r", normalize.phone(raw))
    return out.select("c_custkey", F.col("r.value").alias("phone"), F.array_join(F.transform("r.rules", lambda x: x["rule"]), "|").alias("rules"))


SQL_PHONE_NORM = """
SELECT c_custkey, CASE c_custkey % 7 WHEN 3 THEN '+447' || d WHEN 4 THEN '+12' || d WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE '+919' || d END AS phone,
       CASE c_custkey % 7 WHEN 5 THEN 'phone_parse_failed' WHEN 6 THEN 'phone_validation_failed' ELSE 'convert_to_e164' END AS rules
FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d FROM customer)
"""


def q_date_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderdate")
    raw = _pick(F.col("o_orderkey"), *[F.date_format(o, p) for p in ("yyyy-MM", "yyyy", "MMM yyyy", "MM/yyyy", "yyyy-MM-dd", "MMMM d, yyyy")], F.lit("NOW"), F.lit("hello"))
    out = _t(spark, sf_dir, "orders").withColumn("r", normalize.date(raw))
    return out.select("o_orderkey", F.col("r.value").alias("month"), F.array_join(F.transform("r.rules", lambda x: x["rule"]), "|").alias("rules"))


SQL_DATE_NORM = """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01' WHEN 6 THEN 'Present' WHEN 7 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month,
       CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'date_year_only' WHEN 6 THEN '' WHEN 7 THEN 'date_parse_failed' ELSE 'date_format_normalize' END AS rules FROM orders
"""


def q_country_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pick(F.col("c_custkey"), *map(F.lit, COUNTRY_RAW))
    out = _t(spark, sf_dir, "customer").withColumn("r", normalize.country(raw, normalize.iso_countries(spark)))
    return out.select("c_custkey", F.col("r.value").alias("country"), F.array_join(F.transform("r.rules", lambda x: x["rule"]), "|").alias("rules"))


SQL_COUNTRY_NORM = f"""
SELECT c_custkey, CASE WHEN length(x) = 2 THEN upper(x) ELSE map_extract_value({_map(COUNTRY)}, lower(x)) END AS country,
       CASE WHEN length(x) = 2 THEN 'country_code_uppercase' WHEN map_extract_value({_map(COUNTRY)}, lower(x)) IS NOT NULL THEN 'country_alias_resolve' ELSE 'country_resolve_failed' END AS rules
FROM (SELECT c_custkey, trim({_pick_sql("c_custkey", *map(_q, COUNTRY_RAW))}) AS x FROM customer)
"""


def q_skill_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(_pick(F.col("p_partkey"), *map(F.lit, SKILL_RAW)), F.col("p_type"), F.lit("javascript"))
    out = _t(spark, sf_dir, "part").withColumn("r", normalize.skill_list(raw))
    return out.select("p_partkey", F.array_join("r.value", "|").alias("skills"), F.col("r.duplicates").alias("duplicates"), F.array_join(F.transform("r.rules", lambda x: x["rule"]), "|").alias("rules"))


_SKILL = f"coalesce(map_extract_value({_map(ALIAS)}, lower(x)), array_to_string(list_transform(regexp_extract_all(x, '(\\p{{L}}+|\\P{{L}}+)', 1), lambda y: upper(y[1]) || lower(y[2:])), ''))"
SQL_SKILL_LIST = f"""
WITH s AS (SELECT p_partkey, [{_pick_sql("p_partkey", *map(_q, SKILL_RAW))}, p_type, 'javascript'] AS raw FROM part), v AS (SELECT p_partkey, raw, list_transform(raw, lambda x: {_SKILL}) AS v FROM s)
SELECT p_partkey, array_to_string(list_sort(list_distinct(v)), '|') AS skills, len(v) - len(list_distinct(v)) AS duplicates,
       array_to_string(list_concat(list_filter(list_transform(list_zip(raw, v), lambda z: CASE WHEN z[1] = z[2] THEN NULL WHEN map_extract_value({_map(ALIAS)}, lower(z[1])) IS NOT NULL THEN 'skill_canonicalize' ELSE 'skill_title_case' END), lambda r: r IS NOT NULL),
         list_transform(range(len(v) - len(list_distinct(v))), lambda i: 'remove_duplicate_skill')), '|') AS rules
FROM v
"""


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_custkey").alias("row_seq"), F.lit(0).alias("file_seq"), F.lit("customer").alias("source_file"), F.lit("ats_json").alias("source_type"), F.col("c_name").alias("full_name"), _pick(F.col("c_custkey"), *map(F.lit, COUNTRY_RAW)).alias("country"), F.array(_pick(F.col("c_custkey"), *map(F.lit, SKILL_RAW))).alias("skills"), _mails().alias("emails"))
    return clean.rule_log(clean.canonicalize(clean.normalize(clean.parse(schema.as_records(rows, *BY)))), *BY)


def q_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by name and category after cleaning, normalizing and canonicalizing."""
    return _logged(spark, sf_dir).groupBy("category", "rule").agg(F.count("*").alias("n"))


_RULES = f"""
WITH c AS (SELECT c_custkey % 4 AS k, trim({_pick_sql("c_custkey", *map(_q, COUNTRY_RAW))}) AS x, {_pick_sql("c_custkey", *map(_q, SKILL_RAW))} AS s, {_pick_sql("c_custkey", *map(_q, COUNTRY_RAW))} AS raw FROM customer),
log AS (
  SELECT 'email' AS category, 'lowercase' AS rule FROM c WHERE k = 0
  UNION ALL SELECT 'email', 'remove_duplicate_email' FROM c WHERE k IN (0, 2)
  UNION ALL SELECT 'email', 'email_validation_failed' FROM c WHERE k = 1
  UNION ALL SELECT 'location', CASE WHEN length(x) = 2 THEN 'country_code_uppercase' WHEN map_extract_value({_map(COUNTRY)}, lower(x)) IS NOT NULL THEN 'country_alias_resolve' ELSE 'country_resolve_failed' END FROM c
  UNION ALL SELECT 'skill', CASE WHEN map_extract_value({_map(ALIAS)}, lower(s)) IS NOT NULL THEN 'skill_canonicalize' ELSE 'skill_title_case' END FROM c WHERE s NOT IN ('Go')
)"""
SQL_RULE_COUNTS = _RULES + " SELECT category, rule, count(*) AS n FROM log GROUP BY category, rule"


def q_rule_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _logged(spark, sf_dir)
    return analytics.search_counts(log, "CANONICAL", "skill").crossJoin(analytics.rule_totals(log)).crossJoin(analytics.categories(log).agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")))  # one row each


SQL_RULE_SEARCH = _RULES + " SELECT count(*) FILTER (category = 'skill' AND contains(rule, 'canonical')) AS filtered, count(*) AS total, count(*) AS total_rules, count(*) FILTER (rule = 'skill_canonicalize') AS canonicalized_skills, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM log"


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(evidence(spark, sf_dir), BY)


def q_merge_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("entity_id", "candidate_id", "full_name", "headline", F.col("location.country").alias("country"), "years_experience", "n_records")


SQL_MERGE_SCALAR = EVIDENCE + """
SELECT entity_id, arg_min('CND-' || upper(substr(sha256(CASE WHEN full_name <> '' AND len(emails) > 0 THEN lower(full_name) || '|' || lower(emails[1]) WHEN full_name <> '' THEN lower(full_name) WHEN len(emails) > 0 THEN lower(emails[1]) ELSE source_file END), 1, 12)), ord) AS candidate_id,
       coalesce(arg_min(full_name, ord) FILTER (full_name <> ''), '') AS full_name, arg_min(headline, ord) FILTER (headline <> '') AS headline, arg_min(country, ord) FILTER (country <> '') AS country,
       arg_min(years, ord) FILTER (years IS NOT NULL) AS years_experience, count(*) AS n_records FROM ranked GROUP BY entity_id
"""


def q_merge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("entity_id", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), F.size("experience").alias("n_experience"), F.sha2(F.array_join(F.transform("experience", lambda x: x["title"]), "|"), 256).alias("titles"))


SQL_MERGE_SETS = EVIDENCE + _CANON + """
SELECT c.entity_id, array_to_string(emails, '|') AS emails, array_to_string(phones, '|') AS phones, n_exp AS n_experience,
       sha256(coalesce((SELECT string_agg(title, '|' ORDER BY ord) FROM ranked r WHERE r.entity_id = c.entity_id AND title IS NOT NULL), '')) AS titles FROM canon c
"""


def q_skill_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.skill_rollup(evidence(spark, sf_dir), BY)
    return out.select("entity_id", F.array_join(F.transform("skills", lambda s: F.concat(s["name"], F.lit(":"), F.array_join(s["sources"], "+"))), "|").alias("skills"))


SQL_SKILL_ROLLUP = EVIDENCE + """
, each AS (SELECT entity_id, source_type, ord, unnest(skills) AS name, unnest(range(len(skills))) AS pos FROM ranked), rolled AS (SELECT entity_id, arg_min(name, list_append(ord, pos)) AS name, any_value(source_type) AS source FROM each GROUP BY entity_id, lower(name))
SELECT entity_id, string_agg(name || ':' || source, '|' ORDER BY name) AS skills FROM rolled GROUP BY entity_id
"""


def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.conflicts(merge.candidates(evidence(spark, sf_dir), BY), BY)
    return out.select("entity_id", "field", F.size("candidates").alias("n"), F.col("winner.value").alias("winner"), F.col("winner.priority").alias("priority"), F.size("rejected").alias("rejected"), F.sha2("explanation", 256).alias("explanation"))


_NAMES = "CASE source_type WHEN 'recruiter_csv' THEN 'Recruiter CSV' WHEN 'ats_json' THEN 'ATS JSON' WHEN 'resume_pdf' THEN 'Resume PDF' ELSE 'Recruiter Notes' END"
SQL_CONFLICTS = EVIDENCE + _LONG + f"""
SELECT entity_id, field, count(*) AS n, max(value) FILTER (rank = 1) AS winner, max(priority) FILTER (rank = 1) AS priority, count(*) - 1 AS rejected,
       sha256(string_agg(CASE WHEN rank = 1 THEN '''' || field || ''' selected from ' || {_NAMES} || ' (priority ' || priority || ') because it has higher source priority.' ELSE 'Rejected ''' || value || ''' from ' || {_NAMES} || ' (priority ' || priority || ').' END, ' ' ORDER BY rank)) AS explanation
FROM contested GROUP BY entity_id, field
"""


def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = evidence(spark, sf_dir)
    rows = merge.provenance(merge.candidates(records, BY), merge.merge(records, BY, *merge.lead()), BY)
    return rows.groupBy("field", "source", "source_type", "accepted", "contested").agg(F.count("*").alias("n"), F.min("priority").alias("priority"), F.count_if(F.col("value") == F.col("winning_value")).alias("equal"), F.min("explanation").alias("explanation"))


SQL_PROVENANCE = EVIDENCE + _LONG + _CANON + """
, lead AS (SELECT entity_id, arg_min(source_file, ord) AS source, arg_min(source_type, ord) AS source_type FROM ranked GROUP BY entity_id),
plain AS (SELECT entity_id, 'full_name' AS field FROM canon WHERE full_name <> '' UNION ALL SELECT entity_id, 'headline' FROM canon WHERE headline <> '' UNION ALL SELECT entity_id, 'emails' FROM canon WHERE len(emails) > 0 UNION ALL SELECT entity_id, 'phones' FROM canon WHERE len(phones) > 0),
named AS (SELECT *, CASE source_type WHEN 'recruiter_csv' THEN 'Recruiter CSV' WHEN 'ats_json' THEN 'ATS JSON' WHEN 'resume_pdf' THEN 'Resume PDF' ELSE 'Recruiter Notes' END AS name FROM contested),
won AS (SELECT entity_id, field, value AS w_value, priority AS w_priority, name AS w_name FROM named WHERE rank = 1),
rows_ AS (SELECT field, source_file AS source, source_type, rank = 1 AS accepted, true AS contested, priority, value = w_value AS equal,
    CASE WHEN rank = 1 THEN 'Selected from ' || name || ' — highest priority source.' ELSE 'Rejected: ' || name || ' (priority ' || priority || ') lost to ' || w_name || ' (priority ' || w_priority || ').' END AS explanation FROM named JOIN won USING (entity_id, field)
  UNION ALL SELECT p.field, l.source, l.source_type, true, false, 99, true, 'Single source value from ' || l.source || '. No conflict.' FROM plain p JOIN lead l USING (entity_id) WHERE NOT EXISTS (SELECT 1 FROM contested c WHERE c.entity_id = p.entity_id AND c.field = p.field))
SELECT field, source, source_type, accepted, contested, count(*) AS n, min(priority) AS priority, count(*) FILTER (equal) AS equal, min(explanation) AS explanation FROM rows_ GROUP BY field, source, source_type, accepted, contested
"""


def q_conflict_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.per_field(merge.candidates(evidence(spark, sf_dir), BY).filter("rank = 1"))
    return found.withColumns({"win_rate": analytics.win_rate(F.col("n"), F.col("n")), "ratio": analytics.transform_ratio(F.lit(None).cast("int"), F.col("n"))})


SQL_CONFLICT_FIELDS = EVIDENCE + _LONG + "SELECT field, count(*) AS n, 100.0::DOUBLE AS win_rate, 0.0::DOUBLE AS ratio FROM contested WHERE rank = 1 GROUP BY field"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = evidence(spark, sf_dir)
    return score.quality(score.confidence(merge.merge(records, BY, *score.contributions())))


def q_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, sf_dir).select("entity_id", F.explode("field_confidences").alias("f"))
    return out.select("entity_id", "f.field", "f.confidence", "f.sources_agreeing", analytics.confidence_band(F.col("f.confidence")).alias("band"))


SQL_CONFIDENCE = EVIDENCE + _SCORES + "SELECT entity_id, field, confidence, n AS sources_agreeing, CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.5 THEN 'medium' ELSE 'low' END AS band FROM conf"


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality_score")
    return scored(spark, sf_dir).select("entity_id", "overall_confidence", q["overall_score"].alias("quality"), F.array_join(q["missing_fields"], "|").alias("missing"), F.size(q["suggestions"]).alias("suggestions"), analytics.quality_band(q["overall_score"]).alias("band"))


SQL_QUALITY = EVIDENCE + _CANON + _SCORES + """
, overall AS (SELECT entity_id, round_even(sum(confidence) / 9, 4) AS overall_confidence FROM (SELECT * FROM conf ORDER BY entity_id) GROUP BY entity_id),
q AS (SELECT entity_id, [[length(coalesce(full_name, '')) > 1], [len(emails) > 0], [len(phones) > 0], [coalesce(country <> '', false)], [coalesce(headline <> '', false)], [n_skills > 0], [n_exp > 0], [false], [false], [false]] AS ok FROM canon),
z AS (SELECT entity_id, list_zip(flatten(ok), [15, 12, 10, 8, 8, 15, 15, 10, 4, 3], ['Full Name', 'Email Address', 'Phone Number', 'Location', 'Professional Headline', 'Skills', 'Work Experience', 'Education', 'LinkedIn Profile', 'GitHub Profile']) AS z FROM q),
s AS (SELECT entity_id, round_even(CAST(list_sum(list_transform(z, lambda x: CASE WHEN x[1] THEN x[2] ELSE 0 END)) AS DOUBLE) / 100 * 100, 1) AS quality, list_transform(list_filter(z, lambda x: NOT x[1]), lambda x: x[3]) AS m FROM z)
SELECT entity_id, overall_confidence, quality, array_to_string(m, '|') AS missing, len(m) AS suggestions, CASE WHEN quality >= 80 THEN 'good' WHEN quality >= 50 THEN 'fair' ELSE 'poor' END AS band FROM s JOIN overall USING (entity_id)
"""


def q_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = project.OutputConfig.parse({"include_provenance": False, "include_confidence": False, "fields": [{"path": "full_name"}, {"path": "email0", "from": "emails[0]"}, {"path": "email9", "from": "emails[9]"}, {"path": "country", "from": "location.country"}, {"path": "names", "from": "skills[].name"}, {"path": "nothing", "from": "a.b"}]})
    out = project.project(_merged(spark, sf_dir), BY, wanted)
    return out.withColumn("names", F.array_join("names", "|"))


SQL_PROJECTION = EVIDENCE + _CANON + """
, names AS (SELECT entity_id, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT entity_id, arg_min(name, list_append(ord, pos)) AS name FROM (SELECT entity_id, ord, unnest(skills) AS name, unnest(range(len(skills))) AS pos FROM ranked) GROUP BY entity_id, lower(name)) GROUP BY entity_id)
SELECT c.entity_id, coalesce(full_name, '') AS full_name, emails[1] AS email0, emails[10] AS email9, country, coalesce(names, '') AS names, CAST(NULL AS VARCHAR) AS nothing FROM canon c LEFT JOIN names USING (entity_id)
"""


def q_on_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = project.OutputConfig.parse({"on_missing": "error", "fields": [{"path": "mail", "from": "emails[0]", "required": True}, {"path": "headline"}, {"path": "country", "from": "location.country", "required": True}]})
    return project.missing_errors(_merged(spark, sf_dir), BY, wanted)


SQL_ON_MISSING = EVIDENCE + _CANON + """
SELECT entity_id, 'mail' AS field, 'Required field ''mail'' is missing' AS error, 'emails[0]' AS source_path FROM canon WHERE emails[1] IS NULL
UNION ALL SELECT entity_id, 'country', 'Required field ''country'' is missing', 'location.country' FROM canon WHERE country IS NULL
"""


def q_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.validate(scored(spark, sf_dir), BY)


SQL_VALIDATION = EVIDENCE + _CANON + """
SELECT entity_id, 'full_name' AS field, 'Candidate name is empty' AS error, 'missing_value' AS type FROM canon WHERE full_name IS NULL
UNION ALL SELECT entity_id, 'phones', 'Phone not in E.164 format: ' || p, 'format_error' FROM (SELECT entity_id, unnest(phones) AS p FROM canon) WHERE NOT starts_with(p, '+')
"""


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")} | reader_queries.QUERIES
ORACLES = {"q_" + k[4:].lower(): v for k, v in globals().items() if k.startswith("SQL_")} | reader_queries.ORACLES
