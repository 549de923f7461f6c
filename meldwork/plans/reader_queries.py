"""Registered queries over readers, cleaning, run tables and the rarer rules; inputs are texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.functions import normalize, schema, text
from meldwork.operators import analytics, clean, merge, project, score
from meldwork.plans.engine import changes, validation_errors
from meldwork.sources import files

RUN = "run_id"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _arms(key: Column, *texts: str) -> Column:
    out = F.lit(texts[-1])
    for i, t in enumerate(texts[:-1]):
        out = F.when(key % len(texts) == i, t).otherwise(out)
    return out


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|", "~")


ATS = [
    '{"candidateName":"@N","emailAddress":"A@x.io, b@y.io","mobile":["1",{"value":2},5],"skillList":["a",{"skill":"b"},{"name":"c","skill":"d"}],"jobTitle":"T","yearsExperience":"9.9","locationCity":"Pune","province":"MH","countryCode":"IN","workExperience":[{"companyName":"Z","position":"P","startDate":{"year":2020,"month":"March"},"end":{"year":0}},{"summary":"none"}],"education":{"school":"S","degreeName":"D","major":"M","endYear":"2011"},"githubUrl":"g","website":"w"}',
    '{"name":null,"full_name":"@N","city":{"city":"Goa","state":"no"},"yoe":true,"skills":"x , ,y","positions":{"organization":"O","end_date":"Present"},"linkedInProfile":"l"}',
    '{"candidates":[{"name":7,"yoe":"x"},{"name":"@N","headline":5},{"name":""},3,{"fullName":"  @N ","emails":[null," c@d.e "],"city":4}]}',
    '{"records":[{"applicant_name":"@N","yoe":Infinity},{"applicant_name":"@N","degrees":[{"university":"U","graduation_year":{"year":"2015"}},{"degree":"D","end_year":"soon"},{"field":"f"}]}]}',
    '{"name": ',
    '[{"name":["@N"]},{"name":"@N","experience":[{"title":"a","start":2020,"month":1},{"role":"b","start_date":{"month":5}}]}]',
]


def _ats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    body = F.replace(_arms(key, *ATS), F.lit("@N"), F.col("c_name"))
    return _table(spark, sf_dir, "customer").select(F.lit("r").alias(RUN), key.cast("string").alias("source_file"), F.lit("ats_json").alias("source_type"), key.alias("file_seq"), F.encode(body, "UTF-8").alias("content"))


def q_json_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the plain JSON dialect: aliases by presence, lists, places, years, experience and education."""
    x, e = F.col("experience"), F.col("education")
    return files.records(_ats(spark, sf_dir)).select(
        F.col("file_seq").alias("c_custkey"), "row_seq", "full_name", _joined("emails").alias("emails"), _joined("phones").alias("phones"), _joined("skills").alias("skills"), "headline", "years_experience", F.concat_ws("/", "city", "region", "country").alias("place"),
        F.concat_ws("/", "linkedin", "github", "portfolio").alias("links"),
        _joined(F.transform(x, lambda v: F.concat_ws("/", v["company"], v["title"], v["start"], v["end"], v["summary"]))).alias("experience"),
        _joined(F.transform(e, lambda v: F.concat_ws("/", v["institution"], v["degree"], v["field"], v["end_year"].cast("string")))).alias("education"))


SQL_JSON_ALIASES = """
SELECT c_custkey, arm.row_seq, replace(arm.full_name, '@N', c_name) AS full_name, arm.emails, arm.phones, arm.skills, arm.headline, arm.years_experience, arm.place, arm.links, arm.experience, arm.education
FROM customer JOIN (VALUES
  (0, 0, '@N', 'A@x.io|b@y.io', '1|2', 'a|b|c', 'T', 9, 'Pune/MH/IN', 'g/w', 'Z/P/2020-March', 'S/D/M/2011'),
  (1, 0, '@N', '', '', 'x|y', NULL, 1, 'Goa', 'l', 'O/Present', ''),
  (2, 0, '7', '', '', '', NULL, NULL, '', '', '', ''),
  (2, 4, '@N', 'c@d.e', '', '', NULL, NULL, '', '', '', ''),
  (3, 1, '@N', '', '', '', NULL, NULL, '', '', '', 'U/2015|D'),
  (5, 0, '[''@N'']', '', '', '', NULL, NULL, '', '', '', ''),
  (5, 1, '@N', '', '', '', NULL, NULL, '', '', 'a|b', '')
) AS arm(k, row_seq, full_name, emails, phones, skills, headline, years_experience, place, links, experience, education) ON c_custkey % 6 = arm.k
"""


def q_json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and records that can't be read, with the first word of the reason."""
    bad = files.readers(_ats(spark, sf_dir))["json"].filter("kind = 'error'")
    return bad.select(F.col("file_seq").alias("c_custkey"), "row_seq", F.split("error", ":")[0].alias("reason"))


SQL_JSON_REJECTS = """
SELECT c_custkey, CASE WHEN c_custkey % 6 = 2 THEN 1 ELSE 0 END AS row_seq, CASE c_custkey % 6 WHEN 2 THEN 'record 1' WHEN 3 THEN 'record 0' ELSE 'JSONDecodeError' END AS reason
FROM customer WHERE c_custkey % 6 IN (2, 3, 4)
"""

LINKEDIN = [
    '{"firstName":"Ann","lastName":"@N","headline":"H","location":{"name":"Goa","countryCode":"IN"},"emailAddress":"a@b.co","topSkills":[{"name":"k"},{"skillName":"m"}],"positions":[{"company":"C","title":"T","startDate":{"year":2019,"month":3}}],"publicProfileUrl":"u","candidates":[1]}',
    '[{"formattedName":"@N","title":"H2","geoLocation":"Pune","schools":[{"schoolName":"S","fieldOfStudy":"F","degree":"D"}]},{"firstName":" ","lastName":""}]',
    '{"firstName":"@N","location":{"name":5}}',
]


def q_json_linkedin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the profile dialect."""
    key = F.col("s_suppkey")
    body = F.replace(_arms(key, *LINKEDIN), F.lit("@N"), F.col("s_name"))
    rows = _table(spark, sf_dir, "supplier").select(F.lit("r").alias(RUN), F.lit("f").alias("source_file"), F.lit("linkedin_json").alias("source_type"), key.alias("file_seq"), F.encode(body, "UTF-8").alias("content"))
    x, e = F.col("experience"), F.col("education")
    return files.records(rows).select(
        F.col("file_seq").alias("s_suppkey"), "full_name", "headline", "city", "country", _joined("emails").alias("emails"), _joined("skills").alias("skills"), "linkedin",
        _joined(F.transform(x, lambda v: F.concat_ws("/", v["company"], v["title"], v["start"]))).alias("experience"), _joined(F.transform(e, lambda v: F.concat_ws("/", v["institution"], v["degree"], v["field"]))).alias("education"))


SQL_JSON_LINKEDIN = """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Ann ' || s_name ELSE s_name END AS full_name, CASE s_suppkey % 3 WHEN 0 THEN 'H' ELSE 'H2' END AS headline, CASE s_suppkey % 3 WHEN 0 THEN 'Goa' ELSE 'Pune' END AS city,
       CASE s_suppkey % 3 WHEN 0 THEN 'IN' END AS country, CASE s_suppkey % 3 WHEN 0 THEN 'a@b.co' ELSE '' END AS emails, CASE s_suppkey % 3 WHEN 0 THEN 'k|m' ELSE '' END AS skills, CASE s_suppkey % 3 WHEN 0 THEN 'u' END AS linkedin,
       CASE s_suppkey % 3 WHEN 0 THEN 'C/T/2019-03' ELSE '' END AS experience, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE 'S/D/F' END AS education
FROM supplier WHERE s_suppkey % 3 < 2
"""


def q_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole CSV files with quotes, missing cells and odd years: records and the reason of rejected rows."""
    body = F.concat(F.lit('Name, EMAIL ,title,company,yoe,skills\n'), F.lit('"'), "p_name", F.lit('","a@b.c, d@e.f",Dev,'), "p_brand", F.lit(',3.7,"x,,y"\n,skip@me.io,,,,\n'), "p_brand", F.lit(",NA,,,inf,\n"), "p_type", F.lit(",,,,many,\n"))
    rows = _table(spark, sf_dir, "part").select(F.lit("r").alias(RUN), F.lit("f").alias("source_file"), F.lit("recruiter_csv").alias("source_type"), F.col("p_partkey").alias("file_seq"), F.encode(body, "UTF-8").alias("content"))
    good = files.records(rows).select(F.col("file_seq").alias("p_partkey"), "row_seq", "full_name", _joined("emails").alias("emails"), _joined("skills").alias("skills"), "years_experience", _joined(F.transform("experience", lambda v: F.concat_ws("/", v["title"], v["company"]))).alias("experience"))
    bad = files.csv_rejects(files.readers(rows)["csv"]).groupBy("error").agg(F.count("*").alias("n"))
    return good.unionByName(bad.select(F.col("n").alias("p_partkey"), F.lit(-1).cast("long").alias("row_seq"), F.col("error").alias("full_name")), allowMissingColumns=True)


SQL_CSV_FILES = """
SELECT p_partkey, 0::BIGINT AS row_seq, p_name AS full_name, 'a@b.c|d@e.f' AS emails, 'x|y' AS skills, 3 AS years_experience, 'Dev/' || p_brand AS experience FROM part
UNION ALL SELECT p_partkey, 3, p_type, '', '', NULL, '' FROM part
UNION ALL SELECT count(*), -1, 'row 2: years of experience are infinite', NULL, NULL, NULL, NULL FROM part
"""

RESUME = [
    "@N\nx@y.io\nlinkedin.com/in/me\n\nExperience\n\nLead Dev\nAcme Corp\nJan 2019 - March 2021\nBuilt things\nwith care\n\nTester\nFeb 2018\n\nEducation\n\nState University\nB.Tech Computing\n2010 2014\nInformatics\n\nSkills\npython",
    "@N\n\nEDUCATION\nCity College\nHistory\n1999\n",
]


def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a résumé, their blocks, and the entries of experience and education."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_seq"), F.lit("r").alias(RUN), F.lit("f").alias("source_file"), F.lit("resume_docx").alias("source_type"), F.replace(_arms(F.col("s_suppkey"), *RESUME), F.lit("@N"), F.lit("Ann Lee")).alias("text"))
    x, e = F.col("experience"), F.col("education")
    return files.document_record(rows).select(
        F.col("file_seq").alias("s_suppkey"), "full_name", F.length("raw_text").alias("n_chars"), _joined("skills").alias("skills"), "linkedin",
        _joined(F.transform(x, lambda v: F.concat_ws("/", v["title"], v["company"], v["start"], v["end"], v["summary"]))).alias("experience"),
        _joined(F.transform(e, lambda v: F.concat_ws("/", v["institution"], v["degree"], v["field"], v["end_year"].cast("string")))).alias("education"))


SQL_SECTIONS = """
SELECT s_suppkey, 'Ann Lee' AS full_name, CASE s_suppkey % 2 WHEN 0 THEN 210 ELSE 45 END AS n_chars, CASE s_suppkey % 2 WHEN 0 THEN 'python' ELSE '' END AS skills, CASE s_suppkey % 2 WHEN 0 THEN 'linkedin.com/in/me' END AS linkedin,
       CASE s_suppkey % 2 WHEN 0 THEN 'Lead Dev/Acme Corp/Jan 2019/March 2021/Jan 2019 - March 2021 Built things with care|Tester/Feb 2018' ELSE '' END AS experience,
       CASE s_suppkey % 2 WHEN 0 THEN 'State University/B.Tech Computing 2010 2014 Informatics/B.Tech Computing/20' ELSE 'City College/History/19' END AS education
FROM supplier
"""


def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of recruiters: a labelled name of at most four words, patterns, keywords; blank notes give nothing."""
    note = _arms(F.col("n_nationkey"), "Candidate: Ann Lee\n+91 98765 43210 ann@x.io likes python", " \n\t", "Name: one two three four five\nsql", "plain text")
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_seq"), F.lit("r").alias(RUN), F.lit("f").alias("source_file"), F.lit("recruiter_notes").alias("source_type"), F.encode(note, "UTF-8").alias("content"))
    out = files.records(rows)
    return out.select(F.col("file_seq").alias("n_nationkey"), "full_name", _joined("emails").alias("emails"), _joined("phones").alias("phones"), _joined("skills").alias("skills"), "raw_text")


SQL_NOTES = """
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Ann Lee' END AS full_name, CASE n_nationkey % 4 WHEN 0 THEN 'ann@x.io' ELSE '' END AS emails, CASE n_nationkey % 4 WHEN 0 THEN '+91 98765 43210' ELSE '' END AS phones,
       CASE n_nationkey % 4 WHEN 0 THEN 'python' WHEN 2 THEN 'sql' ELSE '' END AS skills,
       CASE n_nationkey % 4 WHEN 0 THEN 'Candidate: Ann Lee' || chr(10) || '+91 98765 43210 ann@x.io likes python' WHEN 2 THEN 'Name: one two three four five' || chr(10) || 'sql' ELSE 'plain text' END AS raw_text
FROM nation WHERE n_nationkey % 4 <> 1
"""


def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripping of scalars, lists and nested texts, and how many fields that touched."""
    entry = F.array(F.struct(F.concat(F.lit(" "), "c_mktsegment").alias("company"), F.lit(" t ").alias("title"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit("").alias("summary")))
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_seq"), F.lit("r").alias(RUN), F.concat(F.lit(" \t"), "c_name", F.lit("\n")).alias("full_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).alias("headline"), F.array(F.lit(" a "), F.lit(""), F.lit(" "), F.lit(None)).alias("skills"), entry.alias("experience"))
    out = clean.parse(clean.parsed_fields(schema.as_records(rows, RUN).withColumn("source_file", F.lit("f"))))
    return out.select(F.col("row_seq").alias("c_custkey"), "full_name", "headline", _joined("skills").alias("skills"), F.concat_ws("/", F.col("experience")[0]["company"], F.col("experience")[0]["title"]).alias("experience"), "parsed_fields")


SQL_CLEAN = """
SELECT c_custkey, c_name AS full_name, CASE c_custkey % 2 WHEN 0 THEN '' END AS headline, 'a|' AS skills, c_mktsegment || '/t' AS experience, CASE c_custkey % 2 WHEN 0 THEN 6 ELSE 5 END AS parsed_fields FROM customer
"""

FUZZY = ["Argenti", "  Mozambique", "mozambiq", "nowhere", "Perú", "vie", "KENYA"]


def q_country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries by ISO name, in any case, and by a part of it of more than three letters."""
    part = _table(spark, sf_dir, "part").select("p_partkey", _arms(F.col("p_partkey"), *FUZZY).alias("raw"))
    out = part.withColumn("r", normalize.country(F.col("raw"), normalize.iso_countries(spark)))
    return out.select("p_partkey", F.col("r.value").alias("country"), F.array_join(F.transform("r.rules", lambda x: x["rule"]), "|").alias("rules"))


SQL_COUNTRY_NAMES = """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'AR' WHEN 1 THEN 'MZ' WHEN 2 THEN 'MZ' WHEN 4 THEN 'PE' WHEN 5 THEN 'VN' WHEN 6 THEN 'KE' END AS country,
       CASE p_partkey % 7 WHEN 1 THEN 'country_name_resolve' WHEN 3 THEN 'country_resolve_failed' WHEN 6 THEN 'country_name_resolve' ELSE 'country_fuzzy_resolve' END AS rules FROM part
"""


def q_country_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt and shortened names of the nations, each customer's its own way, ranked against all 25 of the table."""
    names = {r["n_name"].lower(): f"{r['n_nationkey']:02d}" for r in _table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()}  # 25 rows
    name, key = F.col("n_name"), F.col("c_custkey")
    at = (key % (F.length(name) - 2) + 2).cast("int")
    before, after = F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name))
    raw = F.when(key % 4 == 0, F.concat(before, after)).when(key % 4 == 1, F.concat(before, F.lit("x"), after)).when(key % 4 == 2, F.lower(F.substring(name, F.lit(1), 2 + (key % 3).cast("int")))).otherwise(F.concat(name, F.lit("q")))
    rows = _table(spark, sf_dir, "customer").join(F.broadcast(_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return rows.select("c_custkey", raw.alias("raw")).withColumn("code", normalize.fuzzy_country(F.col("raw"), names))


SQL_COUNTRY_FUZZY = """
WITH raw AS (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN substr(n_name, 1, p - 1) || substr(n_name, p + 1) WHEN 1 THEN substr(n_name, 1, p - 1) || 'x' || substr(n_name, p + 1) WHEN 2 THEN lower(substr(n_name, 1, 2 + c_custkey % 3)) ELSE n_name || 'q' END AS raw
  FROM (SELECT c_custkey, n_name, c_custkey % (length(n_name) - 2) + 2 AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)
), ranked AS (
  SELECT c_custkey, raw, printf('%02d', n_nationkey) AS code, instr(lower(n_name), lower(raw)) AS place, levenshtein(lower(n_name), lower(raw)) AS edits FROM raw, nation WHERE length(raw) >= 3
)
SELECT r.c_custkey, r.raw, coalesce(arg_min(code, [lpad(place::VARCHAR, 3, '0'), code]) FILTER (place > 0), arg_min(code, [lpad(edits::VARCHAR, 3, '0'), code]) FILTER (edits <= length(r.raw) // 4)) AS code
FROM raw r LEFT JOIN ranked USING (c_custkey) GROUP BY r.c_custkey, r.raw
"""

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def q_date_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders within other words: names and numbers of months, ordinals, day before month, years of two digits and missing ones."""
    d = F.col("o_orderdate").cast("date")
    day, month, year = F.dayofmonth(d), F.month(d), F.year(d)
    name = F.element_at(F.array(*map(F.lit, MONTHS)), month)
    def say(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    short = F.substring(F.lpad(year.cast("string"), 4, "0"), 3, 2)
    raw = _arms(F.col("o_orderkey"), say("around the ", day, "th of ", name, ", ", year, " or so"), say(name, " the ", day, "rd"), say(year, ", in early ", F.upper(F.substring(name, 1, 3))), say("left ", day, "/", month, "/", year),
                say("since ", F.substring(name, 1, 4), " \u2019", short), say(month, "-", day, "-", short), say("maybe in ", year), say("maybe ", day), say(F.lower(name), " only"))
    out = _table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return out.withColumn("plain", normalize.date(F.col("raw"))["value"]).withColumn("with_year", normalize.date(F.col("raw"), year=2001)["value"])


# The arms of q_date_fuzzy: 3 reads day/month as month/day where the day can be a month, as 5 does not.
SQL_DATE_FUZZY = """
WITH d AS (
  SELECT o_orderkey, o_orderkey % 9 AS arm, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][month(o_orderdate)] AS name FROM orders
), said AS (
  SELECT *, CASE arm WHEN 0 THEN format('around the {}th of {}, {} or so', d, name, y) WHEN 1 THEN format('{} the {}rd', name, d) WHEN 2 THEN format('{}, in early {}', y, upper(name[:3])) WHEN 3 THEN format('left {}/{}/{}', d, m, y)
    WHEN 4 THEN format('since {} \u2019{:02d}', name[:4], y % 100) WHEN 5 THEN format('{}-{}-{:02d}', m, d, y % 100) WHEN 6 THEN format('maybe in {}', y) WHEN 7 THEN format('maybe {}', d) ELSE lower(name) || ' only' END AS raw FROM d
)
SELECT o_orderkey, raw, CASE WHEN arm IN (1, 7, 8) THEN NULL WHEN arm = 6 THEN format('{}-01', y) WHEN arm = 3 AND d <= 12 THEN format('{}-{:02d}', y, d) ELSE format('{}-{:02d}', y, m) END AS plain,
       CASE WHEN arm IN (1, 8) THEN format('2001-{:02d}', m) WHEN arm = 7 THEN NULL WHEN arm = 6 THEN format('{}-01', y) WHEN arm = 3 AND d <= 12 THEN format('{}-{:02d}', y, d) ELSE format('{}-{:02d}', y, m) END AS with_year
FROM said
"""

#: Calling code, least and most digits, first digits: some of the numbering plans, as the SQL has them too.
PLANS = [("FR", "33", 9, 9, "123456789"), ("FI", "358", 6, 10, "123456789"), ("SG", "65", 8, 8, "3456789"), ("NO", "47", 8, 8, "23456789"), ("RU", "7", 10, 10, "3456789"), ("KE", "254", 9, 9, "123456789"), ("US", "1", 10, 10, "23456789"), ("PT", "351", 9, 9, "23456789")]


def q_phone_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of eight numbering plans, of any length and beginning, abroad and at home in France."""
    key = F.col("o_orderkey")
    code = _arms(key, *[p[1] for p in PLANS])
    digits = F.substring(F.concat(((key * 7919) % 10).cast("string"), F.lpad((key * 104729 % 10000000000).cast("string"), 10, "0")), F.lit(1), (5 + F.floor(key / 8) % 7).cast("int"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"), digits.alias("digits"))
    return rows.select("o_orderkey", normalize.phone(F.concat(F.lit("+"), "code", F.lit(" "), "digits"))["value"].alias("abroad"), normalize.phone(F.when(~F.col("digits").startswith("0"), F.concat(F.lit("0"), "digits")), "FR")["value"].alias("home"))


SQL_PHONE_PLANS = """
WITH n AS (
  SELECT o_orderkey, (((o_orderkey * 7919) % 10)::VARCHAR || lpad((o_orderkey * 104729 % 10000000000)::VARCHAR, 10, '0'))[:5 + (o_orderkey // 8) % 7] AS digits, o_orderkey % 8 AS k FROM orders
)
SELECT o_orderkey, CASE WHEN length(digits) BETWEEN least AND most AND contains(firsts, digits[1]) THEN '+' || code || digits END AS abroad,
       CASE WHEN digits[1] <> '0' AND length(digits) = 9 THEN '+33' || digits END AS home
FROM n JOIN (VALUES """ + ", ".join(f"({i}, '{c}', {a}, {b}, '{f}')" for i, (_, c, a, b, f) in enumerate(PLANS)) + """) AS p(k, code, least, most, firsts) USING (k)
"""


def q_rank_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and headlines of all customers and suppliers as candidates of one entity, ranked over ranges that tasks share."""
    records = _two_sources(spark, sf_dir).withColumn("entity_id", F.lit(1))
    out = merge.candidates(records, ["entity_id"], spread=True)
    return out.select("field", "value", "source_file", "priority", "rank", "n", F.col("winner.value").alias("winner"))


SQL_RANK_BY_RANGE = """
WITH c AS (
  SELECT 'full_name' AS field, s_name AS value, 's.csv' AS source_file, 2 AS priority, s_suppkey AS k FROM supplier
  UNION ALL SELECT 'full_name', c_name, 'c.json', 3, c_custkey FROM customer UNION ALL SELECT 'headline', c_mktsegment, 'c.json', 3, c_custkey FROM customer
)
SELECT field, value, source_file, priority, row_number() OVER w AS rank, count(*) OVER (PARTITION BY field) AS n, first_value(value) OVER w AS winner FROM c WINDOW w AS (PARTITION BY field ORDER BY priority, k)
"""


def q_phone_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone lists: normalized, first of equal ones, sorted, with repeats logged."""
    d = F.lpad((F.col("s_suppkey") * 7919 % 1000000000).cast("string"), 9, "0")
    raw = F.array(F.concat(F.lit("+91 9"), d), F.concat(F.lit("09"), d), F.concat(F.lit("+1 (2)"), d), F.lit("12"), F.lit(""))
    out = _table(spark, sf_dir, "supplier").withColumn("r", normalize.phone_list(raw))
    return out.select("s_suppkey", _joined("r.value").alias("phones"), F.col("r.duplicates").alias("duplicates"), F.array_join(F.transform("r.rules", lambda x: x["rule"]), "|").alias("rules"))


SQL_PHONE_LIST = """
SELECT s_suppkey, '+12' || d || '|+919' || d AS phones, 1 AS duplicates, 'convert_to_e164|convert_to_e164|convert_to_e164|phone_validation_failed|remove_duplicate_phone' AS rules
FROM (SELECT s_suppkey, lpad(CAST(s_suppkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d FROM supplier)
"""


def q_merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as a sorted set and education end to end in source order, a customer's records by nation."""
    none = F.lit(None)
    school = F.array(F.struct(F.col("c_name").alias("institution"), none.cast("string").alias("degree"), none.cast("string").alias("field"), none.cast("int").alias("end_year")))
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("entity_id"), F.lit("r").alias("source_file"), F.when(F.col("c_custkey") % 2 == 0, "resume_pdf").otherwise("ats_json").alias("source_type"), F.lit(0).alias("file_seq"), F.col("c_custkey").alias("row_seq"),
        F.array(F.concat(F.lit("http://"), F.lower("c_mktsegment")), F.lit("http://a")).alias("other_links"), F.when(F.col("c_custkey") % 3 == 0, school).alias("education"))
    out = merge.merge(schema.as_records(rows, "entity_id"), ["entity_id"])
    return out.select("entity_id", _joined("links.other").alias("links"), F.size("education").alias("n"), F.sha2(_joined(F.transform("education", lambda e: e["institution"])), 256).alias("schools"))


SQL_MERGE_LISTS = """
SELECT c_nationkey AS entity_id, (SELECT string_agg(DISTINCT u, '|' ORDER BY u) FROM (SELECT 'http://' || lower(c_mktsegment) AS u FROM customer d WHERE d.c_nationkey = c.c_nationkey UNION SELECT 'http://a')) AS links,
       count(*) FILTER (c_custkey % 3 = 0) AS n, sha256(coalesce(string_agg(c_name, '|' ORDER BY c_custkey % 2 = 0, c_custkey) FILTER (c_custkey % 3 = 0), '')) AS schools
FROM customer c GROUP BY c_nationkey
"""


def _two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers by nation: names and headlines of two sources."""
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity_id"), F.lit("s.csv").alias("source_file"), F.lit("recruiter_csv").alias("source_type"), F.lit(0).alias("file_seq"), F.col("s_suppkey").alias("row_seq"), F.col("s_name").alias("full_name"), F.lit(None).cast("string").alias("headline"))
    customer = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity_id"), F.lit("c.json").alias("source_file"), F.lit("ats_json").alias("source_type"), F.lit(1).alias("file_seq"), F.col("c_custkey").alias("row_seq"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("headline"))
    rows = schema.as_records(supplier, "entity_id").unionByName(schema.as_records(customer, "entity_id"))
    return rows.withColumn("candidate_id", F.lit("CND-1"))


_TWO = """
WITH two AS (
  SELECT s_nationkey AS entity_id, 2 AS priority, 0.95::DOUBLE AS weight, 0 AS file_seq, s_suppkey AS row_seq, s_name AS full_name, NULL AS headline FROM supplier
  UNION ALL SELECT c_nationkey, 3, 0.9, 1, c_custkey, c_name, c_mktsegment FROM customer
), canon AS (
  SELECT entity_id, arg_min(full_name, [priority, file_seq, row_seq]) AS full_name, arg_min(headline, [priority, file_seq, row_seq]) FILTER (headline IS NOT NULL) AS headline,
         count(*) AS n, count(headline) AS n_headline, min(priority) AS priority, count(DISTINCT file_seq) AS files,
         round_even(max(weight) * greatest(0.5::DOUBLE, least(1.0::DOUBLE, count(*)::DOUBLE / count(DISTINCT file_seq))), 4) AS name_confidence,
         CASE WHEN count(headline) > 0 THEN round_even(0.9::DOUBLE * greatest(0.5::DOUBLE, least(1.0::DOUBLE, count(headline)::DOUBLE / count(DISTINCT file_seq))), 4) ELSE 0 END AS headline_confidence
  FROM two GROUP BY entity_id
)
"""


def _run_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    by = ["entity_id"]
    records = _two_sources(spark, sf_dir)
    merged = merge.merge(records, by, *merge.lead(), *score.contributions())
    scored = score.quality(score.confidence(merged))
    return records, scored, score.backfill(merge.provenance(merge.candidates(records, by), merged, by), scored, by)


def q_field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field the winning entry, the rejected ones, and the confidence that accepted entries get."""
    _, _, rows = _run_tables(spark, sf_dir)
    out = merge.field_provenance(rows, ["entity_id"])
    known = rows.filter("accepted").select("entity_id", "field", "confidence")
    return out.join(known, ["entity_id", "field"]).select("entity_id", "field", F.col("winner.value").alias("winner"), F.col("winner.priority").alias("priority"), F.size("rejected").alias("rejected"), "entries", "has_conflicts", "confidence")


SQL_FIELD_PROVENANCE = _TWO + """
SELECT entity_id, 'full_name' AS field, full_name AS winner, CASE WHEN n > 1 THEN priority ELSE 99 END AS priority, n - 1 AS rejected, n AS entries, n > 1 AS has_conflicts, name_confidence AS confidence FROM canon
UNION ALL SELECT entity_id, 'headline', headline, CASE WHEN n_headline > 1 THEN 3 ELSE 99 END, n_headline - 1, n_headline, n_headline > 1, headline_confidence FROM canon WHERE n_headline > 0
"""


def q_late_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted entries that the output carries as its provenance, with and without the toggle."""
    by = ["entity_id"]
    _, scored, rows = _run_tables(spark, sf_dir)
    accepted = rows.filter("accepted").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("field", "source", F.lit("direct").alias("method")))).alias("provenance"))
    full = scored.join(accepted, by, "left")
    shown = project.project(full, by, project.OutputConfig.parse({"fields": [{"path": "full_name"}], "include_confidence": False}))
    hidden = project.project(full, by, project.OutputConfig.parse({"fields": [{"path": "full_name"}], "include_confidence": True, "include_provenance": False}))
    left = shown.select("entity_id", "full_name", _joined(F.transform("provenance", lambda p: F.concat_ws("/", p["field"], p["source"], p["method"]))).alias("provenance"))
    return left.join(hidden.select("entity_id", F.lit(",".join(hidden.columns)).alias("columns"), "overall_confidence"), "entity_id")


SQL_LATE_PROVENANCE = _TWO + """
SELECT entity_id, full_name, concat_ws('|', 'full_name/' || CASE WHEN priority = 2 THEN 's.csv' ELSE 'c.json' END || '/direct', CASE WHEN n_headline > 1 THEN 'headline/c.json/direct' WHEN n_headline = 1 THEN 'headline/' || CASE WHEN priority = 2 THEN 's.csv' ELSE 'c.json' END || '/direct' END) AS provenance,
       'entity_id,full_name,overall_confidence' AS columns, round_even((name_confidence + headline_confidence) / 9, 4) AS overall_confidence FROM canon
"""


def q_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projected object as JSON; with on_missing=omit a null key is left out, required or not, inside an object it stays."""
    _, scored, _ = _run_tables(spark, sf_dir)
    wanted = project.OutputConfig.parse({"on_missing": "omit", "include_provenance": False, "include_confidence": False, "fields": [{"path": "full_name"}, {"path": "title", "from": "headline", "required": True}, {"path": "mail", "from": "emails[0]", "required": True}, {"path": "location"}, {"path": "phones"}]})
    return project.project_json(scored, ["entity_id"], wanted)


SQL_EXPORT_JSON = _TWO + """
SELECT entity_id, '{"full_name":"' || full_name || '"' || coalesce(',"title":"' || headline || '"', '') || ',"location":{"city":null,"region":null,"country":null},"phones":[]}' AS json FROM canon
"""


def q_on_missing_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With on_missing=null every key stays, and no error is raised for a required one."""
    _, scored, _ = _run_tables(spark, sf_dir)
    wanted = project.OutputConfig.parse({"include_provenance": False, "include_confidence": False, "fields": [{"path": "title", "from": "headline", "required": True}, {"path": "mail", "from": "emails[0]", "required": True}]})
    errors = project.missing_errors(scored, ["entity_id"], wanted).count()
    return project.project_json(scored, ["entity_id"], wanted).withColumn("errors", F.lit(errors))


SQL_ON_MISSING_NULL = _TWO + """SELECT entity_id, '{"title":' || coalesce('"' || headline || '"', 'null') || ',"mail":null}' AS json, 0 AS errors FROM canon"""


def q_validation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of validation error: schema bounds, business rules, and required fields of the projection."""
    key = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(
        key, F.when(key % 5 == 0, None).otherwise(F.lit("CND")).alias("candidate_id"), F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("full_name"), F.array(F.col("c_name"), F.lit("a@b.c")).alias("emails"),
        F.when(key % 2 == 0, F.array(F.col("c_mktsegment"))).otherwise(F.array(F.lit("+1"))).alias("phones"), ((key % 4) / 2 - 0.5).alias("overall_confidence"),
        F.array(F.struct(F.lit("x").alias("name"), ((key % 7) * 0.25).alias("confidence"))).alias("skills"), F.lit(None).cast("string").alias("headline"))
    wanted = project.OutputConfig.parse({"on_missing": "error", "fields": [{"path": "title", "from": "headline", "required": True}]})
    out = validation_errors(rows, ["c_custkey"], wanted)
    return out.select("c_custkey", "field", "error", "type", F.coalesce("input", F.lit("")).alias("input"))


SQL_VALIDATION_KINDS = """
SELECT c_custkey, 'candidate_id' AS field, 'Input should be a valid string' AS error, 'string_type' AS type, 'None' AS input FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'skills → 0 → confidence', 'Input should be less than or equal to 1', 'less_than_equal', CASE c_custkey % 7 WHEN 5 THEN '1.25' ELSE '1.5' END FROM customer WHERE c_custkey % 7 > 4
UNION ALL SELECT c_custkey, 'overall_confidence', 'Input should be greater than or equal to 0', 'greater_than_equal', '-0.5' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'overall_confidence', 'Confidence -0.5 out of range [0, 1]', 'range_error', '' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'full_name', 'Candidate name is empty', 'missing_value', '' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'emails', 'Invalid email format: ' || c_name, 'format_error', '' FROM customer
UNION ALL SELECT c_custkey, 'phones', 'Phone not in E.164 format: ' || c_mktsegment, 'format_error', '' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'title', 'Required field ''title'' is missing', 'required', '' FROM customer
"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("entity_id"), F.lit("s.csv").alias("source_file"), F.lit("recruiter_csv").alias("source_type"), F.lit(0).alias("file_seq"), F.col("s_suppkey").alias("row_seq"), F.col("s_name").alias("full_name"),
        F.array(F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@X.io"))).alias("emails"), _arms(F.col("s_suppkey"), "India", "US", "nowhere land").alias("country"), F.array(F.lit("js"), F.lit("javascript")).alias("skills"))
    return clean.canonicalize(clean.normalize(clean.parse(clean.parsed_fields(schema.as_records(rows, "entity_id"))), countries=normalize.iso_countries(spark)))


def q_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of transformations a field, conflicts of the merge included: their number, the first rule and the last value."""
    records = _prepared(spark, sf_dir)
    conflicts = merge.conflicts(merge.candidates(records, ["entity_id"]), ["entity_id"])
    out = clean.chains(clean.rule_log(records, "entity_id"), "entity_id", conflicts=conflicts)
    return out.select("entity_id", "field", "total", F.col("steps")[0]["rule"].alias("first_rule"), "final", F.element_at("steps", -1)["stage"].alias("last_stage"))


SQL_CHAINS = """
WITH steps AS (
  SELECT s_nationkey AS entity_id, 'emails' AS field, 1 AS stage, s_suppkey AS k, 0 AS step, 'lowercase' AS rule, lower(replace(s_name, '#', '.')) || '@x.io' AS after FROM supplier
  UNION ALL SELECT s_nationkey, 'skills', 2, s_suppkey, x.step, x.rule, x.after FROM supplier, (VALUES (0, 'skill_canonicalize', 'JavaScript'), (1, 'skill_canonicalize', 'JavaScript'), (2, 'remove_duplicate_skill', NULL)) AS x(step, rule, after)
  UNION ALL SELECT s_nationkey, 'location.country', 1, s_suppkey, 0, CASE s_suppkey % 3 WHEN 0 THEN 'country_alias_resolve' ELSE 'country_resolve_failed' END, CASE s_suppkey % 3 WHEN 0 THEN 'IN' END FROM supplier WHERE s_suppkey % 3 <> 1
  UNION ALL SELECT s_nationkey, 'full_name', 3, 0, 0, 'priority_based_conflict_resolution', arg_min(s_name, s_suppkey) FROM supplier GROUP BY s_nationkey HAVING count(*) > 1
  UNION ALL SELECT s_nationkey, 'location.country', 3, 0, 0, 'priority_based_conflict_resolution', arg_min(CASE s_suppkey % 3 WHEN 0 THEN 'IN' ELSE 'US' END, s_suppkey) FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY s_nationkey HAVING count(*) > 1
)
SELECT entity_id, field, count(*) AS total, arg_min(rule, [stage, k, step]) AS first_rule, arg_max_null(after, [stage, k, step]) AS final,
       CASE max(stage) WHEN 1 THEN 'normalization' WHEN 2 THEN 'canonicalization' ELSE 'conflict_resolution' END AS last_stage
FROM steps GROUP BY entity_id, field
"""


def q_chain_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals without gathering the steps."""
    records = _prepared(spark, sf_dir)
    conflicts = merge.conflicts(merge.candidates(records, ["entity_id"]), ["entity_id"])
    return clean.chain_totals(clean.rule_log(records, "entity_id"), "entity_id", conflicts=conflicts)


SQL_CHAIN_TOTALS = "SELECT entity_id, field, total, first_rule, final FROM (" + SQL_CHAINS + ")"


def q_rule_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules found by a word of their description, with stage and number."""
    log = clean.rule_log(_prepared(spark, sf_dir), "entity_id")
    return analytics.search(log, "RESOLVED").unionByName(analytics.search(log, "canonicalized to 'java")).groupBy("rule", "stage", "description").agg(F.count("*").alias("n"))


SQL_RULE_DESCRIPTIONS = """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'country_alias_resolve' ELSE 'country_resolve_failed' END AS rule, 'normalization' AS stage,
       CASE s_suppkey % 3 WHEN 0 THEN 'Country ''India'' resolved to ISO-3166 ''IN'' via alias' ELSE 'Country ''nowhere land'' could not be resolved to ISO-3166' END AS description, count(*) AS n
FROM supplier WHERE s_suppkey % 3 <> 1 GROUP BY ALL
UNION ALL SELECT 'skill_canonicalize', 'canonicalization', 'Skill ''' || raw || ''' canonicalized to ''JavaScript''', count(*) FROM supplier, (VALUES ('js'), ('javascript')) AS v(raw) GROUP BY raw
"""


def q_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run over two sources."""
    by = ["entity_id"]
    records = clean.canonicalize(clean.normalize(clean.parse(clean.parsed_fields(_two_sources(spark, sf_dir))), countries={}))
    scored = score.quality(score.confidence(merge.merge(records, by, *score.contributions())))
    found = records.select("source_file").distinct()
    out = analytics.counters(found, records, merge.candidates(records, by), validation_errors(scored, by, project.OutputConfig()), scored)
    return out.drop("average_confidence")


SQL_COUNTERS = _TWO + """
, score AS (SELECT CAST(15 + CASE WHEN headline IS NOT NULL THEN 8 ELSE 0 END AS DOUBLE) AS q FROM canon)
SELECT (SELECT count(DISTINCT file_seq) FROM two) AS files_processed, (SELECT count(*) FROM two) AS records_parsed, 0 AS fields_normalized, 0 AS duplicates_removed, (SELECT count(full_name) + count(headline) FROM two) AS fields_parsed,
       (SELECT count(*) FILTER (n > 1) + count(*) FILTER (n_headline > 1) FROM canon) AS conflicts_detected, (SELECT count(*) FILTER (n > 1) + count(*) FILTER (n_headline > 1) FROM canon) AS conflicts_resolved,
       0 AS validation_errors, true AS success, (SELECT round_even(avg(q), 1) FROM score) AS quality_score
"""


def q_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages have changed, by stage: entries, and the sums of their numbers."""
    records = _prepared(spark, sf_dir)
    found = records.groupBy("source_file", "source_type").agg(F.sum("row_seq").alias("size"))
    out = changes(found, records, merge.candidates(_two_sources(spark, sf_dir), ["entity_id"]), "entity_id")
    def total(key: str) -> Column:
        return F.coalesce(F.sum(F.try_element_at("change", F.lit(key)).cast("long")), F.lit(0))

    return out.groupBy("stage").agg(F.count("*").alias("n"), (total("size_bytes") + total("records_extracted") + total("fields_parsed") + total("fields_normalized") + total("duplicates_removed") + total("candidates")).alias("total"))


SQL_CHANGES = _TWO + """
SELECT 'Input Detection' AS stage, 1 AS n, sum(s_suppkey) AS total FROM supplier
UNION ALL SELECT 'Extraction', 1, count(*) FROM supplier
UNION ALL SELECT 'Parsing', count(*), 4 * count(*) FROM supplier
UNION ALL SELECT 'Normalization', count(*), sum(2 + CASE WHEN s_suppkey % 3 = 1 THEN 0 ELSE 1 END) FROM supplier
UNION ALL SELECT 'Conflict Resolution', count(*) FILTER (n > 1) + count(*) FILTER (n_headline > 1), sum(CASE WHEN n > 1 THEN n ELSE 0 END) + sum(CASE WHEN n_headline > 1 THEN n_headline ELSE 0 END) FROM canon
"""


def q_labelled_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name behind its label, up to the first character that no name holds."""
    raw = _arms(F.col("n_nationkey"), "PROFILE: Ann-Marie O'Neil 3", "name:   Bo; x", "candidate: a b c d e.", "nobody")
    return _table(spark, sf_dir, "nation").select("n_nationkey", text.labelled_name(raw).alias("name"))


SQL_LABELLED_NAME = "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Ann-Marie O''Neil' WHEN 1 THEN 'Bo' END AS name FROM nation"

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {"q_" + k[4:].lower(): v for k, v in globals().items() if k.startswith("SQL_")}
