import pytest
from pyspark.sql import functions as F

from meldwork.functions import dims, normalize, text
from meldwork.operators import clean


def values(spark, inputs, fn):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r[0] for r in frame.select(fn(F.col("c")).alias("v"), "i").orderBy("i").collect()]


def test_title_case_is_not_initcap(spark):
    assert values(spark, ["graph theory", "foo.bar", "3d", "node.js", ""], text.title) == ["Graph Theory", "Foo.Bar", "3D", "Node.Js", ""]


def test_strip_takes_all_white_space(spark):
    assert values(spark, ["\t a b\r\n", " ", None], text.strip) == ["a b", "", None]


def test_email(spark):
    got = values(spark, [" A@B.CO ", "a@b", "", None], normalize.email)
    assert [g["value"] for g in got] == ["a@b.co", None, None, None]
    assert [r["rule"] for r in got[0]["rules"]] == ["trim_whitespace", "lowercase"]
    assert [r["rule"] for r in got[1]["rules"]] == ["email_validation_failed"]


def test_email_list_keeps_the_first_and_counts_the_rest(spark):
    got = spark.createDataFrame([(["b@x.io", "B@x.io", "a@x.io"],)], "c array<string>").select(normalize.email_list(F.col("c")).alias("r")).first()["r"]
    assert (got["value"], got["duplicates"]) == (["a@x.io", "b@x.io"], 1)


def test_skill_list(spark):
    got = spark.createDataFrame([(["js", "JavaScript"],), (None,)], "c array<string>").select(normalize.skill_list(F.col("c")).alias("r")).collect()
    assert (got[0]["r"]["value"], got[0]["r"]["duplicates"]) == (["JavaScript"], 1)
    assert got[1]["r"]["value"] == []


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("98765-43210", "+919876543210"), ("+91-9988776655", "+919988776655"), ("011-2345-6789", "+911123456789"), ("0044 7700 900123", "+447700900123"), ("call me", None), ("12", None), ("", None)],
)
def test_phone(spark, raw, expected):
    assert values(spark, [raw], normalize.phone)[0]["value"] == expected


def test_dates(spark):
    raw = ["Present", "NOW", "2020-03", "2020-00", "2020", "Jan 2025", "01/2025", "2025-01-15", "hello", "", None]
    assert [g["value"] for g in values(spark, raw, normalize.date)] == ["Present", "Present", "2020-03", "2020-00", "2020-01", "2025-01", "2025-01", "2025-01", None, None, None]


def test_countries(spark):
    names = normalize.iso_countries(spark)
    raw = ["uk", "us", "zz", "U.K.", "England", "India", "norway", "zealand", "nowhere"]
    assert [g["value"] for g in values(spark, raw, lambda c: normalize.country(c, names))] == ["UK", "US", "ZZ", "GB", "GB", "IN", "NO", "NZ", None]


def test_skills(spark):
    raw = ["ReactJS", "react native", "K8s", "graph theory", "3d"]
    once = [g["value"] for g in values(spark, raw, normalize.skill)]
    assert once == ["React", "React Native", "Kubernetes", "Graph Theory", "3D"]
    assert [g["value"] for g in values(spark, once, normalize.skill)] == once


def test_keywords_need_word_boundaries(spark):
    assert values(spark, ["c++ and c# dev", "Python, go!", "gopher", "éai ai"], text.keywords) == [[], ["go", "python"], [], ["ai"]]


def test_names(spark):
    assert values(spark, ["John Doe\nx@y.com", "a@b.co\n+91 98765 43210\nAnn Lee", "123"], text.name_line) == ["John Doe", "Ann Lee", None]
    assert values(spark, ["Name: Jane Smith, x", "Name: Jane Smith\n\nfoo bar baz"], text.labelled_name) == ["Jane Smith", None]


def test_sections_and_blocks(spark):
    resume = "Experience\nDev\nAcme\nJan 2019 - Feb 2020\nDid things\n\nEducation\nMIT\nBSc Physics\nMajor field\n2017"
    found = values(spark, [resume], lambda c: F.transform(text.blocks(text.section(c, "experience")), lambda b: text.experience_block(b)))[0]
    assert [(f["title"], f["company"], f["start"], f["end"], f["summary"]) for f in found] == [("Dev", "Acme", "Jan 2019", "Feb 2020", "Jan 2019 - Feb 2020 Did things")]
    found = values(spark, [resume], lambda c: F.transform(text.blocks(text.section(c, "education")), lambda b: text.education_block(b)))[0]
    assert (found[0]["institution"], found[0]["end_year"]) == ("MIT", 20)


def test_numbers_of_all_plans(spark):
    inputs, want = [], []
    for code, least, most, begin in dims.PHONE_RULES.values():
        for n in (least - 1, least, most, most + 1):
            digits = begin[-1] + "0123456789012345"[: n - 1]
            inputs.append(f"+{code} {digits}")
            want.append(f"+{code}{digits}" if least <= n <= most else None)
        if begin[0] > "0":
            inputs.append(f"00{code}{int(begin[0]) - 1}" + "0" * (least - 1))
            want.append(None)
    assert len(dims.PHONE_RULES) >= 30
    assert [g["value"] for g in values(spark, inputs, normalize.phone)] == want


def test_the_longest_calling_code_decides(spark):
    raw = ["+3581234567", "+35 1234567", "+99912345678", "+999123", "+7 912 345 67 89", "+7 212 345 67 89"]
    assert [g["value"] for g in values(spark, raw, normalize.phone)] == ["+3581234567", None, "+99912345678", None, "+79123456789", None]
    assert values(spark, ["01 23 45 67 89"], lambda c: normalize.phone(c, "FR"))[0]["value"] == "+33123456789"
    described = spark.sql("SELECT '+3581234567' AS a").select(clean.described(F.lit("convert_to_e164"), F.col("a"), F.col("a"))).first()[0]
    assert described.endswith("(detected country: FI)")


@pytest.mark.parametrize(
    ("raw", "plain", "with_year"),
    [
        ("the 3rd of March 2019, or so", "2019-03", "2019-03"), ("March the 3rd", None, "2001-03"), ("3 mar '19", "2019-03", "2019-03"), ("Sept ’98", "1998-09", "1998-09"), ("31/12/2019", "2019-12", "2019-12"), ("x 05/06/2019", "2019-05", "2019-05"),
        ("12-31-99", "1999-12", "1999-12"), ("in 2019", "2019-01", "2019-01"), ("maybe 2019", "2019-01", "2019-01"), ("maybe", None, None), ("mayor 12", None, None), ("5 juneau", None, None), ("13/13/2019", "2019-01", "2019-01"), ("", None, None),
    ],
)
def test_dates_within_words(spark, raw, plain, with_year):
    assert values(spark, [raw], normalize.date)[0]["value"] == plain
    assert values(spark, [raw], lambda c: normalize.date(c, year=2001))[0]["value"] == with_year


def test_countries_by_likeness(spark):
    names = normalize.iso_countries(spark)
    raw = ["Perú", "argentna", "Norwai", "Phillipines", "viet", "ger", "united", "xq", "qqqqqq", "Côte d'Ivoire", ""]
    got = [g["value"] for g in values(spark, raw, lambda c: normalize.country(c, names))]
    assert got[:6] == ["PE", "AR", "NO", "PH", "VN", "DE"]
    assert got[6] == "AE"  # of names that begin with it, the first code
    assert got[7:] == ["XQ", None, "CI", None]
