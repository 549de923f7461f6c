"""Records of both JSON dialects, in columns: a file's text becomes a variant, its items rows, their fields typed values.

Nothing here runs in Python. A file that isn't JSON is one error, a record that can't be used is one, and the
others of its file stay: bytes that aren't UTF-8, a byte-order mark, a key that stands twice, text behind
the value, nesting beyond what the parser takes; in a record, a scalar of the wrong type, a number that no 32-bit integer holds, and an
escape that is half a character.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meldwork.functions import dims
from meldwork.functions.schema import EDUCATION, EXPERIENCE

#: Stands behind the value that is parsed, so that text after it is seen.
_END = "﷑end"
#: Stands for half a character, which no text can hold.
_HALF = "﷐"
#: A text above so many bytes, near the largest variant, is cut into the texts of its items first.
LARGE = 100_000_000
_SPACE = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
#: JSON tokens: a string, or what stands between strings.
_TOKEN = r'("(?:[^"\\]++|\\.)*+"|[^"]+)'
_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_numbers = count()

# The helpers below make SQL text of SQL text, as one expression a field is far quicker to build than a column an operator.


def let(value: str, body: Callable[[str], str]) -> str:
    """body of value, with value computed once."""
    x = f"x{next(_numbers)}"
    return f"get(transform(array({value}), {x} -> {body(x)}), 0)"


def kind(v: str) -> str:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID for null, or a number's kind; null for what isn't there."""
    return f"regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0)"


def at(v: str, key: str) -> str:
    """The value under a key, which may be JSON's null; null if the object has no such key."""
    return f"try_variant_get({v}, '$.{key}', 'variant')"


def text(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def items(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def _bare(t: str) -> str:
    return f"regexp_replace({t}, r'{_SPACE}', '')"


def truthy(v: str) -> str:
    """There, and not null, empty, false or zero."""
    return let(v, lambda x: f"""coalesce(CASE WHEN {x} IS NULL THEN false ELSE CASE {kind(x)} WHEN 'STRING' THEN {text(x)} <> '' WHEN 'ARRAY' THEN size({items(x)}) > 0 WHEN 'OBJECT' THEN schema_of_variant({x}) <> 'OBJECT<>'
        WHEN 'BOOLEAN' THEN {text(x)} = 'true' WHEN 'VOID' THEN false ELSE coalesce(try_variant_get({x}, '$', 'double') <> 0, true) END END, false)""")  # fmt: skip


def first(v: str, *keys: str) -> str:
    """The value under the first key that has one that isn't empty; null if none has."""
    x = f"x{next(_numbers)}"
    return f"get(filter(array({', '.join(at(v, k) for k in keys)}), {x} -> {truthy(x)}), 0)"


def present(v: str, keys: list[str]) -> str:
    """The value under the first key that is there, even if null; for a+b, the texts of the parts that aren't empty, as a variant."""
    def one(key: str) -> str:
        if "+" not in key:
            return at(v, key)
        parts = ", ".join(f"CASE WHEN {truthy(at(v, k))} THEN {_bare(shown(at(v, k)))} END" for k in key.split("+"))
        # to_variant_object takes no bare text: it is the one item of an array
        return let(f"array_compact(array({parts}))", lambda p: f"CASE WHEN size({p}) > 0 THEN try_variant_get(to_variant_object(array(array_join({p}, ' '))), '$[0]', 'variant') END")

    return f"coalesce({', '.join(map(one, keys))})"


def shown(v: str) -> str:
    """A value as text: True, None and quoted items as the dialect's exports print them."""
    def token(t: str) -> str:
        plain = t
        for old, new in ((",", ", "), (":", ": "), ("null", "None"), ("true", "True"), ("false", "False")):
            plain = f"replace({plain}, '{old}', '{new}')"
        return f"""CASE WHEN startswith({t}, '"') THEN concat("'", substring({t}, 2, length({t}) - 2), "'") ELSE {plain} END"""

    def of(x: str) -> str:
        t = f"x{next(_numbers)}"
        inner = f"array_join(transform(regexp_extract_all(to_json({x}), r'{_TOKEN}', 1), {t} -> {token(t)}), '')"
        number = f"CASE WHEN contains({text(x)}, '.') OR {kind(x)} NOT IN ('BIGINT', 'DECIMAL') THEN CAST(try_variant_get({x}, '$', 'double') AS STRING) ELSE {text(x)} END"
        return f"CASE {kind(x)} WHEN 'STRING' THEN {text(x)} WHEN 'BOOLEAN' THEN initcap({text(x)}) WHEN 'VOID' THEN 'None' WHEN 'OBJECT' THEN {inner} WHEN 'ARRAY' THEN {inner} ELSE {number} END"

    return let(v, of)


def listed(v: str) -> str:
    """The texts of a list or of a text with commas; of an object, what stands under name, value, skill or skillName."""
    def one(x: str) -> str:
        named = f"coalesce({', '.join(at(x, k) for k in ('name', 'value', 'skill', 'skillName'))})"
        return f"CASE {kind(x)} WHEN 'OBJECT' THEN {shown(named)} WHEN 'STRING' THEN {text(x)} END"

    x, y, z = (f"x{next(_numbers)}" for _ in range(3))
    parts = let(v, lambda p: f"CASE {kind(p)} WHEN 'STRING' THEN split({text(p)}, ',') WHEN 'ARRAY' THEN transform({items(p)}, {x} -> {one(x)}) END")
    return f"coalesce(filter(transform({parts}, {y} -> {_bare(y)}), {z} -> {z} <> ''), CAST(array() AS array<string>))"


def month(v: str) -> str:
    """A text as it is; of an object, its year and month, whatever they are."""
    def of(x: str) -> str:
        named = let(f"CASE WHEN {at(x, 'month')} IS NULL THEN '' ELSE {shown(at(x, 'month'))} END", lambda m: f"CASE WHEN length({m}) < 2 THEN lpad({m}, 2, '0') ELSE {m} END")
        dated = f"CASE WHEN {truthy(at(x, 'year'))} THEN concat({shown(at(x, 'year'))}, '-', {named}) END"
        return f"CASE {kind(x)} WHEN 'OBJECT' THEN {dated} WHEN 'STRING' THEN {text(x)} END"

    return let(v, of)


def whole(v: str, decimals: bool) -> str:
    """The whole number that a value holds, as a double, infinite if it is; null for what isn't one. A text may have decimals only if `decimals`."""
    def of(x: str) -> str:
        endless = f"WHEN lower({text(x)}) RLIKE r'^\\s*[+-]?inf(inity)?\\s*$' THEN double('infinity')" if decimals else ""
        written = let(_bare(text(x)), lambda b: f"CASE {endless} WHEN {b} RLIKE r'{_DECIMAL if decimals else '^[+-]?[0-9]+$'}' THEN try_cast({b} AS DOUBLE) END")
        return f"CASE {kind(x)} WHEN 'STRING' THEN {written} WHEN 'BOOLEAN' THEN IF({text(x)} = 'true', 1.0D, 0.0D) WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL WHEN 'VOID' THEN NULL ELSE try_variant_get({x}, '$', 'double') END"

    return let(let(v, of), lambda n: f"CASE WHEN isnan({n}) THEN CAST(NULL AS DOUBLE) WHEN abs({n}) < 1e15D THEN CAST(IF({n} < 0, ceil({n}), floor({n})) AS DOUBLE) ELSE {n} END")


def _too_large(n: str) -> str:
    return f"coalesce({n} >= 2147483648D OR {n} < -2147483648D, false)"


def _objects(v: str) -> str:
    """The objects of a list, or the one that stands alone."""
    x = f"x{next(_numbers)}"
    return f"filter({let(v, lambda p: f'CASE WHEN {kind(p)} = {chr(39)}ARRAY{chr(39)} THEN {items(p)} WHEN {p} IS NOT NULL THEN array({p}) END')}, {x} -> {kind(x)} = 'OBJECT')"


def _entries(v: str, fields: Callable[[str], dict[str, str]], *needed: str) -> str:
    """Structs of the objects' fields that have one of the needed ones."""
    x, e = (f"x{next(_numbers)}" for _ in range(2))
    made = f"transform({_objects(v)}, {x} -> named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {c}' for k, c in fields(x).items())}))"
    return f"filter({made}, {e} -> {' OR '.join(f'{e}.{n} IS NOT NULL' for n in needed)})" if needed else made


def experience(v: str) -> str:
    return _entries(v, lambda x: {
        "company": shown(first(x, "company", "companyName", "organization")), "title": shown(first(x, "title", "position", "role", "jobTitle")), "start": month(first(x, "start", "startDate", "start_date")),
        "end": month(first(x, "end", "endDate", "end_date")), "summary": shown(first(x, "summary", "description")),
    }, "company", "title")


def education(v: str) -> str:
    """Entries, of which some may say nothing, whose year is a double still."""
    def year(x: str) -> str:
        return let(first(x, "end_year", "endYear", "graduation_year"), lambda y: f"CASE WHEN {kind(y)} = 'OBJECT' THEN {at(y, 'year')} ELSE {y} END")

    return _entries(v, lambda x: {
        "institution": shown(first(x, "institution", "school", "schoolName", "university")), "degree": shown(first(x, "degree", "degreeName")),
        "field": shown(first(x, "field", "fieldOfStudy", "major", "specialization")), "year": whole(year(x), False),
    })


def _body(content: Column) -> Column:
    """The text, infinite numbers as ones too large for a double, halves of characters marked."""
    body = content.cast("string")
    odd = body.rlike(r"(?<![A-Za-z])(?:Infinity|NaN)(?![A-Za-z])")
    def numbers(x: Column) -> Column:
        return F.when(x.startswith('"'), x).otherwise(F.replace(F.replace(x, F.lit("Infinity"), F.lit("1e999")), F.lit("NaN"), F.lit("null")))

    body = F.when(odd, F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(1)), numbers), "")).otherwise(body)
    escape, high, low = r"((?<!\\)(?:\\\\)*)", r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    marked = F.regexp_replace(F.regexp_replace(body, f"{escape}{high}(?!{low})", f"$1{_HALF}"), f"{escape}(?<!{high}){low}", f"$1{_HALF}")
    return F.when(body.rlike(r"\\u[dD][89a-fA-F]"), marked).otherwise(body)


def _parsed(body: str) -> Column:
    """The one value that the text is; null for what is none."""
    both = items(f"""try_parse_json(concat('[', {body}, ',"{_END}"]'))""")
    return F.expr(let(both, lambda a: f"CASE WHEN size({a}) = 2 AND {text(f'get({a}, 1)')} = '{_END}' THEN get({a}, 0) END"))


def _items() -> Column:
    """The items of _top that may be records: of a list, of the list that a plain object wraps, or the object itself; of a large text, cut before it is parsed."""
    x = f"x{next(_numbers)}"
    wrapped = ", ".join(f"CASE WHEN {kind(at('_top', k))} = 'ARRAY' THEN {items(at('_top', k))} END" for k in dims.WRAPPER_KEYS)
    inner = ", ".join(f"from_json(_body, '{k} array<string>').{k}" for k in dims.WRAPPER_KEYS)
    texts = f"CASE WHEN _body RLIKE r'^\\s*\\[' THEN from_json(_body, 'array<string>') WHEN NOT _profile THEN coalesce({inner}) END"
    return F.expr(f"""CASE WHEN _file IS NOT NULL THEN array(CAST(NULL AS variant)) WHEN octet_length(_body) > {LARGE} THEN transform({texts}, {x} -> try_parse_json({x}))
        WHEN {kind('_top')} = 'ARRAY' THEN {items('_top')} WHEN {kind('_top')} = 'OBJECT' THEN CASE WHEN _profile THEN array(_top) ELSE coalesce({wrapped}, array(_top)) END END""")  # fmt: skip


def _failure() -> str:
    """Why the file is none."""
    return f"""
    CASE WHEN NOT is_valid_utf8(CAST(content AS STRING)) THEN "UnicodeDecodeError: the text isn't UTF-8" WHEN startswith(_body, '﻿') THEN 'JSONDecodeError: a byte-order mark'
    WHEN _top IS NULL AND coalesce(octet_length(_body) <= {LARGE}, true) THEN
        CASE WHEN _body RLIKE r'[\\[{{]{{900}}' THEN 'RecursionError: nested too deep' ELSE "JSONDecodeError: the text isn't one JSON value whose keys differ" END END"""


#: The scalars that must be texts, in the order in which they are looked at.
_TEXTS = ["headline", "linkedin", "github", "portfolio", "city", "region", "country"]
_FIELDS = ["full_name", "headline", "linkedin", "emails", "phones", "skills", "experience", "education", "city", "region", "country", "github", "portfolio", "years_experience"]


def _by_dialect(name: str) -> str:
    ats, other = ((present("_v", a[name]) if name in a else "CAST(NULL AS variant)") for a in (dims.ATS_ALIASES, dims.LINKEDIN_ALIASES))
    return f"CASE WHEN _profile THEN {other} ELSE {ats} END"


def _places() -> dict[str, str]:
    """_city, _region and _country: texts only in the plain dialect, whatever stands there in the other."""
    def only_text(v: str) -> str:
        return let(v, lambda x: f"CASE WHEN {kind(x)} = 'STRING' THEN {x} END")

    city = f"CASE WHEN {kind('_city')} = 'OBJECT' THEN {at('_city', 'city')} ELSE _city END"
    inside = f"{kind('_place')} = 'OBJECT'"
    return {
        "_city": f"CASE WHEN NOT _profile THEN {only_text(city)} WHEN {inside} THEN {first('_place', 'name', 'city')} ELSE {only_text('_place')} END",
        "_region": f"CASE WHEN NOT _profile THEN {only_text('_region')} END",
        "_country": f"CASE WHEN NOT _profile THEN {only_text('_country')} WHEN {inside} THEN {first('_place', 'country', 'countryCode')} END",
    }


def json_rows(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, row_seq, kind, error, and the fields of a record): a row for every record, for every one that can't be used and for every file that is none."""
    def having(df: DataFrame, **more: str) -> DataFrame:
        return df.selectExpr(*[c for c in df.columns if c not in more], *[f"{c} AS {n}" for n, c in more.items()])

    step = files.select(*keys, "content", (F.col("source_type") == "linkedin_json").alias("_profile"), _body(F.col("content")).alias("_body"))
    step = step.withColumn("_top", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.when(F.octet_length("_body") <= LARGE, _parsed("_body"))))
    step = having(step, _file=_failure()).select(*keys, "_profile", "_file", F.posexplode(_items().alias("i")).alias("row_seq", "_v"))
    step = step.filter(f"_file IS NOT NULL OR {kind('_v')} = 'OBJECT'")
    step = having(step, **{f"_{n}": _by_dialect(n) for n in _FIELDS}, _place=present("_v", dims.LINKEDIN_ALIASES["location"])).filter(f"_file IS NOT NULL OR {truthy('_full_name')}")
    step = having(step, **_places(), _years=f"CASE WHEN NOT _profile THEN {whole('_years_experience', True)} END", _schools=education("_education"))
    wrong = ", ".join(f"CASE WHEN {kind(f'_{n}')} NOT IN ('STRING', 'VOID') THEN \"{n} isn't a text\" END" for n in _TEXTS)
    half = f"CASE WHEN contains(to_json(_v), '{_HALF}') THEN 'half a character' END"
    large = f"CASE WHEN {_too_large('_years')} OR exists(_schools, e -> {_too_large('e.year')}) THEN 'a number is too large' END"
    step = having(step, error=f"coalesce(_file, concat('record ', row_seq, ': ', coalesce({half}, {wrong}, {large})))")
    schools = "filter(transform(_schools, e -> named_struct('institution', e.institution, 'degree', e.degree, 'field', e.field, 'end_year', try_cast(e.year AS INT))), e -> e.institution IS NOT NULL OR e.degree IS NOT NULL)"
    fields = {
        "full_name": _bare(shown("_full_name")), **{n: text(f"_{n}") for n in _TEXTS}, "years_experience": "try_cast(_years AS INT)", "emails": listed("_emails"), "phones": listed("_phones"), "skills": listed("_skills"),
        "experience": f"coalesce(CAST({experience('_experience')} AS array<{EXPERIENCE}>), array())", "education": f"coalesce(CAST({schools} AS array<{EDUCATION}>), array())",
    }
    return step.selectExpr(*keys, "CAST(IF(_file IS NULL, row_seq, 0) AS BIGINT) AS row_seq", "IF(error IS NULL, 'json', 'error') AS kind", "error", *[f"CASE WHEN error IS NULL THEN {c} END AS {n}" for n, c in fields.items()])
