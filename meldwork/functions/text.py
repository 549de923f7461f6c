"""Text expressions: stripping, title case, and field extraction from free text. Column in, Column out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meldwork.functions import dims

WHITE = r"[ \t\n\x0B\f\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def strip(c: Column) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def non_empty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def split_list(c: Column, delimiter: str = ",") -> Column:
    """The stripped, non-empty parts of a delimited string; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(delimiter)), strip)
    return F.filter(parts, lambda x: x != "")


def title(c: Column) -> Column:
    """Every run of letters capitalised, so `node.js` becomes `Node.Js` and `3d` `3D`."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def find_all(c: Column, pattern: str, only: Column | None = None) -> Column:
    """All matches; `only` is a cheap test that a text with a match passes, so that most texts are never searched."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.coalesce(found if only is None else F.when(only, found), F.array().cast("array<string>"))


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(find_all(text, dims.EMAIL, text.contains("@"))))


def phones(text: Column) -> Column:
    """Phone-like runs with 7 to 15 digits, stripped, distinct, sorted."""
    found = F.filter(find_all(text, dims.PHONE, text.rlike("[0-9]{3}")), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(7, 15))
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


def urls(text: Column) -> Column:
    """Links other than profile links, in text order with repeats."""
    return F.filter(find_all(text, dims.URL, text.contains("http")), lambda x: ~F.lower(x).contains("linkedin") & ~F.lower(x).contains("github"))


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def name_line(text: Column) -> Column:
    """The first of the first five lines that looks like a name."""
    lines = F.transform(F.slice(F.split(strip(text), "\n"), 1, 5), strip)

    def is_name(x: Column) -> Column:
        phone = x.rlike(dims.PHONE) & (F.length(x) < 20)
        return F.length(x).between(2, 49) & ~x.rlike(dims.EMAIL) & ~x.rlike(dims.URL) & ~phone & x.rlike(dims.NAME_LINE)

    return F.get(F.filter(lines, is_name), F.lit(0))


def labelled_name(text: Column) -> Column:
    """The capture behind `Name:` and the like, if it has at most four words."""
    found = strip(F.regexp_extract(text, dims.NAME_LABEL, 1))
    return F.when((found != "") & (F.size(F.split(found, f"{WHITE}+")) <= 4), found)


def keyword_pattern(word: str) -> str:
    """The word between word boundaries, spelled out so that every engine reads it alike.

    A boundary behind a sign, as in `c++`, needs a word character after it.
    """
    w = r"[\p{L}\p{N}_]"
    return rf"(?:^|[^\p{{L}}\p{{N}}_]){re.escape(word)}" + (r"(?:$|[^\p{L}\p{N}_])" if word[-1].isalnum() else w)


def keywords(text: Column) -> Column:
    """Known skill keywords as whole words, sorted. Those of letters and digits are looked up among the text's words; the others are searched."""
    plain = [k for k in dims.KEYWORDS if k.isalnum()]

    def found(t: Column) -> Column:
        words = F.array_intersect(F.split(t, r"[^\p{L}\p{N}_]+"), F.array(*map(F.lit, plain)))
        odd = F.array_compact(F.array(*[F.when(t.contains(k) & t.rlike(keyword_pattern(k)), F.lit(k)) for k in dims.KEYWORDS if k not in plain]))
        return F.array_sort(F.concat(words, odd))

    return let(F.lower(text), found)


def section(text: Column, name: str) -> Column:
    """From the end of the section's header to the nearest other header."""
    begin = F.regexp_instr(text, F.lit(dims.SECTIONS[name]))
    rest = F.substring(text, begin + F.length(F.regexp_extract(text, dims.SECTIONS[name], 0)), F.length(text))
    stops = [F.nullif(F.regexp_instr(rest, F.lit(p)), F.lit(0)) for k, p in dims.SECTIONS.items() if k != name]
    return F.when(begin > 0, strip(F.substring(rest, F.lit(1), F.coalesce(F.least(*stops), F.length(rest) + 1) - 1))).otherwise(F.lit(""))


def blocks(text: Column) -> Column:
    """Groups of lines between blank ones: an array of arrays of stripped lines."""
    parts = F.split(strip(text), rf"\n{WHITE}*\n")
    lines = F.transform(parts, lambda p: F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != ""))
    return F.filter(lines, lambda x: F.size(x) > 0)


def experience_block(lines: Column) -> Column:
    dates = find_all(F.array_join(lines, " "), dims.MONTH_YEAR)
    second = F.get(lines, F.lit(1))
    rest = F.substring(F.array_join(F.slice(lines, F.lit(3), F.size(lines)), " "), 1, 500)
    return F.struct(
        F.when(~second.rlike(dims.MONTH_YEAR), second).alias("company"), F.get(lines, F.lit(0)).alias("title"),
        F.get(dates, F.lit(0)).alias("start"), F.get(dates, F.lit(1)).alias("end"), F.nullif(rest, F.lit("")).alias("summary"),
    )


def education_block(lines: Column) -> Column:
    """end_year keeps the specification's reading: the century of the last year found (19 or 20)."""
    whole = F.array_join(lines, " ")
    years = F.regexp_extract_all(whole, F.lit(dims.YEAR), F.lit(1))
    degree = F.nullif(strip(F.regexp_extract(whole, dims.DEGREE, 0)), F.lit(""))
    other = F.get(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: ~x.rlike(dims.YEAR) & (F.length(x) > 3)), F.lit(0))
    return F.struct(
        F.get(lines, F.lit(0)).alias("institution"), F.coalesce(degree, other).alias("degree"), F.when(degree.isNotNull(), other).alias("field"),
        F.get(years, F.size(years) - 1).cast("int").alias("end_year"),
    )
