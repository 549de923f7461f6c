"""Normalizers. Each gives struct<value, rules>: the value and the rules that made it, from one evaluation.

A rule is struct<rule, category, field, before, after>. List normalizers give
struct<value: array, rules, duplicates>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from meldwork.functions import dims
from meldwork.functions.text import let, strip, title

RULE = "struct<rule:string,category:string,field:string,before:string,after:string>"


def rule(name: str, category: str, field: str, before: Column, after: Column | None = None) -> Column:
    after = F.lit(None).cast("string") if after is None else after
    return F.struct(F.lit(name).alias("rule"), F.lit(category).alias("category"), F.lit(field).alias("field"), before.alias("before"), after.alias("after"))


def _result(value: Column, *rules: Column) -> Column:
    return F.struct(value.alias("value"), F.array_compact(F.array(*rules)).cast(f"array<{RULE}>").alias("rules"))


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map, folded once."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def email(c: Column) -> Column:
    """Strip, lower, and check: null if not an address."""
    def of(c: Column, bare: Column, low: Column, good: Column) -> Column:
        return _result(
            F.when(good, low),
            F.when(bare != c, rule("trim_whitespace", "email", "emails", c, bare)),
            F.when(~good, rule("email_validation_failed", "email", "emails", c)),
            F.when(good & (low != bare), rule("lowercase", "email", "emails", bare, low)),
        )

    return let(strip(c), lambda bare: let(F.lower(bare), lambda low: let(low.rlike(f"^{dims.EMAIL}$"), lambda good: of(c, bare, low, good))))


def _plan(region: str) -> tuple[str, str]:
    """A region's calling code and the pattern of its subscribers' numbers."""
    code, least, most, begin = dims.PHONE_RULES[region]
    return code, f"[{begin}][0-9]{{{least - 1},{most - 1}}}"


def phone(c: Column, region: str = "IN") -> Column:
    """E.164 by the numbering plans of dims.PHONE_RULES: the longest calling code that the number begins with decides; trunk 0, 00 for +; a code outside the table passes with 8 to 15 digits."""
    code, own = _plan(region)
    plans = literal_map(dict(map(_plan, dims.PHONE_RULES)))

    def abroad(far: Column) -> Column:
        known = F.coalesce(*[F.when(F.try_element_at(plans, F.substring(far, 1, k)).isNotNull(), k) for k in (3, 2, 1)])
        def held(k: Column) -> Column:
            plan = F.concat(F.lit("^"), F.try_element_at(plans, F.substring(far, F.lit(1), k)), F.lit("$"))
            return F.when(k.isNull(), F.length(far).between(8, 15)).otherwise(F.rlike(F.substring(far, k + 1, F.length(far)), plan))

        return F.when(let(known, held), F.concat(F.lit("+"), far))

    def value(bare: Column, digits: Column) -> Column:
        home = F.regexp_replace(digits, "^0", "")
        near = F.when(home.rlike(f"^{own}$"), F.concat(F.lit("+" + code), home)).when(digits.rlike(f"^{code}{own}$"), F.concat(F.lit("+"), digits))
        far = F.when(bare.startswith("+"), digits).when(digits.startswith("00"), F.substring(digits, F.lit(3), F.length(digits)))
        return F.when(~_odd(bare, digits), let(far, lambda f: F.when(f.isNotNull(), abroad(f)).otherwise(near)))

    def of(bare: Column, digits: Column, got: Column) -> Column:
        failed = got.isNull() & (bare != "")
        return _result(
            got,
            F.when(got.isNotNull(), rule("convert_to_e164", "phone", "phones", c, got)),
            F.when(failed & ~_odd(bare, digits), rule("phone_validation_failed", "phone", "phones", c)),
            F.when(failed & _odd(bare, digits), rule("phone_parse_failed", "phone", "phones", c)),
        )

    return let(strip(c), lambda bare: let(F.regexp_replace(bare, "[^0-9]", ""), lambda digits: let(value(bare, digits), lambda got: of(bare, digits, got))))


def _odd(bare: Column, digits: Column) -> Column:
    """Not a phone number at all: words, or fewer than two digits."""
    return bare.rlike("[A-Za-z]{3}") | (F.length(digits) < 2)


#: Layouts that a date may have, tried in this order.
DATE_LADDER = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/yyyy", "MM/dd/yyyy", "MMM yyyy", "MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss"]


def fuzzy_month(bare: Column, year: int | None = None) -> Column:
    """YYYY-MM of a date within other words: a month by its name or its first three letters or more, else the first of two or three
    numbers that can be one, month before day; the year of four digits, or of two behind an apostrophe or as the last of three numbers (69 to 99 in the last century), or
    `year`. A year alone is its January. Null without a year, and where no month and no year of four digits stands.
    """
    names = F.array(*map(F.lit, dims.MONTHS))
    tokens = F.regexp_extract_all(F.lower(bare), F.lit(r"([a-z]+|[0-9]+)"), F.lit(1))
    words = F.transform(F.filter(tokens, lambda t: t.rlike("^[a-z]{3,}$")), lambda t: F.array_position(F.transform(names, lambda n: n.startswith(t) | ((t == "sept") & (n == "september"))), True))
    numbers = F.transform(F.filter(tokens, lambda t: t.rlike("^[0-9]{1,2}$")), lambda t: t.cast("int"))
    whole = F.get(F.transform(F.filter(tokens, lambda t: t.rlike("^[12][0-9]{3}$")), lambda t: t.cast("int")), F.lit(0))

    def of(named: Column, small: Column, full: Column) -> Column:
        short = F.coalesce(F.regexp_extract(bare, r"['\u2019]([0-9]{2})(?![0-9])", 1).try_cast("int"), F.when(named.isNull() & (F.size(small) == 3), F.get(small, F.lit(2))))
        y = F.coalesce(full, short + F.when(short > 68, 1900).otherwise(2000), F.lit(year).cast("int"))
        pair = F.when(F.size(small) + F.when(full.isNotNull(), 1).otherwise(0) >= 2, F.get(F.filter(F.slice(small, 1, 2), lambda n: n.between(1, 12)), F.lit(0)))
        m = F.coalesce(named, pair, F.when(full.isNotNull(), 1))
        return F.when(y.isNotNull() & m.isNotNull(), F.format_string("%04d-%02d", y, m))

    return let(F.get(F.filter(words, lambda n: n > 0), F.lit(0)).cast("int"), lambda named: let(numbers, lambda small: let(whole, lambda full: of(named, small, full))))


def date(c: Column, field: str = "date", year: int | None = None) -> Column:
    """YYYY-MM or Present. YYYY-MM passes unchecked, a bare year is its January, other layouts go down the ladder and then through fuzzy_month(); `year` is that of dates without one."""
    def kind(bare: Column) -> Column:
        return F.when(bare == "", "empty").when(F.lower(bare).isin("present", "current", "now", "ongoing"), "now").when(bare.rlike("^[0-9]{4}-[0-9]{2}$"), "ready").when(bare.rlike("^[0-9]{4}$"), "year").otherwise("other")

    def value(bare: Column, what: Column) -> Column:
        parsed = F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in DATE_LADDER])
        other = F.coalesce(F.date_format(parsed, "yyyy-MM"), fuzzy_month(bare, year))
        return F.when(what == "now", "Present").when(what == "ready", bare).when(what == "year", F.concat(bare, F.lit("-01"))).when(what == "other", other)

    def of(what: Column, got: Column) -> Column:
        return _result(
            got,
            F.when(what == "year", rule("date_year_only", "date", field, c, got)),
            F.when((what == "other") & (got != c), rule("date_format_normalize", "date", field, c, got)),
            F.when((what == "other") & got.isNull(), rule("date_parse_failed", "date", field, c)),
        )

    return let(strip(c), lambda bare: let(F.when(bare.isNull(), "empty").otherwise(kind(bare)), lambda what: let(value(bare, what), lambda got: of(what, got))))


def iso_countries(spark: SparkSession) -> dict[str, str]:
    """Lower-cased English name to code, from the Java runtime's ISO 3166 table."""
    locale = spark._jvm.java.util.Locale
    return {locale("", code).getDisplayCountry(locale.ENGLISH).lower(): code for code in locale.getISOCountries()}


def _folded(c: Column) -> Column:
    """Lower case without the accents that English names of countries drop."""
    return F.translate(F.lower(c), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")


def fuzzy_country(text: Column, names: dict[str, str]) -> Column:
    """The code of the name that is most like a text of three letters or more: first names that contain it, the earlier in the name the better,
    then names within one edit for every four of the text's letters, the nearest first; ties go by code. Null if there is none.
    """
    known = F.transform(F.map_entries(literal_map(names)), lambda n: F.struct(_folded(n["key"]).alias("name"), n["value"].alias("code")))

    def of(t: Column) -> Column:
        holding = F.filter(F.transform(known, lambda n: F.struct(F.call_function("instr", n["name"], t).alias("place"), n["code"].alias("code"))), lambda n: n["place"] > 0)
        most = F.floor(F.length(t) / 4).cast("int")
        near = F.filter(F.transform(known, lambda n: F.struct(F.levenshtein(n["name"], t).alias("place"), n["code"].alias("code"))), lambda n: n["place"] <= most)
        return F.when(F.length(t) >= 3, F.coalesce(F.array_min(holding)["code"], F.array_min(near)["code"]))

    return let(_folded(text), of)


def country(c: Column, names: dict[str, str] | None = None) -> Column:
    """A two-letter code: any two characters are upper-cased unchecked, then aliases, then ISO names, then fuzzy_country()."""
    aliases = literal_map(dims.COUNTRIES)
    iso = literal_map(names) if names else None

    def fuzzy(low: Column) -> Column:
        return fuzzy_country(low, names) if names else F.lit(None).cast("string")

    def how(bare: Column) -> Column:
        low = F.lower(bare)
        exact = F.try_element_at(iso, low) if iso is not None else F.lit(None).cast("string")
        def step(name: str, code: Column) -> Column:
            return F.when(code.isNotNull(), F.struct(F.lit(name).alias("rule"), code.alias("code")))

        two = F.when(F.length(bare) == 2, F.struct(F.lit("country_code_uppercase").alias("rule"), F.upper(bare).alias("code")))
        none = F.struct(F.lit("country_resolve_failed").alias("rule"), F.lit(None).cast("string").alias("code"))
        found = F.coalesce(two, step("country_alias_resolve", F.try_element_at(aliases, low)), step("country_name_resolve", exact), step("country_fuzzy_resolve", fuzzy(low)), none)
        return F.when(bare != "", found)

    def of(got: Column) -> Column:
        logged = got.isNotNull() & ((got["rule"] != "country_code_uppercase") | (got["code"] != c))
        entry = F.struct(got["rule"].alias("rule"), F.lit("location").alias("category"), F.lit("location.country").alias("field"), c.alias("before"), got["code"].alias("after"))
        return _result(got["code"], F.when(logged, entry))

    return let(strip(c), lambda bare: let(how(bare), of))


def skill(c: Column) -> Column:
    """The canonical name of a known alias, else title case; blank stays as it is."""
    aliases = literal_map(dims.SKILLS)

    def of(bare: Column, known: Column, got: Column) -> Column:
        return _result(
            got,
            F.when(known.isNotNull() & (got != c), rule("skill_canonicalize", "skill", "skills", c, got)),
            F.when((bare != "") & known.isNull() & (got != c), rule("skill_title_case", "skill", "skills", c, got)),
        )

    def named(bare: Column, known: Column) -> Column:
        return let(F.when(bare == "", c).otherwise(F.coalesce(known, title(bare))), lambda got: of(bare, known, got))

    return let(strip(c), lambda bare: let(F.try_element_at(aliases, F.lower(bare)), lambda known: named(bare, known)))


def listed(values: Column, one: Callable[[Column], Column], category: str, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """Normalize every item, drop nulls, keep the first of equal keys, sort; repeats are counted and logged."""
    field = category + "s"

    def of(results: Column, good: Column, keys: Column) -> Column:
        again = F.transform(good, lambda v, i: F.array_position(keys, key(v)) <= i)
        first = F.filter(good, lambda v, i: F.array_position(keys, key(v)) == i + 1)
        repeats = F.filter(F.transform(good, lambda v, i: F.when(F.array_position(keys, key(v)) <= i, v)), lambda v: v.isNotNull())
        rules = F.concat(F.flatten(F.transform(results, lambda r: r["rules"])), F.transform(repeats, lambda v: rule(f"remove_duplicate_{category}", category, field, v))).cast(f"array<{RULE}>")
        return F.struct(F.array_sort(first).alias("value"), rules.alias("rules"), F.size(F.filter(again, lambda x: x)).alias("duplicates"))

    items = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: one(x))
    return let(items, lambda r: let(F.filter(F.transform(r, lambda x: x["value"]), lambda v: v.isNotNull()), lambda good: let(F.transform(good, lambda v: key(v)), lambda keys: of(r, good, keys))))


def email_list(values: Column) -> Column:
    return listed(values, email, "email")


def phone_list(values: Column, region: str = "IN") -> Column:
    return listed(values, lambda x: phone(x, region), "phone")


def skill_list(values: Column) -> Column:
    return listed(values, skill, "skill", F.lower)
