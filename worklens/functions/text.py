"""Text and cleaning functions on columns. All treat null as the empty text unless they say otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spellings of a missing value in the extracts.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Words that say nothing about which work is meant.
STOP_WORDS = (
    "construction providing development improvement work works road roads village at of to from in the and for near under with gp mandal district building "
    "installation community public facility street system provision creation developmental strengthening ward house"
).split()

#: Capitalised words of descriptions that are not place names.
GENERIC_WORDS = (
    "construction providing development improvement work works road roads village at of to from in the and for near under with gp mandal district building "
    "installation community public facility street system provision creation developmental strengthening ward house "
    "cc rcc internal external approach main side north south east west bore borewell motor pump tank drain drainage wall compound slab pipe pipeline lights light "
    "fixture fixtures power electrical solar renovation repair repairs urgent colony sc st bc oc nagar hall centre center activity multipurpose platform meeting room "
    "open cover culvert bridge retaining protection boundary gate fencing gravel cement concrete precast interlock pavement footpath pathway drinking water plant "
    "mineral overhead ohsr reservoir sump tap toilet bathroom parking space stadium ground burial cemetery park school hospital library church temple mosque shrine "
    "gurudwara anganwadi sachivalayam panchayat grama gram sabha bhavan bhawan phase part reach section km meters ltr liter capacity no number plot survey block "
    "sector door flat unit formation laying excavation fixing supply purchase municipal municipality corporation town city area region layout extension junction "
    "cross circle bus shelter stop access entry exit link bypass flyover overbridge mr dr sri smt shri"
).split()

#: Terms that name the same type of work; a text may belong to several types.
WORK_TYPES = (
    ("ohsr", "overhead", "reservoir", "wr", "water tank", "watertank"),
    ("community hall", "community centre", "community center", "cc hall"),
    ("under drainage", "underground drainage", "ug drainage", "sewerage", "sewage", "ud system"),
    ("cc road", "rcc road", "cement road", "concrete road"),
    ("gravel road", "mud road", "wbm road"),
    ("burial ground", "graveyard", "cemetery", "burial"),
    ("bore well", "borewell", "bore motor"),
    ("pipeline", "pipe line", "water pipeline"),
    ("street light", "streetlight", "street lighting"),
    ("compound wall", "boundary wall"),
    ("retaining wall", "protection wall"),
    ("culvert", "bridge", "bailey bridge"),
    ("drain", "drainage", "cc drain", "open drain"),
    ("bus shelter", "bus stop", "bus stand"),
    ("stadium", "sports", "playground"),
    ("toilet", "sanitation", "latrine"),
    ("anganwadi",),
    ("school", "vidyalaya", "college"),
    ("hospital", "clinic", "dispensary"),
)

#: Words that number a location; "no" and "number" mean the same.
LOCATION_WORDS = (("ward",), ("plot",), ("survey",), ("phase",), ("block",), ("sector",), ("door",), ("flat",), ("unit",), ("part",), ("house",), ("no", "number"))


@F.udf(StringType(), useArrow=False)
def _nfkc(text: str | None) -> str | None:
    """Not by Arrow: its batches count rows, and thousands of long texts fill a worker's memory; plain ones have a hundred."""
    return None if text is None else unicodedata.normalize("NFKC", text)


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII text is its own NFKC form and is taken as it is, without Python, which gets a null in its place."""
    open_ = F.octet_length(text) > F.char_length(text)
    return F.when(open_, _nfkc(F.when(open_, text))).otherwise(text)


#: The characters that Unicode counts as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Null as empty, without white space of any kind at the ends."""
    return F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(WHITE_SPACE))


def normalize_text(text: Column, compatible: bool = True) -> Column:
    """Lower-case words of a-z, 0-9 and Devanagari with single spaces; "&" reads "and".
    ``compatible``: bring text to NFKC form first."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.lower(nfkc(text) if compatible else text)
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9ऀ-ॿ]+", " "))


def key_of(normalized: Column) -> Column:
    """The letters a-z and digits of a normalised text; empty counts as missing."""
    return F.regexp_replace(normalized, "[^a-z0-9]+", "")


def canonical_member(normalized: Column) -> Column:
    """A name without one leading honorific."""
    return F.trim(F.regexp_replace(normalized, r"^(shri|smt|mr|ms|dr)\.?\s+", ""))


def canonical_constituency(normalized: Column) -> Column:
    """A name without a number at its end."""
    return F.trim(F.regexp_replace(normalized, r"\s*-?\s*\d+\s*$", ""))


def money(text: Column) -> Column:
    """Amount without commas and rupee signs; null where that is no number."""
    bare = F.trim(F.translate(text.cast("string"), ",₹", ""))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))$"), bare.try_cast("double"))


_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY, _YEAR, _CUT = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|\d{2})", "[-/. ]"
#: Forms of a date, and which group of each is the year, the month and the day (0: there is none).
DATE_FORMS = (
    (rf"(\d{{4}}){_CUT}(\d{{1,2}}){_CUT}(\d{{1,2}})", 1, 2, 3),
    (r"(\d{4})(\d{2})(\d{2})", 1, 2, 3),
    (rf"(\d{{1,2}}){_CUT}(\d{{1,2}}){_CUT}{_YEAR}", 3, 1, 2),
    (rf"{_DAY}{_CUT}{{0,2}}(?:of )?{_MONTH}\.?{_CUT}{{0,2}}{_YEAR}", 3, 2, 1),
    (rf"{_MONTH}\.?{_CUT}?{_DAY}{_CUT}{_YEAR}", 3, 1, 2),
    (rf"(\d{{4}}){_CUT}?{_MONTH}\.?{_CUT}?{_DAY}", 1, 2, 3),
    (rf"{_MONTH}\.?{_CUT}?(\d{{4}})", 2, 1, 0),
    (r"(\d{4})[-/](\d{1,2})", 1, 2, 0),
    (r"(\d{4})", 1, 0, 0),
)
_WEEKDAY = r"^(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\.? "
_TIME = r"(?:^|[ t])(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)? ?([ap]m|[ap]\.m\.)? ?(z|utc|gmt|[+-]\d{2}:?\d{2})?$"


def _stamp(text: Column) -> Column:
    """The time of a text in lower case with single spaces. What all forms look at is found once a text."""
    timed = text.rlike(_TIME)
    day = F.trim(F.regexp_replace(F.when(timed, F.regexp_replace(text, _TIME, "")).otherwise(text), _WEEKDAY, ""))
    parts = F.array(F.struct(timed.alias("timed"), day.alias("day")))
    return F.element_at(F.transform(parts, lambda x: _stamp_of(text, x["timed"], x["day"])), 1)


def _stamp_of(text: Column, timed: Column, day: Column) -> Column:
    """The time of a text: ``timed``: whether it ends in a time of day; ``day``: its date, without the weekday."""
    group = lambda source, pattern, i: F.nullif(F.regexp_extract(source, pattern, i), F.lit(""))
    part = lambda i: group(text, _TIME, i)
    number = lambda c: c.try_cast("int")
    hour, half = number(part(1)), F.substring(part(5), 1, 1)
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.concat(F.coalesce(part(3), F.lit("0")), F.lit("."), F.substring(F.coalesce(part(4), F.lit("0")), 1, 6)).try_cast("decimal(16,6)")
    zone = F.replace(part(6), F.lit(":"), F.lit(""))
    ahead = F.when(F.substring(zone, 1, 1).isin("+", "-"), F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (number(F.substring(zone, 2, 2)) * 60 + number(F.substring(zone, 4, 2)))).otherwise(0)
    months = F.create_map(*(F.lit(x) for i, name in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1) for x in (name, i)))
    found = []
    for form, y, m, d in DATE_FORMS:
        form = f"^{form}$"
        year = number(group(day, form, y))
        year = F.when(F.length(group(day, form, y)) > 2, year).otherwise(year + F.when(year < 69, 2000).otherwise(1900))
        named = F.try_element_at(months, F.substring(group(day, form, m), 1, 3)) if m else F.lit(1)
        month = F.coalesce(number(group(day, form, m)), named) if m else F.lit(1)
        date_ = number(group(day, form, d)) if d else F.lit(1)
        if m and d and "jan" not in form:  # month first, unless only the other can be one
            month, date_ = F.when(month > 12, date_).otherwise(month), F.when(month > 12, month).otherwise(date_)
        clock = (F.when(timed, hour).otherwise(0), F.when(timed, number(part(2))).otherwise(0), F.when(timed, second).otherwise(0))
        found.append(F.when(day.rlike(form), F.struct(year.alias("y"), month.alias("m"), date_.alias("d"), clock[0].alias("h"), clock[1].alias("n"), clock[2].alias("s"))))
    one = F.coalesce(*found)
    made = F.element_at(F.transform(F.array(one), lambda x: F.when(x.isNotNull(), F.try_make_timestamp_ntz(x["y"], x["m"], x["d"], x["h"], x["n"], x["s"]))), 1)
    return made - F.make_dt_interval(F.lit(0), F.lit(0), F.when(timed, F.coalesce(ahead, F.lit(0))).otherwise(0))


def date(text: Column) -> Column:
    """Timestamp without zone of a date as people write it, or null: DATE_FORMS with numbers or names of months, after a
    weekday or not, month first where day and month are both possible, two-digit years from 1969 to 2068, with or without a
    time of day (of 24 or 12 hours). A time with a zone is given in UTC."""
    plain = F.regexp_replace(F.lower(F.trim(text.cast("string"))), r"[\s,]+", " ")
    return F.element_at(F.transform(F.array(plain), _stamp), 1)


def one_place(value: Column) -> Column:
    """A number with one decimal place, ties of its exact binary value to the even digit."""

    def tenths(bits: int) -> Column:
        # in these units a number is whole, and so is ten times it
        units = (value * float(1 << bits)).cast("bigint") * 10
        rest, whole = units.bitwiseAND((1 << bits) - 1), F.shiftright(units, bits)
        up = (rest > 1 << bits - 1) | ((rest == 1 << bits - 1) & (whole % 2 == 1))
        return (whole + up.cast("bigint")) / 10.0

    exact = F.when((value >= 1) & (value < 128), tenths(52)).when((value >= 128) & (value < 16384), tenths(45))
    return F.format_string("%.1f", F.coalesce(exact, value))


def formatted(pattern: str, *values: Column) -> Column:
    """Text of a pattern in which each %.1f is set as :func:`one_place` does, and %.0f rounds ties to even."""
    kinds = re.findall(r"%[^a-z]*[a-z]", pattern.replace("%%", ""))
    return F.format_string(pattern.replace("%.1f", "%s"), *(one_place(v.cast("double")) if k == "%.1f" else F.rint(v) if k == "%.0f" else v for k, v in zip(kinds, values)))


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def telling_tokens(text: Column) -> Column:
    """Tokens that are no stop words."""
    return F.array_except(tokens(text), F.array(*map(F.lit, STOP_WORDS)))


def work_types(text: Column) -> Column:
    """Numbers of the work types that a text names anywhere in it."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s]", " "), r"\s+", " "))
    # the plain text is an array's only element, so that it is made once and not for each term
    named = lambda p: F.array(*(F.when(reduce(lambda a, b: a | b, [F.contains(p, F.lit(t)) for t in terms]), F.lit(i)) for i, terms in enumerate(WORK_TYPES)))
    return F.element_at(F.transform(F.array(plain), lambda p: F.filter(named(p), lambda i: i.isNotNull())), 1)


def differ_both_ways(a: Column, b: Column) -> Column:
    """Whether each of two arrays has something that the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def place_names(text: Column) -> Column:
    """Lower-cased capitalised words of three letters or more that are no generic words. In a text that is
    mostly capitals, every word counts as capitalised."""
    text = F.coalesce(text, F.lit(""))
    upper = F.length(F.regexp_replace(text, r"(?U)[^\p{Lu}]", ""))
    letters = F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"(?U)[^\p{L}]", "")))
    pattern = F.when(upper / letters > 0.6, F.lit(r"(?U)\b([A-Za-z]{3,})\b")).otherwise(F.lit(r"(?U)\b([A-Z][a-z]{2,})\b"))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.lower)
    return F.array_except(found, F.array(*map(F.lit, GENERIC_WORDS)))


def location_numbers(text: Column) -> Column:
    """Array of (kind, number) such as "13th ward" and "ward 13" give; kind counts LOCATION_WORDS."""
    text = F.lower(F.coalesce(text, F.lit("")))
    words = "|".join(sorted((w for group in LOCATION_WORDS for w in group), key=len, reverse=True))
    kind = F.create_map(*(F.lit(x) for i, group in enumerate(LOCATION_WORDS) for w in group for x in (w, i)))
    found = []
    for pattern, number, word in ((rf"(?U)\b(\d+)(?:st|nd|rd|th)?\s+({words})\b", 1, 2), (rf"(?U)\b({words})\b[\s.:/-]*(\d+)", 2, 1)):
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(word)).alias("w"), F.regexp_extract_all(text, F.lit(pattern), F.lit(number)).alias("n"))
        found.append(F.transform(both, lambda x: F.struct(kind[x["w"]].alias("kind"), F.translate(x["n"], "०१२३४५६७८९", "0123456789").try_cast("decimal(38,0)").alias("number"))))
    return F.array_distinct(F.concat(*found))


def location_conflicts(a: Column, b: Column) -> Column:
    """Kinds of location that both sides number, with no number in common."""
    numbers = lambda side, i: F.transform(F.filter(side, lambda x: x["kind"] == i), lambda x: x["number"])
    kinds = F.array_intersect(F.transform(a, lambda x: x["kind"]), F.transform(b, lambda x: x["kind"]))
    return F.array_sort(F.filter(kinds, lambda i: ~F.arrays_overlap(numbers(a, i), numbers(b, i))))


def unmatched_reason(text: Column) -> Column:
    """The cause in a reason text that is tagged as unmatched, else empty."""
    body = F.regexp_extract(text, r"(?s)^\[UNMATCHED REASON\](.*)$", 1)
    return F.trim(F.substring_index(body, " || ", 1))


def reason_evidence(text: Column) -> Column:
    """What follows the cause in a tagged reason text; the whole text if it is not tagged."""
    tagged = F.startswith(text, F.lit("[UNMATCHED REASON]"))
    split = F.contains(text, F.lit(" || "))
    return F.when(~tagged, text).when(split, F.trim(F.regexp_extract(text, r"(?s) \|\| (.*)$", 1))).otherwise(F.lit(""))


def reason_value(evidence: Column, name: str) -> Column:
    """The number of ``name=number`` in an evidence text whose parts are divided by "; ", or null."""
    parts = F.filter(F.split(evidence, "; "), lambda p: F.startswith(p, F.lit(f"{name}=")))
    return F.substring(F.element_at(F.when(F.size(parts) > 0, parts), -1), len(name) + 2, 1 << 20).try_cast("double")
