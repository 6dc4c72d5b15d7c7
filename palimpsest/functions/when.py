"""What questions and records say about time, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import text

#: Month names, in the order in which they are looked for, and their numbers.
MONTHS = [
    (name, k + 1)
    for k, names in enumerate((("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"), ("september", "sep"), ("october", "oct"), ("november", "nov"), ("december", "dec")))
    for name in names
]
DATE = r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})"


def date_in(x: Column) -> Column:
    """The first date in a text, null where it is none."""
    return F.try_to_date(F.regexp_replace(F.nullif(F.regexp_extract(x, DATE, 1), F.lit("")), "[/.]", "-"), "yyyy-M-d")


def asked_time(query: Column) -> dict[str, Column]:
    """What a query asks for: direction (oldest or newest), after, before, day, year and month; null where it doesn't."""
    low = F.lower(query)
    words = F.regexp_extract_all(low, F.lit("[a-z']+"), F.lit(0))
    any_of = lambda w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    after = date_in(F.regexp_extract(low, r"after\s+([^.,;?]+)", 1))
    before = date_in(F.regexp_extract(low, r"before\s+([^.,;?]+)", 1))
    day = date_in(low)
    may = low.rlike(r"\bmay\s+(?:\d{1,2}(?:st|nd|rd|th)?|\d{4})") | query.contains(" May")
    month = F.coalesce(*(F.when(may if name == "may" else low.rlike(rf"\b{name}\b"), number) for name, number in MONTHS))
    return {
        "direction": F.when(before.isNotNull(), "oldest").when(after.isNotNull() | any_of(L.NEWEST_WORDS), "newest").when(any_of(L.OLDEST_WORDS), "oldest"),
        "after": after,
        "before": before,
        "day": day,
        "year": F.coalesce(F.year(day), F.nullif(F.regexp_extract(low, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")),
        "month": F.coalesce(month, F.month(day)),
    }


def cue_date(cues: Column) -> Column:
    """The date of the first cue that begins with `date:` and holds one."""
    return F.get(F.filter(F.transform(F.filter(cues, lambda c: c.startswith("date:")), date_in), lambda d: d.isNotNull()), 0)


def date_boost(item: Column, asked: dict[str, Column]) -> Column:
    """1 where a memory's date is what the query asks for, else 0."""
    exact = asked["day"].isNotNull() | asked["after"].isNotNull() | asked["before"].isNotNull()
    hit = exact | (F.year(item) == asked["year"]) | (F.month(item) == asked["month"])
    out = (item < asked["after"]) | (item > asked["before"])
    return F.when(item.isNull() | F.coalesce(out, F.lit(False)), 0.0).when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def order_asked(query: Column) -> Column:
    """`before` or `after` for questions about an order, else null; words for before win."""
    low = F.lower(query)
    return F.when(text.contains_any(low, L.BEFORE_WORDS), "before").when(text.contains_any(low, L.AFTER_WORDS), "after")


def hops_asked(query: Column) -> Column:
    return F.when(F.lower(query).rlike(L.SECOND_HOP), 2).otherwise(1)


def anchor_dates(terms: Column) -> Column:
    """The dates among a query's terms, in their order."""
    return F.filter(F.transform(F.filter(terms, lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}$")), lambda t: F.try_to_date(t)), lambda d: d.isNotNull())


def event_date(content: Column, cues: Column) -> Column:
    """A record's date: the first in its text, else the first cue that is one."""
    iso = r"(\d{4}-\d{2}-\d{2})"
    inside = F.try_to_date(F.nullif(F.regexp_extract(content, iso, 1), F.lit("")))
    return F.coalesce(inside, F.try_to_date(F.get(F.filter(cues, lambda c: c.rlike(f"^{iso}$")), 0)))


def person_of(cues: Column) -> Column:
    """The first cue that is no date and no session."""
    return F.get(F.filter(cues, lambda c: ~c.rlike(r"^\d{4}-\d{2}-\d{2}$|session\d+|^date:|^sid:")), 0)


def session_of(cues: Column) -> Column:
    return F.regexp_extract(F.concat_ws(" ", cues), r"session(\d+)", 1)


def latest_date(content: Column) -> Column:
    """The latest date that a record names, in digits or Chinese numerals; a month and day without a year take the last
    year that stands before. Null where there is none."""
    spelled = r"(\d{4})年([一二三四五六七八九十零两]+)月([一二三四五六七八九十零两]+)日"
    zip3 = lambda pattern: F.arrays_zip(*(F.regexp_extract_all(content, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3)))
    day = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")))
    digits = F.transform(zip3(r"(\d{4})[年-](\d{1,2})[月-](\d{1,2})"), lambda g: day(g["g1"], g["g2"], g["g3"]))
    words = F.transform(zip3(spelled), lambda g: day(g["g1"], text.zh_number(g["g2"]), text.zh_number(g["g3"])))
    full = F.filter(F.concat(digits, words), lambda d: d.isNotNull())
    year = F.year(F.element_at(full, -1))
    bare = r"(?<!年)(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    zip2 = F.arrays_zip(*(F.regexp_extract_all(content, F.lit(bare), F.lit(k)).alias(f"g{k}") for k in (1, 2)))
    short = F.filter(F.transform(zip2, lambda g: day(year, g["g1"], g["g2"])), lambda d: d.isNotNull())
    return F.when(F.size(full) > 0, F.array_max(F.concat(full, short)))
