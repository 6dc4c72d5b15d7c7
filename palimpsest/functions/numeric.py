"""Numbers in texts: quantities, checks of units, and small laws, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L

NUMBER = r"\d+(?:\.\d+)?"
UNITS = "元|米|秒|千克|个|天|小时|公里|千米|分钟|%|斤|吨|升|毫升"


def numbers(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)), lambda n: n.cast("double"))


def quantities(x: Column) -> Column:
    """Numbers with their units."""
    parts = [F.regexp_extract_all(x, F.lit(rf"({NUMBER})\s*({UNITS})"), F.lit(k)) for k in (1, 2)]
    return F.transform(F.arrays_zip(parts[0].alias("value"), parts[1].alias("unit")), lambda p: F.struct(p["value"].cast("double").alias("value"), p["unit"].alias("unit")))


def mixes_units(x: Column) -> Column:
    units = F.transform(quantities(x), lambda p: p["unit"])
    return F.array_contains(units, "米") & (F.array_contains(units, "公里") | F.array_contains(units, "千米"))


def divides_by_zero(x: Column) -> Column:
    return x.rlike(r"(?:除以|÷)\s*0(?!\d)")


def known_speed(x: Column) -> Column:
    """The speed that a memory states, null where it states none."""
    return F.nullif(F.regexp_extract(x, rf"({NUMBER})\s*(?:千米每小时|公里每小时|米每秒)", 1), F.lit("")).cast("double")


def speed_agrees(x: Column, speed: Column) -> Column:
    """Whether the distance that a problem states is within a twentieth of speed times time; null where it states none."""
    pattern = rf"({NUMBER})\s*小时(?:行驶|走|前进)({NUMBER})\s*(?:千米|公里)"
    hours, way = (F.nullif(F.regexp_extract(x, pattern, k), F.lit("")).cast("double") for k in (1, 2))
    return F.abs(speed * hours - way) / F.greatest(F.lit(1.0), way) < 0.05


def numeric_check(problem: Column, speed: Column) -> dict[str, Column]:
    """Checks of a problem, and whether it is consistent or needs another look."""
    agrees = speed_agrees(problem, speed)
    wrong = mixes_units(problem) | divides_by_zero(problem) | ~F.coalesce(agrees, F.lit(True))
    return {
        "quantities": quantities(problem),
        "mixed_units": mixes_units(problem),
        "zero_division": divides_by_zero(problem),
        "speed_agrees": agrees,
        "verdict": F.when(wrong, "review_needed").otherwise("consistent"),
    }


def types_of(x: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Types whose words occur, in the order of the table."""
    return F.array_compact(F.array(*(F.when(x.contains(w), F.lit(t)) for w, t in table)))


def math_ladder(problem: Column) -> dict[str, Column]:
    """From a problem's numbers over its symbols to whether it can be worked out."""
    kinds = types_of(problem, L.MATH_TYPES)
    symbols = F.create_map(*(F.lit(x) for pair in L.MATH_SYMBOLS.items() for x in pair))
    found = numbers(problem)
    return {
        "types": kinds,
        "numbers": found,
        "templates": F.transform(kinds, lambda t: symbols[t]),
        "verdict": F.when((F.size(found) > 0) & (F.size(kinds) > 0), "ready").otherwise("review_needed"),
    }


def simulated(scene: Column) -> dict[str, Column]:
    """A scene's types and numbers, and what follows: the seconds of a fall, or the way of an even motion."""
    kinds = types_of(scene, L.SCENE_TYPES)
    found = numbers(scene)
    head = F.get(kinds, 0)
    height = F.get(F.filter(found, lambda n: n > 0), 0)
    fall = F.round(F.sqrt(2 * height / 9.8), 2)
    way = F.get(found, 0) * F.get(found, 1)
    return {
        "types": kinds,
        "numbers": found,
        "outcome": F.when(head == "自由落体", fall).when(head.isin("匀速运动", "速度"), way),
        "verdict": F.when((F.size(found) > 0) & (F.size(kinds) > 0), "ready").otherwise("review_needed"),
    }
