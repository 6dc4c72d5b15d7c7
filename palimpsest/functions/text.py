"""Text functions as columns: tokens, cues, hashes, importance and mood."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L

#: Words, and compounds of words joined by hyphens. Both are taken whole, so one pass finds them and no place is tried twice.
WORD = "[a-z0-9]++(?:[-_][a-z0-9]++)*+"
CJK = "[\\u4e00-\\u9fff]"
ZH_DATE = "(\\d{4})\\s*年\\s*(\\d{1,2})\\s*月\\s*(\\d{1,2})\\s*日"
ZH_WORD_DATE = "(\\d{4})年([一二三四五六七八九十零]+)月([一二三四五六七八九十零]+)日"
ZH_MEASURE = "([一二三四五六七八九十百千万亿零两]+)(元|块|本|个|台|条|张|件|杯|瓶)"


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def normalized(content: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(content, "\\s+", " ")))


def content_hash(content: Column) -> Column:
    return F.sha2(normalized(content), 256)


def normalize_cues(cues: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(cues, normalized), lambda c: c != ""))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def zh_number(text: Column) -> Column:
    """A Chinese numeral as a number; 0 where it is none. Sections end at 万 and 亿."""
    digits = F.create_map(*(F.lit(x) for k, v in zip("零一二两三四五六七八九", (0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9)) for x in (k, v)))
    units = F.create_map(*(F.lit(x) for k, v in zip("十百千万亿", (10, 100, 1000, 10_000, 100_000_000)) for x in (k, v)))
    start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("ok"))

    def step(a: Column, c: Column) -> Column:
        d, u = digits[c].cast("long"), units[c].cast("long")
        big, small = (a["s"] + a["n"]) * u, a["s"] + F.when(a["n"] == 0, F.lit(1)).otherwise(a["n"]) * u
        zero = F.lit(0).cast("long")
        return (
            F.when(d.isNotNull(), F.struct(a["t"].alias("t"), a["s"].alias("s"), d.alias("n"), a["ok"].alias("ok")))
            .when(u.isNull(), F.struct(a["t"].alias("t"), a["s"].alias("s"), a["n"].alias("n"), F.lit(False).alias("ok")))
            .when(u >= 10_000, F.struct((a["t"] + big).alias("t"), zero.alias("s"), zero.alias("n"), a["ok"].alias("ok")))
            .otherwise(F.struct(a["t"].alias("t"), small.alias("s"), zero.alias("n"), a["ok"].alias("ok")))
        )

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda a: F.when(a["ok"], a["t"] + a["s"] + a["n"]).otherwise(0))


def _groups(text: Column, pattern: str, n: int) -> Column:
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)) for k in range(n)]
    return F.arrays_zip(*(p.alias(f"g{k}") for k, p in enumerate(parts)))


def _latin(low: Column) -> Column:
    """Compounds, then words, as two arrays. The text is searched once: the lambda names what both are taken from."""
    joined = lambda t: F.contains(t, F.lit("-")) | F.contains(t, F.lit("_"))
    whole = lambda w: F.filter(w, lambda t: joined(t) & ~t.isin(*L.STOPWORDS))
    words = lambda w: F.filter(w, lambda t: (F.length(t) > 1) & ~joined(t) & ~t.isin(*L.STOPWORDS))
    return F.get(F.transform(F.array(F.regexp_extract_all(low, F.lit(WORD), F.lit(0))), lambda w: F.struct(whole(w).alias("whole"), words(w).alias("words"))), F.lit(0))


def tokenize(text: Column, cjk: bool = False) -> Column:
    """Tokens in order, with repeats: compounds, then words that are no stop words. With `cjk`, for stores that hold
    Chinese, also dates, measures, characters and pairs of them; that expression is large, so it is asked for."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if not cjk:
        return F.get(F.transform(F.array(_latin(low)), lambda x: F.concat(x["whole"], x["words"])), F.lit(0))
    whole, words = (_latin(low)[n] for n in ("whole", "words"))
    date = lambda y, m, d: F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    spelled = F.filter(
        F.transform(_groups(low, ZH_WORD_DATE, 3), lambda g: F.struct(g["g0"].cast("int").alias("y"), zh_number(g["g1"]).alias("m"), zh_number(g["g2"]).alias("d"))),
        lambda g: g["m"].between(1, 12) & g["d"].between(1, 31),
    )
    spelled = F.transform(spelled, lambda g: date(g["y"], g["m"], g["d"]))
    dates = F.transform(_groups(low, ZH_DATE, 3), lambda g: date(g["g0"], g["g1"], g["g2"]))
    bare = F.regexp_replace(F.regexp_replace(low, ZH_WORD_DATE, "$1年 "), ZH_DATE, " ")
    measures = F.filter(F.transform(_groups(bare, ZH_MEASURE, 2), lambda g: F.struct(zh_number(g["g0"]).alias("n"), g["g1"].alias("u"))), lambda g: g["n"] != 0)
    measures = F.transform(measures, lambda g: F.concat(g["n"].cast("string"), g["u"]))
    chars = F.regexp_extract_all(bare, F.lit(CJK), F.lit(0))
    stop = _strings(list(dict.fromkeys(L.CJK_STOP)))
    solo = F.filter(chars, lambda c: ~F.array_contains(stop, c))
    pairs = F.when(
        F.size(chars) > 1,
        F.transform(
            F.filter(F.arrays_zip(F.slice(chars, F.lit(1), F.size(chars) - 1).alias("a"), F.slice(chars, F.lit(2), F.size(chars) - 1).alias("b")), lambda p: ~F.array_contains(stop, p["a"]) & ~F.array_contains(stop, p["b"])),
            lambda p: F.concat(p["a"], p["b"]),
        ),
    ).otherwise(F.array().cast("array<string>"))
    bare_words = _latin(bare)["words"]
    cjk = F.concat(whole, spelled, dates, measures, bare_words, solo, pairs)
    return F.when(has_cjk(low), cjk).otherwise(F.concat(whole, words))


def extract_cues(tokens: Column, limit: int = 6) -> Column:
    good = F.filter(tokens, lambda t: ~t.isin(*L.STOPWORDS) & (F.length(t) >= 2) & ~(t.rlike("^[a-z0-9]+$") & (F.length(t) < 4)))
    return F.slice(F.array_distinct(good), 1, limit)


def expand_synonyms(terms: Column) -> Column:
    """The terms, their synonyms, and the parts of compounds, each once."""
    table = F.create_map(*(x for k, v in L.SYNONYMS.items() for x in (F.lit(k), _strings(v))))
    empty = F.array().cast("array<string>")
    stop = _strings(L.STOPWORDS)
    parts = lambda t: F.filter(F.split(t, "[-_]"), lambda p: (F.length(p) > 1) & ~p.rlike("^[0-9]+$") & ~F.array_contains(stop, p))
    more = F.transform(terms, lambda t: F.concat(F.coalesce(table[t], empty), F.when(t.rlike("[-_]"), parts(t)).otherwise(empty)))
    return F.array_distinct(F.concat(terms, F.flatten(more)))


def expand_zh_synonyms(terms: Column) -> Column:
    """The terms and those that stand for them in Chinese, one step far, and their words in the other language."""
    more = [(w, tuple(x for x in group if x != w)) for group in L.ZH_SYNONYMS for w in group] + [(a, (b,)) for a, b in L.ZH_ENGLISH] + [(b, (a,)) for a, b in L.ZH_ENGLISH]
    table: dict[str, tuple[str, ...]] = {}
    for word, others in more:
        table[word] = tuple(dict.fromkeys(table.get(word, ()) + others))
    known = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), _strings(v))))
    return F.array_distinct(F.concat(terms, F.flatten(F.transform(terms, lambda t: F.coalesce(known[t], F.array().cast("array<string>"))))))


def place_of(content: Column) -> Column:
    """Where something happened: the two to six Chinese letters after 在, 去 or 到, null where they name no place."""
    two = F.regexp_extract(content, "(?:在|去|到)([\\u4e00-\\u9fff]{2}[室馆店站楼场院厅]?)", 1)
    return F.when((two != "") & ~two.isin(*L.NO_PLACE), two)


def rewritten(query: Column, terms: Column, expanded: Column) -> Column:
    """The query with its further terms behind it, in order."""
    return F.concat_ws(" ", F.array(query), F.array_sort(F.array_except(expanded, terms)))


def question_kind(query: Column) -> Column:
    """`math`, `transitive` or `compare` for questions that need several premises, else null."""
    low = F.lower(query)
    return F.when(low.rlike(L.MATH_QUESTION), "math").when(low.rlike(L.CHAIN_QUESTION), "transitive").when(low.rlike(L.COMPARE_QUESTION), "compare")


def has_dimension(content: Column, kind: Column) -> Column:
    """Whether a memory is a premise of that kind of question: it holds a quantity, or compares."""
    quantity = content.rlike(L.QUANTITY)
    compares = contains_any(content, ("比", "最", *L.DIMENSIONS))
    return F.when(kind == "math", quantity).when(kind.isNotNull(), quantity | compares).otherwise(False)


def pack_size(query: Column) -> Column:
    """How many memories a question needs at once, 6 to 14."""
    has = query.contains
    several = F.length(query) - F.length(F.replace(query, F.lit("比"), F.lit(""))) >= 2
    return F.greatest(
        F.lit(6),
        F.when(several | has("三个人") | has("几个人") | has("三位"), 10).otherwise(6),
        F.when(has("四个人") | has("四位"), 12).otherwise(6),
        F.when(has("五个人"), 14).otherwise(6),
        F.when(has("、") | has("分别") | (has("和") & has("都")) | has("差多少") | has("单价"), 8).otherwise(6),
    )


def cue_in(cue: Column, query: Column) -> Column:
    """Whether a query names a cue: Chinese ones anywhere, words as whole words, others anywhere."""
    word = cue.rlike("^\\w+$") & ~has_cjk(cue)
    whole = F.regexp_like(F.lower(query), F.concat(F.lit("\\b"), F.lower(cue), F.lit("\\b")))
    return F.when(word, whole).otherwise(F.contains(F.lower(query), F.lower(cue)))


def inflections(token: Column) -> Column:
    """Plain forms that an English token of four letters or more may come from."""
    cut = lambda k: F.substring(token, F.lit(1), F.length(token) - k)
    none = F.array().cast("array<string>")
    made = (
        F.when(token.endswith("ies"), F.array(F.concat(cut(3), F.lit("y"))))
        .when(token.endswith("es"), F.array(cut(2), cut(1)))
        .when(token.endswith("s"), F.array(cut(1)))
        .when(token.endswith("ing"), F.array(cut(3), F.concat(cut(3), F.lit("e"))))
        .when(token.endswith("ed"), F.array(cut(2), cut(1)))
        .when(token.endswith("ly"), F.array(cut(2)))
        .otherwise(none)
    )
    return F.when(F.length(token) >= 4, made).otherwise(none)


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def importance(content: Column, trust: Column, access_count: Column) -> Column:
    low = F.lower(content)
    score = (
        0.4
        + F.when(contains_any(low, L.STRONG_WORDS), 0.25).otherwise(0.0)
        + F.when(contains_any(low, L.AFFECT_WORDS), 0.15).otherwise(0.0)
        + 0.1 * F.coalesce(trust, F.lit(0.0))
        + 0.1 * F.least(access_count / 5.0, F.lit(1.0))
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def mood(text: Column) -> Column:
    """The one mood whose words occur, else null."""
    low = F.lower(text)
    found = {m: contains_any(low, w) for m, w in L.MOODS.items()}
    n = reduce(lambda a, b: a + b, (f.cast("int") for f in found.values()))
    return F.when(n == 1, F.coalesce(*(F.when(f, F.lit(m)) for m, f in found.items())))


def overlap(hits: Column, nq: Column, ni: Column) -> Column:
    """Hits against the geometric mean of the query's and the item's term counts, the latter capped."""
    capped = F.least(ni, F.greatest(nq * 2, F.lit(8)))
    return F.when(hits > 0, hits / F.greatest(F.lit(1.0), F.sqrt(F.greatest(F.lit(1), nq) * capped))).otherwise(F.lit(0.0))
