"""Anchors of time and of value: questions about the last, next or first time, a given day, a price or opening hours get
the record that carries the answer.

Records come through the index of terms, so a question meets the records that share a word with it. Dates are numbers
(year * 10000 + month * 100 + day): what a text names need not exist in the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators.anchors import COMMON, FUTURE, PAST
from palimpsest.sources import shared

# What questions and records say, as results depend on them.
FIRST = "第一次|首次|头一回"
NOTICE = "预约|通知|提醒|改到|调时间|约了|收到|说|协议|要求|请假"
DAY_ASKED = "(\\d{1,2})\\s*月\\s*(\\d{1,2})\\s*日"
YEAR_ASKED = "(\\d{4})\\s*年"
NOISE = "是了的吗呢吧啊呀和与及或在有就都还也很这那什么哪一天上下次第几多少怎么如何何时几号点分"
TOPIC_STRIP = (
    "(上次|上一次|最近|最新|刚才|最后一次|前一次|下次|下一次|接下来)"
    "|(是什么时候|是哪一天|是什么时间|什么时候|考了多少分|面了什么内容|结果如何|怎么样|推荐了什么|要准备什么|要带什么|是多少|是什么|多少分|多少钱|出了什么问题|什么问题|怎么解决|怎么办|怎么回事)"
)
STEMS = {
    "修": ("修", "维修", "检修", "检测"),
    "补": ("补", "补发", "补胎", "补牙"),
    "打": ("打", "打气", "打针"),
    "交": ("交", "缴费", "交房", "交付"),
    "买": ("买", "购买", "买入"),
    "续": ("续", "续费"),
    "复": ("复", "复查", "复诊"),
    "查": ("查", "检查", "复查", "查房"),
    "检": ("检", "检查", "检测", "体检"),
    "看": ("看", "查看", "看房"),
    "办": ("办", "办理"),
    "发": ("发", "发布", "发放"),
    "报": ("报", "报名", "报到", "报销"),
    "学": ("学", "学习", "上学"),
    "装": ("装", "安装", "加装"),
    "退": ("退", "退款", "退货", "退换"),
    "换": ("换", "更换", "换新", "换货"),
}
ACTIONS = (
    ("复习", "备考"),
    ("复查", "复诊"),
    ("维修", "检测"),
    ("选品", "上新"),
    ("采摘", "摘", "收获", "收"),
    ("看电影", "观影", "看", "点映"),
    ("保洁", "清洁", "除螨", "擦玻璃", "大扫除", "深度保洁", "家政"),
    ("陪诊", "看门诊", "门诊", "取药", "取报告", "复查", "复诊", "检查", "手术"),
    ("上课", "复课", "补课", "公开课", "课程", "训练", "训练课", "集训", "训导"),
    ("维修", "修理", "检修", "疏通", "维护", "保养", "换修", "修复"),
)
OPPOSITES = (("主观题", "客观题"), ("爬山", "夜爬"), ("复诊", "复查"), ("模考", "考试"), ("模考", "通过"), ("模考", "出分"), ("模考", "成绩"))
GENERIC = ("多少", "分别", "是", "什么", "哪些", "怎么", "如何", "一个", "那个", "这个", "还有")
MONEY_ASKED = "多少钱|价格|费用|价钱|多少元|几块|票价"
MONEY = "\\d+(?:\\.\\d+)?\\s*(?:元|块|万)"
PRICE = "价格|售价|成交价|费用|花了|花费|买成|入手价|报价|标价|收费"
HOURS_ASKED, HOURS = "几点|营业时间|开门|关门", "营业|开门|关门|点到"
VALUE_ASKED = "几点|几点到几点|什么时间|什么时候|几号|多少|哪几天|多少钱|多久|几点开始|几点结束|几餐|几套|几件|几节|几杯|几盒|几斤|几个人|几小时"
TIME_ASKED = "几点|什么时间|几点到几点"
QUANTITY = "(\\d+(?:\\.\\d+)?)\\s*(元|块|天|件|平米|平|%|期|mg|克|kg|万|餐|套|节|杯|盒|斤|人|小时)"
SPELLED = "([一二两三四五六七八九十]+)\\s*(餐|套|节|杯|盒|斤|人|小时|天)"
CLOCK = "\\d{1,2}:\\d{2}"
RANGE = "\\d{1,2}:\\d{2}\\s*[-—~至到]\\s*\\d{1,2}:\\d{2}|(?:早|上午|下午|晚|晚上)?\\s*\\d{1,2}\\s*点(?:\\d{1,2}\\s*分)?\\s*[-—~至到]\\s*(?:早|上午|下午|晚|晚上)?\\s*\\d{1,2}\\s*点"

_CJK = "[\\u4e00-\\u9fff]"
_NONE = "array<string>"


def _words(values) -> Column:
    return F.array(*map(F.lit, values)).cast(_NONE)


def _any_in(words: Column, where: Column) -> Column:
    """Whether a text holds one of an array's words."""
    return F.exists(words, lambda w: F.contains(where, w))


def dates(content: Column) -> tuple[Column, Column]:
    """The full dates of a text, and those together with days without a year, which take the last full date's year."""

    def groups(pattern: str, n: int) -> Column:
        return F.arrays_zip(*(F.regexp_extract_all(content, F.lit(pattern), F.lit(k + 1)).alias(f"g{k}") for k in range(n)))

    whole = "(\\d{4})(?:年|-)(\\d{1,2})(?:月|-)(\\d{1,2})"
    number = lambda y, m, d: y.cast("int") * 10000 + m.cast("int") * 100 + d.cast("int")
    full = F.transform(groups(whole, 3), lambda g: number(g["g0"], g["g1"], g["g2"]))
    year = F.floor(F.element_at(full, -1) / 10000)
    bare = F.transform(groups("(?<![年0-9])(\\d{1,2})\\s*月\\s*(\\d{1,2})\\s*日", 2), lambda g: number(year, g["g0"], g["g1"]))
    return full, F.when(F.size(full) > 0, F.concat(full, bare)).otherwise(full)


def quantities(content: Column) -> Column:
    """What a text counts or measures: value, unit."""
    zipped = lambda pattern: F.arrays_zip(*(F.regexp_extract_all(content, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in (1, 2)))
    digits = F.transform(zipped(QUANTITY), lambda g: F.struct(g["g1"].cast("double").alias("value"), g["g2"].alias("unit")))
    spelled = F.transform(zipped(SPELLED), lambda g: F.struct(text.zh_number(g["g1"]).cast("double").alias("value"), g["g2"].alias("unit")))
    return F.concat(digits, spelled)


def time_range(content: Column) -> Column:
    """The first range of hours, as it stands there."""
    return F.nullif(F.regexp_extract(content, RANGE, 0), F.lit(""))


def asked(queries: DataFrame) -> DataFrame:
    """query_id, query, and what the question asks for: terms, further terms to look records up with, and markers."""
    # Tokens are written first: what follows refers to them often, and the plan would hold their expression each time.
    queries = shared.written(queries.select("query_id", "query", F.array_distinct(text.tokenize(F.col("query"), cjk=True)).alias("__tokens")), "queries")
    q, tokens = F.col("query"), F.col("__tokens")
    concept = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*GENERIC))
    particles = F.array_distinct(F.regexp_extract_all(q, F.lit(f"{_CJK}(?:的|了|着|过)"), F.lit(0)))
    terms = F.array_distinct(F.concat(concept, F.when(F.size(particles) > 0, text.expand_zh_synonyms(particles)).otherwise(F.array().cast(_NONE))))
    stems = F.filter(F.array_distinct(F.regexp_extract_all(q, F.lit(f"({_CJK})(?:的|了|着|过)"), F.lit(1))), lambda s: s.isin(*STEMS))
    table = F.create_map(*(x for k, v in STEMS.items() for x in (F.lit(k), _words(v))))
    stem_words = F.array_distinct(F.flatten(F.transform(stems, lambda s: table[s])))
    actions = F.array_distinct(F.concat(*(F.when(_any_in(_words(g), q), _words(g)).otherwise(F.array().cast(_NONE)) for g in ACTIONS)))
    banned = F.array_distinct(F.concat(*(F.when(q.contains(b), _words([a])).otherwise(F.array().cast(_NONE)) for pair in OPPOSITES for a, b in (pair, pair[::-1]))))
    finals = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(q, F.lit(f"(?={_CJK}({_CJK}))"), F.lit(1)), lambda c: c), lambda c: ~F.contains(F.lit(NOISE), c)))
    topic = F.regexp_replace(F.regexp_replace(q, TOPIC_STRIP, ""), f"[{NOISE}年月日0-9\\s，。？：:、（）()]", "")
    past, future = F.regexp_instr(q, F.lit(PAST)), F.regexp_instr(q, F.lit(FUTURE))
    rows = queries.select(
        "query_id", "query", terms.alias("terms"), stem_words.alias("stems"), actions.alias("actions"), banned.alias("banned"), finals.alias("finals"),
        F.size(F.regexp_extract_all(topic, F.lit(_CJK), F.lit(0))).alias("topic"), q.rlike(NOTICE).alias("of_notice"), q.rlike(HOURS_ASKED).alias("of_hours"), q.rlike(MONEY_ASKED).alias("of_money"),
        q.rlike(FIRST).alias("first"), ((past > 0) & ((future == 0) | (past <= future))).alias("past"), ((past > 0) | (future > 0)).alias("directed"),
        F.nullif(F.regexp_extract(q, DAY_ASKED, 1), F.lit("")).cast("int").alias("month"), F.nullif(F.regexp_extract(q, DAY_ASKED, 2), F.lit("")).cast("int").alias("day"),
        F.nullif(F.regexp_extract(q, YEAR_ASKED, 1), F.lit("")).cast("int").alias("year"), q.rlike(VALUE_ASKED).alias("of_value"), q.rlike(TIME_ASKED).alias("of_time"),
    )
    rows = shared.written(rows, "asked")
    more = F.when(text.has_cjk(F.col("query")), text.expand_zh_synonyms(F.col("terms"))).otherwise(F.col("terms"))
    return rows.withColumn("lookup", F.array_distinct(F.concat("terms", "finals", "stems", "actions", more)))


def relevant(where: Column, tokens: Column) -> Column:
    """Whether a record is about what is asked: a shared word, a word for the same action, or, for short topics, a shared
    last character of a word; never where it holds the opposite."""
    short = (F.col("topic") < 3) & F.exists("finals", lambda c: F.regexp_like(where, F.concat(F.lit(_CJK), c)))
    return ~_any_in(F.col("banned"), where) & (F.arrays_overlap("terms", tokens) | _any_in(F.col("actions"), where) | _any_in(F.col("stems"), where) | short)


def records(mem: DataFrame) -> DataFrame:
    """What anchors need of a memory; computed once for those that questions reach."""
    whole = F.concat(F.col("content"), F.lit(" "), F.array_join("cues", " "))
    full, every = dates(whole)
    return mem.select("id", "content", whole.alias("whole"), full.alias("full"), every.alias("dates"), F.array_distinct(text.tokenize(F.col("content"), cjk=True)).alias("tokens"), F.array_distinct(text.tokenize(whole, cjk=True)).alias("all_tokens"), whole.rlike(NOTICE).alias("notice"))


def met(ask: DataFrame, items: DataFrame, lookup: str = "lookup", common: int = COMMON) -> DataFrame:
    """query_id, id of the memories that share a term with a question (items: id, terms). Terms that more than `common`
    memories have pick no particular record and are left out."""
    wanted = ask.select("query_id", F.explode(lookup).alias("term"))
    named = items.select(F.explode("terms").alias("term"), "id").join(F.broadcast(wanted.select("term").distinct()) if ask.count() <= 1000 else wanted.select("term").distinct(), "term", "left_semi")
    named = shared.written(named, "named")
    rare = named.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") <= common)
    return named.join(rare, "term").join(wanted, "term").select("query_id", "id").distinct()


def appended(found: DataFrame, best: DataFrame, top_k: int) -> DataFrame:
    """found with one more row for each query of best (query_id, id, score, anchor): it scores just above the best so far;
    ranks follow, and top_k rows stay. A record that is there already moves."""
    rows = found.join(best.select("query_id", F.col("id").alias("__id")), "query_id", "left").where("__id is null or id <> __id").drop("__id")
    rows = rows.select("query_id", "id", "score", F.col("rank").alias("__old"), F.lit(None).cast("string").alias("anchor"))
    top = found.groupBy("query_id").agg(F.max("score").alias("__top"))
    new = best.join(top, "query_id").select("query_id", "id", F.greatest("score", F.col("__top") + 0.01).alias("score"), F.lit(1 << 20).alias("__old"), "anchor")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "__old", "id")
    return rows.unionByName(new).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", F.round("score", 6).alias("score"), "anchor")


def temporal_anchor(queries: DataFrame, found: DataFrame, mem: DataFrame, items: DataFrame, today: int, top_k: int = 4, common: int = COMMON) -> DataFrame:
    """query_id, rank, id, score, anchor of the questions about time among `queries` that have results (found: query_id,
    rank, id, score).

    A day that is named ("7月2日") takes the record that holds it. Otherwise the record of the latest day up to today, the
    earliest after it, or the first of all joins the results: notices of an event count less than the event, records must
    be about the topic, and about opening hours or an amount where those are asked for. Where a result is as good already,
    it moves to the front instead. Results that are only notices, opposites of the topic or past where the future is asked
    for go, unless nothing else is left."""
    ask = shared.written(asked(queries).where("directed or month is not null").where(F.size("terms") > 0).join(found.select("query_id").distinct(), "query_id", "left_semi"), "asked")
    pairs = met(ask, items, common=common)
    held = found.join(ask.select("query_id"), "query_id", "left_semi").select("query_id", "id", "rank", "score")
    both = pairs.join(held.select("query_id", "id"), ["query_id", "id"], "full").distinct()
    facts = shared.written(records(mem.join(both.select("id").distinct(), "id", "left_semi")), "facts")
    late = F.lit(today)

    def sides(pool: Column) -> Column:
        return F.when(F.col("past"), F.filter(pool, lambda d: d <= late)).otherwise(F.filter(pool, lambda d: d > late))

    def extreme(side: Column) -> Column:
        return F.when(F.col("past") & ~F.col("first"), F.array_max(side)).otherwise(F.array_min(side))

    event = F.array_except("dates", "full")
    moved = ~F.col("past") & F.col("notice") & (F.size(event) > 0)
    only_notice = F.col("past") & ~F.col("of_notice") & F.col("notice") & ~_any_in(F.col("stems"), F.col("whole"))
    about = relevant(F.col("content"), F.col("tokens"))
    asks = (~F.col("of_money") | F.col("content").rlike(MONEY)) & (~F.col("of_hours") | F.col("content").rlike(HOURS))
    new = pairs.join(held.select("query_id", "id"), ["query_id", "id"], "left_anti").join(ask, "query_id").join(facts, "id")

    # A named day.
    named = F.concat(F.coalesce(F.concat(F.col("year").cast("string"), F.lit("年")), F.lit("")), F.col("month").cast("string"), F.lit("月"), F.col("day").cast("string"), F.lit("日"))
    on_day = new.where("month is not null").where(F.contains(F.regexp_replace("whole", "\\s+", ""), named) & relevant(F.col("whole"), F.col("all_tokens")))
    on_day = on_day.groupBy("query_id").agg(F.min("id").alias("id")).withColumns({"score": F.lit(0.62), "anchor": F.lit("day")})

    # A direction.
    side = sides(F.when(moved, event).otherwise(F.col("dates")))
    rows = new.where("month is null").withColumn("side", side).where(F.size("side") > 0).where(~only_notice & about & asks).withColumn("target", extreme(F.col("side")))
    own = F.when(F.col("past"), extreme(F.col("full"))).otherwise(F.array_min("full"))
    strong = (F.size(sides(F.col("full"))) > 0) & (F.col("target") == own)
    order = [F.when(F.col("past") & ~F.col("first"), -F.col("target")).otherwise(F.col("target")), F.when(strong, 0).otherwise(1), F.col("id")]
    best = rows.groupBy("query_id").agg(F.min(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), "target", "all_tokens")).alias("b"))
    best = shared.written(best.select("query_id", F.col("b.o2").alias("best"), F.col("b.target").alias("target"), F.when(F.col("b.o1") == 0, 0.62).otherwise(0.60).alias("weight"), F.col("b.all_tokens").alias("best_tokens")), "best")

    # What the results hold already.
    there = held.join(ask, "query_id").join(facts, "id").join(best, "query_id")
    per = Window.partitionBy("query_id")

    def unless_all(df: DataFrame, bad: Column) -> DataFrame:
        marked = df.withColumn("__bad", F.coalesce(bad, F.lit(False)))
        return marked.withColumn("__some", F.max(~F.col("__bad")).over(per)).where("not __bad or not __some").drop("__bad", "__some")

    quiet = F.col("past") & ~F.col("of_notice") & F.col("notice") & ~_any_in(F.col("stems"), F.col("content"))
    there = unless_all(unless_all(there, quiet), _any_in(F.col("banned"), F.col("content")))
    there = unless_all(there, ~F.col("past") & (F.size("dates") > 0) & ~F.exists("dates", lambda d: d > late))
    pool = F.when(moved, event).when(F.col("past"), F.col("full")).otherwise(F.col("dates"))
    same_event = F.col("first") | (F.size(F.array_intersect(F.array_intersect("all_tokens", "terms"), "best_tokens")) > 0)
    seen = extreme(sides(pool))
    as_good = F.when(F.col("past") & ~F.col("first"), seen >= F.col("target")).otherwise(seen <= F.col("target"))
    covers = (F.size("dates") > 0) & ~only_notice & about & relevant(F.col("whole"), F.col("all_tokens")) & (~F.col("of_money") | F.col("content").rlike(MONEY)) & (~F.col("of_hours") | F.col("whole").rlike(HOURS)) & same_event & as_good
    there = there.withColumn("covers", F.coalesce(covers, F.lit(False)))
    there = there.withColumn("front", F.min(F.when(F.col("covers"), F.col("rank"))).over(per))
    there = shared.written(there.select("query_id", "id", "rank", "score", "front"), "there")

    kept = there.where("front is not null").withColumn("anchor", F.when(F.col("rank") == F.col("front"), "kept"))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("rank") == F.col("front"), 0).otherwise(1), "rank")
    kept = kept.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "id", F.round("score", 6).alias("score"), "anchor")
    open_rows = there.where("front is null").select("query_id", "rank", "id", "score")
    way = F.when(F.col("first"), "first").when(F.col("past"), "last").otherwise("next")
    joins = best.join(open_rows.select("query_id").distinct(), "query_id", "left_semi").join(ask.select("query_id", way.alias("anchor")), "query_id").select("query_id", F.col("best").alias("id"), F.col("weight").alias("score"), "anchor")
    on = held.join(on_day.select("query_id"), "query_id", "left_semi")
    told = appended(on, on_day, top_k).unionByName(appended(open_rows, joins, top_k)).unionByName(kept)
    rest = held.join(told.select("query_id").distinct(), "query_id", "left_anti")
    return told.unionByName(rest.select("query_id", "rank", "id", F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("anchor")))


def temporal_hint(query: Column) -> Column:
    """Which way to choose among dated records: first, latest, next or day; null where a question asks for none."""
    return F.when(query.rlike(FIRST), "first").when(query.rlike(PAST), "latest").when(query.rlike(FUTURE), "next").when(query.rlike(DAY_ASKED), "day")


def value_anchor(queries: DataFrame, found: DataFrame, mem: DataFrame, items: DataFrame, top_k: int = 4, common: int = COMMON) -> DataFrame:
    """query_id, rank, id, score, anchor of the questions about a value among `queries` that have results.

    For a price, records with an amount that share a word: those with most shared words first, then those that name a price
    or hold the amount near a shared word, then the latest dated. For other values, records that hold a quantity, a day or
    hours and share two words: for questions about hours, ranges of hours first. A record that leads the results already
    is passed over; one below moves up only for a price."""
    ask = shared.written(asked(queries).where("of_value").where(F.size("terms") > 0).join(found.select("query_id").distinct(), "query_id", "left_semi"), "asked")
    ask = ask.withColumn("terms", F.when(text.has_cjk(F.col("query")), text.expand_zh_synonyms(F.col("terms"))).otherwise(F.col("terms")))
    held = found.join(ask.select("query_id"), "query_id", "left_semi").select("query_id", "id", "rank", "score")
    pairs = met(ask, items, "terms", common)
    facts = records(mem.join(pairs.select("id").distinct(), "id", "left_semi"))
    rows = pairs.join(ask, "query_id").join(facts, "id").join(held.select("query_id", "id", F.col("rank").alias("was")), ["query_id", "id"], "left")
    content = F.col("content")
    amount = F.regexp_instr(content, F.lit(MONEY))
    valued = content.rlike(f"{CLOCK}|\\d+\\s*月\\s*\\d+\\s*日") | (F.size(quantities(content)) > 0)
    hits = F.size(F.array_intersect("terms", "all_tokens"))
    money = F.col("of_money")
    rows = rows.withColumn("hits", hits).where(valued & F.when(money, (amount > 0) & (F.col("hits") >= 1)).otherwise(F.col("was").isNull() & (F.col("hits") >= 2)))
    near = F.exists("terms", lambda t: F.contains(content, t) & (F.abs(F.instr(content, t) - amount) <= 15))
    priced = content.rlike(PRICE) | near
    weight = F.when(money, F.when(priced, 0.63).otherwise(0.62)).when(F.col("of_time") & content.rlike(RANGE), 0.62).otherwise(0.60)
    latest = F.coalesce(F.array_max(dates(content)[1]), F.lit(0))
    zero = F.lit(0)
    order = [F.when(money, -F.col("hits")).otherwise(zero), F.when(money, F.when(priced, 0).otherwise(1)).otherwise(zero), F.when(money, -latest).otherwise(zero), -weight, F.col("id")]
    best = rows.where("was is null or was > 1").groupBy("query_id").agg(F.min(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias("b"))
    best = best.select("query_id", F.col("b.o4").alias("id"), (-F.col("b.o3")).alias("score"), F.lit("value").alias("anchor"))
    best = shared.written(best, "best")
    told = appended(held.join(best.select("query_id"), "query_id", "left_semi"), best, top_k)
    rest = held.join(best.select("query_id"), "query_id", "left_anti").select("query_id", "rank", "id", F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("anchor"))
    return told.unionByName(rest)
