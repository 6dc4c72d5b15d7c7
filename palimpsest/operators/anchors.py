"""Anchors: for questions that ask for one kind of record, the best such record joins the results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text, when

# Questions about the last and about the next time.
PAST = "上次|上一次|最近|最新|刚才|最后一次|前一次|现在|目前|当前|第一次|首次|头一回|结果|成绩|考了多少分|评分结果|考核结果|什么时候[^？?]{0,6}(?:的|了)"
FUTURE = "下次|下一次|接下来|什么时候(?:续费|到期|上门|开工|交房|开始|结束|还款|复诊|面试|入职|复查)"
#: Term lists of more memories than this are too general to look for records in.
COMMON = 5000


@dataclass(frozen=True)
class Anchor:
    """Which queries ask for the record, what a record looks like, its score, and how many may join."""

    name: str
    question: str
    record: str
    score: float = 0.60
    most: int = 1


# Patterns of questions and records, as results depend on them.
ANCHORS = (
    Anchor("entity", "航班号|票号|保单号|订单号|编号|号码|房间号|账号|卡号|单号|证号", "(航班|保单|票号|订单号|编号|房间号|账号|卡号|单号|证号|票)[\\s:：\\-]*([A-Za-z]{1,8}[-]?\\d{2,}|\\d{3,})"),
    Anchor("money", "多少钱|价格|费用|价钱|多少元|几块|票价", "\\d+(?:\\.\\d+)?\\s*(?:元|块|万)"),
    Anchor("contact", "电话|号码|联系方式", "(?:\\d{3,4}-){1,2}\\d{3,4}|\\d{3,4}-\\d{7,8}|400-\\d{3}-\\d{4}"),
    Anchor("hours", "几点|营业时间|开门|关门", "营业|开门|关门|点到"),
    Anchor("problem", "什么问题|什么病|什么毛病|怎么了|什么情况|怎么解决|怎么处理|怎么办|怎么救|怎么治", "有虫|坏了|故障|失灵|破损|变形|闪烁|告警|鼓包|不制冷|磨脚|偏大|漏|丢失|褪色|松动|异响|碎了|压坏|空鼓|结膜炎|发炎|感染|过敏|瘦了|信号差|信号问题|化水|烂根|黄叶|枯萎|生虫|抢救|控水"),
    Anchor("purchase", "买了什么|买了哪些|买过什么|买了什么设备|买了什么装备|放了哪些|放了什么|存放了哪些|存放了些什么|存了什么|装了哪些|收纳了哪些|放了什么物品|存了哪些", "买|购买|购入|入手|添置|存放|放入|存了|装了|收纳|放进|搁置", most=2),
    Anchor("scope", "收哪些|收什么|可以收什么|有哪些|包含哪些|包括哪些|有哪几类|分几类|什么书|哪些种类|哪些项目|哪些内容|哪些服务|哪些业务|提供哪些|卖哪些", "范围|包括|包含|均可|不收|种类|分类|清单|项目|内容|车型|型号|类型|科室|部门|设施"),
)


def anchored(queries: DataFrame, found: DataFrame, mem: DataFrame, anchors: tuple[Anchor, ...] = ANCHORS, cjk: bool = True, items: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, anchor: records to insert, above the best score so far. A query that already has a record of
    the kind gets none; records share a word with the query, the more the better, then the newest. items (id, terms) stand
    for the memories' words where they are given."""
    asked = queries.select("query_id", "query", F.array_distinct(text.tokenize(F.col("query"), cjk=cjk)).alias("qt"))
    if items is None:
        words = mem.select("id", "seq", "content", F.array_distinct(text.tokenize(F.col("content"), cjk=cjk)).alias("words"))
    else:
        words = mem.select("id", "seq", "content").join(items.select("id", F.col("terms").alias("words")), "id")
    index = words.select(F.explode("words").alias("term"), "id")
    general = index.groupBy("term").count().where(F.col("count") > COMMON).select("term")
    out = None
    best = found.groupBy("query_id").agg(F.max("score").alias("top"))
    for a in anchors:
        asking = asked.where(F.col("query").rlike(a.question))
        records = words.where(F.col("content").rlike(a.record))
        has = found.join(records.select("id"), "id", "left_semi").select("query_id").distinct()
        terms = asking.join(has, "query_id", "left_anti").select("query_id", F.explode("qt").alias("term")).join(general, "term", "left_anti")
        hits = index.join(records.select("id", "seq"), "id").join(terms, "term").groupBy("query_id", "id", "seq").agg(F.count("*").alias("hits"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("seq")))
        rows = hits.withColumn("k", rank).where(F.col("k") <= a.most).join(best, "query_id", "left")
        rows = rows.select("query_id", "id", F.round(F.greatest(F.lit(a.score), F.coalesce("top", F.lit(0.0)) + 0.01), 6).alias("score"), F.lit(a.name).alias("anchor"))
        out = rows if out is None else out.unionByName(rows)
    return out


def dated(queries: DataFrame, mem: DataFrame) -> DataFrame:
    """query_id, id: memories whose `date:` cue has the day, year or month that the query names, or lies on the side of a
    date that it names."""
    asked = queries.select("query_id", *(c.alias(f"q_{n}") for n, c in when.asked_time(F.col("query")).items()))
    days = mem.select("id", when.cue_date(F.col("cues")).alias("day")).where("day is not null")
    exact = F.col("q_day").isNotNull() | F.col("q_after").isNotNull() | F.col("q_before").isNotNull()
    inside = (F.col("q_after").isNull() | (F.col("day") >= F.col("q_after"))) & (F.col("q_before").isNull() | (F.col("day") <= F.col("q_before")))
    # Years and months by hash joins; sides of a date by a range that Spark joins with the short list of queries.
    ranged = days.join(F.broadcast(asked.where(exact)), inside).select("query_id", "id") if queries.count() <= 4096 else asked.where(exact).join(days, inside).select("query_id", "id")
    loose = asked.where(~exact)
    by_year = loose.where("q_year is not null").join(days, F.col("q_year") == F.year("day")).select("query_id", "id")
    by_month = loose.where("q_month is not null").join(days, F.col("q_month") == F.month("day")).select("query_id", "id")
    return ranged.unionByName(by_year).unionByName(by_month).distinct()


def latest_of(queries: DataFrame, mem: DataFrame, items: DataFrame, today: Column, most: int = 1) -> DataFrame:
    """query_id, id, day: for questions about the last or the next time, the records that share most words with the query,
    of the latest date up to today, or the earliest after it."""
    past = F.col("query").rlike(PAST)
    future = F.col("query").rlike(FUTURE)
    asked = queries.select("query_id", F.when(future, "next").when(past, "last").alias("side"), F.explode(F.array_distinct(text.tokenize(F.col("query"), cjk=True))).alias("term")).where("side is not null")
    hits = items.select("id", F.explode("terms").alias("term")).join(asked, "term").groupBy("query_id", "side", "id").agg(F.count("*").alias("hits")).where("hits >= 2")
    rows = hits.join(mem.select("id", "seq", when.latest_date(F.col("content")).alias("day")), "id").where("day is not null")
    rows = rows.where(((F.col("side") == "last") & (F.col("day") <= today)) | ((F.col("side") == "next") & (F.col("day") > today)))
    k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), F.when(F.col("side") == "next", F.datediff("day", F.lit("2000-01-01"))).otherwise(-F.datediff("day", F.lit("2000-01-01"))), F.desc("seq")))
    return rows.withColumn("k", k).where(F.col("k") <= most).select("query_id", "id", F.col("day").cast("string").alias("day"), "hits")
