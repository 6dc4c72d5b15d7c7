"""Word lists and constants of the data model."""

# Stop words, as results depend on the exact list.
STOPWORDS = (
    "the and for with from that this you your they them what when where how was were are have has had will would can could should about "
    "into over after before during because been being not but his her its our their there here then than also very just only some such "
    "a an of on in at to by as or if else while until since so which who whom whose why these those "
    "i me my we us he she it much many more most less few own same other each"
).split()

# Chinese function characters that are no keywords.
CJK_STOP = "的了是在与和或我你他她它也都有没不就都把被对从到请问说吗呢吧啊呀这那很真最更又再却曾已什怎么"

# English synonyms of query words.
SYNONYMS = {
    "spent": ("cost", "paid", "bought", "spending"),
    "money": ("cost", "amount", "price", "payment"),
    "expenses": ("cost", "costs", "spending", "bills"),
    "total": ("sum", "overall"),
    "bought": ("purchased", "got", "ordered"),
    "purchased": ("bought", "ordered", "got"),
    "price": ("cost", "amount", "fee"),
    "cost": ("price", "amount", "paid"),
    "paid": ("cost", "spent", "charged"),
    "bike": ("bicycle", "cycling"),
    "bicycle": ("bike", "cycling"),
}

# Words of an importance rule, and of moods.
STRONG_WORDS = ("重要", "记住", "务必", "必须", "永远", "关键", "核心", "最重要", "important", "remember", "critical", "essential", "always", "never", "priority", "must")
AFFECT_WORDS = ("喜欢", "讨厌", "害怕", "开心", "难过", "焦虑", "感动", "生气", "love", "hate", "afraid", "happy", "sad", "anxious", "angry")
MOODS = {
    "positive": ("开心", "高兴", "快乐", "兴奋", "满意", "喜欢", "愉快", "happy", "glad", "excited", "pleased"),
    "negative": ("难过", "悲伤", "焦虑", "紧张", "害怕", "生气", "愤怒", "担心", "sad", "anxious", "angry", "afraid", "worried"),
    "arousing": ("刺激", "惊吓", "惊喜", "惊险", "arousing", "surprising"),
}

AROUSED = ("positive", "negative", "arousing")
ORIGINS = ("user", "document", "agent", "inference", "external")
DECAY_RATE = 0.002

# Chinese words that stand for each other in queries.
ZH_SYNONYMS = (
    ("旅游", "旅行"),
    ("准备", "筹备", "安排"),
    ("买", "购买", "购置"),
    ("花", "花费"),
    ("喜欢", "喜爱"),
    ("城市", "都市"),
    ("颜色", "色彩"),
    ("食物", "美食"),
    ("运动", "锻炼", "健身"),
    ("学车", "驾校", "练车", "报名"),
    ("开通", "办理", "办"),
    ("安防", "监控", "门锁", "摄像头"),
    ("续费", "续的"),
    ("复查", "复诊"),
    ("歌手", "歌星"),
    ("搬家", "迁居"),
    ("学习", "学会"),
    ("开始", "坚持"),
    ("餐厅", "饭馆", "饭店"),
    ("酒店", "宾馆"),
    ("礼物", "礼品"),
    ("相机", "照相机"),
    ("手机", "电话"),
    ("电脑", "计算机"),
    ("背包", "书包"),
    ("唱歌", "演唱"),
    ("画画", "绘画"),
    ("跑步", "慢跑"),
    ("写字", "书写"),
    ("高兴", "开心"),
    ("美丽", "漂亮"),
    ("便宜", "廉价"),
    ("做饭", "做菜", "烹饪"),
    ("早晨", "早上"),
    ("晚上", "夜晚"),
    ("贵", "昂贵"),
)

# Chinese words and their English ones, both ways.
ZH_ENGLISH = (
    ("电池", "battery"),
    ("电瓶", "battery"),
    ("雨刮器", "wiper"),
    ("轮胎", "tire"),
    ("刹车", "brake"),
    ("机油", "oil"),
    ("无线", "wifi"),
    ("会员", "vip"),
    ("套餐", "package"),
    ("折扣", "discount"),
    ("手机", "phone"),
    ("电脑", "computer"),
    ("相机", "camera"),
)

# Words for where something happened that name no place.
NO_PLACE = ("这里", "那里", "这时", "当时", "今天", "昨天", "明天", "现在", "这", "那", "现场", "家里家外")

# Words that ask for what came after or before, and for the newest or the oldest.
AFTER_WORDS = ("after", "next", "then", "following", "followed", "subsequent", "later", "之后", "随后", "接着", "接下来", "后来", "再然后")
BEFORE_WORDS = ("before", "prior", "earlier", "previously", "preceding", "之前", "以前", "前面")
OLDEST_WORDS = ("first", "earliest", "initially", "started", "began")
NEWEST_WORDS = ("latest", "recent", "recently", "current", "currently", "now", "since", "updated", "changed", "update", "newest")
SECOND_HOP = r"(?:two|2|second)\s+(?:events?|steps?|things?|days?|times?)|(?:第二件|两件|两个|两次).{0,4}(?:事|事件|之后|後|后)"

# Patterns of questions that need several premises, and of what such a premise holds.
MATH_QUESTION = (
    r"多少|几(?:个|本|元|天|次|人|公里|岁)?|一共|总共|单价|每[本个元天公里]"
    r"|花了?\s*[\d一二三四五六七八九十百千万]+\s*(?:元|块)"
    r"|差多少|贵多少|便宜多少|多少钱|价格"
)
CHAIN_QUESTION = (
    r"(?:谁|哪个|几个人?中).{0,8}(?:最高|最矮|最贵|最便宜|最大|最小|最早|最晚|最近|最远)"
    r"|比.{1,8}(?:高|大|贵|早|晚|近|远).{0,12}比"
)
COMPARE_QUESTION = (
    r"比.{1,8}(?:高|低|大|小|早|晚|贵|便宜|多|少|快|慢|长|短|好|近|远)"
    r"|(?:更|最)(?:高|低|大|小|早|晚|贵|便宜|昂贵|廉价|多|少|快|慢|长|短|好|近|远)"
    r"|(?:谁|哪个).{0,6}(?:更|最|比较)"
    r"|(?:更|最)(?:昂贵|廉价)"
)
DIMENSIONS = ("高", "低", "大", "小", "早", "晚", "贵", "便宜", "昂贵", "廉价", "多", "少", "快", "慢", "长", "短", "好", "近", "远")
QUANTITY = r"(?:\d+(?:\.\d+)?|[一二三四五六七八九十百千万]+)\s*(?:元|块|本|个|天|次|人|公里|岁)"

# Types of arithmetic problems by the words they use, and their symbols.
MATH_TYPES = (
    ("加", "加法"), ("减", "减法"), ("乘", "乘法"), ("除", "除法"), ("每小时", "速度"), ("速度", "速度"),
    ("平均", "平均数"), ("比例", "比例"), ("概率", "概率"), ("方程", "方程"), ("百分", "百分数"),
)
MATH_SYMBOLS = {
    "加法": "a + b = c",
    "减法": "a - b = c",
    "乘法": "a × b = c",
    "除法": "a ÷ b = c",
    "速度": "速度 = 路程 ÷ 时间",
    "平均数": "平均数 = 总和 ÷ 个数",
    "比例": "a : b = c : d",
    "概率": "概率 = 有利结果 ÷ 全部结果",
    "方程": "未知数 = x，等式两边同时变化求解",
    "百分数": "百分数 = 部分 ÷ 整体 × 100%",
}

# Types of scenes by the words they use.
SCENE_TYPES = (
    ("落下", "自由落体"), ("掉落", "自由落体"), ("扔", "抛体"), ("推", "推力"), ("撞", "碰撞"), ("滑", "滑动摩擦"),
    ("滚", "滚动"), ("浮", "浮力"), ("沉", "浮力"), ("杠杆", "杠杆"), ("重力", "重力"), ("摩擦", "摩擦力"),
    ("能量", "能量守恒"), ("动量", "动量守恒"), ("加速度", "加速度"), ("匀速", "匀速运动"), ("每小时", "速度"),
)

# Verbs that a step of a plan is expected to name.
PLAN_VERBS = (
    "做", "写", "创建", "设计", "开发", "测试", "部署", "分析",
    "调研", "优化", "修复", "完成", "检查", "收集", "整理", "实现",
    "重构", "发布", "验证", "运行", "配置", "安装", "更新", "规划",
    "评估", "阅读", "发送", "记录", "确认", "制定", "拆分",
)
# Standard steps by the words a step uses, the first that fits, and their order.
STEP_TEMPLATES = {
    "需求": "调研需求",
    "设计": "设计架构",
    "架构": "设计架构",
    "开发": "开发功能",
    "功能": "开发功能",
    "实现": "开发功能",
    "测试": "测试功能",
    "部署": "部署上线",
    "上线": "部署上线",
    "文档": "写文档",
    "写": "写文档",
    "复盘": "项目复盘",
    "总结": "项目复盘",
}
STEP_ORDER = ("调研需求", "设计架构", "开发功能", "测试功能", "部署上线", "写文档", "项目复盘")
# Words that make a memory a requirement, a risk, or a lesson of one kind (the first that fits).
REQUIREMENT_WORDS = ("需求", "要求", "必须", "需要", "约束", "规格")
RISK_WORDS = ("风险", "问题", "担心", "冲突", "注意", "延期", "失败")
LESSON_WORDS = {"success": ("成功", "完成", "搞定"), "failure": ("失败", "出错", "坑", "教训"), "lesson": ("经验", "学到", "注意", "建议")}
# Goals that ask for steps, what makes a goal demanding, and verbs that a step's noun is told from.
STEP_GOALS = ("想", "要", "打算", "计划", "准备", "希望", "怎么", "如何")
GOAL_CONSTRAINTS = ("预算", "人数", "时间", "地点", "要求", "限制", "完整", "全部", "按顺序", "一共", "几天")
GOAL_REFERENCE = r"(?:参考|参照|学|模仿|按照|像)[\u4e00-\u9fff]{2}|和[\u4e00-\u9fff]{2}"
ACTION_LETTERS = "订买卖打包收拾请找定学搬选入"
# Words of relations between things.
RELATION_WORDS = ("绕", "围绕", "大于", "小于", "等于", "导致", "因为", "所以", "依赖", "推动", "阻止", "包含", "属于", "对应", "orbit", "cause", "depend", "contain", "lead")
