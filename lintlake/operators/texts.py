"""Texts by language: report labels, message pools of rules and advice, with the lookups that fall back between languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ["en-US", "zh-CN"]

LABELS = {
    "title": ("Code quality report", "代码质量报告"), "preparing": ("Reading the code ...", "正在读取代码 ..."), "report_title": ("Findings", "检测结果"),
    "found_issues": ("Issues found", "发现的问题"), "statistics": ("Statistics", "统计"), "nuclear_issues": ("critical", "严重"), "spicy_issues": ("notable", "较重"), "mild_issues": ("minor", "轻微"),
    "total": ("total", "总计"), "top_files": ("Files with the most issues", "问题最多的文件"), "detailed_analysis": ("Issues by file", "按文件的问题"), "summary": ("Summary", "总结"),
    "keep_improving": ("Small steps count.", "一步一步来。"), "clean_code": ("Nothing found.", "没有发现问题。"), "clean_code_warning": ("Keep it that way.", "请继续保持。"), "suggestions": ("Suggestions", "建议"),
    "score": ("Score", "得分"), "density": ("Issues in a thousand lines", "每千行问题数"), "files": ("Files", "文件数"), "lines": ("Lines", "行数"),
    "categories": ("Categories", "类别"), "hall_of_shame": ("Worst files", "最差文件"), "patterns": ("Most common patterns", "最常见的模式"), "advice": ("Advice", "改进意见"), "rule": ("Rule", "规则"), "legend": ("Scale, the higher the worse", "评分标准，分数越高越差"), "status": ("Status", "状态"), "depth": ("depth", "深度"),
}
#: The bands of category scores as the legend lists them.
LEGEND = [
    ("81-100", "Terrible, urgent fixes needed", "糟糕，急需修复"), ("61-80", "Poor, refactoring recommended", "较差，建议重构"), ("41-60", "Average, needs improvement", "一般，需要改进"),
    ("21-40", "Good, room for improvement", "良好，还有提升空间"), ("0-20", "Excellent, keep it up", "优秀，继续保持"),
]

#: What each rule is about, in English and Chinese.
TOPICS = {
    "terrible-naming": ("a name that says nothing", "没有信息的名字"), "single-letter-variable": ("a one-letter variable", "单字母变量"), "meaningless-naming": ("a placeholder name", "占位符名字"),
    "hungarian-notation": ("a type prefix in a name", "名字里的类型前缀"), "abbreviation-abuse": ("a needless abbreviation", "不必要的缩写"), "println-debugging": ("printing for debugging", "打印调试"),
    "panic-abuse": ("giving up by panic", "随意 panic"), "todo-comment": ("a pile of open notes", "堆积的待办"), "magic-number": ("an unexplained number", "魔法数字"), "god-function": ("a function that does everything", "包揽一切的函数"),
    "commented-code": ("code kept as comments", "被注释的代码"), "dead-code": ("a way out in the middle", "可疑的死代码"), "string-abuse": ("owned strings everywhere", "滥用 String"), "vec-abuse": ("vectors everywhere", "滥用 Vec"),
    "iterator-abuse": ("a loop that an iterator could be", "可用迭代器代替的循环"), "match-abuse": ("a match for two cases", "两个分支的 match"), "deep-nesting": ("deep nesting", "嵌套过深"), "long-function": ("a long function", "过长的函数"),
    "code-duplication": ("repeated code", "重复代码"), "unwrap-abuse": ("an unchecked unwrap", "未检查的 unwrap"), "unnecessary-clone": ("one more clone", "多余的 clone"), "complex-closure": ("a complex closure", "复杂的闭包"),
    "lifetime-abuse": ("many lifetimes", "生命周期过多"), "trait-complexity": ("a heavy trait", "过重的 trait"), "generic-abuse": ("too many generics", "泛型过多"), "channel-abuse": ("too many channels", "通道过多"),
    "async-abuse": ("too much async", "异步过多"), "dyn-trait-abuse": ("too much dynamic dispatch", "动态分发过多"), "unsafe-abuse": ("unsafe code", "不安全代码"), "ffi-abuse": ("too much foreign code", "外部接口过多"),
    "macro-abuse": ("many macro calls", "宏过多"), "module-complexity": ("modules in modules", "模块嵌套"), "pattern-matching-abuse": ("complex patterns", "复杂的模式"), "reference-abuse": ("many references", "引用过多"),
    "box-abuse": ("many boxes", "Box 过多"), "slice-abuse": ("many slices", "切片过多"), "file-too-long": ("a long file", "文件过长"), "unordered-imports": ("unordered imports", "导入未排序"),
    "duplicate-imports": ("an import twice", "重复导入"), "deep-module-nesting": ("deep module nesting", "模块嵌套过深"),
}
_FRAMES = {"en-US": ["Here is {}", "This looks like {}", "Worth a second look: {}"], "zh-CN": ["这里有{}", "看起来是{}", "值得再看一眼：{}"]}
UNKNOWN = {"en-US": "Worth a look", "zh-CN": "值得一看"}

#: Advice: why it matters and what to do, for the rules that have some.
ADVICE = {
    "terrible-naming": ("A reader can't tell what it stands for.", "Name the thing by its role."), "meaningless-naming": ("Placeholders outlive their purpose.", "Say what the value means."),
    "hungarian-notation": ("The compiler knows the type already.", "Drop the prefix."), "abbreviation-abuse": ("Everyone shortens differently.", "Write the word out."),
    "deep-nesting": ("Each level is one more thing to remember.", "Return early and move inner parts out."), "god-function": ("It changes for every reason.", "Split it by responsibility."),
    "long-function": ("It doesn't fit a screen or a head.", "Move steps into functions with names."), "magic-number": ("Its meaning is lost.", "Give it a named constant."),
    "commented-code": ("It rots unseen.", "Delete it; version control remembers."), "dead-code": ("It is read but never runs.", "Remove what can't be reached."),
    "unwrap-abuse": ("It stops the program on the first surprise.", "Pass the error on or handle it."), "unnecessary-clone": ("It copies memory for nothing.", "Borrow instead."),
    "string-abuse": ("It allocates where a borrow would do.", "Take a string slice."), "file-too-long": ("Nobody reads it to the end.", "Split it into modules."),
    "iterator-abuse": ("The loop hides what it does.", "Say it with map, filter or fold."), "unordered-imports": ("Merges collide and doubles hide.", "Let the formatter sort them."),
    "println-debugging": ("Output lands in production.", "Use a log with levels."), "panic-abuse": ("Callers can't recover.", "Return a Result."),
    "todo-comment": ("Notes in code are never due.", "Move them to the tracker."), "deep-module-nesting": ("Paths become long and hard to find.", "Flatten the tree and export what is used."),
}


def labels_dim(spark: SparkSession) -> DataFrame:
    """lang, key, text. Chinese lacks no key here, but lookups fall back to English, then to a note that the key is missing."""
    rows = [(lang, key, texts[i]) for key, texts in LABELS.items() for i, lang in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "lang string, key string, text string")


def translate(keys: DataFrame, labels: DataFrame, lang: str) -> DataFrame:
    """``keys`` (key) with text in the language, else in English, else "Missing translation: key". Two lookups in one constant table."""
    own = labels.where(F.col("lang") == lang).select("key", F.col("text").alias("own"))
    english = labels.where(F.col("lang") == LANGUAGES[0]).select("key", F.col("text").alias("english"))
    out = keys.join(F.broadcast(own), "key", "left").join(F.broadcast(english), "key", "left")
    return out.select("key", F.coalesce("own", "english", F.concat(F.lit("Missing translation: "), "key")).alias("text"))


def message_pool(rule: Column, lang: str) -> Column:
    """The pool of messages of a rule (array); for unknown rules and languages the one general text."""
    frames = _FRAMES.get(lang)
    if frames is None:
        return F.array(F.lit(UNKNOWN.get(lang, UNKNOWN[LANGUAGES[0]])))
    topic = F.create_map(*[F.lit(x) for name, texts in TOPICS.items() for x in (name, texts[LANGUAGES.index(lang)])])[rule]
    pool = F.array(*[F.concat(F.lit(before), topic, F.lit(after)) for before, after in (f.split("{}") for f in frames)])
    return F.when(topic.isNotNull(), pool).otherwise(F.array(F.lit(UNKNOWN[lang])))


def pick(pool: Column, number: Column) -> Column:
    """The entry of a pool by a running number."""
    return F.element_at(pool, (F.pmod(number, F.size(pool)) + 1).cast("int"))


#: What is said beside a category with a high score, by category; a category without texts of its own gets the general one.
REMARKS = {
    "naming": {"en-US": ["These names keep their secrets", "A reader has to guess", "Names are the cheapest comments"], "zh-CN": ["名字守口如瓶", "读者只能猜", "好名字胜过注释"]},
    "complexity": {"en-US": ["Every branch leads to another", "Bring a map", "One function, many stories"], "zh-CN": ["一层又一层", "请自备地图", "一个函数讲了太多故事"]},
    "duplication": {"en-US": ["Seen that before", "Copies age apart", "Once would have been enough"], "zh-CN": ["似曾相识", "副本会各自变老", "写一次就够了"]},
    "rust-features": {"en-US": ["All features at once", "Not every tool has to be used"], "zh-CN": ["所有功能一起上", "工具不必全用"]},
}
GENERAL_REMARK = {"en-US": "Code needs improvement", "zh-CN": "代码需要改进"}


def number_of(text: Column) -> Column:
    """A number below 2^31 that depends on the text alone: the same on every machine and in every engine that has md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % (1 << 31)


def remark(category: Column, score: Column, seed: Column, lang: str = "en-US", least: float = 60.0) -> Column:
    """The text of the category's pool that the seed picks, for scores of at least ``least``; null below. Other languages read English."""
    lang = lang if lang in LANGUAGES else LANGUAGES[0]
    pools = F.create_map(*[x for name, texts in REMARKS.items() for x in (F.lit(name), F.array(*map(F.lit, texts[lang])))])
    pool = F.coalesce(pools[category], F.array(F.lit(GENERAL_REMARK[lang])))
    return F.when(score >= least, pick(pool, number_of(F.concat_ws(":", seed.cast("string"), category))))


def with_message(issues: DataFrame, lang: str = "en-US") -> DataFrame:
    """Issues with ``message``: a text of the rule's pool by line number, with the subject."""
    text = pick(message_pool(F.col("rule_name"), lang), F.coalesce("line", F.lit(0)))
    return issues.withColumn("message", F.concat_ws(": ", text, "subject"))


def advice_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(rule, *texts) for rule, texts in ADVICE.items()], "rule_name string, why_bad string, how_to_fix string")


def advice_for(rules: DataFrame) -> DataFrame:
    """``rules`` (rule_name) that have advice, with it."""
    return rules.join(F.broadcast(advice_dim(rules.sparkSession)), "rule_name")
