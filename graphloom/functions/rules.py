"""Rules that judge a text by patterns, as column expressions, with the same rules as SQL for the twins.

Every rule is a table of patterns in a form that Java's and RE2's engines read alike,
so ``..._sql`` writes the table for DuckDB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def has_sql(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, {quote(pattern)}), false)"


def weighted(text: Column, table: list[tuple[str, float]]) -> Column:
    """The sum of the weights of the patterns that occur."""
    return reduce(lambda a, b: a + b, (F.when(has(text, p), w).otherwise(0.0) for p, w in table))


def weighted_sql(text: str, table: list[tuple[str, float]]) -> str:
    return "(" + " + ".join(f"CASE WHEN {has_sql(text, p)} THEN {w} ELSE 0 END" for p, w in table) + ")"


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (has(text, p) for p in patterns))


def any_of_sql(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(has_sql(text, p) for p in patterns) + ")"


def count_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (has(text, p).cast("int") for p in patterns))


def count_of_sql(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"{has_sql(text, p)}::INT" for p in patterns) + ")"


def first_of(text: Column, table: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that occurs."""
    return F.coalesce(*(F.when(has(text, p), F.lit(name)) for p, name in table))


def first_of_sql(text: str, table: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {has_sql(text, p)} THEN {quote(name)}" for p, name in table) + " END"


# -- whether a message asks for a procedure ------------------------------------
#: Words that ask for a procedure.
STRONG = "步骤 流程 方法 指南 排查 配置 回滚 修复 部署 上线 复盘 安装 操作流程 操作步骤 怎么做 SOP runbook playbook checklist".split()
#: Words that ask for the usual way.
REUSE = "按我们之前 还是老流程 照旧 老办法 按以前 复用 习惯".split()
#: Questions for the state, which aren't requests.
NOT_ASKED = "怎么样 怎么了 如何了".split()
HOW = [(r"怎么[^\s样了]", "how"), (r"如何[^\s了]", "how")]
INTENT = [(r"我要\S", "intent"), (r"帮我\S", "intent"), (r"我们来\S", "intent"), (r"接下来做", "intent"), (r"(?i)给我一个\s*(plan|方案|计划)", "intent")]
ENGLISH = [(rf"(?i)\b{w}", "english") for w in (r"how\s+to\b", r"steps?\b", r"procedure\b", r"runbook\b", "troubleshoot", r"rollback\b", "deploy", "config", r"setup\b", "install")]
#: Words that go on with a plan.
GOING_ON = "继续 下一步 照做 执行 开始吧 进行".split()
_PLAN = r"(?:^|\n)\s*[1-9][.、)]"


def _literal(words: list[str], name: str) -> list[tuple[str, str]]:
    return [(w if w.isupper() else f"(?i){w}", name) for w in words]


_TRIGGERS = [*_literal(STRONG, "strong"), *_literal(REUSE, "reuse"), *HOW, *INTENT, *ENGLISH]


def trigger(message: Column, before: Column) -> Column:
    """Why a message asks for a procedure, null if it doesn't; ``before`` is the answer before it."""
    strong = any_of(message, [p for p, _ in _literal(STRONG, "")])
    excluded = any_of(message, NOT_ASKED) & ~strong
    goes_on = any_of(message, GOING_ON) & has(before, _PLAN)
    return F.when(~excluded, F.coalesce(first_of(message, _TRIGGERS), F.when(goes_on, F.lit("going on"))))


def trigger_sql(message: str, before: str) -> str:
    strong = any_of_sql(message, [p for p, _ in _literal(STRONG, "")])
    goes_on = f"CASE WHEN {any_of_sql(message, GOING_ON)} AND {has_sql(before, _PLAN)} THEN 'going on' END"
    return f"CASE WHEN NOT ({any_of_sql(message, NOT_ASKED)} AND NOT {strong}) THEN coalesce({first_of_sql(message, _TRIGGERS)}, {goes_on}) END"


# -- whether a text holds a procedure ------------------------------------------
#: Marks of procedures and their weights.
PROCEDURAL = [
    (r"(?i)(?:^|\n)\s*(?:步骤|step)\s*[1-9]", 0.4),
    (r"(?:^|\n)\s*[1-9][.、)]\s*[^\n]{5,}", 0.3),
    (r"(?:^|\n)\s*第[一二三四五六七八九十]+步", 0.4),
    (r"(?i)(?:如何|怎么|怎样|how\s+to)\s+\S{2,}", 0.3),
    (r"(?i)(?:流程|步骤|方法|规范|指南|教程|procedure|process|workflow)", 0.2),
    (r"(?i)(?:执行|运行|输入|run|execute|cmd|command)[:\s]+[`'\"]\S+", 0.3),
    (r"(?i)(?:git|docker|kubectl|npm|pip|curl|wget|ssh)\s+\w+", 0.3),
    (r"(?i)(?:如果|当|若|when|if)\s+.{5,}\s*(?:则|就|then)", 0.2),
    (r"(?i)(?:否则|otherwise|else)", 0.1),
    (r"(?i)(?:注意|警告|重要|caution|warning|important)[：:]\s*\S", 0.2),
    (r"(?i)(?:必须|需要|应该|不要|不能|must|should|cannot)", 0.15),
    (r"(?:先|首先|第一).{5,}(?:然后|接着|再|其次|之后)", 0.35),
    (r"(?:然后|接着|再).{3,}(?:最后|最终|完成)", 0.3),
    (r"(?:我们?是这样|一般是这样|通常是|我的做法是)", 0.3),
    (r"(?:上次|之前).{5,}(?:这样|这么|如此)(?:解决|处理|做)", 0.25),
    (r"(?:怎么|如何|怎样)\s*(?:处理|解决|做|搞定)", 0.25),
    (r"(?i)(?:Q|问)[：:].{5,}(?:A|答)[：:]", 0.2),
    (r"(?:决定|采用|使用).{5,}(?:方式|方法|流程)", 0.25),
    (r"(?:以后|今后|从现在起).{5,}(?:都要|必须|应该)", 0.2),
    (r"(?:关于|对于).{3,}(?:流程|方案|计划|安排)", 0.2),
    (r"(?:通过后|验证后|完成后).{3,}(?:再|然后|接着)", 0.25),
    (r"(?:如果|若|当).{5,}(?:就|则|立即|马上)", 0.2),
    (r"(?:发现|遇到|碰到).{5,}(?:就|则|应该)", 0.2),
]
#: Marks of reports of events, and their weights.
EPISODIC = [
    (r"(?:今天|昨天|上周|刚才|之前)\s*(?:我|我们|他|她)", -0.3),
    (r"(?:开了个?会|会议上|讨论了|说了|提到了)", -0.3),
    (r"\d{1,2}[:\s点]\d{2}\s*(?:分|到|开始)", -0.2),
    (r"(?:发生了|出现了|遇到了|碰到了)", -0.2),
    (r"(?:张三|李四|王五|某某)\s*(?:说|做|去|来)", -0.2),
]
#: Marks of what everybody knows, and their weights.
COMMONPLACE = [
    (r"(?:打开|关闭|点击|选择)\s*(?:文件|窗口|按钮|菜单|应用)", -0.4),
    (r"(?i)(?:open|close|click|select)\s+(?:file|window|button|app)", -0.4),
    (r"(?:大家都知道|众所周知|显而易见)", -0.3),
    (r"(?:一般来说|通常情况下|正常情况)", -0.2),
    (r"\A[^\n]{0,100}\z", -0.2),
]
_STEP = r"(?:^|\n)\s*[1-9][.、)]\s*[^\n]{5,}"
_INDENTED = r"(?:^|\n)\s{4,}\S"


def procedural_score(text: Column) -> Column:
    n = F.size(F.regexp_extract_all(text, F.lit(f"({_STEP})"), 1))
    size = F.char_length(text)
    return F.round(
        weighted(text, PROCEDURAL + EPISODIC + COMMONPLACE)
        - F.when(F.char_length(F.trim(text)) < 80, 0.3).otherwise(0.0)
        + F.when(n >= 3, 0.2).when((n < 2) & (size < 200), -0.2).otherwise(0.0)
        + F.when(F.contains(text, F.lit("```")) | has(text, _INDENTED), 0.15).otherwise(0.0)
        + F.when(size > 500, 0.1).otherwise(0.0),
        6,
    )


def procedural_kind(text: Column, score: Column) -> Column:
    """procedural, likely, episodic, generic or factual; a text of under 20 characters is generic."""
    return (
        F.when(F.char_length(F.trim(text)) < 20, "generic")
        .when(score >= 0.3, "procedural")
        .when(score >= 0.1, "likely")
        .when((score <= -0.3) & any_of(text, [p for p, _ in EPISODIC]), "episodic")
        .when(score <= -0.3, "generic")
        .otherwise("factual")
    )


def procedural_confidence(kind: Column, text: Column, score: Column) -> Column:
    return F.round(
        F.when(F.char_length(F.trim(text)) < 20, 0.9)
        .when(kind == "procedural", F.least(F.lit(0.9), 0.5 + score))
        .when(kind == "likely", 0.4 + score * 0.5)
        .when(kind == "factual", 0.5)
        .otherwise(0.6 - score)
        + 1e-9,  # halves go up
        2,
    )


def procedural_sql(text: str) -> tuple[str, str]:
    """(score, kind) as SQL; the kind refers to the score as ``score``."""
    score = (
        f"round({weighted_sql(text, PROCEDURAL + EPISODIC + COMMONPLACE)} - CASE WHEN length(trim({text})) < 80 THEN 0.3 ELSE 0 END"
        f" + CASE WHEN len(regexp_extract_all({text}, {quote(_STEP)})) >= 3 THEN 0.2 WHEN len(regexp_extract_all({text}, {quote(_STEP)})) < 2 AND length({text}) < 200 THEN -0.2 ELSE 0 END"
        f" + CASE WHEN contains({text}, '```') OR {has_sql(text, _INDENTED)} THEN 0.15 ELSE 0 END + CASE WHEN length({text}) > 500 THEN 0.1 ELSE 0 END, 6)"
    )
    kind = (
        f"CASE WHEN length(trim({text})) < 20 THEN 'generic' WHEN score >= 0.3 THEN 'procedural' WHEN score >= 0.1 THEN 'likely'"
        f" WHEN score <= -0.3 AND {any_of_sql(text, [p for p, _ in EPISODIC])} THEN 'episodic' WHEN score <= -0.3 THEN 'generic' ELSE 'factual' END"
    )
    return score, kind


# -- what a procedure is worth ---------------------------------------------------
#: Steps that anybody knows.
EVERYDAY = [
    r"^(打开|关闭|点击|选择|输入|复制|粘贴|保存|确认|取消)",
    r"(?i)^(open|close|click|select|enter|copy|paste|save|confirm|cancel)",
    r"^(安装|卸载|下载|上传|登录|注销)",
    r"(?i)^(install|uninstall|download|upload|login|logout)",
    r"(如有疑问|如有问题|如需帮助|详见文档|参考官方)",
]
#: What makes a procedure worth keeping.
WORTHY = {
    "safety": r"(?i)(备份|回滚|恢复|权限|安全|加密|脱敏|审计|backup|rollback|restore|permission|security|encrypt|audit|生产环境|正式环境|线上|prod)",
    "organisation": r"(?i)(内部|公司|团队|项目|我们的|internal|company|team|project|our)",
    "tools": r"(?i)(jenkins|gitlab|docker|kubernetes|k8s|terraform|ansible|mysql|postgresql|redis|mongodb|elasticsearch|aws|gcp|azure|阿里云|腾讯云)",
    "complexity": r"(?i)(分布式|集群|高可用|容灾|负载均衡|distributed|cluster|high.?availability|failover|load.?balance)",
}


def worth(text: Column, steps: Column, complete: Column) -> Column:
    """From 0 to 1, 0.5 for a text without any mark."""
    generic = count_of(text, EVERYDAY)
    score = (
        F.lit(0.5)
        - F.when(generic > 3, 0.3).when(generic > 1, 0.1).otherwise(0.0)
        - F.when(F.char_length(text) < 100, 0.2).otherwise(0.0)
        + 0.15 * count_of(text, list(WORTHY.values()))
        + F.when(steps >= 5, 0.1).otherwise(0.0)
        + F.when(complete, 0.1).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def worth_sql(text: str, steps: str, complete: str) -> str:
    n = count_of_sql(text, EVERYDAY)
    return (
        f"round(greatest(0, least(1, 0.5 - CASE WHEN {n} > 3 THEN 0.3 WHEN {n} > 1 THEN 0.1 ELSE 0 END - CASE WHEN length({text}) < 100 THEN 0.2 ELSE 0 END"
        f" + 0.15 * {count_of_sql(text, list(WORTHY.values()))} + CASE WHEN {steps} >= 5 THEN 0.1 ELSE 0 END + CASE WHEN {complete} THEN 0.1 ELSE 0 END)), 2)"
    )


def index_level(score: Column) -> Column:
    return F.when(score >= 0.4, "full").when(score >= 0.2, "summary_only").otherwise("none")


# -- what must not be shown ------------------------------------------------------
#: Highly sensitive content.
SENSITIVE = [
    r"(?i)(api[_-]?key|token|secret|password|credential)[\"'\s:=]+\S{10,}",
    r"-----BEGIN.*PRIVATE KEY-----",
    r"(?i)(internal\.|\.internal|\.local|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+)",
    r"(?i)(account[_-]?id|user[_-]?id)[\"'\s:=]+\w{8,}",
    r"(?i)(ticket|incident|case)[_-]?(id|number)?[\"'\s:=#]+\w{6,}",
]
#: Content of some sensitivity.
DELICATE = [
    r"(?i)(/home/\w+|/Users/\w+|C:\\Users\\\w+)",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"https?://[^\s]+\?([\w=&]+)",
    r"(?i)(?:电话|phone|tel)[:\s]*[\d\-+()]{8,}",
    r"\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2}",
]


def sensitivity(text: Column) -> Column:
    high, some = count_of(text, SENSITIVE), count_of(text, DELICATE)
    return F.when((high >= 2) | ((high >= 1) & (some >= 2)), "HIGH").when((high >= 1) | (some >= 3), "MEDIUM").otherwise("LOW")


def sensitivity_sql(text: str) -> str:
    high, some = count_of_sql(text, SENSITIVE), count_of_sql(text, DELICATE)
    return f"CASE WHEN {high} >= 2 OR ({high} >= 1 AND {some} >= 2) THEN 'HIGH' WHEN {high} >= 1 OR {some} >= 3 THEN 'MEDIUM' ELSE 'LOW' END"


#: What is masked, in this order.
REDACTIONS = [
    (r"(?i)(api[_-]?key|apikey|api_secret)[\"'\s:=]+[\w\-]{16,}", "[REDACTED_API_KEY]"),
    (r"(?i)(token|access[_-]?token|auth[_-]?token)[\"'\s:=]+[\w\-]{16,}", "[REDACTED_TOKEN]"),
    (r"(?i)(password|passwd|pwd)[\"'\s:=]+\S+", "[REDACTED_PASSWORD]"),
    (r"(?i)(aws[_-]?access[_-]?key[_-]?id)[\"'\s:=]+[\w]{16,}", "[REDACTED_AWS_KEY]"),
    (r"(?i)(aws[_-]?secret[_-]?access[_-]?key)[\"'\s:=]+[\w/+]{32,}", "[REDACTED_AWS_SECRET]"),
    (r"-----BEGIN\s+(?:RSA\s+)?PRIVATE KEY-----(?s:.*?)-----END\s+(?:RSA\s+)?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)bearer\s+[\w\-_.]{20,}", "[REDACTED_BEARER_TOKEN]"),
    (r"(?i)(connection[_-]?string|conn[_-]?str)[\"'\s:=]+[^\s]+", "[REDACTED_CONN_STRING]"),
    (r"(?i)(secret|private|credential)[\"'\s:=]+[A-Za-z0-9+/=]{32,}", "[REDACTED_SECRET]"),
]


def redact(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), REDACTIONS, text)


def redact_sql(text: str) -> str:
    return reduce(lambda t, p: f"regexp_replace({t}, {quote(p[0])}, {quote(p[1])}, 'g')", REDACTIONS, text)


#: Content that no step may hold.
DANGEROUS = [
    r"(?i)(self[_-]?harm|suicide|kill\s+yourself)",
    r"(?i)(make\s+a?\s*bomb|explosive\s+device|weapon\s+manufacturing)",
    r"(?i)(hack\s+into|unauthorized\s+access|bypass\s+security)",
    r"(?i)(create\s+malware|write\s+virus|ransomware)",
    r"(?i)(steal\s+credit|fraud\s+scheme|money\s+launder)",
]
#: Steps that need a second look.
RISKY = [
    r"(?i)(production|prod)\s*(deploy|release|push)",
    r"(?i)(delete|drop|truncate|remove)\s*(database|table|collection|all)",
    r"(?i)(irreversible|cannot\s+undo|permanent)",
    r"(?i)(--force|--hard|-f\s+)",
    r"(?i)(sudo|as\s+root|admin\s+rights)",
]
#: A quick look for expressions of time before they are parsed; rather too often than too seldom.
TIME_HINTS = [
    r"\d{4}[-/.年]\d{1,2}|\d{1,2}月\d{1,2}[日号]|\b(?:19|20)\d\d\b",
    r"(?i)\b(?:january|february|march|april|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"(?i)\b(?:today|yesterday|tomorrow|tonight|recently|lately|ago)\b|\b(?:last|this|next|past)\s+(?:\d+\s+)?(?:day|week|month|quarter|year)s?\b",
    r"(?:昨|今|明|前|后)(?:天|日|晚|年)|(?:上|这|本|下)个?(?:周|星期|月|季度)|最近|近期|去年",
]

# -- how a candidate contradicts what is known -------------------------------------
#: Words that contradict.
STRONG_CHANGE = "替换 改为 不再 取消 弃用 改成 禁止 废弃 replace deprecate remove cancel".split() + ["instead of", "必须改", "不能用", "已废弃", "已取消"]
#: Words that add.
MILD_CHANGE = "新增 补充 添加 优化 调整 更新 add update enhance improve modify".split()
#: Words that bound a procedure.
BOUNDS = "仅 只 必须 禁止 不能 不要 不得 only must".split() + ["should not"] + "cannot forbidden 限制 约束 前提 条件".split()


def _held(text: Column, words: list[str]) -> Column:
    """Which of the words a text holds."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _held_sql(text: str, words: list[str]) -> str:
    return f"list_filter([{', '.join(map(quote, words))}], lambda w: contains({text}, w))"


def conflict(old_steps: Column, new_steps: Column, text: Column, old_bounds: Column, new_bounds: Column) -> Column:
    """How far a candidate contradicts a procedure: other steps, words of change, other bounds."""
    union = F.size(F.array_union(old_steps, new_steps))
    apart = F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(old_steps, new_steps)) / union)
    low, three = F.lower(text), F.lit(3)
    a, b = _held(F.lower(old_bounds), BOUNDS), _held(F.lower(new_bounds), BOUNDS)
    return F.round(
        F.when(apart > 0.5, 0.3).otherwise(0.0)
        + F.least(F.size(_held(low, STRONG_CHANGE)), three) * 0.4
        + F.least(F.size(_held(low, MILD_CHANGE)), three) * 0.1
        + F.when((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0), 0.3).otherwise(0.0),
        6,
    )


def conflict_sql(old: str, new: str, text: str, old_bounds: str, new_bounds: str) -> str:
    union = f"len(list_distinct(list_concat({old}, {new})))"
    same = f"len(list_distinct(list_filter({old}, lambda x: list_contains({new}, x))))"
    a, b = _held_sql(f"lower({old_bounds})", BOUNDS), _held_sql(f"lower({new_bounds})", BOUNDS)
    return (
        f"round(CASE WHEN {union} > 0 AND 1 - {same} / {union}::DOUBLE > 0.5 THEN 0.3 ELSE 0 END + least(len({_held_sql(f'lower({text})', STRONG_CHANGE)}), 3) * 0.4"
        f" + least(len({_held_sql(f'lower({text})', MILD_CHANGE)}), 3) * 0.1 + CASE WHEN {a} <> {b} THEN 0.3 ELSE 0 END, 6)"
    )


def conflict_level(score: Column) -> Column:
    return F.when(score >= 0.7, "new_version").when(score >= 0.3, "mild").otherwise("none")


# -- what a question is about -----------------------------------------------------
#: Question words without meaning, and with one.
EMPTY_QUESTIONS = "是什么 是啥 什么是 啥是 怎么做 怎样做 如何做 为什么 为啥 怎么 怎样 如何 吗 呢 ？ ?".split()
FULL_QUESTIONS = "多少 几个 几条 几项 哪些 哪个 哪里 哪儿 多久 多长 多大 多高 什么时候 何时".split()
_AMOUNT = r"(\d+\.?\d*[%％]?[万亿千百十个元块美金日月年周天小时分秒倍次条台件套人名位家批轮期季度]*)"


_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _without(text: Column, words: list[str]) -> Column:
    return F.regexp_replace(reduce(lambda t, w: F.replace(t, F.lit(w), F.lit("")), words, text), _ENDS, "")


def _without_sql(text: str, words: list[str]) -> str:
    bare = reduce(lambda t, w: f"replace({t}, {quote(w)}, '')", words, text)
    return f"regexp_replace({bare}, {quote(_ENDS)}, '', 'g')"


def vector_query(text: Column) -> Column:
    """A question without the words that no vector needs, or the question if nothing is left."""
    bare = _without(text, EMPTY_QUESTIONS)
    return F.when(bare != "", bare).otherwise(text)


def hybrid_reason(text: Column) -> Column:
    """Why a question needs words as well as vectors: mixed_lang, number, short_query, or null."""
    core = F.regexp_replace(_without(text, EMPTY_QUESTIONS + FULL_QUESTIONS), r"[\s，,。.；;：:！!]+", "")
    return (
        F.when(has(text, "[一-鿿]") & has(text, "[A-Za-z]"), "mixed_lang")
        .when(has(text, "[0-9]"), "number")
        .when(F.char_length(core) <= 3, "short_query")
    )


def keyword(text: Column, reason: Column) -> Column:
    base = F.regexp_replace(_without(text, EMPTY_QUESTIONS + FULL_QUESTIONS), r"[\s，,。.；;：:！!？?、]+", "")
    amounts = F.array_join(F.regexp_extract_all(base, F.lit(_AMOUNT), 1), "")
    latin = F.array_join(F.regexp_extract_all(base, F.lit("([A-Za-z][A-Za-z0-9]*)"), 1), "")
    part = F.when(reason == "number", amounts).when(reason == "mixed_lang", latin)
    return F.coalesce(F.nullif(part, F.lit("")), base)


def question_sql(text: str) -> tuple[str, str, str]:
    """(vector query, reason, keyword) as SQL; the keyword refers to the reason as ``reason``."""
    bare, core = _without_sql(text, EMPTY_QUESTIONS), _without_sql(text, EMPTY_QUESTIONS + FULL_QUESTIONS)
    base = f"regexp_replace({core}, '[\\s，,。.；;：:！!？?、]+', '', 'g')"
    reason = (
        f"CASE WHEN {has_sql(text, '[一-鿿]')} AND {has_sql(text, '[A-Za-z]')} THEN 'mixed_lang' WHEN {has_sql(text, '[0-9]')} THEN 'number'"
        f" WHEN length(regexp_replace({core}, '[\\s，,。.；;：:！!]+', '', 'g')) <= 3 THEN 'short_query' END"
    )
    part = (
        f"CASE reason WHEN 'number' THEN array_to_string(regexp_extract_all({base}, {quote(_AMOUNT)}, 1), '')"
        f" WHEN 'mixed_lang' THEN array_to_string(regexp_extract_all({base}, '([A-Za-z][A-Za-z0-9]*)', 1), '') END"
    )
    return f"CASE WHEN {bare} <> '' THEN {bare} ELSE {text} END", reason, f"coalesce(nullif({part}, ''), {base})"
