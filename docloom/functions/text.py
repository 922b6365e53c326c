"""Column expressions on text: tokens, quality, fingerprints, keywords, labels. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the keyword fallback.
STOP_WORDS = (
    "a an the and or but if then than that this these those is are was were be been being of to in on at by for with from as it its it's his her "
    "their our your my we you they he she them us i not no nor can could should would may might must will shall do does did done have has had how "
    "what when where which who whom why all any both each few more most other some such only own same so too very just don now also into over under "
    "about after before while during between within without through out up down off again often various several many using used use also first second "
    "third new based show shows shown presented present given well make makes made take takes get gets like need needs see seen every less least much "
    "whose whether because since however therefore thus e.g i.e etc per via among along across within toward towards upon"
).split()
#: Prompt-injection patterns, intent patterns in order, route weights by intent.
INJECTIONS = (
    "忽略(之前|以上|上面)(的)?(所有)?(指令|提示|规则)", "(泄露|显示|输出|打印)(你的)?(系统)?(提示|指令|prompt)", r"system\s*prompt", "你(是|的)(系统|初始)(提示|指令)",
)
INTENTS = (
    ("aggregation", "多少|几个|平均|汇总|统计|总计"), ("relational", "关系|影响|导致|关联|依赖"), ("procedural", "如何|怎么|步骤|流程|怎样|操作"),
    ("comparative", "(?i)区别|差异|对比|哪个好|比较|vs"),
)
GREETING = "(?i)^(你好|您好|hi|hello|在吗)"
ROUTE_WEIGHTS = {
    "factual": {"vector": 0.9, "bm25": 0.7, "kw_exact": 0.5}, "relational": {"graph": 0.9, "vector": 0.7, "bm25": 0.5},
    "aggregation": {"structured": 0.9, "bm25": 0.6, "vector": 0.4}, "procedural": {"vector": 0.9, "bm25": 0.6},
            "comparative": {"vector": 0.9, "bm25": 0.6}, "chitchat": {},
}
#: Patterns of the keyword fallback in order, with whether stop words are dropped; labels before a figure description.
MODEL_NUMBER = "(?U)\\b[A-Za-z][A-Za-z\\-_]*[0-9][A-Za-z0-9\\-_.]*\\b"
MIXED_CASE = "(?U)\\b[A-Za-z]*[a-z][A-Z][A-Za-z0-9\\-_]*\\b"
LONG_WORD = "[A-Za-z][A-Za-z0-9\\-_]{3,}"
CAPTION_LABELS = (
    "视觉引擎已解析图片[^：:*\\n]{0,12}", "最终答案", "一句话(?:描述|总结)", "图片?(?:内容)?描述", "内容描述", "图片内容如下", "描述", "答案", "总结",
)
CJK = "[\\u4e00-\\u9fff]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_matches(c, pattern: str) -> Column:
    """Characters of c that match a one-character pattern."""
    c = _col(c)
    return F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))


def token_count(c) -> Column:
    """Estimated tokens: one per CJK ideograph, one per 3.5 other characters, plus one."""
    c = _col(c)
    cjk = count_matches(c, CJK)
    return (cjk + F.floor((F.char_length(c) - cjk) / 3.5).cast("int") + 1).cast("int")


def info_density(c) -> Column:
    """Share of CJK ideographs and ASCII letters and digits among characters that are no white space."""
    c = _col(c)
    solid = F.char_length(F.regexp_replace(c, r"(?U)\s", ""))
    return F.when(solid > 0, count_matches(c, "[\\u3400-\\u4dbf\\u4e00-\\u9fffA-Za-z0-9]") / solid).otherwise(F.lit(0.0))


def chunk_quality(c, multiplier=1.0) -> Column:
    return F.bround(F.greatest(F.lit(0.05), F.least(F.lit(1.0), (0.4 + 0.6 * info_density(c)) * F.lit(multiplier))), 3)


def fingerprint(c, n: int = 120) -> Column:
    """First n characters, lower-cased, trimmed, without blanks."""
    return F.substring(F.regexp_replace(F.lower(F.trim(_col(c))), " ", ""), 1, n)


def mask(c) -> Column:
    """First three and last two characters; short values are hidden entirely, null stays null."""
    c = _col(c).cast("string")
    return F.when(F.char_length(c) > 5, F.concat(F.substring(c, 1, 3), F.lit("***"), F.right(c, F.lit(2)))).when(c.isNotNull(), F.lit("***"))


def chunk_id(tenant, doc_id, seq, text) -> Column:
    short = F.substring(F.sha2(_col(text).cast("binary"), 256), 1, 8)
    return F.substring(F.sha2(F.concat_ws(":", _col(tenant), _col(doc_id).cast("string"), _col(seq).cast("string"), short).cast("binary"), 256), 1, 32)


def sentences(c) -> Column:
    """Pieces between sentence ends followed by white space, and between line breaks; blank pieces are dropped."""
    return F.filter(F.split(_col(c), "(?<=[。！？；!?;])\\s+|\\n+"), lambda s: F.trim(s) != "")


def paragraphs(c) -> Column:
    return F.filter(F.transform(F.split(_col(c), "\\n\\s*\\n"), lambda s: F.trim(s)), lambda s: s != "")


def query_keywords(c, n: int = 8) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(_col(c), F.lit("([A-Za-z][A-Za-z0-9\\-_]{1,})"), F.lit(1))), 1, n)


def regex_keywords(c, n: int = 5) -> Column:
    """Keywords without a model: numbers of models, mixed-case names, CJK bigrams, long words; stop words are dropped."""
    c = _col(c)
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    take = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    live = lambda a: F.filter(a, lambda w: ~F.array_contains(stop, F.lower(w)))
    pairs = F.flatten(
        F.transform(take("[\\u4e00-\\u9fff]{2,}"), lambda run: F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i,
                F.lit(2))))
    )
    found = F.concat(
        take(MODEL_NUMBER), live(take(MIXED_CASE)), pairs, live(take(LONG_WORD))
    )
    return F.slice(F.array_distinct(found), 1, n)


def embed_text(keywords, summary, text) -> Column:
    """What is embedded: keywords, summary and text, a line each; missing parts are left out."""
    kw = F.when(F.size(_col(keywords)) > 0, F.concat(F.lit("关键词："), F.array_join(_col(keywords), "、")))
    sm = F.when(F.coalesce(_col(summary), F.lit("")) != "", F.concat(F.lit("摘要："), _col(summary)))
    return F.concat_ws("\n", kw, sm, _col(text))


def caption_clean(c, labels: int = 4) -> Column:
    """A figure description without leading labels (up to four, each before a colon, bold or not) and without bold marks."""
    bold = "\\s*(?:\\*\\*|__)?\\s*"
    label = f"{bold}(?:{'|'.join(CAPTION_LABELS)})\\s*(?:如下)?\\s*[:：]{bold}"
    bare = F.regexp_replace(F.regexp_replace(_col(c), f"^(?:{label}){{1,{labels}}}", ""), "\\*\\*|__", "")
    return F.trim(F.regexp_replace(bare, "^[\\s:：\\-—]+", ""))


def page_label(first, last) -> Column:
    first, last = _col(first), _col(last)
    text = F.when(last > first, F.concat(F.lit("第"), first, F.lit("–"), last, F.lit("页"))).otherwise(F.concat(F.lit("第"), first, F.lit("页")))
    return F.when(F.coalesce(first, F.lit(0)) == 0, F.lit("")).otherwise(text)


def security_gate(c, longest: int = 2000, blocked: tuple[str, ...] = ()) -> Column:
    """Reason for which a question is refused, or null."""
    q = F.trim(_col(c))
    out = F.when(q == "", F.lit("empty")).when(F.char_length(q) > longest, F.lit("too_long"))
    for w in blocked:
        out = out.when(q.contains(w), F.lit("blocked_word"))
    return out.when(q.rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTIONS)), F.lit("injection"))


def intent(c) -> Column:
    c = _col(c)
    out = F.when((F.char_length(c) < 8) & c.rlike(GREETING), F.lit("chitchat"))
    for name, pattern in INTENTS:
        out = out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("factual"))


def heading_level(c) -> Column:
    """1 for chapter headings, dots + 1 (at most 4) for numbered ones, else null."""
    c = _col(c)
    number = F.regexp_extract(c, "^(\\d{1,2}(?:\\.\\d{1,2}){0,3})\\s+\\S+", 1)
    return F.when(c.rlike("^第[一二三四五六七八九十百\\d]+[章节篇]"), F.lit(1)).when(number != "", F.least(F.lit(4), count_matches(number, "\\.") + 1).cast("int"))


def table_to_text(headers, rows, most: int = 200) -> Column:
    """第N行：header=value；… per row with any pair; rows beyond `most` are counted in a last line."""
    headers, rows = _col(headers), _col(rows)
    pair = lambda h, v: F.when((F.trim(h) != "") & (F.trim(v) != ""), F.concat(h, F.lit("="), v))
    line = lambda r, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("行："), F.array_join(F.zip_with(headers, r, pair), "；"))
    full = lambda r: F.exists(F.zip_with(headers, r, pair), lambda p: p.isNotNull())
    lines = F.filter(F.transform(F.slice(rows, 1, most), lambda r, i: F.when(full(r), line(r, i))), lambda x: x.isNotNull())
    rest = F.when(F.size(rows) > most, F.concat(F.lit("（其余 "), (F.size(rows) - most).cast("string"), F.lit(" 行略）")))
    return F.concat_ws("\n", F.array_join(lines, "\n"), rest)


def markdown_row(*cells) -> Column:
    """Cells of a Markdown table row: pipes escaped, line breaks to blanks, 80 characters at most."""

    def cell(c):
        s = F.replace(F.replace(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        return F.when(F.char_length(s) > 80, F.concat(F.substring(s, 1, 80), F.lit("…"))).otherwise(s)

    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cells]), F.lit(" |"))


def clean_keywords(c, n: int = 5, longest: int = 32) -> Column:
    """First n distinct keywords of a list, trimmed and cut, without blanks and stop words."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    cut = F.transform(_col(c), lambda w: F.substring(F.trim(w), 1, longest))
    return F.slice(F.array_distinct(F.filter(cut, lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)))), 1, n)


def json_objects(c) -> Column:
    """All top-level {...} of a text, in order, by depth of braces; braces that nothing opens or closes are passed over."""
    return F.transform(F.array(_col(c)), _by_depth)[0]


def _by_depth(x: Column) -> Column:
    """Pieces between braces carry the depth; an object is what lies between depth 0 and depth 0 again."""
    tokens = F.regexp_extract_all(x, F.lit("[{}]|[^{}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("found"))

    def fold(s, t):
        opens, closes = t == "{", (t == "}") & (s["depth"] > 0)
        depth = F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"])
        held = F.when((s["depth"] > 0) | opens, F.concat(s["open"], t)).otherwise(F.lit(""))
        done = closes & (s["depth"] == 1)
        return F.struct(depth.alias("depth"), F.when(done, F.lit("")).otherwise(held).alias("open"),
                F.when(done, F.array_append(s["found"], held)).otherwise(s["found"]).alias("found"))

    return F.aggregate(tokens, start, fold, lambda s: s["found"])


def first_json(c, keys: tuple[str, ...] = ()) -> Column:
    """The first JSON object in a text that parses and has one of the keys (any if none are named); {} if there is none."""
    parsed = lambda o: F.from_json(o, "map<string,string>")
    fits = lambda o: parsed(o).isNotNull() & (F.size(F.array_intersect(F.map_keys(parsed(o)),
            F.array(*map(F.lit, keys)))) > 0 if keys else F.size(F.map_keys(parsed(o))) >= 0)
    return F.coalesce(F.get(F.filter(json_objects(c), fits), F.lit(0)), F.lit("{}"))


def table_lines(c) -> Column:
    """Rows of cells of the lines with pipes, the header first; lines of dashes and colons alone are no rows."""
    lines = F.filter(F.split(_col(c), "\\r?\\n"), lambda x: x.contains("|") & ~x.rlike("^[|:\\- ]*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, "^\\|+|\\|+$", ""), "\\|"), lambda v: F.trim(v)))


def rerank_scores(payload, n: int) -> Column:
    """Scores by place from a reranker's answer in JSON: results or data with index and relevance_score or score; 0 where missing."""
    item = "struct<index:int,document_index:int,relevance_score:double,score:double>"
    told = F.from_json(_col(payload), f"results array<{item}>, data array<{item}>")
    items = F.coalesce(F.when(F.size(told["results"]) > 0, told["results"]), told["data"], F.array().cast(f"array<{item}>"))
    place = lambda x: F.coalesce(x["index"], x["document_index"])
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)),
                F.transform(F.filter(items, lambda x: place(x) == i), lambda x: F.coalesce(x["relevance_score"], x["score"]))), -1), F.lit(0.0)),
    )


def temperature(c) -> Column:
    """Between 0 and 2; null stays null."""
    return F.when(_col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(2.0), _col(c).cast("double"))))


def budget_ladder(ceiling: int | None, base: tuple[int, ...] = (512, 2048, 4096)) -> list[tuple[int, int]]:
    """(tokens, characters sent) of each try: the base budgets up to the ceiling, then the ceiling, with less text in the last one."""
    cap = ceiling or base[-1]
    rungs = sorted({min(b, cap) for b in base} | {cap})
    return [(b, 800 if k and k == len(rungs) - 1 else 1500) for k, b in enumerate(rungs) if b > 0]


def ocr_text(lines, scores) -> tuple[Column, Column]:
    """Text and mean confidence of an OCR result: its lines joined, blank ones left out; 0 without lines.

    Scores are added as decimals of six digits, so the mean does not depend on their order, and halves are rounded up.
    """
    kept = F.array_join(F.filter(_col(lines), lambda x: F.trim(x) != ""), "\n")
    s = F.transform(_col(scores), lambda x: x.cast("decimal(12,6)"))
    total = F.aggregate(s, F.lit(0).cast("decimal(24,6)"), lambda a, x: (a + x).cast("decimal(24,6)"))
    return kept, F.when(F.size(s) > 0, F.round(total / F.size(s), 4).cast("double")).otherwise(F.lit(0.0))


def richer(old, new) -> Column:
    """The new rows of a table if they are more than the old ones."""
    return F.when(F.size(_col(new)) > F.size(_col(old)), _col(new)).otherwise(_col(old))


def flat(values, least: float = 3.0) -> Column:
    """Do values (grey tones of a picture) spread so little that nothing is to be seen?"""
    v = _col(values)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(spread) < least
