"""Token, literal and embedding-text expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import DEFAULT, Tuning

GENERIC_WORDS = sorted(
    "component hook util function class type interface page screen app module service provider helper tool".split()
    + "components hooks utils functions classes types interfaces pages screens modules services providers helpers tools".split()
    + "utility func application config configuration common shared base core main index".split()
)
LITERAL_GENERIC = sorted("types type classes class functions function utils util hooks hook components component".split())
LATIN = "([a-z0-9_]{2,})"
CJK = "([\\u4e00-\\u9fff]{2,})"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def latin_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.trim(text)), F.lit(LATIN), 1))


def cjk_bigrams(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(CJK), 1)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))


def search_tokens(text) -> Column:
    """Distinct latin words of two characters or more, then CJK bigrams, in order of appearance."""
    return F.array_union(latin_tokens(lit(text)), cjk_bigrams(lit(text)))


def query_keywords(text, tuning: Tuning = DEFAULT) -> Column:
    """search_tokens without generic code words; with split_camel, case boundaries part words first."""
    text = lit(text)
    if tuning.split_camel:
        text = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_union(F.array_except(latin_tokens(text), strings(GENERIC_WORDS)), cjk_bigrams(text))


def literal_tokens(text) -> Column:
    return F.filter(F.array_except(latin_tokens(lit(text)), strings(LITERAL_GENERIC)), lambda t: F.length(t) >= 3)


def unique_strings(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) > 0))


def terms(text: Column) -> Column:
    """Words as the full-text index has them: lower case, split at blanks and signs."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}_]+"), lambda t: F.length(t) > 0)


def matched_tokens(tokens: Column, haystack: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.contains(haystack, t)))


def search_text(name: Column, path: Column, description: Column, meta_json: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, path, F.coalesce(description, F.lit("")), F.coalesce(meta_json, F.lit(""))))


def _line(label: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(label), value))


def _list_line(label: str, values: Column) -> Column:
    return F.concat(F.lit(label), F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise("none"))


def embed_doc(kind: Column, name: Column, description: Column, signature: Column, behavior: Column, hooks: Column, side_effects: Column) -> Column:
    """Labelled lines that are embedded; empty description, signature and behaviour have none."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Type: "), kind),
        F.concat(F.lit("Name: "), name),
        _line("Description: ", description),
        _line("Signature: ", signature),
        F.when(F.size(behavior) > 0, F.concat(F.lit("Behavior: "), F.array_join(behavior, ", "))),
        _list_line("Hooks: ", hooks),
        _list_line("Side effects: ", side_effects),
    )


def query_embed_doc(query, kind="component") -> Column:
    none = F.array().cast("array<string>")
    return embed_doc(lit(kind), lit(query), lit(query), F.lit(""), none, none, none)


def row_embed_text(name: Column, kind: Column, category: Column, path: Column, description: Column, meta: dict[str, Column], content: Column) -> Column:
    """Fallback text of a stored row: the first 24 strings of each list, 1200 characters of content."""
    brief = [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}: "), F.array_join(F.slice(v, 1, 24), ", "))) for k, v in meta.items()]
    return F.concat_ws("\n", F.concat_ws(" ", kind, name), F.nullif(category, F.lit("")), path, F.nullif(description, F.lit("")), *brief, F.nullif(F.substring(content, 1, 1200), F.lit("")))


def chunk_embed_text(title: Column, path: Column, summary: Column, content: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (title, path, summary, content)])


def summary(content: Column, tuning: Tuning = DEFAULT) -> Column:
    flat = F.trim(F.regexp_replace(content, "\\s+", " "))
    return F.nullif(F.substring(flat, 1, tuning.summary_chars), F.lit(""))


def normalize(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), "^\\s+|\\s+$", "")


def rewrite_fallback(kind, keywords: Column) -> Column:
    """Sentence that stands for a query where no language model rewrites it."""
    return F.concat(F.lit("Looking for a "), lit(kind), F.lit(" related to: "), F.array_join(keywords, ", "))


#: One group a line, the preferred word first. Order matters: the first group that is hit decides, and its first word that the query lacks stands in.
SYNONYMS: list[tuple[str, ...]] = [
    tuple(line.split("|"))
    for line in """input|输入框|输入|textfield|textinput
textarea|文本域|多行输入|multiline
select|选择器|下拉框|下拉|dropdown
checkbox|复选框|勾选
radio|单选框|单选
dialog|弹窗|弹框|对话框|modal|popup
tooltip|提示|气泡提示|悬浮提示|popover
drawer|抽屉|侧边栏|sidebar
loading|加载|加载中|spinner
skeleton|骨架屏|占位图|placeholder
notification|通知|消息|提醒|toast
alert|警告|警示|提示框
table|表格
list|列表
pagination|分页|翻页|pager
tabs|标签页|选项卡|tab
badge|徽标|角标|标记
tag|标签|chip
navigation|导航|nav
menu|菜单
breadcrumb|面包屑
carousel|轮播|走马灯|slider|swiper
upload|上传|文件上传|file upload
image|图片|图像|img
debounce|防抖|去抖|usedebounce
throttle|节流|usethrottle
search|搜索|查询|filter
button|按钮|btn""".split("\n")
]
#: Stripped one after the other, in this order.
NOISE = ["^帮我找(找)?(一个|一下)?", "^有没有(现成的)?", "^请推荐(一个|一下)?", "可复用", "现成的", "封装好的", "(?i)(组件|函数|hook|工具|util)(实现)?"]


def strip_noise(query) -> Column:
    out = lit(query)
    for pattern in NOISE:
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def synonym_variant(query, groups: list[tuple[str, ...]] = SYNONYMS) -> Column:
    """The query with the first word of a group that it holds replaced by the group's first word it lacks, blanks collapsed.

    Groups are tried in order until one changes the query; null if none does. The query is bound to a variable: what a lambda names from outside is worked out again for each of its elements.
    """
    groups = F.array(*[strings(list(g)) for g in groups])
    bound = lambda value, f: F.try_element_at(F.transform(F.array(value), f), F.lit(1))

    def variant(asked: Column) -> Column:
        query, held = asked["query"], lambda w: F.contains(asked["low"], w)
        first = lambda g, test: F.try_element_at(F.filter(g, test), F.lit(1))
        pairs = F.transform(F.filter(groups, lambda g: F.exists(g, held)), lambda g: F.struct(first(g, held).alias("hit"), first(g, lambda w: ~held(w)).alias("other")))
        tried = F.transform(pairs, lambda p: F.trim(F.regexp_replace(F.regexp_replace(query, F.concat(F.lit("(?iu)\\Q"), p["hit"], F.lit("\\E")), p["other"]), "\\s+", " ")))
        return first(tried, lambda v: v.isNotNull() & (F.length(v) > 0) & (v != query))

    return bound(bound(lit(query), lambda q: F.struct(q.alias("query"), F.lower(q).alias("low"))), variant)
