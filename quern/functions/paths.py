"""Path and name predicates, categories and type inference."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lit, strings

DEMO = [f"/{x}/" for x in "examples one-ui-demo example demos demo".split()]  # the first three count outside strict mode too
TESTLIKE_SEGMENTS = ["/story/", "/stories/", "__mocks__", "/fixtures/", "/tests/", "__tests__", "/test/"]
TESTLIKE_FILES = [".stories.", ".mock.", ".test.", ".story.", ".spec."]
TESTLIKE_NAMES = ["demo", "example", "fixture", "mock"]
MARKERS = sorted("apis types hooks utils pages services modules widgets features selectors components".split())
CATEGORY_HINTS = [("util", ["function"]), ("hook", ["hook"]), ("type", ["type", "interface"]), ("class", ["class"]), ("component", ["component"])]
QUERY_HINTS = [(["获取", "计算", "helper", "方法", "函数", "util ", " util"], ["function"]), (["hook", " use"], ["hook"])]


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def contains_any(text: Column, parts: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def display_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def is_demo(path: Column, strict: bool = False) -> Column:
    return contains_any(F.lower(path), DEMO if strict else DEMO[:3])


def is_index_file(path: Column) -> Column:
    return F.lower(basename(path)).rlike("^index\\.(js|ts|tsx|jsx)$")


def is_reusable(name: Column, path: Column) -> Column:
    low = F.lower(path)
    named = any_of([F.startswith(F.lower(name), F.lit(t)) for t in TESTLIKE_NAMES])
    return ~(is_demo(path, True) | contains_any(low, TESTLIKE_SEGMENTS) | contains_any(low, TESTLIKE_FILES)) & ~named


def common_path(path: Column) -> Column:
    return contains_any(F.lower(path), ["/common/", "/shared/"])


def category_from_path(path: Column) -> Column:
    """Last directory or file name that is a marker; null if there is none."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.try_element_at(F.filter(parts, lambda s: s.isin(MARKERS)), F.lit(-1))


def category_from_name(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.startswith(low, F.lit("use")), "hook").when(F.contains(low, F.lit("fetch")), "network").when(F.contains(low, F.lit("format")), "format").when(F.contains(low, F.lit("validate")), "validation")


def infer_types(query, category=None) -> Column:
    """Types to search: hints of the category first, then of the query, else components."""
    q, c = F.lower(lit(query)), F.lower(F.coalesce(lit(category).cast("string"), F.lit("")))
    out = None
    for word, types in CATEGORY_HINTS:
        out = F.when(F.contains(c, F.lit(word)), strings(types)) if out is None else out.when(F.contains(c, F.lit(word)), strings(types))
    for words, types in QUERY_HINTS:
        out = out.when(contains_any(q, words), strings(types))
    return out.otherwise(strings(["component"]))
