"""Vector similarity, text match, usage, recency and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import DEFAULT, Tuning

from . import paths
from .text import literal_tokens, lit, matched_tokens, search_tokens


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, unequally long or zero vectors."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(F.aggregate(d(x), F.lit(0.0), lambda s, v: s + v * v))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot / n).otherwise(0.0)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def usage_score(count: Column, t: Tuning = DEFAULT) -> Column:
    return clamp01(F.log10(count + F.lit(1.0)) / F.lit(t.usage_log_divisor))


def age_days(created: Column, as_of: Column) -> Column:
    """Fractional days; the same for timestamps with and without zone."""
    i = as_of - created
    part = lambda p: F.extract(F.lit(p), i).cast("double")
    return part("DAY") + part("HOUR") / 24 + part("MINUTE") / 1440 + part("SECOND") / 86400


def recency_score(created: Column, as_of: Column, t: Tuning = DEFAULT) -> Column:
    days = age_days(created, as_of)
    out = F.when(created.isNull(), F.lit(t.recency_default))
    for most, score in t.recency_tiers:
        out = out.when(days <= most, F.lit(score))
    return out.otherwise(F.lit(t.recency_oldest))


def path_score(path: Column, t: Tuning = DEFAULT) -> Column:
    return F.when(paths.common_path(path), F.lit(t.path_yes)).otherwise(F.lit(t.path_no))


def token_overlap(query, name: Column, description: Column, path: Column, t: Tuning = DEFAULT) -> Column:
    tokens = search_tokens(query)
    matched = matched_tokens(tokens, F.lower(F.concat_ws(" ", name, F.coalesce(description, F.lit("")), path)))
    ratio = matched / F.greatest(F.size(tokens), F.lit(1)).cast("double")
    out = None
    for least, share, score in t.overlap_tiers:
        hit = (matched >= least) & (ratio >= share)
        out = F.when(hit, F.lit(score)) if out is None else out.when(hit, F.lit(score))
    return out.otherwise(F.lit(0.0))


def text_match(query, name: Column, description: Column, path: Column, t: Tuning = DEFAULT) -> Column:
    """struct(score, label): exact name, name, description, token overlap or weak."""
    q = F.lower(F.trim(lit(query)))
    n, d = F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    overlap = token_overlap(query, name, description, path, t)
    pair = lambda s, label: F.struct(s.alias("score"), F.lit(label).alias("label"))
    return (
        F.when(q == "", pair(F.lit(0.0), "weak"))
        .when(n == q, pair(F.lit(1.0), "exact_name"))
        .when(F.contains(n, q), pair(F.lit(t.name_contains), "name_contains"))
        .when(F.contains(d, q), pair(F.lit(t.description_contains), "description_contains"))
        .when(overlap > 0, pair(overlap, "token_overlap"))
        .otherwise(pair(F.lit(t.weak_text), "weak"))
    )


def callee_bonus(query, callee_names: Column, t: Tuning = DEFAULT) -> Column:
    q = F.lower(lit(query))
    return F.least(F.size(F.filter(callee_names, lambda c: F.contains(q, F.lower(c)))) * F.lit(t.callee_per_match), F.lit(t.callee_max))


def total(text: Column, usage: Column, recency: Column, path: Column, bonus: Column | None = None, t: Tuning = DEFAULT) -> Column:
    out = text * F.lit(t.w_text) + usage * F.lit(t.w_usage) + recency * F.lit(t.w_recency) + path * F.lit(t.w_path)
    return F.round(out if bonus is None else out + bonus, 3)


def _joined(parts: list[Column]) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" + ", *parts), F.lit("")), F.lit("overall relevance"))


def semantic_reason(text: Column, usage: Column, path: Column, bonus: Column, t: Tuning = DEFAULT) -> Column:
    return _joined([
        F.when(text >= t.semantic_high, "high semantic similarity").when(text >= t.semantic_medium, "semantically related"),
        F.when(usage >= t.usage_high, "often used"),
        F.when(path >= t.path_yes, "in a shared path"),
        F.when(bonus > 0, "calls match"),
    ])


def keyword_reason(match: Column, usage: Column, path: Column, t: Tuning = DEFAULT) -> Column:
    return _joined([
        F.when(match["score"] >= t.name_contains, "strong text match").when(match["score"] >= t.description_contains, "description match").when(match["label"] == "token_overlap", "many words match"),
        F.when(usage >= t.usage_high, "often used"),
        F.when(path >= t.path_yes, "in a shared path"),
    ])


def strong_literal(query, name: Column, path: Column) -> Column:
    q = F.lower(F.trim(lit(query)))
    n, p, b = F.lower(name), F.lower(path), F.lower(paths.basename(path))
    return ((q != "") & ((n == q) | F.contains(p, q))) | F.exists(literal_tokens(query), lambda t: F.contains(n, t) | F.contains(b, t))


def priority(score: Column, literal: Column, path: Column, t: Tuning = DEFAULT) -> Column:
    boost = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    out = score + boost(literal, t.literal_boost) + boost(paths.is_index_file(path), t.index_boost) - boost(paths.is_demo(path), t.demo_penalty)
    return F.round(F.greatest(F.lit(0.0), out), 3)


def priority_notes(literal: Column, path: Column) -> Column:
    return F.concat_ws(" + ", F.when(literal, "name or file matches"), F.when(paths.is_index_file(path), "entry file of its directory"), F.when(paths.is_demo(path), "demo path"))


def fulltext_score(words: list[str], fields: list[Column], t: Tuning = DEFAULT) -> Column:
    """s/(s+1) of the mean best field weight of the distinct words; null unless every word occurs."""
    parts, all_in = [], F.lit(bool(words))
    for w in words:
        best = F.lit(0.0)
        for weight, f in reversed(list(zip(t.field_weights, fields))):
            best = F.when(F.array_contains(f, F.lit(w)), F.lit(weight)).otherwise(best)
        parts.append(best)
        all_in = all_in & (best > 0)
    s = sum(parts, F.lit(0.0)) / F.lit(float(max(1, len(words))))
    return F.when(all_in, s / (s + 1))


def parse_vector(text: Column) -> Column:
    v = F.from_json(text, "array<double>")
    return F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v)
