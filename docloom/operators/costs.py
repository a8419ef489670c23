"""Costs, quotas, routes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (part of a model's name, dollars a million prompt tokens, a million completion tokens); the first that fits counts.
RATES = [
    ("gemini-3.7-flash", 0.375, 1.875),
    ("gemini-3.7_flash", 0.375, 1.875),
    ("gemini", 0.30, 2.50),
    ("deepseek", 0.14, 0.28),
    ("gpt-4o-mini", 0.15, 0.60),
    ("haiku", 0.80, 4.00),
    ("gpt-4o", 2.50, 10.00),
    ("sonnet", 3.00, 15.00),
]
DEFAULT_RATE = (0.15, 0.5)
FREE_UPLOADS = 3


def cost(model: Column, prompt: Column, completion: Column, rates=None) -> Column:
    """Dollars by the ordered rate card."""
    rates = RATES if rates is None else rates
    ins, outs = None, None
    for part, i, o in rates:
        hit = F.lower(model).contains(part)
        ins = F.when(hit, i) if ins is None else ins.when(hit, i)
        outs = F.when(hit, o) if outs is None else outs.when(hit, o)
    i = ins.otherwise(DEFAULT_RATE[0]) if ins is not None else F.lit(DEFAULT_RATE[0])
    o = outs.otherwise(DEFAULT_RATE[1]) if outs is not None else F.lit(DEFAULT_RATE[1])
    return (prompt * i + completion * o) / 1e6


def estimated_tokens(pages: Column, items: Column, scheme: Column) -> tuple[Column, Column]:
    """Prompt and completion tokens where the provider names none: by pages and items; less for mark schemes."""
    return pages * F.when(scheme, 1200).otherwise(1400), items * F.when(scheme, 300).otherwise(350)


def cost_fallback(base: Column, model: Column) -> Column:
    """Reasoning models cost three times as much."""
    m = F.lower(model)
    return base * F.when(m.contains("3.7") | m.contains("o1") | m.contains("o3"), 3).otherwise(1)


def quota_left(used: Column, cap: int = FREE_UPLOADS) -> Column:
    return F.greatest(F.lit(0), F.lit(cap) - used)


def route(used: Column, has_key: Column, cap: int = FREE_UPLOADS) -> Column:
    """Own key first, then the free uploads (with those that remain after this one), else a key is needed."""
    kind = F.when(has_key, "byok").when(used < cap, "free").otherwise("needs_key")
    return F.struct(kind.alias("kind"), F.when(~has_key & (used < cap), F.lit(cap) - used - 1).alias("remaining_after"))


def status_class(code: Column) -> Column:
    return F.when(code.isin(401, 403), "auth").when(code == 429, "rate_limited").when(code >= 500, "unavailable").otherwise("other")


def newest(logs: DataFrame, time: str, key: str, n: int = 100) -> DataFrame:
    """The ``n`` newest logs; ties by key."""
    return logs.orderBy(F.col(time).desc(), F.col(key)).limit(n)


def merge_reports(reports: DataFrame, by: list[str], counters: list[str], reasons: str) -> DataFrame:
    """Reports merged: counters summed, counts of each reason summed into one map. Both are partial aggregates."""
    sums = reports.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counters))
    each = reports.select(*by, F.explode(reasons).alias("reason", "n")).groupBy(*by, "reason").agg(F.sum("n").alias("n"))
    maps = each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias(reasons))
    return sums.join(maps, by, "left")


def mark_check(items: DataFrame, expected: DataFrame, key: str, marks: str, expected_marks: str) -> DataFrame:
    """key, actual, expected, ok of the items that have an expectation."""
    e = expected.select(F.col(key).alias("_key"), F.col(expected_marks).alias("expected"))
    return items.join(e, F.col(key) == F.col("_key")).select(key, F.col(marks).alias("actual"), "expected", (F.col(marks) == F.col("expected")).alias("ok"))


def elapsed(rows: DataFrame, by: list[str], total: Column, part: str) -> DataFrame:
    """``elapsed`` of each group: the total that it reports, else the sum of its parts."""
    return rows.groupBy(*by).agg(F.coalesce(F.max(total), F.sum(part)).alias("elapsed"))
