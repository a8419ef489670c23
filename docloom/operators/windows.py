"""Order-dependent operators that windows express: monotone filters, spans, bands, chunks, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monotone_filter(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows not below the running maximum. (What falls below never raises it, so the maximum of all is that of the kept.)"""
    before = F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(value) >= F.col("_before"))).drop("_before")


def span_guard(rows: DataFrame, by: list[str], order: list[str], value: str, jump: int = 500) -> DataFrame:
    """For each group the values kept, in order: strictly rising, none more than ``jump`` above the last kept; what is dropped leaves
    no trace. An ``aggregate`` over the ordered array, so no Python."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("long").alias("v"))))
    start = F.array().cast("array<bigint>")

    def step(kept, x):
        top = F.try_element_at(kept, F.lit(-1))
        ok = F.when(F.size(kept) == 0, True).otherwise((x["v"] > top) & (x["v"] - top <= jump))
        return F.when(ok, F.concat(kept, F.array(x["v"]))).otherwise(kept)

    return rows.groupBy(*by).agg(F.aggregate(listed, start, step).alias("kept"))


def build_spans(rows: DataFrame, by: list[str], order: list[str], first: str, last: str) -> DataFrame:
    """Each span's end: its own last page or the one before the next span's first, whichever is later."""
    nxt = F.lead(first).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("end_page", F.greatest(F.col(last), F.coalesce(nxt - 1, F.col(last))))


def build_bands(headings: DataFrame, by: list[str], page: str, y: str, margin: float = 0.005) -> DataFrame:
    """A heading's band: to just above the next heading if that is on the same page, else to the end of the page before it."""
    w = Window.partitionBy(*by).orderBy(page, y)
    np, ny = F.lead(page).over(w), F.lead(y).over(w)
    end_page = F.when(np.isNull(), F.col(page)).when(np == F.col(page), np).otherwise(F.greatest(F.col(page), np - 1))
    return headings.withColumns({"end_page": end_page, "end_y": F.when(np == F.col(page), ny - margin)})


def split_overlaps(bands: DataFrame, by: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Neighbouring bands that overlap are cut in the middle of the overlap; a band's two ends depend on the raw values only."""
    w = Window.partitionBy(*by).orderBy(*order)
    ns, pe = F.lead(start).over(w), F.lag(end).over(w)
    new_end = F.when(F.col(end) > ns, (F.col(end) + ns) / 2).otherwise(F.col(end))
    new_start = F.when(pe > F.col(start), (pe + F.col(start)) / 2).otherwise(F.col(start))
    return bands.withColumns({"_s": new_start, "_e": new_end}).drop(start, end).withColumnsRenamed({"_s": start, "_e": end})


def footers_rise(footers: DataFrame, by: list[str], order: list[str], number: str) -> DataFrame:
    """Whether each group's footers never fall, and the number of footers left after dropping equal neighbours."""
    prev = F.lag(number).over(Window.partitionBy(*by).orderBy(*order))
    r = footers.withColumn("_prev", prev)
    return r.groupBy(*by).agg(F.bool_and(F.col("_prev").isNull() | (F.col(number) >= F.col("_prev"))).alias("monotone"), F.count(F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(number)), 1)).alias("distinct_footers"))


def sliding_windows(pages: DataFrame, by: list[str], n: str, size: int = 3, step: int = 2) -> DataFrame:
    """Windows [start, stop) over ``n`` pages a group; the last is the first that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((F.col(n) - size) / step)).cast("int")
    w = pages.filter(F.col(n) > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    return w.withColumns({"start": F.col("_k") * step, "stop": F.least(F.col(n), F.col("_k") * step + size)}).drop("_k")


def chunks(rows: DataFrame, by: list[str], order: list[str], size: int = 4) -> DataFrame:
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))


def islands(rows: DataFrame, by: list[str], order: list[str], same: str) -> DataFrame:
    """``island``: numbers runs of equal neighbours within a group."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_spans(text: DataFrame, vision: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """Spans of two sources by number: the earlier start, the later end; ``anomaly`` where only the second has it."""
    keys = [*by, number]
    v = vision.select(*(F.col(k).alias(f"v_{k}") for k in keys), F.col("start_page").alias("v_start"), F.col("end_page").alias("v_end"))
    on = [text[k] == v[f"v_{k}"] for k in keys]
    j = text.join(v, on, "full_outer")
    return j.select(*(F.coalesce(F.col(k), F.col(f"v_{k}")).alias(k) for k in keys), F.least("start_page", "v_start").alias("start_page"), F.greatest("end_page", "v_end").alias("end_page"), text[number].isNull().alias("anomaly"))


def sequence_sufficiency(numbers: DataFrame, by: list[str], number: str, pages: str) -> DataFrame:
    """Whether numbered headings carry a document: from 1, four different ones, at most two missing (one up to 5), on three pages or 30 %."""
    g = numbers.groupBy(*by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.countDistinct(number).alias("n"), F.countDistinct("page").alias("on_pages"), F.max(pages).alias("of_pages"))
    missing = F.col("hi") - F.col("n")
    ok = (F.col("lo") == 1) & (F.col("n") >= 4) & (missing <= F.when(F.col("hi") <= 5, 1).otherwise(2)) & ((F.col("on_pages") >= 3) | (F.col("on_pages") >= 0.3 * F.col("of_pages")))
    return g.select(*by, ok.alias("sufficient"))
