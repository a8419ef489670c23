"""Document maps: page reliability, headings and footers of pages, spans, validation and assembly of extracted items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from docloom.operators import folds, windows
from docloom.sources.shared import kept_table


def page_reliability(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """``reliability``: NonQuestion for the cover and back matter, Ambiguous where a document or page has little text, else Reliable."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    whole = F.sum(size).over(Window.partitionBy(doc))
    back = F.coalesce(F.col(text).rlike(r"(?i)\b(blank page|end of questions|acknowledgements)\b"), F.lit(False))
    r = F.when((F.col(page) == 0) | back, "NonQuestion").when((whole < 100) | (size < 20), "Ambiguous").otherwise("Reliable")
    return pages.withColumn("reliability", r)


def scan_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Headings and footers of pages: doc, page, kind, number, marks, y (share of the page's bytes before it)."""

    def run(batches):
        for pdf in batches:
            out = []
            for d, p, t in zip(pdf[doc], pdf[page], pdf[text]):
                out += [(d, p, "heading", n, None, y) for n, y in folds.scan_headings(t or "")]
                if f := folds.scan_footer(t or ""):
                    out.append((d, p, "footer", f[0], f[1], f[2]))
            yield pd.DataFrame(out, columns=[doc, page, "kind", "number", "marks", "y"]).astype({"number": "Int64", "marks": "Int64"})

    return pages.select(doc, page, text).mapInPandas(run, f"`{doc}` long, `{page}` long, kind string, number long, marks long, y double")


@udtf(returnType="number: int, y: double")
class ScanHeadings:
    """``SELECT * FROM scan_headings(text)``."""

    def eval(self, text: str):
        yield from folds.scan_headings(text or "")


def prune_headings(marks: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Headings without those that stand above a footer of a smaller number on their page."""
    f = marks.filter("kind = 'footer' and number is not null").select(F.col(doc).alias("_d"), F.col(page).alias("_p"), F.col("number").alias("_n"), F.col("y").alias("_y"))
    h = marks.filter("kind = 'heading'")
    return h.join(f, (h[doc] == f["_d"]) & (h[page] == f["_p"]) & (h["y"] < f["_y"]) & (f["_n"] < h["number"]), "left_anti")


def canonical_headings(headings: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """The longest rising chain of headings from 1 of each document."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[folds.longest_steps(pdf["number"].astype(int).tolist())][[doc, page, "number", "y"]]

    return folds.per_document(headings.select(doc, page, "number", "y"), [doc], [page, "y"], fold, f"`{doc}` long, `{page}` long, number long, y double")


def hybrid_map(pages: DataFrame, proposals: DataFrame | None = None, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Spans of each document: doc, number, start_page, end_page, start_y, expected_marks.

    Text headings carry a document where they suffice; otherwise the proposals' numbers (doc, page, number) join them. Spans end
    at the page before the next one's start, expected marks come from footers by number.
    """
    # pages are scanned and headings folded once; both are read several times below
    marks = kept_table(scan_pages(pages, doc, page, text), "marks")
    heads = kept_table(canonical_headings(prune_headings(marks, doc, page), doc, page), "headings")
    n_pages = pages.groupBy(doc).agg((F.max(page) + 1).alias("_pages"))
    enough = windows.sequence_sufficiency(heads.join(n_pages, doc).withColumnRenamed(page, "page"), [doc], "number", "_pages").filter("sufficient").select(doc)
    rows = heads.select(doc, F.col(page).alias("start_page"), F.col(page).alias("end_page"), "number", "y")
    if proposals is not None:
        seen = windows.monotone_filter(proposals.join(enough, doc, "left_anti"), [doc], [page, "number"], "number")
        more = seen.groupBy(doc, "number").agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"))
        merged = windows.merge_spans(rows.join(enough, doc, "left_anti"), more, [doc])
        rows = rows.join(enough, doc, "left_semi").select(doc, "number", "start_page", "end_page", "y").unionByName(merged.select(doc, "number", "start_page", "end_page", F.lit(None).cast("double").alias("y")))
    spans = windows.build_spans(rows, [doc], ["number"], "start_page", "end_page")
    foot = marks.filter("kind = 'footer' and number is not null").groupBy(doc, "number").agg(F.min_by("marks", page).alias("expected_marks"))
    return spans.join(foot, [doc, "number"], "left").select(doc, "number", "start_page", F.greatest("start_page", "end_page").alias("end_page"), F.col("y").alias("start_y"), "expected_marks")


#: Roles of a page and other words for them.
ROLES = {"cover": "cover", "front": "cover", "question": "question", "questions": "question", "continuation": "continuation", "continued": "continuation", "blank": "blank", "formula": "formula", "formulae": "formula", "back": "back", "unknown": "unknown"}


def validate_proposal(numbers: Column, lows: Column, highs: Column, role: Column) -> Column:
    """A proposal's numbers once each in order, its role in our words, and what is wrong with it."""
    named = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.lower(F.trim(role)))
    pairs = F.arrays_zip(lows.alias("lo"), highs.alias("hi"))
    wrong = F.filter(
        F.array(
            F.when(F.exists(numbers, lambda n: (n < 1) | (n > 1000)), "number out of range"),
            F.when((F.size(lows) != F.size(numbers)) | (F.size(highs) != F.size(numbers)), "positions differ from numbers"),
            F.when(F.exists(pairs, lambda p: ~(p["lo"] < p["hi"])), "empty band"),
            F.when(named.isNull(), "unknown role"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.struct(F.array_distinct(numbers).alias("numbers"), F.coalesce(named, F.lit("unknown")).alias("role"), wrong.alias("violations"))


def item_errors(number: Column, expected: Column, content: Column, marks: Column, boxes: Column, indexes: Column) -> Column:
    """Why an extracted item does not fit its span."""
    return F.filter(
        F.array(F.when(~number.eqNullSafe(expected), "another number"), F.when((F.octet_length(F.trim(content)) < 10) & (marks > 1), "almost empty"), F.when(boxes != indexes, "boxes and pages differ")),
        lambda x: x.isNotNull(),
    )


def assemble(content: Column, footer: Column, inline: Column, model: Column) -> Column:
    """marks (the footer's, else the inline sum, else the model's, 1 at least), needs_review (they differ or the text is cut off) and
    rejected (marks without content)."""
    from docloom.functions.scalars import terminal_ending

    marks = F.coalesce(footer, F.when(inline > 0, inline), F.greatest(F.lit(1), F.coalesce(model, F.lit(1))))
    differs = F.coalesce((footer != inline) & (inline > 0), F.lit(False))
    empty = F.trim(F.coalesce(content, F.lit(""))) == ""
    return F.struct(marks.alias("marks"), (differs | ~terminal_ending(content)).alias("needs_review"), (empty & (marks > 0)).alias("rejected"))


def quarantine(spans: DataFrame, results: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Spans with their result, or a card of the first page's text for review: doc, number, content, marks, quarantined."""
    j = spans.join(results.select(doc, "number", F.col("content").alias("_c"), F.col("marks").alias("_m")), [doc, "number"], "left")
    p = pages.select(doc, F.col(page).alias("start_page"), F.col("text").alias("_t"))
    j = j.join(p, [doc, "start_page"], "left")
    return j.select(doc, "number", F.coalesce("_c", "_t", F.lit("")).alias("content"), F.coalesce("_m", "expected_marks", F.lit(0)).alias("marks"), F.col("_c").isNull().alias("quarantined"))


def caption_matches(figures: DataFrame, captions: DataFrame, banded: DataFrame) -> DataFrame:
    """Figure of each number, one at most: a band match before a caption match, then the first in order."""
    both = banded.select("doc_id", "number", "seq", F.lit(0).alias("rank")).unionByName(figures.join(captions, ["doc_id", "page"]).select("doc_id", "number", "seq", F.lit(1).alias("rank")))
    return both.groupBy("doc_id", "number").agg(F.min(F.struct("rank", "seq")).alias("m")).select("doc_id", "number", F.col("m.seq").alias("seq"))
