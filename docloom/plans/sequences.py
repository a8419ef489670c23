"""Queries of the order-dependent, document-map, geometry and streaming operators.

The tables hold no exam papers, so pages, spans and boxes are made from them by rules that the SQL states too.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import rewrite
from docloom.operators import docmap, folds, geometry, windows
from docloom.plans.registry import query
from docloom.sources.tables import load

Q = ["ts", "event_id"]


def E():
    return F.col("event_id")


def events(spark, sf, **cols):
    return load(spark, sf, "events").withColumns(cols)


@query("SELECT user_id, event_id, q FROM (SELECT *, event_id % 37 AS q, max(event_id % 37) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE q >= coalesce(m, 0)")
def monotone_filter(spark, sf):
    return windows.monotone_filter(events(spark, sf, q=E() % 37), ["user_id"], Q, "q").select("user_id", "event_id", "q")


@query("""SELECT user_id, array_to_string(list_reduce(l, lambda a, x: CASE WHEN x[1] > a[-1] AND x[1] - a[-1] <= 500 THEN list_concat(a, x) ELSE a END), ',') AS kept
  FROM (SELECT user_id, list([event_id * 7 % 2000] ORDER BY ts, event_id) AS l FROM events GROUP BY 1)""")
def span_guard(spark, sf):
    out = windows.span_guard(events(spark, sf, q=E() * 7 % 2000), ["user_id"], Q, "q")
    return out.select("user_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))


@query()
def lis_headings(spark, sf):
    """The longest chain of numbers from 1 of each paper of 64 events; tests hold it against brute force."""
    e = events(spark, sf, number=E() * 7 % 9 + 1, paper=F.floor(E() / 64)).select("paper", "event_id", "number")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[folds.longest_steps(pdf["number"].tolist())]

    return folds.per_document(e, ["paper"], ["event_id"], fold, "paper long, event_id long, number long")


@query("""SELECT user_id, lo = 1 AND n >= 4 AND hi - n <= CASE WHEN hi <= 5 THEN 1 ELSE 2 END AND (on_pages >= 3 OR on_pages >= 0.3 * 5) AS sufficient FROM
  (SELECT user_id, min(event_id % 23 + 1) AS lo, max(event_id % 23 + 1) AS hi, count(DISTINCT event_id % 23 + 1) AS n, count(DISTINCT event_id % 5) AS on_pages FROM events GROUP BY 1)""")
def sequence_sufficiency(spark, sf):
    return windows.sequence_sufficiency(events(spark, sf, number=E() % 23 + 1, page=E() % 5, of=F.lit(5)), ["user_id"], "number", "of")


@query("SELECT user_id, event_id, greatest(p, coalesce(lead(event_id % 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, p)) AS end_page FROM (SELECT *, event_id % 50 + event_id % 3 AS p FROM events)")
def span_build(spark, sf):
    return windows.build_spans(events(spark, sf, a=E() % 50, b=E() % 50 + E() % 3), ["user_id"], Q, "a", "b").select("user_id", "event_id", "end_page")


@query("""SELECT user_id, event_id, CASE WHEN np IS NULL THEN p WHEN np = p THEN np ELSE greatest(p, np - 1) END AS end_page, round(CASE WHEN np = p THEN ny - 0.005 END, 6)::DOUBLE AS end_y FROM
  (SELECT *, lead(p) OVER w AS np, lead(y) OVER w AS ny FROM (SELECT *, event_id % 6 AS p, event_id / 1e6::DOUBLE AS y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY p, y))""")
def band_build(spark, sf):
    out = windows.build_bands(events(spark, sf, p=E() % 6, y=E() / 1e6), ["user_id"], "p", "y")
    return out.select("user_id", "event_id", "end_page", F.round("end_y", 6).alias("end_y"))


@query("""SELECT user_id, event_id, round(CASE WHEN pe > s THEN (pe + s) / 2 ELSE s END, 6)::DOUBLE AS s, round(CASE WHEN e > ns THEN (e + ns) / 2 ELSE e END, 6)::DOUBLE AS e FROM
  (SELECT *, lead(s) OVER w AS ns, lag(e) OVER w AS pe FROM (SELECT *, (event_id % 97) / 100.0::DOUBLE AS s, (event_id % 97) / 100.0::DOUBLE + 0.3::DOUBLE AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def band_overlap_split(spark, sf):
    s = (E() % 97) / F.lit(100.0)
    out = windows.split_overlaps(events(spark, sf, s=s, e=s + 0.3), ["user_id"], Q, "s", "e")
    return out.select("user_id", "event_id", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


@query("""SELECT user_id, bool_and(p IS NULL OR n >= p) AS monotone, count(*) FILTER (p IS NULL OR p <> n) AS distinct_footers FROM
  (SELECT user_id, n, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT *, event_id // 900 * (event_id % 2) + user_id % 2 * event_id AS n FROM events)) GROUP BY 1""")
def footer_monotone(spark, sf):
    n = F.floor(E() / 900) * (E() % 2) + F.col("user_id") % 2 * E()
    return windows.footers_rise(events(spark, sf, n=n), ["user_id"], ["event_id"], "n")


@query("""SELECT conv_id, (k * 2)::INT AS start, least(n, k * 2 + 3) AS stop FROM (SELECT conv_id, n, unnest(range(greatest(0, ceil((n - 3) / 2.0))::BIGINT + 1)) AS k FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1))""")
def sliding_windows(spark, sf):
    n = load(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return windows.sliding_windows(n, ["conv_id"], "n").select("conv_id", F.col("start").cast("int").alias("start"), "stop")


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4)::BIGINT AS chunk FROM conversations")
def page_chunks(spark, sf):
    return windows.chunks(load(spark, sf, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "chunk")


@query("""SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM
  (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, event_type, i HAVING count(*) >= 2""")
def same_page_batches(spark, sf):
    runs = windows.islands(load(spark, sf, "events"), ["user_id"], Q, "event_type")
    return runs.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first")).filter("n >= 2").drop("island")


@query("SELECT event_id, array_to_string(list_sort(list_distinct([event_id % 5, event_id % 3, event_id % 7, event_id % 2])), ',') AS pages FROM events")
def page_set_union(spark, sf):
    u = F.array_sort(F.array_union(F.array(E() % 5, E() % 3), F.array(E() % 7, E() % 2)))
    return load(spark, sf, "events").select("event_id", F.array_join(F.transform(u, lambda x: x.cast("string")), ",").alias("pages"))


@query("""WITH t AS (SELECT user_id, event_id % 11 AS number, min(event_id % 40) AS s, max(event_id % 40) AS e FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), v AS (SELECT user_id, event_id % 13 AS number, min(event_id % 37) AS s, max(event_id % 37) AS e FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
  SELECT coalesce(t.user_id, v.user_id) AS user_id, coalesce(t.number, v.number) AS number, least(t.s, v.s) AS start_page, greatest(t.e, v.e) AS end_page, t.number IS NULL AS anomaly FROM t FULL JOIN v ON t.user_id = v.user_id AND t.number = v.number""")
def span_merge(spark, sf):
    def spans(rest, numbers, pages):
        return load(spark, sf, "events").filter(E() % 2 == rest).groupBy("user_id", (E() % numbers).alias("number")).agg(F.min(E() % pages).alias("start_page"), F.max(E() % pages).alias("end_page"))

    return windows.merge_spans(spans(0, 11, 40), spans(1, 13, 37), ["user_id"])


# ---- pages of papers made from conversations: a page of each turn

PAGE_SQL = """pages AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn = 0 THEN 'Cover page of the paper' WHEN turn % 7 = 6 THEN 'BLANK PAGE'
  ELSE turn || '. Work out the value of the given expression step by step.' || chr(10) || '(Total for Question ' || turn || ' is ' || (turn % 5 + 1) || ' marks)' END AS text FROM conversations)"""


def paper_pages(spark, sf):
    t = F.col("turn")
    text = F.when(t == 0, "Cover page of the paper").when(t % 7 == 6, "BLANK PAGE").otherwise(F.concat(t.cast("string"), F.lit(". Work out the value of the given expression step by step.\n(Total for Question "), t.cast("string"), F.lit(" is "), (t % 5 + 1).cast("string"), F.lit(" marks)")))
    return load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), t.alias("page"), text.alias("text"))


@query(f"WITH {PAGE_SQL} SELECT doc_id, page, page AS number FROM pages WHERE page > 0 AND page % 7 <> 6")
def scan_headings_function(spark, sf):
    """The headings of each page by a table function in SQL."""
    spark.udtf.register("scan_headings", docmap.ScanHeadings)
    paper_pages(spark, sf).createOrReplaceTempView("paper_pages")
    return spark.sql("SELECT doc_id, page, CAST(h.number AS BIGINT) AS number FROM paper_pages, LATERAL scan_headings(text) h")


@query("""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^\\s]+') AS w FROM conversations), l AS (SELECT conv_id, turn, unnest(w) AS w, (generate_subscripts(w, 1) - 1) // 10 AS line, generate_subscripts(w, 1) AS i FROM t),
  j AS (SELECT conv_id, turn, line, string_agg(w, ' ' ORDER BY i) AS x FROM l GROUP BY ALL) SELECT conv_id, turn, sha256(string_agg(x, chr(10) ORDER BY line)) AS digest FROM j GROUP BY ALL""")
def glyph_text(spark, sf):
    """The words of each turn set as placed glyphs, ten in a line, and put together again."""
    from docloom.sources.gateway import assemble_glyphs

    t = load(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"[^\s]+"), 0).alias("w"))
    w = t.select("conv_id", "turn", F.posexplode("w").alias("n", "w"))
    g = w.select("conv_id", "turn", "n", F.posexplode(F.split("w", "")).alias("k", "char")).filter("char <> ''")
    # words stand a thousand apart, glyphs one; a line is two high
    g = g.select("conv_id", "turn", (F.col("n") * 100_000 + F.col("k")).alias("i"), "char", (F.col("n") % 10 * 100_000.0 + F.col("k")).alias("x"), (F.floor(F.col("n") / 10) * 2.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("size"))
    return assemble_glyphs(g, ["conv_id", "turn"], "i").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {PAGE_SQL} SELECT doc_id, page, CASE WHEN page = 0 OR regexp_matches(text, 'blank page', 'i') THEN 'NonQuestion' WHEN sum(strlen(text)) OVER (PARTITION BY doc_id) < 100 OR strlen(text) < 20 THEN 'Ambiguous' ELSE 'Reliable' END AS reliability FROM pages""")
def page_reliability(spark, sf):
    return docmap.page_reliability(paper_pages(spark, sf)).select("doc_id", "page", "reliability")


@query(f"WITH {PAGE_SQL} SELECT doc_id, page, page AS number, page % 5 + 1 AS marks FROM pages WHERE page > 0 AND page % 7 <> 6")
def footer_scan(spark, sf):
    return docmap.scan_pages(paper_pages(spark, sf)).filter("kind = 'footer'").select("doc_id", "page", "number", "marks")


@query(f"WITH {PAGE_SQL} SELECT doc_id, page, page AS number FROM pages WHERE page > 0 AND page % 7 <> 6")
def heading_scan(spark, sf):
    return docmap.scan_pages(paper_pages(spark, sf)).filter("kind = 'heading'").select("doc_id", "page", "number")


@query("SELECT user_id, event_id FROM (SELECT *, event_id % 8 AS n, event_id % 4 AS p, event_id % 100 AS y FROM events) h WHERE event_id % 3 < 2 AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_id % 3 = 2 AND f.user_id = h.user_id AND f.event_id // 500 = h.event_id // 500 AND f.event_id % 4 = h.p AND f.event_id % 8 < h.n AND h.y < f.event_id % 100)")
def heading_prune(spark, sf):
    """Every third event a footer, the others headings, on the pages of a user's papers of 500 events."""
    paper = F.col("user_id") * 1_000_000_000 + F.floor(E() / 500)
    m = load(spark, sf, "events").select(paper.alias("doc_id"), "user_id", "event_id", (E() % 4).alias("page"), (E() % 8).alias("number"), (E() % 100).alias("y"), F.when(E() % 3 < 2, "heading").otherwise("footer").alias("kind"))
    return docmap.prune_headings(m).select("user_id", "event_id")


@query(f"""WITH {PAGE_SQL}, h AS (SELECT doc_id, page FROM pages WHERE page BETWEEN 1 AND 5 OR (page BETWEEN 7 AND 12)), k AS (SELECT doc_id, page, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS n FROM h)
  SELECT doc_id, page AS number, page AS start_page, greatest(page, coalesce(n - 1, page)) AS end_page, page % 5 + 1 AS expected_marks FROM k""")
def hybrid_map(spark, sf):
    return docmap.hybrid_map(paper_pages(spark, sf)).select("doc_id", "number", "start_page", "end_page", "expected_marks")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 1300 > 1000 OR event_id % 1300 < 1 THEN 'number out of range' END, CASE WHEN event_id % 9 = 0 THEN 'positions differ from numbers' END, CASE WHEN event_id % 5 = 0 THEN 'empty band' END, CASE WHEN event_id % 4 = 3 THEN 'unknown role' END], lambda x: x IS NOT NULL), ';') AS violations,
  CASE event_id % 4 WHEN 0 THEN 'question' WHEN 1 THEN 'continuation' WHEN 2 THEN 'cover' ELSE 'unknown' END AS role FROM events""")
def proposal_validate(spark, sf):
    numbers = F.when(E() % 9 == 0, F.array(E() % 1300, E() % 1300)).otherwise(F.array(E() % 1300))
    role = F.when(E() % 4 == 0, " Questions").when(E() % 4 == 1, "continued").when(E() % 4 == 2, "front").otherwise("poem")
    v = docmap.validate_proposal(numbers, F.array(F.lit(0.2)), F.array(F.when(E() % 5 == 0, 0.1).otherwise(0.6)), role)
    return load(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", F.array_join("v.violations", ";").alias("violations"), "v.role")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 7 <> event_id % 5 THEN 'another number' END, CASE WHEN event_id % 3 = 0 AND event_id % 4 > 1 THEN 'almost empty' END, CASE WHEN event_id % 2 <> 0 THEN 'boxes and pages differ' END], lambda x: x IS NOT NULL), ';') AS errors FROM events""")
def item_validate(spark, sf):
    e = docmap.item_errors(E() % 7, E() % 5, F.when(E() % 3 == 0, " x ").otherwise("a longer content"), E() % 4, E() % 2, F.lit(0))
    return load(spark, sf, "events").select("event_id", F.array_join(e, ";").alias("errors"))


@query("""SELECT event_id, coalesce(f, CASE WHEN i > 0 THEN i END, greatest(1, m)) AS marks, coalesce(f <> i AND i > 0, false) OR event_id % 4 <> 0 AS needs_review, event_id % 8 = 1 AND coalesce(f, CASE WHEN i > 0 THEN i END, greatest(1, m)) > 0 AS rejected
  FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 6 END AS f, event_id % 5 AS i, event_id % 7 AS m FROM events)""")
def assemble_question(spark, sf):
    content = F.when(E() % 8 == 1, " ").when(E() % 4 == 0, "It ends.").otherwise("It is cut of")
    a = docmap.assemble(content, F.when(E() % 3 == 0, E() % 6), E() % 5, E() % 7)
    return load(spark, sf, "events").select("event_id", a.alias("a")).select("event_id", "a.marks", "a.needs_review", "a.rejected")


@query("""SELECT doc_id, page AS number, CASE WHEN page % 3 = 0 THEN 'got ' || page ELSE 'page ' || page END AS content, CASE WHEN page % 3 = 0 THEN 4 WHEN page % 2 = 0 THEN page ELSE 0 END AS marks, page % 3 <> 0 AS quarantined FROM (SELECT conv_id AS doc_id, turn AS page FROM conversations)""")
def quarantine_cards(spark, sf):
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    spans = c.select("doc_id", F.col("page").alias("number"), F.col("page").alias("start_page"), F.when(F.col("page") % 2 == 0, F.col("page")).alias("expected_marks"))
    results = c.filter("page % 3 = 0").select("doc_id", F.col("page").alias("number"), F.concat(F.lit("got "), F.col("page").cast("string")).alias("content"), F.lit(4).cast("long").alias("marks"))
    return docmap.quarantine(spans, results, c.withColumn("text", F.concat(F.lit("page "), F.col("page").cast("string"))))


@query()
def repair_resolve(spark, sf):
    """The outcome of each user's first three attempts: accepted, stopped on an equal error, or exhausted."""
    w = Window.partitionBy("user_id").orderBy(*Q)
    a = load(spark, sf, "events").select("user_id", F.row_number().over(w).alias("attempt"), F.when(E() % 4 == 0, "reply").alias("reply"), F.when(E() % 4 != 0, F.concat(F.lit("e"), (E() % 2).cast("string"))).alias("error"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["attempt"], pdf["reply"], pdf["error"].where(pdf["error"].notna(), None)))
        return pd.DataFrame([(pdf["user_id"][0], *folds.resolve_attempts(rows))], columns=["user_id", "used", "reply", "outcome"])

    return folds.per_document(a, ["user_id"], ["attempt"], fold, "user_id long, used int, reply string, outcome string")


@query()
def stitch_fold(spark, sf):
    """Pages of a conversation joined where their number goes on."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("number"), "text")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["conv_id"][0], n, t, r) for n, t, r in folds.stitch([(int(n), t) for n, t in zip(pdf["number"], pdf["text"])])], columns=["conv_id", "number", "text", "review"])

    return folds.per_document(c, ["conv_id"], ["turn", "text"], fold, "conv_id long, number long, text string, review boolean")


@query()
def answer_stitch(spark, sf):
    """Answers of a conversation by number: the first, and one alternative that is no repeat."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("number"), "text")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["conv_id"][0], n, t) for n, t in folds.stitch_answers([(int(n), t) for n, t in zip(pdf["number"], pdf["text"])])], columns=["conv_id", "number", "text"])

    return folds.per_document(c, ["conv_id"], ["turn", "text"], fold, "conv_id long, number long, text string")


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN 'See ![](a.png) here ' || text WHEN 1 THEN 'In Figure 1 it is' || chr(10) || chr(10) || '![](a.png)' || chr(10) || chr(10) || text ELSE regexp_replace('plain ' || text, '\\s+$', '') || chr(10) || chr(10) || '![](a.png)' END) AS digest FROM t""")
def attach_figures(spark, sf):
    d = F.col("doc_id")
    t = F.concat(F.when(d % 3 == 0, "See [DIAGRAM_PLACEHOLDER] here ").when(d % 3 == 1, "In Figure 1 it is\n").otherwise("plain "), F.coalesce("text", F.lit("")))
    return load(spark, sf, "documents").select("doc_id", F.sha2(rewrite.over(lambda x: rewrite.attach_figures(x, ["a.png"]))(t), 256).alias("digest"))


# ---- boxes made from vectors

BOX_SQL = """boxes AS (SELECT vec_id, label, vec_id // 20 AS doc_id, vec_id % 3 AS page, abs(embedding[1])::DOUBLE * 4.0 % 0.8::DOUBLE AS x, abs(embedding[2])::DOUBLE * 4.0 % 0.8::DOUBLE AS y, abs(embedding[3])::DOUBLE * 2.0 % 0.4::DOUBLE AS w, abs(embedding[4])::DOUBLE * 2.0 % 0.4::DOUBLE AS h FROM embeddings)"""


def boxes(spark, sf):
    e = F.col("embedding")
    part = lambda i, s: F.abs(e[i]).cast("double") * F.lit(5 * s) % F.lit(s)
    v = F.col("vec_id")
    return load(spark, sf, "embeddings").select("vec_id", "label", F.floor(v / 20).alias("doc_id"), (v % 3).alias("page"), part(0, 0.8).alias("x"), part(1, 0.8).alias("y"), part(2, 0.4).alias("w"), part(3, 0.4).alias("h"))


@query(f"""WITH {BOX_SQL}, b AS (SELECT vec_id, x * s AS a, y * s AS b, w * s AS c, h * s AS d, CASE WHEN vec_id % 3 = 2 THEN 1.0 ELSE 0 END AS pix FROM boxes, LATERAL (SELECT CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 100.0 ELSE 900.0 END::DOUBLE AS s)),
  t AS (SELECT *, greatest(a, b, c, d) AS top FROM b), u AS (SELECT *, CASE WHEN top <= 1.5 THEN 1000.0 WHEN top <= 100 THEN 10.0 WHEN top <= 1050 THEN 1.0 END::DOUBLE AS sx, CASE WHEN top <= 1.5 THEN 800.0 WHEN top <= 100 THEN 8.0 WHEN top <= 1050 THEN 1.0 END::DOUBLE AS sy FROM t),
  p AS (SELECT vec_id, a * sx AS x, b * sy AS y, c * sx AS c, d * sy AS d FROM u), k AS (SELECT *, c > x AND d > y AND (x + c > 1020 OR y + d > 816) AS corner FROM p),
  r AS (SELECT vec_id, x, y, least(CASE WHEN corner THEN c ELSE x + c END, 1000) - x AS w, least(CASE WHEN corner THEN d ELSE y + d END, 800) - y AS h FROM k)
  SELECT vec_id, CASE WHEN w >= 12 AND h >= 12 AND w * h / 800000 BETWEEN 0.0005 AND 0.92 THEN floor(x)::INT || ',' || floor(y)::INT || ',' || round(w)::INT || ',' || round(h)::INT END AS box FROM r""")
def bbox_sanitize(spark, sf):
    v = F.col("vec_id")
    s = F.when(v % 3 == 0, 1.0).when(v % 3 == 1, 100.0).otherwise(900.0)
    box = geometry.sanitize_box(F.array(*(F.col(c) * s for c in "xywh")), F.lit(1000), F.lit(800))
    out = boxes(spark, sf).select("vec_id", box.alias("b"))
    return out.select("vec_id", F.when(F.col("b").isNotNull(), F.concat_ws(",", *(F.col(f"b.{c}").cast("string") for c in "xywh"))).alias("box"))


@query(f"WITH {BOX_SQL} SELECT vec_id, CASE WHEN w < 0.01 OR h < 0.01 THEN CASE WHEN greatest(w, h) > 0.2 THEN 'rule' ELSE 'tiny' END WHEN w * h > 0.5 THEN 'page' WHEN w * h < 0.002 THEN 'tiny' ELSE 'figure' END AS kind FROM boxes")
def bbox_filter(spark, sf):
    return boxes(spark, sf).select("vec_id", geometry.box_kind(F.array("x", "y", "w", "h")).alias("kind"))


@query(f"""WITH {BOX_SQL}, c AS (SELECT *, CASE vec_id % 4 WHEN 0 THEN [4, 5] WHEN 1 THEN [1, 2, 3] WHEN 2 THEN [7] ELSE [NULL]::INT[] END AS f FROM boxes), e AS (SELECT *, len(f) AS n, unnest(f) AS figure, generate_subscripts(f, 1) - 1 AS i FROM c)
  SELECT vec_id, figure, round(CASE WHEN h > w THEN x ELSE x + w * (i / n::DOUBLE) END, 6) AS x, round(CASE WHEN h > w THEN y + h * (i / n::DOUBLE) ELSE y END, 6) AS y, round(CASE WHEN h > w THEN w ELSE w / n END, 6) AS w, round(CASE WHEN h > w THEN h / n ELSE h END, 6) AS h FROM e""")
def caption_split(spark, sf):
    v = F.col("vec_id") % 4
    caption = F.when(v == 0, "Figure 4 and Figure 5").when(v == 1, "Figs. 1, 2, 3").when(v == 2, "Figure 7").otherwise("A photograph")
    out = geometry.split_by_caption(boxes(spark, sf).withColumn("caption", caption), "caption")
    return out.select("vec_id", "figure", *(F.round(c, 6).alias(c) for c in "xywh"))


@query(f"WITH {BOX_SQL} SELECT doc_id, page, round(min(x), 9) AS x, round(min(y), 9) AS y, round(max(x + w) - min(x), 9) AS w, round(max(y + h) - min(y), 9) AS h FROM boxes GROUP BY 1, 2")
def bbox_union(spark, sf):
    u = geometry.union_boxes(boxes(spark, sf), ["doc_id", "page"], "x", "y", "w", "h")
    return u.select("doc_id", "page", *(F.round(c, 9).alias(c) for c in "xywh"))


@query()
def cluster_boxes(spark, sf):
    """Clusters of each page's boxes, greedy by area."""
    b = boxes(spark, sf)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        got = folds.cluster_boxes(list(zip(pdf["x"], pdf["y"], pdf["w"], pdf["h"])))
        return pd.DataFrame([(pdf["doc_id"][0], pdf["page"][0], i, *c) for i, c in enumerate(got)], columns=["doc_id", "page", "cluster", "x", "y", "w", "h"])

    return folds.per_document(b, ["doc_id", "page"], ["vec_id"], fold, "doc_id long, page long, cluster int, x double, y double, w double, h double")


@query()
def figure_detect(spark, sf):
    """Clusters of the figure-like boxes of a page, the large ones left out, with the nearest caption's number."""
    b = boxes(spark, sf).withColumn("kind", geometry.box_kind(F.array("x", "y", "w", "h"))).filter("kind in ('figure', 'rule')")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [c for c in folds.cluster_boxes(list(zip(pdf["x"], pdf["y"], pdf["w"], pdf["h"]))) if c[2] * c[3] <= 0.5]
        return pd.DataFrame([(pdf["doc_id"][0], pdf["page"][0], i, *c) for i, c in enumerate(got)], columns=["doc_id", "page", "seq", "x", "y", "w", "h"])

    figures = folds.per_document(b, ["doc_id", "page"], ["vec_id"], fold, "doc_id long, page long, seq int, x double, y double, w double, h double")
    key = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string"))
    captions = boxes(spark, sf).select(key.alias("place"), F.col("vec_id").alias("cseq"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return geometry.nearest_caption(figures.withColumn("place", key), captions, "place", "seq")


@query(f"""WITH {BOX_SQL}, c AS (SELECT vec_id AS cseq, doc_id, x AS cx, y AS cy FROM boxes WHERE vec_id % 5 = 0) SELECT b.doc_id, b.vec_id, (SELECT cseq FROM c WHERE c.doc_id = b.doc_id ORDER BY (x + w / 2 - cx) ** 2 + (y + h / 2 - cy) ** 2, cseq LIMIT 1) AS cseq FROM boxes b WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = b.doc_id)""")
def nearest_caption(spark, sf):
    b = boxes(spark, sf)
    c = b.filter("vec_id % 5 = 0").select("doc_id", F.col("vec_id").alias("cseq"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return geometry.nearest_caption(b, c, "doc_id", "vec_id")


_SPANS = "spans AS (SELECT number, doc_id, number % 3 AS start_page, number % 3 + (number + doc_id) % 2 AS end_page, 0.2::DOUBLE AS start_y, 0.7::DOUBLE AS end_y FROM (SELECT DISTINCT doc_id FROM boxes) d, range(6) r(number))"


def _spans(spark, sf):
    """Six spans of each document."""
    d = boxes(spark, sf).select("doc_id").distinct().withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    n = F.col("number")
    return d.select("number", "doc_id", (n % 3).alias("start_page"), (n % 3 + (n + F.col("doc_id")) % 2).alias("end_page"), F.lit(0.2).alias("start_y"), F.lit(0.7).alias("end_y"))


@query(f"WITH {BOX_SQL}, {_SPANS} SELECT vec_id, number FROM boxes b JOIN spans s ON b.doc_id = s.doc_id AND page BETWEEN start_page AND end_page AND (page > start_page OR y + h / 2 >= start_y) AND (page < end_page OR y + h / 2 <= end_y)")
def band_join(spark, sf):
    return geometry.in_band(boxes(spark, sf), _spans(spark, sf), "doc_id").select("vec_id", "number")


@query(f"""WITH {BOX_SQL}, {_SPANS}, banded AS (SELECT b.doc_id, number, vec_id AS seq, 0 AS rank FROM boxes b JOIN spans s ON b.doc_id = s.doc_id AND page BETWEEN start_page AND end_page AND (page > start_page OR y + h / 2 >= start_y) AND (page < end_page OR y + h / 2 <= end_y)),
  capt AS (SELECT b.doc_id, c.vec_id % 10 AS number, b.vec_id AS seq, 1 AS rank FROM boxes b JOIN boxes c ON b.doc_id = c.doc_id AND b.page = c.page WHERE c.vec_id % 4 = 1), a AS (SELECT * FROM banded UNION ALL SELECT * FROM capt)
  SELECT doc_id, number, seq FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY rank, seq) = 1""")
def caption_match(spark, sf):
    b = boxes(spark, sf)
    banded = geometry.in_band(b, _spans(spark, sf), "doc_id").select("doc_id", "number", F.col("vec_id").alias("seq"))
    figures = b.select("doc_id", "page", F.col("vec_id").alias("seq"))
    captions = b.filter("vec_id % 4 = 1").select("doc_id", "page", (F.col("vec_id") % 10).alias("number"))
    return docmap.caption_matches(figures, captions, banded)


@query("""SELECT a.vec_id, count(b.vec_id) AS n_near FROM embeddings a LEFT JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label AND a.vec_id // 100 = b.vec_id // 100
  AND round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i] - b.embedding[i])::DOUBLE)) / 64, 5) < 0.13 GROUP BY 1""")
def vector_near_dup(spark, sf):
    """How many other vectors of its import (a hundred vectors) and label are near each vector."""
    e = load(spark, sf, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 100).alias("batch"), "embedding")
    o = e.select(F.col("vec_id").alias("other_id"), "label", "batch", F.col("embedding").alias("other"))
    near = e.join(o, ["label", "batch"]).filter(F.col("vec_id") != F.col("other_id")).filter(F.round(geometry.mean_l1(F.col("embedding"), F.col("other")), 5) < 0.13)
    return e.select("vec_id").join(near.groupBy("vec_id").agg(F.count("*").alias("n")), "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_near"))


@query()
def image_near_dup(spark, sf):
    """Of each import's vectors (a hundred) those kept when one near an earlier kept one goes."""
    import numpy as np

    e = load(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("part"), "embedding")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[folds.first_of_each(np.stack(pdf["embedding"]), 0.8)][["part", "vec_id"]]

    return folds.per_document(e, ["part"], ["vec_id"], fold, "part long, vec_id long")


@query("SELECT vec_id, vec_id % 4 = 0 AS blank, vec_id % 4 IN (1, 2) AS lines, vec_id % 4 = 2 AS grid FROM embeddings")
def pixel_flags(spark, sf):
    """Blank, ruled, gridded and dotted synthetic pages."""

    def draw(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for v in pdf["vec_id"]:
                a = np.full((120, 100), 255, np.uint8)
                if v % 4 in (1, 2):
                    a[10::14] = 0
                if v % 4 == 2:
                    a[:, [5, 50, 95]] = 0
                if v % 4 == 3:
                    a[::9, ::9] = 0
                out.append((v, a.tobytes(), 100, 120))
            yield pd.DataFrame(out, columns=["vec_id", "pixels", "w", "h"])

    pages = load(spark, sf, "embeddings").select("vec_id").mapInPandas(draw, "vec_id long, pixels binary, w int, h int")
    return geometry.pixel_flags(pages, "vec_id", "pixels", "w", "h")


# ---- streams

@query("SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def stream_upsert(spark, sf):
    """Documents streamed into a table of the newest of each source and language."""
    from docloom.sources.shared import fresh_folder
    from docloom.streaming.ingest import latest_version, stream_upsert

    docs = load(spark, sf, "documents").select("doc_id", "lang", "source")
    source = _stream(spark, sf, "documents").select(*docs.columns)
    at = fresh_folder(spark, "stream")
    stream_upsert(source, f"{at}/table", ["source", "lang"], "doc_id", f"{at}/checkpoint").awaitTermination()
    return latest_version(spark, f"{at}/table").select("source", "lang", "doc_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    """Extension: hourly windows over a stream of events, upserted as they change."""
    from docloom.sources.shared import fresh_folder
    from docloom.streaming.ingest import drained, tumbling

    got = drained(tumbling(_event_stream(spark, sf)), "update", ["start", "event_type"], "n", fresh_folder(spark, "windows"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


def _event_stream(spark, sf):
    """Events as a stream; event time is to be a point in time, in the session's zone, and becomes local time again."""
    return _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, sf, name):
    """A table as a stream of its files."""
    return spark.readStream.schema(load(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM s)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, i""")
def stream_sessions(spark, sf):
    """Extension: sessions with a gap of half an hour over a stream of events."""
    from docloom.sources.shared import fresh_folder
    from docloom.streaming.ingest import drained, sessions

    return drained(sessions(_event_stream(spark, sf)), "complete", ["user_id", "start"], None, fresh_folder(spark, "sessions")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_watermark(spark, sf):
    """Extension: one event of each user and type in a stream of events."""
    from docloom.sources.shared import fresh_folder
    from docloom.streaming.ingest import dedup, drained

    return drained(dedup(_event_stream(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type"), "append", [], None, fresh_folder(spark, "dedup"))


# ---- files

@query("SELECT s_suppkey AS id, s_name AS front, 'back, ' || s_suppkey AS back, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' END AS topics FROM supplier")
def flashcard_import(spark, sf):
    """Cards written to a file without header and read back."""
    from docloom.sources.files import read_flashcards
    from docloom.sources.shared import fresh_folder

    at = f"{fresh_folder(spark, 'cards')}/cards.csv"
    s = load(spark, sf, "supplier")
    rows = s.select(F.concat_ws("\x1f", F.col("s_suppkey").cast("string"), "s_name").alias("front"), F.concat(F.lit("back, "), F.col("s_suppkey").cast("string")).alias("back"), F.when(F.col("s_suppkey") % 2 == 0, " a  b ").otherwise("").alias("tags"))
    rows.unionByName(rows.limit(3).withColumn("front", F.lit("  "))).write.csv(at, quote='"', escape='"')
    got = read_flashcards(spark, at)
    return got.select(F.split_part("front", F.lit("\x1f"), F.lit(1)).cast("long").alias("id"), F.split_part("front", F.lit("\x1f"), F.lit(2)).alias("front"), "back", F.array_join("topics", ",").alias("topics"))
