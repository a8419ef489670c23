"""Queries of the text functions. Texts without exam marks are wrapped in a template by rule, in the SQL too."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import jsonx, rewrite, scalars
from docloom.plans.registry import query
from docloom.sources import files
from docloom.sources.tables import load


def docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def D():
    return F.col("doc_id")


_HEX = lambda c: F.sha2(c, 256)  # noqa: E731  long texts are compared by digest


def marked(text=None):
    """The text with mark tags in it: some inline, one at its end."""
    t = F.col("text") if text is None else text
    return F.concat(F.lit("Do it ["), (D() % 30).cast("string"), F.lit(" marks] "), t, F.lit(" ("), (D() % 7).cast("string"), F.lit(" marks)"))


_MARKED = "'Do it [' || (doc_id % 30) || ' marks] ' || coalesce(text, '') || ' (' || (doc_id % 7) || ' marks)'"


@query(f"SELECT doc_id, coalesce(list_sum(list_filter([x::INT FOR x IN regexp_extract_all({_MARKED}, '[\\[(]\\s*\\**\\s*([0-9]{{1,2}})\\s*marks?\\s*\\**\\s*[\\])]', 1, 'i')], lambda x: x <= 25)), 0)::INT AS total FROM documents")
def inline_marks_sum(spark, sf):
    return docs(spark, sf).select("doc_id", scalars.inline_marks_sum(marked()).alias("total"))


#: Each text behind or before what a query looks for.
_T_SQL = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query(f"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' x [3 marks] y (' || (doc_id % 40) || ')' ELSE '' END AS t FROM {_T_SQL})
  SELECT doc_id, greatest(1, least(25, coalesce(list_last(regexp_extract_all(t, '(?:\\[\\s*|\\()([0-9]{{1,3}})(?:\\s*marks?)?\\s*[\\])]', 1, 'i'))::INT, 1)))::INT AS marks FROM t""")
def last_mark_clamp(spark, sf):
    t = F.concat("text", F.when(D() % 2 == 0, F.concat(F.lit(" x [3 marks] y ("), (D() % 40).cast("string"), F.lit(")"))).otherwise(""))
    return docs(spark, sf).select("doc_id", scalars.last_mark(t).alias("marks"))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Let $x_' || doc_id || '$ and ' ELSE '' END || text || CASE WHEN doc_id % 3 = 1 THEN ' See $$y' || chr(10) || 'z$$ then $a$' ELSE '' END AS t FROM {_T_SQL})
  SELECT doc_id, sha256(regexp_extract(t, '(?s)(\\$\\$.+?\\$\\$|\\$[^$\\n]+\\$)', 1)) AS math FROM t""")
def first_math(spark, sf):
    t = F.concat(F.when(D() % 3 == 0, F.concat(F.lit("Let $x_"), D().cast("string"), F.lit("$ and "))).otherwise(""), "text", F.when(D() % 3 == 1, " See $$y\nz$$ then $a$").otherwise(""))
    return docs(spark, sf).select("doc_id", _HEX(scalars.first_math(t)).alias("math"))


_KEEP = lambda pieces: f"list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN {pieces}], lambda x: strlen(x) > 20)"


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Intro' || chr(10) || 'Q1. ' || text || chr(10) || '2) And then ' || text WHEN 1 THEN text || '---' || text || '---x' ELSE text END AS t FROM {_T_SQL}),
  p AS (SELECT doc_id, {_KEEP("string_split(regexp_replace(t, '(?m)^((?:Q(?:uestion)?\\s*)?[0-9]{1,2}[.)]\\s)', chr(1) || '\\1', 'g'), chr(1))")} AS numbered, {_KEEP("string_split(t, '---')")} AS ruled, {_KEEP("[t]")} AS whole FROM t),
  k AS (SELECT doc_id, unnest(CASE WHEN len(numbered) > 1 THEN numbered WHEN len(ruled) > 0 THEN ruled ELSE whole END) AS piece, generate_subscripts(CASE WHEN len(numbered) > 1 THEN numbered WHEN len(ruled) > 0 THEN ruled ELSE whole END, 1) - 1 AS i FROM p)
  SELECT doc_id, i::INT AS i, sha256(piece) AS piece FROM k""")
def split_questions(spark, sf):
    """The pieces of each text, by digest."""
    nl = F.lit("\n")
    t = F.when(D() % 3 == 0, F.concat(F.lit("Intro\nQ1. "), "text", nl, F.lit("2) And then "), "text")).when(D() % 3 == 1, F.concat("text", F.lit("---"), "text", F.lit("---x"))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", F.posexplode(scalars.split_questions(t)).alias("i", "piece")).select("doc_id", "i", _HEX("piece").alias("piece"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\f\\v\\r]*\\n[ \\t\\f\\v\\r]*', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def newline_collapse(spark, sf):
    return docs(spark, sf).select("doc_id", _HEX(files.collapse_newlines(F.col("text"))).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, '0 7 . ' || (doc_id % 9) || ' Read ____' || chr(10) || ' 4 ' || chr(10) || text || chr(10) || 'on----' || chr(10) AS t FROM {_T_SQL})
  SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '[_-]{{3,}}', '', 'g'), '(?m)^[ \\t]*[1-6][ \\t]*$\\n?', '', 'g'), '(?m)^0 ([0-9])[ \\t]*\\.[ \\t]*([0-9])', '0\\1.\\2', 'g')) AS page FROM t""")
def page_text_clean(spark, sf):
    t = F.concat(F.lit("0 7 . "), (D() % 9).cast("string"), F.lit(" Read ____\n 4 \n"), "text", F.lit("\non----\n"))
    return docs(spark, sf).select("doc_id", _HEX(files.clean_page(t)).alias("page"))


_KW = scalars.KEYWORDS
_COUNT = {s: " + ".join(f"contains(low, '{w}')::INT" for w in ws) for s, ws in _KW.items()}
_NAMED = lambda i: "CASE WHEN top = 0 OR math < top THEN '{4}' WHEN school AND further THEN '{0}' WHEN school THEN '{1}' WHEN further THEN '{2}' ELSE '{3}' END".format(*(x[i] for x in scalars.MATHS.values()), scalars.OTHER[i])
_MORE = {0: " the gcse integration of a matrix", 1: " further vector, level 2 certificate proof", 2: " enzyme and dna", 3: " velocity", 4: " a quadratic and a further limit", 5: " binary tree array, stack"}


@query(f"""WITH t AS (SELECT doc_id, lower(text || CASE doc_id % 7 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _MORE.items())} ELSE '' END) AS low FROM {_T_SQL}),
  c AS (SELECT doc_id, contains(low, 'further') AS further, {' OR '.join(f"contains(low, '{w}')" for w in scalars.SCHOOL)} AS school, {', '.join(f'{v} AS {k}' for k, v in _COUNT.items())} FROM t), n AS (SELECT *, greatest({', '.join(_COUNT)}) AS top FROM c)
  SELECT doc_id, {_NAMED(0)} AS subject, {_NAMED(1)} AS subtopic, false AS is_code FROM n""")
def keyword_classify(spark, sf):
    more = F.lit("")
    for k, v in _MORE.items():
        more = F.when(D() % 7 == k, v).otherwise(more)
    return docs(spark, sf).select("doc_id", scalars.keyword_class(F.concat("text", more)).alias("c")).select("doc_id", "c.*")


@query("SELECT doc_id, coalesce(regexp_matches(regexp_replace(text, '\\s+$', ''), '([\\[]\\s*[0-9]+\\s*marks?\\s*[\\]]|[.?!)\\]:;$`|])$', 'i'), false) AS done FROM documents")
def terminal_ending(spark, sf):
    return load(spark, sf, "documents").select("doc_id", scalars.terminal_ending(F.col("text")).alias("done"))


@query("SELECT doc_id, sha256('office first fly stop ' || coalesce(text, '')) AS digest FROM documents")
def ligature_clean(spark, sf):
    return docs(spark, sf).select("doc_id", _HEX(scalars.clean_ligatures(F.concat(F.lit("oﬃce ﬁrst ﬂy ﬆop "), "text"))).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, replace(text, chr(10), ' M1 A1ft' || chr(10)) || '  M1' || chr(10) || '  ' || chr(10) || 'answer ' || (doc_id % 5) || ' B2cao ' || chr(10) AS t FROM {_T_SQL})
  SELECT doc_id, sha256(array_to_string(list_filter([trim(regexp_replace(x, '(?:\\s+(?:M|A|B|E|dM)[0-9](?:ft|cao|oe)?)+\\s*$', '')) FOR x IN string_split(t, chr(10))], lambda x: x <> ''), chr(10))) AS scheme FROM t""")
def examiner_codes(spark, sf):
    t = F.concat(F.replace("text", F.lit("\n"), F.lit(" M1 A1ft\n")), F.lit("  M1\n  \nanswer "), (D() % 5).cast("string"), F.lit(" B2cao \n"))
    return docs(spark, sf).select("doc_id", _HEX(scalars.drop_examiner_codes(t)).alias("scheme"))


_FIGURES = "[x::BIGINT FOR x IN regexp_extract_all(t, '\\b(?:figure|fig\\.?)\\s*([0-9]{1,3})', 1, 'i')]"
_PLACES = "len(regexp_extract_all(t, '\\[DIAGRAM_PLACEHOLDER\\]'))::INT"


@query(f"""WITH t AS (SELECT doc_id, 'In Figure ' || (doc_id % 12) || ' ' || text || ' and fig. ' || (doc_id % 7) || repeat('[DIAGRAM_PLACEHOLDER]', doc_id % 3) AS t FROM {_T_SQL}) SELECT doc_id, {_FIGURES} AS refs, {_PLACES} AS places FROM t""")
def figure_refs(spark, sf):
    t = F.concat(F.lit("In Figure "), (D() % 12).cast("string"), F.lit(" "), "text", F.lit(" and fig. "), (D() % 7).cast("string"), F.repeat(F.lit("[DIAGRAM_PLACEHOLDER]"), (D() % 3).cast("int")))
    return docs(spark, sf).select("doc_id", F.transform(scalars.figure_refs(t), lambda x: x.cast("long")).alias("refs"), scalars.placeholders(t).alias("places"))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Figure 1 ' ELSE '' END || text || repeat('[DIAGRAM_PLACEHOLDER]', doc_id % 3) AS t FROM {_T_SQL})
  SELECT doc_id, array_to_string(list_filter([CASE WHEN {_PLACES} <> doc_id % 2 THEN 'placeholders differ from boxes' END, CASE WHEN len({_FIGURES}) > 0 AND doc_id % 2 = 0 THEN 'figures are mentioned without boxes' END], lambda x: x IS NOT NULL), ';') AS errors FROM t""")
def consistency_errors(spark, sf):
    t = F.concat(F.when(D() % 5 == 0, "Figure 1 ").otherwise(""), "text", F.repeat(F.lit("[DIAGRAM_PLACEHOLDER]"), (D() % 3).cast("int")))
    return docs(spark, sf).select("doc_id", F.array_join(scalars.consistency_errors(t, D() % 2), ";").alias("errors"))


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Draw the line on the grid. ' || text WHEN 1 THEN text || chr(10) || 'for i in range(3):' || chr(10) || '  pass' WHEN 2 THEN text || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' WHEN 3 THEN 'Turn over for page 2' ELSE text END AS t FROM {_T_SQL})
  SELECT doc_id, regexp_matches(t, '\\b(draw|plot|sketch)\\b', 'i') AND regexp_matches(t, '\\b(grid|axes)\\b', 'i') AS grid, contains(t, '```') OR regexp_matches(t, '(?m)^\\s*(def|class|for|while|if)\\b.*:\\s*$') AS code,
  len(regexp_extract_all(t, '(?m)^\\s*\\|.*\\|\\s*$')) >= 2 AS "table", length(t) < 80 AND regexp_matches(t, '\\b(page|turn over|copyright)\\b', 'i') AS footer FROM t""")
def content_flags(spark, sf):
    k = D() % 5
    t = F.when(k == 0, F.concat(F.lit("Draw the line on the grid. "), "text")).when(k == 1, F.concat("text", F.lit("\nfor i in range(3):\n  pass"))).when(k == 2, F.concat("text", F.lit("\n| a | b |\n| 1 | 2 |"))).when(k == 3, "Turn over for page 2").otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", scalars.content_flags(t).alias("f")).select("doc_id", "f.grid", "f.code", "f.table", "f.footer")


@query("""SELECT doc_id, round(CASE WHEN strlen(text) = 0 THEN 0 ELSE 0.7 * length(regexp_replace(text, '[ \\t\\n\\v\\f\\r]', '', 'g')) / strlen(text) + 0.3 * least(strlen(replace(text, chr(10), '')) / len(string_split(text, chr(10))) / 80.0, 1.0) END, 6)::DOUBLE AS density FROM documents""")
def text_density(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(scalars.text_density(F.col("text")), 6).alias("density"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) > 300 THEN 'much text' END, CASE WHEN len(regexp_extract_all(text, '\\.')) >= 4 THEN 'sentences' END], lambda x: x IS NOT NULL), ';') AS signals FROM documents""")
def crop_signals(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(scalars.crop_signals(F.col("text")), ";").alias("signals"))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'As Figure 2 shows ' ELSE '' END || text AS t FROM {_T_SQL})
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'full_vision' WHEN doc_id % 2 = 0 OR len({_FIGURES}) > 0 THEN 'crop_first' ELSE 'text_first' END AS route FROM t""")
def extraction_route(spark, sf):
    t = F.concat(F.when(D() % 5 == 0, "As Figure 2 shows ").otherwise(""), "text")
    return docs(spark, sf).select("doc_id", scalars.extraction_route(t, D() % 2 == 0, D() % 3 != 0).alias("route"))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '(a) ' WHEN 1 THEN '(b) ' ELSE '12. ' END || text AS t FROM conversations), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t)
  SELECT conv_id, turn, (starts_with(t, '(a)') AND regexp_matches(prev, '\\([b-z]\\)')) OR (regexp_matches(substr(t, 1, 200), '\\[\\s*[0-9]+\\s*marks?\\s*\\]', 'i') AND length(regexp_replace(substr(t, 1, 200), '[^\\p{L}]', '', 'g')) > 20) OR starts_with(t, '12. ') AS new FROM p WHERE prev IS NOT NULL""")
def new_question_flag(spark, sf):
    from pyspark.sql import Window

    k = F.col("turn") % 3
    t = load(spark, sf, "conversations").withColumn("t", F.concat(F.when(k == 0, "(a) ").when(k == 1, "(b) ").otherwise("12. "), "text"))
    t = t.withColumn("prev", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev is not null")
    return t.select("conv_id", "turn", scalars.new_question(F.col("prev"), F.col("t")).alias("new"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, (doc_id % 5) / 10.0::DOUBLE AS s, (doc_id % 5) / 10.0::DOUBLE + 0.4 AS e, text FROM documents)
  SELECT doc_id, sha256(CASE WHEN len(l) <= 2 THEN text ELSE array_to_string(l[greatest(0, floor(len(l) * (s - 0.06)))::INT + 1 : least(len(l), ceil(len(l) * (e + 0.06)))::INT], chr(10)) END) AS digest FROM l""")
def slice_by_y(spark, sf):
    s = (D() % 5) / F.lit(10.0)
    return docs(spark, sf).select("doc_id", _HEX(scalars.slice_by_y(F.col("text"), s, s + 0.4)).alias("digest"))


@query("SELECT DISTINCT source, regexp_replace(trim(regexp_replace(source || ' / Teil ' || lang || '!', '[^\\p{L}\\p{N} _-]', '_', 'g')), ' ', '_', 'g') AS name FROM documents")
def safe_name(spark, sf):
    return load(spark, sf, "documents").select("source", files.safe_name(F.concat("source", F.lit(" / Teil "), "lang", F.lit("!"))).alias("name")).distinct()


@query("""WITH q AS (SELECT conv_id, turn, text, turn % 5 + 1 AS marks FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM q)
  SELECT conv_id, sha256('Total: ' || sum(marks)::BIGINT || ' marks, ' || round(sum(marks) * 1.2)::BIGINT || ' minutes' || chr(10) || chr(10) || string_agg('## Question ' || i || ' [' || marks || ' marks]' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS digest FROM n GROUP BY conv_id""")
def worksheet_markdown(spark, sf):
    rows = load(spark, sf, "conversations").withColumn("marks", F.col("turn") % 5 + 1)
    return files.worksheet(rows, "conv_id", "turn", "text", "marks").select("conv_id", _HEX(F.col("sheet")).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size >= 11 THEN 2 WHEN p_partkey % 2 = 0 AND p_size >= 5 THEN 1 ELSE 0 END AS pages FROM part")
def worksheet_plan(spark, sf):
    return load(spark, sf, "part").select("p_partkey", files.continuation_pages(F.col("p_size"), F.col("p_partkey") % 2 == 0).alias("pages"))


@query(f"""WITH t AS (SELECT doc_id, text || ' See ![a](img/' || (doc_id % 50) || '/' || (doc_id % 7) || '.png) there' AS t FROM {_T_SQL}), r AS (SELECT DISTINCT unnest(regexp_extract_all(t, '!\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1)) AS ref FROM t), b AS (SELECT ref, regexp_extract(ref, '([^/\\\\]+)$', 1) AS base FROM r),
  n AS (SELECT ref, base, row_number() OVER (PARTITION BY base ORDER BY ref) AS n FROM b) SELECT ref, CASE WHEN n = 1 THEN base ELSE (n - 1) || '-' || base END AS name FROM n""")
def image_refs(spark, sf):
    t = F.concat("text", F.lit(" See ![a](img/"), (D() % 50).cast("string"), F.lit("/"), (D() % 7).cast("string"), F.lit(".png) there"))
    return files.image_refs(docs(spark, sf).select("doc_id", t.alias("t")), "doc_id", "t")


@query("""SELECT doc_id, sha256(text) AS front, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id ELSE '' END AS back, trim(lang || CASE WHEN doc_id % 4 > 1 THEN ' m' || (doc_id % 4) ELSE '' END || ' t' || (doc_id % 3)) AS tags FROM documents""")
def flashcard_export(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("text").alias("content"), F.when(D() % 2 == 0, F.concat(F.lit("a"), D().cast("string"))).alias("answer"), F.col("lang").alias("subject"), F.when(D() % 4 == 0, "Unknown").when(D() % 4 == 1, "General").otherwise(F.concat(F.lit("m"), (D() % 4).cast("string"))).alias("module"), F.array(F.concat(F.lit("t"), (D() % 3).cast("string"))).alias("topics"), "doc_id")
    cards = files.flashcards(rows.withColumn("content", F.concat_ws("\0", D().cast("string"), "content")))
    return cards.select(F.split_part("front", F.lit("\0"), F.lit(1)).cast("long").alias("doc_id"), _HEX(F.split_part("front", F.lit("\0"), F.lit(2))).alias("front"), "back", "tags")


@query(f"""SELECT doc_id, sha256(CASE WHEN doc_id % 4 < 2 THEN '(' || chr((97 + doc_id % 5)::INT) || ') Name it.' ELSE '7.2 V is used.' END || chr(10) || text) AS digest FROM {_T_SQL}""")
def decimal_parts(spark, sf):
    t = F.when(D() % 4 < 2, F.concat(F.lit("7 . "), (D() % 5 + 1).cast("string"), F.lit(" Name it."))).otherwise("7.2 V is used.")
    return docs(spark, sf).select("doc_id", _HEX(rewrite.over(lambda x: rewrite.decimal_parts(x, 7))(F.concat(t, F.lit("\n"), "text"))).alias("digest"))


#: Plain lines, tables and display maths; the tables hold no code and no environments.
@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {_T_SQL}),
  n AS (SELECT *, len(regexp_extract_all(x, '\\$\\$')) % 2 AS odd, starts_with(ltrim(x, ' ' || chr(9)), '|') AS bar FROM l),
  k AS (SELECT *, coalesce(sum(odd) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 OR odd = 1 OR bar AS kept FROM n),
  b AS (SELECT *, lag(x) OVER w AS px, lag(kept) OVER w AS pk FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  SELECT doc_id, sha256(string_agg(CASE WHEN px IS NOT NULL AND regexp_matches(px, '\\S') AND regexp_matches(x, '\\S') AND NOT (kept AND pk) AND NOT bar THEN chr(10) || x ELSE x END, chr(10) ORDER BY i)) AS digest FROM b GROUP BY 1""")
def harden_lines(spark, sf):
    return docs(spark, sf).select("doc_id", _HEX(rewrite.over(rewrite.harden_lines)(F.col("text"))).alias("digest"))


_BOILER_SQL = "(?im)^[ \\t>*_]*(?:" + "|".join(rewrite.BOILERPLATE) + ")\\b.*$\\n?"
_SERIAL_SQL = "(?im)^[ \\t]*(?:\\*?[A-Z]{1,3}[0-9]{5,}[A-Z]?\\*?|[0-9]{5,6}|(?:page\\s+)?[0-9]{1,3}\\s*(?:/|of)\\s*[0-9]{1,3}|page\\s+[0-9]{1,3})[ \\t]*$\\n?"
_LINES_SQL = "(?im)^[ \\t]*(?:[_.\\-]{6,}|answer\\s*[:=]?\\s*[_.]{3,}.*)[ \\t]*$\\n?"


def _collapsed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("WITH t AS (SELECT doc_id, 'Keep ' || (doc_id % 9) || chr(10) || 'Turn over for the next question' || chr(10) || 'Do not write in this box' || chr(10) || text || chr(10) || 'AB12345' || chr(10) || '123456' || chr(10) || '__________' || chr(10) || 'and this.' || chr(10) || 'Blank page' AS t FROM " + _T_SQL + ") SELECT doc_id, sha256("
       + _collapsed(f"regexp_replace(regexp_replace(regexp_replace(t, '{_BOILER_SQL}', '', 'g'), '{_SERIAL_SQL}', '', 'g'), '{_LINES_SQL}', '', 'g')") + ") AS digest FROM t")
def boilerplate_strip(spark, sf):
    t = F.concat(F.lit("Keep "), (D() % 9).cast("string"), F.lit("\nTurn over for the next question\nDo not write in this box\n"), "text", F.lit("\nAB12345\n123456\n__________\nand this.\nBlank page"))
    return docs(spark, sf).select("doc_id", _HEX(rewrite.over(rewrite.strip_boilerplate)(t)).alias("digest"))


def _rewritten(name, f, make, sql=None):
    """Register a rewrite: its digest over every text in a template; ``sql`` says the result where the text itself stays as it is."""

    @query(f"SELECT doc_id, sha256({sql}) AS digest FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)" if sql else None, name=name)
    def run(spark, sf):
        return docs(spark, sf).select("doc_id", _HEX(rewrite.over(f)(make())).alias("digest"))

    return run


def _T():
    return F.col("text")


conditional_heal = _rewritten("conditional_heal", rewrite.heal_polar, lambda: F.concat(F.lit("The curve has polar equation\n3 cos θ\n"), _T()), "'The curve has polar equation' || chr(10) || '$$r = 3 cos θ$$' || chr(10) || text")
latex_sanitize = _rewritten("latex_sanitize", rewrite.latex_sanitize, lambda: F.concat(F.lit("20°C, 5kg, ½ x² ≤ π "), _T()), "regexp_replace('20\\,^{\\circ}\\mathrm{C}, 5\\,kg, \\frac{1}{2} x^{2} \\leq \\pi ' || text, '[ \\t]{2,}', ' ', 'g')")
relocate_marks = _rewritten("relocate_marks", rewrite.relocate_marks, lambda: F.concat(F.lit("(a) Find [2 marks] x\n(b) "), _T()), "regexp_replace('(a) Find  x [2 marks]' || chr(10) || '(b) ' || text, '\\s+$', '')")
latex_format = _rewritten("latex_format", rewrite.latex_format, lambda: F.concat(F.lit("**bold** $a_1$ *it* 5% "), _T()))
marker_cleanup = _rewritten("marker_cleanup", rewrite.marker_cleanup, lambda: F.concat(F.lit("Turn over\n7.1 Do\n\\ frac{1}{2}\n[3 marks]\n"), _T()), _collapsed(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('(a) Do' || chr(10) || '\\frac{{1}}{{2}}' || chr(10) || chr(10) || text, '{_BOILER_SQL}', '', 'g'), '{_SERIAL_SQL}', '', 'g'), '(?mi)^(?:Q[0-9]{{1,3}}\\.?|[0-9] [0-9] )\\s*', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\s+$', '') || ' [3 marks]'"))
mcq_options = _rewritten("mcq_options", rewrite.mcq_options, lambda: F.concat(F.lit("Which? A) one B) two C) three D) four\n"), _T()), "array_to_string(['Which?', '', '- **A** one', '', '- **B** two', '', '- **C** three', '', '- **D** four', text], chr(10))")
table_from_columns = _rewritten("table_from_columns", rewrite.table_from_columns, lambda: F.concat(F.lit("speed  mass\nA 1  2\nB 3  4\nC 5  6\n"), _T()), "array_to_string(['| | speed | mass |', '|---|---|---|', '| **A** | 1 | 2 |', '| **B** | 3 | 4 |', '| **C** | 5 | 6 |', text], chr(10))")
table_repair = _rewritten("table_repair", rewrite.table_repair, lambda: F.concat(F.lit("x\n| a | b |\n| 1 | 2 |\n"), _T()), "array_to_string(['x', '', '| a | b |', '|---|---|', '| 1 | 2 |'], chr(10)) || chr(10) || CASE WHEN regexp_matches(text, '^[^\\n]*\\S') THEN chr(10) ELSE '' END || text")
heal_delimiters = _rewritten("heal_delimiters", rewrite.heal_delimiters, lambda: F.concat(F.lit("\\begin{align}a $$b$ "), _T()))


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(CASE doc_id % 3 WHEN 0 THEN 'y = x^2 + ' || doc_id WHEN 1 THEN text ELSE 'a = b + 3 - 2 * c < ' || text END, '^\\s+|\\s+$', '', 'g') AS s FROM {_T_SQL}),
  n AS (SELECT doc_id, s, len(list_filter(regexp_extract_all(s, '[\\\\\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{3,}}'))) AS words, len(regexp_extract_all(regexp_replace(s, '([0-9])', '\\1\\1', 'g'), '\\\\[a-zA-Z]+|[=+^_<>]|[0-9]\\s*[-*/]\\s*[\\p{{L}}\\p{{N}}_]')) AS signs FROM t)
  SELECT doc_id, s <> '' AND NOT (ends_with(s, '.') AND words > 4) AND signs >= words AND (signs >= 2 OR regexp_matches(s, '\\\\(?:frac|sqrt|int|sum|begin)\\b')) AS equation FROM n""")
def equation_flag(spark, sf):
    t = F.when(D() % 3 == 0, F.concat(F.lit("y = x^2 + "), D().cast("string"))).when(D() % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("a = b + 3 - 2 * c < "), "text"))
    return docs(spark, sf).select("doc_id", scalars.likely_equation(t).alias("equation"))


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {_T_SQL}),
  k AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p), f AS (SELECT *, before IS NOT NULL AND trim(p) = trim(before) AND length(trim(p)) > 30 AS drop FROM k)
  SELECT doc_id, count(*) FILTER (drop) AS dropped, sha256(coalesce(string_agg(p, chr(10) ORDER BY i) FILTER (NOT drop), '')) AS digest FROM f GROUP BY 1""")
def paragraph_dedupe(spark, sf):
    """The texts without lines that repeat the one before, by digest, and how many went."""
    kept = scalars.drop_repeated_lines(F.col("text"))
    size = lambda c: F.size(F.split(c, "\n"))
    return docs(spark, sf).withColumn("kept", kept).select("doc_id", (size("text") - size("kept")).cast("long").alias("dropped"), _HEX("kept").alias("digest"))


def json_text(text=None):
    """The text as a JSON string."""
    j = F.to_json(F.struct((F.col("text") if text is None else text).alias("v")))
    return F.substring(j, F.lit(6), F.length(j) - 6)


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM {_T_SQL})
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN greatest(0, least(100, doc_id % 200 - 20)) WHEN 1 THEN 6 WHEN 2 THEN CASE WHEN length(d) > 9 THEN 100 WHEN d <> '' THEN least(100, d::BIGINT) END WHEN 3 THEN 100 ELSE NULL END::BIGINT AS v FROM t""")
def coerce_marks(spark, sf):
    k = D() % 6
    raw = F.when(k == 0, (D() % 200 - 20).cast("string")).when(k == 1, "6.0").when(k == 2, json_text()).when(k == 3, '"3 of 12"').when(k == 4, "null").otherwise(F.concat(F.lit("["), json_text(), F.lit("]")))
    return docs(spark, sf).select("doc_id", jsonx.to_marks(raw).alias("v"))


_NUMBERS = ['"Q.9"', '"5b"', '"0 7"', '"2,3"', '"0 1.1"', '"01 5"', '"Question 4"', '"3.5 V"', '" 0 10 "', '"12-"', "2.4", "2.25", "1001"]
_READ = [9, 5, 7, None, 1, 1, 4, None, 10, 12, 2, None, None]


@query(f"""SELECT doc_id, CASE doc_id % 15 {' '.join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(_READ))} WHEN 13 THEN CASE WHEN doc_id % 1200 BETWEEN 1 AND 1000 THEN doc_id % 1200 END
  ELSE CASE WHEN regexp_full_match(trim(text), '[0-9]{{1,3}}[a-z.)]?') THEN nullif(regexp_extract(text, '[0-9]+')::BIGINT, 0) END END::BIGINT AS v FROM {_T_SQL}""")
def coerce_number(spark, sf):
    k = D() % 15
    raw = F.when(k == 13, (D() % 1200).cast("string")).otherwise(json_text())
    for i, x in enumerate(_NUMBERS):
        raw = F.when(k == i, x).otherwise(raw)
    return docs(spark, sf).select("doc_id", jsonx.to_number(raw).alias("v"))


@query(f"""SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN array_to_string(list_filter(['x', trim(text), 'y'], lambda x: x <> ''), ',') WHEN 1 THEN trim(text) ELSE '' END) AS v FROM {_T_SQL}""")
def coerce_topics(spark, sf):
    k = D() % 3
    raw = F.when(k == 0, F.concat(F.lit('[" x ", "", '), json_text(), F.lit(', "y"]'))).when(k == 1, json_text()).otherwise("5")
    return docs(spark, sf).select("doc_id", _HEX(F.array_join(jsonx.to_topics(raw), ",")).alias("v"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'salvaged' WHEN 2 THEN 'salvaged' ELSE 'malformed' END AS status, doc_id % 4 = 1 AS dropped_tail, CASE doc_id % 4 WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 1 END::INT AS items FROM documents""")
def json_salvage(spark, sf):
    """Replies that hold each text as an item: whole, cut off, followed by words, and no JSON at all."""
    k = D() % 4
    one = F.concat(F.lit('{"items":[{"t":'), json_text())
    raw = F.when(k == 0, F.concat(one, F.lit("}]}"))).when(k == 1, F.concat(one, F.lit('},{"t":2},{"t":'), F.substring(json_text(), 1, 5))).when(k == 2, F.concat(one, F.lit("}]} bye"))).otherwise(F.concat(F.lit("sorry "), F.translate("text", "[{", "")))
    o = docs(spark, sf).select("doc_id", jsonx.salvaged(raw).alias("o"))
    return o.select("doc_id", "o.status", "o.dropped_tail", F.coalesce(F.json_array_length(F.get_json_object("o.value", "$.items")), F.lit(0)).alias("items"))


@query(f"""WITH t AS (SELECT doc_id, 'Sure: ["t' || (doc_id % 9) || '"] is it. ' || text AS t FROM {_T_SQL}) SELECT doc_id, sha256(regexp_extract(t, '(?s)(\\[.*\\])', 1)) AS found FROM t""")
def json_array_extract(spark, sf):
    raw = F.concat(F.lit('Sure: ["t'), (D() % 9).cast("string"), F.lit('"] is it. '), "text")
    return docs(spark, sf).select("doc_id", _HEX(jsonx.array_in_prose(raw)).alias("found"))


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || 'A [DIAGRAM_PLACEHOLDER]' || chr(10) || 'B) [DIAGRAM_PLACEHOLDER]' WHEN 1 THEN '[DIAGRAM_PLACEHOLDER] ' || text || ' [DIAGRAM_PLACEHOLDER]' ELSE text END AS t FROM {_T_SQL}),
  l AS (SELECT *, string_split(t, chr(10)) AS l, string_split(t, '[DIAGRAM_PLACEHOLDER]') AS p FROM t), m AS (SELECT *, [regexp_matches(x, '^\\s*[ABCD]\\s*(?:$|\\[DIAGRAM_PLACEHOLDER\\]|[).:])') FOR x IN l] AS m FROM l),
  f AS (SELECT *, regexp_replace(array_to_string(l[1 : list_position(m, true) - 1], chr(10)), '\\s+$', '') AS lead FROM m)
  SELECT doc_id, sha256(CASE WHEN len(list_filter(m, lambda x: x)) >= 2 AND len(p) > 1 THEN CASE WHEN lead = '' THEN '' ELSE lead || chr(10) END || '[DIAGRAM_PLACEHOLDER]'
    WHEN len(p) > 2 THEN regexp_replace(p[1] || '[DIAGRAM_PLACEHOLDER]' || array_to_string(p[2:], ''), '^\\s+|\\s+$', '', 'g') ELSE t END) AS digest FROM f""")
def composite_options(spark, sf):
    """Questions whose options are pictures, with one placeholder for all of them."""
    k, p = D() % 3, F.lit("[DIAGRAM_PLACEHOLDER]")
    t = F.when(k == 0, F.concat("text", F.lit("\nA "), p, F.lit("\nB) "), p)).when(k == 1, F.concat(p, F.lit(" "), "text", F.lit(" "), p)).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", _HEX(scalars.composite_options(t)).alias("digest"))


@query("""SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS digest, sum(turn)::BIGINT AS marks, min_by(role, turn) AS first_role FROM conversations GROUP BY conv_id""")
def merge_items(spark, sf):
    """Parts of one item joined in order: contents, the sum of marks, the first scalars."""
    from docloom.operators import bank

    rows = load(spark, sf, "conversations").withColumn("marks", F.col("turn"))
    return bank.merge_parts(rows, ["conv_id"], ["turn", "text"], "text", "marks", ["role"]).select("conv_id", _HEX("text").alias("digest"), "marks", "first_role")


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations), c AS (SELECT conv_id, turn, w, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT conv_id, turn, sum(n) AS n FROM c GROUP BY ALL)
  SELECT a.conv_id, a.turn FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE coalesce((SELECT sum(least(x.n, y.n)) FROM c x JOIN c y ON x.w = y.w WHERE x.conv_id = a.conv_id AND x.turn = a.turn AND y.conv_id = b.conv_id AND y.turn = b.turn), 0) >= 0.85 * least(a.n, b.n)""")
def multiset_duplicates(spark, sf):
    """Neighbouring turns of which the later repeats the earlier: common words, each as often, at least 85 % of the shorter."""
    w = load(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("w"))
    c = w.groupBy("conv_id", "turn", "w").agg(F.count("*").alias("n"))
    s = c.groupBy("conv_id", "turn").agg(F.sum("n").alias("size"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "w", F.col("n").alias("m"))
    common = c.join(nxt, ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("common"))
    b = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("size").alias("size2"))
    return s.join(b, ["conv_id", "turn"]).join(common, ["conv_id", "turn"]).filter(F.col("common") >= 0.85 * F.least("size", "size2")).select("conv_id", "turn")
