"""Queries of the relational layer: feed, bank, taxonomy, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import bank, costs, feed, taxonomy
from docloom.plans.registry import query
from docloom.sources.tables import ITEMS_SQL, items, load

W = f"WITH {ITEMS_SQL} "


# ---- scans, lookups, feed

@query(W + "SELECT seq, subject, coalesce(module, '') AS module, coalesce(question_number, -1) AS question_number, row_number() OVER (ORDER BY seq DESC) AS position FROM items")
def feed_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed.defaults(items(spark, sf), {"module": "", "question_number": -1})
    return feed.newest_first(rows.select("seq", "subject", "module", "question_number"))


@query(W + "SELECT pos::INT AS pos, id, marks FROM items JOIN (VALUES (0,'d5'),(1,'d3'),(2,'nope'),(3,'d100'),(4,'d7')) v(pos, wanted) ON id = wanted")
def ordered_lookup(spark, sf):
    return feed.ordered_lookup(items(spark, sf), ["d5", "d3", "nope", "d100", "d7"], "id").select("pos", "id", "marks")


@query(W + "SELECT seq, question_number, row_number() OVER (ORDER BY question_number ASC NULLS FIRST, seq) AS place FROM items WHERE paper_name = 'src3'")
def paper_scan(spark, sf):
    rows = items(spark, sf).filter("paper_name = 'src3'").select("seq", "question_number")
    return feed.numbered(rows, F.col("question_number").asc_nulls_first(), F.col("seq"), name="place")


CORPUS = ("subject", "module", "content", "paper_name", "topics")


def _corpus_rows(spark, sf):
    return items(spark, sf).withColumn("topics", F.concat_ws(",", "topics"))


_CORPUS_SQL = "lower(coalesce(subject,'') || ' ' || coalesce(module,'') || ' ' || coalesce(content,'') || ' ' || coalesce(paper_name,'') || ' ' || array_to_string(topics, ','))"


@query(W + f"SELECT seq, subject FROM items WHERE contains({_CORPUS_SQL}, 'worth')")
def feed_search(spark, sf):
    return feed.search(_corpus_rows(spark, sf), "  WORTH ", *CORPUS).select("seq", "subject")


@query(W + f"""SELECT seq, subject, paper_name, marks, needs_review FROM items WHERE contains({_CORPUS_SQL}, 'the')
  AND (needs_review OR answer_stale) AND marks BETWEEN 3 AND 5""")
def feed_filter(spark, sf):
    """The feed with term, review state and marks band in one plan."""
    rows = feed.search(_corpus_rows(spark, sf), "the", *CORPUS)
    rows = rows.filter(feed.review_state(F.col("needs_review"), F.col("answer_stale"), "Needs review") & (feed.marks_band(F.col("marks")) == "3-5"))
    return rows.select("seq", "subject", "paper_name", "marks", "needs_review")


@query(W + "SELECT seq, subject FROM items ORDER BY seq DESC LIMIT 60")
def feed_page(spark, sf):
    """The second page size of the feed (the limit is the feature)."""
    return items(spark, sf).orderBy(F.desc("seq")).limit(feed.NEXT_PAGE).select("seq", "subject")


@query(W + "SELECT count(*) AS n, sum(marks)::BIGINT AS marks FROM items WHERE marks BETWEEN 1 AND 2")
def feed_totals(spark, sf):
    return items(spark, sf).filter(feed.marks_band(F.col("marks")) == "1-2").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"))


@query("""SELECT n_nationkey AS id, coalesce(s1.r_name, s2.r_name, v) AS resolved FROM
  (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_regionkey::VARCHAR WHEN 1 THEN 'asia' ELSE n_name END AS v FROM nation) n
  LEFT JOIN region s1 ON s1.r_regionkey::VARCHAR = v LEFT JOIN region s2 ON lower(s2.r_name) = lower(v)""")
def subject_resolve(spark, sf):
    nations = load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey").cast("string")).when(F.col("n_nationkey") % 3 == 1, F.lit("asia")).otherwise(F.col("n_name")).alias("v"))
    regions = load(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return feed.resolve(nations, regions, "v", "resolved").select("id", "resolved")


@query("""SELECT coalesce(CASE WHEN p_size BETWEEN 1 AND 2 THEN '1-2' WHEN p_size BETWEEN 3 AND 5 THEN '3-5' WHEN p_size >= 6 THEN '6+' END, 'none') AS band,
  count(*) AS n, sum(p_size)::BIGINT AS marks FROM part GROUP BY 1""")
def marks_bands(spark, sf):
    band = F.coalesce(feed.marks_band(F.col("p_size")), F.lit("none")).alias("band")
    return load(spark, sf, "part").groupBy(band).agg(F.count("*").alias("n"), F.sum("p_size").alias("marks"))


@query(W + "SELECT seq FROM items WHERE list_has_any(topics, ['t1', 'u3'])")
def topic_overlap(spark, sf):
    return items(spark, sf).filter(feed.any_topic(F.col("topics"), ["t1", "u3"])).select("seq")


@query(W + """SELECT seq, module FROM items WHERE CASE WHEN module IS NOT NULL AND module NOT IN ('Unknown', 'General', '') THEN module = 'm2'
  WHEN len(topics) > 0 THEN list_has_any(topics, ['t2', 't5']) ELSE true END""")
def module_fallback(spark, sf):
    return items(spark, sf).filter(feed.in_module(F.col("module"), F.col("topics"), "m2", ["t2", "t5"])).select("seq", "module")


@query(W + "SELECT seq FROM items WHERE NOT (needs_review OR answer_stale)")
def review_filter(spark, sf):
    return items(spark, sf).filter(feed.review_state(F.col("needs_review"), F.col("answer_stale"), "Clean")).select("seq")


@query(W + "SELECT DISTINCT trim(paper_name) AS paper FROM items WHERE trim(coalesce(paper_name, '')) <> ''")
def distinct_papers(spark, sf):
    return items(spark, sf).select(F.trim("paper_name").alias("paper")).filter("paper is not null and paper <> ''").distinct()


@query(W + "SELECT DISTINCT unnest(topics) AS topic FROM items")
def distinct_topics(spark, sf):
    return items(spark, sf).select(F.explode("topics").alias("topic")).distinct()


@query(W + "SELECT seq, array_to_string(list_sort(list_distinct(list_filter(topics, lambda x: list_contains(['t0', 't1', 'u1', 'u2'], x)))), ',') AS kept FROM items")
def topic_containment(spark, sf):
    return items(spark, sf).select("seq", F.concat_ws(",", feed.contained(F.col("topics"), ["t0", "t1", "u1", "u2"])).alias("kept"))


@query("""WITH c AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier WHERE s_nationkey = 3),
  a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey DESC) AS pos FROM supplier WHERE s_nationkey IN (3, 4, 5))
  SELECT id, pos FROM c UNION ALL SELECT id, (SELECT coalesce(max(pos), 0) FROM c) + row_number() OVER (ORDER BY pos, id) FROM a WHERE id NOT IN (SELECT id FROM c)""")
def ordered_append(spark, sf):
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    chosen = feed.numbered(s.filter("s_nationkey = 3").select("id"), F.col("id"), name="pos")
    added = feed.numbered(s.filter("s_nationkey in (3, 4, 5)").select("id"), F.col("id").desc(), name="pos")
    return feed.append_new(chosen, added)


@query(W + "SELECT sum(marks)::BIGINT AS total_marks, round(sum(marks) * 1.2)::BIGINT AS minutes, least(round(sum(marks) * 100.0 / 5000), 100)::BIGINT AS progress FROM items WHERE paper_name = 'src1'")
def worksheet_totals(spark, sf):
    return feed.worksheet_totals(items(spark, sf).filter("paper_name = 'src1'"), "marks", 5000)


# ---- taxonomy

def _forest(spark, sf):
    s = load(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    m = load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("subject_id"), F.col("n_name").alias("name"))
    t = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("module_id"), F.col("s_name").alias("name"))
    return s, m, t


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def module_subject_join(spark, sf):
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query("""WITH m AS (SELECT n_regionkey, n_name || '[' || coalesce((SELECT string_agg(s_name, ',' ORDER BY s_name, s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') || ']' AS x, n_name, n_nationkey FROM nation)
  SELECT r_regionkey AS id, r_name AS name, coalesce((SELECT string_agg(x, ';' ORDER BY n_name, n_nationkey) FROM m WHERE n_regionkey = r_regionkey), '') AS modules FROM region""")
def taxonomy_tree(spark, sf):
    return taxonomy.tree(*_forest(spark, sf)).select("id", "name", _shown("modules"))


def _shown(modules: str):
    one = lambda m: F.concat(m["name"], F.lit("["), F.array_join(F.transform(m["topics"], lambda t: t["name"]), ","), F.lit("]"))
    return F.array_join(F.transform(modules, one), ";").alias("modules")


@query("""WITH t AS (SELECT s_nationkey, s_suppkey, s_name FROM supplier), m AS (SELECT n_regionkey, n_nationkey, n_name, contains(lower(n_name), 'a0') AS own,
  (SELECT string_agg(s_name, ',' ORDER BY s_name, s_suppkey) FROM t WHERE s_nationkey = n_nationkey) AS every,
  (SELECT string_agg(s_name, ',' ORDER BY s_name, s_suppkey) FROM t WHERE s_nationkey = n_nationkey AND contains(lower(s_name), '007')) AS hits FROM nation)
  SELECT r_regionkey AS id, r_name AS name, string_agg(n_name || '[' || coalesce(hits, every, '') || ']', ';' ORDER BY n_name, n_nationkey) AS modules
  FROM region JOIN m ON n_regionkey = r_regionkey WHERE hits IS NOT NULL OR contains(lower(n_name), '007') GROUP BY 1, 2""")
def taxonomy_search(spark, sf):
    return taxonomy.search(taxonomy.tree(*_forest(spark, sf)), "007").select("id", "name", _shown("modules"))


@query("SELECT (SELECT count(*) FROM region) AS n_subjects, (SELECT count(*) FROM nation) AS n_modules, (SELECT count(*) FROM supplier) AS n_topics")
def taxonomy_counts(spark, sf):
    return taxonomy.counts(*_forest(spark, sf))


@query("""SELECT 'topic' AS level, s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey NOT IN (1, 2)
  UNION ALL SELECT 'module', n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 2) UNION ALL SELECT 'subject', r_regionkey FROM region WHERE r_regionkey NOT IN (1, 2)""")
def taxonomy_cascade(spark, sf):
    parts = taxonomy.cascade(*_forest(spark, sf), [1, 2])
    named = [p.select(F.lit(n).alias("level"), F.col("id").cast("long").alias("id")) for p, n in zip(parts, ("subject", "module", "topic"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


# ---- bank

_DEDUPE = "row_number() OVER (PARTITION BY paper_name, question_number ORDER BY seq DESC) = 1"


@query(W + f"SELECT seq, paper_name, question_number FROM items WHERE question_number IS NULL OR trim(coalesce(paper_name, '')) = '' UNION ALL SELECT seq, paper_name, question_number FROM items WHERE question_number IS NOT NULL AND trim(coalesce(paper_name, '')) <> '' QUALIFY {_DEDUPE}")
def dedupe_latest(spark, sf):
    return bank.dedupe_latest(items(spark, sf).select("seq", "paper_name", "question_number"), "paper_name", "question_number", "seq")


def _logs(spark, sf):
    """One log for each label: named as a document's source with 'MS:' before every third, some of papers that no item has."""
    d = F.col("doc_id")
    name = F.concat(F.when(d % 3 == 0, "MS:").otherwise(""), F.lit("src"), (d % 31).cast("string"))
    return load(spark, sf, "labels").select(d.alias("log_id"), name.alias("paper"), F.col("quality"))


_LOGS = "logs AS (SELECT doc_id AS log_id, CASE WHEN doc_id % 3 = 0 THEN 'MS:' ELSE '' END || 'src' || (doc_id % 31) AS paper, quality FROM labels)"


@query(W + f", {_LOGS} SELECT log_id, paper FROM logs WHERE EXISTS (SELECT 1 FROM items i WHERE i.paper_name = logs.paper OR (starts_with(logs.paper, 'MS:') AND i.paper_name = substr(logs.paper, 4)))")
def prune_orphans(spark, sf):
    return bank.prune_orphans(_logs(spark, sf), items(spark, sf), "paper", "paper_name").select("log_id", "paper")


@query(W + f""", {_LOGS}, gone AS (SELECT * FROM items WHERE paper_name IN ('src2', 'src4') AND NOT (paper_name = 'src4' AND seq % 2 = 0)), rest AS (SELECT * FROM items WHERE id NOT IN (SELECT id FROM gone)),
  emptied AS (SELECT DISTINCT paper_name AS p FROM gone WHERE paper_name NOT IN (SELECT DISTINCT paper_name FROM rest WHERE paper_name IS NOT NULL))
  SELECT 'item' AS kind, seq AS id FROM rest UNION ALL SELECT 'log', log_id FROM logs WHERE paper NOT IN (SELECT p FROM emptied UNION ALL SELECT 'MS:' || p FROM emptied) UNION ALL SELECT 'left of all', 0""")
def delete_cascade(spark, sf):
    """Whole papers and parts of papers deleted by id: a paper that lost its last item takes its logs along. And all items deleted,
    after which no log is left."""
    every, logs = items(spark, sf), _logs(spark, sf)
    doomed = every.filter("paper_name in ('src2', 'src4') and not (paper_name = 'src4' and seq % 2 = 0)").select("id")
    left, kept = bank.delete_with_cascade(every, logs, doomed, "id", "paper_name", "paper")
    none = bank.delete_with_cascade(every, logs, every.select("id"), "id", "paper_name", "paper")
    rest = none[0].select("id").unionByName(none[1].select(F.col("log_id").cast("string").alias("id"))).agg(F.lit("left of all").alias("kind"), F.count("*").alias("id"))
    return left.select(F.lit("item").alias("kind"), F.col("seq").alias("id")).unionByName(kept.select(F.lit("log").alias("kind"), F.col("log_id").alias("id"))).unionByName(rest)


@query(W + """ SELECT id, marks, array_to_string(topics, ',') AS topics, paper_name FROM items UNION ALL SELECT 'new' || doc_id, quality, '', NULL FROM labels""")
def bank_insert(spark, sf):
    """New items without topics and papers join the bank."""
    new = load(spark, sf, "labels").select(F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("id"), F.col("quality").cast("long").alias("marks"), F.lit(None).cast("array<string>").alias("topics"))
    out = bank.insert(items(spark, sf).select("id", "marks", "topics", "paper_name"), new)
    return out.select("id", "marks", F.concat_ws(",", "topics").alias("topics"), "paper_name")


@query("SELECT 'items' AS name, 0::BIGINT AS n UNION ALL SELECT 'logs', 0 UNION ALL SELECT 'labels', 0")
def delete_all(spark, sf):
    tables = bank.emptied(items(spark, sf), _logs(spark, sf), load(spark, sf, "labels"))
    out = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in zip(("items", "logs", "labels"), tables)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_LOGS} SELECT log_id, paper FROM logs WHERE log_id <> (SELECT min(log_id) FROM logs)")
def drop_log(spark, sf):
    """The logs without one of them."""
    logs = _logs(spark, sf)
    return bank.drop_log(logs, "log_id", logs.agg(F.min("log_id")).first()[0]).select("log_id", "paper")


@query(W + "SELECT seq, subject, marks, array_to_string(topics, ',') AS topics, (SELECT count(*) FROM items) AS n_items, false AS newer_is_read FROM items")
def backup_gate(spark, sf):
    """A backup written, its manifest read, the items read back; one of a newer format is refused."""
    from docloom.sources import files
    from docloom.sources.shared import fresh_folder

    at = fresh_folder(spark, "backup")
    rows = items(spark, sf).select("seq", "subject", "marks", "topics")
    files.write_backup(rows, at, 0)
    n = files.read_manifest(spark, at)["n_items"]
    back = files.read_backup(spark, at, rows.schema)
    newer = fresh_folder(spark, "backup")
    spark.range(1).select(F.lit(files.BACKUP_VERSION + 1).alias("formatVersion"), F.lit(0).alias("created_at"), F.lit(0).alias("n_items")).write.json(f"{newer}/manifest")
    try:
        files.read_manifest(spark, newer)
        read = True
    except ValueError:
        read = False
    return back.select("seq", "subject", "marks", F.concat_ws(",", "topics").alias("topics"), F.lit(n).alias("n_items"), F.lit(read).alias("newer_is_read"))


@query("SELECT source, count(*) AS n, count(*) AS again FROM documents GROUP BY 1")
def cache_table(spark, sf):
    """A table made once under a fingerprint and read from then on."""
    from docloom.sources import files
    from docloom.sources.shared import fresh_folder

    at = fresh_folder(spark, "cache")
    docs = load(spark, sf, "documents")
    first = files.cached(spark, at, "sources", lambda: docs.groupBy("source").agg(F.count("*").alias("n")))
    again = files.cached(spark, at, "sources", lambda: docs.limit(0).groupBy("source").agg(F.count("*").alias("n")))
    return first.join(again.withColumnRenamed("n", "again"), "source")


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey // 8 AS paper, c_custkey % 8 + 1 AS place, CASE WHEN c_custkey % 3 = 0 THEN 'Q' || (c_custkey % 8 + 1) || '. text' ELSE 'text' END AS content, 'answer ' || c_custkey AS answer FROM customer)
  SELECT k, CASE place WHEN 2 THEN coalesce((SELECT s.answer FROM r s WHERE s.paper = r.paper AND s.place = 5), answer) WHEN 5 THEN coalesce((SELECT s.answer FROM r s WHERE s.paper = r.paper AND s.place = 2), answer) ELSE answer END AS answer FROM r""")
def answer_swap(spark, sf):
    """In each paper the second question swaps its answer with the question of number 5."""
    c = F.col("c_custkey")
    place = c % 8 + 1
    content = F.when(c % 3 == 0, F.concat(F.lit("Q"), place.cast("string"), F.lit(". text"))).otherwise("text")
    rows = load(spark, sf, "customer").select(c.alias("k"), F.floor(c / 8).alias("paper"), place.alias("place"), content.alias("content"), F.concat(F.lit("answer "), c.cast("string")).alias("answer"))
    swaps = rows.filter("place = 2").select("k", F.lit(5).cast("long").alias("number"))
    return bank.swap_answers(rows, swaps, "k", "paper", "content", "place", "answer").select("k", "answer")


@query(W + f", {_LOGS} SELECT 'item' AS kind, seq AS id FROM items WHERE paper_name <> 'src3' OR paper_name IS NULL UNION ALL SELECT 'log', log_id FROM logs WHERE paper NOT IN ('src3', 'MS:src3')")
def delete_group(spark, sf):
    left, logs = bank.delete_group(items(spark, sf), _logs(spark, sf), "src3", "paper_name", "paper")
    return left.select(F.lit("item").alias("kind"), F.col("seq").alias("id")).unionByName(logs.select(F.lit("log").alias("kind"), F.col("log_id").alias("id")))


@query(W + """, p AS (SELECT doc_id AS seq, CASE WHEN quality = 0 THEN 'patched' END AS module, 7 + toxic AS marks FROM labels)
  SELECT i.seq, coalesce(p.module, i.module) AS module, CASE WHEN p.seq IS NULL THEN i.marks ELSE p.marks END AS marks, CASE WHEN p.seq IS NULL THEN i.needs_review ELSE false END AS needs_review
  FROM items i LEFT JOIN p ON p.seq = i.seq""")
def patch_update(spark, sf):
    p = load(spark, sf, "labels").select(F.col("doc_id").alias("seq"), F.when(F.col("quality") == 0, "patched").alias("module"), (F.col("toxic") + 7).cast("long").alias("marks"))
    out = bank.patch(items(spark, sf).select("seq", "module", "marks", "needs_review"), p, "seq", ["module"], ["marks"], {"needs_review": False})
    return out


@query("""SELECT d.doc_id AS seq, CASE WHEN l.doc_id IS NOT NULL THEN 'new' || l.quality ELSE CASE WHEN d.doc_id % 2 = 0 THEN 'old' END END AS answer,
  CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id % 2 = 0 ELSE false END AS stale FROM documents d LEFT JOIN labels l USING (doc_id)""")
def answer_commit(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 2 == 0, "old").alias("answer"), F.lit(False).alias("stale"))
    a = load(spark, sf, "labels").select(F.col("doc_id").alias("seq"), F.concat(F.lit("new"), F.col("quality").cast("string")).alias("answer"))
    return bank.commit_answers(d, a, "seq", "answer", "stale")


@query(W + "SELECT seq, coalesce(module, 'General') AS module, coalesce(question_number, 0) AS question_number, '' AS snippet FROM items")
def null_sanitize(spark, sf):
    return feed.defaults(items(spark, sf).select("seq", "module", "question_number"), {"module": "General", "question_number": 0}).withColumn("snippet", F.lit(""))


def _sides(spark, sf):
    i = items(spark, sf)
    i = bank.dedupe_latest(i.filter("question_number is not null and paper_name is not null"), "paper_name", "question_number", "seq")
    old = i.filter("seq % 3 <> 0").select("id", "paper_name", "question_number", "marks", "module", "topics")
    # every second number in another storage order: the same key under another id
    new = i.filter("seq % 2 = 0").select(F.concat(F.lit("b"), F.col("id")).alias("id"), "paper_name", "question_number", (F.col("marks") + 1).alias("marks"), "module", F.when(F.col("seq") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("topics")).alias("topics"))
    return old, new


_SIDES = """, latest AS (SELECT * FROM items WHERE question_number IS NOT NULL AND paper_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_name, question_number ORDER BY seq DESC) = 1),
  o AS (SELECT id, paper_name, question_number, marks, module, topics FROM latest WHERE seq % 3 <> 0),
  n AS (SELECT 'b' || id AS id, paper_name, question_number, marks + 1 AS marks, module, CASE WHEN seq % 4 = 0 THEN []::VARCHAR[] ELSE topics END AS topics FROM latest WHERE seq % 2 = 0)"""


@query(W + _SIDES + """ SELECT coalesce(o.id, n.id) AS id, coalesce(o.paper_name, n.paper_name) AS paper_name, coalesce(o.question_number, n.question_number) AS question_number, coalesce(n.marks, o.marks) AS marks,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.paper_name = n.paper_name AND o.question_number = n.question_number""")
def upsert_merge(spark, sf):
    old, new = _sides(spark, sf)
    return bank.upsert(old, new, ["paper_name", "question_number"], ["marks"]).select("id", "paper_name", "question_number", "marks", "change")


@query(W + _SIDES + """ SELECT change, count(*) AS n, sum(marks)::BIGINT AS marks FROM (SELECT coalesce(n.marks, o.marks) AS marks,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.paper_name = n.paper_name AND o.question_number = n.question_number) GROUP BY 1""")
def backup_merge(spark, sf):
    """The counts that a merge reports."""
    old, new = _sides(spark, sf)
    return bank.upsert(old, new, ["paper_name", "question_number"], ["marks"]).groupBy("change").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"))


@query(W + _SIDES + """ SELECT coalesce(o.id, n.id) AS id, coalesce(n.marks, o.marks) AS marks, coalesce(n.module, o.module) AS module,
  array_to_string(CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR len(n.topics) > 0) THEN n.topics ELSE o.topics END, ',') AS topics FROM o FULL JOIN n ON o.paper_name = n.paper_name AND o.question_number = n.question_number""")
def import_upsert(spark, sf):
    old, new = _sides(spark, sf)
    return bank.import_upsert(old, new, ["paper_name", "question_number"], ["marks"]).select("id", "marks", "module", F.concat_ws(",", "topics").alias("topics"))


@query("""WITH q AS (SELECT c_custkey AS seq, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 200 END, try_cast(regexp_extract(CASE WHEN c_custkey % 8 = 0 THEN (c_custkey % 300)::VARCHAR || ' text' ELSE 'text' END, '^\\s*([0-9]+)', 1) AS BIGINT)) AS n,
   CASE WHEN c_custkey % 3 = 0 THEN 'old' || c_custkey END AS old_answer FROM customer),
  f AS (SELECT * FROM q WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n ORDER BY seq) = 1)
  SELECT seq, f.n, CASE WHEN trim(coalesce(old_answer, '')) <> '' THEN old_answer || chr(10) || chr(10) || s_name ELSE s_name END AS proposed FROM f JOIN supplier ON s_suppkey = f.n""")
def answer_mapping(spark, sf):
    c = F.col("c_custkey")
    content = F.when(c % 8 == 0, F.concat((c % 300).cast("string"), F.lit(" text"))).otherwise("text")
    q = load(spark, sf, "customer").select(c.alias("seq"), F.when(c % 4 != 0, c % 200).alias("number"), content.alias("content"), F.when(c % 3 == 0, F.concat(F.lit("old"), c.cast("string"))).alias("old_answer"))
    return bank.map_answers(q, load(spark, sf, "supplier"), "number", "content", "seq", "s_suppkey", "s_name")


@query(W + "SELECT paper_name, count(*) AS n FROM items GROUP BY 1 UNION ALL SELECT 'all papers', count(*) FROM items")
def group_counts(spark, sf):
    i = items(spark, sf)
    return i.groupBy("paper_name").agg(F.count("*").alias("n")).unionByName(i.agg(F.lit("all papers").alias("paper_name"), F.count("*").alias("n")))


@query(W + "SELECT subject, paper_name, count(*) AS n, sum(marks)::BIGINT AS marks FROM items GROUP BY ROLLUP (subject, paper_name)")
def rollup_marks(spark, sf):
    """Extension: marks by subject and paper with subtotals."""
    return items(spark, sf).rollup("subject", "paper_name").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"))


# ---- costs and reports

_NAMES = ["x/gpt-4o-mini", "Gemini-3.7-Flash", "gemini-2.5-flash", "deepseek-r", "gpt-4o", "a-haiku", "a-sonnet", "o1-pro", "other"]
_MODELS = f"CASE event_id % {len(_NAMES)} {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))} END"


def _calls(spark, sf):
    e = F.col("event_id")
    model = F.element_at(F.array(*map(F.lit, _NAMES)), (e % len(_NAMES) + 1).cast("int"))
    return load(spark, sf, "events").select("event_id", "event_type", "ts", "user_id", "value", "props", model.alias("model"), (e % 1000 * 10).alias("prompt"), (e % 300).alias("completion"))


_IN, _OUT = (f"CASE {' '.join(f"WHEN contains(lower(model), '{r[0]}') THEN {r[i]}" for r in costs.RATES)} ELSE {costs.DEFAULT_RATE[i - 1]} END::DOUBLE" for i in (1, 2))
_CALLS = f"calls AS (SELECT *, event_id % 1000 * 10 AS prompt, event_id % 300 AS completion, {_MODELS} AS model FROM events)"


@query(f"WITH {_CALLS} SELECT event_id, model, round((prompt * {_IN} + completion * {_OUT}) / 1e6, 9) AS cost FROM calls")
def cost_rate_card(spark, sf):
    return _calls(spark, sf).select("event_id", "model", F.round(costs.cost(F.col("model"), F.col("prompt"), F.col("completion")), 9).alias("cost"))


@query(f"""WITH {_CALLS}, g AS (SELECT *, (event_id % 20) * CASE WHEN event_id % 2 = 0 THEN 1200 ELSE 1400 END AS p, (event_id % 9) * CASE WHEN event_id % 2 = 0 THEN 300 ELSE 350 END AS c FROM calls)
  SELECT event_id, p AS prompt, c AS completion, round((p * {_IN} + c * {_OUT}) / 1e6 * CASE WHEN contains(lower(model), '3.7') OR contains(lower(model), 'o1') OR contains(lower(model), 'o3') THEN 3 ELSE 1 END, 9) AS cost FROM g""")
def cost_estimate(spark, sf):
    e = F.col("event_id")
    p, c = costs.estimated_tokens(e % 20, e % 9, e % 2 == 0)
    rows = _calls(spark, sf).withColumns({"p": p, "c": c})
    cost = costs.cost_fallback(costs.cost(F.col("model"), F.col("p"), F.col("c")), F.col("model"))
    return rows.select("event_id", F.col("p").alias("prompt"), F.col("c").alias("completion"), F.round(cost, 9).alias("cost"))


@query("SELECT s_suppkey AS id, s_suppkey % 6 AS used, greatest(0, 3 - s_suppkey % 6) AS remaining FROM supplier")
def quota_status(spark, sf):
    used = F.col("s_suppkey") % 6
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), used.alias("used"), costs.quota_left(used).alias("remaining"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'byok' WHEN s_suppkey % 6 < 3 THEN 'free' ELSE 'needs_key' END AS kind,
  CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 6 < 3 THEN 3 - s_suppkey % 6 - 1 END AS remaining_after FROM supplier""")
def route_case(spark, sf):
    k = F.col("s_suppkey")
    return load(spark, sf, "supplier").select(k.alias("id"), costs.route(k % 6, k % 7 == 0).alias("r")).select("id", "r.kind", "r.remaining_after")


@query("SELECT event_id, CASE WHEN c IN (401, 403) THEN 'auth' WHEN c = 429 THEN 'rate_limited' WHEN c >= 500 THEN 'unavailable' ELSE 'other' END AS class FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 500 END AS c FROM events)")
def status_class(spark, sf):
    e = F.col("event_id")
    code = F.when(e % 5 == 0, 401).when(e % 5 == 1, 429).when(e % 5 == 2, 503).when(e % 5 == 3, 404).otherwise(500)
    return load(spark, sf, "events").select("event_id", costs.status_class(code).alias("class"))


@query(f"WITH {_CALLS}, h AS (SELECT * FROM calls ORDER BY ts DESC, event_id LIMIT 100) SELECT count(*) AS n, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(prompt + completion)::BIGINT AS total FROM h")
def usage_totals(spark, sf):
    """Totals over the newest hundred calls (that many are the feature)."""
    h = costs.newest(_calls(spark, sf), "ts", "event_id")
    return h.agg(F.count("*").alias("n"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.col("prompt") + F.col("completion")).alias("total"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def history_topk(spark, sf):
    """The newest hundred (the limit is the feature): TakeOrderedAndProject, no full sort."""
    return costs.newest(load(spark, sf, "events"), "ts", "event_id").select("event_id", "user_id")


@query("SELECT event_type AS reason, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY 1")
def reason_histogram(spark, sf):
    from pyspark.sql import Window

    n = load(spark, sf, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "reason")).cast("long"))


@query("""SELECT user_id, count(*) AS calls, sum(event_id % 3)::BIGINT AS retries, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS reasons FROM
  (SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) GROUP BY 1""".replace("string_agg(event_type || '=' || n, ',' ORDER BY event_type)", "string_agg(event_type || '=' || n, ',' ORDER BY event_type) FILTER (r = 1)"))
def report_merge(spark, sf):
    e = load(spark, sf, "events")
    reports = e.select("user_id", F.lit(1).cast("long").alias("calls"), (F.col("event_id") % 3).alias("retries"), F.create_map("event_type", F.lit(1).cast("long")).alias("reasons"))
    out = costs.merge_reports(reports, ["user_id"], ["calls", "retries"], "reasons")
    shown = F.array_join(F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return out.select("user_id", "calls", "retries", shown.alias("reasons"))


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), sum(event_id))::BIGINT AS elapsed FROM events GROUP BY 1")
def elapsed_total(spark, sf):
    return costs.elapsed(load(spark, sf, "events"), ["user_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "event_id")


@query(W + """SELECT seq, marks AS actual, quality + 3 AS expected, marks = quality + 3 AS ok FROM items JOIN labels ON doc_id = seq""")
def mark_check(spark, sf):
    expected = load(spark, sf, "labels").select(F.col("doc_id").alias("seq"), (F.col("quality") + 3).alias("want"))
    return costs.mark_check(items(spark, sf), expected, "seq", "marks", "want")


@query(W + """SELECT i.seq, coalesce(i.question_number, l.quality + 100) AS expected FROM items i LEFT JOIN labels l ON l.doc_id = i.seq""")
def marks_backfill(spark, sf):
    i, l = items(spark, sf).select("seq", "question_number"), load(spark, sf, "labels")
    return i.join(l, i["seq"] == l["doc_id"], "left").select("seq", F.coalesce("question_number", (F.col("quality") + 100).cast("long")).alias("expected"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS prompt, 0::BIGINT AS completion, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS total FROM events")
def json_usage(spark, sf):
    from docloom.functions.jsonx import usage

    u = usage(F.col("props"), "$.k", "$.completion_tokens", "$.total_tokens")
    return load(spark, sf, "events").select("event_id", u.alias("u")).select("event_id", "u.prompt", "u.completion", "u.total")


@query("SELECT doc_id, sha256(concat_ws('|', coalesce(text, ''), lang, source, '2'))[1:16] AS key FROM documents")
def content_key(spark, sf):
    from docloom.sources.files import content_key as key

    return load(spark, sf, "documents").select("doc_id", key(F.coalesce("text", F.lit("")), F.col("lang"), F.col("source")).alias("key"))
