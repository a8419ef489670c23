"""Changes to the bank as DataFrame in, DataFrame out: deletes, patches, upserts, merges, de-duplication, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _named(c):
    return F.coalesce(F.trim(c), F.lit("")) != ""


def insert(items: DataFrame, new: DataFrame, topics: str = "topics") -> DataFrame:
    """Items with new rows; null topics become an empty list, missing columns null."""
    filled = new.withColumn(topics, F.coalesce(F.col(topics), F.array().cast("array<string>"))) if topics in new.columns else new
    return items.unionByName(filled, allowMissingColumns=True)


def emptied(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without rows."""
    return tuple(t.filter(F.lit(False)) for t in tables)


def drop_log(logs: DataFrame, key: str, value) -> DataFrame:
    return logs.filter(~F.col(key).eqNullSafe(F.lit(value)))


def dedupe_latest(items: DataFrame, group: str, number: str, seq: str) -> DataFrame:
    """Of rows with one non-blank group and non-null number the latest; other rows stay untouched.

    A group-by finds the rows that stay (map-side combined), a semi-join takes them: a hot key costs no sort.
    """
    exempt = ~_named(F.col(group)) | F.col(number).isNull()
    best = items.filter(~exempt).groupBy(group, number).agg(F.max(seq).alias(seq))
    return items.filter(exempt).unionByName(items.filter(~exempt).join(best, [group, number, seq], "left_semi"))


def prune_orphans(logs: DataFrame, items: DataFrame, name: str, paper: str, prefix: str = "MS:") -> DataFrame:
    """Logs whose name, without the prefix if it has it, is some item's paper; none if there are no items.

    The theta condition (name equal, or prefix and rest equal) becomes two equi keys.
    """
    papers = items.select(F.col(paper).alias("p")).filter("p is not null").distinct()
    keys = papers.unionByName(papers.select(F.concat(F.lit(prefix), "p").alias("p"))).distinct()
    return logs.join(keys, logs[name] == keys["p"], "left_semi")


def delete_with_cascade(items: DataFrame, logs: DataFrame, ids: list | DataFrame, key: str, paper: str, name: str, prefix: str = "MS:") -> tuple[DataFrame, DataFrame]:
    """Items without ``ids`` (a list, or a table of them), and logs without those of papers that lost their last item (all logs, if
    no item is left)."""
    if isinstance(ids, DataFrame):
        doomed = ids.select(F.col(key)).distinct()
        gone, left = items.join(doomed, key, "left_semi"), items.join(doomed, key, "left_anti")
    else:
        gone = items.filter(F.col(key).isin(ids))
        left = items.filter(~F.coalesce(F.col(key).isin(ids), F.lit(False)))
    emptied = gone.select(F.trim(paper).alias("p")).distinct().join(left.select(F.trim(paper).alias("p")).distinct(), "p", "left_anti").filter("p <> ''")
    names = emptied.unionByName(emptied.select(F.concat(F.lit(prefix), "p").alias("p")))
    some = left.select(F.lit(1).alias("some")).limit(1)
    kept = logs.join(names, logs[name] == names["p"], "left_anti").join(F.broadcast(some), how="left_semi")
    return left, kept


def delete_group(items: DataFrame, logs: DataFrame, group: str, paper: str, name: str, prefix: str = "MS:") -> tuple[DataFrame, DataFrame]:
    """Items and logs without one paper's; a blank name is refused."""
    if not group.strip():
        raise ValueError("a blank name names no group")
    return items.filter(~F.col(paper).eqNullSafe(F.lit(group))), logs.filter(~F.coalesce(F.col(name).isin(group, prefix + group), F.lit(False)))


def patch(items: DataFrame, patches: DataFrame, key: str, keep_if_null: list[str], overwrite: list[str], reset: dict | None = None) -> DataFrame:
    """Items with the patches of their key: some columns keep their value where the patch is null, others are overwritten."""
    p = patches.select(F.col(key).alias("p_key"), *(F.col(c).alias(f"p_{c}") for c in keep_if_null + overwrite))
    hit = F.col("p_key").isNotNull()
    new = {c: F.coalesce(F.col(f"p_{c}"), F.col(c)) for c in keep_if_null} | {c: F.when(hit, F.col(f"p_{c}")).otherwise(F.col(c)) for c in overwrite}
    new |= {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in (reset or {}).items()}
    return items.join(p, F.col(key) == F.col("p_key"), "left").withColumns(new).select(*items.columns)


def commit_answers(items: DataFrame, answers: DataFrame, key: str, answer: str, stale: str) -> DataFrame:
    """Answers set; stale is whether there was one before (the old row decides)."""
    a = answers.select(F.col(key).alias("a_key"), F.col(answer).alias("a_new"))
    hit = F.col("a_key").isNotNull()
    out = items.join(a, F.col(key) == F.col("a_key"), "left")
    return out.select(*(F.when(hit, F.col("a_new")).otherwise(F.col(c)).alias(c) if c == answer else F.when(hit, F.col(answer).isNotNull()).otherwise(F.col(c)).alias(c) if c == stale else F.col(c) for c in items.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], kept_id: str = "id") -> DataFrame:
    """Rows of ``old`` with the columns ``update`` of matching new rows, and new rows without a match; ``change`` says which.

    Rows with a null key never match, as in a unique index. New ids that collide with an old one of another row get a fresh id
    made from their key.
    """
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns))
    on = [old[k] == n[f"n_{k}"] for k in keys]
    both = old.join(n, on, "full_outer")
    is_old, is_new = F.col(kept_id).isNotNull(), F.col(f"n_{kept_id}").isNotNull()
    change = F.when(is_old & is_new, "updated").when(is_new, "added").otherwise("kept")
    cols = [F.when(is_new & ((~is_old) | F.lit(c in update)), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns]
    out = both.select(*cols, change.alias("change"))
    taken = old.select(F.col(kept_id).alias("t_id")).distinct()
    out = out.join(taken, (out[kept_id] == taken["t_id"]) & (out["change"] == "added"), "left")
    fresh = F.concat(F.lit("n-"), F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col(kept_id).cast("string")), 256).substr(1, 16))
    return out.withColumn(kept_id, F.when(F.col("t_id").isNotNull(), fresh).otherwise(F.col(kept_id).cast("string"))).drop("t_id")


def merge_parts(rows: DataFrame, by: list[str], order: list[str], text: str, total: str, first: list[str]) -> DataFrame:
    """Parts of one item joined in order: their texts after blank lines, the sum of ``total``, the first part's other values."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    firsts = [F.min_by(c, F.struct(*order)).alias(f"first_{c}") for c in first]
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "\n\n").alias(text), F.sum(total).alias(total), *firsts)


def swap_answers(rows: DataFrame, swaps: DataFrame, key: str, paper: str, content: str, place: str, answer: str) -> DataFrame:
    """``rows`` with answers exchanged: ``swaps`` (key, number) gives each row named the answer of the first row of its paper with that
    number, which gets its answer in turn. A row's number leads its content, else it is its place. Swaps that name no other row, or
    rows that another swap names, change nothing twice: the least key's swap counts.
    """
    lead = F.expr(f"try_cast(regexp_extract(trim({content}), '(?i)^(?:question\\\\s+|q\\\\.?\\\\s*)?([0-9]+)', 1) as bigint)")
    r = rows.withColumn("_n", F.coalesce(lead, F.col(place).cast("bigint")))
    first = r.groupBy(F.col(paper).alias("_paper"), F.col("_n").alias("_number")).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(answer).alias("a")), place).alias("_to"))
    asked = swaps.select(F.col(key).alias("_key"), F.col("number").alias("_want"))
    pairs = r.join(asked, F.col(key) == F.col("_key")).join(first, (F.col(paper) == F.col("_paper")) & (F.col("_want") == F.col("_number"))).filter(F.col(key) != F.col("_to.k"))
    # each row takes part in one swap: that of the least asking key
    ends = pairs.select(F.col(key).alias("by"), F.explode(F.array(F.struct(F.col(key).alias("k"), F.col("_to.a").alias("a")), F.struct(F.col("_to.k").alias("k"), F.col(answer).alias("a")))).alias("x")).select("by", "x.*")
    mine = ends.groupBy("k").agg(F.min("by").alias("by"))
    whole = mine.groupBy("by").agg(F.count("*").alias("ends")).filter("ends = 2").select("by")
    new = ends.join(mine, ["k", "by"], "left_semi").join(whole, "by", "left_semi").select(F.col("k").alias("_k"), F.col("a").alias("_a"))
    out = rows.join(new, F.col(key) == F.col("_k"), "left")
    return out.withColumn(answer, F.when(F.col("_k").isNotNull(), F.col("_a")).otherwise(F.col(answer))).select(*rows.columns)


def import_upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str], topics: str = "topics", module: str = "module") -> DataFrame:
    """As an import does it: empty new topics keep the old ones, a null new module the old one; other columns stay."""
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns))
    both = old.join(n, [old[k] == n[f"n_{k}"] for k in keys], "full_outer")
    is_old = F.col(old.columns[0]).isNotNull()
    hit = F.col(f"n_{keys[0]}").isNotNull()
    cols = []
    for c in old.columns:
        fresh = F.col(f"n_{c}") if c in new.columns else F.lit(None)
        if c == topics:
            v = F.when(hit & (~is_old | (F.size(fresh) > 0)), fresh).otherwise(F.col(c))
        elif c == module:
            v = F.coalesce(fresh, F.col(c))
        elif c in overwrite:
            v = F.when(hit, fresh).otherwise(F.col(c))
        else:
            v = F.when(is_old, F.col(c)).otherwise(fresh)
        cols.append(v.alias(c))
    return both.select(*cols)


def map_answers(items: DataFrame, answers: DataFrame, number: str, content: str, seq: str, answer_number: str, answer: str) -> DataFrame:
    """Answers matched to items: seq, n, proposed. An item's key is its number, else the number its content starts with; the first
    item of a key wins; answers without an item are left out; a new answer follows an old one after a blank line."""
    lead = F.expr(f"try_cast(regexp_extract({content}, '^\\\\s*([0-9]+)', 1) as bigint)")
    keyed = items.withColumn("n", F.coalesce(F.col(number).cast("long"), lead)).filter("n is not null")
    # an aggregate, not a window: a hot key is combined before the shuffle
    first = keyed.groupBy("n").agg(F.min_by(F.struct(F.col(seq).alias("seq"), F.col("old_answer").alias("old_answer")), F.col(seq)).alias("i"))
    a = answers.select(F.col(answer_number).cast("long").alias("n"), F.col(answer).alias("new"))
    proposed = F.when(F.trim(F.coalesce("i.old_answer", F.lit(""))) != "", F.concat_ws("\n\n", "i.old_answer", "new")).otherwise(F.col("new"))
    return first.join(a, "n").select(F.col("i.seq").alias("seq"), "n", proposed.alias("proposed"))
