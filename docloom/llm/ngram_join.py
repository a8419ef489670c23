"""N-gram Jaccard join: MinHash banding for a target recall, shuffled on band hashes, verified on full n-gram sets.

Documents with equal n-gram sets form one class, which has a number of its own and is named by its least id. Classes that share a band bucket are candidates;
a bucket whose members are those of an earlier bucket adds nothing and goes. A bucket that is small in members and in n-grams is
one block. In a large one each set becomes its difference from a pivot's set, which is small for near copies and as good for exact
overlaps; blocks of differences, bounded in members and in size, meet in pairs, so no task holds an unbounded group and no set is
sent once for each pair of blocks. A pair is decided once, in the first bucket that both members share, from their full sets. What
leaves a task is the number of links of each member and a spanning forest of the links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, forget, worker_cache, written

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
#: Members of a small bucket and n-grams of all its sets at most; the same of a large bucket's block, by hash, so nearly.
BLOCK, BLOCK_GRAMS = 768, 2 << 20
LARGE_BLOCK = 2048
#: Members of a block compared with the other at once; 2**BITS bits of the bitmap of candidate documents (8 MB).
TILE, BITS = 768, 26
CACHED_WORDS = 300_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes that find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def ngram_set(text: str, known: _Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the text's distinct word n-grams; a shorter text with words has one, of all its words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two sums over the n-gram set."""
    return int(s.sum().view(np.int64)), int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, t (the text's hash), size (of the n-gram set), h1 and h2 (the set's fingerprint) and the band hashes of each document row."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("n-grams", _Hashes)
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                out = np.zeros((b.num_rows, bands), np.uint64)
                size, h1, h2 = (np.zeros(b.num_rows, np.int64) for _ in range(3))
                for i, t in enumerate(b.column(1).to_pylist()):
                    s = ngram_set(t or "", known, n)
                    size[i] = len(s)
                    if len(s):
                        h1[i], h2[i] = fingerprint(s)
                        least = np.full(bands * rows, np.uint64(2**64 - 1))
                        for at in range(0, len(s), 256):
                            part = (s[at : at + 256, None] ^ seeds) * np.uint64(0xD6E8FEB86659FD93)
                            least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(0))
                        band = np.zeros(bands, np.uint64)
                        for r in range(rows):
                            band = _mix(band + least.reshape(bands, rows)[:, r])
                        out[i] = band
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands), pa.array(out.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size), pa.array(h1), pa.array(h2), lists], names=["doc_id", "t", "size", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, size long, h1 long, h2 long, bands array<long>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """2**BITS bits, those of the ids' hashes set; its size is fixed, whatever the number of ids."""
    bit = F.shiftrightunsigned(F.xxhash64("rep"), 64 - BITS)
    words = ids.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.pow(F.lit(2.0), F.pmod(bit, F.lit(32))).cast("long")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """doc_id, n-gram set and its fingerprint of the documents whose bit is set (all members; others by chance)."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = worker_cache("n-grams", _Hashes), bits.value
        for whole in batches:
            bit = whole.column("bit").to_numpy()
            picked = np.flatnonzero(table[bit >> 5] >> (bit & 31).astype(np.uint32) & 1)
            for at in range(0, len(picked), 500):
                b = whole.take(pa.array(picked[at : at + 500]))
                sets = [ngram_set(t or "", known, n) for t in b.column("text").to_pylist()]
                prints = [pa.array([x[i] for x in map(fingerprint, sets)], pa.int64()) for i in range(2)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *prints, pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "grams"])

    bit = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 64 - BITS)
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", bit.alias("bit")).mapInArrow(run, "doc_id long, h1 long, h2 long, grams array<long>")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the grams that occur on both sides, in column blocks."""
    ga, gb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ga, gb)
    out = np.zeros((len(a), len(b)), np.float32)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])

    def placed(g, r):
        c = np.searchsorted(both, g)
        ok = (c < len(both)) & (both[np.minimum(c, len(both) - 1)] == g) if len(both) else np.zeros(len(g), bool)
        o = np.argsort(c[ok], kind="stable")
        return c[ok][o], r[ok][o]

    (ca, ra), (cb, rb) = placed(ga, ra), placed(gb, rb)
    step = 4096
    for at in range(0, len(both), step):
        x, y = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        i, j = np.searchsorted(ca, [at, at + step])
        x[ra[i:j], ca[i:j] - at] = 1
        i, j = np.searchsorted(cb, [at, at + step])
        y[rb[i:j], cb[i:j] - at] = 1
        out += x @ y.T
    return out


def _differences(rows: DataFrame) -> DataFrame:
    """``rows`` (grams, pivot and other columns) with grams the members' difference from the pivot, missing n-grams negated in their
    bits, and base (size of the pivot's set) and missing (n-grams of the pivot that the member lacks)."""
    kept = [c for c in rows.columns if c not in ("grams", "pivot", "base", "missing")]
    types = {x.name: x.dataType.simpleString() for x in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                out, base, missing = [], [], []
                for grams, pivot in zip(b.column("grams"), b.column("pivot")):
                    own, of = grams.values.to_numpy(), pivot.values.to_numpy()
                    lacks = np.setdiff1d(of, own, assume_unique=True)
                    out.append(np.sort(np.concatenate([np.setdiff1d(own, of, assume_unique=True), ~lacks]).view(np.uint64)).view(np.int64))
                    base.append(len(of)), missing.append(len(lacks))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.list_(pa.int64())), pa.array(base, pa.int64()), pa.array(missing, pa.int64())], names=[*kept, "grams", "base", "missing"])

    return rows.select(*kept, "grams", "pivot").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "grams array<long>, base long, missing long"]))


class _Member:
    """A class in a block: kept bucket by band, size of its set, its difference from a pivot (or the set itself, base 0)."""

    __slots__ = ("block", "cls", "kept", "size", "base", "missing", "grams")

    def __init__(self, block, cls, kept, size, base, missing, grams):
        self.block, self.cls, self.kept, self.size, self.base, self.missing, self.grams = block, cls, kept, size, base, missing, grams


def _links(same: bool, band: int, a: list[_Member], b: list[_Member], threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links of each member and a spanning forest, from the pairs of two blocks that meet first in this bucket."""
    counts: dict[int, int] = {}
    parent: dict[int, int] = {}
    forest: list[tuple[int, int]] = []

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kb, sb = np.array([x.kept for x in b]), np.array([x.size for x in b], float)
    for at in range(0, len(a), TILE):
        part = a[at : at + TILE]
        ka, sa = np.array([x.kept for x in part]), np.array([x.size for x in part], float)
        todo = np.minimum(sa[:, None], sb) >= threshold * np.maximum(sa[:, None], sb) - 1e-9
        for j in range(band):
            todo &= (ka[:, None, j] != kb[None, :, j]) | (ka[:, None, j] == 0)
        if same:
            todo &= np.tri(len(part), len(b), at - 1, dtype=bool)
        rows, cols = np.flatnonzero(todo.any(1)), np.flatnonzero(todo.any(0))
        if not len(rows):
            continue
        x, y = [part[i] for i in rows], [b[j] for j in cols]
        if len(x) * len(y) <= 4:
            share = np.array([[len(np.intersect1d(u.grams, v.grams, assume_unique=True)) for v in y] for u in x], float)
        else:
            share = _overlaps([u.grams for u in x], [v.grams for v in y])
        # what both lack of the pivot was counted as common, and is taken off twice
        share = share + x[0].base - np.array([u.missing for u in x], float)[:, None] - np.array([v.missing for v in y], float)
        union = sa[rows][:, None] + sb[cols] - share
        hit = todo[np.ix_(rows, cols)] & (share >= threshold * union - 1e-9)
        for side, axis in ((x, 1), (y, 0)):
            for u, k in zip(side, hit.sum(axis).tolist()):
                if k:
                    counts[u.cls] = counts.get(u.cls, 0) + k
        # union-find by rows: each row joins all its hits
        for i in np.flatnonzero(hit.any(1)):
            u = x[i].cls
            for j in np.flatnonzero(hit[i]):
                v = y[j].cls
                p, q = top(u), top(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    forest.append((min(u, v), max(u, v)))
    return counts, forest


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """cls, links, near: link counts of members (near null) and forest edges (links 0), from rows sorted by block pair."""

    def decide(key, members):
        _, band, p, q = key
        a = [m for m in members if m.block == p]
        b = a if p == q else [m for m in members if m.block == q]
        return _links(p == q, band, a, b, threshold) if a and b else ({}, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, out = None, [], []

        def done():
            counts, forest = decide(held, members)
            out.extend((u, n, None) for u, n in counts.items())
            out.extend((u, 0, v) for u, v in forest)

        def batch():
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["cls", "links", "near"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("bucket", "band", "p", "q"))))
            kept, grams = b.column("kept"), b.column("grams")
            for i, (key, block, *numbers) in enumerate(zip(keys, *(b.column(c).to_pylist() for c in ("block", "cls", "size", "base", "missing")))):
                if key != held:
                    if members:
                        done()
                    held, members = key, []
                cls, size, base, missing = numbers
                members.append(_Member(block, cls, kept[i].values.to_numpy(), size, base, missing, grams[i].values.to_numpy().view(np.uint64)))
            if out:
                yield batch()
        if members:
            done()
        yield batch()

    return rows.mapInArrow(run, "cls long, links long, near long")


def components(edges: DataFrame, name: str = "near") -> DataFrame:
    """node, root: the least node of each node's component of ``edges`` (u, v). Alternating large and small stars; each round is a table."""
    now = written(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if mark == before:
            break
        before = mark
        # large star: neighbours above a node go to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        large = written(large, f"{name}-large")
        # small star: a node's lower neighbours and the node go to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u <> v").distinct()
        older, now = now, written(small, f"{name}-small")
        forget(older)
        forget(large)
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """A row for each row of ``docs`` with a doc_id: doc_id, class_id, text_id, n_links, n_copies.

    ``text_id`` is the least doc_id with the same n-gram set and ``n_copies`` the number of such rows; ``n_links`` is the number of
    other n-gram sets at ``threshold`` or above; ``class_id`` is the least doc_id of the component of links. Pairs at the
    threshold are found with probability ``recall``, closer ones more surely.

    Texts that are null or have no words have no n-grams: each is its own class without links. A text of fewer than ``n`` words
    has one n-gram, all of its words. Repeated rows count as copies; different
    texts under one doc_id are classes of their own. Rows without a doc_id are left out. An empty table
    gives an empty result.
    """
    return _classes(docs, n, threshold, recall, rows).drop("t")


def _classes(docs: DataFrame, n: int, threshold: float, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """The rows of ``near_duplicates`` with ``t``, the text's hash."""
    bands = bands_for(threshold, recall, rows)
    every = written(signatures(bounded(docs).filter("doc_id is not null"), n, bands, rows), "join-rows")
    classes = written(every.filter("size > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands")).withColumn("cls", F.monotonically_increasing_id()), "join-classes")
    met = classes.select("cls", "size", F.posexplode("bands").alias("band", "hash"))
    # buckets of two members or more, one for each membership: equal count and equal sum of member hashes
    buckets = met.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned(F.xxhash64("cls"), 20).cast("decimal(20,0)")).alias("who"), F.min("cls").alias("first"), F.sum("size").alias("all_grams")).filter("n > 1")
    kept = buckets.groupBy("n", "who", "first", "all_grams").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash", "n", "first", "all_grams")
    member = met.drop("size").join(kept, ["band", "hash"])
    # for each member the hashes of its kept buckets by band, 0 for none, and the list of them
    members = member.groupBy("cls").agg(F.collect_list(F.struct("band", "hash", "n", "first", "all_grams")).alias("in"))
    members = written(members.join(classes.select("cls", "rep", "h1", "h2", "size"), "cls"), "join-members")
    where = F.map_from_arrays(F.transform("in", lambda x: x["band"]), F.transform("in", lambda x: x["hash"]))
    members = members.withColumn("kept", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.coalesce(F.element_at(where, j), F.lit(0).cast("long"))))
    is_small = lambda x: (x["n"] <= BLOCK) & (x["all_grams"] <= BLOCK_GRAMS)

    def in_buckets(chosen) -> DataFrame:
        """A row for each member and kept bucket that ``chosen`` takes, with the n-gram set."""
        some = members.withColumn("in", F.filter("in", chosen)).filter(F.size("in") > 0)
        # one doc_id may name several texts
        sets = _sets(docs, some, n).withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "h1", "h2"])
        return some.join(sets, ["rep", "h1", "h2"]).select("cls", "size", "kept", "grams", F.explode("in").alias("x")).select("cls", "size", "kept", "grams", F.col("x.hash").alias("bucket"), "x.band", "x.n", "x.first")

    none = F.lit(0).cast("long")
    placed = in_buckets(is_small).select("cls", "size", "kept", "grams", "bucket", "band", none.alias("base"), none.alias("missing"), *(F.lit(0).alias(c) for c in ("block", "p", "q")))
    if not members.filter(F.exists("in", lambda x: ~is_small(x))).isEmpty():
        sets = written(in_buckets(lambda x: ~is_small(x)), "join-large")
        # a pivot meets its bucket's members in a join that adaptive execution splits where a bucket is hot
        pivots = sets.filter(F.col("cls") == F.col("first")).select("bucket", "band", F.col("grams").alias("pivot"))
        large = written(_differences(sets.drop("first").join(pivots, ["bucket", "band"])), "join-differences")
        sizes = large.groupBy("bucket", "band").agg(F.greatest(F.ceil(F.count("*") / LARGE_BLOCK), F.ceil(F.sum(F.size("grams")) / BLOCK_GRAMS)).cast("int").alias("blocks"))
        large = large.join(sizes, ["bucket", "band"]).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.unionByName(large.select("cls", "size", "kept", "grams", "bucket", "band", "base", "missing", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")))
    dealt = placed.repartition("bucket", "band", "p", "q").sortWithinPartitions("bucket", "band", "p", "q", "cls")
    found = written(_verify(dealt, threshold), "join-links")
    links = found.filter("near is null").groupBy("cls").agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("near is not null").select(F.col("cls").alias("u"), F.col("near").alias("v")))
    # a component goes by the least doc_id of its classes, its root among them
    roots = roots.withColumnRenamed("node", "cls").unionByName(roots.select(F.col("root").alias("cls"), "root").distinct())
    roots = written(roots.join(classes.select("cls", "rep"), "cls"), "join-roots")
    least = written(roots.groupBy("root").agg(F.min("rep").alias("least")), "join-least")
    roots = roots.join(least, "root").select("cls", F.col("least").alias("root"))
    named = classes.select("cls", "h1", "h2", "rep", "n_copies").join(links, "cls", "left").join(roots, "cls", "left")
    named = named.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "rep", "n_copies", "n_links", "root")
    out = every.select("doc_id", "t", "size", "h1", "h2").join(named, (F.col("size") > 0) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    return out.select("doc_id", "t", F.coalesce("root", "rep", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("text_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without near duplicates: of each class the rows of its least doc_id stay, and rows without a doc_id or without words.

    Repeated rows of the least doc_id all stay: they are one document. Different texts under one doc_id go or stay each for itself.
    """
    classes = _classes(docs, n, threshold)
    gone = written(classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct(), "join-gone")
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_t"]), "left_anti").select(*(docs[c] for c in docs.columns))
