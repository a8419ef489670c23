"""Exact repeats of LENGTH bytes by merging Burrows-Wheeler transforms of shards.

Texts are parsed at content-defined anchors: the anchor of a window of LENGTH bytes is its least K-gram hash (leftmost on a tie),
so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a stretch, written as a short
string of phrase names (hashes of the bytes between anchors). Each map task is a shard: it sends each of its different strings
once, with a count. Strings are dealt by their anchor; where they meet, each shard's strings get a Burrows-Wheeler transform and
the transforms are merged by refining their interleave, symbol by symbol, until it stands still. The refinement yields common
prefixes, and intervals of equal strings with two occurrences or more are the repeated stretches, without sorting the merged
suffixes again. A stretch that occurs once but shares its anchor with others is repeated in part at most; a check of all windows
of just these stretches settles them, by 64-bit hashes of the byte strings. Equal windows stand at one offset from their anchor,
so the windows of an anchor that many stretches share are dealt by ranges of that offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, text_bytes, written

LENGTH, K = 400, 32
#: Bytes of text parsed at once, strings that a map task holds before it sends them, strings of one merge (whole anchors).
CHUNK, HELD, MERGED = 1 << 20, 60_000, 20_000
#: Stretches of an anchor beyond which its windows are dealt by offset: so many a range, in OFFSETS ranges at most. Rows of a check.
HOT, OFFSETS, CHECKED = 2048, 32, 4096
#: Shards of a merge at most: map tasks are dealt among them.
SHARDS = 8
#: Symbols of a string at most; the last one covers what is left of the stretch.
SYMBOLS = 6
BITS = 26
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Sums:
    """Hashes of any byte ranges of a buffer."""

    powers = inverse = np.zeros(0, _U)

    def __init__(self, buf: np.ndarray):
        if len(_Sums.powers) < len(buf) + 1:
            _Sums.powers, _Sums.inverse = _powers(_BASE, len(buf) + 1), _powers(_INVERSE, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(_TABLE[buf] * _Sums.powers[: len(buf)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * _Sums.inverse[a] + (b - a).astype(_U))


def _grams(buf: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the hash of the K bytes at each place (K a power of two); the last K - 1 places are meaningless."""
    h = _TABLE[buf]
    step = 1
    while step < K:
        o = h * _U(0xD6E8FEB86659FD93) + _U(step)
        o ^= o >> _U(32)
        o[:-step] += h[step:]
        h = o
        step *= 2
    return (_mix(h) >> _U(32)).astype(np.uint32)


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each place the leftmost place of the least value among ``width`` from there on."""
    n = len(h)
    low, at, size = h.copy(), np.arange(n, dtype=np.int32), 1

    def joined(low, at, by):
        a, b = low[: n - by], low[by:]
        left = a <= b
        low, at = low.copy(), at.copy()
        low[: n - by] = np.where(left, a, b)
        at[: n - by] = np.where(left, at[: n - by], at[by:])
        return low, at

    while size * 2 <= width:
        low, at = joined(low, at, size)
        size *= 2
    if size < width:
        low, at = joined(low, at, width - size)
    return at


def parse(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The stretches of all texts: text number, anchor key, anchor, first and last window start (places within the text), string
    name, and the strings' symbols with the end of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buf) or (sizes < length).all():
        none = np.zeros(0, np.int64)
        return none, none.view(_U), none, none, none, none.view(_U), none.view(_U), none
    ends = np.cumsum(sizes)
    starts = ends - sizes
    anchor = _anchors(_grams(buf), length - K + 1)
    valid = np.zeros(len(buf) + 1, np.int8)
    long = sizes >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    doc = np.searchsorted(ends, at, side="right")
    a = anchor[at].astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    s, e, p, d = at[first], at[np.append(first[1:], len(at)) - 1], a[first], doc[first]
    sums = _Sums(buf)
    key = sums.of(p, p + K)
    # cuts of a stretch: its anchor and the anchors that follow in the text, as far as the stretch reaches
    # (anchors rise within a text, and texts follow one another); text that repeats itself has many, of which the first few serve
    reach = np.searchsorted(p, e + length)
    number = np.arange(len(p))
    n = np.clip(reach - number, 1, SYMBOLS - 1)
    owner = np.repeat(number, n + 1)
    upto = np.cumsum(n + 1)
    within = np.arange(upto[-1]) - np.repeat(upto - (n + 1), n + 1)
    left = np.where(within == 0, s[owner], p[np.minimum(owner + within - 1, len(p) - 1)])
    right = np.where(within == n[owner], e[owner] + length, p[np.minimum(owner + within, len(p) - 1)])
    symbols = sums.of(left, np.maximum(left, right))
    name = sums.of(s, e + length) ^ _mix((p - s).astype(_U))
    return d, key, p - starts[d], s - starts[d], e - starts[d], name, symbols, upto


class Transform:
    """The Burrows-Wheeler transform of strings: for each rotation in order the symbol before it (0: a string's end mark)."""

    def __init__(self, last: np.ndarray, heads: np.ndarray):
        #: heads: rank of each string's first rotation
        self.last, self.heads = last, heads

    @classmethod
    def of(cls, strings: list[np.ndarray]) -> "Transform":
        """Of strings of positive symbols, each followed by the mark 0, as cyclic words in order; for small shards."""
        sizes = np.array([len(x) + 1 for x in strings])
        flat = np.zeros(int(sizes.sum()), np.int64)
        flat[np.arange(len(flat)) != np.repeat(np.cumsum(sizes) - 1, sizes)] = np.concatenate(strings)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        size = np.repeat(sizes, sizes)
        place = np.arange(len(flat)) - begin
        rank = np.unique(flat, return_inverse=True)[1]
        step = 1
        while step < 2 * sizes.max():  # rotations by their first ``step`` symbols, doubled
            _, rank2 = np.unique(rank * (len(flat) + 1) + rank[begin + (place + step) % size], return_inverse=True)
            if (rank2 == rank).all():
                break
            rank, step = rank2, step * 2
        order = np.lexsort((np.arange(len(flat)), rank))
        last = flat[begin[order] + (place[order] - 1) % size[order]]
        ranks = np.empty(len(flat), np.int64)
        ranks[order] = np.arange(len(flat))
        return cls(last, ranks[np.cumsum(sizes) - sizes])


def merge(a: Transform, b: Transform) -> tuple[Transform, np.ndarray]:
    """Merge two transforms by refining their interleave; the merged one and its common prefix lengths.

    The interleave says for each merged place which transform it comes from. It starts as all of ``a``, then all of ``b``; dealing
    the places stably by the symbols before them refines it by one symbol. The round in which two neighbours part is their
    common prefix length; neighbours that never part (equal words) get -1.
    """
    na, n = len(a.last), len(a.last) + len(b.last)
    source = np.zeros(n, bool)
    source[na:] = True
    block, common, done = np.zeros(n, np.int64), np.full(n, -1, np.int64), 0
    common[:1] = 0
    last = np.empty(n, a.last.dtype)
    while True:
        last[~source], last[source] = a.last, b.last
        order = np.argsort(last, kind="stable")
        moved, sym, was = source[order], last[order], block[order]
        parts = np.zeros(n, bool)
        parts[1:] = (sym[1:] != sym[:-1]) | (was[1:] != was[:-1])
        fresh = parts & (common < 0)
        common[fresh] = done
        refined = np.cumsum(parts)
        if (moved == source).all() and (refined == block).all():
            break
        source, block, done = moved, refined, done + 1
    last[~source], last[source] = a.last, b.last
    of_a, of_b = np.flatnonzero(~source), np.flatnonzero(source)
    return Transform(last, np.concatenate([of_a[a.heads], of_b[b.heads]])), common


def equal_strings(shards: list[list[np.ndarray]]) -> np.ndarray:
    """For the strings of all shards, one after the other, the number of the interval of equal strings that each belongs to."""
    transforms, common = [Transform.of(s) for s in shards], None
    if len(transforms) == 1:  # merged with nothing, to get its prefixes
        transforms.append(Transform(transforms[0].last[:0], np.zeros(0, np.int64)))
    while len(transforms) > 1:  # neighbours first, so heads stay in the order of the shards
        pairs = [merge(a, b) for a, b in zip(transforms[::2], transforms[1::2])]
        common = pairs[-1][1]
        transforms = [t for t, _ in pairs] + transforms[len(transforms) // 2 * 2 :]
    interval = np.cumsum(common >= 0)
    return interval[transforms[0].heads]


def _resolve(keys: np.ndarray, tasks: np.ndarray, counts: np.ndarray, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the merge says of each string: 0 occurs once and alone at its anchor, 1 once beside others, 2 repeated, 3 repeated
    beside others and the first of its interval."""
    out = np.zeros(len(keys), np.int8)
    _, group, rows = np.unique(keys, return_inverse=True, return_counts=True)
    met = (rows[group] > 1) | (counts > 1)
    at = np.flatnonzero(met)
    if not len(at):
        return out
    at = at[np.argsort(tasks[at] % SHARDS, kind="stable")]
    sizes = np.diff(offsets)[at]
    upto = np.cumsum(sizes)
    flat = symbols[np.repeat(offsets[at] - (upto - sizes), sizes) + np.arange(upto[-1])]
    names = np.unique(flat, return_inverse=True)[1] + 1
    strings = np.split(names, upto[:-1])
    shards = [[] for _ in range(SHARDS)]
    for i, x in zip(at, strings):
        shards[tasks[i] % SHARDS].append(x)
    interval = equal_strings([s for s in shards if s])
    total = np.bincount(interval, counts[at])[interval]
    pair = np.unique(np.stack([group[at], interval]), axis=1)
    several = np.bincount(pair[0], minlength=len(rows))[group[at]] > 1
    first = np.zeros(len(at), bool)
    first[np.unique(interval, return_index=True)[1]] = True
    out[at] = np.where(total > 1, np.where(several & first, 3, 2), np.where(several, 1, 0))
    return out


def _bitmap(ids: DataFrame, col: str) -> np.ndarray:
    bit = F.shiftrightunsigned(F.xxhash64(col), 64 - BITS)
    words = ids.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.pow(F.lit(2.0), F.pmod(bit, F.lit(32))).cast("long")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _chosen(rows: DataFrame, ids: DataFrame, wanted: bool = True) -> DataFrame:
    """Rows (rid, raw) whose bit is set in the bitmap of ``ids`` (or not set): all rows of the ids, others by chance."""
    sent = rows.sparkSession.sparkContext.broadcast(_bitmap(ids, "rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            bit = b.column("bit").to_numpy()
            on = (table[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)
            yield b.filter(pa.array(on == wanted)).select(b.schema.names[:-1])

    types = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    return rows.withColumn("bit", F.shiftrightunsigned(F.xxhash64("rid"), 64 - BITS)).mapInArrow(run, types)


def repeated_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, s, e: window starts s to e of the text that occur elsewhere too, from rows (rid, raw), rid a hash of the row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict[int, list] = {}

        def places(rid, name, s, e):
            n = len(rid)
            return _batch(kind=np.zeros(n, np.int32), rid=rid, name=name, s=s, e=e, task=np.full(n, task, np.int32), key=np.zeros(n, np.int64), p=np.zeros(n, np.int64), n=np.zeros(n, np.int64), symbols=[[]] * n)

        def strings():
            v = list(held.values())
            names = np.array(list(held), np.uint64).view(np.int64)
            held.clear()
            return _batch(kind=np.ones(len(v), np.int32), rid=np.array([x[2] for x in v], np.int64), name=names, s=np.array([x[3] for x in v], np.int64), e=np.array([x[4] for x in v], np.int64), task=np.full(len(v), task, np.int32), key=np.array([x[0] for x in v], np.uint64).view(np.int64), p=np.array([x[6] for x in v], np.int64), n=np.array([x[1] for x in v], np.int64), symbols=[x[5].view(np.int64) for x in v])

        for b in batches:
            rids, i = b.column("rid").to_numpy(), 0
            lens = np.cumsum(np.array(b.column("size").to_numpy(), np.int64))
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(lens, (lens[i - 1] if i else 0) + CHUNK)))
                d, key, p, s, e, name, symbols, upto = parse([x.as_py() for x in b.column("raw").slice(i, j - i)], length)
                rid = rids[i:j][d] if len(d) else np.zeros(0, np.int64)
                begin = np.concatenate([[0], upto[:-1]])
                for k, nm in enumerate(name.tolist()):
                    x = held.get(nm)
                    if x is None:
                        held[nm] = [int(key[k]), 1, int(rid[k]), int(s[k]), int(e[k]), symbols[begin[k] : upto[k]], int(p[k])]
                    else:
                        x[1] += 1
                if len(name):
                    yield places(rid, name.view(np.int64), s, e)
                if len(held) > HELD:
                    yield strings()
                i = j
        yield strings()

    schema = "kind int, rid long, name long, s long, e long, task int, key long, p long, n long, symbols array<long>"
    parsed = written(rows.withColumn("size", F.length("raw").cast("long")).mapInArrow(scan, schema), "bwt-parsed")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(t: pa.Table) -> pa.RecordBatch:
            keys = t["key"].to_numpy()
            lists = t["symbols"].combine_chunks()
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            said = _resolve(keys, t["task"].to_numpy(), t["n"].to_numpy(), flat, off)
            some = np.flatnonzero(said)
            return _batch(said=said[some].astype(np.int32), **{c: t[c].to_numpy()[some] for c in ("rid", "name", "s", "e", "key", "p")})

        yield from map(settle, _whole_keys(batches, MERGED))

    strings = parsed.filter("kind = 1").select("key", "p", "task", "rid", "name", "s", "e", "n", "symbols")
    said = written(strings.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "said int, rid long, name long, s long, e long, key long, p long"), "bwt-said")
    whole = parsed.filter("kind = 0").select("rid", "name", "s", "e").join(said.filter("said >= 2").select("name").distinct(), "name").select("rid", "s", "e")

    # exact check of the stretches that occur once beside others, against one of each string at their anchors
    doubtful = said.filter("said in (1, 3)").select("rid", "key", "p", "s", "e", (F.col("said") == 1).alias("asks")).distinct()
    # a row for each hot anchor: the width of its offset ranges
    ranges = F.least(F.lit(OFFSETS), F.ceil(F.col("n") / HOT))
    hot = doubtful.groupBy(F.col("key").alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("hot", F.ceil(length / ranges).cast("long").alias("width"))
    doubtful = doubtful.join(written(hot, "bwt-hot"), F.col("key") == F.col("hot"), "left")
    one = F.array(F.lit(0).cast("long"))
    doubtful = doubtful.withColumn("g", F.explode(F.when(F.col("width").isNull(), one).otherwise(F.sequence(F.floor((F.col("s") - F.col("p")) / F.col("width")), F.floor((F.col("e") - F.col("p")) / F.col("width"))))))
    first = F.greatest("s", F.coalesce(F.col("p") + F.col("g") * F.col("width"), F.col("s")))
    last = F.least("e", F.coalesce(F.col("p") + (F.col("g") + 1) * F.col("width") - 1, F.col("e")))
    doubtful = written(doubtful.select("rid", F.xxhash64("key", "g").alias("key"), first.alias("s"), last.alias("e"), "asks"), "bwt-doubtful")
    listed = doubtful.groupBy("rid").agg(F.collect_list(F.struct("key", "s", "e", "asks")).alias("at"))
    texts = _chosen(rows.select("rid", "raw"), doubtful).dropDuplicates(["rid"]).join(listed, "rid")
    parts = texts.select("rid", "raw", F.explode("at").alias("x")).select("rid", "x.*", F.expr("substring(raw, cast(x.s + 1 as int), cast(x.e - x.s + %d as int))" % length).alias("part"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(t: pa.Table) -> pa.RecordBatch:
            # hashes of all windows, computed for some rows at a time; only they and their order are held for the whole group
            hashes, n = [], np.zeros(t.num_rows, np.int64)
            for at in range(0, t.num_rows, 500):
                texts = [x.as_py() for x in t["part"].slice(at, 500)]
                sizes = np.array([len(x) for x in texts], np.int64)
                sums = _Sums(np.frombuffer(b"".join(texts), np.uint8))
                own = n[at : at + len(texts)] = sizes - length + 1
                start = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(own) - own), own) + np.arange(own.sum())
                hashes.append(sums.of(start, start + length))
            h = np.concatenate(hashes)
            del hashes
            order = np.argsort(h)
            h = h[order]
            same = h[1:] == h[:-1]
            del h
            twin = np.zeros(len(order), bool)
            twin[order[1:][same]] = True
            twin[order[:-1][same]] = True
            del order, same
            twin &= np.repeat(t["asks"].to_numpy(), n)
            good = np.flatnonzero(twin)
            begin = np.cumsum(n) - n
            row = np.searchsorted(begin, good, side="right") - 1
            new = np.ones(len(good), bool)
            new[1:] = (np.diff(good) != 1) | (np.diff(row) != 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(good)) - 1 if len(good) else first
            row, s = row[first], t["s"].to_numpy()
            return _batch(rid=t["rid"].to_numpy()[row], s=s[row] + good[first] - begin[row], e=s[row] + good[last] - begin[row])

        yield from map(settle, _whole_keys(batches, CHECKED))

    in_part = parts.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "rid long, s long, e long")
    return whole.unionByName(in_part)


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of some ``least`` rows, sorted by key, each with all rows of its keys."""
    held, n, first = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        last = b.column("key")[-1].as_py()
        first = b.column("key")[0].as_py() if first is None else first
        # while all rows are of one key, which may go on, none is looked at again
        if n >= least and last != first:
            t = pa.Table.from_batches(held)
            cut = int(np.searchsorted(t["key"].to_numpy(), last))
            yield t.slice(0, cut).combine_chunks()
            held, n, first = t.slice(cut).to_batches(), t.num_rows - cut, last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _batch(**cols) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "task": pa.int32(), "said": pa.int32(), "symbols": pa.list_(pa.int64())}
    arrays = [pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(cols))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, after removing every byte of the UTF-8 text
    that a byte string of ``length`` covers which also starts elsewhere in any text.

    Matches never cross texts; null texts are empty. Repeated rows repeat one another and lose all bytes from ``length`` on. Texts
    shorter than ``length`` stay whole. An empty table gives an empty result; extra columns are ignored.
    """
    rows = bounded(docs).select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "raw"))
    ranges = repeated_ranges(rows.select("rid", "raw"), length)
    listed = written(ranges.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("at")), "bwt-ranges")
    plain = _chosen(rows.select("doc_id", "rid", "raw"), listed, wanted=False)
    n_bytes = F.length("raw").cast("long").alias("n_bytes")
    zero = F.lit(0).cast("long")
    untouched = plain.select("doc_id", n_bytes, zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"))
    met = _chosen(rows.select("doc_id", "rid", "raw"), listed).join(listed, "rid", "left").select("doc_id", "raw", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, at in zip(b.column("raw"), b.column("at").to_pylist()):
                raw = raw.as_py()
                spans: list[list[int]] = []
                for x in at or ():
                    a, z = x["s"], x["e"] + length
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                kept, begin = hashlib.sha256(), 0
                for a, z in spans:
                    kept.update(raw[begin:a])
                    begin = z
                kept.update(raw[begin:])
                out.append((len(raw), sum(z - a for a, z in spans), len(spans), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    touched = met.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return untouched.unionByName(touched).withColumnRenamed("doc_id", key)
