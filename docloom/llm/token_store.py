"""Token-ID output: a content-addressed store of id streams.

Format (a folder): ``packs/*.ids`` hold unique chunks of little-endian ids back to back; ``recipes`` (Parquet) has, in ascending
document order, each document's place in the whole stream, its Merkle root and the digests of its chunks; ``chunks`` (Parquet)
names the pack, offset and length of each digest; ``manifest`` (Parquet) has the documents, ids and Merkle root of each recipe
part; ``store`` (Parquet, one row) has their sums and the Merkle root over the parts. Reading verifies all of these.
A rolling hash over the last 16 ids cuts a document's stream where it meets a mask, so equal passages give equal chunks.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded, discard, forget, fresh, shuffle_partitions, worker_cache, written

END_ID = 2
RECIPES, CHUNKS = "part int, row long, key long, start long, n_tokens long, root binary, chunks array<binary>", "digest binary, place long, length int"
MANIFEST, STORE = "part int, n_docs long, n_tokens long, root binary, base long", "n_parts long, n_docs long, n_tokens long, root binary"
#: Documents whose roots make one node of a part's tree.
LEAVES = 1 << 16
#: Ids of a chunk: least, mask of the rolling hash (one cut in MASK + 1 ids), most.
LEAST, MASK, MOST = 128, 0xFF, 2048
WINDOW = 16
#: Words that a worker remembers with their ids; beyond that it forgets the rarest half and more. (An executor may run several
#: workers in turn, and each keeps its own.)
CACHED_WORDS = 450_000
#: A pack is closed beyond this many bytes. A place is a number: pack << PLACE_BITS | offset.
PACK_BYTES, PLACE_BITS = 64 << 20, 27

#: White space as the tokenizer's pattern has it; str.split() also splits at four control characters.
_WORD = re.compile("[^\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = re.compile("[\x1c-\x1f]")

#: Signs that may follow a word of letters; together they are one pre-token.
TAIL = ".,;:!?%$&*#()[]-"


class WordCodec:
    """Encodes whole texts with a tokenizer whose pre-tokens never cross white space, one call for each unseen word.

    The ids of a text are then those of its white-space-separated words in order (the tests hold this against whole texts).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # words of letters come to this one in normal form and lower case; its cache would only cost time
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        bytes_ = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_]}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.plain.model._resize_cache(0)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        #: place of each word; an unseen word gets the next place and waits in ``unseen``
        self.known, self.unseen = _Places(), []
        self.known.unseen = self.unseen
        self.cores: dict[str, int] = {}
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.core_starts, self.core_lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        #: how often each word occurred
        self.count = np.zeros(1 << 16, np.int64)

    def _forget(self) -> None:
        """Keep the words that occurred most often, half of CACHED_WORDS at most."""
        count = self.count[: len(self.known)]
        kept = count > max(1, int(np.partition(count, -CACHED_WORDS // 2)[-CACHED_WORDS // 2]))
        words, starts, lens = list(compress(self.known, kept.tolist())), self.starts[: len(kept)][kept], self.lens[: len(kept)][kept]
        flat = self.flat[_ranges(starts, lens)]
        self.clear()
        self.known.update(zip(words, range(len(words))))
        self.starts, self.lens = _grown(self.starts, len(words)), _grown(self.lens, len(words))
        self.starts[: len(words)], self.lens[: len(words)] = self._keep(flat) + np.cumsum(lens) - lens, lens

    def _keep(self, ids: np.ndarray) -> int:
        """Append ids to the flat array; where they begin."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _cores(self, cores: list[str]) -> None:
        """Learn words of letters alone: each is one pre-token, whose last id ends a word."""
        for at in range(0, len(cores), 20_000):
            part = cores[at : at + 20_000]
            joined = [" ".join(part[i : i + 200]) for i in range(0, len(part), 200)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a word of letters is not one pre-token of this tokenizer")
            k = len(self.cores)
            self.core_starts, self.core_lens = _grown(self.core_starts, k + len(part)), _grown(self.core_lens, k + len(part))
            n = np.diff(ends, prepend=0)
            self.core_starts[k : k + len(part)] = self._keep(ids) + ends - n
            self.core_lens[k : k + len(part)] = n
            self.cores.update(zip(part, range(k, k + len(part))))

    def _learn(self) -> None:
        words, cores = self.unseen, self.cores
        self.unseen = self.known.unseen = []
        first = len(self.known) - len(words)
        self.starts, self.lens = _grown(self.starts, len(self.known)), _grown(self.lens, len(self.known))
        heads = [w.rstrip(TAIL) for w in words]
        # letters below U+0130 are in normal form and have one lower-case letter each
        whole = np.array([c.isalpha() and (c.isascii() or max(c) < "\u0130") for c in heads], bool)
        places, odd = np.flatnonzero(whole), np.flatnonzero(~whole).tolist()
        if odd:
            words_, heads = words, [h for h, x in zip(heads, whole.tolist()) if x]
            words = [w for w, x in zip(words, whole.tolist()) if x]
        else:
            words_ = words
        plain = [h.lower() for h in heads]
        tails = [w[len(h) :] for w, h in zip(words, heads)]
        self._cores(list(set(plain).difference(cores)))
        if len(places):
            of = np.fromiter(map(cores.__getitem__, plain), np.int64, len(plain))
            at = places + first
            self.starts[at], self.lens[at] = self.core_starts[of], self.core_lens[of]
        endings = {t: i for i, t in enumerate(dict.fromkeys(tails))}
        pieces = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if t else [], np.uint32) for t in endings]
        if len(places):
            self._join(at, np.array([len(x) for x in pieces]), np.concatenate(pieces), np.fromiter(map(endings.__getitem__, tails), np.int64, len(tails)))
        for at in range(0, len(odd), 1000):
            part = odd[at : at + 1000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words_[i] for i in part], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                self.starts[first + i], self.lens[first + i] = self._keep(ids), len(ids)

    def _join(self, words: np.ndarray, tail_lens: np.ndarray, tail_ids: np.ndarray, tail: np.ndarray) -> None:
        """Give each of ``words``, which have their core's ids so far, the ids of its tail too."""
        some = tail_lens[tail] > 0
        words, tail = words[some], tail[some]
        head, after = self.lens[words], tail_lens[tail]
        n = head + after
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        out[_ranges(begin, head)] = self.flat[_ranges(self.starts[words], head)]
        out[_ranges(begin + head, after)] = tail_ids[_ranges((np.cumsum(tail_lens) - tail_lens)[tail], after)]
        self.starts[words], self.lens[words] = self._keep(out) + begin, n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each."""
        split = [_WORD.findall(t) if _CONTROL.search(t) else t.split() for t in texts]
        if len(self.known) > CACHED_WORDS:
            self._forget()
        place = self.known.__getitem__
        words = np.concatenate([np.fromiter(map(place, x), np.int64, len(x)) for x in split]) if split else np.zeros(0, np.int64)
        if self.unseen:
            self._learn()
        self.count = _grown(self.count, len(self.known))
        self.count[: len(self.known)] += np.bincount(words, minlength=len(self.known))
        n = self.lens[words]
        upto = np.cumsum(n)
        at = _ranges(self.starts[words], n)
        count = np.array([len(x) for x in split], np.int64)
        ends = np.concatenate([[0], upto])[np.cumsum(count)]
        return self.flat[at], np.diff(ends, prepend=0)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``starts`` and have ``lens`` numbers."""
    upto = np.cumsum(lens)
    return np.repeat(starts - (upto - lens), lens) + np.arange(int(upto[-1]) if len(upto) else 0)


class _Places(dict):
    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.unseen.append(word)
        return k


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, len(a)), a.dtype)])


def codec(path: str) -> WordCodec:
    return worker_cache(("codec", path), lambda: WordCodec(path))


def _gear(ids: np.ndarray) -> np.ndarray:
    """A hash of each id and the 15 before it, by doubling."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] * np.uint32(pow(2246822519, step, 1 << 32))
        step *= 2
    return h ^ (h >> np.uint32(16))


def marks(ids: np.ndarray) -> list[int]:
    """The places after which the rolling hash of an id stream allows a cut. Streams may follow one another: the hash looks back
    WINDOW ids, fewer than the LEAST of a chunk, so marks that count never see another stream."""
    return (np.flatnonzero((_gear(ids) & np.uint32(MASK)) == 0) + 1).tolist()


def cut(marks_: list[int], at: int, end: int) -> list[int]:
    """Ends of the chunks of the stream from ``at`` to ``end``: at marks, at least LEAST and at most MOST ids apart."""
    out = []
    while end - at > LEAST:
        k = bisect_left(marks_, at + LEAST)
        at = min(marks_[k] if k < len(marks_) else end, at + MOST, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return cut(marks(ids), 0, len(ids))


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [b"\0" * 16]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class _Packs:
    """Packs of one task attempt, named by it, so that a repeated task writes others and rows name those of the one that counts."""

    def __init__(self, at: str):
        self.fs, self.root = pafs.FileSystem.from_uri(at)
        self.out, self.number, self.offset = None, TaskContext.get().taskAttemptId() << 10, 0

    def add(self, data: bytes) -> int:
        """Append and return the place."""
        if self.out is None or self.offset > PACK_BYTES:
            self.close()
            self.fs.create_dir(self.root, recursive=True)
            self.number, self.offset = self.number + 1, 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.number}.ids", buffer_size=1 << 20)
        self.out.write(data)
        self.offset += len(data)
        return self.number << PLACE_BITS | self.offset - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some 4 MB of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (4 << 20))))
        yield batch.slice(at, end - at)
        at = end


def _lists(upto: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values)


def write_store(docs: DataFrame, at: str, tokenizer_path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text of ``docs`` (null: empty) and write the store under the folder ``at``.

    Rows with one key are ordered by their Merkle root. A null key sorts first. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    staging = fresh(spark, "staging")
    ids_type = "<u2" if _vocabulary(tokenizer_path) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, seen, words = _Packs(staging), {}, codec(tokenizer_path)
        gc.disable()  # nothing here makes cycles, and the words make many objects to look through
        try:
            for whole in batches:
                for b in _sliced(whole):
                    flat, lens = words.encode([x or "" for x in b.column(1).to_pylist()])
                    # each document's ids with its end id, one after the other
                    ends = np.cumsum(lens + 1)
                    ids = np.full(len(flat) + len(lens), end_id, ids_type)
                    inner = np.ones(len(ids), bool)
                    inner[ends - 1] = False
                    ids[inner] = flat
                    allowed, size, raw = marks(ids), ids.itemsize, ids.tobytes()
                    n_tokens, roots, upto, digests, places, lengths = [], [], [0], [], [], []
                    for n, end in zip((lens + 1).tolist(), ends.tolist()):
                        begin = end - n
                        for to in cut(allowed, begin, end):
                            data = raw[begin * size : to * size]
                            begin = to
                            d = _digest(data)
                            place = seen.get(d)
                            if place is None:
                                if len(seen) >= 1 << 20:
                                    seen.clear()
                                place = seen[d] = packs.add(data)
                            digests.append(d), places.append(place), lengths.append(len(data))
                        n_tokens.append(n), roots.append(merkle(digests[upto[-1] :])), upto.append(len(digests))
                    lists = (_lists(upto, pa.array(v, t)) for v, t in ((digests, pa.binary()), (places, pa.int64()), (lengths, pa.int32())))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(roots, pa.binary()), *lists], names=["key", "n_tokens", "root", "chunks", "places", "lengths"])
        finally:
            gc.enable()
            packs.close()

    staged = written(bounded(docs).select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(encode, "key long, n_tokens long, root binary, chunks array<binary>, places array<long>, lengths array<int>"), "staged")

    # one owner for each digest; its bytes move to the final pack, the others are left behind
    each = staged.select(F.explode(F.arrays_zip("chunks", "places", "lengths")).alias("c")).select("c.*")
    owners = each.groupBy(F.col("chunks").alias("digest")).agg(F.min("places").alias("place"), F.min("lengths").alias("length"))

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, held, f, position = _Packs(f"{at}/packs"), None, None, 0
        fs, root = pafs.FileSystem.from_uri(staging)
        try:
            for b in batches:
                place, length = b.column("place").to_numpy(), b.column("length").to_numpy()
                out = np.zeros(len(place), np.int64)
                # stretches of neighbouring chunks move at once
                cut = np.flatnonzero(place[1:] != place[:-1] + length[:-1]) + 1
                for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(place)]) if len(place) else ():
                    pack, offset = int(place[i]) >> PLACE_BITS, int(place[i]) & (1 << PLACE_BITS) - 1
                    if pack != held:
                        f, held, position = fs.open_input_stream(f"{root}/{pack}.ids", buffer_size=4 << 20), pack, 0
                    f.read(offset - position)
                    size = int(length[i:j].sum())
                    position = offset + size
                    # in pieces, so that a pack stays near its size
                    while i < j:
                        k = i + max(1, int(np.searchsorted(np.cumsum(length[i:j]), 4 << 20)))
                        out[i:k] = packs.add(f.read(int(length[i:k].sum()))) + np.cumsum(length[i:k]) - length[i:k]
                        i = k
                yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(out), b.column("length")], names=["digest", "place", "length"])
        finally:
            packs.close()

    pack = F.shiftright("place", PLACE_BITS)
    chunks = owners.repartition(pack).sortWithinPartitions("place").mapInArrow(compact, CHUNKS)
    chunks.write.parquet(f"{at}/chunks")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, docs_before, roots, kept = TaskContext.get().partitionId(), 0, 0, [], []
        names = ["kind", "part", "row", "key", "start", "n_tokens", "root", "chunks"]
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            start = before + np.cumsum(n) - n
            row = np.arange(docs_before, docs_before + len(n))
            before, docs_before = before + int(n.sum()), docs_before + len(n)
            roots += b.column("root").to_pylist()
            while len(roots) >= LEAVES:
                kept, roots = [*kept, merkle(roots[:LEAVES])], roots[LEAVES:]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(np.full(len(n), part, np.int32)), pa.array(row), b.column("key"), pa.array(start, pa.int64()), b.column("n_tokens"), b.column("root"), b.column("chunks")], names=names)
        if docs_before:
            root = merkle([*kept, merkle(roots)] if roots else kept)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([part], pa.int32()), pa.array([docs_before], pa.int64()), pa.array([None], pa.int64()), pa.array([before], pa.int64()), pa.array([before], pa.int64()), pa.array([root], pa.binary()), pa.array([[]], pa.list_(pa.binary()))], names=names)

    # equal rows may stand in any order, so their place in the staged table tells them apart and no range holds all copies
    order = ["key", "root", "place"]
    ordered = staged.select("key", "n_tokens", "root", "chunks", F.monotonically_increasing_id().alias("place")).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("place")
    ordered.mapInArrow(number, f"kind int, {RECIPES}").write.partitionBy("kind").parquet(f"{at}/recipes")
    # a row for each recipe part: their number is the number of partitions
    parts = spark.read.schema(f"{RECIPES}, kind int").parquet(f"{at}/recipes").filter("kind = 1").select("part", F.col("row").alias("n_docs"), "n_tokens", "root")
    parts.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).write.parquet(f"{at}/manifest")
    spark.createDataFrame([_sums(spark, at)], STORE).coalesce(1).write.parquet(f"{at}/store")
    discard(spark, staging)
    forget(staged)


def _sums(spark: SparkSession, at: str) -> tuple[int, int, int, bytes]:
    """What the store's row says of its manifest: parts, documents, ids, and the root over the parts."""
    rows = sorted(spark.read.schema(MANIFEST).parquet(f"{at}/manifest").toArrow().to_pylist(), key=lambda r: r["part"])
    leaves = [b"%d %d %d " % (r["part"], r["n_docs"], r["n_tokens"]) + r["root"] for r in rows]
    base = 0
    for r in rows:
        if r["base"] != base:
            raise ValueError(f"part {r['part']} of the manifest begins at another place")
        base += r["n_tokens"]
    return len(rows), sum(r["n_docs"] for r in rows), base, merkle(leaves)


def _verified_parts(spark: SparkSession, at: str, recipes: DataFrame) -> DataFrame:
    """part and base of each part of the manifest or the recipes; the base of a part whose recipes do not give the manifest's root,
    or their number, is an error."""

    def roots(name: str, column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [merkle([x["root"] for x in r]) for r in b.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.binary())], names=[*b.schema.names[:-1], name])

        return run

    # the leaves of one node at a time, then the nodes of a part
    listed = recipes.groupBy("part", F.floor(F.col("row") / LEAVES).alias("row")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids"), F.array_sort(F.collect_list(F.struct("row", "root"))).alias("leaves"))
    nodes = listed.mapInArrow(roots("root", "leaves"), "part int, row long, n long, ids long, root binary")
    listed = nodes.groupBy("part").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.array_sort(F.collect_list(F.struct("row", "root"))).alias("nodes"))
    found = listed.mapInArrow(roots("r_root", "nodes"), "r_part int, n long, ids long, r_root binary")
    manifest = spark.read.schema(MANIFEST).parquet(f"{at}/manifest")
    both = manifest.join(found, F.col("part") == F.col("r_part"), "full_outer")
    same = F.col("root").eqNullSafe(F.col("r_root")) & F.col("n_docs").eqNullSafe(F.col("n")) & F.col("n_tokens").eqNullSafe(F.col("ids"))
    wrong = F.raise_error(F.concat(F.lit("the recipes of part "), F.coalesce("part", "r_part").cast("string"), F.lit(" do not give the manifest's root")))
    return both.select(F.coalesce("part", "r_part").alias("part"), F.when(same, F.col("base")).otherwise(wrong.cast("long")).alias("base"))


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def read_store(spark: SparkSession, at: str, wide: bool = False, ids: bool = False) -> DataFrame:
    """Documents of the store in their order's numbers: key, start, n_tokens, ids_crc32 (and ``ids``, little-endian 32-bit, if asked).

    The manifest is verified against the store's row, each part's recipes against the manifest's root and counts, and the chunks,
    which are hashed as they are read, against each document's root and length. Damage and loss raise: here, or as rows are read.
    ``wide``: the store has 4 bytes an id.
    """
    said = spark.read.schema(STORE).parquet(f"{at}/store").toArrow().to_pylist()
    if [tuple(r.values()) for r in said] != [_sums(spark, at)]:
        raise ValueError("the manifest does not match the store's root")
    recipes = spark.read.schema(f"{RECIPES}, kind int").parquet(f"{at}/recipes").filter("kind = 0").drop("kind")
    # a row for each recipe part: their number is the number of partitions that wrote them
    base = F.broadcast(_verified_parts(spark, at, recipes.select("part", "row", "n_tokens", "root")))
    pieces = recipes.select("part", "key", "start", "n_tokens", "root", F.posexplode_outer("chunks").alias("n", "digest"))
    found = pieces.join(spark.read.schema(CHUNKS).parquet(f"{at}/chunks"), "digest", "left")
    found = found.withColumn("place", F.coalesce("place", F.raise_error(F.concat(F.lit("no chunk "), F.coalesce(F.hex("digest"), F.lit("of a document")))).cast("long")))
    listed = found.groupBy("part", "start", "key", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("n", "place", "length"))).alias("c"))
    listed = listed.select("part", "start", "key", "n_tokens", "root", F.transform("c", lambda x: x["place"]).alias("places"), F.transform("c", lambda x: x["length"]).alias("lengths"))
    # documents of one stretch of a pack are read by one task, in the pack's order
    listed = listed.withColumn("first", F.col("places")[0]).repartitionByRange(shuffle_partitions(spark), "first", "start").sortWithinPartitions("first").drop("first")
    ids_type = "<u4" if wide else "<u2"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{at}/packs")
        files: dict[int, object] = {}

        def fetch(place: int, size: int) -> bytes:
            pack = place >> PLACE_BITS
            if pack not in files:
                if len(files) >= 32:
                    files.pop(next(iter(files))).close()
                files[pack] = fs.open_input_file(f"{root}/{pack}.ids")
            return files[pack].read_at(size, place & (1 << PLACE_BITS) - 1)

        for b in batches:
            places, lengths = b.column("places"), b.column("lengths")
            upto, place, length = places.offsets.to_numpy(), places.values.to_numpy(), lengths.values.to_numpy()
            crcs, datas, ns = [], [], []
            for k, want in enumerate(b.column("root").to_pylist()):
                p, n = place[upto[k] : upto[k + 1]], length[upto[k] : upto[k + 1]]
                cut = (np.flatnonzero(p[1:] != p[:-1] + n[:-1]) + 1).tolist()
                raw = b"".join(fetch(int(p[i]), int(n[i:j].sum())) for i, j in zip([0, *cut], [*cut, len(p)]))
                ends = np.cumsum(n).tolist()
                if merkle([_digest(raw[i:j]) for i, j in zip([0, *ends], ends)]) != want:
                    raise ValueError(f"document root {want.hex()} does not match")
                data = np.frombuffer(raw, ids_type).astype("<u4").tobytes()
                crcs.append(zlib.crc32(data)), ns.append(len(data) // 4)
                datas.append(data if ids else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "start", "key", "n_tokens")), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64()), pa.array(datas, pa.binary())], names=["part", "start", "key", "n_tokens", "n_read", "ids_crc32", "ids"])

    rows = listed.mapInArrow(read, "part int, start long, key long, n_tokens long, n_read long, ids_crc32 long, ids binary").join(base, "part", "left")
    checked = F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_read")).otherwise(F.raise_error(F.lit("a document has another length")).cast("long"))
    return rows.select("key", (F.col("start") + F.coalesce("base", F.raise_error(F.lit("a part without a manifest")).cast("long"))).alias("start"), checked.alias("n_tokens"), "ids_crc32", *["ids"] * ids)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, key: str = "doc_id") -> DataFrame:
    """Write ``docs`` to a new store of the shared folder and read it back: key, start, n_tokens, ids_crc32."""
    at = fresh(docs.sparkSession, "tokens")
    write_store(docs, at, tokenizer_path, end_id, key)
    return read_store(docs.sparkSession, at, wide=_vocabulary(tokenizer_path) > 1 << 16).withColumnRenamed("key", key)
