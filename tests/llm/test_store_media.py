import hashlib
import tarfile
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from docloom.llm import common, media_tar, token_count, token_store  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World!", "it's a test.", "x\x1cy a\x85b\xa0c", "é I'm we'LL", "日本語 123 😀😀", "<|endoftext|> a", "a " * 5000, "same text here " * 40, "same text here " * 40, "İΣΑΣ don't."]
ROWS = [(i, t, "en", i) for i, t in enumerate(TEXTS)] + [(9, "same text here " * 40, None, 0), (3, "another row of one id", "x", 1)]
SCHEMA = "doc_id long, text string, part string, start long"  # extra columns with names that the operators use


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [2]


def test_codec_equals_whole_text():
    flat, lens = token_store.WordCodec(VOCABULARY).encode([t or "" for t in TEXTS])
    ends = np.cumsum(lens)
    for t, n, end in zip(TEXTS, lens, ends):
        assert flat[end - n : end].tolist() == reference_ids(t)[:-1]


def test_store_round_trip(spark):
    at = common.fresh(spark, "tokens")
    token_store.write_store(spark.createDataFrame(ROWS, SCHEMA), at, VOCABULARY)
    got = sorted((r for r in token_store.read_store(spark, at, ids=True).collect()), key=lambda r: r["start"])
    assert [r["key"] for r in got] == sorted(r[0] for r in ROWS)
    start = 0
    left = {}
    for i, t, *_ in ROWS:
        left.setdefault(i, []).append(np.array(reference_ids(t), "<u4").tobytes())
    for r in got:
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["n_tokens"] * 4 == len(r["ids"])
        left[r["key"]].remove(bytes(r["ids"]))
        start += r["n_tokens"]
    # each chunk is stored once
    chunks = spark.read.parquet(f"{at}/chunks").collect()
    assert len({bytes(c["digest"]) for c in chunks}) == len(chunks)
    stored = sum(c["length"] for c in chunks)
    assert stored < sum(len(reference_ids(t)) * 2 for _, t, *_ in ROWS) - 150


def test_damage_is_found(spark):
    at = common.fresh(spark, "tokens")
    token_store.write_store(spark.createDataFrame(ROWS[2:4], SCHEMA), at, VOCABULARY)
    import glob

    pack = glob.glob(f"{at.removeprefix('file://')}/packs/*.ids")[0]
    raw = bytearray(open(pack, "rb").read())
    raw[0] ^= 1
    open(pack, "wb").write(raw)
    with pytest.raises(Exception, match="root"):
        token_store.read_store(spark, at).collect()


def test_cuts_follow_content():
    ids = np.random.default_rng(0).integers(0, 49000, 6000).astype("<u2")
    a, b = token_store.cuts(ids), token_store.cuts(np.concatenate([ids[:500], ids[:7], ids[500:]]))
    ends = np.array(a) + 7
    assert len(set(ends[len(a) // 3 :]) & set(b)) >= len(a) // 3
    assert all(token_store.LEAST <= y - x <= token_store.MOST for x, y in zip([0, *a[:-2]], a[:-1]))


def test_empty_store(spark):
    got = token_store.token_output(spark.createDataFrame([], SCHEMA), VOCABULARY)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


def test_media(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, shard string, digest long")
    got = media_tar.media_columns(df).collect()
    assert len(got) == len(ROWS)
    want = sorted((i, len((t or "").encode())) for i, t, *_ in ROWS)
    assert sorted((r["doc_id"], r["n_bytes"]) for r in got) == want
    shards = {}
    for r in got:
        shards.setdefault(bytes(r["digest"]), set()).add((r["shard"], r["offset"], r["length"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in shards.values()) and len(shards) == len({t or "" for t in TEXTS} | {"another row of one id"})
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        hits = [r for r in got if r["doc_id"] == i and r["payload_sha256"] == hashlib.sha256(pad).hexdigest()]
        assert hits and hits[0]["tail_crc32"] == zlib.crc32(pad[-32:]) and hits[0]["width"] * hits[0]["height"] == len(pad) == hits[0]["payload_bytes"]


def test_tar_is_tar(spark):
    at = common.fresh(spark, "media")
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, b"d")], "k long, p binary")
    got = media_tar.store(rows.select(F.col("k"), F.col("p")), "k", "p", at).collect()
    assert len({r["digest"] for r in map(lambda r: {"digest": bytes(r["digest"])}, got)}) == 2
    for r in got:
        with tarfile.open(f"{at.removeprefix('file://')}/{r['shard']}") as t:
            data = t.extractfile(f"{bytes(r['digest']).hex()}.png").read()
        assert len(data) == r["length"] and media_tar.decode_png(data)[: r["n_bytes"]] == (b"abc" if r["key"] < 3 else b"d")
    assert media_tar.store(rows.limit(0), "k", "p", common.fresh(spark, "media")).count() == 0


def greedy(pieces, word):
    symbols, n = [*word.encode(), 256], 0
    while symbols:
        k = next((k for k in range(len(symbols), 0, -1) if tuple(symbols[:k]) in pieces), 0)
        if not k:
            return None
        symbols, n = symbols[k:], n + 1
    return n


def test_automaton_equals_greedy():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pieces = {tuple(rng.integers(97, 100, rng.integers(1, 5)).tolist()) + ((256,) if rng.random() < 0.4 else ()) for _ in range(rng.integers(1, 14))}
        a = token_count.Automaton(sorted(pieces))
        for _ in range(60):
            w = "".join(map(chr, rng.integers(97, 100, rng.integers(0, 9))))
            assert a.count(w.encode()) == greedy(pieces, w)


def test_token_counts(spark):
    c = token_count.Counter(VOCABULARY)
    got = {(r["doc_id"], r["n_tokens"]) for r in token_count.token_counts(spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string, x long"), VOCABULARY).collect()}
    assert got == {(i, c.text(t or "")) for i, t, *_ in ROWS}
    pieces = None
    import json

    letters = token_count.byte_letters()
    pieces = {(*(letters[x] for x in p.removesuffix("</w>")), *((256,) if p.endswith("</w>") else ())) for p in json.load(open(VOCABULARY))["model"]["vocab"]}
    for w in ("unbelievably", "thhehesh", "éèaux", "a"):
        assert c.word(w) == greedy(pieces, w)


def test_null_payloads_are_stored(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"x"), (4, None)], "k long, p binary")
    got = {r["key"]: r for r in media_tar.store(rows, "k", "p", common.fresh(spark, "media")).collect()}
    assert sorted(got) == [1, 2, 3, 4] and [got[k]["n_bytes"] for k in (1, 2, 3, 4)] == [0, 0, 1, 0]
    assert got[1]["digest"] == got[2]["digest"] == got[4]["digest"] and got[1]["offset"] == got[2]["offset"]


def _damaged(spark, damage, schema=SCHEMA):
    """Write a store of some documents in several parts, damage it, and read it."""
    at = common.fresh(spark, "tokens")
    token_store.write_store(spark.createDataFrame([(i, f"word{i} " * (300 + i), "x", 0) for i in range(12)], schema), at, VOCABULARY)
    assert len(token_store.read_store(spark, at).collect()) == 12
    damage(at)
    with pytest.raises(Exception, match="chunk|root|part|manifest|length|place"):
        token_store.read_store(spark, at).collect()


def _rewrite(spark, path, schema, change):
    rows = change([r.asDict() for r in spark.read.schema(schema).parquet(path).collect()])
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


@pytest.mark.parametrize("lost", [0, 5, 11])
def test_lost_chunk_is_found(spark, lost):
    _damaged(spark, lambda at: _rewrite(spark, f"{at}/chunks", token_store.CHUNKS, lambda rows: rows[:lost] + rows[lost + 1 :]))


def _roots_swapped(rows):
    rows[0]["root"], rows[-1]["root"] = rows[-1]["root"], rows[0]["root"]
    return rows


@pytest.mark.parametrize("change", [lambda r: r[1:], lambda r: [*r[:-1], r[-1] | {"root": b"\0" * 16}], lambda r: [*r[:-1], r[-1] | {"n_docs": 1}], _roots_swapped])
def test_damage_to_the_manifest_is_found(spark, change):
    _damaged(spark, lambda at: _rewrite(spark, f"{at}/manifest", token_store.MANIFEST, change))


def _swap_recipes(rows):
    rows[0]["key"], rows[0]["root"], rows[0]["chunks"] = rows[0]["key"], rows[1]["root"], rows[1]["chunks"]
    return rows


@pytest.mark.parametrize("change", [lambda r: r[1:], lambda r: [r[0] | {"chunks": []}, *r[1:]], lambda r: [*r, r[0]], _swap_recipes])
def test_damage_to_the_recipes_is_found(spark, change):
    _damaged(spark, lambda at: _rewrite(spark, f"{at}/recipes/kind=0", token_store.RECIPES, change))


def test_damage_to_the_store_row_is_found(spark):
    _damaged(spark, lambda at: _rewrite(spark, f"{at}/store", token_store.STORE, lambda r: [r[0] | {"n_docs": 11}]))


def test_lost_pack_is_found(spark):
    import glob
    import os

    def lose(at):
        os.remove(glob.glob(f"{at.removeprefix('file://')}/packs/*.ids")[0])

    at = common.fresh(spark, "tokens")
    token_store.write_store(spark.createDataFrame(ROWS, SCHEMA), at, VOCABULARY)
    lose(at)
    with pytest.raises(Exception):  # noqa: B017
        token_store.read_store(spark, at).collect()


def test_equal_rows_spread_and_count(spark):
    rows = [(1, "same text " * 20, "x", 0)] * 60 + [(2, "b", "x", 0), (None, "n", "x", 0)]
    got = sorted(token_store.token_output(spark.createDataFrame(rows, SCHEMA), VOCABULARY).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] + [1] * 60 + [2]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_trees_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(token_store, "LEAVES", 4)
    got = token_store.token_output(spark.createDataFrame([(i, f"t{i}", "x", 0) for i in range(90)], SCHEMA), VOCABULARY)
    assert got.count() == 90


def test_no_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
