import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import bwt_dedup, decontaminate, ngram_join


def brute_join(rows):
    """class_id, text_id, n_links, n_copies by doc_id."""
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    classes = {}
    for i in sorted(sets):
        classes.setdefault(sets[i] or i, []).append(i)
    reps = [v[0] for k, v in classes.items() if not isinstance(k, int)]
    root, links = {r: r for r in reps}, Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in reps:
        for b in reps:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (top(v[0]) if v[0] in root else i, v[0], links[v[0]], len(v)) for v in classes.values() for i in v}


def corpus(n=60, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            base = (r.choice(rows)[1] or "x").split()
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = word()
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(word() for _ in range(r.randint(3, 90)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  "), (n + 3, "one two"), (n + 4, "one two")]


@pytest.mark.parametrize("block", [768, 4])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, rep int, bands string")
    got = {r["doc_id"]: (r["class_id"], r["text_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_join(rows)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in brute_join(rows).items() if v[0] == i)


def test_join_chain_and_empty(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"x{j}" if j < 2 * i else w for j, w in enumerate(words))) for i in range(8)]
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands():
    b = ngram_join.bands_for(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    shared, texts = [make(700) for _ in range(3)], []
    for _ in range(40):
        t = make(r.randint(0, 600))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 320)
            t += s[a : a + r.randint(300, 700)] + make(r.randint(0, 30))
        texts.append(t)
    texts += [None, "", "a" * 1500, "ab" * 900, "a" * 399, "b" * 400, texts[3], texts[3], make(5000)]
    ids = [*range(len(texts))]
    rows = [(i, t, 1) for i, t in zip(ids, texts)] + [(3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int")
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in bwt_dedup.remove_repeats(df).collect())
    want = brute_repeats([(t or "").encode() for _, t, _ in rows], 400)
    assert got == Counter((i, *w) for (i, *_), w in zip(rows, want))


def test_repeats_of_empty_table(spark):
    assert bwt_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_equals_sorting():
    rng = np.random.default_rng(2)
    for _ in range(40):
        shards = [[rng.integers(1, 4, rng.integers(1, 6)) for _ in range(rng.integers(1, 6))] for _ in range(rng.integers(1, 5))]
        words = [tuple(x.tolist()) for s in shards for x in s]
        number = bwt_dedup.equal_strings(shards)
        assert all((number[i] == number[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    # the merged transform is that of all strings together, and its prefixes are those of the sorted rotations
    a, b = [np.array([1, 2, 1]), np.array([2, 2])], [np.array([1, 2, 2]), np.array([3])]
    merged, common = bwt_dedup.merge(bwt_dedup.Transform.of(a), bwt_dedup.Transform.of(b))
    both = [tuple(x.tolist()) + (0,) for x in a + b]
    rotations = sorted((((w[i:] + w[:i]) * 12)[:12], w[i - 1]) for w in both for i in range(len(w)))
    assert merged.last.tolist() == [last for _, last in rotations]
    shared = [next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for (x, _), (y, _) in zip(rotations, rotations[1:])]
    assert common[1:].tolist() == shared


def brute_align(a, b):
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        score, matched, start, end = decontaminate.align(a, b)
        assert score == brute_align(a.tolist(), b.tolist())
        assert 0 <= start <= end <= len(b) and matched <= min(len(a), end - start)


def test_leaks(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(7))
    filler = lambda n: " ".join(r.choice(["the", "of", "and", word()]) for _ in range(n))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)] + [(5, None), (6, ""), (7, "the of and")]
    edited = items[1][1].split()
    edited[4], edited[20] = "changed", "words"
    del edited[11]
    docs = [(i, filler(300)) for i in range(40)]
    docs += [(100, filler(50) + " " + items[0][1].upper() + " " + filler(50)), (101, filler(30) + " " + " ".join(edited)), (102, items[2][1]), (103, None), (104, ""), (105, " ".join(items[3][1].split()[:8])), (102, items[2][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((x["doc_id"], x["item_id"]) for x in decontaminate.leaks(d, b).collect())
    assert got == Counter({(100, 0): 1, (101, 1): 1, (102, 2): 2})
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted([*range(40), 103, 104, 105])
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0


def test_leak_shared_by_most_documents(spark):
    # the seeds of a leak that most documents hold are not dismissed as common
    r = random.Random(3)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(7))
    item = " ".join(word() for _ in range(25))
    docs = [(i, " ".join(word() for _ in range(200)) + (" " + item if i % 3 else "")) for i in range(90)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {x["doc_id"] for x in got.collect()} == {i for i in range(90) if i % 3}


def leaked(spark, docs, items):
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return Counter((x["doc_id"], x["item_id"]) for x in got.collect())


def test_seeds_hold_at_any_table_size_and_skew(spark):
    # copies of one short leak in a third of the rows, and tables of few words
    r = random.Random(5)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(7))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short, common = text(20), text(5), "the of and"
    docs = [(i, text(30)) for i in range(200)] + [(1000 + i, long) for i in range(100)]
    assert leaked(spark, docs, [(1, long)]) == Counter({(1000 + i, 1): 1 for i in range(100)})
    docs = [(i, text(30) + " the of and the of the and of and") for i in range(60)] + [(1000 + i, f"{word()} {short}") for i in range(60)]
    assert leaked(spark, docs, [(1, short), (2, common)]) == Counter({(1000 + i, 1): 1 for i in range(60)})
    assert leaked(spark, [(0, text(80)), (1, long), (2, text(80))], [(1, long)]) == Counter({(1, 1): 1})
    assert leaked(spark, [(0, text(80)), (1, short), (2, text(80))], [(1, short)]) == Counter({(1, 1): 1})


def test_copy_with_long_insertions(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(7))
    text = lambda n: [word() for _ in range(n)]
    item = text(60)
    edited = item.copy()
    edited[10], edited[45] = word(), word()
    docs = [(n, " ".join([*text(50), *edited[:30], *text(n), *edited[30:], *text(400)])) for n in (0, 36, 42, 70)]
    pieces = [w for i in range(0, 60, 10) for w in [*item[i : i + 10], *text(9)]]
    docs += [(100, " ".join([*text(200), *pieces, *text(200)])), (101, " ".join([*item[:28], *text(300), *item[32:]]))]
    assert leaked(spark, docs, [(1, " ".join(item))]) == Counter({(i, 1): 1 for i in (0, 36, 42, 100)})


def test_texts_under_one_item_id(spark):
    r = random.Random(7)
    text = lambda n: " ".join("".join(r.choice("klmnopqrst") for _ in range(7)) for _ in range(n))
    a, b, c, d = (text(30) for _ in range(4))
    docs = [(i, f"{text(20)} {t}") for i, t in enumerate([a, b, c, d])] + [(9, text(50))]
    items = [(1, a), (1, b), (1, a), (None, c), (None, d)]
    assert leaked(spark, docs, items) == Counter({(0, 1): 1, (1, 1): 1, (2, None): 1, (3, None): 1})
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [x["doc_id"] for x in decontaminate.clean(*frames).collect()] == [9]


def test_excerpt_of_a_long_item(spark):
    r = random.Random(8)
    text = lambda n: ["".join(r.choice("klmnopqrst") for _ in range(7)) for _ in range(n)]
    item = text(500)
    parts = [item[100:340], item[440:], item[:50], item[:49], item[200:240]]
    docs = [(i, " ".join([*text(80), *p, *text(80)])) for i, p in enumerate(parts)]
    assert leaked(spark, docs, [(1, " ".join(item))]) == Counter({(0, 1): 1, (1, 1): 1, (2, 1): 1})


def test_join_of_two_texts_under_one_id(spark):
    r = random.Random(10)
    words = lambda: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
    a, b = words(), words()
    near = lambda ws: " ".join([*ws[:-2], "other", "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, near(b) + " more"), (5, " ".join(words()))]
    got = Counter(tuple(x) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "text_id", "n_links").collect())
    assert got == Counter([(1, 1, 1, 1), (1, 1, 1, 2), (2, 1, 2, 1), (3, 1, 3, 2), (4, 1, 4, 2), (5, 5, 5, 0)])
    # both texts in the same bucket of a band
    rows = [(1, " ".join(a)), (1, near(a)), (0, near(a) + " more")]
    got = Counter(tuple(x) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect())
    assert got == Counter([(1, 0, 2), (1, 0, 2), (0, 0, 2)])


@pytest.mark.parametrize("block,grams,large", [(4, 1 << 20, 5), (768, 400, 2048), (1, 300, 3)])
def test_large_buckets_equal_brute_force(spark, monkeypatch, block, grams, large):
    for name, v in (("BLOCK", block), ("BLOCK_GRAMS", grams), ("LARGE_BLOCK", large), ("TILE", 3)):
        monkeypatch.setattr(ngram_join, name, v)
    r = random.Random(12)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    rows = corpus(30, 4)
    for i in range(100, 160):  # a hot group of near copies
        w = base.copy()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 30)}"
        rows.append((i, " ".join(w[: r.randint(100, 120)])))
    got = {x["doc_id"]: (x["class_id"], x["text_id"], x["n_links"], x["n_copies"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)


def test_one_of_each_with_several_texts_under_an_id(spark):
    r = random.Random(13)
    words = lambda: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
    a, b = words(), words()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (0, " ".join(b) + " end"), (5, " ".join(a) + " end"), (7, None), (None, " ".join(a))]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([rows[0], rows[2], rows[4], rows[5]])


@pytest.mark.parametrize("hot,offsets,rows_", [(3, 7, 1), (2, 32, 10), (10**6, 1, 4096)])
def test_hot_anchors_equal_brute_force(spark, monkeypatch, hot, offsets, rows_):
    # one passage in most texts, between different words, so that many stretches share its anchors
    for name, v in (("HOT", hot), ("OFFSETS", offsets), ("CHECKED", rows_), ("MERGED", rows_)):
        monkeypatch.setattr(bwt_dedup, name, v)
    r = random.Random(21)
    make = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    passage = make(650)
    texts = [make(r.randint(0, 300)) + passage[r.randint(0, 120) : r.randint(500, 650)] + make(r.randint(0, 300)) for _ in range(60)] + [make(900), passage, passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in bwt_dedup.remove_repeats(df).collect())
    assert got == Counter((i, *w) for i, w in enumerate(brute_repeats([t.encode() for t in texts], 400)))
