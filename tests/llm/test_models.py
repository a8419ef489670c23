import random
import zlib

from docloom.llm import langid, toxicity


def words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def test_toxicity_held_out(spark):
    r = random.Random(1)
    rows = []
    for i in range(700):
        bad = i % 5 == 0
        w = words(r, "abcdeinorst", r.randint(20, 200)).split()
        for _ in range(r.randint(1, 4) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["zugvilk", "murxbold", "quasmig"]))
        rows.append((i, " ".join(w), int(bad)))
    scorer = toxicity.fit([(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1])
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(1000, None, 0.1), (1001, "", 0.1), (0, rows[0][1], 0.2)], "doc_id long, text string, score double")
    got = [(r_["doc_id"], r_["score"]) for r_ in toxicity.toxicity(docs, scorer).collect()]
    assert len(got) == 703 and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    held = [(by[i] >= toxicity.REJECT, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.95
    assert by[1000] == by[1001] < 0.5
    assert toxicity.toxicity(docs.limit(0), scorer).count() == 0


def test_toxicity_without_labels():
    for rows, s in (([], 0), ([("a", 0)], 0), ([("a", 1)], 1)):
        assert round(float(toxicity.fit(rows).score(["anything"])[0])) == s


def test_toxicity_sample(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i) for i in range(60)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (5, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled(docs, labels)
    assert sorted(got) == sorted((f"t{i}", i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)


LETTERS = {"aa": "abcdefgh", "bb": "klmnopqr", "cc": "αβγδε"}


def model():
    r = random.Random(2)
    return langid.Model([(words(r, a, 60), lang) for lang, a in LETTERS.items() for _ in range(30)])


def test_languages_and_spans(spark):
    m, r = model(), random.Random(3)
    rows, want = [], {}
    for i in range(60):
        lang = sorted(LETTERS)[i % 3]
        rows.append((i, words(r, LETTERS[lang], 40), lang))
        want[i] = lang
    rows += [(100, None, "aa"), (101, "12 !! ", "aa"), (102, words(r, LETTERS["aa"], 30) + " " + words(r, LETTERS["bb"], 90), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = {x["doc_id"]: x for x in langid.identify(df, m, spans=True).collect()}
    assert all(got[i]["lang_pred"] == lang for i, lang in want.items())
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0.0
    assert got[102]["lang_pred"] == "bb" and [s["lang"] for s in got[102]["spans"]] == ["aa", "bb"] and got[102]["spans"][1]["first_word"] == 30
    assert langid.identify(df.limit(0), m).count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    m, rng = model(), np.random.default_rng(1)
    for _ in range(30):
        s = -rng.random((6, m.width)) * 40
        m._flat = s.astype(np.float32)
        path = m._viterbi([np.arange(6)])[0]
        cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(cost(p) for p in itertools.product(range(m.width), repeat=6))
        assert abs(cost(path.tolist()) - best) < 1e-3
        one = m._single(s)
        if one is not None:
            assert abs(cost([one] * 6) - best) < 1e-9


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert langid.identify(df, langid.Model([])).first()["lang_pred"] == "und"


def test_latin_words_and_every_language(spark, monkeypatch):
    m = langid.Model([("слово дело это время", "ru"), ("these are some plain words", "en")])
    assert m.words(["words", "qqq"])[:, m.langs.index("ru")].tolist() == [langid.FLOOR] * 2
    # more languages than one plan picks, or than the model used to know
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2, raising=False)
    monkeypatch.setattr(langid, "PLAN_LANGUAGES", 2, raising=False)
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 5}") for i in range(80)], "doc_id long, text string, lang string")
    assert {lang for _, lang in langid.labelled(docs)} == {f"l{i}" for i in range(5)}


def test_numbers_are_no_letters(spark):
    m = model()
    df = spark.createDataFrame([(1, "½ ² ① Ⅷ 12 ٣"), (2, "½ abcd ²"), (3, "一二")], "doc_id long, text string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(df, m).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "aa" and got[3][0] != "und"


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_ROWS", 20)
    rows = [(8, f"text {i}", "aa") for i in range(400)] + [(i, "t", "bb") for i in range(1000, 1400)] + [(3, None, "aa"), (4, "x", None), (None, "x", "aa")]
    got = langid.labelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(lang == "bb" for _, lang in got) == 20 and sum(lang == "aa" for _, lang in got) == 1


def test_codes_stand_for_letters_and_what_is_before_them():
    import numpy as np

    texts = ["Alpha alpine, alp alpha beta", "", "x" * 200 + " y", "1 2 !", "beta"]
    raw, sizes, counts = toxicity.coded(texts, 2)
    assert counts.tolist() == [3, 0, 1, 0, 1] and sizes.sum() == len(raw)
    assert sizes.tolist() == [4 * len(w) for w in (" alpha alpine ", " alp alpha ", " beta ", " " + "x" * 200 + " y ", " beta ")]
    codes = np.frombuffer(raw, np.uint32)
    seen = {}
    for w, end in zip((" alpha alpine ", " alp alpha ", " beta ", " " + "x" * 200 + " y ", " beta "), np.cumsum(sizes) // 4):
        for i, c in enumerate(codes[end - len(w) : end]):
            prefix = w[: i + 1].rsplit(" ", 1)[1][: toxicity.LETTERS]
            if len(prefix) < toxicity.LETTERS - 1:
                assert seen.setdefault(prefix, c) == c
    assert len(set(seen.values())) == len(seen)


def test_toxicity_on_the_tables():
    import duckdb
    import numpy as np

    rows = duckdb.connect().execute("select doc_id, text, toxic from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id)").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    scorer = toxicity.fit([(t, y) for i, t, y in rows if not held(i)])
    test = [(t or "", y) for i, t, y in rows if held(i)]
    said = np.concatenate([scorer.score([t for t, _ in test[i : i + 100]]) for i in range(0, len(test), 100)]) >= toxicity.REJECT
    y = np.array([v == 1 for _, v in test])
    assert (said & y).sum() / y.sum() > 0.7 and (said & y).sum() / said.sum() > 0.93
