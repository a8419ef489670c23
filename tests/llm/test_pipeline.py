"""The pipeline's stages on a small fixture, each held against what brute force expects of it."""

import random
import zlib

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def words(r, n):
    return [("".join(r.choice("abcdeinorst") for _ in range(r.randint(3, 8)))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        w = words(r, r.randint(30, 120))
        if i % 5 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["zugvilk", "murxbold", "quasmig"]))
        docs.append((i, " ".join(w), "en", "hot" if i % 3 else f"s{i % 4}"))
        if i < 320:
            labels.append((i, 1, int(i % 5 == 0)))
    item = " ".join(words(r, 25))
    docs += [(1000, docs[1][1], "en", None), (1001, docs[1][1] + " end", "en", "x"), (1002, docs[2][1] + " " + item, "en", "y"), (1003, None, None, None), (1004, "", "en", "x")]
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(*d, 0.5, "k") for d in docs], "doc_id long, text string, lang string, source string, score double, shard string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        kept[name] = sorted(r["doc_id"] for r in out.collect())
        assert all(r["score"] == 0.5 and r["shard"] == "k" for r in out.collect())
        docs = out
    toxic = {i for i in range(400) if i % 5 == 0}
    left = set(kept["toxicity"])
    assert len(toxic & left) <= 4 and {i for i in range(400) if i % 5} <= left and {1003, 1004} <= left
    assert set(kept["near_duplicates"]) == left - {1000, 1001}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {1002}
    mixed = kept["mixing"]
    assert set(mixed) <= set(kept["decontamination"]) - {1003, 1004} and max(map(mixed.count, mixed)) == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in last) == mixed
    starts = sorted((r["start"], r["n_tokens"]) for r in last)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_run_reruns_agree(spark, folder):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert a == b and len(a) > 300




def test_stages_with_repeated_ids_and_long_texts(spark, folder):
    r = random.Random(11)
    a, b, c = (" ".join(words(r, 80)) for _ in range(3))
    long = " ".join(words(r, 60_000))
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (3, long), (4, long + " end"), (None, c), (5, None), (5, ""), (6, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0.5, "k") for i, t in rows], "doc_id long, text string, lang string, source string, score double, shard string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        kept[name] = sorted((str(x["doc_id"]), len(x["text"] or "")) for x in docs.collect())
    assert len(kept["toxicity"]) == len(rows)
    # 2 goes as a copy of 1's second text, 4 as one of 3; rows without an id or words stay, and each row of a text that stays
    assert kept["near_duplicates"] == sorted((str(i), len(t or "")) for i, t in rows if i not in (2, 4)) == kept["decontamination"]
    assert set(kept["mixing"]) <= {x for x in kept["decontamination"] if x[1]} and len(kept["mixing"]) >= 4
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(str(x["doc_id"]) for x in last) == [i for i, _ in kept["mixing"]]


def test_run_leaves_no_tables_of_its_stages(spark, folder):
    import glob

    from docloom.llm import common

    at = f"{common.shared_dir(spark).removeprefix('file://')}/docloom"
    before = set(glob.glob(f"{at}/*"))
    n = corpus_pipeline.run(spark, folder).count()
    left = sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{at}/*")) - before)
    assert n > 300 and left == ["stage-token_output", "tokens"]
