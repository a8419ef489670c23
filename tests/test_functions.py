import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import jsonx, rewrite, scalars
from docloom.operators import folds
from docloom.sources import gateway


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_scalars(spark):
    assert column(spark, ["x [2 marks] y (3 marks)", "(1999) only", "[40 marks]"], scalars.inline_marks_sum) == [5, 0, 0]
    assert column(spark, ["Done.", "cut mid wor", "", "| a | b |", "see [2 marks]", None], scalars.terminal_ending) == [True, False, False, True, True, False]
    assert column(spark, ["no mark", "a (3) b [30 marks]"], scalars.last_mark) == [1, 25]
    assert column(spark, ["ﬁve ﬂat"], scalars.clean_ligatures) == ["five flat"]


def test_json_values(spark):
    assert column(spark, ['"0 7"', '"02 4"', '"Q.9"', '"6)"', '"5b"', '"4.2"', '"4.25"', '"2,3"', "0", "1000", "1001", "2.4", "2.25"], jsonx.to_number) == [7, 2, 9, 6, 5, 4, None, None, None, 1000, None, 2, None]
    assert column(spark, ["7", "6.0", '"[8 marks]"', '"3 of 12"', "null", "250"], jsonx.to_marks) == [7, 6, 8, 100, None, 100]


def test_salvage():
    assert jsonx.salvage_text('{"items":[{"n":1},{"n":2},{"n":')[:3] == ("salvaged", '{"items": [{"n": 1}, {"n": 2}]}', True)
    assert jsonx.salvage_text('{"items":[{"n":1}]} bye')[0::2] == ("salvaged", False)
    assert jsonx.salvage_text("```json\n[1]\n```")[:2] == ("clean", "[1]")
    assert jsonx.salvage_text("sorry")[0] == jsonx.salvage_text(None)[0] == "malformed"


def test_rewrites():
    assert rewrite.decimal_parts("7 . 2 Name it.", 7) == "(b) Name it."
    assert rewrite.decimal_parts("Use 7.2 V here.", 7) == "Use 7.2 V here."
    assert rewrite.decimal_parts("8 . 1 x", 7) == "8 . 1 x"
    assert rewrite.harden_lines("a\nb") == "a\n\nb"
    for kept in ("| a | b |\n|---|---|\n| 1 | 2 |", "```\nx = 1\ny = 2\n```"):
        assert rewrite.harden_lines(kept) == kept
    assert rewrite.relocate_marks("Find [2 marks] x.") == "Find x. [2 marks]"
    assert rewrite.relocate_marks("(a) Find [2 marks] x\n(b) Do") == "(a) Find  x [2 marks]\n(b) Do"
    assert rewrite.table_repair("| a | b |\n| 1 | 2 |") == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert rewrite.pair_dollars("a $x$$ b").count("$$") == 2
    assert rewrite.balance_environments("\\begin{cases}a") == "\\begin{cases}a\\end{cases}"
    assert rewrite.mcq_options("Which? A) one B) two C) three").startswith("Which?\n\n- **A** one")
    assert rewrite.mcq_options("A) state x B) two C) three") == "A) state x B) two C) three"
    assert rewrite.multiset_share("the cat sat", "The cat, sat down") == 1.0
    assert rewrite.multiset_share("a b c d", "a b c x y") == 0.75
    assert rewrite.multiset_share("", "a") == 0.0


@given(st.text(alphabet="ab$|\\ \n`", max_size=40))
def test_rewrites_take_any_text(text):
    for f in (rewrite.harden_lines, rewrite.heal_delimiters, rewrite.marker_cleanup, rewrite.latex_format, rewrite.relocate_marks, rewrite.wrap_equations):
        assert isinstance(f(text), str)


def test_longest_steps():
    pick = lambda v: [v[i] for i in folds.longest_steps(v)]
    assert pick([1, 2, 24, 3, 4, 2, 3]) == [1, 2, 3, 4]
    assert pick([5, 6, 1, 2, 3]) == [1, 2, 3]
    assert pick([2, 3]) == []


@given(st.lists(st.integers(1, 8), max_size=9))
def test_longest_steps_is_longest(values):
    got = folds.longest_steps(values)
    if 1 not in values:
        assert got == []
        return
    first, best = values.index(1), 0
    for mask in range(1 << (len(values) - first - 1)):
        chain = [1] + [v for i, v in enumerate(values[first + 1 :]) if mask >> i & 1]
        if all(0 < b - a <= 3 for a, b in zip(chain, chain[1:])):
            best = max(best, len(chain))
    assert len(got) == best


def test_folds():
    assert folds.guard([1, 2, 2, 700, 3, 9]) == [1, 2, 3, 9]
    assert [tuple(round(x, 2) for x in c) for c in folds.cluster_boxes([(0.1, 0.1, 0.3, 0.3), (0.35, 0.1, 0.1, 0.1), (0.8, 0.8, 0.05, 0.05)], 0)] == [(0.1, 0.1, 0.35, 0.3), (0.8, 0.8, 0.05, 0.05)]
    assert folds.stitch([(1, "a"), (1, "b"), (None, "c"), (1, "d")]) == [(1, "a\n\nb", False), (2, "c", True), (3, "d", True)]
    assert folds.stitch_answers([(1, "x y z"), (1, "x y z"), (1, "other words here"), (1, "third one now")]) == [(1, "x y z\n\n---\n\nother words here")]
    assert folds.resolve_attempts([(1, None, "a"), (2, "ok", None)]) == (2, "ok", "accepted")
    assert folds.resolve_attempts([(1, None, "a"), (2, None, "a"), (3, "ok", None)]) == (2, None, "stopped")


def test_scans():
    assert folds.scan_headings("3. Explain what happens to the current here.") == [(3, 0.0)]
    assert folds.scan_headings("5 cm of wire is used to make a circuit here") == []
    assert folds.scan_headings("2000. Explain what happens to the current here") == []
    assert folds.scan_footer("text\n(Total for Question 4 is 7 marks)")[:2] == (4, 7)
    assert folds.scan_footer("(Total 0 marks)") is None


def test_gateway_retries():
    client = gateway.Scripted({"p": [gateway.Upstream("rate_limited"), "", "reply"]})
    waits = []
    assert gateway.call(client, "p", waits.append) == "reply" and len(waits) == 2 and waits[0] >= 10
    with pytest.raises(gateway.Upstream):
        gateway.call(gateway.Scripted({"p": [gateway.Upstream("auth")]}), "p", waits.append)


def test_gateway_rows(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "id int, prompt string")
    got = gateway.chat_rows(rows, "id", "prompt", lambda: gateway.Scripted({"p": ["yes"], "q": [gateway.Upstream("auth")]}), 2, lambda s: None)
    assert sorted(map(tuple, got.collect())) == [(1, "yes", None), (2, None, "auth")]


def test_glyphs(spark):
    g = [(0, i, c, x, y, 5.0, 10.0) for i, (c, x, y) in enumerate([("a", 0.0, 0.0), ("b", 5.0, 0.0), ("c", 14.0, 0.0), ("d", 0.0, 20.0)])]
    rows = spark.createDataFrame(g, "page int, seq int, char string, x double, y double, width double, size double")
    assert gateway.assemble_glyphs(rows, ["page"], "seq").first()["text"] == "ab c\nd"


def test_longest_steps_equals_brute_force():
    import itertools
    import random

    from docloom.operators import folds

    r = random.Random(1)
    for _ in range(200):
        v = [r.randint(1, 6) for _ in range(r.randint(0, 9))]
        got = folds.longest_steps(v)
        best = 0
        if 1 in v:
            first = v.index(1)
            for k in range(1, len(v) + 1):
                for c in itertools.combinations(range(first, len(v)), k):
                    if c[0] == first and all(0 < v[b] - v[a] <= 3 for a, b in zip(c, c[1:])):
                        best = max(best, k)
        assert len(got) == best and all(0 < v[b] - v[a] <= 3 for a, b in zip(got, got[1:])) and (not got or got[0] == v.index(1))
