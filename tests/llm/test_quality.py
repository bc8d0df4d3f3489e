import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citegrid.llm.quality import FIELDS, RULES, columns_of, text_quality

PROSE = [
    "We study how the model learns from the data that it has seen. It is not clear why this works so well.",
    "Nous étudions la détection et montrons que le réseau\naméliore la frontière de façon rapide. Il n'est pas certain\nque la projection soit locale dans tous les cas.",
    "本文研究排序问题，并证明算子能够改善记忆。然而，当约束未知时，索引并不稀疏。",
    "Für die Suche wurde der Filter gemessen. Die Ergebnisse zeigen, dass er besser ist als der Operator.",
]
OTHER = [
    "- apples\n- pears for cooking\n- plums\n- figs",
    "1.1 A survey of filters for the web ........... 2\n1.2 How stable is the prior? ........... 7",
    "| a | b |\n| --- | --- |\n| 1 | 2.5 |\n| 3 | 4 |",
    "epoch=0 loss=2.9 lr=1e-5\nepoch=1 loss=1.2 lr=1e-5",
    "mbpqhdc cpjkhgjwqqb drn twjwsvxxskz wjnfzfzbmf rzrgsgjmdg wcq",
    "lattice lattice lattice lattice lattice lattice lattice lattice lattice lattice",
    "=====\n*****\n-----",
    "T h i s i s s p a c e d o u t t e x t",
    "name: value\ncolour: red\nsize: big",
    "",
]


def measure(*texts):
    return [dict(zip((f[0] for f in FIELDS), r)) for r in zip(*(c.to_pylist() for c in columns_of(pa.array(texts, pa.string()))))]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert measure(text)[0]["prose_share"] > 0.5


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    got = measure(text)[0]
    assert got["prose_share"] <= 0.5 and set(got["reasons"]) & {*RULES, "no_text"}


def test_reasons():
    got = measure(OTHER[0], OTHER[2], OTHER[4], OTHER[5], OTHER[7])
    for g, rule in zip(got, ("bullets", "columns", "common_words", "repetition", "single_letters")):
        assert rule in g["reasons"]
    assert "bullet_lines" in got[0]["reasons"] and "alphabetic_words" in measure("1 2 3 4 five")[0]["reasons"]
    assert measure(" ".join(PROSE[:1] * 5))[0]["reasons"] == []


def test_mixed_by_characters():
    table = "\n".join("| 1 | 2 | 3 |" for _ in range(40))
    a, b = measure(f"{PROSE[0]}\n\n{table}", f"{PROSE[0] * 9}\n\n{table[:100]}")
    assert a["prose_share"] < 0.5 < b["prose_share"]


def test_statistics():
    got = measure("The cat is here.\n- one\n- two ...")[0]
    assert got["words"] == 6 and got["mean_word_length"] == 3.0 and got["punct_line_share"] == pytest.approx(2 / 3) and got["bullet_line_share"] == pytest.approx(2 / 3)
    assert got["ellipsis_line_share"] == pytest.approx(1 / 3) and got["symbol_ratio"] == pytest.approx(1 / 6) and got["alphabetic_share"] == pytest.approx(6 / 9)
    assert "word_count" in got["reasons"] and got["common_kinds"] >= 2


TEXTS = st.lists(st.sampled_from([*PROSE, *OTHER, "\n", "\r\n", "\r", " ", "\x01", "\u00a0", "'", "l'eau", "🙂", "a", "."]), max_size=6).map("\n".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_a_text_is_measured_alike_alone_and_in_a_batch(texts):
    assert measure(*texts) == [measure(t)[0] for t in texts]


def test_operator(spark):
    df = spark.createDataFrame([(1, PROSE[0], "x"), (1, PROSE[0], "x"), (2, None, "x"), (None, "", "x"), (3, PROSE[0] * 5000, "x")], "doc bigint, body string, words string")
    got = text_quality(df, "doc", "body")
    assert got.count() == 4 and got.where("is_prose").count() == 3 and text_quality(df.limit(0), "doc", "body").count() == 0
