import random

import pytest
from conftest import rows

from citegrid.llm.names import EDIT, Meetings, _acyclic, _chase, link_names, name_pairs, slip_odds
from citegrid.llm.spelling import edits, read_affiliation, read_name, same_affiliation

SCHEMA = "id bigint, name string, affiliation string, freq bigint, entity int, node int"
FORMS = "given_name string, short_form string"


def pairs(spark, people, forms=(("Robert", "Bob"),)):
    df = spark.createDataFrame([(i, n, a, f, 0, 0) for i, (n, a, f) in enumerate(people)], SCHEMA)
    return rows(name_pairs(link_names(df, spark.createDataFrame(list(forms), FORMS))))


def test_variants(spark):
    u, v = "University of Aston, Birmley", "Institute for Bean Studies"
    people = [
        ("Robert Q. Hamilden", u, 9),  # 0
        ("HAMILDEN, Robert", "UA Birmley", 1),
        ("Hamilden, R.", u, 1),
        ("Bob Hamilden", None, 1),
        ("Robret Hamilden", u, 1),
        ("Dr. Robert Hamildén (ed.)", None, 1),
        ("R. Hamilden", v, 1),  # 6: another
        ("Rosa Hamilden", v, 5),
        ("The Glorp Collaboration", None, 3),  # 8
        ("GLORP Collab.", None, 1),
        ("Walter Hamilden", u, 4),  # 10
        (None, None, None),
        ("†", None, 1),
    ]
    got = pairs(spark, people)
    one = [0, 1, 2, 3, 4, 5]
    want = [(a, b) for a in one for b in one if a < b] + [(6, 7), (8, 9)]
    assert got == sorted(want)


def test_empty_and_repeated(spark):
    assert pairs(spark, [], []) == []
    df = spark.createDataFrame([(1, "Ann Bo", None, 1, 0, 0)] * 2, SCHEMA)
    assert name_pairs(link_names(df, spark.createDataFrame([], FORMS))).count() == 0


@pytest.mark.parametrize(
    "text,last,given,rest",
    [("Ada B. Lovelace", "lovelace", "ada", ("b",)), ("Lovelace, A. B.", "lovelace", "", ("b",)), ("Lovelace AB", "lovelace", "", ("b",)), ("AdaLovelace", "lovelace", "ada", ()), ("Prof. ADA LOVELACE, PhD", "lovelace", "ada", ()), ("Ada Love-Lace1,2", "lovelace", "ada", ()), ("Ada L0velace*", "lovelace", "ada", ())],
)
def test_reading(text, last, given, rest):
    r = read_name(text)
    assert (r.last, r.given, r.rest, r.initial) == (last, given, rest, "a")


def test_affiliations():
    same = lambda a, b: same_affiliation(read_affiliation(a), read_affiliation(b))
    assert same("University of Aston, Birmley", "UA Birmley") == 1 and same("UNIVERSITY OF ASTTON", "University of Aston") == 1
    assert same("University of Aston", "Institute for Bean Studies") == -1 and same(None, "x") == 0
    assert edits("abcd", "abdc") == 1 and edits("abcd", "wxyz") == 3


def test_other_scripts_and_unread_names(spark):
    people = [("Иван Петров", None, 5), ("Петров, Иван", None, 1), ("Νίκος Παππάς", None, 1), ("王小明", None, 1), ("Bo Sørby", None, 3), ("Dr.", None, 1), ("†", None, 1), (None, None, None)]
    assert pairs(spark, people) == [(0, 1)]
    df = spark.createDataFrame([(i, n, a, f, 0, 0) for i, (n, a, f) in enumerate(people)], SCHEMA)
    got = rows(link_names(df, spark.createDataFrame([], FORMS)))
    assert [i for i, _ in got] == list(range(8)) and len({e for _, e in got}) == 7
    assert read_name("Bo Sørby").last == "sørby" and read_name("王小明").last == "王小明"


def test_long_chains_and_circles_end_at_one_root(spark):
    chain = [(i, i + 1) for i in range(30)]
    circle = [(100, 103), (103, 101), (101, 102), (102, 100), (99, 101)]
    mutual = [(200, 201), (201, 200)]
    links = spark.createDataFrame(chain + circle + mutual, "node bigint, to bigint")
    ranks = spark.createDataFrame([(i,) for i in [*range(31), *range(99, 104), 200, 201]], "node bigint").selectExpr("node", "if(node = 101, 500, node) as rank")
    got = rows(_chase(_acyclic(links, ranks)))
    assert got == [(i, 30) for i in range(30)] + [(99, 101), (100, 101), (102, 101), (103, 101), (200, 201)]


def _crowd(rng, n):
    syl = ["ka", "lo", "mi", "tu", "ve", "ra", "so", "ne", "pi", "du"]
    name = lambda k: "".join(rng.choice(syl) for _ in range(k)).capitalize()
    givens = [name(3) for _ in range(20)]
    return [(f"{rng.choice(givens)} {name(5)}", None, rng.randrange(3, 9)) for _ in range(n)]


def test_planted_variants_are_found(spark):
    """Slips, initials, turned names and marks planted on invented persons: what share of the planted pairs comes out, and what else."""
    rng = random.Random(4)
    people = list(dict.fromkeys(n for n, _, _ in _crowd(rng, 300)))
    data, truth = [], set()
    for p in people:
        base = len(data)
        data.append((p, None, 6))
        given, last = p.split()
        i = rng.randrange(1, len(last) - 1)
        kinds = [last[:i] + last[i + 1] + last[i] + last[i + 2 :], last[:i] + last[i + 1 :], last[:i] + "x" + last[i:]]
        for v in rng.sample([f"{given} {rng.choice(kinds)}", f"{last}, {given}", f"{p} †", p.upper()], 2):
            data.append((v, None, 1))
        truth |= {(a, b) for a in range(base, len(data)) for b in range(a + 1, len(data)) if data[a][0] != data[b][0]}
    got = {(a, b) for a, b in pairs(spark, data) if data[a][0] != data[b][0]}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97


def test_a_hot_name_is_not_paired_with_itself_on_every_string(spark):
    nodes = spark.createDataFrame([(i, "wang", f"g{i}") for i in range(300)] + [(1000, "wamg", "g0"), (1001, "li", "g0")], "node bigint, last string, given string")
    meet = Meetings()
    meet.slip(nodes, nodes, ["given"], "last")
    meet.equal(nodes, nodes, ["last", "given"], "rest", True)
    assert rows(meet.pairs(), "v", "c") == [(0, 1000), (1000, 0)]


def test_slip_odds(spark):
    schema = "last string, given string, gn bigint, ln bigint"
    few = spark.createDataFrame([("abcdef", "x", 1, 1), ("zzz", "y", 1, 1)], schema)
    assert EDIT + 1.5 <= slip_odds(few) <= 8 and slip_odds(few.limit(0)) <= 8
    # forty rare surnames near another, all under a given name that both have, among many given names
    many = [(f"{c}{d}abcde", f"g{i}", 2, 5) for i, (c, d) in enumerate((a, b) for a in "qrstu" for b in "ghijklmn")]
    slips = [(f"{last}x", g, 2, 1) for last, g, _, _ in many]
    assert slip_odds(spark.createDataFrame(many + slips, schema)) > slip_odds(spark.createDataFrame(many + [(x, f"h{i}", 1, 1) for i, (x, *_) in enumerate(slips)], schema))
