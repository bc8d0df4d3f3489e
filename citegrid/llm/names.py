"""Variant spellings of names: noisy-channel attribution to canonical forms.

A spelling is read into parts (spelling.py), and spellings that read alike are one form. Forms are ranked as candidate canonical
forms; each form v looks for the canonical c that most likely was meant: ln prior(c) + ln P(v | c), where the prior is the number of
papers under c, and the channel has likelihoods for slips of the pen, initials, short forms, dropped middle names and another
affiliation. v is attached to the maximum, unless the hypothesis that v is a name of its own is likelier: a spelling
whose parts occur in many other names is no slip. Full forms are attached first; initials then choose between whole persons.

Candidates meet on keys, never all forms with one surname: equal surname and given name, one of them up to one deletion (two
spellings within one edit share such a key), a table of short forms, or surname, initial and affiliation. Where a form has only an initial
and no affiliation, it meets one row per surname and initial: the likeliest person and the mass of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small
from .spelling import edits, read_affiliation, read_name, same_affiliation

FORM = "id bigint, kind string, last string, given string, initial string, rest string, acr string, aff string, place string, freq double, plain2 boolean"
#: Natural logarithms of likelihoods.
EDIT, INITIAL, SHORT, REST_MISSING, REST_OTHER, AFF_SAME, AFF_OTHER, RARE_GIVEN, SAME_AFF_SLIP, MARGIN = -3.5, -1.5, -2.0, -0.5, -6.0, 2.5, -9.0, -4.0, -1.5, 0.0
#: Share of the mass that the likeliest person behind an initial must have.
SURE = 0.6


def read_forms(df: DataFrame) -> DataFrame:
    """df(id, name, affiliation, freq) -> one row per readable name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FORM.split(", ")]
        types = [pa.int64(), *[pa.string()] * 8, pa.float64(), pa.bool_()]
        for b in batches:
            rows = []
            for i, n, a, f in zip(*(b.column(k).to_pylist() for k in range(4))):
                r = read_name(n)
                if r is None or not r.last:
                    continue
                acr, full, place = read_affiliation(a)
                two = r.kind == "person" and "," not in n and bool(r.given) and not r.rest
                rows.append((i, r.kind, r.last, r.given, r.initial, "".join(x[0] for x in r.rest), acr, full, place, float(f or 0) + 0.5, two))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return df.select("id", "name", "affiliation", "freq").where(F.col("name").isNotNull() & F.col("id").isNotNull()).mapInArrow(run, FORM)


def _in_order(forms: DataFrame) -> DataFrame:
    """Two words without a comma whose second is a given name in other names: the surname came first."""
    people = forms.where(F.col("kind") == "person")
    as_given = people.where(F.col("given") != "").groupBy(F.col("given").alias("t")).agg(F.count_distinct("last").alias("gn"))
    as_last = people.groupBy(F.col("last").alias("t")).agg(F.count("*").alias("ln"))
    turned = as_given.join(as_last, "t").where((F.col("gn") >= 3) & (F.col("gn") >= 3 * F.col("ln"))).select(F.col("t").alias("last"), "gn")
    first = as_given.select(F.col("t").alias("given"), F.col("gn").alias("g0"))
    x = forms.join(turned, "last", "left").join(first, "given", "left")
    swap = F.col("plain2") & F.col("gn").isNotNull() & (F.coalesce("g0", F.lit(0)) * 3 <= F.col("gn"))
    last, given = F.when(swap, F.col("given")).otherwise(F.col("last")), F.when(swap, F.col("last")).otherwise(F.col("given"))
    initial = F.when(swap, F.substring("last", 1, 1)).otherwise(F.col("initial"))
    return x.select("id", "kind", last.alias("last"), given.alias("given"), initial.alias("initial"), "rest", "acr", "aff", "place", "freq")


def slip_odds(people: DataFrame) -> float:
    """Natural logarithm of the odds that a rare surname (of at most two forms) within one slip of another, under a given name that both have, is a
    slip and no name of its own. Estimated from the table: names of their own would share a given name no more often than any two
    surnames do. One row comes to the driver."""
    dels = people.select("last", "given", "ln", _deletions("last").alias("d"))
    other = dels.select(F.col("last").alias("other"), "d").distinct()
    near = dels.where(F.col("ln") <= 2).join(other, "d").where(F.col("last") != F.col("other")).select("last", "given", "other")
    names = people.select(F.col("last").alias("other"), "given", F.lit(True).alias("hit")).distinct()
    two = F.xxhash64("last", "other")
    row = near.join(names, ["other", "given"], "left").agg(F.count_distinct(two).alias("near"), F.count_distinct(F.when(F.col("hit"), two)).alias("same")).first()
    # forms of a given name, and surnames: a surname of `ln` forms is counted ln times an ln-th part
    size = people.agg(F.avg("gn").alias("gn"), F.sum(1 / F.col("ln")).alias("lasts")).first()
    share = (row["same"] + 1) / (row["near"] + 2)
    chance = min(0.9, max(1e-6, (size["gn"] or 1) / max(1.0, size["lasts"] or 1)))
    slips = max(0.0, (share - chance) / (1 - chance))
    by_chance = max(1e-6, (1 - slips) * chance)
    return min(8.0, max(EDIT + 1.5, math.log(max(1e-6, share - by_chance) / by_chance)))


def _scorer(df: DataFrame, odds: float) -> DataFrame:
    """Pairs (v, c: structs) -> (v, c, score, own); odds: slip_odds."""
    rare_last = EDIT - odds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs, cs, how = (b.column(k).to_pylist() for k in range(3))
            score, own = [], []
            for v, c, h in zip(vs, cs, how):
                s = math.log(c["freq"])
                s += 0.0 if v["last"] == c["last"] else EDIT * edits(v["last"], c["last"], 2)
                if v["given"] and c["given"]:
                    s += 0.0 if v["given"] == c["given"] else SHORT if h == "short" else EDIT * edits(v["given"], c["given"], 2)
                elif v["given"] != c["given"]:
                    s += INITIAL
                if v["rest"] != c["rest"]:
                    a, z = sorted((v["rest"], c["rest"]), key=len)
                    s += REST_MISSING if z.startswith(a) else REST_OTHER
                same = same_affiliation((v["acr"], v["aff"], v["place"]), (c["acr"], c["aff"], c["place"]))
                s += AFF_SAME if same > 0 else AFF_OTHER if same < 0 else 0.0
                o = math.log(v["freq"])
                if v["given"] != c["given"] and v["given"]:
                    o += RARE_GIVEN if v["gn"] <= 2 or h == "short" else 0.0
                elif v["given"] == c["given"] and v["last"] == c["last"]:
                    o += RARE_GIVEN  # two persons of one name
                if v["last"] != c["last"]:
                    o += rare_last if v["ln"] <= 2 else 2.0
                    o += SAME_AFF_SLIP if same > 0 else 0.0
                if not v["given"]:
                    o += RARE_GIVEN
                score.append(s)
                own.append(o)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array(own, pa.float64())], names=["v", "c", "score", "own"])

    kinds = dict(df.dtypes)
    return df.select("v", "c", "how").mapInArrow(run, f"v {kinds['v']}, c {kinds['c']}, score double, own double")


def _deletions(c: str):
    """The string and what is left of it without any one letter: two strings within one edit share one of these."""
    x = F.col(c)
    return F.explode(F.array_distinct(F.concat(F.array(x), F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))))


def _rank(of: str = "") -> Column:
    """Order of forms as candidates: one whose parts occur often, then a frequent one."""
    parts = [F.least(f"{of}gn", F.lit(3)), F.least(f"{of}ln", F.lit(3)), F.col(f"{of}freq"), F.col(f"{of}node")]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("gn", "ln", "freq", "node"))])


class Meetings:
    """Pairs (v, c, how, ranked) of nodes, without their fields: those with equal keys, and those with equal keys of which one part differs by a
    slip, which leaves the same string of both when one letter is left out. All requests are answered together. For slips, first the strings
    are found that different parts leave, with one small row for each string; only nodes that leave one of those are met. Parts that are
    equal, however many nodes have them, leave all their strings together and are no slips. ranked: c has to be the better candidate."""

    def __init__(self) -> None:
        self.asked, self.equals, self.slips = 0, [], []

    def _rows(self, left: DataFrame, right: DataFrame, keys: list[str | Column], part: Column, how: str, ranked: bool) -> list[DataFrame]:
        self.asked += 1
        key = F.xxhash64(F.lit(self.asked), *keys).alias("key")
        tags = lambda l, r: [F.lit(l).alias("l"), F.lit(r).alias("r"), F.lit(how).alias("how"), F.lit(ranked).alias("ranked")]  # noqa: E731, E741
        sides = [(left, True, True)] if left is right else [(left, True, False), (right, False, True)]
        return [df.select(key, part.alias("part"), "node", *tags(l, r)) for df, l, r in sides]

    def equal(self, left: DataFrame, right: DataFrame, keys: list[str], how: str, ranked: bool = False) -> None:
        self.equals += self._rows(left, right, keys, F.lit(""), how, ranked)

    def slip(self, left: DataFrame, right: DataFrame, keys: list[str], part: str, how: str = "edit", ranked: bool = False) -> None:
        open_ = lambda df: df.withColumn("d", _deletions(part))
        a = open_(left)
        self.slips += self._rows(a, a if left is right else open_(right), [*keys, "d"], F.col(part), how, ranked)

    def pairs(self) -> DataFrame:
        every = reduce(DataFrame.unionByName, self.slips)
        sides = [F.max("l").alias("l"), F.max("r").alias("r")]
        several = every.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), *sides)
        keys = cut_lineage(several.where((F.col("low") < F.col("high")) & F.col("l") & F.col("r")).select("key"))
        met = every.join(small(keys), "key", "left_semi").unionByName(reduce(DataFrame.unionByName, self.equals))
        met = cut_lineage(met)
        a = met.where("l").select("key", F.col("node").alias("v"), F.col("part").alias("v_part"), "how", "ranked")
        b = met.where("r").select("key", F.col("node").alias("c"), F.col("part").alias("c_part"))
        # an equal part means the same spelling, but in meetings on equal keys, where no part is given
        other = (F.col("v_part") != F.col("c_part")) | (F.col("v_part") == "")
        return a.join(b, "key").where(other & (F.col("v") != F.col("c"))).select("v", "c", "how", "ranked")


FIELDS = ["node", "kind", "last", "given", "initial", "rest", "freq", "acr", "aff", "place", "gn", "ln"]


def _best(pairs: DataFrame, left: DataFrame, right: DataFrame, odds: float) -> DataFrame:
    """The attachment of each form: to the maximum a posteriori, if it beats the form's own name. A pair that met on several keys is scored once."""
    once = pairs.groupBy("v", "c").agg(F.max("how").alias("how"), F.min("ranked").alias("ranked"))  # short before rest, initial and edit
    v, c = (df.select(F.struct(*FIELDS).alias(side), F.col("node").alias(f"{side}_node")) for df, side in ((left, "v"), (right, "c")))
    full = once.withColumnsRenamed({"v": "v_node", "c": "c_node"}).join(v, "v_node").join(c, "c_node")
    full = full.where(~F.col("ranked") | (_rank("c.") > _rank("v.")))
    scored = _scorer(full, odds).where(F.col("score") > F.col("own") + MARGIN)
    return scored.groupBy(F.col("v.node").alias("node")).agg(F.max_by("c.node", F.struct("score", "c.node")).alias("to"))


def _chase(links: DataFrame) -> DataFrame:
    """node -> root, following attachments to their ends; there are no circles. Each round doubles the steps taken."""
    while True:
        nxt = links.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = cut_lineage(links.join(nxt, "to", "left").select("node", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")))
        links = step.select("node", "to")
        if step.where("moved").isEmpty():
            return links


def link_names(df: DataFrame, short_forms: DataFrame) -> DataFrame:
    """(id, entity): for df(id bigint, name, affiliation, freq), rows with one entity are spellings of one person or organisation.

    short_forms: (given_name, short_form), a short form may stand for several. Null ids are left out; an id of which no name
    can be read (null, no letter, nothing but titles) is an entity of its own; null frequencies count as 0, null affiliations as not known. Repeated rows give equal rows. Empty tables: no rows.
    Further columns, whatever their names, are not read.
    """
    # every table that several branches read is written once: the plans stay small
    read = read_forms(df.select(F.col("id").cast("bigint").alias("id"), "name", "affiliation", F.col("freq").cast("double").alias("freq")))
    forms = _in_order(cut_lineage(read))
    # a form that has only an initial is one form for each affiliation
    full = (F.col("given") != "") | (F.col("kind") == "org")
    key = F.struct("kind", "last", "given", F.when(full, F.lit("")).otherwise(F.col("initial")).alias("i"), "rest", F.when(full, F.lit("")).otherwise(F.concat("acr", F.lit("|"), "place")).alias("a"))
    forms = forms.withColumn("node", F.xxhash64(key))
    forms = cut_lineage(forms)
    where = F.max(F.struct((F.col("acr") != "").alias("known"), (F.col("aff") != "").alias("f"), "freq", "acr", "aff", "place"))
    nodes = forms.groupBy("node", "kind", "last", "given", "initial", "rest").agg(F.sum("freq").alias("freq"), where.alias("w"))
    nodes = nodes.select("node", "kind", "last", "given", "initial", "rest", "freq", "w.acr", "w.aff", "w.place")
    gn = nodes.where(F.col("given") != "").groupBy("given").agg(F.count("*").alias("gn"))
    ln = nodes.groupBy("last").agg(F.count("*").alias("ln"))
    nodes = nodes.join(gn, "given", "left").join(ln, "last").withColumn("gn", F.coalesce("gn", F.lit(0)))
    nodes = cut_lineage(nodes)

    people = nodes.where((F.col("kind") == "person") & (F.col("given") != ""))
    orgs = nodes.where(F.col("kind") == "org")
    odds = slip_odds(people)
    shorts = short_forms.select(F.lower("short_form").alias("given"), F.lower("given_name").alias("long")).where(F.col("given").isNotNull() & F.col("long").isNotNull()).distinct()
    longer = people.join(shorts, "given").withColumn("given", F.col("long"))
    known = F.col("acr") != ""
    meet = Meetings()
    meet.slip(people, people, ["last"], "given", ranked=True)
    meet.slip(people, people, ["given"], "last", ranked=True)
    affiliated = people.where(known)
    meet.slip(affiliated, affiliated, ["initial", "acr"], "last", ranked=True)  # slips in both names, one affiliation
    meet.slip(orgs, orgs, [], "last", ranked=True)
    meet.slip(longer, people, ["given"], "last", "short")
    named = people.unionByName(orgs)
    meet.equal(named, named, ["kind", "last", "given"], "rest", True)
    meet.equal(longer, people, ["last", "given"], "short")
    pairs = meet.pairs()
    short_side = _best(pairs, nodes, nodes, odds)
    roots = _chase(cut_lineage(_acyclic(cut_lineage(short_side), nodes.select("node", _rank().alias("rank")))))

    # whole persons: affiliation and mass of all their full forms
    owner = nodes.where(F.col("given") != "").join(roots, "node", "left").withColumn("root", F.coalesce("to", "node"))
    first = F.max(F.struct((F.col("acr") != "").alias("known"), (F.col("aff") != "").alias("f"), "freq", "acr", "aff", "place")).alias("w")
    person = owner.groupBy("root").agg(F.max_by("last", F.struct((F.col("node") == F.col("root")), "freq")).alias("last"), F.max_by("given", (F.col("node") == F.col("root"))).alias("given"), F.max_by("rest", F.struct(F.length("rest"), "freq")).alias("rest"), F.sum("freq").alias("freq"), first)
    person = person.select(F.col("root").alias("node"), F.lit("person").alias("kind"), "last", "given", F.substring("given", 1, 1).alias("initial"), "rest", "freq", "w.acr", "w.aff", "w.place", F.lit(9).cast("bigint").alias("gn"), F.lit(9).cast("bigint").alias("ln"))
    person = cut_lineage(person)
    bare = nodes.where((F.col("kind") == "person") & (F.col("given") == ""))

    # without an affiliation on one side: the likeliest person by surname and initial, if it holds most of the mass
    order, none = F.struct("freq", "node"), ~known
    heads = person.groupBy("last", "initial").agg(
        F.max_by("node", order).alias("top"),
        (F.max("freq") >= SURE * F.sum("freq")).alias("sure"),
        F.max_by(F.when(none, F.col("node")), F.when(none, order)).alias("far"),
        (F.max(F.when(none, F.col("freq"))) >= SURE * F.sum(F.when(none, F.col("freq")))).alias("far_sure"),
    )
    heads = cut_lineage(heads)
    top = heads.where("sure").select("last", "initial", F.col("top").alias("node"))
    far = heads.where("far_sure").select("last", "initial", F.col("far").alias("node"))
    # of the persons with one surname, initial, affiliation and further initials only the most frequent can be the likeliest
    alike = person.where(known).groupBy("last", "initial", "acr", "aff", "place", "rest").agg(F.max_by("node", order).alias("node"))
    near = bare.where(known)
    meet = Meetings()
    meet.slip(near, alike, ["initial", "acr"], "last")
    meet.slip(near, top, ["initial"], "last")
    meet.equal(near, alike, ["last", "initial", "acr"], "initial")
    meet.equal(near, far, ["last", "initial"], "initial")
    meet.equal(bare, top, ["last", "initial"], "initial")  # with an affiliation: a slip in its letters
    chances = meet.pairs()
    chosen = cut_lineage(_best(chances, nodes, person, odds))
    # initials that no full form explains: by surname and affiliation, the longest form stands for the rest
    orphan = bare.join(chosen.select("node"), "node", "left_anti")
    head = orphan.where(known).groupBy("last", "initial", "acr").agg(F.max_by("node", F.struct(F.length("rest"), "freq", "node")).alias("to"))
    joined = orphan.where(known).join(head, ["last", "initial", "acr"]).where(F.col("node") != F.col("to")).select("node", "to")
    every = roots.unionByName(chosen).unionByName(joined)
    said = forms.join(every, "node", "left").select("id", F.coalesce("to", "node").alias("entity"))
    rest = df.select(F.col("id").cast("bigint").alias("id")).where(F.col("id").isNotNull()).join(forms.select("id"), "id", "left_anti")
    return said.unionByName(rest.select("id", F.xxhash64(F.lit("unread"), "id").alias("entity")))


def _acyclic(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """Short forms may outrank their long form: of forms attached in a circle the one of the highest rank, ranks(node, rank), stays free.
    A form is on a circle and its highest if it is the highest of those that it reaches."""
    top = ranks.select(F.col("node").alias("to"), F.struct("rank", "node").alias("best"))
    walk = links.join(top, "to").select("node", "to", "best")
    while True:
        nxt = walk.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("best").alias("more"))
        grew = F.coalesce(F.col("more") > F.col("best"), F.lit(False))
        step = walk.join(nxt, "to", "left").select("node", F.coalesce("then", "to").alias("to"), F.when(grew, F.col("more")).otherwise(F.col("best")).alias("best"), grew.alias("grew"))
        step = cut_lineage(step)
        walk = step.drop("grew")
        if step.where("grew").isEmpty():
            break
    return links.join(walk.where(F.col("best.node") == F.col("node")).select("node"), "node", "left_anti").select("node", "to")


def name_pairs(linked: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of one entity."""
    ids = cut_lineage(linked.distinct())
    sizes = ids.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("entity")
    ids = ids.join(sizes, "entity", "left_semi")
    a, b = ids.select("entity", F.col("id").alias("id_a")), ids.select("entity", F.col("id").alias("id_b"))
    return a.join(b, "entity").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()
