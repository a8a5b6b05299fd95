"""Brute-force and edge-case tests of the general problems 3, 4 and 5."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.operators import canonical, components, grouped_split, overlap


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(300):03}", f"n{rnd.randrange(300):03}") for _ in range(260)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("x", None), ("y", "y")]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {a: find(a) for a in parent}
    got = components.connected_components(spark.createDataFrame(edges, "src string, dst string"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_article_keys(spark):
    cases = {
        "PMC100000007": "PMC100000007", " pmc100000007 ": "PMC100000007", "PMC-100000007": "PMC100000007", "PMC:100000007": "PMC100000007", "100000007": "PMC100000007",
        "pmcid: PMC100000007": "PMC100000007", "PMC000100000007": "PMC100000007", "PMC100000007.2": "PMC100000007", "PMC 12": "PMC000000012", "": None, "n/a": None, None: None,
    }
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, a string").select("i", grouped_split.article_key(F.col("a")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in rows] == list(cases.values())
    lead = spark.createDataFrame([("PMC100000007_01",), ("pmc100000007-12 ",), ("x",), (None,)], "c string").select(grouped_split.case_article(F.col("c")).alias("k")).collect()
    assert [r["k"] for r in lead] == ["PMC100000007", "PMC100000007", None, None]


SPLIT_SCHEMA = "row_id bigint, case_id string, article_id string, n_images int, leish_type string, split string"


def test_split_keeps_groups_and_shares(spark):
    rnd = random.Random(1)
    rows = [(i, f"PMC{100000000 + min(rnd.randrange(2000), rnd.randrange(2000)):09}_{i}", None, 1, rnd.choice(["A", "A", "A", "B", "c"]), "clash") for i in range(6000)]
    rows += [(10_000 + i, f"PMC{200000000 + i}_1", "PMC300000000", None, "B", None) for i in range(300)]
    rows += [(20_000, None, None, None, None, None), (20_001, "?", " ", None, None, None), rows[0]]
    out = grouped_split.grouped_split(spark.createDataFrame(rows, SPLIT_SCHEMA)).collect()
    assert len(out) == 6302 and len({r["row_id"] for r in out}) == 6302
    per = {}
    for r in out:
        if r["group_article"]:
            per.setdefault(r["group_article"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per.values())
    assert len({r["split"] for r in out if 10_000 <= r["row_id"] < 10_300}) == 1
    n = Counter(r["split"] for r in out)
    assert abs(n["train"] / 6302 - 0.8) < 0.02 and abs(n["test"] / 6302 - 0.1) < 0.02
    assert grouped_split.grouped_split(spark.createDataFrame([], SPLIT_SCHEMA)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(1, 7), st.lists(st.integers(-50, 300), min_size=3, max_size=3))
def test_units_are_dealt_as_one_by_one(members, n, needs):
    want = dict(zip(["train", "validation", "test"], map(float, needs)))
    left, one = dict(want), Counter()
    for _ in range(members):
        s = max(want, key=lambda s: left[s])
        left[s] -= n
        one[s] += 1
    got = grouped_split._deal(members, n, want, list(want))
    assert sum(got.values()) == members and all(abs(got[s] - one[s]) <= 1 for s in want)


def test_split_balances_every_label(spark):
    rnd = random.Random(9)
    rows = [(f"g{g}", rnd.choice(["a"] * 60 + ["b"] * 8 + ["c"] * 2 + [None])) for g in range(900) for _ in range(1 + (g % 7 == 0) * 4 + (g == 1) * 200)]
    groups = spark.createDataFrame(rows, "group_key string, label string")
    split = {r["group_key"]: r["split"] for r in grouped_split.stratify_groups(groups, "label").collect()}
    assert set(split) == {g for g, _ in rows}
    for label in ("a", "b", "c", None):
        held = Counter(split[g] for g, x in rows if x == label)
        assert all(abs(held[s] - p * sum(held.values())) <= 0.02 * sum(held.values()) + 2 for s, p in grouped_split.SPLITS.items()), (label, held)


def _catalog(spark):
    return spark.createDataFrame(
        [
            (1, "diagnosis", "Cutaneous leishmaniasis", ["CL", "oriental sore"]), (2, "diagnosis", "Visceral leishmaniasis", ["VL", "kala-azar"]),
            (3, "diagnosis", "Yaws", None), (4, "diagnosis", "Squamous cell carcinoma", ["SCC"]), (5, "type", "CL", ["cutaneous"]), (6, "type", "MCL", ["mucocutaneous"]),
        ],
        "entry_id bigint, list_name string, canonical_name string, aliases array<string>",
    )


def test_typed_values_find_their_entry(spark):
    want = {
        ("diagnosis", "cutan. leish."): 1, ("diagnosis", "Leishmaniasis, cutaneous"): 1, ("diagnosis", "C.L."): 1, ("diagnosis", "localised CL"): 1, ("diagnosis", "kala azar (probable)"): 2,
        ("diagnosis", "viscreal leishmaniasis"): 2, ("diagnosis", "**Yaws**"): 3, ("diagnosis", "squamous-cell ca"): 4, ("diagnosis", "contact dermatitis"): 0, ("diagnosis", "pending"): 0,
        ("diagnosis", "leishmaniasis"): 0, ("type", "type CL"): 5, ("type", "CUTANEOUS?"): 5, ("type", "mucocutanous"): 6, ("type", "type 2"): 0, ("type", "  "): 0, ("nowhere", "CL"): 0,
    }
    rows = [(*k, "extra") for k in want] + [("diagnosis", None, "x"), (None, "CL", "x"), ("type", "type CL", "again")]
    out = canonical.map_values(spark.createDataFrame(rows, "list string, value string, entry_id string"), _catalog(spark)).collect()
    assert {(r["list"], r["value"]): r["entry_id"] for r in out} == want and len(out) == len(want)


def test_mapping_of_empty_tables(spark):
    empty = spark.createDataFrame([], "list string, value string")
    assert canonical.map_values(empty, _catalog(spark)).count() == 0
    some = spark.createDataFrame([("type", "CL")], "list string, value string")
    assert canonical.map_values(some, _catalog(spark).where("false")).first()["entry_id"] == 0
    records = spark.createDataFrame([(1, "CL "), (1, "CL "), (2, None), (3, " ")], "id bigint, value string")
    mapped = canonical.map_records(canonical.typed_values(records, "id", "value", "type"), _catalog(spark)).collect()
    assert [(r["record_id"], r["entry_id"]) for r in mapped] == [(1, 5)]


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_overlaps_match_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [[rnd.choice(words) for _ in range(rnd.randrange(14, 60))] for _ in range(160)]
    rows, i = [], 0
    for t in texts:
        for _ in range(rnd.randrange(1, 4)):
            u = [rnd.choice(words) if rnd.random() < rnd.choice([0, 0.03, 0.15]) else w for w in t]
            rows.append((i, rnd.choice(["train", "validation", "test"]), ", ".join(u).title(), "clash"))
            i += 1
    rows += [(i + 1, "train", None, None), (i + 2, "test", "", None), (i + 3, None, rows[0][2], None), (i + 4, "test", "too few words", None), rows[0]]
    frame = spark.createDataFrame(rows, "query_id bigint, split string, clinical_context string, rep string")
    got = {(r[0], r[1]) for r in overlap.split_overlaps(frame).collect()}
    sets = {(q, s == "train"): set(t.lower().replace(",", "").split()) for q, s, t, _ in rows if s and t}
    want = {(min(a, b), max(a, b)) for (a, x), u in sets.items() for (b, y), v in sets.items() if x and not y and min(len(u), len(v)) >= 12 and _jaccard(u, v) >= 0.75}
    assert want and got <= want
    sure = {p for p in want if _jaccard(next(u for (q, _), u in sets.items() if q == p[0]), next(u for (q, _), u in sets.items() if q == p[1])) >= 0.8}
    assert sure <= got and len(got) >= 0.98 * len(want)
    assert overlap.split_overlaps(frame.where("false")).count() == 0


def test_hot_group_of_copies(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "train" if i % 3 else "test", text) for i in range(300)]
    assert overlap.split_overlaps(spark.createDataFrame(rows, "query_id bigint, split string, clinical_context string")).count() == 200 * 100


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_normalising_any_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.normalised(F.col("t")).alias("n")).collect()
    assert all(r["n"] == r["n"].strip() for r in rows)


@pytest.mark.parametrize("length", [200_000])
def test_very_long_text(spark, length):
    long = " ".join(f"w{i}" for i in range(length // 8))
    rows = [(1, "train", long), (2, "test", long + " more")]
    assert [tuple(r) for r in overlap.split_overlaps(spark.createDataFrame(rows, "query_id bigint, split string, clinical_context string")).collect()] == [(1, 2)]
