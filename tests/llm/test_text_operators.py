"""Tests of the text operators: held-out accuracy, round trips and edge cases."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("caseloom.llm")

from caseloom.llm import crf, mixing, mojibake, packing, pairs, scans, tokens  # noqa: E402

SUBJECTS = ["the team", "our group", "a nurse", "the clinic", "the patient", "every doctor"]
VERBS = ["recorded", "described", "measured", "reviewed", "considered", "treated"]
THINGS = ["a shallow ulcer", "the enlarged spleen", "several raised papules", "a negative culture", "the follow-up visit", "an earlier infection", "the well-defined lesion"]
PLACES = ["at the hospital", "during the winter", "after seven weeks", "without any delay", "near the village", "before treatment"]


def sentence(rnd):
    return f"{rnd.choice(SUBJECTS).capitalize()} {rnd.choice(VERBS)} {rnd.choice(THINGS)} {rnd.choice(PLACES)}."


# 8: wrong encodings

DOC_SCHEMA = "doc_id bigint, text string, restored string"
ACCENTED = ["La evolución de tres meses y la úlcera pequeña apoyan el diagnóstico.", "Não houve recaída após três dias de observação clínica.", "Die Ärztin prüfte täglich die Größe der Läsion über Wochen.", "Der Verlauf über fünf Monate war schön und ruhig."]


def garble(text, how):
    read_as, truly = how
    return text.encode(truly).decode(read_as)


@pytest.mark.parametrize("how", [("latin-1", "utf-8"), ("cp437", "utf-8"), ("cp850", "cp1252")])
def test_garbled_texts_are_restored(spark, how):
    rnd = random.Random(2)
    clean = [(i, " ".join(rnd.choice(ACCENTED) for _ in range(6)), "clash") for i in range(300)]
    bad = [(1000 + i, garble(" ".join(rnd.choice(ACCENTED) for _ in range(4)), how), None) for i in range(12)]
    out = {r["doc_id"]: r for r in mojibake.repair_encoding(spark.createDataFrame(clean + bad, DOC_SCHEMA)).collect()}
    assert set(out) == {b[0] for b in bad}
    assert all(r["recoverable"] == 1 for r in out.values())
    assert sum(out[i]["restored"].encode(how[1]).decode(how[0]) == t for i, t, _ in bad) >= 10


def test_encoding_edge_cases(spark):
    rows = [(1, None, None), (2, "", None), (3, "plain text only", None), (4, "lost � sign", None), (5, "é", None), (6, "a" * 300_000 + " cafÃ©", None), (None, "x �", None), (4, "lost � sign", None)]
    rows += [(100 + i, "un café très serré", None) for i in range(50)]
    out = sorted((r["doc_id"] or 0, r["recoverable"]) for r in mojibake.repair_encoding(spark.createDataFrame(rows, DOC_SCHEMA)).collect())
    assert out == [(0, 0), (4, 0), (4, 0), (6, 1)]
    assert mojibake.repair_encoding(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_mappings_are_tried_inside_segments_only(monkeypatch):
    texts = ["un café très serré et une évolution"] * 50 + [garble("un café très serré", ("cp1252", "utf-8"))] * 3
    counts = pd.concat(mojibake._count_pairs([pd.DataFrame({"text": texts})])).groupby(["a", "b"])["n"].sum().reset_index()
    model = mojibake.PairModel(counts.to_numpy())
    assert [bool(mojibake.Repairer(model).text(t)) for t in texts] == [False] * 50 + [True] * 3
    monkeypatch.setattr(mojibake, "segments", lambda scores: [])
    assert not any(mojibake.Repairer(model).text(t) for t in texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), max_size=25))
def test_segments_are_disjoint_and_hold_the_best(scores):
    found = mojibake.segments(scores)
    assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(sorted(found), sorted(found)[1:]))
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert max((sum(scores[a:b]) for a, b in found), default=0) == pytest.approx(max(best, 0))


# 2: scanned pages


def scanned(rnd, doc, page, confuse):
    words = " ".join(sentence(rnd) for _ in range(7)).split()
    traces, lines, line = set(), [], ""
    for w in words:
        bare = w.strip(".").lower()
        if len(bare) > 5 and rnd.random() < 0.03:
            a, b = rnd.choice([x for x in confuse if x[0] in bare] or [("", "")])
            if a:
                w = w.replace(a, b, 1)
                traces.add(("character", bare))
        if len(line) + len(w) > 55:
            if len(bare) > 7 and "-" not in w and w.lower().strip(".") == bare and rnd.random() < 0.5:
                lines.append(line + " " + w[:4] + "-")
                traces.add(("hyphenation", bare))
                line = w[4:]
                continue
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    lines.append(line)
    header = f"Reports of the {doc} valley"
    traces |= {("running_line", header.lower()), ("page_number", str(page + 40))}
    return "\n".join([header, *lines, f"- {page + 40} -"]), traces


def test_scan_traces_found(spark):
    rnd = random.Random(8)
    rows, want = [], set()
    for d in range(25):
        for p in range(12):
            text, traces = scanned(rnd, f"North{d}", p, [("e", "c"), ("i", "!"), ("o", "0"), ("l", "1"), ("h", "b"), ("d", "cl")])
            rows += [(f"s{d}", p, text, "clash"), (f"s{d}", p, None, None), (f"s{d}", p, text, "again")]
            want |= {(f"s{d}", p, *t) for t in traces}
    hits = spark.createDataFrame(rows, "doc_id string, page_index int, text_excerpt string, word string")
    _, traces = scans.scan_traces(hits)
    got = {(r["doc_id"], r["page_index"], r["noise"], r["value"]) for r in traces.collect()}
    for noise, least in (("running_line", 0.95), ("page_number", 0.95), ("hyphenation", 0.95), ("character", 0.7)):
        w, g = {x for x in want if x[2] == noise}, {x for x in got if x[2] == noise}
        assert len(w & g) >= least * len(w), noise
        assert len(w & g) >= 0.9 * len(g), noise
    text = scans.repair_pages(hits).where("doc_id = 's0' and page_index = 3").first()["text"]
    assert "Reports of" not in text and "- 43 -" not in text and "\n" not in text


def test_headers_of_three_lines(spark):
    rnd = random.Random(12)
    rows = []
    for d in range(12):
        for p in range(10):
            body = [" ".join(rnd.choice(["under", "water", "river", "small", "valley", "healed", "clinic", "letters", "morning", "patient"]) for _ in range(8)) + "." for _ in range(9)]
            rows.append((f"s{d}", p, "\n".join([f"Institute of Northern Care {d}", f"Annual survey of wards {d}", f"Volume {d} of the series", *body, f"Page {p + 3}"])))
    got = scans.scan_traces(spark.createDataFrame(rows, "doc_id string, page_index int, text_excerpt string"))[1].collect()
    heads = {(r["doc_id"], r["page_index"], r["value"]) for r in got if r["noise"] == "running_line"}
    assert sum((f"s{d}", p, line) in heads for d in range(12) for p in range(10) for line in (f"institute of northern care {d}", f"annual survey of wards {d}", f"volume {d} of the series")) >= 0.95 * 360


def test_frequent_words_are_no_misreadings(spark):
    words = [("for", 9000), ("fever", 900), ("found", 700), ("por", 300), ("foot", 500), ("after", 800), ("affer", 2), ("left", 900), ("leff", 1), ("righf", 2), ("right", 900), ("tests", 300), ("fesfs", 1), ("h0me", 1), ("home", 400), ("w0rds", 1), ("words", 300), ("month", 300), ("monfh", 2)]
    out = {r["word"]: r["right"] for r in scans.corrections(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert "por" not in out and out["affer"] == "after" and out["monfh"] == "month"


def test_a_candidate_is_found_whatever_it_shares(spark):
    import itertools

    base = "pseudoepitheliomatous"
    spoilt = {base[:i] + "zz" + base[i + 2 : j] + "zz" + base[j + 2 : k] + "zz" + base[k + 2 :] for i, j, k in itertools.combinations(range(1, len(base) - 2, 3), 3)}
    words = spark.createDataFrame([(base, 500), ("pseudomonas", 50)] + [(w, 1) for w in sorted(spoilt)], "word string, n bigint")
    found = {r["word"] for r in scans.correction_pairs(words).where(f"cand = '{base}'").collect()}
    assert found == spoilt


def test_paragraphs_follow_the_line_pairs(spark):
    rnd = random.Random(3)
    line = lambda: " ".join(rnd.choice(["under", "water", "river", "small", "valley", "healed"]) for _ in range(8))
    pages = []
    for p in range(60):
        parts = []
        for _ in range(3):
            parts.append("\n".join(["The " + line(), *[line() for _ in range(3)], "then it healed."]))
        pages.append(("\n\n".join(parts), None))
    model = scans.paragraph_model(spark.createDataFrame(pages, "text string, furniture array<int>"))
    weights = [float(w) for w in model.weights]
    joined = pages[0][0].replace("\n\n", "\n", 1)
    assert len(scans.paragraphs(joined, set(), weights)) == 3
    torn = pages[0][0].split("\n")
    torn.insert(2, "")
    assert len(scans.paragraphs("\n".join(torn), set(), weights)) == 3


def test_scan_edge_cases(spark):
    schema = "doc_id string, page_index int, text_excerpt string"
    rows = [("a", 0, ""), ("a", 1, None), (None, 1, "x"), ("b", None, "x"), ("c", 2, "word " * 40_000), ("d", 3, "\r\n\r\n"), ("e", 4, "-\n-\n12"), ("e", 4, "-\n-\n12")]
    scans.scan_traces(spark.createDataFrame(rows, schema))[1].collect()
    assert {r["doc_id"] for r in scans.repair_pages(spark.createDataFrame(rows, schema)).collect()} == {"a", "c", "d", "e"}
    assert scans.scan_traces(spark.createDataFrame([], schema))[1].count() == 0


def test_page_numbers():
    assert scans.split_number("- 414 -") == ("", "414") and scans.split_number("Page 464") == ("", "464") and scans.split_number("16 of 34") == ("", "16")
    assert scans.split_number("x   Village  surveys") == ("village surveys", "x") and scans.split_number("QUARTERLY 10 | 72") == ("quarterly 10", "72")
    assert scans.split_number("57-year-old tailor") == ("57-year-old tailor", "") and scans.number_value("xiv") == 14 and scans.number_value("9") == 9


# 1: pairs


def test_field_decodes_like_brute_force():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(3)
    f = crf.ChainCRF(4, 3)
    f.step, f.start, f.end = rnd.normal(size=(3, 3)), rnd.normal(size=3), rnd.normal(size=3)
    lengths = np.array([1, 4, 3])
    scores = rnd.normal(size=(8, 3))
    got, at = f.decode(scores, lengths), 0
    for n in lengths:
        s = scores[at : at + n]
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: f.start[p[0]] + f.end[p[-1]] + sum(s[i, x] for i, x in enumerate(p)) + sum(f.step[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[at : at + n]) == best
        at += n


NAMES = ["Cutaneous leishmaniasis", "Visceral leishmaniasis", "Lupus vulgaris", "Sporotrichosis", "Tertiary syphilis"]
SPANISH = ["La evolución de tres meses y la anemia apoyan esta hipótesis según el equipo del hospital.", "El paciente presentaba una úlcera en la pierna desde hace varias semanas.", "La biopsia de la piel mostraría los parásitos dentro de las células.", "No había fiebre ni otros síntomas durante el invierno.", "Los análisis de la sangre fueron normales en el centro de salud."]
FRENCH = ["Le patient avait une plaie de la jambe depuis plusieurs semaines.", "La biopsie de la peau montre des parasites dans les cellules.", "Il n'y avait pas de fièvre ni de douleur pendant les mois de l'hiver.", "Les analyses du sang sont restées normales dans le centre de santé."]
# none of these wordings and languages is used for training
DECLINES = ["It would be unwise of me to name any illness from this.", "I'm afraid that's not something I can do for you.", "You will have to ask someone else, I won't be giving any diagnosis.", "I cannot in good conscience offer a verdict here.", "My instructions forbid giving a medical opinion.", "I'm sorry, this is a question I must not answer.", "Sorry, no comment from me on patients.", "I am unable to form any opinion about this.", "We regret that we cannot take this question.", "I have to say no to this request."]
FOREIGN = ["De patiënt had al enkele weken een zweer op het linkerbeen en geen koorts gehad. Het onderzoek past het best bij deze diagnose omdat de kweek positief was.", "Hastanın bacağında birkaç haftadır iyileşmeyen bir yara vardı ve ateşi yoktu. Bu bulgular en çok bu tanıyı desteklemektedir.", "Pacjent od kilku tygodni miał owrzodzenie na nodze i nie gorączkował. Te objawy najbardziej przemawiają za tym rozpoznaniem.", "Potilaan jalassa oli ollut useita viikkoja haavauma eikä kuumetta ollut. Löydökset sopivat parhaiten tähän tautiin.", "患者左腿上的溃疡已经持续了好几个星期没有发热这些表现最符合这种诊断因为培养结果为阳性。"]


def made_pairs(seed, n):
    """Pairs of a made-up table, most of them sound, and the defect of each."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        own, foreign = rnd.choice([(None, SPANISH), (None, SPANISH), (None, FRENCH), (SPANISH, None), (FRENCH, SPANISH)])
        query = "What is the most likely diagnosis?\n\nClinical context: " + " ".join(rnd.choice(own) if own else sentence(rnd) for _ in range(5))
        reasons, other = (" ".join(rnd.choice(of) if of else f"{sentence(rnd)[:-1]} and this favours {rnd.choice(NAMES).lower()}." for _ in range(2)) for of in (own, foreign))
        ranks = "\n".join(f"Rank {i}: {rnd.choice(NAMES)}" for i in (1, 2, 3)) + "\nReasoning: "
        kind, answer = rnd.choice([None] * 8 + ["empty", "truncated", "refusal", "copied_question", "other_language"]), ranks + reasons
        if kind == "empty":
            answer = rnd.choice([None, "", " \n", "N/A", "Rank 1:\nRank 2:\nRank 3:", "Reasoning:"])
        elif kind == "truncated":
            at = rnd.randrange(answer.index("Reasoning") + 30, len(answer) - 3)
            answer = answer[:at].rstrip(". ") + ("x" if answer[at - 1] in ". " else "")
        elif kind == "refusal":
            answer = rnd.choice(["I am not able to interpret these images.", "Request declined.", "Sorry, I won't give an opinion on this case.", "Devo recusar este pedido."])
        elif kind == "copied_question":
            answer = rnd.choice([query, query.upper(), query.replace("?", "")])
        elif kind == "other_language":
            answer = ranks + other
        out.append((query, answer, kind))
    return out


SCHEMA = "answer_id bigint, query string, answer string, defect string, answer_format_valid boolean"


def test_pair_defects(spark):
    made = made_pairs(4, 1500)
    rows, want = [(i, q, a, "clash", False) for i, (q, a, _) in enumerate(made)], {i: k for i, (*_, k) in enumerate(made) if k}
    got = {r["answer_id"]: r["defect"] for r in pairs.find_broken_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    for kind in set(want.values()):
        held = [i for i, k in want.items() if k == kind]
        assert sum(got.get(i) == kind for i in held) >= 0.9 * len(held), kind
    assert len(set(got) - set(want)) <= 0.01 * len(made)
    assert pairs.find_broken_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, None, "word " * 50_000, None, None), (2, "", "Lupus.", None, None), (1, None, None, None, None)], SCHEMA)
    assert sorted(r["answer_id"] or 0 for r in pairs.find_broken_pairs(odd).where("defect = 'empty'").collect()) == [1, 1]


def test_wordings_and_languages_that_training_has_not_seen(spark):
    made = made_pairs(5, 1500)
    tagger = pairs.fit_tagger(spark.createDataFrame([(q, a) for q, a, _ in made], "query string, answer string"))
    query = made_pairs(6, 40)[0][0]
    ranks = "\n".join(f"Rank {i}: {n}" for i, n in enumerate(NAMES[:3], 1)) + "\nReasoning: "
    english = next(q for q, *_ in made_pairs(6, 40) if "hospital" in q and "según" not in q and "santé" not in q)
    assert sum(d == "refusal" for d in tagger.defects([english] * len(DECLINES), DECLINES)) >= 0.9 * len(DECLINES)
    assert tagger.defects([english] * len(FOREIGN), [ranks + f for f in FOREIGN]) == ["other_language"] * len(FOREIGN)
    sound = [ranks[: ranks.index("Reasoning")].strip(), "Lupus vulgaris.", "This is not medical advice. " + ranks + "The team recorded a shallow ulcer before treatment and this favours sporotrichosis."]
    assert tagger.defects([english] * len(sound), sound) == [None] * len(sound)
    # without the field every clause is an answer, and only the empty ones are left
    tagger.tags = lambda x: __import__("numpy").zeros(len(x.sizes), int)
    assert set(tagger.defects([q for q, *_ in made], [a for _, a, _ in made])) <= {None, "empty"} and query


def test_large_ids_beside_nulls_stay(spark):
    big = 2**53 + 1
    rows = [(big, "q", None, "x \ufffd", "s"), (None, "q", None, "y \ufffd", "s")]
    df = spark.createDataFrame(rows, "id bigint, query string, answer string, text string, source string").coalesce(1)
    assert {r[0] for r in pairs.find_broken_pairs(df, "id").collect()} == {big, None}
    assert {r[0] for r in mojibake.repair_encoding(df, "id").collect()} == {big, None}
    assert {r[0] for r in tokens.token_sizes(df, id_col="id").collect()} == {big, None}


def test_answers_that_state_nothing():
    for text in [None, "", " \n\t", "N/A", "null", "Rank 1:\nRank 2:", "Reasoning:", "**Rank 1:** none", "<answer></answer>"]:
        assert pairs.states_nothing(text), text
    for text in ["Yaws", "Rank 1: Yaws", "No.", "1"]:
        assert not pairs.states_nothing(text), text


# 6 and 7: sizes, packing and mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.sampled_from("abcdefgh"), st.sampled_from("xyz")), max_size=60))
def test_best_fit_keeps_capacity_and_conflicts(items):
    bins = packing.best_fit(items, 50)
    held = {}
    for (size, cluster, _), b in zip(items, bins):
        held.setdefault(b, []).append((size, cluster))
    assert len(bins) == len(items)
    assert all(sum(s for s, _ in x) <= 50 and len({c for _, c in x}) == len(x) for x in held.values())


def test_hot_clusters_pack_in_near_linear_time():
    import time

    rnd = random.Random(1)
    items = [(rnd.randrange(1, 60), "copies" if i % 3 == 0 else f"k{i // 7}", "s") for i in range(60_000)]
    began = time.time()
    bins = packing.best_fit(items, 600)
    assert time.time() - began < 20
    assert len({b for b, (_, c, _) in zip(bins, items) if c == "copies"}) == 20_000


def test_packing_holds_every_token_once(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b"]), f"c{rnd.randrange(400)}", rnd.choice([1, 7, 40, 99, 100, 101, 350])) for i in range(900)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, cluster string, tokens bigint")
    out = packing.pack(sizes, 100, 20_000).collect()
    per_doc, per_bin = {}, {}
    for r in out:
        per_doc.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
        per_bin[r["container"]] = per_bin.get(r["container"], 0) + r["tokens"]
    for i, _, _, n in rows:
        parts = sorted(per_doc[i])
        assert sum(t for _, t in parts) == n and [a for a, _ in parts] == list(range(0, n, 100)) and (len(parts) == 1 or n > 100)
    assert max(per_bin.values()) <= 100 and sum(per_bin.values()) / (100 * len(per_bin)) > 0.95
    assert packing.pack(sizes.where("false")).count() == 0


def test_token_sizes(spark):
    d = spark.createDataFrame([(1, "Hello world", " A "), (2, "hello  WORLD", None), (3, None, "a"), (4, "", "a"), (5, "x" * 100_000, "a"), (5, "x" * 100_000, "a")], "doc_id bigint, text string, source string")
    r = {x["doc_id"]: x for x in tokens.token_sizes(d).collect()}
    assert r[1]["tokens"] == 2 and r[1]["cluster"] == r[2]["cluster"] and r[1]["source"] == "a" and r[2]["source"] == "" and set(r) == {1, 2, 5}


def test_mix_reaches_the_shares(spark):
    rnd = random.Random(9)
    rows = [(i, s, f"k{i}", rnd.randrange(20, 400)) for i, s in enumerate(["big"] * 4000 + ["small"] * 300 + ["unused"] * 50)] + [(99_999, "small", "k4000", 30)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, cluster string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.6, 1), (" SMALL", 0.3, 4), ("missing", 0.1, None)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(sizes, targets)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["big"]["reached_share"] - 2 / 3) < 0.01 and abs(r["small"]["reached_share"] - 1 / 3) < 0.01 and r["missing"]["reached_share"] == 0
    m = mixed.collect()
    assert max(x["copies"] for x in m if x["source"] == "small") <= 4 and max(x["copies"] for x in m if x["source"] == "big") == 1
    assert len({x["doc_id"] for x in m}) == len(m) and all(x["source"] != "unused" for x in m)
    assert sorted(map(tuple, m)) == sorted(map(tuple, mixing.mix(sizes, targets)[0].collect()))
    assert mixing.mix(sizes.where("false"), targets)[0].count() == 0 and mixing.mix(sizes, targets.where("false"))[0].count() == 0


def test_mix_keeps_texts_whose_first_copy_is_elsewhere(spark):
    rows = [(i, "", f"k{i}", 100) for i in range(150)] + [(i, "unused", f"k{i}", 100) for i in range(150, 200)]
    rows += [(1000 + i, "a", f"k{i}", 100) for i in range(200)] + [(2000 + i, "b", f"k{i}", 100) for i in range(200, 400)] + [(500 + i, "none", f"k{i}", 100) for i in range(200, 400)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, cluster string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(sizes, targets)
    r = {x["source"]: x for x in report.collect()}
    assert r["a"]["texts"] == r["b"]["texts"] == 200 and r["a"]["tokens_used"] == r["b"]["tokens_used"] == 20_000
    assert {x["doc_id"] for x in mixed.collect()} == {1000 + i for i in range(200)} | {2000 + i for i in range(200, 400)}


def test_a_long_text_at_the_edge_does_not_stop_the_fill(spark):
    rows = [(i, "a", f"a{i}", 100) for i in range(50)] + [(1000 + i, "b", f"b{i}", 3000 if i % 4 == 0 else 30) for i in range(400)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, cluster string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    for edge_texts in (50_000, 5):
        mixed, report = mixing.mix(sizes, targets, edge_texts=edge_texts, buckets=16)
        used = {r["source"]: (r["tokens_used"], r["deviation"]) for r in report.collect()}
        assert used["a"][0] == 5000 and 4970 <= used["b"][0] <= 5000 and abs(used["b"][1]) < 0.01
        assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0


def test_pareto_inclusion_follows_the_weights(spark):
    rows = [(i, "s", f"k{i}", 100 if i % 2 else 400) for i in range(20_000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, cluster string, tokens bigint")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(sizes, targets, total_tokens=500_000)[0].groupBy("tokens").count().collect()
    n = {r["tokens"]: r["count"] for r in m}
    assert abs(n[400] / n[100] - 2.0) < 0.15  # inclusion grows with the root of the size
    assert abs(sum(t * c for t, c in n.items()) - 500_000) < 400


def test_registered_queries_run(spark):
    from caseloom.llm import queries

    for name in ("p1_found", "p6_report", "p7_report", "p8_found"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_all_pairs_teach_the_field(spark):
    made = made_pairs(4, 1500)
    tagger = pairs.fit_tagger(spark.createDataFrame([(q, a) for q, a, _ in made], "query string, answer string"), share_rows=500)
    got = tagger.defects([q for q, *_ in made], [a for _, a, _ in made])
    for kind in {k for *_, k in made if k}:
        held = [g for g, (*_, k) in zip(got, made) if k == kind]
        assert sum(g == kind for g in held) >= 0.9 * len(held), kind
    assert sum(g is not None and k is None for g, (*_, k) in zip(got, made)) <= 0.01 * len(made)


def test_a_share_is_encoded_once(monkeypatch):
    import numpy as np

    from caseloom.llm import clauses

    sample = [(q, a) for q, a, k in made_pairs(7, 300) if k is None]
    tagger = pairs.Tagger(crf.ChainCRF(clauses.WIDTH, len(pairs.TAGS)), clauses.Languages([t.lower() for p in sample for t in p]), clauses.Names([n.lower() for n in NAMES]), -7.0)
    seen, encode = [], pairs.encode
    monkeypatch.setattr(pairs, "encode", lambda queries, answers, *rest: seen.extend(zip(queries, answers)) or encode(queries, answers, *rest))
    field, counts = pairs.fit_share(sample, [n.lower() for n in NAMES], tagger, 20, np.random.default_rng(1))
    assert all(seen.count(p) == 1 for p in sample) and field.emit.any() and counts.any()


def test_features_do_not_hang_on_the_queries_beside_them():
    import numpy as np

    from caseloom.llm import clauses

    sample = [(q, a or "") for q, a, _ in made_pairs(8, 120)] + [("", "Lupus."), ("x", ""), ("", "")]
    queries, answers = [q for q, _ in sample], [a for _, a in sample]
    languages, names = clauses.Languages([t.lower() for t in queries]), clauses.Names([n.lower() for n in NAMES])
    whole = clauses.encode(queries, answers, languages, names, -7.0)
    known = clauses.Queries(queries, languages, size=7)
    parts = clauses.Encoded.joined([clauses.encode(queries[i : i + 10], answers[i : i + 10], languages, names, -7.0, known=known) for i in range(0, len(sample), 10)])
    assert all(np.array_equal(a, b) for a, b in zip(vars(whole).values(), vars(parts).values()))
    assert all(np.array_equal(a[: len(b)], b) for a, b in zip(vars(whole).values(), vars(whole.head(9)).values()))


def test_gradient_of_the_field():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(4)
    parts = [rnd.normal(size=(4, 3)), rnd.normal(size=(3, 3)), rnd.normal(size=3), rnd.normal(size=3)]
    lengths, sizes = np.array([1, 4, 3]), np.array([1, 2, 1, 3, 1, 1, 2, 1])
    ids, labels = rnd.integers(0, 4, sizes.sum()), rnd.integers(0, 3, 8)
    items = np.split(ids, np.cumsum(sizes)[:-1])

    def loss():
        emit, step, start, end = parts
        total, at = 0.0, 0
        for n in lengths:
            score = lambda p, at=at, n=n: start[p[0]] + end[p[-1]] + sum(emit[items[at + i], x].sum() for i, x in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))
            total += np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=int(n)))) - score(tuple(labels[at : at + n]))
            at += n
        return total / len(lengths)

    for part, gradient in zip(parts, crf.ChainCRF._gradient(parts, ids, sizes, lengths, labels)):
        for at in np.ndindex(part.shape):
            part[at] += 1e-5
            up = loss()
            part[at] -= 2e-5
            down = loss()
            part[at] += 1e-5
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_repeated_queries_count_as_often_as_they_stand(spark):
    rows = [("the patient had an ulcer on the arm",)] * 3 + [("the biopsy was taken from the border",)]
    counted = spark.createDataFrame(rows, "text string").groupBy("text").count().withColumnRenamed("count", "n")
    assert sorted(pairs.common_words(counted, share=0.5)) == ["an", "arm", "had", "on", "patient", "the", "ulcer"]


def test_every_text_counts_for_the_languages(spark):
    rows = [(f"The ulcer of patient {i} was on the arm and it has been there for {i} days.",) for i in range(9_000)] + [("Die Wunde ist nicht verheilt und wurde mit der Salbe auf dem Arm für eine Woche von dem Arzt behandelt.",)] * 2
    found = pairs.learnt_languages(spark.createDataFrame(rows, "text string").repartition(4))
    assert found.kinds == ["en", "de"]
