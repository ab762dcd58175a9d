"""Operators on small inputs: text, matching, rules, graph, scores, models, files."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitagraph.functions import stem as S
from vitagraph.functions import text as T
from vitagraph.operators.edges import patient_runs
from vitagraph.operators import analytics as A
from vitagraph.operators import attributes as X
from vitagraph.operators import evaluate as E
from vitagraph.operators import edgemodel as Y
from vitagraph.operators import edges as P
from vitagraph.operators import graph as G
from vitagraph.operators import learn as L
from vitagraph.operators import matching as M
from vitagraph.operators import nodes as N
from vitagraph.operators import rules, scope, tagger
from vitagraph.sources import readers, sinks
from vitagraph.sources.tables import latest_by
from vitagraph.streaming import graph_stream

TERMS = [
    ("abdominal pain", "Symptom"), ("pain", "Symptom"), ("nausea", "Symptom"), ("ct scan", "Exam"), ("cyst", "Result"), ("lesser sac", "Anatomy"),
    ("stomach", "Anatomy"), ("aspirin", "Medication"), ("gastric cancer", "Disease"), ("cancer", "Disease"), ("echotexture", "Result"),
]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "key string, label string").cache()


def sentences(spark, *texts):
    return spark.createDataFrame([("c1", i, t) for i, t in enumerate(texts, 1)], "case_id string, sent_no int, sentence string")


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_strings(spark):
    assert one(spark, T.normalize_phrase, " X-Ray, (CT) ") == "x ray ct" and one(spark, T.normalize_phrase, None) is None
    for word, want in [("CT", "CT"), ("cysts", "cyst"), ("biopsies", "biopsy"), ("boxes", "box"), ("mass", "mass"), ("gas", "gas"), ("nodes", "node"), ("thrombi", "thrombus")]:
        assert one(spark, T.lemmatize, word) == want
    assert one(spark, T.word_shape, "COVID-19") == "X-d" and one(spark, T.word_shape, "Hemoglobin") == "Xx"
    assert one(spark, T.term_variants, "Tomography, X-Ray  Computed") == ["tomography, x-ray computed", "x-ray computed tomography"]
    assert one(spark, T.headword, "  gastric duplication cyst ") == "cyst"
    assert one(spark, T.parse_number, "12,476.5") == 12476.5 and one(spark, T.parse_number, "x") is None


def test_clinical_tokens(spark):
    got = one(spark, T.clinical_tokens, "CEA 12,476.5ng/ml; BP 136/74 mmHg, 5 mg/day (X-ray).")
    assert got == ["CEA", "12,476.5ng/ml", ";", "BP", "136/74 mmHg", ",", "5 mg/day", "(", "X-ray", ")", "."]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("aZ9-' .é\n图", max_size=30), min_size=1, max_size=4))
def test_offsets_point_at_tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in T.offset_tokens(df, ["i"], "t").collect():
        assert texts[r.i][r.char_start : r.char_end] == r.token
    for r in T.sentences_with_offsets(df, ["i"], "t").collect():
        assert texts[r.i][r.char_start : r.char_end] == r.sentence


def test_rule_sentences(spark):
    df = spark.createDataFrame([(1, "See Fig. A now. Then Dr. Bo came! Why? Because so. End?")], "i int, t string")
    got = [(r.pos, r.sentence) for r in T.rule_sentences(df, ["i"], "t").orderBy("sent_no").collect()]
    assert [s for _, s in got] == ["See Fig. A now", "Then Dr. Bo came", "ecause so", "End?"]
    assert [s for s in (r.sentence for r in T.rule_sentences(df, ["i"], "t", compat=False).orderBy("sent_no").collect())] == ["See Fig. A now", "Then Dr. Bo came", "Why", "Because so", "End?"]


def test_attributes(spark):
    text = "A 44-year-old woman with a 3-day history, 9.5cm x 4.5cm x 2.0cm cyst, 6cm x 9cm and 4 mm, on 75 mg; right, POD 4."
    assert one(spark, X.sizes, text) == ["9.5cm x 4.5cm x 2.0cm", "6cm x 9cm", "4 mm"]
    assert one(spark, X.duration, text) == "3-day history" and one(spark, X.age_years, text) == 44.0
    assert one(spark, X.age_years, "a six-month old boy") == 0.5 and one(spark, X.gender, "She came with her dog; he left") == "Female"
    assert one(spark, X.sentence_attributes, "right 5 mg and right") == "dosage=5 mg; laterality=right"
    q = X.typed_quantities(spark.createDataFrame([(1, "Fig. 3 on day 4 BP 136/74 mmHg, 2.5 mg/day, 12 cm x 3 cm, 7, type 2")], "i int, t string"), ["i"], "t")
    got = [(r.quantity, r.value, r.unit, r.matched_rule) for r in q.orderBy("token_index").collect()]
    assert got == [("4", "4", "day", "time"), ("136/74 mmHg", "136/74", "mmHg", "pressure"), ("2.5 mg/day", "2.5", "mg/day", "weight"), ("12 cm x 3 cm", "12 cm x 3 cm", "cm", "dimension"), ("2", "2", "", "numero_puro")]
    rows = spark.createDataFrame([("n", 2, "b=2"), ("n", 1, "a=1"), ("n", 3, ""), ("n", 4, "a=1"), ("n", 5, None)], "k string, o int, a string")
    assert X.merge_attributes(rows, ["k"], "o", "a").first().attributes == "a=1; b=2"


def test_scope(spark):
    neg = lambda t, e: spark.createDataFrame([(t, e)], "t string, e string").select(scope.negated_in_clause(F.col("t"), F.col("e"))).first()[0]
    assert neg("No evidence of malignancy, but pain", "Malignancy") and not neg("No evidence of malignancy, but pain", "pain")
    assert neg("free of the cyst and the stomach", "stomach")
    blocked = lambda t, p: spark.createDataFrame([(t, p)], "t string, p int").select(scope.blocked_in_window(F.col("t"), F.col("p"))).first()[0]
    assert blocked("There was no pain", 13) and blocked("pain is suspected", 0) and not blocked("mild pain", 5)


def brute_greedy(spans, key):
    kept = []
    for s in sorted(spans, key=key):
        if all(s[1] <= a or b <= s[0] for a, b in kept):
            kept.append(s)
    return sorted(kept)


def test_greedy_selection(spark):
    rng = random.Random(1)
    for _ in range(15):
        spans = sorted({(a, a + rng.randint(1, 4)) for a in (rng.randint(0, 12) for _ in range(10))})
        rows = spark.createDataFrame([(1, a, b) for a, b in spans], "i int, start int, stop int")
        for key, order in ((lambda s: (s[0], -s[1]), ("start", "-(stop - start)")), (lambda s: (-(s[1] - s[0]), s[0]), ("-(stop - start)", "start"))):
            s = F.struct(F.expr(order[0]).alias("x"), F.expr(order[1]).alias("y"), "start", "stop")
            got = rows.groupBy("i").agg(F.array_sort(F.collect_list(s)).alias("s")).select(M.greedy(F.col("s"), F.col("s")).alias("g")).first().g
            assert sorted((g.start, g.stop) for g in got) == brute_greedy(spans, key)


def test_matching_and_tags(spark, terms):
    s = sentences(spark, "Abdominal pain and gastric cancer.", "Nothing here", None)
    got = [(r.start, r.stop, r.term) for r in M.match_terms(s, ["case_id", "sent_no"], "sentence", terms).orderBy("start").collect()]
    assert got == [(0, 2, "abdominal pain"), (3, 5, "gastric cancer")]
    spans = M.match_terms(s, ["case_id", "sent_no"], "sentence", terms)
    tagged = {r.sent_no: r.tagged for r in M.tag_text(s, ["case_id", "sent_no"], "sentence", spans).collect()}
    assert tagged[1] == "TAG-SYMPTOM and TAG-DISEASE" and tagged[2] == "Nothing here"
    assert M.match_terms(s.limit(0), ["case_id", "sent_no"], "sentence", terms).count() == 0


def test_descriptors(spark, tmp_path):
    record = lambda trees, terms, act="": "<DescriptorRecord>" + act + "<TreeNumberList>" + "".join(f"<TreeNumber>{t}</TreeNumber>" for t in trees) + "</TreeNumberList><ConceptList><Concept><TermList>" + "".join(f"<Term><String>{t}</String></Term>" for t in terms) + "</TermList></Concept></ConceptList></DescriptorRecord>"
    act = "<PharmacologicalActionList><PharmacologicalAction>x</PharmacologicalAction></PharmacologicalActionList>"
    body = [
        record(["A03.556.875"], ["Stomach"]), record(["C23.888.646.421"], ["Fever", "Pyrexia"]), record(["C01.1"], ["Tuberculosis"]), record(["C23.300.707.164"], ["Cyst"]),
        record(["E01.370.350.825"], ["Computed Tomography"]), record(["E04.074"], ["Biopsy"]), record(["E04.210.696"], ["Pancreatectomy"]), record(["D02.1"], ["Aspirin"], act), record(["D02.033.375"], ["Ethanol"]),
    ]
    path = tmp_path / "desc.xml"
    path.write_text("<DescriptorRecordSet>" + "".join(body) + "</DescriptorRecordSet>")
    got = {(r.category, r.term) for r in M.classify_descriptors(readers.read_descriptors(spark, str(path))).collect()}
    assert got == {
        ("Anatomy", "stomach"), ("Symptom", "fever"), ("Symptom", "pyrexia"), ("Disease", "tuberculosis"), ("Result", "cyst"), ("Exam", "computed tomography"),
        ("Exam", "biopsy"), ("Procedure", "pancreatectomy"), ("Medication", "aspirin"),
    }


def test_dictionary(spark):
    rows = [("Cell", "Anatomy"), ("HeLa Cells", "Anatomy"), ("biopsy", "Procedure"), ("biopsy", "Exam"), ("suture", "Procedure"), ("fever", "Disease"), ("Fever", "Symptom"), (None, "Exam"), ("x", None)]
    got = {r.key: (r.label, r.candidates) for r in M.dictionary(spark.createDataFrame(rows, "t string, c string"), "t", "c").collect()}
    assert got == {"biopsy": ("Exam", ["Exam"]), "suture": ("IGNORE", ["Procedure"]), "fever": ("Symptom", ["Symptom", "Disease"])}


def test_rule_edges(spark, terms):
    s = sentences(spark, "A 3-day history of abdominal pain in the left stomach", "CT scan revealed a cyst of 4 cm in the stomach", "He took aspirin 75 mg with 40 mg later", "Past medical history of cancer", "Denies nausea")
    got = {(r.source, r.target, r.relation, r.attributes) for r in rules.rule_edges(s, terms).collect()}
    assert got == {
        ("P:c1", "abdominal pain", "PRESENTS_WITH", "duration=3-day history"), ("abdominal pain", "stomach", "LOCATED_IN", "laterality=left"),
        ("P:c1", "ct scan", "UNDERWENT_EXAM", ""), ("ct scan", "cyst", "REVEALS", "size=4 cm"), ("cyst", "stomach", "LOCATED_IN", ""),
        ("P:c1", "aspirin", "TAKES", "dosage=75 mg"), ("P:c1", "cancer", "HAS_PERSONAL_HISTORY", ""),
    }


def test_star_graph(spark, terms):
    s = sentences(spark, "She presented with nausea", "No cyst was seen", "CT scan of the stomach, 5 mg")
    edges = G.star_edges(s, terms)
    got = {(r.target_id, r.relation, r.attributes, r.sentence_number) for r in edges.collect()}
    assert got == {("S:nausea", "PRESENTS_WITH", "", 1), ("E:ct_scan", "UNDERWENT_EXAM", "dosage=5 mg", 3), ("A:stomach", "LOCATED_IN", "dosage=5 mg", 3)}
    nodes = {(r.node_id, r.type) for r in G.star_nodes(edges).collect()}
    assert nodes == {("P:c1", "Patient"), ("S:nausea", "Symptom"), ("E:ct_scan", "Exam"), ("A:stomach", "Anatomy")}
    assert {r.check: r.violations for r in A.integrity(G.star_nodes(edges), edges).collect()} == {"repeated node ids": 0, "source_id without node": 0, "target_id without node": 0}


def test_pairs_and_weak_labels(spark, terms):
    s = sentences(spark, "CT scan revealed a cyst", "cyst in the stomach seen by CT scan", "pain in the stomach", "CT scan revealed no cyst")
    keys = ["case_id", "sent_no"]
    got = {(r.sent_no, r.e1, r.e2): (r.reading_order, r.label) for r in P.weak_labels(P.candidate_pairs(P.sentence_entities(s, terms, keys), keys)).collect()}
    assert got[1, "ct scan", "cyst"] == ("E1_before_E2", "REVEALS") and got[2, "ct scan", "cyst"] == ("E2_before_E1", "REVEALS")
    assert got[3, "pain", "stomach"] == ("E1_before_E2", "LOCATED_IN") and got[4, "ct scan", "cyst"] == ("E1_before_E2", "NONE")
    # a patient is implied where the sentence names none
    assert got[3, "patient", "pain"] == ("E1_before_E2", "PRESENTS_WITH")


def test_patients_of_pairs(spark, terms):
    s = sentences(spark, "The man had nausea but the female patients had no pain", "His mother had pain")
    keys = ["case_id", "sent_no"]
    rows = P.weak_labels(P.candidate_pairs(P.sentence_entities(s, terms, keys), keys)).collect()
    got = {(r.sent_no, r.e2): (r.e1, r.e1_is_virtual, r.label) for r in rows if r.type_e1 == "Patient"}
    assert got == {(1, "nausea"): ("man", False, "PRESENTS_WITH"), (1, "pain"): ("female patients", False, "NONE"), (2, "pain"): ("patient", True, "NONE")}
    summary = {(r.section, r.name): r.n for r in P.edge_summary(P.weak_labels(P.candidate_pairs(P.sentence_entities(s, terms, keys), keys))).collect()}
    assert summary["total", "cases"] == 1 and summary["label", "PRESENTS_WITH"] == 1


def test_anchor_and_quantities(spark):
    t = spark.createDataFrame([("s", 5, 6), ("s", 1, 2), ("z", 0, 1)], "k string, start int, stop int")
    a = spark.createDataFrame([("s", 3, 4), ("s", 9, 10)], "k string, start int, stop int")
    got = {(r.k, r.start): r.a_start for r in G.nearest_anchor(t, a, ["k"]).collect()}
    assert got == {("s", 5): 3, ("s", 1): 3, ("z", 0): None}
    q = spark.createDataFrame([("s", 10, 15, "5", "mg", "weight"), ("s", 400, 405, "6", "mg", "weight")], "k string, q_start int, q_end int, value string, unit string, matched_rule string")
    e = spark.createDataFrame([("s", "x", "LOCATED_IN", 16, 20), ("s", "y", "TAKES", 40, 50)], "k string, edge string, relation string, e_start int, e_end int")
    assert [(r.value, r.edge, r.n) for r in G.bind_quantities(q, e, ["k"]).collect()] == [("5", "y", 1)]


def test_match_modes_meet_once(spark):
    row = "case_id string, start int, stop int, label string"
    gold = spark.createDataFrame([("a", 0, 2, "X"), ("a", 0, 2, "X"), ("a", 4, 5, "Y"), (None, 0, 1, "X"), ("b", None, 1, "X")], row)
    pred = spark.createDataFrame([("a", 1, 3, "X"), ("a", 4, 5, "Z"), (None, 0, 1, "X"), ("b", None, 1, "X")], row)
    found = E.match_modes(gold, pred)
    assert {r["mode"]: (r.hit_pred, r.hit_gold, r.recall) for r in found.collect()} == {"strict": (0, 0, 0.0), "start_tag": (0, 0, 0.0), "start": (1, 1, 0.25), "overlap": (1, 1, 0.25)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[1:3] for r in E.match_modes(gold.limit(0), pred.limit(0)).collect()] == [(0, 0)] * 4


def test_scores(spark):
    cols = "case_id string, start int, stop int, label string"
    gold = spark.createDataFrame([("c", 0, 2, "A"), ("c", 3, 4, "B"), ("c", 5, 6, "B"), ("c", 5, 6, "B")], cols)
    pred = spark.createDataFrame([("c", 0, 2, "A"), ("c", 3, 5, "B"), ("c", 9, 10, "C")], cols)
    got = {r.label: (r.support, r.predicted, r.tp, r.fp, r.fn, r.f1) for r in E.span_scores(gold, pred).collect()}
    assert got == {"A": (1, 1, 1, 0, 0, 1.0), "B": (2, 1, 0, 1, 2, 0.0), "C": (0, 1, 0, 1, 0, 0.0)}
    modes = {r["mode"]: (r.hit_pred, r.hit_gold) for r in E.match_modes(gold, pred).collect()}
    assert modes == {"strict": (1, 1), "start_tag": (2, 2), "start": (2, 2), "overlap": (2, 2)}
    assert E.averages(E.span_scores(gold, pred)).first().tp == 1
    tags = spark.createDataFrame([("c", i, t) for i, t in enumerate("O I-A I-A I-B O B-B B-B".split())], "c string, i int, t string")
    spans = E.bio_spans(E.repair_bio(tags, ["c"], "i", "t"), ["c"], "i")
    assert {(r.start, r.stop, r.label) for r in spans.collect()} == {(1, 3, "A"), (3, 4, "B"), (5, 6, "B"), (6, 7, "B")}


def test_analytics(spark):
    nodes = spark.createDataFrame([("P1", "Patient", "a"), ("P2", "Patient", "b"), ("P3", "Patient", "c"), ("E1", "Exam", "ct")], "node_id string, type string, label string")
    edges = spark.createDataFrame([("P1", "E1"), ("P1", "E1"), ("P2", "E1")], "source_id string, target_id string")
    hub = A.hubs(edges, nodes).first()
    assert (hub.patients, hub.edges, hub.share) == (2, 3, 66.6667)
    assert {r.state: r.patients for r in A.isolated(edges, nodes).collect()} == {"connected": 2, "isolated": 1}
    links = [("p1", "x"), ("p1", "y"), ("p2", "x"), ("p2", "y"), ("p3", "x"), ("p3", "z"), ("p4", "y"), ("p4", "x"), ("p4", "z")]
    got = {(r.class_lo, r.class_hi, r.members_lo, r.members_hi, r.shared) for r in A.co_patients(spark.createDataFrame(links, "source_id string, target_id string")).collect()}
    assert got == {("p1", "p1", 2, 2, 2), ("p1", "p4", 2, 1, 2), ("p3", "p4", 1, 1, 2)}


def test_latest(spark):
    rows = spark.sql("select * from values ('a', 1L, timestamp'2020-01-01', 'x'), ('a', 2L, timestamp'2020-01-01', 'y'), ('a', 3L, null, 'z'), ('b', 1L, null, null), (null, 1L, null, 'q') as t(k, row_id, loaded_at, v)")
    assert {(r.k, r.v) for r in latest_by(rows, "k", "v").collect()} == {("a", "y"), ("b", None)}


def test_splits_and_folds():
    test = L.split_groups([f"g{i:02d}" for i in range(50)])
    assert len(test) == 10 and L.split_groups(["b", "a"], 0.5) == L.split_groups(["a", "b", "a"], 0.5)


def test_models(spark):
    lm = {(r.context, r.word): (r.c, r.p) for r in L.laplace(L.ngram_model(spark.createDataFrame([(["a", "b"],), (["a"],), (None,)], "t array<string>"), "t", 2)).collect()}
    assert lm["<s>", "a"][0] == 2 and abs(lm["<s>", "a"][1] - 3 / (2 + 4)) < 1e-9


def test_alignment(spark):
    cases = spark.createDataFrame([("c", "Pain, pain and CT", [("pain", "S"), ("pain", "S"), ("ct", "E"), ("zz", "E"), ("pain", "IGNORE")]), ("d", None, None)], "case_id string, case_text string, entities array<struct<text:string,label:string>>")
    assert [(r.char_start, r.char_end, r.label) for r in L.align_entities(cases).orderBy("char_start").collect()] == [(0, 4, "S"), (6, 10, "S"), (15, 17, "E")]
    rows = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["a", "TAG-X", "d"]), (2, ["a"], ["b"])], "id int, original array<string>, tagged array<string>")
    got = {r.id: r.spans for r in L.align_tags(rows).collect()}
    assert [(s.start, s.stop, s.label) for s in got[1]] == [(1, 3, "X")] and got[2] is None


def test_ngram_tagger(spark):
    rng = random.Random(2)
    words, drugs = ["patient", "doctor", "nurse", "woman"], ["zomex", "kirol", "tavin"]
    tagged = [f"the {rng.choice(words)} was given TAG-DRUG every day .".split() for _ in range(300)] + [f"the {rng.choice(words)} was seen at home every day .".split() for _ in range(300)]
    fitted = tagger.fit_tagger(spark.createDataFrame([(t,) for t in tagged], "t array<string>"), "t")
    lines = spark.createDataFrame([(i, f"the {w} was given {d} every day .".split()) for i, (w, d) in enumerate((w, d) for w in words for d in drugs)] + [(99, []), (98, None)], "i int, t array<string>")
    found = tagger.find_entities(lines, ["i"], "t", fitted).collect()
    hits = {r.i for r in found if r.start == 4 and r.label == "DRUG"}
    assert len(hits) >= 9
    best, trials = tagger.tune(fitted, [("the nurse was given zomex every day .".split(), {(4, 5, "TAG-DRUG")})], 3)
    assert len(trials) == 4 and max(t["f1"] for t in trials) >= trials[0]["f1"]


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('article_id,case_id,case_text,age,gender\nA,A_1,"Two\nlines, ""quoted""",44,Female\n')
    row = readers.read_csv(spark, str(tmp_path / "c.csv"), readers.CASES).first()
    assert row.case_text == 'Two\nlines, "quoted"' and row.age == 44.0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "mesh_symptoms.csv").write_text("term,source,category\npain,m,Symptom\n")
    (tmp_path / "d" / "other.csv").write_text("term\nx\n")
    assert [tuple(r) for r in readers.read_dictionaries(spark, str(tmp_path / "d" / "*.csv")).collect()] == [("pain", "Symptom")]
    nodes = spark.createDataFrame([("P1", "Patient", 'a "b"', "x=1"), ("E1", "Exam", "ct", None)], "node_id string, type string, label string, attributes string")
    edges = spark.createDataFrame([("e1", "P1", "E1", "HAS", None)], "edge_id string, source_id string, target_id string, relation string, attributes string")
    assert sinks.mermaid_text(nodes, edges) == "graph LR\nE1[\"ct\"]\nP1 -->|HAS| E1\nP1((\"a 'b'\"))"
    sinks.write_viewer_csv(nodes, sinks.NODE_FIELDS, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == sinks.NODE_FIELDS
    fallback = nodes.select("label")
    assert readers.load_lexicon(spark, str(tmp_path / "none.json"), fallback) is fallback


def test_stream(spark, terms, tmp_path):
    (tmp_path / "in").mkdir()
    sentences(spark, "She presented with nausea", "CT scan of the stomach").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("case_id string, sent_no int, sentence string").parquet(str(tmp_path / "in"))
    out = {}
    query = graph_stream.stream_edges(stream, terms, lambda df, n: out.update({n: df.collect()}), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert {r.target_id for rows in out.values() for r in rows} == {"S:nausea", "E:ct_scan", "A:stomach"}


def test_substitution_and_patterns(spark):
    terms = {"CT": "computed tomography", "CT scan": "imaging ($1)", "bp": "x"}
    assert one(spark, lambda c: T.substitute(c, terms), "ct scan, CT and BP; bpm") == "imaging ($1), computed tomography and x; bpm"
    import re

    rx = re.compile(T.alternatives(["cyst", "biopsy", "lymph node"]), re.I)
    assert rx.findall("Cysts, biopsies and lymph  nodes; cystic") == ["Cysts", "biopsies", "lymph  nodes"]
    assert one(spark, T.valid_number, "1.5") and not one(spark, T.valid_number, "nan") and not one(spark, T.valid_number, "x")
    assert one(spark, T.repair_tags, "a TAG-DRUG/NN b") == "a TAG-DRUG b"


def test_json_and_dictionary_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b")], "key string, label string")
    sinks.write_json_lines(df, str(tmp_path / "j"), {"made_by": "test"})
    assert spark.read.json(str(tmp_path / "j")).count() == 1 and spark.read.json(str(tmp_path / "j_meta")).first().made_by == "test"
    sinks.save_dictionary(df, str(tmp_path / "d"), "stems")
    assert sinks.load_dictionary(spark, str(tmp_path / "d"), "stems").columns == ["key", "label"]
    with pytest.raises(ValueError):
        sinks.load_dictionary(spark, str(tmp_path / "d"), "words")
    terms = spark.createDataFrame([("b", "s", "X"), ("a", "s", "X"), ("c", "s", "Y")], "term string, source string, category string")
    sinks.write_category_csv(terms, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_empty_tables(spark, terms):
    empty = sentences(spark, "x").limit(0)
    assert G.star_edges(empty, terms).count() == 0 and rules.rule_edges(empty, terms).count() == 0
    keys = ["case_id", "sent_no"]
    assert P.candidate_pairs(P.sentence_entities(empty, terms, keys), keys).count() == 0
    assert X.typed_quantities(empty, ["case_id", "sent_no"], "sentence").count() == 0
    assert A.co_patients(spark.createDataFrame([], "source_id string, target_id string")).count() == 0


def test_merge_terms(spark):
    terms = spark.createDataFrame([("abdominal pain", "Symptom"), ("pain", "Symptom"), ("ct scan", "Exam")], "key string, label string")
    rows = spark.createDataFrame([(1, "Abdominal pain, then a CT scan."), (2, "no term"), (3, None)], "k int, t string")
    got = {r.k: r.tokens for r in M.merge_terms(rows, ["k"], "t", terms).collect()}
    assert got == {1: ["Abdominal_pain", "then", "a", "CT_scan"], 2: ["no", "term"], 3: None}


def test_context_bag(spark):
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate("a B , c d e f b".split())] + [(2, 0, "z")], "s int, at int, w string")
    got = {(r.s, r.at): r.bag for r in L.context_bag(rows, ["s"], "at", "w").collect()}
    assert got[1, 0] == ["b", "c", "d", "e"] and got[1, 1] == ["a", "c", "d", "e", "f"] and got[1, 7] == ["c", "d", "e", "f"] and got[2, 0] == []


def test_pair_features_tables_and_prediction(spark):
    (a, b, relations), odd = G.VALID_PAIRS[0], ("Nothing", "Nowhere")
    rows = [("x head", a, "y tail", b, "forward", d, between) for d, between in ((0, ""), (10, f"{a},Q"), (16, "Q"))] + [("x", *odd[:1], "y", odd[1], "forward", 9, "")]
    f = L.pair_features(spark.createDataFrame(rows, "e1 string, type_e1 string, e2 string, type_e2 string, reading_order string, token_dist int, intervening string").withColumn("between", F.lit("and then")))
    got = [(r.dist_bin, r.token_dist_scaled, r.num_intervening, r.has_same_type_intervening, r.valid_schema_pair, r.head_e1) for r in f.collect()]
    assert got == [("adj_0", 0.0, 0, False, True, "head"), ("far_9_15", 1.0, 2, True, True, "head"), ("very_far_16+", 1.6, 1, False, True, "head"), ("far_9_15", 0.9, 0, False, False, "x")]
    counts = {(r.level, r.x): (r.n_xy, r.n_x, r.n_y, r.pmi) for r in L.pair_pmi_tables(f).collect()}
    pmi = lambda xy, x, y: round(math.log2((xy + 0.5) / 4.5 / ((x + 0.5) / 4.5 * (y + 0.5) / 4.5)), 6)
    assert counts["type", a] == (2, 3, 3, pmi(2, 3, 3)) and counts["lexical", "x head"] == (3, 3, 3, pmi(3, 3, 3)) and counts["head", "x"] == (1, 1, 1, pmi(1, 1, 1))
    labels = ["NONE", "UNKNOWN", relations[0]]
    p = f.select(L.schema_prediction(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.30004)), labels, F.col("type_e1"), F.col("type_e2")).alias("p")).collect()
    assert [(r.p.pred_label, r.p.pred_confidence) for r in p] == [(relations[0], 0.3)] * 3 + [("NONE", 0.2)]
    assert p[0].p.probabilities == {"NONE": 0.2, "UNKNOWN": 0.5, relations[0]: 0.3}
    assert L.top_features(["f", "g", "h"], ["A"], [[0.1, 2.0, 0.1]], 2) == [("A", 1, "g", 2.0), ("A", 2, "f", 0.1)]


def test_terms_of_more_than_five_words_match(spark):
    terms = spark.createDataFrame([("atypical squamous cells of the cervix", "Result"), ("cervix", "Anatomy"), ("squamous cells", "Result")], "key string, label string")
    rows = spark.createDataFrame([(1, "Atypical squamous cells of the cervix were seen")], "k int, t string")
    for by in (M.LONGEST_FIRST, M.LEFT_TO_RIGHT):
        assert [(r.start, r.stop) for r in M.match_terms(rows, ["k"], "t", terms, by).collect()] == [(0, 6)]


#: Published pairs of words and stems.
STEMS = {
    "consigned": "consign", "consistency": "consist", "consolation": "consol", "consolingly": "consol", "conspicuously": "conspicu",
    "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneading": "knead", "knightly": "knight", "knots": "knot",
    "happy": "happi", "relational": "relat", "hopefulness": "hope", "generously": "generous", "ties": "tie", "cries": "cri", "by": "by",
    "say": "say", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hoping": "hope", "hopped": "hop",
    "skies": "sky", "caresses": "caress", "agreed": "agre", "Plastered": "plaster", "x1": "x1", "communities": "communiti", "yellow": "yellow",
    "biliary": "biliari", "resection": "resect", "adjustable": "adjust", "formalities": "formal", "vietnamization": "vietnam", "rational": "ration",
}


def test_stems(spark):
    got = {r.w: r.stem for r in S.stem_words(spark.createDataFrame([(w,) for w in [*STEMS, None]], "w string"), "w").collect()}
    assert got == STEMS


def test_stem_matches(spark):
    s = sentences(spark, "The women had recurrent infections, of the kidneys", "No terms")
    terms = M.stemmed_phrases(spark.createDataFrame([("recurrent infection",), ("kidney",), ("woman",)], "p string"), "p").select("key", F.lit("Disease").alias("label"))
    got = {(r.sent_no, r.start, r.stop, r.term, r.label) for r in M.match_stems(s, ["case_id", "sent_no"], "sentence", terms, P.patient_runs).collect()}
    assert got == {(1, 1, 2, "women", "Patient"), (1, 3, 5, "recurr infect", "Disease"), (1, 7, 8, "kidney", "Disease")}


def test_group_folds(spark):
    rng = random.Random(3)
    sizes = {f"g{i:03d}": rng.choice([1, 1, 2, 5, 40]) for i in range(120)}
    held, want = [0] * 4, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        want[g] = held.index(min(held))
        held[want[g]] += sizes[g]
    df = spark.createDataFrame(list(sizes.items()), "g string, n bigint")
    assert {r.g: r.fold for r in Y.group_folds(df, "g", "n", 4).collect()} == want
    assert Y.group_folds(df.limit(0), "g", "n").count() == 0


def pair_rows(n):
    rows = []
    for i in range(n):
        d, far = f"disease {i % 7}", i % 3 == 0
        rows.append((f"a{i % 20}_{i:02d}", 1, d, "Disease", "stomach", "Anatomy", False, 5, 9 if far else 5, 7, 10, "E1_before_E2", "and then it" if far else "in the", "seen", "was", 4 if far else 2, "", "NONE" if far else "LOCATED_IN"))
    return rows


PAIR = "case_id string, sent_no int, e1 string, type_e1 string, e2 string, type_e2 string, e1_is_virtual boolean, e1_start int, e2_start int, e1_stop int, e2_stop int, reading_order string, between string, left_context string, right_context string, token_dist int, intervening string, label string"


def test_edge_model(spark, tmp_path):
    f = L.pair_features(spark.createDataFrame(pair_rows(90), PAIR)).withColumn("group", F.split_part("case_id", F.lit("_"), F.lit(1)))
    folds = Y.group_folds(f.groupBy("group").agg(F.count("*").alias("n")), "group", "n", 2)
    out = Y.out_of_fold(f, folds, "group", 2).collect()
    assert len(out) == 90 and all(r.pred_label == r.label for r in out)
    model = Y.fit(f)
    model.save(f"{tmp_path}/model")
    again = Y.EdgeModel.load(spark, f"{tmp_path}/model")
    want = sorted((r.case_id, r.pred_label, r.pred_confidence, r.pmi_head) for r in Y.predict(model, f).collect())
    assert sorted((r.case_id, r.pred_label, r.pred_confidence, r.pmi_head) for r in Y.predict(again, f).collect()) == want
    # terms and pairs that the model has not seen
    new = L.pair_features(spark.createDataFrame([("z_1", 1, "q", "Disease", "w", "Disease", False, 0, 3, 1, 4, "E1_before_E2", "", "", "", 2, "", "NONE")], PAIR))
    assert [(r.pred_label) for r in Y.predict(model, new).collect()] == ["NONE"]
    assert len(Y.feature_names(model)) == model.stages[-1].coefficientMatrix.numCols
    assert {r[0] for r in Y.top_features(model, 3)} == {"LOCATED_IN", "NONE"}


def test_class_scores(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "NONE"), ("B", "A"), ("NONE", "NONE"), ("NONE", "B")], "t string, g string")
    got = {r.label: (r.support, r.predicted, r.tp, r.precision, r.recall) for r in P.class_scores(df, "t", "g").collect()}
    assert got == {"A": (2, 2, 1, 0.5, 0.5), "B": (1, 1, 0, 0.0, 0.0), "macro": (3, 3, 1, 0.25, 0.25), "micro": (3, 3, 1, round(1 / 3, 6), round(1 / 3, 6))}
    assert {(r.truth, r.guess): r.share for r in P.class_confusion(df, "t", "g").collect()}["A", "NONE"] == 0.5


def test_ambiguous_tags(spark):
    rows = [("O", ["Disease", "Symptom"], True, {"B-Symptom": 0.3, "I-Symptom": 0.1, "B-Disease": 0.35}), ("B-Exam", ["Exam"], True, {}), ("B-Exam", ["IGNORE"], False, {}), ("O", ["A", "B"], False, {})]
    df = spark.createDataFrame(rows, "tag string, c array<string>, f boolean, s map<string,double>")
    assert [r[0] for r in df.select(N.choose_ambiguous(F.col("tag"), F.col("c"), F.col("f"), F.col("s"))).collect()] == ["B-Symptom", "B-Exam", "O", "I-A"]


def test_hidden_spans(spark):
    df = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("k"))
    share = [df.where(L.hidden([F.col("k")], 0.3, seed)).count() / 2000 for seed in (1, 2)]
    assert all(abs(x - 0.3) < 0.05 for x in share) and df.where(L.hidden([F.col("k")], 0.0, 1)).count() == 0 and df.where(L.hidden([F.col("k")], 1.0, 1)).count() == 2000
    assert df.where(L.hidden([F.col("k")], 0.3, 1)).orderBy("k").collect() == df.repartition(3).where(L.hidden([F.col("k")], 0.3, 1)).orderBy("k").collect()


def test_named_dictionaries(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Termo,Preferred Name\nMI,Myocardial infarction\nCT,Scan\n,empty\n")
    (tmp_path / "b.json").write_text('[{"synonym": "CT", "canonical": "Computed tomography (X-ray)"}, {"synonym": "EKG", "canonical": null}]')
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    found, skipped = readers.read_named_dictionaries(spark, [str(tmp_path / f) for f in ("a.csv", "b.json", "c.csv", "none.csv")])
    assert {tuple(r) for r in found.collect()} == {("MI", "myocardial_infarction"), ("CT", "computed_tomography_x_ray")}
    assert [p.rsplit("/", 1)[1] for p in skipped] == ["c.csv", "none.csv"]
    assert readers.read_named_dictionaries(spark, [])[0].count() == 0


def test_lexicon_module_and_graph_sinks(spark, tmp_path):
    import json

    terms = spark.createDataFrame([("b", "X"), ("a", "X"), ("a", "X"), ("it's", "Y"), (None, "Y")], "term string, category string")
    sinks.write_lexicon(terms, str(tmp_path / "l.json"))
    assert json.loads((tmp_path / "l.json").read_text()) == ["a", "b", "it's"]
    sinks.write_category_module(terms, str(tmp_path / "m.py"))
    names = {}
    exec((tmp_path / "m.py").read_text(), names)
    assert names["ENTITY_CATEGORIES"] == {"X": {"a", "b"}, "Y": {"it's"}}
    with pytest.raises(ValueError):
        sinks.write_lexicon(terms, str(tmp_path / "n.json"), most=2)
    nodes = spark.createDataFrame([("c_1", 0, "Patient", "p", ""), ("c_1", 1, "Exam", "ct", "")], "case_id string, node int, type string, label string, attributes string")
    edges = spark.createDataFrame([("c_1", 0, 1, "HAS", "")], "case_id string, from_node int, to_node int, relation string, attributes string")
    sinks.write_case_graphs(nodes, edges, str(tmp_path / "n"), str(tmp_path / "e"))
    row = spark.read.option("header", True).csv(str(tmp_path / "e")).first()
    assert (row.source_id, row.target_id) == ("c_1:N0", "c_1:N1")
    n = spark.createDataFrame([("P", "Patient", "p"), ("E", "Exam", "ct"), ("Z", "Exam", "z")], "node_id string, type string, label string")
    e = spark.createDataFrame([("P", "E", "HAS")], "source_id string, target_id string, relation string")
    assert sinks.mermaid_text(*sinks.hub_subgraph(n, e, "E"), "TD", rhombus=["Exam"]) == 'graph TD\nE{"ct"}\nP -->|HAS| E\nP(("p"))'


def test_reconstructed_tokens(spark):
    s = sentences(spark, "He had chest. Pain was absent. CT; scan and kidney cysts", "The CT scan", None)
    words = spark.createDataFrame([("chest pain",), ("ct scan",), ("kidney cyst",)], "key string")
    got = {r.sent_no: r.tokens for r in M.reconstruct_tokens(s, ["case_id", "sent_no"], "sentence", words).collect()}
    assert got[1] == ["He", "had", "chest", ".", "Pain", "was", "absent", ".", "CT [computed tomography]", ";", "scan", "and", "kidney cysts"]
    assert got[2] == ["The", "CT [computed tomography]", "scan"]


def test_command_line(spark, tmp_path):
    from vitagraph.__main__ import main, parser

    spark.createDataFrame([("CT scan",), (None,)], "label string").write.parquet(f"{tmp_path}/v4_nodes.parquet")
    main(["lexicon", "--data", str(tmp_path), "--out", str(tmp_path / "l.json")])
    assert (tmp_path / "l.json").read_text() == '[\n    "ct scan"\n]'
    with pytest.raises(SystemExit):
        parser().parse_args(["run"])


def test_ranked(spark):
    from vitagraph.sources.tables import ranked

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), f"x{k:03d}", 0) for k in rng.sample(range(300), 300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        got = {(r.g, r.v): r.place for r in ranked(spark.createDataFrame(rows, "g string, v string, n_ int").drop("n_"), ["g"], ["v"], "place").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("a", "b", None):
        assert [got[g, v] for v in sorted(v for h, v in got if h == g)] == list(range(1, 1 + sum(h == g for h, _ in got)))
    assert ranked(spark.createDataFrame([], "g string, v string"), ["g"], ["v"], "place").count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from vitagraph.sources import tables

    for master, fails in (("spark://host:7077", True), ("local-cluster[2,1,1024]", True), ("local[2]", False)):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: None)
        session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
        monkeypatch.setattr(tables.atexit, "register", lambda *a: None)
        if fails:
            with pytest.raises(ValueError):
                tables.scratch_dir(session)
        else:
            assert tables.scratch_dir(session).endswith(f"vitagraph-app-{master}")


def test_stems_are_matched_on_known_words_only(spark):
    texts = spark.createDataFrame([("a", "chest pains"), ("b", "chest of pains"), ("c", "the chest patient pains"), ("d", "pain, chest pain")], "k string, s string")
    terms = spark.createDataFrame([("chest pain", "Symptom"), ("pain", "Result")], "key string, label string")
    found = M.match_stems(texts, ["k"], "s", terms, patient_runs)
    assert {(r.k, r.start, r.stop, r.label) for r in found.collect()} == {
        ("a", 0, 2, "Symptom"), ("b", 2, 3, "Result"), ("c", 2, 3, "Patient"), ("c", 3, 4, "Result"), ("d", 0, 1, "Result"), ("d", 1, 3, "Symptom"),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ement|ance" not in plan  # the stems are made once, apart from the matching
