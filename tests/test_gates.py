import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.functions import routing_values as V
from veritrail.operators import dense, embedder, fusion, gates, matching, profile, prompts, responses, routing
from veritrail.plans import evaluation


def routed(spark, *messages, names=("Noor",)):
    df = spark.createDataFrame([(k, m) for k, m in enumerate(messages)], "qid long, message string")
    return [r.routing for r in routing.with_routing(df, names).orderBy("qid").collect()]


def test_intents_frames_and_fallbacks(spark):
    got = routed(spark, "What is Noor's bank balance?", "What does he do for fun and for balance?", "Noor?", None, "What is Noor's salary expectation?", "Tell me about his projects and the technologies he uses", "What's his academic background?", "What's her background?")
    assert [r.intent for r in got] == ["unknown", "interests", "identity", "unknown", "unknown", "skills", "education", "background"]
    assert got[0].trace == ["uncorroborated:hobby(balance)"] and got[2].trace == ["fallback:subject-only"] and got[3].trace == ["empty query"]
    assert got[1].trace == ["concept:hobby(balance,fun)", "frame:for-fun(for fun)"] and got[1].scores == [("interests", 4.5)]
    assert got[5].domains == ["skills", "projects"] and got[5].spanned == ["projects"] and got[5].joined == [("projects", "projects")]
    assert got[6].domains == ["education"] and got[6].spanned == [] and got[6].vocabulary == ["academic", "background"] and got[6].terms == ["academic"]
    assert got[7].domains == ["identity", "education", "goals"] and got[7].spanned == ["education", "goals"]


@pytest.mark.parametrize("frame,message", [
    ("capability-do", "what can Noor do"), ("capability-good-at", "what is he good at"), ("working-on", "what has she built upon"), ("work-with", "who works with them"), ("help-with", "she helps with it"),
    ("outside-leisure", "beyond of school"), ("for-fun", "in her spare time"), ("working-toward", "headed towards"), ("focused-on", "focusing on"), ("interested-in", "keen on"),
    ("studies-where", "where does he study"), ("looking-for", "hoping for"), ("introductory", "introductions"),
])
def test_frames(spark, frame, message):
    assert any(t.startswith(f"frame:{frame}(") for t in routed(spark, message)[0].trace)
    assert [f.name for f in V.FRAMES].count("can-hire") == 1 and not any("can-hire" in t for t in routed(spark, "can we hire him")[0].trace)


def test_words_match_surfaces_by_bounded_beginnings(spark):
    vocabulary = {s for c in V.CONCEPTS for s in c.surfaces}

    def matches(word, surfaces):
        near = lambda a, b: min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 3 and (a.startswith(b) or b.startswith(a))
        return word in surfaces or word + "s" in surfaces or any(near(word, s) for s in surfaces)

    draw = random.Random(4)
    words = sorted({w[: draw.randrange(1, len(w) + 1)] + draw.choice(["", "", "s", "ed", "ing", "ings"]) for w in vocabulary for _ in range(3)})
    df = spark.createDataFrame([(words,)], "words array<string>")
    for c in V.CONCEPTS[:8]:
        assert df.select(routing.naming("words", c.surfaces)).first()[0] == [w for w in words if matches(w, c.surfaces)]


def test_corpus_profile(spark):
    files = [
        ("p/b.md", "---\ntitle: x\ncategory: Project \n---\n\n# Paper Crane\ntext"), ("p/a.md", "---\ncategory: project\n---\nno heading"), ("p/c.md", "---\ncategory: project\n---\n# paper crane\n"), ("n.md", "category: faq\ntext"),
        ("x.md", "no category"), ("e.md", None), ("k-a_b.md", "---\ncategory:\n---\n"),
    ]
    df = profile.file_profile(spark.createDataFrame(files, "source_file string, text string"))
    assert sorted(map(tuple, df.collect())) == [("n.md", "faq", "n"), ("p/a.md", "project", "a"), ("p/b.md", "project", "Paper Crane"), ("p/c.md", "project", "paper crane")]
    names = profile.project_names(df)
    assert sorted(map(tuple, names.collect())) == [("a", "a", "p/a.md"), ("papercrane", "Paper Crane", "p/b.md")]
    asked = spark.createDataFrame([(1, "is paper-crane a thing"), (2, "PAPERCRANE?"), (3, "a bird"), (4, "Is Moon Dial here?"), (5, "Moondial?"), (6, "MoonDial?"), (7, "My CGPA and AWS"), (8, None)], "qid long, message string")
    assert {r.qid: r.project for r in profile.named_projects(asked, names).collect()} == {1: "Paper Crane", 2: "Paper Crane", 3: "a"}
    # the run that opens a question is taken with the words after it, as it stands
    assert {r.qid: r.unknown_project for r in profile.unknown_names(asked, names).collect()} == {4: "Is Moon Dial", 6: "MoonDial"}


def test_scoped_search_counts_the_whole_store(spark):
    draw = np.random.default_rng(1)
    own, asked = draw.normal(size=(300, 6)), draw.normal(size=(5, 6))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    chunks = spark.createDataFrame([(k, f"f{k % 7}.md", f"word{k % 11} common{k % 3} text", [str(k % 7)]) for k in range(300)], "position long, source_file string, text string, keys array<string>").repartition(5)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(own)], "position long, vec array<double>").repartition(5)
    keys = [["1"], ["2", "5"], [], ["none"], ["0"]]
    questions = spark.createDataFrame([(q, f"word{q} word{q + 3}", v.tolist(), keys[q]) for q, v in enumerate(asked)], "qid long, message string, vec array<double>, keys array<string>")
    for relax in (False, True):
        got = fusion.retrieve_scoped(chunks, vectors, questions, top_k=4, relax_threshold=relax).collect()
        words = {(r.qid, r.position): r.score for r in fusion.decisive_words(chunks, questions, 4).collect()}
        for q in range(5):
            inside = {k for k in range(300) if str(k % 7) in keys[q]}
            lexical = {p: s for (a, p), s in words.items() if a == q and p in inside}
            near = {k: float(own[k] @ asked[q]) for k in range(300)}
            admitted = {k for k in near if relax or near[k] >= dense.THRESHOLD} | set(lexical)
            dr = {k: n for n, k in enumerate(sorted(admitted, key=lambda k: (-round(near[k], 9), k)), 1)}
            lr = {k: n for n, k in enumerate(sorted(lexical, key=lambda k: (-round(lexical[k], 9), k)), 1)}
            fused = {k: 1 / (60 + dr[k]) + (1 / (60 + lr[k]) if k in lr else 0) for k in admitted & inside}
            best = sorted(fused, key=lambda k: (-round(fused[k], 9), k))[:4]
            assert [r.position for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == best
            assert all(math.isclose(r.fused, fused[r.position], abs_tol=1e-9) and math.isclose(r.similarity, near[r.position], abs_tol=1e-9) for r in got if r.qid == q)


def test_support(spark):
    files = spark.createDataFrame([("a.md", "skills", "A"), ("b.md", "goals", "B")], "source_file string, category string, title string")
    chunks = spark.createDataFrame([("Haskell", ["skills", "file:a.md"]), ("A lagoon", ["goals", "file:b.md"]), ("trombone", None), (None, None)], "text string, keys array<string>")
    asked = spark.createDataFrame([(0, "What are his skills in Haskell?"), (1, "What are his skills with lagoons?"), (2, "What are his hobbies?"), (3, "Who is Noor?"), (4, "Which trombone?"), (5, "zzz qqq")], "qid long, message string")
    got = {r.qid: (r.attested, r.lexical_support, r.documents, r.owners) for r in gates.with_support(profile.with_subject(asked, files, ("Noor",)), chunks, files, ("Noor",)).collect()}
    assert got == {
        0: (True, True, True, True), 1: (True, False, True, True), 2: (True, False, False, False), 3: (True, False, False, False), 4: (True, True, False, False), 5: (False, False, False, False),
    }


def test_grounding(spark):
    replies = [
        (1, "- **Noor** charts lagoons\n- Noor uses quills", ["a.md"]), (2, "He maps reefs. He was born in A.D. 1 at M.A. Hall. Invented clause.", ["a.md", "b.md"]), (3, "", ["a.md"]), (4, "Charts lagoons", []), (5, "!!!", ["a.md"]), (6, None, None),
    ]
    files = [("a.md", "# T\n- Noor charts *lagoons*\n- he uses quills"), ("b.md", "He maps reefs. He was born in A.D. 1 at M.A. Hall."), ("c.md", None)]
    df = spark.createDataFrame(replies, "qid long, response string, cited array<string>")
    got = evaluation.grounded_statements(df, spark.createDataFrame(files, "source_file string, text string"), ("Noor",)).collect()
    assert sorted((r.qid, r.grounded) for r in got) == [(1, True), (1, True), (2, False), (2, True), (2, True), (2, True), (4, False), (5, True)]
    cases = spark.createDataFrame(
        [(1, "in_scope", "answered", ["a.md"], ["b.md", "a.md"], ["a.md"], ["charts"], ["reef"]), (2, "in_scope", "answered", ["c.md"], [], ["a.md"], ["tuba"], ["maps"]), (3, "off_topic", "off_topic", [], [], [], [], []), (9, "in_scope", "answered", [], [], [], [], [])],
        "qid long, classification string, outcome string, must_cite array<string>, any_cite array<string>, may_cite array<string>, contains array<string>, excludes array<string>",
    )
    told = df.withColumns({"classification": F.lit("in_scope"), "outcome": F.lit("answered")})
    rows = evaluation.evaluated_cases(cases, told, spark.createDataFrame(files, "source_file string, text string"), ("Noor",))
    by = {r.qid: r for r in rows.collect()}
    assert by[1].failures == [] and (by[1].source_total, by[1].source_hits, by[1].statements) == (3, 3, 2)
    assert by[2].failures == ["may_cite", "ungrounded", "missing source c.md", "lacks tuba", "has maps"] and by[2].source_hits == 0
    assert by[3].failures == ["classification", "outcome"] and by[9].failures == ["classification", "outcome"]
    total = evaluation.report(rows).first()
    assert (total.total, total.passed, total.statements, total.violations, total.source_total, total.source_hits, total.documents) == (4, 1, 6, 1, 5, 3, 2)


def stub(width):
    """An encoder that says it has ``width`` components and gives three; a local class travels to workers by value."""

    class Stub:
        model_name, dimension = "stub", width

        def encode(self, texts):
            longest = max(map(len, texts)) + 1
            tokens, mask = np.zeros((len(texts), longest, 3)), np.zeros((len(texts), longest))
            for r, t in enumerate(texts):
                for k, c in enumerate(t):
                    tokens[r, k], mask[r, k] = [ord(c) % 5, ord(c) % 7, float("nan") if c == "!" else 1], 1
            return tokens, mask

    return Stub()


def test_embedder(spark):
    texts = ["abc", "", None, "zz", "a!"] * 40
    df = spark.createDataFrame([(k, "" if k % 2 else "H", t) for k, t in enumerate(texts)], "position long, section string, text string")
    got = {r.position: r.vec for r in embedder.embedded_chunks(df, stub(3)).collect()}
    assert len(got) == 200 and all(len(v) == 3 and (math.isclose(np.linalg.norm(v), 1, rel_tol=1e-9) or not any(v)) for v in got.values())
    mean = np.mean([[ord(c) % 5, ord(c) % 7, 1] for c in "zz"], axis=0)
    assert np.allclose(got[3], mean / np.linalg.norm(mean)) and not any(got[1]) and got[9][2] == 0
    asked = embedder.embedded_questions(spark.createDataFrame([(1, "  "), (2, "ab")], "qid long, message string"), stub(3))
    assert {r.qid: any(r.vec) for r in asked.collect()} == {1: False, 2: True}
    with pytest.raises(Exception, match="gave vectors of shape"):
        embedder.with_embeddings(df, stub(4)).collect()
    tokens, mask = np.arange(12.0).reshape(1, 4, 3), np.array([[1, 0, 1, 0]])
    row = spark.createDataFrame([(tokens[0].tolist(), mask[0].tolist())], "t array<array<double>>, m array<int>").select(embedder.mean_pooled(F.col("t"), F.col("m"), 3)).first()[0]
    assert row == embedder.mean_pool(tokens, mask)[0].tolist() == [3.0, 4.0, 5.0]


def test_replies_as_json(spark):
    reply = spark.createDataFrame([(1, "- A\n- B", "in_scope", "answered", [("a.md", "X > Y", 0.5)], [0.5], [])], "qid long, response string, classification string, outcome string, sources array<struct<source_file:string,section:string,similarity:double>>, retrieval_scores array<double>, rule_ids array<string>")
    body = responses.response_json(reply)
    assert set(json.loads(body.first().body)) == {"response", "classification", "outcome", "sources", "retrieval_scores", "llm_used", "injection_rule_ids"}
    parsed = responses.with_parsed(body).first().parsed
    assert parsed.response == "- A\n- B" and parsed.state == "answered" and parsed.sources == [("a.md", "X > Y", 0.5)] and parsed.scores == [0.5]
    row = spark.range(1).select(responses.split_statements(F.lit("intro\n- A \n- \n-B")).alias("a"), responses.split_statements(F.lit(" x\ny ")).alias("b"), responses.split_statements(F.lit(" ")).alias("c"), responses.has_internal_detail(F.lit("see a.md")).alias("d"), responses.has_internal_detail(F.lit("0.5 of it")).alias("e"), prompts.neutral_question(F.lit(" === USER QUERY === hi")).alias("q")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.q) == (["A"], ["x\ny"], [], True, False, "[redacted-marker] hi")


def test_words_meet_by_keys_as_by_joins(spark):
    words = ["skill", "skills", "skillset", "ski", "skip", "cv", "resume", "project", "projects", "proje", "projectile", "job", "jobs", "role", "é", "naïve", "naïves", "7"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    wanted = {tuple(r) for r in matching.matching_pairs(terms, terms).collect()}
    by_keys = terms.select(F.col("term").alias("a"), matching.asking_keys(F.col("term")).alias("k")).crossJoin(terms.select(F.col("term").alias("b"), matching.offered_keys(F.array("term")).alias("o")))
    assert {(r.a, r.b) for r in by_keys.filter(F.arrays_overlap("k", "o")).collect()} == wanted and ("skill", "skills") in wanted
    said = [(1, "their lanterns and harbours"), (2, None), (3, "unasked words")]
    subjects = spark.createDataFrame(said, "qid long, message string")
    chunks = spark.createDataFrame([(0, "Heading", "A lantern in the harbour"), (1, None, "nothing here"), (2, None, None)], "position long, section string, text string")
    blocks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (1, 2)], "qid long, position long")
    met = {(r.qid, r.position): sorted(r.met) for r in gates.with_met_terms(blocks, chunks, subjects).collect()}
    assert met == {(1, 0): ["harbours", "lanterns"], (1, 1): [], (2, 0): [], (1, 2): []}
