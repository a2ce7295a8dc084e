import datetime as dt

import pytest
from pyspark.sql import functions as F

from notequery.operators import context, grounding, index, maintain, privacy, query, retrieve, segments
from notequery.streaming import changes, completions

NOW = dt.datetime(2024, 5, 1)
CORPUS = [
    ("work/autoqa.md", "---\ntitle: Automatic checks\n---\n# AutoQA\nThe checks run nightly on every build of the product.\n## Root cause\nThe orchestrator node pool was too small for the jobs we started.\n"),
    ("work/gpu-infra.md", "# GPU infra\nGPU nodes drain early. We drain the GPU pool at night and process the rest in the morning.\n"),
    ("work/realtime.md", "# Realtime\nStreams of calls need a GPU now and then, and processing must keep up with them.\n"),
    ("ideas/rag.md", "# Retrieval\nSplit notes into passages and rank them by how rare their words are in the corpus.\n"),
    ("personal/gpu.md", "# Mine\nI want a GPU of my own for the evenings and the weekends at home.\n"),
    ("work/hidden.md", "---\nai: false\n---\n# Hidden\nThe GPU budget is a secret that nobody outside may ever read.\n"),
]


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    raw = spark.createDataFrame([(p, c, NOW) for p, c in CORPUS], "path string, content string, modified timestamp")
    return segments.rebuild(raw, str(tmp_path_factory.mktemp("index")), stemming=True)


def paths(rows):
    return [r["path"] for r in sorted(rows.collect(), key=lambda r: r["rank"])]


def run(spark, notes, text, mode="all", folder=None, limit=30, cap=3, exclude=False, rules=None, after=None):
    rows = spark.createDataFrame([(1, text, mode, folder, after, limit, cap, exclude)], retrieve.QUERY)
    return retrieve.retrieve(rows, notes, rules), retrieve.withheld(rows, notes, rules)


def test_search(spark, notes):
    hits, _ = run(spark, notes, "orchestrator node pool")
    assert paths(hits)[0] == "work/autoqa.md"
    assert hits.first()["heading_path"] == "AutoQA > Root cause"
    assert set(paths(run(spark, notes, "process")[0])) == {"work/gpu-infra.md", "work/realtime.md"}
    assert paths(run(spark, notes, "automatic checks")[0]) == ["work/autoqa.md"]
    assert "work/gpu-infra.md" not in paths(run(spark, notes, "gpu -drain")[0])
    assert paths(run(spark, notes, '"drain early"')[0]) == ["work/gpu-infra.md"]
    assert paths(run(spark, notes, "orch*")[0]) == ["work/autoqa.md"]
    assert paths(run(spark, notes, "zebra")[0]) == paths(run(spark, notes, "-gpu")[0]) == []
    scores = [r["score"] for r in sorted(run(spark, notes, "gpu")[0].collect(), key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True) and scores[0] == 1.0 and scores[-1] == 0.0
    assert set(paths(run(spark, notes, "gpu", folder="personal")[0])) == {"personal/gpu.md"}
    assert paths(run(spark, notes, "gpu", after=dt.datetime(2025, 1, 1))[0]) == []


def test_exclusions_take_no_place(spark, notes):
    hits, held = run(spark, notes, "gpu", exclude=True, rules=["personal/**"])
    assert set(paths(hits)) == {"work/gpu-infra.md", "work/realtime.md"}
    assert held.first()["withheld"] == 2
    hits, held = run(spark, notes, "gpu")
    assert {"work/hidden.md", "personal/gpu.md"} <= set(paths(hits))
    questions = spark.createDataFrame([(1, "What did I write about the GPU?"), (2, "Tell me about zebras")], "qid long, question string")
    assert set(paths(retrieve.ask(questions, notes, ["personal/**"]))) == {"work/gpu-infra.md", "work/realtime.md"}
    found = retrieve.search(spark.createDataFrame([(1, "gpu")], "qid long, text string"), notes).collect()
    assert all("GPU" in r["snippet"] and r["modified"] == NOW for r in found)


def test_index_kept_up_equals_rebuilt(spark, notes):
    raw = spark.createDataFrame([("ideas/rag.md", "# New\nA wholly different text about gardens and the plants in them.", NOW), ("work/new.md", "fresh words here, enough to make a passage of them", NOW)], "path string, content string, modified timestamp")
    kept = changes.apply(notes, spark.createDataFrame([("work/realtime.md", True, NOW), ("ideas/rag.md", False, NOW), ("work/new.md", False, NOW)], "path string, removed boolean, ts timestamp"), index.parse_notes(raw))
    left = [(p, c, NOW) for p, c in CORPUS if p not in ("work/realtime.md", "ideas/rag.md")]
    whole = index.build(spark.createDataFrame(left, "path string, content string, modified timestamp").unionByName(raw), stemming=True)
    for a, b in ((kept.passages, whole.passages), (kept.postings, whole.postings), (kept.doc_stats, whole.doc_stats)):
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))
    assert maintain.remove(notes, spark.createDataFrame([("work/autoqa.md",)], "path string")).passages.filter("path = 'work/autoqa.md'").count() == 0


CLAUSES = [
    ("gpu failure", [(False, False, ["gpu"]), (False, False, ["failure"])]),
    ('"node pool" gpu', [(False, False, ["node", "pool"]), (False, False, ["gpu"])]),
    ("gpu -azure", [(False, False, ["gpu"]), (True, False, ["azure"])]),
    ("orch*", [(False, True, ["orch"])]),
    ('"unterminated phrase', [(False, False, ["unterminated", "phrase"])]),
    ("column:value", [(False, False, ["columnvalue"])]),
    ("well-known", [(False, False, ["well", "known"])]),
    ('gpu -- ... !! """ * ()', [(False, False, ["gpu"])]),
    ("-azure", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CLAUSES)
def test_clauses(spark, text, want):
    rows = query.clauses(spark.createDataFrame([(1, text)], "qid long, text string")).orderBy("clause").collect()
    assert [(r["negated"], r["prefix"], r["tokens"]) for r in rows] == want


def test_clauses_are_bounded(spark):
    assert query.clauses(spark.createDataFrame([(1, "word " * 500)], "qid long, text string")).count() == 32


@pytest.mark.parametrize(
    ("question", "terms"),
    [
        ("What did I write about the GPU nodes shutting down too early?", "gpu nodes shutting down too early"), ("What do my notes say about capacity planning?", "capacity planning"),
        ("How do I configure the dialler?", "configure dialler"), ("GPU nodes draining on a schedule", "gpu nodes draining schedule"), ("  WHAT DID I WRITE ABOUT   Disaster Recovery  ", "disaster recovery"),
        ("what island", "what island"), ("the and of", "the and of"), ('find "the one" there', "find the one"),
    ],
)
def test_question_terms(spark, question, terms):
    row = spark.createDataFrame([(question,)], "q string").select(F.array_join(query.question_terms(F.col("q")), " ").alias("t")).first()
    assert row["t"] == terms


def test_budget(spark):
    rows = [(1, i, f"n{i}.md", f"N{i}", "", "", 1, 2, NOW, "word " * 40) for i in range(1, 6)] + [(2, 1, "big.md", "Big", "f", "h", 1, 2, NOW, "word " * 4000), (2, 2, "s.md", "S", "", "", 1, 1, None, "x")]
    frame = spark.createDataFrame(rows, "qid long, rank int, path string, title string, folder string, heading_path string, line_start int, line_end int, modified timestamp, text string")
    found = {r["qid"]: r for r in context.contexts(frame, 200).collect()}
    assert found[1]["tokens"] <= 200 and found[1]["dropped"] == 5 - len(found[1]["citations"]) and not found[1]["oversized"]
    assert found[2]["oversized"] and len(found[2]["citations"]) == 1 and found[2]["dropped"] == 1
    assert found[2]["block"].startswith("=== EXCERPT 1 ===\nNote: Big\nFolder: f\nSection: h\nModified: 2024-05-01\n\nword")


@pytest.mark.parametrize(
    ("text", "used", "unmatched"),
    [
        ("a [1]", [1], []), ("[2][1] [1, 2]", [2, 1], []), ("[12] [1]", [1], [12]), ("```\n[1]\n``` `[2]` [3]", [3], []), ("x ```open [1]", [], []),
        ("[a] [] [1, b] [ 2 ]", [2], []), ("[1,] [2", [1], []),
    ],
)
def test_grounding(spark, text, used, unmatched):
    sent = spark.createDataFrame([("r", i, f"n{i}.md") for i in (1, 2, 3)], "request_id string, number int, path string")
    row = grounding.check(spark.createDataFrame([("r", text)], "request_id string, text string"), sent).first()
    assert (row["used"], row["unmatched"], row["uncited"]) == (used, unmatched, not used)
    assert sorted(row["used"] + row["unused"]) == [1, 2, 3]


def test_refusals(spark):
    ask = lambda t: spark.createDataFrame([(t,)], "t string").select(grounding.declines(F.col("t"))).first()[0]
    assert ask("I could not find this in your notes.") and not ask("It is so.") and not ask("could not find " * 40) and not ask("")


KEY = "aK3" + "xQ7vMz2Lp9rTn4Wb8" + "Zc1"
PLANTED = {
    "openai-key": "sk-" + KEY + KEY,
    "aws-access-token": "AKIA" + "Q3EGJT5VNSPW4YK2",
    "github-pat": "ghp_" + (KEY + KEY)[:36],
    "gcp-api-key": "AIza" + (KEY + KEY)[:35],
    "slack-bot-token": "xoxb-" + "1234567890123-1234567890123-" + KEY,
    "basic-auth-url": "postgres://ann:" + "s3cr3tpw@",
    "bearer-header": "Authorization: Bearer " + KEY,
    "azure-connection-key": "AccountKey=" + KEY + "==",
    "assigned-secret": "password: " + "xQ7vMz2Lp9rTn4",
    "private-key": "-----BEGIN RSA PRIVATE KEY-----\n" + KEY * 5 + "\n-----END RSA PRIVATE KEY-----",
}
CLEAN = ["password: hunter2", "secret: confidential`", "api_key = your_key_goes_here", "see https://example.org/a:b", "token: <insert token 123456>"]


def test_credentials_are_found_and_gone(spark):
    rules = privacy.load(spark)
    rows = [(k, f"é before {v} after") for k, v in PLANTED.items()] + [(f"clean{i}", c) for i, c in enumerate(CLEAN)] + [("none", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in privacy.merge(privacy.matches(docs, rules)).collect()}
    out = {r["doc_id"]: r for r in privacy.redact(docs, rules).collect()}
    for rule, secret in PLANTED.items():
        text = f"é before {secret} after"
        assert out[rule]["first_rule"] == rule and secret not in out[rule]["redacted"] and f"[redacted: {rule}]" in out[rule]["redacted"]
        a, b = spans[rule]
        assert text[:a] + f"[redacted: {rule}]" + text[b:] == out[rule]["redacted"]
    for i, c in enumerate(CLEAN):
        assert out[f"clean{i}"]["redacted"] == c
    again = privacy.redact(spark.createDataFrame([(r["doc_id"], r["redacted"]) for r in out.values()], "doc_id string, text string"), rules)
    assert all(r["redacted"] == r["text"] for r in again.collect())


def test_overlaps_merge_and_touching_spans_stay(spark):
    rows = [("d", "a", 0, 0, 10), ("d", "b", 1, 5, 15), ("d", "c", 2, 15, 20), ("d", "e", 3, 16, 18)]
    out = privacy.merge(spark.createDataFrame(rows, "doc_id string, rule string, ord int, start int, end int"))
    assert sorted((r["rule"], r["start"], r["end"]) for r in out.collect()) == [("a", 0, 15), ("c", 15, 20)]


def test_gate(spark):
    rules = privacy.load(spark)
    rows = [("1", "m", [("system", "key " + PLANTED["openai-key"]), ("user", "hi")], ["a.md"]), ("2", "m", [("user", "x")], ["personal/b.md"])]
    frame = spark.createDataFrame(rows, "request_id string, model string, messages array<struct<role: string, content: string>>, sources array<string>")
    bad = F.startswith("source", F.lit("personal/"))
    for mode in ("redact", "block", "off"):
        sent, refused = privacy.gate(frame, rules, bad, mode)
        assert [r["request_id"] for r in refused.collect()] == ["2"]
        row = sent.first()
        text = " ".join(m["content"] for m in row["messages"])
        assert (PLANTED["openai-key"] in text) == (mode == "off")
        assert len(row["messages"]) == (1 if mode == "block" else 2)
        assert (row["withheld"] == ["system: openai-key"]) == (mode == "block")
    with pytest.raises(privacy.BrokenRules):
        privacy.load(spark, [{"rule": "x", "pattern": "(", "confidence": "shape", "min_entropy": 0, "keywords": ["x"]}])
    with pytest.raises(privacy.BrokenRules):
        privacy.load(spark, [])
    assert "openai-key" not in [r["rule"] for r in privacy.names(privacy.load(spark, disabled=["openai-key", "nothing"])).collect()]


def test_debounce_and_own_writes(spark):
    at = lambda ms: NOW + dt.timedelta(milliseconds=ms)
    rows = [("a.md", False, at(0)), ("a.md", True, at(499)), ("b.md", False, at(0)), ("b.md", False, at(501)), ("c.md", True, at(0)), ("c.md", False, at(100))]
    events = spark.createDataFrame(rows, "path string, removed boolean, ts timestamp")
    got = sorted((r["path"], r["removed"]) for r in changes.debounce(events).collect())
    assert got == [("a.md", True), ("b.md", False), ("b.md", False), ("c.md", False)]
    feed = spark.createDataFrame([("x\\y.md", False, at(1900)), ("x/y.md", False, at(2000)), ("z.md", False, at(0))], "path string, removed boolean, ts timestamp")
    own = spark.createDataFrame([("x/y.md", at(0))], "path string, ts timestamp")
    assert sorted(r["path"] for r in changes.foreign(feed, own).collect()) == ["x/y.md", "z.md"]


def test_stream_replay_equals_batch(spark, tmp_path):
    at = lambda ms: NOW + dt.timedelta(milliseconds=ms)
    rows = [(f"n{i % 3}.md", i % 2 == 0, at(300 * i)) for i in range(20)] + [("end.md", False, at(10**6))]
    batch = spark.createDataFrame(rows, "path string, removed boolean, ts timestamp").coalesce(1)
    batch.write.parquet(str(tmp_path / "events"))
    stream = changes.debounce(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.format("memory").queryName("replay").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = [r for r in changes.debounce(batch).collect() if r["path"] != "end.md"]
    assert sorted(map(str, spark.table("replay").collect())) == sorted(map(str, want))


STREAM = (
    'data: {"model":"m","choices":[{"delta":{"content":"Hé"}}]}\r\n\r\n: keep-alive\n\ndata: {broken\n\ndata: {"choices":[{"delta":{"content":"llo"}}]}\n\n'
    'data: {"choices":[],"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3}}\n\ndata: [DONE]'
)


def test_every_split_gives_the_same_answer(spark):
    rows = [(str(i), s, c) for i in range(1, len(STREAM)) for s, c in enumerate((STREAM[:i], STREAM[i:]))]
    found = completions.reassemble(spark.createDataFrame(rows, "request_id string, seq int, chunk string")).drop("request_id").distinct().collect()
    assert [tuple(r) for r in found] == [("Héllo", "m", 1, 2, 3, True, 1)]
