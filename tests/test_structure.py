"""Hand-made expectations: Markdown structure, frontmatter, names, query texts, rules and upkeep of a stored index."""

import pytest
from pyspark.sql import functions as F

from notequery.functions import notes as n
from notequery.operators import fuzzy, maintain, passages, privacy, query

LONG = "a text of more than forty characters that makes a passage"


def found(spark, body):
    rows = passages.passages(spark.createDataFrame([("p", body)], "path string, body string")).orderBy("ordinal").collect()
    return [(r["heading_path"], r["line_start"], r["line_end"], r["text"]) for r in rows]


def test_a_short_tail_of_a_split_section_is_a_passage_of_its_own(spark):
    head = "x" * 1190 + " y."
    assert [t for *_, t in found(spark, f"# H\n{head} Short tail.")] == [f"H {head}", "Short tail."]


def test_sentences_are_packed_with_their_spaces(spark):
    first, second = "a" * 599 + ".", "b" * 599 + "."
    assert [t for *_, t in found(spark, f"{first} {second} c.")] == [first, f"{second} c."]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"~~~~\n```\n# not a heading\n~~~~\n# Real\n{LONG}", [("", 3, 3, "# not a heading"), ("Real", 5, 6, f"Real {LONG}")]),
        (f"```py\n# a\n\n# b\n````\n# C\n{LONG}", [("", 2, 4, "# a # b"), ("C", 6, 7, f"C {LONG}")]),
        (f"```\n# open to the end {LONG}", [("", 2, 2, f"# open to the end {LONG}")]),
        (f"Title\n=====\n{LONG}\n\nSub\n---\n{LONG}", [("Title", 1, 3, f"Title {LONG}"), ("Title > Sub", 5, 7, f"Sub {LONG}")]),
        (f"    # indented\n{LONG}", [("", 1, 2, f"# indented {LONG}")]),
        (f"# A\r\n{LONG}\r\n## \r\n{LONG}\r\n", [("A", 1, 2, f"A {LONG}"), ("A", 4, 4, LONG)]),
        (f"#hashtag {LONG}", [("", 1, 1, f"#hashtag {LONG}")]),
        (f"# A #\n- [x] _done_ and **bold** {LONG}[^1]\n\n[^1]: a note", [("A", 1, 4, f"A done and bold {LONG} a note")]),
        (f"[ref]: http://x/y\n<b>{LONG}</b> <http://a.b> \\*star\\* snake_case_name", [("", 2, 2, f"{LONG} <http://a.b> *star* snake_case_name")]),
        (f"| a | b |\n|---|:-:|\n| [c](u) | {LONG} |", [("", 1, 3, f"a b c {LONG}")]),
        (f"<div>\n# inside html\n</div>\n\n{LONG}", [("", 5, 5, LONG)]),
        (f"<!--\n# hidden heading\n\nhidden text\n--> hidden\n{LONG}", [("", 6, 6, LONG)]),
        (f"{LONG}\n<!-- a\ncomment --> end", [("", 1, 1, LONG)]),
        (f"Para one\nsecond line\n===\n{LONG}", [("Para one second line", 1, 4, f"Para one second line {LONG}")]),
        (f"[a]: http://x\nTitle\n---\n{LONG}", [("Title", 2, 4, f"Title {LONG}")]),
        (f"> # Quoted\n> {LONG}\nand lazily on\n\n- item\n  ## In it\n  {LONG}\n- next", [("Quoted", 1, 5, f"Quoted {LONG} and lazily on item"), ("Quoted > In it", 6, 8, f"In it {LONG} next")]),
        (f"- item\n\n      code in it\n\n  ```\n  # no heading\n  ```\n1. {LONG}\n2. two\n", [("", 1, 9, f"item code in it # no heading {LONG} two")]),
        (f"a line\n    # no code, goes on\n\n    # code\n{LONG}", [("", 1, 5, f"a line # no code, goes on # code {LONG}")]),
        (f"see [the\nlink](http://x/y) and `code\n*kept*` {LONG} ![alt *x*](u) [![img](p) text](q)", [("", 1, 3, f"see the link and code *kept* {LONG} alt x img text")]),
        (f"***\n{LONG}\n- - -\n&amp; &lt;b&gt; <script>\nvar x;\n</script> more", [("", 2, 6, f"{LONG} & <b> var x; more")]),
        (f"<script>\n# x\n\nvar a;\n</script>\n{LONG}", [("", 6, 6, LONG)]),
        (f"one | two\n--- | ---\na \\| b | `c\\|d` {LONG} | not a column\n\n# T\n{LONG}", [("", 1, 3, f"one two a | b c|d {LONG}"), ("T", 5, 6, f"T {LONG}")]),
        (f"```\ncode\n\n{LONG}\n", [("", 2, 4, f"code {LONG}")]),
        ("", []),
        (None, []),
    ],
)
def test_structure(spark, body, want):
    assert found(spark, body) == want


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("---\na: 1\n\ntitle: old\n# note\n---\nbody", '---\na: 1\n\ntitle: "say \\"x: y\\""\n# note\ntags: [a, "b: c"]\n---\nbody'),
        ("---\r\ntags: [old]\r\n---\r\nbody\r\n", '---\r\ntags: [a, "b: c"]\r\ntitle: "say \\"x: y\\""\r\n---\r\nbody\r\n'),
        ("body\r\nmore", '---\r\ntitle: "say \\"x: y\\""\r\ntags: [a, "b: c"]\r\n---\r\nbody\r\nmore'),
    ],
)
def test_frontmatter_is_rewritten_in_place(spark, content, want):
    row = spark.createDataFrame([(content,)], "c string")
    changed = n.rewrite(F.col("c"), {"title": F.lit('say "x: y"'), "updated": F.lit(None).cast("string")}, {"tags": F.array(F.lit("a"), F.lit("b: c"))})
    assert row.select(changed).first()[0] == want
    assert n.rewrite is not None and row.select(n.rewrite(F.col("c"), {}, {"tags": F.array().cast("array<string>")})).first()[0] == content


def test_names(spark):
    names = ["a\tb c", " _Lead__and  space_ ", "CON", "...", "x" * 79 + "-y", "é/Ü:?"]
    rows = spark.createDataFrame([(x,) for x in names], "x string").select(n.slug(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["ab-c", "lead-and-space", "con-note", "untitled", "x" * 79, "éü"]


def test_marks_around_a_phrase_say_nothing(spark):
    rows = spark.createDataFrame([(1, '-"node pool" "node poo"* gpu -azure orch* - * -x*')], "qid long, text string")
    out = query.clauses(rows).orderBy("clause").collect()
    assert [(r["negated"], r["prefix"], r["tokens"]) for r in out] == [
        (False, False, ["node", "pool"]), (False, False, ["node", "poo"]), (False, False, ["gpu"]), (True, False, ["azure"]), (False, True, ["orch"]), (True, True, ["x"]),
    ]


def test_phrases_of_questions_can_be_kept(spark):
    row = spark.createDataFrame([('What about "the node pool" and gpu?',)], "q string")
    assert row.select(query.question_terms(F.col("q"))).first()[0] == ["the", "node", "pool", "gpu"]
    assert row.select(query.question_terms(F.col("q"), True)).first()[0] == ['"the node pool"', "gpu"]


def test_excerpts_are_withheld_one_by_one(spark):
    key = "glpat-" + "a1B2c3D4e5F6g7H8i9J0"
    text = f"Answer.\n\n=== EXCERPT 1 ===\nfine\n\n=== EXCERPT 2 ===\n{key}\n\n=== EXCERPT 3 ===\nalso fine\n"
    rows = spark.createDataFrame([("r", [("system", text), ("user", "q?")], [])], "request_id string, messages array<struct<role: string, content: string>>, sources array<string>")
    rules = privacy.load(spark)
    out, _ = privacy.gate(rows, rules, F.lit(False), "block", "excerpt")
    row = out.first()
    assert [m["role"] for m in row["messages"]] == ["system", "user"] and key not in row["messages"][0]["content"]
    assert "also fine" in row["messages"][0]["content"] and row["withheld"] == ["system: gitlab-pat"]
    whole, _ = privacy.gate(rows, rules, F.lit(False), "block")
    assert [m["role"] for m in whole.first()["messages"]] == ["user"]


def test_a_move_onto_a_claimed_place_is_refused(spark):
    notes = spark.createDataFrame([(f"a/{i}.md", "a", "b", None) for i in range(4)], "path string, folder string, body string, modified timestamp")
    rows = [("a/0.md", "move", "z.md"), ("a/1.md", "move", "z.md"), ("a/2.md", "delete", None), ("a/3.md", "save", None), ("q.md", "delete", None)]
    changes = spark.createDataFrame([(*r, "new", None, None) for r in rows], "path string, action string, new_path string, body string, expected timestamp, at timestamp")
    kept, refused = maintain.apply_changes(notes, changes)
    assert sorted((r["path"], r["reason"]) for r in refused.collect()) == [("a/0.md", "claimed twice"), ("a/1.md", "claimed twice"), ("q.md", "absent")]
    assert sorted((r["path"], r["body"]) for r in kept.collect()) == [("a/0.md", "b"), ("a/1.md", "b"), ("a/3.md", "new")]


def points(query_, text):
    """The greedy subsequence match, one letter at a time."""
    low, at, run, total = text.lower(), -1, 0, 0
    for c in query_.lower():
        place = low.find(c, at + 1)
        if place < 0:
            return None
        run = run + 1 if place == at + 1 and at >= 0 else 1
        total += (run - 1) * fuzzy.RUN + (fuzzy.START if place == 0 else fuzzy.WORD if low[place - 1] in " /_-" else 0)
        at = place
    return total + max(0, fuzzy.SHORT - len(text))


def test_quick_open_equals_letter_by_letter(spark):
    titles = ["Alpha beta", "beta", "The a-b test", "aab", "Ünder_score", "x/y zed"]
    notes = spark.createDataFrame([(f"dir{i}/{t}.md", t) for i, t in enumerate(titles)], "path string, title string")
    recent = spark.createDataFrame([("dir1/beta.md", 0), ("dir3/aab.md", 1)], "path string, position int")
    queries = ["ab", "beta", "d2", "", "zz", "ü_s", "a", "aa", "md", "tt", "  ", "q", "dir0/al", "ta a", "X/"]
    got = {}
    for r in fuzzy.quick_open(spark.createDataFrame(list(enumerate(queries)), "qid long, query string"), notes, recent).collect():
        got.setdefault(r["qid"], {})[r["path"]] = r["points"]
    for qid, q in enumerate(queries):
        want = {}
        q = q.strip()
        for i, t in enumerate(titles):
            path = f"dir{i}/{t}.md"
            bonus = {"dir1/beta.md": 400, "dir3/aab.md": 380}.get(path, 0)
            if not q:
                score = bonus or None
            else:
                title, place = points(q, t), points(q, path)
                score = title + fuzzy.TITLE + bonus if title is not None else place + fuzzy.PATH + bonus if place is not None else None
            if score is not None:
                want[path] = score
        assert got.get(qid, {}) == want
