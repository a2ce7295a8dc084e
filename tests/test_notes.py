import pytest
from pyspark.sql import functions as F

from notequery.functions import notes as n
from notequery.functions import text as x
from notequery.operators import index, passages
from notequery.operators.exclusions import excluded, problem
from notequery.sources import corpus, logs


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("path", "folder", "stem"),
    [("a.md", "", "a"), ("x/y/b.c.md", "x/y", "b.c"), ("x\\y\\b.md", "x/y", "b"), ("x/.hidden", "x", ".hidden"), ("plain", "", "plain")],
)
def test_paths(spark, path, folder, stem):
    assert one(spark, n.folder(F.col("v")), path) == folder
    assert one(spark, n.stem(F.col("v")), path) == stem


@pytest.mark.parametrize(
    ("content", "block", "body"),
    [
        ("no head", None, "no head"),
        ("---\ntitle: A\n---\nbody\n", "title: A\n", "body\n"),
        ("\ufeff---\r\ntitle: A\r\n---\r\nbody", "title: A\r\n", "body"),
        ("---\n---\nx", "", "x"),
        ("---\nopen: 1\n", None, "---\nopen: 1\n"),
        ("----\na: b\n---\nx", None, "----\na: b\n---\nx"),
        ("---\na: b\n--- x\nrest", None, "---\na: b\n--- x\nrest"),
    ],
)
def test_frontmatter(spark, content, block, body):
    assert one(spark, n.frontmatter(F.col("v")), content) == block
    assert one(spark, n.body(F.col("v")), content) == body


def test_fields(spark):
    block = "title: 'First'\ntitle: \"Second: x\"\ntags: [a, 'b c', \"d\",]\n  title: nested\nai: No\nai: true\ncreated: 2024-05-06T07:08:09+02:00\n"
    assert one(spark, n.field(F.col("v"), "title"), block) == "Second: x"
    assert one(spark, n.tags(F.col("v")), block) == ["a", "b c", "d"]
    assert one(spark, n.ai_excluded(F.col("v")), block) is True
    assert one(spark, n.ai_excluded(F.col("v")), "private: 0\n") is False
    assert one(spark, n.ai_excluded(F.col("v")), "private: YES\n") is True
    assert str(one(spark, n.created(F.col("v")), block)) == "2024-05-06 05:08:09"
    assert one(spark, n.created(F.col("v")), "created: yesterday\n") is None


def test_titles(spark):
    title = n.title(n.frontmatter(F.col("v")), n.body(F.col("v")), F.lit("f/stem.md"))
    assert one(spark, title, "---\ntitle: Head\n---\n# Line\n") == "Head"
    assert one(spark, title, "text\n  # Line \n# Other") == "Line"
    assert one(spark, title, "## Low") == "stem"


@pytest.mark.parametrize(
    ("name", "slug"),
    [("Hello World", "hello-world"), ("  a__b  c ", "a-b-c"), ('a<b>:"c|?*', "abc"), ("", "untitled"), ("...", "untitled"), ("CON", "con-note"), ("x" * 100, "x" * 80), ("Ünï Códe.", "ünï-códe")],
)
def test_slugs(spark, name, slug):
    assert one(spark, n.slug(F.col("v")), name) == slug


@pytest.mark.parametrize(
    ("path", "ok"),
    [("a/b.md", True), ("/etc/x", False), ("C:/x", False), ("//s/x", False), ("a/../b", False), ("a./b", False), ("a /b", False), ("con.md", False), ("a/LPT1.txt", False), ("a/console.md", True), ("", False)],
)
def test_path_safety(spark, path, ok):
    assert (one(spark, n.path_problem(F.col("v")), path) is None) == ok


def test_rewrite_keeps_other_lines(spark):
    content = "---\r\ntitle: old\r\nother: [1,\r\n  2]\r\nai: false\r\n---\r\nbody"
    out = one(spark, n.rewrite(F.col("v"), {"title": F.lit("new: one"), "ai": F.lit(None).cast("string"), "made": F.lit("x")}), content)
    assert out == '---\r\ntitle: "new: one"\r\nother: [1,\r\n  2]\r\nmade: x\r\n---\r\nbody'
    assert one(spark, n.rewrite(F.col("v"), {"ai": F.lit(None).cast("string")}), "body") == "body"
    again = n.rewrite(F.col("v"), {"title": F.lit("t")})
    assert one(spark, again, one(spark, again, "x")) == one(spark, again, "x")


def test_measures(spark):
    assert one(spark, x.entropy(F.col("v")), "") == 0
    assert one(spark, x.entropy(F.col("v")), "aabb") == pytest.approx(1)
    assert one(spark, x.looks_random(F.col("v")), "xQ7vMz2Lp9rTn4") is True
    assert one(spark, x.looks_random(F.col("v")), "confidential`") is False
    assert one(spark, x.looks_random(F.col("v")), "hunter2") is False
    assert one(spark, x.placeholder(F.col("v")), "YOUR_KEY") is True
    assert one(spark, x.tokens(F.col("v")), "x" * 36) == 10


def test_snippets_and_highlights(spark):
    terms = F.array(F.lit("needle"), F.lit("n"))
    out = one(spark, x.snippet(F.col("v"), terms), "a" * 300 + " Needle " + "b" * 300)
    assert out.startswith("…") and out.endswith("…") and "Needle" in out and len(out) <= 222
    assert one(spark, x.snippet(F.col("v"), terms), "short") == "short"
    assert one(spark, x.highlight(F.col("v"), F.array(F.lit("ab"), F.lit("abc"), F.lit("c+"))), "xABCx abx c+") == "x<mark>ABC</mark>x <mark>ab</mark>x <mark>c+</mark>"


def sections(spark, body):
    return [(r["heading_path"], r["line_start"], r["line_end"], r["text"]) for r in passages.passages(spark.createDataFrame([("p", body)], "path string, body string")).orderBy("ordinal").collect()]


LONG = "This sentence is long enough to stand on its own as a passage."


def test_passages(spark):
    assert [s[0] for s in sections(spark, f"# A\n{LONG}\n## B\n{LONG}\n### C\n{LONG}\n## D\n{LONG}")] == ["A", "A > B", "A > B > C", "A > D"]
    assert sections(spark, f"{LONG}\n\nmore") == [("", 1, 3, f"{LONG} more")]
    assert sections(spark, f"# A\n\n{LONG}\n\n# B\n{LONG}")[1][:3] == ("B", 5, 6)
    assert len(sections(spark, "# A\n## B\n")) == 1
    assert sections(spark, f"# A\n{LONG}\n# B\nstub\n") == [("A", 1, 4, f"A {LONG} B stub")]
    assert sections(spark, f"```py\n# no heading\n```\n{LONG}")[0][3] == f"# no heading {LONG}"
    assert sections(spark, "") == []
    assert sections(spark, f"- [ ] **{LONG}** [link](http://x) ![alt](y.png) `code`\r\n")[0][3] == f"{LONG} link alt code"
    many = sections(spark, "# H\n" + " ".join([LONG] * 60))
    assert len(many) > 1 and all(len(s[3]) <= 1240 for s in many) and {s[1:3] for s in many} == {(1, 2)}
    huge = sections(spark, "x" * 3000)
    assert len(huge) == 1 and len(huge[0][3]) == 3000


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("processing", "process"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("agreed", "agre"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("filing", "file"), ("sky", "sky")],
)
def test_porter(word, stem):
    assert index.stem(word) == stem


@pytest.mark.parametrize(
    ("rule", "path", "out"),
    [
        ("personal/**", "personal/a/b.md", True), ("personal/**", "work/a.md", False), ("**/secrets.md", "secrets.md", True), ("**/secrets.md", "a/b/secrets.md", True),
        ("work/cred*", "work/credentials.md", True), ("work/cred*", "work/x/credentials.md", False), ("work/key?.md", "work/key1.md", True), ("work/key?.md", "work/key12.md", False),
        ("personal", "personal/x.md", True), ("personal", "personality/x.md", False), ("Personal\\Finance\\**", "personal/finance/q.md", True), ("x", ".trash/a.md", True), ("a**b", "a/b", False),
    ],
)
def test_exclusions(spark, rule, path, out):
    assert one(spark, excluded(F.col("v"), [rule]), path) is out


def test_exclusion_problems():
    assert [bool(problem(r)) for r in ("", "../x", "/x", "C:/x", "a**b", "a/**/b")] == [True] * 5 + [False]


def test_scan_import_export(spark, tmp_path):
    for name, data in {"a.md": b"# A\n", "sub/b.MARKDOWN": b"x", "sub/c d+.md": "é".encode(), "bad.md": b"\xff\xfe", "no.txt": b"", ".hid/e.md": b"", "sub/.f.md": b""}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    good, skipped = corpus.scan(spark, str(tmp_path / "in"))
    assert {r["path"]: r["content"] for r in good.collect()} == {"a.md": "# A\n", "sub/b.MARKDOWN": "x", "sub/c d+.md": "é"}
    assert [r["path"] for r in skipped.collect()] == ["bad.md"]
    assert {r["title"] for r in corpus.heads(spark, str(tmp_path / "in")).collect()} >= {"A", "b", "c d+"}
    assert corpus.states(spark, str(tmp_path / "in")).count() == 4
    have = spark.createDataFrame([("in/x.md",), ("in/y-4.md",)], "path string")
    rows = [("X.md", "1"), ("x.md", "2"), ("Y.md", "3"), ("z.txt", "4"), ("w.md", None), ("W.md", "5")]
    made, out = corpus.import_notes(spark.createDataFrame(rows, "name string, content string"), have, "in")
    assert {r["path"] for r in made.collect()} == {"in/x-2.md", "in/x-3.md", "in/y-5.md", "in/w.md"} and out.count() == 2
    corpus.export(good, good.filter("path like 'sub/%'"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_heads_read_no_more_than_they_need(spark, tmp_path, monkeypatch):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "long é.md").write_bytes(b"---\ntitle: Long\ntags: [a, b]\nai: false\n---\n" + b"x" * 4060 + "é".encode() * 200_000)
    (tmp_path / "in" / "sub" / "late.md").write_text(" " * 5000 + "\n# Too late")
    (tmp_path / "in" / "short.md").write_text("x")
    rows = {r["path"]: (r["title"], r["tags"], r["ai_excluded"]) for r in corpus.heads(spark, str(tmp_path / "in")).collect()}
    assert rows == {"long é.md": ("Long", ["a", "b"], True), "sub/late.md": ("late", [], False), "short.md": ("short", [], False)}
    sizes = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            sizes.append(n)
            return self.file.read_at(n, at)

    class Store:
        def open_input_file(self, path):
            return Counting(corpus.fs.LocalFileSystem().open_input_file(path))

    monkeypatch.setattr(corpus, "_store_of", lambda at: (Store(), at))
    import pyarrow as pa

    at = [str(p) for p in (tmp_path / "in").rglob("*.md")] + [str(tmp_path / "gone.md")]
    batch = pa.RecordBatch.from_arrays([pa.array(at), pa.array([None] * len(at), pa.timestamp("us")), pa.array(at)], names=["path", "modified", "at"])
    out = next(corpus._read_heads([batch])).column(2).to_pylist()
    assert max(sizes) == corpus.HEAD and len(out) == 4 and out[-1] is None


def test_notes_go_out_as_files(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "# A\r\né"), ("sub/deep/b c.md", "b"), ("n.md", None), ("../out.md", "x")], "path string, content string")
    chosen = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert corpus.export_files(notes, chosen("a.md", "sub/deep/b c.md", "n.md", "a.md"), str(tmp_path / "out")) == 3
    assert (tmp_path / "out" / "a.md").read_bytes() == "# A\r\né".encode() and (tmp_path / "out/sub/deep/b c.md").read_text() == "b" and (tmp_path / "out" / "n.md").read_text() == ""
    for wrong in ("../out.md", "nowhere.md"):
        with pytest.raises(ValueError):
            corpus.export_files(notes, chosen("a.md", wrong), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists() and corpus.export_files(notes, chosen("a.md").limit(0), str(tmp_path / "no")) == 0


def test_logs(spark, tmp_path):
    lines = ["2026-09-17T04:11:04.841560Z  INFO files: watching the notes folder", "2026-09-17T04:11:05Z ERROR no category here: x", "panic!"]
    (tmp_path / "l.log").write_text("\n".join(lines))
    rows = [tuple(r)[1:] for r in logs.read(spark, str(tmp_path / "l.log")).collect()]
    assert rows[0] == ("2026-09-17T04:11:04.841560Z", "INFO", "files", "watching the notes folder")
    assert rows[1][1:] == ("ERROR", "", "no category here: x") and rows[2] == ("", "", "", "panic!")
    many = spark.range(500).withColumnRenamed("id", "n")
    assert [r["n"] for r in logs.tail(many, "n", F.col("n") % 2 == 0, 3).collect()] == [494, 496, 498]
