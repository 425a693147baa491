import subprocess

import pytest

from quern.operators.search import MissingRequiredBindings
from quern.plans.demand import ask
from quern.plans.rules import RuleSet, Stats, atom, rule
from quern.sources import computed, git, syntax


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-C", str(d), "-c", "user.name=Ann", "-c", "user.email=ann@x.test", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (d / "a.txt").write_text("one\ntwo\nthree\n")
    run("add", ".")
    run("commit", "-qm", "First lamp")
    (d / "a.txt").write_text("zero\none\ntwo\nTHREE\n")
    (d / "b.txt").write_text("new\n")
    run("add", ".")
    run("commit", "-qm", "Second\n\nWith a body")
    return str(d)


def test_git(spark, rows, repo, tmp_path):
    r = spark.createDataFrame([(repo,), (repo,), (None,)], "repository string")
    log = git.commits(r).orderBy("summary").cache()
    got = log.collect()
    assert [x.summary for x in got] == ["First lamp", "Second"] and got[1].parents == [got[0].commit] and got[1].message.endswith("With a body") and got[0].email == "ann@x.test"
    assert git.commits(r, limit=1).count() == 1
    assert [(x["index"], x.parent) for x in git.commit_parents(log).collect()] == [(0, got[0].commit)]
    assert [x.summary for x in git.commit_search(log, "LAMP", 5).collect()] == ["First lamp"]
    old, new = got[0].commit, got[1].commit
    assert rows(git.ref_targets(r).select("ref", "commit")) == [("refs/heads/main", new)]
    assert rows(git.repository_vcs(spark.createDataFrame([(repo,), (str(tmp_path),)], "repository string")).select("vcs")) == [("git",)]
    assert rows(git.changed_files(r, old, new).select("path", "kind")) == [("a.txt", "modified"), ("b.txt", "added")]
    assert "@@" in git.file_diff(r, old, new, "a.txt").first().unified
    lines = [(x.old_line, x.new_line, x.kind, x.text) for x in git.file_diff_lines(r, old, new, "a.txt").orderBy("line_index").collect()]
    assert lines == [(None, 1, "added", "zero"), (1, 2, "context", "one"), (2, 3, "context", "two"), (3, None, "removed", "three"), (None, 4, "added", "THREE")]
    p = git.line_projection(r, old, new, "a.txt", 1, 2).first()
    assert (p.projected_start, p.projected_end, p.quality) == (2, 3, "shifted")
    assert git.line_projection(r, old, new, "a.txt", 3, 3).first().quality == "changed"
    assert [x.summary for x in git.file_history(r, "a.txt").collect()] == ["Second", "First lamp"]
    blame = git.file_blame(r, new, "a.txt").cache()
    assert [(x.line, x.summary) for x in blame.orderBy("line").collect()] == [(1, "Second"), (2, "First lamp"), (3, "First lamp"), (4, "Second")]
    assert sorted((x.start_line, x.end_line) for x in git.blame_hunks(blame).collect()) == [(1, 1), (2, 3), (4, 4)]


def test_computed(spark, rows):
    files = spark.createDataFrame([("r", "1", "a.rs", "x\ny", "h")], "repository string, revision string, path string, text string, hash string")
    units = spark.createDataFrame([("r", "u", "a.rs", "m", None)], "repository string, unit string, path string, model string, indexed_at timestamp")
    symbols = spark.createDataFrame([("r", None)], "repository string, indexed_at timestamp")
    reg = computed.source_relations(units, symbols, files)
    with pytest.raises(MissingRequiredBindings):
        reg.scan("FileText", ["r", None, "a.rs", None, None])
    with pytest.raises(ValueError):
        reg.scan("FileText", ["r"])
    assert rows(reg.scan("FileLineCount", ["r", "1", "a.rs", None])) == [("r", "1", "a.rs", 2)]
    assert reg.scan("FileLineCount", ["r", "1", "a.rs", 3]).count() == 0
    assert rows(reg.scan("FileLines", ["r", "1", "a.rs", 2, 5, None, None])) == [("r", "1", "a.rs", 2, 5, 2, "y")]
    near = computed.nearest_relation(spark.createDataFrame([("a", [1.0]), ("b", [-1.0])], "s string, e array<double>"), "s", "e", 7)
    assert rows(near.scan(["i", [1.0], 1, None, None, None]).select("subject", "snapshot_version")) == [("a", 7)]
    computed.register_words(spark)
    assert rows(spark.sql("SELECT * FROM words_of('a \"b c\"')")) == [(0, "a"), (1, "b c")]


def test_syntax(spark):
    files = spark.createDataFrame([("r", "1", "a.rs", 'let x = "a b"; // note', "h")], "repository string, revision string, path string, text string, hash string")
    seg = [(s.kind, s.text) for s in syntax.syntax_line(files).first().segments if s.kind != "space"]
    assert seg == [("name", "let"), ("name", "x"), ("mark", "="), ("string", '"a b"'), ("mark", ";"), ("comment", "// note")]
    sym = spark.createDataFrame([("r", "s1", "T", " Class", "a.py", 1, 9, 0, 90, None), ("r", "s2", "f", "fn", "a.py", 2, 3, 10, 40, None)],
                                "repository string, symbol string, name string, kind string, path string, start_line long, end_line long, start_byte long, end_byte long, deleted_at timestamp")
    places = spark.createDataFrame([("r", "a.py", 15), ("r", "a.py", 50), ("r", "a.py", 95)], "repository string, path string, byte_offset long")
    assert {r.byte_offset: r.name for r in syntax.syntax_node_at(sym, places).collect()} == {15: "f", 50: "T"}


def test_demand_agrees_with_full_evaluation(spark, rows):
    class Reader:
        def __init__(self, **t):
            self.t = t

        def read(self, name):
            return self.t[name]

    e = [(1, 2), (2, 3), (3, 1), (7, 8), (8, 9)]
    r = Reader(Edge=spark.createDataFrame(e, "a long, b long"), Node=spark.createDataFrame([(i,) for i in range(1, 10)], "a long"), Reach=spark.createDataFrame([(3, 70)], "a long, b long"))
    rs = RuleSet([
        rule(atom("Reach", "?x", "?y"), atom("Edge", "?x", "?y")), rule(atom("Reach", "?x", "?z"), atom("Edge", "?x", "?y"), atom("Reach", "?y", "?z")),
        rule(atom("Ring", "?x"), atom("Reach", "?x", "?x")), rule(atom("Free", "?x", "?y"), atom("Reach", "?x", "?y"), ~atom("Ring", "?y"))])
    full = rs.fixpoint(r)
    stats = Stats()
    for target, b, kinds in (("Reach", [1, None], "long"), ("Reach", [7, 9], "long, long"), ("Free", [7, None], "long"), ("Reach", [None, 9], "long")):
        got = rows(ask(rs, r, target, b, spark, kinds, stats=stats))
        assert got == [t for t in rows(full[target]) if all(x is None or x == y for x, y in zip(b, t))]


def test_syntax_line_reads_whole_texts(spark, tmp_path):
    from quern.queries import syntax_line as query

    text = "\n".join(f"let a{i} = {i};" for i in range(1, 9))
    files = spark.createDataFrame([("r", "v", "a.rs", text)], "repository string, revision string, path string, text string")
    files.write.parquet(f"{tmp_path}/source_file.parquet")
    numbers = lambda df: sorted(r.number for r in df.collect())
    assert numbers(query(spark, str(tmp_path))) == list(range(1, 9))
    assert numbers(syntax.syntax_line(files, 2, 3)) == [2, 3, 4]
