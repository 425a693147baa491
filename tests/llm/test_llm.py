"""Problems 3 and 5 to 9 on small cases: nulls, ties, repeats, empty tables, long texts, extra columns."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.chunks import split_oversized, split_text
from quern.llm.docpairs import Source, doc_pairs, js_doc, slash_doc, python_doc, rust_doc, significant_words, signature
from quern.llm.mixing import mix, mixture_report, pivotal
from quern.llm.packing import pack, pack_report, pack_sizes
from quern.llm.percentiles import clean_samples, day_sketch, merge_sketches, multi_select, percentiles
from quern.llm.stuffing import concentration, flag_pages, page_curves, stuffed_pages, stuffed_share
from quern.llm.tokens import count_tokens, encoding, with_tokens, TOKENIZER
from quern.runtime import Scratch

SENTENCES = ["The lamp stands near the door.", "It rains, and the harbour is quiet.", "Who keeps the key of the tower?", "Every room has one exit; two have none."]


# -- problem 3 ----------------------------------------------------------------------------
def texts(rng):
    yield "x" * 5000
    yield "word " * 1500
    yield "\n".join(rng.choice(SENTENCES) for _ in range(300))
    yield "\r\n\r\n".join(" ".join(rng.choice(SENTENCES) for _ in range(rng.randrange(1, 40))) for _ in range(12))
    yield "é😀" * 2500
    yield "a" * 1999 + "\n" + "b" * 3000 + "\n\nend."
    yield "e\u0301" * 3000


@pytest.mark.parametrize("limit,overlap", [(2000, 200), (300, 0), (50, 20)])
def test_pieces_tile_and_fit(limit, overlap):
    for t in texts(random.Random(4)):
        cut = split_text(t, limit, overlap)
        assert cut[0][0] == 0 and cut[-1][2] == len(t)
        for k, (s, b, e) in enumerate(cut):
            assert s <= b < e and e - s <= limit and b - s <= overlap
            assert k == 0 or (b == cut[k - 1][2] and s >= cut[k - 1][0])
            assert t[e - 1 : e + 1] != "\r\n"


def test_cuts_prefer_strong_boundaries():
    t = ("A first paragraph with words. " * 40 + "\n\n") * 4
    cut = split_text(t, 2000, 200)
    assert all(t[e - 2 : e] == "\n\n" for _, _, e in cut)
    assert all(t[s - 1 : s] in " \n" and s < b for s, b, _ in cut[1:])


def test_split_rows(spark):
    long = "\n".join(["line " + "y" * 90] * 40)
    df = spark.createDataFrame(
        [("a", 1, long, 10, "z"), ("a", 1, long, 10, "z"), ("b", 2, "q" * 2001, None, "z"), ("c", 3, "q" * 2000, 1, "z"), ("d", 4, None, 1, "z"), ("e", 5, "", 1, "z")],
        "unit string, ordinal long, text string, start_line long, piece string")
    got = split_oversized(df, keys=["unit", "ordinal"]).orderBy("unit", "piece").collect()
    assert {r.unit for r in got} == {"a", "b"}
    a = [r for r in got if r.unit == "a"]
    assert [r.piece for r in a] == list(range(len(a))) and {r.pieces for r in a} == {len(a)} and {r.hard for r in a} == {0}
    assert a[0].start_line == 10 and a[-1].end_line == 49
    for r in a:  # the lines named are those the piece lies on
        assert r.text.rstrip("\n") == "\n".join(long.split("\n")[r.start_line - 10 : r.end_line - 9])
    b = [r for r in got if r.unit == "b"]
    assert {r.hard for r in b} == {1} and {r.start_line for r in b} == {None}
    assert split_oversized(df.limit(0), keys=["unit"]).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, keys=["unit"], limit=10, overlap=10)


# -- problem 5 ----------------------------------------------------------------------------
@pytest.mark.parametrize("before,doc", [
    ("/// One two.\n#[inline]\n// note\n/// Three.\n\n", "One two.\nThree."),
    ("//// no\n", ""), ("//! inner\n", ""), ("/** Block\n * text\n */\n#[x]\npub ", ""), ("/** Block\n * text\n */\n#[x]\n", "Block\ntext\n"),
    ("/*** no */\n", ""), ("/**/\n", ""), ("/* plain */\n", ""), ("}\n", ""), ('#[doc = "From attribute"]\n#[a(b = "]")]\n', "From attribute"), ("    /// Indented\r\n    ", "Indented"), ("/// cut\nlet x = 1;\n", ""),
    ("/** a /* nested */ b */\n", "a /* nested */ b"),
])
def test_rust(before, doc):
    assert rust_doc(before).strip() == doc.strip()


@pytest.mark.parametrize("code,doc", [
    ('def f(a, b="):"):\n    """Doc here."""\n', "Doc here."), ("async def f(\n    a, # c:\n) -> dict[str, int]:\n    # note\n\n    r'''Raw\n    text'''\n", "Raw\ntext"),
    ('def f(): "One line."\n', "One line."), ('def f():\n    x = 1\n    """no"""\n', ""), ('def f():\n    f"""no"""\n', ""), ('def f():\n    b"no"\n', ""), ('def f():\n    """a""".strip()\n', ""), ("def f(): pass", ""), ('def f():\n    "a" "b"\n', "ab"),
])
def test_python(code, doc):
    assert python_doc(code) == doc


def test_js_and_slashes():
    assert js_doc("/**\n * Does it.\n */\n    ").strip() == "Does it."
    assert js_doc("/** One */\nexport ").strip() == "One"
    assert js_doc("/** One */\n\n") == "" and js_doc("/* One */\n") == "" and js_doc("/*** One */\n") == "" and js_doc('log("/** x */");\n') == ""
    assert slash_doc("x\n// one\n// two\n") == "one\ntwo" and slash_doc("// one\n\n") == "" and slash_doc("") == ""


def test_trivial():
    assert significant_words("bind the mail box now", "bind_mailbox") == 4
    assert significant_words("Visit index", "visitIndex") == 0
    assert significant_words("TODO write this up some day\n@param a b c d\n:param x: y z\nFIXME a b c d", "f") == 0
    assert significant_words("naïve café über straße", "f") == 4
    assert signature("fn f<'a>(x: &'a str, y: u64 ) -> u8 {") == signature("fn f(text:&str, n: u64)") == "&str,u64"
    assert signature("fn f(&self, m: Map<u8, u16>, g: fn(u8) -> u8)") == "&self,Map<u8,u16>,fn(u8)->u8" and signature("fn f(c: crate::T)") == "crate::T"
    assert signature("def f(self, a, b: int = 3):") == "self,_,int" and signature("f(a, b = {x: 1}) {") == "_,_" and signature("x") == ""


def test_scopes_close():
    rs = "impl<T> Show for A<T> {\n    fn a() { x('{'); }\n    // }\n    /* } /* } */ */\n    fn b() -> &'static str { r#\"}\"# }\n}\nfn free() {}\nimpl B {\n    fn c() {}\n}\n"
    own = lambda ext, text, part: Source(f"x.{ext}", text).owner(text.index(part))
    assert own("rs", rs, "fn a") == own("rs", rs, "fn b") == ("A", "Show") and own("rs", rs, "fn free") == ("", "") and own("rs", rs, "fn c") == ("B", "")
    py = 'class A(m.Base):\n    def a(self):\n        """\nno\n        """\n    def b(self): ...\n\ndef free(): ...\nclass C:\n    class D:\n        def d(self): ...\n    def c(self): ...\n'
    assert own("py", py, "def b") == ("A", "Base") and own("py", py, "def free") == ("", "") and own("py", py, "def d") == ("D", "") and own("py", py, "def c") == ("C", "")
    js = "class A extends B {\n  a() { return `}`; }\n  b() {}\n}\nfunction free() {}\n"
    assert own("js", js, "b()") == ("A", "B") and own("js", js, "function free") == ("", "")
    assert Source("x.rs", "é { }").at(2) == 1


def test_doc_pairs(spark, rows):
    src = "/// é One two three four.\npub fn f(a: u8) {\n}\n/// short\nfn g() {\n}\ntrait T {\n    /// Declared in a trait here.\n    fn h(x: u8);\n}\nimpl T for S {\n    fn h(x: u8) {\n    }\n}\n"
    raw = src.encode()

    def span(text, nth=0):
        at = -1
        for _ in range(nth + 1):
            at = raw.index(text.encode(), at + 1)
        return at, at + len(text.encode())

    f, g, decl, own = span("pub fn f(a: u8) {\n}"), span("fn g() {\n}"), span("fn h(x: u8);"), span("fn h(x: u8) {\n    }")
    sym = [("r", "a.rs", " FN", "f", *f), ("r", "a.rs", "Function ", "f", *f), ("r", "a.rs", "method", "g", *g), ("r", "a.rs", "fn", "h", *decl), ("r", "a.rs", "fn", "h", *own),
           ("r", "a.rs", None, "f", *f), ("r", "a.rs", "struct", "f", *f), ("r", "a.rs", "fn", "f", None, 9), ("r", None, "fn", "f", 0, 9), ("r", "a.rs", "fn", "f", 0, 10**6), ("r", "b.rs", "fn", "f", 0, 9)]
    s = spark.createDataFrame(sym, "repository string, path string, kind string, name string, start_byte long, end_byte long").withColumn("text", F.lit(1))
    fl = spark.createDataFrame([("r", "a.rs", src, "h", None), ("r", "b.rs", None, "h", None)], "repository string, path string, text string, hash string, indexed_at timestamp")
    got = {(r.start_byte, r.doc_from): r for r in doc_pairs(s, fl).collect()}
    assert set(got) == {(f[0], "own"), (decl[0], "own"), (own[0], "declaration")}
    assert got[f[0], "own"].code.startswith("pub fn f") and got[f[0], "own"].doc == "é One two three four."
    def case(path, text, parts):
        at = [text.index(x) for x in parts]
        return (path, text), [("r", path, "method", x.split("(")[0].split()[-1], a, a + len(x)) for a, x in zip(at, parts)]

    # Across files: overloads by their types whatever the names; a closed scope lends nothing.
    trait = case("t.rs", "trait T {\n    /// Turns the small dial here.\n    fn h(&self, x: u8);\n    /// Turns the large dial here.\n    fn h(&self, x: u64);\n}\n", ["fn h(&self, x: u8);", "fn h(&self, x: u64);"])
    impl = case("i.rs", "impl T for S {\n    fn h(&self, dial: u64) {}\n}\nfn h(x: u8) {}\n", ["fn h(&self, dial: u64) {}", "fn h(x: u8) {}"])
    base = case("b.py", 'class B:\n    def m(self, a):\n        """Does one thing very well."""\n        ...\n', ['def m(self, a):\n        """Does one thing very well."""\n        ...'])
    sub = case("s.py", "class S(B):\n    def m(self, b):\n        return 1\n", ["def m(self, b):\n        return 1"])
    cases = [trait, impl, base, sub]
    s2 = spark.createDataFrame([x for _, xs in cases for x in xs], "repository string, path string, kind string, name string, start_byte long, end_byte long")
    f2 = spark.createDataFrame([("r", p, t, "h", None) for (p, t), _ in cases], "repository string, path string, text string, hash string, indexed_at timestamp")
    lent = {(r.path, r.doc_from, r.doc) for r in doc_pairs(s2, f2).collect()}
    assert lent == {("t.rs", "own", "Turns the small dial here."), ("t.rs", "own", "Turns the large dial here."), ("i.rs", "declaration", "Turns the large dial here."),
                    ("b.py", "own", "Does one thing very well."), ("s.py", "declaration", "Does one thing very well.")}
    assert doc_pairs(s.limit(0), fl).count() == 0 and doc_pairs(s, fl.limit(0)).count() == 0


# -- problem 6 ----------------------------------------------------------------------------
def test_multi_select_is_exact(spark):
    rng = np.random.default_rng(1)
    data = {1: rng.lognormal(8, 3, 3000).astype("int64"), 2: np.repeat([5, 5, 7], 400), 3: np.array([42]), 4: rng.integers(0, 3, 900)}
    rows = [(g, int(v), "x") for g, vs in data.items() for v in vs] + [(None, 1, "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "g int, v long, n string").repartition(5)
    for finish in (1, 64, 10_000):
        got = {(r.g, r.permille): r.v for r in multi_select(df, finish=finish).collect()}
        assert got == {(g, q): int(np.sort(vs)[max(1, -(-len(vs) * q // 1000)) - 1]) for g, vs in data.items() for q in (500, 900, 990, 999)}
    assert multi_select(df.limit(0)).count() == 0


def test_samples_and_sketches(spark, rows):
    import datetime as dt

    d1, d2 = dt.datetime(2025, 5, 1, 23), dt.datetime(2025, 5, 2, 1)
    t = spark.createDataFrame(
        [(1, "a", d1, 10), (1, "a", d1, 10), (2, "a", d1, None), (3, "a", d1, -1), (4, "a", d1, 2**63 - 1), (5, "a", d2, 30), (6, None, d2, 7), (7, "a", None, 1000), (None, "a", d1, 20), (None, "a", d1, 20)],
        "sample_id long, kind string, recorded_at timestamp, us long")
    s = clean_samples(t, "m", "kind", "us")
    assert s.count() == 6
    got = {(r.label, r.day): (r.n, r.p50, r.p999) for r in percentiles(s).collect()}
    assert got == {("a", "2025-05-01"): (3, 20, 20), ("a", "2025-05-02"): (1, 30, 30), ("a", "all"): (5, 20, 1000), (None, "2025-05-02"): (1, 7, 7), (None, "all"): (1, 7, 7)}
    assert percentiles(s.limit(0)).count() == 0
    rng = np.random.default_rng(2)
    v = rng.lognormal(9, 2, 2000).astype("int64")
    x = spark.createDataFrame([("m", "a", int(i % 3), int(n)) for i, n in enumerate(v)], "metric string, label string, day int, value long")
    m = merge_sketches(day_sketch(x), ["metric", "label"]).first()
    for q, name in ((500, "p50"), (900, "p90"), (990, "p99"), (999, "p999")):
        true = int(np.sort(v)[-(-2000 * q // 1000) - 1])
        assert m[name] <= true < m[name] * (1 + 1 / 128) + 1


# -- problem 7 ----------------------------------------------------------------------------
def test_pack_sizes():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 2048, 500), rng.integers(1, 60, 3000), np.full(10, 1500), np.array([], dtype="int64")):
        where = pack_sizes(sizes, 2048, 1.0, 1 / 4096)
        load = np.bincount(where, weights=sizes) if len(sizes) else np.array([])
        assert (load <= 2048).all()
    assert len(set(pack_sizes(rng.integers(1, 60, 3000), 2048, 1.0, 1 / 4096))) <= -(-3000 * 30 // 2048) + 3


def test_pack(spark):
    items = [(i, n) for i, n in enumerate([100, 2048, 5000, 0, None, 700, 700, 2047, 1])] + [(5, 700), (None, 3)]
    df = spark.createDataFrame(items, "doc_id long, n long").withColumn("container", F.lit("clash"))
    got = pack(df, item="doc_id", tokens="n", shard_items=4).collect()
    load, parts = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.item, []).append((r.part, r.first_token, r.n_tokens))
    assert max(load.values()) <= 2048 and sum(load.values()) == sum(n for _, n in items if n)
    assert sorted(parts[2]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and len(parts[5]) == 2 and 3 not in parts
    assert all(len(v) == 1 for k, v in parts.items() if k not in (2, 5))
    assert pack(df.limit(0), item="doc_id", tokens="n").count() == 0
    r = pack_report(pack(df, item="doc_id", tokens="n")).first()
    assert r.tokens == sum(n for _, n in items if n) and r.fullest <= 2048


# -- problem 8 ----------------------------------------------------------------------------
def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(4)
    size, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    out, held = pivotal(size, p, rng)
    assert abs((size * out).sum() - (size * p).sum()) < 1e-6
    assert set(np.delete(out, held) if held >= 0 else out) <= {0.0, 1.0}
    mean = np.mean([pivotal(size[:7], p[:7], np.random.default_rng(i))[0] for i in range(4000)], axis=0)
    assert np.abs(mean - p[:7]).max() < 0.04


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, s, int(n)) for i, (s, n) in enumerate((s, n) for s, k in (("a", 900), ("b", 60), ("c", 300)) for n in rng.integers(20, 200, k))] + [(9999, None, 5), (None, "a", 5), (9998, "a", None), (9997, "z", 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("copies", F.lit(-1))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    for bucket in (10_000, 50):
        m = mix(df, t, bucket_docs=bucket, fan_in=3)
        assert m.where("copies > 4 or (source = 'a' and copies > 1) or source = 'z'").count() == 0
        rep = {r.source: r for r in mixture_report(df, t, m).collect()}
        total = sum(r.mixed_tokens for r in rep.values())
        for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
            assert abs(rep[s].mixed_tokens - share * total) < 400
        assert rep["none"].mixed_tokens == 0 and rep["none"].actual_share == 0
    small = mixture_report(df, t, mix(df, t, total=5000), total=5000).collect()
    assert abs(sum(r.mixed_tokens for r in small) - 5000) < 600
    with pytest.raises(Exception, match="needs more repeats than allowed"):
        mix(df, t, total=10**9).count()
    assert mix(df.limit(0), t).count() == 0


def test_tokens(spark):
    enc = encoding(TOKENIZER)
    df = spark.createDataFrame([("Hello <|endoftext|> world",), ("",), (None,)], "text string")
    assert [r.n_tokens for r in with_tokens(df).collect()] == [count_tokens("Hello <|endoftext|> world", enc), 0, 0]
    assert enc.decode(enc.encode_ordinary("Grüße, 😀!")) == "Grüße, 😀!"


# -- problem 9 ----------------------------------------------------------------------------
PROSE = " ".join(SENTENCES * 4)
SPAM = {
    "links": "\n".join(f"[lamp {i}](https://shop{i}.example/a)" for i in range(20)),
    "tags": "\n".join(f"SKU {i} green lamp 9.99 new door" for i in range(20)),
    "keywords": "\n".join(f"cheap lamp {c}" for c in ("Oldport", "buy", "best", "sale", "Westmoor", "offer") * 5),
    "stuffed": "the cheap lamp of the cheap lamp is the lamp for the cheap lamp, with a cheap lamp and the cheap lamp in our lamp. " * 3,
    "crumbs": "\n".join("best > lamp > door (12)" for _ in range(15)),
}
FINE = {
    "prose": PROSE, "cited": " ".join(f"{s} See https://x{i}.example/a." for i, s in enumerate(SENTENCES * 3)), "tagged": PROSE + "\n\nTags: lamp, door, key",
    "facts": "\n".join(f"Holds(#lamp_{i}, :green)" for i in range(30)), "log": "\n".join(f"v{i} +Holds(#lamp, {i})" for i in range(30)),
    "table": "\n".join("| lamp | green | 4 | a lamp |" for _ in range(20)), "code": "\n".join("let lamp = scan(lamp);" for _ in range(20)),
    "talk": "\n".join(f"{n}: look" for n in ("Ann", "Bob") * 10), "verse": "\n".join(["The lamp is lit and we go home,", "And all the doors are shut and still,", "Oh carry me over the hill tonight,", SENTENCES[0]] * 4),
}


@pytest.mark.parametrize("name", sorted(SPAM))
def test_spam(name):
    assert stuffed_share(SPAM[name]) > 0.9


@pytest.mark.parametrize("name", sorted(FINE))
def test_no_spam(name):
    assert stuffed_share(FINE[name]) < 0.3


def test_shares():
    assert 0.3 < stuffed_share(PROSE + "\n\n" + SPAM["tags"]) < 0.75
    assert stuffed_share("") == stuffed_share("...\n\n") == 0.0 and concentration([]) == 0.0


def prose(rng, k=None):
    """Sentences of many shapes, so that prose has a spread."""
    word = lambda: rng.choice(("lamp", "door", "key", "tower", "harbour", "rope", "kettle", "cart", "oar", "bell", "mill", "barn"))
    shapes = ("The {} stands near the {}.", "It rains, and the {} is quiet.", "Who keeps the {} of the {}?", "Every {} has one {}; two have none.", "We do not know if the {} was here before the {}.", "They had a {} and no {} at all.")
    return " ".join(rng.choice(shapes).format(word(), word()) for _ in range(k or rng.randrange(3, 30)))


def test_stuffed_pages(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng), rng.choice(["en", None, "fr", "x"])) for i in range(80)]
    docs += [(100 + i, t, "en") for i, t in enumerate(SPAM.values())] + [(200 + i, t, None) for i, t in enumerate(FINE.values())]
    docs += [(300, None, "en"), (301, "", "en"), (302, "123 456", "en"), (100, SPAM["links"], "en"), (303, SPAM["stuffed"] * 300, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("page", F.lit(1)).withColumn("share", F.lit(2.0)).withColumn("e", F.lit(3))
    got = stuffed_pages(df).collect()
    assert sorted(r.doc_id for r in got) == [100, 101, 102, 103, 104, 303] and all(r.flag for r in got)
    assert stuffed_pages(df.limit(0)).count() == 0
    curves = page_curves(df)
    assert {r.doc_id for r in curves.collect()} == {r[0] for r in docs} - {300, 301, 302}
    steep = {r.doc_id: r.slope for r in curves.collect()}
    assert steep[303] < steep[200] < 0
    only_spam = df.where("doc_id between 100 and 104")  # no prose to measure against: everything is read
    assert {r.flag for r in stuffed_pages(only_spam.where("doc_id <> 103")).collect()} == {"unmeasured"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_curves_lose_no_page(spark):
    """The pages that the curves flag hold every page that reading them all would find."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    read = docs.where("text is not null").select("doc_id", "text").toPandas()
    every = {d for d, t in zip(read.doc_id, read.text) if stuffed_share(t) > 0.5}
    assert {r.doc_id for r in stuffed_pages(docs).collect()} == every and len(every) > 20


def test_spam_among_spam_is_found(spark):
    """Where pages of links are the common case of a language and length, none is unlike the rest."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abdeglmnorstuv", k=6))
    links = lambda: "\n".join(f"[{word()} and the {word()}](https://{word()}.example/{word()})" for _ in range(12))
    df = spark.createDataFrame([(i, links() if i < 60 else prose(rng), "en") for i in range(100)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == list(range(60))


def test_spam_moves_no_yardstick(spark):
    """Prose is as far from the prose of its kind whether or not most other pages are spam."""
    rng = random.Random(9)
    rows = [(i, prose(rng), "en") for i in range(40)]
    spam = [(100 + i, "\n".join(f"the cheap lamp, {rng.choice('abcdef')} door, lamp, lamp" for _ in range(11)), "en") for i in range(80)]
    spam += [(200 + i, SPAM["links"], "x") for i in range(40)]

    def curves(data):
        df = spark.createDataFrame(data, "doc_id long, text string, lang string")
        return {r.doc_id: r for r in flag_pages(page_curves(df)).collect()}

    alone, among = curves(rows), curves(rows + spam)
    assert [among[i] for i, _, _ in rows] == [alone[i] for i, _, _ in rows]
    assert len(among) == 160 and all(among[i].flag for i, _, _ in spam)


def test_spam_without_a_language_is_found(spark):
    """Pages of links alone have no function words; they are held against the prose of all languages."""
    rng = random.Random(3)
    page = lambda i: "\n".join(f"https://lamp{i}x{k}.example/door{k}" for k in range(20))
    df = spark.createDataFrame([(i, page(i), None) for i in range(40)] + [(100 + i, prose(rng), "en") for i in range(20)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == list(range(40))
