"""Markdown by rule, damaged books, long tracks and pages, null texts, plans, the ingest job, and tables kept by streams."""

import gzip
import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import captions as C
from lectern.operators import documents as D
from lectern.operators import ingest
from lectern.operators import reading as R
from lectern.plans import inputs as I
from lectern.sources import files as S
from lectern.sources import markup as M
from lectern.sources import sinks as K
from lectern.streaming import live as V

RULES = [
    ("a\n```py\nx = 1\n```\nb", "a\n\nb"), ("a\n~~~\ncode\n~~~\nb", "a\n\nb"), ("```\nopen", "```\nopen"), ("---\ntitle: x\n---\nText", "Text"),
    ("![a b](i.png) c", "a b c"), ("[see](http://x) [that][1]", "see that"), ("[![alt](i)](u)", "alt"), ("[no link] (x)", "[no link] (x)"), ("<http://a.b/c> <b>x</b>", " x"),
    ("text\n\n[1]: http://x \"t\"\nmore", "text\n\nmore"), ("# One\n## Two! ##\n####### no", "One.\nTwo!\n####### no"), ("Title\n=====\nx\n---", "Title.\nx."),
    ("a\n\n* * *\n\nb", "a\n\nb"), ("> said\n>> twice", "said\n> twice"), ("- a\n  * b\n3) c\n10. d", "a\n b\n3. c\n10. d"),
    ("| a | b |\n|---|:--:|\n| 1 |  |", "a, b\n\n1"), ("**bold** __too__ ***both***", "bold too both"), ("*it* _em_ 2 * 3 * 4 snake_case_name", "it em 2 * 3 * 4 snake_case_name"),
    ("~~gone~~ `code` ``more``", "gone code more"), (r"\# \[x\] 5 \* 6", "# [x] 5 * 6"), ("a  b\t\tc\n\n\n\nd", "a b c\n\nd"), ("", ""), ("* item *with* em", "item with em"),
]


@pytest.mark.parametrize("given, said", RULES)
def test_markdown_rules(given, said):
    assert M.markdown_text(given) == said


def test_markdown_signs(spark):
    texts = ["# H", "[a](b) and\n- x", "- a\n> b", "```\nx\n```\n- y", "**b** | x", "plain - text * with # signs", "|a|\n- b\n**cc**", None, "", "  # no heading", "####### x", "#x", "###   x",
             "- a\n[](b)", "- a\n[b]()", "- a\n[b][c](](d)", "- a\n[b](c\nd)", "- a\n[b](c", "|a|\n- b\n** c**", "|a|\n- b\n**c ***", "|a|\n- b\n******", "|a|\n- b\n**a ** b**", "|a|\n- b\n>\n", "|a|\n- b\n>", "    |a|\n- b\n**cc**"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.m for r in df.select("i", T.looks_like_markdown(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [True, True, False, True, False, False, True, False, False, False, False, False, True, False, False, True, True, False, False, True, True, True, True, False, False]


def test_long_inputs_take_time_in_proportion():
    began = time.time()
    text = C.repair_track([(i * 1.0, i + 1.0, f"some words number {i}") for i in range(40_000)])[0]
    assert text.count("number") == 40_000
    assert M.html_text("<p>one paragraph</p>" * 60_000).count("one") == 60_000
    for bad in ("**a * b _c `d [e ![f <g ~~h\n", "<", "[", "*x ", "`", "```\nx\n"):
        M.markdown_text(bad * 20_000)
    assert time.time() - began < 60


@pytest.mark.parametrize("bad", [
    lambda n: D.sentence_spans("." * n + "a"), lambda n: D.sentence_spans("?" + "\"" * n + "a"), lambda n: D.sentence_spans("Chapter one " + ". " * (n // 2) + "." * (n // 2) + "7"),
    lambda n: M.html_text("<div>" * (n // 10) + "</i>" * (n // 10) + "text"), lambda n: M.html_text("<ul>" + "<li>x</b>" * (n // 9)), lambda n: S._nav_titles("<nav" * (n // 4)), lambda n: M.html_text("<nav" * (n // 4)),
    lambda n: S._nav_titles("<nav><a href='x'>" * (n // 17)),
])
def test_a_megabyte_of_a_bad_case_takes_a_second(bad):
    began = time.time()
    bad(1_000_000)
    assert time.time() - began < 5  # on a busy machine


def test_blanks_are_trimmed_in_proportion(spark):
    df = spark.createDataFrame([("a" + " " * 400_000 + "b",), ("\u00a0\ufeff x \u2003",), (None,)], "t string")
    began = time.time()
    got = [r.n for r in df.select(F.length(T.js_trim(F.col("t"))).alias("n")).collect()]
    assert got == [400_002, 1, None] and time.time() - began < 20


def test_navigation_titles():
    page = "<p><a href='no'>not here</a></p><nav epub:type='toc'><ol><li><a class=x href='a.xhtml#top'>The <b>first</b>\n part</a></li><li><a>none</a><a href='#x'>within</a><a href=b.xhtml>Caf&eacute;</a></ol></nav><a href='c'>after</a>"
    assert S._nav_titles(page) == {"a.xhtml": "The first part", "b.xhtml": "Café"}


def test_implied_ends():
    assert M.html_text("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>").split() == ["one", "two", "a", "b"]
    assert M.html_text("a <b>c</b> <nav x &amp; y") == "a c <nav x & y" and M.html_text("a<!-- b > c -->d") == "ad"
    assert M.html_text("<h2>Head<p>said</i></h2>x") == M.html_text("<h2>Head<p>said</h2>x")


def book(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), text)
    return out.getvalue()


PACKAGE = """<package xmlns:dc="d"><metadata><dc:title> A Book </dc:title><dc:creator>Ann</dc:creator></metadata><manifest><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>
<item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="c" href="gone.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></package>"""
CONTAINER = '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>'


def test_damaged_books_give_reasons_and_go_on(spark):
    whole = book(**{"META-INF__container_xml": CONTAINER, "p_opf": PACKAGE, "t_ncx": "<ncx>&nosuch;</ncx>", "a_xhtml": "<h1>First</h1><p>One</p>", "b_xhtml": "<p>Two</p>"})
    at = whole.index(b"<p>Two</p>")
    bad_sum = whole[:at] + b"<p>TwO</p>" + whole[at + 10 :]
    files = [("good", whole), ("sum", bad_sum), ("junk", b"PK\x03\x04 nothing"), ("none", None), ("empty", book(x_txt="x"))]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files], "path string, content binary")
    got = {}
    for r in S.epub_parts(df).collect():
        got.setdefault(r.path, []).append(r)
    assert [(r.title, r.text.strip(), r.book_title, r.author) for r in got["good"]] == [("First", "First.\n\nOne", "A Book", "Ann"), ("Section 2", "Two", "A Book", "Ann")]
    assert len(got["good"][0].warnings) == 2 and "t.ncx" in got["good"][0].warnings[0] and "gone.xhtml" in got["good"][0].warnings[1]
    assert [r.title for r in got["sum"]] == ["First"] and any("b.xhtml" in w for w in got["sum"][0].warnings)
    assert all(got[k][0].text is None and got[k][0].error for k in ("junk", "none", "empty"))


def test_packed_handoffs_are_bounded(spark, monkeypatch):
    import base64

    pack = lambda t: base64.urlsafe_b64encode(gzip.compress(t)).decode().rstrip("=")
    df = spark.createDataFrame([(0, pack(b"{}")), (1, "!!"), (2, None), (3, pack(b"x" * 1000)[:-9])], "i int, p string")
    assert [r.t for r in df.select("i", S.gunzip_handoff("p").alias("t")).orderBy("i").collect()] == ["{}", None, None, None]
    monkeypatch.setattr(S, "LARGEST_HANDOFF", 10)
    assert S.gunzip_handoff.func(__import__("pandas").Series([pack(b"123456789"), pack(b"x" * 11)])).tolist() == ["123456789", None]


def test_cues_without_text_say_nothing(spark):
    rows = [(1, 0, 0.0, 1.0, "hello there"), (1, 1, 1.0, 2.0, None), (1, 2, 2.0, 3.0, "and on"), (2, 0, 0.0, 1.0, None)]
    cues = spark.createDataFrame(rows, "track_id long, cue_no int, start double, end double, text string")
    assert [r.text for r in C.dedupe_rolling_cues(cues).where("track_id = 1").orderBy("cue_no").collect()] == ["hello there", "", "and on"]
    assert {r.track_id: r.text.split() for r in C.repair_captions(cues).collect()} == {1: ["hello", "there", "and", "on"], 2: []}
    assert C.captions_to_parts(cues).count() == 1
    short = cues.withColumnsRenamed({"track_id": "doc_id", "cue_no": "cue_index"})
    assert [r.text for r in K.split_for_subtitles(short).where("doc_id = 1").orderBy("cue_index").collect()] == ["hello there", "", "and on"]
    p = spark.createDataFrame([(1, 0, None, 0), (1, 1, "a b", 5)], "doc_id long, passage_index int, text string, start int")
    assert [(r.text, r.start) for r in R.tokenize_words(p).collect()] == [("a", 5), ("b", 7)]


def test_rolling_cues_against_a_plain_search(spark):
    """Every leading run of 2 to 24 words that ends the cue kept before goes; the longest first."""
    rng, rows = random.Random(3), []
    words = [rng.choice(["the", "quick", "Fox", "fox,", "ran", "home"]) for _ in range(400)]
    at = 0
    for i in range(60):
        n = rng.randint(1, 9)
        rows.append((1, i, i * 1.0, i + 0.9, " ".join(words[max(0, at - rng.randint(0, 4)) : at + n])))
        at += n
    plain = lambda w: "".join(c for c in w.lower() if c.isalnum() or c == "'")
    kept: list[list[str]] = []
    for *_, text in rows:
        said, n = text.split(), 0
        for k in range(2, min(24, len(said), len(kept[-1]) if kept else 0) + 1):
            if [plain(w) for w in kept[-1][-k:]] == [plain(w) for w in said[:k]]:
                n = k
        if not n or n < len(said):
            kept.append(said[n:])
    df = spark.createDataFrame(rows, "track_id long, cue_no int, start double, end double, text string")
    got = C.dedupe_rolling_cues(df).orderBy("cue_no").collect()
    assert [r.text.split() for r in got] == kept and got[0].dropped_words == sum(len(r[4].split()) for r in rows) - sum(map(len, kept))


def test_pieces_for_speech_and_subtitles_lose_no_word(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice(["word", "longer-word", "end.", "why?", "then;", "x," * 9]) for _ in range(600))
    df = spark.createDataFrame([(1, 0, text, 0.0, 60.0)], "doc_id long, passage_index int, text string, start double, end double")
    pieces = K.split_for_subtitles(df.withColumnRenamed("passage_index", "cue_index")).orderBy("cue_index").collect()
    assert "".join("".join(p.text for p in pieces).split()) == "".join(text.split()) and all(len(p.text) <= 84 for p in pieces)
    assert abs(pieces[0].start) < 1e-9 and abs(pieces[-1].end - 60) < 1.0 and all(abs(a.end - b.start) < 0.5 for a, b in zip(pieces, pieces[1:]))
    spoken = [r.segment for r in D.synthesis_segments(df).orderBy("segment_no").collect()]
    letters = lambda t: "".join(c for c in t if c.isalnum())
    assert letters("".join(spoken)) == letters(text) and all(len(s) <= 300 for s in spoken)


def python_evaluations(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython") + plan.count("MapInArrow ") + plan.count("PythonMapInArrow")


def test_plans_clean_every_text_once(spark):
    docs = spark.createDataFrame([(1, "One “two”.\nthree")], "doc_id long, text string")
    parts = docs.select("doc_id", F.lit(0).alias("part_no"), F.lit("t").alias("title"), "text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert python_evaluations(D.assemble(parts)) == 1
        made = D.narration_time(docs)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert python_evaluations(made) == 2 and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert made.first().passages == 1


def test_a_section_opens_slowly_where_that_is_asked_for(spark):
    p = spark.createDataFrame([(1, 0, "plain words here", 0)], "doc_id long, passage_index int, text string, start int")
    tokens = R.tokenize_words(p)
    plain = {r.token_no: r.weight for r in R.dwell_schedule(tokens, 300).collect()}
    first = {r.token_no: r.weight for r in R.dwell_schedule(tokens, 300, F.col("token_no") == 0).collect()}
    assert first[0] == 3 * plain[0] and first[1] == plain[1]


def test_files_of_all_kinds_become_timed_passages(spark):
    epub = book(**{"META-INF__container_xml": CONTAINER, "p_opf": PACKAGE, "a_xhtml": "<h1>First</h1><p>One two.</p>", "b_xhtml": "<p>Three.</p>"})
    files = [
        (1, "/x/a.txt", b"Plain text here. It ends."), (2, "/x/b.md", b"# Head\n\nSome **bold** words."), (3, "/x/c.html", b"<h1>Page</h1><p>Said so.</p>"), (4, "/x/d.epub", epub),
        (5, "/x/e.vtt", b"WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nSpoken words.\n"), (6, "/x/f.pdf", b"%PDF-1.7"), (7, "/x/g.zip", b"PK\x03\x04"), (8, "/x/h.txt", b" \n "),
        (9, "/x/i.srt", b"no cues at all"),
    ]
    df = spark.createDataFrame([(i, p, len(c), bytearray(c)) for i, p, c in files], "doc_id long, path string, length long, content binary")
    made = ingest.ingest_files(df)
    docs = {r.doc_id: r for r in made.documents.collect()}
    assert {i: r.kind for i, r in docs.items()} == {1: "txt", 2: "md", 3: "html", 4: "epub", 5: "captions"}
    assert docs[2].text == "Head.\n\nSome bold words." and docs[4].title == "A Book" and docs[4].author == "Ann" and len(docs[4].warnings) == 1 and docs[1].warnings == []
    passages = made.passages.collect()
    assert {(p.doc_id, p.section_title) for p in passages} == {(1, "a.txt"), (2, "b.md"), (3, "c.html"), (4, "First"), (5, "0:01")}
    assert all(docs[p.doc_id].text[p.start : p.end] == p.text and p.cue_end > p.cue_start for p in passages)
    assert {r.doc_id: r.reason for r in made.rejected.collect()} == {6: ingest.NO_PDF, 7: "a ZIP archive that is no EPUB", 8: ingest.NO_TEXT, 9: "No caption lines were found in that file."}


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, at long, v string"
    merge = V.upsert(spark, path, ["k"], "at", buckets=4)
    table = lambda: {r.k: (r.at, r.v) for r in V.upserted(spark, path, schema).collect()}
    assert table() == {}
    merge(spark.createDataFrame([(k, 1, "a") for k in range(40)] + [(3, 2, "b")], schema), 0)
    for epoch in (1, 1, 2, 3):  # a batch that runs again changes nothing
        merge(spark.createDataFrame([(3, epoch, "old"), (5, 10 + epoch, f"n{epoch}")], schema), epoch)
    got = table()
    assert len(got) == 40 and got[5] == (13, "n3") and got[3] == (3, "old") and got[0] == (1, "a")
    assert len(list((tmp_path / "t").glob("v=0/_bucket=*"))) >= 2 and len(list((tmp_path / "t").glob("v=3/_bucket=*"))) <= 2


def test_live_cues_equal_their_batch_twin(spark):
    rows = [(t, i, i * 2.0, i * 2.0 + 1.8, x) for t in (1, 2) for i, x in enumerate(["rivers carry sand", "carry sand down", "sand down", "to the sea", "to the sea"])]
    cues = spark.createDataFrame(rows, "track_id long, cue_no int, start double, end double, text string")
    timed = cues.withColumn("ts", F.timestamp_seconds(F.col("start") + 1_700_000_000))
    live = I.streamed(timed, "cues", "cue_no < 2", V.stream_dedupe_cues).collect()
    kept = {}
    for r in sorted(live, key=lambda r: (r.track_id, r.start)):
        kept[r.track_id, r.cue_no] = (r.end, kept[r.track_id, r.cue_no][1]) if r.kind == "extend" else (r.end, r.text)
    batch = C.dedupe_rolling_cues(cues).collect()
    assert sorted((t, e, x) for (t, _), (e, x) in kept.items()) == sorted((r.track_id, r.end, r.text) for r in batch)
