from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import documents as D
from lectern.operators import reading as R
from lectern.sources import files as S
from lectern.sources import markup as M
from lectern.sources import sinks as K


def col(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    got = col(spark, ["“ofﬁce” — a b", "hyphen-\nated word\nnext line.\nNew", "a\r\nb\tc  d", "x \n\n\n\n y", None], T.normalize_text)
    assert got == ['"office" - a b', "hyphenated word next line.\nNew", "a b c d", "x\n\ny", None]


def test_page_numbers(spark):
    assert col(spark, ["a\n 12 \nb\n- 3 -\n[4]\n12345\n(7)"], T.strip_orphan_page_numbers) == ["a\n\nb\n\n\n12345\n"]


def test_words_languages_and_clocks(spark):
    assert col(spark, ["don't stop-me 3 times", "", "été --"], T.count_words) == [4, 0, 1]
    assert col(spark, ["en", "en-US", "en_AU", "EN-us", "de-DE", "enm", "eo", None], T.english_only) == [True] * 4 + [False] * 4
    assert col(spark, ["0", "59.9", "3725", "-2"], lambda c: T.format_clock(c.cast("double"))) == ["0:00", "0:59", "1:02:05", "0:00"]
    assert col(spark, ["1.9996", "3661.5"], lambda c: T.timecode(c.cast("double"), ",")) == ["00:00:02,000", "01:01:01,500"]
    assert col(spark, ["512", "2048", "5242880"], lambda c: T.format_bytes(c.cast("long"))) == ["512 B", "2 KB", "5.0 MB"]
    assert col(spark, ["my: file?.txt", ".txt", "a  b"], lambda c: T.safe_filename(c, "mp3")) == ["my- file-.mp3", "narration.mp3", "a b.mp3"]


def test_video_urls(spark):
    i = "dQw4w9WgXcQ"
    given = [f"https://www.youtube.com/watch?v={i}&t=90", f"https://youtu.be/{i}?t=1h2m3s", f"youtube.com/shorts/{i}", f"https://m.youtube.com/live/{i}", i, f"https://youtube.com.evil.example/watch?v={i}", "not a url", f"https://vimeo.com/{i}"]
    got = col(spark, given, T.parse_video_url)
    assert [g and (g.video_id, g.start) for g in got] == [(i, 90.0), (i, 3723.0), (i, None), (i, None), (i, None), None, None, None]


def test_furniture(spark):
    pages = [(1, p, f"My Book {p}\n\nbody {w}\nmore {w} text\nlast {w} line\n{p}") for p, w in enumerate("abcde")]
    got = [r.text for r in D.strip_running_furniture(spark.createDataFrame(pages + [(2, 0, "My Book 1\nx")], "doc_id long, page_no int, text string")).where("doc_id = 1").orderBy("page_no").collect()]
    assert got[0] == "\nbody a\nmore a text\nlast a line\n0"  # a bare number is too short a key


def test_assemble_seams(spark):
    parts = [(1, 0, "A", "One ends."), (1, 1, "B", "   "), (1, 2, "C", "Two flows"), (1, 3, "D", "on here hyph-"), (1, 4, "E", "enated end.")]
    made = D.assemble(spark.createDataFrame(parts, "doc_id long, part_no int, title string, text string"))
    s = made.orderBy("section_index").collect()
    text = D.text_of(made).first().text
    assert text == "One ends.\n\nTwo flows on here hyphenated end."
    assert [(r.section_id, r.section_index) for r in s] == [("sec-0", 1), ("sec-2", 2), ("sec-3", 3), ("sec-4", 4)]
    assert text[s[1].start : s[1].end] == "Two flows" and s[2].end == s[3].start + 1


def test_sentences():
    cut = lambda t: [t[a:b] for a, b in D.sentence_spans(t)]
    assert cut("Dr. Smith came. He sat!  Why?") == ["Dr. Smith came. ", "He sat!  ", "Why?"]
    assert cut("J. Doe met 3.5 people.\n\nThen left") == ["J. Doe met 3.5 people.\n\n", "Then left"]
    assert cut("") == [] and cut(" \n ") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc .!?;,\né", max_size=900))
def test_passages_are_slices_and_lose_nothing(text):
    made = D.pack_passages(text, D.PassagePreset(60, 20, True))
    assert "".join("".join(text[a:b].split()) for a, b, _ in made) == "".join(text.split())
    assert all(b - a <= 60 for a, b, _ in made)
    assert all(p[1] <= q[0] for p, q in zip(made, made[1:]))
    assert all(0 <= x < y <= b - a for a, b, spans in made for x, y in spans)


def test_as_of(spark):
    left = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (2, 3)], "doc_id long, at int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 8, "y")], "doc_id long, start int, name string")
    got = D.as_of(left, right, ["doc_id"], "at", "start", ["name"]).orderBy("doc_id", "at").collect()
    assert [r.name for r in got] == [None, "x", "y", None]


def test_segments():
    assert D.pack_segments("One. Two!") == ["One.", "Two!"]
    long = "alpha, " * 60
    assert all(len(s) <= 300 for s in D.pack_segments(long)) and D.pack_segments("x" * 400) == ["x" * 400]


def test_html_and_markdown():
    assert M.html_text("<body><h1>Title</h1><p>One <b>two</b></p><script>x</script><div role='navigation'>skip</div><p hidden>no</p><br>end</body>").split("\n") == ["", "Title.", "", "One two", "", "end"]
    assert M.markdown_text("# Head\n\n- **bold** and _it_ `code`\n> quote [a](b) ![c](d)\n\n| a | b |\n|---|---|\n2 * 3 snake_case") == "Head.\n\nbold and it code\nquote a c\n\na, b\n\n2 * 3 snake_case"


def test_plain_parts():
    assert [p["title"] for p in M.plain_parts("intro\n# A\nx\n## B\ny", "n")] == ["Front matter", "A", "B"]
    parts = M.plain_parts("a" * 7000 + "\n\n" + "b" * 9000, "n")
    assert [p["title"] for p in parts] == ["Part 1", "Part 2"] and "".join(p["text"] for p in parts) == "a" * 7000 + "\n\n" + "b" * 9000


def test_tokens():
    flags = {t[0]: dict(zip(R.FLAGS, t[2:])) for t in R.word_tokens('He said, "Go." Dr. Who paid $3.50 in 1999.\n\nNext')}
    word = lambda w, text='He said, "Go." Dr. Who paid $3.50 in 1999.\n\nNext': flags[text.index(w)]
    assert word("said,")["ends_clause"] and word('"Go."')["ends_sentence"] and not word("Dr.")["ends_sentence"]
    assert word("$3.50")["numeric"] and word("1999.")["ends_paragraph"] and not word("1999.")["ends_sentence"] and word("Next")["ends_paragraph"]
    assert R.balanced_pieces("x" * 16) == [(0, 16)] and len(R.balanced_pieces("x" * 30)) == 3
    assert R.balanced_pieces("counter-revolutionary")[0] == (0, 8)


def test_pivots(spark):
    assert col(spark, ["a", "word", "reading", "understand", "extraordinarily", '"hello', "--", ""], T.pivot_for) == [0, 1, 2, 3, 4, 2, 0, 0]


def test_pace_is_kept(spark):
    p = spark.createDataFrame([(1, 0, "Some words here, and a sentence that ends. Then 12 more follow to the end of it all.", 0)], "doc_id long, passage_index int, text string, start int")
    for wpm in (150, 600, 1200):
        report = R.pacing_report(R.dwell_schedule(R.tokenize_words(p), wpm), wpm).first()
        assert report.within and abs(report.effective_wpm - wpm) < 1e-6


def test_subtitles(spark):
    pieces = K.subtitle_pieces("One short. " + "word " * 40)
    assert all(len(p) <= 84 for p in pieces) and " ".join(pieces).split() == ("One short. " + "word " * 40).split()
    assert col(spark, ["short", "a line of text that is clearly longer than forty-two characters"], T.wrap_for_subtitle) == ["short", "a line of text that is clearly\nlonger than forty-two characters"]
    cues = spark.createDataFrame([(1, 0, 0.0, 1.5, "Hi"), (1, 1, 1.5, 3.0, "There")], "doc_id long, cue_index int, start double, end double, text string")
    assert K.subtitle_documents(cues, "vtt").first().content == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.500\nHi\n\n2\n00:00:01.500 --> 00:00:03.000\nThere\n"


def test_files(spark, tmp_path):
    rows = [("/x/a.pdf", b"%PDF-1"), ("/x/b.zip", b"PK\x03\x04"), ("/x/c.epub", b"PK\x03\x04"), ("/x/d.txt", b"WEBVTT\n"), ("/x/e.md", b"# x"), ("/x/f", b"\xff\xfea\x00")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")
    got = {r.path[-5:]: (r.kind, r.t) for r in S.classify_files(df).withColumn("t", S.decode_text(F.col("content"))).collect()}
    assert [got[k][0] for k in ("a.pdf", "b.zip", ".epub", "d.txt", "/e.md", "/x/f")] == ["pdf", None, "epub", "captions", "md", "txt"] and got["/x/f"][1] == "a"


def test_handoffs(spark):
    good = '{"v":1,"videoId":"abcdefghijk","title":" ","cues":[{"start":"x","end":2,"text":"hi"},{"text":5},{"text":" "}]}'
    rows = [(0, good), (1, good.replace('"v":1', '"v":2')), (2, good.replace("abcdefghijk", "short")), (3, '{"v":1,"videoId":"abcdefghijk","cues":[]}'), (4, "junk"), (5, '{"v":1,"videoId":"abcdefghijk","cues":[{"text":1}]}')]
    ok, bad = S.validate_handoffs(spark.createDataFrame(rows, "payload_id int, payload string"))
    r = ok.first()
    assert (r.payload_id, r.title, [(c.start, c.end, c.text) for c in r.cues]) == (0, "Untitled video", [(0.0, 2.0, "hi")])
    assert {x.payload_id: x.reason for x in bad.collect()} == {1: "unknown version", 2: "bad video id", 3: "no cues", 4: "not an object", 5: "no usable cues"}
