"""Rules whose cases the corpus does not hold: positive examples and refusals on small rows."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, book, epub, flow, layout, notes, repair, structure, tables
from lectern.plans import fixtures
from lectern.sources import corpus


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expression).first()[0]


@pytest.mark.parametrize(("raw", "want"), [
    ("a ﬁne ﬂaw", "a fine flaw"), ("-", "97-•"), ("what?..", "what?..."), ("what?... so", "what?... so"), ("word , next", "word, next"),
    ("a . . . b", "a . . . b"), ("end .", "end."), ("one,two;three", "one, two; three"), ("1,5 at 10:30", "1,5 at 10:30"), ("no!! why??", "no! why?"), ("“ Open ”", "“Open”"), ("bell\x07", "bell"), ("kept...", "kept..."),
])
def test_hygiene(spark, raw, want):
    assert one(spark, T.hygiene(F.col("x")), x=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1", "1"), ("[1]", "1"), ("(1)", "1"), ("1.", "1"), ("¹", "1"), ("*", "*"), ("††", "††"), ("word", None), ("1234", None), ("", None)])
def test_markers(spark, raw, want):
    assert one(spark, T.marker(F.col("x")), x=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("İçe IĞDIR", "içe ığdır"), ("Straße", "straße")])
def test_fold(spark, raw, want):
    assert one(spark, T.fold(F.col("x")), x=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("III", 3), ("xiv", 14), ("12", 12), ("word", None), ("MCMXC", 1990)])
def test_numerals(spark, raw, want):
    assert one(spark, T.roman(F.col("x")), x=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Über die Brücke!", "uber-die-brucke"), ("  ", ""), ("ÇAĞ — İki", "cag-iki")])
def test_slugs(spark, raw, want):
    assert one(spark, T.slug(F.col("x")), x=raw) == want


def test_lines_join_at_hyphens(spark):
    df = spark.createDataFrame([(["mor-", "ning came", "soft­", "ly and Mid-", "West  wind"],)], "x array<string>")
    assert df.select(T.join_broken_lines(F.col("x"))).first()[0] == "morning came softly and Mid- West wind"


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, i long, line string")


def vocab(spark, **freq):
    return spark.createDataFrame([(1, w, n) for w, n in freq.items()], "doc_id long, word string, freq long")


def test_repairs_in_turn_are_logged_with_their_grade(spark):
    texts, log = repair.repaired(fixtures.frame(spark, "worn_texts"))
    got = {(r.doc_id, r.i, r.kind, r.grade, r.original, r.corrected) for r in log.collect()}
    assert (1, 1, "ocr_character", "confident", "Sumrnary", "Summary") in got
    assert (1, 1, "repeated_punctuation", "safe", "A Sumrnary, of it, and more!!", "A Sumrnary, of it, and more!") in got
    assert (1, 3, "ocr_character", "confident", "Ozel", "Özel") in got
    assert {g for *_, kind, g, original, _ in got if original in ("Guzel", "GUZEL")} == {"uncertain"}
    assert {(o, c) for _, _, kind, _, o, c in got if kind == "word_split"} == {("gib i", "gibi"), ("Gib i", "Gibi")}
    assert not any(d == 2 for d, *_ in got)  # twice is no evidence
    assert texts.where("doc_id = 4").count() == 0 and texts.where("doc_id = 1").count() == 8


def test_repairs_of_nothing(spark):
    texts, log = repair.repaired(spark.createDataFrame([], "doc_id long, text string"))
    assert texts.count() == 0 and log.count() == 0


def test_titles_take_the_most_frequent_reading(spark):
    vocab = spark.createDataFrame([(1, "gey", 9), (1, "şey", 3), (1, "bey", 9), (1, "iz", 1)], "doc_id long, word string, freq long")
    titles = spark.createDataFrame([(1, 1, "6EY"), (1, 2, "1Z"), (1, 3, "66666EY"), (1, 4, None)], "doc_id long, seq long, text string")
    got = {r.seq: (r.corrected, r.words) for r in repair.reread_titles(titles, vocab).collect()}
    assert got == {1: ("GEY", 1), 2: ("1Z", 0), 3: ("66666EY", 0), 4: (None, 0)}


def test_glyph_repair_needs_evidence(spark):
    v = vocab(spark, yaşarnım=1, yaşamım=12, modern=9, modem=40, corner=1, comer=3, burnt=1, bumt=20)
    got = {r.word: r.candidate for r in repair.glyph_repairs(v).collect()}
    assert got == {"yaşarnım": "yaşamım"}  # modern is established, comer is rare, burnt is short


def test_diacritics(spark):
    v = vocab(spark, için=540, icin=1, sakın=10, sakin=1, kişi=390, kışı=10, değil=285, degil=2)
    got = {r.word: r.decision for r in repair.diacritic_candidates(v).collect()}
    assert got["icin"] == "accepted" and got["sakin"] == "would lose a mark" and got["degil"] == "used more than once"
    assert "kışı" not in got


def test_split_words(spark):
    rows = lines(spark, "gib i de ğil o dama", "a b a b")
    v = vocab(spark, gibi=50, değil=90, odama=20, o=500, dama=3, gib=0, de=400, i=1, ğil=0, ab=30, a=2, b=2, ba=30)
    got = repair.split_candidates(rows, v)
    first = {(r.left, r.right): r.decision for r in got.where("i = 0").collect()}
    assert first[("gib", "i")] == "accepted" and first[("o", "dama")] == "a common one-letter word"
    assert ("de", "ğil") in first or ("i", "de") not in first
    applied = {(r.pos, r.joined) for r in repair.split_applied(got).where("i = 1").collect()}
    assert applied == {(0, "ab"), (2, "ab")}  # a word is used once


def test_hyphen_decisions(spark):
    rows = lines(spark, "a well-known and morn-", "ing came with well-", "known ways and new-", "comers")
    got = {r.joined for r in repair.hyphen_decisions(rows, repair.hyphen_evidence(rows)).collect()}
    assert got == {"morning", "well-known", "newcomers"}


def test_audit_counts_each_defect(spark):
    rows = [("p", "A line that ends without a stop"), ("p", "lower opening is broken"), ("h2", "12"), ("p", "after a heading it is not"), ("p", "ends with a colon:"), ("p", "so this is not"), ("p", "b0ok and wOrd and runTogether"), ("p", "mor- ning"), ("p", "***"), ("p", "7"), ("p", "a lone k letter"), ("p", "bad � char")]
    rows += [("p", "Running head")] * 5
    df = spark.createDataFrame([(1, i, tag, text) for i, (tag, text) in enumerate(rows)], "book long, seq long, tag string, text string")
    r = audit.audit(df).first()
    assert (r.broken, r.hyphen, r.junk, r.ocr, r.split, r.chars, r.headings) == (6, 1, 1, 1, 1, 1, 1)
    assert r.furniture == 1 + 4 and r.glued == 1
    assert [x.rank for x in audit.ranked(audit.audit(df)).collect()] == [1]


def test_verse(spark):
    verse = ["The wind that rose", "across the silver hill", "and took the smaller leaves", "is with us still"]
    prose = ["The wind that rose across the hill and took every leaf of it along,", "went on until the evening when the whole of the valley had gone to", "sleep and nobody but the miller heard how it turned at the old door."]
    rows, y = [], 72.0
    for i, t in enumerate(prose + verse):
        rows.append((1, 1, i, t, 72.0, 72.0 + (430.0 if i < 3 else 6.0 * len(t)), y, y + 10, 10.0))
        y += 40.0 if i == 2 else 14.0
    df = spark.createDataFrame(rows, "doc_id long, page long, i long, text string, x0 double, x1 double, y0 double, y1 double, font_size double")
    assert [(r.first_line, r.last_line) for r in flow.verse_runs(df).collect()] == [(3, 6)]


def test_visual_lines_anchor_on_the_first_fragment(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.0, 100.0, 9.0, 110.0), (1, 1, 1, 20.0, 104.0, 29.0, 114.0), (1, 1, 2, 40.0, 108.0, 49.0, 118.0)], "doc_id long, page long, i long, x0 double, y0 double, x1 double, y1 double")
    assert {r.i: r.line for r in flow.visual_lines(df).collect()} == {0: 0, 1: 0, 2: 1}


def test_stacked_notes(spark):
    df = spark.createDataFrame([(1, "b", "1. First note\ncarried on\n2. Second\n9 not the next\n3. Third")], "doc_id long, block_id string, text string")
    assert [r.text for r in flow.stacked_notes(df).orderBy("part").collect()] == ["1. First note\ncarried on", "2. Second\n9 not the next", "3. Third"]


def test_titles_wrap_and_take_their_number(spark):
    rows = [(1, 1, "HEADING", "IV", 20.0), (1, 2, "HEADING", "The Long", 24.0), (1, 3, "HEADING", "Road Home", 24.2), (1, 4, "PARAGRAPH", "x", 10.0), (1, 5, "HEADING", "Small", 14.0), (1, 6, "HEADING", "Large", 24.0)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, role string, text string, heading_scale double")
    assert [(r.seq, r.text) for r in flow.merge_title_lines(df).orderBy("seq").collect()] == [(1, "IV The Long Road Home"), (5, "Small"), (6, "Large")]


def test_paragraphs(spark):
    nodes = fixtures.frame(spark, "paragraph_nodes")
    runs = flow.paragraph_runs(nodes)
    texts = {r.first_seq: r.text for r in runs.collect()}
    assert texts[1] == "The river rose in the night and morning came." and texts[10] == "a quote goes on"
    assert texts[6] == "A new start,” he said." and texts[9] == "lower but cut"
    order = [(r.seq, r.role) for r in flow.held_order(nodes, runs).orderBy("position").collect()]
    assert order[:3] == [(1, "PARAGRAPH"), (2, "FOOTNOTE"), (4, "PAGE_NUMBER")]


def test_heading_signals_and_vetoes(spark):
    rows = [("Chapter One", 1.8), ("THE RIVER", 1.2), ("www.example.org", 1.9), ("“A quote”", 1.9), ("ISBN 978", 1.9), ("tail of it)", 1.9), ("qq", 1.9), ("This is a sentence. And here is another one of them.", 1.4), ("plain words", 1.0)]
    df = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(rows)], "i long, text string, size_ratio double")
    wide = df.select("*", F.lit(False).alias("bold"), F.lit(50.0).alias("gap_above"), F.lit(50.0).alias("gap_below"), F.lit(4.0).alias("line_gap"), F.lit(200.0).alias("x0"), F.lit(395.0).alias("x1"), F.lit(595.0).alias("page_width"), F.lit(2000).alias("page_chars"), F.lit(False).alias("first_on_page"))
    got = {r.text: r.is_heading for r in structure.heading_score(wide).collect()}
    assert got == {t: t in ("Chapter One", "THE RIVER") for t, _ in rows}


def test_furniture_by_parity(spark):
    rows = []
    for p in range(1, 21):
        rows.append((1, p, 0, "The Left Book" if p % 2 else f"Chapter {p}", 10.0, 20.0))
        rows += [(1, p, k, f"body {p} {k} and more", 300.0 + 20 * k, 310.0 + 20 * k) for k in (1, 2, 3)]
        rows.append((1, p, 9, str(p), 800.0, 810.0))
    df = spark.createDataFrame(rows, "book long, page long, i long, text string, y0 double, y1 double").withColumn("page_height", F.lit(842.0)).withColumn("font_size", F.lit(8.0))
    got = {(r.band, r.key): r["class"] for r in layout.repeated_heads(df).collect()}
    assert got[("top", "theleftbook")] == "odd" and got[("bottom", "##")] == "all" if ("bottom", "##") in got else got[("top", "theleftbook")] == "odd"
    profile = layout.page_number_profile(df).first()
    assert profile.numbers == 20 and profile["size"] == 8.0
    assert layout.page_number_matches(df.where("i = 9"), layout.page_number_profile(df)).count() == 20


def test_two_columns(spark):
    rows = [(1, 1, 0, 72.0, 540.0, 50.0), (1, 1, 1, 72.0, 280.0, 100.0), (1, 1, 2, 320.0, 540.0, 100.0), (1, 1, 3, 72.0, 280.0, 120.0), (1, 1, 4, 320.0, 540.0, 120.0)]
    df = spark.createDataFrame(rows, "doc_id long, page long, i long, x0 double, x1 double, y0 double")
    got = [r.i for r in layout.two_column_order(df).orderBy("position").collect()]
    assert got == [0, 1, 3, 2, 4]


def test_backgrounds(spark):
    images = spark.createDataFrame([(1, 1, 5, 0.0, 0.0, 595.0, 842.0, 595.0, 842.0), (1, 1, 6, 0.0, 0.0, 50.0, 50.0, 595.0, 842.0)], "doc_id long, page long, image long, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    blocks = spark.createDataFrame([(1, 1, "text", 72.0, 100.0, 90.0, 110.0)], "doc_id long, page long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.image for r in layout.background_images(images, blocks).collect()] == [5]


def test_direction(spark):
    df = spark.createDataFrame([(1, "שלום עולם"), (2, "مرحبا بالعالم abc"), (3, "plain"), (4, "123"), (5, "abcdef שלו")], "doc_id long, text string")
    assert {r.doc_id: r.direction for r in layout.direction(df).collect()} == {1: "rtl", 2: "rtl", 3: "ltr", 4: "ltr", 5: "ltr"}


def test_glued_markers(spark):
    rows = spark.createDataFrame([(1, 1, 0, "the river5 rose.6 again"), (1, 3, 0, "the hill5")], "doc_id long, page long, i long, text string")
    have = spark.createDataFrame([(1, 2, "5"), (1, 1, "7")], "doc_id long, page long, number string")
    assert [(r.page, r.number) for r in notes.glued_markers(rows, have).collect()] == [(1, "5")]


def test_note_numbers(spark):
    df = spark.createDataFrame([(1, 1, "3. A note", 700.0, 842.0, 8.0, 10.0), (1, 1, "4 Another", 720.0, 842.0, 8.0, 10.0), (1, 1, "5. body", 100.0, 842.0, 8.0, 10.0)], "doc_id long, page long, text string, y0 double, page_height double, font_size double, body_size double")
    assert [r.numbers for r in notes.note_numbers(df).collect()] == ["3,4"]


def test_table_scores(spark):
    good = [(1, 0, r, c, "name" if r == 0 else str(10 * r + c)) for r in range(4) for c in range(3)]
    ragged = [(1, 9, r, c, "" if c else "x") for r in range(2) for c in range(3)]
    df = spark.createDataFrame(good + ragged, "doc_id long, table_at long, row long, col long, text string")
    got = {r.table_at: r for r in tables.table_scores(df).collect()}
    assert got[0].score == 1.0 and got[0].has_header and got[9].score == 0.0 and not got[9].has_header


def test_captions_and_formulas(spark):
    rows = spark.createDataFrame([(1, 0, "Figure 3. The old"), (1, 1, "mill by the river"), (1, 2, "Prose begins"), (1, 3, "∑ x = y + z (3)")], "doc_id long, i long, text string")
    assert [(r.i, r.text, r.lines) for r in structure.caption_merge(rows).collect()] == [(0, "Figure 3. The old mill by the river", 2)]
    assert {r.i: r.s for r in rows.select("i", structure.formula_score(F.col("text")).alias("s")).collect()}[3] == 0.9


def test_titles(spark):
    t = spark.createDataFrame([(1, "The River Road"), (2, "Untitled 7"), (3, "Nothing Alike Here"), (4, "abc")], "book long, title string")
    o = spark.createDataFrame([(b, "the river and the road to it untitled 7") for b in (1, 2, 3, 4)], "book long, text string")
    assert {r.book for r in structure.plausible_titles(t, o).where("plausible").collect()} == {1}


def test_books_round_trip(spark):
    rows = [(1, 0, "PARAGRAPH", None, "Before <all> & any"), (1, 1, "HEADING", 1, "Chapter 1"), (1, 2, "LIST_ITEM", None, "one"), (1, 3, "LIST_ITEM", None, "two"), (1, 4, "PARAGRAPH", None, ""), (1, 5, "HEADING", 1, "Chapter 2"), (1, 6, "QUOTE", None, "a \x01quote")]
    nodes = book.chapters(spark.createDataFrame(rows, "doc_id long, seq long, role string, level long, text string"))
    assert {r.seq: (r.chapter, r.chapter_title) for r in nodes.collect()}[0] == (0, "Front Matter")
    books = epub.packages(nodes)
    raw = books.first().epub
    assert raw == epub.packages(nodes).first().epub
    with zipfile.ZipFile(BytesIO(raw)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "<ul><li" in z.read("OEBPS/text/chapter0001.xhtml").decode()
    assert [r.text for r in epub.read_back(books).orderBy("seq").collect()] == ["Before <all> & any", "Chapter 1", "one", "two", "Chapter 2", "a quote"]


def test_integrity_reports_loss_and_duplication(spark):
    blocks = spark.createDataFrame([(1, "a", "one two", False), (1, "b", "three", False), (1, "c", "head", True)], "doc_id long, block_id string, text string, furniture boolean")
    nodes = spark.createDataFrame([(1, ["a"], "one two one two one")], "doc_id long, source_block_ids array<string>, text string")
    r = book.integrity(blocks, nodes).first()
    assert (r.unaccounted, r.ratio, r.suspicious) == (1, 1.0, True) and r.raw_ratio > 1.6


def test_tsv_and_guards(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t1\t2\t3\t4\t91.5\t\"quoted\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t12\tlow\n4\t1\t1\t1\t1\t0\t1\t2\t3\t4\t-1\t\n5\t1\t1\t1\t1\t3\t1\t2\t3\t4\t80\t \n")
    assert [(r.text, r.conf) for r in corpus.ocr_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [('"quoted', 0.915)]
    for name, content in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b"hello"), ("c.txt", b"%PDF-")):
        (tmp_path / name).write_bytes(content)
    got = {r.path.split("/")[-1]: r.error for r in corpus.pdf_guards(spark.read.format("binaryFile").load(str(tmp_path / "*.*"))).collect()}
    assert got["a.pdf"] is None and got["b.pdf"] == got["c.txt"] == "not_a_pdf"
    made = spark.createDataFrame([("x/d.pdf", 0, bytearray(b"")), ("x/e.pdf", 99, bytearray(b"%PDF-"))], "path string, length long, content binary")
    assert [r.error for r in corpus.pdf_guards(made, max_bytes=50).collect()] == ["empty_file", "too_large"]


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert audit.audit(corpus.document_nodes(docs)).count() == 0
    assert flow.verse_runs(corpus.blocks_by_document(docs)).count() == 0
    assert layout.two_column_order(corpus.blocks_by_document(docs)).count() == 0
    assert repair.vocabulary(docs).count() == 0


def test_foreign_packages(spark):
    """Another folder, attributes in another order, nested items, named entities; broken files give an error row."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile media-type="a/b" full-path="book/pack.opf"/></rootfiles></container>')
        z.writestr("book/pack.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="text/b%20c.xhtml" media-type="x" id="two"/><item media-type="x" href="a.xhtml" id="one"/></manifest><spine><itemref linear="yes" idref="one"/><itemref idref="two"/></spine></package>')
        z.writestr("book/a.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml"><body><h1>One&nbsp;&eacute;</h1><nav><p>skip</p></nav><ul><li><p>item <b>bold</b></p><ul><li>inner</li></ul></li></ul><table><tr><td><p>cell</p></td></tr></table></body></html>')
        z.writestr("book/text/b c.xhtml", "<html><body><p>last\n  line</p><p>broken</body></html>")
    books = spark.createDataFrame([(1, out.getvalue()), (2, b"no zip"), (3, None)], "doc_id long, epub binary")
    got = [(r.doc_id, r.seq, r.tag, r.text, bool(r.error)) for r in epub.read_back(books).orderBy("doc_id", "seq").collect()]
    assert got[:2] == [(1, 0, "h1", "One é", False), (1, 1, "li", "item boldinner", False)]
    assert got[2:] == [(1, 2, None, None, True), (2, 0, None, None, True), (3, 0, None, None, True)]


def test_pages_without_short_lines_stay_out_of_the_fold(spark):
    wide = [(1, 1, i, "a line that runs the whole width of its column and more", 72.0, 500.0, 72.0 + 14 * i, 82.0 + 14 * i, 10.0) for i in range(12)]
    assert flow.verse_runs(spark.createDataFrame(wide, "doc_id long, page long, i long, text string, x0 double, x1 double, y0 double, y1 double, font_size double")).count() == 0
