"""Rules on small frames, against rows worked out by hand."""

import re

import pytest

from marginalia.functions.dialect import SPARK
from marginalia.plans import registry
from marginalia.sources import files


def run(spark, name, *columns, **frames):
    """Sorted rows of an operator over frames given as (schema, rows)."""
    made = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in frames.items()}
    out = registry.apply(spark, name, **made)
    return sorted((tuple(r[c] for c in columns or out.columns) for r in out.collect()), key=repr)


META = "doc_id long, page_size string, margin_inches string, font_points string, font_family string, lang string"


def test_export_settings_hold_numbers_in_range(spark):
    rows = [(1, "A4", "0", "5", "Georgia, serif", "es"), (2, "A3", "4", "40.26", "a; b", "not a code"), (3, "", "wide", "", "", ""), (4, None, None, None, None, None), (5, " legal ", "1.5", "10.04", " My  Font ", "en-GB")]
    got = run(spark, "export_settings", "doc_id", "setting", "value", "fell_back", fx_meta=(META, rows))
    default = "Arial, Helvetica, sans-serif"
    want = {
        1: [("page", "A4", False), ("margin", "0.25", True), ("points", "6", True), ("font", "Georgia, serif", False), ("lang", "es", False)],
        2: [("page", "letter", True), ("margin", "3", True), ("points", "36", True), ("font", default, True), ("lang", "en-US", True)],
        3: [("page", "letter", False), ("margin", "1", True), ("points", "11", False), ("font", default, False), ("lang", "en-US", False)],
        4: [("page", "letter", False), ("margin", "1", False), ("points", "11", False), ("font", default, False), ("lang", "en-US", False)],
        5: [("page", "legal", False), ("margin", "1.5", False), ("points", "10", False), ("font", "My Font", False), ("lang", "en-GB", False)],
    }
    assert got == sorted([(i, *x) for i, xs in want.items() for x in xs], key=repr)
    counts = run(spark, "export_fallbacks", fx_meta=(META, rows))
    assert counts == sorted([("page", 5, 1), ("margin", 5, 3), ("points", 5, 2), ("font", 5, 1), ("lang", 5, 1)], key=repr)


DOCS = "doc_id long, readable boolean, marked boolean, lang string, display_title boolean, xmp_title string, info_title string, part_id string, outline boolean, suspects boolean, xfa boolean, encrypted boolean, allow_access boolean, allow_extract boolean, producer string, file_name string"
SIZES = "doc_id long, page int, width double, height double"
PAGES = "doc_id long, page int, width double, height double, text string, chars int, untagged int, images int, unmarked int, tabs string"
ELEMS = "doc_id long, elem_id int, parent_id int, kind string, page int, alt string, actual_text string"
FONTS = "doc_id long, font_id int, font_name string, subtype string, has_file boolean, has_tounicode boolean, encoding string"
ANNOTS = "doc_id long, page int, annot_id int, subtype string, has_struct_parent boolean, contents string, parent_id int, tip string"
ROLES = "doc_id long, from_kind string, to_kind string"


def report_frames(docs, pages, elems=(), fonts=(), annots=(), roles=()):
    return {"fx_docs": (DOCS, docs), "fx_pdf_pages": (PAGES, pages), "fx_elems": (ELEMS, list(elems)), "fx_fonts": (FONTS, list(fonts)), "fx_annots": (ANNOTS, list(annots)), "fx_rolemap": (ROLES, list(roles))}


def document(i, marked=True, readable=True, xfa=False, title="A title"):
    return (i, readable, marked, "en", True, title, title, "1", True, False, xfa, False, None, None, "p", f"{i}.pdf")


def page(i, number, text, images=0, tabs="/S"):
    return (i, number, 612.0, 792.0, text, len(text), 0, images, 0, tabs)


def test_triage_levels_and_steps(spark):
    bad = "" * 10
    docs = [document(1), document(2), document(3), document(4), document(5, marked=False), document(6, title=""), document(7, readable=False), document(8, xfa=True)]
    pages = [page(1, 1, bad), page(2, 1, "words"), page(2, 2, bad), page(3, 1, ""), page(4, 1, "words"), page(5, 1, "words"), page(6, 1, "words"), page(7, 1, ""), page(8, 1, "words"), page(8, 2, "", images=1)]
    elems = [(i, 1, None, "/Document", 1, "", "") for i in range(1, 9)] + [(4, 2, 1, "/Figure", 1, " ", "")]
    frames = report_frames(docs, pages, elems, annots=[(2, 1, 1, "/Widget", True, "", None, "name")])
    levels = {1: "pictures", 2: "partly", 3: "empty", 4: "faults", 5: "flat", 6: "faults", 7: "unreadable", 8: "partly"}
    assert run(spark, "triage_level", **frames) == sorted(levels.items(), key=repr)
    steps = {
        1: "open, full check",
        2: "open, fill in, full check",
        3: "resend, full check",
        4: "pictures, rebuild, full check",
        5: "rebuild, full check",
        6: "repair, rebuild, full check",
        7: "resend",
        8: "open, other form, full check",
    }
    assert run(spark, "triage_steps", **frames) == sorted(steps.items(), key=repr)


def test_report_follows_trees_fields_and_roles(spark):
    elems = [(1, 1, None, "/Document", 1, "", ""), (1, 2, 1, "/Table", 1, "", ""), (1, 3, 2, "/TR", 1, "", ""), (1, 4, 3, "/TH", 1, "", ""), (1, 5, 1, "/Table", 1, "", ""), (1, 6, 1, "/H1", 1, "", ""),
             (1, 7, 1, "/H3", 1, "", ""), (1, 8, 1, "/L", 1, "", ""), (1, 9, 8, "/LI", 1, "", ""), (1, 10, 9, "/LBody", 1, "", ""), (1, 11, 8, "/LI", 1, "", ""), (1, 12, 1, "/Mine", 1, "", ""), (1, 13, 1, "/Loop", 1, "", "")]
    roles = [(1, "/Mine", "/Yours"), (1, "/Yours", "/P"), (1, "/Loop", "/Hoop"), (1, "/Hoop", "/Loop")]
    annots = [(1, 1, 1, "/Widget", True, "", 3, ""), (1, 1, 3, "/Text", False, "", None, "named above"), (1, 1, 2, "/Widget", False, "", None, ""), (1, 2, 4, "/Link", False, "", None, ""), (1, 9, 5, "/Popup", True, "", None, "")]
    pages = [page(1, 1, "words", tabs="/R"), page(1, 2, "words"), page(1, 3, "words", tabs="")]
    fonts = [(1, 1, "ABCDEF+Helvetica", "/TrueType", False, False, None), (1, 2, "Odd", "/Type0", True, False, None), (1, 3, "Three", "/Type3", False, True, None)]
    got = {r[0]: r[1:] for r in run(spark, "report_union", "key", "passed", "bad", "total", **report_frames([document(1)], pages, elems, fonts, annots, roles))}
    assert got["table_headers"] == (False, 1, 2) and got["headings"] == (False, 7, 2) and got["lbody"] == (False, 1, 2)
    assert got["fields"] == (False, 1, 2) and got["fields_tagged"] == (False, 1, 2) and got["tabs"] == (False, 1, 2)
    assert got["links"] == (False, 1, 1) and got["fonts"] == (False, 1, 3) and got["unicode"] == (False, 1, 3)
    # /Mine is a paragraph in the end; the circle ends where it comes back, at a kind that is not standard
    assert got["roles"] == (False, 1, 11)
    assert "xfa" not in got and "permissions" not in got and len(got) == 26
    assert got["annotations"] == (False, 1, 1)


LINES = "doc_id long, source string, page int, line int, block int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean"


SHAPES = "doc_id long, page int, x0 double, x1 double, y0 double, y1 double"


def line(i, text, page=0, block=0, doc=1, size=11.0):
    return (doc, "s", page, i, block, text, 72.0, 10.0 * i, 300.0, 10.0 * i + 9, size, False)


def test_list_marks(spark):
    texts = ["— em dash", "⁃ hyphen bullet", "□ a box is none", "• bullet", "xviii. roman", "(a) letter", "1234. four digits", "-no space", "  12) item"]
    got = run(spark, "list_markers", "line", "marker", "text", fx_lines=(LINES, [line(i, t) for i, t in enumerate(texts)]), fx_line_shapes=(SHAPES, []))
    assert got == [(0, "ul", "em dash"), (1, "ul", "hyphen bullet"), (3, "ul", "bullet"), (4, "ol", "roman"), (5, "ol", "letter"), (8, "ol", "item")]
    items = run(spark, "list_items", "block", "tag", "text", fx_lines=(LINES, [line(0, "— one"), line(1, "more"), line(2, "— two")]), fx_line_shapes=(SHAPES, []))
    assert items == [(0, "ul", "one more"), (0, "ul", "two")]


def test_paragraphs_go_on_unless_a_sentence_or_quotation_ended(spark):
    texts = ["He said “go”", "and went", "(so it is)", "they say", "on", "and on"]
    got = run(spark, "paragraph_continuation", "text", fx_lines=(LINES, [line(i, t, block=i) for i, t in enumerate(texts)]))
    assert got == [("(so it is)",), ("He said “go”",), ("and went",), ("they say on and on",)]


def test_titles_and_languages(spark):
    docs = [document(1, title=" abc"), document(2, title=" "), document(3), document(4, title="")]
    docs[1] = (*docs[1][:6], "From the dictionary", *docs[1][7:])
    docs[3] = (*docs[3][:3], "english language", *docs[3][4:])
    docs[0] = (*docs[0][:3], "", *docs[0][4:])
    lines = (LINES, [line(0, "small words"), line(1, "Largest  line", size=20.0), line(2, "Ends with a stop.", size=30.0), line(3, "12 34 5", size=40.0)])
    frames = {"fx_docs": (DOCS, docs), "fx_lines": lines, "fx_pdf_pages": (PAGES, [page(1, 1, "el gato de la casa que no se va con los otros por la noche y con un perro en la calle"), page(1, 7, "the of and to in a is that for it as was with be by on not he his but at " * 9)])}
    assert run(spark, "title_plan", **frames) == [(1, "Largest line", "largest line"), (2, "From the dictionary", "from the dictionary"), (4, "4", "file name")]
    assert run(spark, "lang_plan", **frames) == [(1, "es", "guessed")]


def test_heading_levels(spark):
    styles = [(1, 1, None, 9, "Normal"), (1, 2, 1, None, "HEADING 2"), (1, 3, 2, None, "Body"), (1, 4, None, 3, "Mine"), (1, 5, 4, None, "Based on mine"), (1, 6, None, None, "title"), (1, 7, 6, None, "Based on a title"), (1, 8, None, None, "heading9")]
    paragraphs = [(1, i, i, 0, 0, "x", None) for i in range(1, 9)] + [(1, 9, 3, 0, 0, "x", 0), (1, 10, 99, 0, 0, "x", 5), (1, 11, 99, 0, 0, "x", 6)]
    got = run(spark, "heading_levels_from_styles", "para", "level", fx_styles=("doc_id long, style_id int, base_id int, outline_lvl int, style_name string", styles), fx_doc_paragraphs=("doc_id long, para int, style_id int, num_id int, ilvl int, text string, outline_lvl int", paragraphs))
    # a name counts for its own style alone, an outline level for those based on it; 9 is no heading
    assert got == sorted([(2, 2), (4, 4), (5, 4), (6, 1), (8, 6), (9, 1), (10, 6)], key=repr)


PICTURES = "doc_id long, page int, ordinal int, kb double, readable boolean, w_px int, h_px int, x0 double, y0 double, x1 double, y1 double"


def test_payload_cap_comes_before_readability(spark):
    rows = [(1, 1, i, 10.0, i % 5 != 0) for i in range(1, 21)] + [(2, 1, 1, 99_999.0, True), (2, 1, 2, 1.0, True)]
    got = run(spark, "picture_payload", "doc_id", "ordinal", "verdict", fx_pictures=("doc_id long, page int, ordinal int, kb double, readable boolean", rows))
    want = [(1, i, "over cap" if i > 14 else "unreadable" if i % 5 == 0 else "chosen") for i in range(1, 21)] + [(2, 1, "chosen"), (2, 2, "over budget")]
    assert got == sorted(want, key=repr)


def test_pictures_and_sizes_of_recognised_pages(spark):
    pictures = [(1, 1, 1, 1.0, True, 100, 100, 0.0, 0.0, 600.0, 700.0), (1, 2, 2, 1.0, True, 100, 100, 0.0, 0.0, 600.0, 700.0), (1, 1, 3, 1.0, True, 20, 100, 0.0, 0.0, 60.0, 70.0)]
    known = ("doc_id long, page int", [(1, 1), (3, 0)])
    assert run(spark, "picture_filter", "ordinal", fx_pictures=(PICTURES, pictures), fx_recognised=known, fx_form_pages=(SIZES, [(1, p, 612.0, 792.0) for p in (1, 2)])) == [(2,)]
    spans = [(1, 1, 0, 0, 0, "x" * 50, 10.4, False, False), (1, 1, 0, 1, 0, "y", 20.0, False, False), (1, 2, 0, 0, 0, "z" * 9, 12.0, False, False), (3, 0, 0, 0, 0, "x" * 5, 9.6, False, False), (3, 0, 0, 1, 0, "x", 12.0, False, False)]
    got = run(spark, "size_levelling", "doc_id", "page", "line", "size", fx_spans=("doc_id long, page int, block int, line int, span int, text string, size double, bold boolean, italic boolean", spans), fx_recognised=known)
    assert got == [(1, 1, 0, 12.0), (1, 1, 1, 24.0), (1, 2, 0, 12.0), (3, 0, 0, 10.0), (3, 0, 1, 10.0)]


PROPOSALS = "doc_id long, page int, pid int, label string, confidence double, source string, x0 double, y0 double, x1 double, y1 double"


def test_proposals_lend_labels_and_colons_give_way(spark):
    rows = [
        (1, 1, 1, "", 0.9, "box", 0.0, 0.0, 100.0, 20.0),
        (1, 1, 2, "Name", 0.8, "line", 5.0, 2.0, 90.0, 18.0),
        (1, 1, 3, "Other", 0.7, "line", 6.0, 2.0, 90.0, 18.0),
        (1, 1, 4, "Name", 0.5, "colon", 300.0, 300.0, 400.0, 320.0),
        (1, 1, 5, "Town", 0.5, "colon", 300.0, 400.0, 400.0, 420.0),
        (1, 1, 6, "", 0.5, "colon", 300.0, 500.0, 400.0, 520.0),
    ]
    assert run(spark, "proposal_dedupe", "pid", "label", fx_proposals=(PROPOSALS, rows)) == [(1, "Name"), (5, "Town"), (6, "")]


def test_answers(spark):
    fields = [(1, 1, "text", 10, False, "", False, False), (1, 2, "multiline text", 0, False, "", False, False), (1, 3, "checkbox", 0, False, "", False, False), (1, 4, "radio", 0, False, "Red|Blue", False, False),
              (1, 5, "choice", 0, False, "Red|Blue", False, False), (1, 6, "choice", 0, False, "Red|Blue", True, False), (1, 7, "choice", 0, False, "Red", False, True), (1, 8, "signature", 0, False, "", False, False), (1, 9, "text", 0, True, "", False, False)]
    given = [(1, "a\n b"), (1, "longer than ten"), (1, "a\n" + " " * 20 + "b"), (2, "a\nb"), (3, "No"), (3, "perhaps"), (3, None), (4, "bLUE"), (4, "none"), (4, "green"), (5, " red "), (5, "Red|Blue"), (5, "green"), (5, ""),
             (6, "blue|Red"), (6, "blue|pink"), (7, "pink"), (8, "me"), (9, "me"), (10, "me")]
    got = run(spark, "answer_validation", "field_id", "status", "value", fx_fields=("doc_id long, field_id int, kind string, max_len int, read_only boolean, choices string, multi boolean, editable boolean", fields), fx_answers=("doc_id long, field_id int, answer string", [(1, *x) for x in given]))
    want = [(1, "squeezed", "a b"), (1, "too long", None), (1, "squeezed", "a b"), (2, "taken", "a\nb"), (3, "taken", "false"), (3, "taken", "true"), (3, "taken", "false"), (4, "taken", "Blue"), (4, "taken", ""), (4, "not an option", None), (5, "taken", "Red"),
            (5, "more than one", None), (5, "not an option", None), (5, "taken", ""), (6, "taken", "Blue|Red"), (6, "not an option", None), (7, "taken", "pink"), (8, "refused", None), (9, "read only", None), (10, "no such field", None)]
    assert got == sorted(want, key=repr)


def test_cell_headings(spark):
    shapes = [(1, 1, 1, "rule", 100.0, 100.0, 400.0, 100.0), (1, 1, 2, "rule", 100.0, 130.0, 400.0, 130.0), (1, 1, 3, "rule", 100.0, 160.0, 400.0, 160.0)] + [(1, 1, 10 + k, "upright", x, 70.0, x, 160.0) for k, x in enumerate((100.0, 200.0, 300.0, 400.0))]
    lines = [(1, 1, 1, "Above the table", 210.0, 10.0, 290.0, 20.0), (1, 1, 2, "Dose", 220.0, 75.0, 280.0, 85.0), (1, 1, 3, "Morning", 110.0, 108.0, 160.0, 120.0), (1, 1, 4, "Lower", 220.0, 88.0, 280.0, 98.0)]
    got = run(spark, "label_headings", "shape_id", "upright", "label", fx_shapes=("doc_id long, page int, shape_id int, kind string, x0 double, y0 double, x1 double, y1 double", shapes), fx_form_lines=("doc_id long, page int, line int, text string, x0 double, y0 double, x1 double, y1 double", lines))
    # the first column has its own line in the upper row, but nothing above; the third has only the row's first cell
    assert got == sorted([(1, 10, ""), (1, 11, "Dose"), (1, 12, "Morning"), (2, 10, "Morning"), (2, 11, "Dose"), (2, 12, "")], key=repr)


def pages(*bodies):
    return "page_id long, url string, html string", [(i, "http://h.example/", b) for i, b in enumerate(bodies)]


def test_empty_blocks(spark):
    body = "<h2> &nbsp;</h2><p>​<br></p><p><img src='a'></p><ul> </ul><ul><li></li><li>x</li></ul><table></table><table><tr></tr><tr><td>a</td></tr></table><p>text</p>"
    assert run(spark, "empty_blocks", pages=pages(body, "<p>x</p>")) == sorted([(0, "h2", 1), (0, "p", 1), (0, "ul", 1), (0, "li", 1), (0, "table", 1), (0, "tr", 1)], key=repr)


def test_markdown_tables(spark):
    body = "<p>be*fore</p><table><caption>Doses</caption><tr><th>Drug</th><th>mg</th></tr><tr><td>a|b <p>c</p></td><td></td><td>5</td></tr></table><ol><li>one<li>two</ol>"
    got = dict(run(spark, "corpus_to_markdown", "doc_id", "body", pages=pages(body, "<h2>T</h2>plain")))
    assert got[0] == "be\\*fore\n\nDoses\n\n| Drug | mg |  |\n| --- | --- | --- |\n| a\\|b c |  | 5 |\n\n1. one\n\n2. two"
    assert got[1] == "## T\n\nplain"


def test_page_rules(spark):
    metas = ("doc_id long, title string, lang string", [(1, " ", "en"), (2, "T", None), (3, "T", "en")])
    assert run(spark, "issue_no_title", "doc_id", fx_page_meta=metas) == [(1,)] and run(spark, "issue_no_lang", "doc_id", fx_page_meta=metas) == [(2,)]
    body = "<p>" + "word " * 121 + "</p>"
    found = run(spark, "page_findings", "doc_id", "key", "ordinal", pages=pages(f"<html lang='en'><title>t</title>{body}", f"<h1>H</h1>{body}<h3>x</h3><a href='x'>Click here!</a><p>{'LOUD ' * 11}</p>"))
    assert found == [(0, "no_headings", 0), (1, "caps", 2), (1, "heading_skip", 2), (1, "lang", 0), (1, "link_vague", 1), (1, "title", 0)]


def test_decoding(spark):
    contents = {"mark": b"\xef\xbb\xbfa\xc3\xa9", "utf8": "é—".encode(), "wide": "é—".encode("utf-16"), "windows": b"\x80\x93caf\xe9\x94\x81", "empty": b""}
    got = {r["path"]: (r["encoding"], r["text"]) for r in files.decoded(spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")).collect()}
    assert got == {"mark": ("utf-8-sig", "aé"), "utf8": ("utf-8", "é—"), "wide": ("utf-16", "é—"), "windows": ("cp1252", "€“café”�"), "empty": ("utf-8", "")}


def test_whole_output_survives_a_failed_write(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    files.write_whole(spark.range(5), path)
    with pytest.raises(Exception):
        files.write_whole(spark.range(9).selectExpr("case when id = 3 then raise_error('no') else id end id"), path)
    assert spark.read.parquet(path).count() == 5
    files.write_whole(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_inputs_leave_the_session_as_it_was(spark):
    spark.range(3).createOrReplaceTempView("pages")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    run(spark, "plain_text", pages=pages("<p>a</p>"))
    run(spark, "page_inheritance", fx_elems=(ELEMS, [(1, 1, None, "/Document", 1, "", ""), (1, 2, 1, "/P", None, "", "")]))
    assert spark.table("pages").count() == 3 and spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    spark.catalog.dropTempView("pages")


def test_a_batch_that_is_run_again_ends_as_before(spark, tmp_path):
    from marginalia.streaming import arrivals

    schema = "page_id long, url string, html string"
    for k, rows in enumerate(([(1, "u", "<p>a</p>")], [(1, "u", "<p>a</p>"), (2, "u", "<p>b</p>")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        # the second run loses the commit of its last batch and repeats it
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        arrivals.check_arrivals(stream, f"{tmp_path}/out")
    want = sorted(map(repr, spark.read.parquet(f"{tmp_path}/out/issues").collect()))
    assert len({r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out/issues").collect()}) == 2
    last = max(int(p.name) for p in (tmp_path / "out/state/commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "out/state/commits" / name).unlink()
    arrivals.check_arrivals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out")
    assert sorted(map(repr, spark.read.parquet(f"{tmp_path}/out/issues").collect())) == want


CONTENT = "doc_id long, page int, mcid int, elem_id int, text string"


def test_trees_of_any_depth(spark):
    """A chain of 5,000 elements whose last one has the page, the text and the header cell; a missing parent; a ring; two children with pages."""
    n = 5000
    chain = [(1, i, i - 1 if i > 1 else None, "/TH" if i == n else "/Table" if i in (1, 2500) else "/Div", 7 if i == n else None, "", "") for i in range(1, n + 1)]
    other = [(2, 5, 99, "/P", None, "", ""), (2, 6, 5, "/Span", 3, "", ""), (2, 7, 5, "/Span", 4, "", ""), (3, 1, 2, "/P", None, "", ""), (3, 2, 1, "/P", 9, "", ""), (4, 1, None, "/Sect", 2, "", ""), (4, 2, 1, "/P", None, "", ""), (4, 3, 2, "/Span", 5, "", "")]
    elems = (ELEMS, chain + other)
    got = {(d, e): p for d, e, p in run(spark, "page_inheritance", "doc_id", "elem_id", "page", fx_elems=elems)}
    assert all(got[1, i] == 7 for i in range(1, n + 1))
    assert [got[2, i] for i in (5, 6, 7)] == [3, 3, 4] and [got[3, i] for i in (1, 2)] == [None, 9] and [got[4, i] for i in (1, 2, 3)] == [2, 2, 5]
    content = (CONTENT, [(1, 2, 0, n, "low"), (2, 2, 0, 6, "first"), (2, 1, 1, 7, "third"), (2, 2, 1, 6, "second")])
    texts = {(d, e): t for d, e, t in run(spark, "element_text", "doc_id", "elem_id", "text", fx_elems=elems, fx_content=content)}
    assert len(texts) == n + 3 and texts[1, 1] == "low" and texts[2, 5] == "first second third" and texts[2, 7] == "third"
    docs = (DOCS, [document(i) for i in (1, 2, 3, 4)])
    assert run(spark, "chk_table_headers", "doc_id", "passed", "bad", "total", fx_elems=elems, fx_docs=docs) == [(1, True, 0, 2)]
    lone = (ELEMS, [(1, 1, None, "/Table", 1, "", ""), (1, 2, 1, "/Table", 1, "", ""), (1, 3, 1, "/TH", 1, "", "")])
    assert run(spark, "chk_table_headers", "doc_id", "passed", "bad", "total", fx_elems=lone, fx_docs=docs) == [(1, False, 1, 2)]


def test_role_maps_of_any_length(spark):
    n = 300
    elems = (ELEMS, [(1, 1, None, "/K0", 1, "", ""), (1, 2, 1, "/A", 1, "", ""), (2, 1, None, "/K0", 1, "", ""), (1, 3, 1, "/P", 1, "", "")])
    roles = (ROLES, [(1, f"/K{i}", f"/K{i + 1}") for i in range(n)] + [(1, "/A", "/B"), (1, "/B", "/C"), (1, "/C", "/B")])
    got = run(spark, "role_resolution", "doc_id", "kind", "resolved", fx_elems=elems, fx_rolemap=roles)
    assert got == [(1, "/A", "/C"), (1, "/K0", f"/K{n}"), (1, "/P", "/P"), (2, "/K0", "/K0")]


def test_fields_take_tips_from_seven_levels_above(spark):
    annots = [(1, 1, 100 + i, "/Widget", True, "", 100 + i - 1 if i else None, "top" if not i else "") for i in range(9)]
    got = run(spark, "chk_fields", "doc_id", "passed", "bad", "total", fx_annots=(ANNOTS, annots), fx_docs=(DOCS, [document(1)]))
    assert got == [(1, False, 1, 9)]  # the ninth is eight above


def test_tag_blocks(spark):
    kinds = [(1, None, "/Document"), (2, 1, "/H"), (3, 1, "/H5"), (4, 1, "/P"), (5, 4, "/Table"), (6, 5, "/TH"), (7, 4, "/Span"), (8, 1, "/Caption"), (9, 1, "/Note"), (10, 1, "/Sect"), (11, 10, "/Code"), (12, 1, "/Form"), (13, 12, "/P"),
             (14, 1, "/BlockQuote"), (15, 14, "/P"), (16, 1, "/P"), (17, 1, "/Odd"), (18, 1, "/Figure")]
    elems = [(1, i, up, kind, 1, "", "") for i, up, kind in kinds]
    content = [(1, 1, i, i, f"t{i}") for i in (2, 3, 4, 6, 7, 8, 9, 10, 11, 13, 15, 17)] + [(1, 2, 0, 8, "next")]
    got = run(spark, "tag_blocks", "ord", "tag", "text", fx_elems=(ELEMS, elems), fx_content=(CONTENT, content), fx_rolemap=(ROLES, [(1, "/Odd", "/H2")]))
    want = [("h2", "t2"), ("h5", "t3"), ("p", "t4"), ("table", "t6"), ("p", "t7"), ("p", "t8 next"), ("p", "t9"), ("p", "t10"), ("p", "t11"), ("blockquote", "t15"), ("h2", "t17"), ("img", "")]
    assert [x[1:] for x in sorted(got)] == want


def test_trees_are_the_same_by_document_and_by_rows(spark, monkeypatch):
    """A small document is worked out without a round of joins; with no document small the rounds give the same. Rings, repeated elements
    and missing parents are among them."""
    from marginalia.operators import trees

    ups = {1: None, 2: 1, 3: 1, 4: 9, 5: 6, 6: 5, 7: 5, 8: 2, 10: 8, 11: 99}
    elems = [(doc, i, up, "/TH" if i % 2 else "/Table", i if i % 3 else None, "", "") for doc in (1, 2) for i, up in ups.items()] + [(1, 8, 3, "/P", 7, "", "")]
    content = [(1, 1, k, i, f"t{k}") for k, i in enumerate((10, 2, 8, 3, 3, 5, 11))]
    frames = {"fx_elems": (ELEMS, elems), "fx_content": (CONTENT, content)}
    monkeypatch.setattr(trees, "climbed", None)
    small = [run(spark, name, **frames) for name in ("element_text", "page_inheritance")]
    assert ((1, 1, "t4 t3 t1 t2 t0") in small[0] or (1, 1, "t1 t2 t0 t3 t4") in small[0]) and len(small[0]) == 6
    monkeypatch.undo()
    monkeypatch.setattr(trees, "SMALL", 0)
    assert [run(spark, name, **frames) for name in ("element_text", "page_inheritance")] == small


def test_rollup_counts_a_document_once_at_each_level(spark):
    """A document of two hosts counts for both, and once above them; no plan spreads rows over the levels before they are summed."""
    issues = ("origin string, doc_id long, key string, severity string, kind string, ordinal long, detail string", [("page", i, k, v, "", n, "") for i in (1, 2) for k, v in (("title", "fix"), ("lang", "fix"), ("caps", "review")) for n in range(i)])
    docs = ("origin string, doc_id long, source string", [("page", 1, "a"), ("page", 1, "b"), ("page", 2, "b")])
    got = run(spark, "issues_rollup", "level", "key", "source", "n", "docs", issues=issues, all_docs=docs)
    assert [x for x in got if x[0] == 3] == [(3, None, None, 12, 2)]
    assert [x for x in got if x[0] in (1, 2) and x[1] == "title"] == [(1, "title", None, 4, 2), (2, "title", None, 4, 2)]
    assert [x for x in got if x[0] == 0 and x[1] == "caps"] == [(0, "caps", "a", 1, 1), (0, "caps", "b", 3, 2)]
    made = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in {"issues": issues, "all_docs": docs}.items()}
    plan = registry.apply(spark, "issues_rollup", **made)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan.split("Expand")[1] and "doc_id" not in plan.split("Expand")[1].split("\n")[0]


PICTURE = "data:image/png;base64,iVBORw0KGgo="
CLEANED = [
    ("<p>x <b>bold</b> <i>it</i> <font size=\"3\">f</font> y</p>", "<p>x <strong>bold</strong> <em>it</em> f y</p>"),
    ("<div>one</div><div><p>a</p>bare<p>b</p></div>", "<p>one</p><p>a</p><p>bare</p><p>b</p>"),
    ("hello <b>world</b><p>para</p>trailing", "<p>hello <strong>world</strong></p><p>para</p><p>trailing</p>"),
    ("<p></p><p><br></p><p>&nbsp;</p><h2></h2><p>kept<br></p><ul></ul><table></table><blockquote><p> </p></blockquote>", "<p>kept</p>"),
    ("<ul><li>a</li><ul><li>nested</li></ul></ul>", "<ul><li>a<ul><li>nested</li></ul></li></ul>"),
    ("<ul>stray<li>x</li><li><br></li>more <b>words</b></ul>", "<ul><li>stray</li><li>x</li><li>more <strong>words</strong></li></ul>"),
    ("<p>one<p>two<ul><li>a<li>b<ol><li>c</ol>d</ul>", "<p>one</p><p>two</p><ul><li>a</li><li>b<ol><li>c</li></ol>d</li></ul>"),
    ("<blockquote>bare</blockquote><dl><dt>t</dt><dd>d</dd></dl>", "<blockquote><p>bare</p></blockquote><p>t</p><p>d</p>"),
    (f'<p><img src="{PICTURE}"> <img src="{PICTURE}" alt="x" onerror="e()" width="9"> <img src="https://e.example/x.png" alt="y"></p>', f'<p><img src="{PICTURE}" alt="" data-needs-alt="1"> <img src="{PICTURE}" alt="x"></p>'),
    (f'<p><img src="{PICTURE}" alt="" role="presentation"></p>', f'<p><img src="{PICTURE}" alt="" role="presentation"></p>'),
    ('<p lang="fr">oui</p><h3 lang="no code">x</h3>', '<p lang="fr">oui</p><h3>x</h3>'),
    ('<p><a href="javascript:x()">a</a> <a href="https://x.y/?a=1&b=2">b</a> <a href="mailto:a@b.c?subject=h w">c</a> <a href="#f">d</a></p>', '<p>a <a href="https://x.y/?a=1&amp;b=2">b</a> <a href="mailto:a@b.c?subject=h%20w">c</a> d</p>'),
    ("<p>a &lt;b&gt; &amp; \"q\" </p>", "<p>a &lt;b&gt; &amp; \"q\"</p>"),
    ("<table><tr><td>a<td>b<tr><td colspan=\"2\" rowspan=\"x\">c</table>", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td colspan=\"2\">c</td></tr></tbody></table>"),
    ("<table><caption>Cap</caption><thead><tr><th scope=\"col\">a</th></tr></thead><tbody><tr><td></td></tr></tbody></table>", "<table><caption>Cap</caption><thead><tr><th scope=\"col\">a</th></tr></thead><tbody><tr><td></td></tr></tbody></table>"),
    ("<p onclick=\"x()\">t</p><script>a()</script><svg><p>in</p></svg><p>after</p>", "<p>t</p><p>after</p>"),
    ("<p>un<b>closed<p>next", "<p>un<strong>closed</strong></p><p>next</p>"),
    ("<pre>\n  kept\n   as is </pre>", "<pre>  kept\n   as is </pre>"),
    ("<p>" + "w <b>b</b> " * 300 + "</p>", "<p>" + " ".join(["w <strong>b</strong>"] * 300) + "</p>"),
    ("", None),
]
HTML_PAGES = "page_id long, url string, html string"


def test_cleaned_pages(spark):
    clean = lambda pages: dict(run(spark, "clean_corpus", "doc_id", "html", pages=(HTML_PAGES, [(i, "u", h) for i, h in pages])))
    once = clean(enumerate(h for h, _ in CLEANED))
    assert [once.get(i) for i in range(len(CLEANED))] == [want for _, want in CLEANED]
    assert clean(once.items()) == once


def test_lists_and_implied_closes(spark):
    pages = (HTML_PAGES, [(1, "u", "<ul>stray<li>a</li><ol><li>b</li></ol><li></li></ul>"), (2, "u", "<table><tr><td>1<td>2<tr><td>3</table><dl><dt>t<dd>d</dl><p>x<p>y<li>i<li>j")])
    got = run(spark, "list_repair", "level", "text", pages=pages)
    assert got == [(1, "a"), (1, "i"), (1, "j"), (1, "stray"), (2, "b")]
    assert run(spark, "implied_closes", "doc_id", "tag", "implied", pages=pages) == [(2, "dd", 1), (2, "li", 1), (2, "p", 1), (2, "td", 1), (2, "tr", 1)]


REPLIES = "doc_id long, page int, reply string"


def test_model_replies(spark):
    """Several boxes, corners in any order and off the page, unknown kinds, numbers that are none, broken lists, too large or small, sizes of the page."""
    good = '{"label":" Your  name: ","rect":[200,60,100,40],"kind":"Signature","confidence":1.5}'
    reply = f'Here: [{good},{{"label":"","rect":[590,10,700,30],"kind":"poem","confidence":"x"}},"text",{{"rect":["a",1,2,3]}},{{"rect":[NaN,1,20,30]}},{{"rect":[1,2,3,4]}},{{"rect":[0,0,600,500]}},{{"rect":[10,10,50]}},{{"label":"","rect":[10,100,60,120,7],"confidence":-1}}] done'
    replies = (REPLIES, [(1, 1, reply), (1, 2, "no list"), (2, 1, '[{"label":"cut'), (3, 1, None), (4, 1, f"[{good}]"), (5, 1, "[]")])
    pages = (SIZES, [(i, p, 600.0, 800.0) for i in (1, 2, 3, 5) for p in (1, 2)])
    got = run(spark, "model_boxes", "doc_id", "page", "n", "label", "kind", "x0", "y0", "x1", "y1", fx_replies=replies, fx_form_pages=pages)
    assert got == [(1, 1, 1, "Your name:", "signature", 100.0, 40.0, 200.0, 60.0), (1, 1, 2, "", "text", 590.0, 10.0, 600.0, 30.0), (1, 1, 9, "", "text", 10.0, 100.0, 60.0, 120.0)]
    counts = run(spark, "model_box_counts", "doc_id", "page", "offered", "kept", fx_replies=replies, fx_form_pages=pages)
    assert counts == [(1, 1, 9, 3), (1, 2, 0, 0), (2, 1, 0, 0), (3, 1, 0, 0), (4, 1, 1, 0), (5, 1, 0, 0)]
    made = run(spark, "model_proposals", "n", "kind", "confidence", "label", fx_replies=replies, fx_form_pages=pages)
    assert made == [(1, "text", 1.0, "Your name"), (2, "text", 0.7, "Blank 1 on page 1"), (9, "text", 0.0, "Blank 2 on page 1")]


PROPOSALS = "doc_id long, page int, pid int, label string, confidence double, source string, x0 double, y0 double, x1 double, y1 double"


def proposed(labels):
    return (PROPOSALS, [(1, 1, i, label, 0.9, "box", 0.0, 0.0, 1.0, 1.0) for i, label in enumerate(labels)])


def test_names_are_unique(spark):
    names = lambda labels: [n for _, n in run(spark, "unique_names", "pid", "name", fx_proposals=proposed(labels))]
    assert names(["A", "A", "A 2"]) == ["a", "a_2", "a_2_2"]
    assert names(["a_2", "a", "a", "a", "a_3", None, "!", "a"]) == ["a_2", "a", "a_3", "a_4", "a_3_2", "field", "field_2", "a_5"]
    assert names(["x" * 39 + "-y", "Ü ber 9"]) == ["x" * 39, "ber_9"]


def test_rows_follow_the_heights_of_their_page(spark):
    rows = lambda items: [r[1:] for r in run(spark, "row_reading_order", "pid", "row_no", "read_ord", fx_proposals=(PROPOSALS, [(1, 1, i, "", 0.9, "box", x, y, x + 9, y + h) for i, (x, y, h) in enumerate(items)]))]
    assert rows([(50.0, 0.0, 30.0), (10.0, 12.0, 30.0), (0.0, 40.0, 30.0)]) == [(1, 2), (1, 1), (2, 3)]
    assert rows([(50.0, 0.0, 5.0), (10.0, 5.0, 5.0)]) == [(1, 1), (2, 2)]  # a band of 4
    assert rows([(50.0, 0.0, 0.0), (10.0, 8.0, 0.0), (0.0, 8.5, 0.0)]) == [(1, 2), (1, 1), (2, 3)]  # no heights: 8
    assert rows([(5.0, 0.0, 10.0), (3.0, 7.0, 20.0)]) == [(1, 2), (1, 1)]  # the upper of two medians


def test_field_names_from_the_page(spark):
    words = [(1, 1, 1, "Full", 100.0, 50.0, 120.0, 62.0), (1, 1, 2, "name:", 125.0, 50.0, 150.0, 62.0), (1, 1, 3, "far", -100.0, 50.0, -65.0, 62.0), (1, 1, 4, "Above", 300.0, 80.0, 340.0, 90.0), (1, 1, 5, "me _.", 345.0, 80.0, 380.0, 90.0), (1, 2, 6, "other", 100.0, 50.0, 150.0, 62.0)]
    fields = [(1, 1, 1, 160.0, 52.0, 300.0, 64.0), (1, 2, 1, 290.0, 100.0, 400.0, 112.0), (1, 3, 1, 290.0, 130.0, 400.0, 140.0)]
    got = run(spark, "field_names_from_page", "field_id", "name", fx_words=("doc_id long, page int, word_id int, text string, x0 double, y0 double, x1 double, y1 double", words), fx_unnamed_fields=("doc_id long, field_id int, page int, x0 double, y0 double, x1 double, y1 double", fields))
    assert got == [(1, "Full name"), (2, "Above me")]


def test_nested_lists(spark):
    items = [(1, 0, "ul"), (2, 1, "ul"), (3, 1, "ul"), (4, 1, "ol"), (5, 3, "ol"), (6, 0, "ul"), (7, 0, "ol"), (8, 2, "ul"), (9, 1, "ul"), (10, 0, "ol")]
    got = run(spark, "nested_lists", "item_id", "list_id", "parent_id", fx_list_items=("doc_id long, item_id int, level int, tag string, text string", [(1, i, level, tag, "") for i, level, tag in items]))
    assert sorted(got) == [(1, 1, None), (2, 2, 1), (3, 2, 1), (4, 4, 1), (5, 5, 4), (6, 1, None), (7, 7, None), (8, 8, 7), (9, 9, 7), (10, 7, None)]


LINES = "doc_id long, source string, page int, line int, block int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean"
SPANS = "doc_id long, page int, block int, line int, span int, text string, size double, bold boolean, italic boolean"
LINE_PAGES = "doc_id long, page int, width double, height double"


def set_line(page, n, text, y, x0=72.0, x1=280.0, block=0):
    return (1, "s", page, n, block, text, x0, y, x1, y + 10, 11.0, False)


def test_furniture_of_short_pages(spark):
    lines = (LINES, [set_line(p, n, t, y) for p in (1, 2, 3) for n, t, y in ((1, f"Head {p}", 5.0), (2, "body", 300.0), (3, f"Foot {p}", 560.0))])
    pages = (LINE_PAGES, [(1, p, 420.0, 595.0) for p in (1, 2, 3)])
    assert run(spark, "furniture_lines", "key", "pages", fx_lines=lines, fx_line_pages=pages) == [("foot #", 3), ("head #", 3)]
    assert run(spark, "drop_furniture", "dropped", "examples", fx_lines=lines, fx_line_pages=pages) == [(6, "Head 1 | Foot 1 | Head 2")]
    assert run(spark, "furniture_lines", fx_lines=lines, fx_line_pages=(LINE_PAGES, [(1, p, 420.0, 792.0) for p in (1, 2, 3)])) == [(1, "head #", 3)]


def test_ties_of_sizes_go_to_the_first_line(spark):
    spans = (SPANS, [(1, 2, 0, 1, 0, "abcd", 9.0, False, False), (1, 1, 0, 100, 0, "abcd", 12.0, False, False), (1, 1, 0, 99, 11, "abcd", 10.0, False, False)])
    assert run(spark, "body_size", "body_size", fx_spans=spans) == [(10.0,)]


def test_paragraphs_go_on_after_many_blocks(spark):
    lines = (LINES, [set_line(1, 1, "one", 1.0, block=99), set_line(1, 2, "two", 2.0, block=100), set_line(1, 3, "three", 3.0, block=150), set_line(2, 1, "four", 1.0, block=0)])
    assert run(spark, "paragraph_continuation", "text", fx_lines=lines) == [("one two three four",)]


def test_columns_by_the_width_of_the_page(spark):
    lines = (LINES, [set_line(1, 1, "l1", 10.0, 10.0, 150.0), set_line(1, 2, "r1", 10.0, 210.0, 390.0), set_line(1, 3, "l2", 30.0, 10.0, 150.0)])
    order = lambda w: [x[1] for x in sorted(run(spark, "reading_order", "read_ord", "line", fx_lines=lines, fx_line_pages=(LINE_PAGES, [(1, 1, w, 600.0)])))]
    assert order(400.0) == [1, 3, 2] and order(800.0) == [1, 2, 3]


def test_drawn_bullets(spark):
    form = ("doc_id long, page int, line int, text string, x0 double, y0 double, x1 double, y1 double", [(1, 1, i, "t", 72.0, 100.0 * i, 200.0, 100.0 * i + 12) for i in range(1, 6)])
    shapes = [(60.0, 65.0, 102.0, 107.0), (95.0, 100.0, 202.0, 207.0), (68.0, 73.0, 304.0, 308.0), (30.0, 41.0, 402.0, 406.0), (40.0, 41.0, 502.0, 506.0)]
    got = run(spark, "drawn_bullets", "line", "shapes", fx_form_lines=form, fx_bullet_shapes=("doc_id long, page int, x0 double, x1 double, y0 double, y1 double", [(1, 1, *x) for x in shapes]))
    assert got == [(1, 1), (3, 1)]


def test_lists_end_where_other_text_stands(spark):
    texts = ["- a", "more", "- b", "1. c", "plain", "- d", "- e"]
    lines = (LINES, [set_line(1, i, t, 10.0 * i, block=i if t == "plain" else 9 if i > 4 else 0) for i, t in enumerate(texts)])
    got = run(spark, "list_items", "page", "block", "item_id", "tag", "text", "list_id", fx_lines=lines, fx_line_shapes=(SHAPES, []))
    assert [x[3:5] for x in got] == [("ul", "a more"), ("ul", "b"), ("ol", "c"), ("ul", "d"), ("ul", "e")]
    ids = [x[5] for x in got]
    assert ids[0] == ids[1] and ids[3] == ids[4] and len(set(ids)) == 3


def test_texts_are_taken_as_they_stand(spark):
    assert run(spark, "text_paragraphs", "paragraph", fx_plain_texts=("doc_id long, text string", [(1, "a, b"), (2, " x \n y \n \n z"), (3, None)])) == [("a, b",), ("x y",), ("z",)]
    lines = ("doc_id long, line_no long, line string", [(1, 0, "one, two"), (1, 1, "3–5 and — so")])
    assert run(spark, "dash_report", "line_no", "dashes", "cleaned", fx_dash_lines=lines) == [(1, 2, "3 to 5 and, so")]
    code = ("doc_id long, html string", [(1, "<p>no</p><pre>\n a &lt; b\n\tc\n\n</pre><pre>x<br>y</pre>")])
    assert run(spark, "code_block_lines", "block", "line_no", "line", fx_code_pages=code) == [(1, 0, " a < b"), (1, 1, "\tc"), (2, 0, "x"), (2, 1, "y")]


def test_figures_of_pages(spark):
    pages = ("doc_id long, html string", [(1, "<figure><img src=a>loose <b>words</b><figcaption>First</figcaption><img src=b><figcaption>second</figcaption></figure>text<figure><figcaption>alone</figcaption></figure>")])
    assert run(spark, "figure_pairing", "figure", "n_img", "caption", "kind", fx_figure_pages=pages) == [(1, 2, "First loose words", "figure"), (2, 0, "alone", "text")]


def test_search_and_replace(spark):
    docs = ("doc_id long, text string", [(1, "The cat, THE the aa aaa 50% (a.b) axb"), (2, None), (3, "ÉTÉ été")])
    terms = ("term string, match_case boolean", [("the", False), ("the", True), ("aa", True), ("50% (a.b)", False), ("été", False), ("", False), ("nothing", False)])
    got = run(spark, "corpus_find", "doc_id", "term", "match_case", "hits", documents=docs, fx_terms=terms)
    assert got == [(1, "50% (a.b)", False, 1), (1, "aa", True, 2), (1, "the", False, 3), (1, "the", True, 1), (3, "été", False, 2)]
    pages = (HTML_PAGES, [(1, "u", "<p the>Cat CATS cat. x</p><b>scat</b>")])
    swaps = ("find string, repl string, match_case boolean", [("cat", "dog", False), ("cat", "dog", True), (".", "!", False)])
    import hashlib

    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = run(spark, "corpus_replace", "find", "n", "text_md5", pages=pages, fx_replacements=(swaps[0], swaps[1][:1]))
    assert got == [("cat", 4, digest("Dog DOGS dog. xsdog"))]
    assert run(spark, "corpus_replace", "find", "n", "text_md5", pages=pages, fx_replacements=(swaps[0], swaps[1][1:])) == [(".", 1, digest("Cat CATS cat! xscat")), ("cat", 2, digest("Cat CATS dog. xsdog"))]


def test_capitals_keep_the_length_of_a_line(spark):
    """Spark writes ß as two capitals; the line of the first document would then have 41 letters."""
    lines = [(7, "ß" + "a" * 39), (14, "ß" + "a" * 40)]
    got = run(spark, "issue_caps", "doc_id", "ordinal", documents=("doc_id long, text string, source string", [(i, "x\n" + t, "s") for i, t in lines]))
    assert got == [(14, 1)]
    sample = "aßŉǰ\nᾳᾲﬁ\u019b x\U00010d70é"
    assert spark.createDataFrame([(sample,)], "s string").selectExpr(f"{SPARK.upper('s')} u").first()[0] == "Aẞŉǰ\nᾼᾲﬁ\u019b X\U00010d70É"


def test_percentiles_are_exact(spark):
    """30,000 sizes in a group, no two alike, beyond what a sketch of 10,000 keeps apart."""
    sizes = spark.range(30000).selectExpr("id doc_id", "repeat('w ', cast(id as int)) text", "'en' lang", "cast(null as string) source")
    assert [tuple(r) for r in registry.apply(spark, "word_percentiles", documents=sizes).select("docs", "p50", "p95").collect()] == [(30000, 14999, 28499)]


def test_percentiles_within_their_error(spark):
    docs = [(i, "w " * ((i * 37) % 5000 + 1), "en", "a" if i % 3 else None) for i in range(3000)]
    got = run(spark, "word_percentiles", "lang", "source", "docs", "p50", "p95", documents=("doc_id long, text string, lang string, source string", docs))
    for _, source, n, p50, p95 in got:
        sizes = sorted((i * 37) % 5000 + 1 for i in range(3000) if (source == "a") == bool(i % 3))
        assert n == len(sizes)
        for p, x in ((0.5, p50), (0.95, p95)):
            assert abs(sizes.index(x) - p * n) <= n / 10000 + 1


def test_streams_work_on_what_arrives(spark, tmp_path):
    """A batch leaves the changed sources alone; a stream that is started again goes on where it was; pages seen before are not checked again."""
    from marginalia.streaming import arrivals

    schema = "source_id long, snapshot_id long, saved_at timestamp, title string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    arrive = lambda n, rows: spark.createDataFrame(rows, "source_id long, snapshot_id long, saved_at string, title string").selectExpr("source_id", "snapshot_id", "cast(saved_at as timestamp) saved_at", "title").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    arrive(1, [(i, i, "2026-01-02", f"a{i}") for i in range(50)])
    arrivals.keep_latest(stream(), f"{tmp_path}/out")
    arrive(2, [(1, 100, "2026-01-03", "new"), (2, 101, "2026-01-01", "late"), (60, 102, "2026-01-01", "other")])
    arrivals.keep_latest(stream(), f"{tmp_path}/out")
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out/changes").groupBy("batch").count().collect()}
    assert sizes[0] == 50 and sizes[max(sizes)] == 3
    got = lambda: sorted(tuple(r) for r in arrivals.kept_latest(spark, f"{tmp_path}/out").collect())
    want = sorted([(i, i, f"a{i}") for i in range(50) if i != 1] + [(1, 100, "new"), (60, 102, "other")])
    assert got() == want
    arrivals.compacted(spark, f"{tmp_path}/out", max(sizes))
    assert got() == want and spark.read.parquet(f"{tmp_path}/out/changes").count() == 51
    arrive(3, [(1, 103, "2026-01-04", "newest")])
    arrivals.keep_latest(stream(), f"{tmp_path}/out")
    assert (1, 103, "newest") in got() and len(got()) == 51


def test_pages_as_text_and_markdown(spark):
    html = f'<html><head><title>Mine</title></head><body><h2>Items</h2><p>a <b>bold</b> and <i>it</i>, <a href="https://e.example/">a link</a> *x* <code>c</code></p><p>un<b>closed</p><ul><li>One<ul><li>Nested</li></ul></li></ul><blockquote>Quoted</blockquote><img src="{PICTURE}" alt="A red square"><img src="{PICTURE}"><table><caption>Cap</caption><tr><th>Item<th>Cost<tr><td>Tea<td>2</table></body></html>'
    pages = (HTML_PAGES, [(1, "u", html), (2, "u", "<title>T</title><h1>Own</h1>")])
    text = dict(run(spark, "corpus_to_text", "doc_id", "body", pages=pages))
    assert text[1].split("\n") == ["Mine", "", "Items", "a bold and it, a link *x* c", "unclosed", "* One", "  * Nested", "Quoted", "Picture: A red square Picture with no description.", "Cap", "Item    Cost", "Tea    2"]
    marked = dict(run(spark, "corpus_to_markdown", "doc_id", "body", pages=pages))
    assert marked[1].split("\n\n") == ["# Mine", "## Items", "a **bold** and *it*, [a link](https://e.example/) \\*x\\* `c`", "un**closed**", "- One", "    - Nested", "> Quoted", "Picture: A red square Picture with no description.", "Cap", "| Item | Cost |\n| --- | --- |\n| Tea | 2 |"]
    assert text[2] == "Own" and marked[2] == "# Own"


def test_warnings_of_pictures(spark):
    html = f'<img src="{PICTURE}" alt="a" data-alt-source="ai:x"><img src="{PICTURE}" alt="b" data-alt-source="pdf"><img src="https://e.example/x.png" alt=""><img src="{PICTURE}">'
    assert run(spark, "clean_warnings", "ord", "warning", "n", pages=(HTML_PAGES, [(1, "u", html)])) == [(1, "no description", 1), (2, "description by a model", 1), (3, "recovered description", 1), (7, "pictures dropped", 1)]


def test_pictures_and_tables_of_pages_are_checked(spark):
    html = ("<p>x</p><img src='a.png' title=' alt=\"no\"'><img src=b alt=plain data-needs-alt data-alt-source='pdf'><img alt='' role=presentation><IMG ALT=\"A &amp; b\" data-alt-source=\"ai:x\" />"
            "<table><caption>Cap</caption><tr><th>H</th></tr><tr><td>one<table><tr><td>in</td></tr></table>late</td></tr></table>after")
    pages = ("page_id long, url string, html string", [(1, "https://h.example/", html), (2, None, None), (None, "x", "<img>")])
    parts = run(spark, "parts_extract", "doc_id", "kind", "ordinal", "text", pages=pages)
    assert [p[2:] for p in parts if p[:2] == (1, "picture")] == [(1, ""), (2, "plain"), (3, ""), (4, "A & b")]
    assert [p[2:] for p in parts if p[:2] == (1, "table")] == [(1, "CapHone"), (2, "in")]
    found = run(spark, "page_findings", "doc_id", "key", "ordinal", pages=pages)
    own = {(k, o) for i, k, o in found if i == 1 and k not in ("title", "lang")}
    assert own == {("picture", 1), ("recovered_picture", 2), ("ai_picture", 4), ("table_header", 2), ("table_caption", 2)}
    assert (None, "picture", 1) in found


ISSUES = "origin string, doc_id long, key string, severity string, kind string, ordinal long, detail string"


def test_diff_knows_findings_by_kind_place_and_detail(spark):
    row = lambda i, key, ordinal, detail="", kind="link", origin="page": (origin, i, key, "fix", kind, ordinal, detail)
    before = [row(1, "link_vague", 1, "here"), row(1, "picture", 1, kind="picture"), row(10**9 + 1, "lang", 0), row(None, "title", 0)]
    now = [row(1, "link_vague", 1, "more"), row(1, "picture", 1, kind="picture"), row(10**9 + 1, "lang", 0, origin="extract"), row(None, "title", 0)]
    got = run(spark, "issues_diff", "origin", "doc_id", "key", "detail", "change", checked_before=(ISSUES, before), checked_now=(ISSUES, now))
    want = [("page", 1, "link_vague", "here", "resolved"), ("page", 1, "link_vague", "more", "new"), ("page", 1, "picture", "", "kept"), ("page", 10**9 + 1, "lang", "", "resolved"),
            ("extract", 10**9 + 1, "lang", "", "new"), ("page", None, "title", "", "kept")]
    assert got == sorted(want, key=repr)


def test_outline_names_links_pictures_and_tables(spark):
    html = ("<h2>Head <a href='https://x.example/" + "a" * 150 + "'>link</a></h2>loose<p>One<br>two <a href='data:x'>no</a></p><ul><li><p>item</p><p>second</p></li></ul>"
            "<figure><img src=a alt=' A  cat ' data-alt-source='ai:x'><img src=b alt='' role='presentation'><img src=c><figcaption><p>Under</p></figcaption></figure>"
            "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><p>in</p>left</td><td></td></tr>stray</table><td>x</td><dl><dt>T</dt><dd><p>D</p></dd></dl>end")
    pages = ("page_id long, url string, html string", [(1, "u", html), (2, "u", None)])
    lines = [r[1:] for r in sorted(run(spark, "outline_lines", "line_no", "label", "text", pages=pages))]
    assert lines == [
        ("Heading level 2", "Head link (link to https://x.example/" + "a" * 102 + ")"), ("Text", "loose"), ("Paragraph", "One two no"), ("List item", "item"), ("Paragraph", "second"),
        ("Picture 1, described as", "A cat (this description was written by AI and has not been checked by a sighted person)"), ("", "Picture 2, marked decorative, no description."), ("", "Picture 3, no description."), ("Caption", "Under"),
        ("", "Table starts."), ("Header row", "A, B"), ("Paragraph", "in"), ("Row", "1, left, "), ("Text", "stray"), ("", "Table ends, 2 rows and 3 columns."),
        ("Term", "T"), ("Definition", "D"), ("Text", "end")]
    assert run(spark, "word_counts", pages=pages) == [(1, 14, 18)]
    cut = sorted(run(spark, "first_words", "line_no", "text", pages=pages, fx_word_limit=("words int", [(7,)])))
    assert [t for _, t in cut] == ["Head link (link to https://x.example/" + "a" * 102 + ")", "loose", "One"]


def test_metas_in_any_order(spark):
    html = "<html lang=en-GB><head><meta content='A > \"B\"' name=\"Author\"><META NAME=description CONTENT=short><meta charset=utf-8><meta name='author' content=' last '/><title>T &amp;\n t</title></head><body><meta name=author content=no>"
    pages = ("page_id long, html string", [(1, html), (2, None), (3, "")])
    assert run(spark, "page_metadata", "page_id", "title", "lang", "author", "subject", "metas", pages=pages)[0] == (1, "T & t", "en-GB", "last", "short", 4)
    assert run(spark, "page_meta_pairs", "page_id", "name", "content", pages=pages) == [(1, "author", " last "), (1, "description", "short")]


def test_drawn_marks_count_where_none_is_written(spark):
    lines = (LINES, [line(0, "plain"), line(1, "1. one"), line(2, "far")])
    shapes = (SHAPES, [(1, 0, 60.0, 64.0, 2.0, 6.0), (1, 0, 60.0, 64.0, 12.0, 16.0), (1, 0, 20.0, 24.0, 22.0, 26.0), (1, 1, 60.0, 64.0, 22.0, 26.0)])
    assert run(spark, "list_markers", "line", "marker", "text", fx_lines=lines, fx_line_shapes=shapes) == [(0, "ul", "plain"), (1, "ol", "one")]


def test_spans_merge_by_all_five_formats(spark):
    spans = "doc_id long, page int, block int, line int, span int, text string, bold boolean, italic boolean, mono boolean, superscript boolean, x0 double, x1 double, y0 double, y1 double"
    row = lambda li, i, text, bold=False, mono=False, sup=False, x=0.0, block=0: (1, 0, block, li, i, text, bold, False, mono, sup, x, x + 10, 0.0, 10.0)
    rows = [row(0, 0, "a"), row(0, 1, "b", x=50.0), row(0, 2, ""), row(0, 3, "c", x=52.0), row(0, 4, "d", mono=True), row(0, 5, "e", mono=True, sup=True), row(0, 6, "f", bold=True), row(1, 0, "Head", bold=True, block=1), row(1, 1, " line", block=1)]
    level = ("doc_id long, page int, block int, level int, text string", [(1, 0, 0, None, ""), (1, 0, 1, 2, "Head line")])
    rects = ("doc_id long, page int, link_id int, uri string, x0 double, y0 double, x1 double, y1 double", [(1, 0, 2, "second", 40.0, 0.0, 99.0, 20.0), (1, 0, 1, "first", 40.0, 0.0, 70.0, 20.0)])
    got = run(spark, "span_merge", "line", "run_id", "bold", "mono", "superscript", "link", "text", fx_formatted_spans=(spans, rows), leveled=level, fx_link_rects=rects)
    assert got == [(0, 1, False, False, False, "", "a"), (0, 2, False, False, False, "first", "bc"), (0, 3, False, True, False, "", "d"), (0, 4, False, True, True, "", "e"), (0, 5, True, False, False, "", "f"), (1, 1, False, False, False, "", "Head line")]


def test_metadata_of_imports(spark):
    docs = [document(1, title=" "), document(2, title="T"), document(3, title="")]
    docs = [(*x[:3], "", *x[4:]) for x in docs]
    level = ("doc_id long, page int, block int, level int, text string", [(1, 1, 0, 2, "later"), (1, 0, 9, 2, " First  one "), (1, 0, 1, 3, "lower"), (1, 0, 0, None, "text")])
    frames = {"leveled": level, "guesses": ("doc_id long, guess string", [(1, "es"), (2, "")]), "fx_doc_info": ("doc_id long, author string, subject string", [(1, " me ", None)])}
    assert run(spark, "import_metadata", "doc_id", "title", "author", "subject", "lang", fx_docs=(DOCS, docs), **frames) == [(1, "First one", "me", "", "es"), (2, "T", "", "", ""), (3, "", "", "", "")]


def test_numbers_come_from_styles_and_names(spark):
    styles = ("doc_id long, style_id int, base_id int, outline_lvl int, style_name string", [(1, 1, None, None, "Base"), (1, 2, 1, None, "List Bullet 3"), (1, 3, 2, None, "Mine")])
    nums = {"fx_style_nums": ("doc_id long, style_id int, num_id int, ilvl int", [(1, 1, 7, None)]), "fx_nums": ("doc_id long, num_id int, abstract_id int", [(1, 7, 1), (1, 8, 1), (1, 9, 2)]),
            "fx_num_overrides": ("doc_id long, num_id int, ilvl int, seq int, fmt string", [(1, 8, 2, 0, "none")]),
            "fx_abstract_nums": ("doc_id long, abstract_id int, ilvl int, fmt string", [(1, 1, 0, "bullet"), (1, 1, 2, "decimal"), (1, 2, 0, None)])}
    paras = ("doc_id long, para int, style_id int, num_id int, ilvl int, text string, outline_lvl int", [(1, i, s, n, lv, "x", None) for i, (s, n, lv) in enumerate([(2, None, None), (3, None, None), (1, None, None), (1, 8, 2), (1, 9, None), (1, 5, 1), (None, None, None), (2, 0, 0)])])
    assert run(spark, "numbering_kind", "para", "tag", "level", fx_styles=styles, fx_doc_paragraphs=paras, **nums) == [(0, "ol", 2), (1, "ul", 0), (2, "ul", 0), (3, "ol", 2), (4, "ol", 0), (5, "ul", 1)]


def test_context_of_pictures_and_their_sources(spark):
    blocks = ("doc_id long, ordinal int, level int, text string", [(1, 1, 2, " Head "), (1, 2, None, "x" * 500), (1, 3, None, " "), (1, 5, 3, " ")])
    pictures = ("doc_id long, ordinal int, alt string, alt_source string", [(1, 1, "a", "ai:x"), (1, 4, " ", ""), (1, 5, "b", ""), (2, 1, "c", "pdf")])
    assert run(spark, "picture_context", "doc_id", "ordinal", "heading", "before", fx_blocks=blocks, fx_pictures=pictures) == [(1, 1, "Head", "Head"), (1, 4, "Head", "x" * 400), (1, 5, "Head", "x" * 400), (2, 1, "", "")]
    got = run(spark, "alt_provenance", "source", "ai", "recovered", "human", "missing", fx_pictures=pictures, fx_sources=("doc_id long, source string", [(1, "s")]))
    assert got == [("", 0, 1, 0, 0), ("s", 1, 0, 1, 1)]


def test_scanned_pages_hold_no_tables_and_were_not_read(spark):
    kinds = ("doc_id long, page int, kind string", [(1, 1, "scanned"), (1, 2, "scanned"), (2, 1, "scanned"), (2, 2, "scanned"), (2, 3, "blank"), (3, 1, "blank")])
    where = "doc_id long, page int"
    got = run(spark, "scanned_documents", "doc_id", "scanned_pages", "is_scanned", "some_scanned", "nothing", page_kinds=kinds, fx_table_boxes=(where, [(2, 1), (2, 1)]), fx_recognised=(where, [(2, 3)]))
    assert got == [(1, 2, True, False, False), (2, 1, False, True, False), (3, 0, False, False, True)]


def test_warnings_of_an_import_follow_the_way_it_was_read(spark):
    """Document 1 is read from its tags, 2 is tagged but read from the layout, 3 has no tags, 4 is pictures, 5 is empty."""
    where, kinds = "doc_id long, page int", [(1, 1, "garbled"), (2, 1, "garbled"), (2, 2, "garbled"), (2, 3, "text"), (3, 1, "scanned"), (3, 2, "text"), (4, 1, "scanned"), (5, 1, "blank")]
    pictures = [(i, p, o, True) for i, p, o in [(1, 1, 1), (2, 1, 1), (2, 1, 2), (2, 3, 1), (3, 2, 1)]]
    got = run(
        spark, "import_warnings", "doc_id", "ord", "warning", "n", "detail",
        fx_fields=("doc_id long, field_id int", [(1, 1), (1, 2), (3, 1)]),
        fx_elems=("doc_id long, elem_id int", [(1, 1), (1, 2), (2, 1)]),
        coverage=("doc_id long, ratio double, use_tags boolean", [(1, 1.0, True), (2, 0.5, False), (3, 1.0, True)]),
        fx_marks=("doc_id long, in_tagged boolean", [(1, True), (1, False), (1, False), (2, False)]),
        fx_pictures=("doc_id long, page int, ordinal int, in_tagged boolean", pictures),
        # page 3 of document 2 has no descriptions, which is no mismatch; a blank one is used but not counted
        fx_figure_alts=("doc_id long, page int, seq int, alt string", [(1, 1, 1, "a"), (1, 1, 2, " "), (2, 1, 1, "b"), (2, 1, 2, " ")] + [(3, p, 1, "c") for p in range(11, 0, -1)]),
        fx_recognised=(where, [(2, 2), (2, 2)]),
        page_kinds=("doc_id long, page int, kind string", kinds),
        furniture=("doc_id long, key string, pages long", [(1, "k", 2), (2, "k", 2), (2, "m", 3)]),
        dropped_lines=("doc_id long, dropped long, examples string", [(1, 2, "K"), (2, 5, "K | M")]),
        fx_table_boxes=(where, [(1, 1), (2, 2), (2, 3), (2, 3)]),
        fx_control_texts=("doc_id long, text string", [(1, "a\x07\x08"), (2, "a"), (9, None)]),
    )
    assert got == sorted(
        [
            (1, 1, "fields", 2, ""), (1, 2, "read from the tags", 1, ""), (1, 3, "decoration left out", 2, ""), (1, 4, "descriptions from the tags", 1, ""),
            (1, 15, "control characters removed", 2, ""),
            (2, 5, "tagged, but rebuilt from the layout", 1, ""), (2, 6, "pages read by recognition", 1, ""), (2, 7, "garbled pages", 1, ""),
            (2, 8, "running lines left out", 2, "K | M"), (2, 9, "tables rebuilt", 2, ""), (2, 13, "descriptions from the tags", 1, ""),
            (3, 1, "fields", 1, ""), (3, 11, "some pages are pictures", 1, ""), (3, 13, "descriptions from the tags", 1, ""),
            (3, 14, "descriptions did not match", 10, "1, 3, 4, 5, 6, 7, 8, 9"),
            (4, 10, "all pages are pictures", 1, ""), (5, 12, "nothing on any page", 1, ""),
        ],
        key=repr,
    )


def test_overrides_of_numbers_are_by_level_and_document(spark):
    nums = {
        "fx_styles": ("doc_id long, style_id int, base_id int, outline_lvl int, style_name string", []),
        "fx_style_nums": ("doc_id long, style_id int, num_id int, ilvl int", []),
        # both documents have a number 1, of other abstract numbers
        "fx_nums": ("doc_id long, num_id int, abstract_id int", [(1, 1, 1), (2, 1, 1), (2, 2, 9)]),
        "fx_num_overrides": ("doc_id long, num_id int, ilvl int, seq int, fmt string", [(1, 1, 1, 0, None), (1, 1, 1, 1, "bullet"), (1, 1, 1, 2, "decimal"), (1, 1, 2, 0, None), (3, 1, 0, 0, "bullet")]),
        "fx_abstract_nums": ("doc_id long, abstract_id int, ilvl int, fmt string", [(1, 1, 0, "decimal"), (1, 1, 1, "decimal"), (1, 1, 2, "lowerRoman"), (2, 1, 0, "bullet"), (2, 1, 1, "decimal")]),
    }
    paras = [(1, 0, 1, 0), (1, 1, 1, 1), (1, 2, 1, 2), (1, 3, 1, 3), (2, 0, 1, 0), (2, 1, 1, 1), (2, 2, 2, 0), (3, 0, 1, 0), (3, 1, 0, 0)]
    frame = ("doc_id long, para int, style_id int, num_id int, ilvl int, text string, outline_lvl int", [(i, p, None, n, lv, "x", None) for i, p, n, lv in paras])
    got = run(spark, "numbering_kind", "doc_id", "para", "tag", fx_doc_paragraphs=frame, **nums)
    assert got == [(1, 0, "ol"), (1, 1, "ul"), (1, 2, "ol"), (1, 3, "ul"), (2, 0, "ul"), (2, 1, "ol"), (2, 2, "ul"), (3, 0, "ul")]


def test_a_stored_view_is_a_table_before_the_rounds_that_read_it(spark, monkeypatch):
    """Structure trees and fields read the table of parts, and do not work it out anew."""
    read = {}
    for name in ("elem_docs", "field_tips"):
        made = registry.BUILT[name]

        def noted(made=made, **frames):
            read.update({k: df.inputFiles() for k, df in frames.items()})
            return made(**frames)

        noted.reads = made.reads
        monkeypatch.setitem(registry.BUILT, name, noted)
    part = spark.createDataFrame([(1, "a name", 3, "t", "b")], "p_partkey long, p_name string, p_size int, p_type string, p_brand string")
    item = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate date"
    rows = spark.createDataFrame([(i, 1, i, 1, 1.0, 2.0, "N", None) for i in range(1, 20)], item)
    assert [tuple(r) for r in registry.apply(spark, "report_gate", part=part, lineitem=rows).select("doc_id", "gate").collect()] == [(1, False)]
    assert all(read[k] and all("marginalia-" in f for f in read[k]) for k in ("fx_elems", "fx_annots"))


def test_counts_of_a_report_are_those_of_its_checks(spark):
    """Headings by steps of their levels in order, the text of the first 40 pages; all as sums, without a window over a document's rows."""
    kinds = {1: ["/H1", "/H2", "/P", "/H3"], 2: ["/P", "/H2", "/H3"], 3: ["/H1", "/H3", "/H6", "/H1", "/H4"], 4: ["/P"], 5: ["/H1", "/P", "/P", "/H2", "/H1"]}
    elems = [(i, 9 - k if i == 3 else k, None, kind, "", None) for i, ks in kinds.items() for k, kind in enumerate(ks)]
    texts = {1: ["a b", None, "\ufffd c"], 2: [None, None], 3: [" "], 4: ["x"] * 40 + ["\ufffd" * 99], 5: ["\ufffd", "\x01 abc", ""]}
    pages = [(i, p, 1, 0, 0, 0, "/S", t) for i, ts in texts.items() for p, t in enumerate(ts, 1)]
    docs = "doc_id long, readable boolean, marked boolean, lang string, display_title boolean, xmp_title string, info_title string, part_id string, outline boolean, suspects boolean, xfa boolean, encrypted boolean, allow_access boolean, allow_extract boolean"
    frames = {
        "fx_docs": (docs, [(i, True, True, "es", True, "t", "t", "1", True, False, False, False, True, True) for i in kinds]),
        "fx_elems": ("doc_id long, elem_id int, parent_id int, kind string, alt string, actual_text string", elems),
        "fx_pdf_pages": ("doc_id long, page int, chars int, images int, untagged int, unmarked int, tabs string, text string", pages),
        "headed_tables": ("doc_id long, elem_id int, th long", []),
        "field_tips": ("doc_id long, annot_id int, named boolean", []),
        "fx_rolemap": ("doc_id long, from_kind string, to_kind string", []),
        "fx_fonts": ("doc_id long, font_id int, font_name string, subtype string, has_file boolean, has_tounicode boolean, encoding string", []),
        "fx_annots": ("doc_id long, page int, annot_id int, subtype string, has_struct_parent boolean, contents string", []),
    }
    made = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in frames.items()}
    columns = ["doc_id", "key", "passed", "bad", "total"]
    report = registry.apply(spark, "report_union", **made).select(columns)
    for key in ("headings", "garbled", "figures", "lbody", "text"):
        alone = registry.apply(spark, f"chk_{key}", **{k: v for k, v in made.items() if k in ("fx_docs", "fx_elems", "fx_pdf_pages")}).select(columns)
        assert sorted(report.filter(f"key = '{key}'").collect()) == sorted(alone.collect())
    assert {r["doc_id"]: r["bad"] for r in report.filter("key = 'headings'").collect()} == {1: 0, 2: 1, 3: 5, 4: 0, 5: 0}
    assert "Window" not in report._jdf.queryExecution().sparkPlan().toString()


def test_what_warnings_of_an_import_share_is_worked_out_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(registry, "_sql", lambda spark, body, inputs, f=registry._sql: made.append(body) or f(spark, body, inputs))
    registry.queries()["import_warnings"](spark, "/root/testdata/sf0.001")
    shared = ("fx_recognised", "page_kinds", "picture_pages", "tagged_counts", "import_ways")
    assert [made.count(f"select * from {name}") for name in shared] == [1] * 5


def tables_of_parts(spark):
    part = [(i, f"name {i}", i, "t", "b") for i in range(12)]
    item = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate date"
    rows = [(i % 7, i % 13, i, i // 7, 1.0, 2.0, "N", None) for i in range(60)]
    return {"part": spark.createDataFrame(part, "p_partkey long, p_name string, p_size int, p_type string, p_brand string"), "lineitem": spark.createDataFrame(rows, item)}


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def kept_columns(monkeypatch) -> list:
    """The columns of each table that lies by a key, as they are written."""
    found = []
    monkeypatch.setattr(registry, "saved", lambda df, by=None, f=registry.saved: (found.append((by, df.columns)) if by else None) or f(df, by))
    return found


def test_places_of_findings_are_not_shuffled_and_share_their_texts(spark, monkeypatch):
    """Only tables meet the text of their cells over a shuffle; places that repeat give each finding each text, those without an id none."""
    frames = {
        "page_issues": ("doc_id long, key string, severity string, kind string, ordinal long, detail string", [(7, "picture", "fix", "picture", 1, "")]),
        "page_parts": ("doc_id long, kind string, ordinal long, level int, text string, mark string, n_th long, has_caption boolean", [(7, "picture", 1, None, " a  b ", "", None, None), (7, "link", 1, None, "x", "", None, None)]),
    }
    made = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in frames.items()}
    kept = kept_columns(monkeypatch)
    df = registry.apply(spark, "issue_locator", **tables_of_parts(spark), **made)
    # two for the pages' parts, three for the tables (findings of either kind, and cells)
    assert kept == [("doc_id", ["doc_id", "ord", "pk", "sk", "name"])] and shuffles(df) <= 5
    assert df.filter("origin = 'page'").count() == 1 and df.filter("origin = 'extract'").count() > 20
    frames |= {
        "fx_headings": ("doc_id long, ordinal int, level int, text string", [(1, 1, 2, " Two "), (1, 1, 2, "Other"), (1, 2, 4, "x" * 90), (None, 1, 3, "n"), (2, None, 3, "n"), (2, 1, 1, "fine")]),
        "fx_pictures": ("doc_id long, ordinal int, alt string, has_alt boolean, needs_alt boolean, alt_source string", [(1, 1, None, False, False, ""), (1, 1, "other", True, False, ""), (2, 1, "fine", True, False, ""), (None, 1, "", False, False, "")]),
        "fx_links": ("doc_id long, ordinal int, text string", [(1, 1, " Click \n here. "), (1, 2, None), (1, 3, " "), (1, 4, "a good one")]),
        "fx_tables": ("doc_id long, ordinal int, n_th long, has_caption boolean", [(1, 1, 0, False), (1, 2, 1, False), (2, 1, 0, True), (3, 1, 2, True)]),
        "fx_cells": ("doc_id long, tbl int, r int, c int, text string", [(1, 1, 1, 0, " third"), (1, 1, 0, 1, "second "), (1, 1, 0, 0, "first"), (2, 1, 0, 0, None), (3, 1, 0, 0, "no finding")]),
    }
    got = run(spark, "issue_locator", "origin", "doc_id", "key", "kind", "ordinal", "text", **frames)
    assert got == sorted(
        [
            ("page", 7, "picture", "picture", 1, "a b"),
            *[("extract", 1, "first_heading", "heading", 1, text) for text in ("Two", "Other")], ("extract", 1, "heading_skip", "heading", 2, "x" * 80),
            ("extract", 1, "picture", "picture", 1, ""), ("extract", 1, "picture", "picture", 1, "other"),
            ("extract", 1, "link_vague", "link", 1, "Click here."), ("extract", 1, "link_empty", "link", 3, ""),
            ("extract", 1, "table_header", "table", 1, "first second third"), ("extract", 1, "table_caption", "table", 1, "first second third"), ("extract", 2, "table_header", "table", 1, None),
        ],
        key=repr,
    )


def test_numbers_are_found_without_a_shuffle(spark, monkeypatch):
    kept = kept_columns(monkeypatch)
    df = registry.apply(spark, "numbering_kind", **tables_of_parts(spark))
    assert kept == [("doc_id", ["doc_id", "ord", "pk", "sk"])]
    assert df.count() > 20 and shuffles(df) == 0


def test_numbers_of_long_chains_rings_and_repeated_rows(spark):
    """The nearest of twelve styles; rings end; of rows that repeat a style the largest number and level count, and each makes a row."""
    chain = [(1, i, i + 1, None, "Base") for i in range(1, 14)]
    styles = ("doc_id long, style_id int, base_id int, outline_lvl int, style_name string", [*chain, (2, 1, 2, None, "List Number 4"), (2, 2, 1, None, "x"), (3, 1, 2, None, "a"), (3, 1, 3, None, "List Bullet 2"), (3, 2, None, None, "b"), (3, 3, None, None, "c")])
    nums = {
        "fx_style_nums": ("doc_id long, style_id int, num_id int, ilvl int", [(1, 13, 5, 1), (3, 2, 4, 2), (3, 3, 6, None), (2, 7, 1, 1)]),
        "fx_nums": ("doc_id long, num_id int, abstract_id int", [(1, 5, 1), (3, 6, 1), (3, 6, 2), (None, 5, 1)]),
        "fx_num_overrides": ("doc_id long, num_id int, ilvl int, seq int, fmt string", [(3, 6, 2, None, "decimal")]),
        "fx_abstract_nums": ("doc_id long, abstract_id int, ilvl int, fmt string", [(1, 1, 1, "decimal"), (3, 1, 2, "bullet"), (3, 2, 2, None)]),
    }
    paras = [(1, 1, 1, None, None), (1, 2, 2, None, None), (2, 1, 1, None, None), (3, 1, 1, None, None), (None, 1, 1, 5, 3), (4, 1, 1, 5, None), (4, 2, 1, None, 1)]
    frame = ("doc_id long, para int, style_id int, num_id int, ilvl int, text string, outline_lvl int", [(i, p, s, n, lv, "x", None) for i, p, s, n, lv in paras])
    got = run(spark, "numbering_kind", "doc_id", "para", "tag", "level", fx_styles=styles, fx_doc_paragraphs=frame, **nums)
    # document 3: two rows of the style, and two of number 6
    assert got == sorted([(1, 2, "ol", 1), *[(3, 1, t, 2) for t in ("ul", "ol") * 2], (None, 1, "ul", 3), (4, 1, "ul", 0)], key=repr)


def test_boxes_of_a_page_are_counted_beside_its_sizes(spark, monkeypatch):
    """Replies of one page are joined with the items of all of them, and boxes with those of their number, of each size that keeps them."""
    box, wide, bad = '{"rect":[10,10,60,30]}', '{"rect":[10,10,500,30]}', '{"rect":["x",1,2,3]}'
    replies = (REPLIES, [(1, 1, f"[{box},{wide},{bad}]"), (1, 1, f"[{box}]"), (1, 2, f"[{box},7,{wide}]"), (2, 1, f"[{box}]"), (3, 1, "none"), (3, 1, None), (None, 1, f"[{box}]"), (4, None, f"[{box}]")])
    sizes = [(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0), (1, 2, 50.0, 300.0), (1, 2, 0.0, 800.0), (None, 1, 600.0, 800.0), (4, None, 600.0, 800.0), (5, 1, 600.0, 800.0)]
    got = run(spark, "model_box_counts", "doc_id", "page", "offered", "kept", fx_replies=replies, fx_form_pages=(SIZES, sizes))
    # page 1: two items of number 1 and two boxes of it, for each of two replies; page 2: two sizes keep the first box, both the wide one
    assert got == sorted([(1, 1, 12, 10), (1, 2, 5, 4), (2, 1, 1, 0), (3, 1, 0, 0), (None, 1, 0, 0), (4, None, 0, 0)], key=repr)
    kept = kept_columns(monkeypatch)
    df = registry.apply(spark, "model_box_counts", **tables_of_parts(spark))
    assert kept == [("doc_id", ["doc_id", "ord", "pk", "sk", "qty", "name", "psize"])]
    # replies meet sizes once: one shuffle each
    assert df.count() > 20 and shuffles(df) <= 2
