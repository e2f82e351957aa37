from tidewater.llm import lines

LONG = "one two three four five six"


def test_templates_generalise_variable_fields():
    assert lines.template(b"user 17 from a@b.c logged in now") == lines.template(b"user  99 from x@y.z logged in now")
    assert lines.template(b"2024-01-02 10:11 10.0.0.1 GET /a1 200") == lines.template(b"2025-03-04 12:13 10.0.0.2 GET /b2 404")
    assert lines.template(b"1 2 3 4 5") != lines.template(b"1 2 3 5 5")  # data, not a pattern
    assert lines.template(b" \t") is None


def test_first_document_keeps_its_lines(frame):
    docs = frame((2, f"{LONG}\nown line of document two\n{LONG}"), (1, f"intro of the first one\n{LONG}\n{LONG}"), (3, LONG), (4, f"Les.\n{LONG} 1\n"), (5, f"Les.\n{LONG} 2\nx"), extra="dropped")
    got = {r.doc_id: (r.text, list(r.dropped_lines)) for r in lines.dedup_lines(docs).collect()}
    assert got == {1: (f"intro of the first one\n{LONG}\n{LONG}", []), 2: ("own line of document two", [0, 2]), 3: ("", [0]), 4: (f"Les.\n{LONG} 1\n", []), 5: ("x", [0, 1])}
    kept = lines.drop_repeated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert {r.doc_id: r.n_chars for r in kept.collect()}[2] == len("own line of document two")


def test_nulls_empties_and_repeated_rows(frame):
    docs = frame((1, None), (2, ""), (3, LONG), (3, LONG), (None, LONG), (None, f"{LONG} seven"), (None, None))
    got = sorted(((r.doc_id or 99), r.text, list(r.dropped_lines)) for r in lines.dedup_lines(docs).collect() if r.text is not None)
    assert got == [(2, "", []), (3, LONG, []), (3, LONG, []), (99, "", [0]), (99, f"{LONG} seven", [])]
    assert lines.drop_repeated(docs).count() == 6
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_recur_too_in_the_pipeline(frame):
    docs = frame((1, "Les.\nown words of one\n\nAll rights reserved."), (2, "Les.\nown words of two\n\nAll  rights reserved."), (3, "Page 3\n\n}"), (4, "Page 4\nmore"), (5, "Les."))
    got = {r.doc_id: r.text for r in lines.drop_repeated(docs).collect()}
    assert got == {1: "Les.\nown words of one\n\nAll rights reserved.", 2: "own words of two\n", 3: "Page 3\n\n}", 4: "more"}


def test_clashing_columns(frame):
    docs = frame((1, LONG), (2, f"{LONG}\nown"), extra="dropped_lines")
    kept = lines.drop_repeated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: (r.text, r.dropped_lines) for r in kept.collect()} == {r.doc_id: ({1: LONG, 2: "own"}[r.doc_id], r.dropped_lines) for r in docs.collect()}
    assert {r.doc_id: list(r.dropped_lines) for r in lines.dedup_lines(docs).collect()} == {1: [], 2: [0]}
