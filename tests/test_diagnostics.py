from loomlight.operators import diagnostics as D
from tests.conftest import rows

TAIL = "\n# Stopped early.\n# See above.\n\nNothing done!\n"


def parse(spark, text):
    logs = spark.createDataFrame([("log", text)], "log_id string, text string")
    found = D.diagnostics_a(logs).orderBy("seq").collect()
    return [(r.type, r.file, tuple(r.start), tuple(r.end), r.message) for r in found]


def test_positioned_finding_between_other_text(spark):
    log = (
        "\nError processing file: ../pump.mo\n"
        "[/work/plant/pump.mo:4:3-4:19:writable] "
        "Error: No valve of this name near pump.\n"
        "Error: Error while reading pump\n" + TAIL
    )
    assert parse(spark, log) == [
        ("Error", "/work/plant/pump.mo", (4, 3), (4, 19),
         "No valve of this name near pump.")
    ]


def test_message_with_a_colon(spark):
    log = "[/a/r.mo:1:6-12:11:writable] Error: Name clash: two parts are called tank\n" + TAIL
    assert parse(spark, log)[0][4] == "Name clash: two parts are called tank"


def test_hyphens_start_lines_and_quotes_inside_stay(spark):
    log = (
        "[/a/r.mo:9:2-9:80:writable] Error: Cannot join: pipe(in, out)\n"
        '- in carries flow(limit = 2.0, unit = "bar")\n- out carries {q, t}\nError: Stopped\n'
    )
    assert parse(spark, log)[0][4] == (
        'Cannot join: pipe(in, out)\n- in carries flow(limit = 2.0, unit = "bar")\n- out carries {q, t}'
    )


def test_several_findings_keep_their_order(spark):
    log = "".join(
        f"    [/srv/my lib/Pipes {n}.0/package.mo:{n}:1-46:15:readonly] Error: Teil B{n} ohne Länge.\n"
        for n in range(1, 4)
    )
    found = parse(spark, '"Notice: read before."\n' + log + "Error: Error occurred\n" + TAIL)
    assert [f[1] for f in found] == [f"/srv/my lib/Pipes {n}.0/package.mo" for n in range(1, 4)]
    assert [f[4] for f in found] == [f"Teil B{n} ohne Länge." for n in range(1, 4)]


def test_text_between_findings_does_not_end_the_list(spark):
    log = "[/a.mo:1:1-1:2:writable] Error: one\n# note\n[/b.mo:1:1-1:2:writable] Warning: two\n"
    assert [(f[0], f[4]) for f in parse(spark, log)] == [("Error", "one"), ("Warning", "two")]


def test_quoted_findings_lose_the_dangling_quote(spark):
    log = 'no\n"later"\n"[/a/build.mos:5:1-5:30:writable] Error: Teil <oben> (y) unbekannt."\n'
    assert parse(spark, log) == [
        ("Error", "/a/build.mos", (5, 1), (5, 30), "Teil <oben> (y) unbekannt.")
    ]


def test_processed_file_without_position(spark):
    log = (
        "\nError processing file: /work/plant/BoilerCheck.mo\n"
        "Notice: library Pipes 1.0 was read first.\n"
        "Error: Kessel überfüllt - kein Ausgleich. Es fehlen 3 Ventil(e) und 2 Rohr(e).\n"
        "Error: step two was not tried.\n" + TAIL
    )
    assert parse(spark, log) == [
        ("Error", "/work/plant/BoilerCheck.mo", (0, 0), (0, 0),
         "Kessel überfüllt\n- kein Ausgleich. Es fehlen 3 Ventil(e) und 2 Rohr(e).")
    ]


def test_bare_errors_but_not_the_escaped_one(spark):
    log = '""\n\\"Error: Pipes could not be read.\nError: Teil K ist nicht in <OBEN>.\n\\"\n'
    assert parse(spark, log) == [("Error", "", (0, 0), (0, 0), "Teil K ist nicht in <OBEN>.")]
    assert [f[4] for f in parse(spark, "Error: one.\nError: two.\n")] == ["one.", "two."]
    # A quoted error after another one is a word like any other, so it stays in the message.
    assert [f[4] for f in parse(spark, 'Error: one.\n"Error: two."\n')] == ['one. "Error: two.']


def test_no_error_no_rows_and_unreadable_logs(spark):
    assert parse(spark, "[/a.mo:1:1-1:2:writable] Warning: only this\n") == []
    assert parse(spark, "true\nfalse") == []
    found = parse(spark, "Errors #1")
    assert found == [("Error", "", (0, 0), (0, 0), "Couldn't understand compiler:\nErrors #1")]


def test_windows_paths_get_one_separator(spark):
    for raw in ("C:\\n\\d\\t.mo", "C:\\n\\/d\\/t.mo", "C:/n//d/t.mo"):
        log = f'"[{raw}:2:7-4:8:writable] Error: Odd sign\nError: Nothing was read\n"'
        assert [(f[1], f[4]) for f in parse(spark, log)] == [("C:/n/d/t.mo", "Odd sign")]


def test_long_logs_do_not_overflow(spark):
    words = "word " * 200_000
    found = parse(spark, f"[/a.mo:1:1-1:2:writable] Error: {words}")
    assert len(found) == 1 and found[0][4] == words.strip()
    assert len(parse(spark, "noise " * 200_000 + "Error: end")) == 1


def test_second_dialect(spark):
    log = (
        "Warning: in file '/a.mo':\nAt line 3, column 4:\n  odd thing\n\n"
        "Error: in file '/b.mo':\nSyntax error at line 1, column 2:\n   bad thing\n"
    )
    logs = spark.createDataFrame([("log", log)], "log_id string, text string")
    found = D.diagnostics_b(logs).orderBy("part", "seq").collect()
    assert [(r.type, r.file, tuple(r.start), tuple(r.end), r.message) for r in found] == [
        ("Error", "/b.mo", (1, 2), (1, 2), "bad thing"),
        ("Warning", "/a.mo", (3, 4), (3, 4), "odd thing"),
    ]


def test_scope(spark):
    kept = ["", "/p", "/p/a.mo", "/x/y.mos"]
    dropped = ["/", "/p2/a.mo", "/test.mo", "p/a.mo"]
    df = spark.createDataFrame([(f, "/p") for f in kept + dropped], "file string, root string")
    assert [r[0] for r in rows(D.project_scope_filter(df), "file")] == kept


def test_roots_may_be_written_otherwise(spark):
    rows_ = [("/p/a.mo", "/p/"), ("C:/w/a.mo", "C:\\w"), ("C:\\w\\b.mo", "C:/w/"), ("/p2/a.mo", "/p/"), ("/x/a.mo", "/")]
    df = spark.createDataFrame(rows_, "file string, root string")
    assert [r[0] for r in rows(D.project_scope_filter(df), "file")] == ["/p/a.mo", "C:/w/a.mo", "C:\\w\\b.mo", "/x/a.mo"]


def test_second_stage_is_gated(spark):
    schema = "model string, message string"
    first = spark.createDataFrame([("a", "parse")], schema)
    second = spark.createDataFrame([("a", "type"), ("b", "type"), ("c", "type")], schema)
    partial = spark.createDataFrame([("c",)], "model string")
    found = D.gated_diagnostics(first, second, partial, "model")
    assert sorted(rows(found, "model", "stage")) == [("a", 1), ("b", 2)]


def test_model_size(spark):
    text = (
        "Looked at tank.\nClass tank has 5 equation(s) and 4 variable(s).\n"
        "3 of these are trivial equation(s).\n"
    )
    reports = spark.createDataFrame([("c", text), ("c", "no report")], "corpus string, text string")
    sizes = D.model_size(reports)
    assert rows(sizes) == [("c", "tank", 5, 4, 3)]
    assert rows(D.model_size_totals(sizes, "corpus")) == [("c", 1, 5, 4, 3)]
