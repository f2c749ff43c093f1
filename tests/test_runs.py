from pyspark.sql import functions as F

from loomlight.operators import docs, records, runs
from loomlight.sources import files
from tests.conftest import rows


def test_outcomes(spark):
    report = 'record SimulationResult\n    resultFile = "/tmp/a b/ball_res.csv",\n messages = "",\nend;'
    failed = 'record\n resultFile = "",\n messages = " stopped: no step",\nend;'
    data = [
        ("ok", "", report),
        ("null", None, report),
        ("warned", "Warning: slow", report),
        ("broke", "Error: no model", report),
        ("stopped", "", failed),
        ("empty", "", "nothing"),
    ]
    found = runs.run_outcome(spark.createDataFrame(data, "run_id string, error string, result string"))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {
        "ok": ("finished", "/tmp/a b/ball_res.csv", None, None),
        "null": ("finished", "/tmp/a b/ball_res.csv", None, None),
        "warned": ("finished", "/tmp/a b/ball_res.csv", None, "Warning: slow"),
        "broke": ("failed", None, "simulating failed with: Error: no model", None),
        "stopped": ("failed", None, "stopped: no step", None),
        "empty": ("failed", None, "the result string didn't contain a 'resultFile' property", None),
    }


def test_options(spark):
    data = [
        ("a", '{"stopTime": 3, "solver": "dassl", "tolerance": 1.50, "outputFormat": "mat"}'),
        ("b", '{"x": true}'),
        ("c", '{"x": [1]}'),
        ("d", '{"x": null}'),
        ("e", "{broken"),
        ("f", "{}"),
        ("g", '{"x": "5", "y": 5}'),
    ]
    found = runs.request_options(spark.createDataFrame(data, "id string, options string"))
    forced = 'outputFormat="csv"'
    assert {r.id: (r.accepted, r.arguments) for r in found.collect()} == {
        "a": (True, [forced, 'solver="dassl"', "stopTime=3", "tolerance=1.5"]),
        "b": (False, None),
        "c": (False, None),
        "d": (False, None),
        "e": (False, None),
        "f": (True, [forced]),
        "g": (True, [forced, 'x="5"', "y=5"]),
    }


def test_result_files_keep_row_order(spark, tmp_path):
    n = 500
    data = [(r, i, f"{i * 0.01:.2f}", float(n - i)) for r in ("a", "b") for i in range(n)]
    wide = spark.createDataFrame(data, "run_id string, i int, time string, h double")
    files.write_run_results(wide, str(tmp_path / "runs"), "i")
    read = files.read_run_results(spark, str(tmp_path / "runs"))
    times = read.filter("variable = 'time'")
    assert sorted(rows(times, "run_id", "row_idx", "text")) == [(r, i, f"{i * 0.01:.2f}") for r, i, *_ in data]
    long = runs.cell_values(read)
    assert long.count() == 2 * 2 * n and rows(runs.failed_runs(long)) == []
    series = runs.run_series(long, ["run_id", "variable"], size=64).filter("variable = 'h' and run_id = 'a'")
    blocks = series.orderBy("block").collect()
    assert [v for b in blocks for v in b["values"]] == [float(n - i) for i in range(n)]
    assert max(len(b["values"]) for b in blocks) == 64
    maps = runs.variables_map(runs.run_series(long, ["run_id", "variable"], size=n))
    found = {r.run_id: r.variables for r in maps.collect()}
    assert set(found) == {"a", "b"} and set(found["a"]) == {"time", "h"}
    assert len({len(v) for v in found["a"].values()}) == 1


def test_json_types_and_inner_fields_count(spark):
    place = '{"line": 1, "column": 2}'
    texts = {
        "CompletionRequest": {
            f'{{"file": "a", "position": {place}, "word": "x"}}': True,
            '{"file": "a", "position": {}, "word": "x"}': False,
            '{"file": "a", "position": {"line": 1, "column": null}, "word": "x"}': False,
            f'{{"file": "a", "position": {place}, "word": 5}}': False,
            f'{{"file": {{"z": 1}}, "position": {place}, "word": "x"}}': False,
            '{"file": "a", "position": {"line": "1", "column": 2}, "word": "x"}': False,
        },
        "SimulationResult": {
            '{"modelName": "m", "variables": {"h": [1, 2.5], "v": []}}': True,
            '{"modelName": "m", "variables": {"h": [1, null]}}': False,
            '{"modelName": "m", "variables": {"h": 1}, "warning": null}': False,
        },
        "CompilerError": {
            f'{{"type": "Error", "file": "f", "start": {place}, "end": {place}, "message": "m"}}': True,
            f'{{"type": "Error", "file": "f", "start": {place}, "end": [], "message": "m"}}': False,
        },
    }
    for record, cases in texts.items():
        df = spark.createDataFrame([(x,) for x in cases], "json string")
        assert {r.json: r.accepted for r in records.json_ingest(df, record).collect()} == cases


def test_each_run_keeps_its_own_variables(spark, tmp_path):
    path = str(tmp_path / "runs")
    one = spark.createDataFrame([("a", 0, 0.0, 1.5), ("a", 1, 0.5, 2.5)], "run_id string, i int, time double, h double")
    two = spark.createDataFrame([("b", 0, 3.0, "0.0", None)], 'run_id string, i int, `w, ""x""` double, time string, v string')
    for wide in (one, two):
        files.write_run_results(wide, path, "i")
    assert sorted(rows(runs.cell_values(files.read_run_results(spark, path))), key=str) == [
        ("a", 0, "h", 1.5), ("a", 0, "time", 0.0), ("a", 1, "h", 2.5), ("a", 1, "time", 0.5),
        ("b", 0, "time", 0.0), ("b", 0, "v", None), ("b", 0, 'w, ""x""', 3.0),
    ]


def test_csv_cells(spark):
    lines = ["a,b", ",b", "a,", "", '"x, ""y""",2', "a,,c"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(files.csv_cells(F.col("line"))).collect()
    assert [r[0] for r in got] == [["a", "b"], ["", "b"], ["a", ""], [""], ['x, "y"', "2"], ["a", "", "c"]]


def test_cells_that_are_no_numbers_fail_their_run(spark):
    wide = spark.createDataFrame([("a", 0, "1.0"), ("b", 0, "x")], "run_id string, row_idx int, h string")
    long = runs.run_results_long(wide, ["run_id", "row_idx"])
    assert rows(runs.failed_runs(long)) == [("b",)]


def test_json_in(spark):
    data = [
        ("good", '{"kind": "Model", "name": "m", "parameters": ["a"]}'),
        ("kind", '{"kind": "Gadget", "name": "m"}'),
        ("field", '{"kind": "Model"}'),
        ("broken", '{"kind": "Model"'),
        ("type", '{"kind": "Model", "name": "m", "parameters": 3}'),
        ("null", None),
    ]
    found = records.json_ingest(spark.createDataFrame(data, "id string, json string"), "Suggestion")
    assert {r.id for r in found.filter("accepted").collect()} == {"good"}
    errors = spark.createDataFrame(
        [('{"type":"Error","file":"","start":{"line":1,"column":2},"end":{"line":1,"column":3},"message":"m"}',)],
        "json string",
    )
    row = records.json_ingest(errors, "CompilerError").filter("accepted").first()
    assert (row.record.start.line, row.record.end.column) == (1, 3)
    assert records.required_fields("Suggestion") == ["kind", "name"]
    assert records.required_fields("TypeOf") == ["name", "type"]


def test_json_out_and_in_again(spark):
    df = spark.createDataFrame([("x", "Real", None), ("y", "Real", "c")], "name string, type string, comment string")
    texts = records.json_egress(df)
    assert rows(texts)[0] == ('{"name":"x","type":"Real"}',)
    again = records.json_ingest(texts, "TypeOf")
    assert rows(again.filter("accepted").select("record.*")) == rows(df)


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("a", 2)], "item string, hits bigint")
    files.write_snapshot(df, str(tmp_path / "one"))
    assert rows(files.read_snapshot(spark, str(tmp_path / "one"), "item string, hits bigint")) == [("a", 2)]
    assert rows(files.read_snapshot(spark, None, "item string, hits bigint")) == []
    try:
        files.write_snapshot(df, str(tmp_path / "one"))
        raise AssertionError("wrote over a snapshot")
    except Exception as error:
        assert "ALREADY_EXISTS" in str(error)


def test_templates(spark):
    df = spark.createDataFrame([("x", ["1", "2"])], "name string, items array<string>")
    filled = docs.fill(F.lit("<{a}> {b} {a} {c}"), [("a", F.col("name")), ("b", docs.list_value(F.col("items")))])
    assert rows(df.select(filled)) == [("<x> <ul>1\n2</ul> x {c}",)]


def test_pages(spark, tmp_path):
    data = [("A", "about A", "r1", "h"), ("B", "", "r", "h"), ("C", "about C", "", "")]
    described = spark.createDataFrame(data, "class_name string, info string, revisions string, header string")
    members = [("A", f"A.m{i:02d}", f"member {i}" if i % 2 else None) for i in range(7)] + [("B", "B.x", None)]
    members = spark.createDataFrame(members, "class_name string, member string, comment string")
    documented = docs.class_docs(described, members, size=3)
    parts = {(r.class_name, r.block): [m.class_name for m in r.members] for r in documented.collect()}
    assert parts == {
        ("A", 0): ["A.m00", "A.m01", "A.m02"],
        ("A", 1): ["A.m03", "A.m04", "A.m05"],
        ("A", 2): ["A.m06"],
        ("C", 0): [],
    }
    pages = docs.docs_site(described, documented)
    html = {}
    for r in pages.orderBy("class_name", "part").collect():
        html[r.class_name] = html.get(r.class_name, "") + r.html + "\n"
    assert html["A"].count("<html>") == html["A"].count("</html>") == 1
    assert html["A"].count("<li>") == 7 and " - member 1</li>" in html["A"]
    assert "{" not in html["A"].replace("{ font-family", "").replace("{ margin", "")
    assert "No documentation for B" in html["B"] and "<ul></ul>" in html["C"]
    docs.write_site(pages, str(tmp_path / "site"), buckets=2)
    written = "\n".join(r.value for r in spark.read.text(str(tmp_path / "site")).collect())
    assert written.count("</html>") == 3
