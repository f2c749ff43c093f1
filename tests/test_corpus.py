from pyspark.sql import functions as F

from loomlight.functions import text as T
from loomlight.operators import corpus
from loomlight.sources import files
from tests.conftest import rows

SOURCE = """// a falling thing

model Drop "a 'falling' thing"
  type Height=Real(unit="m");
  parameter Real loss=0.8 "Part lost";
  Height h "Height";
  Speed v(start=0.0, fixed=true) "Speed";
initial equation
  h = 1;
  der(h) = v;
  when h<0 then
    reinit(v, -v);
  end when;
end Drop;
"""


def source(spark, text, file="drop.mo"):
    return spark.createDataFrame([(file, text)], "file string, text string")


def test_lines_are_numbered_from_one_and_a_last_break_opens_none(spark):
    lines = corpus.corpus_lines(source(spark, "a\n\nb\n"))
    assert rows(lines, "line_no", "line") == [(1, "a"), (2, ""), (3, "b")]
    assert rows(corpus.corpus_lines(source(spark, "a\nb")), "line") == [("a",), ("b",)]
    assert rows(corpus.corpus_lines(source(spark, ""))) == []
    assert rows(corpus.corpus_lines(source(spark, "\n")), "line") == [("",)]


def test_carriage_returns_do_not_hide_declarations(spark):
    lines = corpus.corpus_lines(source(spark, 'Real a "x";\r\nReal b;\r\n'))
    assert rows(lines, "line") == [('Real a "x";',), ("Real b;",)]
    found = corpus.extract_variables(lines)
    assert rows(found, "line_no", "name", "comment") == [(1, "a", "x"), (2, "b", None)]


def test_very_long_lines_are_whole(spark):
    line = "Real a" + " " * 200_000 + '"far away";'
    found = corpus.extract_variables(corpus.corpus_lines(source(spark, line)))
    assert rows(found, "name", "comment") == [("a", "far away")]


def test_variables_keep_keyword_rows_unless_strict(spark):
    lines = corpus.corpus_lines(source(spark, SOURCE))
    found = rows(corpus.extract_variables(lines), "line_no", "type", "name", "comment")
    assert sorted(found) == [
        (3, "model", "Drop", None),
        (4, "type", "Height", None),
        (5, "Real", "loss", "Part lost"),
        (6, "Height", "h", "Height"),
        (7, "Speed", "v", "Speed"),
        (8, "initial", "equation", None),
        (11, "when", "h", None),
        (13, "end", "when", None),
        (14, "end", "Drop", None),
    ]
    strict = rows(corpus.extract_variables(lines, strict=True), "line_no")
    assert sorted(strict) == [(5,), (6,), (7,)]


def test_one_modifier_is_skipped(spark):
    lines = corpus.corpus_lines(source(spark, "input Real\nflow Real q;\nparameter input Real x;\n"))
    found = rows(corpus.extract_variables(lines), "line_no", "type", "name")
    assert sorted(found) == [(1, "input", "Real"), (2, "Real", "q"), (3, "input", "Real")]


def test_classes(spark):
    text = "package A\n  partial model B\n  function f\n end f;\n model_x y;\n encapsulated package C\n"
    found = corpus.extract_classes(corpus.corpus_lines(source(spark, text)))
    assert rows(found, "line_no", "restriction", "class_name") == [
        (1, "package", "A"),
        (2, "model", "B"),
        (3, "function", "f"),
        (6, "package", "C"),
    ]


def test_comments_go_but_line_numbers_stay(spark):
    text = "a // b\nc /* d\n e */ f\n/**/g / h"
    stripped = corpus.strip_comments(source(spark, text))
    assert rows(stripped, "text") == [("a \nc \n f\ng / h",)]


def test_first_declaration(spark):
    lines = corpus.corpus_lines(source(spark, 'Real a;\nInteger a "late";\nReal b;\n'))
    found = corpus.first_declaration(corpus.extract_variables(lines))
    assert sorted(rows(found, "name", "line_no", "type")) == [("a", 1, "Real"), ("b", 3, "Real")]


def test_parameters(spark):
    data = [
        ("f", "Function", "function f\n input Real x;\n input Integer n;\n output Real y;", []),
        ("g", "Function", "function g\n input Real;", []),
        ("m", "Model", "", ['"k"', "c"]),
        ("p", "Package", "", ["k"]),
    ]
    schema = "name string, kind string, source string, parameter_names array<string>"
    found = corpus.extract_parameters(spark.createDataFrame(data, schema))
    assert dict(rows(found, "name", "parameters")) == {
        "f": ["Real x", "Integer n"],
        "g": None,
        "m": ["k", "c"],
        "p": None,
    }


def test_class_comments_and_kinds(spark):
    data = [("a", "function", '"x"'), ("b", "record", '""'), ("c", "type", None)]
    found = corpus.class_kind(spark.createDataFrame(data, "name string, restriction string, comment string"))
    assert rows(corpus.class_comments(found), "kind", "comment") == [
        ("Function", "x"),
        ("Class", None),
        ("Type", None),
    ]


def test_split_at_last_dot(spark):
    df = spark.createDataFrame([("a.b.c",), ("a",), ("a.",), (".a",)], "s string")
    found = df.select(T.head_before(F.col("s"), "."), T.tail_after(F.col("s"), "."))
    assert rows(found) == [("a.b", "c"), ("a", ""), ("a", ""), ("", "a")]


def test_vocabulary_lists_are_disjoint():
    assert len(T.KEYWORDS) == len(set(T.KEYWORDS)) == 59
    assert not set(T.KEYWORDS) & set(T.PRIMITIVE_TYPES)


def test_inventory_of_a_folder(spark, tmp_path):
    for name in ("b.mo", "a.mo", "c.txt", ".hidden.mo", "sub/d.mo"):
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_text("model X\nend X;\n")
    found = files.corpus_inventory(spark, str(tmp_path))
    assert rows(found, "path", "file_name") == [
        (str(tmp_path / "a.mo"), "a.mo"),
        (str(tmp_path / "b.mo"), "b.mo"),
        (str(tmp_path / "sub/d.mo"), "d.mo"),
    ]
    read = files.read_corpus(spark, str(tmp_path))
    assert read.count() == 3 and corpus.extract_classes(corpus.corpus_lines(read)).count() == 3


def test_word_lists(spark, tmp_path):
    (tmp_path / "words").write_text("model\n\nend\n")
    found = files.read_words(spark, str(tmp_path / "words"), "Keyword")
    assert rows(found) == [("Keyword", "model"), ("Keyword", "end")]


def test_comment_signs_in_strings_are_text(spark):
    text = 'Real x "see http://a.b/c";\nReal y "a /* b";  // gone\nReal z "q \\" // r"; /* out\n*/ Real w;\n'
    lines = corpus.corpus_lines(corpus.strip_comments(spark.createDataFrame([("f", text)], "file string, text string")))
    found = {r.name: r.comment for r in corpus.extract_variables(lines).collect()}
    assert found == {"x": "see http://a.b/c", "y": None, "z": None, "w": None}
    assert [r.line for r in lines.orderBy("line_no").collect()][1].rstrip() == 'Real y "a /* b";'


def test_classes_by_their_full_name(spark):
    from loomlight.operators import lookup

    first = "within Lib;\npackage A\n  model M\n    Real x;\n  end M;\n  model N = M;\n  function f\n  algorithm\n    if true then\n    end if;\n  end f;\nend A;\n"
    second = "model M\n  Lib.A.M p;\n  Real y;\nend M;\nmodel Z\nend Z;\n"
    lines = corpus.corpus_lines(spark.createDataFrame([("a.mo", first), ("b.mo", second)], "file string, text string"))
    for ranges in (1, 5):
        found = corpus.class_catalogue(lines, ranges)
        assert sorted(rows(found, "class_name", "parent", "restriction", "file", "line_no"), key=str) == sorted([
            ("Lib.A", "Lib", "package", "a.mo", 2), ("Lib.A.M", "Lib.A", "model", "a.mo", 3),
            ("Lib.A.N", "Lib.A", "model", "a.mo", 6), ("Lib.A.f", "Lib.A", "function", "a.mo", 7),
            ("M", None, "model", "b.mo", 1), ("Z", None, "model", "b.mo", 5),
        ], key=str)
    # a variable of a dotted type has the members of that class, and the class is found
    variables = corpus.extract_variables(lines)
    sources = lookup.source_table(found)
    asked = spark.createDataFrame([("r", "b.mo", 9, "p.")], "req_id string, file string, line int, word string")
    members = lookup.member_access(asked.withColumn("word", F.lit("p.x")), variables, sources)
    assert "p.x" in {r.name for r in members.collect()}
    place = spark.createDataFrame([("q", "b.mo", 9, "Lib.A.M")], "req_id string, file string, line int, word string")
    declared = lookup.declaration_lookup(place, found, variables, sources).first()
    assert (declared.declared_in, declared.declared_at) == ("a.mo", 3)
