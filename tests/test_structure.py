"""Classes, scopes and imports of sources, against a reader that takes a text sign by sign."""

import random
import re

import pytest

from loomlight.operators import corpus, structure
from tests.conftest import rows

WORDS = set("model class package function record block connector type operator".split())
PREFIXES = set("replaceable encapsulated partial final inner outer expandable operator pure impure".split())


def tokens(text):
    """(line_no, token) of the code of a text."""
    line, i = 1, 0
    while i < len(text):
        c = text[i]
        if c == "\n":
            line, i = line + 1, i + 1
        elif text.startswith("//", i):
            while i < len(text) and text[i] != "\n":
                i += 1
        elif text.startswith("/*", i) or c == '"':
            end = i + (2 if c == "/" else 1)
            while end < len(text) and not (text.startswith("*/", end) if c == "/" else text[end] == '"'):
                end += 2 if c == '"' and text[end] == "\\" else 1
            end = min(len(text), end + (2 if c == "/" else 1))
            if c == '"':
                yield line, c
            line, i = line + text.count("\n", i, end), end
        elif c.isspace():
            i += 1
        else:
            found = re.compile(r"[A-Za-z_]\w*|'(?:[^'\\\n]|\\.)*'|==|.").match(text, i)
            yield line, found[0]
            i = found.end()


def read_classes(file, text):
    """(full name, parent, restriction, file, line) of each class."""
    found, stack, seen = [], [], list(tokens(text))
    is_name = lambda t: re.fullmatch(r"[A-Za-z_]\w*|'.*'", t) and t not in WORDS and t != "extends"
    i, redeclared = 0, False
    while i < len(seen):
        line, token = seen[i]
        after = [t for _, t in seen[i + 1 : i + 4]] + ["", "", ""]
        if token == "redeclare":
            redeclared = True
        elif token == "within" and is_name(after[0]):
            while i + 1 < len(seen) and seen[i + 1][1] != ";":
                i += 1
                stack += [seen[i][1]] if seen[i][1] != "." else []
        elif token == "end":
            if is_name(after[0]) and after[0] not in ("if", "for", "when", "while"):
                stack = stack[:-1]
                i += 1
            redeclared = False
        elif token in WORDS and (not i or seen[i - 1][1] != "."):
            at = i + 1 + (after[0] == "extends")
            if at < len(seen) and is_name(seen[at][1]):
                name, short = seen[at][1], at + 1 < len(seen) and seen[at + 1][1] == "="
                if not (redeclared and short):
                    found.append((".".join([*stack, name]), ".".join(stack) or None, token, file, seen[at][0]))
                stack = stack if short else [*stack, name]
                i = at
                redeclared = False
        elif token not in PREFIXES:
            redeclared = False
        i += 1
    return found


def lines_of(spark, texts):
    return corpus.corpus_lines(spark.createDataFrame(texts, "file string, text string"))


def same_classes(spark, texts, size):
    got = rows(corpus.class_catalogue(lines_of(spark, texts), size), "class_name", "parent", "restriction", "file", "line_no")
    want = [c for file, text in texts for c in read_classes(file, text)]
    assert sorted(got, key=str) == sorted(want, key=str)
    return [c[0] for c in want]


CASES = {
    "one_line.mo": "package P\nrecord A Real x; end A;\nmodel B record C end C; type D = Real; end B; model E\nend E;\nend P;\n",
    "string.mo": 'package P\n  model A "a\nmodel of a motor \\"\nend A;\n"\n  end A;\n  model B\n  end B;\nend P;\n',
    "comment.mo": "package P /* model X\n end P; */ model A // model Y\n /* end A; // */ end A; /**/ block B end B;\nend P;\n",
    "apart.mo": 'within A.B ;\npartial\nmodel\n // here\n  /* and\n here */ C\n  = D;\ntype E "x"\n  Real y;\nend\n  E;\npackage\n\nF\nend F;\n',
    "names.mo": "operator record C\n  encapsulated operator 'a\"b'\n    function 'model X' end 'model X';\n  end 'a\"b';\n  operator function '-' end '-';\nend C;\nmodel D end D;\n",
    "ends.mo": "model A\n Real x[3] = y[end - 1];\nequation\n if a then\n for i in 1:2 loop\n end for;\n end if; when b then end when; end A;\nend Z;\nmodel B end B;\n",
    "redeclare.mo": "model A\n extends B(redeclare package Medium = M, redeclare replaceable model X = Y);\n replaceable package Medium = N constrainedby O;\n redeclare function extends f\n end f;\n my_model x; model_type y; z.model z;\nend A;\n",
    "empty.mo": "",
}


@pytest.mark.parametrize("size", (2, 256))
def test_classes_of_hard_texts(spark, size):
    found = same_classes(spark, list(CASES.items()), size)
    assert {"P.A", "P.B", "P.B.C", "P.B.D", "P.E", "A.B.C", "A.B.E", "A.B.F", "C.'a\"b'.'model X'", "B"} <= set(found)
    assert "Medium" not in found and "A.Medium" in found and "A.f" in found


PIECES = [
    "model M{} ", "end M{};", "record R{}\n", " end R{}; ", "type T{} = Real;", "package\nP{}\n", "end\nP{};", '"text"', '"a\nmodel of b\n"',
    '"\\\\"', '"\\""', "/* model X\n*/", "// end M1;\n", "\n", "\n\n", " ", "Real x{};", "x[end];", "end if;", "function F{}\n=\nG;",
    "partial block ", "B{}", "redeclare model X{} = Y;", "within Q{};", "'q\"{}'", ";", "operator 'o{}'", "end 'o{}';", "=", "class extends C{}",
]


@pytest.mark.parametrize("size", (2, 5, 256))
def test_classes_of_random_texts(spark, size):
    rng = random.Random(size)
    texts = []
    for i in range(60):
        pieces = [rng.choice(PIECES).replace("{}", str(rng.randint(1, 3))) for _ in range(rng.randint(0, 40))]
        texts.append((f"f{i}", rng.choice(("", " ", "\n")).join(pieces)))
    assert len(same_classes(spark, texts, size)) > 100


def test_a_long_file_takes_several_rounds(spark):
    text = "package P\n" + "".join(f'model M{i} "text\nmodel x\n" end M{i};\n' for i in range(700)) + "end P;\nmodel Q end Q;\n"
    found = same_classes(spark, [("long.mo", text), ("b.mo", "model A end A;")], 8)
    assert "P.M699" in found and "Q" in found


def test_imports_and_scopes(spark):
    text = (
        "within L;\npackage P\n  import A.B;\n  import C = D.E; import F.*;\n  // import no.no;\n"
        '  model M "\n import no.string;\n"\n    import G.{H, I};\n    Real x "a";\n  end M;\n  Real y;\nend P;\n'
    )
    found = structure.nested(lines_of(spark, [("f", text)]))
    assert sorted(rows(structure.imports(found)), key=str) == sorted([
        ("L.P", "B", "A.B"), ("L.P", "C", "D.E"), ("L.P", None, "F"), ("L.P.M", "H", "G.H"), ("L.P.M", "I", "G.I"),
    ], key=str)
    scopes = {r.name: (r.line_no, r.scope, r.comment) for r in corpus.scoped_variables(found, strict=True).collect()}
    assert scopes["x"] == (10, ["L", "P", "M"], "a") and scopes["y"] == (12, ["L", "P"], None)
    assert "no" not in scopes and "string" not in scopes


def test_types_are_found_by_scope(spark):
    from loomlight.operators import lookup, scopes

    first = (
        "within Lib;\npackage A\n  import Far.Away.Thing; import Short = Far.Long; import Far.Open.*;\n"
        "  model Part\n    Real x;\n  end Part;\n  model M\n    model Part\n      Real inner_x;\n    end Part;\n"
        "    Part p;\n    A.Part q;\n    Thing t;\n    Short.Name s;\n    Inside i;\n    Missing m;\n    Real r;\n  end M;\n  Part o;\nend A;\n"
    )
    second = "within Lib;\nmodel Use\n  Part p;\n  A.Part q;\nend Use;\nmodel Part\n  Real outer_x;\nend Part;\n"
    third = "within Far;\npackage Open\n  model Inside\n    Real deep;\n  end Inside;\nend Open;\n"
    found = structure.nested(lines_of(spark, [("a.mo", first), ("b.mo", second), ("c.mo", third)]), 2)
    catalogue = structure.classes(found)
    typed = scopes.scoped_types(corpus.scoped_variables(found, strict=True), catalogue, structure.imports(found))
    assert {(r.file[0], r.name): r.class_name for r in typed.collect() if not r.name.endswith(("x", "deep"))} == {
        ("a", "p"): "Lib.A.M.Part", ("a", "q"): "Lib.A.Part", ("a", "t"): "Far.Away.Thing", ("a", "s"): "Far.Long.Name",
        ("a", "i"): "Far.Open.Inside", ("a", "m"): None, ("a", "r"): None, ("a", "o"): "Lib.A.Part",
        ("b", "p"): "Lib.Part", ("b", "q"): "Lib.A.Part",
    }
    asked = [("1", "b.mo", None, "p.o"), ("2", "b.mo", None, "q.x"), ("3", "a.mo", None, "i.d")]
    requests = spark.createDataFrame(asked, "req_id string, file string, line int, word string")
    members = lookup.member_access(requests, typed, lookup.source_table(catalogue)).collect()
    assert {r.name for r in members if r.req_id == "1"} == {"p.p", "p.q", "p.outer_x"}
    assert {r.name for r in members if r.req_id == "2"} >= {"q.x", "q.inner_x"}
    assert {r.name for r in members if r.req_id == "3"} == {"i.deep"}


def test_hot_type_names_and_no_classes(spark):
    from loomlight.operators import scopes

    lines = [f"model M{i}\n Common c;\n Unknown u;\nend M{i};" for i in range(200)]
    found = structure.nested(lines_of(spark, [("f", "\n".join(["model Common end Common;", *lines]))]))
    variables = corpus.scoped_variables(found, strict=True)
    typed = scopes.scoped_types(variables, structure.classes(found), structure.imports(found))
    assert sorted(r.class_name or "" for r in typed.collect()) == [""] * 200 + ["Common"] * 200
    none = structure.classes(found).limit(0)
    assert scopes.scoped_types(variables, none, structure.imports(found)).filter("class_name IS NOT NULL").count() == 0


def test_short_texts_are_read_without_a_shuffle_as_the_scans_read_them(spark, monkeypatch):
    """Only long files and those in several rows go through the scans; all rows are the same."""
    rng = random.Random(3)
    texts = [*CASES.items(), ("odd.mo", "within A..B;\npackage P\x01\r\n  model M\n end M; end P; end Q;\n"), ("none", None)]
    for i in range(40):
        pieces = [rng.choice([*PIECES, "\r\n", "/*", "*/"]).replace("{}", str(rng.randint(1, 3))) for _ in range(rng.randint(0, 40))]
        texts.append((None if i == 7 else f"twice{i % 2}" if i < 4 else f"f{i}", rng.choice(("", " ", "\n")).join(pieces)))
    files = spark.createDataFrame(texts, "file string, text string")
    want = sorted(map(str, structure.nested(corpus.corpus_lines(files)).collect()))
    scanned, scan = [], structure.nested

    def seen(lines, size):
        scanned.extend(r[0] for r in lines.select("file").distinct().collect())
        return scan(lines, size)

    monkeypatch.setattr(structure, "nested", seen)
    for size, others in ((256, {"twice0", "twice1"}), (5, None)):
        scanned.clear()
        assert sorted(map(str, structure.nested_texts(files, size).collect())) == want
        assert set(scanned) == others if others else {"twice0", "twice1", "comment.mo"} - set(scanned) == {"comment.mo"}
    scanned.clear()
    structure.nested_texts(files.filter("file LIKE 'f%' OR file = 'odd.mo'"), 256)
    assert scanned == []


def test_each_asked_type_is_numbered_and_stored_once(spark):
    from loomlight.operators import scopes

    found = structure.nested_texts(spark.createDataFrame([("a", "model A\n  B b;\nend A;\nmodel B end B;\n")], "file string, text string"))
    typed = scopes.scoped_types(corpus.scoped_variables(found, strict=True), structure.classes(found), structure.imports(found))
    assert rows(typed, "name", "class_name") == [("b", "B")]
    assert {"asked", "declared"} <= {f.rsplit("/", 2)[1].split("-")[0] for f in typed.inputFiles()}
