from loomlight.operators import corpus, lookup, names
from tests.conftest import rows


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slices(s):
    head, dot, tail = s.rpartition(".")
    return (head, tail) if dot else (s, "")


def ranked(word, candidates):
    """What one request must give, worked out by hand."""
    obj, member = slices(word)
    found = []
    for name, kind in candidates:
        if name.startswith(word):
            continue
        part = slices(name)
        d = levenshtein(part[1], member) if member else levenshtein(part[0], obj)
        if d < len(name):
            found.append((d, name, kind))
    return sorted(found)


NAMES = ["A.B.cat", "A.B.car", "A.B.x", "A.B", "A", "cart", "c", "A.B.cat.tail", "zebra"]


def test_fuzzy_rank_equals_a_plain_loop(spark):
    words = ["A.B.ca", "ca", "A.B", "zebras", "c.", "toolongaword"]
    pairs = [(w, w, n, "Class") for w in words for n in NAMES]
    scoped = spark.createDataFrame(pairs, "req_id string, word string, name string, kind string")
    found = rows(names.fuzzy_rank(scoped), "req_id", "distance", "name", "kind")
    for word in words:
        mine = [r[1:] for r in found if r[0] == word]
        assert mine == ranked(word, [(n, "Class") for n in NAMES])
    best = rows(names.fuzzy_rank(scoped, best=2), "req_id", "name")
    assert all(len([b for b in best if b[0] == w]) <= 2 for w in words)


def test_prefixes_of_the_vocabulary(spark):
    def hits(word):
        df = names.vocabulary(spark).selectExpr("*", f"'{word}' as word")
        return {r.name for r in names.prefix_match(df).collect()}

    assert hits("func") == {"function"} and hits("im") == {"import", "impure"}
    assert hits("B") == {"Boolean"} and hits("In") == {"Integer"} and len(hits("e")) == 11


def test_prefix_lookup_equals_a_plain_loop(spark):
    words = ["A", "A.B.c", "ca", "zebra", "q"]
    found = names.prefix_lookup(
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame([(n,) for n in NAMES], "name string"),
    )
    assert sorted(rows(found)) == sorted((w, n) for w in words for n in NAMES if n.startswith(w))


def test_namespaces(spark):
    table = names.namespace_table(spark.createDataFrame([("A.B.c",), ("A",)], "name string"))
    assert rows(table) == [("A.B.c", "A.B", "c"), ("A", None, "A")]
    classes = spark.createDataFrame([(n, "Class") for n in NAMES], "name string, kind string")
    asked = spark.createDataFrame([(1, "A.B."), (2, "A.B.c"), (3, "z"), (4, "No.")], "req_id int, word string")
    found = {}
    for req, name in rows(names.namespace_children(asked, classes), "req_id", "name"):
        found.setdefault(req, set()).add(name)
    members = {"A.B.cat", "A.B.car", "A.B.x"}
    assert found == {1: members, 2: members, 3: {"A", "cart", "c", "zebra"}}


def catalog(spark):
    files = [
        ("user.mo", 'model User\n  Part p "one";\n  Real r;\n  Part p2;\nend User;\n'),
        ("part.mo", 'package Lib\n  model Part\n    Real size "how big";\n  end Part;\nend Lib;\n'),
        ("odd.mo", "Real User;\n"),
    ]
    lines = corpus.corpus_lines(spark.createDataFrame(files, "file string, text string"))
    classes = corpus.extract_classes(lines)
    return corpus.extract_variables(lines), classes, lookup.source_table(classes)


def requests(spark, data):
    return spark.createDataFrame(data, "req_id string, file string, line int, word string")


def test_type_lookup_takes_the_topmost_declaration(spark):
    lines = corpus.corpus_lines(
        spark.createDataFrame([("f", "Real a;\nInteger a;\nReal b;\n")], "file string, text string")
    )
    asked = requests(
        spark,
        [("late", "f", 9, "a.x"), ("early", "f", 2, "b"), ("open", "f", None, "b"), ("none", "f", 9, "+")],
    )
    found = lookup.type_lookup(asked, corpus.extract_variables(lines))
    assert sorted(rows(found, "req_id", "type")) == [("late", "Real"), ("open", "Real")]


def test_declarations_prefer_classes(spark):
    variables, classes, sources = catalog(spark)
    aliases = spark.createDataFrame(
        [("Lib.Part", "part.mo"), ("gone.User", "part.mo")], "class_name string, source_file string"
    )
    asked = requests(
        spark,
        [
            ("class", "user.mo", 1, "Part"),
            ("qualified", "user.mo", 1, "Lib.Part"),
            ("variable", "user.mo", 1, "p2"),
            ("both", "odd.mo", 1, "User"),
            ("no line", "user.mo", 1, "gone.User"),
            ("library", "user.mo", 1, "Modelica.Part"),
            ("nothing", "user.mo", 1, "q"),
        ],
    )
    found = lookup.declaration_lookup(asked, classes, variables, sources.unionByName(aliases))
    assert {r.req_id: (r.declared_in, r.declared_at) for r in found.collect()} == {
        "class": ("part.mo", 2),
        "qualified": ("part.mo", 2),
        "variable": ("user.mo", 4),
        "both": ("user.mo", 1),
        "no line": (None, None),
        "library": (None, None),
        "nothing": (None, None),
    }


def test_variables_of_requests_are_looked_up_once_for_both_looks(spark):
    variables, classes, sources = catalog(spark)
    found = lookup.declaration_lookup(requests(spark, [("v", "user.mo", 1, "p2")]), classes, variables, sources)
    assert rows(found, "declared_in", "declared_at") == [("user.mo", 4)]
    assert any("/local-" in f for f in found.inputFiles())


def test_members_of_an_object(spark):
    variables, _, sources = catalog(spark)
    asked = requests(
        spark,
        [("hit", "user.mo", 3, "p.s"), ("above", "user.mo", 1, "p.s"), ("primitive", "user.mo", 9, "r.s"),
         ("bare", "user.mo", 9, "p")],
    )
    found = lookup.member_access(asked, variables, sources)
    assert {r[0] for r in rows(found, "req_id")} == {"hit"}
    assert ("p.size", "Real", "how big") in rows(found, "name", "type", "comment")


def test_completions(spark):
    variables, _, sources = catalog(spark)
    classes = spark.createDataFrame(
        [("Lib", "Package", None, None), ("Lib.Part", "Model", ["Real s"], "a part")],
        "name string, kind string, parameters array<string>, comment string",
    )
    asked = requests(
        spark,
        [("empty", "user.mo", 9, ""), ("list", "user.mo", 9, "Lib."), ("word", "user.mo", 3, "p"),
         ("member", "user.mo", 3, "p.si")],
    )
    found = names.completion_union(asked, classes, variables, sources)
    by_request = {}
    for r in names.in_order(found).collect():
        by_request.setdefault(r.req_id, []).append(r)
    assert "empty" not in by_request
    assert [(r.name, r.kind, r.parameters) for r in by_request["list"]] == [("Lib.Part", "Model", ["Real s"])]
    prefix = {r.name for r in by_request["word"] if r.tier == 0}
    assert prefix == {"p", "package", "parameter", "partial", "protected", "public", "pure"}
    assert by_request["word"][0].tier == 0 and by_request["word"][-1].tier == 1
    assert "p2" not in {r.name for r in by_request["word"]}
    assert [r.name for r in by_request["member"] if r.tier == 0] == ["p.size"]
    counts = {r.req_id: r for r in names.completion_counts(found).collect()}
    assert counts["word"].n_suggestions == len(by_request["word"])
    summary = names.completion_summary(found, size=10).filter("req_id = 'word'").orderBy("block").collect()
    shown = [d for block in summary for d in block.displays]
    assert shown == sorted(f"{r.kind} - {r.name}" for r in by_request["word"])
    assert all(len(block.displays) <= 10 for block in summary)
