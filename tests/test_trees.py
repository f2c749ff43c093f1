from pyspark.sql import functions as F

from loomlight.functions import paths as P
from loomlight.operators import trees
from tests.conftest import rows

FILES = [
    "plain/tank.mo",
    "plain/notes.txt",
    "single.mo",
    "pumps/package.mo",
    "pumps/a.mo",
    "pumps/inner/package.mo",
    "pumps/inner/b.mo",
    "valves/package.mo",
    "valves/far/off/c.mo",
    "pumps2/d.mo",
]


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_tree_has_every_directory_once(spark):
    nodes = trees.path_tree(paths(spark, FILES))
    found = {r.path: r for r in nodes.collect()}
    directories = {p for p, r in found.items() if not r.is_leaf}
    assert directories == {"plain", "pumps", "pumps/inner", "valves", "valves/far", "valves/far/off", "pumps2"}
    assert nodes.count() == len(FILES) + len(directories)
    assert found["valves/far"].parent == "valves" and found["single.mo"].parent is None
    assert found["valves/far/off/c.mo"].depth == 4


def test_absolute_paths_keep_their_slash(spark):
    nodes = trees.path_tree(paths(spark, ["/a/b.mo"]))
    assert sorted(rows(nodes, "path", "parent")) == [("/a", None), ("/a/b.mo", "/a")]


def test_root_size_is_the_node_count(spark):
    nodes = trees.path_tree(paths(spark, ["r/" + f for f in FILES]))
    sizes = dict(rows(trees.subtree_size(nodes), "path", "size"))
    assert sizes["r"] == nodes.count() and sizes["r/pumps"] == 6 and sizes["r/single.mo"] == 1


def test_fold(spark):
    data = [("5/2/20", 20), ("5/2/30", 30), ("5/5", 5), ("5/10", 10)]
    leaves = spark.createDataFrame(data, "path string, value bigint")
    folded = {r.path: (r.total, r.low, r.high, r.n) for r in trees.tree_fold(leaves, "value").collect()}
    assert folded["5"] == (65, 5, 30, 4) and folded["5/2"] == (50, 20, 30, 2)


def test_preorder_find_filter(spark):
    nodes = trees.path_tree(paths(spark, ["b/y", "b/x", "a", "b-c/z"]))
    listed = rows(trees.tree_preorder(nodes), "path", "text")
    assert [p for p, _ in listed] == ["a", "b", "b/x", "b/y", "b-c", "b-c/z"]
    assert dict(listed)["b/x"] == "  - x"
    assert rows(trees.tree_find(nodes, F.col("depth") == 2), "path") == [("b/x",)]
    assert rows(trees.tree_find(nodes, F.col("depth") == 9)) == []
    assert rows(trees.tree_filter(nodes, F.col("label").isin("z", "b")), "path") == [("b",), ("b-c/z",)]
    assert rows(trees.tree_contains(nodes, paths(spark, ["b", "q"]))) == [("b",)]


def test_upsert_turns_a_leaf_into_a_parent(spark):
    nodes = trees.path_tree(paths(spark, ["a/b", "a/c"]))
    grown = {r.path: r.is_leaf for r in trees.tree_upsert(nodes, paths(spark, ["a/b/x", "a/d"])).collect()}
    assert grown == {"a": False, "a/b": False, "a/b/x": True, "a/c": True, "a/d": True}


def test_prune_drops_whole_subtrees(spark):
    nodes = trees.path_tree(paths(spark, ["r/.git/x", "r/out/y", "r/src/out", "r/src/.z", "r/src/w"]))
    kept = {r.path for r in trees.subtree_prune(nodes, "out").collect()}
    assert kept == {"r", "r/src", "r/src/out", "r/src/w"}


def test_packages(spark):
    df = paths(spark, FILES)
    assert sorted(rows(trees.package_roots(df))) == [("pumps",), ("valves",)]
    assert sorted(r.path for r in trees.files_outside_packages(df).collect()) == [
        "plain/notes.txt",
        "plain/tank.mo",
        "pumps2/d.mo",
        "single.mo",
    ]
    order = rows(trees.load_order(df, paths(spark, ["lib/z.mo"])), "stage", "path")
    assert order[:3] == [(0, "lib/z.mo"), (1, "pumps/package.mo"), (1, "valves/package.mo")]
    assert len(order) == 7


def test_root_that_is_a_package_holds_everything(spark):
    df = paths(spark, ["/p/package.mo", "/p/a.mo", "/p/q/package.mo"])
    assert rows(trees.package_roots(df)) == [("/p",)]
    assert rows(trees.files_outside_packages(df)) == []


def test_canonical_paths(spark):
    df = paths(spark, ["C:\\a\\/b//c.mo", "/a/b", "a\\\\b"])
    assert rows(df.select(P.canonical(F.col("path")))) == [("C:/a/b/c.mo",), ("/a/b",), ("a/b",)]
    under = P.lies_under(F.col("path"), F.lit("/a"))
    assert rows(paths(spark, ["/a", "/a/b", "/ab"]).filter(under)) == [("/a",), ("/a/b",)]


def test_a_marker_in_the_root_makes_it_the_only_package(spark):
    for lead in ("", "/"):
        df = paths(spark, [lead + n for n in ("package.mo", "a/package.mo", "c/d.mo")])
        assert rows(trees.package_roots(df)) == [("",)]
        assert rows(trees.files_outside_packages(df)) == []
        libraries = paths(spark, ["lib/z.mo"])
        assert rows(trees.load_order(df, libraries)) == [(0, "lib/z.mo"), (1, lead + "package.mo")]


def test_intervals_of_nodes(spark):
    nodes = trees.path_tree(paths(spark, FILES))
    for ranges in (1, 4):
        found = {r.path: r for r in trees.nested_sets(nodes, "depth", ranges).collect()}
        order = sorted(found, key=lambda p: p.split("/"))
        for i, path in enumerate(order):
            below = [p for p in order if p == path or p.startswith(path + "/")]
            assert (found[path].pre, found[path].size, found[path].total) == (i, len(below), sum(p.count("/") + 1 for p in below))


def test_intervals_of_a_deep_tree_take_two_rows_a_node(spark):
    deep = "/".join(f"d{i}" for i in range(1000))
    data = [("/".join(deep.split("/")[: i + 1]),) for i in range(1000)]
    found = trees.nested_sets(spark.createDataFrame(data, "path string"))
    assert sorted(rows(found, "pre", "size")) == [(i, 1000 - i) for i in range(1000)]
    plan = found._jdf.queryExecution().toString()
    assert "explode" not in plan.lower()


def test_folds_that_depend_on_the_order(spark):
    # 5(2(20,30),5,10), written as preorder places; and a long tree of another key
    values = [5, 2, 20, 30, 5, 10]
    long = [(7 * i) % 11 - 5 for i in range(900)]
    data = [("a", i + 40, v) for i, v in enumerate(values)] + [("b", i, v) for i, v in enumerate(long)]
    nodes = spark.createDataFrame(data, "tree string, pre bigint, v bigint")
    one = F.lit(1).cast("bigint")
    minus = trees.ordered_fold(nodes, "tree", trees.affine(one, -F.col("v")), F.lit(100).cast("bigint"), size=16)
    assert dict(rows(minus)) == {"a": 100 - sum(values), "b": 100 - sum(long)}
    turned = trees.ordered_fold(nodes, "tree", trees.affine(-one, F.col("v")), F.lit(100).cast("bigint"), size=4)
    want = {}
    for key, own in (("a", values), ("b", long)):
        x = 100
        for v in own:
            x = v - x
        want[key] = x
    assert dict(rows(turned)) == want
    # a fold into a list, with steps of its own kind
    none = F.array().cast("array<bigint>")
    listed = trees.ordered_fold(
        nodes.filter("tree = 'a'"), "tree", F.array("v"), none, none, lambda f, g: F.concat(g, f), lambda x, f: F.concat(f, x), 2
    )
    assert dict(rows(listed)) == {"a": values[::-1]}
