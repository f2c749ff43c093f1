"""Hierarchies as node tables.

A node is (path, parent, label, depth, is_leaf). Containment is an equi-join on
exploded ancestors or an interval of preorder numbers, never a prefix test between
two tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import paths as P
from loomlight.operators.ordering import KEY, RANGE, asked_keys, before, lookup_join, range_split, with_carry, within
from loomlight.operators.scans import SIZE, block_scan

MARKER = "package.mo"


def node_columns(flat: DataFrame) -> DataFrame:
    path = F.col("path")
    return flat.select(
        "path",
        P.parent(path).alias("parent"),
        P.file_name(path).alias("label"),
        P.depth(path).alias("depth"),
        "is_leaf",
    )


def path_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Flat file paths to nodes, all directories on the way included.

    Directories are made distinct before their own ancestors are exploded, so
    a directory with very many files is expanded once, not per file.
    """
    leaves = paths.select(F.col(path).alias("path"))
    directories = leaves.select(P.parent(F.col("path")).alias("directory")).dropna().distinct()
    inner = directories.select(F.explode(P.ancestors_and_self(F.col("directory"))).alias("path"))
    every = leaves.withColumn("is_leaf", F.lit(True)).unionByName(
        inner.withColumn("is_leaf", F.lit(False))
    )
    return node_columns(every.groupBy("path").agg(F.bool_and("is_leaf").alias("is_leaf")))


def tree_upsert(nodes: DataFrame, new_paths: DataFrame, path: str = "path") -> DataFrame:
    """Nodes with more paths added; a leaf that got children is a leaf no more."""
    both = nodes.select("path", "is_leaf").unionByName(
        path_tree(new_paths, path).select("path", "is_leaf")
    )
    return node_columns(both.groupBy("path").agg(F.bool_and("is_leaf").alias("is_leaf")))


def tree_filter(nodes: DataFrame, predicate: Column) -> DataFrame:
    """Nodes that satisfy the predicate, in preorder; a failing parent hides no child."""
    return nodes.filter(predicate).orderBy(P.segments(F.col("path")))


def tree_find(nodes: DataFrame, predicate: Column) -> DataFrame:
    """The first node in preorder that satisfies the predicate; no row if there is none."""
    key = P.segments(F.col("path")).alias("key")
    first = F.min(F.struct(key, F.struct(*nodes.columns).alias("node"))).alias("first")
    return nodes.filter(predicate).agg(first).dropna().select("first.node.*")


def tree_contains(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted paths that are nodes of the tree."""
    return wanted.join(nodes.select("path"), "path", "left_semi")


def tree_preorder(nodes: DataFrame, indicator: str = "-") -> DataFrame:
    """Nodes in preorder with an indented text line each, two blanks per level."""
    top = F.greatest(F.lit(0), F.col("depth") - 1)
    text = F.concat(F.repeat(F.lit("  "), top), F.lit(f"{indicator} "), F.col("label"))
    ordered = nodes.orderBy(P.segments(F.col("path")))
    return ordered.withColumn("text", text)


def subtree_size(nodes: DataFrame) -> DataFrame:
    """Number of nodes at and below each node.

    The nodes of one directory are counted before its way up is exploded.
    """
    inside = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).dropna()
    up = inside.select(F.explode(P.ancestors_and_self(F.col("parent"))).alias("path"), "n")
    both = up.unionByName(nodes.select("path", F.lit(1).cast("bigint").alias("n")))
    return both.groupBy("path").agg(F.sum("n").alias("size"))


def tree_fold(leaves: DataFrame, measure: str, path: str = "path") -> DataFrame:
    """Sum, least, greatest and count of a leaf measure at and below each node.

    Leaves of one directory are combined before the way up is exploded.
    """
    value = F.col(measure)
    first = leaves.select(
        F.col(path).alias("path"), *[value.alias(c) for c in ("total", "low", "high")],
        F.when(value.isNotNull(), 1).otherwise(0).cast("bigint").alias("n"),
    )

    def combined(rows: DataFrame, key: Column) -> DataFrame:
        return rows.groupBy(key.alias("path")).agg(
            F.sum("total").alias("total"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.sum("n").alias("n"),
        )

    inside = combined(first, P.parent(F.col("path"))).filter("path is not null")
    way_up = F.explode(P.ancestors_and_self(F.col("path"))).alias("path")
    up = inside.select(way_up, "total", "low", "high", "n")
    return combined(up.unionByName(first), F.col("path"))


#: Sorts behind every label.
LAST = "\U0010ffff"


def nested_sets(nodes: DataFrame, measure: str | None = None, ranges: int | None = None) -> DataFrame:
    """(path, pre, size) of each node: its place in preorder, from 0, and the nodes at and below it.

    A node's subtree are the nodes from ``pre`` to ``pre + size - 1``. Each node is two rows,
    where it begins and behind all that lies below it, in one running count; so the work is
    that of the nodes, however deep they lie. With ``measure``, ``total`` is its sum over the
    subtree, null values counting nothing.
    """
    value = F.lit(0).cast("bigint") if measure is None else F.coalesce(F.col(measure), F.lit(0))
    steps = P.segments(F.col("path"))
    none = F.lit(0).cast("bigint")
    begins = nodes.select("path", steps.alias("place"), F.lit(1).cast("bigint").alias("n"), value.alias("m"))
    ends = nodes.select("path", F.concat(steps, F.array(F.lit(LAST))).alias("place"), none.alias("n"), (value * 0).alias("m"))
    split = range_split(begins.unionByName(ends), [], ["place"], ranges)
    sums = split.groupBy(KEY, RANGE).agg(F.sum("n").alias("_n"), F.sum("m").alias("_m"))
    base = [F.coalesce(F.sum(c).over(before()), F.lit(0)).alias(f"{c}_base") for c in ("_n", "_m")]
    local = split.select("*", *[F.sum(c).over(within(["place"])).alias(f"_{c}") for c in ("n", "m")])
    placed = with_carry(local, sums.select(KEY, RANGE, *base))
    n, m = F.col("_n_base") + F.col("_n"), F.col("_m_base") + F.col("_m")
    is_begin = F.col("n") == 1
    both = placed.groupBy("path").agg(
        F.max(F.when(is_begin, n - 1)).alias("pre"), F.max(F.when(~is_begin, n)).alias("end"),
        F.max(F.when(is_begin, m - F.col("m"))).alias("before"), F.max(F.when(~is_begin, m)).alias("after"),
    )
    total = [] if measure is None else [(F.col("after") - F.col("before")).alias("total")]
    return both.select("path", "pre", (F.col("end") - F.col("pre")).alias("size"), *total)


def affine(factor: Column, addend: Column) -> Column:
    """The step x -> factor * x + addend of an ordered fold."""
    return F.struct(factor.alias("factor"), addend.alias("addend"))


def affine_then(f: Column, g: Column) -> Column:
    return affine(f["factor"] * g["factor"], g["factor"] * f["addend"] + g["addend"])


def affine_of(x: Column, f: Column) -> Column:
    return f["factor"] * x + f["addend"]


def ordered_fold(
    nodes: DataFrame, tree: str, step: Column, start: Column, identity: Column | None = None,
    compose: Callable[[Column, Column], Column] = affine_then, apply: Callable[[Column, Column], Column] = affine_of,
    size: int = SIZE,
) -> DataFrame:
    """(tree, folded): the fold of each tree's nodes in preorder, for operations whose order matters.

    ``nodes`` have the place ``pre`` (:func:`nested_sets`). ``step`` is what a node does to the
    state, a function that can be composed: affine ones are there (x - v is 1, -v), others come
    with their own ``identity``, ``compose`` and ``apply``. A tree of any size is folded in
    blocks over all tasks. Values of ``start`` and of steps should be of one type.
    """
    if identity is None:
        identity = affine(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))
    first = nodes.groupBy(tree).agg(F.min("pre").alias("_first"))
    placed = lookup_join(nodes, first, [tree], row_id=["pre"]).withColumn("_place", F.col("pre") - F.col("_first"))
    prepare = lambda rows: rows.withColumn("step", step).withColumn("_step", F.col("step"))
    seen = block_scan(placed, tree, "_place", prepare, identity, compose, start, apply, "state", size)
    last = F.max_by(F.struct("state", "step"), "pre").alias("last")
    return seen.groupBy(tree).agg(last).select(tree, apply(F.col("last.state"), F.col("last.step")).alias("folded"))


def subtree_prune(nodes: DataFrame, output_dir: str | None = None) -> DataFrame:
    """Drop hidden nodes and output directories together with everything below them."""
    steps = P.segments(F.col("path"))
    directories = F.when(F.col("is_leaf"), F.slice(steps, F.lit(1), F.size(steps) - 1)).otherwise(
        steps
    )
    bad = F.exists(steps, P.is_hidden)
    if output_dir is not None:
        bad = bad | F.array_contains(directories, output_dir)
    return nodes.filter(~bad)


def directory(path: str) -> Column:
    """The directory of a file; empty for files that lie in the root itself."""
    return F.coalesce(P.parent(F.col(path)), F.lit(""))


def enclosing(folder: Column) -> Column:
    """The root, as the empty path, and every directory on the way down to ``folder``."""
    return F.array_distinct(F.concat(F.array(F.lit("")), P.ancestors_and_self(folder)))


def package_roots(files: DataFrame, path: str = "path", marker: str = MARKER) -> DataFrame:
    """Topmost directories that hold a marker file themselves; the root is the empty path.

    A marker in the root makes it the only package root.
    """
    marked = (
        files.filter(P.file_name(F.col(path)) == marker).select(directory(path).alias("root")).distinct()
    )
    above = marked.select(
        "root", F.explode(F.filter(enclosing(F.col("root")), lambda a: a != F.col("root"))).alias("above")
    )
    nested = above.join(marked.select(F.col("root").alias("above")), "above", "left_semi")
    return marked.join(nested.select("root").distinct(), "root", "left_anti")


def files_outside_packages(
    files: DataFrame, roots: DataFrame | None = None, path: str = "path"
) -> DataFrame:
    """Files that lie under no package root.

    The question is answered per distinct directory; files only look their directory up.
    """
    roots = package_roots(files, path) if roots is None else roots
    located = files.withColumn("_dir", directory(path))
    directories = asked_keys(located, ["_dir"])
    inside = (
        directories.select("_dir", F.explode(enclosing(F.col("_dir"))).alias("root"))
        .join(roots.select("root"), "root", "left_semi")
        .select("_dir")
        .distinct()
    )
    return lookup_join(located, inside, ["_dir"], "left_anti").select(*files.columns)


def load_order(files: DataFrame, libraries: DataFrame, path: str = "path") -> DataFrame:
    """What is loaded in which order: libraries, then package files, then single files."""
    roots = package_roots(files, path)
    markers = files.filter(P.file_name(F.col(path)) == MARKER).withColumn("root", directory(path))
    packages = markers.join(roots, "root", "left_semi").select(
        F.lit(1).alias("stage"), F.col(path).alias("path")
    )
    singles = files_outside_packages(files, roots, path).select(
        F.lit(2).alias("stage"), F.col(path).alias("path")
    )
    external = libraries.select(F.lit(0).alias("stage"), F.col(path).alias("path"))
    return external.unionByName(packages).unionByName(singles).orderBy("stage", "path")
