"""Every operator bound to the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.functions import paths as P
from loomlight.operators import corpus, diagnostics, docs, lookup, names, records, registry, runs, scopes, structure, trees
from loomlight.plans import inputs
from loomlight.session import cut, scratch_path, stored
from loomlight.sources import files
from loomlight.streaming import changelog, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BLOCK = 64
TOP = 25


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def flat_findings(findings: DataFrame, *more: str) -> DataFrame:
    return findings.select(
        "log_id", *more, "seq", "type", "file",
        F.col("start.line").alias("start_line"), F.col("start.column").alias("start_column"),
        F.col("end.line").alias("end_line"), F.col("end.column").alias("end_column"), "message",
    )


# ---- shared inputs ---------------------------------------------------------


def full_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.class_kind(inputs.classes(spark, sf_dir))
    described = corpus.class_comments(corpus.extract_parameters(known))
    return described.select("name", "kind", "parameters", "comment")


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name a member, with the members of their name space."""
    requests = inputs.name_requests(spark, sf_dir).filter(~F.endswith("word", F.lit(".")))
    return names.namespace_children(requests, full_classes(spark, sf_dir).select("name", "kind"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_lines(inputs.document_files(spark, sf_dir))


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_lines(corpus.strip_comments(inputs.part_files(spark, sf_dir)))


def order_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.extract_variables(inputs.order_lines(spark, sf_dir))


def order_and_part_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = corpus.extract_variables(part_lines(spark, sf_dir))
    return order_variables(spark, sf_dir).unionByName(parts)


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.extract_classes(part_lines(spark, sf_dir))


def package_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.nested_texts(inputs.package_files(spark, sf_dir))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name = inputs.name_requests(spark, sf_dir).select(
        "req_id", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), "word"
    )
    requests = by_name.unionByName(inputs.document_requests(spark, sf_dir)).unionByName(
        inputs.supplier_requests(spark, sf_dir)
    )
    variables = corpus.extract_variables(document_lines(spark, sf_dir)).unionByName(
        order_and_part_variables(spark, sf_dir)
    )
    sources = lookup.source_table(part_classes(spark, sf_dir))
    return names.completion_union(
        stored(requests, "requests"),
        full_classes(spark, sf_dir),
        stored(variables, "variables"),
        sources,
    )


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.path_tree(inputs.page_paths(spark, sf_dir))


# ---- sources ---------------------------------------------------------------


@query
def corpus_inventory(spark, sf_dir):
    return files.inventory(inputs.customer_paths(spark, sf_dir))


@query
def corpus_lines(spark, sf_dir):
    return document_lines(spark, sf_dir)


@query
def vocab_source(spark, sf_dir):
    """The vocabulary, read from word lists, with the number of times documents use each word."""
    lists = {kind: scratch_path(spark, "words") for kind in ("Keyword", "Type")}
    for kind, path in lists.items():
        files.write_words(names.vocabulary(spark).filter(F.col("kind") == kind), path)
    known = files.read_words(spark, lists["Keyword"], "Keyword").unionByName(files.read_words(spark, lists["Type"], "Type"))
    used = document_lines(spark, sf_dir).select(F.explode(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0))).alias("name"))
    counts = used.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    found = known.join(counts, "name", "left")
    return found.select("kind", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_uses"))


@query
def run_results_long(spark, sf_dir):
    path = scratch_path(spark, "run-results")
    for group in inputs.run_groups(spark, sf_dir):
        files.write_run_results(group, path, "event_id")
    return runs.cell_values(files.read_run_results(spark, path))


@query
def json_ingest(spark, sf_dir):
    parsed = records.json_ingest(inputs.suggestion_texts(spark, sf_dir), "Suggestion")
    kept = F.col("accepted")
    return parsed.select(
        "event_id",
        "accepted",
        F.when(kept, F.col("record.kind")).alias("kind"),
        F.when(kept, F.col("record.name")).alias("name"),
        F.when(kept, F.array_join("record.parameters", "|")).alias("parameters"),
        F.when(kept, F.col("record.classComment")).alias("class_comment"),
        F.when(kept, F.col("record.type")).alias("type"),
    )


@query
def json_egress(spark, sf_dir):
    variables = order_variables(spark, sf_dir)
    commented = F.when(F.col("comment") == "F", F.col("comment")).alias("comment")
    return records.json_egress(variables.select("name", "type", commented))


@query
def recent_snapshot(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    path = scratch_path(spark, "recent")
    early = F.col("event_type").isin("view", "signup")
    files.write_snapshot(registry.hits(events.filter(early), "user_id"), path)
    old = files.read_snapshot(spark, path, "item bigint, hits bigint")
    merged = registry.merge_hits(old, registry.hits(events.filter(~early), "user_id"))
    saved = scratch_path(spark, "recent")
    files.write_snapshot(merged, saved)
    return files.read_snapshot(spark, saved, "item bigint, hits bigint")


@query
def docs_site(spark, sf_dir):
    classes = inputs.page_classes(spark, sf_dir)
    documented = docs.class_docs(inputs.page_docs(classes), inputs.page_members(classes), BLOCK)
    return docs.docs_site(classes, documented)


# ---- filters ---------------------------------------------------------------


@query
def prefix_match(spark, sf_dir):
    """Members with the prefix, and part names that start with one of the short words."""
    parts = inputs.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    words = inputs.part_words(spark, sf_dir)
    found = names.prefix_lookup(words, parts).select("word", "name")
    return found.unionByName(names.prefix_match(scoped(spark, sf_dir)).select("word", "name"))


@query
def prefix_nonmatch(spark, sf_dir):
    return names.prefix_nonmatch(scoped(spark, sf_dir)).select("req_id", "word", "name", "kind")


@query
def position_filter(spark, sf_dir):
    variables = corpus.extract_variables(document_lines(spark, sf_dir))
    return lookup.position_filter(inputs.document_requests(spark, sf_dir), variables).select(
        "req_id", "line_no", "type", "name"
    )


@query
def project_scope_filter(spark, sf_dir):
    findings = diagnostics.diagnostics_a(inputs.logs_a(spark, sf_dir))
    return diagnostics.project_scope_filter(findings).select("log_id", "root", "seq", "file")


@query
def subtree_prune(spark, sf_dir):
    return trees.subtree_prune(page_nodes(spark, sf_dir), "de").select("path", "is_leaf")


@query
def tree_filter(spark, sf_dir):
    wanted = (F.col("depth") == 2) | F.endswith("label", F.lit(".html"))
    return trees.tree_filter(page_nodes(spark, sf_dir), wanted).select("path", "label", "depth")


# ---- look-ups --------------------------------------------------------------


@query
def type_lookup(spark, sf_dir):
    found = lookup.type_lookup(inputs.order_requests(spark, sf_dir), order_variables(spark, sf_dir))
    return found.select("req_id", "name", "type", "comment")


@query
def class_source_lookup(spark, sf_dir):
    asked = inputs.table(spark, sf_dir, "lineitem").select(
        inputs.log_key().alias("req_id"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("P"), "l_partkey"))
        .otherwise(F.concat(F.lit("Modelica.P"), "l_partkey"))
        .alias("word"),
    )
    return lookup.class_source_lookup(asked, lookup.source_table(part_classes(spark, sf_dir)))


@query
def declaration_lookup(spark, sf_dir):
    """Classes by their plain and their full name, and variables of the order's own file."""
    status = F.col("o_orderstatus")
    word = (
        F.when(status == "F", F.concat(F.lit("P"), "o_custkey"))
        .when(status == "O", F.concat(F.lit("item"), F.col("o_custkey") % 7 + 1))
        .otherwise(F.concat(F.lit("Lib.Basic"), F.col("o_orderkey") % 7, F.lit(".Point")))
    )
    orders = inputs.table(spark, sf_dir, "orders")
    requests = orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("req_id"),
        F.concat(F.lit("order_"), "o_orderkey", F.lit(".mo")).alias("file"),
        word.alias("word"),
    ).unionByName(inputs.class_requests(spark, sf_dir))
    catalogue = structure.classes(package_structure(spark, sf_dir))
    classes = stored(part_classes(spark, sf_dir).unionByName(catalogue, allowMissingColumns=True), "classes")
    return lookup.declaration_lookup(
        requests, classes, order_variables(spark, sf_dir), lookup.source_table(classes)
    ).select("req_id", "word", "declared_in", "declared_at")


@query
def namespace_children(spark, sf_dir):
    found = names.namespace_children(inputs.name_requests(spark, sf_dir), full_classes(spark, sf_dir))
    return found.select("req_id", "name", "kind", joined("parameters"), "comment")


@query
def member_access(spark, sf_dir):
    """Members of items in orders, and of objects in packages, whose types are found by scope."""
    items = lookup.member_access(
        inputs.order_requests(spark, sf_dir),
        stored(order_and_part_variables(spark, sf_dir), "variables"),
        lookup.source_table(part_classes(spark, sf_dir)),
    )
    packages = package_structure(spark, sf_dir)
    catalogue = stored(structure.classes(packages), "classes")
    variables = corpus.scoped_variables(packages, strict=True)
    typed = scopes.scoped_types(variables, catalogue, structure.imports(packages))
    objects = lookup.member_access(
        inputs.package_requests(spark, sf_dir), stored(typed, "variables"), lookup.source_table(catalogue)
    )
    return items.unionByName(objects)


@query
def files_outside_packages(spark, sf_dir):
    return trees.files_outside_packages(inputs.customer_paths(spark, sf_dir))


@query
def gated_diagnostics(spark, sf_dir):
    return diagnostics.gated_diagnostics(
        inputs.stage_findings(spark, sf_dir, True),
        inputs.stage_findings(spark, sf_dir, False),
        inputs.not_instantiable(spark, sf_dir),
        "model",
    )


@query
def class_docs(spark, sf_dir):
    classes = inputs.page_classes(spark, sf_dir)
    documented = docs.class_docs(inputs.page_docs(classes), inputs.page_members(classes), BLOCK)
    shown = F.transform(
        "members", lambda m: F.concat_ws(" - ", m["class_name"], m["comment"])
    )
    return documented.select(
        "class_name", "info", "revisions", "header", "n_members", "block",
        F.array_join(shown, "|").alias("members"),
    )


@query
def run_status_asof(spark, sf_dir):
    events = inputs.status_events(inputs.table(spark, sf_dir, "events"))
    return runs.run_status_asof(events).select("run_id", "event_id", "status")


# ---- aggregates ------------------------------------------------------------


@query
def subtree_size(spark, sf_dir):
    return trees.subtree_size(page_nodes(spark, sf_dir))


@query
def tree_intervals(spark, sf_dir):
    """Each node's interval in preorder, and the sum of the depths in it."""
    return trees.nested_sets(page_nodes(spark, sf_dir), "depth")


@query
def tree_ordered_fold(spark, sf_dir):
    """The nodes of each site folded in preorder by x -> depth - x, which depends on the order."""
    nodes = page_nodes(spark, sf_dir)
    placed = trees.nested_sets(nodes).select("path", "pre").join(nodes.select("path", "depth"), "path")
    site = F.coalesce(F.get(P.segments(F.col("path")), F.lit(1)), F.lit(""))
    step = trees.affine(F.lit(-1).cast("bigint"), F.col("depth").cast("bigint"))
    return trees.ordered_fold(placed.withColumn("site", site), "site", step, F.lit(100).cast("bigint"))


@query
def tree_fold(spark, sf_dir):
    return trees.tree_fold(inputs.page_paths(spark, sf_dir), "n_chars")


@query
def run_series(spark, sf_dir):
    wide = inputs.run_tables(spark, sf_dir).withColumnRenamed("event_id", "row_idx")
    long = runs.run_results_long(wide, ["run_id", "row_idx"])
    series = runs.run_series(long, ["run_id", "variable"], size=1000)
    return series.select("run_id", "variable", "block", joined("values"))


@query
def registry_counts(spark, sf_dir):
    return registry.registry_counts(registry.final_counts(inputs.registry_calls(spark, sf_dir)))


@query
def model_size(spark, sf_dir):
    sizes = diagnostics.model_size(inputs.check_reports(spark, sf_dir))
    return diagnostics.model_size_totals(sizes, "corpus")


@query
def completion_summary(spark, sf_dir):
    found = cut(suggestions(spark, sf_dir))
    summary = names.completion_summary(found, BLOCK)
    return summary.select(
        "req_id", "n_suggestions", "n_prefix", "n_fuzzy", "block", joined("displays")
    )


@query
def distinct_classes(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    restriction = F.when(F.col("p_size") > 25, "model").otherwise("record")
    found = part.select(F.col("p_name").alias("name"), restriction.alias("restriction"))
    return corpus.distinct_classes(corpus.class_kind(found))


# ---- first matches, ids, running counts ------------------------------------


@query
def first_declaration(spark, sf_dir):
    return corpus.first_declaration(corpus.extract_variables(document_lines(spark, sf_dir)))


@query
def registry_ids(spark, sf_dir):
    counted = cut(registry.count_scan(inputs.registry_calls(spark, sf_dir)))
    return registry.registry_ids(counted).select("key", "project_id", "event_id")


@query
def registry_refcount(spark, sf_dir):
    counted = registry.registry_refcount(inputs.registry_calls(spark, sf_dir))
    return counted.select("event_id", "key", "op", "clients", "total_clients")


# ---- sorting ---------------------------------------------------------------


@query
def fuzzy_rank(spark, sf_dir):
    return names.fuzzy_rank(scoped(spark, sf_dir)).select("req_id", "word", "distance", "name", "kind")


@query
def recent_topk(spark, sf_dir):
    return registry.recent_topk(registry.hits(inputs.table(spark, sf_dir, "events"), "user_id"), TOP)


@query
def load_order(spark, sf_dir):
    supplier = inputs.table(spark, sf_dir, "supplier")
    libraries = supplier.select(F.concat(F.lit("/lib/"), "s_name").alias("path"))
    return trees.load_order(inputs.customer_paths(spark, sf_dir), libraries)


@query
def tree_preorder(spark, sf_dir):
    return trees.tree_preorder(page_nodes(spark, sf_dir)).select("path", "depth", "text")


@query
def tree_find(spark, sf_dir):
    nodes = page_nodes(spark, sf_dir)
    return trees.tree_find(nodes, F.endswith("label", F.lit(".html"))).select("path", "depth")


# ---- unions ----------------------------------------------------------------


@query
def completion_union(spark, sf_dir):
    found = suggestions(spark, sf_dir)
    return found.select(
        "req_id", "word", "tier", "distance", "kind", "name", joined("parameters"), "comment", "type"
    )


@query
def diagnostics_union(spark, sf_dir):
    both = diagnostics.diagnostics_union(
        diagnostics.library_warnings(inputs.library_failures(spark, sf_dir)),
        diagnostics.diagnostics_a(inputs.logs_a(spark, sf_dir)),
    )
    return both.select("log_id", "part", "seq", "type", "file", "message")


# ---- extraction ------------------------------------------------------------


@query
def extract_variables(spark, sf_dir):
    return corpus.extract_variables(document_lines(spark, sf_dir))


@query
def extract_classes(spark, sf_dir):
    return part_classes(spark, sf_dir)


@query
def class_catalogue(spark, sf_dir):
    return corpus.class_catalogue(corpus.corpus_lines(inputs.package_files(spark, sf_dir)))


@query
def extract_parameters(spark, sf_dir):
    classes = corpus.extract_parameters(corpus.class_kind(inputs.classes(spark, sf_dir)))
    return classes.select("name", "kind", joined("parameters"))


@query
def class_kind(spark, sf_dir):
    return corpus.class_kind(inputs.classes(spark, sf_dir)).select("name", "restriction", "kind")


@query
def class_comments(spark, sf_dir):
    return corpus.class_comments(inputs.classes(spark, sf_dir)).select("name", "comment")


@query
def diagnostics_a(spark, sf_dir):
    return flat_findings(diagnostics.diagnostics_a(inputs.logs_a(spark, sf_dir)))


@query
def diagnostics_b(spark, sf_dir):
    return flat_findings(diagnostics.diagnostics_b(inputs.logs_b(spark, sf_dir)), "part")


@query
def run_outcome(spark, sf_dir):
    return runs.run_outcome(inputs.run_reports(spark, sf_dir))


@query
def request_options(spark, sf_dir):
    parsed = runs.request_options(inputs.option_requests(spark, sf_dir))
    return parsed.select("event_id", "accepted", joined("arguments"))


@query
def namespace_table(spark, sf_dir):
    return names.namespace_table(inputs.classes(spark, sf_dir)).select("name", "parent", "simple")


@query
def path_canonical(spark, sf_dir):
    """Findings per file, for paths written in four ways."""
    item = inputs.table(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 4
    separator = (
        F.when(kind == 0, "/").when(kind == 1, "\\").when(kind == 2, "\\/").otherwise("//")
    )
    raw = F.concat(F.lit("C:"), separator, F.lit("work"), separator, F.lit("s"), "l_suppkey")
    return item.groupBy(P.canonical(raw).alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query
def strip_comments(spark, sf_dir):
    texts = inputs.part_files(spark, sf_dir).unionByName(inputs.document_files(spark, sf_dir))
    return corpus.strip_comments(texts)


@query
def path_tree(spark, sf_dir):
    return page_nodes(spark, sf_dir)


@query
def package_roots(spark, sf_dir):
    return trees.package_roots(inputs.customer_paths(spark, sf_dir))


@query
def tree_upsert(spark, sf_dir):
    """Pages added below the customer tree's copy, some of them below what was a leaf."""
    pages = inputs.page_paths(spark, sf_dir)
    below = pages.select(F.concat("path", F.lit("/part"), F.col("page_id") % 2).alias("path"))
    return trees.tree_upsert(page_nodes(spark, sf_dir), below)


@query
def validate_projects(spark, sf_dir):
    known = inputs.customer_paths(spark, sf_dir).unionByName(inputs.script_paths(spark, sf_dir))
    checked = registry.validate_projects(inputs.projects(spark, sf_dir), trees.path_tree(known))
    return checked.select("project", "path", joined("errors"))


# ---- streams ---------------------------------------------------------------


#: How much later than others an event may come.
DELAY = timedelta(hours=6)


@query
def file_index_stream(spark, sf_dir):
    changes = inputs.file_changes(inputs.event_stream(spark, sf_dir))
    index = live.FileIndex(scratch_path(spark, "file-index"), DELAY)
    index.start(changes, scratch_path(spark, "offsets")).awaitTermination()
    index.finish(spark)
    return index.files(spark)


@query
def registry_stream(spark, sf_dir):
    calls = inputs.registry_events(inputs.event_stream(spark, sf_dir))
    table = scratch_path(spark, "registry")
    clients = live.Registry(table, DELAY)
    clients.start(calls, scratch_path(spark, "offsets")).awaitTermination()
    clients.finish(spark)
    counted = spark.read.parquet(f"{table}/calls")
    ids = spark.read.parquet(f"{table}/projects").select("event_id", "project_id")
    return counted.join(ids, "event_id", "left").select(
        "event_id", "key", "op", "clients", "total_clients", "project_id"
    )


@query
def recent_stream(spark, sf_dir):
    stream = inputs.event_stream(spark, sf_dir)
    table = scratch_path(spark, "recent-stream")
    counts = live.recent_stream(stream, "user_id")
    changelog.keep_changes(counts, table, scratch_path(spark, "offsets")).awaitTermination()
    return registry.recent_topk(changelog.newest(spark, table, ["item"]), TOP)


@query
def run_status_stream(spark, sf_dir):
    events = inputs.status_events(inputs.event_stream(spark, sf_dir))
    table = scratch_path(spark, "run-status")
    status = live.RunStatus(table, DELAY)
    status.start(events, scratch_path(spark, "offsets")).awaitTermination()
    status.finish(spark)
    return spark.read.parquet(f"{table}/polls").select("run_id", "event_id", "status")
