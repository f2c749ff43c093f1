"""The given tables, read in the shape each operator takes.

Every function is a plain projection of whole tables; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- names -----------------------------------------------------------------


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions hold nations, nations hold customers: dotted class names with all attributes."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    customer = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    none = F.array().cast("array<string>")
    top = region.select(
        F.col("r_name").alias("name"),
        F.lit("package").alias("restriction"),
        F.format_string('"Region %d"', "r_regionkey").alias("comment"),
        F.lit("").alias("source"),
        none.alias("parameter_names"),
    )
    middle = nation.select(
        F.concat_ws(".", "r_name", "n_name").alias("name"),
        F.lit("package").alias("restriction"),
        F.lit('""').alias("comment"),
        F.lit("").alias("source"),
        none.alias("parameter_names"),
    )
    segment = F.col("c_mktsegment")
    restriction = (
        F.when(segment == "AUTOMOBILE", "function")
        .when(segment == "BUILDING", "model")
        .when(segment == "FURNITURE", "type")
        .when(segment == "HOUSEHOLD", "record")
        .otherwise("block")
    )
    bottom = customer.select(
        F.concat_ws(".", "r_name", "n_name", "c_name").alias("name"),
        restriction.alias("restriction"),
        F.concat(F.lit('"'), "c_mktsegment", F.lit(' account"')).alias("comment"),
        F.concat(
            F.lit("function f\n  input Real key"),
            F.col("c_custkey").cast("string"),
            F.lit(";\n  input N"),
            F.col("c_nationkey").cast("string"),
            F.lit(" home;\nend f;\n"),
        ).alias("source"),
        F.when(
            segment == "BUILDING", F.array(F.concat(F.lit('"key'), "c_custkey", F.lit('"')))
        ).otherwise(none).alias("parameter_names"),
    )
    return top.unionByName(middle).unionByName(bottom)


def name_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unfinished word per nation (a member of it) and per region (a nation of it, a region)."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    start = F.concat(F.lit("Customer#00000"), (F.col("n_nationkey") % 3).cast("string"))
    members = nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("req_id"),
        F.concat_ws(".", "r_name", "n_name", start).alias("word"),
    )
    nations = region.select(
        F.concat(F.lit("r"), "r_regionkey").alias("req_id"),
        F.concat_ws(".", "r_name", F.lit("NATION_1")).alias("word"),
    )
    regions = region.select(
        F.concat(F.lit("t"), "r_regionkey").alias("req_id"), F.left("r_name", F.lit(2)).alias("word")
    )
    listings = nation.select(
        F.concat(F.lit("l"), "n_nationkey").alias("req_id"),
        F.concat(F.concat_ws(".", "r_name", "n_name"), F.lit(".")).alias("word"),
    )
    return members.unionByName(nations).unionByName(regions).unionByName(listings)


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each part name, cut to three letters, as unfinished words."""
    part = table(spark, sf_dir, "part")
    return part.select(F.left(F.substring_index("p_name", " ", 1), F.lit(3)).alias("word")).distinct()


# ---- sources ---------------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("file"), "text"
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part, which declares class P<key>."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("// "), "p_name", F.lit("\nmodel P"), key,
        F.lit("\n  Real "), F.substring_index("p_name", " ", 1), F.lit(' "'), "p_brand", F.lit('";\n'),
        F.lit("  parameter Integer "), F.substring_index("p_name", " ", -1),
        F.lit(";\n  /* "), "p_type", F.lit("\n  */ P"), key, F.lit(" next;\nend P"), key, F.lit(";\n"),
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), key, F.lit(".mo")).alias("file"), text.alias("text")
    )


def brand() -> Column:
    return F.replace("p_brand", F.lit("#"), F.lit("_"))


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part, a package inside its brand, and one per region that the packages import.

    Texts and comments with what looks like classes, several classes on one line, and a short
    definition over several lines.
    """
    key = F.col("p_partkey").cast("string")
    near = [((F.col("p_partkey") + i) % 5).cast("string") for i in (0, 1)]
    values = {"k": key, "brand": brand(), "a": near[0], "b": near[1]}
    text = _written(
        'within Lib.{brand};\npackage P{k} "Parts,\nmodel of a motor \\"P{k}\\"\nend P{k};\n"\n'
        "  import Lib.Basic{a}.Point; import Lib.Basic{b}.*;\n"
        "  type Size = Real; record Pair Real x; Real y; end Pair;\n"
        "  model Outer /* model Hidden\n  end Outer; */\n"
        "    model Inner\n      Real a;\n    equation\n      when a > 0 then\n      end when;\n    end Inner;\n"
        '    Inner part "own";\n    Pair both;\n    Point where "at";\n    Only{b} one;\n    P{k}.Outer.Inner far;\n'
        "  end Outer; partial block Last\n  end Last;\n  type\n    Late\n    = Size;\nend P{k};\n",
        values,
    )
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("lib/P"), key, F.lit(".mo")).alias("file"), text.alias("text")
    )
    basic = _written(
        "within Lib;\npackage Basic{r}\n  record Point Real px; end Point;\n  record Only{r}\n    Real only;\n"
        "  end Only{r};\nend Basic{r};\n",
        {"r": F.col("r_regionkey").cast("string")},
    )
    regions = table(spark, sf_dir, "region").select(
        F.concat(F.lit("lib/Basic"), "r_regionkey", F.lit(".mo")).alias("file"), basic.alias("text")
    )
    return parts.unionByName(regions)


def package_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per part for a member of an object in its package."""
    words = F.array(*[F.lit(f"{name}.s") for name in ("part", "both", "where", "one", "far")])
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("req_id"),
        F.concat(F.lit("lib/P"), "p_partkey", F.lit(".mo")).alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.get(words, (F.floor(F.col("p_partkey") / 3) % 5).cast("int")).alias("word"),
    )


def class_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per part for a class in its package, or one that is not there."""
    ends = F.array(*[F.lit(name) for name in ("", ".Late", ".Outer.Inner", ".Hidden", ".Last")])
    word = F.concat(F.lit("Lib."), brand(), F.lit(".P"), "p_partkey", F.get(ends, (F.col("p_partkey") % 5).cast("int")))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("req_id"), F.lit("elsewhere.mo").alias("file"), word.alias("word")
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a file and each of its line items a line that declares item<n>."""
    item = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "Real").otherwise(
        F.concat(F.lit("P"), "l_partkey")
    )
    line = F.concat(
        F.lit("  "), kind, F.lit(" item"), "l_linenumber", F.lit(' "'), "l_linestatus", F.lit('";')
    )
    return item.select(
        F.concat(F.lit("order_"), "l_orderkey", F.lit(".mo")).alias("file"),
        F.col("l_linenumber").alias("line_no"),
        line.alias("line"),
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: a member of one of its items, or of none."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("req_id"),
        F.concat(F.lit("order_"), "o_orderkey", F.lit(".mo")).alias("file"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 7 + 1).cast("int")).alias("line"),
        F.concat(F.lit("item"), F.col("o_custkey") % 7 + 1, F.lit(".s")).alias("word"),
    )


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per document: the start of its first word, the cursor at a line that varies."""
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        F.concat(F.lit("d"), "doc_id").alias("req_id"),
        F.concat(F.lit("doc"), "doc_id").alias("file"),
        (F.col("doc_id") % 9 + 1).cast("int").alias("line"),
        F.regexp_extract("text", r"[A-Za-z]{1,3}", 0).alias("word"),
    )


def supplier_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per supplier for a member of an item in the order of the same number."""
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("req_id"),
        F.concat(F.lit("order_"), "s_suppkey", F.lit(".mo")).alias("file"),
        F.lit(7).alias("line"),
        F.concat(F.lit("item"), F.col("s_suppkey") % 7 + 1, F.lit(".s")).alias("word"),
    )


# ---- paths -----------------------------------------------------------------


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files web/host/lang/leaf, without scheme, query, fragment and final slash."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    path = F.concat(F.lit("web/"), F.regexp_replace(bare, "/+$", ""))
    return pages.select(
        path.alias("path"), F.length("html").cast("bigint").alias("n_chars"), "page_id", "html"
    )


def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in region and nation directories; some directories hold a package file."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    customer = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    leaf = F.when(F.col("c_custkey") % 50 == 0, "package.mo").otherwise(
        F.concat("c_name", F.lit(".mo"))
    )
    own = customer.select(
        F.concat(F.lit("/"), F.concat_ws("/", "r_name", "n_name", leaf)).alias("path")
    )
    marker = F.when(F.col("r_regionkey") == 4, "package.mo").otherwise("notes.mo")
    top = region.select(F.concat(F.lit("/"), F.concat_ws("/", "r_name", marker)).alias("path"))
    return own.unionByName(top).distinct()


def script_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build script in every second nation's directory."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    script = F.concat(F.lit("/"), F.concat_ws("/", "r_name", "n_name", F.lit("build.mos")))
    place = F.when(F.col("n_nationkey") % 2 == 0, script).otherwise(F.lit("/shared/build.mos"))
    return nation.select(place.alias("path")).distinct()


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project description per customer: a directory, a file or nothing that exists."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    customer = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    directory = F.concat(F.lit("/"), F.concat_ws("/", "r_name", "n_name"))
    third = F.col("c_custkey") % 3
    path = (
        F.when(third == 0, directory)
        .when(third == 1, F.concat(directory, F.lit("/"), "c_name", F.lit(".mo")))
        .otherwise(F.concat(F.lit("/none/"), "c_name"))
    )
    script = F.when(F.col("c_mktsegment") == "BUILDING", "build.mos").when(
        F.col("c_mktsegment") == "MACHINERY", "package.mo"
    )
    return customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("project"),
        path.alias("path"),
        F.lit("out").alias("output_dir"),
        script.alias("build_script"),
    )


# ---- logs and runs ---------------------------------------------------------


def _numbers() -> dict:
    text = lambda c: F.col(c).cast("string")
    quantity = F.col("l_quantity").cast("int")
    return {
        "order": text("l_orderkey"), "part": text("l_partkey"), "supp": text("l_suppkey"),
        "line": text("l_linenumber"), "next": (F.col("l_linenumber") + 1).cast("string"),
        "qty": quantity.cast("string"), "far": (quantity + 7).cast("string"),
    }


def _written(pattern: str, values: dict) -> Column:
    """A text with {name} places filled from columns."""
    pieces = []
    for n, piece in enumerate(pattern.replace("{", "\0").replace("}", "\0").split("\0")):
        pieces.append(values[piece] if n % 2 else F.lit(piece))
    return F.concat(*pieces)


def log_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def logs_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compiler log per line item; its flags choose the form of the log."""
    item = table(spark, sf_dir, "lineitem")
    values = _numbers()
    positioned = _written(
        "Error processing file: o{order}.mo\n"
        "[/work/o{order}.mo:{line}:{qty}-{next}:{far}:writable] Error: Class P{part} not found in scope S{supp}.\n"
        "[/lib//S{supp}.mo:{qty}:1-{qty}:9:readonly] Warning: Unused input - see p{part}\n"
        "Error: Error occurred while flattening model O{order}\n\n# Error encountered! Exiting...\n",
        values,
    )
    processed = _written(
        "Error processing file: /work/o{order}.mo\nNotification: Loaded package L{supp}.\n"
        "Error: Too many equations - system {part}.\nError: Optimization {line} failed.\n",
        values,
    )
    bare = _written(
        '"Error: Failed to load package P{part}\nError: Class S{supp} not found.\n"\n', values
    )
    unreadable = _written("Errors #{part}", values)
    quiet = _written("true\nWarning: nothing to do for P{part}\n", values)
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    text = (
        F.when(flag == "A", positioned)
        .when(flag == "N", processed)
        .when(status == "F", bare)
        .when(F.col("l_linenumber") == 1, unreadable)
        .otherwise(quiet)
    )
    root = F.when(F.col("l_suppkey") % 3 == 0, "/work").when(F.col("l_suppkey") % 3 == 1, "/wor")
    return item.select(
        log_key().alias("log_id"), F.coalesce(root, F.lit("/lib")).alias("root"), text.alias("text")
    )


def logs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log of the second dialect per line item, with a warning before an error."""
    item = table(spark, sf_dir, "lineitem")
    values = _numbers()
    warning = _written(
        "Warning: in file '/work/o{order}.mo':\nAt line {qty}, column {line}:\n  Odd S{supp}\n\n", values
    )
    error = _written(
        "Error: in file '/work/o{order}.mo':\nSyntax error at line {line}, column {qty}:\n  Bad P{part}\n",
        values,
    )
    text = F.when(F.col("l_returnflag") == "A", F.concat(warning, error)).otherwise(warning)
    return item.select(log_key().alias("log_id"), text.alias("text"))


def library_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(
        F.concat(F.lit("lib"), "s_suppkey").alias("log_id"),
        F.lit("/lib").alias("root"),
        F.concat(F.lit("Could not load "), "s_name").alias("text"),
    )


def stage_findings(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    """Findings of one stage, their order being the input: line items with flag A are the first, all others the second."""
    flagged = F.col("l_returnflag") == "A"
    item = table(spark, sf_dir, "lineitem").filter(flagged if first else ~flagged)
    return item.select(
        F.concat(F.lit("O"), "l_orderkey").alias("model"),
        F.concat(F.lit("finding "), "l_linenumber", F.lit(" on P"), "l_partkey").alias("message"),
    )


def not_instantiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    return orders.select(F.concat(F.lit("O"), "o_orderkey").alias("model"))


def check_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    text = F.concat(
        F.lit("Check of P"), key, F.lit(" completed successfully.\nClass P"), key, F.lit(" has "),
        size.cast("string"), F.lit(" equation(s) and "), (size + 3).cast("string"),
        F.lit(" variable(s).\n"), (F.col("p_partkey") % 7).cast("string"),
        F.lit(" of these are trivial equation(s).\n"),
    )
    return part.select(F.col("p_brand").alias("corpus"), text.alias("text"))


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run report per order; the order status chooses how the run ended."""
    orders = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    error = F.when(status == "F", F.concat(F.lit("Error: run "), key, F.lit(" broke"))).when(
        status == "O", F.concat(F.lit("Warning: slow step in "), key)
    )
    finished = F.concat(
        F.lit('record SimulationResult\n  resultFile = "/runs/O'), key, F.lit('_res.csv",\n'),
        F.lit('  messages = "  done",\nend SimulationResult;'),
    )
    stopped = F.concat(
        F.lit('record SimulationResult\n  resultFile = "",\n  messages = " stopped at '), key,
        F.lit('",\nend SimulationResult;'),
    )
    result = (
        F.when(status == "O", finished)
        .when(F.col("o_orderpriority") == "5-LOW", "no record")
        .otherwise(stopped)
    )
    return orders.select(
        F.concat(F.lit("O"), key).alias("run_id"), error.alias("error"), result.alias("result")
    )


# ---- events ----------------------------------------------------------------


def run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type as one run, each of its events as one row of measured variables."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        "event_id",
        (F.col("event_id") * 0.5).alias("time"),
        "value",
        F.col("user_id").cast("double").alias("user"),
    )


#: Runs of the event types below have other variables than the rest.
FLOWS = ("purchase", "signup")


def run_groups(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The runs of :func:`run_tables` in two tables with different variables."""
    runs = run_tables(spark, sf_dir)
    flows = F.col("run_id").isin(*FLOWS)
    other = runs.filter(flows).select("run_id", "event_id", F.col("user").alias("_user, id"), "time")
    return [runs.filter(~flows), other]


def registry_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_events(table(spark, sf_dir, "events"))


def registry_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "connect").when(kind == "purchase", "disconnect").otherwise(kind)
    key = F.concat(F.lit("u"), "user_id").alias("key")
    return events.select("ts", "event_id", key, op.alias("op"))


def status_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op = (
        F.when(kind == "signup", "submit")
        .when(kind == "purchase", "finish")
        .when(kind == "error", "fail")
        .when(kind == "click", "poll")
        .otherwise(kind)
    )
    run = F.concat(F.lit("r"), "user_id").alias("run_id")
    return events.select("ts", "event_id", run, op.alias("op"))


def file_changes(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op = (
        F.when(kind == "signup", "create")
        .when(kind == "error", "delete")
        .when(kind == "click", "modify")
        .otherwise(kind)
    )
    path = F.concat(F.lit("/work/f"), "user_id", F.lit(".mo")).alias("path")
    return events.select("ts", "event_id", path, op.alias("op"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


def option_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties with more options around them; an error event adds a boolean one."""
    flag = F.when(F.col("event_type") == "error", ', "verbose": true').otherwise("")
    options = F.concat(
        F.rtrim(F.col("props"), F.lit("}")),
        F.lit(', "solver": "'), "event_type", F.lit('", "stopTime": '),
        F.col("user_id").cast("string"), F.lit(', "outputFormat": "mat"'), flag, F.lit("}"),
    )
    events = table(spark, sf_dir, "events")
    return events.select("event_id", options.alias("options"))


def suggestion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON suggestions; some have an unknown kind, no name, or are cut short."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.concat(F.lit('{"kind": "Model", "name": "e'), "event_id"))
        .when(kind == "view", F.concat(F.lit('{"kind": "Widget", "name": "v'), "event_id", F.lit('"}')))
        .when(kind == "click", F.lit('{"kind": "Model"}'))
        .when(
            kind == "signup",
            F.concat(
                F.lit('{"kind": "Function", "name": "s'), "event_id",
                F.lit('", "parameters": ["Real a", "N'), "user_id", F.lit(' b"], "type": null}'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"name": "p'), "event_id",
                F.lit('", "kind": "Variable", "classComment": "of '), "user_id",
                F.lit('", "type": "Real"}'),
            )
        )
    )
    events = table(spark, sf_dir, "events")
    return events.select("event_id", text.alias("json"))


# ---- documentation ---------------------------------------------------------


def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page tree as classes (class_name, parent, title); a page's title is its comment."""
    from loomlight.operators.trees import path_tree

    paths = page_paths(spark, sf_dir)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    titles = paths.groupBy("path").agg(F.min(title).alias("title"))
    nodes = path_tree(paths)
    return nodes.join(titles, "path", "left").select(
        F.col("path").alias("class_name"), "parent", "label", "is_leaf", "title"
    )


def page_docs(classes: DataFrame) -> DataFrame:
    """Documentation of the page classes: titles for pages, a line for English sections."""
    info = F.when(F.col("is_leaf"), F.coalesce("title", F.lit(""))).when(
        F.col("label").isin("en", "web"), F.concat(F.lit("Section "), "class_name")
    )
    return classes.select(
        "class_name",
        F.coalesce(info, F.lit("")).alias("info"),
        F.concat(F.lit("first "), "label").alias("revisions"),
        F.coalesce("parent", F.lit("top")).alias("header"),
    )


def page_members(classes: DataFrame) -> DataFrame:
    return classes.filter(F.col("parent").isNotNull()).select(
        F.col("parent").alias("class_name"),
        F.col("class_name").alias("member"),
        F.nullif("title", F.lit("")).alias("comment"),
    )
