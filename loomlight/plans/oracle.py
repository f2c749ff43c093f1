"""The same results in DuckDB SQL, written from the raw columns wherever a text is parsed."""

from __future__ import annotations

from loomlight.functions.text import DECLARATION, DECLARATION_COMMENT, KEYWORDS, PRIMITIVE_TYPES
from loomlight.operators.docs import MISSING, PAGE, STYLES
from loomlight.plans.catalog import BLOCK, TOP


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DECL = quoted(DECLARATION.replace(r"(\w[\w\-.]*\s+\w[\w\-]*)", r"(\w[\w\-.]*)\s+(\w[\w\-]*)"))
COMMENT = quoted(DECLARATION_COMMENT.replace(r"\"", '"'))
WORDS = ", ".join(
    f"('{kind}', '{word}')"
    for kind, words in (("Keyword", KEYWORDS), ("Type", PRIMITIVE_TYPES))
    for word in words
)

def shown(column: str) -> str:
    """Text as it stands in a page."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = f"replace({column}, '{sign}', '{name}')"
    return column


FRAGMENTS: dict[str, tuple[str, list[str]]] = {}


def fragment(name: str, text: str, *needs: str) -> None:
    FRAGMENTS[name] = (text, list(needs))


def with_fragments(text: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in FRAGMENTS[name][1]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = ", ".join(f"{name} AS ({FRAGMENTS[name][0]})" for name in ordered)
    return f"WITH {parts} {text}" if parts else text


# ---- names -----------------------------------------------------------------

fragment(
    "nations",
    "SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey",
)
fragment(
    "located",
    "SELECT c.*, r_name, n_name, n_nationkey FROM customer c JOIN nations ON c_nationkey = n_nationkey",
    "nations",
)
fragment(
    "classes",
    """
    SELECT r_name AS name, NULL AS parent, 'package' AS restriction, 'Package' AS kind,
           'Region ' || r_regionkey AS comment, CAST(NULL AS VARCHAR) AS parameters
    FROM region
    UNION ALL
    SELECT r_name || '.' || n_name, r_name, 'package', 'Package', NULL, NULL FROM nations
    UNION ALL
    SELECT r_name || '.' || n_name || '.' || c_name, r_name || '.' || n_name,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'function' WHEN 'BUILDING' THEN 'model'
                WHEN 'FURNITURE' THEN 'type' WHEN 'HOUSEHOLD' THEN 'record' ELSE 'block' END,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Function' WHEN 'BUILDING' THEN 'Model'
                WHEN 'FURNITURE' THEN 'Type' ELSE 'Class' END,
           c_mktsegment || ' account',
           CASE c_mktsegment
                WHEN 'AUTOMOBILE' THEN 'Real key' || c_custkey || '|N' || c_nationkey || ' home'
                WHEN 'BUILDING' THEN 'key' || c_custkey END
    FROM located
    """,
    "located",
)
fragment(
    "name_requests",
    """
    SELECT 'n' || n_nationkey AS req_id,
           r_name || '.' || n_name || '.Customer#00000' || (n_nationkey % 3) AS word,
           r_name || '.' || n_name AS scope FROM nations
    UNION ALL SELECT 'r' || r_regionkey, r_name || '.NATION_1', r_name FROM region
    UNION ALL SELECT 't' || r_regionkey, left(r_name, 2), '' FROM region
    UNION ALL SELECT 'l' || n_nationkey, r_name || '.' || n_name || '.', r_name || '.' || n_name
    FROM nations
    """,
    "nations",
)
fragment(
    "scoped",
    """
    SELECT req_id, word, name, kind FROM name_requests
    JOIN classes ON scope = coalesce(parent, '') WHERE NOT ends_with(word, '.')
    """,
    "name_requests",
    "classes",
)

TAIL = "CASE WHEN contains({0}, '.') THEN regexp_extract({0}, '[^.]*$') ELSE '' END"
HEAD = "CASE WHEN contains({0}, '.') THEN regexp_replace({0}, '\\.[^.]*$', '') ELSE {0} END"
DISTANCE = (
    f"CAST(CASE WHEN ({TAIL.format('word')}) <> '' "
    f"THEN levenshtein({TAIL.format('name')}, {TAIL.format('word')}) "
    f"ELSE levenshtein({HEAD.format('name')}, {HEAD.format('word')}) END AS INTEGER)"
)

# ---- lines and declarations ------------------------------------------------

fragment(
    "document_lines",
    """
    SELECT file, CAST(i AS INTEGER) AS line_no,
           CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS line
    FROM (SELECT 'doc' || doc_id AS file, parts, unnest(parts) AS raw,
                 generate_subscripts(parts, 1) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
    WHERE NOT (i = len(parts) AND raw = '')
    """,
)
fragment(
    "document_variables",
    f"""
    SELECT file, line_no, regexp_extract(line, {DECL}, 1) AS type,
           regexp_extract(line, {DECL}, 2) AS name,
           nullif(regexp_extract(line, {COMMENT}, 1), '') AS comment
    FROM document_lines WHERE regexp_matches(line, {DECL})
    """,
    "document_lines",
)
fragment(
    "order_variables",
    """
    SELECT 'order_' || l_orderkey || '.mo' AS file, l_linenumber AS line_no,
           CASE WHEN l_returnflag = 'A' THEN 'Real' ELSE 'P' || l_partkey END AS type,
           'item' || l_linenumber AS name, l_linestatus AS comment
    FROM lineitem
    """,
)
fragment(
    "part_variables",
    """
    SELECT 'part_' || p_partkey || '.mo' AS file, v.line_no, v.type, v.name, v.comment
    FROM part, LATERAL (VALUES
        (2, 'model', 'P' || p_partkey, NULL),
        (3, 'Real', string_split(p_name, ' ')[1], p_brand),
        (4, 'Integer', string_split(p_name, ' ')[-1], NULL),
        (6, 'P' || p_partkey, 'next', NULL),
        (7, 'end', 'P' || p_partkey, NULL)) v(line_no, type, name, comment)
    """,
)
fragment(
    "order_first",
    """
    SELECT file, name, line_no, type, comment FROM (
        SELECT *, row_number() OVER (PARTITION BY file, name
                                     ORDER BY line_no, type, comment NULLS FIRST) AS n
        FROM order_variables) WHERE n = 1
    """,
    "order_variables",
)
fragment(
    "order_requests",
    """
    SELECT 'o' || o_orderkey AS req_id, 'order_' || o_orderkey || '.mo' AS file,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 7 + 1 AS INTEGER) END AS line,
           'item' || (o_custkey % 7 + 1) AS object
    FROM orders
    """,
)
fragment(
    "supplier_requests",
    """
    SELECT 's' || s_suppkey AS req_id, 'order_' || s_suppkey || '.mo' AS file, 7 AS line,
           'item' || (s_suppkey % 7 + 1) AS object
    FROM supplier
    """,
)
MEMBERS = """
    SELECT r.req_id, r.object || '.s' AS word, r.object || '.' || v.name AS name, v.type, v.comment
    FROM {0} r JOIN order_first d ON d.file = r.file AND d.name = r.object
                                 AND (r.line IS NULL OR d.line_no <= r.line)
    JOIN part_variables v ON d.type <> 'Real'
                         AND v.file = 'part_' || substr(d.type, 2) || '.mo'
"""
fragment(
    "document_requests",
    """
    SELECT 'd' || doc_id AS req_id, 'doc' || doc_id AS file,
           CAST(doc_id % 9 + 1 AS INTEGER) AS line, regexp_extract(text, '[A-Za-z]{1,3}') AS word
    FROM documents
    """,
)
fragment(
    "judged",
    f"""
    WITH typed AS (
        SELECT req_id, word, scope, NULL AS file, NULL AS line FROM name_requests
        WHERE NOT ends_with(word, '.')
        UNION ALL SELECT req_id, word, '', file, line FROM document_requests WHERE word <> ''
        UNION ALL SELECT req_id, object || '.s', object, file, line FROM supplier_requests),
    found AS (
        SELECT req_id, word, v.kind, v.name, NULL AS parameters, NULL AS comment, NULL AS type
        FROM typed, (VALUES {WORDS}) v(kind, name)
        UNION ALL SELECT req_id, word, kind, name, parameters, comment, NULL
        FROM typed JOIN classes ON scope = coalesce(parent, '')
        UNION ALL SELECT req_id, word, 'Variable', name, NULL, comment, type
        FROM typed JOIN (SELECT * FROM document_variables UNION ALL SELECT * FROM order_variables) v
             ON v.file = typed.file AND v.line_no <= typed.line
        UNION ALL SELECT req_id, word, 'Property', name, NULL, comment, type
        FROM ({MEMBERS.format("supplier_requests")}))
    SELECT * FROM (
        SELECT req_id, word, CASE WHEN starts_with(name, word) THEN 0 ELSE 1 END AS tier,
               CASE WHEN starts_with(name, word) THEN 0 ELSE {DISTANCE} END AS distance,
               kind, name, parameters, comment, type
        FROM found)
    WHERE tier = 0 OR distance < length(name)
    UNION ALL
    SELECT req_id, word, 0, 0, kind, name, parameters, comment, NULL
    FROM name_requests JOIN classes ON scope = coalesce(parent, '') WHERE ends_with(word, '.')
    """,
    "name_requests",
    "classes",
    "document_requests",
    "supplier_requests",
    "document_variables",
    "order_first",
    "part_variables",
)

# ---- paths -----------------------------------------------------------------

fragment(
    "page_paths",
    """
    SELECT 'web/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''),
               '[?#].*$', ''), '/+$', '') AS path, page_id, CAST(length(html) AS BIGINT) AS n_chars, html
    FROM pages
    """,
)


def nodes_of(paths: str) -> str:
    return f"""
    SELECT array_to_string(steps, '/') AS path,
           CASE WHEN len(steps) > 1 THEN array_to_string(steps[1:len(steps) - 1], '/') END AS parent,
           steps[-1] AS label, CAST(len(steps) AS INTEGER) AS depth, bool_and(leaf) AS is_leaf
    FROM (SELECT all_steps[1:n] AS steps, n = len(all_steps) AS leaf
          FROM (SELECT all_steps, unnest(generate_series(1, len(all_steps))) AS n
                FROM (SELECT DISTINCT string_split(path, '/') AS all_steps FROM {paths})))
    GROUP BY steps
    """


fragment("page_nodes", nodes_of("page_paths"), "page_paths")
fragment(
    "customer_paths",
    """
    SELECT DISTINCT '/' || r_name || '/' || n_name || '/' ||
           CASE WHEN c_custkey % 50 = 0 THEN 'package.mo' ELSE c_name || '.mo' END AS path
    FROM located
    UNION
    SELECT '/' || r_name || '/' || CASE WHEN r_regionkey = 4 THEN 'package.mo' ELSE 'notes.mo' END
    FROM region
    """,
    "located",
)
fragment(
    "marked",
    """
    SELECT regexp_replace(path, '/package.mo$', '') AS root FROM customer_paths
    WHERE ends_with(path, '/package.mo')
    """,
    "customer_paths",
)
fragment(
    "roots",
    """
    SELECT root FROM marked m
    WHERE NOT EXISTS (SELECT 1 FROM marked a WHERE starts_with(m.root, a.root || '/'))
    """,
    "marked",
)
fragment(
    "outside",
    """
    SELECT path FROM customer_paths f
    WHERE NOT EXISTS (SELECT 1 FROM roots WHERE starts_with(f.path, root || '/'))
    """,
    "customer_paths",
    "roots",
)

# ---- logs ------------------------------------------------------------------

fragment(
    "findings",
    """
    WITH item AS (
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS log_id,
               CASE l_suppkey % 3 WHEN 0 THEN '/work' WHEN 1 THEN '/wor' ELSE '/lib' END AS root,
               CAST(l_quantity AS INTEGER) AS q, l_linenumber AS ln, * FROM lineitem)
    SELECT log_id, root, 0 AS seq, 'Error' AS type, '/work/o' || l_orderkey || '.mo' AS file,
           ln AS start_line, q AS start_column, ln + 1 AS end_line, q + 7 AS end_column,
           'Class P' || l_partkey || ' not found in scope S' || l_suppkey || '.' AS message
    FROM item WHERE l_returnflag = 'A'
    UNION ALL
    SELECT log_id, root, 1, 'Warning', '/lib/S' || l_suppkey || '.mo', q, 1, q, 9,
           'Unused input' || chr(10) || '- see p' || l_partkey
    FROM item WHERE l_returnflag = 'A'
    UNION ALL
    SELECT log_id, root, 0, 'Error', '/work/o' || l_orderkey || '.mo', 0, 0, 0, 0,
           'Too many equations' || chr(10) || '- system ' || l_partkey || '.'
    FROM item WHERE l_returnflag = 'N'
    UNION ALL
    SELECT log_id, root, 0, 'Error', '', 0, 0, 0, 0, 'Failed to load package P' || l_partkey
    FROM item WHERE l_returnflag = 'R' AND l_linestatus = 'F'
    UNION ALL
    SELECT log_id, root, 1, 'Error', '', 0, 0, 0, 0, 'Class S' || l_suppkey || ' not found.'
    FROM item WHERE l_returnflag = 'R' AND l_linestatus = 'F'
    UNION ALL
    SELECT log_id, root, 0, 'Error', '', 0, 0, 0, 0,
           'Couldn''t understand compiler:' || chr(10) || 'Errors #' || l_partkey
    FROM item WHERE l_returnflag = 'R' AND l_linestatus <> 'F' AND l_linenumber = 1
    """,
)

# ---- events ----------------------------------------------------------------

fragment(
    "calls",
    """
    SELECT ts, event_id, 'u' || user_id AS key,
           CASE event_type WHEN 'signup' THEN 'connect' ELSE 'disconnect' END AS op,
           CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS step
    FROM events WHERE event_type IN ('signup', 'purchase')
    """,
)
fragment("summed", "SELECT *, sum(step) OVER o AS s FROM calls WINDOW o AS (PARTITION BY key ORDER BY ts, event_id)", "calls")
fragment(
    "counted",
    """
    SELECT *, CAST(s - least(0, min(s) OVER o) AS BIGINT) AS clients
    FROM summed WINDOW o AS (PARTITION BY key ORDER BY ts, event_id)
    """,
    "summed",
)
fragment(
    "compared",
    """
    SELECT *, coalesce(lag(clients) OVER (PARTITION BY key ORDER BY ts, event_id), 0) AS clients_before
    FROM counted
    """,
    "counted",
)
fragment(
    "totals",
    """
    SELECT *, CAST(sum(clients - clients_before) OVER (ORDER BY ts, event_id) AS BIGINT) AS total_clients
    FROM compared
    """,
    "compared",
)
fragment(
    "registrations",
    """
    SELECT key, event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS project_id
    FROM compared WHERE clients_before = 0 AND clients = 1
    """,
    "compared",
)
STATUS = """
    SELECT run_id, event_id, coalesce(status, 'unknown') AS status FROM (
        SELECT 'r' || user_id AS run_id, event_id, event_type,
               last_value(CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'finished'
                          WHEN 'error' THEN 'failed' END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY ts, event_id) AS status
        FROM events) WHERE event_type = 'click'
"""
RECENT = f"""
    SELECT user_id AS item, count(*) AS hits FROM events
    GROUP BY user_id ORDER BY hits DESC, item LIMIT {TOP}
"""

# ---- documentation ---------------------------------------------------------

fragment(
    "page_classes",
    """
    SELECT n.path AS class_name, parent, label, is_leaf, title
    FROM page_nodes n LEFT JOIN (
        SELECT path, min(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title
        FROM page_paths GROUP BY path) t ON n.path = t.path
    """,
    "page_nodes",
    "page_paths",
)
fragment(
    "page_docs",
    """
    SELECT class_name, 'first ' || label AS revisions, coalesce(parent, 'top') AS header,
           CASE WHEN is_leaf THEN coalesce(title, '')
                WHEN label IN ('en', 'web') THEN 'Section ' || class_name ELSE '' END AS info
    FROM page_classes
    """,
    "page_classes",
)
fragment(
    "member_blocks",
    f"""
    SELECT parent AS class_name, (n - 1) // {BLOCK} AS block, max(total) AS n_members,
           string_agg(CASE WHEN comment IS NULL THEN member ELSE member || ' - ' || comment END,
                      '|' ORDER BY n) AS members,
           string_agg('<li><a href="?class=' || url_encode(member) || '">' || {shown("member")} || '</a>' ||
                      coalesce(' - ' || {shown("comment")}, '') || '</li>', chr(10) ORDER BY n) AS items
    FROM (SELECT parent, class_name AS member, nullif(title, '') AS comment,
                 row_number() OVER (PARTITION BY parent ORDER BY class_name) AS n,
                 count(*) OVER (PARTITION BY parent) AS total
          FROM page_classes WHERE parent IS NOT NULL)
    GROUP BY 1, 2
    """,
    "page_classes",
)
fragment(
    "documented",
    """
    SELECT d.class_name, info, revisions, header, CAST(coalesce(n_members, 0) AS BIGINT) AS n_members,
           CAST(coalesce(block, 0) AS BIGINT) AS block, coalesce(members, '') AS members,
           coalesce(items, '') AS items
    FROM page_docs d LEFT JOIN member_blocks b ON d.class_name = b.class_name WHERE info <> ''
    """,
    "page_docs",
    "member_blocks",
)


def filled(template: str) -> str:
    text = quoted(template)
    places = (
        ("className", "class_name"), ("info-header", "header"), ("info-string", "info"),
        ("revisions", "revisions"), ("styles", quoted(STYLES)),
    )
    for key, value in places:
        if "{" + key + "}" in template:
            text = f"replace({text}, '{{{key}}}', {value})"
    return text


PAGE_HEAD, PAGE_TAIL = PAGE.split("{subcomponents}")

RUN_CELLS = """
    SELECT event_type AS run_id, event_id, v.variable, v.value FROM events, LATERAL (VALUES
        ('time', event_id * 0.5::DOUBLE), ('value', value), ('user', CAST(user_id AS DOUBLE))) v(variable, value)
"""

ORACLES: dict[str, str] = {
    "corpus_inventory": with_fragments(
        "SELECT path, string_split(path, '/')[-1] AS file_name FROM customer_paths", "customer_paths"
    ),
    "corpus_lines": with_fragments("SELECT * FROM document_lines", "document_lines"),
    "vocab_source": with_fragments(
        f"""SELECT kind, v.name, count(l.word) AS n_uses
            FROM (VALUES {WORDS}) v(kind, name) LEFT JOIN (
                SELECT unnest(regexp_extract_all(line, '\\w+')) AS word FROM document_lines) l
            ON l.word = v.name GROUP BY ALL""",
        "document_lines",
    ),
    "run_results_long": f"""
        SELECT run_id, variable, value,
               CAST(row_number() OVER (PARTITION BY run_id, variable ORDER BY event_id) - 1 AS BIGINT) AS row_idx
        FROM (SELECT run_id, event_id, value,
                     CASE WHEN run_id IN ('purchase', 'signup') AND variable = 'user' THEN '_user, id'
                          ELSE variable END AS variable
              FROM ({RUN_CELLS}) WHERE run_id NOT IN ('purchase', 'signup') OR variable <> 'value')""",
    "class_catalogue": """
        SELECT scope || c.name AS class_name, rtrim(scope || c.parent, '.') AS parent, c.restriction, file, c.line_no
        FROM (SELECT 'lib/P' || p_partkey || '.mo' AS file, p_partkey,
                     'Lib.' || replace(p_brand, '#', '_') || '.' AS scope FROM part),
        LATERAL (VALUES
            ('P' || p_partkey, '', 'package', 2),
            ('P' || p_partkey || '.Size', 'P' || p_partkey, 'type', 7),
            ('P' || p_partkey || '.Pair', 'P' || p_partkey, 'record', 7),
            ('P' || p_partkey || '.Outer', 'P' || p_partkey, 'model', 8),
            ('P' || p_partkey || '.Outer.Inner', 'P' || p_partkey || '.Outer', 'model', 10),
            ('P' || p_partkey || '.Last', 'P' || p_partkey, 'block', 21),
            ('P' || p_partkey || '.Late', 'P' || p_partkey, 'type', 24)) c(name, parent, restriction, line_no)
        UNION ALL
        SELECT 'Lib.Basic' || r_regionkey || c.name, CASE WHEN c.name = '' THEN 'Lib' ELSE 'Lib.Basic' || r_regionkey END,
               c.restriction, 'lib/Basic' || r_regionkey || '.mo', c.line_no
        FROM region,
        LATERAL (VALUES ('', 'package', 2), ('.Point', 'record', 3),
                        ('.Only' || r_regionkey, 'record', 4)) c(name, restriction, line_no)""",
    "json_ingest": """
        SELECT event_id, event_type IN ('signup', 'purchase') AS accepted,
               CASE event_type WHEN 'signup' THEN 'Function' WHEN 'purchase' THEN 'Variable' END AS kind,
               CASE event_type WHEN 'signup' THEN 's' || event_id WHEN 'purchase' THEN 'p' || event_id END AS name,
               CASE event_type WHEN 'signup' THEN 'Real a|N' || user_id || ' b' END AS parameters,
               CASE event_type WHEN 'purchase' THEN 'of ' || user_id END AS class_comment,
               CASE event_type WHEN 'purchase' THEN 'Real' END AS type
        FROM events""",
    "json_egress": with_fragments(
        """SELECT '{"name":"' || name || '","type":"' || type || '"' ||
                  CASE WHEN comment = 'F' THEN ',"comment":"F"' ELSE '' END || '}' AS json
           FROM order_variables""",
        "order_variables",
    ),
    "recent_snapshot": """
        SELECT user_id AS item, count(*) AS hits FROM events GROUP BY user_id""",
    "docs_site": with_fragments(
        f"""SELECT class_name, block AS part,
                   CASE WHEN block = 0 THEN {filled(PAGE_HEAD + "<ul>")} ELSE '' END || items ||
                   CASE WHEN block = greatest(0, (n_members + {BLOCK} - 1) // {BLOCK} - 1)
                        THEN {filled("</ul>" + PAGE_TAIL)} ELSE '' END AS html
            FROM documented
            UNION ALL SELECT class_name, 0, {filled(MISSING)} FROM page_docs WHERE info = ''""",
        "documented",
        "page_docs",
    ),
    "prefix_match": with_fragments(
        """SELECT word, name FROM (SELECT DISTINCT p_name AS name FROM part),
                  (SELECT DISTINCT left(string_split(p_name, ' ')[1], 3) AS word FROM part)
           WHERE starts_with(name, word)
           UNION ALL SELECT word, name FROM scoped WHERE starts_with(name, word)""",
        "scoped",
    ),
    "prefix_nonmatch": with_fragments(
        "SELECT req_id, word, name, kind FROM scoped WHERE NOT starts_with(name, word)", "scoped"
    ),
    "position_filter": with_fragments(
        """SELECT req_id, line_no, type, name
           FROM document_requests r JOIN document_variables v ON v.file = r.file AND line_no <= line""",
        "document_requests",
        "document_variables",
    ),
    "project_scope_filter": with_fragments(
        """SELECT log_id, root, seq, file FROM findings
           WHERE file = '' OR file = root OR starts_with(file, root || '/') OR ends_with(file, '.mos')""",
        "findings",
    ),
    "subtree_prune": with_fragments(
        """SELECT path, is_leaf FROM page_nodes
           WHERE NOT list_contains(CASE WHEN is_leaf THEN string_split(path, '/')[1:depth - 1]
                                        ELSE string_split(path, '/') END, 'de')
             AND NOT regexp_matches(path, '(^|/)[.]')""",
        "page_nodes",
    ),
    "tree_filter": with_fragments(
        "SELECT path, label, depth FROM page_nodes WHERE depth = 2 OR ends_with(label, '.html')", "page_nodes"
    ),
    "type_lookup": with_fragments(
        """SELECT req_id, name, type, comment FROM order_requests r
           JOIN order_first d ON d.file = r.file AND d.name = r.object
           WHERE line IS NULL OR line_no <= line""",
        "order_requests",
        "order_first",
    ),
    "class_source_lookup": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS req_id,
               CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'Modelica.P' END || l_partkey AS word,
               CASE WHEN l_linestatus = 'F' AND p_partkey IS NOT NULL
                    THEN 'part_' || l_partkey || '.mo' END AS source_file
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "declaration_lookup": with_fragments(
        """SELECT 'o' || o_orderkey AS req_id, word,
                  CASE WHEN p_partkey IS NOT NULL THEN 'part_' || p_partkey || '.mo'
                       WHEN r_regionkey IS NOT NULL THEN 'lib/Basic' || r_regionkey || '.mo' ELSE d.file END AS declared_in,
                  CASE WHEN p_partkey IS NOT NULL THEN 2 WHEN r_regionkey IS NOT NULL THEN 3
                       ELSE d.line_no END AS declared_at
           FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'P' || o_custkey
                        WHEN 'O' THEN 'item' || (o_custkey % 7 + 1) ELSE 'Lib.Basic' || (o_orderkey % 7) || '.Point' END AS word,
                        CASE o_orderstatus WHEN 'F' THEN o_custkey END AS wanted,
                        CASE o_orderstatus WHEN 'P' THEN o_orderkey % 7 END AS basic
                 FROM orders) r
           LEFT JOIN part ON p_partkey = wanted LEFT JOIN region ON r_regionkey = basic
           LEFT JOIN order_first d ON d.file = 'order_' || o_orderkey || '.mo' AND d.name = word
           UNION ALL
           SELECT 'p' || p_partkey, 'Lib.' || replace(p_brand, '#', '_') || '.P' || p_partkey || ending,
                  CASE WHEN line_no > 0 THEN 'lib/P' || p_partkey || '.mo' END, nullif(line_no, 0)
           FROM part JOIN (VALUES (0, '', 2), (1, '.Late', 24), (2, '.Outer.Inner', 10), (3, '.Hidden', 0),
                                  (4, '.Last', 21)) e(kind, ending, line_no) ON kind = p_partkey % 5""",
        "order_first",
    ),
    "namespace_children": with_fragments(
        """SELECT req_id, name, kind, parameters, comment
           FROM name_requests JOIN classes ON scope = coalesce(parent, '')""",
        "name_requests",
        "classes",
    ),
    "member_access": with_fragments(
        MEMBERS.format("order_requests")
        + """
        UNION ALL
        SELECT 'p' || p_partkey, object || '.s', object || '.' || v.name, v.type, v.comment
        FROM (SELECT p_partkey, ['part', 'both', 'where', 'one', 'far'][p_partkey // 3 % 5 + 1] AS object FROM part),
        LATERAL (VALUES
            (false, 'a', 'Real', NULL), (false, 'part', 'Inner', 'own'), (false, 'both', 'Pair', NULL),
            (false, 'where', 'Point', 'at'), (false, 'one', 'Only' || ((p_partkey + 1) % 5), NULL),
            (false, 'far', 'P' || p_partkey || '.Outer.Inner', NULL),
            (true, 'only', 'Real', NULL)) v(elsewhere, name, type, comment)
        WHERE elsewhere = (object IN ('where', 'one'))
        """,
        "order_requests", "order_first", "part_variables",
    ),
    "files_outside_packages": with_fragments("SELECT path FROM outside", "outside"),
    "gated_diagnostics": """
        WITH found AS (
            SELECT 'O' || l_orderkey AS model, l_returnflag AS flag,
                   'finding ' || l_linenumber || ' on P' || l_partkey AS message FROM lineitem)
        SELECT model, message, 1 AS stage FROM found WHERE flag = 'A'
        UNION ALL
        SELECT model, message, 2 FROM found f WHERE flag <> 'A'
          AND NOT EXISTS (SELECT 1 FROM found a WHERE a.flag = 'A' AND a.model = f.model)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND 'O' || o_orderkey = f.model)""",
    "class_docs": with_fragments(
        "SELECT class_name, info, revisions, header, n_members, block, members FROM documented", "documented"
    ),
    "run_status_asof": STATUS,
    "subtree_size": with_fragments(
        """SELECT path, count(*) AS size
           FROM (SELECT array_to_string(s[1:n], '/') AS path
                 FROM (SELECT s, unnest(generate_series(1, len(s))) AS n
                       FROM (SELECT string_split(path, '/') AS s FROM page_nodes)))
           GROUP BY path""",
        "page_nodes",
    ),
    "tree_intervals": with_fragments(
        """SELECT path, pre, size, total
           FROM (SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS pre FROM page_nodes)
           JOIN (SELECT array_to_string(s[1:n], '/') AS path, count(*) AS size, CAST(sum(len(s)) AS BIGINT) AS total
                 FROM (SELECT s, unnest(generate_series(1, len(s))) AS n
                       FROM (SELECT string_split(path, '/') AS s FROM page_nodes)) GROUP BY ALL) USING (path)""",
        "page_nodes",
    ),
    "tree_ordered_fold": with_fragments(
        """SELECT site, CAST(100 * (-1) ** max(n) + sum(depth * (-1) ** (n - 1 - i)) AS BIGINT) AS folded
           FROM (SELECT site, depth, count(*) OVER (PARTITION BY site) AS n,
                        row_number() OVER (PARTITION BY site ORDER BY s) - 1 AS i
                 FROM (SELECT string_split(path, '/') AS s, len(string_split(path, '/')) AS depth,
                              coalesce(string_split(path, '/')[2], '') AS site FROM page_nodes)) GROUP BY site""",
        "page_nodes",
    ),
    "tree_fold": with_fragments(
        """SELECT path, CAST(sum(c) AS BIGINT) AS total, min(c) AS low, max(c) AS high, count(*) AS n
           FROM (SELECT array_to_string(s[1:n], '/') AS path, c
                 FROM (SELECT s, c, unnest(generate_series(1, len(s))) AS n
                       FROM (SELECT string_split(path, '/') AS s, n_chars AS c FROM page_paths)))
           GROUP BY path""",
        "page_paths",
    ),
    "run_series": f"""
        SELECT run_id, variable, event_id // 1000 AS block,
               string_agg(CAST(value AS VARCHAR), '|' ORDER BY event_id) AS values
        FROM ({RUN_CELLS}) GROUP BY ALL""",
    "registry_counts": with_fragments(
        """SELECT count(*) FILTER (WHERE clients > 0) AS projects, CAST(sum(clients) AS BIGINT) AS clients
           FROM (SELECT key, arg_max(clients, struct_pack(ts, event_id)) AS clients FROM counted GROUP BY key)""",
        "counted",
    ),
    "model_size": """
        SELECT p_brand AS corpus, count(*) AS classes, CAST(sum(p_size) AS BIGINT) AS equations,
               CAST(sum(p_size + 3) AS BIGINT) AS variables, CAST(sum(p_partkey % 7) AS BIGINT) AS trivial
        FROM part GROUP BY p_brand""",
    "completion_summary": with_fragments(
        f"""SELECT req_id, max(total) AS n_suggestions, max(prefix) AS n_prefix, max(total - prefix) AS n_fuzzy,
                   (n - 1) // {BLOCK} AS block, string_agg(shown, '|' ORDER BY n) AS displays
            FROM (SELECT req_id, kind || ' - ' || name AS shown,
                         row_number() OVER (PARTITION BY req_id ORDER BY kind || ' - ' || name, tier) AS n,
                         count(*) OVER (PARTITION BY req_id) AS total,
                         count(*) FILTER (WHERE tier = 0) OVER (PARTITION BY req_id) AS prefix
                  FROM judged)
            GROUP BY req_id, (n - 1) // {BLOCK}""",
        "judged",
    ),
    "distinct_classes": """
        SELECT DISTINCT p_name AS name, CASE WHEN p_size > 25 THEN 'Model' ELSE 'Class' END AS kind FROM part""",
    "first_declaration": with_fragments(
        """SELECT file, name, line_no, type, comment FROM (
               SELECT *, row_number() OVER (PARTITION BY file, name
                                            ORDER BY line_no, type, comment NULLS FIRST) AS n
               FROM document_variables) WHERE n = 1""",
        "document_variables",
    ),
    "registry_ids": with_fragments("SELECT key, project_id, event_id FROM registrations", "registrations"),
    "registry_refcount": with_fragments(
        "SELECT event_id, key, op, clients, total_clients FROM totals", "totals"
    ),
    "fuzzy_rank": with_fragments(
        f"""SELECT * FROM (SELECT req_id, word, {DISTANCE} AS distance, name, kind
                           FROM scoped WHERE NOT starts_with(name, word))
            WHERE distance < length(name)""",
        "scoped",
    ),
    "recent_topk": RECENT,
    "load_order": with_fragments(
        """SELECT 0 AS stage, '/lib/' || s_name AS path FROM supplier
           UNION ALL SELECT 1, root || '/package.mo' FROM roots
           UNION ALL SELECT 2, path FROM outside""",
        "roots",
        "outside",
    ),
    "tree_preorder": with_fragments(
        "SELECT path, depth, repeat('  ', depth - 1) || '- ' || label AS text FROM page_nodes", "page_nodes"
    ),
    "tree_find": with_fragments(
        """SELECT path, depth FROM page_nodes WHERE ends_with(label, '.html')
           ORDER BY string_split(path, '/') LIMIT 1""",
        "page_nodes",
    ),
    "completion_union": with_fragments("SELECT * FROM judged", "judged"),
    "diagnostics_union": with_fragments(
        """SELECT 'lib' || s_suppkey AS log_id, 0 AS part, 0 AS seq, 'Warning' AS type, '' AS file,
                  'Could not load ' || s_name AS message FROM supplier
           UNION ALL SELECT log_id, 1, seq, type, file, message FROM findings""",
        "findings",
    ),
    "extract_variables": with_fragments("SELECT * FROM document_variables", "document_variables"),
    "extract_classes": """
        SELECT 'part_' || p_partkey || '.mo' AS file, 2 AS line_no, 'model' AS restriction,
               'P' || p_partkey AS class_name FROM part""",
    "extract_parameters": with_fragments("SELECT name, kind, parameters FROM classes", "classes"),
    "class_kind": with_fragments("SELECT name, restriction, kind FROM classes", "classes"),
    "class_comments": with_fragments("SELECT name, comment FROM classes", "classes"),
    "diagnostics_a": with_fragments("SELECT * EXCLUDE (root) FROM findings", "findings"),
    "diagnostics_b": """
        WITH item AS (
            SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS log_id,
                   '/work/o' || l_orderkey || '.mo' AS file, CAST(l_quantity AS INTEGER) AS q, * FROM lineitem)
        SELECT log_id, 0 AS part, 0 AS seq, 'Error' AS type, file, l_linenumber AS start_line,
               q AS start_column, l_linenumber AS end_line, q AS end_column, 'Bad P' || l_partkey AS message
        FROM item WHERE l_returnflag = 'A'
        UNION ALL
        SELECT log_id, 1, 0, 'Warning', file, q, l_linenumber, q, l_linenumber, 'Odd S' || l_suppkey FROM item""",
    "run_outcome": """
        SELECT 'O' || o_orderkey AS run_id,
               CASE WHEN o_orderstatus = 'O' THEN 'finished' ELSE 'failed' END AS status,
               CASE WHEN o_orderstatus = 'O' THEN '/runs/O' || o_orderkey || '_res.csv' END AS result_file,
               CASE WHEN o_orderstatus = 'F' THEN 'simulating failed with: Error: run ' || o_orderkey || ' broke'
                    WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
                    THEN 'the result string didn''t contain a ''resultFile'' property'
                    WHEN o_orderstatus = 'P' THEN 'stopped at ' || o_orderkey END AS failure,
               CASE WHEN o_orderstatus = 'O' THEN 'Warning: slow step in ' || o_orderkey END AS warning
        FROM orders""",
    "request_options": """
        SELECT event_id, event_type <> 'error' AS accepted,
               CASE WHEN event_type <> 'error' THEN 'k=' || json_extract_string(props, '$.k') ||
                    '|outputFormat="csv"|solver="' || event_type || '"|stopTime=' || user_id END AS arguments
        FROM events""",
    "namespace_table": with_fragments(
        "SELECT name, parent, string_split(name, '.')[-1] AS simple FROM classes", "classes"
    ),
    "path_canonical": "SELECT 'C:/work/s' || l_suppkey AS path, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "strip_comments": """
        SELECT 'part_' || p_partkey || '.mo' AS file,
               chr(10) || 'model P' || p_partkey || chr(10) || '  Real ' || string_split(p_name, ' ')[1] || ' "' ||
               p_brand || '";' || chr(10) || '  parameter Integer ' || string_split(p_name, ' ')[-1] || ';' || chr(10) ||
               '  ' || chr(10) || ' P' || p_partkey || ' next;' || chr(10) || 'end P' || p_partkey || ';' || chr(10) AS text
        FROM part
        UNION ALL
        SELECT 'doc' || doc_id, array_to_string(list_transform(
                   regexp_extract_all(text, '(?s)/\\*.*?\\*/|//[^\\n]*|[^/]+|/'),
                   lambda t: CASE WHEN starts_with(t, '//') OR starts_with(t, '/*')
                                  THEN regexp_replace(t, '[^\\n]', '', 'g') ELSE t END), '')
        FROM documents""",
    "path_tree": with_fragments("SELECT * FROM page_nodes", "page_nodes"),
    "package_roots": with_fragments("SELECT root FROM roots", "roots"),
    "tree_upsert": with_fragments(
        nodes_of(
            "(SELECT path FROM page_paths UNION SELECT path || '/part' || (page_id % 2) FROM page_paths)"
        ),
        "page_paths",
    ),
    "validate_projects": with_fragments(
        """,
        files AS (
            SELECT path FROM customer_paths
            UNION SELECT CASE WHEN n_nationkey % 2 = 0 THEN '/' || r_name || '/' || n_name || '/build.mos'
                              ELSE '/shared/build.mos' END FROM nations),
        directories AS (
            SELECT DISTINCT '/' || r_name || '/' || n_name AS path FROM located
            UNION SELECT '/' || r_name || '/' || n_name FROM nations WHERE n_nationkey % 2 = 0),
        wanted AS (
            SELECT 'c' || c_custkey AS project,
                   CASE c_custkey % 3 WHEN 0 THEN '/' || r_name || '/' || n_name
                        WHEN 1 THEN '/' || r_name || '/' || n_name || '/' || c_name || '.mo'
                        ELSE '/none/' || c_name END AS path,
                   CASE c_mktsegment WHEN 'BUILDING' THEN 'build.mos' WHEN 'MACHINERY' THEN 'package.mo' END AS script
            FROM located)
        SELECT project, path, concat_ws('|',
               CASE WHEN path IN (SELECT path FROM files) THEN '`' || path || '` isn''t a directory'
                    WHEN path NOT IN (SELECT path FROM directories) THEN '`' || path || '` doesn''t exist' END,
               CASE WHEN script IS NOT NULL AND NOT (ends_with(script, '.mos')
                         AND path || '/' || script IN (SELECT path FROM files))
                    THEN path || '/' || script || ' isn''t a regular *.mos file!' END) AS errors
        FROM wanted""",
        "customer_paths",
        "located",
    ).replace(")  ,", "),").replace(") ,", "),"),
    "file_index_stream": """
        SELECT path, ts FROM (
            SELECT '/work/f' || user_id || '.mo' AS path, event_type, ts,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
            FROM events WHERE event_type IN ('signup', 'error'))
        WHERE n = 1 AND event_type = 'signup'""",
    "registry_stream": with_fragments(
        """SELECT t.event_id, t.key, op, clients, total_clients, project_id
           FROM totals t LEFT JOIN registrations r ON t.event_id = r.event_id""",
        "totals",
        "registrations",
    ),
    "recent_stream": RECENT,
    "run_status_stream": STATUS,
}
