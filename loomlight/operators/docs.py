"""Documentation of classes, as rows and as pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.operators.ordering import ordered_blocks

STYLES = "body { font-family: sans-serif } .part { margin: 1em }"
PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{className}</title><style>{styles}</style></head>
<body><h1>{className}</h1>
<div class="part"><h2>Members</h2>{subcomponents}</div>
<div class="part"><h2>Header</h2>{info-header}</div>
<div class="part"><h2>Information</h2>{info-string}</div>
<div class="part"><h2>Revisions</h2>{revisions}</div>
</body></html>"""
MISSING = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{className}</title><style>{styles}</style></head>
<body><h1>No documentation for {className}</h1></body></html>"""


def fill(template: Column, values: Sequence[tuple[str, Column]]) -> Column:
    """Put values into ``{key}`` places, in the order given; a missing value is empty."""
    for key, value in values:
        template = F.replace(template, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return template


def list_value(items: Column) -> Column:
    """A list as it appears in a template."""
    return F.concat(F.lit("<ul>"), F.array_join(items, "\n"), F.lit("</ul>"))


def class_docs(docs: DataFrame, members: DataFrame, size: int = 512) -> DataFrame:
    """Documented classes with their members, sorted by name, in blocks of at most ``size``.

    ``docs`` is (class_name, info, revisions, header); an empty info means there is
    none. ``members`` is (class_name, member, comment). A class without members has one
    block with an empty list. ``last_block`` is the number of the class's last block.
    """
    present = docs.filter("info <> ''")
    known = members.join(present.select("class_name"), "class_name", "left_semi")
    once = known.groupBy("class_name", "member").agg(F.max("comment").alias("comment"))
    member = F.struct(F.col("member").alias("class_name"), F.col("comment").alias("comment"))
    blocks = ordered_blocks(once, ["class_name"], ["member"], member, "members", size)
    counts = once.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_members"))
    empty = F.array().cast("array<struct<class_name:string,comment:string>>")
    return (
        present.join(counts, "class_name", "left")
        .join(blocks, "class_name", "left")
        .select(
            *docs.columns,
            F.coalesce("n_members", F.lit(0)).cast("bigint").alias("n_members"),
            F.coalesce("block", F.lit(0)).cast("bigint").alias("block"),
            F.coalesce("members", empty).alias("members"),
            F.greatest(F.lit(0), F.ceil(F.coalesce("n_members", F.lit(0)) / size) - 1).cast("bigint").alias("last_block"),
        )
    )


def escaped(text: Column) -> Column:
    """Text as it stands in a page."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def member_link(name: Column, comment: Column) -> Column:
    """One member as a list entry with a link, and its comment if there is one."""
    shown = F.coalesce(F.concat(F.lit(" - "), escaped(comment)), F.lit(""))
    link = F.concat(F.lit("<li><a href=\"?class="), F.url_encode(name), F.lit('">'))
    return F.concat(link, escaped(name), F.lit("</a>"), shown, F.lit("</li>"))


def docs_site(classes: DataFrame, documented: DataFrame, template: str = PAGE) -> DataFrame:
    """One page per class as (class_name, part, html); classes without docs get a page that says so.

    ``documented`` is the result of :func:`class_docs`. The parts of a page in order
    are the page: the first one opens it, the last one closes it, and each carries one
    block of members. A page with up to one block is one part.
    """
    head, tail = template.split("{subcomponents}")
    values = [
        ("className", F.col("class_name")),
        ("info-header", F.col("header")),
        ("info-string", F.col("info")),
        ("revisions", F.col("revisions")),
        ("styles", F.lit(STYLES)),
    ]
    items = F.array_join(F.transform("members", lambda m: member_link(m["class_name"], m["comment"])), "\n")
    opening = F.when(F.col("block") == 0, fill(F.lit(head + "<ul>"), values)).otherwise("")
    closing = F.when(F.col("block") == F.col("last_block"), fill(F.lit("</ul>" + tail), values)).otherwise("")
    pages = documented.select(
        "class_name", F.col("block").alias("part"), F.concat(opening, items, closing).alias("html")
    )
    described = documented.select("class_name").distinct()
    undescribed = classes.select("class_name").distinct().join(described, "class_name", "left_anti")
    missing = undescribed.select(
        "class_name",
        F.lit(0).cast("bigint").alias("part"),
        fill(F.lit(MISSING), [values[0], values[-1]]).alias("html"),
    )
    return pages.unionByName(missing)


def write_site(pages: DataFrame, path: str, buckets: int = 64) -> None:
    """Write pages as text below ``path/bucket=n``, each page's parts in order."""
    placed = pages.withColumn("bucket", F.pmod(F.xxhash64("class_name"), F.lit(buckets)))
    (
        placed.repartitionByRange("bucket", "class_name", "part")
        .sortWithinPartitions("bucket", "class_name", "part")
        .select("bucket", F.col("html").alias("value"))
        .write.partitionBy("bucket")
        .text(path)
    )
