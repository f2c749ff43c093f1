"""Column functions over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """One separator for mixed '/', '\\', '\\/' and '//'; a drive letter stays."""
    return F.regexp_replace(path, r"[/\\]{1,2}", "/")


def plain(path: Column) -> Column:
    """The canonical path without a final separator; the root of all is empty."""
    return F.rtrim(canonical(path), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory a path lies in; null at the top."""
    kept = F.length(path) - F.length(file_name(path)) - 1
    return F.when(kept > 0, F.substring(path, F.lit(1), kept))


def segments(path: Column) -> Column:
    """Path steps from the top; comparing these arrays gives preorder."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def ancestors_and_self(path: Column) -> Column:
    """Every leading part of the path, shortest first, the path itself last."""
    steps = segments(path)
    lead = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))),
        lambda n: F.concat(lead, F.array_join(F.slice(steps, F.lit(1), n), "/")),
    )
    return F.when(F.size(steps) == 0, F.array().cast("array<string>")).otherwise(every)


def depth(path: Column) -> Column:
    return F.size(segments(path))


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def lies_under(path: Column, root: Column) -> Column:
    """True for the root itself and everything below it; 'root2' is not below 'root'.

    Both may be written with other separators, and the root with a final one.
    """
    return (plain(path) == plain(root)) | F.startswith(plain(path), F.concat(plain(root), F.lit("/")))
