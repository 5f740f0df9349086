"""Paths, globs and repository addresses as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of prose; refs that move.
PROSE = [".md", ".mdx", ".rst", ".txt"]
MOVING = ["head", "main", "master"]


def path_problem(path: Column) -> Column:
    """Why a path is refused, or null."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.when(path.isNull() | (p == ""), "empty").when(p.startswith("/"), "absolute").when(p.rlike("^[A-Za-z]:"), "drive").when(p.rlike(r"(^|/)\.\.(/|$)"), "escapes").when(canonical(path) == "", "empty")


def canonical(path: Column) -> Column:
    """The path with forward slashes and without empty or `.` segments, whatever it is."""
    parts = F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda x: (x != "") & (x != ".")), "/")


def canonical_path(path: Column) -> Column:
    """The canonical path, or null if it is refused."""
    return F.when(path_problem(path).isNull(), canonical(path))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: `**/` any folders, `**` anything, `*` and `?` within a segment."""
    if not pattern or pattern.startswith("/") or ".." in pattern.split("/"):
        raise ValueError(f"unsafe pattern {pattern!r}")
    pieces = re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|[^*?\[]+|\[", pattern)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(x) or (x if x.startswith("[") and x.endswith("]") else re.escape(x)) for x in pieces) + "$"


def included(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the patterns; no patterns include all."""
    hit = F.lit(not patterns)
    for p in patterns:
        hit = hit | path.rlike(glob_regex(p))
    return hit


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last dot and what follows it in the file's name, or an empty string."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def first_segment(path: Column) -> Column:
    """The first folder, or root."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("root")


def text_kind(path: Column) -> Column:
    return F.when(extension(path).isin(PROSE), "DOCUMENT").otherwise("CONFIG")


def moving_ref(ref: Column) -> Column:
    """Whether a ref may point to another commit tomorrow."""
    r = F.lower(F.trim(ref))
    return r.isin(MOVING) | r.startswith("refs/heads/")


def repository_url(url: Column) -> Column:
    """scheme://host/path of an https or ssh address without user, query, fragment and .git; null if it is another."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", ""), r"\.git$", "")
    return F.when(scheme.isin("https", "ssh") & (host != "") & ~host.contains("@"), F.concat(scheme, F.lit("://"), host, path))
