"""Paths, globs and slices as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _balanced(glob: str) -> bool:
    depth = 0
    for token in re.findall(r"\\.|[{}]", glob):
        depth += {"{": 1, "}": -1}.get(token, 0)
        if depth < 0:
            return False
    return depth == 0


def glob_to_regex(glob: str, braces: bool = True) -> str:
    """Anchored regex of a glob. braces: {a,b} is an alternation, if all braces match; else they are literals."""
    braces = braces and _balanced(glob)
    made, depth = [], 0
    for token in re.findall(r"\\.|\*\*/|\*\*|.", glob, re.S):
        if token in ("**/", "**", "*", "?"):
            made.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}[token])
        elif braces and token == "{":
            made.append("(?:")
            depth += 1
        elif braces and depth and token == "}":
            made.append(")")
            depth -= 1
        elif braces and depth and token == ",":
            made.append("|")
        else:
            made.append(re.escape(token[-1]))
    return f"^{''.join(made)}$"


def concrete_segments(glob: str) -> list[str]:
    return [s for s in glob.split("/") if s and not re.search(r"[*?{\[]", s)]


def segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda s: s != "")


def matches(path: Column, glob: str) -> Column:
    """Whether a glob matches; 'folder/**' is a comparison of prefixes."""
    folder = glob.removesuffix("/**")
    if folder != glob and folder and not set(folder) & set("*?{}[]\\"):
        return path.startswith(f"{folder}/")
    return path.rlike(glob_to_regex(glob))


def specificity(path: Column, glob: str) -> Column:
    """Rank of a glob that matches the path: depth of its last concrete segment, then how many, then literal length.

    Where all concrete segments lead the glob, any path that it matches begins with them, and the rank is a constant.
    """
    named, literal = concrete_segments(glob), len(glob.replace("*", ""))
    if not named:
        return F.lit(literal).cast("long")
    base = len(named) * 10_000 + literal
    parts = glob.split("/")
    if parts[: len(named)] == named:
        return F.lit(len(named) * 1_000_000 + base).cast("long")
    own, at = segments(path), F.lit(0).cast("long")
    for name in named:
        next_ = F.array_position(F.slice(own, (at + 1).cast("int"), F.greatest(F.size(own), F.lit(1))), name)
        at = F.when(at.isNull() | (next_ == 0), F.lit(None)).otherwise(at + next_)
    return F.coalesce(at * 1_000_000, F.lit(0)) + F.lit(base).cast("long")


def slice_id(path: Column, folders: tuple[str, ...]) -> Column:
    """folder/next of the first segment (not the last) that is one of the folders, in lower case; null if none is."""
    parts = F.transform(segments(path), F.lower)
    pairs = F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hits = F.filter(pairs, lambda p: p["a"].isin([f.lower() for f in folders]))
    first = F.get(hits, F.lit(0))
    return F.when(F.size(hits) > 0, F.concat(first["a"], F.lit("/"), first["b"]))


def normalize_path(path: Column) -> Column:
    """Slashes forward, no empty or '.' segments, '..' resolved; leading '..' stay."""
    def step(stack: Column, part: Column) -> Column:
        climbs = (part == "..") & (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        return F.when(part.isin("", "."), stack).when(climbs, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part)))

    return F.array_join(F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), step), "/")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_canonical_path(path: Column) -> Column:
    """Relative to the project, no drive, no NUL, no way above the root, and already normal."""
    portable = F.replace(path, F.lit("\\"), F.lit("/"))
    clean = normalize_path(path)
    return (clean != "") & (clean == portable) & ~portable.rlike("^(/|[A-Za-z]:/)") & ~portable.contains("\0") & (clean != "..") & ~clean.startswith("../")


#: Generated files.
GENERATED = ("**/*.gen.ts", "**/*.gen.tsx", "**/*.generated.ts", "**/*.generated.tsx")


def scan_excluded(path: Column, exclude: tuple[str, ...] = (), generated: bool = True) -> Column:
    """Whether a file is left out of scans: generated ones, unless asked for, and those that a glob names."""
    globs = (*(GENERATED if generated else ()), *exclude)
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike("|".join(glob_to_regex(g) for g in globs)) if globs else F.lit(False)
