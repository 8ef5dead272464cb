"""Glob patterns as Columns: an exact regular expression, next to plain conditions that Spark can push into the scan."""

from __future__ import annotations

import fnmatch
import glob
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, normalize

_MAGIC = re.compile(r"[*?\[]")


def _java(regex: str) -> str:
    """A translated pattern for Java: it has nested classes and intersections where Python has plain characters, and its \\Z
    admits a line end."""
    out, i, inside = [], 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        if not inside and c == "[":
            inside = True
            out.append(c)
            if regex[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if regex[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif inside and c == "]":
            inside = False
            out.append(c)
        else:
            out.append("\\" + c if inside and c in "[&^" else c)
        i += 1
    body = "".join(out)
    return r"\A" + body.removesuffix(r"\Z").removesuffix(r"\z") + r"\z"


def glob_regex(pattern: str, recursive: bool = False, include_hidden: bool = False) -> str:
    """Python's glob: ``*`` stays within a name, ``**`` (if recursive) spans directories, names with a leading dot need one in
    the pattern unless hidden ones are included."""
    return _java(glob.translate(pattern, recursive=recursive, include_hidden=include_hidden, seps="/"))


def name_regex(pattern: str) -> str:
    """fnmatch on a name."""
    return _java(fnmatch.translate(pattern))


def raw_regex(pattern: str) -> str:
    """SQL GLOB: ``*`` crosses ``/``, classes are negated by ``^``; an unclosed class matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            negated = pattern[j : j + 1] == "^"
            j += negated
            first = j
            while j < len(pattern) and (pattern[j] != "]" or j == first):
                j += 1
            if j >= len(pattern):
                return r"(?!)"
            members = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[first:j])
            out.append(f"[{'^' if negated else ''}{members}]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return r"\A(?s:" + "".join(out) + r")\z"


@dataclass(frozen=True)
class Bounds:
    """What every match has literally at its ends."""

    prefix: str
    suffix: str


def bounds(pattern: str) -> Bounds:
    marks = [m.start() for m in _MAGIC.finditer(pattern)]
    if not marks:
        return Bounds(pattern, "")
    suffix = "" if "[" in pattern else pattern[marks[-1] + 1 :]
    # '**/x' also matches 'x'
    return Bounds(pattern[: marks[0]], suffix.lstrip("/") if pattern[: marks[-1] + 1].endswith("**") else suffix)


def _matching(path: Column, pattern: str, regex: str) -> Column:
    if not _MAGIC.search(pattern):
        return path == pattern
    found, ends = path.rlike(regex), bounds(pattern)
    if ends.suffix:
        found = path.endswith(ends.suffix) & found
    return path.startswith(ends.prefix) & found if ends.prefix else found


def matches(path: Column, pattern: str, recursive: bool = False, include_hidden: bool = False) -> Column:
    """Whether a path matches a Python glob. The pattern is not normalised: '/x' and 'd/' match nothing."""
    if recursive and pattern == "**":
        return F.lit(True) if include_hidden else ~path.rlike(r"(\A|/)\.")
    return _matching(path, pattern, glob_regex(pattern, recursive, include_hidden))


def matches_raw(path: Column, pattern: str) -> Column:
    """Whether a path matches an SQL GLOB; the pattern is normalised as a path."""
    pattern = normalize(pattern)
    return _matching(path, pattern, raw_regex(pattern))


def matches_name(path: Column, pattern: str) -> Column:
    return basename(path).rlike(name_regex(pattern))


def raw_chain(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """(include, pattern) from left to right as ``OR GLOB`` and ``AND NOT GLOB`` with SQL's precedence: AND binds tighter, so an
    exclusion holds for the inclusion right before it."""
    terms: list[Column] = []
    for include, pattern in rules:
        if include:
            terms.append(matches_raw(path, pattern))
        else:
            terms[-1:] = [(terms[-1] if terms else F.lit(True)) & ~matches_raw(path, pattern)]
    out = terms[0] if terms else F.lit(True)
    for term in terms[1:]:
        out = out | term
    return out


def first_match(path: Column, rules: list[tuple[bool, str]], default: bool = True) -> Column:
    """The first rule that matches decides; hidden names count; ``**`` in a rule makes it recursive."""
    out = None
    for include, pattern in rules:
        hit = matches(path, pattern, recursive="**" in pattern, include_hidden=True)
        out = F.when(hit, F.lit(include)) if out is None else out.when(hit, F.lit(include))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def build_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """When an archive is built: any exclusion decides; with inclusions, one must match."""
    hit = lambda patterns: any_of([matches(path, p, recursive="**" in p, include_hidden=True) for p in patterns])
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def sync_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """When trees are synchronised: an inclusion rescues an excluded name."""
    hit = lambda patterns: any_of([matches_name(path, p) for p in patterns])
    return ~(hit(exclude) & ~hit(include))


def directory_pattern(pattern: str) -> str:
    """'d/' means all below d."""
    return pattern + "**" if pattern.endswith("/") and not pattern.endswith("**/") else pattern
