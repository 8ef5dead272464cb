"""Sizes, modes and times as people write them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_size(text: str) -> int:
    """'1.5G' and the like, to the base 1024."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*([KMGT]?)(?:i?B)?\s*", text, re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m.group(1)) * _UNITS.get(m.group(2).upper(), 1))


def size_condition(size: Column, text: str) -> Column:
    """'+N' more than, '-N' less than, 'N' exactly."""
    if text[:1] == "+":
        return size > parse_size(text[1:])
    if text[:1] == "-":
        return size < parse_size(text[1:])
    return size == parse_size(text)


def human_size(size: Column) -> Column:
    out = F.when(size < 1024, F.format_string("%d", size))
    for unit, step in (("K", 1 << 10), ("M", 1 << 20), ("G", 1 << 30)):
        out = out.when(size < step * 1024, F.format_string(f"%.1f{unit}", size / step))
    return out.otherwise(F.format_string("%.1fT", size / (1 << 40)))


def mode_string(mode: Column, is_dir: Column) -> Column:
    """'drwxr-xr-x'; unknown modes are those of plain files and directories."""
    mode = F.coalesce(mode, F.when(is_dir, 0o755).otherwise(0o644))
    bits = [F.when(mode.bitwiseAND(1 << (8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(F.when(is_dir, "d").otherwise("-"), *bits)


def modified(mtime_ns: Column) -> Column:
    """As a timestamp; its microseconds are those of the integer, which never passes through a double."""
    return F.timestamp_micros(F.floor(mtime_ns.cast("decimal(20,0)") / 1000).cast("long"))
