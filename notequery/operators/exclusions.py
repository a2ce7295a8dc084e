"""Exclusion rules: globs over paths, read once on the driver and applied as one pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Always excluded.
ALWAYS = [".trash/**"]


def problem(rule: str) -> str | None:
    """Why a rule can't be used; such a rule is kept and matches nothing."""
    text = rule.strip().replace("\\", "/")
    if not text:
        return "empty"
    if text.startswith("/"):
        return "leading slash"
    if re.match(r"[A-Za-z]:", text):
        return "drive letter"
    steps = text.split("/")
    if ".." in steps:
        return "parent"
    return "** is not a whole step" if any("**" in s and s != "**" for s in steps) else None


def pattern(rule: str) -> str | None:
    """An anchored pattern: * and ? within a step, ** any steps; a rule without either names a folder or note."""
    if problem(rule):
        return None
    text = rule.strip().replace("\\", "/").rstrip("/")
    if not re.search(r"[*?]", text):
        return f"{re.escape(text)}(?:/.*)?"
    out = ""
    steps = text.split("/")
    for i, step in enumerate(steps):
        if step == "**":
            out += ".*" if i == len(steps) - 1 else "(?:[^/]+/)*"
        else:
            out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in step)
            out += "/" if i < len(steps) - 1 else ""
    return out


def excluded(path: Column, rules: list[str]) -> Column:
    """Whether any rule that can be used matches a path, in any case."""
    usable = [p for p in map(pattern, [*ALWAYS, *rules]) if p]
    return F.regexp_like(F.translate(path, "\\", "/"), F.lit(f"(?i)^(?:{'|'.join(usable)})$"))
