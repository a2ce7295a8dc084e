"""Column expressions for a note: its path, its frontmatter, its title and its name as a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that some systems keep for devices.
RESERVED = ["con", "prn", "aux", "nul", *[f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)]]
_HEAD = r"^\x{FEFF}?---[ \t]*\r?\n(?s:(.*?\n)??)---\r?(?:\n|\z)"


def normal_path(path: Column) -> Column:
    """Separators as /."""
    return F.translate(path, "\\", "/")


def folder(path: Column) -> Column:
    """All before the last /; empty at the root."""
    return F.regexp_extract(normal_path(path), r"^(.*)/", 1)


def stem(path: Column) -> Column:
    """The file's name without its last extension; a leading dot starts no extension."""
    name = F.regexp_extract(normal_path(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def frontmatter(content: Column) -> Column:
    """The lines between an opening and a closing ---; null if there are none."""
    return F.when(F.regexp_like(content, F.lit(_HEAD)), F.regexp_extract(content, _HEAD, 1))


def body(content: Column) -> Column:
    """The content after its frontmatter; all of it, less a byte order mark, if there is none."""
    return F.regexp_replace(F.regexp_replace(content, _HEAD, ""), r"^\x{FEFF}", "")


def _lines(block: Column) -> Column:
    return F.split(F.coalesce(block, F.lit("")), "\r?\n")


def _values(block: Column, key: str) -> Column:
    """Values of a top-level key in order; indented lines don't count."""
    pattern = rf"^{key}[ \t]*:[ \t]*(.*?)[ \t]*$"
    return F.transform(F.filter(_lines(block), lambda x: F.regexp_like(x, F.lit(pattern))), lambda x: F.regexp_extract(x, pattern, 1))


def unquote(value: Column) -> Column:
    """Without one pair of quotes around it."""
    return F.regexp_replace(value, r"^(?:\"(.*)\"|'(.*)')$", "$1$2")


def field(block: Column, key: str) -> Column:
    """The last value of a key, unquoted; null if absent or empty."""
    return F.nullif(F.trim(unquote(F.try_element_at(_values(block, key), F.lit(-1)))), F.lit(""))


def tags(block: Column) -> Column:
    """The last inline list of tags; an empty list if there is none."""
    value = F.coalesce(F.try_element_at(_values(block, "tags"), F.lit(-1)), F.lit(""))
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(unquote(F.trim(x)))), lambda x: x != "")


def ai_excluded(block: Column) -> Column:
    """Whether any ai: false/no/off/0 or private: true/yes/on/1 stands in the frontmatter."""
    off = F.exists(_values(block, "ai"), lambda v: F.lower(unquote(v)).isin("false", "no", "off", "0"))
    return off | F.exists(_values(block, "private"), lambda v: F.lower(unquote(v)).isin("true", "yes", "on", "1"))


def created(block: Column) -> Column:
    """The created timestamp; null where it is none in RFC 3339."""
    value = field(block, "created")
    valid = F.regexp_like(value, F.lit(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"))
    return F.when(valid, F.try_to_timestamp(F.upper(value)))


def title(block: Column, text: Column, path: Column) -> Column:
    """The frontmatter title, else the first line that starts with '# ', else the stem."""
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*# +(.*\S)[ \t\r]*$", 1)), F.lit(""))
    return F.coalesce(field(block, "title"), heading, stem(path))


def slug(name: Column) -> Column:
    """A safe file name of 80 characters at most: lower case, runs of space and _ as one -, no control characters or separators."""
    x = F.regexp_replace(F.regexp_replace(name, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", ""), r"[\p{Cc}<>:\"/|?*\\]", "")
    x = F.lower(F.regexp_replace(F.regexp_replace(x, r"^[\p{Z}_]+", ""), r"[\p{Z}_]+", "-"))
    x = F.regexp_replace(x, r"[.\- ]+$", "")
    x = F.when(x == "", F.lit("untitled")).otherwise(x)
    x = F.when(x.isin(RESERVED), F.concat(x, F.lit("-note"))).otherwise(x)
    return F.when(F.char_length(x) > 80, F.regexp_replace(F.substring(x, 1, 80), "-+$", "")).otherwise(x)


def path_problem(path: Column) -> Column:
    """Why a relative path is refused; null if it is safe."""
    parts = F.split(normal_path(path), "/")
    device = F.exists(parts, lambda p: F.lower(F.regexp_extract(p, r"^([^.]*)", 1)).isin(RESERVED))
    return (
        F.when(F.coalesce(F.trim(path), F.lit("")) == "", "empty")
        .when(F.regexp_like(path, F.lit(r"^(?:[/\\]|[A-Za-z]:)")), "absolute")
        .when(F.exists(parts, lambda p: p == ".."), "parent")
        .when(F.exists(parts, lambda p: p == ""), "empty step")
        .when(F.exists(parts, lambda p: F.regexp_like(p, F.lit(r"[. ]$"))), "trailing dot or space")
        .when(device, "reserved")
    )


def quoted(value: Column) -> Column:
    """A value as frontmatter holds it: quoted, with \\ and " escaped, only if it would be read otherwise."""
    risky = F.regexp_like(value, F.lit(r"^$|^[ \[{\"'&*!|>%@`#]|: |:$| #| $"))
    return F.when(risky, F.concat(F.lit('"'), F.regexp_replace(value, r'([\\"])', r"\\$1"), F.lit('"'))).otherwise(value)


def _set(lines: Column, key: str, value: Column) -> Column:
    """Frontmatter lines with one key set wherever it stands, or dropped where the value is null; appended if absent."""

    def mine(x: Column) -> Column:
        return F.regexp_like(x, F.lit(rf"^{key}\s*:"))

    line = F.concat(F.lit(f"{key}: "), value)
    there = F.exists(lines, mine)
    replaced = F.transform(lines, lambda x: F.when(mine(x), line).otherwise(x))
    return F.when(value.isNull(), F.filter(lines, lambda x: ~mine(x))).when(there, replaced).otherwise(F.array_append(lines, line))


def rewrite(content: Column, changes: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """Content with keys of its frontmatter set, or dropped where the value is null; all other lines stay as they are.

    A key is replaced wherever it stands, and missing keys are appended in the order given.  ``lists`` are keys with
    arrays of texts, written inline as [a, b]; a null or empty one leaves the key alone.  Line ends are those of the
    frontmatter, or of the body where there is none.  A note without frontmatter gets some if a key has a value, and
    one whose frontmatter comes out empty loses it.
    """
    block, rest = frontmatter(content), body(content)
    ending = F.when(F.contains(F.coalesce(block, rest), F.lit("\r\n")), "\r\n").otherwise("\n")
    lines = F.when(F.coalesce(block, F.lit("")) == "", F.array().cast("array<string>")).otherwise(_lines(F.regexp_replace(block, r"\r?\n\z", "")))
    for key, value in changes.items():
        lines = _set(lines, key, quoted(value))
    for key, values in (lists or {}).items():
        inline = F.concat(F.lit("["), F.array_join(F.transform(values, quoted), ", "), F.lit("]"))
        lines = F.when(F.size(values) > 0, _set(lines, key, inline)).otherwise(lines)
    head = F.concat(F.lit("---"), ending, F.array_join(F.transform(lines, lambda x: F.concat(x, ending)), ""), F.lit("---"), ending)
    return F.when(F.size(lines) > 0, F.concat(head, rest)).when(block.isNotNull(), rest).otherwise(content)
