"""The block structure of Markdown: one fold over a note's lines with a stack of quotes and list items.

A line belongs to the containers it carries the marks of; what is left of it opens, continues or closes a leaf: a
heading, a paragraph, a fenced or indented block of code, a block of HTML, a table.  Neither a stack nor a paragraph
that waits for what follows it can be said by functions over columns, so this runs on Arrow batches, a note at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<n: int, level: int, plain: string>>"

_FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$")
_BARE = re.compile(r" {0,3}(?:`{3,}|~{3,})[ \t]*$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(?:(=+)|-+)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
_TASK = re.compile(r"\[[ xX]\][ \t]+")
_DEFINED = re.compile(r" {0,3}\[(?!\^)[^\]]+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_NOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]*")
_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: Blocks of HTML: how they start and how they end; None at a blank line.  Fixed values: the names of the block elements.
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (
        re.compile(
            r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html"
            r"|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)",
            re.I,
        ),
        None,
    ),
    (re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$"), None),
]
_MARKED = re.compile(r"[\[\]*_`~<>\\&!]")
_CODE = re.compile(r"(?<![\\`])(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_TAG = re.compile(r"<!--.*?-->|<(?![A-Za-z][A-Za-z0-9+.-]*:|[^\s<>]+@)/?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"!?\[((?:[^\[\]\\]|\\.)*)\](?:\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\])", re.S)
_REFERRED = re.compile(r"\[\^[^\]\s]+\]")
_STRONG = re.compile(r"(?<!\\)(?:\*\*|__|~~|`+)")
_STAR = re.compile(r"(^|[^\w*\\])\*([^\s*][^*]*)\*")
_LOW = re.compile(r"(^|[^\w\\])_([^\s_](?:[^_]*[^\s_])?)_(?!\w)")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def plain(text: str) -> str:
    """Text without marks of emphasis, links, notes and tags; link texts, image texts and code stay, and so does every line end."""
    if not _MARKED.search(text):
        return text
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[2])
        return f"\0{len(kept) - 1}\0"

    x = _CODE.sub(keep, text.replace("\0", " "))
    x = _REFERRED.sub("", x)
    for _ in range(2):  # an image may stand in a link
        x = _LINK.sub(r"\1", x)
    x = _STRONG.sub("", _TAG.sub(lambda m: "\n" * m[0].count("\n"), x))
    x = _LOW.sub(r"\1\2", _STAR.sub(r"\1\2", x))
    if "&" in x:
        x = html.unescape(x)
    x = _ESCAPED.sub(r"\1", x)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], x) if kept else x


def _cells(line: str) -> list[str]:
    """The cells of a table's row."""
    return [c.replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


class _Fold:
    """What is open after some lines, and what has been read: (line, level, text), level 0 for all but headings."""

    def __init__(self) -> None:
        self.out: list[tuple[int, int, str]] = []
        self.stack: list[int] = []  # 0 for a quote, for an item how far its content is indented
        self.para: list[tuple[int, str]] = []
        self.fence = self.html = None  # the fence's mark and indent; the end of the block of HTML, or "" for a blank line
        self.table = 0  # columns

    def close(self, level: int = 0) -> None:
        """End the paragraph, as a heading if it has a level."""
        lines, self.para, self.table = self.para, [], 0
        while lines and _DEFINED.match(lines[0][1]):
            lines.pop(0)
        if lines:
            texts = plain("\n".join(_NOTE.sub("", t).strip() for _, t in lines)).split("\n")
            if level:
                self.out.append((lines[0][0], level, " ".join(t.strip() for t in texts)))
            else:
                self.out += [(n, 0, t) for (n, _), t in zip(lines, texts, strict=True)]

    def enter(self, line: str) -> tuple[int, str]:
        """How many containers a line is in, and what is left of it."""
        for depth, item in enumerate(self.stack):
            if item:
                if line.strip() and _indent(line) < item:
                    return depth, line
                line = line[item:]
            else:
                m = _QUOTE.match(line)
                if not m:
                    return depth, line
                line = line[m.end() :]
        return len(self.stack), line

    def starts(self, line: str, sibling: bool) -> bool:
        """Whether a line opens a block that ends a paragraph; next to an item any item does."""
        m = _ITEM.match(line)
        item = m and (sibling or (line[m.end() :].strip() and (m[3] is None or int(m[3]) == 1)))
        return bool(item or _QUOTE.match(line) or _ATX.match(line) or _FENCE.match(line) or _BREAK.match(line) or any(s.match(line) for s, _ in _HTML[:6]))

    def add(self, n: int, line: str) -> None:
        line = line.expandtabs(4)
        depth, rest = self.enter(line)
        if depth < len(self.stack):
            if self.para and rest.strip() and not self.table and not self.starts(rest, self.stack[depth] > 0):
                self.para.append((n, rest))  # a paragraph goes on without its marks
                return
            self.close()
            self.stack, self.fence, self.html = self.stack[:depth], None, None
        if self.fence:
            mark, indent = self.fence
            if re.fullmatch(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*", rest):
                self.fence = None
            elif not _BARE.match(rest):  # marks of other fences say nothing
                self.out.append((n, 0, rest[min(indent, _indent(rest)) :]))
            return
        if self.html is not None:
            if self.html == "":
                self.html = None if not rest.strip() else ""
            elif self.html.search(rest):
                self.html = None
            return
        self.open(n, rest)

    def open(self, n: int, rest: str) -> None:
        while True:
            if not rest.strip():
                self.close()
                return
            if _indent(rest) >= 4 and not self.para:
                self.out.append((n, 0, rest[4:]))
                return
            if self.para and not self.table and (m := _UNDERLINE.match(rest)) and any(not _DEFINED.match(t) for _, t in self.para):
                self.close(1 if m[1] else 2)
                return
            if m := _QUOTE.match(rest):
                self.close()
                self.stack.append(0)
                rest = rest[m.end() :]
                continue
            if m := _ATX.match(rest):
                self.close()
                self.out.append((n, len(m[1]), plain((m[2] or "").strip()).strip()))
                return
            if m := _FENCE.match(rest):
                self.close()
                self.fence = (m[1] or m[2], _indent(rest))
                return
            for k, (start, end) in enumerate(_HTML):
                if start.match(rest) and not (k == 6 and self.para):
                    self.close()
                    self.html = "" if end is None else None if end.search(rest, start.match(rest).end() if k != 3 else 0) else end
                    return
            if _BREAK.match(rest):
                self.close()
                return
            m = _ITEM.match(rest)
            if m and (not self.para or (rest[m.end() :].strip() and (m[3] is None or int(m[3]) == 1))):
                self.close()
                after = rest[m.end() :]
                gap = _indent(after) if after.strip() else 1
                gap = 1 if gap > 4 else gap
                self.stack.append(m.end() + gap)
                rest = after[gap:]
                if not rest.strip():
                    return
                rest = _TASK.sub("", rest, count=1) if _TASK.match(rest) else rest
                continue
            break
        if self.table:
            self.out.append((n, 0, " ".join(plain(c.strip()) for c in _cells(rest)[: self.table])))
        elif self.para and "|" in self.para[-1][1] and _RULE.match(rest) and "-" in rest and len(_cells(rest)) == len(_cells(self.para[-1][1])):
            head = self.para.pop()
            self.close()
            self.out.append((head[0], 0, " ".join(plain(c.strip()) for c in _cells(head[1]))))
            self.table = len(_cells(rest))
        else:
            self.para.append((n, rest))


def parse(body: str) -> list[tuple[int, int, str]]:
    """(line from 1, level, text) of what a note's lines say; level is 0 but for headings, which come with all their lines at the first."""
    fold = _Fold()
    for n, line in enumerate(re.split(r"\r\n?|\n", body), 1):
        fold.add(n, line)
    fold.close()
    return fold.out


def blocks(body: Column) -> Column:
    """The lines of a note that say something, as ``parse`` reads them."""

    @F.pandas_udf(KIND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"n": n, "level": level, "plain": t} for n, level, t in parse(x)] if x else [] for x in batch])

    return run(body)
