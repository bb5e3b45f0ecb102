"""Ranges of the top-level blocks of a Markdown text, by the block rules of CommonMark.

The text is handled as Latin-1 of its UTF-8 bytes, so positions are byte
offsets.  A block ends after its last line's terminator; blank lines after it
are outside.  Thematic breaks and link reference definitions are no blocks.
"""

from __future__ import annotations

import re

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|[\r\n]|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})[\r\n]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`\r\n]*[\r\n]*$)|~{3,})")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})([.)]))(?=[ \t\r\n]|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*[\r\n]*$")
_DEFINITION = re.compile(
    r"""[ ]{0,3}\[(?!\s*\])(?:[^\[\]\\]|\\.){1,999}\]:[ \t]*(?:\r\n|\n|\r)?[ \t]*(?:<(?:[^<>\r\n\\]|\\.)*>|[^\s<]\S*)"""
    r"""(?:(?:[ \t]+|[ \t]*(?:\r\n|\n|\r)[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))[ \t]*(?=[\r\n]|\Z)|[ \t]*(?=[\r\n]|\Z))(?:\r\n|\n|\r|\Z)""",
    re.S,
)
_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".replace(" ", "|")
_ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_TAGS})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf" {{0,3}}(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
]


def _blank(line: str) -> bool:
    return not line.strip(" \t\r\n")


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _unindent(line: str, width: int) -> str:
    """``line`` without its first ``width`` columns of white space; a tab cut in two leaves spaces."""
    n = 0
    for i, c in enumerate(line):
        if n >= width:
            return " " * (n - width) + line[i:]
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            return line[i:]
    return ""


def _html(line: str, within_paragraph: bool) -> int | None:
    for i, (start, _) in enumerate(_HTML):
        if start.match(line) and not (within_paragraph and i == 6):
            return i
    return None


def _item(line: str, within_paragraph: bool = False) -> tuple[str, int, bool] | None:
    """Kind of list, column where an item's content begins, whether its first line is empty."""
    m = _ITEM.match(line)
    if not m or _RULE.match(line):
        return None
    rest = line[m.end() :]
    empty = _blank(rest)
    if within_paragraph and (empty or (m[3] and int(m[3]) != 1)):
        return None
    space = _indent(rest)
    column = m.end() + (1 if empty or space > 4 else space)
    return m[4] or m[2], column, empty


def _interrupts(line: str, containers: bool = True) -> bool:
    """Whether a line ends a paragraph before it by beginning another block, a container among them."""
    if _indent(line) >= 4:
        return False
    if _ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or _html(line, True) is not None:
        return True
    return containers and bool(_QUOTE.match(line) or _item(line, True))


class _Open:
    """What is still open inside a container, line by line: a stack of quotes and list items, and the kind of the last leaf.

    A quote is None on the stack, an item the column of its content.
    """

    def __init__(self):
        self.stack: list[int | None] = []
        self.leaf: str | re.Pattern | None = None  # "paragraph", "html" up to a blank line, or what ends a fence or HTML block
        self.fence = False
        self.bare = False  # the innermost item has had no content

    @property
    def paragraph(self) -> bool:
        return self.leaf == "paragraph"

    def _continued(self, line: str) -> tuple[int, str]:
        """How many of the containers the line continues, and the rest of the line."""
        for depth, column in enumerate(self.stack):
            if column is None:
                m = _QUOTE.match(line) if _indent(line) < 4 else None
                if not m:
                    return depth, line
                line = line[m.end() :]
            elif _blank(line):
                if self.bare and depth == len(self.stack) - 1:
                    return depth, line
            elif _indent(line) >= column:
                line = _unindent(line, column)
            else:
                return depth, line
        return len(self.stack), line

    def _ended(self, line: str) -> bool:
        if self.leaf == "html":
            return _blank(line)
        return bool(self.leaf.match(line) if self.fence else self.leaf.search(line))

    def feed(self, line: str) -> None:
        depth, line = self._continued(line)
        whole = depth == len(self.stack)
        if whole and self.leaf is not None and not self.paragraph:
            if self._ended(line):
                self.leaf = None
            return
        within = self.paragraph and (whole or self.stack[depth] is None)
        opened = False
        while _indent(line) < 4:
            if m := _QUOTE.match(line):
                column, line = None, line[m.end() :]
            elif (found := _item(line, within)) is not None:
                column, at = found[1], _ITEM.match(line).end()
                line = _unindent(" " * at + line[at:], column)
            else:
                break
            self.stack[depth:] = [column]
            depth, opened, within, self.leaf = depth + 1, True, False, None
        if _blank(line):
            del self.stack[depth:]
            self.leaf = None
            self.bare = opened and self.stack[-1] is not None
            return
        self.bare = False
        if self.paragraph:
            if whole and _SETEXT.match(line):
                self.leaf = None
                return
            if not _interrupts(line, False):
                return
        del self.stack[depth:]
        self._begin(line)

    def _begin(self, line: str) -> None:
        """A new leaf."""
        self.leaf, self.fence = None, False
        if _indent(line) >= 4 or _ATX.match(line) or _RULE.match(line):
            return
        if m := _FENCE.match(line):
            self.leaf, self.fence = _closing(m), True
        elif (html := _html(line, False)) is not None:
            close = _HTML[html][1]
            self.leaf = "html" if close is None else None if close.search(line) else close
        else:
            self.leaf = "paragraph"


def _closing(fence: re.Match) -> re.Pattern:
    return re.compile(rf" {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*[\r\n]*$")


def _quote(lines: list[str], i: int) -> int:
    """First line after the quote."""
    inner = _Open()
    while i < len(lines):
        m = _QUOTE.match(lines[i]) if _indent(lines[i]) < 4 else None
        if m:
            inner.feed(lines[i][m.end() :])
        elif not inner.paragraph or _blank(lines[i]) or _interrupts(lines[i]):
            break
        i += 1
    return i


def _list(lines: list[str], i: int) -> int:
    """First line after the list, without blank lines at its end."""
    kind = _item(lines[i])[0]
    end = i
    while i < len(lines):
        found = _item(lines[i]) if _indent(lines[i]) < 4 else None
        if not found or found[0] != kind:
            break
        column, at = found[1], _ITEM.match(lines[i]).end()
        inner = _Open()
        inner.feed(_unindent(" " * at + lines[i][at:], column))
        i += 1
        end = i
        if found[2] and i < len(lines) and _blank(lines[i]):
            while i < len(lines) and _blank(lines[i]):
                i += 1
            continue
        while i < len(lines):
            if _blank(lines[i]):
                inner.feed("\n")
            elif _indent(lines[i]) >= column:
                inner.feed(_unindent(lines[i], column))
                end = i + 1
            elif not inner.paragraph or _interrupts(lines[i]) or (_indent(lines[i]) < 4 and _item(lines[i])):
                break
            else:
                end = i + 1
            i += 1
    return end


def _scan(lines: list[str]):
    """(first line, line after the last, kind) of each block; a rule is of kind None."""
    i = 0
    while i < len(lines):
        line, start = lines[i], i
        if _blank(line):
            i += 1
            continue
        if _indent(line) >= 4:
            end = i
            while i < len(lines) and (_blank(lines[i]) or _indent(lines[i]) >= 4):
                i += 1
                if not _blank(lines[i - 1]):
                    end = i
            yield start, end, "code"
            continue
        if m := _FENCE.match(line):
            close = _closing(m)
            i += 1
            while i < len(lines) and not close.match(lines[i]):
                i += 1
            i = min(i + 1, len(lines))
            yield start, i, "fence"
        elif _ATX.match(line):
            i += 1
            yield start, i, "heading"
        elif _RULE.match(line):
            i += 1
            yield start, i, None
        elif _QUOTE.match(line):
            i = _quote(lines, i)
            yield start, i, "quote"
        elif _item(line):
            i = _list(lines, i)
            yield start, i, "list"
        elif (html := _html(line, False)) is not None:
            close = _HTML[html][1]
            while i < len(lines):
                if close is None and _blank(lines[i]):
                    break
                i += 1
                if close is not None and close.search(lines[i - 1]):
                    break
            yield start, i, "html"
        else:
            i += 1
            heading = False
            while i < len(lines) and not _blank(lines[i]):
                if _SETEXT.match(lines[i]):
                    i += 1
                    heading = True
                    break
                if _interrupts(lines[i]):
                    break
                i += 1
            yield start, i, "heading" if heading else "paragraph"


def top_level_blocks(text: str) -> list[tuple[int, int]]:
    """Byte ranges of the top-level blocks of ``text``, in order."""
    raw = text.encode().decode("latin-1")
    lines = [m[0] for m in _LINE.finditer(raw) if m[0]]
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line))
    out = []
    for first, end, kind in _scan(lines):
        if kind is None:
            continue
        start = at[first]
        if kind == "paragraph" or (kind == "heading" and not _ATX.match(lines[first])):
            stop = at[end] if kind == "paragraph" else at[end - 1]
            while start < stop and (m := _DEFINITION.match(raw, start, stop)):
                start = m.end()
            if start >= stop:
                if kind == "heading":  # only definitions above the underline, which is then text
                    out.append((stop, at[end]))
                continue
        if kind != "code":
            start += len(raw[start : at[end]]) - len(raw[start : at[end]].lstrip(" \t"))
        out.append((start, at[end]))
    return out


def chunk_by_bytes(text: str, most: int) -> list[str]:
    """Pieces that end at block ends where they can; put together they are the text."""
    raw = text.encode()
    out, start, safe = [], 0, 0
    for _, end in top_level_blocks(text):
        if end - start > most:
            cut = safe if safe > start else end
            out.append(raw[start:cut].decode())
            start = cut
        safe = end
    if start < len(raw):
        out.append(raw[start:].decode())
    return out


def chunk_by_tokens(text: str, most: int, count) -> list[str]:
    """Runs of blocks whose token counts add up to ``most`` at most; a block beyond that stands alone."""
    raw = text.encode()
    blocks = top_level_blocks(text)
    counts = count([raw[a:b].decode() for a, b in blocks])
    out: list[str] = []
    start = end = blocks[0][0] if blocks else 0
    used = 0
    for (a, b), n in zip(blocks, counts, strict=True):
        if used + n > most:
            if used:
                out.append(raw[start:end].decode())
            if n > most:
                out.append(raw[a:b].decode())
                used, start = 0, b
            else:
                start, end, used = a, b, n
        else:
            end, used = b, used + n
    if used:
        out.append(raw[start:end].decode())
    return out
