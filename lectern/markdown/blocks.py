"""Blocks of Markdown: each container hands its lines, without its own marks, to the same scanner."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lectern.markdown.inline import normal_label

ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
QUOTE = re.compile(r"^ {0,3}> ?")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(?:<[^<>]*>|[^\s<]\S*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*$")
DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
# How HTML blocks begin, and what ends those that do not end at a blank line.
_BLOCK_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
HTML = [
    (re.compile(r"^ {0,3}<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"^ {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"^ {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"^ {{0,3}}</?(?:{_BLOCK_TAGS})(?=[\s/>]|$)", re.I), None),
    (re.compile(r"^ {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
]
# Languages in which a line that starts with # is no comment, and those that show markup.
HASH_IS_TEXT = ("c", "cpp", "c++", "cs", "csharp", "css", "go", "golang", "html", "java", "javascript", "js", "json", "jsonc", "jsx", "kotlin", "lua", "rs", "rust", "scss", "sql", "swift", "ts", "tsx", "typescript", "xml")
MARKUP = ("", "markdown", "md", "mdx", "mdown", "text", "txt", "plain", "plaintext", "rst", "html")


@dataclass
class Block:
    kind: str
    start: int
    stop: int
    text: str = ""
    level: int = 0
    children: list[list[Block]] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)


def indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def dedent(line: str, n: int) -> str:
    """``line`` without up to ``n`` columns of white space."""
    at = 0
    for i, c in enumerate(line):
        if at >= n or c not in " \t":
            return " " * (at - n) + line[i:]
        at += 1 if c == " " else 4 - at % 4
    return " " * max(0, at - n)


@dataclass(frozen=True)
class Fence:
    """The line that opens a fenced block: three or more of one mark, and what is said after them."""

    indent: int
    mark: str
    length: int
    info: str

    @classmethod
    def opened_by(cls, line: str) -> Fence | None:
        bare = line.lstrip(" ")
        for mark in "`~":
            length = len(bare) - len(bare.lstrip(mark))
            if length >= 3 and not (mark == "`" and mark in bare[length:]):
                return cls(len(line) - len(bare), mark, length, bare[length:].strip())
        return None

    @property
    def language(self) -> str:
        return (self.info.lower().split() or [""])[0]

    def closed_by(self, line: str, most: int = 3) -> bool:
        bare = line.strip()
        return len(bare) >= self.length and set(bare) == {self.mark} and indent(line) <= most

    def mispaired(self, inside: list[str]) -> bool:
        """Whether what stands inside opens a fence that could not be nested here, so that the closing line is another's. Samples of markup may show fences."""
        nested = (Fence.opened_by(x) for x in inside)
        return self.language not in MARKUP and any(f is not None and f.info and f.indent <= 3 and f.mark == self.mark and f.length >= self.length for f in nested)

    def outlives(self, lines: list[str], at: int) -> bool:
        """Whether line ``at``, which reads as a heading after a blank line, may be inside. A single # may where it begins a comment."""
        heading = ATX.match(lines[at])
        return not heading or not heading[2] or bool(lines[at - 1].strip()) or len(heading[1]) == 1 and self.language not in HASH_IS_TEXT


def cells(line: str) -> list[str]:
    """Cells of a table row; an escaped bar is text."""
    bare = line.strip()
    bare = bare[1:] if bare.startswith("|") else bare
    bare = bare[:-1] if bare.endswith("|") and not bare.endswith("\\|") else bare
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", bare)]


class Scanner:
    """Blocks of lines. ``labels`` gathers link references; with ``recover``, open fences end at plausible headings."""

    def __init__(self, recover: bool = False):
        self.recover = recover
        self.labels: set[str] = set()

    def blocks(self, lines: list[str], top: bool = True) -> list[Block]:
        out: list[Block] = []
        i = 0
        while i < len(lines):
            if not lines[i].strip():
                i += 1
                continue
            block = self.one(lines, i, top)
            if block.kind != "nothing":
                out.append(block)
            i = block.stop
        return out

    def one(self, lines: list[str], i: int, top: bool) -> Block:
        line = lines[i]
        if indent(line) >= 4:
            stop = i
            while stop < len(lines) and (not lines[stop].strip() or indent(lines[stop]) >= 4):
                stop += 1
            while not lines[stop - 1].strip():
                stop -= 1
            return Block("code", i, stop, "\n".join(dedent(x, 4) for x in lines[i:stop]) + "\n")
        if (fence := Fence.opened_by(line)) and fence.indent <= 3:
            return self.fence(lines, i, fence, top)
        if atx := ATX.match(line):
            return Block("heading", i, i + 1, (atx[2] or "").strip(), len(atx[1]))
        if RULE.match(line):
            return Block("rule", i, i + 1)
        if QUOTE.match(line):
            return self.quote(lines, i)
        if ITEM.match(line):
            return self.list(lines, i)
        for n, (begins, ends) in enumerate(HTML):
            if begins.match(line):
                return self.html(lines, i, ends)
        return self.paragraph(lines, i)

    def fence(self, lines: list[str], i: int, fence: Fence, top: bool) -> Block:
        close = next((k for k in range(i + 1, len(lines)) if fence.closed_by(lines[k])), None)
        last = len(lines) if close is None else close
        after = last if close is None else close + 1
        if self.recover and top and (close is None or fence.mispaired(lines[i + 1 : close])):
            left = next((k for k in range(i + 2, after) if not fence.outlives(lines, k)), None)
            last, after = (last, after) if left is None else (left, left)
        return Block("fence", i, after, "".join(dedent(x, fence.indent) + "\n" for x in lines[i + 1 : last]))

    def interrupts(self, lines: list[str], i: int) -> bool:
        """Whether a line ends the paragraph before it."""
        line = lines[i]
        if indent(line) >= 4:
            return False
        fence, item = Fence.opened_by(line), ITEM.match(line)
        if fence and fence.indent <= 3 or ATX.match(line) or RULE.match(line) or QUOTE.match(line):
            return True
        if item and line[item.end() :].strip() and (item[2] in "-+*" or item[2][:-1] == "1"):
            return True
        return any(begins.match(line) for begins, _ in HTML[:6]) or self.is_table(lines, i)

    def quote(self, lines: list[str], i: int) -> Block:
        inner, k = [], i
        while k < len(lines):
            if QUOTE.match(lines[k]):
                inner.append(QUOTE.sub("", lines[k], count=1))
            elif not lines[k].strip() or not self.lazy(inner) or self.interrupts(lines, k) or SETEXT.match(lines[k]):
                break
            else:
                inner.append(lines[k])
            k += 1
        return Block("quote", i, k, children=[self.blocks(inner, False)])

    def lazy(self, inner: list[str]) -> bool:
        """Whether what stands so far ends in a paragraph that an unmarked line may continue."""
        if not inner or not inner[-1].strip():
            return False
        last = Scanner().blocks(inner, False)[-1:]
        while last and last[0].children:
            last = last[0].children[-1][-1:]
        return bool(last) and last[0].kind == "paragraph"

    def list(self, lines: list[str], i: int) -> Block:
        first = ITEM.match(lines[i])
        kind = first[2][-1]
        children, spans, k = [], [], i
        while k < len(lines):
            mark = ITEM.match(lines[k])
            if not mark or mark[2][-1] != kind or RULE.match(lines[k]):
                break
            rest = lines[k][mark.end() :]
            pad = indent(rest)
            width = mark.end() + (pad if 1 <= pad <= 4 and rest.strip() else 1)
            inner, start = [dedent(" " * mark.end() + rest, width)], k
            k += 1
            while k < len(lines):
                line = lines[k]
                if not line.strip():
                    ahead = next((x for x in lines[k:] if x.strip()), None)
                    if ahead is None or indent(ahead) < width or not inner[0].strip() and len(inner) == 1:
                        break
                    inner.append("")
                elif indent(line) >= width:
                    inner.append(dedent(line, width))
                elif self.lazy(inner) and not self.interrupts(lines, k) and not ITEM.match(line) and not SETEXT.match(line):
                    inner.append(line.lstrip())
                else:
                    break
                k += 1
            children.append(self.blocks(inner, False))
            after = k
            while k < len(lines) and not lines[k].strip():
                k += 1
            spans.append((start, k if k < len(lines) and ITEM.match(lines[k]) and ITEM.match(lines[k])[2][-1] == kind and not RULE.match(lines[k]) else after))
            if spans[-1][1] == after and k != after:
                k = after
                break
        return Block("list", i, k, children=children, spans=spans)

    def html(self, lines: list[str], i: int, ends: re.Pattern | None) -> Block:
        k = i
        while k < len(lines):
            if ends is None and not lines[k].strip():
                break
            k += 1
            if ends is not None and ends.search(lines[k - 1]):
                break
        return Block("html", i, k, "\n".join(lines[i:k]))

    def is_table(self, lines: list[str], i: int) -> bool:
        return i + 1 < len(lines) and "|" in lines[i] and DELIMITER.match(lines[i + 1]) is not None and ("|" in lines[i + 1] or ":" in lines[i + 1]) and len(cells(lines[i])) == len(cells(lines[i + 1]))

    def table(self, lines: list[str], i: int) -> Block:
        k = i + 2
        while k < len(lines) and lines[k].strip() and indent(lines[k]) < 4 and not (self.interrupts(lines, k) and not self.is_table(lines, k)):
            k += 1
        return Block("table", i, k, spans=[(n, n + 1) for n in range(i + 2, k)])

    def paragraph(self, lines: list[str], i: int) -> Block:
        if self.is_table(lines, i):
            return self.table(lines, i)
        if definition := DEFINITION.match(lines[i]):
            self.labels.add(normal_label(definition[1]))
            return Block("nothing", i, i + 1)
        k = i + 1
        while k < len(lines) and lines[k].strip():
            if underline := SETEXT.match(lines[k]):
                return Block("heading", i, k + 1, "\n".join(x.strip() for x in lines[i:k]), 1 if underline[1][0] == "=" else 2)
            if self.interrupts(lines, k):
                break
            k += 1
        return Block("paragraph", i, k, "\n".join(x.strip() for x in lines[i:k]))
