"""What a reader sees of a line of Markdown."""

from __future__ import annotations

import html
import re
import string
import unicodedata

# Tags that only style text.
STYLING = ("a", "abbr", "b", "br", "code", "del", "em", "font", "i", "img", "ins", "kbd", "mark", "s", "small", "span", "strong", "sub", "sup", "u")

_TAG = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Za-z][^>]*)>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9.-]+)>")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()<]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def _flanks(text: str, lo: int, hi: int) -> tuple[bool, bool]:
    """Whether the run of marks at lo:hi may open and close emphasis."""
    before, after = text[lo - 1] if lo else " ", text[hi] if hi < len(text) else " "
    mark = lambda c: c in string.punctuation or unicodedata.category(c)[0] in "PS"
    left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
    right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
    if text[lo] == "_":
        return left and (not right or mark(before)), right and (not left or mark(after))
    return left, right


def _bracketed(text: str, start: int) -> int:
    """Where the bracket that opens at ``start`` closes, or -1. Code spans and escapes inside are skipped."""
    depth, i = 0, start
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "`":
            run = len(text) - i - len(text[i:].lstrip("`"))
            close = re.search(rf"(?<!`)`{{{run}}}(?!`)", text[i + run :])
            i += run - 1 + (close.end() if close else 0)
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def plain(text: str, labels: frozenset[str] = frozenset()) -> str:
    """Markup gone, code and image descriptions kept, white space even. ``labels`` are those of link references."""
    return re.sub(r"\s+", " ", "".join(_pieces(text, labels))).strip()


def _pieces(text: str, labels: frozenset[str]) -> list[str]:
    out: list[str] = []
    runs: list[list] = []  # marks that may be emphasis: place in out, mark, how many are left, opens, closes
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            if text[i + 1] in string.punctuation:
                out.append(text[i + 1])
                i += 2
                continue
            if text[i + 1] == "\n":
                out.append(" ")
                i += 2
                continue
        elif c == "`":
            run = len(text) - i - len(text[i:].lstrip("`"))
            close = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, i + run)
            if close:
                code = text[i + run : close.start()].replace("\n", " ")
                out.append(code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code)
                i = close.end()
            else:
                out.append("`" * run)
                i += run
            continue
        elif c == "<":
            if link := _AUTOLINK.match(text, i):
                out.append(link[1])
                i = link.end()
                continue
            if tag := _TAG.match(text, i):
                name = re.match(r"</?([A-Za-z][A-Za-z0-9-]*)", tag[0])
                if name and name[1] not in STYLING:
                    out.append(tag[0])
                elif name and name[1] == "br":
                    out.append(" ")
                i = tag.end()
                continue
        elif c == "&" and (entity := _ENTITY.match(text, i)):
            out.append(html.unescape(entity[0]))
            i = entity.end()
            continue
        elif c == "[" or c == "!" and text[i + 1 : i + 2] == "[":
            at = i + (c == "!")
            close = _bracketed(text, at)
            if close > 0:
                inner = text[at + 1 : close]
                target = _TARGET.match(text, close + 1)
                second = text[close + 1 : close + 2] == "[" and _bracketed(text, close + 1)
                end = -1
                if target:
                    end = target.end()
                elif second and second > 0 and normal_label(text[close + 2 : second] or inner) in labels:
                    end = second + 1
                elif normal_label(inner) in labels:
                    end = close + 1
                if end > 0:
                    out.extend(_pieces(inner, labels))
                    i = end
                    continue
        elif c in "*_":
            run = len(text) - i - len(text[i:].lstrip(c))
            opens, closes = _flanks(text, i, i + run)
            runs.append([len(out), c, run, opens, closes, run])
            out.append(c * run)
            i += run
            continue
        out.append(" " if c == "\n" else c)
        i += 1
    for j, closer in enumerate(runs):
        k = j - 1
        while closer[4] and closer[2] and k >= 0:
            opener = runs[k]
            thirds = (opener[4] or closer[3]) and (opener[5] + closer[5]) % 3 == 0 and (opener[5] % 3 or closer[5] % 3)
            if opener[1] == closer[1] and opener[3] and opener[2] and not thirds:
                used = 2 if opener[2] > 1 and closer[2] > 1 else 1
                opener[2] -= used
                closer[2] -= used
                for between in runs[k + 1 : j]:
                    between[3] = between[4] = False
            else:
                k -= 1
    for place, mark, left, *_ in runs:
        out[place] = mark * left
    return out
