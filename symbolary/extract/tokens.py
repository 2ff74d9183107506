"""A lexer for source code: names, numbers, strings, marks, line ends and comments of many languages, without a grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: Characters of a doc text that are kept.
DOC_CHARS = 600


@dataclass(frozen=True)
class Token:
    """kind: name, number, string, mark, line (an end of line), note (a comment), or hash (a preprocessor line)."""

    kind: str
    text: str
    line: int


@dataclass(frozen=True)
class Lexis:
    """What comments and strings look like."""

    line_notes: tuple[str, ...] = ("//",)
    block_notes: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    strings: tuple[str, ...] = (r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'")
    preprocessor: bool = False
    patterns: bool = False  # a slash may begin a pattern


_MARKS = r"::|->|=>|\?\.|:=|\.\.\.|&&|\|\||<-|==|!=|<=|>=|[^\s\w]"
_NAME = r"[^\W\d]\w*"


@lru_cache(32)
def _pattern(lexis: Lexis) -> re.Pattern[str]:
    notes = [re.escape(a) + r"[\s\S]*?(?:" + re.escape(b) + r"|\Z)" for a, b in lexis.block_notes] + [re.escape(a) + r"[^\n]*" for a in lexis.line_notes]
    parts = [("note", "|".join(notes) or r"(?!)"), ("string", "|".join(lexis.strings)), ("name", _NAME), ("number", r"\d[\w.]*"), ("line", r"\n"), ("mark", _MARKS)]
    if lexis.preprocessor:
        parts.insert(0, ("hash", r"(?m:^[ \t]*#(?:\\\n|[^\n])*)"))
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in parts))


_SLASH = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_BEFORE_SLASH = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "return", "typeof", "=>"}


def lex(source: str, lexis: Lexis) -> list[Token]:
    """All tokens in order, line ends and comments among them."""
    pattern, out, at, line = _pattern(lexis), [], 0, 1
    last = ""
    while m := pattern.search(source, at):
        kind, text, end = m.lastgroup, m[0], m.end()
        if lexis.patterns and text == "/" and (not last or last in _BEFORE_SLASH) and (p := _SLASH.match(source, m.start())):
            kind, text, end = "string", p[0], p.end()
        line += source.count("\n", at, m.start())
        out.append(Token(kind, text, line))
        line += text.count("\n")
        if kind not in ("line", "note"):
            last = text
        at = end
    return out


_EDGE = re.compile(r"^\s*(?:/\*+!?|\*+/|///?!?|//!|--+\[*=*\[?|#+!?|\*)?[ \t]?|\s*\*+/\s*$|\s*\]=*\]\s*$")
_XML = re.compile(r"</?[a-zA-Z][^<>]*>")


def prose(notes: list[str], drop: str | None = None) -> str:
    """The words of comments: without their marks and tags, and without lines that match `drop`."""
    lines = [_XML.sub(" ", _EDGE.sub("", x)).strip() for note in notes for x in note.split("\n")]
    kept = [x for x in lines if x and not (drop and re.match(drop, x))]
    return "\n".join(kept)[:DOC_CHARS].strip()
