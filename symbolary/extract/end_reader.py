"""Languages whose bodies end with a word: Ruby, Lua and Bash, by their tokens and a stack of what is open."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable

from symbolary.extract.findings import Findings
from symbolary.extract.tokens import Lexis, Token, lex, prose

_QUOTED = (r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'")
LEXES = {
    "ruby": Lexis(line_notes=("#",), block_notes=(("=begin", "=end"),), strings=(*_QUOTED, r"`(?:\\.|[^`\\])*`"), patterns=True),
    "lua": Lexis(line_notes=("--",), block_notes=(("--[[", "]]"), ("--[=[", "]=]")), strings=(r"\[=*\[[\s\S]*?\]=*\]", *_QUOTED)),
    "bash": Lexis(line_notes=("#",), block_notes=(), strings=(r'"(?:\\.|[^"\\])*"', r"'[^']*'")),
}
_DROP = {"ruby": r"(?:frozen_string_literal|rubocop|encoding|:nodoc:|!)", "lua": r"@\w+", "bash": r"(?:!|shellcheck|@test)"}
_RUBY_OPENS, _RUBY_AT_START = {"class", "module", "def", "begin", "case"}, {"if", "unless", "while", "until", "for"}
_RUBY_WORDS = _RUBY_OPENS | _RUBY_AT_START | set("end do then else elsif when rescue ensure return yield and or not in self nil true false super puts raise require require_relative attr_reader attr_writer attr_accessor include extend prepend private public protected lambda proc".split())
_LUA_WORDS = set("function end if then else elseif for while do repeat until return local and or not in nil true false require setmetatable break goto".split())
_BASH_WORDS = set("if then else elif fi for while until do done case esac function in select time local return exit echo printf read cd set shift export source eval exec test trap declare readonly unset true false break continue let".split())


class Reader:
    def __init__(self, language: str, path: str, prefix: str, source: str, put: Callable[..., None]) -> None:
        self.language, self.path = language, path
        self.found = Findings(prefix, put)
        every = lex(source, LEXES[language])
        self.notes = {t.line + t.text.count("\n"): t for t in every if t.kind == "note"}
        self.t: list[Token] = [t for t in every if t.kind != "note"]
        self.code = {t.line for t in self.t if t.kind != "line"}
        #: (kind, name, id) of what is open; a plain block has no id
        self.open: list[tuple[str, str, str]] = []

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else "line"

    def doc_above(self, line: int) -> str:
        at, held = line - 1, []
        while (note := self.notes.get(at)) and at not in self.code:
            held.append(note.text)
            at = note.line - 1
        return prose(held[::-1], _DROP[self.language])

    def holder(self) -> str:
        return next((mine for _, _, mine in reversed(self.open) if mine), self.found.prefix)

    def scope(self) -> tuple[str, ...]:
        return tuple(name for _, name, mine in self.open if mine)

    def owner(self) -> str | None:
        top = next((k for k in reversed(self.open) if k[2]), None)
        return top[1] if top and top[0] == "class" else None

    def at_start(self, i: int) -> bool:
        return self.kind(i - 1) == "line" or self.text(i - 1) in (";", "=", "then", "do", "else", "(", "{", "|", "&&", "||", "return")

    def receiver(self, i: int) -> tuple[str | None, bool, bool]:
        """(receiver, whether on self, whether an attribute of self) of the call at i."""
        if self.text(i - 1) not in (".", ":", "?.", "::") or self.kind(i - 2) == "line":
            return None, False, False
        x, far = self.text(i - 2), self.text(i - 3)
        if self.kind(i - 2) != "name":
            return f"({x})", False, False
        if x == "self" and far not in (".", ":"):
            return None, True, False
        if far == "@":
            return x, False, True
        if far in (".", ":") and self.text(i - 4) == "self":
            return x, False, True
        return (f"({far}{x})" if far in (".", ":", "::", "?.") else x), False, False

    def read(self) -> None:
        step = {"ruby": self.ruby, "lua": self.lua, "bash": self.bash}[self.language]
        i = 0
        while i < len(self.t):
            i = step(i)
        self.found.flush()

    # Ruby

    def ruby(self, i: int) -> int:
        x, line = self.text(i), self.t[i].line
        if self.kind(i) != "name" or self.text(i - 1) in (":", "@") and self.text(i - 2) != "?" and x not in ("end",):
            return i + 1
        plain = self.text(i - 1) not in (".", "?.", "::")
        if x in ("class", "module") and plain and self.kind(i + 1) == "name":
            k, name = i + 1, self.text(i + 1)
            while self.text(k + 1) == "::":
                k += 2
                name = self.text(k)
            bases = ()
            if self.text(k + 1) == "<" and self.kind(k + 2) == "name":
                k += 2
                while self.text(k + 1) == "::":
                    k += 2
                bases = (self.text(k),)
            mine = self.found.symbol(name, "class", self.scope(), line, self.holder(), doc=self.doc_above(line), bases=bases)
            self.open.append(("class", name, mine))
            return k + 1
        if x == "class" and plain and self.text(i + 1) == "<":
            self.open.append(("block", "", ""))
            return i + 1
        if x == "def" and plain:
            k = i + 1
            while self.text(k + 1) == "." and self.kind(k + 2) == "name":
                k += 2
            name = self.text(k)
            if self.text(k + 1) in ("=", "?", "!") and (self.text(k + 2) in ("(",) or self.text(k + 1) != "="):
                name += self.text(k + 1)
                k += 1
            owner = self.owner()
            mine = self.found.symbol(name, "method" if owner else "function", self.scope(), line, self.holder(), owner, self.doc_above(line))
            stop = k + 1
            if self.text(stop) == "(":
                while stop < len(self.t) and self.text(stop) != ")":
                    stop += 1
                stop += 1
            if self.text(stop) != "=":  # an endless method has no end
                self.open.append(("function", name, mine))
            return stop
        if x in ("attr_reader", "attr_writer", "attr_accessor") and self.owner():
            k = i + 1
            while self.kind(k) != "line":
                if self.kind(k) == "name" and self.text(k - 1) == ":":
                    for name in ([self.text(k)] if x != "attr_writer" else []) + ([self.text(k) + "="] if x != "attr_reader" else []):
                        self.found.symbol(name, "method", self.scope(), line, self.holder(), self.owner())
                k += 1
            return k
        if x in ("include", "extend", "prepend") and self.owner() and self.kind(i + 1) == "name":
            k = i + 1
            while self.text(k + 1) == "::":
                k += 2
            self.found.base(self.holder(), self.text(k))
            return k + 1
        if x in ("require", "require_relative") and plain:
            k = i + 1 + (self.text(i + 1) == "(")
            if self.kind(k) == "string":
                self.site(self.text(k)[1:-1], line, relative=x == "require_relative")
            return k + 1
        if plain and (x in _RUBY_OPENS or x in _RUBY_AT_START and self.at_start(i) or x == "do" and not self.loop_line(i)):
            self.open.append(("block", "", ""))
        elif x == "end" and plain:
            if self.open:
                self.open.pop()
        elif x not in _RUBY_WORDS or self.text(i - 1) == ".":
            self.ruby_call(i)
        return i + 1

    def loop_line(self, i: int) -> bool:
        k = i - 1
        while self.kind(k) != "line":
            if self.text(k) in ("while", "until", "for") and self.at_start(k):
                return True
            k -= 1
        return False

    def ruby_call(self, i: int) -> None:
        x, line, scope = self.text(i), self.t[i].line, self.scope()
        made = self.text(i + 2) if self.text(i + 1) == "=" else ""
        if made[:1].isupper() and self.text(i + 3) == "." and self.text(i + 4) == "new":
            if self.text(i - 1) == "@" and self.open:
                owner = next((n for k, n, _ in reversed(self.open) if k == "class"), None)
                if owner:
                    self.found.attribute(owner, x, made)
            else:
                self.found.variable(scope, x, made)
        name = x + (self.text(i + 1) if self.text(i + 1) in ("?", "!") and self.text(i + 2) in ("(", "") or self.text(i + 1) in ("?", "!") and self.kind(i + 2) == "line" else "")
        receiver, on_self, own = self.receiver(i)
        dotted = self.text(i - 1) in (".", "?.")
        bare = not dotted and (self.text(i + 1) == "(" or self.at_start(i) and self.kind(i + 1) in ("string", "name", "number") and self.text(i + 1) not in _RUBY_WORDS) and self.text(i + 1) not in ("=",) and not x[:1].isupper()
        if dotted and x == "new" and receiver and receiver[:1].isupper():
            self.found.call(self.holder(), receiver, line)
        elif dotted:
            self.found.call(self.holder(), name, line, receiver, on_self, own)
        elif bare:
            self.found.call(self.holder(), name, line, None, on_self=any(k == "class" for k, _, _ in self.open))

    def site(self, target: str, line: int, relative: bool) -> None:
        path = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), target)) if relative else target
        path = re.sub(r"\.(?:rb|lua|sh|bash)$", "", path)
        self.found.imported(path.strip("./").replace("/", "."), line)

    # Lua

    def lua(self, i: int) -> int:
        x, line = self.text(i), self.t[i].line
        if self.kind(i) != "name":
            return i + 1
        if x == "function":
            return self.lua_function(i)
        if x in ("do", "repeat") or x == "if":
            self.open.append(("block", "", ""))
        elif x in ("end", "until"):
            if self.open:
                self.open.pop()
        elif x == "require":
            k = i + 1 + (self.text(i + 1) == "(")
            if self.kind(k) == "string":
                module = self.text(k).strip("\"'[]").replace("/", ".")
                local = self.text(i - 2) if self.text(i - 1) == "=" else ""
                self.found.imported(module, line, *([(local, module)] if local else []))
            return k + 1
        elif x == "setmetatable" and self.text(i + 1) == "(" and self.kind(i + 2) == "name" and self.text(i + 3) == "," and self.text(i + 4) == "{" and self.text(i + 5) == "__index":
            self.found.base("_".join([self.found.prefix, self.text(i + 2).lower()]), self.text(i + 7))
        elif x not in _LUA_WORDS and (self.text(i + 1) in ("(", "{") or self.kind(i + 1) == "string") and self.text(i + 1) != "{":
            receiver, on_self, own = self.receiver(i)
            self.found.call(self.holder(), x, line, receiver, on_self, own)
        elif self.text(i + 1) == "=" and self.text(i + 2)[:1].isupper() and self.text(i + 3) in (".", ":") and self.text(i + 4) == "new":
            self.found.variable(self.scope(), x, self.text(i + 2))
        return i + 1

    def lua_function(self, i: int) -> int:
        line, k = self.t[i].line, i + 1
        parts, joint = [], ""
        while self.kind(k) == "name":
            parts.append(self.text(k))
            if self.text(k + 1) not in (".", ":"):
                k += 1
                break
            joint = self.text(k + 1)
            k += 2
        if not parts:
            b = i - 1
            if self.text(b) == "=" and self.kind(b - 1) == "name":
                parts = [self.text(b - 1)]
                while self.text(b - 2) == "." and self.kind(b - 3) == "name":
                    parts.insert(0, self.text(b - 3))
                    b -= 2
        if not parts:
            self.open.append(("block", "", ""))
            return i + 1
        name, owner = parts[-1], parts[-2] if len(parts) > 1 else None
        doc = self.doc_above(line)
        if owner and owner in self.tables():
            mine_class = self.found.symbol(owner, "class", (), line, self.found.prefix)
            mine = self.found.symbol(name, "method", (owner,), line, mine_class, owner, doc)
        else:
            mine = self.found.symbol(name, "function", self.scope(), line, self.holder(), doc=doc)
        if joint == ":" and owner:
            self.found.variable((owner, name), "self", owner)
        self.open.append(("function", name, mine))
        return k

    def tables(self) -> set[str]:
        """Tables that have methods, which makes them classes."""
        if not hasattr(self, "_tables"):
            self._tables = {self.text(k + 1) for k in range(len(self.t)) if self.text(k) == "function" and self.text(k + 2) == ":"} | {self.text(k) for k in range(len(self.t)) if self.text(k + 1) == "." and self.text(k + 2) == "__index" and self.text(k + 3) == "="}
        return self._tables

    # Bash

    def bash(self, i: int) -> int:
        x, line = self.text(i), self.t[i].line
        if x == "{":
            self.open.append(("block", "", "") if not self.waiting else self.waiting)
            self.waiting = None
        elif x == "}" and self.open and self.text(i - 1) != "$":
            self.open.pop()
        elif x == "$" and self.text(i + 1) == "{":  # ${...} is no block
            depth, k = 0, i + 1
            while k < len(self.t):
                depth += (self.text(k) == "{") - (self.text(k) == "}")
                k += 1
                if not depth:
                    break
            return k
        elif self.kind(i) == "name" and self.first(i):
            if x == "function" and self.kind(i + 1) == "name" or self.text(i + 1) == "(" and self.text(i + 2) == ")":
                name = self.text(i + 1) if x == "function" else x
                mine = self.found.symbol(name, "function", self.scope(), line, self.holder(), doc=self.doc_above(line))
                self.waiting = ("function", name, mine)
                return i + (2 if x == "function" else 3)
            if x == "source":
                self.bash_site(i)
            elif x not in _BASH_WORDS and self.text(i + 1) not in ("=", "+", "/", ".", "["):
                self.found.call(self.holder(), x, line)
        elif x == "." and self.first(i):
            self.bash_site(i)
        return i + 1

    waiting: tuple[str, str, str] | None = None

    def first(self, i: int) -> bool:
        """Whether a command begins here."""
        return self.kind(i - 1) == "line" or self.text(i - 1) in (";", "&&", "||", "|", "&", "then", "do", "else", "{", "(", "!") and self.text(i - 1) not in ("$",)

    def bash_site(self, i: int) -> None:
        line, k, parts = self.t[i].line, i + 1, []
        while self.kind(k) != "line" and self.text(k) not in (";", "&&", "||"):
            parts.append(self.text(k).strip("\"'"))
            k += 1
        raw = "".join(parts)
        anchored = raw.startswith(("$", "/"))
        tail = re.sub(r"^\$(?:\{[^}]*\}|\([^)]*\)|\w+)/*", "", raw)
        if tail and "$" not in tail:
            self.site(tail, line, relative=not anchored and tail.startswith("."))


def reader(language: str):
    """A reader of the language: read(path, prefix, package, source, put)."""

    def read(path: str, prefix: str, package: list[str], source: str, put: Callable[..., None]) -> None:
        Reader(language, path, prefix, source, put).read()

    return read
