"""Languages whose bodies stand in braces, by their tokens: Go, TypeScript, JavaScript, Java, C#, Rust, PHP, Swift, Kotlin, C, C++.

A file is read once, with a stack of open braces. What opens a brace is told from the words before it: a type
declaration, a function with its parameters, or a plain block. There is no grammar, so what a language writes in an
unusual way (macros that stand for braces, code in templates) is read as plain text; a file is never refused for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from symbolary.extract.findings import Findings
from symbolary.extract.tokens import Lexis, Token, lex, prose

_RAW = r"`(?:\\.|[^`\\])*`"
_TRIPLE = r'"""[\s\S]*?(?:"""|\Z)'
_QUOTED = (r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'")


@dataclass(frozen=True)
class Spec:
    """A language: its lexis, the words that begin types and functions, and how its parts are written."""

    lexis: Lexis
    types: frozenset[str]
    functions: frozenset[str] = frozenset()
    #: name(...) { defines: in a class, and outside of one (C and C++)
    plain_methods: bool = False
    plain_functions: bool = False
    #: words before the bases of a type; a colon for those that use it
    bases: frozenset[str] = frozenset()
    selves: frozenset[str] = frozenset({"this"})
    #: an unqualified call may be one of a method of its own class
    own_calls: bool = False
    ends_at_line: bool = False
    doc: str = r"/\*\*|///"
    drop: str | None = r"@\w+"
    keep_extension: bool = False
    #: words before a parenthesis that call nothing, besides those of all
    control: frozenset[str] = frozenset()
    modifiers: frozenset[str] = frozenset("public private protected internal static final abstract open override async export default virtual inline const readonly sealed partial data case extern unsafe pub suspend mutating get set new struct class enum union indirect fileprivate required convenience lateinit var val let declare".split())


CONTROL = frozenset(
    """if for while switch catch return sizeof typeof instanceof throw else do try finally case in of await yield not and or
    import package super this self operator where typename template function""".split()
)
_W = lambda s: frozenset(s.split())

SPECS: dict[str, Spec] = {
    "go": Spec(Lexis(strings=(*_QUOTED, _RAW)), _W("type"), _W("func"), ends_at_line=True, doc="//", drop=None, selves=frozenset(), control=_W("func go defer select range chan make len append cap copy")),
    "typescript": Spec(Lexis(strings=(*_QUOTED, _RAW), patterns=True), _W("class interface type enum"), _W("function"), plain_methods=True, bases=_W("extends implements"), control=_W("new delete")),
    "javascript": Spec(Lexis(strings=(*_QUOTED, _RAW), patterns=True), _W("class"), _W("function"), plain_methods=True, bases=_W("extends"), control=_W("new delete")),
    "java": Spec(Lexis(strings=(_TRIPLE, *_QUOTED)), _W("class interface enum record @interface"), plain_methods=True, bases=_W("extends implements"), own_calls=True, doc=r"/\*\*", control=_W("new synchronized")),
    "csharp": Spec(Lexis(strings=(r'@\$?"(?:""|[^"])*"', _TRIPLE, *_QUOTED), preprocessor=True), _W("class interface struct record enum delegate"), plain_methods=True, bases=_W(":"), own_calls=True, doc="///", control=_W("new base using lock foreach fixed checked unchecked nameof default when")),
    "rust": Spec(Lexis(strings=(r'r#*"[\s\S]*?"#*', r'"(?:\\.|[^"\\])*"', r"'(?:\\[^']+|[^'\\\n])'")), _W("struct enum union trait type"), _W("fn"), selves=_W("self Self"), doc=r"///|/\*\*", drop=None, control=_W("fn match loop unsafe as")),
    "php": Spec(Lexis(line_notes=("//", "#"), strings=(r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'")), _W("class interface trait enum"), _W("function"), bases=_W("extends implements"), selves=_W("this self static"), doc=r"/\*\*", control=_W("fn isset empty array list echo print unset exit die match foreach elseif include require include_once require_once new")),
    "swift": Spec(Lexis(strings=(_TRIPLE, _QUOTED[0])), _W("class struct enum actor protocol typealias"), _W("func init deinit"), bases=_W(":"), selves=_W("self Self"), own_calls=True, ends_at_line=True, drop=r"- ?(?:[Pp]arameter|[Rr]eturns|[Tt]hrows)", control=_W("func guard repeat")),
    "kotlin": Spec(Lexis(strings=(_TRIPLE, *_QUOTED)), _W("class object interface typealias"), _W("fun constructor"), bases=_W(":"), own_calls=True, ends_at_line=True, doc=r"/\*\*", control=_W("fun when constructor")),
    "c": Spec(Lexis(preprocessor=True), _W("struct union enum"), plain_functions=True, selves=frozenset(), doc=r"/\*|//", keep_extension=True, control=_W("defined")),
    "cpp": Spec(Lexis(strings=(r'R"\([\s\S]*?\)"', *_QUOTED), preprocessor=True), _W("class struct union enum"), plain_methods=True, plain_functions=True, bases=_W(":"), own_calls=True, doc=r"/\*|//", keep_extension=True, control=_W("new delete noexcept decltype alignof alignas static_assert static_cast dynamic_cast const_cast reinterpret_cast typeid")),
}
_BEFORE_TYPES = frozenset("struct union enum const unsigned signed final readonly ref out params in volatile static".split())
_STD_MACROS = frozenset("println print eprintln eprint format panic vec assert assert_eq assert_ne debug_assert write writeln matches todo unimplemented unreachable include_str env concat cfg dbg".split())
_WORDS_OF_TYPES = frozenset("int long short char bool boolean byte float double void string String var val let auto unsigned signed size_t usize isize u8 u16 u32 u64 i8 i16 i32 i64 f32 f64 str object any number never unknown Int Bool Double Float Long Any Unit Void error rune Self".split())


@dataclass
class Scope:
    """An open brace: what it belongs to."""

    kind: str  # class, function, or block
    name: str = ""
    mine: str = ""
    path: tuple[str, ...] = ()


class Reader:
    """One file of one language."""

    def __init__(self, spec: Spec, language: str, path: str, prefix: str, source: str, put: Callable[..., None]) -> None:
        self.spec, self.language, self.path = spec, language, path
        self.control = CONTROL | spec.control
        self.found = Findings(prefix, put)
        every = lex(source, spec.lexis)
        # notes by the line on which they end, and the lines that hold code
        self.notes: dict[int, Token] = {t.line + t.text.count("\n"): t for t in every if t.kind == "note"}
        self.hashes = [t for t in every if t.kind == "hash"]
        self.t = [t for t in every if t.kind not in ("note", "hash") and (t.kind != "line" or spec.ends_at_line)]
        self.code = {t.line for t in self.t if t.kind != "line"}
        self.scopes = [Scope("block", mine=prefix)]
        #: how many expression bodies end at a token
        self.closes: dict[int, int] = {}
        self.pending: dict[int, Scope] = {}
        if language == "rust" and (about := [t.text for t in every if t.kind == "note" and t.text.startswith("//!")]):
            self.found.doc(prefix, prose(about), 1)

    # tokens

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def after(self, i: int, opener: str, closer: str) -> int:
        """The place behind the closer of the opener at i."""
        depth, n = 0, len(self.t)
        while i < n:
            x = self.t[i].text
            depth += (x == opener) - (x == closer)
            i += 1
            if not depth:
                return i
        return n

    def skip_lines(self, i: int) -> int:
        while self.kind(i) == "line":
            i += 1
        return i

    def generic(self, i: int) -> int:
        """The place behind <...> at i, if it closes within a statement, else i."""
        if self.text(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.t) and k < i + 80 and self.text(k) not in (";", "{", "}", "&&", "||"):
            depth += (self.text(k) == "<") - (self.text(k) == ">")
            k += 1
            if not depth:
                return k
        return i

    def doc_above(self, line: int) -> str:
        """The comments that end on the line above, and those above them without a gap; annotations may stand between."""
        at, held = line - 1, []
        while at in self.code and at not in self.notes and any(t.line == at and t.text in ("@", "#", "[") for t in self.t):
            at -= 1
        while (note := self.notes.get(at)) and (at not in self.code or note.text.count("\n")):
            if not re.match(self.spec.doc, note.text):
                break
            held.append(note.text)
            at = note.line - 1
            if note.text.startswith("/*"):
                break
        return prose(held[::-1], self.spec.drop)

    # scopes

    @property
    def here(self) -> Scope:
        return self.scopes[-1]

    def holder(self) -> str:
        return next(s.mine for s in reversed(self.scopes) if s.mine)

    def owner(self) -> Scope | None:
        return next((s for s in reversed(self.scopes) if s.kind == "class"), None)

    def scope_path(self) -> tuple[str, ...]:
        return next((s.path for s in reversed(self.scopes) if s.path), ())

    def in_function(self) -> bool:
        return any(s.kind == "function" for s in self.scopes)

    # declarations

    def names_of_bases(self, i: int, stop: int) -> tuple[str, ...]:
        """Type names of a heritage list: the last part of each dotted name, without arguments."""
        out, want = [], True
        while i < stop:
            x = self.text(i)
            if x == "<":
                i = max(i + 1, self.generic(i))
                continue
            if x in ("(", "["):
                i = self.after(i, x, ")" if x == "(" else "]")
                continue
            if x in (",", "extends", "implements", ":", "with", "&"):
                want = True
            elif x in ("where", "by", "throws", "permits"):
                if x != "by":
                    break
                want = False
            elif self.kind(i) == "name" and want and x not in self.spec.modifiers:
                while self.text(i + 1) in (".", "::", "\\") and self.kind(i + 2) == "name":
                    i += 2
                out.append(self.text(i))
                want = False
            i += 1
        return tuple(n for n in dict.fromkeys(out) if n not in _WORDS_OF_TYPES)

    def type_at(self, i: int) -> int | None:
        """Reads a type declaration whose word is at i; gives the place to go on from."""
        word = self.text(i)
        if self.text(i - 1) in (".", "::", "->", "?.") or self.language in ("kotlin", "swift") and self.text(i - 1) == ":" or self.text(i + 1) in ("=", ":", ",", ")"):
            return None
        k = i + 1
        if self.language == "csharp" and word == "record" and self.text(k) in ("struct", "class"):
            k += 1
        if self.language in ("cpp", "c", "swift", "kotlin") and word == "enum" and self.text(k) in ("class", "struct"):
            k += 1
        if word == "delegate":  # the name stands before the parameters
            while k < len(self.t) and self.text(k) not in ("(", ";"):
                k += 1
            k -= 1
        if self.kind(k) != "name":
            return None
        while self.language == "cpp" and self.kind(k + 1) == "name" and self.text(k + 1) not in ("final",):
            k += 1  # a macro before the name
        name, line, start = self.text(k), self.t[i].line, k + 1
        stop = start
        while stop < len(self.t) and self.text(stop) not in ("{", ";", "="):
            if self.text(stop) == "(":
                stop = self.after(stop, "(", ")")
                continue
            if self.kind(stop) == "line":
                after = self.text(self.skip_lines(stop))
                if after not in ("{", ":", ",", "extends", "implements", "where") and self.text(stop - 1) not in (",", ":"):
                    break
            if self.language in ("c", "cpp") and self.text(stop) in (")", ",", "*", "&", "[") and ":" not in [self.text(x) for x in range(start, stop)]:
                return None  # a use of the type, not a declaration
            stop += 1
        body = self.text(stop) == "{"
        if self.language in ("c", "cpp") and not body:
            return None
        if self.language == "go":
            body = self.text(start) in ("struct", "interface") and body
        if self.language == "c" and self.kind(k + 1) == "name":
            return None
        bases: tuple[str, ...] = ()
        if self.spec.bases:
            begin = start
            while begin < stop and self.text(begin) not in self.spec.bases:
                begin = self.after(begin, "(", ")") if self.text(begin) == "(" else begin + 1
            begin = min(begin, stop)
            if self.language == "csharp" and begin < stop and word == "enum":
                begin = stop
            bases = self.names_of_bases(begin, stop)
        elif self.language == "rust" and word == "trait" and self.text(start) == ":":
            bases = self.names_of_bases(start, stop)
        owner = self.owner()
        path = self.scope_path()
        if self.language == "java":
            path = ()  # nested types are known by their own name
        mine = self.found.symbol(name, "class", path, line, owner.mine if owner else self.holder(), doc=self.doc_above(line), bases=bases)
        if self.language == "kotlin" and self.text(start) == "(":
            self.parameters(start, (*path, name), name)
        if body:
            self.pending[stop] = Scope("class", name, mine, (*path, name))
        return max(start, stop)

    def parameters(self, i: int, scope: tuple[str, ...], owner: str | None = None) -> None:
        """Declared types of the parameters in the parentheses at i; with owner, those of its properties."""
        stop = self.after(i, "(", ")") - 1
        k = i + 1
        while k < stop:
            if self.kind(k) == "name":
                a, b, c = self.text(k), self.text(k + 1), self.text(k + 2)
                if a in _BEFORE_TYPES:
                    k += 1
                    continue
                if b in (":", "?") and self.language in ("typescript", "kotlin", "swift", "rust"):
                    at = k + 2
                    while self.text(at) in (":", "&", "mut", "inout", "dyn", "@") or self.text(at) in ("Box", "Rc", "Arc", "<"):
                        at += 1
                    self.typed(scope, a, self.text(at), owner if owner and self.text(k - 1) in ("val", "var", "private", "public", "readonly", "protected") else None)
                elif self.language in ("java", "csharp", "c", "cpp", "php", "go") and (self.kind(k + 1) == "name" or b in ("*", "&", "$") and self.kind(k + 2) == "name"):
                    name, cls = (a, c if b == "*" else b) if self.language == "go" else (c if b in ("*", "&", "$") else b, a)
                    self.typed(scope, name, cls, owner if owner and self.text(k - 1) in ("private", "public", "protected", "readonly") else None)
            k += 1

    def typed(self, scope: tuple[str, ...], name: str, cls: str, owner: str | None = None) -> None:
        if cls and cls[:1].isupper() and cls not in _WORDS_OF_TYPES or cls and self.language in ("c", "go") and cls not in _WORDS_OF_TYPES and cls not in self.control and cls[:1].isalpha():
            self.found.variable(scope, name, cls)
            if owner:
                self.found.attribute(owner, name, cls)

    def body_after(self, i: int) -> int | None:
        """The brace of a body behind the parameters that end before i, or None if there is none."""
        k = i
        while k < len(self.t):
            x = self.text(k)
            if x == "{":
                return k
            if x in (";", "}", "=", ")") or x == "=>" or x == "," and self.language in ("typescript", "javascript"):
                return None
            if x == "(":
                k = self.after(k, "(", ")")
                continue
            if self.kind(k) == "line" and self.text(self.skip_lines(k)) not in ("{", "where", "throws", "->", ":"):
                return None
            if self.language == "go" and x in ("interface", "struct") and self.text(k + 1) == "{":
                k = self.after(k + 1, "{", "}")
                continue
            if self.language in ("cpp",) and x == ":" and self.text(k + 1) != ":":  # constructor initialisers
                k += 1
                while self.kind(k) == "name":
                    k += 1
                    k = self.generic(k)
                    opener = self.text(k)
                    if opener not in ("(", "{"):
                        break
                    k = self.after(k, opener, ")" if opener == "(" else "}")
                    k += self.text(k) == ","
                continue
            if self.kind(k) in ("string", "number") and self.language not in ("rust",):
                return None
            k += 1
        return None

    def define(self, name: str, i: int, params: int, receiver: str | None = None) -> int:
        """A function called name whose word is at i and whose parameters open at params."""
        line = self.t[i].line
        owner = self.owner() if not self.in_function() else None
        of = receiver or (owner.name if owner else None)
        path = (receiver,) if receiver else self.scope_path()
        label = name
        mine = self.found.symbol(label, "method" if of else "function", path, line, self.holder() if not receiver else "_".join([self.found.prefix, receiver.lower()]), of, self.doc_above(self.t[self.statement(i)].line))
        inner = (*path, name)
        self.parameters(params, inner, owner.name if owner and name in ("constructor", "__construct") else None)
        end = self.after(params, "(", ")")
        body = self.body_after(end)
        if body is not None:
            self.pending[body] = Scope("function", name, mine, inner)
        elif self.language in ("csharp", "kotlin"):
            self.expression(end, Scope("function", name, mine, inner))
        return body if self.language == "cpp" and body is not None else end

    def expression(self, i: int, scope: Scope) -> None:
        """A body that is an expression behind => or =, up to the end of the statement."""
        k, sign = i, "=>" if self.language == "csharp" else "="
        while k < len(self.t) and self.text(k) not in (sign, ";", "{", "}", ",") and self.kind(k) != "line":
            k += 1
        if self.text(k) != sign:
            return
        k, depth = self.skip_lines(k + 1), 0
        while k < len(self.t):
            x = self.text(k)
            depth += (x in ("(", "{", "[")) - (x in (")", "}", "]"))
            if depth < 0 or not depth and (x == ";" or self.kind(k) == "line"):
                break
            k += 1
        self.scopes.append(scope)
        self.closes[k] = self.closes.get(k, 0) + 1

    def statement(self, i: int) -> int:
        """Where the declaration at i begins: behind the last ; { } or line end."""
        k = i
        while k > 0 and self.text(k - 1) not in (";", "{", "}", ",") and self.kind(k - 1) != "line" and self.t[k - 1].line >= self.t[i].line - 3 and not (self.text(k - 1) == ")" and self.text(k) != "{"):
            k -= 1
        return k

    def function_at(self, i: int) -> int | None:
        """A function that a word begins."""
        k, receiver = i + 1, None
        word = self.text(i)
        if self.language == "go" and self.text(k) == "(":
            end = self.after(k, "(", ")")
            if self.kind(end) != "name" or self.text(end + 1) not in ("(", "["):
                return None
            inside = [x.text for x in self.t[k + 1 : end - 1] if x.kind == "name"]
            receiver = inside[1] if len(inside) > 1 else inside[0] if inside else None
            held = inside[0] if len(inside) > 1 else None
            k = end
            name = self.text(k)
            out = self.define(name, i, self.next_parenthesis(k + 1), receiver)
            if held and receiver:
                self.found.variable((receiver, name), held, receiver)
            return out
        if self.language in ("javascript", "typescript") and self.text(k) == "*":
            k += 1
        if self.language == "php" and self.text(k) == "&":
            k += 1
        if self.language in ("swift", "kotlin") and word in ("init", "deinit", "constructor"):
            if self.owner() is None or self.in_function():
                return None
            k += self.text(k) in ("?", "!")
            return self.define(word, i, k) if self.text(k) == "(" else None
        if self.language == "kotlin":
            k = self.generic(k)
            if self.text(k + 1) == "." and self.kind(k + 2) == "name":  # an extension belongs to the type it extends
                receiver, k = self.text(k), k + 2
        if self.kind(k) != "name":
            return None
        name = self.text(k)
        at = self.next_parenthesis(k + 1)
        return self.define(name, i, at, receiver) if at < len(self.t) else None

    def next_parenthesis(self, i: int) -> int:
        i = self.generic(i)
        if self.text(i) == "[":
            i = self.after(i, "[", "]")
        while i < len(self.t) and self.text(i) != "(":
            i += 1
        return i

    def plain_at(self, i: int) -> int | None:
        """name(...) that is a definition by where it stands and what is around it."""
        before, owner = self.text(i - 1), self.owner()
        in_class = self.here.kind == "class"
        if self.in_function() or before in (".", "->", "?.", "=", "return", "new", "(", ",", "!", "&&", "||", "+", "-", "?", "<<"):
            return None
        if not (in_class and self.spec.plain_methods or not in_class and self.spec.plain_functions):
            return None
        name, receiver = self.text(i), None
        if before == "::" and self.language == "cpp":
            receiver = self.text(i - 2)
        elif before == "~":
            name = "~" + name
        end = self.after(i + 1, "(", ")")
        body = self.body_after(end)
        typed = self.kind(i - 1) == "name" or before in (">", "*", "&", "]", "}", ";", "{", "~", "::", ":", "?", ")", "#")
        if body is None and not (in_class and self.declared(end) and (self.kind(i - 1) == "name" or before in (">", "]", "*", "&", "~", "?") or self.language == "typescript" or owner and name == owner.name)):
            return None
        if not typed and not in_class:
            return None
        if not in_class and self.kind(i - 1) != "name" and before not in ("*", "&", ">", "::", "~"):
            return None
        return self.define(name, i, i + 1, receiver)

    def declared(self, i: int) -> bool:
        """Whether a declaration without a body ends here: a prototype, an abstract method, an expression body."""
        k = i
        while k < len(self.t) and k < i + 60:
            x = self.text(k)
            if x in (";", "=>"):
                return True
            if x == "}" and self.language == "typescript":
                return True
            if x in ("{", "}", "(") or self.kind(k) == "string":
                return False
            k += 1
        return False

    # calls

    def call_at(self, i: int) -> None:
        name, before, line = self.text(i), self.text(i - 1), self.t[i].line
        if name in self.control and not (name == "init" and before == "."):
            return
        holder = self.holder()
        if self.language in ("c", "cpp") and not self.in_function() and self.kind(i - 1) in ("name", "") or before in ("*", "&", ">") and not self.in_function():
            return  # a prototype
        if before in (".", "->", "?.", "::"):
            chain, k = [], i - 1
            while self.text(k) in (".", "->", "?.", "::") and self.kind(k - 1) == "name":
                chain.append(self.text(k - 1))
                k -= 2
            chain.reverse()
            if self.text(k) == "$" and chain:
                k -= 1
            if self.text(k + 1) in (")", "]", "}", ".", "->", "?.", "::", "!", "?") or not chain:
                self.found.call(holder, name, line, "(" + self.text(k) + ")")
                return
            if self.language == "cpp" and chain[0] == "std":
                return
            if len(chain) == 1 and chain[0] in self.spec.selves:
                self.found.call(holder, name, line, None, on_self=True)
            elif len(chain) == 2 and chain[0] in self.spec.selves:
                self.found.call(holder, name, line, chain[1], own=True)
            elif len(chain) == 1 and self.language == "go" and any(chain[0] == v for v in self.receivers()):
                self.found.call(holder, name, line, None, on_self=True)
            elif len(chain) == 1:
                self.found.call(holder, name, line, chain[0])
            else:
                self.found.call(holder, name, line, "(" + ".".join(chain) + ")")
            return
        owner = self.owner()
        method_here = self.spec.own_calls and owner is not None and name in self.defined.get(owner.name, ()) and before != "new"
        self.found.call(holder, name, line, None, on_self=method_here)

    def receivers(self) -> list[str]:
        return [f["name"] for row, f in self.found.rest[-400:] if row == "var" and f["scope"] == ".".join(self.scope_path()) and f["cls"] == (self.scope_path() or ("",))[0]][:1]

    def variable_at(self, i: int) -> None:
        """Types of variables: x := T{, let x: T, T x = , var x = new T(, val x = T(."""
        a, b, c = self.text(i), self.text(i + 1), self.text(i + 2)
        if self.text(i - 1) == ":" and self.language in ("typescript", "kotlin", "swift", "rust"):
            return  # a type
        scope, owner = self.scope_path(), self.owner()
        cls = None
        if b in ("=", ":="):
            at = i + 2
            while self.text(at) in ("new", "&", "await", "*"):
                at += 1
            made = self.text(at)
            if self.kind(at) == "name" and made[:1].isupper() and (self.text(at + 1) in ("(", "{") or self.text(at + 1) == "::" and self.text(at + 3) == "("):
                cls = made
            elif self.text(at - 1) == "new" and self.kind(at) == "name":
                cls = made
        elif b == ":" and self.language in ("typescript", "kotlin", "swift", "rust") and self.kind(i + 2) in ("name", "mark"):
            at = i + 2
            while self.text(at) in ("&", "mut", "Box", "Rc", "Arc", "<", "dyn"):
                at += 1
            cls = self.text(at) if self.kind(at) == "name" and self.text(at)[:1].isupper() else None
        elif self.kind(i + 1) == "name" and c in ("=", ";") and self.language in ("java", "csharp", "cpp", "c") and a not in self.control and a[:1].isupper():
            self.typed(scope, b, a, owner.name if owner and not self.in_function() else None)
            return
        elif b == "*" and self.kind(i + 2) == "name" and self.text(i + 3) in ("=", ";") and self.language in ("c", "cpp") and a not in self.control:
            self.typed(scope, c, a, owner.name if owner and not self.in_function() else None)
            return
        if not cls or cls in _WORDS_OF_TYPES:
            return
        before = self.text(i - 1)
        if before in (".", "->") and self.text(i - 2) in self.spec.selves and owner:
            self.found.attribute(owner.name, a, cls)
        elif before not in (".", "->", "::"):
            self.found.variable(scope, a, cls)
            if owner and not self.in_function():
                self.found.attribute(owner.name, a, cls)

    # the whole file

    def read(self) -> None:
        from symbolary.extract.imports import read_imports

        read_imports(self.language, self.path, self.t, self.hashes, self.found)
        self.defined = self._methods_by_class()
        i = 0
        while i < len(self.t):
            x, kind = self.text(i), self.kind(i)
            for _ in range(self.closes.pop(i, 0)):
                self.scopes.pop()
            if x == "{":
                self.scopes.append(self.pending.pop(i, None) or Scope("block"))
            elif x == "}":
                if len(self.scopes) > 1:
                    self.scopes.pop()
            elif kind == "name":
                i = self.name_at(i)
                continue
            i += 1
        self.found.flush()

    def name_at(self, i: int) -> int:
        x, spec = self.text(i), self.spec
        if self.language == "rust" and x == "impl" and not self.in_function():
            return self.impl_at(i)
        if self.language == "swift" and x == "extension" and self.kind(i + 1) == "name" or self.language == "kotlin" and x == "companion" and self.text(i + 1) == "object" and self.text(i + 2) == "{":
            return self.fold_at(i)
        if self.language == "rust" and x == "macro_rules" and self.text(i + 1) == "!":
            self.found.symbol(self.text(i + 2), "function", (), self.t[i].line, self.holder(), doc=self.doc_above(self.t[i].line))
            return i + 3
        if self.language == "c" and x == "typedef":
            return self.typedef_at(i)
        if x in spec.types and (not self.in_function() or self.language in ("javascript", "typescript")) and (at := self.type_at(i)) is not None:
            return at
        if x in spec.functions and (at := self.function_at(i)) is not None:
            return at
        if self.language in ("javascript", "typescript") and (at := self.arrow_at(i)) is not None:
            return at
        if self.language == "go" and self.here.kind == "class" and (self.kind(i - 1) == "line" or self.text(i - 1) in ("{", "*")):
            k = i + 2 if self.text(i + 1) == "." else i
            if self.kind(k + 1) == "line" and (self.kind(i - 1) != "mark" or self.text(i - 1) != "*" or self.kind(i - 2) == "line"):
                self.found.base(self.here.mine, self.text(k))
                return k + 1
        if self.language == "php" and x == "use" and self.here.kind == "class":
            stop = i
            while self.text(stop) not in (";", "{", ""):
                stop += 1
            self.found.base(self.here.mine, *self.names_of_bases(i + 1, stop))
            return stop
        called = self.generic(i + 1) if self.text(i + 1) == "<" and x[:1].isalpha() else i + 1
        if self.language == "rust" and self.text(i + 1) == "::" and self.text(i + 2) == "<":
            called = self.generic(i + 2)
        macro = self.language == "rust" and self.text(i + 1) == "!" and self.text(i + 2) in ("(", "[", "{")
        if self.text(called) == "(" or macro:
            if x not in self.control and called == i + 1 and not macro and (at := self.plain_at(i)) is not None:
                return at
            if not (macro and x in _STD_MACROS):
                self.call_at(i)
        else:
            self.variable_at(i)
        if self.language == "rust" and x in ("self",) and self.text(i + 1) == ".":
            return i + 1
        return i + 1

    def impl_at(self, i: int) -> int:
        """impl T, or impl Trait for T, which is one of T's bases."""
        k = self.generic(i + 1)
        stop = k
        while stop < len(self.t) and self.text(stop) not in ("{", ";"):
            stop += 1
        split = next((x for x in range(k, stop) if self.text(x) == "for"), None)
        where = next((x for x in range(k, stop) if self.text(x) == "where"), stop)
        name = self.names_of_bases(k if split is None else split + 1, where)
        if name:
            mine = "_".join([self.found.prefix, name[0].lower()])
            if split is not None:
                self.late_bases.append((mine, self.names_of_bases(k, split)))
            self.pending[stop] = Scope("class", name[0], mine, (name[0],))
        return stop

    def fold_at(self, i: int) -> int:
        """A body that adds to a type that is declared elsewhere or around it."""
        stop = i
        while stop < len(self.t) and self.text(stop) != "{":
            stop += 1
        name = self.text(i + 1)
        if self.text(i) == "companion":
            owner = self.owner()
            self.pending[stop] = Scope("class", owner.name, owner.mine, owner.path) if owner else Scope("block")
        else:
            mine = "_".join([self.found.prefix, name.lower()])
            colon = next((x for x in range(i, stop) if self.text(x) == ":"), stop)
            self.late_bases.append((mine, self.names_of_bases(colon, stop)))
            self.pending[stop] = Scope("class", name, mine, (name,))
        return stop

    def typedef_at(self, i: int) -> int:
        """typedef struct tag { ... } name; is one type by its last name."""
        k = i + 1
        while k < len(self.t) and self.text(k) not in ("{", ";"):
            k += 1
        if self.text(k) != "{":
            if self.kind(k - 1) == "name":
                self.found.symbol(self.text(k - 1), "class", (), self.t[i].line, self.holder(), doc=self.doc_above(self.t[i].line))
            return k
        end = self.after(k, "{", "}")
        if self.kind(end) == "name":
            self.found.symbol(self.text(end), "class", (), self.t[i].line, self.holder(), doc=self.doc_above(self.t[i].line))
        return end

    def arrow_at(self, i: int) -> int | None:
        """const name = (...) => ... and name = function (...): functions by the name they are given."""
        if self.text(i + 1) not in ("=", ":") or self.in_function() and self.here.kind != "class":
            return None
        k = i + 2
        if self.text(i + 1) == ":":
            return None
        k += self.text(k) == "async"
        if self.text(k) == "function":
            at = self.next_parenthesis(k + 1)
        elif self.text(k) == "(":
            at = k
            if self.text(self.after(k, "(", ")")) not in ("=>", ":"):
                return None
            if self.text(self.after(k, "(", ")")) == ":" and "=>" not in [self.text(x) for x in range(self.after(k, "(", ")"), self.after(k, "(", ")") + 12)]:
                return None
        else:
            return None
        name, receiver = self.text(i), None
        if self.text(i - 1) == "." and self.text(i - 2) == "prototype":
            receiver = self.text(i - 4)
        elif self.text(i - 1) == ".":
            receiver = self.text(i - 2) if self.text(i - 2)[:1].isupper() else None
            if receiver is None:
                return None
        end = self.define(name, i, at, receiver)
        k = end
        while k < len(self.t) and self.text(k) not in ("=>", "{", ";"):
            k += 1
        if self.text(k) == "=>" and self.text(k + 1) == "{":
            path = (receiver,) if receiver else self.scope_path()
            self.pending[k + 1] = Scope("function", name, "_".join([self.found.prefix, *(s.lower() for s in path), name.lower()]), (*path, name))
        return end

    def _methods_by_class(self) -> dict[str, set[str]]:
        """Names that are defined in the body of each class, by a first look at what stands before a parameter list."""
        self.late_bases: list[tuple[str, tuple[str, ...]]] = []
        out: dict[str, set[str]] = {}
        stack: list[str] = []
        name = None
        for i in range(len(self.t)):
            x = self.text(i)
            if self.kind(i) == "name":
                if (x in self.spec.types or x == "extension") and self.kind(i + 1) == "name":
                    name = self.text(i + 1)
                    if self.text(i + 1) in ("class", "struct"):
                        name = self.text(i + 2)
                elif self.text(i + 1) == "(" and stack and stack[-1] and x not in self.control and self.text(i - 1) not in (".", "=", "new", "return", "->", "(", ","):
                    out.setdefault(stack[-1], set()).add(x)
            elif x == "{":
                stack.append(name or "")
                name = None
            elif x == "}" and stack:
                stack.pop()
            elif x == ";":
                name = None
        return out


def reader(language: str):
    """A reader of the language: read(path, prefix, package, source, put)."""

    def read(path: str, prefix: str, package: list[str], source: str, put: Callable[..., None]) -> None:
        r = Reader(SPECS[language], language, path, prefix, source, put)
        flush, r.found.flush = r.found.flush, lambda: None
        r.read()
        for mine, bases in r.late_bases:
            r.found.base(mine, *bases)
        flush()

    return read
