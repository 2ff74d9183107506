"""What files import, by language: a site for each statement, and the names that it binds."""

from __future__ import annotations

import posixpath
import re

from symbolary.extract.findings import Findings
from symbolary.extract.tokens import Token


def _plain(text: str) -> str:
    return text[1:-1] if len(text) > 1 else text


def _module(path: str, here: str) -> str:
    """A module path as dotted text: relative ones from the file's folder, without an extension."""
    if path.startswith("."):
        path = posixpath.normpath(posixpath.join(posixpath.dirname(here), path))
    path = re.sub(r"\.(?:[mc]?[jt]sx?|json)$", "", path)
    return path.strip("./").replace("/", ".")


def _until(t: list[Token], i: int, ends: tuple[str, ...], lines: bool = False) -> int:
    while i < len(t) and t[i].text not in ends and not (lines and t[i].kind == "line"):
        i += 1
    return i


def _dotted(t: list[Token], i: int, stop: int, joint: tuple[str, ...]) -> tuple[str, int]:
    parts = []
    while i < stop and t[i].kind == "name":
        parts.append(t[i].text)
        if i + 1 < stop and t[i + 1].text in joint:
            i += 2
            continue
        i += 1
        break
    return ".".join(parts), i


def _bind(found: Findings, module: str, line: int, pairs: list[tuple[str, str]]) -> None:
    found.imported(module, line, *((local, f"{module}.{name}" if name else module) for local, name in pairs))


def _script(t: list[Token], i: int, path: str, found: Findings) -> None:
    """import ... from "m", export ... from "m", require("m") of JavaScript and TypeScript."""
    x, line = t[i].text, t[i].line
    if x == "require" and i + 2 < len(t) and t[i + 1].text == "(" and t[i + 2].kind == "string":
        module = _module(_plain(t[i + 2].text), path)
        k, names = i - 2, []
        if i > 1 and t[i - 1].text == "=":
            if t[k].kind == "name":
                names = [(t[k].text, "")]
            elif t[k].text == "}":
                while k >= 0 and t[k].text != "{":
                    if t[k].kind == "name" and t[k - 1].text != ":":
                        local = t[k + 2].text if t[k + 1].text == ":" else t[k].text
                        names.append((local, t[k].text))
                    k -= 1
        _bind(found, module, line, names)
        return
    stop = next((k for k in range(i + 1, min(len(t), i + 200)) if t[k].kind == "string" or t[k].text == ";"), None)
    if stop is None or t[stop].kind != "string" or not (t[stop - 1].text == "from" or stop == i + 1) or x == "export" and t[stop - 1].text != "from":
        return
    module, names = _module(_plain(t[stop].text), path), []
    k = i + 1
    while k < stop:
        if t[k].kind == "name" and t[k].text not in ("from", "type", "as"):
            if t[k - 1].text == "as":
                pass
            elif k + 2 < stop and t[k + 1].text == "as":
                names.append((t[k + 2].text, t[k].text))
            else:
                braced = any(t[b].text == "{" for b in range(i, k))
                names.append((t[k].text, t[k].text if braced else ""))
        elif t[k].text == "*" and k + 2 < stop and t[k + 1].text == "as":
            names.append((t[k + 2].text, ""))
        k += 1
    _bind(found, module, line, names if x == "import" else [])


def _rust_tree(t: list[Token], i: int, stop: int, head: list[str]) -> list[tuple[str, list[str]]]:
    """(local name, path) of a use tree."""
    out, path = [], list(head)
    while i < stop:
        x = t[i].text
        if x == "{":
            depth, k, begin = 0, i, i + 1
            while k < stop:
                depth += (t[k].text == "{") - (t[k].text == "}")
                if depth == 1 and t[k].text == "," or not depth:
                    out += _rust_tree(t, begin, k, path)
                    begin = k + 1
                if not depth:
                    break
                k += 1
            return out
        if x == "as" and i + 1 < stop:
            return [(t[i + 1].text, path)]
        if t[i].kind == "name" or x == "*":
            path = [*path, x]
        i += 1
    if not path:
        return out
    if path[-1] == "self":
        path = path[:-1]
    return [*out, (path[-1], path)] if path and path[-1] != "*" else [*out, ("", path[:-1])]


def read_imports(language: str, path: str, t: list[Token], hashes: list[Token], found: Findings) -> None:
    folder = [p for p in path.split("/")[:-1]]
    for h in hashes:
        if m := re.match(r'\s*#\s*(?:include|import)\s*(["<])([^">]+)[">]', h.text):
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), m[2])) if m[1] == '"' else m[2]
            found.imported(re.sub(r"[./]", ".", target.strip("./")), h.line)
    depth = 0
    for i, x in enumerate(t):
        depth += (x.text == "{") - (x.text == "}")
        if x.kind != "name":
            continue
        before = t[i - 1].text if i else ""
        if language in ("javascript", "typescript"):
            if x.text in ("import", "export") and before not in (".", "?.") and not depth or x.text == "require":
                _script(t, i, path, found)
        elif language == "go" and x.text == "import" and not depth:
            opened = i + 1 < len(t) and t[i + 1].text == "("
            stop = _until(t, i, (")",)) if opened else _until(t, i + 1, (), lines=True)
            for k in range(i + 1, stop):
                if t[k].kind == "string":
                    module = _plain(t[k].text).replace("/", ".")
                    local = t[k - 1].text if t[k - 1].kind == "name" and t[k - 1].text != "import" else module.rsplit(".", 1)[-1]
                    found.imported(module, t[k].line, (local, module))
        elif language == "java" and x.text == "import":
            stop = _until(t, i, (";",))
            static = t[i + 1].text == "static"
            name, _ = _dotted(t, i + 1 + static, stop, (".",))
            parts = name.split(".")
            head = next((k + 1 for k, p in enumerate(parts) if p[:1].isupper()), len(parts))
            cls = ".".join(parts[:head])
            found.imported(cls, x.line, (parts[-1], f"{cls}.{parts[-1]}" if static or head == len(parts) and parts[-1][:1].isupper() else name))
        elif language == "csharp" and x.text == "using" and before in ("", ";", "}") and not depth:
            stop = _until(t, i, (";",))
            at = i + 1 + (t[i + 1].text in ("static", "global"))
            if t[at + 1].text == "=":
                name, _ = _dotted(t, at + 2, stop, (".",))
                found.imported(name, x.line, (t[at].text, name))
            else:
                name, _ = _dotted(t, at, stop, (".",))
                found.imported(name, x.line)
        elif language == "rust" and x.text == "use" and before in ("", ";", "}", "pub", ")", "]"):
            stop = _until(t, i, (";",))
            pairs = []
            for local, parts in _rust_tree(t, i + 1, stop, []):
                if parts and parts[0] == "crate":
                    parts = [*folder[: folder.index("src") + 1 if "src" in folder else 0], *parts[1:]]
                elif parts and parts[0] == "self":
                    parts = [*folder, *parts[1:]]
                while parts and parts[0] == "super":
                    parts = [*folder[: -1 if len(folder) > 1 else None], *parts[1:]]
                pairs.append((local, parts))
            if pairs:
                module = pairs[0][1][:-1] if pairs[0][0] else pairs[0][1]
                found.imported(".".join(module or pairs[0][1]), x.line, *((a, ".".join(p)) for a, p in pairs if a))
        elif language == "rust" and x.text == "mod" and i + 2 < len(t) and t[i + 2].text == ";":
            found.imported(".".join([*folder, t[i + 1].text]), x.line)
        elif language == "php" and x.text == "use" and not depth and before in ("", ";", "}", "php", ">"):
            stop = _until(t, i, (";",))
            k = i + 1 + (t[i + 1].text in ("function", "const"))
            name, k = _dotted(t, k + (t[k].text == "\\"), stop, ("\\",))
            if k < stop and t[k].text == "{" or k - 1 < stop and t[k - 1].text == "\\":
                head, members = name, [t[m].text for m in range(k, stop) if t[m].kind == "name"]
                for m in members:
                    found.imported(f"{head}.{m}", x.line, (m, f"{head}.{m}"))
            else:
                local = t[k + 1].text if k < stop and t[k].text == "as" else name.rsplit(".", 1)[-1]
                found.imported(name, x.line, (local, name))
        elif language in ("swift", "kotlin") and x.text == "import" and not depth:
            stop = _until(t, i + 1, (";",), lines=True)
            at = i + 1 + (t[i + 1].text in ("class", "struct", "func", "enum", "protocol"))
            name, k = _dotted(t, at, stop, (".",))
            local = t[k + 1].text if k < stop and t[k].text == "as" else name.rsplit(".", 1)[-1]
            parts = name.split(".")
            head = next((j + 1 for j, p in enumerate(parts) if p[:1].isupper()), len(parts))
            found.imported(".".join(parts[:head]) if language == "kotlin" else name, x.line, (local, name))
