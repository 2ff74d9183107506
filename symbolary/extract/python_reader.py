"""Python, by the interpreter's own parser, with a stack of its own instead of recursion."""

from __future__ import annotations

import ast
from collections.abc import Callable

EXTENSIONS = (".py",)


def available() -> str | None:
    """None if this reader can run here, else why not."""
    return None


def _class_of(value: ast.expr | None) -> str | None:
    """The class that an expression constructs, by the custom of capitals."""
    if not isinstance(value, ast.Call):
        return None
    name = value.func.id if isinstance(value.func, ast.Name) else value.func.attr if isinstance(value.func, ast.Attribute) else ""
    return name if name[:1].isupper() else None


def _annotated(note: ast.expr | None) -> str | None:
    name = note.id if isinstance(note, ast.Name) else note.attr if isinstance(note, ast.Attribute) else note.value.partition("[")[0].strip() if isinstance(note, ast.Constant) and isinstance(note.value, str) else ""
    return name if name[:1].isupper() else None


def _dotted(node: ast.expr) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        return "?"


def read(path: str, prefix: str, package: list[str], source: str, put: Callable[..., None]) -> None:
    """Calls put(kind of row, **fields) for each finding; raises SyntaxError or ValueError for what is no Python.

    package: the folders of the file, which relative imports start from.
    """
    tree = ast.parse(source)
    classes = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}

    def describe(owner: str, node: ast.AST, line: int) -> None:
        if doc := ast.get_docstring(node):
            put("node", id=f"{owner}#doc", label=f"docstring of {owner}", kind="rationale", line=line, text=doc.strip())
            put("edge", source=owner, target=f"{owner}#doc", relation="rationale_for", line=line)

    describe(prefix, tree, 1)
    # (node, scopes, whether the parent is a class, the symbol that holds it)
    todo: list[tuple[ast.AST, tuple[str, ...], bool, str]] = [(n, (), False, prefix) for n in reversed(list(ast.iter_child_nodes(tree)))]
    while todo:
        node, scope, in_class, holder = todo.pop()
        owner = next((s for s in reversed(scope) if s in classes), None)
        inner = (scope, in_class, holder)
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            a_class = isinstance(node, ast.ClassDef)
            accessor = not a_class and any(isinstance(x, ast.Attribute) and x.attr in ("setter", "deleter") for x in node.decorator_list)
            mine = "_".join([prefix, *(s.lower() for s in scope), node.name.lower()])
            if not accessor:
                bases = [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))] if a_class else None
                put("node", id=mine, label=node.name, kind="class" if a_class else "method" if in_class else "function", line=node.lineno, bases=bases)
                put("edge", source=holder, target=mine, relation="contains", line=node.lineno)
                if owner and not a_class:
                    put("owner", id=mine, owner=owner)
                describe(mine, node, node.lineno)
            inner = ((*scope, node.name), a_class, holder if accessor else mine)
            if not a_class:
                for arg in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                    if cls := _annotated(arg.annotation):
                        put("var", scope=".".join(inner[0]), name=arg.arg, cls=cls)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                put("import", name=alias.asname or alias.name.partition(".")[0], dotted=alias.name)
                put("site", dotted=alias.name, line=node.lineno)
        elif isinstance(node, ast.ImportFrom):
            above = package[: len(package) - node.level + 1] if node.level else []
            module = ".".join([*above, *([node.module] if node.module else [])])
            for alias in node.names:
                put("import", name=alias.asname or alias.name, dotted=".".join(filter(None, (module, alias.name))))
            if module:
                put("site", dotted=module, line=node.lineno)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            cls = (_annotated(node.annotation) if isinstance(node, ast.AnnAssign) else None) or _class_of(node.value)
            for target in (node.targets if isinstance(node, ast.Assign) else [node.target]) if cls else ():
                if isinstance(target, ast.Name):
                    put("var", scope=".".join(scope), name=target.id, cls=cls)
                elif owner and _dotted(target).startswith("self.") and isinstance(target, ast.Attribute) and _dotted(target.value) == "self":
                    put("attr", owner=owner, name=target.attr, cls=cls)
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                put("call", id=holder, name=f.id, line=node.lineno, receiver=None, receiver_is_self=False, on_self=False)
            elif isinstance(f, ast.Attribute):
                v = f.value
                on_self = isinstance(v, ast.Name) and v.id == "self"
                own = isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) and v.value.id == "self"
                # a longer chain is kept as text that is no variable's name, so that it can't pass for a bare call
                put("call", id=holder, name=f.attr, line=node.lineno, receiver=v.id if isinstance(v, ast.Name) else v.attr if own else f"({_dotted(v)})", receiver_is_self=own, on_self=on_self)
        todo.extend((n, *inner) for n in reversed(list(ast.iter_child_nodes(node))))
