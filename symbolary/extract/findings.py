"""What a reader of a file finds, in the order of the file: symbols, containment, docs, calls, imports and types."""

from __future__ import annotations

from collections.abc import Callable


class Findings:
    """Collects what is found and hands it on at the end, when bases that are told apart from their class are known.

    The first definition of an id is its node; later ones (overloads, reopened classes) only add what is inside them.
    """

    def __init__(self, prefix: str, put: Callable[..., None]) -> None:
        self.prefix, self.put = prefix, put
        self.nodes: dict[str, dict] = {}
        self.rest: list[tuple[str, dict]] = []

    def symbol(self, name: str, kind: str, scope: tuple[str, ...], line: int, holder: str, owner: str | None = None, doc: str = "", bases: tuple[str, ...] = ()) -> str:
        mine = "_".join([self.prefix, *(s.lower() for s in scope), name.lower()])
        if mine in self.nodes:
            self.base(mine, *bases)
            return mine
        self.nodes[mine] = {"id": mine, "label": name, "kind": kind, "line": line, "bases": list(bases) if kind == "class" else None}
        self.rest.append(("edge", {"source": holder, "target": mine, "relation": "contains", "line": line}))
        if owner and kind != "class":
            self.rest.append(("owner", {"id": mine, "owner": owner}))
        self.doc(mine, doc, line)
        return mine

    def doc(self, owner: str, text: str, line: int) -> None:
        if text and f"{owner}#doc" not in self.nodes:
            self.nodes[f"{owner}#doc"] = {"id": f"{owner}#doc", "label": f"docstring of {owner}", "kind": "rationale", "line": line, "text": text}
            self.rest.append(("edge", {"source": owner, "target": f"{owner}#doc", "relation": "rationale_for", "line": line}))

    def base(self, mine: str, *names: str) -> None:
        held = self.nodes.get(mine, {}).get("bases")
        if held is not None:
            held += [n for n in names if n not in held]

    def call(self, holder: str, name: str, line: int, receiver: str | None = None, on_self: bool = False, own: bool = False) -> None:
        self.rest.append(("call", {"id": holder, "name": name, "line": line, "receiver": receiver, "receiver_is_self": own, "on_self": on_self}))

    def imported(self, dotted: str, line: int, *names: tuple[str, str]) -> None:
        """A statement's module, and (local name, dotted name) of what it binds."""
        if dotted:
            self.rest.append(("site", {"dotted": dotted, "line": line}))
        self.rest += [("import", {"name": a, "dotted": b}) for a, b in names]

    def variable(self, scope: tuple[str, ...], name: str, cls: str) -> None:
        self.rest.append(("var", {"scope": ".".join(scope), "name": name, "cls": cls}))

    def attribute(self, owner: str, name: str, cls: str) -> None:
        self.rest.append(("attr", {"owner": owner, "name": name, "cls": cls}))

    def flush(self) -> None:
        for fields in self.nodes.values():
            self.put("node", **fields)
        for row, fields in self.rest:
            self.put(row, **fields)
