"""What an expression is known to be at a place in the source: string constants through names, fields and concatenation."""

from __future__ import annotations

from typing import NamedTuple

from .parser import Node

DEEPEST = 8
BRANCHES = ("if", "switch", "while", "for", "foreach", "do")


class Value(NamedTuple):
    status: str
    value: str | None = None


UNKNOWN, AMBIGUOUS, PARTLY = Value("UNKNOWN"), Value("AMBIGUOUS"), Value("PARTIALLY_RESOLVED")


def up(node: Node):
    while node is not None:
        yield node
        node = node.parent


def fields(owner: Node, name: str) -> tuple[Node, Node] | None:
    """The field of a type and its declarator of that name."""
    for f in owner.children:
        if f.kind == "field":
            for v in f.children:
                if v.name == name:
                    return f, v
    return None


def resolved(expr: Node | None, site: Node, depth: int = 0, seen: frozenset = frozenset()) -> Value:
    """Literals, brackets, casts, ``+`` of strings, names and constant fields; ``site`` is where the value is used."""
    if expr is None or depth > DEEPEST:
        return UNKNOWN
    if expr.kind == "string":
        return Value("RESOLVED", expr.value)
    if expr.kind in ("paren", "cast"):
        return resolved(expr.value, site, depth + 1, seen)
    if expr.kind == "binary" and expr.op == "+":
        a, b = resolved(expr.left, site, depth + 1, seen), resolved(expr.right, site, depth + 1, seen)
        if a.value is not None and b.value is not None:
            return Value("RESOLVED", a.value + b.value)
        if AMBIGUOUS in (a, b):
            return AMBIGUOUS
        return PARTLY if a.value is not None or b.value is not None else UNKNOWN
    if expr.kind == "name":
        return AMBIGUOUS if expr.name in seen else variable(expr.name, site, depth + 1, seen | {expr.name})
    if expr.kind == "access":
        return AMBIGUOUS if expr.name in seen else member(expr, site, depth + 1, seen | {expr.name})
    return UNKNOWN


def member(expr: Node, site: Node, depth: int, seen: frozenset) -> Value:
    if expr.source == "this":
        owner = next((n for n in up(site) if n.kind == "type"), None)
        return field(owner, expr.name, depth, seen) if owner else UNKNOWN
    *_, unit = up(site)
    owners = [n for n in unit.walk() if n.kind == "type" and expr.source in (n.name, n.fqcn.replace("$", "."))]
    if len(owners) != 1 or bound(expr.source, site):
        return UNKNOWN
    found = fields(owners[0], expr.name)
    if not found or not ("static" in found[0].modifiers or owners[0].type_kind == "INTERFACE"):
        return UNKNOWN
    return field(owners[0], expr.name, depth, seen)


def field(owner: Node, name: str, depth: int, seen: frozenset) -> Value:
    found = fields(owner, name)
    if not found or not ("final" in found[0].modifiers or owner.type_kind == "INTERFACE"):
        return UNKNOWN
    return resolved(found[1].init, found[1], depth, seen)


def variable(name: str, site: Node, depth: int, seen: frozenset) -> Value:
    """The innermost binding of ``name`` around ``site``; parameters and loop, catch and resource bindings are unknown."""
    for here in up(site):
        if here.kind == "block":
            own = [v for s in here.children if s.kind == "expression" for d in s.children if d.kind == "local" for v in d.children if v.name == name]
            before = [v for v in own if v.at < site.at]
            if before:
                return assigned(before[-1], here, name, site, depth, seen)
            if own:
                return UNKNOWN
        elif here.kind in ("method", "constructor", "type", "catch"):
            names = here.components if here.kind == "type" else [c for c in here.children if c.kind == "param"]
            if any(p.name == name for p in names):
                return UNKNOWN
        elif here.kind in ("for", "foreach", "try") and any(n.kind == "variable" and n.name == name for n in here.walk()):
            return UNKNOWN
        if here.kind == "type" and fields(here, name):
            return field(here, name, depth, seen)
    return UNKNOWN


def assigned(declared: Node, block: Node, name: str, site: Node, depth: int, seen: frozenset) -> Value:
    """The value of a local variable at ``site``: its initialiser, or the only plain assignment since, if that is in the same block."""
    later = [a for a in block.walk() if a.kind == "assign" and a.target.kind == "name" and a.target.name == name and declared.at < a.at < site.at]
    if any(a.op != "=" for a in later):
        return UNKNOWN
    if len(later) > 1 or any(branched(a) for a in later):
        return AMBIGUOUS
    if later:
        if next((n for n in up(later[0]) if n.kind == "block"), None) is not block:
            return UNKNOWN
        return resolved(later[0].value, later[0], depth, seen)
    return resolved(declared.init, declared, depth, seen)


def branched(node: Node) -> bool:
    for n in up(node.parent):
        if n.kind in BRANCHES:
            return True
        if n.kind == "method":
            return False
    return False


def bound(name: str, site: Node) -> bool:
    """Whether a value named ``name`` is in scope at ``site``."""
    for here in up(site):
        if here.kind in ("method", "constructor") and any(p.name == name for p in here.params):
            return True
        if here.kind == "block" and any(n.kind == "variable" and n.name == name and n.at < site.at for n in here.walk()):
            return True
        if here.kind == "type" and (fields(here, name) or any(p.name == name for p in here.components)):
            return True
    return False
