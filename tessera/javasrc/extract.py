"""Rows of one source file: types, methods, fields, imports, unresolved calls and cryptography calls, from a single walk."""

from __future__ import annotations

from tessera.operators.crypto import OWNERS

from .constants import resolved
from .parser import Node, line_starts, parse, spot

SIMPLE = {fqcn.rsplit(".", 1)[1]: owner for owner, fqcn in OWNERS.items()}
BY_NAME = {fqcn: owner for owner, fqcn in OWNERS.items()}
NEUTRAL = {"java.lang", "java.util", "java.io", "java.nio", "java.net"}


class Scopes:
    """Frames of local names; the outermost can't be popped, an inner declaration hides an outer one."""

    def __init__(self):
        self.frames: list[dict[str, str]] = [{}]

    def push(self) -> None:
        self.frames.append({})

    def pop(self) -> None:
        if len(self.frames) > 1:
            self.frames.pop()

    def declare(self, name: str, kind: str) -> None:
        self.frames[-1][name] = kind

    def lookup(self, name: str) -> str | None:
        return next((f[name] for f in reversed(self.frames) if name in f), None)

    def depth(self) -> int:
        return len(self.frames)

    def reset(self) -> None:
        self.frames = [{}]


class Extractor:
    def __init__(self, path: str, source: str, visible: bool = False):
        """``visible``: list the names in scope at the ends of blocks as well."""
        self.seen = visible
        self.unit, self.errors, self.source = parse(source)
        self.path, self.package, self.starts = path, self.unit.package, line_starts(source)
        self.types, self.calls, self.crypto, self.visible = [], [], [], []
        self.explicit = [n for n, static, star in self.unit.imports if not star]
        self.wildcards = [n for n, static, star in self.unit.imports if star]
        for n in self.unit.children:
            self.declare(n, "")
        self.local_names = {n.name for n in self.unit.walk() if n.kind == "type"}
        self.scopes, self.owner, self.method, self.fields = Scopes(), "", "", {}
        for n in self.unit.children:
            self.visit(n)

    # declarations
    def declare(self, n: Node, outer: str) -> None:
        if n.kind != "type":
            return
        n.fqcn = f"{outer}${n.name}" if outer else f"{self.package}.{n.name}" if self.package else n.name
        methods, fields = [], []
        for kind in ("method", "constructor"):
            for m in n.children:
                if m.kind == kind:
                    types = [p.type for p in m.params]
                    methods.append({"name": m.name, "signature": f"{m.name}({','.join(types)})", "return_type": m.type, "param_types": types, "param_names": [p.name for p in m.params], "modifiers": m.modifiers, "is_constructor": kind == "constructor", "range": self.place(m)})
        for f in n.children:
            if f.kind == "field":
                fields += [{"name": v.name, "type": f.type.removesuffix("[]"), "modifiers": f.modifiers, "range": self.place(f)} for v in f.children if v.kind == "variable"]
        fields += [{"name": p.name, "type": p.type, "modifiers": ["private", "final"], "range": self.place(p)} for p in n.components]
        self.types.append({
            "fqcn": n.fqcn, "simple_name": n.name, "package": self.package, "kind": "ANNOTATION" if n.type_kind == "ANNOTATION" else n.type_kind, "path": self.path, "superclass": n.superclass,
            "interfaces": sorted(set(n.interfaces)), "annotations": sorted(set(n.annotations)), "range": self.place(n), "methods": methods, "fields": fields, "nesting": n.fqcn.count("$"),
        })
        for c in n.children:
            self.declare(c, n.fqcn)

    # calls
    def visit(self, n: Node) -> None:
        HANDLERS.get(n.kind, Extractor.inside)(self, n)

    def inside(self, n: Node) -> None:
        for c in n.children:
            self.visit(c)

    def framed(self, n: Node) -> None:
        self.scopes.push()
        self.inside(n)
        if self.seen and self.method and n.kind != "type":
            of_method = n.kind == "block" and n.parent.kind in ("method", "constructor")
            names = {k: v for f in self.scopes.frames for k, v in f.items()}
            self.visible.append({"type": self.owner, "method": self.method, "line": spot(self.starts, n.at)[0], "method_end": of_method, "names": [{"name": k, "type": v} for k, v in sorted(names.items())]})
        self.scopes.pop()

    visit_block = visit_try = visit_for = visit_foreach = visit_catch = framed

    def visit_type(self, n: Node) -> None:
        kept = self.owner, self.method, self.fields
        if not hasattr(n, "fqcn"):  # a type inside a method
            n.fqcn = f"{self.owner}${n.name}"
        self.owner, self.method = n.fqcn, ""
        self.fields = {v.name: v.type for f in n.children if f.kind == "field" for v in f.children if v.kind == "variable"}
        self.framed(n)
        self.owner, self.method, self.fields = kept

    def visit_method(self, n: Node) -> None:
        kept, self.method = self.method, n.name if n.kind == "method" else "<init>"
        self.framed(n)
        self.method = kept

    visit_constructor = visit_method

    def visit_param(self, n: Node) -> None:
        self.scopes.declare(n.name, n.type)

    def visit_variable(self, n: Node) -> None:
        if n.parent.kind != "field":
            self.scopes.declare(n.name, n.type)
        self.inside(n)

    def visit_new(self, n: Node) -> None:
        self.call(n, n.type.rsplit(".", 1)[-1], "<init>", "CONSTRUCTOR_CALL", "type")
        if n.type.rsplit(".", 1)[-1] == "SecureRandom" and (confidence := self.random_owner(n.type)):
            self.crypto_call(n, "SECURE_RANDOM", "<init>", confidence, "DEFAULT", "RESOLVED", None, "")
        self.inside(n)

    def visit_call(self, n: Node) -> None:
        target, kind, how = self.owner, "METHOD_CALL", "this"
        s = n.scope
        if s is not None and s.kind == "super":
            kind, how = "SUPER_CALL", "super"
        elif s is not None and s.kind == "name":
            local = self.scopes.lookup(s.name) or self.fields.get(s.name)
            target, how = local or s.name, "type"
            if local is None:
                kind = "STATIC_METHOD_CALL"
        elif s is not None and s.kind != "this":
            target, how = n.source, "unsupported" if s.kind in ("call", "new") else "type"
        self.call(n, target, n.name, kind, how)
        if n.name == "getInstance" and n.args and (found := self.crypto_owner(s, n)):
            value = resolved(n.args[0], n)
            self.crypto_call(n, *found[:1], "getInstance", found[1], self.text(n.args[0]), value.status, value.value, n.source)
        self.inside(n)

    def call(self, n: Node, target: str, name: str, kind: str, how: str) -> None:
        self.calls.append({"caller": self.owner, "caller_method": self.method, "target": target, "method": name, "kind": kind, "how": how, "arguments": len(n.args), "range": self.place(n), "ord": len(self.calls)})

    def text(self, n: Node) -> str:
        return " ".join(self.source[n.at : n.end].split())

    def place(self, n: Node) -> dict:
        """Lines and columns from 1, the last inclusive."""
        (a, b), (c, d) = spot(self.starts, n.at), spot(self.starts, n.end - 1)
        return {"line": a, "col": b, "end_line": max(a, c), "end_col": d}

    # cryptography
    def crypto_owner(self, scope: Node | None, n: Node) -> tuple[str, str] | None:
        """The owner of ``getInstance`` and how sure that is; None if imports or types of the file speak against it."""
        if scope is None:
            for name, static, star in self.unit.imports:
                if static:
                    for fqcn, owner in BY_NAME.items():
                        if name == f"{fqcn}.getInstance" or (star and name == fqcn):
                            return owner, "HIGH"
            return None
        if scope.kind == "access":
            owner = BY_NAME.get(n.source.replace(" ", ""))
            return (owner, "HIGH") if owner else None
        if scope.kind != "name" or scope.name not in SIMPLE or scope.name in self.local_names:
            return None
        owner = SIMPLE[scope.name]
        fqcn = OWNERS[owner]
        package = fqcn.rsplit(".", 1)[0]
        for name, static, star in self.unit.imports:
            if not static and not star and name.endswith("." + scope.name):
                return (owner, "HIGH") if name == fqcn else None
        stars = {name for name, static, star in self.unit.imports if star and not static}
        if package in stars:
            return owner, "LOW" if stars - NEUTRAL - {package} else "HIGH"
        return (owner, "HIGH") if self.package == package else None

    def random_owner(self, name: str) -> str | None:
        fqcn = OWNERS["SECURE_RANDOM"]
        if name == fqcn:
            return "HIGH"
        if "." in name or "SecureRandom" in self.local_names:
            return None
        named = any(not static and (n == fqcn if not star else n == "java.security") for n, static, star in self.unit.imports)
        return "HIGH" if named or self.package == "java.security" else None

    def crypto_call(self, n: Node, owner: str, method: str, confidence: str, argument: str, status: str, value: str | None, receiver: str) -> None:
        self.crypto.append({"owner": owner, "method": method, "class": self.owner, "in_method": "" if self.method == "<init>" else self.method, "receiver": receiver, "argument": argument, "status": status, "raw": value, "confidence": confidence, "source": self.text(n), "range": self.place(n)})

    def row(self) -> dict:
        return {
            "path": self.path, "package": self.package, "types": self.types, "calls": self.calls, "crypto": self.crypto, "errors": self.errors,
            "imports": [{"name": n, "is_static": s, "wildcard": w, "ord": i} for i, (n, s, w) in enumerate(self.unit.imports)],
        }


HANDLERS = {k.removeprefix("visit_"): f for k, f in vars(Extractor).items() if k.startswith("visit_")}


def scopes(path: str, source: str | None) -> list[dict]:
    """The local names, with their types, at the end of each block, loop, catch clause, try statement and method of a file; the end of a method is marked. Inner declarations hide outer ones."""
    try:
        return [{"path": path, **x} for x in Extractor(path, source or "", visible=True).visible]
    except (RecursionError, ValueError, IndexError, AttributeError, TypeError):
        return []


def extracted(path: str, source: str | None) -> dict:
    """The row of one file; whatever goes wrong is an error in it, never an exception."""
    try:
        return Extractor(path, source or "").row()
    except (RecursionError, ValueError, IndexError, AttributeError, TypeError) as e:
        return {"path": path, "package": "", "types": [], "calls": [], "crypto": [], "errors": [f"{type(e).__name__}: {e}"], "imports": []}
