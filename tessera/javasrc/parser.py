"""A tolerant parser of Java source: declarations, scopes, and the expressions that analyses look at. Pure Python, no Spark.

What can't be parsed becomes an error string and is skipped up to the next balanced end; the rest of the unit is kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

TOKEN = re.compile(
    r"""\s*+(?:(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<text>\"\"\"(?:[^\\]|\\.)*?\"\"\")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<char>'(?:[^'\\\n]|\\.)+')
    |(?P<num>0[xXbB][0-9A-Fa-f_.pP+-]*[lLfFdD]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)
    |(?P<id>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||[-+*/%&|^!=<]=|<<=?|[-+*/%&|^!~?:;,.(){}\[\]@=<>])
    |(?P<bad>.))""",
    re.X | re.S,
)
#: Tokens that a rule looks ahead at most, but for lambdas, which look no further than the end.
AHEAD = 8
MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
#: What modifiers begin with.
MODIFYING = MODIFIERS | {"@", "non"}
PRIMITIVES = set("boolean byte short int long char float double void".split())
RESERVED = set("if else while for do switch case return break continue throw try catch finally new this super instanceof assert class interface enum package import extends implements throws".split())
BINARY = {x: i for i, level in enumerate(["||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<< >> >>>", "+ -", "* / %"]) for x in level.split()}
ASSIGN = set("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
ESCAPE = re.compile(r"\\(?:u+([0-9a-fA-F]{4})|([0-7]{1,3})|(\r?\n)|(.))", re.S)
SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " ", "0": "\0"}


class Token(NamedTuple):
    """Its kind and text, and where it begins and ends in the source."""

    kind: str
    text: str
    at: int
    end: int


def line_starts(source: str) -> list[int]:
    """Where each line begins."""
    out, k = [0], source.find("\n")
    while k >= 0:
        out.append(k + 1)
        k = source.find("\n", k + 1)
    return out


def spot(starts: list[int], at: int) -> tuple[int, int]:
    """Line and column, from 1, of the character at ``at``."""
    k = bisect_right(starts, at)
    return k, at - starts[k - 1] + 1


class ParseError(Exception):
    pass


class Node:
    """A node with a kind, where it begins and ends, parent and children; other attributes by kind."""

    def __init__(self, kind: str, start: Token, **attributes):
        self.kind, self.at, self.end, self.parent, self.children = kind, start.at, start.end, None, []
        self.__dict__.update(attributes)

    def add(self, child: Node | None) -> Node | None:
        if child is not None:
            child.parent = self
            self.children.append(child)
        return child

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


def tokens(source: str) -> list[Token]:
    out, made = [], tuple.__new__
    add = out.append
    for m in TOKEN.finditer(source, 0, len(source.rstrip())):
        k = m.lastindex
        if k > 1:  # the first group is what is skipped
            add(made(Token, (m.lastgroup, m[k], *m.span(k))))
    out.append(Token("eof", "", len(source), len(source) + 1))
    return out


def unquoted(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 8))
        return "" if m[3] else SIMPLE.get(m[4], m[4])

    if text.startswith('"""'):
        lines = text[3:-3].split("\n", 1)[-1].split("\n")
        margin = min((len(x) - len(x.lstrip()) for i, x in enumerate(lines) if x.strip() or i == len(lines) - 1), default=0)
        text = "\n".join(x[margin:].rstrip() for x in lines)
    else:
        text = text[1:-1]
    return ESCAPE.sub(one, text)


class Parser:
    def __init__(self, source: str):
        self.source, self.t, self.i, self.errors, self.depth = source, tokens(source), 0, [], 0
        self.starts = line_starts(source)
        #: Texts and whether each is a name, with room after the end for all that looks ahead.
        self.texts = [t.text for t in self.t] + [""] * AHEAD
        self.names = [t.kind == "id" and t.text not in RESERVED for t in self.t] + [False] * AHEAD

    # tokens
    def peek(self, k: int = 0) -> str:
        return self.texts[self.i + k]

    def is_name(self, k: int = 0) -> bool:
        return self.names[self.i + k]

    def next(self) -> Token:
        t = self.t[self.i]
        if t.kind != "eof":
            self.i += 1
        return t

    def take(self, text: str) -> bool:
        if self.texts[self.i] == text and self.t[self.i].kind in ("op", "id"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if self.peek() != text:
            t = self.t[self.i]
            raise ParseError(f"{self.spot(t)}: expected {text!r}, found {t.text!r}")
        return self.next()

    def name(self) -> str:
        if not self.is_name():
            t = self.t[self.i]
            raise ParseError(f"{self.spot(t)}: expected a name, found {t.text!r}")
        return self.next().text

    def spot(self, t: Token) -> str:
        line, col = spot(self.starts, t.at)
        return f"{line}:{col}"

    def close(self, node: Node) -> Node:
        node.end = self.t[self.i - 1 if self.i else 0].end
        return node

    def text(self, begin: int, end: int) -> str:
        return re.sub(r"\s+", " ", self.source[begin:end]).strip()

    def upto(self) -> int:
        last = self.t[max(0, self.i - 1)]
        return last.at + len(last.text)

    def skip(self) -> None:
        """Past the next ``;`` or balanced block, or up to the brace that ends the one around."""
        depth = 0
        while self.t[self.i].kind != "eof":
            x = self.peek()
            if x in "({[" and x:
                depth += 1
            elif x in ")}]" and x:
                if depth == 0:
                    if x == "}":
                        return
                else:
                    depth -= 1
                    if depth == 0 and x == "}":
                        self.i += 1
                        return
            elif x == ";" and depth == 0:
                self.i += 1
                return
            self.i += 1

    def attempt(self, rule):
        i = self.i
        try:
            return rule()
        except ParseError:
            self.i = i
            return None

    # unit and types
    def unit(self) -> Node:
        out = Node("unit", self.t[0], package="", imports=[])
        while self.t[self.i].kind != "eof":
            begin = self.i
            try:
                mods = self.modifiers()
                if self.take("package"):
                    out.package = self.qualified()
                    self.need(";")
                elif self.take("import"):
                    static = self.take("static")
                    name, star = self.qualified(), False
                    if self.take("."):
                        self.need("*")
                        star = True
                    self.need(";")
                    out.imports.append((name, static, star))
                elif not self.take(";"):
                    out.add(self.type(mods))
            except (ParseError, RecursionError) as e:
                self.errors.append(str(e))
                self.depth = 0
                self.skip()
                if self.i == begin:
                    self.i += 1
        return out

    def qualified(self) -> str:
        out = [self.name()]
        while self.peek() == "." and self.is_name(1):
            self.i += 1
            out.append(self.name())
        return ".".join(out)

    def modifiers(self) -> dict:
        found, notes, begin = [], [], self.t[self.i]
        while True:
            if self.texts[self.i] not in MODIFYING:
                return {"modifiers": found, "annotations": notes, "begin": begin}
            if self.peek() == "@" and self.peek(1) != "interface":
                self.i += 1
                notes.append("@" + self.qualified())
                if self.peek() == "(":
                    self.balanced()
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")) and not (self.peek() == "sealed" and not (self.is_name(1) or self.peek(1) in MODIFIERS | {"class", "interface"})):
                found.append(self.next().text)
            elif self.peek() == "non" and self.peek(1) == "-" and self.peek(2) == "sealed":
                self.i += 3
                found.append("non-sealed")
            else:
                return {"modifiers": found, "annotations": notes, "begin": begin}

    def balanced(self) -> None:
        pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
        while self.t[self.i].kind != "eof":
            x = self.next().text
            depth += (x in pairs) - (x in pairs.values())
            if depth == 0:
                return

    def starts_type(self) -> bool:
        x = self.peek()
        return x in ("class", "interface", "enum") or (x == "@" and self.peek(1) == "interface") or (x == "record" and self.is_name(1) and self.peek(2) in ("(", "<"))

    def type(self, mods: dict) -> Node:
        if not self.starts_type():
            t = self.t[self.i]
            raise ParseError(f"{self.spot(t)}: expected a type, found {t.text!r}")
        word = self.next().text
        if word == "@":
            word = "annotation"
            self.next()
        node = Node("type", mods["begin"], type_kind=word.upper(), modifiers=mods["modifiers"], annotations=mods["annotations"], superclass=None, interfaces=[], components=[])
        node.name = self.name()
        if self.peek() == "<":
            self.type_arguments()
        if word == "record":
            node.components = self.parameters(node)
        while self.peek() in ("extends", "implements", "permits"):
            what = self.next().text
            names = [self.type_name()]
            while self.take(","):
                names.append(self.type_name())
            if what == "extends" and word == "class":
                node.superclass = re.sub(r"<.*", "", names[0])
            elif what != "permits":
                node.interfaces += [re.sub(r"<.*", "", n).split(".")[-1] for n in names]
        self.need("{")
        if word == "enum":
            self.constants(node)
        self.members(node)
        return self.close(node)

    def constants(self, node: Node) -> None:
        while self.peek() not in (";", "}") and self.t[self.i].kind != "eof":
            self.modifiers()
            self.name()
            if self.peek() == "(":
                self.arguments(node)
            if self.peek() == "{":
                body = Node("body", self.next())
                node.add(body)
                self.members(body)
            if not self.take(","):
                break
        self.take(";")

    def members(self, node: Node) -> None:
        while not self.take("}"):
            if self.t[self.i].kind == "eof":
                raise ParseError("unexpected end of file")
            begin = self.i
            try:
                self.member(node)
            except ParseError as e:
                self.errors.append(str(e))
                self.i = max(self.i, begin)
                self.skip()
                if self.i == begin:
                    self.i += 1

    def member(self, node: Node) -> None:
        if self.take(";"):
            return
        mods = self.modifiers()
        if self.starts_type():
            node.add(self.type(mods))
        elif self.peek() == "{":
            node.add(self.block())
        else:
            if self.peek() == "<":
                self.type_arguments()
            if self.is_name() and self.peek(1) in ("(", "{"):  # constructor, or a record's compact one
                m = Node("constructor", mods["begin"], name=self.name(), type="void", modifiers=mods["modifiers"], params=[])
                if self.peek() == "(":
                    m.params = self.parameters(m)
                self.rest_of_method(m)
                node.add(m)
                return
            kind = self.type_name()
            name_at = self.t[self.i]
            name = self.name()
            if self.peek() == "(":
                m = Node("method", mods["begin"], name=name, type=kind, modifiers=mods["modifiers"], params=[])
                m.params = self.parameters(m)
                while self.take("["):
                    self.need("]")
                self.rest_of_method(m)
                node.add(m)
                return
            f = Node("field", mods["begin"], modifiers=mods["modifiers"], type=kind)
            self.declarators(f, kind, name, name_at)
            self.need(";")
            node.add(self.close(f))

    def rest_of_method(self, m: Node) -> None:
        if self.take("throws"):
            self.type_name()
            while self.take(","):
                self.type_name()
        if self.take("default"):
            m.add(self.expression())
        if self.peek() == "{":
            m.add(self.block())
        else:
            self.need(";")
        self.close(m)

    def parameters(self, owner: Node) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            mods = self.modifiers()
            kind = self.type_name()
            if self.take("..."):
                kind += "..."
            name = self.next().text if self.peek() == "this" else self.name()
            while self.take("["):
                self.need("]")
            out.append(owner.add(self.close(Node("param", mods["begin"], name=name, type=kind))))
            if not self.take(","):
                self.need(")")
                break
        return out

    def declarators(self, owner: Node, kind: str, name: str, at: Token) -> None:
        while True:
            v = Node("variable", at, name=name, type=kind, init=None)
            while self.take("["):
                self.need("]")
                v.type += "[]"
            if self.take("="):
                v.init = v.add(self.initializer())
            owner.add(self.close(v))
            if not self.take(","):
                return
            at = self.t[self.i]
            name = self.name()

    def initializer(self) -> Node:
        if self.peek() != "{":
            return self.expression()
        n = Node("other", self.next())
        while not self.take("}"):
            n.add(self.initializer())
            if not self.take(","):
                self.need("}")
                break
        return self.close(n)

    def type_name(self) -> str:
        self.modifiers()
        if self.peek() == "?":
            self.next()
            if self.peek() in ("extends", "super"):
                return f"? {self.next().text} {self.type_name()}"
            return "?"
        out = self.next().text if self.peek() in PRIMITIVES else self.name()
        if self.peek() == "<":
            out += self.type_arguments()
        while self.peek() == "." and (self.is_name(1) or self.peek(1) == "@"):
            self.i += 1
            self.modifiers()
            out += "." + self.name()
            if self.peek() == "<":
                out += self.type_arguments()
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
            out += "[]"
        while self.peek() == "&":
            self.i += 1
            out += " & " + self.type_name()
        return out

    def type_arguments(self) -> str:
        self.need("<")
        parts = []
        while self.peek() != ">":
            part = self.type_name()
            if self.take("extends"):
                part += " extends " + self.type_name()
            parts.append(part)
            if not self.take(","):
                break
        self.need(">")
        return "<" + ", ".join(parts) + ">"

    # statements
    def block(self) -> Node:
        node = Node("block", self.need("{"))
        while not self.take("}"):
            if self.t[self.i].kind == "eof":
                raise ParseError("unexpected end of file")
            begin, depth = self.i, self.depth
            try:
                node.add(self.statement())
            except ParseError as e:
                self.errors.append(str(e))
                self.depth = depth
                self.skip()
                if self.i == begin:
                    self.i += 1
        return self.close(node)

    def local(self) -> Node | None:
        """A declaration of local variables, if the tokens ahead are one."""

        def rule() -> Node:
            mods = self.modifiers()
            kind = self.type_name()
            at = self.t[self.i]
            name = self.name()
            if self.peek() not in ("=", ";", ",", ":", "[", ")"):
                raise ParseError("no declaration")
            n = Node("local", mods["begin"], type=kind)
            self.declarators(n, kind, name, at)
            return self.close(n)

        return self.attempt(rule)

    def statement(self) -> Node:
        t, x = self.t[self.i], self.peek()
        if x == "{":
            return self.block()
        node = Node("other", t)
        if x == ";":
            self.next()
        elif x == "if":
            node.kind = "if"
            self.next()
            self.parenthesised(node)
            node.add(self.statement())
            if self.take("else"):
                node.add(self.statement())
        elif x == "while":
            node.kind = "while"
            self.next()
            self.parenthesised(node)
            node.add(self.statement())
        elif x == "do":
            node.kind = "do"
            self.next()
            node.add(self.statement())
            self.need("while")
            self.parenthesised(node)
            self.take(";")
        elif x == "for":
            self.for_loop(node)
        elif x == "try":
            self.try_statement(node)
        elif x == "switch":
            node.kind = "switch"
            self.switch(node)
            self.take(";")
        elif x in ("return", "throw", "assert") or (x == "yield" and self.peek(1) not in ("=", ".", "(", "++", "--")):
            self.next()
            if self.peek() != ";":
                node.add(self.expression())
                if self.take(":"):
                    node.add(self.expression())
            self.need(";")
        elif x in ("break", "continue"):
            self.next()
            if self.is_name():
                self.next()
            self.need(";")
        elif x == "synchronized" and self.peek(1) == "(":
            self.next()
            self.parenthesised(node)
            node.add(self.block())
        elif self.is_name() and self.peek(1) == ":" :
            self.i += 2
            node.add(self.statement())
        else:
            begin = self.i
            mods = self.modifiers()
            if self.starts_type():
                node.add(self.type(mods))
            else:
                self.i = begin
                node.kind = "expression"
                found = self.local()
                node.add(found if found is not None else self.expression())
                self.need(";")
        return self.close(node)

    def parenthesised(self, node: Node) -> None:
        self.need("(")
        node.add(self.expression())
        self.need(")")

    def for_loop(self, node: Node) -> None:
        self.next()
        self.need("(")
        found = None if self.peek() == ";" else self.local()
        if found is not None and self.take(":"):
            node.kind = "foreach"
            node.add(found)
            node.add(self.expression())
        else:
            node.kind = "for"
            node.add(found)
            if found is None and self.peek() != ";":
                node.add(self.expression())
                while self.take(","):
                    node.add(self.expression())
            self.need(";")
            if self.peek() != ";":
                node.add(self.expression())
            self.need(";")
            while self.peek() != ")":
                node.add(self.expression())
                if not self.take(","):
                    break
        self.need(")")
        node.add(self.statement())

    def try_statement(self, node: Node) -> None:
        node.kind = "try"
        self.next()
        if self.take("("):
            while not self.take(")"):
                found = self.local()
                node.add(found if found is not None else self.expression())
                if not self.take(";"):
                    self.need(")")
                    break
        node.add(self.block())
        while self.peek() == "catch":
            c = Node("catch", self.next())
            self.need("(")
            mods = self.modifiers()
            kinds = [self.type_name()]
            while self.take("|"):
                kinds.append(self.type_name())
            c.add(Node("param", mods["begin"], name=self.name(), type=" | ".join(kinds)))
            self.need(")")
            c.add(self.block())
            node.add(self.close(c))
        if self.take("finally"):
            node.add(self.block())

    def switch(self, node: Node) -> None:
        self.need("switch")
        self.parenthesised(node)
        self.need("{")
        while not self.take("}"):
            if self.t[self.i].kind == "eof":
                raise ParseError("unexpected end of file")
            if self.peek() in ("case", "default"):
                depth = 0
                while not (depth == 0 and self.peek() in (":", "->")) and self.t[self.i].kind != "eof":
                    x = self.next().text
                    depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
                self.next()
            else:
                node.add(self.statement())

    # expressions
    def expression(self) -> Node:
        self.depth += 1
        if self.depth > 120:
            self.depth = 0
            raise ParseError("expression nested too deep")
        try:
            return self.assignment()
        finally:
            self.depth = max(0, self.depth - 1)

    def operator(self) -> tuple[str, int]:
        """The operator ahead and its tokens; ``>`` signs that touch belong together."""
        x, n = self.peek(), 1
        if x == ">":
            while n < 3 and self.peek(n) == ">" and self.t[self.i + n].at == self.t[self.i + n - 1].at + 1:
                x, n = x + ">", n + 1
            if self.peek(n) in ("=", "==") and self.t[self.i + n].at == self.t[self.i + n - 1].at + 1 and self.peek(n) == "=":
                x, n = x + "=", n + 1
        return x, n

    def assignment(self) -> Node:
        t = self.t[self.i]
        if self.is_lambda():
            return self.lambda_()
        left = self.ternary()
        op, n = self.operator()
        if op in ASSIGN:
            self.i += n
            node = Node("assign", t, op=op, target=left)
            node.add(left)
            node.value = node.add(self.expression())
            return self.close(node)
        return left

    def is_lambda(self) -> bool:
        if self.is_name() and self.peek(1) == "->":
            return True
        if self.peek() != "(":
            return False
        k, depth = 0, 0
        while self.i + k < len(self.t) - 1:
            x = self.peek(k)
            depth += (x == "(") - (x == ")")
            k += 1
            if depth == 0:
                return self.peek(k) == "->"
            if x in (";", "{"):
                return False
        return False

    def lambda_(self) -> Node:
        node = Node("lambda", self.t[self.i])
        if self.peek() == "(":
            self.balanced()
        else:
            self.next()
        self.need("->")
        node.add(self.block() if self.peek() == "{" else self.expression())
        return self.close(node)

    def ternary(self) -> Node:
        t = self.t[self.i]
        test = self.binary(0)
        if not self.take("?"):
            return test
        node = Node("other", t)
        node.add(test)
        node.add(self.expression())
        self.need(":")
        node.add(self.expression())
        return self.close(node)

    def binary(self, least: int) -> Node:
        t = self.t[self.i]
        left = self.unary()
        while True:
            op, n = self.operator()
            level = BINARY.get(op, -1)
            if level < least:
                return left
            self.i += n
            node = Node("binary", t, op=op, left=left, right=None)
            node.add(left)
            if op == "instanceof":
                self.take("final")
                self.type_name()
                if self.peek() == "(":
                    self.balanced()
                elif self.is_name():
                    self.next()
            else:
                node.right = node.add(self.binary(level + 1))
            left = self.close(node)

    def unary(self) -> Node:
        t, x = self.t[self.i], self.peek()
        if t.kind == "op" and x in ("+", "-", "!", "~", "++", "--"):
            self.next()
            node = Node("other", t)
            self.depth += 1
            if self.depth > 120:
                raise ParseError("expression nested too deep")
            node.add(self.unary())
            self.depth -= 1
            return self.close(node)
        if x == "(":
            found = self.attempt(self.cast)
            if found is not None:
                return found
        return self.postfix(self.primary())

    def cast(self) -> Node:
        t = self.need("(")
        kind = self.type_name()
        self.need(")")
        ahead, x = self.t[self.i], self.peek()
        primitive = kind in PRIMITIVES
        if not (ahead.kind in ("str", "text", "char", "num") or (ahead.kind == "id" and x != "instanceof") or x in ("(", "!", "~") or (primitive and x in ("+", "-", "++", "--"))):
            raise ParseError("no cast")
        node = Node("cast", t, type=kind)
        node.value = node.add(self.lambda_() if self.is_lambda() else self.unary())
        return self.close(node)

    def arguments(self, node: Node) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(node.add(self.expression()))
            if not self.take(","):
                self.need(")")
                break
        return out

    def primary(self) -> Node:
        t, x = self.t[self.i], self.peek()
        if t.kind in ("str", "text"):
            self.next()
            return Node("string", t, value=unquoted(x))
        if t.kind in ("num", "char"):
            self.next()
            return Node("literal", t)
        if x == "(":
            self.next()
            node = Node("paren", t)
            node.value = node.add(self.expression())
            self.need(")")
            return self.close(node)
        if x == "new":
            return self.creation(t, None)
        if x == "switch":
            node = Node("switch", t)
            self.switch(node)
            return self.close(node)
        if x in ("this", "super"):
            self.next()
            node = Node(x, t)
            if self.peek() == "(":  # a call of another constructor
                node.kind = "other"
                self.arguments(node)
            return self.close(node)
        if x in PRIMITIVES:
            self.type_name()
            return self.close(Node("other", t))
        if x == "<":
            self.type_arguments()
        if not self.is_name():
            raise ParseError(f"{self.spot(t)}: expected an expression, found {t.text!r}")
        self.next()
        if self.peek() == "(":
            node = Node("call", t, name=x, scope=None, source="")
            node.args = self.arguments(node)
            return self.close(node)
        node = Node("name", t, name=x)
        if self.peek() == "<" or (self.peek() == "[" and self.peek(1) == "]"):  # Type<..>::new, Type[]::new, Type[].class
            i = self.i
            self.i -= 1
            if self.attempt(self.type_name) is None or self.peek() not in ("::", ".") or (self.peek() == "." and self.peek(1) != "class"):
                self.i = i
        return node

    def creation(self, t: Token, scope: Node | None) -> Node:
        self.need("new")
        self.modifiers()
        if self.peek() == "<":
            self.type_arguments()
        kind = self.next().text if self.peek() in PRIMITIVES else self.name()
        while True:
            if self.peek() == "<":
                self.need("<") if self.peek(1) == ">" else self.type_arguments()
                self.take(">")
            if not (self.peek() == "." and self.is_name(1)):
                break
            self.i += 1
            kind += "." + self.name()
        node = Node("new", t, type=kind, args=[])
        node.add(scope)
        if self.peek() == "[":
            node.kind = "other"
            while self.take("["):
                if self.peek() != "]":
                    node.add(self.expression())
                self.need("]")
            if self.peek() == "{":
                node.add(self.initializer())
            return self.close(node)
        node.args = self.arguments(node)
        if self.peek() == "{":
            body = Node("body", self.next())
            node.add(body)
            self.members(body)
            self.close(body)
        return self.close(node)

    def postfix(self, node: Node) -> Node:
        first = Token("id", "", node.at, node.at + 1)
        while True:
            x = self.peek()
            if x == ".":
                end = self.upto()
                self.next()
                if self.peek() == "<":
                    self.type_arguments()
                if self.peek() == "new":
                    node = self.creation(first, node)
                    continue
                name = self.next()
                if name.kind != "id":
                    raise ParseError(f"{self.spot(name)}: expected a name, found {name.text!r}")
                if self.peek() == "(":
                    call = Node("call", first, name=name.text, scope=node, source=self.text(node.at, end))
                    call.add(node)
                    call.args = self.arguments(call)
                    node = self.close(call)
                else:
                    access = Node("access", first, name=name.text, scope=node, source=self.text(node.at, end))
                    access.add(node)
                    node = self.close(access)
            elif x == "[":
                self.next()
                out = Node("other", first)
                out.add(node)
                out.add(self.expression())
                self.need("]")
                node = self.close(out)
            elif x in ("++", "--"):
                self.next()
                out = Node("other", first)
                out.add(node)
                node = self.close(out)
            elif x == "::":
                self.next()
                if self.peek() == "<":
                    self.type_arguments()
                self.next()
                out = Node("other", first)
                out.add(node)
                node = self.close(out)
            else:
                return node


def parse(source: str) -> tuple[Node, list[str], str]:
    """The unit's tree, the errors met, and the source."""
    p = Parser(source)
    return p.unit(), p.errors, source
