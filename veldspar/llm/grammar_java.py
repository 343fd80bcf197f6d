"""A recognizer for Java 17 source; names and types are not checked."""

from __future__ import annotations

import math
import re

from veldspar.llm.grammar_base import Cursor, Invalid, Unfinished

# The language's reserved words.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
PRIMITIVES = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())

TOKEN = re.compile(
    r"""(?P<space>[ \t\f\r\n\x1a]+|//[^\r\n]*|/\*.*?\*/)
    |(?P<i>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<s>\"\"\"[ \t\f]*\r?\n(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|"(?!"")(?:\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})|[^"\\\r\n])*"|'(?:\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})|[^'\\\r\n])')
    |(?P<n>0[xX](?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d[\d_]*[fFdD]?)?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?|(?:\d(?:[\d_]*\d)?)?\.\d(?:[\d_]*\d)?(?:[eE][+-]?\d+)?[fFdD]?|\d(?:[\d_]*\d)?(?:\.(?:[eE][+-]?\d+)?[fFdD]?(?![\w.])|[eE][+-]?\d+[fFdD]?|[fFdD]|[lL])?)(?![\w$])
    |(?P<o>(?!/\*)(?:->|::|\.\.\.|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|[-+*/%&|^]=|[-+*/%&|^~!?:;,.()\[\]{}<>=@]))""",
    re.S | re.X,
)


def tokens(text: str, at: int = 0):
    kinds, values, starts = [], [], []
    pos, n = at, len(text)
    match = TOKEN.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            for state in ("/*", '"""'):
                if text.startswith(state, pos):
                    raise Unfinished(state, kinds, values, starts, [False] * len(kinds))
            raise Invalid("character", pos)
        k = m.lastgroup
        if k != "space":
            kinds.append(k)
            values.append(m.group())
            starts.append(pos)
        pos = m.end()
    return kinds, values, starts, [False] * len(kinds)


PACKAGE, IMPORT, TYPE, MODULE = range(4)


class Java(Cursor):
    MAX_DEPTH = 400

    def __init__(self, found: tuple) -> None:
        super().__init__(*found)

    # names and types

    def is_name(self) -> bool:
        return self.k[self.p] == "i" and self.v[self.p] not in KEYWORDS

    def name(self) -> None:
        if not self.is_name():
            self.fail()
        self.p += 1

    def qualified(self) -> None:
        self.name()
        while self.is_op(".") and self.k[self.p + 1] == "i" and self.v[self.p + 1] not in KEYWORDS:
            self.p += 2

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.op("("):
            if not self.op(")"):
                if self.is_name() and self.v[self.p + 1] == "=":
                    while True:
                        self.name()
                        self.need("=")
                        self.element_value()
                        if not self.op(","):
                            break
                else:
                    self.element_value()
                self.need(")")

    def element_value(self) -> None:
        if self.is_op("@"):
            self.annotation()
        elif self.op("{"):
            while not self.op("}"):
                self.element_value()
                if not self.op(","):
                    self.need("}")
                    break
        else:
            self.ternary()

    def annotations(self) -> None:
        while self.is_op("@") and self.v[self.p + 1] != "interface":
            self.annotation()

    def type(self, void: bool = False, wild: bool = False) -> None:
        self.annotations()
        if wild and self.op("?"):
            if self.word("extends") or self.word("super"):
                self.type()
            return
        if void and self.word("void"):
            return
        if self.is_word(*PRIMITIVES):
            self.p += 1
        else:
            self.class_type()
        self.dims()

    def class_type(self) -> None:
        while True:
            self.annotations()
            self.name()
            if self.is_op("<"):
                self.type_arguments()
            if self.is_op(".") and (self.k[self.p + 1] == "i" and self.v[self.p + 1] not in KEYWORDS or self.v[self.p + 1] == "@"):
                self.p += 1
                continue
            return

    def type_arguments(self) -> None:
        self.need("<")
        if self.op(">"):
            return
        while True:
            self.type(wild=True)
            if not self.op(","):
                break
        self.need(">")

    def dims(self) -> None:
        while self.is_op("[", "@"):
            p = self.p
            self.annotations()
            if self.is_op("[") and self.v[self.p + 1] == "]":
                self.p += 2
            else:
                self.p = p
                return

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            self.annotations()
            self.name()
            if self.word("extends"):
                self.bounds()
            if not self.op(","):
                break
        self.need(">")

    def bounds(self) -> None:
        self.type()
        while self.op("&"):
            self.type()

    def type_list(self) -> None:
        self.type()
        while self.op(","):
            self.type()

    # declarations

    def part(self) -> int | None:
        """Rank of one piece of a compilation unit: package, import, type, module; null for semicolons."""
        if self.is_word("import"):
            self.p += 1
            self.word("static")
            self.qualified()
            if self.op("."):
                self.need("*")
            self.need(";")
            return IMPORT
        if self.attempt(self.package_line):
            return PACKAGE
        if self.is_word("module", "open") and self.attempt(self.module):
            return MODULE
        rank = None
        while self.k[self.p] != "e":
            if not self.op(";"):
                self.type_declaration(self.modifiers())
                rank = TYPE
        return rank

    def package_line(self) -> None:
        self.annotations()
        self.need("package")
        self.qualified()
        self.need(";")

    def module(self) -> None:
        self.word("open")
        self.need("module")
        self.qualified()
        self.need("{")
        while not self.op("}"):
            if not self.is_word("requires", "exports", "opens", "uses", "provides"):
                self.fail()
            self.p += 1
            while not self.op(";"):
                if self.k[self.p] != "i" and not self.is_op(".", ","):
                    self.fail()
                self.p += 1

    def modifiers(self) -> bool:
        some = False
        while True:
            if self.is_op("@") and self.v[self.p + 1] != "interface":
                self.annotation()
            elif self.is_word("non") and self.v[self.p + 1] == "-" and self.v[self.p + 2] == "sealed":
                self.p += 3
            elif self.is_word("sealed"):
                if self.k[self.p + 1] != "i":
                    return some
                self.p += 1
            elif self.is_word("default") and self.v[self.p + 1] in (":", "->"):
                return some
            elif self.k[self.p] == "i" and self.v[self.p] in MODIFIERS:
                if self.is_word("synchronized", "static") and self.v[self.p + 1] in ("(", "{"):
                    return some
                self.p += 1
            else:
                return some
            some = True

    def at_type_declaration(self) -> bool:
        if self.is_word("class", "interface", "enum") or self.is_op("@") and self.v[self.p + 1] == "interface":
            return True
        return self.is_word("record") and self.k[self.p + 1] == "i" and self.v[self.p + 2] in ("(", "<")

    def type_declaration(self, _modified: bool = False) -> None:
        if self.word("class"):
            self.name()
            if self.is_op("<"):
                self.type_parameters()
            if self.word("extends"):
                self.type()
            if self.word("implements"):
                self.type_list()
            if self.word("permits"):
                self.type_list()
            self.class_body()
        elif self.word("interface"):
            self.name()
            if self.is_op("<"):
                self.type_parameters()
            if self.word("extends"):
                self.type_list()
            if self.word("permits"):
                self.type_list()
            self.class_body()
        elif self.word("enum"):
            self.name()
            if self.word("implements"):
                self.type_list()
            self.enum_body()
        elif self.op("@"):
            self.need("interface")
            self.name()
            self.class_body()
        elif self.at_type_declaration():
            self.p += 1
            self.name()
            if self.is_op("<"):
                self.type_parameters()
            self.parameters()
            if self.word("implements"):
                self.type_list()
            self.class_body()
        else:
            self.fail()

    def enum_body(self) -> None:
        self.need("{")
        while not self.is_op(";", "}"):
            self.annotations()
            self.name()
            if self.is_op("("):
                self.arguments()
            if self.is_op("{"):
                self.class_body()
            if not self.op(","):
                break
        if self.op(";"):
            self.members()
        self.need("}")

    def class_body(self) -> None:
        self.need("{")
        self.members()
        self.need("}")

    def members(self) -> None:
        while not self.is_op("}"):
            if self.k[self.p] == "e":
                self.fail()
            self.member()

    def member(self) -> None:
        if self.op(";"):
            return
        if self.is_op("{"):
            self.block()
            return
        if self.is_word("static") and self.v[self.p + 1] == "{":
            self.p += 1
            self.block()
            return
        self.modifiers()
        if self.at_type_declaration():
            self.type_declaration()
            return
        if self.is_op("<"):
            self.type_parameters()
            self.annotations()
        if self.is_name() and self.v[self.p + 1] == "(":  # a constructor
            self.p += 1
            self.parameters()
            self.throws()
            self.block()
            return
        if self.is_name() and self.v[self.p + 1] == "{":  # a record's compact constructor
            self.p += 1
            self.block()
            return
        self.type(void=True)
        void = self.v[self.p - 1] == "void"
        self.name()
        if self.is_op("("):
            self.parameters()
            self.dims()
            self.throws()
            if self.word("default"):
                self.element_value()
            if not self.op(";"):
                self.block()
            return
        if void:
            self.fail()
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.word("throws"):
            self.type_list()

    def parameters(self) -> None:
        self.need("(")
        if self.op(")"):
            return
        while True:
            self.modifiers()
            self.type()
            self.annotations()
            self.op("...")
            if self.is_word("this"):
                self.p += 1
            else:
                self.name()
                if self.op("."):
                    self.need("this")
            self.dims()
            if not self.op(","):
                break
        self.need(")")

    def declarators(self) -> None:
        """From behind the first name on."""
        while True:
            self.dims()
            if self.op("="):
                self.initializer()
            if not self.op(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.is_op("{"):
            self.array_initializer()
        else:
            self.expression()

    def array_initializer(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.initializer()
            if not self.op(","):
                self.need("}")
                return

    # statements

    def block(self) -> None:
        self.depth += 1
        if self.depth > self.MAX_DEPTH:
            raise RecursionError
        self.need("{")
        while not self.op("}"):
            if self.k[self.p] == "e":
                self.fail()
            self.block_statement()
        self.depth -= 1

    def block_statement(self) -> None:
        p = self.p
        if self.is_op("@") or self.is_word("final", "abstract", "static", "strictfp", "class", "interface", "enum", "record", "sealed", "non"):
            self.modifiers()
            if self.at_type_declaration():
                self.type_declaration()
                return
            if self.p > p:
                self.local_declaration()
                self.need(";")
                return
        if self.is_word(*PRIMITIVES) and self.attempt(self.local_declaration) or self.is_name() and self.starts_declaration():
            if self.v[self.p - 1] != ";" or self.p == p:
                if self.p == p:
                    self.local_declaration()
                self.need(";")
            return
        self.p = p
        self.statement()

    def starts_declaration(self) -> bool:
        p = self.p
        nxt = self.v[p + 1]
        if self.k[p + 1] == "o" and nxt in ("(", "=", ";", "++", "--", "::", ":", "->"):
            return False
        ok = self.attempt(self.type) and self.is_name() and self.v[self.p + 1] in ("=", ";", ",", "[", ":")
        if ok and self.is_word("instanceof"):
            ok = False
        self.p = p
        return ok

    def local_declaration(self) -> None:
        self.type()
        self.name()
        self.declarators()

    def parenthesized(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        k, v = self.k[self.p], self.v[self.p]
        if k == "o":
            if v == "{":
                self.block()
                return
            if v == ";":
                self.p += 1
                return
        elif k == "i":
            rule = self.RULES.get(v)
            if rule is not None:
                if v != "yield" or self.is_yield():
                    self.depth += 1
                    if self.depth > self.MAX_DEPTH:
                        raise RecursionError
                    rule(self)
                    self.depth -= 1
                    return
            elif self.is_name() and self.v[self.p + 1] == ":" and self.k[self.p + 1] == "o":
                self.p += 2
                self.statement()
                return
        self.expression_statement()
        self.need(";")

    def is_yield(self) -> bool:
        n = self.v[self.p + 1]
        return self.k[self.p + 1] != "o" or n in ("(", "!", "~", "+", "-", "++", "--") and n not in ("++", "--")

    def expression_statement(self) -> None:
        if self.expression() not in ("call", "assign", "step", "new"):
            self.fail()

    def s_if(self) -> None:
        while True:  # a chain of else-ifs is no nesting
            self.p += 1
            self.parenthesized()
            self.statement()
            if not self.word("else"):
                return
            if not self.is_word("if"):
                self.statement()
                return

    def s_while(self) -> None:
        self.p += 1
        self.parenthesized()
        self.statement()

    def s_do(self) -> None:
        self.p += 1
        self.statement()
        self.need("while")
        self.parenthesized()
        self.need(";")

    def s_for(self) -> None:
        self.p += 1
        self.need("(")
        if self.attempt(self.for_each_head):
            self.expression()
        else:
            if not self.op(";"):
                p = self.p
                self.modifiers()
                if self.p > p or self.is_word(*PRIMITIVES) or self.is_name() and self.starts_declaration():
                    self.local_declaration()
                else:
                    self.expression_statement()
                    while self.op(","):
                        self.expression_statement()
                self.need(";")
            if not self.is_op(";"):
                self.expression()
            self.need(";")
            if not self.is_op(")"):
                self.expression_statement()
                while self.op(","):
                    self.expression_statement()
        self.need(")")
        self.statement()

    def for_each_head(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.dims()
        self.need(":")

    def s_return(self) -> None:
        self.p += 1
        if not self.is_op(";"):
            self.expression()
        self.need(";")

    def s_throw(self) -> None:
        self.p += 1
        self.expression()
        self.need(";")

    def s_jump(self) -> None:
        self.p += 1
        if self.is_name():
            self.p += 1
        self.need(";")

    def s_yield(self) -> None:
        self.p += 1
        self.expression()
        self.need(";")

    def s_assert(self) -> None:
        self.p += 1
        self.expression()
        if self.op(":"):
            self.expression()
        self.need(";")

    def s_synchronized(self) -> None:
        self.p += 1
        self.parenthesized()
        self.block()

    def s_try(self) -> None:
        self.p += 1
        resources = self.op("(")
        if resources:
            while True:
                p = self.p
                self.modifiers()
                if self.p > p or self.is_name() and self.starts_declaration():
                    self.type()
                    self.name()
                    self.need("=")
                    self.expression()
                else:
                    self.expression()
                if not self.op(";") or self.is_op(")"):
                    break
            self.need(")")
        self.block()
        some = resources
        while self.word("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.op("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.word("finally"):
            some = True
            self.block()
        if not some:
            self.fail()

    def s_switch(self) -> None:
        self.switch()

    def switch(self) -> None:
        self.need("switch")
        self.parenthesized()
        self.need("{")
        arrows = None
        while not self.op("}"):
            if self.word("default"):
                pass
            else:
                self.need("case")
                while True:
                    if not self.word("default") and not self.attempt(self.case_pattern):
                        self.ternary(in_case=True)
                    if not self.op(","):
                        break
            if self.op("->"):
                if arrows is False:
                    self.fail()
                arrows = True
                if self.is_op("{"):
                    self.block()
                elif self.is_word("throw"):
                    self.s_throw()
                else:
                    self.expression()
                    self.need(";")
            else:
                if arrows:
                    self.fail()
                arrows = False
                self.need(":")
                while not self.is_op("}") and not self.is_word("case") and not (self.is_word("default") and self.v[self.p + 1] in (":", "->")):
                    if self.k[self.p] == "e":
                        self.fail()
                    self.block_statement()

    def case_pattern(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if not self.is_op("->", ":", ",", "&&"):
            self.fail()
        if self.op("&&"):
            self.expression()

    def s_stray(self) -> None:
        self.fail()

    RULES = {
        "if": s_if, "while": s_while, "do": s_do, "for": s_for, "return": s_return, "throw": s_throw, "break": s_jump, "continue": s_jump, "yield": s_yield,
        "assert": s_assert, "synchronized": s_synchronized, "try": s_try, "switch": s_switch, "else": s_stray, "case": s_stray, "catch": s_stray, "finally": s_stray, "default": s_stray,
    }

    # expressions; each rule says what kind of expression it read

    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())

    def expression(self) -> str:
        if self.is_lambda():
            self.lambda_()
            return "other"
        kind = self.ternary()
        if self.assignment_operator():
            if kind not in ("name", "index"):
                self.fail()
            self.expression()
            return "assign"
        return kind

    def assignment_operator(self) -> bool:
        if self.k[self.p] != "o":
            return False
        v = self.v[self.p]
        if v in self.ASSIGN:
            self.p += 1
            return True
        if v == ">":  # >>= and >>>= come as single signs
            j = self.p
            while self.v[j + 1] == ">" and self.at[j + 1] == self.at[j] + 1:
                j += 1
            if j > self.p and self.v[j + 1] == "=" and self.at[j + 1] == self.at[j] + 1:
                self.p = j + 2
                return True
        return False

    def is_lambda(self) -> bool:
        if self.is_name() and self.v[self.p + 1] == "->":
            return True
        return self.is_op("(") and self.v[self.partner[self.p] + 1] == "->"

    def lambda_(self) -> None:
        if self.op("("):
            if not self.op(")"):
                if self.is_name() and self.v[self.p + 1] in (",", ")"):
                    self.name()
                    while self.op(","):
                        self.name()
                    self.need(")")
                else:
                    self.p -= 1
                    self.parameters()
        else:
            self.name()
        self.need("->")
        if self.is_op("{"):
            self.block()
        else:
            self.expression()

    def ternary(self, in_case: bool = False) -> str:
        self.depth += 1
        if self.depth > self.MAX_DEPTH:
            raise RecursionError
        kind = self.binary()
        if self.op("?"):
            kind = "other"
            if self.is_lambda():
                self.lambda_()
            else:
                self.expression()
            self.need(":")
            if self.is_lambda():
                self.lambda_()
            else:
                self.ternary()
        self.depth -= 1
        return kind

    BINARY = frozenset("|| && | ^ & == != < <= << + - * / %".split())

    def binary(self) -> str:
        kind = self.unary()
        while True:
            if self.k[self.p] == "o":
                v = self.v[self.p]
                if v in self.BINARY:
                    self.p += 1
                elif v == ">":
                    j, n = self.p, 1
                    while self.v[j + 1] == ">" and self.at[j + 1] == self.at[j] + 1 and n < 3:
                        j, n = j + 1, n + 1
                    if self.v[j + 1] == "=" and self.at[j + 1] == self.at[j] + 1:
                        if n > 1:
                            return kind
                        j += 1
                    self.p = j + 1
                else:
                    return kind
                self.unary()
                kind = "other"
            elif self.word("instanceof"):
                kind = "other"
                self.modifiers()
                self.type()
                if self.is_name():
                    self.p += 1
            else:
                return kind

    def unary(self) -> str:
        k, v = self.k[self.p], self.v[self.p]
        if k == "o":
            if v in ("+", "-", "!", "~"):
                self.p += 1
                self.unary()
                return "other"
            if v in ("++", "--"):
                self.p += 1
                if self.unary() not in ("name", "index"):
                    self.fail()
                return "step"
            if v == "(" and self.attempt(self.cast):
                return "other"
        kind = self.primary()
        while self.is_op("++", "--"):
            if kind not in ("name", "index"):
                self.fail()
            self.p += 1
            kind = "step"
        return kind

    def cast(self) -> None:
        close = self.partner[self.p]
        self.p += 1
        primitive = self.is_word(*PRIMITIVES)
        self.bounds()
        if self.p != close:
            self.fail()
        primitive = primitive and self.v[self.p - 1] != "]"
        self.p += 1
        if self.is_lambda():
            self.lambda_()
            return
        k, v = self.k[self.p], self.v[self.p]
        if primitive or k in "ns" or k == "i" and v not in ("instanceof",) or k == "o" and v in ("(", "!", "~"):
            self.unary()
        else:
            self.fail()

    def arguments(self) -> None:
        self.need("(")
        if self.op(")"):
            return
        while True:
            self.expression()
            if not self.op(","):
                break
        self.need(")")

    def primary(self) -> str:
        k, v = self.k[self.p], self.v[self.p]
        kind = "other"
        if k in "ns":
            self.p += 1
        elif k == "i":
            if v == "switch":
                self.switch()
            elif v == "new":
                kind = self.creator()
            elif v in ("true", "false", "null"):
                self.p += 1
            elif v in ("this", "super"):
                self.p += 1
                if self.is_op("("):
                    self.arguments()
                    kind = "call"
            elif v in PRIMITIVES or v == "void":
                self.p += 1
                self.dims()
                if self.is_op("::"):
                    pass
                else:
                    self.need(".")
                    self.need("class")
            elif v in KEYWORDS:
                self.fail()
            else:
                self.p += 1
                kind = "name"
                if self.is_op("("):
                    self.arguments()
                    kind = "call"
                elif self.is_op("<", "[", "."):
                    p = self.p
                    self.p -= 1
                    if not (self.attempt(self.type) and (self.is_op("::") or self.is_op(".") and self.v[self.p + 1] == "class") and self.v[self.p - 1] in (">", "]")):
                        self.p = p
                    else:
                        kind = "other"
        elif k == "o" and v == "(":
            self.p += 1
            inner = self.expression()
            self.need(")")
            kind = inner if inner in ("name", "index") else "other"
        else:
            self.fail()
        while True:
            if self.k[self.p] != "o":
                return kind
            v = self.v[self.p]
            if v == ".":
                self.p += 1
                if self.is_word("new"):
                    kind = self.creator()
                elif self.word("class"):
                    kind = "other"
                elif self.word("this"):
                    kind = "other"
                else:
                    if self.is_op("<"):
                        self.type_arguments()
                    if not self.word("super"):
                        self.name()
                    kind = "name"
                    if self.is_op("("):
                        self.arguments()
                        kind = "call"
            elif v == "[":
                self.p += 1
                self.expression()
                self.need("]")
                kind = "index"
            elif v == "::":
                self.p += 1
                if self.is_op("<"):
                    self.type_arguments()
                if not self.word("new"):
                    self.name()
                kind = "other"
            else:
                return kind

    def creator(self) -> str:
        self.need("new")
        if self.is_op("<"):
            self.type_arguments()
        self.annotations()
        if self.is_word(*PRIMITIVES):
            self.p += 1
        else:
            self.class_type()
        if self.is_op("(") and self.v[self.p - 1] not in PRIMITIVES:
            self.arguments()
            if self.is_op("{"):
                self.class_body()
            return "new"
        if not self.is_op("[", "@"):
            self.fail()
        sized = False
        while self.is_op("[", "@"):
            self.annotations()
            if self.v[self.p + 1] == "]":
                self.p += 2
                if not sized and not self.is_op("[", "{", "@"):
                    self.fail()
            elif self.is_op("[") and self.v[self.p - 1] != "]" or sized:
                self.need("[")
                self.expression()
                self.need("]")
                sized = True
            else:
                self.fail()
        if self.is_op("{"):
            if sized:
                self.fail()
            self.array_initializer()
        return "other"


def plain(text: str) -> str:
    """``text`` with such escapes resolved as stand for their character everywhere in a source."""
    if "\\u" not in text:
        return text
    return re.sub(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})", lambda m: m[1] + chr(int(m[2], 16)), text)


def statements(found: tuple) -> list[tuple[int, int]]:
    """Token spans of the package line, each import and each type of a compilation unit."""
    kinds, values = found[:2]
    out, depth, start = [], 0, 0
    for i, v in enumerate(values):
        if kinds[i] != "o":
            continue
        if v in ("(", "[", "{"):
            depth += 1
        elif v in (")", "]", "}"):
            depth -= 1
        if depth == 0 and v in (";", "}"):
            out.append((start, i + 1))
            start = i + 1
    if start < len(values):
        out.append((start, len(values)))
    return out


def check(found: tuple, deep: bool = False) -> int | None:
    """The rank of the piece; raises :class:`Invalid` unless it is a whole one."""
    cursor = Java(found)
    if deep:
        cursor.MAX_DEPTH = math.inf
    rank = cursor.part()
    if cursor.k[cursor.p] != "e":
        cursor.fail()
    return rank


def in_order(ranks: list[int | None]) -> bool:
    """Whether pieces of these ranks make a compilation unit, in this order."""
    some = [r for r in ranks if r is not None]
    if PACKAGE in ranks[1:] or MODULE in some and (some.count(MODULE) > 1 or TYPE in some):
        return False
    return some == sorted(some)
