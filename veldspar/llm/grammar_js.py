"""A recognizer for ECMAScript modules and TypeScript 5; names and types are not checked."""

from __future__ import annotations

import math
import re

from veldspar.llm.grammar_base import Cursor, Invalid, Unfinished

# Reserved words of a module.
RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public".split()
)
# words that may still name something in TypeScript, or in a place where the grammar is not strict about them
SOFT = frozenset("let static implements interface package private protected public await yield".split())
BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default".split())

TOKEN = re.compile(
    r"""(?P<space>(?:[ \t\v\f\xa0﻿ - 　]|//[^\r\n  ]*|/\*.*?\*/|(?P<nl>[\r\n  ]))+)
    |(?P<i>\#?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<s>"(?:\\(?:\r\n|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^ux])|[^"\\\r\n])*"|'(?:\\(?:\r\n|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^ux])|[^'\\\r\n])*')
    |(?P<n>(?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9]\d*(?:_\d+)*)n|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?))(?![\w$])
    |(?P<o>(?!/\*)(?:=>|\.\.\.|\?\?=|\?\?|\?\.(?!\d)|===|!==|==|!=|\*\*=|\*\*|\+\+|--|&&=|\|\|=|&&|\|\||<<=|<<|<=|[-+*/%&|^]=|[-+*/%&|^~!?:;,.()\[\]{}<>=@]))""",
    re.S | re.X,
)
REGEX = re.compile(r"/(?![*/])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[A-Za-z]*")
TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^\\`$])*(`|\$\{)")


def tokens(text: str, at: int = 0):
    """Kinds, values, starts from ``at`` on, and whether a line end stands in front."""
    kinds: list[str] = []
    values: list[str] = []
    starts: list[int] = []
    newline: list[bool] = []
    pos, n, nl = at, len(text), True
    if not at and text.startswith("#!"):
        pos = (re.search(r"[\r\n]|$", text)).start()
    braces: list[str] = []  # what each open brace belongs to
    parens_regex = False
    parens: list[bool] = []  # whether a regular expression may follow the closing bracket
    match = TOKEN.match
    while pos < n:
        c = text[pos]
        if c == "`" or c == "}" and braces and braces[-1] == "`":
            if c == "}":
                braces.pop()
                kinds.append("o")
                values.append(")")
                starts.append(pos)
                newline.append(nl)
                nl = False
            m = TEMPLATE.match(text, pos + 1)
            if m is None:
                raise Unfinished("`", kinds, values, starts, newline)
            kinds.append("t" if c == "`" else "T")
            values.append("`" if m[1] == "`" else "${")
            starts.append(pos)
            newline.append(nl)
            nl = False
            if m[1] == "${":
                braces.append("`")
                kinds.append("o")
                values.append("(")
                starts.append(m.end())
                newline.append(False)
            pos = m.end()
            continue
        if c == "/" and not text.startswith(("//", "/*"), pos):
            last, kind = (values[-1], kinds[-1]) if values else ("", "o")
            if kind == "o" and last not in (")", "]", "}", "++", "--") or kind == "i" and last in BEFORE_REGEX and not (len(values) > 1 and values[-2] in (".", "?.")) or kind == "o" and last == ")" and parens_regex or kind == "o" and last == "}":
                m = REGEX.match(text, pos)
                if m is not None:
                    kinds.append("r")
                    values.append(m.group())
                    starts.append(pos)
                    newline.append(nl)
                    nl = False
                    pos = m.end()
                    continue
        m = match(text, pos)
        if m is None:
            if text.startswith("/*", pos):
                raise Unfinished("/*", kinds, values, starts, newline)
            raise Invalid("character", pos)
        k = m.lastgroup
        if k == "space" or k == "nl":
            nl = nl or m["nl"] is not None or "\n" in m.group() or "\r" in m.group()
        else:
            v = m.group()
            if k == "o":
                if v == "{":
                    braces.append("{")
                elif v == "}":
                    if braces:
                        braces.pop()
                elif v == "(":
                    parens.append(bool(values) and values[-1] in ("if", "while", "for", "with") and not (len(values) > 1 and values[-2] in (".", "?.")))
                elif v == ")":
                    parens_regex = parens.pop() if parens else False
            kinds.append(k)
            values.append(v)
            starts.append(pos)
            newline.append(nl)
            nl = False
        pos = m.end()
    return kinds, values, starts, newline


class Script(Cursor):
    MAX_DEPTH = 300

    def __init__(self, found: tuple, ts: bool) -> None:
        super().__init__(*found)
        self.ts = ts
        self.no_in = False

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > self.MAX_DEPTH:
            raise RecursionError

    # small things

    def semicolon(self) -> None:
        if self.op(";"):
            return
        if self.nl[self.p] or self.is_op("}") or self.k[self.p] == "e":
            return
        self.fail()

    def is_name(self) -> bool:
        v = self.v[self.p]
        return self.k[self.p] == "i" and v[0] != "#" and (v not in RESERVED or v in SOFT)

    def name(self) -> None:
        if not self.is_name() or self.v[self.p] in ("let", "static", "implements", "interface", "package", "private", "protected", "public") and not self.ts:
            self.fail()
        self.p += 1

    def any_word(self) -> None:
        if self.k[self.p] != "i" or self.v[self.p][0] == "#":
            self.fail()
        self.p += 1

    def listed(self, close: str, rule) -> None:
        """Items up to ``close``, commas between, one may be left over."""
        while not self.op(close):
            rule()
            if not self.op(","):
                self.need(close)
                return

    # module

    def module(self) -> None:
        while self.k[self.p] != "e":
            self.statement(top=True)

    def import_(self) -> None:
        self.need("import")
        if self.k[self.p] == "s":
            self.p += 1
            self.attributes()
            self.semicolon()
            return
        if self.ts and self.is_word("type") and not (self.v[self.p + 1] in ("from", ",") and self.v[self.p + 2] != "from") and self.v[self.p + 1] != "=":
            self.p += 1
        if self.ts and self.is_name() and self.v[self.p + 1] == "=":
            self.p += 2
            self.entity()
            if self.is_op("("):
                self.arguments()
            self.semicolon()
            return
        first = False
        if self.is_name():
            self.name()
            first = True
        if not first or self.op(","):
            if self.op("*"):
                self.need("as")
                self.name()
            else:
                self.need("{")
                self.listed("}", self.import_item)
        self.need("from")
        self.string()
        self.attributes()
        self.semicolon()

    def import_item(self) -> None:
        self.specifier(local=True)

    def specifier(self, local: bool) -> None:
        if self.ts and self.is_word("type") and (self.k[self.p + 1] in "is") and self.v[self.p + 1] != "as":
            self.p += 1
        if self.k[self.p] == "s":
            self.p += 1
            if not self.is_word("as") and local:
                self.fail()
        else:
            p = self.p
            self.any_word()
            if local and not self.is_word("as"):
                self.p = p
                self.name()
        if self.word("as"):
            if local:
                self.name()
            elif self.k[self.p] == "s":
                self.p += 1
            else:
                self.any_word()

    def export_item(self) -> None:
        self.specifier(local=False)

    def string(self) -> None:
        if self.k[self.p] != "s":
            self.fail()
        self.p += 1

    def attributes(self) -> None:
        if self.is_word("with") or self.is_word("assert") and not self.nl[self.p]:
            self.p += 1
            self.object()

    def export(self) -> None:
        self.need("export")
        if self.op("*"):
            if self.word("as"):
                if self.k[self.p] == "s":
                    self.p += 1
                else:
                    self.any_word()
            self.need("from")
            self.string()
            self.attributes()
            self.semicolon()
        elif self.is_op("{") or self.ts and self.is_word("type") and self.v[self.p + 1] in ("{", "*"):
            self.word("type")
            if self.op("*"):
                if self.word("as"):
                    self.any_word()
                self.need("from")
                self.string()
            else:
                self.need("{")
                self.listed("}", self.export_item)
                if self.word("from"):
                    self.string()
            self.attributes()
            self.semicolon()
        elif self.word("default"):
            if self.is_word("function") or self.is_word("async") and self.v[self.p + 1] == "function" and not self.nl[self.p + 1]:
                self.function(named=False)
            elif self.is_word("class") or self.is_op("@"):
                self.decorators()
                self.class_(named=False)
            elif self.ts and self.is_word("abstract") and self.v[self.p + 1] == "class":
                self.p += 1
                self.class_(named=False)
            elif self.ts and self.is_word("interface") and self.k[self.p + 1] == "i":
                self.interface()
            else:
                self.assignment()
                self.semicolon()
        elif self.ts and self.op("="):
            self.expression()
            self.semicolon()
        elif self.ts and self.is_word("as") and self.v[self.p + 1] == "namespace":
            self.p += 2
            self.name()
            self.semicolon()
        elif self.ts and self.is_word("import"):
            self.import_()
        else:
            self.decorators()
            if not self.declaration():
                self.fail()

    def declaration(self) -> bool:
        """A declaration, if one begins here."""
        v, n, same = self.v[self.p], self.v[self.p + 1], not self.nl[self.p + 1]
        if self.k[self.p] != "i":
            if self.is_op("@"):
                self.decorators()
                if self.is_word("export"):
                    self.export()
                    return True
                if self.ts and self.is_word("abstract"):
                    self.p += 1
                self.class_()
                return True
            return False
        if v == "function" or v == "async" and n == "function" and same:
            self.function()
        elif v == "class":
            self.class_()
        elif v == "var" or v == "const" or v == "let" and (self.k[self.p + 1] == "i" and n not in ("in", "of", "instanceof") or n in ("[", "{")):
            if self.ts and v == "const" and n == "enum":
                self.p += 1
                self.enum()
            else:
                self.variables()
                self.semicolon()
        elif self.ts:
            word = self.k[self.p + 1] == "i"
            if v == "interface" and word and same:
                self.interface()
            elif v == "type" and word and same and n not in ("in", "instanceof", "as", "satisfies", "of") and self.v[self.p + 2] in ("=", "<"):
                self.p += 1
                self.name()
                self.type_parameters()
                self.need("=")
                self.type()
                self.semicolon()
            elif v == "enum" and word:
                self.enum()
            elif v == "abstract" and n == "class":
                self.p += 1
                self.class_()
            elif v == "declare" and word and same:
                self.p += 1
                if self.is_word("global") and self.v[self.p + 1] == "{":
                    self.p += 1
                    self.block()
                elif not self.declaration():
                    self.fail()
            elif v in ("namespace", "module") and (word or self.k[self.p + 1] == "s") and same:
                self.p += 1
                if self.k[self.p] == "s":
                    self.p += 1
                else:
                    self.entity()
                if self.is_op("{"):
                    self.need("{")
                    while not self.op("}"):
                        self.statement(top=True)
                else:
                    self.semicolon()
            else:
                return False
        else:
            return False
        return True

    def entity(self) -> None:
        self.any_word()
        while self.op("."):
            self.any_word()

    # statements

    def block(self) -> None:
        self.need("{")
        self.deeper()
        while not self.op("}"):
            if self.k[self.p] == "e":
                self.fail()
            self.statement()
        self.depth -= 1

    def parenthesized(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self, top: bool = False, only: bool = False) -> None:
        k, v = self.k[self.p], self.v[self.p]
        if k == "o":
            if v == "{":
                self.block()
                return
            if v == ";":
                self.p += 1
                return
            if v == "@" and not only:
                self.declaration()
                return
        elif k == "i":
            if v in ("import", "export"):
                n = self.v[self.p + 1]
                if v == "export" or n not in ("(", "."):
                    if not top:
                        self.fail()
                    (self.export if v == "export" else self.import_)()
                    return
            rule = self.RULES.get(v)
            if rule is not None:
                self.deeper()
                rule(self)
                self.depth -= 1
                return
            if only:
                if v in ("class", "const") or v == "let" and self.v[self.p + 1] == "[" or v == "function":
                    self.fail()
            elif self.declaration():
                return
            if v not in RESERVED | {"async"} or v in SOFT or v == "async":
                if self.v[self.p + 1] == ":" and self.k[self.p + 1] == "o":
                    self.p += 2
                    self.statement()
                    return
        elif k == "e":
            self.fail()
        if only and v == "var":
            self.variables()
        else:
            self.expression()
        self.semicolon()

    def s_if(self) -> None:
        while True:  # a chain of else-ifs is no nesting
            self.p += 1
            self.parenthesized()
            self.statement(only=True)
            if not self.word("else"):
                return
            if not self.is_word("if"):
                self.statement(only=True)
                return

    def s_while(self) -> None:
        self.p += 1
        self.parenthesized()
        self.statement(only=True)

    def s_do(self) -> None:
        self.p += 1
        self.statement(only=True)
        self.need("while")
        self.parenthesized()
        self.op(";")

    def s_for(self) -> None:
        self.p += 1
        waits = self.word("await")
        self.need("(")
        before, self.no_in = self.no_in, True
        declared = 0
        if self.is_word("var", "const") or self.is_word("let") and (self.k[self.p + 1] == "i" and self.v[self.p + 1] not in ("in", "of") or self.v[self.p + 1] in ("[", "{")):
            declared = self.variables(loop=True)
        elif not self.is_op(";"):
            self.expression()
        self.no_in = before
        if self.word("of"):
            self.assignment()
        elif not waits and self.word("in"):
            self.expression()
        else:
            if waits or declared < 0:
                self.fail()
            self.need(";")
            if not self.is_op(";"):
                self.expression()
            self.need(";")
            if not self.is_op(")"):
                self.expression()
        self.need(")")
        self.statement(only=True)

    def s_return(self) -> None:
        self.p += 1
        if not (self.nl[self.p] or self.is_op(";", "}") or self.k[self.p] == "e"):
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        self.p += 1
        if self.nl[self.p]:
            self.fail()
        self.expression()
        self.semicolon()

    def s_jump(self) -> None:
        self.p += 1
        if self.is_name() and not self.nl[self.p]:
            self.p += 1
        self.semicolon()

    def s_debugger(self) -> None:
        self.p += 1
        self.semicolon()

    def s_try(self) -> None:
        self.p += 1
        self.block()
        some = False
        if self.word("catch"):
            some = True
            if self.op("("):
                self.binding()
                if self.ts and self.op(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.word("finally"):
            some = True
            self.block()
        if not some:
            self.fail()

    def s_switch(self) -> None:
        self.p += 1
        self.parenthesized()
        self.need("{")
        while not self.op("}"):
            if not self.word("default"):
                self.need("case")
                self.expression()
            self.need(":")
            while not self.is_op("}") and not self.is_word("case", "default"):
                self.statement()

    def s_stray(self) -> None:
        self.fail()

    RULES = {
        "if": s_if, "while": s_while, "do": s_do, "for": s_for, "return": s_return, "throw": s_throw, "break": s_jump, "continue": s_jump, "debugger": s_debugger, "try": s_try, "switch": s_switch,
        "else": s_stray, "case": s_stray, "catch": s_stray, "finally": s_stray, "default": s_stray, "with": s_stray, "in": s_stray, "instanceof": s_stray,
    }

    def variables(self, loop: bool = False) -> int:
        """Declared variables; negative if one lacks the value it must have."""
        const = self.v[self.p] == "const"
        self.p += 1
        n, lacks = 0, False
        while True:
            pattern = self.is_op("[", "{")
            self.binding()
            if self.ts:
                self.op("!")
                if self.op(":"):
                    self.type()
            if self.op("="):
                self.assignment()
            elif pattern or const:
                lacks = True
            n += 1
            if not self.op(","):
                break
        if lacks:
            if loop:
                return -n
            if not self.ts:
                self.fail()
        return n

    def binding(self) -> None:
        if self.op("["):
            while not self.op("]"):
                if self.op(","):
                    continue
                self.op("...")
                self.binding_value()
                if not self.op(","):
                    self.need("]")
                    return
        elif self.op("{"):
            self.listed("}", self.binding_property)
        else:
            self.name()

    def binding_value(self) -> None:
        self.binding()
        if self.op("="):
            self.assignment()

    def binding_property(self) -> None:
        if self.op("..."):
            self.binding()
            return
        if self.k[self.p] == "i" and not (self.v[self.p + 1] == ":" and self.k[self.p + 1] == "o"):
            self.name()
        else:
            self.property_name()
            self.need(":")
            self.binding()
        if self.op("="):
            self.assignment()

    def property_name(self, private: bool = False) -> None:
        if self.k[self.p] in "sn":
            self.p += 1
        elif self.k[self.p] == "i" and (private or self.v[self.p][0] != "#"):
            self.p += 1
        elif self.op("["):
            before, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = before
            self.need("]")
        else:
            self.fail()

    # functions and classes

    def function(self, named: bool = True) -> None:
        self.word("async")
        self.need("function")
        self.op("*")
        if self.k[self.p] == "i":
            self.name()
        elif named:
            self.fail()
        self.signature()
        if self.is_op("{"):
            self.body()
        elif self.ts:
            self.semicolon()
        else:
            self.fail()

    def body(self) -> None:
        before, self.no_in = self.no_in, False
        self.block()
        self.no_in = before

    def signature(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.ts and self.op(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        self.listed(")", self.parameter)

    def parameter(self) -> None:
        self.decorators()
        if self.ts:
            while self.is_word("public", "private", "protected", "readonly", "override") and (self.k[self.p + 1] == "i" or self.v[self.p + 1] in ("{", "[")):
                self.p += 1
        rest = self.op("...")
        if self.ts and self.is_word("this"):
            self.p += 1
        else:
            self.binding()
        if self.ts:
            self.op("?")
            if self.op(":"):
                self.type()
        if self.op("="):
            if rest:
                self.fail()
            self.assignment()
        if rest and not self.is_op(")"):
            self.fail()

    def decorators(self) -> None:
        while self.op("@"):
            if self.is_op("("):
                self.parenthesized()
            else:
                self.any_word()
                while self.op("."):
                    self.any_word()
                if self.ts and self.is_op("<"):
                    self.attempt(self.type_arguments)
                if self.is_op("("):
                    self.arguments()

    def class_(self, named: bool = True) -> None:
        self.need("class")
        if self.is_name() and not self.is_word("implements"):
            self.name()
        elif named:
            self.fail()
        self.type_parameters()
        if self.word("extends"):
            self.left_hand()
            if self.ts and self.is_op("<"):
                self.type_arguments()
        if self.ts and self.word("implements"):
            self.type()
            while self.op(","):
                self.type()
        self.need("{")
        while not self.op("}"):
            if self.k[self.p] == "e":
                self.fail()
            if not self.op(";"):
                self.member()

    # words in front of a member; each is the member's own name where a name's end follows
    FRONT = ("static", "async", "get", "set", "accessor")
    FRONT_TS = ("public", "private", "protected", "readonly", "abstract", "override", "declare")

    def member(self) -> None:
        self.decorators()
        words = set()
        while self.k[self.p] == "i" and (self.v[self.p] in self.FRONT or self.ts and self.v[self.p] in self.FRONT_TS):
            n = self.p + 1
            if self.k[n] == "o" and self.v[n] in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
                break
            if self.v[self.p] == "static" and self.v[n] == "{":
                self.p += 1
                self.body()
                return
            if self.nl[n] and self.v[self.p] in ("get", "set", "async", "accessor"):
                break
            words.add(self.v[self.p])
            self.p += 1
        star = self.op("*")
        if self.ts and self.is_op("[") and self.k[self.p + 1] == "i" and self.v[self.p + 2] == ":":
            self.index_signature()
            self.semicolon()
            return
        self.property_name(private=True)
        if self.ts:
            self.op("?")
            self.op("!")
        if self.is_op("(", "<"):
            self.signature()
            if self.is_op("{"):
                self.body()
            elif self.ts:
                self.semicolon()
            else:
                self.fail()
            return
        if star or words & {"get", "set", "async"}:
            self.fail()
        if self.ts and self.op(":"):
            self.type()
        if self.op("="):
            self.assignment()
        self.semicolon()

    # expressions

    def expression(self) -> None:
        self.assignment()
        while self.op(","):
            self.assignment()

    ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= &&= ||= ??=".split())

    def assignment(self) -> None:
        self.deeper()
        if not self.arrow():
            if self.is_word("yield"):
                self.p += 1
                if not (self.nl[self.p] or self.is_op(")", "]", "}", ",", ";", ":") or self.k[self.p] == "e"):
                    self.op("*")
                    self.assignment()
            else:
                target = self.conditional()
                if self.k[self.p] == "o":
                    v = self.v[self.p]
                    shift = 0
                    if v == ">":
                        j = self.p
                        while self.v[j + 1] == ">" and self.at[j + 1] == self.at[j] + 1:
                            j += 1
                        if j > self.p and self.v[j + 1] == "=" and self.at[j + 1] == self.at[j] + 1:
                            shift = j + 2 - self.p
                    if v in self.ASSIGN or shift:
                        if target == "other" or target == "pattern" and v != "=":
                            self.fail()
                        self.p += shift or 1
                        self.assignment()
        self.depth -= 1

    def arrow(self) -> bool:
        p = self.p
        q = p + 1 if self.is_word("async") and not self.nl[p + 1] and (self.v[p + 1] in ("(", "<") or self.k[p + 1] == "i" and self.v[p + 2] == "=>") else p
        if self.k[q] == "i" and self.v[q + 1] == "=>":
            self.p = q
            self.name()
        elif self.k[q] == "o" and self.v[q] == "(" and (self.v[self.partner[q] + 1] == "=>" or self.ts and self.v[self.partner[q] + 1] == ":") or self.ts and self.k[q] == "o" and self.v[q] == "<":
            self.p = q
            if not self.attempt(self.arrow_head):
                self.p = p
                return False
        else:
            return False
        if self.nl[self.p]:
            self.fail()
        self.need("=>")
        if self.is_op("{"):
            self.body()
        else:
            self.assignment()
        return True

    def arrow_head(self) -> None:
        self.signature()
        if not self.is_op("=>"):
            self.fail()

    def conditional(self) -> str:
        kind = self.binary()
        if self.is_op("?"):
            self.p += 1
            before, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = before
            self.need(":")
            self.assignment()
            return "other"
        return kind

    BINARY = frozenset("|| && ?? | ^ & == != === !== < <= << + - * / % **".split())

    def binary(self) -> str:
        if self.k[self.p] == "i" and self.v[self.p][0] == "#":
            self.p += 1
            self.need("in")
            self.unary()
            kind = "other"
        else:
            kind = self.unary()
        while True:
            k, v = self.k[self.p], self.v[self.p]
            if k == "o":
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
            elif k == "i":
                if v == "instanceof" or v == "in" and not self.no_in:
                    self.p += 1
                elif self.ts and v in ("as", "satisfies") and not self.nl[self.p]:
                    self.p += 1
                    if not self.word("const"):
                        self.type()
                    continue
                else:
                    return kind
            else:
                return kind
            self.unary()
            kind = "other"

    def unary(self) -> str:
        k, v = self.k[self.p], self.v[self.p]
        if k == "o":
            if v in ("+", "-", "!", "~"):
                self.p += 1
                self.deeper()
                self.unary()
                self.depth -= 1
                return "other"
            if v in ("++", "--"):
                self.p += 1
                if self.unary() != "target":
                    self.fail()
                return "other"
            if v == "<" and self.ts:
                self.p += 1
                self.type()
                self.need(">")
                self.unary()
                return "other"
        elif k == "i" and (v in ("typeof", "void", "delete") or v == "await" and self.starts_operand(self.p + 1)):
            self.p += 1
            self.unary()
            return "other"
        kind = self.left_hand()
        if self.is_op("++", "--") and not self.nl[self.p]:
            if kind != "target":
                self.fail()
            self.p += 1
            return "other"
        return kind

    def starts_operand(self, p: int) -> bool:
        return self.k[p] in "instrT" and self.v[p] not in ("in", "instanceof", "of", "as") or self.k[p] == "o" and self.v[p] in ("(", "[", "{", "!", "~", "+", "-", "++", "--")

    def arguments(self) -> None:
        self.need("(")
        before, self.no_in = self.no_in, False
        self.listed(")", self.argument)
        self.no_in = before

    def argument(self) -> None:
        self.op("...")
        self.assignment()

    def template(self) -> None:
        """``self.p`` is at its first part; the parts' expressions stand in brackets."""
        while True:
            whole = self.v[self.p] == "`"
            self.p += 1
            if whole:
                return
            self.need("(")
            self.expression()
            self.need(")")
            if self.k[self.p] != "T":
                self.fail()

    def left_hand(self) -> str:
        k, v = self.k[self.p], self.v[self.p]
        kind = "other"
        if k in "nsr":
            self.p += 1
        elif k == "t":
            self.template()
        elif k == "o":
            if v == "(":
                before, self.no_in = self.no_in, False
                self.p += 1
                p = self.p
                self.expression()
                kind = "target" if self.simple_target(p) else "other"
                self.need(")")
                self.no_in = before
            elif v == "[":
                self.array()
                kind = "pattern"
            elif v == "{":
                self.object()
                kind = "pattern"
            elif v == "@":
                self.decorators()
                self.class_(named=False)
            else:
                self.fail()
        elif k == "i":
            n = self.v[self.p + 1]
            if v == "function" or v == "async" and n == "function" and not self.nl[self.p + 1]:
                self.function(named=False)
                if self.v[self.p - 1] != "}":
                    self.fail()
            elif v == "class":
                self.class_(named=False)
            elif v == "new":
                self.p += 1
                if self.op("."):
                    self.need("target")
                else:
                    self.new()
            elif v == "import":
                self.p += 1
                if self.op("."):
                    self.any_word()
                else:
                    if not self.is_op("("):
                        self.fail()
                    self.arguments()
            elif v == "super":
                self.p += 1
                if not self.is_op("(", ".", "["):
                    self.fail()
            elif v in ("this", "null", "true", "false"):
                self.p += 1
            else:
                self.name()
                kind = "target"
        else:
            self.fail()
        return self.suffixes(kind)

    def simple_target(self, p: int) -> bool:
        """Whether the brackets from ``p`` on hold one member or name."""
        if self.k[p] != "i" or self.v[p] in ("typeof", "void", "delete", "new", "await", "function", "class", "async"):
            return self.k[p] == "o" and self.v[p] == "("
        depth = 0
        for i in range(p, self.p):
            if self.k[i] == "o":
                if self.v[i] in ("(", "["):
                    depth += 1
                elif self.v[i] in (")", "]"):
                    depth -= 1
                elif not depth and self.v[i] not in (".", "!"):
                    return False
            elif self.k[i] == "i" and not depth and i > p and self.v[i - 1] != "." and self.k[i - 1] != "i" and not self.ts:
                return False
        return self.v[self.p - 1] != ")" or self.p == p

    def suffixes(self, kind: str, calls: bool = True) -> str:
        while True:
            k, v = self.k[self.p], self.v[self.p]
            if k == "t":
                self.template()
                kind = "other"
                continue
            if k != "o":
                return kind
            if v == ".":
                self.p += 1
                if self.k[self.p] != "i":
                    self.fail()
                self.p += 1
                kind = "target"
            elif v == "?.":
                if not calls:
                    self.fail()
                self.p += 1
                if self.is_op("("):
                    self.arguments()
                elif self.op("["):
                    self.expression()
                    self.need("]")
                elif self.k[self.p] == "i":
                    self.p += 1
                elif self.ts and self.is_op("<"):
                    self.type_arguments()
                    self.arguments()
                else:
                    self.fail()
                kind = "other"
            elif v == "[":
                self.p += 1
                before, self.no_in = self.no_in, False
                self.expression()
                self.no_in = before
                self.need("]")
                kind = "target"
            elif v == "(" and calls:
                self.arguments()
                kind = "other"
            elif v == "!" and self.ts and not self.nl[self.p]:
                self.p += 1
            elif v == "<" and self.ts:
                if not self.attempt(self.applied):
                    return kind
                kind = "other"
            else:
                return kind

    def applied(self) -> None:
        self.type_arguments()
        if self.k[self.p] == "t" or self.is_op("("):
            return
        if self.k[self.p] in "ins" and not self.nl[self.p] or self.is_op("[", "{", "-", "+", "!", "~"):
            self.fail()

    def new(self) -> None:
        if self.word("new"):
            if self.op("."):
                self.need("target")
            else:
                self.new()
        else:
            k, v = self.k[self.p], self.v[self.p]
            if k == "o" and v == "(":
                self.parenthesized()
            elif k == "i" and v == "class":
                self.class_(named=False)
            elif k == "i" and v == "function":
                self.function(named=False)
            elif k == "i" and v in ("this", "super"):
                self.p += 1
            elif k == "i" and v == "import" and self.v[self.p + 1] == ".":
                self.p += 3
            else:
                self.name()
        self.suffixes("target", calls=False)
        if self.is_op("("):
            self.arguments()

    def array(self) -> None:
        self.need("[")
        before, self.no_in = self.no_in, False
        while not self.op("]"):
            if self.op(","):
                continue
            self.argument()
            if not self.op(","):
                self.need("]")
                break
        self.no_in = before

    def object(self) -> None:
        self.need("{")
        before, self.no_in = self.no_in, False
        self.listed("}", self.object_property)
        self.no_in = before

    def object_property(self) -> None:
        if self.op("..."):
            self.assignment()
            return
        words = set()
        while self.is_word("async", "get", "set"):
            n = self.p + 1
            if self.k[n] == "o" and self.v[n] in ("(", ",", ":", "}", "=", "<"):
                break
            words.add(self.v[self.p])
            self.p += 1
        star = self.op("*")
        plain = self.is_name()
        self.property_name()
        if self.is_op("(", "<"):
            self.signature()
            self.body()
        elif star or words:
            self.fail()
        elif self.op(":"):
            self.assignment()
        elif plain:
            if self.op("="):
                self.assignment()
        else:
            self.fail()

    # types

    def type_parameters(self) -> None:
        if not self.ts or not self.op("<"):
            return
        while True:
            while self.is_word("const", "in", "out") and self.k[self.p + 1] == "i":
                self.p += 1
            self.name()
            if self.word("extends"):
                self.type()
            if self.op("="):
                self.type()
            if not self.op(",") or self.is_op(">"):
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.op(",") or self.is_op(">"):
                break
        self.need(">")

    def return_type(self) -> None:
        if self.is_word("asserts") and self.k[self.p + 1] == "i" and not self.nl[self.p + 1] and self.v[self.p + 1] != "is":
            self.p += 2
            if self.word("is"):
                self.type()
        elif self.k[self.p] == "i" and self.v[self.p + 1] == "is" and not self.nl[self.p + 1]:
            self.p += 2
            self.type()
        else:
            self.type()

    def type(self) -> None:
        self.deeper()
        if self.function_type():
            self.depth -= 1
            return
        self.union()
        if self.is_word("extends") and not self.nl[self.p]:
            self.p += 1
            self.union_or_function()
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        self.depth -= 1

    def union_or_function(self) -> None:
        if not self.function_type():
            self.union()

    def function_type(self) -> bool:
        p = self.p
        if self.is_word("abstract") and self.v[p + 1] == "new":
            self.p += 1
        new = self.word("new")
        if self.is_op("<") or self.is_op("(") and self.v[self.partner[self.p] + 1] == "=>":
            if self.attempt(self.function_type_head):
                self.return_type()
                return True
        if new:
            self.fail()
        self.p = p
        return False

    def function_type_head(self) -> None:
        self.type_parameters()
        self.parameters()
        self.need("=>")

    def union(self) -> None:
        self.op("|") or self.op("&")
        self.postfix_type()
        while self.is_op("|", "&"):
            self.p += 1
            if not self.function_type():
                self.postfix_type()

    def postfix_type(self) -> None:
        if self.is_word("keyof", "unique", "readonly", "infer") and (self.k[self.p + 1] in "ist" or self.v[self.p + 1] in ("(", "[", "{")):
            infer = self.v[self.p] == "infer"
            self.p += 1
            self.postfix_type()
            if infer and self.is_word("extends"):
                self.attempt(self.infer_bound)
            return
        self.primary_type()
        while self.is_op("[") and not self.nl[self.p]:
            self.p += 1
            if not self.op("]"):
                self.type()
                self.need("]")

    def infer_bound(self) -> None:
        self.need("extends")
        self.union()
        if self.is_op("?"):
            self.fail()

    def primary_type(self) -> None:
        k, v = self.k[self.p], self.v[self.p]
        if k in "ns":
            self.p += 1
        elif k == "t":
            while True:
                whole = self.v[self.p] == "`"
                self.p += 1
                if whole:
                    return
                self.need("(")
                self.type()
                self.need(")")
        elif k == "o":
            if v == "(":
                self.p += 1
                self.type()
                self.need(")")
            elif v == "[":
                self.p += 1
                self.listed("]", self.tuple_item)
            elif v == "{":
                self.object_type()
            elif v == "-" and self.k[self.p + 1] == "n":
                self.p += 2
            else:
                self.fail()
        elif k == "i":
            if v == "typeof":
                self.p += 1
                if self.word("import"):
                    self.arguments()
                else:
                    self.any_word()
                while self.op("."):
                    self.p += 1
                if self.is_op("<") and not self.nl[self.p]:
                    self.type_arguments()
            elif v == "import":
                self.p += 1
                self.need("(")
                self.type()
                if self.op(","):
                    self.object()
                self.need(")")
                while self.op("."):
                    self.any_word()
                if self.is_op("<"):
                    self.type_arguments()
            elif v in ("void", "null", "this", "true", "false"):
                self.p += 1
            elif v in RESERVED and v not in SOFT:
                self.fail()
            else:
                self.p += 1
                while self.op("."):
                    self.any_word()
                if self.is_op("<") and not self.nl[self.p]:
                    self.type_arguments()
        else:
            self.fail()

    def tuple_item(self) -> None:
        self.op("...")
        if self.k[self.p] == "i" and (self.v[self.p + 1] == ":" or self.v[self.p + 1] == "?" and self.v[self.p + 2] == ":"):
            self.p += 1
            self.op("?")
            self.need(":")
        self.type()
        self.op("?")

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.need(":")
        self.type()

    def mapped_type(self) -> None:
        self.need("{")
        if self.is_op("+", "-"):
            self.p += 1
            self.need("readonly")
        else:
            self.word("readonly")
        self.need("[")
        self.name()
        self.need("in")
        self.type()
        if self.word("as"):
            self.type()
        self.need("]")
        if self.is_op("+", "-"):
            self.p += 1
            self.need("?")
        else:
            self.op("?")
        if self.op(":"):
            self.type()
        self.op(";") or self.op(",")
        self.need("}")

    def object_type(self) -> None:
        if self.attempt(self.mapped_type):
            return
        self.need("{")
        while not self.op("}"):
            self.type_member()
            if not (self.op(";") or self.op(",") or self.is_op("}") or self.nl[self.p]):
                self.fail()

    def type_member(self) -> None:
        while self.is_word("readonly", "get", "set") and (self.k[self.p + 1] in "isn" or self.v[self.p + 1] == "["):
            self.p += 1
        if self.is_op("(", "<"):
            self.signature()
            return
        if self.is_word("new") and self.v[self.p + 1] in ("(", "<"):
            self.p += 1
            self.signature()
            return
        if self.is_op("[") and self.k[self.p + 1] == "i" and self.v[self.p + 2] == ":":
            self.index_signature()
            return
        self.property_name()
        self.op("?")
        if self.is_op("(", "<"):
            self.signature()
        elif self.op(":"):
            self.type()

    def interface(self) -> None:
        self.need("interface")
        self.name()
        self.type_parameters()
        if self.word("extends"):
            self.type()
            while self.op(","):
                self.type()
        self.object_type()

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        self.listed("}", self.enum_item)

    def enum_item(self) -> None:
        self.property_name()
        if self.op("="):
            self.assignment()


# words that begin a statement wherever a line begins with them behind a closing brace
_BEGIN = frozenset("function class const var export import".split())


def statements(found: tuple) -> list[tuple[int, int]]:
    """Token spans of one or more whole top-level statements each.

    A span ends behind a semicolon, or behind a closing brace where the next
    line begins with a word that can only begin a statement.
    """
    kinds, values, _, newline = found
    out, depth, start = [], 0, 0
    for i, v in enumerate(values):
        if i > start and depth == 0 and kinds[i - 1] == "o":
            last = values[i - 1]
            if last == ";":
                new = kinds[i] != "i" or v not in ("else", "while")
            else:
                new = last == "}" and newline[i] and kinds[i] == "i" and v in _BEGIN and not (v == "import" and values[i + 1 : i + 2] in (["("], ["."]))
            if new:
                out.append((start, i))
                start = i
        if kinds[i] == "o":
            if v in ("(", "[", "{"):
                depth += 1
            elif v in (")", "]", "}"):
                depth -= 1
    if start < len(values):
        out.append((start, len(values)))
    return out


def check(found: tuple, ts: bool, deep: bool = False) -> None:
    """Raises :class:`Invalid` unless the tokens are statements of a module."""
    cursor = Script(found, ts)
    if deep:
        cursor.MAX_DEPTH = math.inf
    cursor.module()
