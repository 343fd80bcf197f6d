"""What the local grammars share: a token list with matched brackets."""

from __future__ import annotations


class Invalid(Exception):  # noqa: N818
    """The source is not valid."""


class Unfinished(Invalid):
    """The text ends within a comment or literal: its state, and the tokens in front of it."""

    def __init__(self, state: str, *found: list) -> None:
        super().__init__("end within", state)
        self.state = state
        self.found = found


OPEN = {"(": ")", "[": "]", "{": "}"}


def matched(values: list[str], kinds: list[str]) -> list[int]:
    """For each bracket the index of its partner, else -1."""
    partner = [-1] * len(values)
    stack: list[int] = []
    for i, v in enumerate(values):
        if kinds[i] == "o":
            if v in OPEN:
                stack.append(i)
            elif v in (")", "]", "}"):
                if not stack or OPEN[values[stack[-1]]] != v:
                    raise Invalid("bracket", i)
                j = stack.pop()
                partner[i], partner[j] = j, i
    if stack:
        raise Invalid("open bracket", stack[-1])
    return partner


class Cursor:
    """Reading position over tokens; kinds are i(dentifier), n(umber), s(tring), r(egex), t(emplate), o(perator), e(nd)."""

    def __init__(self, kinds: list[str], values: list[str], starts: list[int], newline: list[bool]) -> None:
        self.partner = [*matched(values, kinds), -1, -1, -1]
        self.k = [*kinds, "e", "e", "e"]
        self.v = [*values, "", "", ""]
        self.at = [*starts, -1, -1, -1]
        self.nl = [*newline, True, True, True]
        self.p = 0
        self.depth = 0

    def fail(self) -> None:
        raise Invalid("token", self.p, self.v[self.p])

    def op(self, v: str) -> bool:
        """Takes the operator, if it is next."""
        if self.v[self.p] == v and self.k[self.p] == "o":
            self.p += 1
            return True
        return False

    def is_op(self, *vs: str) -> bool:
        return self.k[self.p] == "o" and self.v[self.p] in vs

    def need(self, v: str) -> None:
        if self.v[self.p] != v or self.k[self.p] not in "oi":
            self.fail()
        self.p += 1

    def word(self, v: str) -> bool:
        if self.v[self.p] == v and self.k[self.p] == "i":
            self.p += 1
            return True
        return False

    def is_word(self, *vs: str) -> bool:
        return self.k[self.p] == "i" and self.v[self.p] in vs

    def attempt(self, rule, *args) -> bool:
        """Tries a rule; on failure the position is as before."""
        p, d = self.p, self.depth
        try:
            rule(*args)
        except Invalid:
            self.p, self.depth = p, d
            return False
        return True
