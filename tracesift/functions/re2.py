"""Patterns in RE2's syntax as Java patterns of the same meaning.

RE2 knows ASCII classes, no look-around and no back references; ``.`` and ``$`` heed ``\\n`` only, and ``$`` is the very end unless in
multi-line mode. What RE2 refuses is refused here too. The translation is one pass over the pattern.
"""

from __future__ import annotations

import re


class PatternError(ValueError):
    pass


#: The named ASCII classes, by their members in Java.
NAMED = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Members of RE2's one-letter classes; its white space has no vertical tab.
CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r\x20"}
#: Escapes for single characters.
ESCAPES = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
INSIDE = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
#: Largest number of a counted repetition.
MOST = 1000


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def fail(self, why: str):
        raise PatternError(f"bad pattern {self.p!r}: {why}")

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def take(self, regex: str) -> re.Match | None:
        m = re.compile(regex, re.S).match(self.p, self.i)
        if m:
            self.i = m.end()
        return m

    def character(self) -> str | None:
        """The code point of an escape for one character, as a Java escape; None where it's another kind. Stands after the backslash."""
        if m := self.take(r"x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})"):
            code = int(m[1] or m[2], 16)
            if code > 0x10FFFF:
                self.fail("no such code point")
            return f"\\x{{{code:X}}}"
        if m := self.take(r"0[0-7]{0,2}|[1-7][0-7]{1,2}"):
            return f"\\x{{{int(m[0], 8):X}}}"
        if m := self.take(f"[{''.join(ESCAPES)}]"):
            return ESCAPES[m[0]]
        if m := self.take(r"[^0-9A-Za-z\x80-\U0010FFFF]"):
            return "\\" + m[0] if m[0] != "_" else "_"
        return None

    def group(self) -> str | None:
        """Members of a class escape (of letters, Perl's or Unicode's), for use within brackets. Stands after the backslash."""
        if m := self.take(r"[dws]"):
            return CLASSES[m[0]]
        if m := self.take(r"[DWS]"):
            return f"[^{CLASSES[m[0].lower()]}]"
        if m := self.take(r"([pP])(?:\{(\^?)(\w+)\}|([A-Z]))"):
            name = m[3] or m[4]
            negative = (m[1] == "P") != bool(m[2])
            if name == "Any":
                return r"[^\x{0}-\x{10FFFF}]" if negative else r"\x{0}-\x{10FFFF}"
            return f"\\{'P' if negative else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
        return None


def java(pattern: str) -> str:
    """The pattern for Java's engine; PatternError where RE2 would refuse it."""
    r, out = _Reader(pattern), []
    flags, stack = {"i": False, "m": False, "s": False, "U": False}, []
    last = ""  # what a repetition would apply to: "" nothing, "one" an item, "many" a repetition
    while r.i < len(pattern):
        c = pattern[r.i]
        r.i += 1
        if c == "\\":
            if r.take(r"Q"):
                m = r.take(r"(.*?)(?:\\E|\Z)")
                out += [re.sub(r"([^0-9A-Za-z_])", r"\\\1", x) for x in m[1]]
                last = "one" if m[1] else last
                continue
            if r.take("E"):
                continue
            if m := r.take(r"[AzbB]"):
                out.append({"A": r"\A", "z": r"\z", "b": EDGE, "B": INSIDE}[m[0]])
            elif (x := r.group()) is not None:
                out.append(f"[{x}]")
            elif (x := r.character()) is not None:
                out.append(x)
            else:
                r.fail(f"unknown escape \\{r.peek()}")
            last = "one"
        elif c == "[":
            out.append(_brackets(r))
            last = "one"
        elif c == "(":
            stack.append(dict(flags))
            if r.peek() != "?":
                out.append("(")
            elif r.take(r"\?P?<([A-Za-z_][0-9A-Za-z_]*)>"):
                out.append("(")  # the name has no part in whether it matches
            elif m := r.take(r"\?([imsU]*)(?:-([imsU]+))?([:)])"):
                new = dict(flags) | {f: True for f in m[1]} | {f: False for f in m[2] or ""}
                if m[3] == ")":
                    stack.pop()
                    flags = new
                    out.append(_switch(new))
                    last = ""
                    continue
                flags = new
                out.append("(?:" + _switch(new))
            else:
                r.fail("look-around, atomic groups and the like aren't known")
            last = ""
        elif c == ")":
            if not stack:
                r.fail("unexpected )")
            flags = stack.pop()  # switches inside reach to the group's end only, as in Java
            out.append(")")
            last = "one"
        elif c == "|":
            out.append("|")
            last = ""
        elif c in "*+?" or c == "{" and re.match(r"\d+(?:,\d*)?\}", pattern[r.i :]):
            text = c
            if c == "{":
                m = r.take(r"(\d+)(,?)(\d*)\}")
                low, high = int(m[1]), int(m[3] or m[1])
                if low > MOST or high > MOST or high < low:
                    r.fail("bad counts")
                text = "{" + m[0]
            if not last:
                r.fail("nothing to repeat")
            if last == "many":
                r.fail("a repetition of a repetition")
            lazy = bool(r.take(r"\?"))
            out.append(text + ("?" if lazy != flags["U"] else ""))
            last = "many"
        elif c == "^":
            out.append(r"(?:\A|(?<=\n))" if flags["m"] else r"\A")
            last = "one"
        elif c == "$":
            out.append(r"(?=\n|\z)" if flags["m"] else r"\z")
            last = "one"
        elif c == ".":
            out.append(r"[\x{0}-\x{10FFFF}]" if flags["s"] else r"[^\n]")
            last = "one"
        else:
            out.append("\\" + c if c in "{}]" else c)
            last = "one"
    if stack:
        r.fail("missing )")
    return "".join(out)


def _switch(flags: dict[str, bool]) -> str:
    return "(?iu)" if flags["i"] else "(?-iu)"


def _brackets(r: _Reader) -> str:
    """A bracket expression; stands after the bracket. Java reads more signs within it as its own, so all are escaped."""
    negative, items, first = bool(r.take(r"\^")), [], True
    while True:
        if r.i >= len(r.p):
            r.fail("missing ]")
        if r.peek() == "]" and not first:
            r.i += 1
            break
        first = False
        if m := r.take(r"\[:(\^?)(\w+):\]"):
            if m[2] not in NAMED:
                r.fail(f"no class {m[2]}")
            items.append(f"[^{NAMED[m[2]]}]" if m[1] else NAMED[m[2]])
            continue
        low = _member(r)
        if isinstance(low, list):
            items += low
            continue
        if r.peek() == "-" and r.peek(2) not in ("-]", "-"):
            r.i += 1
            high = _member(r)
            if isinstance(high, list) or high < low:
                r.fail("bad range")
            items.append(f"\\x{{{low:X}}}-\\x{{{high:X}}}")
        else:
            items.append(f"\\x{{{low:X}}}")
    # a negative class of classes: none of them, each put as a look-ahead would be; Java's own union is kept apart
    inner = "".join(items)
    return f"(?:(?![{inner}])[\\x{{0}}-\\x{{10FFFF}}])" if negative else f"[{inner}]"


def _member(r: _Reader) -> int | list[str]:
    """One character's code point, or the members of a class."""
    c = r.peek()
    r.i += 1
    if c != "\\":
        return ord(c)
    if (x := r.group()) is not None:
        return [x]
    if (x := r.character()) is not None:
        if m := re.fullmatch(r"\\x\{?([0-9A-F]+)\}?", x):
            return int(m[1], 16)
        return {r"\f": 12, r"\t": 9, r"\n": 10, r"\r": 13}.get(x, ord(x[-1]))
    r.fail(f"unknown escape \\{r.peek()}")
