"""A recogniser for bracketed languages: grammars in EBNF over token classes.

A masked text (``lexing.mask``) becomes a string of one character for each
token. Bracket groups are then reduced from the inside outwards: the content
of a group is matched with every rule that the grammar has for its kind of
bracket, and the group is replaced by one character that stands for the set of
rules it follows (as parameters, as arguments, as a block ...). So each rule is
a regular expression over a string without brackets, and together they are a
context-free grammar. A group that follows none of its rules, or a top level
that does not follow the top rule, makes the text invalid. Contents that were
met before are looked up, so most groups cost no match at all.
"""

from __future__ import annotations

import re

import regex

from codelake.llm.lexing import BAD, LIT

TICK = "\x0e"  # stands for a template literal
NUM = "n"  # stands for a number
_WORDY = re.compile(r"[^\W\d]")
_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_']+(?:\.[\da-fA-F_']*)?(?:[pP][+-]?\d+)?|0[bB][01_']+|0[oO][0-7_]+|(?:\d[\d_']*)?\.?\d[\d_']*(?:[eE][+-]?\d[\d_]*)?\.?)(?:[uUlLnNfFdDmMijr]|usize|isize|LL|UL|ULL|uL|[uif](?:8|16|32|64|128))*")
_NOTATION = re.compile(r"'([^'\s]+|')'|<([^<>]*)>|([A-Za-z_]\w*)|(\(\?[=!:>]|\(\?<[=!]|\()|(\S)|\s+")
_INNER = re.compile(r"([(\[{])([^()\[\]{}]*)[)\]}]")
_PART = re.compile("[^;\n\ue800-\uebff]+[;\n]")  # up to a semicolon or line break, without a curly group
_EMPTY = re.compile(";{2,}")
_PAIR = {"(": ")", "[": "]", "{": "}"}
_BASE = {"(": 0xE000, "[": 0xE400, "{": 0xE800}
_KNOWN_LIMIT = 200_000


class Invalid(Exception):
    """The text does not follow the grammar."""


class _Classes(dict):
    """Token -> class character; names, numbers and literals are classed when first met."""

    def __missing__(self, token: str) -> str:
        c = token[0]
        if len(token) > 1 and token[-1] == ":":
            got = self.labels
        elif len(token) > 1 and c == ":":
            got = LIT
        elif c in (LIT, TICK):
            got = c
        elif _WORDY.match(c) or c in "$`@":
            got = "i"
        elif (c.isdigit() or c == ".") and _NUMBER.fullmatch(token):
            got = NUM
        else:
            got = BAD
        if len(self) < 50_000:
            self[token] = got
        return got


class Grammar:
    """One language.

    ``words``: reserved words; ``soft``: words with a meaning of their own that may also be names; ``signs``: signs of
    more than one character, the longest first. ``rules``: name -> EBNF, where a name that starts with ``P_``, ``S_`` or
    ``B_`` is a reading of a round, square or curly group and others are fragments, and
    ``TOP`` is the whole. In EBNF, ``'x'`` is a sign, ``<a b>`` one of several tokens, a word in lower case a reserved or
    soft word, a word in upper case a rule; ``( ) | * + ?`` are as in regular expressions. ``ID`` is a name, ``LIT`` a
    literal, ``STR`` one that is no number, ``NL`` a line break. ``ends`` and ``begins``: tokens after and before which a line break counts; without them line breaks
    are blank space. ``generic``: what may stand between angle brackets. ``before``: pairs of EBNF and token, each a
    sequence of tokens that counts as that token, such as the name of an operator. ``STEP`` and ``LEAD``: a statement that holds no other
    one, and what may stand before it. ``wider``: a rule that takes all that ``B_s`` takes. ``bare_heads``: semicolons of
    loops stand outside of brackets. ``closed``: every statement ends with a semicolon or a curly group. ``extra``: a pattern of tokens that come first - with a colon in front they are literals, with one
    at the end the given token.
    """

    def __init__(self, words: str, soft: str, signs: str, rules: dict[str, str], ends: str = "", begins: str = "", not_before: str = "", generic: str = "", number: str = "", extra: tuple[str, str] = ("", ""), before: tuple[tuple[str, str], ...] = (), wider: str = "", bare_heads: bool = False, closed: bool = False):
        code = iter(range(0x1000, 0x2000))
        self.chars = {w: chr(next(code)) for w in (words + " " + soft + " " + signs).split() if len(w) > 1 or w.isalpha() or w == "_"}
        spoken = [self.chars[w] for w in (words + " " + soft).split()]
        self.soft = "".join(self.chars[w] for w in soft.split())
        self.table = _Classes(self.chars)
        for c in "()[]{};,.:?=<>+-*/%&|^!~@#\\'":
            self.table.setdefault(c, c)
        self.table["\n"] = "\n"
        first = f"{extra[0]}|" if extra[0] else ""
        self.table.labels = self.chars.get(extra[1], "i")
        many = "|".join(re.escape(s) for s in sorted((s for s in signs.split() if len(s) > 1), key=len, reverse=True))
        number = number or r"0[xXbBoO][\w']+|\d[\d_']*(?:\.\d[\d_']*)?(?:[eE][+-]?\d+)?[A-Za-z]\w*|\d[\d_']*(?:\.\d[\d_']*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?\w*"
        self.tokens = re.compile(rf"{first}[^\W\d][\w$]*|\$[\w$]*|`[^`\n]*`|{number}|{many}|[^\s\w]|\n" if ends else rf"{first}[^\W\d][\w$]*|\$[\w$]*|`[^`\n]*`|{number}|{many}|[^\s\w]")
        self.known: dict[tuple[str, str], str] = {}
        names: dict[str, list[str]] = {"(": [], "[": [], "{": []}
        for name in rules:
            if name[:2] in ("P_", "S_", "B_"):
                names[{"P": "(", "S": "[", "B": "{"}[name[0]]].append(name)
        self.parts: dict[str, str] = {"ID": f"[i{re.escape(self.soft)}]", "LIT": f"[{LIT}{TICK}{NUM}]", "STR": f"[{LIT}{TICK}]", "TICK": TICK, "NL": "\n", "GEN": "\x0f?", "GEN1": "\x0f", "TERN": "\x10", "EOS": r"\Z", "ANY": "[^;]", "ALL": r"[\s\S]", "EMPTY": "", "GRP": "[\ue000-\uefff]", "WORD": f"[i{spoken[0]}-{spoken[-1]}]" if spoken else "i"}
        for bracket, kinds in names.items():
            for j, name in enumerate(kinds):
                starts = range(1 << j, 1 << len(kinds), 2 << j)  # the sets with bit j, as ranges
                self.parts[name] = "[" + "".join(f"{chr(_BASE[bracket] + m)}-{chr(_BASE[bracket] + m + (1 << j) - 1)}" if j else chr(_BASE[bracket] + m) for m in starts) + "]"
        self.defined: dict[str, str] = {}
        fragments = [name for name in rules if name[:2] not in ("P_", "S_", "B_") and name != "TOP"]
        if any(len(k) > 10 for k in names.values()):
            raise ValueError("too many readings of a bracket")
        self.parts |= {name: f"(?&{name})" for name in fragments}
        for name in fragments:
            self.defined[name] = self.compile(rules[name])
        self.top = self.whole(self.compile(rules["TOP"]))
        self.rules = {b: [(self.whole(self.compile(rules[name])), name in ("B_s", "B_w"), kinds.index("B_s") if name == wider else -1) for name in kinds] for b, kinds in names.items()}
        self.step = self.whole(f"(?P<before_>{self.parts['LEAD']})({self.parts['STEP']})[;\n]") if "STEP" in rules else None
        self.steps: dict[str, str] = {}
        self.bare_heads, self.closed = bare_heads, closed
        self.steps_on_top = "STMT" in rules["TOP"]
        self.before = [(self.whole(self.compile(a)), self.chars.get(b, b)) for a, b in before]
        self.breaks = re.compile(self.break_rule(ends, begins, not_before)) if ends else None
        self.generic = re.compile(f"<{self.one_of(generic)}*>") if generic else None
        self.ternary = self.whole(rf"\?{self.parts['TERNARY']}:") if "TERNARY" in rules else None

    def break_rule(self, ends: str, begins: str, not_before: str) -> str:
        """Line breaks that are blank space: not after a token of ``ends``, or not before one of ``begins`` (or before one of ``not_before``)."""
        after = self.one_of(ends)
        before = f"(?={self.one_of(begins)})" if begins else f"(?!{self.one_of(not_before)}|\\Z)"
        return rf"(?<!{after})\n+|\n+(?!{before})"

    def whole(self, source: str) -> regex.Pattern[str]:
        """Pattern of a source with the fragments it calls."""
        needed: dict[str, str] = {}
        left = [source]
        while left:
            for name in re.findall(r"\(\?&(\w+)\)", left.pop()):
                if name not in needed:
                    needed[name] = self.defined[name]
                    left.append(self.defined[name])
        return regex.compile("".join(f"(?(DEFINE)(?P<{n}>{t}))" for n, t in needed.items()) + f"(?:{source})")

    def one_of(self, tokens: str) -> str:
        """Class of the characters of several tokens."""
        out = ""
        for t in tokens.split():
            got = self.parts.get(t)
            out += (got[1:-1] if got[0] == "[" else got) if got else re.escape(self.chars.get(t, t))
        return f"[{out}]"

    def compile(self, text: str) -> str:
        """EBNF -> source of a regular expression."""
        def put(m: re.Match[str]) -> str:
            sign, several, word, opening, other = m.groups()
            if sign:
                return re.escape(self.chars.get(sign, sign))
            if several is not None:
                return self.one_of(several)
            if word:
                if word in self.parts:
                    return self.parts[word]
                if word in self.chars:
                    return self.chars[word]
                raise KeyError(word)
            if opening:
                return "(?:" if opening == "(" else opening
            return other or ""
        return _NOTATION.sub(put, text)

    def reading(self, bracket: str, content: str) -> str:
        """The character for a group: the set of rules its content follows."""
        got = self.known.get((bracket, content))
        if got is None:
            flat = self.flat(content)
            short = self.shortened(flat) if bracket == "{" else flat
            mask = 0
            open_end = self.closed and flat[-1:] not in ("", ";", ":") and not "\ue800" <= flat[-1] <= "\uebff"
            for k, (rule, steps, follows) in enumerate(self.rules[bracket]):
                if steps and open_end:
                    continue
                if (follows >= 0 and mask >> follows & 1) or rule.fullmatch(short if steps else flat):
                    mask |= 1 << k
            got = chr(_BASE[bracket] + mask) if mask else ""
            if len(self.known) > _KNOWN_LIMIT:
                self.known.clear()
            self.known[bracket, content] = got
        return got

    def shortened(self, content: str) -> str:
        """Statements without their simple parts: each becomes an empty statement, and how a part reads is looked up."""
        if not self.step:
            return content
        content = _PART.sub(self.shorter, content)
        return content if self.bare_heads else _EMPTY.sub(";", content)

    def shorter(self, m: re.Match[str]) -> str:
        part = m[0]
        got = self.steps.get(part)
        if got is None:
            n = self.step.fullmatch(part)
            got = n["before_"] + ";" if n else part
            if len(self.steps) > _KNOWN_LIMIT:
                self.steps.clear()
            self.steps[part] = got
        return got

    def flat(self, content: str) -> str:
        """Content with type arguments and conditional operators reduced."""
        if self.generic and "<" in content:
            n = 0
            while n != len(content):
                n = len(content)
                content = self.generic.sub("\x0f", content)
        if self.ternary and "?" in content:
            n = 0
            while n != len(content):
                n = len(content)
                content = self.ternary.sub("\x10", content)
        return content

    def classes(self, masked: str) -> str:
        """The string of token classes of a masked text."""
        s = "".join(map(self.table.__getitem__, self.tokens.findall(masked)))
        for pattern, token in self.before:
            s = pattern.sub(token, s)
        if self.breaks:
            s = re.sub(r"\n+", "\n", self.breaks.sub("", s)).strip("\n")
        return s

    def reduced(self, s: str) -> str:
        """Token classes with every group reduced; raises ``Invalid``."""
        def put(m: re.Match[str]) -> str:
            if m[0][-1] != _PAIR[m[1]]:
                raise Invalid
            got = self.reading(m[1], m[2])
            if not got:
                raise Invalid
            return got

        n = 0
        while n != len(s):
            n = len(s)
            s = _INNER.sub(put, s)
        if any(c in s for c in "()[]{}"):
            raise Invalid
        return self.flat(s)

    def accepts(self, masked: str) -> bool:
        """Whether a masked text follows the grammar."""
        s = self.classes(masked)
        if BAD in s:
            return False
        try:
            r = self.reduced(s)
            return self.top.fullmatch(self.shortened(r) if self.steps_on_top else r) is not None
        except Invalid:
            return False
        except RecursionError:
            return True
