"""Lexical masking of source text, one profile for each language.

``mask(language, text)`` blanks comments and replaces every literal by the
placeholder ``LIT`` while keeping each line break, so later stages can read
structure with plain regular expressions and still count lines. A literal or
comment that never ends leaves a mark that ``broken`` finds.
"""

from __future__ import annotations

import re

LIT = "\x01"  # stands for a string, character or pattern literal
BAD = "\x02"  # stands for a literal or comment without an end

_LINE = r"//[^\n]*"
_BLOCK = r"/\*[\s\S]*?(?:\*/|(?P<e1>\Z))"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?P<e2>(?=\n)|\Z))'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*(?:'|(?P<e3>(?=\n)|\Z))"
_CHAR = r"'(?:[^'\\\n]|\\(?:u\{?[0-9A-Fa-f]+\}?|x[0-9A-Fa-f]+|[0-7]{1,3}|U[0-9A-Fa-f]+|.))'|(?P<e3>')"
_TRIPLE_DQ = r'"""[\s\S]*?(?:"""|(?P<e4>\Z))'
_TRIPLE_SQ = r"'''[\s\S]*?(?:'''|(?P<e5>\Z))"
_TICK = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`(?:[^`\\]|\\[\s\S])*`)*\})*(?:`|(?P<e6>\Z))"
_JS_PATTERN = r"(?P<keep>(?:^|[=(,:;!&|?{}\[+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw))[ \t]*)/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"

_JS = (_LINE, _BLOCK, _DQ, _SQ, _TICK, _JS_PATTERN)
_PARTS = {
    "javascript": _JS,
    "typescript": _JS,
    "dart": (_LINE, _BLOCK, r"\br(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*\"|'[^'\n]*')", _TRIPLE_DQ, _TRIPLE_SQ, _DQ, _SQ),
    "rust": (_LINE, _BLOCK, r'\bb?r(?P<hash>#*)"[\s\S]*?(?:"(?P=hash)|(?P<e7>\Z))', r'(?:\bb)?"(?:[^"\\]|\\[\s\S])*(?:"|(?P<e2>\Z))', r"(?:\bb)?'(?:[^'\\\n]|\\(?:u\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]+|.))'", r"(?P<keep>'(?=[A-Za-z_]))", r"(?P<e3>')"),
    "go": (_LINE, _BLOCK, _DQ, r"`[^`]*(?:`|(?P<e6>\Z))", _CHAR),
    "java": (_LINE, _BLOCK, _TRIPLE_DQ, _DQ, _CHAR),
    "cpp": (_LINE, _BLOCK, r'\b(?:u8|u|U|L)?R"(?P<raw>[^()\\\s]{0,16})\([\s\S]*?(?:\)(?P=raw)"|(?P<e7>\Z))', r"(?m:^[ \t]*#[ \t]*include[^\n]*)", _DQ, r"(?P<keep>(?<=[0-9A-Fa-f])'(?=[0-9A-Fa-f]))", _CHAR),
    "csharp": (_LINE, _BLOCK, _TRIPLE_DQ, r'\$?@\$?"(?:[^"]|"")*(?:"|(?P<e7>\Z))', r"(?m:^[ \t]*#(?:region|endregion|if|else|elif|endif|define|undef|pragma|nullable|line|warning|error)\b[^\n]*)", r'\$?"(?:[^"\\\n]|\\.)*(?:"|(?P<e2>(?=\n)|\Z))', _CHAR),
    "swift": (_LINE, _BLOCK, r'(?P<hash>#+)"[\s\S]*?(?:"(?P=hash)|(?P<e7>\Z))', _TRIPLE_DQ, _DQ),
    "kotlin": (_LINE, _BLOCK, _TRIPLE_DQ, _DQ, _CHAR),
    "ruby": (
        r"(?m:^=begin\b[\s\S]*?^=end\b[^\n]*)", r"#[^\n]*", r"<<[~-]?(?P<q>['\"]?)(?P<here>[A-Z_][A-Z0-9_]*)(?P=q)[^\n]*\n[\s\S]*?(?:(?m:^[ \t]*(?P=here)$)|(?P<e7>\Z))",
        r"%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})(?=[\s,;.)\]]|\Z)", r'"(?:[^"\\]|\\[\s\S])*(?:"|(?P<e2>\Z))', r"'(?:[^'\\]|\\[\s\S])*(?:'|(?P<e3>\Z))", r"`[^`\n]*(?:`|(?P<e6>(?=\n)|\Z))",
        r"(?P<keep>(?:^|[=(,!&|?{\[~]|\b(?:if|unless|when|and|or|not|return))[ \t]*)/(?![/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
    ),
    "sql": (r"--[^\n]*", _BLOCK, r"\$(?P<tag>[A-Za-z_]\w*|)\$[\s\S]*?(?:\$(?P=tag)\$|(?P<e7>\Z))", r"\b[Ee]'(?:[^'\\]|\\[\s\S]|'')*(?:'|(?P<e4>\Z))", r"'(?:[^']|'')*(?:'|(?P<e3>\Z))", r'"(?:[^"]|"")*(?:"|(?P<e2>\Z))'),
    "python": (r"#[^\n]*", r"\b[rRbBuUfF]{0,2}(?:" + _TRIPLE_DQ + "|" + _TRIPLE_SQ + ")", _TRIPLE_DQ, _TRIPLE_SQ, _DQ, _SQ),
    "html": (r"<!--[\s\S]*?(?:-->|(?P<e1>\Z))",),
}


def _unnamed(parts: tuple[str, ...]) -> re.Pattern[str]:
    """One alternation; groups named e1, e2 ... are renumbered so that a name occurs once."""
    out, n = [], 0
    for part in parts:
        def again(_: re.Match[str]) -> str:
            nonlocal n
            n += 1
            return f"(?P<bad{n}>"
        out.append(re.sub(r"\(\?P<e\d>", again, part))
    return re.compile("|".join(f"(?:{x})" for x in out), re.M)


LEX = {k: _unnamed(v) for k, v in _PARTS.items()}
LANGUAGES = tuple(k for k in LEX if k != "html")
_COMMENT = {
    "ruby": ("#", "=begin"), "python": ("#",), "sql": ("--", "/*"), "html": ("<!--",),
} | {k: ("//", "/*") for k in ("javascript", "typescript", "dart", "rust", "go", "java", "cpp", "csharp", "swift", "kotlin")}


def mask(language: str, text: str, tick: str = LIT) -> str:
    """Text with comments blank, literals as ``LIT`` and those in back quotes as ``tick``; unknown languages keep their text."""
    lex = LEX.get(language)
    if lex is None:
        return text
    marks, has_keep = _COMMENT[language], "keep" in lex.groupindex

    def put(m: re.Match[str]) -> str:
        t, last = m[0], m.lastgroup
        if last and last[:3] == "bad":
            return BAD
        if t.startswith(marks):
            return "\n" * t.count("\n") if "\n" in t else " "
        if has_keep and (kept := m["keep"]) is not None:
            return t if kept == t else kept + LIT
        if t[0] in "# \t" and language in ("cpp", "csharp"):
            return "#"  # a preprocessor line
        mark = tick if t[0] == "`" else LIT
        return mark + "\n" * t.count("\n") if "\n" in t else mark

    return lex.sub(put, text)


def normal(language: str | None) -> str | None:
    """Blanks and dots cut off, lower case; null stays null, and an empty name is null."""
    if language is None:
        return None
    return language.strip(" .\t\r\n").lower() or None
