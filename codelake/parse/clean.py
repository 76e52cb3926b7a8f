"""Cleaning, formatting and validation of a block's text."""

from __future__ import annotations

import ast
import re

# The warning's text, the words of a licence, the words that open a lint directive by comment mark, SQL keywords.
STRIPPED = "Stripped metadata (shebang/encoding/copyright/lint directives)"
LICENCE = ("copyright", "license", "all rights reserved")
DIRECTIVES = {"//": ("ignore", "noinspection", "eslint-disable", "pylint:", "type:ignore", "noqa"), "#": ("pylint:", "type:ignore", "noqa", "pragma")}
SQL_KEYWORDS = "select from where insert into values update set delete create table view function trigger index alter drop primary key foreign references not null default unique check constraint on or replace if exists begin end return returns declare as and in is with cascade restrict grant revoke policy using for each row before after execute procedure language plpgsql volatile stable immutable security definer invoker materialized temporary temp type enum".split()
_KEYWORD = re.compile(rf"\b(?:{'|'.join(SQL_KEYWORDS)})\b", re.I)
_TOKEN = re.compile(r"""'[^']*'|"[^"]*"|[\w$*]+(?:\.[\w$*]+)*|\S""")
_WORD = re.compile(r"\w+")


def _is_encoding(line: str) -> bool:
    """A comment line that names its coding: the word, a colon or equals sign, and a name."""
    if not line.startswith("#"):
        return False
    return any(rest[:1] and rest[0] in ":=" and re.match(r"[\w.-]", rest[1:].lstrip()) for rest in line.split("coding")[1:])


def _directive(text: str, at: int) -> int | None:
    """Offset after the lint directive that starts at ``at``, if one does."""
    mark = "//" if text.startswith("//", at) else "#" if text.startswith("#", at) else None
    if mark is None:
        end = text.find("*/", at, (text.find("\n", at) + 1 or len(text) + 1) - 1) if text.startswith("/*", at) else -1
        inner = text[at + 2 : end].lstrip() if end >= 0 else ""
        return end + 2 if inner.startswith("eslint-disable") else None
    pos = at + len(mark)
    while pos < len(text) and text[pos].isspace():
        pos += 1
    for word in DIRECTIVES[mark]:
        head, colon, tail = word.partition(":")
        if not text.startswith(head + colon, pos):
            continue
        end = pos + len(head + colon)
        if not tail:
            return end
        while end < len(text) and text[end].isspace():
            end += 1
        if text.startswith(tail, end):
            return end + len(tail)
    return None


def _without_directives(text: str) -> str:
    """Text without lint directives that open a line, with the blank space on both sides of each."""
    out: list[str] = []
    done = at = 0
    while at < len(text):
        first = at
        while first < len(text) and text[first].isspace():
            first += 1
        end = _directive(text, first) if first < len(text) else None
        if end is None:
            at = text.find("\n", first) + 1 or len(text)
            continue
        out.append(text[done:at])
        while end < len(text) and text[end].isspace():
            end += 1
        done = end
        at = end if end and text[end - 1] == "\n" else text.find("\n", end) + 1 or len(text)
    return "".join(out) + text[done:]


def _leading_comment(text: str) -> int:
    """Length of the comment a text opens with, up to the line it ends on; 0 without one."""
    for opening, closing in (('"""', '"""'), ("'''", "'''"), ("/*", "*/")):
        if text.startswith(opening):
            end = text.find(closing, len(opening))
            rest = text[end + len(closing) :] if end >= 0 else ""
            blank = rest[: len(rest) - len(rest.lstrip())]
            return end + len(closing) + blank.rindex("\n") + 1 if "\n" in blank else 0
    n = 0
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if bare and not bare.startswith(("#", "//")):
            break
        n += len(line)
    return n


def strip_metadata(code: str) -> tuple[str, list[str]]:
    """Text without its first shebang and encoding line, leading licence and lint directives, and a warning if that changed it."""
    lines = code.split("\n")
    for unwanted in (lambda x: x.startswith("#!"), _is_encoding):
        at = next((k for k, x in enumerate(lines) if unwanted(x)), None)
        if at is not None:
            lines[at : at + 1] = [] if at + 1 < len(lines) else [""]
    text = "\n".join(lines)
    opened = text.lstrip("\n")
    n = _leading_comment(opened)
    if n and any(w in opened[:n].lower() for w in LICENCE):
        text = opened[n:]
    text = _without_directives(text)
    start = len(text) - len(text.lstrip("\n"))
    return (text[start - 2 :] if start > 2 else text), [STRIPPED] if text != code else []


def imported_names(statement: str) -> list[str]:
    """Names that an import brings into use: the alias where there is one; none where they can't be told.

    Python's own imports are read by its parser, those of other languages from their tokens.
    """
    s = statement.strip().rstrip(";")
    try:
        tree = ast.parse(s).body
    except (SyntaxError, ValueError):
        tree = []
    if len(tree) == 1 and isinstance(tree[0], (ast.Import, ast.ImportFrom)):
        names = [a.asname or a.name.rpartition(".")[2] for a in tree[0].names]
        return [n for n in names if n.isidentifier()]
    t = _TOKEN.findall(s)
    if t[:1] == ["from"] and "import" in t:  # an import in parentheses that goes on in the next line
        bound = " ".join(x for x in t[t.index("import") + 1 :] if x not in "()").split(",")
        return [n for p in bound if p.strip() and (n := p.split()[-1]).isidentifier()]
    if not t or t[0] not in ("import", "const", "let", "var"):
        return []
    binds = "from" if t[0] == "import" else "="
    if len(t) > 2 and t[1] == "{" and "}" in t:
        close = t.index("}")
        if t[close + 1 : close + 2] == [binds] and (binds == "from" or t[close + 2 : close + 3] == ["require"]):
            inner = " ".join(t[2:close]).split(",")
            return [p.split()[-1] for p in inner if p.strip()]
        return []
    if t[2:3] == [binds] and (binds == "from" or t[3:4] == ["require"]):
        return [t[1]] if t[1].isidentifier() else []
    if t[0] == "import" and "from" not in s and not any(x[0] in "'\"" for x in t):
        return [n for n in (part.split()[-1].rpartition(".")[2] for part in " ".join(t[1:]).split(",") if part.strip()) if n.isidentifier()]
    return []


def used_imports(imports: list[str], code: str) -> list[str]:
    """Imports of which a name occurs in the code as a word; those whose names can't be told stay."""
    words = set(_WORD.findall(code))
    return [i for i in imports if not (names := imported_names(i)) or not words.isdisjoint(names)]


def is_relative(statement: str) -> bool:
    """Whether an import names its source by its place: Python by leading dots, scripts by ``./`` or ``../``, Dart by a bare path."""
    t = _TOKEN.findall(statement.strip())
    if t[:1] == ["from"] and t[1:2] == ["."]:
        return True
    if t[:1] == ["import"] and t[1:2] and t[1][0] == "'" and not t[1][1:].startswith(("package:", "dart:")):
        return True
    return any(x[0] in "'\"" and x[1:].startswith(("./", "../")) and (t[k - 1] == "from" or t[k - 2 : k] == ["require", "("]) for k, x in enumerate(t) if k)


def sanitised(imports: list[str]) -> tuple[list[str], list[str]]:
    """Relative imports as notes to be resolved, and a warning for each."""
    out, warnings = [], []
    for i in imports:
        s = i.strip()
        if is_relative(s):
            out.append(f"{'#' if s.startswith(('from .', 'import .')) else '//'} TODO: Resolve relative import — {s.rstrip(';')}")
            warnings.append(f"Relative import converted to TODO: {s}")
        else:
            out.append(i)
    return out, warnings


def clean(code: str | None, imports: list[str] | None) -> tuple[str, list[str], list[str]]:
    """(code, required imports, warnings): metadata stripped, unused imports removed and counted, relative ones noted."""
    text, warnings = strip_metadata(code or "")
    used = used_imports(imports or [], text)
    if len(used) < len(imports or []):
        warnings.append(f"Removed {len(imports) - len(used)} unused import(s)")
    kept, relative = sanitised(used)
    return text, kept, warnings + relative


def formatted(code: str, lang: str | None) -> str:
    """Lines without trailing blanks, runs of blank lines cut to two for Python and one for others, SQL keywords in upper case outside dollar quotes."""
    lines, out, dollar = [x.rstrip() for x in code.splitlines()], [], False
    most, run = (2 if lang == "python" else 1), 0
    for x in lines:
        if not x:
            run += 1
            if run > most:
                continue
        else:
            run = 0
        if lang == "sql" and x:
            if "$$" in x:
                dollar = not dollar
            if not dollar:
                x = _KEYWORD.sub(lambda m: m[0].upper(), x)
        out.append(x)
    return "\n".join(out).strip()


def _depth(code: str, lang: str | None) -> int:
    quotes = "'\"" if lang == "dart" else "'\"`"
    line = r"//[^\n]*|#[^\n]*" if lang not in ("javascript", "typescript", "dart") else r"//[^\n]*"
    lit = "|".join(rf"{q}(?:[^{q}\\]|\\[\s\S])*(?:{q}|\Z)" for q in quotes)
    bare = re.sub(rf"{line}|/\*[\s\S]*?(?:\*/|\Z)|{lit}", "", code)
    return bare.count("{") - bare.count("}")


def validated(code: str, lang: str | None) -> tuple[bool, str | None]:
    """Whether a text is well formed, and what is wrong: Python by its parser, SQL by parentheses, others by braces."""
    if lang == "python":
        body = "\n".join(x for x in code.split("\n") if not x.strip().startswith("#"))
        if not body.strip():
            return True, None
        try:
            ast.parse(body)
            return True, None
        except (SyntaxError, ValueError) as e:
            return False, f"Syntax error: {e}"
    if lang == "sql":
        bare = re.sub(r"\$\$[\s\S]*?(?:\$\$|\Z)|'[^']*(?:'|\Z)", "", code)
        d = bare.count("(") - bare.count(")")
        return (True, None) if d == 0 else (False, f"Unbalanced parentheses (depth={d})")
    d = _depth(code, lang)
    return (True, None) if d == 0 else (False, f"Unbalanced braces (depth={d})")


def header(qualified_name: str, block_type: str, path: str, line: int, as_of: str, warnings: list[str]) -> str:
    """Head of an exported file; the day is a parameter."""
    out = [f"Extracted: {qualified_name}", f"Type: {block_type}", f"Source: {path}:{line}", f"Date: {as_of}"]
    return "\n".join(out + ([f"Warnings: {'; '.join(warnings)}"] if warnings else []))


def file_content(code: str, head: str, lang: str | None) -> str:
    """Text of an exported file: the head as comment, a blank line, the code, a line break at the end."""
    if lang == "html":
        top = f"<!-- {head} -->"
    else:
        mark = {"sql": "--", "python": "#", "ruby": "#"}.get(lang or "", "//")
        top = "\n".join(f"{mark} {x}" for x in head.splitlines())
    text = f"{top}\n\n{code}" if head else code
    return text if text.endswith("\n") else text + "\n"
