"""Cuts the text of an item out of its file, with imports, decorators and type references."""

from __future__ import annotations

import ast
import re

from codelake.parse.scan import Item, blank_literals, closing, html_blocks

WINDOW = {"dart": 200}
_REFS = re.compile(r"\b[A-Z][a-zA-Z0-9]+\b")
_IMPORTS = {
    "javascript": re.compile(r"^(?:import\s[^\n]*|(?:const|let|var)\s[^\n]*=\s*require\([^\n]*)$", re.M), "dart": re.compile(r"^import\s+'[^']*'[^\n]*;$", re.M),
    "rust": re.compile(r"^(?:pub\s+)?use\s[^;]*;", re.M), "go": re.compile(r"^import\s+(?:\([^)]*\)|[^\n]*)", re.M), "java": re.compile(r"^import\s[^;]*;", re.M), "kotlin": re.compile(r"^import\s[^\n]*", re.M),
    "swift": re.compile(r"^import\s[^\n]*", re.M), "csharp": re.compile(r"^using\s[^;(]*;", re.M), "cpp": re.compile(r"^\s*#include[^\n]*", re.M), "ruby": re.compile(r"^require(?:_relative)?\s[^\n]*", re.M),
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]


def _python(text: str, item: Item) -> tuple[str, list[str], list[str], list[str]] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    named = [x for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and x.name == item.name]
    node = next((x for x in named if x.lineno == item.line), named[0] if named else None)
    if node is None:
        return None
    lines = text.split("\n")
    top = min([d.lineno for d in node.decorator_list] + [node.lineno])
    code = "\n".join(lines[top - 1 : node.end_lineno])
    imports = ["\n".join(lines[x.lineno - 1 : x.end_lineno]) for x in tree.body if isinstance(x, (ast.Import, ast.ImportFrom))]
    refs: dict[str, None] = {}
    try:
        for x in ast.walk(ast.parse(code)):
            if isinstance(x, ast.Name) and x.id[:1].isupper() and x.id not in ("True", "False", "None"):
                refs[x.id] = None
    except SyntaxError:  # an indented method stands alone badly and has no references
        refs = {}
    return code, imports, [ast.dump(d) for d in node.decorator_list], list(refs)


def _braces(text: str, item: Item, lang: str, window: int) -> str:
    lines = text.split("\n")
    start = sum(len(x) + 1 for x in lines[: item.line - 1])
    blank = blank_literals(text, lang)
    opening = blank.find("{", start)
    if opening < 0:
        return "\n".join(lines[item.line - 1 : item.line - 1 + window])
    stop = closing(blank, opening)
    return text[start : stop + 1 if stop is not None else len(text)]


def sql_statement(text: str, line: int) -> str:
    """Statement from a line on: up to a line that ends in a semicolon outside parentheses and dollar quotes."""
    lines = text.split("\n")
    while line <= len(lines) and not lines[line - 1].strip():
        line += 1
    out, depth, dollars = [], 0, 0
    for x in lines[line - 1 :]:
        out.append(x)
        dollars += x.count("$$")
        if dollars % 2:
            continue
        depth += x.count("(") - x.count(")")
        if x.rstrip().endswith(";") and depth <= 0:
            break
    return "\n".join(out).strip()


def _html(text: str, item: Item) -> str | None:
    found = html_blocks(text)
    if item.block_type.endswith("_block"):
        return next((b[4].strip() for b in found if b[2] == item.line and item.name.startswith(b[0])), None)
    b = next((b for b in found if f"{b[0]}_block_{b[2]}" == item.parent), None) or next((b for b in found if b[2] <= item.line <= b[3]), None)
    if b is None:
        return None
    body = b[4]
    m = re.search(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:class|function|const|let|var)\s+{re.escape(item.name)}\b", body, re.M)
    return _braces(body, Item(item.name, item.block_type, "javascript", body.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1), "javascript", 100) if m else None


def extract_item(text: str, item: Item) -> dict | None:
    """source_code, imports, decorators and type_references of an item, or null if it can't be found in the text."""
    lang = item.language
    ended = item.end is not None and lang not in ("python", "html", "sql")
    if lang == "python":
        got = _python(text, item)
        return None if got is None else dict(zip(("source_code", "imports", "decorators", "type_references"), got, strict=True))
    if lang == "html":
        code = _html(text, item)
        return None if code is None else {"source_code": code, "imports": [], "decorators": [], "type_references": []}
    if lang == "sql":
        if re.match(r"class\s", text.split("\n")[item.line - 1] if item.line <= len(text.split("\n")) else ""):
            got = _python(text, item)
            if got:
                return {"source_code": got[0], "imports": got[1], "decorators": got[2], "type_references": got[3]}
        return {"source_code": sql_statement(text, item.line), "imports": [], "decorators": [], "type_references": []}
    lines = text.split("\n")
    code = "\n".join(lines[item.line - 1 : item.end]) if ended else _braces(text, item, lang, WINDOW.get(lang, 100))
    marks, i = [], item.line - 2
    while i >= 0 and re.match(r"\s*(?:@\w|#\[|\[[A-Z])", lines[i]):
        marks.insert(0, lines[i].strip())
        i -= 1
    imports = [m[0].strip() for m in _IMPORTS[lang].finditer(text)] if lang in _IMPORTS else []
    if marks and ended:
        code = "\n".join(marks) + "\n" + code
    refs = sorted(set(_REFS.findall(code))) if lang not in ("javascript", "typescript", "dart") else []
    return {"source_code": code, "imports": imports, "decorators": marks if ended else [], "type_references": refs}
