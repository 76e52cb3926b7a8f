"""Problem 4: functions and methods paired with their documentation."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm import grammar
from codelake.llm.common import checkpointed, language, rows
from codelake.llm.lexing import LANGUAGES, LIT, mask

# Words that no function of the language can be named, or that open a statement which looks like a definition. After a keyword
# such as func any name will do.
_RESERVED = {
    "javascript": "if|for|while|switch|catch|with|function|case",
    "java": "if|for|while|switch|catch|return|super|this|else|do|new|throw|case|assert|import|package|synchronized|try|goto|instanceof",
    "csharp": "if|for|while|switch|catch|return|base|this|else|do|new|throw|foreach|using|lock|fixed|sizeof|typeof|case|when|try|in|is|as|goto",
    "cpp": "if|for|while|switch|catch|return|else|do|new|throw|sizeof|case|using|try|delete|goto|typedef|co_await|co_return|co_yield",
    "dart": "if|for|while|switch|catch|return|super|this|else|do|new|throw|case|when|assert|with|in|is|try",
}
_ANY = r"(?P<name>[A-Za-z_$][\w$]*)"
_NAME = {k: rf"(?P<name>(?!(?:{v})\b)[A-Za-z_$][\w$]*)" for k, v in _RESERVED.items()}
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|native|synchronized|default|extern|external|unsafe|new|partial|inline|constexpr|explicit|friend|const|readonly|export|open|suspend|operator|infix|tailrec|mutating|nonmutating|class|required|convenience|fileprivate|late|covariant|extern|get|set)\s+)*"
_TYPE = r"(?!(?:return|new|throw|else|await|yield|case|goto|delete|import|package|using|in|is|as|assert)\b)[A-Za-z_][\w.:]*(?:\s*<[^;{}()=]*>)?(?:\s*\[\s*\])*[?*&]*"
_ARGS = r"\((?:[^;{}()]|\([^;{}()]*\)|\{[^;{}()]*\})*\)"
_ANN = r"(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)*"
_DEF = {
    "javascript": (
        rf"^[ \t]*(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*{_ANY}",
        rf"^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+{_ANY}[ \t]*(?::[^=\n]+)?=[ \t]*(?:async\b[ \t]*)?(?:<[^<>\n]*>[ \t]*)?(?:{_ARGS}[ \t]*(?::[^=\n{{;]+)?|[\w$]+[ \t]*)=>",
        rf"^[ \t]+(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)[ \t]+|\*[ \t]*)*#?{_NAME['javascript']}[ \t]*(?:<[^<>\n]*>[ \t]*)?{_ARGS}[ \t]*(?::[^{{;=]+)?\{{",
    ),
    "java": (rf"^[ \t]*{_ANN}{_MODS}(?:<[^;{{}}()]*>[ \t]*)?{_TYPE}\s+{_NAME['java']}\s*{_ARGS}\s*(?:throws\s[\w.,\s]+)?[{{;]",),
    "csharp": (rf"^[ \t]*{_MODS}{_TYPE}\s+{_NAME['csharp']}\s*(?:<[^;{{}}()]*>\s*)?{_ARGS}\s*(?:where\s[^{{;=]+)?(?:\{{|;|=>)",),
    "cpp": (rf"^[ \t]*(?:template[ \t]*<[^;{{}}]*>\s*)?{_MODS}{_TYPE}[\s*&]+(?:\w+::)*~?{_NAME['cpp']}\s*{_ARGS}\s*(?:(?:const|noexcept|override|final)\b\s*|->[ \t]*[\w:<>]+\s*)*[{{;]",),
    "go": (rf"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?{_ANY}[ \t]*[\[(]",),
    "rust": (rf"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]*{LIT})?)[ \t]+)*fn[ \t]+(?:r#)?{_ANY}",),
    "dart": (rf"^[ \t]*{_MODS}{_TYPE}\s+{_NAME['dart']}\s*(?:<[^;{{}}()]*>\s*)?{_ARGS}\s*(?:async\*?|sync\*)?\s*(?:\{{|=>|;)", rf"^[ \t]*{_MODS}{_NAME['dart']}\s*{_ARGS}\s*(?:async\*?|sync\*)?\s*(?:\{{|=>)"),
    "ruby": (r"^[ \t]*(?:(?:private|public|protected|module_function|private_class_method)[ \t]+)?def[ \t]+(?:self\.|\w+\.)?(?P<name>[A-Za-z_]\w*[?!=]?)",),
    "swift": (rf"^[ \t]*{_ANN}{_MODS}func[ \t]+`?{_ANY}",),
    "kotlin": (rf"^[ \t]*{_ANN}{_MODS}fun[ \t]+(?:<[^\n()]*>[ \t]*)?(?:[\w.<>?]+\.)?`?{_ANY}`?[ \t]*\(",),
    "sql": (r"^[ \t]*(?i:create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:function|procedure))[ \t]+(?:\w+\.)*(?P<name>\w+)",),
}
_DEF["typescript"] = _DEF["javascript"]
_DEFS = {k: tuple(re.compile(p, re.M) for p in v) for k, v in _DEF.items()}
_CLASS = re.compile(r"^(?P<indent>[ \t]*)(?:[\w@]+(?:\([^()\n]*\))?[ \t]+)*?(?P<kind>class|interface|struct|impl|trait|object|protocol|extension|mixin|enum|record|union|actor)\b(?P<head>[^{;=]*)", re.M)
_HEAD_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*")
# Words of class headers that are no names of classes.
_HEAD_WORDS = frozenset("class struct enum public private protected internal virtual final sealed open abstract extends implements with on permits where override static by const mut dyn unsafe default".split())
_DECORATOR = re.compile(r"^[ \t]*(?:@[\w.:]+.*|#!?\[.*\]|\[[A-Z][\w.]*(?:\(.*\))?(?:,[^\]]*)?\])[ \t]*$")
_LINE_MARK = {"ruby": "#", "python": "#", "sql": "--"}

# Fixed words of placeholders: a documentation that starts so and says no more than this is none.
_PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack|wip|undocumented|no docs?|see (?:above|below)|helper|placeholder|description|documentation (?:goes|missing|pending)|missing doc\w*|add (?:docs?|documentation|description|a docstring)|write (?:docs?|documentation)|docs? (?:to come|pending|missing)|auto-?generated (?:method|function|javadoc|stub)|lorem ipsum|n/?a)\b", re.I)
# Fixed words of tool directives.
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint\b|eslint-|tslint:|jshint|jslint|prettier-ignore|istanbul|c8 ignore|@ts-|@flow|noqa|type:\s*ignore|pylint:|flake8:|mypy:|pragma\b|fmt:\s*(?:on|off)|yapf:|isort:|black:|nolint|go:\w+|\+build|lint:|rubocop:|swiftlint:|sourcery:|ktlint|detekt|noinspection|suppress\w*[:(]|@suppress|checkstyle|spotless|clang-format|nolintnextline|cppcheck|coverity|ignore(?:_for_file)?:|dart format|region\b|endregion\b|resharper|-\*-|vim?:|frozen_string_literal|typed:|encoding:|coding:|biome-ignore|deno-lint|nosec|nosonar|codespell|cspell:|sqlfluff|squawk|webpack\w*:|@__pure__|@preserve|@license|copyright\b|spdx-)", re.I)
_CODE_LINE = re.compile(r"""(?:[;{}]\s*$|^\s*[\w.\[\]]+\s*(?::=|=(?!=)|\+=)\s*\S|^\s*[\w.]+\([^)]*\)\s*;?\s*$|^\s*(?:(?:const|let|var|val|final|auto|mut|int|long|bool|char|string|String|std::string|double|float|static)\s+)+[\w$]+(?:\s*:[^=]+)?\s*=(?!=)|^\s*(?:return|if|for|while|const|let|var|val|import|from|def|class|else|elsif|fn|func|end|puts|print|println|logger|log|console|assert|raise|throw|defer|go|unless|foreach)\b.*[(){}=;:\[\]'"]|^\s*(?:end|else|\}|\{|break|pass|return \w+)\s*$)""")
_TAG_LINE = re.compile(r"^\W*(?:[@\\:](?:param|parameter|arg|argument|returns?|retval|throws?|exception|raises?|type|rtype|tparam|typeparam|see|since|author|version|deprecated|override|example|template|yields?|keyword|ivar|cvar|var|option|inheritdoc|ignore|internal|private|public|access|memberof)\b.*|[-*]?\s*`?\w+`?\s*(?:--|—)\s.*|(?:args|arguments|parameters|params|returns?|raises|throws|yields)\s*:?\s*$|[-*]\s*parameters?\b.*|[-*]\s*returns?\s*:.*)", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|throws|yields|attributes)\s*:\s*$", re.I)
_XML_PARAM = re.compile(r"<(param|returns|typeparam|exception|remarks|value|seealso|see|inheritdoc)\b[^>]*?(?:/>|>[\s\S]*?</\1>)")
_XML = re.compile(r"</?\w+[^<>]*>")
_INHERIT = re.compile(r"\{@inheritDoc\}|@inheritDoc\b|<inheritdoc\b|@inheritdoc\b")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def described(doc: str | None, name: str) -> str | None:
    """The description in a documentation, or null where it is empty or trivial.

    Trivial: fewer than four words remain besides parameter tags, markup and
    the words of the function's own name; or it is a placeholder, a tool
    directive or commented-out code.
    """
    if not doc:
        return None
    lines = [x.strip() for x in _XML_PARAM.sub(" ", doc).split("\n")]
    kept, section = [], False
    for x in lines:
        if _SECTION.match(x):
            section = True
        elif not x:
            section = False
        elif not section and not _TAG_LINE.match(x) and not _DIRECTIVE.match(x):
            kept.append(_XML.sub(" ", x))
    if not kept or _PLACEHOLDER.match(kept[0]):
        return None
    code = sum(bool(_CODE_LINE.search(x)) for x in kept)
    if code * 2 > len(kept) or (code and code == len(kept)):
        return None
    own = {w.lower() for w in _CAMEL.findall(name)} | {name.lower()}
    words = [w for x in kept for w in _WORD.findall(x.replace("_", " ")) if any(c.isalpha() for c in w)]
    return "\n".join(kept) if sum(w.lower() not in own for w in words) >= 4 else None


def _comment_text(lines: list[str]) -> str:
    out = []
    for x in lines:
        x = re.sub(r"^\s*(?:/\*+!?|///?!?|//+!?|\*(?!/)|#+!?|--+)\s?", "", x)
        out.append(re.sub(r"\s*\*+/\s*$", "", x))
    return "\n".join(out).strip()


def _above(raw: list[str], masked: list[str], i: int, lang: str) -> str:
    """Text of the comment that ends on the line above line ``i`` (from 0) or above its decorators."""
    j = i - 1
    while j >= 0 and masked[j].strip() and _DECORATOR.match(masked[j]):
        j -= 1
    if j < 0 or masked[j].strip() or not (last := raw[j].strip()):
        return ""
    k = j
    if last.endswith("*/"):
        while k >= 0 and "/*" not in raw[k]:
            k -= 1
        if k < 0 or masked[k].strip():
            return ""
    else:
        mark = _LINE_MARK.get(lang, "//")
        if not last.startswith(mark):
            return ""
        while k > 0 and raw[k - 1].strip().startswith(mark) and not masked[k - 1].strip():
            k -= 1
    return _comment_text(raw[k : j + 1])


def classes_of(masked: str, lang: str) -> list[tuple[int, str, str, list[str]]]:
    """(offset of the name, indentation, name, all bases in order) of the classes, interfaces, traits and so on of a masked text.

    Headers are read to their brace over any number of lines; type parameters
    and constructor parameters are skipped. ``impl Trait for Type`` is Type with base Trait.
    """
    out = []
    for m in _CLASS.finditer(masked):
        head = m["head"]
        if lang == "ruby":
            head = head.split("\n")[0]
        for pattern in (r"<[^<>]*>", r"\([^()]*\)"):
            while pattern[0] != "<" or lang != "ruby":
                new = re.sub(pattern, " ", head)
                if new == head:
                    break
                head = new
        head = re.split(r"\bwhere\b|\n[ \t]*\n|->", head)[0]
        names = [n for n in _HEAD_NAME.findall(head) if n not in _HEAD_WORDS]
        if not names or (names[0] == "for"):
            continue
        at = m.start("head") + m["head"].find(names[0])
        if m["kind"] == "impl":
            if "for" in names[1:]:
                k = names.index("for")
                if k + 1 < len(names):
                    out.append((at, m["indent"], _last(names[k + 1]), [_last(names[0])]))
            else:
                out.append((at, m["indent"], _last(names[0]), []))
        elif re.match(r"\s", m["head"]) and names:
            out.append((at, m["indent"], _last(names[0]), [_last(n) for n in names[1:] if n not in ("for", "as")]))
    return out


def _last(name: str) -> str:
    return re.split(r"\.|::", name)[-1]


_LOCK = re.compile(r"lock|guard")
_HOLDER = re.compile(r"\b(?:class|struct|union|namespace|extern|enum)\b")


def _local(masked: str, at: int) -> bool:
    """Whether offset ``at`` of C++ stands in a function's body, where ``std::lock_guard<M> lock(m);`` is a variable."""
    depth = 0
    for m in reversed(list(re.compile(r"[{}]").finditer(masked, 0, at))):
        depth += 1 if m[0] == "}" else -1
        if depth < 0:
            head = masked[: m.start()]
            return not _HOLDER.search(head[max(head.rfind(c) for c in ";{}") + 1 :])
    return False


def _extent(masked: str, start: int, lang: str) -> int:
    """Offset where a definition that starts at ``start`` ends: its block, or its line."""
    if lang == "ruby":
        indent = re.match(r"[ \t]*", masked[start:])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(masked, start)
        return m.end() if m else len(masked)
    depth, opened = 0, False
    for m in re.compile(r"[{};]|\n").finditer(masked, start):
        c = m[0]
        if c == "{":
            depth, opened = depth + 1, True
        elif c == "}":
            depth -= 1
            if opened and depth <= 0:
                return m.end()
        elif c == ";" and not opened:
            return m.end()
    return len(masked)


_PY_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+")


def _python_functions(text: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
    raw = text.split("\n")
    out: list[tuple] = []
    masked: list[str] | None = None
    stack: list[tuple[ast.AST, str | None, list[str]]] = [(tree, None, [])]
    while stack:
        node, cls, bases = stack.pop()
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                named = [b.value if isinstance(b, ast.Subscript) else b for b in x.bases]
                above = [b.id if isinstance(b, ast.Name) else b.attr for b in named if isinstance(b, (ast.Name, ast.Attribute))]
                if above:
                    out.append((x.lineno, "", x.name, above, "", ""))
                stack.append((x, x.name, above))
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                line = x.lineno - 1
                if line < len(raw) and _PY_DEF.match(raw[line]):
                    doc = ast.get_docstring(x, clean=True)
                    if described(doc, x.name) is None:
                        top = min([d.lineno for d in x.decorator_list] + [x.lineno]) - 1
                        if top > 0 and raw[top - 1].lstrip().startswith("#"):
                            masked = masked or mask("python", text).split("\n")
                            above = _above(raw, masked, line, "python") if len(masked) == len(raw) else ""
                            doc = above if described(above, x.name) or not doc else doc
                    out.append((line + 1, x.name, cls, bases, doc or "", "\n".join(raw[line : x.end_lineno])))
                stack.append((x, None, []))
            elif not isinstance(x, ast.expr):
                stack.append((x, cls, bases))
    return out


def functions_of(lang: str | None, text: str | None) -> list[tuple]:
    """(line, name, class, base classes, documentation, code) of each definition in a valid file; of each class with bases, with an empty name.

    Empty for null or invalid texts and for languages without definitions.
    """
    if not text or lang not in LANGUAGES:
        return []
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    if lang == "python":
        return _python_functions(text)
    masked = grammar.masked_text(lang, text)
    if not grammar.valid_masked(lang, masked):
        return []
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    mstarts = [0] + [m.end() for m in re.finditer("\n", masked)]
    raw, mlines = text.split("\n"), masked.split("\n")
    if len(starts) != len(mstarts):
        return []
    classes = [(bisect_right(mstarts, at), len(indent.expandtabs(4)), c, bases) for at, indent, c, bases in classes_of(masked, lang)] if lang not in ("go", "sql") else []
    found: dict[int, tuple] = {}
    for p in _DEFS[lang]:
        for m in p.finditer(masked):
            line = bisect_right(mstarts, m.start("name"))
            if line in found or (lang == "cpp" and m[0].endswith(";") and _LOCK.fullmatch(m["name"]) and _local(masked, m.start())):
                continue
            first = bisect_right(mstarts, m.start() + len(m[0]) - len(m[0].lstrip()))
            doc = _above(raw, mlines, first - 1, lang)
            indent = len(mlines[first - 1]) - len(mlines[first - 1].lstrip())
            cls, base = None, []
            if indent:
                for at, depth, c, b in reversed(classes):
                    if at <= first and depth < len(mlines[first - 1][:indent].expandtabs(4)):
                        cls, base = c, b
                        break
            code = ""
            if doc:
                end = bisect_right(mstarts, max(m.start(), _extent(masked, m.start(), lang) - 1))
                code = "\n".join(raw[first - 1 : end])
            found[line] = (line, m["name"], cls, base, doc, code)
    return [*found.values(), *((line, "", c, bases, "", "") for line, _, c, bases in classes if bases)]


def functions(files: DataFrame) -> DataFrame:
    """Every definition of every valid file with its own documentation, if any.

    Columns: ordinal, scan_id, language, file_path, line_number, name,
    class_name, base_names, documented (own documentation that isn't trivial),
    inherits (asks for inherited documentation), description, code. Methods
    without documentation are kept only where a base could supply it. Each
    class with bases is a row of its own with an empty name.
    """
    cols = ("line_number", "name", "class_name", "base_names")

    def extract(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("ordinal", "scan_id", "language", "file_path", *cols, "documented", "inherits", "description", "code")}
        for o, s, lang, path, text in zip(b["ordinal"], b["scan_id"], b["language"], b["file_path"], b["source_code"], strict=True):
            for f in functions_of(lang, text):
                what = described(f[4], f[1])
                asks = what is None and f[1] != "" and bool(f[3]) and (not f[4] or bool(_INHERIT.search(f[4])))
                if what is None and f[2] is None:
                    continue
                for k, v in zip(("ordinal", "scan_id", "language", "file_path", *cols), (o, s, lang, path, *f[:4]), strict=True):
                    out[k].append(v)
                out["documented"].append(what is not None)
                out["inherits"].append(asks)
                out["description"].append(what)
                out["code"].append(f[5] if what or asks else None)
        return out

    picked = files.select("ordinal", "scan_id", language().alias("language"), "file_path", "source_code")
    return rows(picked, extract, "ordinal long, scan_id string, language string, file_path string, line_number int, name string, class_name string, base_names array<string>, documented boolean, inherits boolean, description string, code string").dropDuplicates(["ordinal", "line_number", "name"])


def inherited(found: DataFrame) -> DataFrame:
    """Documentation that methods get from the method they override.

    ``found``: ordinal, scan_id, language, line_number, name, class_name,
    base_names, documented, inherits. In each round the methods still open are
    joined with the methods of all their bases; a documented one resolves
    them, of several the one of the base named first, and open ones pass on to
    the bases of these bases. It ends when no method is open, so a chain of any
    length resolves; cycles of classes end since a base is visited once. A
    class is sought in the file of the method first; of several in a scan the
    one of the least ordinal counts. Result: ordinal, line_number, from_ordinal, from_line.
    """
    key = ["scan_id", "language", "class_name"]
    classes = checkpointed(
        found.filter((F.col("name") == "") & (F.size("base_names") > 0)).groupBy(*key).agg(F.min_by("base_names", "ordinal").alias("next_bases"))
    )
    documented = found.filter(F.col("class_name").isNotNull() & F.col("documented"))
    near = documented.groupBy("ordinal", "class_name", "name").agg(F.min("line_number").alias("near_line"))
    methods = documented.groupBy(*key, "name").agg(F.min(F.struct("ordinal", "line_number")).alias("at"))
    asking = found.filter("inherits").select("ordinal", "line_number", "scan_id", "language", "name", F.posexplode("base_names").alias("rank", "class_name"), F.array("class_name").alias("seen"))
    is_open = checkpointed(asking)
    done = None
    while not is_open.isEmpty():
        step = is_open.join(methods, [*key, "name"], "left").join(near, ["ordinal", "class_name", "name"], "left").join(classes, key, "left")
        step = checkpointed(step.withColumn("at", F.when(F.col("near_line").isNotNull(), F.struct("ordinal", F.col("near_line").alias("line_number"))).otherwise(F.col("at"))))
        hit = step.filter("at is not null").groupBy("ordinal", "line_number").agg(F.min_by("at", F.struct("rank", "at")).alias("at")).select("ordinal", "line_number", F.col("at.ordinal").alias("from_ordinal"), F.col("at.line_number").alias("from_line"))
        done = hit if done is None else done.unionByName(hit)
        left = step.filter(F.col("at").isNull() & F.col("next_bases").isNotNull()).join(hit.select("ordinal", "line_number"), ["ordinal", "line_number"], "left_anti")
        deeper = left.select("ordinal", "line_number", "scan_id", "language", "name", "rank", F.explode(F.array_except("next_bases", "seen")).alias("class_name"), F.array_append("seen", F.col("class_name")).alias("seen"))
        is_open = checkpointed(deeper.groupBy("ordinal", "line_number", "scan_id", "language", "name", "class_name").agg(F.min("rank").alias("rank"), F.min("seen").alias("seen")))
    if done is None:
        return found.sparkSession.createDataFrame([], "ordinal long, line_number int, from_ordinal long, from_line int")
    return done


def documented_functions(files: DataFrame, with_text: bool = True) -> DataFrame:
    """Pairs of code and description with name, kind and place.

    A function counts if its documentation is neither empty nor trivial, or if
    it is a method whose documentation resolves through the class hierarchy
    (``is_inherited``). Null and invalid texts give nothing; repeated rows of
    one ordinal count once. ``with_text=False`` leaves out description and code.
    """
    keys = ["ordinal", "scan_id", "language", "file_path", "line_number", "name", "class_name", "base_names", "documented", "inherits"]
    found = checkpointed(functions(files).select(*keys, *(("description", "code") if with_text else ())))
    kind = F.when(F.col("class_name").isNull(), "function").otherwise("method").alias("kind")
    place = ["ordinal", "file_path", "language", "line_number", "name", kind]
    text = ("description", "code") if with_text else ()
    own = found.filter("documented").select(*place, *text, F.lit(False).alias("is_inherited"))
    links = inherited(found.drop("description", "code"))
    got = found.filter("name <> ''").join(links, ["ordinal", "line_number"])
    if with_text:
        source = found.select(F.col("ordinal").alias("from_ordinal"), F.col("line_number").alias("from_line"), F.col("description").alias("from_description"))
        got = got.join(source, ["from_ordinal", "from_line"]).withColumn("description", F.col("from_description"))
    return own.unionByName(got.select(*place, *text, F.lit(True).alias("is_inherited")))
