"""Whether a text follows the grammar of a language, and the ranking of languages for a text.

Python is parsed by the interpreter's own parser, twelve languages by their
grammars in ``languages``: whole files down to statements and expressions. The
checks know nothing of names, types or modules.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from _symtable import symtable

from codelake.llm.languages import grammar, plain, ready
from codelake.llm.lexing import BAD, LANGUAGES, mask
from codelake.llm.syntax import TICK

_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|>{7}(?: |$)|\|{7}(?: |$)|={7}\r?$)", re.M)


def _python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            symtable(text, "f", "exec")
            return True
        except (SyntaxError, ValueError):
            try:
                ast.parse(text)
                return True
            except (SyntaxError, ValueError):
                return False
            except (RecursionError, MemoryError):
                return True
        except (RecursionError, MemoryError):
            return True


def masked_text(language: str, text: str) -> str:
    """Masked text with the lines of the plain text, for ``valid_masked``."""
    return mask(language, plain(text), TICK)


def valid_masked(language: str, masked: str) -> bool:
    """Whether masked text follows the language's grammar; not for Python."""
    return BAD not in masked and not _CONFLICT.search(masked) and grammar(language).accepts(ready(language, masked))


def valid(language: str | None, text: str | None) -> bool:
    """Whether a text is syntactically valid; null texts, HTML and languages without a grammar always are."""
    if text is None or language not in LANGUAGES or not text.strip("\ufeff \t\r\n"):
        return True
    if language == "python":
        return _python(text.removeprefix("\ufeff").replace("\r\n", "\n"))
    return valid_masked(language, masked_text(language, text))


# Fixed tokens that speak for a language; each counts once for every line that starts with it.
_SIGNS = {
    "python": r"def |from \w[\w.]* import|import \w+$|elif |class \w+.*:$|if .*:$|for .*:$|return ", "javascript": r"const |let |import .* from|export |function |async function|console\.",
    "typescript": r"const \w+: |import type|export |interface |private |import .* from|let ", "java": r"package [\w.]+;|import [\w.]+;|public |private |protected |@\w+$|final class", "go": r"package \w+$|func |import \"|var |type \w+ struct|\w+ := ",
    "rust": r"use [\w:]+;|pub |fn |let (?:mut )?|impl |struct |#\[", "dart": r"import '|final |var |class |String |int |print\(", "csharp": r"using [\w.]+;|namespace |public |private |internal |foreach ",
    "cpp": r"#include|std::|auto |static |namespace |template|virtual |int |char ", "ruby": r"def |end$|require|class |module |puts |unless ", "swift": r"import \w+$|func |let |var |guard |private func|print\(",
    "kotlin": r"package [\w.]+$|import [\w.]+$|fun |val |var |private fun|println\(", "sql": r"(?i:create |insert |select |alter |drop |from |where |grant )",
}
_SIGN_RE = {k: re.compile(rf"^[ \t]*(?:{v})", re.M) for k, v in _SIGNS.items()}


def ranked(text: str) -> list[str]:
    """All languages, those with the most signs in the text first; ties by name."""
    counts = {k: len(p.findall(text)) for k, p in _SIGN_RE.items()}
    return sorted(counts, key=lambda k: (-counts[k], k))


def verdict(language: str | None, text: str | None) -> tuple[bool, str | None]:
    """(valid, language it parses as): the claimed grammar first, then all others by rank.

    A text that fails its own grammar and follows another one has a wrong
    extension; one that follows none is corrupt, and the second value is null.
    """
    if valid(language, text):
        return True, language
    for other in ranked(text or ""):
        if other != language and valid(other, text):
            return False, other
    return False, None


sys.setrecursionlimit(max(sys.getrecursionlimit(), 3000))
