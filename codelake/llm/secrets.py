"""Problem 6: credentials embedded in source code."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import rows

# Fixed words in the name of what holds a credential, and in names of what never does.
_SECRET_NAME = re.compile(r"passw|(?:^|_)pwd|(?:^|_)pass(?:$|_)|secret|api_?key|access_?key|auth_?token|bearer|signing_?key|private_?key|encryption_?key|master_?key|credential|client_?key|(?:auth|access|refresh|session|deploy|bot|user|api|id)_token|authorization|(?:^|_)auth(?:$|_)|passphrase|smtp_?pass|token$|x_api_key|storage_?key|account_?key|license_?key")
_PLAIN_NAME = re.compile(r"check_?sum|sha_?\d*(?:$|_)|(?:^|_)md5|digest|etag|commit|trace|revision|(?:^|_)rev(?:$|_)|(?:^|_)hash|integrity|public_?key|verify_?key|fingerprint|uuid|guid|request_?id|span_?id|build_?id|(?:^|_)nonce|icon|image|img|png|jpe?g|svg|logo|font|avatar|thumb|(?:min|max)_?len|length|_ttl|label|hint|field|column|placeholder|schema|version")
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|_+|change_?me\w*|placeholder|replace_?me\w*|your[-_].*|my[-_](?:secret|token|password|key)|<.*>|\$\{.*\}?|\$\(.*|\$[A-Z_]+|\{\{.*|%[\w-]+%|#\{.*|(?:todo|example|dummy|fake|test|sample)(?:[-_ ]?(?:key|token|secret|password|passwd|pwd|pass|value|string))?\d{0,3}|none|null|nil|undefined|true|false|password\d*|passwd|secret|token|api[-_ ]?key|client[-_]?secret|username|user|admin|default|redacted|hidden|fill[-_]?in|insert[-_]\w*|(?:process\.)?env\b.*|os\.environ.*|getenv.*|vault\b.*|secrets?manager.*|ssm:.*|kms:.*|arn:.*|env:.*|@\w+@|redacted.*)$", re.I)
_REFERENCE = re.compile(r"\$\{|\{\{|#\{|%\w+%|process\.env|os\.environ|getenv|vault|ENV\[|System\.getenv|secretsmanager|secretKeyRef|<%=")

# Fixed prefixes of tokens that services issue.
_ISSUED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:AKIA|ASIA)[0-9A-Z]{12,20}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{24,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}|pypi-[\w-]{20,}|hf_[A-Za-z0-9]{20,}|dop_v1_[0-9a-f]{40,}|shpat_[0-9a-f]{20,}|sq0\w{3}-[\w-]{20,}|EAACEdEose0cBA\w+|ya29\.[\w-]{20,}|key-[0-9a-f]{32})")
_URL = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s\"'`:/@<>{}$%]+:(?P<value>[^\s\"'`/@<>]+|[^\s\"'`@<>]*[^\s\"'`@<>/])@[\w.-]+")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<value>[\s\S]*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)")
_NAMED = re.compile(r"(?<![\w$.-])(?P<name>(?=[\d$.-]*[A-Za-z_])[\w$.]++(?:-[\w$.]++)*+)[\"']?\]?\s*(?::\s*(?:&(?:'static\s+)?)?[\w<>?*\[\]]+\s*(?==))?(?::=|=>|=|:|->)\s*(?=[\"'`]|[^\s\"'`=>&|])")
_QUOTED = re.compile(r"(?P<q>[\"'`])(?P<value>(?:[^\"'`\s\\]|\\\S){8,}+)(?P=q)")
_PHRASE = re.compile(r"(?P<q>[\"'`])(?P<value>(?:[^\"'`\n\\]|\\.)+?)(?P=q)")
_JOINED = re.compile(r"(?P<q>[\"'`])(?P<a>[^\"'`\s\\]{3,}+)(?P=q)(?P<more>(?:(?:\s*(?:\+|\.|<>|~|\|\||\\\n)\s*|\s*\n\s*)(?P=q)[^\"'`\s\\]++(?P=q))+)")
# A line that goes on: it ends with a literal or an operator after one, and the next one starts with an operator or a literal.
_GOES_ON = re.compile(r"(?<=[\"'`+.~>|\\])[ \t\r]*\n[ \t]*(?:(?:\+|\.|<>|~|\|\|)[ \t]*)?[\"'`][^\n]*")
_CALL = re.compile(r"\b(?:log_?in|connect|open_?session|authenticate|auth|sign_?in|bind|set_?password|basic_?auth)\s*\(\s*[\"'`][^\"'`\s]+[\"'`]\s*,\s*[\"'`](?P<value>[^\"'`\s]{6,}+)[\"'`]", re.I)
_BEARER = re.compile(r"\b(?:Bearer|Basic|Token)\s+(?P<value>[^\s\"'`<>{}$]{8,}+)(?=[\"'`\s]|$)")
_QUERY = re.compile(r"[?&](?:access_token|api_?key|token|auth|key|password|secret|client_secret|sig)=(?P<value>[^\s\"'`&<>{}$]{8,}+)", re.I)
_SQL_PW = re.compile(r"\b(?:PASSWORD|IDENTIFIED\s+BY)\s+'(?P<value>[^'\s]{6,}+)'", re.I)
_COMMENT = re.compile(r"(?<![\w.-])(?P<name>[A-Za-z]\w*+(?:[.-]\w++)*+)\s*(?:\bwas\b|\bis\b|->|:|=)\s*(?:(?P<value>[^\s\"'`,;()]{8,}+)(?=[\s,;)]|$)|[^\s\"'`,;()]++)")
_COMMENT_LINE = re.compile(r"\s*(?://|#|\*|/\*|--|;|<!--)")
_LOGIN = re.compile(r"\b(?:log_?in|password|passwd|pwd|credentials?|pass|secret|token)\s+(?:for|of|to)\s+[\w.@-]+\s*(?::|=|->|\bis\b)\s*(?P<value>[^\s\"'`,;()]{8,}+)", re.I)
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]*\d)[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_CONFIG_LINE = re.compile(r"^\s*(?:export\s+|-\s+)?[\"']?(?P<name>[\w.-]+)[\"']?\s*[=:]\s*(?P<value>[^\s\"'#;][^\s\"']{7,}+)\s*$", re.M)
# First characters that the formats of images, fonts, archives, documents, sound and compiled code have in base64, and names of what holds such data.
_BLOB = re.compile(r"iVBORw0KGgo|/9j/|R0lGOD|UklGR|PHN2Zy|PD94bW|AAABAA|d09G[Rg]|AAEAAAA|T1RUTw|UEsDB|H4sI|QlpoO|N3q8r|/Td6WF|KLUv/|JVBERi|SUQz|T2dnUw|AGFzbQ|f0VMR|TVqQ|yv66v")
_BLOB_NAME = re.compile(r"(?:^|_)(?:blob|data_?uri|wasm|bitmap|pixels?|sprite|texture|audio|video|pdf|zip|certificate|bytecode|source_?map)s?(?:$|_)")
# What makes a line worth a closer look: a run of at least eight characters with a figure, literals that are joined, the prefix of an
# issued token, or in lower case a word that every name of _SECRET_NAME or every context has; of "key" and the calls, what must stand beside it.
_RUN = re.compile(r"(?<![\w+/=@:#!%?*&$^~|\\.-])[A-Za-z_+/=@:#!%?*&$^~|\\.\x80-\U0010ffff-]*+\d[\w+/=@:#!%?*&$^~|\\.\x80-\U0010ffff-]*+")
_JOINT = re.compile(r"[\"'`]\s*(?:\+|\.|<>|~|\|\|)\s*[\"'`]")
_PREFIX = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "AIza", "npm_", "SG.", "eyJ", "pypi-", "hf_", "dop_v1_", "shpat_", "sq0", "EAACEdEose0cBA", "ya29.", "Basic")
_WORDS = ("pass", "pwd", "secret", "token", "auth", "bearer", "credential", "identified", "sig=")
_KEY = re.compile(r"(?:(?:api|access|signing|private|encryption|master|client|storage|account|license)[_.-]?|[?&])key")
_OPENS = re.compile(r"(?:log_?in|connect|open_?session|sign_?in|bind)\s*\(\s*[\"'`]|\blog_?in\s+(?:for|of|to)\s")


def _spots(text: str) -> list[int]:
    """Offsets of all that makes a line worth a closer look."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    out = [m.start() for m in _RUN.finditer(text) if m.end() - m.start() >= 8]
    out += [m.start() for m in _JOINT.finditer(text)]
    for where, words in ((text, _PREFIX), (low, _WORDS)):
        for word in words:
            at = where.find(word)
            while at >= 0:
                out.append(at)
                at = where.find("\n", at)  # one spot a line is enough
                at = where.find(word, at) if at >= 0 else -1
    if "key" in low:
        out += [m.start() for m in _KEY.finditer(low)]
    if "(" in low or "log" in low:
        out += [m.start() for m in _OPENS.finditer(low)]
    return sorted(out)


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]+$")
_B64 = re.compile(r"^[A-Za-z0-9+/_-]+={0,2}$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_WORDY = re.compile(r"^[A-Za-z]++(?:[-_./: ][A-Za-z]++)*+\d{0,3}$")
_PATHY = re.compile(r"^(?:[./~]?[a-z0-9_.-]*(?:/[a-z0-9_.-]+)+/?$|[.~]/|[A-Za-z]:\\|https?://|[\w-]+\.[a-z]{2,4}$|\d+(?:\.\d+)+$|\d{4}-\d\d)")


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def alphabet(value: str) -> str:
    return "hex" if _HEX.match(value) else "base64" if _B64.match(value) else "printable"


def _threshold(kind: str, n: int) -> float:
    """Bits a character that a random text of ``n`` characters reaches nearly always.

    Such a text shows fewer different characters when it is short, so the
    limit is a share of what its alphabet and its length allow.
    """
    size = {"hex": 16, "base64": 64, "printable": 94}[kind]
    return 0.82 * min(math.log2(size), math.log2(n)) if n > 1 else 9.0


def random_looking(value: str) -> bool:
    """Entropy above the length-adjusted threshold of the value's alphabet, and not made of words."""
    v = value.rstrip("=")
    if len(v) < 12 or _UUID.match(v) or _WORDY.match(v) or _PATHY.match(v):
        return False
    kind = alphabet(v)
    if kind != "hex" and not (any(c.isdigit() for c in v) and any(c.isalpha() for c in v)):
        return False
    return entropy(v) >= _threshold(kind, len(v))


def _password_like(value: str) -> bool:
    """A chosen password: at least eight characters of three kinds, or words with figures."""
    if len(value) < 8 or _PATHY.match(value) or _UUID.match(value):
        return False
    kinds = (any(c.islower() for c in value)) + (any(c.isupper() for c in value)) + (any(c.isdigit() for c in value)) + (any(not c.isalnum() for c in value))
    return kinds >= 3 or (any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= 2.5)


def _name(text: str) -> str:
    return _CAMEL.sub("_", text).lower().replace("-", "_").replace(".", "_")


def _usable(value: str, name: str | None, context: bool) -> bool:
    """Whether a value under a name, or in a context that only takes credentials, is one."""
    if _PLACEHOLDER.match(value) or _REFERENCE.search(value) or len(set(value)) < 5:
        return False
    if _ISSUED.match(value):
        return True
    if not context:
        key = _name(name) if name else ""
        secret, plain = _SECRET_NAME.search(key), _PLAIN_NAME.search(key)
        if not secret or (plain and plain.start() < secret.start()):  # the word that comes first tells what it is
            return False
    return random_looking(value) or _password_like(value)


def credentials_of(text: str | None, path: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each credential in a text, in order and without overlap.

    Spans cover the value only, so quotes, key names, hosts and the begin and
    end lines of a private key stay. Null and empty texts have none.
    """
    if not text:
        return []
    spans: dict[int, tuple[int, str]] = {}

    def add(a: int, b: int, kind: str) -> None:
        if b > a and (a not in spans or spans[a][0] < b):
            spans[a] = (b, kind)

    if "PRIVATE KEY" in text:
        for m in _PRIVATE.finditer(text):
            body = re.sub(r"\\[nr]|[\s\"'+,]", "", m["value"])
            if len(body) >= 16 and not _PLACEHOLDER.match(body) and len(set(body)) > 8:
                add(m.start(), m.end(), "private_key")
    if "://" in text and "@" in text:
        for m in _URL.finditer(text):
            if not _PLACEHOLDER.match(m["value"]) and not _REFERENCE.search(m["value"]) and len(m["value"]) >= 4:
                add(m.start("value"), m.end("value"), "url_password")
    upto = -1
    for spot in _spots(text):
        if spot < upto:
            continue
        at = text.rfind("\n", 0, spot) + 1
        upto = text.find("\n", spot)
        upto = len(text) if upto < 0 else upto
        while (end := _bare_end(text, at, upto)) > at and text[end - 1] in "\"'`+.~>|\\" and (more := _GOES_ON.match(text, end)) is not None:
            upto = more.end()
        for a, b, kind in _in_line(text[at:upto]):
            add(at + a, at + b, kind)
    out: list[tuple[int, int, str]] = []
    for a in sorted(spans, key=lambda x: (x, -spans[x][0])):
        b, kind = spans[a]
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
        elif b > out[-1][1] and out[-1][2] != "private_key":
            out[-1] = (out[-1][0], b, out[-1][2])
    return out


def _bare_end(text: str, at: int, upto: int) -> int:
    """Offset after the last character of a line that is not blank."""
    while upto > at and text[upto - 1] in " \t\r":
        upto -= 1
    return upto


def _parts_usable(value: str, name: str) -> bool:
    """Whether a quoted value with blanks under a secret name holds a part that no text in words has."""
    parts = value.split()
    return len(parts) > 1 and any(len(p) >= 6 and any(c.isdigit() for c in p) and any(c.isalpha() for c in p) and any(not c.isalnum() for c in p.rstrip(".,:;!?)")) for p in parts) and _usable(value.replace(" ", ""), name, False)


def _in_line(s: str) -> list[tuple[int, int, str]]:
    """Credentials within one line, or the lines of one joined literal; of any length, read whole."""
    out = [(m.start(), m.end(), "token") for m in _ISSUED.finditer(s) if not _PLACEHOLDER.match(m[0])]
    for p, kind in ((_CALL, "call"), (_BEARER, "header"), (_QUERY, "query"), (_SQL_PW, "sql_password"), (_LOGIN, "comment")):
        out += [(m.start("value"), m.end("value"), kind) for m in p.finditer(s) if "://" not in m["value"] and _usable(m["value"], None, True)]
    for m in _NAMED.finditer(s):
        start = m.end()
        while s[start : start + 1] in ("(", " "):
            start += 1
        j = _JOINED.match(s, start)
        if j:
            v = "".join([j["a"], *re.findall(r"[\"'`]([^\"'`]+)[\"'`]", j["more"])])
            u = _URL.match(v)
            if _ISSUED.match(v) or (u and _usable(u["value"], None, True)) or _usable(v, m["name"], False) or ("\n" not in j[0] and random_looking(v) and alphabet(v) == "base64" and not _BLOB.match(v) and not _PLAIN_NAME.search(_name(m["name"]))):
                out.append((start + 1, j.end() - 1, "joined"))
        elif (q := _QUOTED.match(s, m.end())) and "://" not in q["value"] and _usable(q["value"], m["name"], False):
            out.append((m.end() + 1, q.end() - 1, "named"))
        elif s[start : start + 1] in ("'", '"', "`") and _SECRET_NAME.search(_name(m["name"])) and (q := _PHRASE.match(s, m.end())) and " " in q["value"] and "://" not in q["value"] and _parts_usable(q["value"], m["name"]):
            out.append((m.end() + 1, q.end() - 1, "named"))
    if _COMMENT_LINE.match(s):
        out += [(m.start("value"), m.end("value"), "comment") for m in _COMMENT.finditer(s) if m["value"] and "://" not in m["value"] and _usable(m["value"].rstrip("."), m["name"], False)]
    else:
        c = _CONFIG_LINE.match(s)
        if c and "://" not in c["value"] and not re.search(r"[(){}\[\]]", c["value"]) and _usable(c["value"], c["name"], False):
            out.append((c.start("value"), c.end("value"), "config"))
    for m in _LONG.finditer(s):
        v = m[0]
        if alphabet(v) != "hex" and not _BLOB.match(v) and random_looking(v) and _loose(s, m.start()):
            out.append((m.start(), m.end(), "entropy"))
    return out


def _loose(line: str, at: int) -> bool:
    """Whether a long token that nothing names stands as a whole literal and nothing tells it is harmless."""
    before = line[:at].rstrip("\"'`")
    names = _NAMED.search(line[:at] + "x")
    name = _name(before[-120:])
    named = [n for m in _NAMED.finditer(before[-120:] + "x") if (n := _name(m["name"]))]
    if not names and line[at - 1 : at] in ("'", '"', "`"):
        head = line[: at - 1].rstrip()
        called = re.search(r"(\w+)\s*$", head[: head.rfind("(")][-120:]) if head.endswith(("(", ",")) and "(" in head else None
        return called is not None and not (_PLAIN_NAME.search(_name(called[1])) or _BLOB_NAME.search(_name(called[1])) or re.search(r"base64|data:|ssh-|sha\d+-|integrity|PUBLIC", line))
    if not names or (named and _BLOB_NAME.search(named[-1])) or re.search(r"-----(?:BEGIN|END)|base64|data:|ssh-|sha\d+-|integrity|PUBLIC", line) or _PLAIN_NAME.search(name):
        return False
    return line[:at][-1:] in "\"'`" or line[:at].rstrip()[-1:] in "=:"


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Text with each span replaced by a mark of the same alphabet; all else stays as it is.

    A private key keeps its begin and end lines and its line breaks. Joined
    literals keep their quotes and operators. The mark holds no quote, escape
    or bracket, so the code stays as valid as before.
    """
    if text is None:
        return None
    out, last = [], 0
    for a, b, kind in spans:
        v = text[a:b]
        if kind == "private_key":
            new = re.sub(r"(?P<keep>-----[A-Z0-9 ]+-----|\\[nr]|[\s\"'+,`]+)|[^\s\"'+,`\\-]+|.", lambda m: m["keep"] or "REDACTED"[: max(1, len(m[0]))], v)
        elif kind == "joined":
            new = re.sub(r"[^\"'`]+", lambda m: m[0] if re.fullmatch(r"\s*(?:\+|\.|<>|~|\|\||\\)?\s*", m[0]) else "REDACTED", v)
        else:
            new = "REDACTED"
        out += [text[last:a], new]
        last = b
    return "".join(out) + text[last:]


def credentials(files: DataFrame, with_text: bool = False) -> DataFrame:
    """Place and kind of each credential: ordinal, line_number, start, length, kind.

    With ``with_text``: one row for each ordinal with the redacted text
    instead (ordinal, found, source_code). Null texts hold none and stay null;
    repeated rows of one ordinal count once.
    """
    picked = files.select("ordinal", "file_path", "source_code")
    if with_text:
        def clean(b: dict[str, list]) -> dict[str, list]:
            got = [credentials_of(t, p) for t, p in zip(b["source_code"], b["file_path"], strict=True)]
            return {"ordinal": b["ordinal"], "found": [len(x) for x in got], "source_code": [redacted(t, x) for t, x in zip(b["source_code"], got, strict=True)]}

        return rows(picked, clean, "ordinal long, found int, source_code string").dropDuplicates(["ordinal"])

    def find(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("ordinal", "line_number", "start", "length", "kind")}
        for o, p, t in zip(b["ordinal"], b["file_path"], b["source_code"], strict=True):
            spans = credentials_of(t, p)
            if spans:
                breaks = [m.start() for m in re.finditer("\n", t)]
                for a, z, kind in spans:
                    for k, v in zip(out, (o, bisect_right(breaks, a) + 1, a, z - a, kind), strict=True):
                        out[k].append(v)
        return out

    return rows(picked, find, "ordinal long, line_number int, start int, length int, kind string").dropDuplicates(["ordinal", "line_number", "start"])


def credential_rates(found: DataFrame, files: DataFrame) -> DataFrame:
    """Files, files with a credential and credentials for each extension of file_path; null paths are one group."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    every = files.select("ordinal", ext.alias("extension")).dropDuplicates(["ordinal"])
    n = found.groupBy("ordinal").agg(F.count("*").alias("n"))
    return every.join(n, "ordinal", "left").groupBy("extension").agg(F.count("*").alias("files"), F.count("n").alias("files_with"), F.coalesce(F.sum("n"), F.lit(0)).alias("credentials"))
