"""Problem 5: generated, minified, vendored files and data saved as code."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import language, rows
from codelake.llm.lexing import LIT, mask

# Fixed names of folders and file endings that tools and package managers use.
_VENDOR_DIR = r"(?i)(?:^|/)(?:vendor|vendored|third[_-]?party|3rd[_-]?party|thirdparty|external|externals|deps|node_modules|bower_components|jspm_packages|Pods|Carthage|site-packages|dist-packages|\.bundle|_vendor|Godeps|extlib|extern|contrib/vendor)/"
_GENERATED_DIR = r"(?i)(?:^|/)(?:generated|gen|autogen|__generated__|generated[_-]sources|codegen|build/out|auto_generated)/"
_GENERATED_FILE = r"(?i)(?:\.(?:g|gen|generated|pb|pbgrpc|freezed|designer|grpc|gr|config\.g)\.\w+|_pb2(?:_grpc)?\.py|_pb\.(?:js|ts|rb|d\.ts)|\.pb\.(?:go|cc|h|swift)|[_.-](?:generated|gen|autogen)\.\w+|\.g\.dart|_grpc_pb\.\w+|_string\.go|\.designer\.cs|_mock\.gen\.\w+)$"
_MINIFIED_FILE = r"(?i)[.-](?:min|bundle|bundled|packed|prod|umd\.min|chunk|compressed)\.(?:js|mjs|cjs|css|jsx|ts)$|\.chunk\.\w+$"

# Fixed wording of tool headers. A header is a comment near the start or the end of a file.
_GENERATED_TEXT = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?(?:matically )?generated(?: file| code|\s+on|\s+by|\s+from|[,.!;]| -)|\bcode generated (?:by|from)\b|\bgenerated by (?:the )?[\w.-]+(?: (?:compiler|generator|tool|plugin))?\b.{0,60}(?:do not|don't|never)|\bgenerated (?:from|using|with) [\w./-]+\.(?:proto|idl|schema|tmpl|g4|y|l|json|ya?ml|xsd|wsdl|thrift|avsc)\b|\b(?:this )?(?:file|code|class) (?:was|is|has been) (?:automatically |auto-?)?(?:generated|created|produced|written) (?:by|from|on)\b|\bdo not (?:edit|modify|change)(?: (?:this file|it))?(?: by hand|manually|;|!|\.|$)|\bchanges (?:will|may) be (?:lost|overwritten)|\bmachine-?(?:made|generated|written)\b|\b(?:this is )?build output\b|\bregenerate (?:with|using|by)\b|\bfichier (?:produit|généré|genere)|\bne pas (?:modifier|éditer)|\bautomatisch (?:erzeugt|generiert|erstellt)|\bnicht (?:von hand |manuell )?(?:ändern|bearbeiten|editieren)|\b(?:archivo|fichero|código) generado|\bno (?:editar|modificar)\b|\b(?:edit|change) [\w./-]+\.(?:tmpl|tpl|idl|proto|schema|in|erb|j2) instead\b", re.I)
# Fixed wording that tools put into what they write and nobody else does: it counts wherever a comment line holds it.
_MARK = re.compile(r"@generated\b|<auto-?generated\b|\bcode generated (?:by|from)\b.*\bdo not edit\b", re.I)
# Fixed words of which every header of ``_GENERATED_TEXT`` or ``_VENDOR_TEXT`` holds one.
_TELLING = ("generated", "do not", "don't", "changes", "machine", "build output", "regenerate", "fichier", "ne pas", "automatisch", "von hand", "nicht", "archivo", "fichero", "código", "no edit", "no modif", " instead")
_FOREIGN = ("copied", "upstream", "distributed under", "copyright", "vendored", "this file is part of", "keep unmodified")
_VENDOR_TEXT = re.compile(
    r"\bcopied (?:verbatim )?from (?P<a>[\w.@/-]+) v?\d+[\w.]*|^\W*(?P<b>[\w.@/-]+) v?\d+\.\d[\w.]*\s*\|[^|\n]*\|\s*upstream\b|\bupstream:\s*https?://(?P<c>[\w.-]+)|\bdistributed under the terms of the [\w .-]+ licen[cs]e by the (?P<d>[\w.-]+) (?:project|team|authors)|\bcopyright (?:\(c\)|©)(?: \d{4}(?:-\d{4})?,?)? the (?P<e>[\w.-]+) (?:contributors|authors|developers|project|team|foundation)|\bvendored (?:from|copy of) (?P<f>[\w.@/-]+)|\bthis file is part of (?:the )?(?P<g>[\w.-]+)|\bcopyright (?:\(c\) |© )?\d{4}(?:-\d{4})?,? the (?P<h>[\w.-]+) (?:contributors|authors|developers|project|team|foundation)|\bkeep unmodified\b", re.I | re.M)
_BANNER = re.compile(r"\A\s*/\*!.{0,200}", re.S)
_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!include|define|if|pragma)|/\*|\*|--|<!--|\"\"\"|''')")

_NUMBER = re.compile(r"(?<![\w.])-?(?:0x[0-9A-Fa-f]+|\d[\d_.]*(?:[eE][-+]?\d+)?)\w?")
_SPACE = re.compile(r"\s+")
_KEEP = re.compile(r"[A-Za-z_]{2,}")
_CSV_LINE = re.compile(r"^[^,;\t\n]{0,80}([,;\t])(?:[^\n]*\1)+[^\n(){}=]*$", re.M)
_SQL_ROW = re.compile(r"^\s*INSERT\s+INTO\b[^\n]*\bVALUES\b[^\n]*;\s*$|^\s*\([^()\n]*\)\s*[,;]\s*$", re.I | re.M)

LONG_LINE, LEAST_TEXT, LEAST_DATA, LEAST_ROWS = 300, 600, 1_200, 25


def comment_lines(lang: str, text: str) -> list[tuple[str, bool]]:
    """Whole lines of comment, each with whether no code stands before it or none after it; of any number and length."""
    masked = mask(lang, text)
    raw, bare = text.split("\n"), masked.split("\n")
    if len(raw) != len(bare):
        return [(x, True) for x in raw if _COMMENT_LINE.match(x)]
    code = [k for k, x in enumerate(bare) if x.strip() and not (x.strip() == LIT and _COMMENT_LINE.match(raw[k])) and not raw[k].startswith("#!")]
    first, last = (code[0], code[-1]) if code else (len(raw), -1)
    return [(x, k < first or k > last) for k, x in enumerate(raw) if x.strip() and (k < first or k > last or not bare[k].strip())]


def headers_of(lang: str, text: str) -> tuple[bool, list[str] | None]:
    """(written by a tool, holders of third-party marks) as the comments of a text say; None for no third-party mark.

    The wording counts in the comments before the first and after the last
    line of code, however long they are; what only tools write counts in any comment.
    """
    low = text.lower()
    tool, foreign = any(w in low for w in _TELLING), any(w in low for w in _FOREIGN)
    if not tool and not foreign:
        return False, None
    generated, holders, found = False, [], False
    for line, outer in comment_lines(lang, text.replace("\r\n", "\n")):
        if tool and not generated:
            generated = bool((_GENERATED_TEXT if outer else _MARK).search(line))
        if foreign and outer and (m := _VENDOR_TEXT.search(line)):
            found = True
            who = next((v for v in m.groupdict().values() if v), None)
            holders.append(who.lower().split(".")[0] if who else "")
    return generated, holders if found else None


def data_share(masked: str, text: str) -> float:
    """Share of a text's characters without blanks that are literals, figures and the signs between them."""
    whole = len(_SPACE.sub("", text))
    bare = _SPACE.sub("", _NUMBER.sub("", masked.replace(LIT, "")))
    words = sum(map(len, _KEEP.findall(bare)))
    return 1.0 - words / whole if whole else 0.0


def flags_of(lang: str | None, text: str | None) -> tuple[bool, bool, bool, list[str] | None]:
    """(generated, minified, data, holders of third-party marks) as the text shows.

    None of it for files without a language (configuration) and for null
    texts. Text of fewer than ``LEAST_TEXT`` characters is never minified and
    tables below ``LEAST_DATA`` characters are never data: short constant
    tables are no cases.
    """
    if not lang or not text:
        return False, False, False, None
    generated, holders = headers_of(lang, text)
    minified = False
    if len(text) >= LEAST_TEXT and max(map(len, text.split("\n"))) > LONG_LINE:
        masked = mask(lang, text.replace("\r\n", "\n")) if lang != "html" else text
        dense = sum(len(x) for x in masked.split("\n") if len(x) > LONG_LINE and x.count(" ") < 0.12 * len(x))
        minified = lang in ("javascript", "typescript", "html", "sql") and dense > 0.5 * len(_SPACE.sub("", masked) or "x") and dense > LONG_LINE
    data = not minified and not generated and len(text) >= LEAST_DATA and _is_data(lang, text)
    return generated, minified, data, holders


def _is_data(lang: str, text: str) -> bool:
    """Rows of values or one great literal instead of code; short constant tables are none."""
    lines = [x for x in text.split("\n") if x.strip()]
    if lang == "html":
        return False
    first = text.lstrip()[:1]
    masked = mask(lang, text.replace("\r\n", "\n"))
    if first in "{[" and re.match(r"\s*[{\[]\s*(?:[\"{\[\d]|$)", text) and data_share(masked, text) > 0.9:
        return True
    if lang != "sql" and len(lines) >= LEAST_ROWS and len(_CSV_LINE.findall(text)) > 0.9 * len(lines) and not re.search(r"[{}();]\s*$", text, re.M):
        return True
    if lang == "sql":
        return len(lines) >= LEAST_ROWS and len(_SQL_ROW.findall(text)) > 0.9 * len(lines)
    return data_share(masked, text) > 0.9 and (len(lines) >= LEAST_ROWS or max(map(len, lines)) > LEAST_DATA)


def _leaf(text: str) -> tuple[str, int]:
    """Hash and length of a file's text without blanks and comment lines, so headers and re-indentation don't count."""
    body = "\n".join(x for x in text.split("\n") if not _COMMENT_LINE.match(x))
    bare = _SPACE.sub("", body)
    return hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest(), len(bare)


LEAST_TREE = 1_000  # characters without blanks that a tree, or a single file, must have to tell something when it occurs twice
OWN_PART = 0.5  # a repository of which more than this part of the files occurs elsewhere is a fork or the source of the copies


def own_flags(files: DataFrame) -> DataFrame:
    """What a text shows, with its leaf hash and its size for the Merkle tree; one row for each ordinal."""
    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("ordinal", "scan_id", "language", "file_path", "generated", "minified", "data", "holders", "leaf", "size")}
        for o, s, lang, p, t in zip(b["ordinal"], b["scan_id"], b["language"], b["file_path"], b["source_code"], strict=True):
            leaf, size = _leaf(t) if t and lang else (None, 0)
            for k, x in zip(out, (o, s, lang, p, *flags_of(lang, t), leaf, size), strict=True):
                out[k].append(x)
        return out

    picked = files.select("ordinal", "scan_id", language().alias("language"), "file_path", "source_code")
    return rows(picked, run, "ordinal long, scan_id string, language string, file_path string, generated boolean, minified boolean, data boolean, holders array<string>, leaf string, size long").dropDuplicates(["ordinal"])


def plain_path(path: str | Column) -> Column:
    """A path with forward slashes, one at a time, without drive, leading dots and single dots, with a slash in front."""
    c = F.regexp_replace(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")), r"[\\/]+", "/")
    c = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]:", ""), r"(^|/)(?:\./)+", "$1")
    return F.concat(F.lit("/"), F.regexp_replace(c, r"^\.?/+", ""))


def placed(flags: DataFrame, scans: DataFrame | None) -> DataFrame:
    """Adds repo and inside: the repository, and the path within it.

    The repository is the project of the file's scan (the scan itself if that
    is unknown), and its folder is the scan's source_dir. A path outside of
    that folder, as one of another machine, begins after the folder of the project's name, if it has one.
    """
    path = plain_path("file_path")
    if scans is None:
        return flags.withColumn("repo", F.coalesce("scan_id", F.lit(""))).withColumn("inside", F.regexp_replace(path, "^/", ""))
    known = scans.select("scan_id", F.col("project_name").alias("_project"), F.regexp_replace(plain_path("source_dir"), "/$", "").alias("_root")).dropDuplicates(["scan_id"])
    at = F.instr(path, F.concat(F.lit("/"), F.col("_project"), F.lit("/")))
    inside = (
        F.when((F.length("_root") > 1) & F.startswith(path, F.concat("_root", F.lit("/"))), F.substr(path, F.length("_root") + 2))
        .when(at > 0, F.substr(path, at + F.length("_project") + 2)).otherwise(F.substr(path, F.lit(2)))
    )
    return flags.join(known, "scan_id", "left").withColumn("repo", F.coalesce("_project", "scan_id", F.lit(""))).withColumn("inside", inside).drop("_project", "_root")


def _of_children() -> Column:
    """Hash of a folder from its children's hashes in any order: their number, a sum and an exclusive or of two hashes of each.

    These merge, so a folder of any number of files is pre-aggregated before
    the shuffle and never held in one task.
    """
    one, two = F.xxhash64(F.lit("a"), "hash"), F.xxhash64(F.lit("b"), "hash")
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(one.cast("decimal(20,0)")).cast("string"), F.bit_xor(two).cast("string")), 256)


def merkle(leaves: DataFrame) -> DataFrame:
    """Merkle hashes of all folders of each repository, from the leaves upwards.

    ``leaves``: repo, inside (path within it), leaf, size. The hash of a
    folder is that of the multiset of its children's hashes, so names don't
    count and the same tree under another name has the same hash. Result: repo,
    path, depth, hash, files, size; files without a leaf hash take part as an
    empty child. Each level is one aggregation over the level below, written
    to the checkpoint folder, so the plan stays as small for deep trees.
    """
    from codelake.llm.common import checkpointed

    nodes = checkpointed(leaves.select("repo", F.col("inside").alias("path"), F.size(F.split("inside", "/")).alias("depth"), F.coalesce("leaf", F.lit("")).alias("hash"), F.lit(1).cast("long").alias("files"), F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    out, below = nodes, nodes.filter(F.col("depth") == deepest)
    for depth in range(deepest, 1, -1):
        up = checkpointed(below.groupBy("repo", parent.alias("path")).agg(_of_children().alias("hash"), F.sum("files").alias("files"), F.sum("size").alias("size")).select("repo", "path", F.lit(depth - 1).alias("depth"), "hash", "files", "size"))
        below = nodes.filter(F.col("depth") == depth - 1).unionByName(up)
        out = out.unionByName(up)
    return out


def shared_files(flags: DataFrame) -> DataFrame:
    """Ordinals of files below a tree that also occurs in an unrelated repository.

    A tree (a folder or a single file) of at least ``LEAST_TREE`` characters
    counts if its Merkle hash occurs in two repositories. Where more than
    ``OWN_PART`` of a repository's files lie in such trees, it is a fork or the
    source that others copied from, and its own files are not marked.
    """
    tree = merkle(flags.select("repo", "inside", "leaf", "size"))
    common = tree.filter((F.col("hash") != "") & (F.col("size") >= LEAST_TREE)).groupBy("hash").agg(F.min("repo").alias("r0"), F.max("repo").alias("r1")).filter("r0 <> r1")
    at = tree.join(common.select("hash"), "hash", "left_semi").select("repo", F.col("path").alias("node")).distinct()
    steps: Column = F.split("inside", "/")
    up = flags.filter("leaf is not null").select("ordinal", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("node"))
    hit = up.join(at, ["repo", "node"], "left_semi").select("ordinal", "repo").distinct()
    part = hit.groupBy("repo").agg(F.count("*").alias("hits")).join(flags.filter("leaf is not null").groupBy("repo").agg(F.count("*").alias("all")), "repo")
    return hit.join(part.filter(F.col("hits") <= F.col("all") * OWN_PART), "repo", "left_semi").select("ordinal")


def origin_flags(files: DataFrame, scans: DataFrame | None = None, by_path: bool = True) -> DataFrame:
    """One row for each ordinal: generated, minified, vendored, data, shared, hand_written.

    ``shared``: the file lies in a tree whose Merkle hash also occurs in an
    unrelated repository (``shared_files``); such a file counts as vendored.
    ``scans`` gives the project of each scan; without it a scan is a repository
    of its own. ``by_path=False`` leaves out the rules on names of folders and
    files. Files without a language and null texts are never flagged. Null
    paths are judged by text alone. Repeated rows of one ordinal count once.
    """
    from codelake.llm.common import checkpointed

    flags = checkpointed(placed(own_flags(files), scans))
    shared = shared_files(flags.filter("language is not null")).withColumn("shared", F.lit(True))
    seen = F.col("language").isNotNull() & F.col("leaf").isNotNull() & F.lit(by_path)
    path = F.concat(F.lit("/"), F.col("inside"))
    own = F.array(F.lower("repo"), F.lit("authors"), F.lit("project"), F.lit("team"))
    foreign = F.coalesce(F.size(F.array_except("holders", own)) > 0, F.lit(False))
    minified = F.col("minified") | (seen & path.rlike(_MINIFIED_FILE))
    return flags.join(shared, "ordinal", "left").select(
        "ordinal", "scan_id", "language", F.coalesce("shared", F.lit(False)).alias("shared"),
        (F.col("generated") | (seen & (path.rlike(_GENERATED_DIR) | path.rlike(_GENERATED_FILE)))).alias("generated"), minified.alias("minified"),
        (foreign | F.coalesce("shared", F.lit(False)) | (seen & path.rlike(_VENDOR_DIR))).alias("vendored"), (F.col("data") & ~minified).alias("data"),
    ).select("ordinal", "scan_id", "language", "generated", "minified", "vendored", "data", "shared", (~(F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data"))).alias("hand_written"))
