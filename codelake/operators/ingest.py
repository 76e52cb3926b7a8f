"""From file texts to items and blocks, and from blocks to cleaned and formatted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.batches import rows
from codelake.parse import clean as C
from codelake.parse import extract_item, scan_text

_ITEM = ("scan_id", "item_id", "name", "qualified_name", "block_type", "language", "file_path", "line_number", "end_line", "parent", "scanner", "place")
_ITEM_SCHEMA = "scan_id string, item_id string, name string, qualified_name string, block_type string, language string, file_path string, line_number int, end_line int, parent string, scanner int, place int"
_BLOCK_SCHEMA = _ITEM_SCHEMA + ", source_code string, imports array<string>, decorators array<string>, type_references array<string>"


def scan(files: DataFrame, with_code: bool = False) -> DataFrame:
    """Items of each file (scan_id, file_path, source_code), with their blocks' columns if ``with_code``.

    Each file is read and parsed once. Files that can't be parsed and null
    texts have no items; items whose text isn't found have no block.
    """
    schema = _BLOCK_SCHEMA if with_code else _ITEM_SCHEMA
    names = [*_ITEM, *(("source_code", "imports", "decorators", "type_references") if with_code else ())]

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in names}
        for s, p, t in zip(b["scan_id"], b["file_path"], b["source_code"], strict=True):
            if not p or not t:
                continue
            for k, i in enumerate(scan_text(p, t)):
                row = (s, f"{p}:{i.line}", i.name, i.qualified, i.block_type, i.language, p, i.line, i.end, i.parent, i.rank, k)
                if with_code:
                    x = extract_item(t, i)
                    if x is None:
                        continue
                    row = (*row, *(x[n] for n in names[12:]))
                for n, v in zip(names, row, strict=True):
                    out[n].append(v)
        return out

    return rows(files.select("scan_id", "file_path", "source_code"), run, schema)


def numbered(items: DataFrame) -> DataFrame:
    """Adds ordinal, the place in the order of (file_path, line, scanner, place) within each scan, from 1.

    Files are counted first and shifted by the items before them, so the
    windows run over files, not over all items of a scan.
    """
    from pyspark.sql.window import Window

    per = items.groupBy("scan_id", "file_path").agg(F.count("*").alias("n"))
    w = Window.partitionBy("scan_id").orderBy("file_path")
    start = per.select("scan_id", "file_path", (F.sum("n").over(w) - F.col("n")).alias("before"))
    k = F.row_number().over(Window.partitionBy("scan_id", "file_path").orderBy("line_number", "scanner", "place"))
    return items.withColumn("k", k).join(start, ["scan_id", "file_path"]).withColumn("ordinal", F.col("before") + F.col("k")).drop("k", "before", "scanner", "place")


def cleaned(blocks: DataFrame, key: str = "ordinal") -> DataFrame:
    """key, source_code, required_imports, warnings of each block."""
    def run(b: dict[str, list]) -> dict[str, list]:
        got = [C.clean(t, i) for t, i in zip(b["source_code"], b["imports"], strict=True)]
        return {key: b[key], "source_code": [g[0] for g in got], "required_imports": [g[1] for g in got], "warnings": [g[2] for g in got]}

    return rows(blocks.select(key, "source_code", "imports"), run, f"{key} {dict(blocks.dtypes)[key]}, source_code string, required_imports array<string>, warnings array<string>")


def formatted(blocks: DataFrame, as_of: str, key: str = "ordinal") -> DataFrame:
    """Blocks ready for export: key, name, block_type, language, source_code with its imports, header, is_valid, validation_error, warnings.

    ``as_of`` is the day in the headers. Null texts count as empty.
    """
    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in (key, "name", "block_type", "language", "source_code", "header", "is_valid", "validation_error", "warnings")}
        for i in range(len(b[key])):
            code, imports, warnings = C.clean(b["source_code"][i], b["imports"][i])
            body = C.formatted(code, b["language"][i])
            full = "\n".join([*imports, "", body]) if imports else body
            ok, why = C.validated(full, b["language"][i])
            head = C.header(b["qualified_name"][i] or "", b["block_type"][i] or "", b["file_path"][i] or "", b["line_number"][i] or 0, as_of, warnings)
            for n, v in zip(out, (b[key][i], b["name"][i], b["block_type"][i], b["language"][i], full, head, ok, why, warnings), strict=True):
                out[n].append(v)
        return out

    cols = list(dict.fromkeys([key, "name", "qualified_name", "block_type", "language", "file_path", "line_number", "source_code", "imports"]))
    kind = dict(blocks.dtypes)[key]
    return rows(blocks.select(*cols), run, f"{key} {kind}, name string, block_type string, language string, source_code string, header string, is_valid boolean, validation_error string, warnings array<string>")
