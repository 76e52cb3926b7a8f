"""Exports of formatted blocks: folders by language, packages, manifests, indexes, documentation, archives."""

from __future__ import annotations

import json
import os
import re
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelake.batches import rows
from codelake.functions.text import safe_filename
from codelake.parse.clean import file_content

# Fixed endings of exported files by language.
ENDINGS = {"python": ".py", "javascript": ".js", "typescript": ".ts", "dart": ".dart", "rust": ".rs", "go": ".go", "java": ".java", "cpp": ".cpp", "ruby": ".rb", "swift": ".swift", "kotlin": ".kt", "csharp": ".cs", "sql": ".sql", "html": ".html"}


def exported_files(formatted: DataFrame, key: str = "ordinal") -> DataFrame:
    """(language, path, content) of the files of a folder export; of blocks with one path the last by key counts."""
    ending = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ENDINGS.items() for x in kv)), F.coalesce("language", F.lit(""))), F.lit(".txt"))
    folder = F.coalesce("language", F.lit("other"))
    f = formatted.withColumn("path", F.concat(folder, F.lit("/"), safe_filename(F.coalesce("name", F.lit("unnamed"))), ending))
    w = Window.partitionBy("path").orderBy(F.desc(key))
    f = f.withColumn("r", F.row_number().over(w)).filter("r = 1")

    def content(b: dict[str, list]) -> dict[str, list]:
        return {"language": b["language"], "path": b["path"], "content": [file_content(c or "", h or "", lang) for c, h, lang in zip(b["source_code"], b["header"], b["language"], strict=True)]}

    return rows(f.select("language", "path", "source_code", "header"), content, "language string, path string, content string")


def index_lines(formatted: DataFrame) -> DataFrame:
    """(language, content): an index of the exported names of each language, in its own syntax."""
    f = formatted.select(F.coalesce("language", F.lit("other")).alias("language"), F.coalesce("name", F.lit("unnamed")).alias("name")).distinct().withColumn("file", safe_filename("name"))
    line = (
        F.when(F.col("language") == "python", F.concat(F.lit("from ."), "file", F.lit(" import "), "name"))
        .when(F.col("language").isin("javascript", "typescript"), F.concat(F.lit("export { "), "name", F.lit(" } from './"), "file", F.lit("';")))
        .when(F.col("language") == "dart", F.concat(F.lit("export '"), "file", F.lit(".dart';"))).when(F.col("language") == "rust", F.concat(F.lit("pub mod "), "file", F.lit(";"))).when(F.col("language") == "ruby", F.concat(F.lit("require_relative '"), "file", F.lit("'")))
        .when(F.col("language") == "cpp", F.concat(F.lit('#include "'), "file", F.lit('.cpp"'))).when(F.col("language") == "sql", F.concat(F.lit("\\i "), "file", F.lit(".sql"))).otherwise(F.concat("name", F.lit(": "), "file")))
    return f.groupBy("language").agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("content"))


def manifest(formatted: DataFrame, source_dir: str, as_of: str) -> DataFrame:
    """One row with a JSON text: where, when, how many, and a summary of each kind by language; rows of items stay in the table."""
    per = formatted.groupBy("language", "block_type").agg(F.count("*").alias("items"), F.count_if(~F.col("is_valid")).alias("invalid"))
    return per.agg(F.to_json(F.struct(F.lit(source_dir).alias("source"), F.lit(as_of).alias("created"), F.coalesce(F.sum("items"), F.lit(0)).alias("total"), F.sort_array(F.collect_list(F.struct("language", "block_type", "items", "invalid"))).alias("kinds"))).alias("manifest"))


def readme(formatted: DataFrame) -> DataFrame:
    """One row with a Markdown table of the exported kinds and the number of warnings."""
    per = formatted.groupBy(F.coalesce("language", F.lit("other")).alias("language"), "block_type").agg(F.count("*").alias("n"), F.sum(F.size("warnings")).alias("w"))
    line = F.concat(F.lit("| "), "language", F.lit(" | "), "block_type", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("w").cast("string"), F.lit(" |"))
    return per.agg(F.concat(F.lit("# Extracted code\n\n| Language | Kind | Items | Warnings |\n|-|-|-|-|\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("readme"))


def primary_language(formatted: DataFrame, key: str = "ordinal") -> DataFrame:
    """One row: the most frequent language, that of the earliest block among equals."""
    return formatted.groupBy("language").agg(F.count("*").alias("n"), F.min(key).alias("first")).orderBy(F.desc("n"), "first").limit(1).select("language")


def package_manifest(language: str | None, name: str, version: str) -> tuple[str, str]:
    """(file name, text) of the package description that a language expects."""
    if language in ("javascript", "typescript"):
        d = {"name": name, "version": version, "main": "src/index.js", **({"types": "src/index.d.ts"} if language == "typescript" else {}), "keywords": ["extracted"]}
        return "package.json", json.dumps(d, indent=2)
    if language == "dart":
        return "pubspec.yaml", f"name: {name.replace('-', '_')}\nversion: {version}\ndescription: Extracted code package\nenvironment:\n  sdk: '>=3.0.0 <4.0.0'\n"
    if language == "rust":
        return "Cargo.toml", f'[package]\nname = "{name}"\nversion = "{version}"\nedition = "2021"\n\n[dependencies]\n'
    return "pyproject.toml", f'[build-system]\nrequires = ["setuptools>=68.0", "wheel"]\nbuild-backend = "setuptools.build_meta"\n\n[project]\nname = "{name}"\nversion = "{version}"\ndescription = "Extracted code package"\nrequires-python = ">=3.10"\n'


def docs_markdown(sections: DataFrame) -> DataFrame:
    """(block_type, content): Markdown of the documentation, a part for each kind."""
    one = F.concat(F.lit("### "), "qualified_name", F.lit("\n\n`"), "signature", F.lit("`\n\n"), "description", F.when(F.size("members") > 0, F.concat(F.lit("\n\n- `"), F.array_join("members", "`\n- `"), F.lit("`"))).otherwise(""), F.lit("\n"))
    head = F.concat(F.lit("## "), F.initcap(F.replace("block_type", F.lit("_"), F.lit(" "))), F.lit("s\n\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("qualified_name", "ordinal", one.alias("t")))), lambda x: x["t"]), "\n")
    return sections.groupBy("block_type").agg(F.concat(F.first(head), body).alias("content"))


def write_folder(files: DataFrame, folder: str) -> DataFrame:
    """Writes each file below a folder that all executors share and returns (path, bytes), written once by its action.

    A path that would leave the folder is refused. The write is repeatable: a
    task that runs again writes the same files.
    """
    def put(b: dict[str, list]) -> dict[str, list]:
        sizes = []
        for p, c in zip(b["path"], b["content"], strict=True):
            full = os.path.realpath(os.path.join(folder, p))
            if not full.startswith(os.path.realpath(folder) + os.sep):
                raise ValueError(f"path leaves the folder: {p}")
            os.makedirs(os.path.dirname(full), exist_ok=True)
            data = c.encode()
            with open(f"{full}.{os.getpid()}.part", "wb") as f:
                f.write(data)
            os.replace(f"{full}.{os.getpid()}.part", full)
            sizes.append(len(data))
        return {"path": b["path"], "bytes": sizes}

    return rows(files.select("path", "content"), put, "path string, bytes long")


def write_package(formatted: DataFrame, folder: str, name: str, version: str = "0.1.0") -> dict:
    """A package of all blocks: sources below src, the description of the primary language, an index and a manifest."""
    lang = [r[0] for r in primary_language(formatted).collect()]
    files = exported_files(formatted).withColumn("path", F.concat(F.lit("src/"), F.regexp_replace("path", r"^[^/]*/", "")))
    n = write_folder(files, folder).count()
    file, text = package_manifest(lang[0] if lang else None, name, version)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, file), "w", encoding="utf-8") as f:
        f.write(text)
    return {"folder": folder, "files": n, "manifest": file, "language": lang[0] if lang else None}


def write_zip(folder: str, target: str) -> str:
    """Archive of an exported folder."""
    return shutil.make_archive(re.sub(r"\.zip$", "", target), "zip", folder)
