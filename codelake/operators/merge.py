"""Merging scans and validating the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed groups of languages that build together, and kinds of SQL block.
GROUPS = {"javascript": "js_ts", "typescript": "js_ts", "html": "js_ts", "java": "jvm", "kotlin": "jvm", "python": "python", "dart": "dart", "rust": "rust", "go": "go", "cpp": "cpp", "ruby": "ruby", "swift": "swift", "csharp": "csharp", "sql": "sql"}
SQL_KINDS = ("table", "view", "trigger", "policy", "migration", "index", "sql_function")


def merged(blocks: DataFrame) -> DataFrame:
    """Adds the composite key ``scan_id::item_id``; one row for each key, the last by ordinal."""
    w = Window.partitionBy("key").orderBy(F.desc("ordinal"))
    return blocks.withColumn("key", F.concat_ws("::", "scan_id", "item_id")).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def naming_conflicts(m: DataFrame, scans: DataFrame) -> DataFrame:
    """Names that two projects or more use: name, items, projects."""
    p = m.join(F.broadcast(scans.select("scan_id", "project_name").dropDuplicates(["scan_id"])), "scan_id", "left")
    return p.groupBy("name").agg(F.count("*").alias("items"), F.count_distinct("project_name").alias("projects")).filter("items >= 2 and projects >= 2")


def group_of(lang: Column) -> Column:
    """Group of a language; null for languages without one."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv)), F.coalesce(lang, F.lit("")))


def language_groups(m: DataFrame) -> DataFrame:
    """Groups of runtime languages with their blocks and first two keys; more than one group doesn't build."""
    g = m.withColumn("grp", group_of(F.col("language"))).filter("grp is not null and grp <> 'sql'")
    w = Window.partitionBy("grp").orderBy("ordinal")
    n = g.groupBy("grp").agg(F.count("*").alias("blocks"))
    two = g.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "key"))), lambda x: x["key"]).alias("examples"))
    return n.join(two, "grp")


def orphans(m: DataFrame) -> DataFrame:
    """Methods whose parent is neither a name nor a qualified name of the merge: key, name, parent."""
    known = m.select(F.explode(F.array("name", "qualified_name")).alias("parent")).distinct()
    return m.filter("block_type = 'method' and parent is not null").join(known, "parent", "left_anti").select("key", "name", "parent", "ordinal")


def unresolved(m: DataFrame) -> DataFrame:
    """Type references that no name of the merge meets: key, reference, once for each block."""
    known = m.select(F.explode(F.array("name", "qualified_name")).alias("reference")).distinct()
    return m.select("key", F.explode(F.array_distinct("type_references")).alias("reference")).join(known, "reference", "left_anti").select("key", "reference")


def issues(m: DataFrame, scans: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """All findings: severity, rule, items; the costly rules only where the cycles (item_id, component) are given."""
    lang = language_groups(m).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("error").alias("severity"), F.lit("language_coherence").alias("rule"), F.col("n").alias("items"))
    kinds = m.agg(F.count_if(F.col("block_type").isin(*SQL_KINDS)).alias("sql_n"), F.count_if(~F.col("block_type").isin(*SQL_KINDS)).alias("other_n")).filter("sql_n > 0 and other_n > 0").select(F.lit("error").alias("severity"), F.lit("sql_isolation").alias("rule"), F.col("sql_n").alias("items"))
    orphan = orphans(m).agg(F.count("*").alias("items")).filter("items > 0").select(F.lit("warning").alias("severity"), F.lit("orphaned_methods").alias("rule"), "items")
    out = lang.unionByName(kinds).unionByName(orphan)
    if cycles is not None:
        refs = unresolved(m).agg(F.count_distinct("key").alias("items")).filter("items > 0").select(F.lit("warning").alias("severity"), F.lit("unresolved_references").alias("rule"), "items")
        circ = cycles.agg(F.count_distinct("component").alias("items")).filter("items > 0").select(F.lit("warning").alias("severity"), F.lit("circular_dependencies").alias("rule"), "items")
        conf = naming_conflicts(m, scans).agg(F.count("*").alias("items")).filter("items > 0").select(F.lit("warning").alias("severity"), F.lit("naming_conflicts").alias("rule"), "items")
        out = out.unionByName(refs).unionByName(circ).unionByName(conf)
    return out


def compatibility(m: DataFrame, scans: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row: penalties, score from 100 down and grade of a merge."""
    refs = m.agg(F.coalesce(F.sum(F.size(F.array_distinct(F.coalesce("type_references", F.array().cast("array<string>"))))), F.lit(0)).alias("refs"))
    parts = [
        language_groups(m).agg(F.count("*").alias("groups")), unresolved(m).agg(F.count("*").alias("open_refs")), refs, naming_conflicts(m, scans).agg(F.count("*").alias("conflicts")),
        orphans(m).agg(F.count("*").alias("orphans")), cycles.agg(F.count_distinct("component").alias("cycles"))]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # single rows
    one = one.withColumn("language_penalty", F.when(F.col("groups") > 1, 30.0).otherwise(0.0)).withColumn("deps_penalty", F.coalesce(F.round(25.0 * F.col("open_refs") / F.nullif("refs", F.lit(0)), 1), F.lit(0.0)))
    total = 100 - F.col("language_penalty") - F.col("deps_penalty") - F.least(5 * F.col("conflicts"), F.lit(15)) - F.least(3 * F.col("orphans"), F.lit(15)) - F.least(5 * F.col("cycles"), F.lit(15))
    one = one.withColumn("score", F.bround(F.greatest(F.lit(0.0), total), 0).cast("int"))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return one.withColumn("grade", grade)


def renamed(m: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks after renaming: ``names`` has key, old_name, new_name; the text of that block and the references of all blocks change.

    Whole words are replaced. The last name by key wins for references to an old name.
    """
    refs = F.broadcast(names.groupBy("old_name").agg(F.max_by("new_name", "key").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("old_name", "n"))).alias("to")))  # one row; as long as the list of names
    j = m.join(F.broadcast(names), "key", "left").crossJoin(refs)
    word = F.concat(F.lit(r"(?U)\b\Q"), "old_name", F.lit(r"\E\b"))
    return j.select(
        "key", F.coalesce("new_name", "name").alias("name"), F.when(F.col("old_name").isNotNull(), F.regexp_replace("source_code", word, F.col("new_name"))).otherwise(F.col("source_code")).alias("source_code"),
        F.transform("type_references", lambda r: F.coalesce(F.element_at("to", r), r)).alias("type_references"))


def resolvable(m: DataFrame, palette: DataFrame) -> DataFrame:
    """Open references of a merge: reference, needed_by (blocks), candidates (items of the palette outside the merge that could meet it), first_candidate (least key)."""
    need = unresolved(m).groupBy("reference").agg(F.count("*").alias("needed_by"))
    have = palette.join(m.select("key"), "key", "left_anti").groupBy(F.col("name").alias("reference")).agg(F.count("*").alias("candidates"), F.min("key").alias("first_candidate"))
    return need.join(have, "reference", "left").select("reference", "needed_by", F.coalesce("candidates", F.lit(0)).alias("candidates"), "first_candidate")


def palette(items: DataFrame, scans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Items of the scans that are ready, with references and imports of their blocks."""
    ready = F.broadcast(scans.filter("status = 'ready'").select("scan_id", "project_name").dropDuplicates(["scan_id"]))
    extra = blocks.select("ordinal", "type_references", "imports")
    return items.join(ready, "scan_id").join(extra, "ordinal", "left").select(F.concat_ws("::", "scan_id", "item_id").alias("key"), "project_name", "name", "block_type", "language", "parent", "type_references", "imports", "ordinal")


def template_match(wanted: DataFrame, palette_rows: DataFrame) -> DataFrame:
    """For each wanted (name, block_type, language) the first item of the palette, or null."""
    w = Window.partitionBy("name", "block_type", "language").orderBy("ordinal")
    first = palette_rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("name", "block_type", "language", "key")
    return wanted.join(first, ["name", "block_type", "language"], "left")
