"""Dependency graph: edges from references, imports and parents, degrees, closure, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIORITY = ("type_reference", "import", "parent")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: what ``spark.checkpoint.dir`` names.

    Only on one machine may that be unset: then a temporary folder is set. On a
    cluster it is an error, since executors could not read each other's folders.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="codelake-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``checkpoint_folder``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def name_index(blocks: DataFrame) -> DataFrame:
    """(scan_id, key, item_id): each block under its name and its qualified name."""
    return blocks.select("scan_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), "item_id").filter("key is not null").distinct()


def import_names(line: Column) -> Column:
    """Names that an import statement brings in, as an array: the last part of a dotted name, the original of an alias.

    Python's ``from`` and ``import``, braces and defaults of JavaScript, and
    ``show`` lists of Dart; stars and quoted paths bring in nothing.
    """
    s = F.rtrim(F.regexp_replace(F.trim(line), r"\s*;\s*$", ""))
    python_from = F.regexp_extract(s, r"^from\s+\S+\s+import\s+(.+)$", 1)
    braces = F.regexp_extract(s, r"^import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}\s*from\b", 1)
    default = F.regexp_extract(s, r"^import\s+(?:type\s+)?(\w+)\s*(?:,\s*\{[^}]*\}\s*)?from\b", 1)
    shown = F.regexp_extract(s, r"^import\s+['\"][^'\"]*['\"].*\bshow\s+(.+)$", 1)
    plain = F.when(s.rlike(r"^import\s+[\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*$"), F.regexp_extract(s, r"^import\s+(.+)$", 1)).otherwise("")
    parts = F.split(F.concat_ws(",", *(F.nullif(x, F.lit("")) for x in (python_from, braces, default, shown, plain))), ",")
    names = F.transform(parts, lambda p: F.regexp_extract(F.regexp_replace(F.trim(p), r"\s+as\s+.*$", ""), r"(?:^|\.)\(?([A-Za-z_]\w*)\)?$", 1))
    return F.filter(names, lambda n: n != "")


def first_edge(edges: DataFrame) -> DataFrame:
    """At most one edge for each ordered pair: by kind in the order of PRIORITY, then by position and name; no loops."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("edge_type"))
    best = F.min(F.struct(rank.alias("rank"), F.col("pos"), "reference_name", "edge_type")).alias("e")
    return edges.filter("src <> dst").groupBy("src", "dst").agg(best).select("src", "dst", "e.edge_type", "e.reference_name")


def reference_edges(blocks: DataFrame) -> DataFrame:
    """Edges from each block to the blocks of its scan that its type references name."""
    refs = blocks.select("scan_id", F.col("item_id").alias("src"), F.posexplode("type_references").alias("pos", "key"))
    return refs.join(name_index(blocks), ["scan_id", "key"]).select("src", F.col("item_id").alias("dst"), F.lit("type_reference").alias("edge_type"), F.col("key").alias("reference_name"), "pos").filter("src <> dst")


def import_edges(blocks: DataFrame) -> DataFrame:
    """Edges from each block to the blocks of its scan that its imports name."""
    lines = blocks.select("scan_id", F.col("item_id").alias("src"), F.posexplode("imports").alias("line_pos", "line"))
    names = lines.select("scan_id", "src", "line_pos", F.posexplode(import_names(F.col("line"))).alias("name_pos", "key"))
    return names.join(name_index(blocks), ["scan_id", "key"]).select(
        "src", F.col("item_id").alias("dst"), F.lit("import").alias("edge_type"), F.col("key").alias("reference_name"), (F.col("line_pos") * 1000 + F.col("name_pos")).alias("pos")).filter("src <> dst")


def parent_edges(blocks: DataFrame) -> DataFrame:
    """Edges from each block with a parent to the blocks of its scan of that name."""
    child = blocks.filter("parent is not null").select("scan_id", F.col("item_id").alias("src"), F.col("parent").alias("key"))
    return child.join(name_index(blocks), ["scan_id", "key"]).select("src", F.col("item_id").alias("dst"), F.lit("parent").alias("edge_type"), F.col("key").alias("reference_name"), F.lit(0).alias("pos")).filter("src <> dst")


def dependency_edges(blocks: DataFrame) -> DataFrame:
    """The graph's edges from all three sources, one for each ordered pair."""
    return first_edge(reference_edges(blocks).unionByName(import_edges(blocks)).unionByName(parent_edges(blocks)))


def degrees(edges: DataFrame) -> DataFrame:
    """item_id, fan_out, fan_in, total over distinct neighbours; only nodes with an edge."""
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array(
        F.struct(F.col("src").alias("item_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("item_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("item_id").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"), F.count("*").alias("total"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): every node that a root reaches, with the least number of steps; a root isn't its own.

    Semi-naive evaluation: each round joins the newest nodes alone and drops
    those already reached; it ends when a round finds none. Cycles end by
    themselves; unknown roots reach nothing. ``roots`` has the column root.
    """
    pairs = cut_lineage(edges.select("src", "dst").distinct())
    reached = cut_lineage(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier, depth = reached, 0
    while True:
        depth += 1
        step = frontier.join(pairs, frontier["node"] == pairs["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(reached, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return reached.filter("depth > 0")
        reached = reached.unionByName(frontier)  # each round is a checkpoint of its own, read again but not rewritten


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Cycles of two: a < b with edges both ways."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: nodes without an edge in or out are cut off until none is left."""
    e = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct())
    n = e.count()
    while n:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = cut_lineage(kept.select("src", "dst"))
        m = kept.count()
        if m == n:
            break
        e, n = kept, m
    return e


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two nodes or more: item_id, component (its least item_id), size.

    After the cut of ``on_cycles`` colours run along the edges: each node takes
    the greatest label that reaches it; the nodes of a colour that reach the
    colour's own node backwards form a component, which is taken out, and the
    rest goes on. Each step is a join and an aggregation.
    """
    left = on_cycles(edges)
    found = None
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = cut_lineage(nodes.withColumn("c", F.col("node")))
        while True:
            sent = left.join(colour, left["src"] == colour["node"]).select(F.col("dst").alias("node"), "c")
            new = cut_lineage(colour.unionByName(sent).groupBy("node").agg(F.max("c").alias("c")))
            changed = not new.exceptAll(colour).isEmpty()
            colour = new
            if not changed:
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inside = cut_lineage(inside)
        back = cut_lineage(colour.filter("node = c"))
        front = back
        while not front.isEmpty():
            step = inside.join(front.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            front = cut_lineage(step.join(back, ["node", "c"], "left_anti"))
            back = cut_lineage(back.unionByName(front))
        found = back if found is None else found.unionByName(back)
        left = cut_lineage(left.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        left = on_cycles(left)
    if found is None:
        return edges.sparkSession.createDataFrame([], "item_id string, component string, size long")
    w = Window.partitionBy("c")
    return found.select(F.col("node").alias("item_id"), F.min("node").over(w).alias("component"), F.count("*").over(w).alias("size")).filter("size > 1")


def smart_extract(blocks: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected blocks and all they depend on; ``selected`` has the column item_id."""
    roots = selected.select(F.col("item_id").alias("root")).distinct()
    wanted = closure(edges, roots).select(F.col("node").alias("item_id")).unionByName(roots.select(F.col("root").alias("item_id"))).distinct()
    return blocks.join(wanted, "item_id", "left_semi")
