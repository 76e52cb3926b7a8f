"""Analyses over blocks and the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelake.functions.text import n_lines, path_parts, strip
from codelake.operators.graph import cut_lineage, degrees

# Fixed names of entry points, and of items that are called without a reference.
ENTRY_POINTS = ("main", "app", "index", "setup", "configure", "init", "__init__", "__main__", "run", "start", "serve")
TOUR_STARTS = ("main", "app", "index", "setup", "run", "start", "serve", "__main__", "__init__")
IMPLICIT = ("__init__", "constructor", "build")
CONTAINERS = ("class", "widget", "component", "struct")
# Fixed patterns of code that has a newer form: (id, language, pattern).
MIGRATIONS = (
    ("react_class_to_hooks", "javascript", r"class\s+\w+\s+extends\s+(?:React\.)?(?:Component|PureComponent)"),
    ("flutter_stateful_to_riverpod", "dart", r"class\s+\w+\s+extends\s+StatefulWidget"),
    ("python_class_to_dataclass", "python", r"class\s+\w+:?\s*\n\s+def\s+__init__\(self"),
    ("js_promise_to_async", "javascript", r"\.then\s*\("),
)


def line_count() -> Column:
    """Greater of the span of lines and the lines of the text; an open end counts as the start."""
    return F.greatest(F.coalesce(F.col("end_line"), F.col("line_number")) - F.col("line_number"), F.coalesce(n_lines("source_code"), F.lit(0)))


def long_functions(blocks: DataFrame, least: int = 10) -> DataFrame:
    """Functions and methods of at least ``least`` lines: item_id, name, line_count, ordinal."""
    return blocks.filter("block_type in ('function', 'method')").select("item_id", F.col("qualified_name").alias("name"), line_count().alias("line_count"), "ordinal").filter(F.col("line_count") >= least)


def health_score(blocks: DataFrame, edges: DataFrame, dup: DataFrame, least: int = 10) -> DataFrame:
    """One row: blocks, long functions, duplicate pairs (``dup``: one row, dup_n), hubs (more than 10 neighbours) and the score from 0 to 100."""
    n = blocks.agg(F.count("*").alias("n"))
    lines = F.col("line_count") if "line_count" in blocks.columns else line_count()  # counted before texts are shuffled, or here
    long = blocks.filter("block_type in ('function', 'method')").filter(lines >= least).agg(F.count("*").alias("long_n"))
    hub = degrees(edges).filter("total > 10").agg(F.count("*").alias("hub_n"))
    s = n.crossJoin(long).crossJoin(dup).crossJoin(hub)  # four single rows
    share = lambda c, top: F.least(F.lit(float(top)), 100.0 * F.col(c) / F.greatest("n", F.lit(1)))
    return s.withColumn("score", F.when(F.col("n") == 0, 100).otherwise(F.greatest(F.lit(0.0), F.bround(100 - share("long_n", 30) - share("dup_n", 30) - share("hub_n", 20), 0))).cast("int"))


def dead_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Items that nothing refers to, with the confidence that they are unused and the reason."""
    name = F.lower(F.element_at(F.split("qualified_name", r"\."), -1))
    c = nodes.join(edges.select(F.col("dst").alias("item_id")).distinct(), "item_id", "left_anti").withColumn("low", name)
    entry = F.col("low").isin(*ENTRY_POINTS)
    base = F.when(entry, 0.2).when(~F.col("low").startswith("_"), 0.8).otherwise(0.9)
    test = F.when(F.contains("low", F.lit("test")), 0.3).otherwise(base)
    markup = F.when(F.col("block_type").isin("script_block", "style_block"), 0.2).otherwise(test)
    method = F.when(F.col("block_type") == "method", F.least(markup, F.lit(0.5))).otherwise(markup)
    conf = F.when(F.col("low").isin(*IMPLICIT), 0.1).otherwise(method)
    reason = (
        F.when(F.col("low").isin(*IMPLICIT), "constructor").when(F.col("block_type") == "method", "method").when(F.col("block_type").isin("script_block", "style_block"), "markup block")
        .when(F.contains("low", F.lit("test")), "test").when(entry, "entry point").otherwise("no references"))
    return c.select("item_id", F.col("qualified_name").alias("name"), "block_type", F.round(conf, 2).alias("confidence"), reason.alias("reason"), "ordinal")


def with_module(nodes: DataFrame, scans: DataFrame) -> DataFrame:
    """Adds module: the first folder below the scan's source folder, ``root`` for files in it or outside any."""
    dirs = scans.select("scan_id", "source_dir").dropDuplicates(["scan_id"])
    rel = F.replace(F.array_join(F.concat(F.array(F.lit("")), path_parts("file_path")), "/"), F.coalesce("source_dir", F.lit("\u0001")), F.lit(""))
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    return nodes.join(F.broadcast(dirs), "scan_id", "left").withColumn("module", F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("root")).drop("source_dir")


def ranked_in_module(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds links (edge ends at the item) and rank within (scan, module), the earlier item first among equals."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("item_id")).groupBy("item_id").agg(F.count("*").alias("links"))
    w = Window.partitionBy("scan_id", "module").orderBy(F.desc("links"), "ordinal")
    return nodes.join(ends, "item_id", "left").fillna({"links": 0}).withColumn("rank", F.row_number().over(w))


def visible_edges(ranked: DataFrame, edges: DataFrame, top: int = 15) -> DataFrame:
    """Edges between items that are among the first ``top`` of their modules."""
    shown = ranked.filter(F.col("rank") <= top).select("item_id")
    return edges.join(shown.select(F.col("item_id").alias("src")), "src", "left_semi").join(shown.select(F.col("item_id").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_type")


def cross_module(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of edges from each module to each other one."""
    m = ranked.select("item_id", "module")
    e = edges.join(m.select(F.col("item_id").alias("src"), F.col("module").alias("from_module")), "src").join(m.select(F.col("item_id").alias("dst"), F.col("module").alias("to_module")), "dst")
    return e.filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("edges"))


def module_rollup(ranked: DataFrame) -> DataFrame:
    """Items, shown items, hidden items and links of each module of each scan."""
    return ranked.groupBy("scan_id", "module").agg(F.count("*").alias("items"), F.count_if(F.col("rank") <= 15).alias("shown"), F.count_if(F.col("rank") > 15).alias("hidden"), F.sum("links").alias("links"))


def signature_line(code: Column, lang: Column) -> Column:
    """Signature from the first line of a text: the head of a definition, else the text before a brace."""
    first = strip(F.regexp_extract(strip(code), r"^([^\n\r]*)", 1))
    py = F.regexp_extract(first, r"^((?:async\s+)?(?:def|class)\s+\w+\s*\([^)]*\))", 1)
    js = F.regexp_extract(first, r"^((?:export\s+)?(?:async\s+)?(?:function\s+)?\w+\s*\([^)]*\))", 1)
    dart = F.regexp_extract(first, r"^([\w<>?\s]+\w+\s*\([^)]*\))", 1)
    found = F.when(lang == "python", py).when(lang.isin("javascript", "typescript"), js).when(lang == "dart", dart).otherwise("")
    return F.when(found != "", found).otherwise(strip(F.split_part(first, F.lit("{"), F.lit(1))))


def description_line(code: Column) -> Column:
    """First line of the documentation in a text: docstring, doc comment, or a leading line comment; else empty."""
    text = strip(code)
    one = lambda p: strip(F.regexp_extract(strip(F.regexp_extract(text, p, 1)), r"^([^\n\r]*)", 1))
    dq, sq = one(r'(?s)"""(.*?)"""'), one(r"(?s)'''(.*?)'''")
    block = F.regexp_extract(text, r"(?s)/\*\*(.*?)\*/", 1)
    lines = F.filter(F.transform(F.split(block, r"\r?\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[* ]+", ""))), lambda x: (x != "") & ~x.startswith("@"))
    lead = strip(F.regexp_extract(text, r"^[/ ]*//[/ ]*([^\n\r]*)", 1))
    return F.when(dq != "", dq).when(sq != "", sq).when(block != "", F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).when(text.startswith("//"), lead).otherwise("")


def docs_sections(blocks: DataFrame) -> DataFrame:
    """Sections of the documentation: items without a parent with signature, description and the signatures of their members."""
    sig = signature_line(F.col("source_code"), F.col("language"))
    member = blocks.filter("parent is not null").select("scan_id", F.col("parent").alias("name"), F.struct("ordinal", F.coalesce(F.when(sig != "", sig), F.concat("name", F.lit("()"))).alias("s")).alias("m"))
    members = member.groupBy("scan_id", "name").agg(F.transform(F.sort_array(F.collect_list("m")), lambda x: x["s"]).alias("found"))
    top = blocks.filter("parent is null").select("scan_id", "item_id", "ordinal", "name", "qualified_name", "block_type", "language", sig.alias("signature"), description_line(F.col("source_code")).alias("description"))
    holds = F.col("block_type").isin(*CONTAINERS)
    return top.join(members, ["scan_id", "name"], "left").withColumn("members", F.when(holds & F.col("found").isNotNull(), F.col("found")).otherwise(F.array().cast("array<string>"))).drop("found")


def parameters(code: Column, lang: Column) -> Column:
    """Parameters of the first definition in a text: array of (name, type_annotation, default_value).

    The list ends at the first closing parenthesis and is cut at commas
    outside brackets; ``self`` and ``cls`` drop out for Python.
    """
    head = F.when(lang == "python", F.regexp_extract(code, r"def\s+\w+\s*\(([^)]*)\)", 1)).when(
        lang.isin("javascript", "typescript"), F.coalesce(F.nullif(F.regexp_extract(code, r"(?:function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?)\s*\(([^)]*)\)", 1), F.lit("")), F.regexp_extract(code, r"\(([^)]*)\)\s*(?:=>|\{)", 1))).otherwise(F.regexp_extract(code, r"\w+\s*\(([^)]*)\)", 1))
    raw = F.when(lang == "dart", F.regexp_replace(head, r"[{}]", "")).otherwise(head)
    masked = raw
    for _ in range(4):  # commas within brackets, from the inside outwards
        masked = F.regexp_replace(masked, r"([\[({<][^\[\](){}<>,]*),(?=[^\[\](){}<>]*[\])}>])", "$1\u0001")
    for _ in range(4):  # and after a bracket that stays open, as the list ends at the first closing parenthesis
        masked = F.regexp_replace(masked, r"([\[({<][^\])}>,]*),(?=[^\])}>]*$)", "$1\u0001")
    parts = F.filter(F.transform(F.split(masked, ","), lambda p: F.trim(F.regexp_replace(F.replace(p, F.lit("\u0001"), F.lit(",")), r"\s+", " "))), lambda p: (p != "") & ~((lang == "python") & p.isin("self", "cls")))

    def one(p: Column) -> Column:
        p = F.when(lang == "dart", F.regexp_replace(F.regexp_replace(p, r"^required\s+", ""), r"^this\.", "")).otherwise(p)
        typed = lang.isin("python", "javascript", "typescript")
        cut = typed | (lang == "dart")
        left = F.when(cut & p.contains("="), F.trim(F.regexp_extract(p, r"^([^=]*)=", 1))).otherwise(p)
        default = F.when(cut & p.contains("="), F.trim(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)))
        name = F.when(typed & left.contains(":"), F.trim(F.regexp_extract(left, r"^([^:]*):", 1))).when(lang == "dart", F.regexp_extract(left, r"(\S+)$", 1)).otherwise(left)
        ann = F.when(typed & left.contains(":"), F.trim(F.regexp_extract(left, r"^[^:]*:(.*)$", 1))).when((lang == "dart") & left.contains(" "), F.regexp_extract(left, r"^(.*) \S+$", 1))
        return F.struct(name.alias("name"), ann.alias("type_annotation"), default.alias("default_value"))

    return F.transform(parts, one)


def catalog(blocks: DataFrame) -> DataFrame:
    """One row for each block: place, parameters, up to 2,000 characters of code and lines."""
    code = F.coalesce("source_code", F.lit(""))
    return blocks.select("item_id", F.col("qualified_name").alias("name"), "block_type", "language", "file_path", "line_number", "parent", parameters(code, F.col("language")).alias("parameters"), F.left(code, F.lit(2000)).alias("code"), n_lines(code).alias("line_count"), "ordinal")


def migrations(blocks: DataFrame) -> DataFrame:
    """Blocks that match a migration pattern of their language: pattern_id, item_id, name."""
    out = None
    for pid, lang, pattern in MIGRATIONS:
        x = blocks.filter((F.col("language") == lang) & F.col("source_code").rlike(pattern)).select(F.lit(pid).alias("pattern_id"), "item_id", F.col("qualified_name").alias("name"), "ordinal")
        out = x if out is None else out.unionByName(x)
    return out


def promise_to_async(code: Column) -> Column:
    """Chains of ``.then(x => ...)`` as awaited assignments."""
    return F.regexp_replace(code, r"(\w[\w.]*\([^()]*\))\s*\.then\(\s*\(?(\w+)\)?\s*=>\s*([^()]*(?:\([^()]*\))?[^()]*)\)", "const $2 = await $1; $3")


def migrated(blocks: DataFrame, pattern_id: str) -> DataFrame:
    """Blocks rewritten by a migration: item_id, code, applied; an unknown id and other blocks leave the text as it is."""
    rules = {
        "js_promise_to_async": promise_to_async(F.col("source_code")),
        "python_class_to_dataclass": F.regexp_replace("source_code", r"(?m)^(\s*)(class\s+\w+)", "$1@dataclass\n$1$2"),
        "react_class_to_hooks": F.regexp_replace(F.regexp_replace("source_code", r"class\s+(\w+)\s+extends\s+(?:React\.)?(?:Component|PureComponent)\s*\{", "function $1(props) {"), r"this\.props\b", "props"),
        "flutter_stateful_to_riverpod": F.regexp_replace("source_code", r"extends\s+StatefulWidget", "extends ConsumerWidget"),
    }
    hit = next(((lang, p) for i, lang, p in MIGRATIONS if i == pattern_id), None)
    if hit is None:
        return blocks.select("item_id", F.col("source_code").alias("code"), F.lit(False).alias("applied"))
    on = F.coalesce((F.col("language") == hit[0]) & F.col("source_code").rlike(hit[1]), F.lit(False))
    return blocks.select("item_id", F.when(on, rules[pattern_id]).otherwise(F.col("source_code")).alias("code"), on.alias("applied"))


def folder_of(path: str = "file_path") -> Column:
    """The folder that holds a file, ``root`` for a bare file name."""
    p = path_parts(path)
    return F.when(F.size(p) > 1, F.element_at(p, -2)).otherwise("root")


def boilerplate(blocks: DataFrame) -> DataFrame:
    """Kinds of block that a folder holds more than once: directory, block_type, n, names (the first five)."""
    b = blocks.select(folder_of().alias("directory"), "block_type", "ordinal", "name")
    w = Window.partitionBy("directory", "block_type").orderBy("ordinal")
    five = b.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("directory", "block_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("names"))
    return b.groupBy("directory", "block_type").agg(F.count("*").alias("n")).filter("n >= 2").join(five, ["directory", "block_type"])


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two texts."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return F.left(a, F.array_max(same))


def templates(blocks: DataFrame) -> DataFrame:
    """A template for each pair of folder and kind: the first block with its name, and then the names' common prefix, as variables."""
    g = blocks.filter("source_code is not null and name is not null").groupBy(folder_of().alias("directory"), "block_type").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "name", "source_code")).alias("f"), F.min("name").alias("lo"), F.max("name").alias("hi")).filter("n >= 2")
    prefix = common_prefix(F.col("lo"), F.col("hi"))
    base = F.replace("f.source_code", F.col("f.name"), F.lit("{{name}}"))
    return g.withColumn("prefix", prefix).select("directory", "block_type", "n", "prefix", F.when(F.length("prefix") > 2, F.replace(base, F.col("prefix"), F.lit("{{prefix}}"))).otherwise(base).alias("template"))


def apply_template(template: str | Column, variables: Column) -> Column:
    """Template with each ``{{key}}`` replaced in the order of the map's entries."""
    t = F.lit(template) if isinstance(template, str) else template
    return F.aggregate(F.map_entries(variables), t, lambda s, e: F.replace(s, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def cloned(code: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """(text, replacements): every case variant of a name replaced by that of another, one after the other."""
    total: Column = F.lit(0)
    for k in ("pascal", "camel", "snake", "upper", "kebab"):
        o = old[k]
        total = total + F.when(F.length(o) > 0, (F.length(code) - F.length(F.replace(code, o, F.lit("")))) / F.length(o)).otherwise(0).cast("int")
        code = F.when(F.length(o) > 0, F.replace(code, o, new[k])).otherwise(code)
    return code, total


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of two scans by name, kind and language (the last one wins): change, name, block_type, language and both texts up to 1,500 characters."""
    keys = ["name", "block_type", "language"]

    def last(x: DataFrame, n: str) -> DataFrame:
        key = x.select(*keys, "ordinal", "source_code").groupBy(*keys).agg(F.max_by("source_code", "ordinal").alias(f"{n}_code"))
        return key.withColumn(f"in_{n}", F.lit(True)).withColumn("language", F.coalesce("language", F.lit("")))

    j = last(a, "a").join(last(b, "b"), keys, "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(strip("a_code") != strip("b_code"), "modified").otherwise("unchanged")
    return j.select(change.alias("change"), *keys, F.left("a_code", F.lit(1500)).alias("a_code"), F.left("b_code", F.lit(1500)).alias("b_code"))


def entry_points(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """Items with the name of an entry point or holding main, app or index, those least referred to first."""
    low = F.lower("name")
    inn = edges.groupBy(F.col("dst").alias("item_id")).agg(F.count("*").alias("fan_in"))
    hit = nodes.filter(low.isin(*TOUR_STARTS) | low.contains("main") | low.contains("app") | low.contains("index"))
    return hit.join(inn, "item_id", "left").fillna({"fan_in": 0}).orderBy("fan_in", "ordinal").limit(top).select("item_id", "name", "fan_in", "ordinal")


def tour(nodes: DataFrame, edges: DataFrame, steps: int = 30) -> DataFrame:
    """Breadth-first reading order from the entry points: step, item_id, level, description, up to 10 names it depends on.

    Without entry points the items with most edges out lead, else the first
    ones. Within a level the parent's place comes first, then the item's own.
    """
    seeds = entry_points(nodes, edges)
    if seeds.isEmpty():
        out = edges.groupBy(F.col("src").alias("item_id")).agg(F.count("*").alias("n"))
        seeds = nodes.join(out, "item_id").orderBy(F.desc("n"), "ordinal").limit(5)
    if seeds.isEmpty():
        seeds = nodes.orderBy("ordinal").limit(5).withColumn("fan_in", F.lit(0))
    at = nodes.select("item_id", "ordinal")
    seeds = seeds.select("item_id", F.row_number().over(Window.orderBy(F.coalesce("fan_in", F.lit(0)) if "fan_in" in seeds.columns else F.lit(0), "ordinal")).alias("place"))
    placed = cut_lineage(seeds.withColumn("level", F.lit(0)))
    front, level, n = placed, 0, placed.count()
    while n < steps:
        level += 1
        nxt = edges.join(front.select(F.col("item_id").alias("src"), "place"), "src").select(F.col("dst").alias("item_id"), "place").join(placed.select("item_id"), "item_id", "left_anti").groupBy("item_id").agg(F.min("place").alias("p")).join(at, "item_id")
        nxt = nxt.orderBy("p", "ordinal").limit(steps - n)
        nxt = cut_lineage(nxt.select("item_id", (F.row_number().over(Window.orderBy("p", "ordinal")) + n).alias("place"), F.lit(level).alias("level")))
        m = nxt.count()
        if not m:
            break
        placed, front, n = cut_lineage(placed.unionByName(nxt)), nxt, n + m
    names = nodes.select(F.col("item_id").alias("dst"), F.col("qualified_name").alias("dep"))
    deps = edges.join(placed.select(F.col("item_id").alias("src")), "src", "left_semi").join(names, "dst").groupBy(F.col("src").alias("item_id")).agg(F.slice(F.sort_array(F.collect_set("dep")), 1, 10).alias("depends_on"))
    told = description_line(F.col("source_code"))
    say = F.when(told != "", told).otherwise(F.concat("qualified_name", F.lit(" ("), "block_type", F.lit(")")))
    return placed.join(nodes.select("item_id", say.alias("description"), F.left("source_code", F.lit(2000)).alias("code")), "item_id").join(deps, "item_id", "left").select(F.col("place").alias("step"), "item_id", "level", "description", "code", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def item_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies, bytes, lines and score of each item: points off for more than 100 lines and more than 10 dependencies."""
    out = edges.groupBy(F.col("src").alias("item_id")).agg(F.count("*").alias("deps"))
    s = nodes.join(out, "item_id", "left").select("item_id", F.coalesce("deps", F.lit(0)).alias("deps"), F.coalesce(F.octet_length("source_code"), F.lit(0)).alias("bytes"), F.coalesce(n_lines("source_code"), F.lit(0)).alias("lines"))
    long = F.when(F.col("lines") > 100, F.least(F.lit(30), F.floor((F.col("lines") - 100) / 5))).otherwise(0)
    many = F.when(F.col("deps") > 10, F.least(F.lit(20), (F.col("deps") - 10) * 2)).otherwise(0)
    return s.withColumn("score", (100 - long - many).cast("int"))


