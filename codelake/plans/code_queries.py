"""Queries over code: filters, graph, similarity, health, structure, documentation, templates, diff, merge, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import tables as T
from codelake.functions import text as X
from codelake.operators import analysis as A
from codelake.operators import graph as G
from codelake.operators import merge as M
from codelake.operators import search as S
from codelake.operators import similarity as D
from codelake.plans.sql import BLOCKS, EDGES, FILES, ITEMS, NAMES, NODES, STRIP, lines, w, wr
from codelake.registry import op


@op("scan_summary", "scan", w(ITEMS) + "SELECT language, block_type, count(*) AS items FROM i GROUP BY GROUPING SETS ((language), (block_type))")
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by language and by kind."""
    return T.items(spark, d).groupingSets([["language"], ["block_type"]], "language", "block_type").agg(F.count("*").alias("items"))


@op("language_breakdown", "scan", w(FILES) + "SELECT language, count(*) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM f GROUP BY language")
def language_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Files and percentage by language."""
    g = T.files(spark, d).groupBy("language").agg(F.count("*").alias("files"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("files").alias("all_n")))).select("language", "files", F.round(100.0 * F.col("files") / F.col("all_n"), 2).alias("pct"))  # one row on the right


@op("file_listing", "scan", w(ITEMS) + "SELECT file_path, list(name ORDER BY line_number, ordinal) AS names FROM i GROUP BY file_path")
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Names of each file in the order of their lines."""
    return T.items(spark, d).groupBy("file_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "ordinal", "name"))), lambda x: x["name"]).alias("names"))


@op("glob_filter", "filter", w(ITEMS) + "SELECT ordinal, name FROM i WHERE name GLOB '*[Ss]ervice' OR qualified_name GLOB '*[Ss]ervice' OR block_type GLOB '*[Ss]ervice'")
def glob_filter(spark: SparkSession, d: str, pattern: str = "*[Ss]ervice") -> DataFrame:
    """Items whose name, qualified name or kind meets a glob."""
    return S.glob(T.items(spark, d), pattern).select("ordinal", "name")


@op("tiered_target", "filter", w(ITEMS) + ", t AS (SELECT ordinal, name, CASE WHEN name = 'merge' OR qualified_name = 'merge' THEN 1 WHEN lower(name) LIKE 'merge%' THEN 2 END AS tier FROM i) SELECT ordinal, name FROM t WHERE tier = (SELECT min(tier) FROM t)")
def tiered_target(spark: SparkSession, d: str) -> DataFrame:
    """Items at the best tier of a target: exact before looser matches."""
    t = T.items(spark, d).select("ordinal", "name", F.when((F.col("name") == "merge") | (F.col("qualified_name") == "merge"), 1).when(F.lower("name").startswith("merge"), 2).alias("tier"))
    return S.best_tier(t).select("ordinal", "name")


@op("items_filter", "filter", w(ITEMS) + "SELECT ordinal FROM i WHERE language = 'python' AND block_type = 'method' AND contains(lower(qualified_name), 'merge')")
def items_filter(spark: SparkSession, d: str) -> DataFrame:
    """Items by language, kind and part of the name."""
    return T.items(spark, d, "language = 'python' and block_type = 'method' and contains(lower(qualified_name), 'merge')").select("ordinal")


@op("duplicate_items", "scan", w(ITEMS) + "SELECT item_id, count(*) AS n, max(ordinal) AS kept FROM i GROUP BY item_id HAVING count(*) > 1")
def duplicate_items(spark: SparkSession, d: str) -> DataFrame:
    """Item ids that occur more than once and the row that counts."""
    return T.items(spark, d).groupBy("item_id").agg(F.count("*").alias("n"), F.max("ordinal").alias("kept")).filter("n > 1")


@op("line_counts", "text", w(BLOCKS) + f"SELECT ordinal, ({lines('source_code')})::INTEGER AS lines, length(source_code)::INTEGER AS chars FROM b")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines and characters of each block."""
    return T.blocks(spark, d).select("ordinal", X.n_lines("source_code").alias("lines"), F.length("source_code").alias("chars"))


@op("tokens_per_block", "text", w(BLOCKS) + r"SELECT ordinal, len(t) AS words, len(list_distinct(t)) AS different FROM (SELECT ordinal, list_transform(regexp_extract_all(source_code, '[a-zA-Z_][\p{L}\p{N}_]+'), lambda x: lower(x)) AS t FROM b WHERE source_code IS NOT NULL)")
def tokens_per_block(spark: SparkSession, d: str) -> DataFrame:
    """Words and different words of each block."""
    t = X.tokens("source_code")
    return T.blocks(spark, d, "source_code is not null").select("ordinal", F.size(t).cast("long").alias("words"), F.size(F.array_distinct(t)).cast("long").alias("different"))


@op("type_references", "text", w(BLOCKS) + r"SELECT ordinal, list_sort(list_distinct(list_filter(regexp_extract_all(source_code, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z0-9]+')))) AS refs FROM b WHERE source_code IS NOT NULL")
def type_references(spark: SparkSession, d: str) -> DataFrame:
    """Different capitalised words of each block, sorted."""
    return T.blocks(spark, d, "source_code is not null").select("ordinal", F.array_sort(F.array_distinct(F.regexp_extract_all("source_code", F.lit(r"\b[A-Z][a-zA-Z0-9]+\b"), F.lit(0)))).alias("refs"))


@op("ddl_statements", "scan", w(FILES) + r"""
    , l AS (SELECT ordinal, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS s FROM (SELECT ordinal, string_split(source_code, chr(10)) AS x FROM f WHERE language = 'sql' AND source_code IS NOT NULL))
    SELECT ordinal, line::INTEGER AS line, lower(regexp_extract(s, '(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|MATERIALIZED\s+|UNIQUE\s+)?(TABLE|VIEW|FUNCTION|TRIGGER|INDEX|POLICY)\b', 1)) AS kind,
    regexp_extract(s, '(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|MATERIALIZED\s+|UNIQUE\s+)?(?:TABLE|VIEW|FUNCTION|TRIGGER|INDEX|POLICY)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:"?\w+"?\.)?"?(\w+)"?', 1) AS name
    FROM l WHERE regexp_matches(s, '(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|MATERIALIZED\s+|UNIQUE\s+)?(TABLE|VIEW|FUNCTION|TRIGGER|INDEX|POLICY)\b')""")
def ddl_statements(spark: SparkSession, d: str) -> DataFrame:
    """Data definitions in SQL files: line, kind, name."""
    return S.ddl(T.files(spark, d, "language = 'sql'"))


@op("preview_slice", "search", w(ITEMS, FILES) + r"""
    SELECT i.ordinal, array_to_string(list_slice(string_split(f.source_code, chr(10)), i.line_number, coalesce(i.end_line, i.line_number + 100)), chr(10)) AS preview
    FROM i JOIN f ON f.scan_id = i.scan_id AND f.file_path = i.file_path WHERE f.source_code IS NOT NULL""")
def preview_slice(spark: SparkSession, d: str) -> DataFrame:
    """Text of each item from its file: its lines, or 100 more where the end is open."""
    return S.preview(T.items(spark, d), T.files(spark, d))


# Graph ---------------------------------------------------------------------------------------------------------------

@op("name_index", "graph", w(NODES, NAMES) + "SELECT scan_id, key, item_id FROM ki")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    """Items under their names and qualified names."""
    return G.name_index(T.nodes(spark, d))


@op("reference_edges", "graph", w(NODES, NAMES) + ", r AS (SELECT DISTINCT scan_id, item_id AS src, unnest(type_references) AS key FROM n) SELECT DISTINCT r.src, ki.item_id AS dst, r.key AS reference_name FROM r JOIN ki USING (scan_id, key) WHERE r.src <> ki.item_id")
def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from type references to the items they name."""
    return G.reference_edges(T.nodes(spark, d)).select("src", "dst", "reference_name").distinct()


@op("parent_edges", "graph", w(NODES, NAMES) + "SELECT DISTINCT n.item_id AS src, ki.item_id AS dst FROM n JOIN ki ON ki.scan_id = n.scan_id AND ki.key = n.parent WHERE n.item_id <> ki.item_id")
def parent_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from members to the items that hold them."""
    return G.parent_edges(T.nodes(spark, d)).select("src", "dst").distinct()


@op("import_edges", "graph", w(NODES, NAMES) + r"""
    , x AS (SELECT scan_id, item_id AS src, rtrim(regexp_replace(trim(unnest(imports)), '\s*;\s*$', '')) AS s FROM n),
    p AS (SELECT scan_id, src, unnest(string_split(concat_ws(',', nullif(regexp_extract(s, '^from\s+\S+\s+import\s+(.+)$', 1), ''), nullif(regexp_extract(s, '^import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}\s*from\b', 1), ''),
        nullif(regexp_extract(s, '^import\s+(?:type\s+)?(\w+)\s*(?:,\s*\{[^}]*\}\s*)?from\b', 1), ''), nullif(regexp_extract(s, '^import\s+[''"][^''"]*[''"].*\bshow\s+(.+)$', 1), ''),
        CASE WHEN regexp_matches(s, '^import\s+[\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*$') THEN regexp_extract(s, '^import\s+(.+)$', 1) END), ',')) AS part FROM x),
    q AS (SELECT scan_id, src, regexp_extract(regexp_replace(trim(part), '\s+as\s+.*$', ''), '(?:^|\.)\(?([A-Za-z_]\w*)\)?$', 1) AS key FROM p)
    SELECT DISTINCT q.src, ki.item_id AS dst FROM q JOIN ki USING (scan_id, key) WHERE q.key <> '' AND q.src <> ki.item_id""")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from imports to the items they name."""
    return G.import_edges(T.nodes(spark, d)).select("src", "dst").distinct()


@op("dependency_counts", "graph")
def dependency_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph built from the blocks, by kind."""
    return G.dependency_edges(T.nodes(spark, d)).groupBy("edge_type").agg(F.count("*").alias("edges"))


@op("edges_once", "graph", w(EDGES) + "SELECT * FROM e")
def edges_once(spark: SparkSession, d: str) -> DataFrame:
    """Stored edges, one for each ordered pair."""
    return T.edges(spark, d)


@op("degrees", "graph", w(EDGES) + ", x AS (SELECT src AS item_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT item_id, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in, count(*) AS total FROM x GROUP BY item_id")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in, out and in all of each item."""
    return G.degrees(T.edges(spark, d))


@op("coupling_topk", "graph", w(NODES, EDGES) + ", x AS (SELECT src AS item_id FROM e UNION ALL SELECT dst FROM e), c AS (SELECT item_id, count(*) AS total FROM x GROUP BY 1) SELECT c.item_id, c.total FROM c JOIN n USING (item_id) ORDER BY total DESC, n.ordinal LIMIT 20")
def coupling_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 items with most neighbours."""
    return G.degrees(T.edges(spark, d)).join(T.nodes(spark, d).select("item_id", "ordinal"), "item_id").orderBy(F.desc("total"), "ordinal").limit(20).select("item_id", "total")


def _roots(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    return e.select("src").distinct().join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select(F.col("src").alias("root"))


@op("closure_from_roots", "graph", wr(EDGES) + ", r(root, node) AS (SELECT src, src FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node) SELECT DISTINCT root, node FROM r WHERE root <> node")
def closure_from_roots(spark: SparkSession, d: str) -> DataFrame:
    """All that each item without a referrer depends on."""
    return G.closure(T.edges(spark, d), _roots(spark, d)).select("root", "node").distinct()


@op("closure_depths", "graph", wr(EDGES) + ", r(root, node, depth) AS (SELECT src, src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 200), l AS (SELECT root, node, min(depth) AS depth FROM r WHERE root <> node GROUP BY 1, 2) SELECT depth, count(*) AS pairs FROM l GROUP BY 1")
def closure_depths(spark: SparkSession, d: str) -> DataFrame:
    """How many items the roots reach at each depth."""
    return G.closure(T.edges(spark, d), _roots(spark, d)).groupBy("depth").agg(F.count("*").alias("pairs"))


@op("mutual_pairs", "graph", w(EDGES) + "SELECT a.src AS a, a.dst AS b FROM e a JOIN e c ON a.src = c.dst AND a.dst = c.src WHERE a.src < a.dst")
def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Items that depend on each other."""
    return G.mutual_pairs(T.edges(spark, d))


@op("cycles", "graph", wr(EDGES) + ", r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT a AS item_id, min(b) AS component, count(*) AS size FROM m GROUP BY a HAVING count(*) > 1")
def cycles(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components of two items or more."""
    return G.components(T.edges(spark, d))


@op("smart_extract", "graph", wr(NODES, EDGES) + ", r(node) AS (SELECT item_id FROM n WHERE block_type = 'class' AND name LIKE '%Service' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT item_id, name, block_type FROM n WHERE item_id IN (SELECT node FROM r)")
def smart_extract(spark: SparkSession, d: str) -> DataFrame:
    """The service classes with all they depend on."""
    n = T.nodes(spark, d)
    return G.smart_extract(n, T.edges(spark, d), n.filter("block_type = 'class' and name like '%Service'")).select("item_id", "name", "block_type")


@op("dependency_lookup", "graph", w(NODES, EDGES) + ", x AS (SELECT e.src AS item_id, m.qualified_name AS name, m.ordinal FROM e JOIN n m ON m.item_id = e.dst) SELECT item_id, name FROM x QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ordinal) <= 20")
def dependency_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Up to 20 names that each item depends on."""
    return S.neighbours(T.nodes(spark, d), T.edges(spark, d), 20)


@op("item_stats", "graph", w(NODES, EDGES) + f"""
    , o AS (SELECT src AS item_id, count(*) AS deps FROM e GROUP BY 1), s AS (SELECT n.item_id, coalesce(o.deps, 0) AS deps, coalesce(octet_length(encode(source_code)), 0)::INTEGER AS bytes, coalesce({lines('source_code')}, 0)::INTEGER AS lines FROM n LEFT JOIN o USING (item_id))
    SELECT *, (100 - CASE WHEN lines > 100 THEN least(30, (lines - 100) // 5) ELSE 0 END - CASE WHEN deps > 10 THEN least(20, (deps - 10) * 2) ELSE 0 END)::INTEGER AS score FROM s""")
def item_stats(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies, bytes, lines and score of each item."""
    return A.item_stats(T.nodes(spark, d), T.edges(spark, d))


# Similarity and health -----------------------------------------------------------------------------------------------

def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts by ordinal; repeated rows are left to ``representatives``."""
    return T.read(spark, d, "blocks").select(F.col("ordinal").alias("id"), "source_code")


_BAG = r"""t AS (SELECT min(ordinal) AS id, source_code FROM b WHERE source_code IS NOT NULL GROUP BY source_code), c0 AS (SELECT id, lower(unnest(regexp_extract_all(source_code, '[a-zA-Z_][\p{L}\p{N}_]+'))) AS token FROM t),
    c AS (SELECT id, token, count(*) AS n FROM c0 GROUP BY 1, 2), s AS (SELECT id, sum(n)::BIGINT AS total FROM c GROUP BY 1 HAVING sum(n) >= 5)"""


@op("token_bag", "similarity", w(BLOCKS, _BAG) + "SELECT c.id, count(*) AS words, max(c.n) AS most FROM c JOIN s USING (id) GROUP BY c.id")
def token_bag(spark: SparkSession, d: str) -> DataFrame:
    """Different words and the greatest count of each distinct text."""
    return D.bags(D.representatives(_texts(spark, d))[0]).groupBy("id").agg(F.count("*").alias("words"), F.max("n").alias("most"))


@op("minhash_signatures", "similarity", w(BLOCKS, _BAG) + ", v AS (SELECT id, i, md5(concat(i, ':', token)) AS h FROM (SELECT c.id, c.token, unnest(range(64)) AS i FROM c JOIN s USING (id))) SELECT id, i::INTEGER AS i, min(('0x' || substr(h, 1, 8))::BIGINT) AS value FROM v GROUP BY 1, 2")
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    """All MinHash coordinates of each distinct text."""
    return D.signatures(D.sketches(D.representatives(_texts(spark, d))[0]))


@op("dup_pairs_lsh", "similarity", w(BLOCKS, _BAG) + """
    , x AS (SELECT a.id AS a, q.id AS b, sa.total AS ta, sb.total AS tb, sum(least(a.n, q.n))::BIGINT AS inner_n FROM c a JOIN c q ON a.token = q.token AND a.id < q.id JOIN s sa ON sa.id = a.id JOIN s sb ON sb.id = q.id WHERE least(sa.total, sb.total) >= 0.75 * greatest(sa.total, sb.total) GROUP BY 1, 2, 3, 4)
    SELECT a, b, round(inner_n::DOUBLE / (ta + tb - inner_n), 3) AS similarity FROM x WHERE inner_n::DOUBLE / (ta + tb - inner_n) >= 0.75""")
def dup_pairs_lsh(spark: SparkSession, d: str) -> DataFrame:
    """Links between distinct texts that are alike, found by bands and verified."""
    return D.duplicate_pairs(_texts(spark, d))[1]


@op("dup_classes", "similarity", w(BLOCKS) + ", t AS (SELECT ordinal, min(ordinal) OVER (PARTITION BY source_code) AS rep, count(*) OVER (PARTITION BY source_code) AS copies FROM b WHERE source_code IS NOT NULL) SELECT * FROM t")
def dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of equal texts of each block and its size."""
    m = D.representatives(_texts(spark, d))[1]
    return m.join(m.groupBy("rep").agg(F.count("*").alias("copies")), "rep").select(F.col("id").alias("ordinal"), "rep", "copies")


@op("long_functions_topk", "health", w(BLOCKS) + f", x AS (SELECT item_id, qualified_name AS name, greatest(coalesce(end_line, line_number) - line_number, coalesce({lines('source_code')}, 0))::INTEGER AS line_count, ordinal FROM b WHERE block_type IN ('function', 'method')) SELECT item_id, name, line_count FROM x WHERE line_count >= 10 ORDER BY line_count DESC, ordinal LIMIT 30")
def long_functions_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 30 longest functions and methods."""
    return A.long_functions(T.blocks(spark, d)).orderBy(F.desc("line_count"), "ordinal").limit(30).select("item_id", "name", "line_count")


@op("health_score", "health", w(NODES, EDGES, _BAG) + f"""
    , k AS (SELECT t.id, (SELECT count(*) FROM b WHERE b.source_code = t.source_code) AS copies FROM t JOIN s USING (id)),
    x AS (SELECT a.id AS a, q.id AS b, sa.total AS ta, sb.total AS tb, sum(least(a.n, q.n))::BIGINT AS inner_n FROM c a JOIN c q ON a.token = q.token AND a.id < q.id JOIN s sa ON sa.id = a.id JOIN s sb ON sb.id = q.id WHERE least(sa.total, sb.total) >= 0.75 * greatest(sa.total, sb.total) GROUP BY 1, 2, 3, 4),
    dp AS (SELECT (SELECT coalesce(sum(copies * (copies - 1) // 2), 0) FROM k) + (SELECT coalesce(sum(ka.copies * kb.copies), 0) FROM x JOIN k ka ON ka.id = x.a JOIN k kb ON kb.id = x.b WHERE inner_n::DOUBLE / (ta + tb - inner_n) >= 0.75) AS dup_n),
    lf AS (SELECT count(*) AS long_n FROM (SELECT greatest(coalesce(end_line, line_number) - line_number, coalesce({lines('source_code')}, 0)) AS lc FROM n WHERE block_type IN ('function', 'method')) WHERE lc >= 10),
    hb AS (SELECT count(*) AS hub_n FROM (SELECT u FROM (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e) GROUP BY u HAVING count(*) > 10)), al AS (SELECT count(*) AS n FROM n)
    SELECT al.n, long_n, dup_n::BIGINT AS dup_n, hub_n, CASE WHEN al.n = 0 THEN 100 ELSE greatest(0, least(100, round_even(100 - least(30.0, 100.0 * long_n / al.n) - least(30.0, 100.0 * dup_n / al.n) - least(20.0, 100.0 * hub_n / al.n), 0)))::INTEGER END AS score FROM al, lf, dp, hb""")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    """Health of the code as one score with its parts."""
    b = T.read(spark, d, "blocks").select("ordinal", "item_id", "block_type", A.line_count().alias("line_count"))
    return A.health_score(T.last_by_item(T.one_each(b)), T.edges(spark, d), D.duplicate_count(_texts(spark, d)))


@op("dead_items", "health", w(NODES, EDGES) + """
    , c AS (SELECT *, lower(list_extract(string_split(qualified_name, '.'), -1)) AS low FROM n WHERE item_id NOT IN (SELECT dst FROM e)),
    b1 AS (SELECT *, CASE WHEN low IN ('main', 'app', 'index', 'setup', 'configure', 'init', '__init__', '__main__', 'run', 'start', 'serve') THEN 0.2 WHEN low NOT LIKE '\\_%' ESCAPE '\\' THEN 0.8 ELSE 0.9 END AS c1 FROM c),
    b2 AS (SELECT *, CASE WHEN block_type IN ('script_block', 'style_block') THEN 0.2 WHEN contains(low, 'test') THEN 0.3 ELSE c1 END AS c2 FROM b1)
    SELECT item_id, CASE WHEN low IN ('__init__', 'constructor', 'build') THEN 0.1 WHEN block_type = 'method' THEN least(c2, 0.5) ELSE c2 END::DOUBLE AS confidence FROM b2""")
def dead_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that nothing refers to and how sure that is."""
    return A.dead_items(T.nodes(spark, d), T.edges(spark, d)).select("item_id", "confidence")


# Structure -----------------------------------------------------------------------------------------------------------

_MODULE = r"""
    d AS (SELECT DISTINCT ON (scan_id) scan_id, source_dir FROM scans ORDER BY scan_id),
    p AS (SELECT n.*, list_filter(string_split(replace('/' || array_to_string(list_filter(string_split(replace(file_path, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'), '/'), coalesce(d.source_dir, chr(1)), ''), '/'), lambda x: x <> '') AS parts FROM n LEFT JOIN d USING (scan_id)),
    mo AS (SELECT * EXCLUDE (parts), CASE WHEN len(parts) > 1 THEN parts[1] ELSE 'root' END AS module FROM p),
    en AS (SELECT item_id, count(*) AS links FROM (SELECT src AS item_id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
    ra AS (SELECT mo.*, coalesce(en.links, 0) AS links, row_number() OVER (PARTITION BY scan_id, module ORDER BY coalesce(en.links, 0) DESC, ordinal) AS rank FROM mo LEFT JOIN en USING (item_id))"""


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = T.edges(spark, d)
    return A.ranked_in_module(A.with_module(T.nodes(spark, d), T.read(spark, d, "scans")), e), e


@op("module_rollup", "architecture", w(NODES, EDGES, _MODULE) + "SELECT scan_id, module, count(*) AS items, count(*) FILTER (rank <= 15) AS shown, count(*) FILTER (rank > 15) AS hidden, sum(links)::BIGINT AS links FROM ra GROUP BY 1, 2")
def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Items and links of each module."""
    return A.module_rollup(_ranked(spark, d)[0])


@op("module_top15", "architecture", w(NODES, EDGES, _MODULE) + "SELECT item_id, module, links, rank::INTEGER AS rank FROM ra WHERE rank <= 15")
def module_top15(spark: SparkSession, d: str) -> DataFrame:
    """The 15 items with most links of each module."""
    return _ranked(spark, d)[0].filter("rank <= 15").select("item_id", "module", "links", "rank")


@op("visible_edges", "architecture", w(NODES, EDGES, _MODULE) + "SELECT src, dst, edge_type FROM e WHERE src IN (SELECT item_id FROM ra WHERE rank <= 15) AND dst IN (SELECT item_id FROM ra WHERE rank <= 15)")
def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between items that are shown."""
    return A.visible_edges(*_ranked(spark, d))


@op("cross_module_edges", "architecture", w(NODES, EDGES, _MODULE) + "SELECT x.module AS from_module, y.module AS to_module, count(*) AS edges FROM e JOIN ra x ON x.item_id = e.src JOIN ra y ON y.item_id = e.dst WHERE x.module <> y.module GROUP BY 1, 2")
def cross_module_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from module to module."""
    return A.cross_module(*_ranked(spark, d))


@op("catalog", "catalog", w(BLOCKS) + f"SELECT ordinal, qualified_name AS name, block_type, language, left(coalesce(source_code, ''), 2000) AS code, ({lines("coalesce(source_code, '')")})::INTEGER AS line_count FROM b")
def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue rows without the parameters."""
    return A.catalog(T.blocks(spark, d)).select("ordinal", "name", "block_type", "language", "code", "line_count")


@op("parameters", "catalog")
def parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of each block with type and default."""
    return A.catalog(T.blocks(spark, d)).select("ordinal", "parameters")


@op("parameter_counts", "catalog", w(BLOCKS) + r"""
    , h AS (SELECT ordinal, regexp_extract(source_code, 'def\s+\w+\s*\(([^)]*)\)', 1) AS raw FROM b WHERE language = 'python' AND source_code IS NOT NULL),
    p AS (SELECT ordinal, regexp_replace(raw, '\[[^\]]*\]', '', 'g') AS raw FROM h)
    SELECT ordinal, len(list_filter(string_split(raw, ','), lambda x: trim(x) NOT IN ('', 'self', 'cls'))) AS n FROM p""")
def parameter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of parameters of each Python block."""
    return A.catalog(T.blocks(spark, d, "language = 'python' and source_code is not null")).select("ordinal", F.size("parameters").cast("long").alias("n"))


@op("docs_sections", "docs")
def docs_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the documentation with signatures, descriptions and members."""
    return A.docs_sections(T.blocks(spark, d))


@op("docs_members", "docs", w(BLOCKS) + ", m AS (SELECT scan_id, parent AS name, count(*) AS members FROM b WHERE parent IS NOT NULL GROUP BY 1, 2) SELECT b.ordinal, CASE WHEN b.block_type IN ('class', 'widget', 'component', 'struct') THEN coalesce(m.members, 0) ELSE 0 END::INTEGER AS members FROM b LEFT JOIN m USING (scan_id, name) WHERE b.parent IS NULL")
def docs_members(spark: SparkSession, d: str) -> DataFrame:
    """Number of members of each section."""
    return A.docs_sections(T.blocks(spark, d)).select("ordinal", F.size("members").alias("members"))


@op("docs_by_kind", "docs", w(BLOCKS) + "SELECT block_type, count(*) AS sections FROM b WHERE parent IS NULL GROUP BY 1")
def docs_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Sections by kind."""
    return A.docs_sections(T.blocks(spark, d)).groupBy("block_type").agg(F.count("*").alias("sections"))


@op("migration_matches", "migration", w(BLOCKS) + r"""
    SELECT 'react_class_to_hooks' AS pattern_id, item_id, ordinal FROM b WHERE language = 'javascript' AND regexp_matches(source_code, 'class\s+\w+\s+extends\s+(?:React\.)?(?:Component|PureComponent)')
    UNION ALL SELECT 'flutter_stateful_to_riverpod', item_id, ordinal FROM b WHERE language = 'dart' AND regexp_matches(source_code, 'class\s+\w+\s+extends\s+StatefulWidget')
    UNION ALL SELECT 'python_class_to_dataclass', item_id, ordinal FROM b WHERE language = 'python' AND regexp_matches(source_code, 'class\s+\w+:?\s*\n\s+def\s+__init__\(self')
    UNION ALL SELECT 'js_promise_to_async', item_id, ordinal FROM b WHERE language = 'javascript' AND regexp_matches(source_code, '\.then\s*\(')""")
def migration_matches(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that could be migrated."""
    return A.migrations(T.blocks(spark, d)).select("pattern_id", "item_id", "ordinal")


@op("migration_apply", "migration")
def migration_apply(spark: SparkSession, d: str, pattern_id: str = "react_class_to_hooks") -> DataFrame:
    """Blocks after a migration."""
    return A.migrated(T.blocks(spark, d), pattern_id)


_FOLDER = "(SELECT CASE WHEN len(l) > 1 THEN l[-2] ELSE 'root' END FROM (SELECT list_filter(string_split(replace(file_path, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.') AS l))"


@op("boilerplate_groups", "template", w(BLOCKS) + f"SELECT {_FOLDER} AS directory, block_type, count(*) AS n, list_slice(list(name ORDER BY ordinal), 1, 5) AS names FROM b GROUP BY 1, 2 HAVING count(*) >= 2")
def boilerplate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of block that a folder holds more than once."""
    return A.boilerplate(T.blocks(spark, d))


@op("templates", "template")
def templates(spark: SparkSession, d: str) -> DataFrame:
    """A template for each such kind."""
    return A.templates(T.blocks(spark, d))


@op("template_apply", "template", w(BLOCKS) + "SELECT ordinal, replace(replace('class {{name}}({{base}}): pass', '{{name}}', name), '{{base}}', coalesce(parent, 'object')) AS code FROM b WHERE name IS NOT NULL")
def template_apply(spark: SparkSession, d: str) -> DataFrame:
    """A template filled in for each block."""
    v = F.create_map(F.lit("name"), "name", F.lit("base"), F.coalesce("parent", F.lit("object")))
    return T.blocks(spark, d, "name is not null").select("ordinal", A.apply_template("class {{name}}({{base}}): pass", v).alias("code"))


@op("case_variants", "template", w(BLOCKS) + r"""
    , x AS (SELECT DISTINCT name, list_filter(CASE WHEN contains(name, '_') THEN string_split(name, '_') WHEN contains(name, '-') THEN string_split(name, '-') ELSE string_split(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1' || chr(1) || '\2', 'g'), '([A-Z])([A-Z][a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)) END, lambda y: y <> '') AS ws FROM b WHERE name IS NOT NULL)
    SELECT name, array_to_string(list_transform(ws, lambda y: upper(y[1:1]) || lower(y[2:])), '') AS pascal, array_to_string(list_transform(ws, lambda y: lower(y)), '_') AS snake, array_to_string(list_transform(ws, lambda y: upper(y)), '_') AS upper, array_to_string(list_transform(ws, lambda y: lower(y)), '-') AS kebab FROM x""")
def case_variants(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of each name."""
    v = T.blocks(spark, d, "name is not null").select("name").distinct().withColumn("v", X.case_variants("name"))
    return v.select("name", "v.pascal", "v.snake", "v.upper", "v.kebab")


@op("clone_counts", "template", w(BLOCKS) + "SELECT ordinal, ((length(source_code) - length(replace(source_code, name, ''))) / length(name))::INTEGER AS found FROM b WHERE source_code IS NOT NULL AND length(name) > 0")
def clone_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each block holds its own name."""
    return T.blocks(spark, d, "source_code is not null and length(name) > 0").select("ordinal", X.occurrences("source_code", F.col("name")).alias("found"))


@op("clone_preview", "template")
def clone_preview(spark: SparkSession, d: str, new_name: str = "FreshSampleThing") -> DataFrame:
    """Each block with its name replaced in all spellings."""
    code, n = A.cloned(F.col("source_code"), X.case_variants("name"), X.case_variants(F.lit(new_name)))
    return T.blocks(spark, d, "source_code is not null and name is not null").select("ordinal", code.alias("code"), n.alias("replacements"))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = T.blocks(spark, d, "name is not null")
    return b.filter("scan_id < '8'"), b.filter("scan_id >= '8'")


@op("diff_counts", "diff", w(BLOCKS) + f"""
    , k AS (SELECT name, block_type, coalesce(language, '') AS language, source_code, ordinal, scan_id < '8' AS first_scan FROM b WHERE name IS NOT NULL),
    a AS (SELECT * FROM k WHERE first_scan QUALIFY row_number() OVER (PARTITION BY name, block_type, language ORDER BY ordinal DESC) = 1), z AS (SELECT * FROM k WHERE NOT first_scan QUALIFY row_number() OVER (PARTITION BY name, block_type, language ORDER BY ordinal DESC) = 1)
    SELECT CASE WHEN a.name IS NULL THEN 'added' WHEN z.name IS NULL THEN 'removed' WHEN {STRIP.format('a.source_code')} <> {STRIP.format('z.source_code')} THEN 'modified' ELSE 'unchanged' END AS change, count(*) AS items
    FROM a FULL JOIN z ON a.name = z.name AND a.block_type = z.block_type AND a.language = z.language GROUP BY 1""")
def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items added, removed, modified and unchanged between two sets of scans."""
    return A.diff(*_two(spark, d)).groupBy("change").agg(F.count("*").alias("items"))


@op("diff_rows", "diff", w(BLOCKS) + f"""
    , k AS (SELECT name, block_type, coalesce(language, '') AS language, source_code, ordinal, scan_id < '8' AS first_scan FROM b WHERE name IS NOT NULL),
    a AS (SELECT * FROM k WHERE first_scan QUALIFY row_number() OVER (PARTITION BY name, block_type, language ORDER BY ordinal DESC) = 1), z AS (SELECT * FROM k WHERE NOT first_scan QUALIFY row_number() OVER (PARTITION BY name, block_type, language ORDER BY ordinal DESC) = 1)
    SELECT * FROM (SELECT CASE WHEN a.name IS NULL THEN 'added' WHEN z.name IS NULL THEN 'removed' WHEN {STRIP.format('a.source_code')} <> {STRIP.format('z.source_code')} THEN 'modified' ELSE 'unchanged' END AS change, coalesce(a.name, z.name) AS name, coalesce(a.block_type, z.block_type) AS block_type, coalesce(a.language, z.language) AS language, a.source_code[:1500] AS a_code, z.source_code[:1500] AS b_code
    FROM a FULL JOIN z ON a.name = z.name AND a.block_type = z.block_type AND a.language = z.language) WHERE change <> 'unchanged' """)
def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    """The changes themselves."""
    return A.diff(*_two(spark, d)).filter("change <> 'unchanged'")


@op("entry_points", "tour", w(NODES, EDGES) + """, f AS (SELECT dst AS item_id, count(*) AS fan_in FROM e GROUP BY 1) SELECT n.item_id, n.name, coalesce(fan_in, 0) AS fan_in, n.ordinal FROM n LEFT JOIN f USING (item_id) WHERE lower(name) IN ('main', 'app', 'index', 'setup', 'run', 'start', 'serve', '__main__', '__init__') OR contains(lower(name), 'main') OR contains(lower(name), 'app') OR contains(lower(name), 'index') ORDER BY fan_in, ordinal LIMIT 5""")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Likely entry points, those least referred to first."""
    return A.entry_points(T.nodes(spark, d), T.edges(spark, d))


@op("tour", "tour")
def tour(spark: SparkSession, d: str) -> DataFrame:
    """A reading order of 30 steps from the entry points."""
    return A.tour(T.nodes(spark, d), T.edges(spark, d))


# Merge ---------------------------------------------------------------------------------------------------------------

_KEY = "m AS (SELECT *, concat_ws('::', scan_id, item_id) AS key FROM b QUALIFY row_number() OVER (PARTITION BY scan_id, item_id ORDER BY ordinal DESC) = 1)"
_SCANS = "sc AS (SELECT DISTINCT ON (scan_id) * FROM scans ORDER BY scan_id)"
_KNOWN = "kn AS (SELECT DISTINCT unnest([name, qualified_name]) AS x FROM m)"


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return M.merged(T.blocks(spark, d))


@op("merge_keys", "merge", w(BLOCKS, _KEY) + "SELECT key, ordinal FROM m")
def merge_keys(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all scans under their composite key."""
    return _merged(spark, d).select("key", "ordinal")


@op("naming_conflicts", "merge", w(BLOCKS, _KEY, _SCANS) + "SELECT m.name, count(*) AS items, count(DISTINCT sc.project_name) AS projects FROM m LEFT JOIN sc USING (scan_id) GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT sc.project_name) >= 2")
def naming_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Names that several projects use."""
    return M.naming_conflicts(_merged(spark, d), T.read(spark, d, "scans"))


@op("language_groups", "merge", w(BLOCKS, _KEY) + """
    , g AS (SELECT m.*, map {'javascript': 'js_ts', 'typescript': 'js_ts', 'html': 'js_ts', 'java': 'jvm', 'kotlin': 'jvm', 'python': 'python', 'dart': 'dart', 'rust': 'rust', 'go': 'go', 'cpp': 'cpp', 'ruby': 'ruby', 'swift': 'swift', 'csharp': 'csharp'}[language] AS grp FROM m)
    SELECT grp, count(*) AS blocks, list_slice(list(key ORDER BY ordinal), 1, 2) AS examples FROM g WHERE grp IS NOT NULL GROUP BY 1""")
def language_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of languages with two examples each."""
    return M.language_groups(_merged(spark, d))


@op("orphans", "merge", w(BLOCKS, _KEY, _KNOWN) + "SELECT key, name, parent FROM m WHERE block_type = 'method' AND parent IS NOT NULL AND parent NOT IN (SELECT x FROM kn WHERE x IS NOT NULL)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Methods without their class."""
    return M.orphans(_merged(spark, d)).select("key", "name", "parent")


@op("unresolved_refs", "merge", w(BLOCKS, _KEY, _KNOWN) + "SELECT DISTINCT key, reference FROM (SELECT key, unnest(type_references) AS reference FROM m) WHERE reference NOT IN (SELECT x FROM kn WHERE x IS NOT NULL)")
def unresolved_refs(spark: SparkSession, d: str) -> DataFrame:
    """References that nothing meets."""
    return M.unresolved(_merged(spark, d))


@op("merge_issues", "merge")
def merge_issues(spark: SparkSession, d: str) -> DataFrame:
    """All findings of the validation."""
    return M.issues(_merged(spark, d), T.read(spark, d, "scans"), G.components(T.edges(spark, d)))


@op("compat_score", "merge")
def compat_score(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility of the merge with its penalties."""
    return M.compatibility(_merged(spark, d), T.read(spark, d, "scans"), G.components(T.edges(spark, d)))


@op("rename_resolution", "merge", w(BLOCKS, _KEY) + r"""
    , nm AS (SELECT key, name AS old_name, name || 'X' AS new_name FROM m WHERE block_type = 'class' AND length(name) > 0), la AS (SELECT old_name, arg_max(new_name, key) AS nn FROM nm GROUP BY 1)
    SELECT m.key, coalesce(nm.new_name, m.name) AS name, CASE WHEN nm.old_name IS NULL THEN m.source_code ELSE regexp_replace(m.source_code, '\b' || nm.old_name || '\b', nm.new_name, 'g') END AS source_code FROM m LEFT JOIN nm USING (key)""")
def rename_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Blocks after every class got a new name."""
    m = _merged(spark, d)
    return M.renamed(m, m.filter("block_type = 'class' and length(name) > 0").select("key", F.col("name").alias("old_name"), F.concat("name", F.lit("X")).alias("new_name"))).select("key", "name", "source_code")


@op("palette", "merge", w(BLOCKS, ITEMS, _SCANS) + "SELECT concat_ws('::', i.scan_id, i.item_id) AS key, sc.project_name, i.ordinal, coalesce(len(b.type_references), -1) AS refs FROM i JOIN sc ON sc.scan_id = i.scan_id AND sc.status = 'ready' LEFT JOIN b ON b.ordinal = i.ordinal")
def palette(spark: SparkSession, d: str) -> DataFrame:
    """Items of ready scans with the number of their references."""
    return M.palette(T.items(spark, d), T.read(spark, d, "scans"), T.blocks(spark, d)).select("key", "project_name", "ordinal", F.coalesce(F.size("type_references"), F.lit(-1)).cast("long").alias("refs"))


@op("resolvable_deps", "merge", w(BLOCKS, ITEMS, _SCANS) + """
    , m AS (SELECT *, concat_ws('::', scan_id, item_id) AS key FROM b WHERE scan_id < '8' QUALIFY row_number() OVER (PARTITION BY scan_id, item_id ORDER BY ordinal DESC) = 1), kn AS (SELECT DISTINCT unnest([name, qualified_name]) AS x FROM m),
    un AS (SELECT key, unnest(list_distinct(type_references)) AS reference FROM m), nd AS (SELECT reference, count(*) AS needed_by FROM un WHERE reference NOT IN (SELECT x FROM kn WHERE x IS NOT NULL) GROUP BY 1),
    p AS (SELECT i.name, concat_ws('::', i.scan_id, i.item_id) AS key FROM i JOIN sc ON sc.scan_id = i.scan_id AND sc.status = 'ready'), h AS (SELECT name AS reference, count(*) AS candidates, min(key) AS first_candidate FROM p WHERE key NOT IN (SELECT key FROM m) GROUP BY 1)
    SELECT reference, needed_by, coalesce(candidates, 0) AS candidates, first_candidate FROM nd LEFT JOIN h USING (reference)""")
def resolvable_deps(spark: SparkSession, d: str) -> DataFrame:
    """Open references of the merge of one half of the scans, and what the palette of all scans has for them."""
    return M.resolvable(M.merged(T.blocks(spark, d).filter("scan_id < '8'")), M.palette(T.items(spark, d), T.read(spark, d, "scans"), T.blocks(spark, d)))


@op("template_match", "merge", w(BLOCKS, ITEMS, _SCANS) + ", w AS (SELECT DISTINCT name, block_type, language FROM b WHERE block_type = 'class'), p AS (SELECT i.*, concat_ws('::', i.scan_id, i.item_id) AS key FROM i JOIN sc ON sc.scan_id = i.scan_id AND sc.status = 'ready' QUALIFY row_number() OVER (PARTITION BY name, block_type, language ORDER BY ordinal) = 1) SELECT w.name, w.block_type, w.language, p.key FROM w LEFT JOIN p USING (name, block_type, language)")
def template_match(spark: SparkSession, d: str) -> DataFrame:
    """The first item of the palette for each wanted class."""
    want = T.blocks(spark, d, "block_type = 'class'").select("name", "block_type", "language").distinct()
    return M.template_match(want, M.palette(T.items(spark, d), T.read(spark, d, "scans"), T.blocks(spark, d)))


# Search --------------------------------------------------------------------------------------------------------------

@op("search_items", "search", w(NODES) + "SELECT item_id, qualified_name AS name FROM n WHERE contains(lower(qualified_name), 'service') OR contains(lower(name), 'service') ORDER BY ordinal LIMIT 20")
def search_items(spark: SparkSession, d: str, query: str = "service") -> DataFrame:
    """The first 20 items that hold a text in their name."""
    return S.search(T.nodes(spark, d), query).select("item_id", F.col("qualified_name").alias("name"))


@op("resolve_items", "search", w(NODES) + """
    , q AS (SELECT DISTINCT parent AS query FROM n WHERE parent IS NOT NULL), c AS (SELECT q.query, n.item_id, n.ordinal, CASE WHEN n.name = q.query OR n.qualified_name = q.query THEN 1 ELSE 2 END AS tier FROM q JOIN n ON lower(n.name) = lower(q.query) OR lower(n.qualified_name) = lower(q.query))
    SELECT query, item_id, tier FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, ordinal) = 1""")
def resolve_items(spark: SparkSession, d: str) -> DataFrame:
    """The best item for each parent's name: exact before case-blind, the first of several."""
    n = T.nodes(spark, d)
    return S.resolve(n, n.filter("parent is not null").select(F.col("parent").alias("query")).distinct()).select("query", "item_id", "tier")


@op("rank_relevance", "search", w(NODES) + """
    , s AS (SELECT item_id, ordinal, 0.1 + list_sum(list_transform(['merge', 'python', 'service'], lambda q: CASE WHEN lower(name) = q OR lower(list_extract(string_split(qualified_name, '.'), -1)) = q THEN 10.0 WHEN contains(lower(qualified_name), q) THEN 5.0 ELSE 0.0 END
        + CASE WHEN contains(lower(block_type), q) THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(coalesce(language, '')), q) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(file_path), q) THEN 3.0 ELSE 0.0 END)) AS score FROM n)
    SELECT item_id, round(score, 1)::DOUBLE AS score FROM s ORDER BY score DESC, ordinal LIMIT 20""")
def rank_relevance(spark: SparkSession, d: str, query: str = "merge python service") -> DataFrame:
    """The 20 items that fit a query best."""
    return S.relevance(T.nodes(spark, d), query).select("item_id", "score")
