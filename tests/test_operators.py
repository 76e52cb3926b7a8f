import numpy as np
from pyspark.sql import functions as F

from codelake import registry
from codelake.functions import text as X
from codelake.operators import analysis as A
from codelake.operators import graph as G
from codelake.operators import merge as M
from codelake.operators import policy as P
from codelake.operators import similarity as D
from codelake.operators import usage as U
from codelake.tables import BLOCK


def block(n, **k):
    r = {"scan_id": "s", "item_id": f"/f/{n}.py:1", "name": n, "qualified_name": n, "block_type": "function", "language": "python", "file_path": f"/f/{n}.py", "line_number": 1, "end_line": 10, "parent": None, "ordinal": 1, "source_code": "def foo(): pass", "imports": [], "decorators": [], "type_references": []} | k
    return tuple(r[f] for f in BLOCK.fieldNames())


def blocks(spark, *rows):
    return spark.createDataFrame(list(rows), BLOCK)


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "type_reference", None) for a, b in pairs], "src string, dst string, edge_type string, reference_name string")


def scans(spark, *rows):
    return spark.createDataFrame(list(rows), "scan_id string, project_name string, source_dir string, status string")


def test_text(spark):
    df = spark.createDataFrame([("a b\r\nc\n", "XMLParserJob"), ("", "get_user"), (None, None), ("größe A_1 x y", "kebab-name")], "t string, n string")
    got = df.select(X.n_lines("t").alias("l"), X.tokens("t").alias("w"), X.est_tokens("t").alias("e"), X.case_variants("n").alias("v"), X.safe_filename("n").alias("f")).collect()
    assert [r["l"] for r in got] == [2, 0, None, 2] and [r["e"] for r in got] == [2, 0, 0, 3]
    assert got[3]["w"] == ["größe", "a_1"] and got[0]["v"]["snake"] == "xml_parser_job" and got[1]["v"]["pascal"] == "GetUser" and got[3]["v"]["camel"] == "kebabName"
    assert got[0]["f"] == "xmlparser_job"
    assert X.glob_to_regex("a[!b]?*.py") == r"(?s)^a[^b]..*\.py$"


def test_edges_and_closure(spark):
    b = blocks(spark, block("fa", type_references=["K", "fa"]), block("K", block_type="class", ordinal=2), block("m", parent="K", block_type="method", qualified_name="K.m", ordinal=3), block("g", imports=["from x import K as Z, fa"], ordinal=4))
    e = {(r["src"], r["dst"], r["edge_type"]) for r in G.dependency_edges(b).collect()}
    f = lambda n: f"/f/{n}.py:1"
    assert e == {(f("fa"), f("K"), "type_reference"), (f("m"), f("K"), "parent"), (f("g"), f("K"), "import"), (f("g"), f("fa"), "import")}
    empty = blocks(spark)
    assert G.dependency_edges(empty).count() == 0
    x = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("d", "a"))
    got = {(r["node"], r["depth"]) for r in G.closure(x, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("b", 1), ("c", 1)}
    assert G.closure(x, spark.createDataFrame([("zz",)], "root string")).count() == 0
    assert {(r["item_id"], r["component"], r["size"]) for r in G.components(x).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3)}
    two = edges(spark, ("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c"), ("a", "a"))
    assert {(r["component"], r["size"]) for r in G.components(two).collect()} == {("a", 2), ("c", 2)}
    assert G.components(edges(spark)).count() == 0 and G.mutual_pairs(two).count() == 2
    assert {(r["item_id"], r["total"]) for r in G.degrees(edges(spark, ("a", "b"), ("a", "b"))).collect()} == {("a", 1), ("b", 1)}


def test_health_and_dead(spark):
    b = blocks(spark, block("long", end_line=200), block("main", ordinal=2), block("_x", ordinal=3), block("test_y", ordinal=4), block("__init__", block_type="method", ordinal=5, source_code=None))
    assert [r["line_count"] for r in A.long_functions(b).filter("name = 'long'").collect()] == [199]
    dead = {r["name"]: r["confidence"] for r in A.dead_items(b, edges(spark)).collect()}
    assert dead == {"long": 0.8, "main": 0.2, "_x": 0.9, "test_y": 0.3, "__init__": 0.1}
    s = A.health_score(b, edges(spark), spark.createDataFrame([(0,)], "dup_n long")).first()
    assert 0 <= s["score"] <= 100
    assert A.health_score(blocks(spark), edges(spark), spark.createDataFrame([(0,)], "dup_n long")).first()["score"] == 100


def test_parameters_and_docs(spark):
    b = blocks(spark, block("f", source_code='def f(self, a: dict[str, int] = None, b=(1, 2)):\n    """First line.\n    more"""'), block("C", block_type="class", source_code="class C(Base):\n    ''''''", ordinal=2), block("m", parent="C", block_type="method", source_code="def m(self): pass", ordinal=3))
    p = {r["name"]: r["parameters"] for r in A.catalog(b).collect()}
    assert [(x["name"], x["type_annotation"], x["default_value"]) for x in p["f"]] == [("a", "dict[str, int]", "None"), ("b", None, "(1, 2")]
    d = {r["name"]: r for r in A.docs_sections(b).collect()}
    assert d["f"]["description"] == "First line." and d["C"]["members"] == ["def m(self)"] and d["C"]["description"] == ""


def test_templates_and_diff(spark):
    df = spark.createDataFrame([({"name": "Foo", "base": "Base"},), ({"name": "Bar", "base": "Parent"},)], "v map<string,string>")
    assert {r[0] for r in df.select(A.apply_template("class {{name}}({{base}}): pass", F.col("v"))).collect()} == {"class Foo(Base): pass", "class Bar(Parent): pass"}
    a = blocks(spark, block("x", source_code=" same \n"), block("y", ordinal=2), block("z", ordinal=3, source_code="1"))
    b = blocks(spark, block("x", source_code="same"), block("w", ordinal=2), block("z", ordinal=3, source_code="2"))
    assert {(r["name"], r["change"]) for r in A.diff(a, b).collect()} == {("x", "unchanged"), ("y", "removed"), ("w", "added"), ("z", "modified")}
    assert {r["change"] for r in A.diff(a, a).collect()} == {"unchanged"}
    t = A.templates(blocks(spark, block("getA", file_path="/p/q/a.py", source_code="def getA(): getA"), block("getB", file_path="/p/q/b.py", ordinal=2))).first()
    assert t["template"] == "def {{name}}(): {{name}}" and t["prefix"] == "get"


def test_duplicates(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    df = spark.createDataFrame([(1, t), (2, t), (3, t + " nu"), (4, "other words that share nothing at all here"), (5, None), (6, ""), (7, "a b")], "id long, source_code string")
    members, links = D.duplicate_pairs(df)
    assert {(r["id"], r["rep"]) for r in members.filter("id < 3").collect()} == {(1, 1), (2, 1)}
    assert [(r["a"], r["b"], r["similarity"]) for r in links.collect()] == [(1, 3, 0.923)]


def test_duplicates_broadcast_no_sketch(spark, tmp_path):
    t = "alpha beta gamma delta epsilon zeta eta"
    spark.createDataFrame([(1, t), (2, t), (3, t + " theta")], "id long, source_code string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")  # a file's size is known and small, so its joins are broadcast unless told otherwise
    members, links = D.duplicate_pairs(df)
    for x in (members, links, D.duplicate_count(df)):
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
    assert D.duplicate_count(df).first()["dup_n"] == 3


def test_bags_and_line_counts(spark):
    codes, counts = np.array([2**48 - 1, 5, 7], np.uint64), np.array([1, 2, 3])
    for n in (counts, counts * 300):  # counts of one byte, and of four
        assert [x.tolist() for x in D.unpack(D.pack(codes, n))] == [[5, 7, 2**48 - 1], [n[1], n[2], n[0]]]
    assert D.common(D.pack(codes, counts), D.pack(codes[1:], counts[1:] * 300)) == 5 and D.common(D.pack(codes[:1], counts[:1]), D.pack(codes[1:], counts[1:])) == 0
    b = blocks(spark, block("long", end_line=200), block("short", ordinal=2), block("text", end_line=None, ordinal=3, source_code="x\n" * 10), block("class", block_type="class", end_line=99, ordinal=4))
    none = spark.createDataFrame([(0,)], "dup_n long")
    counted = b.select("item_id", "block_type", A.line_count().alias("line_count"))
    assert A.health_score(counted, edges(spark), none).first() == A.health_score(b, edges(spark), none).first() and A.health_score(counted, edges(spark), none).first()["long_n"] == 2


def test_duplicate_places_and_repeats(spark):
    words = [f"w{i:03d}" for i in range(60)]
    near, far = [*words[:55], *(f"x{i}" for i in range(5))], [*words[:48], *(f"y{i}" for i in range(12))]  # 55 / 65, 48 / 72
    texts = [" ".join(x) for x in (words, near, far, ["the_word"] * 40, ["the_word"] * 30, ["the_word"] * 29)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (9, texts[1])], "id long, source_code string")
    _, links = D.duplicate_pairs(df)
    alike = {(r["a"], r["b"]): r["similarity"] for r in links.collect()}
    every = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)], "a long, b long")
    exact = {(r["a"], r["b"]): r["similarity"] for r in D.verified(every, D.sketches(D.representatives(df)[0], 0)).collect()}
    assert exact == {(0, 1): 0.846, (3, 4): 0.75, (4, 5): 0.967} and alike.items() <= exact.items()
    assert (0, 1) in alike and (4, 5) in alike
    assert D.duplicate_count(df).first()["dup_n"] == 1 + sum(2 if 1 in p else 1 for p in alike)


def test_merge(spark):
    s = scans(spark, ("p1", "one", "/x", "ready"), ("p2", "two", "/y", "ready"))
    clean = M.merged(blocks(spark, block("a", scan_id="p1"), block("b", scan_id="p2", ordinal=2)))
    none = spark.createDataFrame([], "item_id string, component string, size long")
    score = lambda m: M.compatibility(m, s, none).first()
    assert (score(clean)["score"], score(clean)["grade"]) == (100, "A")
    mixed = M.merged(blocks(spark, block("a", scan_id="p1"), block("b", scan_id="p2", language="dart", ordinal=2)))
    assert score(mixed)["score"] == 70 and "language_coherence" in {r["rule"] for r in M.issues(mixed, s, none).collect()}
    refs = M.merged(blocks(spark, block("App", type_references=["MissingA", "MissingB"])))
    assert (score(refs)["score"], score(refs)["grade"], score(refs)["deps_penalty"]) == (75, "B", 25.0)
    conf = M.merged(blocks(spark, block("Config", scan_id="p1"), block("Config", scan_id="p2", ordinal=2)))
    assert score(conf)["score"] == 95 and M.naming_conflicts(conf, s).count() == 1
    orphan = M.merged(blocks(spark, block("do", block_type="method", parent="Gone")))
    assert score(orphan)["score"] == 97
    r = M.renamed(refs, spark.createDataFrame([("s::/f/App.py:1", "foo", "bar")], "key string, old_name string, new_name string")).first()
    assert r["source_code"] == "def bar(): pass"


def events(spark, *rows):
    return spark.createDataFrame([(i + 1, t, u, x, ok, f"2024-01-01 00:00:{i % 60:02d}") for i, (t, u, x, ok) in enumerate(rows)], "seq long, tool_name string, user_id string, execution_time double, success boolean, ts string").withColumn("ts", F.to_timestamp("ts"))


def test_usage(spark):
    e = events(spark, ("a", "u", 1.0, True), ("a", "u", 2.0, False), ("b", None, 1.0, True))
    s = {r["tool_name"]: r for r in U.tool_stats(e).collect()}
    assert (s["a"]["uses"], s["a"]["success_rate"], s["a"]["avg_time"], s["b"]["users"]) == (2, 0.5, 1.5, 0)
    m = events(spark, *[(t, "u", 1.0, True) for _ in range(20) for t in ("scan", "extract", "format")])
    g = {(r["t1"], r["t2"], r["t3"]): r["n"] for r in U.ngrams(m, 3).collect()}
    assert g == {("scan", "extract", "format"): 20, ("extract", "format", "scan"): 19, ("format", "scan", "extract"): 19}
    assert {(r["src"], r["dst"]): r["probability"] for r in U.next_tools(m).collect()}[("scan", "extract")] == 1.0
    slow = events(spark, *[("s", "u", 6.0, True)] * 11)
    assert [r["kind"] for r in U.bottlenecks(slow).collect()] == ["slow_execution"] and U.moving_average_alerts(slow).count() == 1
    bad = events(spark, *[("s", "u", 1.0, False)] * 10)
    assert [(r["kind"], r["severity"]) for r in U.bottlenecks(bad).collect()] == [("high_error_rate", "high")]
    lim = {(r["key"], r["seq"]): r["allowed"] for r in U.rate_limited(events(spark, *[("t", u, 0.0, True) for u in "xxxxy"]), limit=3).collect()}
    assert lim == {("x", 1): True, ("x", 2): True, ("x", 3): True, ("x", 4): False, ("y", 5): True}
    old, U.BLOCK = U.BLOCK, 7  # runs across the borders of ranges
    try:
        assert sum(r["n"] for r in U.ngrams(m, 3).collect()) == 58
    finally:
        U.BLOCK = old
    assert U.ngrams(events(spark), 3).count() == 0 and U.tool_stats(events(spark)).count() == 0


def test_policy(spark):
    df = spark.createDataFrame([("high", None, 5), (None, "critical", 1)], "priority string, task_type string, n int")
    assert [r["strategy"] for r in P.evaluated(df).collect()] == ["performance", "reliability"]
    got = df.select(
        P.predicate({"type": "not", "rule": {"type": "condition", "field": "gone", "operator": "equals", "value": 1}}, df.columns).alias("a"),
        P.predicate('{"type": "or", "rules": [{"field": "n", "operator": "greater_than", "value": 4}, {"field": "priority", "operator": "contains", "value": "zz"}]}', df.columns).alias("b"),
        P.predicate({"field": "n", "operator": "unknown", "value": 1}, df.columns).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (True, False, False)]
    m = spark.createDataFrame([("a", 1.0, "s", 5.0, 10.0, 1), ("a", 12.0, "s", 5.0, 10.0, 2), ("r", 1.0, "ratio", 0.9, 0.5, 1)], "name string, value double, unit string, warn double, crit double, ts long")
    st = P.metric_status(m)
    assert {r["name"]: r["status"] for r in st.collect()} == {"a": "critical", "r": "healthy"} and P.overall(st).first()[0] == "critical" and P.overall(st.filter("false")).first()[0] == "unknown"


def test_registry(spark):
    import codelake.plans.catalogue  # noqa: F401

    assert registry.describe(spark).count() == len(registry.OPS)
    try:
        registry.run(spark, "no such", "x")
        raise AssertionError
    except KeyError:
        pass


def test_all_coordinates(spark):
    import hashlib
    import re
    from pathlib import Path

    import pytest

    from codelake.plans.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test data")
    texts = {}
    for r in spark.read.parquet(f"{d}/blocks.parquet").select("ordinal", "source_code").filter("source_code is not null").collect():
        texts[r[1]] = min(r[0], texts.get(r[1], r[0]))
    want = {}
    for t, o in texts.items():
        words = [x.lower() for x in re.findall(r"[a-zA-Z_]\w+", t)]
        if len(words) >= 5:
            want |= {(o, i): min(int(hashlib.md5(f"{i}:{x}".encode()).hexdigest()[:8], 16) for x in set(words)) for i in range(64)}
    assert {(r["id"], r["i"]): r["value"] for r in QUERIES["minhash_signatures"](spark, d).collect()} == want
    sums = {}
    for r in spark.read.parquet(f"{d}/embeddings.parquet").select("label", "embedding").filter("embedding is not null").collect():
        for i, x in enumerate(r[1]):
            if x is not None:
                sums.setdefault((r[0], i), []).append(float(x))
    got = {(r["label"], r["i"]): (r["vectors"], r["mean"]) for r in QUERIES["label_centroids"](spark, d).collect()}
    assert got.keys() == sums.keys() and len({i for _, i in got}) > 1
    assert all(n == len(sums[k]) and abs(m - sum(sums[k]) / n) < 1e-5 for k, (n, m) in got.items())
