import os
import time

from codelake import registry
from codelake.engine import Engine
from codelake.plans import catalogue  # noqa: F401
from codelake.sinks import export
from codelake.sources import tree
from codelake.streaming import jobs


def make(folder):
    for p, t in {"pkg/__init__.py": "from .a import run\n", "pkg/a.py": "def run(x):\n    return Helper(x)\n\n\nclass Helper:\n    def go(self):\n        return 1\n", "web/x.js": "export function Run() {\n  return 1;\n}\n", "build/skip.py": "def no(): pass\n", "bad.py": "def (:\n", "n.txt": "x"}.items():
        os.makedirs(os.path.dirname(folder / p), exist_ok=True)
        (folder / p).write_text(t)
    (folder / "raw.sql").write_bytes(b"CREATE TABLE t\xff (id INT);\n")


def test_scan_export(spark, tmp_path):
    make(tmp_path)
    e = Engine(spark)
    assert {os.path.basename(r["file_path"]) for r in e.files(str(tmp_path)).collect()} == {"__init__.py", "a.py", "x.js", "bad.py", "raw.sql"}
    s = e.scan(str(tmp_path), "s1")
    got = [(r["name"], r["ordinal"]) for r in s.blocks.orderBy("ordinal").collect()]
    assert [n for n, _ in got] == ["run", "Helper", "go", "t", "Run"] and [o for _, o in got] == [1, 2, 3, 4, 5]
    assert {(r["src"].rsplit("/", 1)[1], r["dst"].rsplit("/", 1)[1]) for r in s.edges.collect()} == {("a.py:1", "a.py:5"), ("a.py:6", "a.py:5")}
    assert [r["name"] for r in e.select(s, target="RUN").collect()] == ["run", "Run"] or e.select(s, target="RUN").count() == 2
    assert e.select(s, target="run").count() == 1 and e.select(s, pattern="He*").count() == 2
    try:
        e.select(s, target="nothing")
        raise AssertionError
    except ValueError:
        pass
    out = tmp_path / "out"
    assert s.export(str(out), "2026-01-01").count() == 5
    assert (out / "python" / "helper.py").read_text().startswith("# Extracted: Helper")
    f = s.formatted("2026-01-01")
    assert export.write_package(f, str(tmp_path / "pkg_out"), "my-pkg")["manifest"] == "pyproject.toml"
    assert os.path.exists(export.write_zip(str(out), str(tmp_path / "a.zip")))
    assert '"total":5' in export.manifest(f, "/x", "2026-01-01").first()[0] and "| python |" in export.readme(f).first()[0]
    assert s.health().first()["n"] == 5 and s.tour().count() >= 1 and s.search("help").count() == 2 and s.diff(s).filter("change <> 'unchanged'").count() == 0


def test_tree_helpers(tmp_path):
    make(tmp_path)
    assert tree.inside(str(tmp_path / "pkg"), str(tmp_path)) and not tree.inside(str(tmp_path) + "x", str(tmp_path))
    assert [os.path.basename(p) for p in tree.folders(str(tmp_path / "p"), str(tmp_path))] == ["pkg"] and tree.folders("/etc", str(tmp_path)) == []


def test_streams(spark, tmp_path):
    make(tmp_path / "src" / "")
    seen = []
    q = jobs.watch_tree(spark, str(tmp_path / "src"), lambda items, epoch: seen.append({r["name"] for r in items.collect()})).start()
    end = time.time() + 60
    while not seen and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert seen and {"run", "Helper"} <= seen[0]


def test_appended_streams_stay_out_of_the_driver(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 7 if i else None, "click", 900.0, "{}") for i in range(15)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "to_timestamp(ts) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["key"], r["seq"], r["allowed"], r["retry_after"]) for r in registry.run(spark, "stream_rate_limit", str(tmp_path)).orderBy("seq").collect()]
    assert got == [("7", i, i < 4, 0.0 if i < 4 else 86_401.0 - i) for i in range(1, 15)]
    assert [(r["seq"], r["mean_time"]) for r in registry.run(spark, "stream_slow_tools", str(tmp_path)).orderBy("seq").collect()] == [(i, 90.0) for i in range(10, 15)]
    assert not {"stream_rate_limit", "stream_slow_tools"} & {t.name for t in spark.catalog.listTables()}
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert os.path.isdir(folder) and not [x for x in os.listdir(folder) if x.startswith("stream_")]
