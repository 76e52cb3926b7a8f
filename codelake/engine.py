"""The engine in one object: scan a tree or read stored tables, then ask."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import registry
from codelake.operators import analysis, graph, ingest, merge, search, similarity
from codelake.sinks import export
from codelake.sources.tree import CodeTree


class Scan:
    """Items, blocks, edges and analyses of one or several source trees; everything is lazy."""

    def __init__(self, spark: SparkSession, blocks: DataFrame):
        self.spark, self.blocks = spark, blocks

    @cached_property
    def nodes(self) -> DataFrame:
        from codelake.tables import last_by_item

        return last_by_item(self.blocks)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.dependency_edges(self.nodes)

    def duplicates(self) -> tuple[DataFrame, DataFrame]:
        return similarity.duplicate_pairs(self.blocks.select(F.col("ordinal").alias("id"), "source_code"))

    def health(self) -> DataFrame:
        return analysis.health_score(self.nodes, self.edges, similarity.duplicate_count(self.blocks.select(F.col("ordinal").alias("id"), "source_code")))

    def dead(self) -> DataFrame:
        return analysis.dead_items(self.nodes, self.edges).orderBy(F.desc("confidence"), "ordinal")

    def catalog(self) -> DataFrame:
        return analysis.catalog(self.blocks).orderBy("block_type", "name")

    def docs(self) -> DataFrame:
        return analysis.docs_sections(self.blocks)

    def tour(self) -> DataFrame:
        return analysis.tour(self.nodes, self.edges)

    def search(self, query: str, **by) -> DataFrame:
        return search.search(self.nodes, query, **by)

    def closure(self, selected: DataFrame) -> DataFrame:
        return graph.smart_extract(self.nodes, self.edges, selected)

    def diff(self, other: Scan) -> DataFrame:
        return analysis.diff(self.blocks, other.blocks)

    def merged(self) -> DataFrame:
        return merge.merged(self.blocks)

    def formatted(self, as_of: str) -> DataFrame:
        return ingest.formatted(self.blocks, as_of)

    def export(self, folder: str, as_of: str) -> DataFrame:
        return export.write_folder(export.exported_files(self.formatted(as_of)), folder)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        spark.dataSource.register(CodeTree)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def files(self, path: str, scan_id: str | None = None) -> DataFrame:
        r = self.spark.read.format("codetree").option("path", path).option("pushFilters", "true")
        return (r.option("scanId", scan_id) if scan_id else r).load()

    def scan(self, path: str, scan_id: str | None = None) -> Scan:
        return Scan(self.spark, ingest.numbered(ingest.scan(self.files(path, scan_id), with_code=True)))

    def select(self, scan: Scan, target: str | None = None, pattern: str | None = None) -> DataFrame:
        """Items by an exact name, else regardless of case, or by a glob; an error if there are none."""
        items = scan.nodes
        if target:
            exact = (F.col("name") == target) | (F.col("qualified_name") == target)
            blind = (F.lower("name") == target.lower()) | (F.lower("qualified_name") == target.lower())
            out = search.best_tier(items.withColumn("tier", F.when(exact, 1).when(blind, 2))).drop("tier")
        elif pattern:
            out = search.glob(items, pattern)
        else:
            return items
        if out.isEmpty():
            raise ValueError(f"no item matches {target or pattern}")
        return out

    def run(self, name: str, folder: str, **params) -> DataFrame:
        return registry.run(self.spark, name, folder, **params)
