"""One object for the whole engine: named tables and what can be asked of them.

    engine = Engine(spark, {"site": sites, "point": points, "history": his})
    engine.query("point and siteRef->area > 1000ft²", select=["id", "dis"], limit=20)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.filters import Model
from tagweave.operators import graph, graph_dsl, grid, search, usage
from tagweave.plans import templates
from tagweave.sources import readers
from tagweave.sources.zinc import write_zinc

MOST_ROWS = 1000


class Engine:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, model: Model | None = None):
        self.spark, self.tables, self.model = spark, dict(tables or {}), model or Model()

    # --- catalogue ---

    def add(self, name: str, table: DataFrame) -> Engine:
        self.tables[name] = table
        return self

    def open(self, name: str, path: str) -> Engine:
        """A Parquet path, or a folder of zinc, trio or json record files by its suffix."""
        form = path.rsplit(".", 1)[-1]
        return self.add(name, readers.read_records(self.spark, path, form) if form in ("zinc", "trio") else self.spark.read.parquet(path))

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise grid.GridError(f"no table {name!r}")
        return self.tables[name]

    # --- records ---

    def read_all(self, table: str, filter_: str) -> DataFrame:
        return grid.filter_rows(self._table(table), filter_, self.model)

    def read(self, table: str, filter_: str, order: Sequence[str], checked: bool = True) -> dict | None:
        return grid.read_one(self.read_all(table, filter_), F.lit(True), order, checked)

    def read_by_id(self, table: str, id_: Any, key: str = "id", checked: bool = True) -> dict | None:
        return grid.read_one(self._table(table), F.col(key) == F.lit(id_), [key], checked)

    def read_by_ids(self, table: str, ids: Sequence[Any], key: str = "id") -> DataFrame:
        return self._table(table).where(F.col(key).isin(list(ids)))

    def count(self, table: str, filter_: str) -> int:
        return self.read_all(table, filter_).count()

    def page(self, table: str, filter_: str, order: Sequence[str], offset: int = 0, limit: int = 100) -> tuple[int, DataFrame]:
        found = self.read_all(table, filter_)
        return found.count(), grid.page(found, order, offset, limit, MOST_ROWS)

    def query(self, table: str, filter_: str, select: Sequence[str] | None = None, limit: int = 100, order: Sequence[str] = ()) -> DataFrame:
        found = self.read_all(table, filter_)
        found = found.orderBy(*order) if order else found
        return (found.select(*select) if select else found).limit(limit)

    def text(self, found: DataFrame, form: str = "json", limit: int = MOST_ROWS) -> str:
        """A small answer as json, zinc or csv text."""
        if form == "csv":
            return found.limit(limit).toPandas().to_csv(index=False)
        small = readers.to_grid(found, limit)
        return write_zinc(small) if form == "zinc" else readers.json_text(small)

    def schema(self, table: str, tags: Sequence[str]) -> DataFrame:
        return grid.schema_counts(self._table(table), tags)

    def record_types(self, table: str, kinds: Sequence[str]) -> DataFrame:
        """(kind, n, tags): records that fill the kind's tag, and what else they fill."""
        df = self._table(table)
        filled = F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in df.columns)))
        each = df.select(F.explode(F.array_intersect(filled, F.array(*(F.lit(k) for k in kinds)))).alias("kind"), filled.alias("tags"))
        out = grid.record_types(each, "kind", F.col("tags"))
        return out.withColumn("tags", F.array_remove("tags", F.col("kind")))

    # --- templates ---

    def template(self, name: str, **parameters: Any) -> DataFrame:
        return templates.run(name, self.tables, **parameters)

    def find_templates(self, query: str, n: int = 5) -> list[tuple[str, float]]:
        return templates.find(query, n)

    # --- functions and their use: table `function`, table `usage` ---

    def functions(self, contains: str = "") -> DataFrame:
        return self._table("function").where(F.contains(F.lower("name"), F.lit(contains.lower())))

    def search_functions(self, query: str, n: int = 20, **filters: Any) -> DataFrame:
        df = search.filter_results(self._table("function"), **filters)
        fields = {k: F.col(k).cast("string") for k in search.FIELD_WEIGHTS if k in df.columns}
        return df.withColumn("score", search.relevance(query, fields)).where("score > 0").orderBy(F.desc("score"), "name").limit(n)

    def function_usage(self, name: str, context: str | None = None, argument: str | None = None) -> DataFrame:
        found = self._table("usage").where(F.col("functionName") == name)
        if context:
            found = found.where(F.col("context").rlike(context))
        if argument:
            found = found.where(F.exists("arguments", lambda a: a.rlike(argument)))
        return found

    def usage_statistics(self) -> DataFrame:
        return self._table("usage").groupBy("functionName").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))

    def unused_functions(self) -> DataFrame:
        used = self._table("usage").select(F.col("functionName").alias("name"))
        return self._table("function").join(used, "name", "left_anti")

    def commit_function(self, changed: DataFrame, stamp: str, keep: int = 10) -> Engine:
        """Adds or updates functions by name; the replaced versions go to `function_backup`,
        which keeps the newest `keep` of each name."""
        stored = self._table("function")
        old = stored.join(changed.select("name"), "name", "left_semi").withColumn("saved", F.lit(stamp).cast("timestamp"))
        backups = self.tables["function_backup"].unionByName(old) if "function_backup" in self.tables else old
        kept = usage.newest_versions(backups, ["name"], [F.desc("saved")], keep).drop("version")
        return self.add("function_backup", kept).add("function", usage.merge_upsert(stored, changed, "name"))

    # --- graph: tables `node`, `edge` ---

    def graph(self, text: str) -> DataFrame:
        return graph_dsl.parse(text).run(self._table("node"), self._table("edge"))

    def find_nodes(self, text: str, n: int = 50) -> DataFrame:
        """Nodes whose name contains the text, by name."""
        return graph.find_nodes(self._table("node"), text).orderBy("name", "id").limit(n)

    def callers(self, id_: Any, depth: int = 5) -> DataFrame:
        return graph.callers(self._table("edge"), self._table("node").where(F.col("id") == id_), depth)

    def callees(self, id_: Any, depth: int = 5) -> DataFrame:
        return graph.callees(self._table("edge"), self._table("node").where(F.col("id") == id_), depth)

    def impact(self, id_: Any, depth: int = 10) -> DataFrame:
        return graph.impact(self._table("edge"), self._table("node").where(F.col("id") == id_), depth)

    def call_graph(self, id_: Any, depth: int = 1) -> DataFrame:
        """(id, calls, called_by) of a node and what it reaches in fewer than depth steps."""
        return graph.call_lists(self._table("edge"), self._table("node").where(F.col("id") == id_), depth)

    def subgraph(self, id_: Any, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges around a node, in either direction."""
        node = self._table("node")
        return graph.subgraph(node, self._table("edge"), node.where(F.col("id") == id_), depth)

    def call_subgraph(self, id_: Any, depth: int = 5, reverse: bool = False, most: int | None = None) -> DataFrame:
        return graph.call_subgraph(self._table("edge"), self._table("node").where(F.col("id") == id_), depth, reverse, most)

    def graph_text(self, form: str = "dot") -> DataFrame:
        return graph.export(self._table("node"), self._table("edge"), form)

    # --- documents and vectors ---

    def search_documents(self, query: str, n: int = 20, table: str = "document") -> DataFrame:
        df = self._table(table)
        score = search.doc_score(query, F.col("title"), F.col("body"), F.col("library"))
        return df.withColumn("score", score).where("score > 0").withColumn("shown", search.highlight(F.col("body"), query)).orderBy(F.desc("score"), "title").limit(n)

    def save_index(self, table: str, key: str, texts: Sequence[str], path: str) -> Engine:
        """Keeps the words of a table at a path, for `search_words`."""
        search.save_index(search.token_index(self._table(table), key, *texts), path)
        return self

    def search_words(self, path: str, words: Sequence[str], every: bool = True) -> DataFrame:
        """(id) of the texts in a kept index that have every word, or any."""
        index = self.spark.read.parquet(path)
        return search.search_all(index, words) if every else search.search_any(index, words)

    def search_lines(self, pattern: str, table: str, key: str, text: str, context: int = 1) -> DataFrame:
        return search.regex_lines(self._table(table), key, text, pattern, context)

    def similar(self, ids: Sequence[Any], k: int = 10, least: float = 0.5, table: str = "vector", key: str = "vec_id") -> DataFrame:
        df = self._table(table)
        return search.nearest(df, df.where(F.col(key).isin(list(ids))), k, key, least=least)


class Workspace:
    """Projects by name, each an engine of its own, and the one that is asked."""

    def __init__(self) -> None:
        self.engines: dict[str, Engine] = {}
        self.current: str | None = None

    def add(self, project: str, engine: Engine, instance: str = "default") -> Workspace:
        """Projects of several instances are told apart as instance/project."""
        name = f"{instance}/{project}"
        self.engines[name] = engine
        self.current = self.current or name
        return self

    def list(self, instance: str | None = None) -> list[str]:
        return sorted(n for n in self.engines if instance is None or n.startswith(f"{instance}/"))

    def use(self, project: str, instance: str = "default") -> Engine:
        name = f"{instance}/{project}"
        if name not in self.engines:
            raise grid.GridError(f"no project {name!r}")
        self.current = name
        return self.engines[name]

    @property
    def engine(self) -> Engine:
        if self.current is None:
            raise grid.GridError("no project is open")
        return self.engines[self.current]
