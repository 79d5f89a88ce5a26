"""Reading and writing tagged text files with Spark.

A file is the unit of parallelism: whole files are read by Spark's text source, so any
path that Spark can open works, and parsed in Arrow batches to one row per record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.filters import Quantity, Ref
from tagweave.sources.trio import read_trio, write_trio
from tagweave.sources.values import Grid, Marker, record_json, read_hayson
from tagweave.sources.zinc import read_zinc, write_zinc


def parse_records(text: str, form: str) -> list[dict[str, Any]]:
    if form == "trio":
        return read_trio(text)
    grid = read_zinc(text) if form == "zinc" else read_hayson(text)
    return grid.rows


def scan_files(spark: SparkSession, path: str, include: str | None = None) -> DataFrame:
    """(path, text) of every file below a folder whose name fits the glob."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=include)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_records(spark: SparkSession, path: str, form: str, include: str | None = None) -> DataFrame:
    """(path, pos, record): record maps each tag to its JSON value."""
    return parse_texts(scan_files(spark, path, include), form)


def parse_texts(files: DataFrame, form: str) -> DataFrame:
    """The same for a table of (path, text)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                rows = [(path, k, record_json(r)) for k, r in enumerate(parse_records(text, form))]
                yield pd.DataFrame(rows, columns=["path", "pos", "record"])

    return files.select("path", "text").mapInPandas(parse, "path string, pos int, record map<string,string>")


def tag(record: Column | str, name: str, kind: str) -> Column:
    """A typed column from a record map. Markers are true; numbers lose their unit."""
    column = F.col(record) if isinstance(record, str) else record
    raw = F.try_element_at(column, F.lit(name))
    plain = F.get_json_object(raw, "$.val")
    if kind == "marker":
        return F.when(raw.isNotNull(), True)
    if kind == "unit":
        return F.get_json_object(raw, "$.unit")
    if kind == "string":
        return F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(F.coalesce(plain, raw))
    text = F.coalesce(plain, raw)
    return text.try_cast("double").try_cast(kind) if kind in ("int", "long") else text.try_cast(kind)


def to_grid(df: DataFrame, limit: int | None = None) -> Grid:
    """A small table as a grid; for answers and tests, not for bulk writes."""
    rows = (df.limit(limit) if limit is not None else df).collect()
    columns = [(f.name, {k: v for k, v in (f.metadata or {}).items() if isinstance(v, str)}) for f in df.schema]
    return Grid({}, columns, [{k: tagged(v) for k, v in r.asDict().items() if v is not None} for r in rows])


def tagged(v: Any) -> Any:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return Quantity(float(v))
    return v if isinstance(v, (str, bool, date, list, dict)) else str(v)


def write_text(df: DataFrame, form: str, name: str = "text") -> DataFrame:
    """One row of text per record, made where the record lies: Zinc rows, Trio records or
    JSON. Zinc rows go below the header that `zinc_header` gives."""
    columns = df.columns
    if form == "zinc":
        return zinc_rows(df, name)

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                record = {c: tagged(v.item() if hasattr(v, "item") else v) for c, v in zip(columns, row, strict=True) if v is not None and v == v}
                out.append(write_trio([record]))
            yield pd.DataFrame({name: out})

    if form == "json":
        return df.select(F.to_json(F.struct(*columns)).alias(name))
    return df.mapInPandas(one, f"{name} string")


def zinc_cell(column: Column, kind: T.DataType) -> Column:
    """A value as Zinc writes it, in JVM expressions; nothing for null."""
    if isinstance(kind, T.StringType):
        text = column
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("$", "\\$"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        out = F.concat(F.lit('"'), text, F.lit('"'))
    elif isinstance(kind, T.BooleanType):
        out = F.when(column, "T").otherwise("F")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = column.cast("string")
    elif isinstance(kind, T.NumericType):
        x = column.cast("double")
        whole = (F.abs(x) < 1e15) & (x == F.floor(x))
        out = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "INF").otherwise("-INF")).when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    elif isinstance(kind, T.DateType):
        out = column.cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z UTC"))
    else:
        return zinc_cell(F.to_json(column), T.StringType())
    return F.when(column.isNull(), "").otherwise(out)


def zinc_rows(df: DataFrame, name: str = "text") -> DataFrame:
    """One line of Zinc per row, made where the row lies."""
    cells = [zinc_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(F.concat_ws(",", *cells).alias(name))


def write_files(df: DataFrame, path: str, form: str, mode: str = "errorifexists") -> None:
    """A folder with a file for each partition, written by all tasks: csv and zinc files
    have their header each, trio and json files their records."""
    writer = df.write.mode(mode)
    if form == "csv":
        writer.csv(path, header=True)
    elif form == "json":
        writer.json(path)
    elif form == "zinc":
        header = zinc_header(df)

        def headed(batches: Iterator[Any]) -> Iterator[Any]:
            import pyarrow as pa

            for k, batch in enumerate(batches):
                if not k:
                    yield pa.RecordBatch.from_arrays([pa.array(header.split("\n"))], schema=batch.schema)
                yield batch

        zinc_rows(df).mapInArrow(headed, "text string").write.mode(mode).text(path)
    elif form == "trio":
        write_text(df, "trio").write.mode(mode).text(path, lineSep="\n---\n")
    else:
        raise ValueError(f"no format {form!r}")


def changed_files(spark: SparkSession, path: str, since: str, include: str | None = None) -> DataFrame:
    """(path, modified, changed) of every file below a path: whether it changed after a time."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", **({"pathGlobFilter": include} if include else {})).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), (F.col("modificationTime") > F.lit(since).cast("timestamp")).alias("changed"))


class Cache:
    """Derived tables kept as Parquet: one is made again once a source file is newer than
    it, or it is older than its most age."""

    def __init__(self, spark: SparkSession, folder: str, most_age_s: float | None = None):
        self.spark, self.folder, self.most_age_s = spark, folder, most_age_s

    def _files(self, path: str) -> Any:
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(hadoop), at

    def made_at(self, name: str) -> float | None:
        """When a table was written whole, in seconds; None if it wasn't."""
        files, at = self._files(f"{self.folder}/{name}/_SUCCESS")
        return files.getFileStatus(at).getModificationTime() / 1000 if files.exists(at) else None

    def is_stale(self, name: str, sources: list[str], now: float | None = None) -> bool:
        import time

        made = self.made_at(name)
        if made is None or (self.most_age_s is not None and (now or time.time()) - made > self.most_age_s):
            return True
        stamp = F.lit(made).cast("timestamp")
        return any(not changed_files(self.spark, s, "1970-01-01").where(F.col("modified") > stamp).isEmpty() for s in sources)

    def table(self, name: str, sources: list[str], make: Any, now: float | None = None) -> DataFrame:
        if self.is_stale(name, sources, now):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def clear(self, name: str) -> None:
        files, at = self._files(f"{self.folder}/{name}")
        files.delete(at, True)


def zinc_header(df: DataFrame) -> str:
    return "\n".join(write_zinc(Grid({}, [(f.name, {}) for f in df.schema])).split("\n")[:2])


def infer_frame(spark: SparkSession, grid: Grid) -> DataFrame:
    """A grid as a typed table: numbers with their common unit as metadata, markers and
    booleans, dates; everything else as text."""
    fields, values = [], {}
    for name, _ in grid.columns:
        cells = [r.get(name) for r in grid.rows]
        held = [c for c in cells if c is not None]
        if held and all(isinstance(c, Quantity) for c in held):
            unit = {c.unit for c in held}
            kind, meta = T.DoubleType(), {"unit": unit.pop()} if len(unit) == 1 and unit != {""} else {}
            values[name] = [None if c is None else c.value for c in cells]
        elif held and all(isinstance(c, (bool, Marker)) for c in held):
            kind, meta = T.BooleanType(), {}
            values[name] = [None if c is None else True if isinstance(c, Marker) else c for c in cells]
        elif held and all(type(c) is date for c in held):
            kind, meta, values[name] = T.DateType(), {}, cells
        elif held and all(isinstance(c, (str, Ref)) for c in held):
            kind, meta = T.StringType(), {}
            values[name] = [c.id if isinstance(c, Ref) else c for c in cells]
        else:
            kind, meta = T.StringType(), {}
            values[name] = [None if c is None else record_json({"v": c})["v"] for c in cells]
        fields.append(T.StructField(name, kind, True, meta))
    rows = list(zip(*(values[n] for n, _ in grid.columns), strict=True)) if grid.columns else []
    return spark.createDataFrame(rows, T.StructType(fields))


def json_text(grid: Grid) -> str:
    from tagweave.sources.values import to_hayson

    return json.dumps(to_hayson(grid), ensure_ascii=False)
