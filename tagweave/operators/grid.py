"""Grid, list and dict operators over DataFrames.

A grid is a DataFrame; its order, where an operator needs one, is named by `order`
columns that must be total. Table metadata travels in a side dict, column metadata in
the schema.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.filters import Compiler, Model
from tagweave.functions.lineage import durable


class GridError(LookupError):
    pass


def _predicate(df: DataFrame, condition: str | Column, model: Model | None = None) -> tuple[DataFrame, Column]:
    if isinstance(condition, Column):
        return df, condition
    compiler = Compiler(df, model)
    from tagweave.functions.filters import parse

    column = compiler.column(parse(condition))
    return compiler.df, column


def filter_rows(df: DataFrame, condition: str | Column, model: Model | None = None) -> DataFrame:
    wide, predicate = _predicate(df, condition, model)
    return wide.where(predicate).select(*df.columns)


def remove(df: DataFrame, condition: str | Column, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was removed)."""
    wide, held = _predicate(df, condition, model)
    predicate = F.coalesce(held, F.lit(False))
    return wide.where(~predicate).select(*df.columns), wide.where(predicate).select(*df.columns)


def find(df: DataFrame, condition: str | Column, order: Sequence[str]) -> DataFrame:
    """The first match in order, or no row."""
    return filter_rows(df, condition).orderBy(*order).limit(1)


def read_one(df: DataFrame, condition: str | Column, order: Sequence[str], checked: bool = True) -> dict | None:
    rows = find(df, condition, order).collect()  # one row at most
    if not rows and checked:
        raise GridError(f"no record for {condition}")
    return rows[0].asDict() if rows else None


def matches(df: DataFrame, condition: str | Column) -> DataFrame:
    """One row: any, all. No rows: both false."""
    wide, held = _predicate(df, condition)
    predicate = F.coalesce(held, F.lit(False))
    return wide.agg(
        F.coalesce(F.bool_or(predicate), F.lit(False)).alias("any"),
        F.coalesce(F.bool_and(predicate), F.lit(False)).alias("all"),
    )


def filter_by(df: DataFrame, column: str, inner: Callable[[Column], Column]) -> DataFrame:
    """Rows whose list cell has an item that satisfies inner; a struct cell is one item."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return df.where(F.coalesce(F.exists(column, inner), F.lit(False)))
    if isinstance(kind, T.StructType):
        return df.where(F.coalesce(inner(F.col(column)), F.lit(False)))
    return df.where(F.lit(False))


def any_by(df: DataFrame, column: str, inner: Callable[[Column], Column]) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(F.exists(column, inner)), F.lit(False)).alias("any"))


def all_by(df: DataFrame, column: str, inner: Callable[[Column], Column]) -> DataFrame:
    """True if every cell is a list with items that all satisfy inner, and there are rows."""
    whole = F.coalesce((F.size(column) > 0) & F.forall(column, inner), F.lit(False))
    return df.agg(F.coalesce(F.bool_and(whole), F.lit(False)).alias("all"))


def unique_by(df: DataFrame, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in order; rows that miss a key go."""
    first = Window.partitionBy(*names).orderBy(*order)
    return df.na.drop(subset=list(names)).withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def limit_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist, in the grid's own order."""
    return df.select(*(c for c in df.columns if c in set(names)))


def reorder_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    front = [n for n in names if n in df.columns]
    return df.select(*front, *(c for c in df.columns if c not in front))


def add_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Appends rows and widens the schema."""
    return df.unionByName(other, allowMissingColumns=True)


def sort_by(df: DataFrame, names: Sequence[str], descending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    keys = [*names, *tie]
    return df.orderBy(*(F.desc(k) if descending else F.asc(k) for k in keys))


def reverse(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in the opposite of their order."""
    return df.orderBy(*(F.desc(k) for k in order))


def last(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The last row in order, or none."""
    return reverse(df, order).limit(1)


def get(df: DataFrame, order: Sequence[str], at: int) -> DataFrame:
    """The row at a place, counted from 0, or none."""
    return df.orderBy(*order).offset(at).limit(1) if at >= 0 else df.limit(0)


def length(df: DataFrame) -> DataFrame:
    """One row: n, and empty."""
    return df.agg(F.count("*").alias("n"), (F.count("*") == 0).alias("empty"))


def clear(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.limit(0)


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """df with each row's place in order, counted from 0; order must be total.

    Sorted range partitions are numbered by themselves and moved on by the sizes of those
    before them. They are checkpointed first, so sizes and rows are of one sorting."""
    dealt = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = dealt.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return inside.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__nth") - 1).drop("__part", "__start", "__nth")


def insert(df: DataFrame, order: Sequence[str], at: int, rows: DataFrame, rows_order: Sequence[str]) -> DataFrame:
    """df with `rows` from place `at` on, as columns and `position`; places beyond the end
    append. Columns that one side lacks are null there."""
    old, new = numbered(df, order), numbered(rows, rows_order)
    n, more = old.count(), new.count()
    at = min(max(at, 0), n)
    moved = old.withColumn("position", F.when(F.col("position") >= at, F.col("position") + more).otherwise(F.col("position")))
    return moved.unionByName(new.withColumn("position", F.col("position") + at), allowMissingColumns=True)


def set_row(df: DataFrame, order: Sequence[str], at: int, values: dict[str, object]) -> DataFrame:
    """df, with `position`, whose row at a place has these values and no others."""
    types = {f.name: f.dataType for f in df.schema.fields}
    here = F.col("position") == at
    return numbered(df, order).select(*(F.when(here, F.lit(values.get(c)).cast(types[c])).otherwise(F.col(c)).alias(c) for c in df.columns), "position")


def zip_rows(a: DataFrame, a_order: Sequence[str], b: DataFrame, b_order: Sequence[str]) -> DataFrame:
    """Rows of two grids side by side by their places, as far as the shorter one goes."""
    return numbered(a, a_order, "__at").join(numbered(b, b_order, "__at"), "__at").drop("__at")


def flatten(df: DataFrame, column: str) -> DataFrame:
    """A row for each item of a list of lists; other columns repeat."""
    return df.withColumn(column, F.explode(F.flatten(F.col(column))))


def row_range(df: DataFrame, order: Sequence[str], start: int, end: int | None = None) -> DataFrame:
    """range(n): first n rows, 0 for all; range(a, b): rows a to b, both included."""
    if end is None:
        return df if start == 0 else df.orderBy(*order).limit(start)
    return df.orderBy(*order).offset(start).limit(end - start + 1)


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int, most: int = 1000) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def list_by(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The column's values in order, without missing ones: (position, column), a row each, so
    a long list lies in many partitions. A list in one cell is made by group, where groups
    are bounded."""
    held = df.where(F.col(column).isNotNull()).select(*dict.fromkeys([*order, column]))
    return numbered(held, order).select("position", column)


def fold(df: DataFrame, column: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """sum, min, max, avg of a number column."""
    sizes = {"sum": F.sum(column), "min": F.min(column), "max": F.max(column), "avg": F.avg(column)}
    return df.groupBy(*by).agg(*((F.round(v, digits) if digits is not None else v).alias(f"{k}_{column}") for k, v in sizes.items()))


def with_totals(df: DataFrame, key: str, sums: dict[str, Column], label: str = "TOTAL") -> DataFrame:
    """Groups of key and one TOTAL row, in one pass by rollup."""
    out = df.rollup(key).agg(*(v.alias(k) for k, v in sums.items()), F.grouping(key).alias("__total"))
    return out.withColumn(key, F.when(F.col("__total") == 1, label).otherwise(F.col(key))).drop("__total")


def with_column_meta(df: DataFrame, column: str, **meta: object) -> DataFrame:
    return df.withMetadata(column, {**(df.schema[column].metadata or {}), **meta})


def prune_empty_columns(df: DataFrame) -> DataFrame:
    """Drops columns that no row has a value in; costs one pass."""
    held = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if held[c]))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def record_types(df: DataFrame, kind: str, tags: Column) -> DataFrame:
    """Per kind: number of records and the sorted tag names they use."""
    return df.groupBy(kind).agg(
        F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(tags)))).alias("tags")
    )


def schema_counts(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(t).isNotNull()).alias(t) for t in tags))


# --- lists ---


def list_all(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce((F.size(items) > 0) & F.forall(items, test), F.lit(False))


def list_sort(items: Column) -> Column:
    """Ascending, nulls first."""
    return F.sort_array(items, asc=True)


def list_sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + F.coalesce(x.cast("double"), F.lit(0.0)))


def list_avg(items: Column) -> Column:
    held = F.array_compact(items)
    return F.when(F.size(held) > 0, list_sum(held) / F.size(held))


def list_slice(items: Column, start: int, end: int) -> Column:
    """Items start to end, both included, counted from 0."""
    return F.slice(items, start + 1, end - start + 1)


def list_insert(items: Column, at: int, value: Column) -> Column:
    return F.array_insert(items, at + 1 if at >= 0 else at, value)


def list_remove_at(items: Column, at: int) -> Column:
    return F.filter(items, lambda _, i: i != at)


def list_includes(items: Column, value: Column, start: int = 0) -> Column:
    return F.coalesce(F.array_contains(F.slice(items, start + 1, F.greatest(F.size(items), F.lit(1))), value), F.lit(False))


def list_reverse(items: Column) -> Column:
    return F.reverse(items)


def list_flat(items: Column) -> Column:
    """One level of lists less."""
    return F.flatten(items)


def list_find(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first item that passes, or null."""
    return F.get(F.filter(items, test), F.lit(0))


def list_reduce(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, start, step)


# --- dicts ---


def dict_get(record: Column, name: str, default: Column | None = None) -> Column:
    value = F.element_at(record, name)
    return value if default is None else F.coalesce(value, default)


def dict_set(record: Column, name: str, value: Column) -> Column:
    return _merge_two(record, F.create_map(F.lit(name), value))


def dict_has(record: Column, *names: str) -> Column:
    """Whether it has every name, whatever the values."""
    out = F.lit(True)
    for n in names:
        out = out & F.map_contains_key(record, n)
    return out


def dict_names(record: Column) -> Column:
    return F.array_sort(F.map_keys(record))


def dict_matches(record: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Whether a pair of name and value passes."""
    return F.size(F.map_filter(record, test)) > 0



def _merge_two(old: Column, new: Column) -> Column:
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_from_entries(F.concat(F.map_entries(kept), F.map_entries(new)))


def dict_merge(*dicts: Column) -> Column:
    """The last value of a key wins."""
    out = dicts[0]
    for later in dicts[1:]:
        out = _merge_two(out, later)
    return out


def dict_remove(record: Column, *names: str) -> Column:
    return F.map_filter(record, lambda k, _: ~k.isin(*names))


def diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and op: add, remove, update or same, by null-safe comparison of columns."""
    a = old.select(F.col(key).alias("__a"), F.struct(*columns).alias("__old"))
    b = new.select(F.col(key).alias("__b"), F.struct(*columns).alias("__new"))
    joined = a.join(b, F.col("__a") == F.col("__b"), "full")
    op = (
        F.when(F.col("__a").isNull(), "add")
        .when(F.col("__b").isNull(), "remove")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "same")
        .otherwise("update")
    )
    return joined.select(F.coalesce("__a", "__b").alias(key), op.alias("op"))


def is_newer(a: Column, b: Column) -> Column:
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.coalesce(a, epoch) > F.coalesce(b, epoch)


def display_name(df: DataFrame, default: str = "") -> Column:
    """The first of the usual naming tags that the table has and the row fills."""
    order = ("dis", "disMacro", "disKey", "name", "def", "tag", "navName", "id")
    return F.coalesce(*(F.col(c).cast("string") for c in order if c in df.columns), F.lit(default))


def expand_macro(pattern: Column, tags: dict[str, Column]) -> Column:
    """`$tag` and `${tag}` with the row's values; unknown and empty ones stay as they are."""
    for name in sorted(tags, key=len, reverse=True):
        value = tags[name].cast("string")
        braced = F.replace(pattern, F.lit("${" + name + "}"), F.coalesce(value, F.lit("${" + name + "}")))
        plain = F.regexp_replace(braced, F.lit(rf"\${name}(?![A-Za-z0-9_])"), F.regexp_replace(F.coalesce(value, F.lit("$" + name)), r"([\\$])", r"\\$1"))
        pattern = plain
    return pattern


def to_tag_name(text: Column) -> Column:
    """camelCase of the text's letters and digits, with a lower-case start."""
    words = F.filter(F.split(F.regexp_replace(text, r"[^A-Za-z0-9_]+", " "), " "), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))), "")
    return F.when(joined.rlike(r"^\d"), F.concat(F.lit("v"), joined)).otherwise(joined)


def is_tag_name(text: Column) -> Column:
    return text.rlike(r"^[a-z][A-Za-z0-9_]*$")


def bulk_update(df: DataFrame, key: str, tags: str, mode: str, changes: dict[str, str]) -> DataFrame:
    """A dry run: key, before, after, changed for a map column of tags; mode is add (only
    missing tags), set (all) or remove."""
    new = F.create_map(*(F.lit(x) for pair in changes.items() for x in pair))
    if mode == "remove":
        after = dict_remove(F.col(tags), *changes)
    elif mode == "set":
        after = dict_merge(F.col(tags), new)
    elif mode == "add":
        after = dict_merge(new, F.col(tags))
    else:
        raise GridError(f"no mode {mode!r}")

    def settled(m: Column) -> Column:
        return F.array_sort(F.map_entries(m))

    return df.select(
        key, F.col(tags).alias("before"), after.alias("after"), (settled(F.col(tags)) != settled(after)).alias("changed")
    )


def enum_decode(code: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in enumerate(names) for x in pair)), code)


def containment_refs(df: DataFrame, parents: DataFrame, ref: str, inherited: Sequence[str]) -> DataFrame:
    """Fills missing refs such as siteRef from the row that `ref` points to."""
    up = parents.select(F.col("id").alias("__id"), *(F.col(c).alias("__" + c) for c in inherited if c in parents.columns))
    joined = df.join(up, F.col(ref) == F.col("__id"), "left")
    return joined.select(
        *(F.coalesce(c, "__" + c).alias(c) if c in inherited and c in parents.columns else F.col(c) for c in df.columns)
    )
