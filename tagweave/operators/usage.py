"""Usage statistics, quality dashboards and incremental synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.calls import calls
from tagweave.functions.scalars import half_up


def daily_statistics(events: DataFrame, ts: str, tool: str, session: str) -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("calls"), F.count_distinct(tool).alias("unique_tools"), F.count_distinct(session).alias("sessions")
    )


def tool_usage(events: DataFrame, tool: str, duration: str, failed: Column) -> DataFrame:
    return events.groupBy(tool).agg(
        F.count("*").alias("calls"), F.round(F.avg(duration), 4).alias("avg_duration"), F.count_if(failed).alias("errors"),
        F.round(100.0 * F.count_if(failed) / F.count("*"), 4).alias("error_percent"),
    )


def top_queries(searches: DataFrame, text: str, n: int = 20) -> DataFrame:
    """Most frequent queries, trimmed and lower-cased; ties by text."""
    said = F.lower(F.trim(F.col(text)))
    return searches.where(said != "").groupBy(said.alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(n)


def zero_results(searches: DataFrame, text: str, results: Column) -> DataFrame:
    return searches.groupBy(F.lower(F.trim(F.col(text))).alias("query")).agg(F.max(results).alias("__most")).where("__most = 0").select("query")


def active_sessions(events: DataFrame, session: str, action: str, start: str, end: str) -> DataFrame:
    """Sessions that started and haven't ended."""
    ended = events.where(F.col(action) == end).select(session)
    return events.where(F.col(action) == start).select(session).distinct().join(ended, session, "left_anti")


def retained(df: DataFrame, day: str, now: str, days: int = 90) -> DataFrame:
    return df.where(F.col(day) > F.date_sub(F.lit(now).cast("date"), days))


def percent_of(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 0 of nothing."""
    return F.when(whole > 0, half_up(100.0 * part / whole)).otherwise(0).cast("long")


def quality_dashboard(df: DataFrame, keys: Sequence[str], size: str, good: Column, bad: Column) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*keys).agg(
        n.alias("n"), F.count_if(good).alias("good"), F.count_if(bad).alias("bad"), percent_of(F.count_if(good), n).alias("good_percent"),
        half_up(F.avg(size)).alias("avg_size"), F.max(size).alias("max_size"),
    )


def keyword_frequency(df: DataFrame, words: Column, n: int = 20) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def classify_changes(stored: DataFrame, incoming: DataFrame, key: str, mod: str) -> DataFrame:
    """key and change: new, changed (mod differs), unchanged or deleted."""
    a = stored.select(F.col(key).alias("__a"), F.col(mod).alias("__am"))
    b = incoming.select(F.col(key).alias("__b"), F.col(mod).alias("__bm"))
    change = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "deleted").when(F.col("__am").eqNullSafe(F.col("__bm")), "unchanged").otherwise("changed")
    return a.join(b, F.col("__a") == F.col("__b"), "full").select(F.coalesce("__a", "__b").alias(key), change.alias("change"))


def merge_upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows with incoming ones added or in their place, in one full join."""
    cols = [c for c in stored.columns if c != key]
    a = stored.select(key, F.struct(*cols).alias("__a"))
    b = incoming.select(key, F.struct(*cols).alias("__b"))
    picked = F.coalesce("__b", "__a")
    return a.join(b, key, "full").select(key, *(picked.getField(c).alias(c) for c in cols))


def newest_versions(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], keep: int = 4) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("version", nth).where(F.col("version") <= keep)


def export_json(**tables: DataFrame) -> DataFrame:
    """(section, text): the rows of every table as JSON, one row each, so that a long
    log is written by all tasks."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


#: Cost of operations in a source text (fixed values).
OPERATION_COST = {
    "readAll": 10, "read": 1, "eval": 5,
    "map": 2, "each": 2, "fold": 3, "filter": 2, "findAll": 2, "sort": 5, "unique": 4,
    "hisRead": 20, "hisWrite": 15, "hisRollup": 10,
    "concat": 1, "split": 2, "regex": 3,
    "join": 8, "union": 6, "diff": 6,
}

#: Rows that a read of such records is taken to give; the last that fits counts (fixed values).
ROWS_READ = {"his": 10_000, "point": 1000, "equip": 100, "site": 10}


def cost_model(source: Column) -> Column:
    """1 and the costs of all operations, times ten for each level of nested loops."""
    total = F.lit(1)
    for name, cost in OPERATION_COST.items():
        total = total + cost * F.regexp_count(source, F.lit(rf"\b{name}\b"))
    loop = r"\b(?:each|map)\b"
    nesting = F.when(source.rlike(rf"(?s){loop}.*{loop}.*{loop}"), 2).when(source.rlike(rf"(?s){loop}.*{loop}"), 1).otherwise(0)
    return total * F.pow(F.lit(10.0), nesting).cast("long")


def duration_class(cost: Column, source: Column) -> Column:
    """How long a text of such a cost is taken to run."""
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(source, F.lit(r"readAll\s*\(([^)]+)\)"), F.lit(1))), -1)
    rows = F.lit(100)
    for word, n in ROWS_READ.items():
        rows = F.when(F.contains(last, F.lit(word)), n).otherwise(rows)
    weight = cost * F.log10(rows + 1)
    return F.when(weight < 100, "<1s").when(weight < 1000, "1-5s").when(weight < 5000, "5-30s").otherwise(">30s")


def lint(source: Column) -> Column:
    """Names of the issues a source text shows."""
    return F.concat_ws(
        ",",
        F.when(source.rlike(r"(?s)\b(each|map)\b.*\bread(All)?\s*\("), "n+1"),
        F.when(source.rlike(r"(?s)\b(each|map)\b.*\b(each|map)\b"), "nested"),
        F.when(source.rlike(r"\breadAll\s*\(") & ~source.rlike(r"\blimit\b"), "unbounded"),
    )


def suggestions(unknown: DataFrame, known: DataFrame, most: int = 3, n: int = 3) -> DataFrame:
    """(name, suggestion, distance): known names within `most` edits, nearest first.

    A known name is cut into most + 1 pieces. With so many edits at most, one piece is whole
    in the unknown name, within as many places of where it stood: names meet by the known
    name's length and a piece, which finds all pairs and compares only those. A name of fewer
    letters than pieces has an empty piece and meets all names of like length."""
    pieces = F.sequence(F.lit(0), F.lit(most))

    def cut(length: Column, piece: Column) -> tuple[Column, Column]:
        start = F.floor(piece * length / (most + 1))
        return start, F.floor((piece + 1) * length / (most + 1)) - start

    stored = known.select(F.col("name").alias("suggestion"), F.length("name").alias("len")).where("suggestion IS NOT NULL").distinct()
    stored = stored.select("*", F.explode(pieces).alias("piece"))
    start, size = cut(F.col("len"), F.col("piece"))
    stored = stored.select("suggestion", "len", "piece", F.substring("suggestion", start.cast("int") + 1, size.cast("int")).alias("part"))

    asked = unknown.select("name", F.length("name").alias("own")).where("name IS NOT NULL").distinct()
    asked = asked.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("own") - most), F.col("own") + most)).alias("len")).select("*", F.explode(pieces).alias("piece"))
    start, size = cut(F.col("len"), F.col("piece"))
    low, high = F.greatest(F.lit(0), start.cast("int") - most), F.least(F.col("own") - size.cast("int"), start.cast("int") + most)
    asked = asked.select("name", "len", "piece", size.cast("int").alias("size"), low.alias("low"), high.alias("high")).where("low <= high")
    asked = asked.select("name", "len", "piece", F.explode(F.sequence("low", "high")).alias("at"), "size").select("name", "len", "piece", F.substring("name", F.col("at") + 1, F.col("size")).alias("part")).distinct()

    met = asked.join(stored, ["len", "piece", "part"]).select("name", "suggestion", F.levenshtein("name", "suggestion", most).alias("distance")).where("distance > 0").distinct()
    nth = F.row_number().over(Window.partitionBy("name").orderBy("distance", "suggestion"))
    return met.withColumn("k", nth).where(F.col("k") <= n).select("name", "suggestion", "distance")


def calls_with_arguments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, n_args) of all calls of a text, those inside others' arguments too."""
    return calls(df, key, text).select(key, "name", "n_args")


def validate_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (name, n_args and more) with `problem`, from functions (name, required, most,
    deprecated): unknown, deprecated, too few or too many arguments; only calls with one."""
    known = functions.select("name", "required", "most", "deprecated", F.lit(True).alias("__known"))
    joined = calls.join(known, "name", "left")
    problem = (
        F.when(F.col("__known").isNull(), "unknown")
        .when(F.col("n_args") < F.col("required"), "too few arguments")
        .when(F.col("n_args") > F.col("most"), "too many arguments")
        .when(F.col("deprecated"), "deprecated")
    )
    return joined.select(*calls.columns, problem.alias("problem")).where("problem IS NOT NULL")


def corrections(unknown: DataFrame, known: DataFrame, n: int = 3) -> DataFrame:
    """(name, suggestion) for unknown names: known ones that differ by case or at most two
    letters, or start with the same three, nearest first. Names meet by their first three
    letters, or by length as in `suggestions`, never all with all."""
    near = suggestions(unknown.select(F.lower("name").alias("name")).distinct(), known.select(F.lower("name").alias("name")).distinct(), 2, n)
    forms = known.select(F.col("name").alias("suggestion"), F.lower("name").alias("low"))
    asked = unknown.select("name", F.lower("name").alias("low")).distinct()
    same = asked.join(forms, "low").where("name <> suggestion").select("name", "suggestion", F.lit(0).alias("rank"))
    edits = near.withColumnRenamed("name", "low").withColumnRenamed("suggestion", "other").join(asked, "low").join(forms.withColumnRenamed("low", "other"), "other").select("name", "suggestion", F.col("distance").alias("rank"))
    start = F.substring("low", 1, 3)
    like = asked.where(F.length("low") >= 3).withColumn("start", start).join(forms.select("suggestion", start.alias("start")), "start").where("name <> suggestion").select("name", "suggestion", F.lit(9).alias("rank"))
    best = same.unionByName(edits).unionByName(like).groupBy("name", "suggestion").agg(F.min("rank").alias("rank"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("rank", "suggestion"))
    return best.withColumn("k", nth).where(F.col("k") <= n).select("name", "suggestion")
