"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power a, normalised. The exponent is
found by narrowing an interval on totals over the sources: the flattest mix whose
entropy doesn't pass a target, or whose most repeated source stays within a limit of
epochs. Weights become rows as budgeted block permutations: in each epoch a source's
documents are laid out in seeded hash order, cut into blocks of about `BLOCK_DOCS`;
block totals are accumulated over blocks, documents within their block, so no source
gathers in one task; the last epoch ends where the source's token budget is met.

Without a budget the mix is the least one that has every document at least once, so
nothing is dropped.

Defined cases: a null source is a source of its own; a null text has no tokens; a
source without tokens has weight 0 and appears once; rows equal in all columns are
numbered and drawn one by one, like others; an empty table gives an empty mix. The token column may be any
expression; the default counts runs of letters and digits, and single other marks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import MARKED_ROWS, durable, join_small, table, text_of, whole

#: Most epochs of any source in the standard mix.
REPEAT_LIMIT = 2.0
#: Numbers of one row that one task makes.
PIECE = 10_000
BLOCK_DOCS = 4096
SEED = 23
#: Each round of the search evaluates so many exponents in one aggregation.
SECTIONS = 16
ROUNDS = 6
#: Letter or digit runs, and other marks one by one.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def default_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _exponent(sources: DataFrame, target_entropy: float | None, repeat_limit: float | None) -> float:
    """The smallest exponent in [0, 1] that meets the target; 1 if none below does."""
    low, high = 0.0, 1.0
    share = F.col("tokens") / F.col("all_tokens")
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / SECTIONS for k in range(SECTIONS)]
        sums = []
        for k, a in enumerate(points):
            power = F.pow(share, F.lit(a))
            sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log(share)).alias(f"s{k}")]
        found = sources.where("tokens > 0").agg(*sums, F.min(share).alias("least"), F.max(share).alias("most")).first()
        if found["most"] is None:
            return 1.0
        for k, a in enumerate(points):
            if target_entropy is not None:
                entropy = math.log(found[f"z{k}"]) - a * found[f"s{k}"] / found[f"z{k}"]
                met = entropy <= target_entropy
            else:
                met = (found["most"] / found["least"]) ** (1 - a) <= repeat_limit
            if met:
                if a == 0.0:
                    return 0.0
                low, high = points[k - 1] if k else low, a
                break
        else:
            low = points[-1]
    return high


def mix_plan(counted: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT, budget: float | None = None) -> DataFrame:
    """One row per source: tokens, docs, weight, budget, epochs (whole ones), part
    (tokens of the last one), blocks."""
    sources = durable(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = sources.withColumn("all_tokens", F.lit(float(max(1, total))))
    a = _exponent(sources, target_entropy, repeat_limit)
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all_tokens"), F.lit(a))).otherwise(0.0)
    sources = sources.withColumn("raw", raw)
    z = sources.agg(F.sum("raw")).first()[0] or 1.0
    weighted = sources.withColumn("weight", F.col("raw") / F.lit(float(z)))
    if budget is None:  # the least that covers every source once
        budget = weighted.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    own = F.col("weight") * F.lit(float(budget))
    # Rounding must not cost a source its last document.
    ratio = F.when(F.col("tokens") > 0, own / F.col("tokens")).otherwise(1.0) + F.lit(1e-9)
    return weighted.select(
        "source", "tokens", "docs", "weight", own.alias("budget"), F.floor(ratio).cast("int").alias("epochs"),
        F.when(F.col("tokens") > 0, own - F.floor(ratio) * F.col("tokens")).otherwise(0.0).alias("part"),
        F.ceil(F.col("docs") / BLOCK_DOCS).cast("long").alias("blocks"),
    )


def _draw(epoch: Column) -> Column:
    """A row's place in [0, 1) in one epoch's permutation; rows are known by `base`, a hash
    of all their columns, and equal ones by their number, so each has a draw of its own."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), epoch, F.col("base"), F.col("nth")), 11) / F.lit(float(1 << 53))


def _base(docs: DataFrame) -> Column:
    return F.xxhash64(*(F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema))


def numbered(rows: DataFrame, times: str = "times") -> DataFrame:
    """Each row once for each number `nth` below its `times`. Where that is many, its
    numbers are dealt over the tasks in pieces."""
    many = rows.where(F.col(times) > PIECE)
    numbers = rows.where(F.col(times) <= PIECE).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    if many.isEmpty():
        return numbers
    pieces = many.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(PIECE).cast("long")))).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    dealt = pieces.withColumn("nth", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + PIECE, F.col(times)) - 1))).drop("__from")
    return numbers.unionByName(dealt)


def _counted(docs: DataFrame, tokens: Column | None) -> DataFrame:
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (default_tokens(text_of("text")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))).alias("tokens"),
        _base(docs).alias("base"),
    )
    # Equal rows combine before they are shuffled.
    return numbered(durable(rows.groupBy("doc_id", "source", "tokens", "base").agg(F.count("*").alias("times"))))


def _sources_equal(left: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """left with the plan's other columns; `source` is what the plan calls its sources."""

    def tag(name: str) -> Column:
        return F.when(F.col(name).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(name).cast("string")))

    return join_small(left.withColumn("__tag", tag("source")), plan.withColumn("__tag", tag(source)).drop(source, "tokens", "docs"), ["__tag"]).drop("__tag")


def laid_out(counted: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row of the mix with its epoch, draw, block and start among its source's tokens."""
    planned = _sources_equal(counted, plan).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("part") > 0, F.col("epochs")).otherwise(F.greatest(F.col("epochs") - 1, F.lit(0)))))
    )
    drawn = planned.withColumn("draw", _draw(F.col("epoch"))).withColumn("block", F.floor(F.col("draw") * F.col("blocks")))
    key = ["source", "epoch", "block"]
    earlier = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.groupBy(*key).agg(F.sum("tokens").alias("block_tokens")).select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy(*key).orderBy("draw", "doc_id", "base", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    return joined.withColumn("start", F.col("block_start") + F.col("before")).where(
        (F.col("epoch") < F.col("epochs")) | (F.col("start") < F.col("part")) | (F.col("budget") == 0)
    )


def mix(docs: DataFrame, tokens: Column | None = None, target_entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT, budget: float | None = None) -> DataFrame:
    """doc_id, source, tokens, weight, epoch, block, position.

    position, in [0, 1), is how far the row's start is into its source's budget:
    reading all rows by position interleaves the sources in their weights.
    """
    counted = durable(_counted(docs, tokens))
    plan = durable(mix_plan(counted, target_entropy, repeat_limit, budget))
    position = F.when(F.col("budget") > 0, (F.col("epoch") * F.col("source_tokens") + F.col("start")) / F.col("budget")).otherwise(0.0)
    return laid_out(counted, plan.withColumn("source_tokens", F.col("tokens"))).select(
        "doc_id", "source", "tokens", "weight", F.col("epoch").cast("int").alias("epoch"), F.col("block").cast("long").alias("block"), position.alias("position")
    )


def mixed_documents(docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """The documents themselves, a row for each time they are in the mix, columns
    unchanged. The last epoch of a source is all draws up to one bound, so the texts
    are read once and not shuffled."""
    counted = durable(_counted(docs, None))
    plan = durable(mix_plan(counted, target_entropy, repeat_limit, budget))
    # One row per source, from the draws of the last epoch.
    bounds = laid_out(counted, plan).where("epoch = epochs").groupBy("source").agg(F.max("draw").alias("bound"))
    joined = plan.join(bounds.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "epochs", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
    planned = durable(joined.withColumnRenamed("source", "planned"))
    last = (_draw(F.col("epochs")) <= F.col("bound")).cast("int")
    based = _sources_equal(whole(docs, F.col("source").cast("string").alias("source"), _base(docs).alias("base"), F.lit(0).cast("long").alias("nth")), planned, "planned")
    # Rows that are equal in all columns: one of them stands for the copies of all.
    several = counted.where("times > 1")
    totals = durable(_sources_equal(several, planned, "planned").groupBy("base").agg(F.sum(F.col("epochs") + last).alias("total")))
    if totals.isEmpty():
        return based.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("epochs") + last))).select("doc.*")
    marked = join_small(based, totals, ["base"], "left", MARKED_ROWS)
    single = marked.where("total IS NULL").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("epochs") + last))).select("doc")
    shared = marked.where("total > 0").groupBy("base").agg(F.first("doc").alias("doc"), F.max("total").alias("total"))
    return single.unionByName(numbered(shared, "total").select("doc")).select("doc.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
