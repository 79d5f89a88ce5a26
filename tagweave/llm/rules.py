"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Base statistics come from whole texts with built-in functions. Rows that pass the
base rules are judged by a minimum-covariance-determinant estimate of their language
and source: a location and scatter of transformed statistics that the best `CORE` of
the group's rows agree on, found from two starts (the centre and spread of medians,
and the plain moments) by concentration steps; the start with the smaller determinant
wins. Rows further from it than `CUT` by Mahalanobis distance are rejected.

Steps go on until no determinant falls any more. Each is two aggregations over a
checkpointed table of statistics: a histogram of squared distances per group gives the
radius that holds the core, then sums of products inside it give the new moments. Both
combine before they shuffle, so a source with a third of all rows is as cheap as any
other, and parameters stay in a table: they are broadcast only where the number of
groups is counted and small.

Every group has its own estimate, whatever its size. Its core is joined by `PRIOR_ROWS`
rows' worth of its language's core, and a language's by as many of the core of all rows,
so small groups lean on the larger ones they lie in, without a size from which they do.

Defined cases: a null text has no words and fails the base rules; null languages and
sources are groups of their own; equal rows get equal verdicts; very long texts are
measured whole; a table of at most `UNDEFINED` rows that pass the base rules has no
scatter and judges nobody, those rows stay; an empty table gives no rows; statistics that
are constant in a group get the spread in FLOOR; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.partitions import spread
from tagweave.llm.common import SEPARATOR, durable, table, text_of

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
CORE = 0.75
#: A fall of the logarithm of a determinant (of the factor) that counts as none.
STILL = 1e-3
#: Rows of the core of the next larger group that join a group's own core.
PRIOR_ROWS = 30
#: Squared distance beyond which a row is rejected: far above the 0.9999 quantile of
#: chi-square with 4 degrees of freedom (23.5), as clean statistics have heavy tails.
CUT = 60.0
#: Median of chi-square with 4 degrees of freedom, to which the core's distances are scaled.
CHI2_MEDIAN = 3.357
#: Bins of a distance histogram, even in the logarithm; and their width.
BINS, BIN_WIDTH = 4000, 0.01
#: Most groups whose parameters (some 20 numbers each) are broadcast.
MOST_BROADCAST = 10_000
SYMBOLS = "[#*$%&|<>]"

#: The transformed statistics and the least spread each is given.
FLOOR = {"x0": 0.3, "x1": 0.05, "x2": 0.03, "x3": 0.08}
NAMES = list(FLOOR)
D = len(NAMES)
UNDEFINED = 2 * D


def base_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    step = spread(docs.select(*keep, text_of(text).alias("__text"))).withColumn("__parts", F.split("__text", SEPARATOR))
    # One cut at every separator gives the words and, by the number of parts, the separators.
    separators = F.size("__parts") - 1
    step = step.select(*keep, "__text", F.array_remove("__parts", "").alias("__words"), (F.length("__text") - separators).cast("long").alias("word_chars"))
    step = step.withColumn("n_words", F.size("__words").cast("long"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
        lambda i: F.xxhash64(*(F.get("__words", i + k) for k in range(WINDOW))),
    )
    step = step.withColumn("__windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("__lines", lines)
    measured = step.select(
        *keep,
        "n_words",
        "word_chars",
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "__windows",
    )
    # Only texts with an equal pair of windows are sorted: hash and place, so that equal ones are neighbours.
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(some, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = measured.withColumn("__placed", placed).drop("__windows")

    def same(k: Column) -> Column:
        return F.get("__placed", k)["h"]

    found = F.filter("__placed", lambda x, k: (x["h"] == F.coalesce(F.when(k > 0, same(k - 1)), x["h"] + F.lit(None))) | (x["h"] == same(k + 1)))
    starts = twice.withColumn("__starts", F.array_sort(F.transform(found, lambda x: x["i"]))).drop("__placed")
    # Each window covers its words up to where the next one starts.
    covered = F.aggregate(
        F.transform("__starts", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x,
    )
    counted = starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__starts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _transformed() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt((F.col("n_dup_lines") + F.col("n_repeat_words")) / words),
    )
    return dict(zip(NAMES, values, strict=True))


def _tag(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), column), F.lit("-"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds grp, language and source."""
    return rows.select("*", F.concat_ws("\x1f", _tag("lang"), _tag("source")).alias("grp"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2 from the location m* and the Cholesky factor l** of the scatter."""
    names = rows.columns
    steps = []  # each uses the ones before it, which one select resolves
    for i, x in enumerate(NAMES):
        known = "".join(f" - l{i}{j} * z{j}" for j in range(i))
        steps.append(f"({x} - m{i}{known}) / l{i}{i} AS z{i}")
    total = " + ".join(f"z{i} * z{i}" for i in range(D))
    return rows.selectExpr("*", *steps, f"{total} AS d2").select(*names, "d2")


def _factored(params: DataFrame) -> DataFrame:
    """From means m*, and second moments s** of at least FLOOR, the Cholesky factor and
    the logarithm of its determinant."""
    steps = []
    for i in range(D):
        for j in range(i + 1):
            value = f"s{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            # What earlier statistics explain leaves at least a part of the floor.
            steps.append(f"sqrt(greatest({value}, {(0.5 * FLOOR[NAMES[i]]) ** 2!r}D)) AS l{i}{i}" if i == j else f"({value}) / l{j}{j} AS l{i}{j}")
    kept = [c for c in params.columns if not (c[0] == "s" and c[1:].isdigit())]
    factor = [f"l{i}{j}" for i in range(D) for j in range(i + 1)]
    total = " + ".join(f"ln(l{i}{i})" for i in range(D))
    return params.selectExpr("*", *steps, f"{total} AS logdet").select(*kept, *factor, "logdet")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means m*, second moments s** without a floor, and n, of rows by keys."""
    sums = [F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(NAMES))]
    sums += [F.covar_pop(NAMES[i], NAMES[j]).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*sums)


def _floored(params: DataFrame) -> DataFrame:
    return params.withColumns({f"s{i}{i}": F.col(f"s{i}{i}") + F.lit(FLOOR[x] ** 2) for i, x in enumerate(NAMES)})


def _pooled(params: DataFrame, keys: list[str]) -> DataFrame:
    """The moments of the groups of params together, by keys."""
    n = F.sum("n")
    means = params.groupBy(*keys).agg(
        n.alias("n"),
        *((F.sum(F.col("n") * F.col(f"m{i}")) / n).alias(f"m{i}") for i in range(D)),
        *((F.sum(F.col("n") * (F.col(f"s{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}"))) / n).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)),
        (F.sum(F.col("n") * F.log("scale")) / n).alias("log_scale"),
    )
    return means.select(
        *keys, "n", *(f"m{i}" for i in range(D)),
        *((F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)),
        F.exp("log_scale").alias("scale"),
    )


def _leaning(own: DataFrame, larger: DataFrame, on: list[str]) -> DataFrame:
    """own, each group's core joined by PRIOR_ROWS rows' worth of the larger group's."""
    names = [f"m{i}" for i in range(D)] + [f"s{i}{j}" for i in range(D) for j in range(i + 1)] + ["scale"]
    wide = larger.select(*on, *(F.col(x).alias(f"w_{x}") for x in names))
    both = own.join(wide, on)
    w = F.lit(float(PRIOR_ROWS)) / (F.col("n") + PRIOR_ROWS)

    def mean(x: str) -> Column:
        return (1 - w) * F.col(x) + w * F.col(f"w_{x}")

    def second(i: int, j: int) -> Column:
        apart = (F.col(f"m{i}") - F.col(f"w_m{i}")) * (F.col(f"m{j}") - F.col(f"w_m{j}"))
        return mean(f"s{i}{j}") + w * (1 - w) * apart

    kept = [c for c in own.columns if c not in names]
    return both.select(
        *kept, *(mean(f"m{i}").alias(f"m{i}") for i in range(D)),
        *(second(i, j).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)),
        F.exp((1 - w) * F.log("scale") + w * F.log("w_scale")).alias("scale"),
    )


def _bin() -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.log(F.col("d2") + F.lit(1e-9)) + 20) / BIN_WIDTH))).cast("int")


def _radius(rows: DataFrame, share: float) -> DataFrame:
    """Per group and start, the least bin that with those below holds `share` of the rows."""
    from pyspark.sql import Window

    bins = rows.groupBy("grp", "start", _bin().alias("bin")).count()
    order = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("grp", "start")
    held = bins.select("grp", "start", "bin", F.sum("count").over(order).alias("held"), F.sum("count").over(total).alias("n"))
    return held.where(F.col("held") >= F.col("n") * F.lit(share)).groupBy("grp", "start").agg(F.min("bin").alias("radius"))


def _factors(params: DataFrame, keys: list[str]) -> DataFrame:
    return _factored(_floored(params)).select(*keys, "logdet", *(f"m{i}" for i in range(D)), *(f"l{i}{j}" for i in range(D) for j in range(i + 1)))


def core_moments(rows: DataFrame, few: bool = True) -> DataFrame:
    """grp, n, m*, s** and logdet of each group's core: the best `CORE` of its rows that
    concentration finds from two starts. few: the groups were counted and their
    parameters may be broadcast; else they are joined by shuffles."""

    def with_groups(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(F.broadcast(right) if few else right, on)

    # Start 0: medians and their absolute deviations. Start 1: the plain moments.
    medians = rows.groupBy("grp").agg(F.count("*").alias("n"), *(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in NAMES))
    middle = medians.select(
        "grp", "n", *(F.col(x)[1].alias(f"m{i}") for i, x in enumerate(NAMES)),
        *(
            (F.pow((F.col(NAMES[i])[2] - F.col(NAMES[i])[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}")
            for i in range(D) for j in range(i + 1)
        ),
        F.lit(0).alias("start"),
    )
    starts = middle.unionByName(_moments(rows, ["grp"]).withColumn("start", F.lit(1)))
    keys = ["grp", "start"]
    # A start's own moments are of no core: any core found from it replaces them.
    params = durable(starts.withColumn("logdet", F.lit(float("inf"))))
    while True:
        measured = _distance(with_groups(rows, _factors(params.drop("logdet"), keys).drop("logdet"), ["grp"]))
        inside = with_groups(measured, _radius(measured, CORE), keys).where(_bin() <= F.col("radius"))
        found = _moments(inside.select(*keys, *NAMES), keys)
        found = found.join(_factors(found, keys).select(*keys, "logdet"), keys)
        old = params.select(*keys, *(F.col(c).alias(f"old_{c}") for c in params.columns if c not in keys))
        both = found.join(old, keys)
        falls = F.col("logdet") < F.col("old_logdet") - STILL
        stepped = both.select(*keys, falls.alias("falls"), *(F.when(falls, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in params.columns if c not in keys))
        stepped = durable(stepped)
        params = stepped.drop("falls")
        if stepped.where("falls").isEmpty():
            break
    best = params.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return params.join(best, keys).drop("start")


def robust_estimates(rows: DataFrame, few: bool = True) -> DataFrame:
    """One row per group: location m*, factor l**, and `scale`, which brings the median
    squared distance to that of the normal model. Small groups lean on larger ones."""
    cores = durable(core_moments(rows, few).drop("logdet").withColumn("tongue", F.element_at(F.split("grp", "\x1f"), 1)))
    factors = _factors(cores, ["grp"]).withColumn("start", F.lit(0))
    half = _radius(_distance(rows.join(F.broadcast(factors) if few else factors, "grp")), 0.5)
    middle = F.exp((F.col("radius") + 1) * BIN_WIDTH - 20)
    own = durable(cores.join(half.drop("start"), "grp").withColumn("scale", F.greatest(middle / CHI2_MEDIAN, F.lit(1.0))).drop("radius"))
    own = own.withColumn("every", F.lit(0))
    tongues = _leaning(_pooled(own, ["tongue", "every"]), _pooled(own, ["every"]), ["every"]).drop("every")
    leaning = _leaning(own, tongues, ["tongue"])
    return _factored(_floored(leaning)).drop("logdet", "n", "tongue", "every")


def apply_rules(docs: DataFrame, text: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, distance (squared,
    scaled; null where no estimate judges the row) and kept."""
    measured = base_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text).alias("text")))
    measured = durable(_grouped(measured.withColumns(_transformed())).drop("lang", "source"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passing = measured.where("NOT base_failed")
    sizes = passing.groupBy("grp").count()
    groups, n = sizes.agg(F.count("*"), F.sum("count")).first()
    if (n or 0) <= UNDEFINED:
        return measured.select(*columns, F.lit(None).cast("double").alias("distance"), (~F.col("base_failed")).alias("kept"))
    few = groups <= MOST_BROADCAST
    estimates = durable(robust_estimates(passing.select("grp", *NAMES), few))
    judged = _distance(passing.join(F.broadcast(estimates) if few else estimates, "grp")).withColumn("distance", F.col("d2") / F.col("scale"))
    passed = judged.select(*columns, "distance", (F.col("distance") <= cut).alias("kept"))
    failed = measured.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return passed.unionByName(failed)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
