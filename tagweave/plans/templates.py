"""Parameterised reports: names, typed parameters with defaults, and a runner.

A template is a function of tables and parameters that returns a DataFrame. Parameters
arrive as text or values; they are checked and converted before anything is planned.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators import reports, search, series


class TemplateError(ValueError):
    pass


def _boolean(text: Any) -> bool:
    if str(text).lower() in ("true", "yes", "1"):
        return True
    if str(text).lower() in ("false", "no", "0"):
        return False
    raise ValueError(text)


_CONVERT: dict[str, Callable[[Any], Any]] = {
    "string": str, "number": float, "integer": int, "boolean": _boolean,
    "date": lambda x: x if isinstance(x, date) else date.fromisoformat(str(x)),
    "datetime": lambda x: x if isinstance(x, datetime) else datetime.fromisoformat(str(x)),
    "list": lambda x: list(x) if isinstance(x, (list, tuple)) else [p.strip() for p in str(x).split(",") if p.strip()],
}


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str = "string"
    required: bool = False
    default: Any = None
    choices: tuple = ()

    def value(self, given: Mapping[str, Any]) -> Any:
        raw = given.get(self.name)
        if raw is None or raw == "":
            if self.required:
                raise TemplateError(f"{self.name} is required")
            return self.default
        try:
            out = _CONVERT[self.kind](raw)
        except (TypeError, ValueError) as e:
            raise TemplateError(f"{self.name}: {raw!r} is no {self.kind}") from e
        if self.choices and out not in self.choices:
            raise TemplateError(f"{self.name} must be one of {', '.join(map(str, self.choices))}")
        return out


@dataclass(frozen=True)
class Template:
    name: str
    category: str
    title: str
    keywords: tuple[str, ...]
    tables: tuple[str, ...]
    parameters: tuple[Parameter, ...]
    plan: Callable[..., DataFrame]

    def run(self, tables: Mapping[str, DataFrame], given: Mapping[str, Any]) -> DataFrame:
        unknown = set(given) - {p.name for p in self.parameters}
        if unknown:
            raise TemplateError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        missing = set(self.tables) - set(tables)
        if missing:
            raise TemplateError(f"{self.name} needs the table {', '.join(sorted(missing))}")
        return self.plan(*(tables[t] for t in self.tables), **{p.name: p.value(given) for p in self.parameters})


TEMPLATES: dict[str, Template] = {}


def template(name: str, category: str, title: str, keywords: str, tables: str, *parameters: Parameter) -> Callable:
    def add(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TEMPLATES[name] = Template(name, category, title, tuple(keywords.split()), tuple(tables.split()), parameters, plan)
        return plan

    return add


_P = Parameter


@template("point-history", "data", "Point history with a rollup", "history trend export rollup", "history", _P("start", required=True), _P("end", required=True), _P("interval", default="1 hour"), _P("fold", default="avg", choices=("avg", "min", "max", "sum", "count")))
def point_history(history: DataFrame, start: str, end: str, interval: str, fold: str) -> DataFrame:
    return series.rollup(series.span(history, start, end), ["point"], "v0", interval, [fold])


@template("load-profile", "energy", "Load profile by hour or weekday", "load profile hour weekday weekend", "history", _P("by", default="hour", choices=("hour", "weekday", "weekend")))
def load_profile(history: DataFrame, by: str) -> DataFrame:
    keys = {"hour": F.hour("ts"), "weekday": series.monday_weekday(F.col("ts")), "weekend": series.monday_weekday(F.col("ts")) >= 5}
    return series.profile(history, keys[by], by, "v0")


@template("demand-peak", "energy", "Peak demand and when it was", "peak demand maximum", "history")
def demand_peak(history: DataFrame) -> DataFrame:
    return series.peak(history, ["point"], "v0")


@template("energy-spike", "fault", "Deviations above a weekday and hour baseline", "spike anomaly baseline deviation", "history", _P("split", required=True), _P("percent", "number", default=50.0), _P("gapHours", "number", default=2.0))
def energy_spike(history: DataFrame, split: str, percent: float, gapHours: float) -> DataFrame:  # noqa: N803
    over = series.baseline_deviation(history, split, "v0").where(F.col("deviation") > percent)
    return series.sessions(over, ["point"], gapHours * 3600, "v0")


@template("comm-loss", "fault", "Gaps and coverage of points", "gap communication loss offline coverage", "history", _P("start", required=True), _P("end", required=True), _P("expectedMinutes", "number", default=15.0))
def comm_loss(history: DataFrame, start: str, end: str, expectedMinutes: float) -> DataFrame:  # noqa: N803
    found = series.gaps(series.span(history, start, end), ["point"])
    share = series.coverage(history, ["point"], start, end, expectedMinutes)
    status = reports.ladder([(F.col("coverage") < 50, "critical"), (F.col("coverage") < 90, "warning")], "ok")
    return found.join(share, "point").withColumn("status", status)


@template("sensor-failure", "fault", "Stuck, noisy and flat sensors", "sensor stuck outlier flat", "history", _P("stuck", "integer", default=4), _P("outlierPercent", "number", default=5.0))
def sensor_failure(history: DataFrame, stuck: int, outlierPercent: float) -> DataFrame:  # noqa: N803
    return reports.sensor_health(history, ["point"], "v0", "v0", ["ts"], stuck, outlierPercent)


@template("zone-comfort", "hvac", "Comfort compliance in a band", "comfort temperature zone setpoint", "history", _P("low", "number", default=68.0), _P("high", "number", default=76.0))
def zone_comfort(history: DataFrame, low: float, high: float) -> DataFrame:
    return reports.comfort(history, ["point"], "v0", low, high)


@template("equipment-cycling", "hvac", "Runs shorter than a minimum", "cycle short runtime equipment", "history", _P("minMinutes", "number", default=5.0))
def equipment_cycling(history: DataFrame, minMinutes: float) -> DataFrame:  # noqa: N803
    runs = series.periods(history, ["point"], F.col("v0") > 0)
    return runs.groupBy("point").agg(F.count("*").alias("runs"), F.count_if(F.col("duration_s") < 60 * minMinutes).alias("short_runs"), F.round(F.avg("duration_s") / 60, 4).alias("avg_minutes"))


@template("door-open", "rule", "Periods that a condition lasts", "rule door open period", "history", _P("atLeastMinutes", "number", default=10.0))
def door_open(history: DataFrame, atLeastMinutes: float) -> DataFrame:  # noqa: N803
    return series.lasting(series.periods(history, ["point"], F.col("v0") > 0), 60 * atLeastMinutes)


@template("equipment-inventory", "data", "Points of each role by equip", "equipment inventory points count", "equip point", _P("roles", "list", default=("sensor", "cmd", "sp")))
def equipment_inventory(equip: DataFrame, point: DataFrame, roles: list[str]) -> DataFrame:
    return reports.inventory(equip, point, "equipRef", "role", list(roles))


def run(name: str, tables: Mapping[str, DataFrame], **given: Any) -> DataFrame:
    if name not in TEMPLATES:
        raise TemplateError(f"no template {name!r}")
    return TEMPLATES[name].run(tables, given)


def intent_score(t: Template, intent: str) -> int:
    """Name 10, category 5, words of the title 2, keywords 3, tables 4, actions 5 a word."""
    said = intent.lower()
    about = f"{t.name} {t.title}".lower()
    score = 10 * (t.name in said) + 5 * (t.category in said)
    score += sum(2 for w in t.title.lower().split() if len(w) > 3 and w in said)
    score += sum(3 for w in t.keywords if w in said) + sum(4 for w in t.tables if w in said)
    return score + sum(5 for action, words in search.ACTIONS.items() if action in about for w in words if w in said)


def find(intent: str, n: int = 5) -> list[tuple[str, float]]:
    """The templates that fit an intent best."""
    scored = [(t.name, float(intent_score(t, intent))) for t in TEMPLATES.values()]
    return sorted((x for x in scored if x[1]), key=lambda x: (-x[1], x[0]))[:n]


#: What a stored template must have.
FIELDS = ("id", "name", "category", "template")
STORED = "id string, name string, category string, description string, template string, tags array<string>, parameters array<struct<name: string, type: string, description: string, required: boolean>>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored templates, from JSON files below a folder, one document a file; (path, ...)."""
    files = spark.read.schema(STORED).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_path").alias("path"), "*")


def problems(stored: DataFrame) -> DataFrame:
    """(id, problem) of stored templates: missing fields, parameters without a name, type or
    description, placeholders without a parameter, required parameters without a placeholder."""
    used = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{\{([^}]+)\}\}"), F.lit(1)))
    names = F.transform("parameters", lambda p: p["name"])
    asked = F.transform(F.filter("parameters", lambda p: F.coalesce(p["required"], F.lit(True))), lambda p: p["name"])
    none = F.array().cast("array<string>")

    def say(prefix: str, items: Column) -> Column:
        return F.transform(F.coalesce(items, none), lambda x: F.concat(F.lit(prefix), x))

    missing = F.filter(F.array(*(F.when(F.coalesce(F.col(f), F.lit("")) == "", f) for f in FIELDS), F.when(F.col("parameters").isNull(), "parameters")), lambda x: x.isNotNull())
    unnamed = F.when(F.exists("parameters", lambda p: F.coalesce(p["name"], F.lit("")) == ""), F.array(F.lit("name")))
    bare = F.transform(F.filter("parameters", lambda p: (F.coalesce(p["type"], F.lit("")) == "") | (F.coalesce(p["description"], F.lit("")) == "")), lambda p: F.coalesce(p["name"], F.lit("?")))
    found = F.concat(
        say("missing ", missing), say("a parameter has no ", unnamed), say("no type or description: ", bare),
        say("no parameter for ", F.array_except(used, F.coalesce(names, none))), say("not used: ", F.array_except(F.coalesce(asked, none), used)),
    )
    return stored.select("id", F.explode(found).alias("problem"))


__all__ = ["TEMPLATES", "Parameter", "Template", "TemplateError", "find", "load", "problems", "run"]
