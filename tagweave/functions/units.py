"""Units: a small dimension table, conversion and unit algebra.

Units belong to columns (field metadata `unit`), so algebra happens while a plan is
built; only `convert_rows` reads a unit per row, through a broadcast of this table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnitError(ValueError):
    pass


#: Exponents of kilogram, metre, second, kelvin, ampere, mole, candela.
Dimension = tuple[int, int, int, int, int, int, int]
NONE: Dimension = (0, 0, 0, 0, 0, 0, 0)


@dataclass(frozen=True)
class Unit:
    """value in SI = value * scale + offset"""

    id: str
    quantity: str
    dimension: Dimension
    scale: float
    offset: float = 0.0


def _unit(id_: str, quantity: str, kg: int = 0, m: int = 0, s: int = 0, k: int = 0, scale: float = 1.0, offset: float = 0.0) -> Unit:
    return Unit(id_, quantity, (kg, m, s, k, 0, 0, 0), scale, offset)


UNITS: dict[str, Unit] = {
    u.id: u
    for u in (
        _unit("ns", "time", s=1, scale=1e-9), _unit("µs", "time", s=1, scale=1e-6), _unit("ms", "time", s=1, scale=1e-3),
        _unit("s", "time", s=1), _unit("min", "time", s=1, scale=60), _unit("h", "time", s=1, scale=3600),
        _unit("day", "time", s=1, scale=86400), _unit("wk", "time", s=1, scale=604800),
        _unit("mo", "time", s=1, scale=2592000), _unit("yr", "time", s=1, scale=31536000),
        _unit("m", "length", m=1), _unit("km", "length", m=1, scale=1000), _unit("cm", "length", m=1, scale=0.01),
        _unit("ft", "length", m=1, scale=0.3048), _unit("in", "length", m=1, scale=0.0254),
        _unit("m²", "area", m=2), _unit("ft²", "area", m=2, scale=0.09290304),
        _unit("m³", "volume", m=3), _unit("L", "volume", m=3, scale=0.001), _unit("gal", "volume", m=3, scale=0.003785411784),
        _unit("kg", "mass", kg=1), _unit("g", "mass", kg=1, scale=0.001), _unit("lb", "mass", kg=1, scale=0.45359237),
        _unit("ton", "mass", kg=1, scale=907.18474), _unit("mton", "mass", kg=1, scale=1000),
        _unit("K", "temperature", k=1), _unit("°C", "temperature", k=1, offset=273.15),
        _unit("°F", "temperature", k=1, scale=5 / 9, offset=459.67 * 5 / 9),
        _unit("J", "energy", kg=1, m=2, s=-2), _unit("kJ", "energy", kg=1, m=2, s=-2, scale=1e3),
        _unit("Wh", "energy", kg=1, m=2, s=-2, scale=3600), _unit("kWh", "energy", kg=1, m=2, s=-2, scale=3.6e6),
        _unit("MWh", "energy", kg=1, m=2, s=-2, scale=3.6e9), _unit("BTU", "energy", kg=1, m=2, s=-2, scale=1055.05585262),
        _unit("W", "power", kg=1, m=2, s=-3), _unit("kW", "power", kg=1, m=2, s=-3, scale=1e3),
        _unit("MW", "power", kg=1, m=2, s=-3, scale=1e6), _unit("tonrefr", "power", kg=1, m=2, s=-3, scale=3516.8528420667),
        _unit("Pa", "pressure", kg=1, m=-1, s=-2), _unit("kPa", "pressure", kg=1, m=-1, s=-2, scale=1e3),
        _unit("psi", "pressure", kg=1, m=-1, s=-2, scale=6894.757293168),
        _unit("m/s", "velocity", m=1, s=-1), _unit("m³/s", "volumetric flow", m=3, s=-1),
        _unit("L/s", "volumetric flow", m=3, s=-1, scale=0.001), _unit("cfm", "volumetric flow", m=3, s=-1, scale=0.0004719474432),
        _unit("Hz", "frequency", s=-1),
        _unit("%", "dimensionless", scale=0.01), _unit("byte", "bytes"), _unit("kB", "bytes", scale=1024),
        _unit("MB", "bytes", scale=1048576), _unit("GB", "bytes", scale=1073741824),
    )
}


def unit(id_: str) -> Unit:
    if id_ not in UNITS:
        raise UnitError(f"unknown unit {id_!r}")
    return UNITS[id_]


def same_quantity(a: str, b: str) -> bool:
    x, y = unit(a), unit(b)
    return x.dimension == y.dimension and (x.quantity == "bytes") == (y.quantity == "bytes")


def is_duration(id_: str) -> bool:
    return id_ in UNITS and UNITS[id_].quantity == "time"


def convert(value, from_: str, to: str):  # noqa: ANN001, ANN201
    """A number or a Column from one unit to another of its dimension."""
    a, b = unit(from_), unit(to)
    if not same_quantity(from_, to):
        raise UnitError(f"{from_} is no {b.quantity}")
    return (value * a.scale + a.offset - b.offset) / b.scale


def sum_unit(a: str, b: str) -> str:
    """Sums need equal units, or one side without."""
    if a and b and a != b:
        raise UnitError(f"{a} and {b} don't add")
    return a or b


def close(a: float, b: float, tolerance: float = 0.001) -> bool:
    return abs(a - b) <= tolerance * max(abs(a), abs(b))


def product_unit(a: str, b: str, divide: bool = False) -> str:
    """The unit of a product or quotient, by dimension and scale."""
    if not a and not b:
        return ""
    if not b:
        return a
    x = unit(a) if a else Unit("", "", NONE, 1.0)
    y = unit(b)
    sign = -1 if divide else 1
    dimension = tuple(i + sign * j for i, j in zip(x.dimension, y.dimension, strict=True))
    scale = x.scale / y.scale if divide else x.scale * y.scale
    if dimension == NONE and close(scale, 1.0):
        return ""
    fits = [u.id for u in UNITS.values() if u.dimension == dimension and close(u.scale, scale) and not u.offset]
    if len(fits) != 1:
        raise UnitError(f"{a or 1} {'/' if divide else '*'} {b} has no single unit: {fits}")
    return fits[0]


def unit_of(df: DataFrame, column: str) -> str:
    return (df.schema[column].metadata or {}).get("unit", "")


def with_unit(column: Column, name: str, id_: str) -> Column:
    return column.alias(name, metadata={"unit": id_})


def arithmetic(df: DataFrame, left: str, op: str, right: str, name: str) -> DataFrame:
    """Adds `name` = left op right with its unit; op is one of + - * /."""
    a, b = unit_of(df, left), unit_of(df, right)
    if op in "+-":
        id_ = sum_unit(a, b)
        value = F.col(left) + F.col(right) if op == "+" else F.col(left) - F.col(right)
    else:
        id_ = product_unit(a, b, divide=op == "/")
        value = F.col(left) * F.col(right) if op == "*" else F.try_divide(F.col(left).cast("double"), F.col(right))
    return df.select("*", with_unit(value, name, id_))


def convert_rows(df: DataFrame, value: str, from_unit: str, to: str, name: str) -> DataFrame:
    """Adds `name`, each row converted from its own unit; null where that can't be."""
    goal = unit(to)
    rows = [(u.id, float(u.scale), float(u.offset)) for u in UNITS.values() if same_quantity(u.id, to)]
    # A fixed table of a few dozen units.
    known = F.broadcast(df.sparkSession.createDataFrame(rows, "__unit string, __scale double, __offset double"))
    joined = df.join(known, F.col(from_unit) == F.col("__unit"), "left")
    out = (F.col(value) * F.col("__scale") + F.col("__offset") - goal.offset) / goal.scale
    return joined.select(*df.columns, with_unit(out, name, to))


def by_quantity(quantity: str) -> list[Unit]:
    """The units of a quantity, smallest first."""
    return sorted((u for u in UNITS.values() if u.quantity == quantity), key=lambda u: u.scale)
