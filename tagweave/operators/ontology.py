"""Ontology reasoning over a table of defs.

A def has a name, a list of supertypes `is`, and tags such as tagOn, children or the
relationships it carries. There are hundreds of defs, so they are normalised on the
driver and published as small closure tables; records, of which there may be any
number, are only ever joined with those tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.filters import Model, Symbol


class OntologyError(ValueError):
    pass


@dataclass(frozen=True)
class Def:
    name: str
    supers: tuple[str, ...] = ()
    tag_on: tuple[str, ...] = ()
    mandatory: bool = False
    of: str = ""
    relations: tuple[tuple[str, str], ...] = ()  # (relation, term)
    transitive: bool = False
    reciprocal: str = ""
    children: tuple[str, ...] = ()
    lib: str = ""

    @property
    def parts(self) -> tuple[str, ...]:
        """The tags of a conjunct such as hot-water; of a plain name itself."""
        return tuple(self.name.split("-")) if ":" not in self.name else (self.name,)

    @property
    def feature(self) -> str:
        return self.name.partition(":")[0] if ":" in self.name else ""


def _names(value: object) -> tuple[str, ...]:
    if not value:
        return ()
    values = value if isinstance(value, (list, tuple)) else [value]
    return tuple(v.name if isinstance(v, Symbol) else str(v).lstrip("^") for v in values)


def read_defs(records: Iterable[dict]) -> list[Def]:
    """Defs from parsed records; unknown tags are kept out."""
    out = []
    for r in records:
        if "def" not in r:
            continue
        relations = tuple((k, t) for k in r if k in ("inputs", "outputs", "contains", "containedBy", "equips") for t in _names(r[k]))
        out.append(
            Def(
                _names(r["def"])[0], _names(r.get("is")), _names(r.get("tagOn")), bool(r.get("mandatory")),
                "".join(_names(r.get("of"))[:1]), relations, bool(r.get("transitive")), "".join(_names(r.get("reciprocalOf"))[:1]),
                _names(r.get("children")), "".join(_names(r.get("lib"))[:1]),
            )
        )
    return out


@dataclass
class Namespace:
    defs: dict[str, Def] = field(default_factory=dict)
    ancestors: dict[str, set[str]] = field(default_factory=dict)
    descendants: dict[str, set[str]] = field(default_factory=dict)
    #: All tags of every def, where it was built from whole records.
    records: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def build(cls, defs: Iterable[Def]) -> Namespace:
        """Resolve names, inherit, find cycles; conjuncts without `is` extend their last part."""
        space = cls()
        for d in defs:
            if d.name in space.defs:
                raise OntologyError(f"{d.name} is defined twice")
            space.defs[d.name] = d
        for d in space.defs.values():
            for s in d.supers:
                if s not in space.defs:
                    raise OntologyError(f"{d.name} extends {s}, which isn't defined")
        for name in space.defs:
            space._climb(name, ())
        for name, above in space.ancestors.items():
            for a in above:
                space.descendants.setdefault(a, set()).add(name)
        return space

    def _climb(self, name: str, path: tuple[str, ...]) -> set[str]:
        if name in path:
            raise OntologyError(f"{name} extends itself")
        if name not in self.ancestors:
            d = self.defs[name]
            supers = d.supers or ((d.parts[-1],) if len(d.parts) > 1 and d.parts[-1] in self.defs else ())
            found = {name}
            for s in supers:
                found |= self._climb(s, (*path, name))
            self.ancestors[name] = found
        return self.ancestors[name]

    def by_name(self, name: str) -> Def:
        if name not in self.defs:
            raise OntologyError(f"no def {name!r}")
        return self.defs[name]

    def supers(self, name: str) -> set[str]:
        return set(self.by_name(name).supers)

    def all_supers(self, name: str) -> set[str]:
        self.by_name(name)
        return self.ancestors[name] - {name}

    def subs(self, name: str) -> set[str]:
        return {d.name for d in self.defs.values() if name in d.supers}

    def all_subs(self, name: str) -> set[str]:
        self.by_name(name)
        return self.descendants.get(name, set()) - {name}

    def fits(self, name: str, base: str) -> bool:
        return base in self.ancestors.get(name, set())

    def conjuncts(self) -> list[Def]:
        return [d for d in self.defs.values() if len(d.parts) > 1]

    def features(self) -> list[Def]:
        return [d for d in self.defs.values() if d.feature]

    def libs(self) -> list[Def]:
        return [d for d in self.defs.values() if d.feature == "lib"]

    def feature_names(self) -> list[str]:
        return sorted({d.feature for d in self.features()})

    def choices_for(self, name: str) -> set[str]:
        """What may stand for a choice: its direct subtypes; nothing may for other defs."""
        return self.subs(name) if "choice" in self.supers(name) else set()

    def choices(self) -> dict[str, set[str]]:
        return {d.name: self.choices_for(d.name) for d in self.defs.values() if "choice" in d.supers}

    def associations(self, parent: str, association: str) -> set[str]:
        """Defs that a def names under an association. One that is computed from its
        reciprocal, such as tags from tagOn, has the defs that name the parent or one of its
        supertypes there."""
        record = self.records.get(association, {})
        if "association" not in _names(record.get("is")):
            return set()
        computed = "computedFromReciprocal" if "computedFromReciprocal" in self.defs else "computed"
        if computed not in record:
            return {n for n in _names(self.records.get(parent, {}).get(association)) if n in self.defs}
        back = "".join(_names(record.get("reciprocalOf"))[:1])
        if back not in self.defs:
            return set()
        above = self.ancestors.get(parent, set())
        return {n for n, r in self.records.items() if above & set(_names(r.get(back)))}

    def timezones(self) -> list[str]:
        """The cities that the def of time zones lists, in its order."""
        return [x for x in str(self.records.get("tz", {}).get("enum", "")).split("\n") if x]

    def tags_of(self, name: str) -> set[str]:
        """Tags that apply to an entity, its supertypes' included."""
        above = self.ancestors.get(name, set())
        return {d.name for d in self.defs.values() if set(d.tag_on) & above}

    def kind_of(self, name: str) -> str:
        kinds = ("marker", "val", "number", "str", "bool", "ref", "date", "dateTime", "time", "uri", "list", "dict", "grid", "coord")
        above = self.ancestors.get(name, set())
        return next((k for k in kinds[2:] if k in above), "marker" if "marker" in above else "")

    def reflect(self, tags: Iterable[str]) -> set[str]:
        """Defs that a record with these tags has, conjuncts and supertypes included."""
        held = set(tags)
        named = {t for t in held if t in self.defs}
        named |= {d.name for d in self.conjuncts() if set(d.parts) <= held}
        return set().union(*(self.ancestors[n] for n in named)) if named else set()

    def implementation(self, name: str) -> list[str]:
        """Tags that a record needs to be of a type: its parts and its supertypes' mandatory markers."""
        out = list(self.by_name(name).parts)
        for s in sorted(self.all_supers(name)):
            if self.defs[s].mandatory:
                out += [p for p in self.defs[s].parts if p not in out]
        return out

    def protos(self, tags: Iterable[str]) -> list[str]:
        return sorted({c for name in self.reflect(tags) for c in self.defs[name].children})

    # --- tables ---

    def closure(self, spark: SparkSession) -> DataFrame:
        """(name, ancestor) with every def its own ancestor; a few thousand rows."""
        rows = [(n, a) for n, above in self.ancestors.items() for a in sorted(above)]
        return spark.createDataFrame(rows, "name string, ancestor string")

    def model(self, **refs: tuple[DataFrame, str]) -> Model:
        """For the filter language: subtypes behind ^symbol and relations behind `rel?`."""
        relations: dict[str, dict[str, set[str]]] = {}
        for d in self.defs.values():
            for relation, term in d.relations:
                for sub in self.descendants.get(d.name, {d.name}):
                    relations.setdefault(relation, {}).setdefault(sub, set()).update(self.ancestors.get(term, {term}))
        return Model(refs=refs, descendants=dict(self.descendants), relations=relations)

    def associations_table(self, spark: SparkSession, association: str) -> DataFrame:
        """(name, associated) for every def."""
        rows = [(n, x) for n in sorted(self.defs) for x in sorted(self.associations(n, association))]
        return spark.createDataFrame(rows, "name string, associated string")

    def reflect_records(self, records: DataFrame, key: str, tags: str) -> DataFrame:
        """(key, def) for a column that lists each record's tags."""
        spark = records.sparkSession
        # Both sides are bounded by the ontology: hundreds of conjuncts, thousands of closure rows.
        parts = spark.createDataFrame([(d.name, list(d.parts)) for d in self.defs.values()], "name string, parts array<string>")
        held = records.select(key, F.array_distinct(tags).alias("__tags"))
        first = parts.select("name", "parts", F.element_at("parts", 1).alias("__first"))
        each = held.select(key, "__tags", F.explode("__tags").alias("__first"))
        named = each.join(F.broadcast(first), "__first").where(F.size(F.array_except("parts", "__tags")) == 0).select(key, "name")
        return named.join(F.broadcast(self.closure(spark)), "name").select(key, F.col("ancestor").alias("def")).distinct()

    def validate_records(self, records: DataFrame, key: str, tags: str) -> DataFrame:
        """(key, def, missing): mandatory markers that a record's types ask for and it lacks."""
        found = self.reflect_records(records, key, tags)
        needs = [(t, p) for t in self.defs for d in (self.defs[x] for x in self.tags_of(t)) if d.mandatory for p in d.parts]
        rows = records.sparkSession.createDataFrame(needs, "def string, missing string")
        asked = found.join(F.broadcast(rows), "def")
        return asked.join(records.select(key, F.col(tags).alias("__tags")), key).where(~F.array_contains("__tags", F.col("missing"))).select(key, "def", "missing").distinct()


def related(records: DataFrame, key: str, ref: str, target: str, transitive: bool = True, most: int = 32) -> DataFrame:
    """(key): records whose ref leads to the target, over several hops if transitive."""
    from tagweave.functions.lineage import durable

    hops = durable(records.select(F.col(key).cast("string").alias("id"), F.col(ref).cast("string").alias("to")))
    found = hops.where(F.col("to") == target).select("id").distinct()
    frontier = found
    for _ in range(most if transitive else 0):
        frontier = durable(hops.join(frontier.select(F.col("id").alias("to")), "to").select("id").distinct().join(found, "id", "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def closure_of(edges: DataFrame, name: str, parent: str, most: int = 32) -> DataFrame:
    """(name, ancestor) pairs of any hierarchy table, each name its own ancestor."""
    from tagweave.functions.lineage import durable

    up = durable(edges.select(F.col(name).alias("name"), F.col(parent).alias("ancestor")).where("name <> ancestor").distinct())
    every = up.select("name").unionByName(up.select(F.col("ancestor").alias("name"))).distinct()
    out = every.select("name", F.col("name").alias("ancestor"))
    frontier = up
    for _ in range(most):
        out = out.unionByName(frontier)
        step = frontier.join(up.select(F.col("name").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("name", F.col("next").alias("ancestor")).distinct()
        frontier = durable(step.join(out, ["name", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
    return out


def divide(tags: DataFrame, key: str, tag: str, wanted: Sequence[str]) -> DataFrame:
    """Keys that have every wanted tag, from rows of (key, tag)."""
    held = tags.where(F.col(tag).isin(*wanted)).groupBy(key).agg(F.count_distinct(tag).alias("n"))
    return held.where(F.col("n") == len(set(wanted))).select(key)
