"""Text, operator, regex and vector search.

An inverted index is a table of (token, id); searches are joins and aggregates on it.
Scores are expressions; a ranked answer is a top-k, never a sort of everything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions import scalars
from tagweave.functions.partitions import spread


def token_index(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """(token, id) over one or more text columns."""
    joined = F.concat_ws(" ", *texts)
    return spread(df.select(key, *texts)).select(F.explode(scalars.tokens(joined)).alias("token"), F.col(key).alias("id")).distinct()


def save_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sorted by token in range partitions, so a search reads the few row groups that its
    terms may be in."""
    index.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode(mode).parquet(path)


def index_statistics(index: DataFrame) -> DataFrame:
    per = index.groupBy("token").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("tokens"), F.sum("n").alias("postings"), F.round(F.avg("n"), 4).alias("avg_postings"), F.max("n").alias("most"))


def search_all(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Ids that every term hits: by the exact token, or by tokens that start with it where
    no token is equal. One pass over the index and one shuffle by id."""
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    token = F.col("token")
    some = F.lit(False)
    for t in wanted:
        some = some | token.startswith(t)
    flags = [F.bool_or(token == t).alias(f"exact{k}") for k, t in enumerate(wanted)]
    flags += [F.bool_or(token.startswith(t)).alias(f"start{k}") for k, t in enumerate(wanted)]
    per = index.where(some).groupBy("id").agg(*flags)
    known = per.agg(*(F.coalesce(F.bool_or(f"exact{k}"), F.lit(False)).alias(f"known{k}") for k in range(len(wanted))))
    hit = F.lit(True)
    for k in range(len(wanted)):
        hit = hit & F.when(F.col(f"known{k}"), F.col(f"exact{k}")).otherwise(F.col(f"start{k}"))
    return per.join(F.broadcast(known)).where(hit).select("id")  # known is one row


def search_any(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Ids that a term hits, exactly or by prefix."""
    test = F.lit(False)
    for term in terms:
        test = test | F.col("token").startswith(term.lower())
    return index.where(test).select("id").distinct()


#: Weights of the fields of a function record (fixed values).
FIELD_WEIGHTS = {"name": 5.0, "params": 3.0, "tags": 2.5, "category": 2.0, "docs": 1.8, "description": 1.5, "project": 1.2, "source": 0.8}


def relevance(query: str, fields: dict[str, Column], from_project: Column | None = None, is_docs: Column | None = None) -> Column:
    """Fielded score: weights of the fields with a query word; a name that equals,
    starts with or contains the query adds 100, 50 or 25, each word in it 10."""
    words = [w for w in query.lower().split() if w]
    phrase = query.lower().strip()
    base = F.lit(0.0)
    for name, column in fields.items():
        low = F.lower(F.coalesce(column, F.lit("")))
        for word in words:
            base = base + F.when(F.contains(low, F.lit(word)), FIELD_WEIGHTS[name]).otherwise(0.0)
    name = F.lower(F.coalesce(fields["name"], F.lit("")))
    bonus = F.when(name == phrase, 100.0).when(name.startswith(phrase), 50.0).when(F.contains(name, F.lit(phrase)), 25.0).otherwise(0.0)
    for word in words:
        bonus = bonus + F.when(F.contains(name, F.lit(word)), 10.0).otherwise(0.0)
    score = F.when(base > 0, base + bonus).otherwise(0.0)
    if from_project is not None:
        score = score * F.when(from_project, 1.1).otherwise(1.0)
    if is_docs is not None:
        score = score * F.when(is_docs, 0.3).otherwise(1.0)
    return score


def doc_score(query: str, title: Column, body: Column, library: Column) -> Column:
    """Base 50, phrase 25, title 30, library 20, share of the words found up to 20; 100 at most;
    0 where no word is found."""
    phrase = query.lower()
    words = phrase.split()
    low, head, lib = F.lower(body), F.lower(title), F.lower(library)
    found = sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int"))
    score = (
        50 + F.when(F.contains(low, F.lit(phrase)), 25).otherwise(0) + F.when(F.contains(head, F.lit(phrase)), 30).otherwise(0)
        + F.when(F.contains(lib, F.lit(phrase)), 20).otherwise(0) + F.floor(20.0 * found / len(words))
    )
    return F.when(found > 0, F.least(score, F.lit(100))).otherwise(0).cast("int")


def highlight(text: Column, phrase: str, before: int = 50, after: int = 100, short: int = 150) -> Column:
    """The surroundings of the phrase, or the text's start."""
    at = F.locate(phrase.lower(), F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, text.substr(start, at + len(phrase) + after - start)).otherwise(F.substring(text, 1, short))


def rank_sections(sections: DataFrame, key: str, heading: str, text: str, query: str, n: int) -> DataFrame:
    """The best sections of each document: 10 for the phrase, 1 a word, 2 a heading word."""
    words = query.lower().split()
    body, head = F.lower(text), F.lower(heading)
    score = F.when(F.contains(body, F.lit(query.lower())), 10).otherwise(0)
    for w in words:
        score = score + F.contains(body, F.lit(w)).cast("int") + 2 * F.contains(head, F.lit(w)).cast("int")
    scored = sections.withColumn("score", score).where("score > 0")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= n)


def filter_results(df: DataFrame, category: str | None = None, tags: Sequence[str] = (), source: str | None = None, project: str | None = None, instance: str | None = None) -> DataFrame:
    if category:
        df = df.where(F.lower("category") == category.lower())
    for tag in tags:
        df = df.where(F.exists("tags", lambda t, tag=tag: F.contains(F.lower(t), F.lit(tag.lower()))) if df.schema["tags"].dataType.typeName() == "array" else F.contains(F.lower("tags"), F.lit(tag.lower())))
    if source:
        df = df.where(F.col("source") == source)
    if project:
        df = df.where(F.contains(F.lower("project"), F.lit(project.lower())))
    if instance:
        df = df.where(F.startswith("project", F.lit(instance)))
    return df


#: The operators that are indexed (fixed values).
OPERATORS = (
    "==", "!=", ">", "<", ">=", "<=",
    "+", "-", "*", "/", "%",
    "&&", "||", "!",
    "&", "|", "^", "~", "<<", ">>",
    "?:", "=>", "..", "->", "?->",
)

#: Characters that may not stand before and after an operator, lest it be part of a longer
#: one (fixed values).
_GUARDS = {">": (">=-", ">="), "<": ("<=-", "<="), "!": ("", "="), "&": ("&", "&"), "|": ("|", "|")}


def operator_pattern(operator: str) -> str:
    before, after = _GUARDS.get(operator, ("", ""))
    ahead = f"(?<![{re.escape(before)}])" if before else ""
    return ahead + re.escape(operator) + (f"(?![{re.escape(after)}])" if after else "")


def operator_counts(df: DataFrame, key: str, text: str, operators: Sequence[str] = OPERATORS) -> DataFrame:
    """(key, operator, n) for the operators that a text uses; one pass over each text. It cuts
    out the runs of operators' characters: an operator and what may not stand beside it lie
    within one run, and only the runs are searched for each operator."""
    marks = "".join(re.escape(c) for c in sorted(set("".join(operators))))
    alone = "".join(re.escape(o) for o in operators if len(o) == 1)
    runs = F.regexp_extract_all(text, F.lit(f"[{marks}]{{2,}}" + (f"|[{alone}]" if alone else "")), F.lit(0))
    cut = df.select(key, F.array_join(runs, " ").alias("__runs")).where("__runs <> ''")
    pairs = F.array(*(F.struct(F.lit(o).alias("operator"), F.regexp_count("__runs", F.lit(operator_pattern(o))).cast("long").alias("n")) for o in operators))
    return cut.select(key, F.inline(pairs)).where("n > 0")


def search_operators(index: DataFrame, key: str, operators: Sequence[str]) -> DataFrame:
    """Keys of the texts that use every one of the operators, from operator_counts."""
    asked = set(operators)
    held = index.where(F.col("operator").isin(*asked)).groupBy(key).agg(F.count("*").alias("__n"))
    return held.where(F.col("__n") == len(asked)).select(key)


def operator_statistics(index: DataFrame) -> DataFrame:
    """(operator, texts, uses, share): how many texts use an operator and how often, and
    its share of all (text, operator) pairs, from operator_counts."""
    per = index.groupBy("operator").agg(F.count("*").alias("texts"), F.sum("n").alias("uses"))
    total = per.agg(F.sum("texts").alias("__all"))  # one row; per has one for each operator
    return per.join(F.broadcast(total)).select("operator", "texts", "uses", F.round(F.col("texts") / F.col("__all"), 6).alias("share"))


def regex_lines(df: DataFrame, key: str, text: str, pattern: str, context: int = 1) -> DataFrame:
    """Lines that match, with the lines around them."""
    lines = df.select(key, F.split(text, "\n").alias("__lines"))
    hits = lines.select(key, "__lines", F.posexplode("__lines").alias("line", "matched")).where(F.col("matched").rlike(pattern))
    start = F.greatest(F.col("line") - context, F.lit(0))
    around = F.slice("__lines", start + 1, F.col("line") + context - start + 1)
    return hits.select(key, (F.col("line") + 1).alias("line"), "matched", F.array_join(around, "\n").alias("around"))


def diverse_examples(df: DataFrame, size: Column, n: int, low: int, high: int, order: Sequence[str]) -> DataFrame:
    """n / 3 examples each of simple, medium and complex ones."""
    level = F.when(size < low, "simple").when(size < high, "medium").otherwise("complex")
    nth = F.row_number().over(Window.partitionBy("level").orderBy(*order))
    return df.withColumn("level", level).withColumn("nth", nth).where(F.col("nth") <= -(-n // 3))


def weighted_match(query: str, weights: dict[str, tuple[Column, float]]) -> Column:
    """Sum of each field's weight for every query word it contains."""
    score = F.lit(0.0)
    for word in dict.fromkeys(query.lower().split()):
        for column, weight in weights.values():
            score = score + F.when(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(word)), weight).otherwise(0.0)
    return score


#: What an intent may speak of, and what it may ask for with the words that say so (fixed values).
ENTITIES = ("site", "equip", "point", "meter", "sensor", "ahu", "vav")
ACTIONS = {
    "consumption": ("usage", "consumed", "consumption", "energy use"),
    "efficiency": ("efficiency", "performance", "cop", "kw/ton"),
    "fault": ("fault", "problem", "issue", "broken", "offline", "down"),
    "export": ("export", "download", "extract", "dump"),
    "history": ("history", "historical", "trend", "over time", "past"),
    "status": ("status", "state", "running", "online", "active"),
}


def intent_score(intent: str, name: Column, category: Column, description: Column, tags: Column, body: Column) -> Column:
    """How well a record fits an intent: its name is said 10, its category 5, each word of
    its description of over three letters 2, each tag 3, an entity that is said and in its
    body 4, each word for an action that its name or description is about 5."""
    said = F.lit(intent.lower())
    low = intent.lower()
    words = F.filter(F.split(F.lower(description), r"\s+"), lambda w: (F.length(w) > 3) & F.contains(said, w))
    held = F.filter(tags, lambda t: F.contains(said, F.lower(t)))
    score = F.when(F.contains(said, F.lower(name)), 10).otherwise(0) + F.when(F.contains(said, F.lower(category)), 5).otherwise(0) + 2 * F.size(words) + 3 * F.size(held)
    for entity in ENTITIES:
        if entity in low:
            score = score + F.when(F.contains(body, F.lit(entity)), 4).otherwise(0)
    for action, ways in ACTIONS.items():
        n = sum(w in low for w in ways)
        if n:
            about = F.contains(F.lower(name), F.lit(action)) | F.contains(F.lower(description), F.lit(action))
            score = score + F.when(about, 5 * n).otherwise(0)
    return score


def _says(text: str, *fields: Column) -> Column:
    low = F.lit(text.lower())
    said = F.lit(False)
    for f in fields:
        said = said | F.coalesce(F.contains(F.lower(f), low), F.lit(False))
    return said


def search_templates(df: DataFrame, text: str = "", category: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Records (name, description, template, category, tags) of a category, with any of the
    tags, whose text fields or a tag contain the text."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if tags:
        df = df.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in tags))))
    if text:
        df = df.where(_says(text, F.col("name"), F.col("description"), F.col("template"), F.array_join("tags", "\n")))
    return df


def search_patterns(df: DataFrame, keyword: str, fields: Sequence[str]) -> DataFrame:
    """Records whose fields, joined with spaces, contain the keyword."""
    return df.where(_says(keyword, F.concat_ws(" ", *fields)))


def patterns_of_category(df: DataFrame, category: str, key: str = "id") -> DataFrame:
    """Records whose key starts with the category's name."""
    return df.where(F.startswith(F.col(key), F.lit(category.lower())))


def search_workflows(df: DataFrame, query: str = "", semantic: DataFrame | None = None, category: str | None = None, tags: Sequence[str] = (), n: int = 10) -> DataFrame:
    """(id, score) of records (id, title, description, category, tags): 1 if the joined
    fields contain the query, 0.5 more if the title does; the scores of `semantic` (id,
    score) are added, and its hits without the text count by themselves. A tag filter holds
    for text hits, the category for both. Without a query all records score 1."""
    if category is not None:
        df = df.where(F.col("category") == category)
    joined = F.concat_ws(" ", "title", "description", "category", F.array_join("tags", " "))
    text = F.when(_says(query.strip(), joined), 1.0).otherwise(0.0) + F.when(_says(query.strip(), F.col("title")), 0.5).otherwise(0.0) if query.strip() else F.lit(1.0)
    tagged = F.lit(True)
    for t in tags:
        tagged = tagged & F.array_contains(F.transform("tags", F.lower), t.lower())
    scored = df.select("id", F.when(tagged, text).otherwise(0.0).alias("text"))
    if semantic is not None:
        scored = scored.join(semantic.select("id", F.col("score").alias("meaning")), "id", "left")
    else:
        scored = scored.withColumn("meaning", F.lit(None).cast("double"))
    found = scored.where("text > 0 OR meaning IS NOT NULL")
    return found.select("id", (F.col("text") + F.coalesce("meaning", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "id").limit(n)


# --- vectors ---

#: Queries multiplied at once.
QUERY_BLOCK = 1000
#: Scores kept at once in a task.
HELD_SCORES = 4_000_000
#: Rows that a task holds while the queries pass, at most.
PART_ROWS = 32_768
#: Cells that the vectors of a dimension are dealt to, at most.
CELLS = 64
#: Room for the rounding of angles; far above it, and far below what prunes.
_SLACK = 1e-6


def _unit_rows(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of a dimension that have a direction, and these as unit rows."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    where = np.flatnonzero(lengths == dim)
    rows = column.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(where), dim)
    norms = np.sqrt((rows * rows).sum(1))
    good = np.isfinite(norms) & (norms > 0)
    return where[good], rows[good] / norms[good, None]


def _best(asked: np.ndarray, units: np.ndarray, keys: np.ndarray, held: np.ndarray, k: int, least: float | None, exclude_self: bool) -> tuple[np.ndarray, ...]:
    """(query, key, score) of the k best held rows of each asked one."""
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    step = max(1, HELD_SCORES // max(1, len(asked)))
    for begin in range(0, len(keys), step):
        # Equal vectors must tie, whatever the order their products were summed in.
        scores = np.round(units @ held[begin : begin + step].T, 12)
        if least is not None:
            scores[scores < least] = -np.inf
        if exclude_self:
            scores[asked[:, None] == keys[None, begin : begin + step]] = -np.inf
        high = scores > -np.inf
        if scores.shape[1] > k:
            high &= scores >= np.partition(scores, -k, axis=1)[:, -k][:, None]  # the k-th best and its ties
        row, column = np.nonzero(high)
        row, key, score = (np.concatenate(p) for p in zip(found, (row, keys[begin + column], scores[row, column])))
        order = np.lexsort((key, -score, row))
        row, key, score = row[order], key[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        found = (row[kept], key[kept], score[kept])
    return asked[found[0]], found[1], found[2]


def _has_direction(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _pivots(named: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """For each dimension some vectors as unit rows, CELLS at most, one for about a thousand
    rows: one of each residue of the keys' hash. Any choice gives the same result."""
    some = max(1, min(CELLS, rows // 1000))
    picked = named.where(_has_direction("vector")).groupBy(F.size("vector").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(some)).alias("at")).agg(F.min_by("vector", "key").alias("vector"))
    out: dict[int, list[np.ndarray]] = {}
    for r in picked.orderBy("dim", "at").collect():  # CELLS rows a dimension at most
        row = np.array(r["vector"], np.float64)
        norm = np.sqrt((row * row).sum())
        if np.isfinite(norm) and norm > 0:
            out.setdefault(r["dim"], []).append(row / norm)
    return {dim: np.array(rows) for dim, rows in out.items()}


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", least: float | None = None, exclude_self: bool = True) -> DataFrame:
    """(query, key, score): the k most similar rows of each query by cosine, ties by key.

    Rows lie in the cell of their nearest pivot, cells in parts of bounded size. A query goes
    to the parts of those cells that can hold one of its k best: by the triangle inequality on
    angles, no row of a cell is nearer than the pivot's angle less the cell's radius, and k
    rows are within the angle plus the radius of the cells that hold them. Rows are shuffled
    once, a part's rows come before its queries, and a task holds one part while the queries
    pass in Arrow batches; each leaves k rows. The driver gets pivots and the sizes of cells,
    never a query. Vectors that are null, without direction or of another dimension are near
    to nothing; with exclude_self, no row of a query's key is an answer."""
    named = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key IS NOT NULL")
    asked = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key IS NOT NULL")
    session = vectors.sparkSession
    per_key = named.groupBy("key").count().agg(F.sum("count"), F.max("count")).first()
    rows, repeats = per_key[0] or 0, per_key[1] or 0
    pivots = _pivots(named, rows)
    dims = sorted(pivots)
    first = dict(zip(dims, np.cumsum([0, *(len(pivots[d]) for d in dims)]).tolist()))

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each dimension: places of vectors, and their angles to its pivots."""
        for dim in dims:
            where, units = _unit_rows(batch.column(1), dim)
            if len(where):
                yield dim, where, np.arccos(np.clip(units @ pivots[dim].T, -1, 1))

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, angles in placed(batch):
                cell = angles.argmin(1)
                for c in np.unique(cell):
                    mine = angles[cell == c, c]
                    yield pa.RecordBatch.from_pydict({"cell": [int(c) + first[dim]], "n": [len(mine)], "radius": [float(mine.max())]})

    n_cells = sum(len(p) for p in pivots.values())
    sizes, radii = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    measured = named.mapInArrow(cells_of, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    for r in measured.collect():  # as many rows as pivots
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    size = max(1, min(PART_ROWS, max(256, rows // session.sparkContext.defaultParallelism)))
    parts = np.maximum(1, -(-sizes // size))
    need = k + (repeats if exclude_self else 0)
    reach = np.pi if least is None else float(np.arccos(np.clip(least, -1, 1)))

    def held_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, where, angles in placed(batch):
                cell = angles.argmin(1) + first[dim]
                columns = [pa.array(cell), pa.array(parts[cell]), batch.column(0).take(pa.array(where)), batch.column(1).take(pa.array(where))]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "parts", "key", "vector"])

    def sent_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, where, angles in placed(batch):
                mine = slice(first[dim], first[dim] + angles.shape[1])
                far = np.where(sizes[mine] > 0, angles + radii[mine], np.inf)
                order = far.argsort(1)
                enough = np.cumsum(sizes[mine][order], 1) >= need
                bound = np.where(enough.any(1), np.take_along_axis(far, order, 1)[np.arange(len(far)), enough.argmax(1)], np.pi)
                wanted = (angles - radii[mine] <= np.minimum(bound, reach)[:, None] + _SLACK) & (sizes[mine] > 0)
                query, cell = np.nonzero(wanted)
                cell, at = cell + first[dim], pa.array(where[query])
                columns = [pa.array(cell), pa.array(parts[cell]), batch.column(0).take(at), batch.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "parts", "key", "vector"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, held, ready = None, [], [], False
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                group, side = tuple(marks[begin, :2].tolist()), marks[begin, 2]
                if group != current:
                    current, keys, held, ready = group, [], [], False
                for at in range(begin, end, QUERY_BLOCK):
                    piece = batch.slice(at, min(QUERY_BLOCK, end - at))
                    column = piece.column(4)
                    where, units = _unit_rows(column, len(column[0]))
                    ids = piece.column(3).to_numpy(zero_copy_only=False)[where]
                    if side == 0:
                        keys.append(ids)
                        held.append(units)
                    elif keys:
                        if not ready:
                            keys, held, ready = [np.concatenate(keys)], [np.concatenate(held)], True
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(ids, units, keys[0], held[0], k, least, exclude_self)], ["query", "key", "score"])

    shape = "cell long, parts long, key long, vector array<double>"
    stored = named.mapInArrow(held_rows, shape).select("cell", F.pmod(F.xxhash64("key", "vector"), "parts").alias("part"), F.lit(0).alias("side"), "key", "vector")
    sent = asked.mapInArrow(sent_queries, shape).select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "key", "vector")
    dealt = stored.unionByName(sent).repartition(int(max(1, parts.sum())), "cell", "part").sortWithinPartitions("cell", "part", "side")
    scored = dealt.mapInArrow(answers, "query long, key long, score double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k).select("query", F.col("key").alias(key), "score")


def pooled(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, vector): the mean of each key's vectors, of length one: how the vectors of a
    text's tokens become that of the text. Places are averaged where they lie before they
    move; a mean of length zero stays as it is."""
    places = vectors.select(key, F.posexplode(F.col(vector)).alias("__at", "__x"))
    means = places.groupBy(key, "__at").agg(F.avg("__x").alias("__x"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda p: p["__x"]).alias("__v"))
    length = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(key, F.transform("__v", lambda x: F.when(length > 0, x / length).otherwise(x)).alias(vector))


def hybrid(scored: DataFrame, degree: DataFrame, key: str, weight: float = 0.3, full: float = 20.0) -> DataFrame:
    """(1 - w) * cosine + w * min(1, degree / full), best first within a query."""
    joined = scored.join(degree, key, "left")
    share = F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / full)
    return joined.select("query", key, "score", ((1 - weight) * F.col("score") + weight * share).alias("blended"))


def upsert(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of changed in place of those with their key, the rest as they are."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed)


def count_vectors(stored: DataFrame, project: Column, value: object | None = None) -> DataFrame:
    """One row: the number of vectors, of a project or of all."""
    return (stored if value is None else stored.where(project == F.lit(value))).agg(F.count("*").alias("n"))


def delete_project(stored: DataFrame, project: Column, value: object) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number of vectors that go); vectors without a project stay."""
    gone = F.coalesce(project == F.lit(value), F.lit(False))
    return stored.where(~gone), stored.agg(F.count_if(gone).alias("n"))
