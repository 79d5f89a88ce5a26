"""Queries of text, operator, regex and vector search over documents and embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tagweave.functions.lineage import shared_folder
from tagweave.operators import search
from tagweave.plans.registry import query, table
from tagweave.sources import readers

_INDEX = "WITH i AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: len(t) >= 2)) AS token, doc_id AS id FROM documents)"


def _index(spark, d):
    return search.token_index(table(spark, d, "documents"), "doc_id", "text")


@query("token_index_stats", _INDEX + ", p AS (SELECT token, count(*) AS n FROM i GROUP BY 1) SELECT count(*) AS tokens, CAST(sum(n) AS BIGINT) AS postings, round(avg(n), 4) AS avg_postings, max(n) AS most FROM p")
def token_index_stats(spark, d):
    return search.index_statistics(_index(spark, d))


@query("search_and", _INDEX + " SELECT id FROM i WHERE token = 'the' INTERSECT SELECT id FROM i WHERE token LIKE 'thea%' AND ((SELECT count(*) FROM i WHERE token = 'thea') = 0 OR token = 'thea') INTERSECT SELECT id FROM i WHERE token = 'with'")
def search_and(spark, d):
    return search.search_all(_index(spark, d), ["the", "thea", "with"])


@query("search_saved", _INDEX + " SELECT id FROM i WHERE token LIKE 'licens%' AND ((SELECT count(*) FROM i WHERE token = 'licens') = 0 OR token = 'licens') INTERSECT SELECT id FROM i WHERE token = 'the'")
def search_saved(spark, d):
    """Words in an index that is kept, and made again when the documents are newer."""
    cache = readers.Cache(spark, f"{shared_folder(spark)}/indexes")
    name = f"tokens-{hashlib.sha256(d.encode()).hexdigest()}"
    source = f"{d}/documents.parquet"
    if cache.is_stale(name, [source]):
        search.save_index(_index(spark, d), f"{cache.folder}/{name}")
    return search.search_all(spark.read.parquet(f"{cache.folder}/{name}"), ["licens", "the"])


@query("search_or", _INDEX + " SELECT DISTINCT id FROM i WHERE token LIKE 'licens%' OR token LIKE 'apache%'")
def search_or(spark, d):
    return search.search_any(_index(spark, d), ["licens", "Apache"])


def _score_sql(q: str) -> str:
    words = q.split()
    found = " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)
    return (
        f"SELECT doc_id, CAST(CASE WHEN {found} > 0 THEN least(100, 50 + CASE WHEN contains(lower(text), '{q}') THEN 25 ELSE 0 END + CASE WHEN contains(lower(split_part(text, chr(10), 1)), '{q}') THEN 30 ELSE 0 END"
        f" + CASE WHEN contains(lower(source), '{q}') THEN 20 ELSE 0 END + floor(20.0 * ({found}) / {len(words)})) ELSE 0 END AS INTEGER) AS score FROM documents"
    )


@query("relevance_rank", f"SELECT * FROM ({_score_sql('with the')}) ORDER BY score DESC, doc_id LIMIT 50")
def relevance_rank(spark, d):
    docs = table(spark, d, "documents")
    score = search.doc_score("with the", F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), F.col("source"))
    return docs.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(
    "fielded_rank",
    """WITH b AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS c, lower(p_brand) AS t FROM part),
       s AS (SELECT *, CASE WHEN contains(n, 'part') THEN 5.0 ELSE 0 END + CASE WHEN contains(n, '1') THEN 5.0 ELSE 0 END + CASE WHEN contains(c, 'part') THEN 2.0 ELSE 0 END + CASE WHEN contains(c, '1') THEN 2.0 ELSE 0 END + CASE WHEN contains(t, 'part') THEN 2.5 ELSE 0 END + CASE WHEN contains(t, '1') THEN 2.5 ELSE 0 END AS base FROM b)
       SELECT p_partkey, round(CASE WHEN base > 0 THEN base + CASE WHEN n = 'part 1' THEN 100 WHEN starts_with(n, 'part 1') THEN 50 WHEN contains(n, 'part 1') THEN 25 ELSE 0 END + CASE WHEN contains(n, 'part') THEN 10 ELSE 0 END + CASE WHEN contains(n, '1') THEN 10 ELSE 0 END ELSE 0 END, 4)::DOUBLE AS score FROM s ORDER BY score DESC, p_partkey LIMIT 50""",
)
def fielded_rank(spark, d):
    fields = {"name": F.col("p_name"), "category": F.col("p_type"), "tags": F.col("p_brand")}
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(search.relevance("part 1", fields), 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


@query("highlights", "WITH t AS (SELECT doc_id, text, instr(lower(text), 'license') AS loc FROM documents) SELECT doc_id, CASE WHEN loc > 0 THEN substr(text, greatest(loc - 50, 1), loc + 107 - greatest(loc - 50, 1)) ELSE substr(text, 1, 150) END AS shown FROM t")
def highlights(spark, d):
    return table(spark, d, "documents").select("doc_id", search.highlight(F.col("text"), "license").alias("shown"))


@query(
    "section_rank",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
       s AS (SELECT doc_id, pos, CASE WHEN contains(lower(t), 'with the') THEN 10 ELSE 0 END + CAST(contains(lower(t), 'with') AS INT) + 2 * CAST(contains(lower(split_part(t, ' ', 1)), 'with') AS INT) + CAST(contains(lower(t), 'the') AS INT) + 2 * CAST(contains(lower(split_part(t, ' ', 1)), 'the') AS INT) AS score FROM l)
       SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM s WHERE score > 0) WHERE k <= 3""",
)
def section_rank(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    sections = lines.withColumn("heading", F.split_part("body", F.lit(" "), F.lit(1)))
    return search.rank_sections(sections, "doc_id", "heading", "body", "with the", 3).select("doc_id", "pos", "score")


def _operator_sql() -> str:
    """SQL has no look-around: an operator that may be part of a longer one is counted by the
    maximal runs of the characters it may not touch."""
    runs = {">": ("[>=-]+", "x[1] = '>' AND (len(x) = 1 OR x[2] = '-')"), "<": ("[<=-]+", "x[1] = '<' AND (len(x) = 1 OR x[2] = '-')"), "&": ("&+", "x = '&'"), "|": ("[|]+", "x = '|'")}
    counts = []
    for o in search.OPERATORS:
        plain = "".join(f"[{c}]" if c not in "^!" else ("\\^" if c == "^" else "!") for c in o)
        if o in runs:
            counts.append(f"len(list_filter(regexp_extract_all(text, '{runs[o][0]}'), lambda x: {runs[o][1]}))")
        elif o == "!":
            counts.append("len(regexp_extract_all(text, '!')) - len(regexp_extract_all(text, '!='))")
        else:
            counts.append(f"len(regexp_extract_all(text, '{plain}'))")
    names = ", ".join(f"'{o}'" for o in search.OPERATORS)
    return f"c AS (SELECT doc_id, unnest([{names}]) AS operator, unnest([{', '.join(counts)}]) AS n FROM documents), i AS MATERIALIZED (SELECT doc_id, operator, CAST(n AS BIGINT) AS n FROM c WHERE n > 0)"


_OPERATORS = "WITH " + _operator_sql()


def _operators(spark, d):
    return search.operator_counts(table(spark, d, "documents"), "doc_id", "text")


@query("operator_counts", _OPERATORS + " SELECT * FROM i")
def operator_counts(spark, d):
    return _operators(spark, d)


@query("operator_search", _OPERATORS + " SELECT doc_id FROM i WHERE operator = '*' INTERSECT SELECT doc_id FROM i WHERE operator = '%' INTERSECT SELECT doc_id FROM i WHERE operator = '&&'")
def operator_search(spark, d):
    return search.search_operators(_operators(spark, d), "doc_id", ["*", "%", "&&"])


@query("operator_statistics", _OPERATORS + " SELECT operator, count(*) AS texts, CAST(sum(n) AS BIGINT) AS uses, round(count(*) / (SELECT count(*) FROM i), 6) AS share FROM i GROUP BY 1")
def operator_statistics(spark, d):
    return search.operator_statistics(_operators(spark, d))


@query(
    "regex_context",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), x AS (SELECT doc_id, a, unnest(a) AS matched, generate_subscripts(a, 1) AS line FROM l)
       SELECT doc_id, CAST(line AS INTEGER) AS line, matched, array_to_string(a[greatest(line - 1, 1):line + 1], chr(10)) AS around FROM x WHERE regexp_matches(matched, 'Licen[sc]e|[0-9]{3}-[0-9]{4}')""",
)
def regex_context(spark, d):
    return search.regex_lines(table(spark, d, "documents"), "doc_id", "text", "Licen[sc]e|[0-9]{3}-[0-9]{4}", 1)


@query("diverse_examples", "SELECT doc_id, level FROM (SELECT doc_id, level, row_number() OVER (PARTITION BY level ORDER BY n_chars, doc_id) AS k FROM (SELECT *, CASE WHEN n_chars < 500 THEN 'simple' WHEN n_chars < 3000 THEN 'medium' ELSE 'complex' END AS level FROM documents)) WHERE k <= 4")
def diverse_examples(spark, d):
    docs = table(spark, d, "documents")
    return search.diverse_examples(docs, F.col("n_chars"), 12, 500, 3000, ["n_chars", "doc_id"]).select("doc_id", "level")


_INTENT = "Export the history of src7 meters in de with past status, from the things over time"


@query(
    "template_intent",
    f"""WITH t AS (SELECT doc_id, source AS name, lang AS category, substr(text, 1, 400) || ' history' AS description, [source, 'with', lang] AS tags, text AS body, lower('{_INTENT}') AS said FROM documents)
       SELECT doc_id, CAST(CASE WHEN contains(said, lower(name)) THEN 10 ELSE 0 END + CASE WHEN contains(said, lower(category)) THEN 5 ELSE 0 END + 2 * len(list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda w: len(w) > 3 AND contains(said, w)))
         + 3 * len(list_filter(tags, lambda w: contains(said, lower(w)))) + CASE WHEN contains(body, 'meter') THEN 4 ELSE 0 END
         + CASE WHEN contains(lower(description), 'export') THEN 5 ELSE 0 END + CASE WHEN contains(lower(description), 'history') THEN 15 ELSE 0 END + CASE WHEN contains(lower(description), 'status') THEN 5 ELSE 0 END AS INTEGER) AS score FROM t""",
)
def template_intent(spark, d):
    docs = table(spark, d, "documents")
    about = F.concat(F.substring("text", 1, 400), F.lit(" history"))
    score = search.intent_score(_INTENT, F.col("source"), F.col("lang"), about, F.array("source", F.lit("with"), "lang"), F.col("text"))
    return docs.select("doc_id", score.cast("int").alias("score"))


def _records(spark, d):
    """Parts as records to search."""
    return table(spark, d, "part").select(
        F.concat(F.lower("p_brand"), F.lit("-"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_type").alias("template"),
        F.col("p_brand").alias("category"), F.array(F.concat(F.lit("size"), "p_size"), F.col("p_brand")).alias("tags"), F.col("p_name").alias("title"), "p_partkey",
    )


@query("template_search", "SELECT p_partkey FROM part WHERE p_size IN (3, 7) AND (lower(p_name) LIKE '%1%' OR lower(p_type) LIKE '%1%' OR lower('size' || p_size) LIKE '%1%' OR lower(p_brand) LIKE '%1%')")
def template_search(spark, d):
    return search.search_templates(_records(spark, d), "1", tags=["size3", "size7"]).select("p_partkey")


@query("pattern_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || 'size' || p_size || ' ' || p_brand), '1 ')")
def pattern_search(spark, d):
    return search.search_patterns(_records(spark, d).withColumn("tags", F.array_join("tags", " ")), "1 ", ["name", "description", "tags"]).select("p_partkey")


@query("pattern_category", "SELECT p_partkey FROM part WHERE starts_with(lower(p_brand) || '-', lower((SELECT min(p_brand) FROM part)))")
def pattern_category(spark, d):
    first = table(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return search.patterns_of_category(_records(spark, d), first).select("p_partkey")


@query("workflow_search", "WITH m AS (SELECT p_partkey, p_retailprice / 1000 AS s FROM part WHERE p_size = 5), t AS (SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_type || ' ' || p_brand || ' size' || p_size || ' ' || p_brand), '12') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(p_name), '12') THEN 0.5 ELSE 0 END AS x FROM part) SELECT p_partkey, round(CAST(x AS DOUBLE) + coalesce(s, 0), 6) AS score FROM t LEFT JOIN m USING (p_partkey) WHERE x > 0 OR s IS NOT NULL ORDER BY CAST(x AS DOUBLE) + coalesce(s, 0) DESC, p_partkey LIMIT 40")
def workflow_search(spark, d):
    """Words and meaning together; sizes stand for nearness here."""
    near = table(spark, d, "part").where("p_size = 5").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("score"))
    found = search.search_workflows(_records(spark, d).withColumn("id", F.col("p_partkey")), "12", near, n=40)
    return found.select(F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_KNN = f"SELECT query, vec_id, score FROM (SELECT q.vec_id AS query, a.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, a.vec_id) AS k FROM embeddings a JOIN embeddings q ON q.vec_id % 50 = 0 AND a.vec_id <> q.vec_id) WHERE k <= 10"


def _knn(spark, d, least=None):
    v = table(spark, d, "embeddings")
    return search.nearest(v, v.where("vec_id % 50 = 0"), 10, least=least)


@query("knn_cosine", f"SELECT query, vec_id, round(score, 5) AS score FROM ({_KNN})")
def knn_cosine(spark, d):
    return _knn(spark, d).select("query", "vec_id", F.round("score", 5).alias("score"))


@query("knn_threshold", f"SELECT query, vec_id FROM ({_KNN}) WHERE score >= 0.2")
def knn_threshold(spark, d):
    return _knn(spark, d, 0.2).select("query", "vec_id")


@query("hybrid_rank", f"WITH k AS ({_KNN}), g AS (SELECT vec_id, (SELECT count(*) FROM embeddings x WHERE x.label = e.label) AS degree FROM embeddings e) SELECT query, k.vec_id, round(0.7 * score + 0.3 * least(1.0, degree / 20.0), 5) AS blended FROM k JOIN g USING (vec_id)")
def hybrid_rank(spark, d):
    v = table(spark, d, "embeddings")
    degree = v.join(v.groupBy("label").agg(F.count("*").alias("degree")), "label").select("vec_id", "degree")
    return search.hybrid(_knn(spark, d), degree, "vec_id").select("query", "vec_id", F.round("blended", 5).alias("blended"))


@query("vectors_pooled", "WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS l FROM m GROUP BY 1) SELECT label, k - 1 AS place, round(x / l, 6) AS x FROM m JOIN n USING (label)")
def vectors_pooled(spark, d):
    """The mean direction of each label's vectors."""
    found = search.pooled(table(spark, d, "embeddings"), "label")
    return found.select("label", F.posexplode("embedding").alias("place", "x")).select("label", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    return search.upsert(v, v.where("vec_id % 9 = 0").withColumn("label", F.lit(-1)), "vec_id")


@query("vector_count", "SELECT count(*) AS n FROM embeddings WHERE label = 3")
def vector_count(spark, d):
    return search.count_vectors(table(spark, d, "embeddings"), F.col("label"), 3)


@query("vector_delete_project", "SELECT vec_id, (SELECT count(*) FROM embeddings WHERE label = 3) AS gone FROM embeddings WHERE label IS DISTINCT FROM 3")
def vector_delete_project(spark, d):
    left, gone = search.delete_project(table(spark, d, "embeddings"), F.col("label"), 3)
    return left.select("vec_id").join(F.broadcast(gone.withColumnRenamed("n", "gone")))


@query("filtered_results", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src7'")
def filtered_results(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), "source")
    return search.filter_results(docs, category="EN", source="src7").select("doc_id")
