"""The pipeline's stages on a small table, and end to end."""

import corpus_pipeline
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
            # Nothing appears that wasn't there.
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).where("doc_id IS NULL").isEmpty()
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
        if name == "source mixing":
            assert before.join(docs, "doc_id", "left_anti").isEmpty()
        if name == "near-duplicate removal":
            assert docs.count() == docs.select("doc_id").distinct().count()
    assert sizes[0] < n and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] <= sizes[3] * 2
    packed = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.agg(F.max("n")).first()[0] <= 2048


def test_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_near_copies_are_all_found(spark, monkeypatch):
    import numpy as np
    from tagweave.llm import near_copies

    monkeypatch.setattr(near_copies, "SAMPLE", 60)  # some shingles count as frequent
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, " ", "One two", "one  TWO", "one three"]
    for _ in range(12):
        base = rng.choice(words, int(rng.integers(5, 150))).tolist()
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 4))):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
    passage = " ".join(words[:30])
    texts += [f"{passage} {' '.join(rng.choice(words, 12))}" for _ in range(20)]

    def cut(text):
        t = (text or "").lower().split()
        return {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()

    sets = [cut(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()}
    assert got == {i: top(i) for i in range(len(texts))}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, DIR).collect()} == {top(i) for i in range(len(texts))}


def test_a_run_goes_on_where_it_failed(spark, monkeypatch):
    calls = []

    def counted(k, stage):
        def run(spark, docs, sf_dir):
            calls.append(k)
            if k == 2 and calls.count(2) == 1:
                raise RuntimeError("lost")
            return docs.limit(40) if k < 4 else docs.select("doc_id")

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(k, s)) for k, (n, s) in enumerate(corpus_pipeline.STAGES)])
    name = "test-run"
    try:
        corpus_pipeline.run(spark, DIR, name)
    except RuntimeError:
        pass
    assert corpus_pipeline.run(spark, DIR, name).count() == 40
    assert calls == [0, 1, 2, 2, 3, 4]
    files, path = corpus_pipeline._path(spark, f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}")
    assert [f.getPath().getName() for f in files.listStatus(path)] == ["4"]


def _brute(documents):
    """Line and near-copy dedup by plain code: the texts left, and the ids kept of them."""
    from test_operators import brute_lines

    table = sorted((d.doc_id, d.text or "") for d in documents)
    cleaned = {i: (t, n) for i, t, n in brute_lines(table)}
    alive = {i: t for i, (t, n) in cleaned.items() if not (n and not t.strip(" \t\n\x0b\x0c\r"))}

    def cut(text):
        t = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
        return {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()

    sets = {i: cut(t) for i, t in alive.items()}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 5 * small >= 4 * large and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return alive, {i for i in ids if top(i) == i}


def test_stages_against_plain_code(spark, tmp_path):
    from tagweave.llm import quality
    from tagweave.llm.common import table

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    scored = {r.doc_id: r.score for r in quality.score_quality(docs, table(spark, DIR, "labels")).collect()}
    read = {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        read[k] = docs.collect()
        if k == 0:
            assert {r.doc_id for r in read[0]} == {i for i, x in scored.items() if x >= 0.7}
            alive, kept = _brute(read[0])
        elif k == 1:
            assert {r.doc_id: r.text or "" for r in read[1]} == alive
            assert all(r.n_chars == len(r.text) for r in read[1] if r.text is not None and r.n_chars != before.where(F.col("doc_id") == r.doc_id).first().n_chars)
        elif k == 2:
            assert {r.doc_id for r in read[2]} == kept
            assert {r for r in read[2]} <= {r for r in read[1]}
        elif k == 3:
            assert {r for r in read[3]} == {r for r in read[2]}
            times = [sum(r == x for r in read[3]) for x in read[2]]
            assert min(times) == 1 and max(times) <= 2
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sorted((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in read[3])
    assert sorted((r.doc_id, r.doc_tokens) for r in read[4] if r.start == 0) == tokens
    assert sum(r.length for r in read[4]) == sum(n for _, n in tokens)


def test_odd_rows_pass_through(spark, tmp_path):
    rows = [
        (None, None, None, None, None, "x", 1), (1, "", "en", "a", 0, "y", 2), (1, None, "en", None, 0, "z", 3), (2, "A plain sentence that says a few things about the weather today.", "en", "a", 60, "x", 4),
        (2, "A plain sentence that says a few things about the weather today.", "en", "a", 60, "x", 4), (3, " ".join(f"word{i % 977} and{i}" for i in range(20_000)), "en", "b", 1, None, 5), (4, " " * 50_000, "de", "b", 1, "q", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, doc int").repartition(3)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == columns
        if k:  # the classifier may reject any of these rows; the others get them all
            docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0


def test_near_copies_by_fingerprint(spark, monkeypatch):
    """SimHash alone links the closest copies; its links are verified; the exact join adds the rest."""
    import numpy as np
    from tagweave.llm import near_copies, simhash

    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 4000)]
    close, far = [*base[:-1], "other"], list(base)
    for at in range(0, 4000, 60):
        far[at] = f"x{at}"
    texts = [" ".join(x) for x in (base, close, far)] + ["a text of its own that is like no other", None]
    sets = [near_copies.shingles(t) for t in texts]
    prints = [simhash.set_fingerprint(x) for x in sets]
    assert prints[0] != prints[2] and (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    ids = lambda: [r.component_id for r in near_copies.near_copies(frame).orderBy("doc_id").collect()]
    assert ids() == [0, 0, 0, 3, 4]
    with monkeypatch.context() as m:  # nothing filed under shingles
        m.setattr(near_copies, "_passing", lambda prints, wanted: prints.select("node", F.lit(0).cast("long").alias("key")).limit(0))
        assert ids() == [0, 0, 2, 3, 4]
        m.setattr(simhash, "set_fingerprint", lambda x: 7)  # bits alone link nothing
        assert ids()[3:] == [3, 4]
