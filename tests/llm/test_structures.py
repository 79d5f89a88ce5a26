"""Fill-in-the-middle, the conversation trie and the Jaccard join against brute force, on small and odd tables."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import common, components, fill_in_middle, line_dedup, mixing, ngram_join, prefix_trie, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-the-middle.

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "character": r"(?s:.)"}
TEXTS = [None, "", "\n", "a", "a\n", "\n\na\r\n\n", "no marker <P here", "with <M> inside", "é東\n𝄞 x\ny\n", " lead and  more\twords ", "x" * 70_000 + "\n" + "é\n" * 40_000, "one line\n" * 3, " not a line\x0b"]


def brute_fim(i, text, unit, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit,rate", [("line", 100), ("word", 60), ("character", 100)])
def test_fill_in_middle(spark, unit, rate):
    table = [(i if i else None, t) for i, t in enumerate(TEXTS * 4)] + [(5, "twice\nthe same")] * 2
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("n", "form", "cut", "source", "output", "doc")})
    made = fill_in_middle.fill_in_middle(docs, unit=unit, rate=rate)
    assert made.columns == ["doc_id", "text", "cut", "source", "doc", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id or 0, r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
    assert got == sorted(((i or 0, t or "", *brute_fim(i, t, unit, rate=rate)) for i, t in table), key=repr)
    assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_in_middle_chunks():
    """Cuts don't depend on the size of chunks."""
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "\n", "é", "𝄞", "東\n"]) for _ in range(rng.randrange(40)))
        data = np.frombuffer(text.encode(), np.uint8)
        pair = (rng.randrange(1 << 32), rng.randrange(1 << 32))
        for unit, pattern in UNIT.items():
            n = len(re.findall(pattern, text))
            whole = fill_in_middle.cut_chars(data, pair, unit)
            assert whole[0] == n
            assert {fill_in_middle.cut_chars(data, pair, unit, size) for size in (1, 2, 3, 7)} == {whole}


def test_fill_in_middle_empty(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


# Conversation trie.

SAID = "conv_id long, turn long, role string, text string"


def brute_rebuilt(table):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x[1] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return rebuilt


def brute_trie(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids[node]), leaves[node], saved[node], sha(",".join(map(str, sorted(ends[node])))))
        for node, m in members.items()
    )


def trie_rows(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in names) for r in frame.collect())


def said_table(seed, convs=260):
    """Conversations over few turns, so prefixes and whole conversations repeat."""
    rng = random.Random(seed)
    table = []
    for c in range(convs):
        if rng.random() < 0.15:
            continue
        same = c % 3 == 0
        for t in range(4 if same else rng.choice([1, 1, 2, 3, 5, 9, 12])):
            table.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", "user", None, ""]) if not same else "user", "fixed" if same else rng.choice(["a", "b", "é東", None, ""])))
    table += [(None, 0, "user", "nobody's"), (7777, 3, "x", "y"), (10_000, 1, None, None)]
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    table = said_table(seed)
    frame = spark.createDataFrame(table, SAID).repartition(5).withColumns({c: F.lit(-1) for c in ("end", "path", "point", "n", "depth", "turns")})
    turns = prefix_trie.turns_of(frame)
    assert trie_rows(prefix_trie.trie(prefix_trie.shared_starts(turns))) == brute_trie(brute_rebuilt(table))


def test_prefix_trie_repeated_and_nested(spark):
    """Repeated rows, one conversation within another, and a chain of ends."""
    table = [(c, t, "u", f"t{t}") for c in range(1000, 1040) for t in range(c - 1000)] + [(5, 1, "u", "x")] * 3 + [(2000, 0, "a", "bc"), (2001, 0, "ab", "c")]
    frame = spark.createDataFrame(table, SAID)
    own = defaultdict(list)
    for c, t, role, text in sorted(table, key=lambda x: (x[0], x[1])):
        own[c].append((role, text))
    assert trie_rows(prefix_trie.trie(prefix_trie.turns_of(frame))) == brute_trie(own)
    assert trie_rows(prefix_trie.trie(prefix_trie.shared_starts(prefix_trie.turns_of(frame)))) == brute_trie(brute_rebuilt(table))


def test_prefix_trie_whole_table(spark):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(registry.QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.01")) == brute_trie(brute_rebuilt(table))


def test_prefix_trie_empty(spark):
    empty = spark.createDataFrame([], SAID)
    assert prefix_trie.trie(prefix_trie.shared_starts(prefix_trie.turns_of(empty))).count() == 0


# Jaccard join.


def brute_sets(text, words=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_join(table, words=3, alike=90):
    sets = [brute_sets(t, words) for _, t, *_ in table]
    parent = list(range(len(table)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in combinations(range(len(table)), 2):
        a, b = sets[x], sets[y]
        if a and b and 100 * len(a & b) >= alike * len(a | b):
            parent[find(x)] = find(y)
    least = {}
    for k, (i, *_) in enumerate(table):
        r = find(k)
        least[r] = min((v for v in (least.get(r), i) if v is not None), default=None)
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, *_) in enumerate(table)), key=repr)


def copies_table(seed, bases=12, copies=14):
    rng = random.Random(seed)
    table, i = [], 0
    boiler = "all rights reserved by the owner of this very common passage".split()
    for base in range(bases):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 3, 11, 40, 90]))] + boiler * (base % 2)
        for _ in range(copies):
            edited = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(edited))
                edited[k : k + 1] = rng.choice([[f"x{rng.randrange(50)}"], [], [edited[k], "ins"]])
                edited = edited or ["gone"]
            text = " ".join(edited)
            table.append((i, text.upper() if rng.random() < 0.2 else text))
            i += rng.choice([1, 1, 2])
    table += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (None, "no id"), (None, table[0][1]), (9003, "other words of the id")]
    rng.shuffle(table)
    return table


@pytest.mark.parametrize("seed,words,alike", [(1, 3, 90), (2, 2, 75), (3, 3, 60)])
def test_jaccard_join(spark, seed, words, alike, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWDED", 1)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT", 60)
    table = copies_table(seed)
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("n", "node", "grp", "keys", "digest", "root", "component_id")})
    out = ngram_join.jaccard_components(docs.repartition(3), words=words, alike=alike)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr) == brute_join(table, words, alike)


def test_jaccard_join_groups(spark):
    """Sets of one prefix and size form a group, and tests on groups refuse no alike members."""
    table = copies_table(5, bases=6, copies=20)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    sets = ngram_join._sets(docs, 3, 90).collect()
    by = {}
    for r in sets:
        assert len(r["keys"]) <= ngram_join.prefix_length(r.n) and by.setdefault(r.grp, (r.n, r["keys"])) == (r.n, r["keys"])
    assert len(by) < len({r.node for r in sets})
    join = ngram_join._Join(docs, 3, 90)
    passed = join.groups.alias("x").crossJoin(join.groups.alias("y")).where(ngram_join.groups_may_be_alike("x", "y") & ngram_join.prefixes_may_be_alike("x", "y")).select("x.grp", "y.grp").collect()
    passed = {tuple(r) for r in passed}
    text = {r.node: brute_sets(t) for r in ngram_join._sets(docs.select("doc_id", "text"), 3, 90).collect() for i, t in table if i == r.doc_id and len(brute_sets(t)) == r.n}
    grp = {r.node: r.grp for r in sets}
    alike = [(a, b) for a, b in combinations(text, 2) if text[a] and text[b] and 100 * len(text[a] & text[b]) >= 90 * len(text[a] | text[b])]
    assert alike and all((grp[a], grp[b]) in passed for a, b in alike)


def test_jaccard_join_empty(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


# Equal rows in the mix, and very long texts in line dedup.


def test_mixing_repeated_rows(spark, monkeypatch):
    """A third of all rows equal in every column: no block is crowded, the budget is kept,
    and the documents are those of the plan."""
    monkeypatch.setattr(mixing, "PIECE", 100)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 200)
    few = [(i, f"tok {i}", "a", 1) for i in range(2000)] + [(7, "tok same", "a", 1)] * 1000 + [(8, "twice", "b", k % 2) for k in range(5)]
    frame = spark.createDataFrame(few, "doc_id long, text string, source string, kind int").repartition(4)
    for budget in (4000.0, None):
        planned = mixing.mix(frame, budget=budget).collect()
        blocks = defaultdict(int)
        for r in planned:
            blocks[r.source, r.epoch, r.block] += 1
        whole = [v for (source, epoch, _), v in blocks.items() if source == "a" and (budget is None and epoch == 0)]
        assert not whole or max(whole) <= 2 * sum(whole) / len(whole)
        if budget:
            assert abs(sum(r.tokens for r in planned) - budget) <= 10
        made = mixing.mixed_documents(frame, budget=budget).collect()
        assert sorted((r.doc_id, r.source) for r in made) == sorted((r.doc_id, r.source) for r in planned)
        if budget is None:
            assert {tuple(r) for r in made} == set(few)


def test_line_dedup_of_a_very_long_text(spark):
    """Half a million recurring lines are cleaned in linear time."""
    line = "this very line recurs in both documents"
    long = "\n".join([line] * 250_000 + ["only here stands a line of its own"] + [line] * 250_000)
    out = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame([(1, line), (2, long)], "doc_id long, text string")).collect()}
    assert out[1].text == line and out[1].n_dropped == 0
    assert out[2].text == "only here stands a line of its own" and out[2].n_dropped == 500_000 and out[2].n_lines == 500_001


# What steps leave on disk, and small tables in few partitions.


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


@pytest.mark.parametrize("step", [common.durable, common.stored])
def test_steps_leave_no_shuffle_files(spark, step):
    before = _shuffle_files(spark)
    base = spark.range(5000, numPartitions=7).withColumn("key", F.col("id") % 100)
    grouped = base.groupBy("key").count().hint("merge").join(base, "key").groupBy("key").agg(F.sum("count").alias("n"))
    out = step(grouped)
    for _ in range(50):  # executors are told, not waited for
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.SHUFFLES_GO, None) in (None, "false")
    # Both the result and the table it was made from can be read again.
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, grouped.collect())) == [(k, 2500) for k in range(100)]


@pytest.mark.parametrize("each", [7, 10_000])
def test_components_packed(spark, each, monkeypatch):
    """Chains, stars and a repeated link over many partitions, whether or not they fit into one."""
    monkeypatch.setattr(common, "ROWS_EACH", each)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(201, 200), (200, 201), (300, 300)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(60)).collect())
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    edges = spark.createDataFrame(links, "a long, b long").repartition(60)
    assert common.packed(edges, len(links)).rdd.getNumPartitions() == min(60, -(-len(links) // each))
