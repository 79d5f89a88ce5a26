"""URL filter: a rule list, and gradient-boosted trees for what no rule covers.

A rule is a host and a path; it fits that host and its subdomains where the url's
path starts with the rule's, and the longest rule that fits decides. All other urls
are scored by trees over lexical features: lengths, depth, digit ratio, entropy,
parameter counts, and statistics of the host's suffix and first folder. The trees
learn from labelled urls. Without a label table, urls are labelled by seed terms: a
host that has one of `SEED_TERMS` as a whole word counts as unwanted, all other hosts as
wanted. The rules are no labels: that a folder is blocked says nothing of other hosts.

A bounded sample of different urls is used, for each label the `TRAIN_ROWS` / 2 smallest
by a seeded hash of the url, so neither partitioning nor a url that repeats changes it.
Both labels weigh the same in training; a block needs a score over `BLOCK_FROM`. A url
further outside the range of the learned features than that range is wide is allowed.

Defined cases: a null url or one without `://` has an empty host and path, no rule,
and is scored like any other; repeated urls get equal verdicts; without any labelled
url the score is 0.5 and the verdict allow; of fitting rules equally long the one
with the longer host, then the smaller text, wins; very long urls are scored whole;
other columns of pages don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import gbdt
from tagweave.llm.common import bounded_sample, table

#: (host and path, verdict) in the contract's order.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Words of a host that mark unwanted sites (gambling, drugs, adult, advertising), for
#: labels where there is no table of them.
SEED_TERMS = ("casino", "poker", "bets", "pills", "viagra", "adult", "porn", "xxx", "ads", "track", "spam")
#: Largest number of labelled urls that the trees learn from.
TRAIN_ROWS = 20_000
#: Suffix statistics are kept for this many hashed suffixes at most.
SUFFIX_SLOTS = 4096
#: Both labels weigh the same in training, though few urls are unwanted; a block needs clear evidence.
BLOCK_FROM = 0.95
SEED = 7


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after.substr(F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The winning rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    split = [(rule, rule.partition("/")[0], "/" + rule.partition("/")[2], what) for rule, what in rules]
    # The last `when` wrapped around the others is tried first: weakest rules go in first.
    for rule, rule_host, rule_path, what in sorted(split, key=lambda x: (len(x[0]), len(x[1]), [-ord(c) for c in x[0]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def _suffixes(host: str, path: str) -> tuple[str, str, str]:
    top = host.rpartition(".")[2]
    return top, ".".join(host.split(".")[-2:]), top + "/" + path.lstrip("/").partition("/")[0]


def _slot(suffix: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(suffix, SEED) % SUFFIX_SLOTS


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0] if "?" in url else ""
    labels = host.split(".") if host else []
    longest = max(map(len, labels), default=0)
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(query), len(labels), path.count("/"), longest,
        digits / max(1, len(url)), sum(c.isdigit() for c in host), host.count("-"),
        _entropy(host), _entropy(path), query.count("=") , query.count("&"), float("#" in url),
        float(url.startswith("https")), url.count("%"), sum(c.isupper() for c in path),
        len(path.rpartition(".")[2]) if "." in path else 0,
    ]


def _features(frame: pd.DataFrame, stats: np.ndarray) -> np.ndarray:
    rows = [
        lexical(u, h, p) + [stats[_slot(s)] for s in _suffixes(h, p)]
        for u, h, p in zip(frame["url"], frame["host"], frame["path"], strict=True)
    ]
    return np.array(rows, dtype=np.float64).reshape(len(rows), 22)


def train(labelled: pd.DataFrame) -> tuple[gbdt.Trees, np.ndarray]:
    """From url, host, path and block (0 or 1). A row's own label is taken out of
    the suffix statistics that it is trained with."""
    prior = 0.5
    hits, seen = np.zeros(SUFFIX_SLOTS), np.zeros(SUFFIX_SLOTS)
    slots = np.array([[_slot(s) for s in _suffixes(h, p)] for h, p in zip(labelled["host"], labelled["path"], strict=True)], np.int64).reshape(-1, 3)
    y = labelled["block"].to_numpy(np.float64)
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) if len(y) else y
    for k in range(3):
        np.add.at(hits, slots[:, k], weight * y)
        np.add.at(seen, slots[:, k], weight)

    def share(blocked: np.ndarray, all_: np.ndarray) -> np.ndarray:
        """A suffix that was seen under one label only says nothing."""
        both = (blocked > 1e-9) & (all_ - blocked > 1e-9)
        return np.where(both, (blocked + 2 * prior) / (all_ + 2), prior)

    stats = share(hits, seen)
    x = _features(labelled, stats)
    if len(labelled):
        own = weight[:, None]
        x[:, -3:] = share(hits[slots] - own * y[:, None], seen[slots] - own)
    # Each row also counts once as if its suffixes were new: for those the lexical features must do.
    unseen = x.copy()
    unseen[:, -3:] = prior
    both = gbdt.fit(np.vstack([x, unseen]), np.tile(y, 2), rounds=60, depth=4, weight=np.tile(weight, 2) / 2)
    return both, stats


def seed_label(host: Column, terms: tuple[str, ...] = SEED_TERMS) -> Column:
    """1 if the host has one of the terms as a whole word, else 0."""
    return host.rlike(rf"(^|[.-])({'|'.join(terms)})([.-]|$)").cast("int")


def training_sample(known: DataFrame, train_rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """Different rows of known (url, host, path, block), half of train_rows for each label
    at most; a url under both labels counts as both."""
    halves = [bounded_sample(known.where(F.col("block") == label), ["url"], train_rows // 2, SEED).toPandas() for label in (0, 1)]
    return pd.concat(halves).sort_values(["url", "block"], ignore_index=True)


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    key: str = "page_id",
    rules: tuple[tuple[str, str], ...] = RULES,
    labels: DataFrame | None = None,
    train_rows: int = TRAIN_ROWS,
    terms: tuple[str, ...] = SEED_TERMS,
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score (of being unwanted).

    labels: optional (url, block 0/1); else the seed terms label the urls of pages.
    """
    host, path = host_and_path(F.col("url"))
    parted = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path")
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parted.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if labels is None:
        known = parted.where("host <> ''").select("url", "host", "path", seed_label(F.col("host"), terms).alias("block"))
    else:
        known = labels.where("url IS NOT NULL AND block IS NOT NULL").select(F.col("url").cast("string").alias("url"), F.col("block").cast("int").alias("block")).select("url", host.alias("host"), path.alias("path"), "block")
    sample = training_sample(known, train_rows)
    trees, stats = train(sample)
    seen = _features(sample, stats)
    low, high = (seen.min(0), seen.max(0)) if len(seen) else (np.zeros(22), np.zeros(22))
    width = np.maximum(high - low, 1.0)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _features(frame, stats)
            by_trees = trees.score(x)
            like = ((x >= low - width) & (x <= high + width)).all(1)
            ruled = frame.pop("ruled")
            frame["verdict"] = ruled.where(ruled.notna(), np.where(like & (by_trees > BLOCK_FROM), "block", "allow"))
            frame["score"] = by_trees
            yield frame

    return ruled.mapInPandas(score, "page_id long, url string, host string, path string, rule string, verdict string, score double")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
