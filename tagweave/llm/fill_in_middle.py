"""Fill-in-the-middle: a text is cut at two places and its parts change places.

A text is a row of units (lines, words or characters), and both cuts lie between
units, chosen by a hash of the document's id. Where units end is a matter of two
neighbouring bytes, so a text is taken apart into chunks that overlap by one byte:
every chunk counts its boundaries and code points by itself, vectorised, prefix sums
of these counts name the chunk that owns each cut, and only the owning chunks are
looked through again for the place itself. No list of units is ever made, and no more
than one chunk is held beside the text. Python returns three numbers a text; the parts
are cut and joined by Spark's own expressions, columns of the input untouched.

Defined cases: a null text is empty; an empty text has no units and is plain; texts
that hold a marker are plain, since they couldn't be told apart again; a null id is
hashed as an empty string; rows are taken one by one, so ties, repeats and empty tables
need no rule; new columns replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.partitions import spread
from tagweave.llm.common import table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that are transformed, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7
#: Bytes of a chunk, without the one it shares with the next.
CHUNK = 1 << 16

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Whether a unit ends between two neighbouring bytes.
UNITS = {
    "line": lambda left, right: left == 10,
    "word": lambda left, right: _IS_SPACE[left] & ~_IS_SPACE[right],
    "character": lambda left, right: (right & 0xC0) != 0x80,
}


def _count(flags: np.ndarray) -> int:
    return int(np.count_nonzero(flags))


def _starts(piece: np.ndarray) -> np.ndarray:
    """Bytes that begin a code point."""
    return (piece & 0xC0) != 0x80


def _inner(text: np.ndarray, chunk: int, unit: str, size: int) -> np.ndarray:
    """Whether a unit ends behind each byte of a chunk; the text's last byte has no neighbour."""
    piece = text[chunk * size : (chunk + 1) * size + 1]
    return UNITS[unit](piece[:-1], piece[1:])


def chunk_counts(text: np.ndarray, unit: str = "line", size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and code points of every chunk."""
    chunks = range(-(-len(text) // size))
    inner = np.array([_count(_inner(text, k, unit, size)) for k in chunks], np.int64)
    chars = np.array([_count(_starts(text[k * size : (k + 1) * size])) for k in chunks], np.int64)
    return inner, chars


def cut_chars(text: np.ndarray, draws: tuple[int, int], unit: str = "line", size: int = CHUNK) -> tuple[int, int, int]:
    """Units of a UTF-8 text, and the code points before the first cut and between both."""
    if not len(text):
        return 0, 0, 0
    inner, chars = chunk_counts(text, unit, size)
    until, before = np.cumsum(inner), np.concatenate(([0], np.cumsum(chars)))
    units = int(until[-1]) + 1

    def place(rank: int) -> int:
        """Code points of the first `rank` units."""
        if rank in (0, units):
            return int(before[-1]) if rank else 0
        owner = int(np.searchsorted(until, rank))
        nth = rank - int(until[owner] - inner[owner])
        end = int(np.flatnonzero(_inner(text, owner, unit, size))[nth - 1]) + 1
        return int(before[owner]) + _count(_starts(text[owner * size : owner * size + end]))

    low, high = sorted(place(d % (units + 1)) for d in draws)
    return units, low, high - low


_CUTS = "struct<n: bigint, prefix_chars: bigint, middle_chars: bigint>"


def _cuts(unit: str):  # noqa: ANN202
    @F.arrow_udf(_CUTS)
    def cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        whole = text.cast(pa.large_string())
        _, offsets, data = whole.buffers()
        at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        draws = zip(first.to_pylist(), second.to_pylist(), strict=True)
        found = [cut_chars(held[at[i] : at[i + 1]], pair, unit) for i, pair in enumerate(draws)]
        parts = np.array(found, np.int64).reshape(len(found), 3)
        return pa.StructArray.from_arrays([pa.array(parts[:, k].copy()) for k in range(3)], ["n", "prefix_chars", "middle_chars"])

    return cuts


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 for an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "line", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code
    points; null if plain), and output, the rearranged text."""
    named = spread(docs)
    source, h = text_of(named[text]), draws(named[key], seed)
    marked = F.greatest(*(F.instr(source, m) for m in (PREFIX, SUFFIX, MIDDLE))) > 0
    plain = (source == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = named.select(
        F.struct(*(named[c] for c in docs.columns if c not in added)).alias("doc"), source.alias("source"), form.alias("form"), _cuts(unit)(source, h[0], h[1]).alias("cut")
    )
    head, body = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    whole = F.col("source")
    prefix, middle, suffix = F.substring(whole, F.lit(1), head), F.substring(whole, head + 1, body), F.substring(whole, head + body + 1, F.length(whole))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(whole)
    )
    shown = [F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")]
    return kept.select("doc.*", F.col("cut.n").alias("n"), "form", *shown, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of which an output was made."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


SQL = {
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
                   regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
            FROM documents),
        c AS (
            SELECT doc_id, text, units, len(units) AS n,
                   CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS y,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM d),
        p AS (
            SELECT *, coalesce(array_to_string(units[1:least(x, y)], ''), '') AS pre,
                   coalesce(array_to_string(units[least(x, y) + 1:greatest(x, y)], ''), '') AS mid,
                   coalesce(array_to_string(units[greatest(x, y) + 1:n], ''), '') AS suf
            FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                                WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """
}
