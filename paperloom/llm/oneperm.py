"""Document fingerprints: one-permutation MinHash with optimal densification, in b-bit form.

Everything here is a Column expression or a DataFrame operation; no Python runs on
the executors. For each text:

1. Words are hashed once, shingles of ``WORDS`` words are hashed from their words'
   hashes (fewer words: the whole sequence is one shingle).
2. The hashes are binned once: their highest bits name one of ``BINS`` bins and the
   smallest hash of each bin stands for it. Sorting the hashes together with one
   largest value for each bin puts every bin's minimum first in its run, so one pass
   over the sorted array gives all bins in order; a bin whose minimum is that largest
   value is empty.
3. An empty bin borrows from a bin that it names by hashing itself with the number of
   the attempt, as optimal densification does: all empty bins choose independently,
   and every document alike. After ``ATTEMPTS`` bins that are empty as well, the
   filled bin with the smallest hash of both bins' numbers is taken, which is an
   equally uniform choice and always ends.
4. The lowest ``BITS`` bits of each bin are packed into longs.

Two fingerprints agree in a bin with probability ``C + (1 - C) J``, where J is the
resemblance of the shingle sets and C = 2 ** -BITS what unequal values agree in by
chance; ``likeness`` inverts that and stays in 0 to 1. Its standard error is at most
0.034 with 256 bins of four bits.

Nulls count as empty texts. A text without a word has the empty fingerprint, which is
like itself (1) and like no other (0). Equal texts have equal fingerprints; longer
ones take time in proportion. Other columns of a table are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import ids_and_texts

#: Words of a shingle.
WORDS = 5
#: Bins, a power of two, and the bits kept of each, a divisor of 64.
BINS, BITS = 256, 4
#: Bins that an empty one asks in turn before it picks among the filled ones.
ATTEMPTS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, words: int = WORDS) -> Column:
    """Array of a long for each shingle, repeats included; empty without a word."""
    each = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda k: F.xxhash64(*(h[k + j] for j in range(words))))
    none = F.array().cast("array<bigint>")
    return _let(each, lambda h: F.when(F.size(h) >= words, runs(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none))


def _bins(hashes: Column, bins: int) -> Column:
    """The smallest hash of each bin in order; all lower bits are set in an empty one."""
    width = 65 - bins.bit_length()
    ends = F.array(*(F.lit(((k + 1) << width) - 1) for k in range(-bins // 2, bins // 2)))
    first = lambda s: F.filter(s, lambda x, k: (k == 0) | (F.shiftright(x, width) != F.shiftright(s[k - 1], width)))
    return _let(F.sort_array(F.concat(hashes, ends)), first)


def _densified(least: Column, bins: int, bits: int) -> Column:
    """The lowest bits of every bin, those of empty ones borrowed."""
    width = 65 - bins.bit_length()
    rest = (1 << width) - 1
    filled = lambda x: x.bitwiseAND(F.lit(rest)) != rest
    low = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))

    def borrowed(d: Column, full: Column, k: Column) -> Column:
        asked = [d[F.xxhash64(k, F.lit(t)).bitwiseAND(F.lit(bins - 1)).cast("int")] for t in range(ATTEMPTS)]
        picked = F.array_min(F.transform(full, lambda y: F.struct(F.xxhash64(k, F.shiftright(y, width)).alias("place"), low(y).alias("value"))))["value"]
        return F.coalesce(*(F.when(filled(y), low(y)) for y in asked), picked)

    return _let(least, lambda d: _let(F.filter(d, filled), lambda full: F.transform(d, lambda x, k: F.when(filled(x), low(x)).otherwise(borrowed(d, full, k)))))


def fingerprint(text: Column, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> Column:
    """Packed fingerprint of a text: an array of ``bins * bits / 64`` longs, empty without a word."""
    if bins & (bins - 1) or 64 % bits or bins * bits % 64 or not 64 / bits <= bins <= 1 << 16:
        raise ValueError("bins must be a power of two and fill whole longs with bits that divide 64")
    each = 64 // bits
    packed = lambda v: F.transform(F.sequence(F.lit(0), F.lit(bins // each - 1)), lambda w: F.aggregate(F.slice(v, w * each + 1, each), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, bits).bitwiseOR(x)))
    return _let(shingles(text, words), lambda h: F.when(F.size(h) == 0, h).otherwise(_let(_densified(_bins(h, bins), bins, bits), packed)))


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimate of the resemblance of two texts' shingle sets from their packed fingerprints."""
    lowest = sum(1 << k for k in range(0, 64, bits))
    lowest -= (lowest >> 63) << 64

    def apart(x: Column, y: Column) -> Column:
        def fields(z: Column) -> Column:
            any_bit = z
            for k in range(1, bits):
                any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(z, k))
            return F.bit_count(any_bit.bitwiseAND(F.lit(lowest)))

        return _let(x.bitwiseXOR(y), fields)

    differ = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda total, x: total + x)
    chance = 2.0**-bits
    estimate = F.greatest(F.lit(0.0), (1.0 - differ / F.lit(float(bins)) - chance) / (1.0 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, text, packed) for every row; repeated rows and null ids stay as they are."""
    return ids_and_texts(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("packed", fingerprint(F.col("text"), words, bins, bits))


def _numbered(split: list[int], value: Column) -> Column:
    """How many of the descending splits are above ``value``: a lookup in two steps of about sqrt(len(split)) compares."""
    if not split:
        return F.lit(0)
    step = int(len(split) ** 0.5) + 1
    heads, table = F.array(*map(F.lit, split[::step])), F.array(*map(F.lit, split))
    above = lambda a: F.size(F.filter(a, lambda s: value < s))
    return _let(above(heads), lambda n: F.when(n == 0, 0).otherwise((n - 1) * step + above(F.slice(table, (n - 1) * step + 1, step))))


def with_next(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """Each row of (doc_id, text, packed) with the next one's text and fingerprint, the last one with the first's.

    Rows stand in descending order of (doc_id, ``key``), rows without an id last. No
    task sees them all: quantiles of the ids cut the order into ``parts``, each part
    gets the first row of the part after it as a guest, and a window within each part
    does the rest, so a text is shuffled once. Rows that are equal in both keys
    stand next to each other in any order.
    """
    source = df.select("doc_id", key.alias("tie"))
    cuts = source.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts + 1000)).first()[0]
    split = sorted({int(x) for x in cuts or []}, reverse=True)
    part = F.when(F.col("doc_id").isNull(), len(split) + 1).otherwise(_numbered(split, F.col("doc_id")))
    # One row for each part: its first document.
    firsts = sorted(source.groupBy(part.alias("part")).agg(F.max(F.struct("doc_id", "tie")).alias("first")).collect(), key=lambda r: r.part)
    if not firsts:
        return df.select("*", F.lit(None).cast("string").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_packed"))
    before, ids, ties = [0] * (len(split) + 2), [None] * (len(split) + 2), [0] * (len(split) + 2)
    for a, b in pairwise([*firsts, firsts[0]]):
        before[b.part], ids[b.part], ties[b.part] = a.part, b.first.doc_id, b.first.tie
    table = lambda values, kind: F.array(*(F.lit(x).cast(kind) for x in values))
    placed = df.withColumns({"tie": key, "part": part})
    leads = F.col("doc_id").eqNullSafe(table(ids, "bigint")[F.col("part")]) & (F.col("tie") == table(ties, "bigint")[F.col("part")])
    at = F.when(leads, F.array(F.col("part"), table(before, "int")[F.col("part")])).otherwise(F.array("part"))
    dealt = placed.select("doc_id", "text", "packed", "tie", F.posexplode(at).alias("guest", "at"))
    order = Window.partitionBy("at").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return dealt.withColumns({"next_text": F.lead("text").over(order), "next_packed": F.lead("packed").over(order)}).where("guest = 0").drop("tie", "guest", "at")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last half (rounded down) of the code points replaced by
    the first as many, or all, of the next document in descending order of ids. Nulls
    count as empty; the only row of a table is its own next one; an empty table gives
    an empty result; rows with one id follow each other by a hash of their texts.
    """
    spark = df.sparkSession
    parts = 3 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(fingerprints(df, id_col, text_col), F.xxhash64(F.coalesce("text", F.lit(""))), parts)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    made = edited.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "packed", "next_packed", fingerprint(F.col("edited")).alias("edited_packed"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("packed")).alias("fingerprint"),
        as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
