"""Document fingerprints by Order MinHash, with DataFrame functions only.

Tokens are runs of non-space characters, long runs cut every 16 characters and ideographs taken one by one. k
consecutive tokens form a k-mer, and the i-th occurrence of a k-mer counts as an item of its own. One random order of
the items, cut into `bins` equal ranges, serves as that many independent orders: each range keeps its `tuple_size`
least items, puts them back into text order and hashes the tuple. Two fingerprints agree in a range only if the same
k-mers were chosen and stand in the same order, which makes the likeness follow the edit distance.

Within a document the work is n log n, on arrays of longs that hold 33 bits of hash and 30 bits of position: no text that
fits a row, of 2 GB at most, has more tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import table

K = 3
TUPLE = 2
BINS = 32
POS_BITS = 30
IDEOGRAPH = "[⺀-鿿가-힣]"
LONGEST = r"\S{16}"
ROWS_A_RANGE = 200
MOST_RANGES = 65_536


def tokens(text: Column) -> Column:
    """The tokens of a text, null as empty. Spaces are put where a token ends, then the text is split at its white space,
    which takes less time than a search for each token.
    """
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), IDEOGRAPH, " $0 "), LONGEST, "$0 ")
    return F.array_remove(F.split(spaced, r"\s+"), "")


def _packed(hashed: Column, pos: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, POS_BITS + 1), POS_BITS).bitwiseOR(pos.cast("bigint").bitwiseAND(F.lit((1 << POS_BITS) - 1)))


def _hash(v: Column) -> Column:
    return F.shiftright(v, POS_BITS)


def _pos(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << POS_BITS) - 1))


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, bins: int = BINS, tuple_size: int = TUPLE) -> DataFrame:
    """df with the column out: array<bigint>, one long (range number and tuple hash) for each range that has an item.

    Null and empty texts have no items and give an empty array. A text of fewer than k tokens is one k-mer.
    """
    t, a, b, c, s, h = (f"_{out}_{x}" for x in "tabcsh")
    shift = 63 - int(math.log2(bins))
    if 1 << (63 - shift) != bins:
        raise ValueError("bins must be a power of two")
    df = df.withColumn(t, tokens(F.col(text_col)))
    starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(a, F.sort_array(F.transform(starts, lambda i: _packed(F.xxhash64(*[F.get(t, i + j) for j in range(k)]), i))))
    # the first index of the run of equal k-mers that holds i: steps of halving length, only where the k-mer repeats
    df = df.withColumn(h, F.filter(F.array(*[F.lit(1 << j) for j in range(POS_BITS, -1, -1)]), lambda step: step < F.size(a)))

    def first_of_run(v: Column, i: Column) -> Column:
        return F.aggregate(h, i, lambda at, step: F.when((at >= step) & (_hash(F.get(a, at - step)) == _hash(v)), at - step).otherwise(at))

    def occurrence(v: Column, i: Column) -> Column:
        repeats = (i > 0) & (_hash(F.get(a, i - 1)) == _hash(v))
        return F.when(repeats, i - first_of_run(v, i)).otherwise(F.lit(0))

    df = df.withColumn(b, F.sort_array(F.transform(a, lambda v, i: _packed(F.xxhash64(_hash(v), occurrence(v, i)), _pos(v)))))
    df = df.withColumn(c, F.filter(b, lambda v, i: (i < tuple_size) | (F.shiftright(F.get(b, i - tuple_size), shift) != F.shiftright(v, shift))))

    def opens(v: Column, i: Column) -> Column:
        return (i == 0) | (F.shiftright(F.get(c, i - 1), shift) != F.shiftright(v, shift))

    def tuple_of(i: Column) -> Column:
        of = F.shiftright(F.get(c, i), shift)
        own = F.filter(F.slice(c, i + 1, tuple_size), lambda v: F.shiftright(v, shift) == of)
        ordered = F.sort_array(F.transform(own, lambda v: F.struct(_pos(v).alias("p"), _hash(v).alias("h"))))
        hashed = F.xxhash64(F.transform(ordered, lambda v: v["h"]))
        return F.shiftleft(of, 32).bitwiseOR(hashed.bitwiseAND(F.lit(0xFFFFFFFF)))

    where = F.transform(c, lambda v, i: F.when(opens(v, i), i))
    df = df.withColumn(s, F.filter(where, lambda i: i.isNotNull()))
    return df.withColumn(out, F.transform(s, tuple_of)).drop(t, a, b, c, s, h)


def likeness(x: str | Column, y: str | Column) -> Column:
    """Equal tuples over the ranges that either text fills; 1 for two texts without items."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    ranges = F.size(F.array_union(F.transform(x, lambda v: F.shiftright(v, 32)), F.transform(y, lambda v: F.shiftright(v, 32))))
    return F.when(ranges == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / ranges).cast("double")


def shown(fp: str) -> Column:
    """A fingerprint as text: ten hexadecimal digits for each range that has an item."""
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")), "")


def _constants(values: list[int], kind: str = "bigint") -> Column:
    """An array of numbers as one short constant of the plan, which is read once and not for each row."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _ranges(docs: DataFrame, order: Column, spread: Column, rows: int, most: int) -> Column:
    """The number of the range of a row: ranges of about equal counts that rise with order and then with spread.

    order: a long; spread: a hash as a long, which parts the rows of an id that fills several ranges. A row finds its
    range by halving steps over the sorted marks, so the work for a row grows with the logarithm of the ranges.
    """
    n = docs.count()
    side = max(1, math.isqrt(min(most, n // rows)))
    if side == 1:
        return F.lit(0).cast("bigint")
    cuts = side * side
    found = docs.select(F.percentile_approx(order, [i / cuts for i in range(1, cuts)], 20 * cuts)).first()[0]
    times = Counter(found)
    marks = sorted(times)
    # a mark that was found m times is an id with about m ranges of rows: its rows, the first of their range, get m ranges by spread
    parts = [1, *(times[m] for m in marks)]
    first = [0, *accumulate(p if p == 1 else p + 1 for p in parts)]
    sorted_marks, steps = _constants(marks), _constants([1 << j for j in reversed(range(len(marks).bit_length()))], "int")

    def number(at: Column) -> Column:
        """at: how many marks are not above order."""
        own, many = F.get(sorted_marks, at - 1), F.get(_constants(parts), at)
        share = F.least(F.floor((spread / 2.0**64 + 0.5) * many), many - 1)
        return F.get(_constants(first), at) + F.when(many == 1, F.lit(0)).when(order == own, share).otherwise(many)

    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_marks, at + step - 1) <= order, at + step).otherwise(at), number).cast("bigint")


def edit_fingerprints(docs: DataFrame, rows_a_range: int = ROWS_A_RANGE, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Fingerprints of every text, of its edited form, and the likenesses.

    The edited text has its last quarter replaced by the start of the next document's text, by ascending doc_id; the
    last document is followed by the first. A null text is empty. Rows that repeat a doc_id follow each other in the
    order of a hash of their texts, and then of the texts; rows without a doc_id come first. Other columns are ignored. An
    empty table gives no rows.

    The next document is found by one shuffle into ranges of about equal counts, in which an id of many rows is parted by
    the hash; a copy of each range's first row goes to the range before, so no range waits for another and no task sees
    all rows.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_ord"))
    base = base.withColumn("_h", F.xxhash64("text"))
    base = base.withColumn("_range", _ranges(base, F.col("_ord"), F.col("_h"), rows_a_range, most_ranges))
    firsts = base.groupBy("_range").agg(F.min(F.struct("_ord", "_h")).alias("x")).select("_range", "x.*")  # as many rows as there are ranges
    ring = W.partitionBy(F.lit(0)).orderBy("_range")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lent = firsts.select("_ord", "_h", F.coalesce(F.lag("_range").over(ring), F.max("_range").over(whole)).alias("_before"))
    one = base.join(F.broadcast(lent), ["_ord", "_h"]).groupBy("_before").agg(F.min(F.struct("text", "_ord", "_h")).alias("x"))  # one of equal rows is enough
    borrowed = one.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "x.text", "x._ord", "x._h", F.col("_before").alias("_range"), F.lit(True).alias("_lent"))
    both = base.select("doc_id", "text", "_ord", "_h", "_range", F.lit(False).alias("_lent")).union(borrowed)
    w = W.partitionBy("_range").orderBy("_lent", "_ord", "_h", "text")
    linked = both.withColumn("_next", F.coalesce(F.lead("text").over(w), F.lit("")))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - quarter), F.substring(F.col("_next"), F.lit(1), quarter))
    linked = linked.select("doc_id", "text", "_ord", "_h", "_range", "_lent", F.when(~F.col("_lent"), edited).alias("edited"))
    made = with_fingerprint(with_fingerprint(linked, "text", "fp"), "edited", "efp")
    made = made.withColumn("nfp", F.lead("fp").over(w))
    return made.filter(~F.col("_lent")).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("fp").alias("fingerprint"), shown("efp").alias("edited_fingerprint"), likeness("fp", "efp").alias("near_edited"), likeness("fp", "nfp").alias("near_next"),
    )


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))
