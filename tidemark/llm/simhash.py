"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most max_bits bits agree in at least 8 - max_bits of their eight
positional bytes. The index lists every distinct fingerprint under small sets of positional bytes, chosen so that
any pair with the guaranteed number of agreeing bytes meets in at least one list. A pair that meets is kept only if
the tally of shared positional bytes reaches the guaranteed minimum, and is then verified bit by bit. Members of a list
that grows long are listed again under one positional byte more, so that they meet only those with which the tally can
reach the minimum; the list's length decides, so keys lengthen where fingerprints crowd and as their number grows.

Only connections matter for the result, so a long list is first thinned: each member is compared with a few hubs of
its list, components are formed, and then only members of different components are compared, all of them, in blocks.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, stored, table

SHINGLE = 4
SEED = 42
MAX_BITS = 4
HUBS = 4
#: lists of more members get longer keys, and are compared in blocks of about so many
LONG = 1_024


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned 64-bit number; 0 where there is no word."""
    words = (text or b"").lower().split()  # for bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest, seed, ones = xxhash.xxh64_intdigest, SEED, np.zeros(64, np.int64)
    for at in range(0, last, 65_536):
        part = [digest(joined[s:e], seed) for s, e in zip(starts[at : min(at + 65_536, last)].tolist(), stops[at : at + 65_536].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and its fingerprint as a (signed) long. A null text has no words."""

    def run(batches):
        for b in batches:
            made = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def position_sets(matches: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any `matches` positions contain one.

    For four: Turan's construction, triples within one of three groups, or two of a group and one of the next.
    """
    if matches != 4:
        return list(combinations(range(8), min(3, matches)))
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [g for g in groups if len(g) == 3]
    for i, g in enumerate(groups):
        out += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in groups[(i + 1) % 3]]
    return out


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("bigint"))


def _keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    parts = []
    for n, positions in enumerate(sets):
        key = F.lit(n).cast("bigint")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
        parts.append(key)
    return F.array(*parts)


def _near(a: Column, b: Column, max_bits: int) -> Column:
    """Enough shared positional bytes, then few enough differing bits."""
    x = a.bitwiseXOR(b)
    shared = reduce(lambda s, i: s + (_byte(x, i) == 0).cast("int"), range(8), F.lit(0))
    return (shared >= 8 - max_bits) & (F.bit_count(x) <= max_bits)


def _longer(index: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """Each entry fp, key again under its key and every positional byte that the key does not hold."""
    held = F.element_at(F.array(*[F.lit(sum(1 << p for p in s)) for s in sets]), (F.shiftright("key", 24) + 1).cast("int"))
    new = [F.when(held.bitwiseAND(F.lit(1 << p)) == 0, F.lit(1 << 48).bitwiseOR(F.shiftleft("key", 11)).bitwiseOR(F.lit(p << 8)).bitwiseOR(_byte(F.col("fp"), p))) for p in range(8)]
    return index.select("fp", F.explode(F.array_compact(F.array(*new))).alias("key"))


def fingerprint_groups(classes: DataFrame, max_bits: int = MAX_BITS, hubs: int = HUBS, long: int = LONG) -> DataFrame:
    """classes: distinct fingerprints, column fp. Returns fp, root for every fingerprint linked with another one."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must lie between 0 and 7")
    sets = position_sets(8 - max_bits)
    hub = [F.min("fp"), F.max("fp"), *(F.min_by("fp", F.xxhash64("fp", F.lit(i))) for i in range(hubs - 2))]

    def lists(index: DataFrame) -> DataFrame:
        return index.groupBy("key").agg(F.array(*hub).alias("hubs"), F.count(F.lit(1)).alias("n")).filter("n > 1")

    index = classes.select("fp", F.explode(_keys(F.col("fp"), sets)).alias("key"))
    dense = index.join(lists(index), "key")
    if len(sets[0]) < 8 - max_bits:
        dense = stored(dense)
        again = _longer(dense.filter(F.col("n") > long), sets)
        dense = dense.filter(F.col("n") <= long).unionByName(again.join(lists(again), "key"))
    dense = stored(dense.select("fp", "key", "hubs"))
    star = dense.select("fp", F.explode(F.array_distinct("hubs")).alias("hub")).filter("fp <> hub").filter(_near(F.col("fp"), F.col("hub"), max_bits))
    first = stored(components(star.select(F.col("hub").alias("a"), F.col("fp").alias("b"))))
    held = dense.select("key", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / long).alias("parts")).filter("lo <> hi")
    rest = stored(held.join(mixed.select("key", "parts"), "key").withColumn("own", F.pmod(F.xxhash64("fp"), "parts")))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    one = rest.select("key", F.col("own").alias("a"), each.alias("b"), "fp", "comp")
    other = rest.select("key", each.alias("a"), F.col("own").alias("b"), F.col("fp").alias("fp2"), F.col("comp").alias("comp2"))
    late = one.join(other, ["key", "a", "b"]).filter("comp < comp2").filter(_near(F.col("fp"), F.col("fp2"), max_bits))
    second = components(late.select(F.col("comp").alias("a"), F.col("comp2").alias("b")))
    roots = first.select("node", "root").union(second.select("node", F.col("node").alias("root"))).distinct()
    moved = roots.join(second.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return moved.groupBy("node").agg(F.min(F.coalesce("to", "root")).alias("root")).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that a chain of links reaches.

    Null and empty texts have the fingerprint 0 and link as any other. Repeated ids keep a row each. A null id never
    names a component unless all ids of the component are null. An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col))
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    groups = fingerprint_groups(classes.select("fp"), max_bits)
    linked = classes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("size")).filter("size > 1")
    named = linked.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the documents whose group has one with a smaller doc_id; every column is kept.

    One row of each group stays: that with the least doc_id (null last), then the least hash of its text. Rows that
    share a doc_id, or have none, are told apart by their texts and stay where nothing links them.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash")).alias("_key")
    kept = near_duplicates(docs.select(key, "text"), max_bits, "_key").filter("doc_id <=> component_id").select(F.col("doc_id").alias("_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key)
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
