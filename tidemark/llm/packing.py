"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Documents become pieces of at most `size` tokens. Partitions pack their pieces by best fit, longest first, and emit
the nearly full bins. What is left over, the underfull bins, moves up a tree: several partitions' bins come together
in one and are packed again as whole items, until one partition holds the rest or a round brings no gain. A task holds
a bounded number of items, since the number of partitions follows the number of items.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

SIZE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
ITEMS_A_TASK = 40_000
SLACK = 2
#: Words of at most 64 characters whose ids are held, about 50 MB a worker.
MOST_CACHED = 250_000
#: Texts of only these characters can be split with classes spelled out, which is several times faster.
PLAIN = r"[\t\n\v\f\r\x20-\x7e\xa0-\xff]*"
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
PLAIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 up."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenBytes(dict):
    """Token ids of a text as little-endian 32-bit numbers; a word met before is looked up.

    Words are encoded by the tokenizers library. A special token's string within a text is that special token.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import re

        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.words, self.plain, self.any = re.compile(PLAIN_SPLIT), re.compile(PLAIN), regex.compile(public_tokenizers.PATTERN)
        self.byte_letters = byte_letters()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        mapped = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.byte_letters)
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        split = self.words if self.plain.fullmatch(text) else self.any
        return b"".join(map(self.__getitem__, split.findall(text)))


@cache
def token_bytes(vocabulary: str) -> TokenBytes:
    """One encoder for all tasks of a worker process."""
    return TokenBytes(vocabulary)


def cuts(total: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole ones at the end, the rest of the division first."""
    first = total % size or min(total, size)
    return [(0, first)] + [(s, size) for s in range(first, total, size)]


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document; a null text is empty."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens = token_bytes(vocabulary)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = tokens.encode(text.as_py() or "") + end
                rows += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cuts(len(ids) // 4, size))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Bins as lists of item numbers: longest item first, each into the fullest bin that has room."""
    bins, by_gap, gaps = [], [[] for _ in range(size + 1)], 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fit = gaps >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            at = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[at].append(i)
        else:
            gap, at = size, len(bins)
            bins.append([i])
        if gap > n:
            by_gap[gap - n].append(at)
            gaps |= 1 << (gap - n)
    return bins


def pack(items: DataFrame, size: int = SIZE, items_a_task: int = ITEMS_A_TASK, slack: int = SLACK) -> DataFrame:
    """items: item (a unique long), length (1 to size). Returns item, sequence_id, offset; ids are those of items."""
    schema = "members array<bigint>, lengths array<int>, total int, done boolean"

    def run(batches):
        members, lengths = [], []
        for b in batches:
            members += b.column(0).to_pylist()
            lengths += b.column(1).to_pylist()
        totals = [sum(x) for x in lengths]
        bins = best_fit(totals, size)
        for at in range(0, len(bins), 10_000):
            part = bins[at : at + 10_000]
            full = [sum(totals[i] for i in x) for x in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[m for i in x for m in members[i]] for x in part], pa.list_(pa.int64())), pa.array([[m for i in x for m in lengths[i]] for x in part], pa.list_(pa.int32())), pa.array(full, pa.int32()), pa.array([n >= size - slack for n in full])],
                ["members", "lengths", "total", "done"],
            )

    spark = items.sparkSession
    left = items.select(F.array("item").alias("members"), F.array(F.col("length").cast("int")).alias("lengths"))
    count, ended = items.count(), []
    while True:
        parts = max(1, -(-count // items_a_task))
        made = stored(left.repartition(parts, F.col("members")[0]).mapInArrow(run, schema))
        rest = made.filter("not done")
        now = rest.count()
        if parts == 1 or now > 0.98 * count:
            ended.append(made)
            break
        ended.append(made.filter("done"))
        left, count = rest.select("members", "lengths"), now
    out = ended[0]
    for x in ended[1:]:
        out = out.union(x)
    flat = out.select(F.array_min("members").alias("sequence_id"), "lengths", F.posexplode("members").alias("at", "item"))
    offset = F.aggregate(F.slice("lengths", 1, F.col("at")), F.lit(0), lambda s, x: s + x)
    return flat.select("item", "sequence_id", offset.cast("bigint").alias("offset"))


def packed(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY, items_a_task: int = ITEMS_A_TASK) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Null and empty texts are a piece of the end id alone. Documents that repeat are packed each for itself, a null
    doc_id is kept. Other columns are ignored; an empty table gives no rows.
    """
    cut = stored(pieces(docs, size, end_id, vocabulary).withColumn("item", F.monotonically_increasing_id()))
    placed = pack(cut.filter(F.col("length") < size).select("item", "length"), size, items_a_task)
    whole = cut.filter(F.col("length") == size).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("bigint")})
    part = cut.filter(F.col("length") < size).join(placed, "item")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(cols).union(part.select(cols))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
