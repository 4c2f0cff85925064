"""Line deduplication by an exact set-similarity join.

A line is the set of its words, put in order of their rarity in the corpus. Two sets x and y with a Jaccard similarity
of at least the threshold t share at least t / (1 + t) (|x| + |y|) words. The index lists a line under its prefix:

- rare words, those whose group occurs at most RARE times: under each of the first n - ceil(t n) + 1 words. Such a list
  has at most RARE lines, so their pairs grow as the input does.
- where a line has fewer rare words than a partner may lack: under pairs of adjacent words after the rare ones. A word
  of x that y lacks breaks two such pairs, a word of y alone breaks one, and a partner lacks all rare words that are not
  shared; of the first 2 (n - t n) + 1 - 2 rare pairs one is left whole in both lines.

Lines that meet must pass the filters on length, on position (the words of x before a first shared word are not in y,
nor those of y in x, and both count against what they may differ by) and on parity (a signature that bounds how many
words differ from below). What is left is verified on the words. A line goes if an earlier line, by doc_id and line
number, is equal as a set or similar enough.

Lines that are equal as sets are one class, met by grouping; a class is named by a 64-bit hash of its set and a 64-bit
parity. A line with few partners in a list gives all of them; one with many gives the nearest earlier ones and is
noted as open there, and so are all lines of a very long list. Open lines that no verified pair accounts for meet
the whole list at the end, so that groups of near-equal lines do not give all their pairs, and no list is held in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored, table, tidy
from tidemark.llm.word_sets import HASH_BITS, LINE_BITS, RANK_BITS, Sets, mixed, ordered_sets, text_lines, within

THRESHOLD = 0.8
#: Below it a short line can have too few adjacent words for the index.
LEAST_THRESHOLD = 0.7
MIN_WORDS = 5
#: The query and the pipeline compare every line that has a word.
EVERY_LINE = 1
RARE = 128
COUNT_BLOCKS = 64
KEY_BITS, POS_BITS = 40, 23
MOST_NOTED = 100_000
#: Lines of more words also compare the halves of their parity.
SHORT_LINE = 64
#: Postings for each bucket of lists, and of a bucket that a task holds before it sets long lists aside.
BUCKET, HOLD = 250_000, 3_000_000
#: A list of more lines is compared with its first lines only, in the first round.
LONG_LIST, FIRST_LINES = 1_024, 64
#: So many open lines of a list meet the whole list in one group.
BLOCK = 1_024
#: So many pairs of short lists, or those of one list, are tested and held at once.
MOST_TESTED = 1_000_000
#: A line with more partners in a list is open there, and gives the nearest of the earlier ones and the first one.
MOST_PARTNERS, NEAREST = 4, 4
U = np.uint64
CLASS = ["sid", "par"]


@dataclass
class Ranks:
    """A rank for each of 2 ** RANK_BITS groups of words, by how often their words occur in all texts.

    Groups below `single` occur once, so that their word is in one line only; groups below `rare` at most RARE times.
    """

    rank: np.ndarray
    single: int
    rare: int


def rarity(docs: DataFrame) -> Ranks:
    """The ranks of all words of docs. A task sends its counts as arrays, in blocks of groups."""
    size = 1 << RANK_BITS
    schema = "block int, at array<int>, n array<bigint>"

    def rows(sums: np.ndarray, blocks) -> pa.RecordBatch:
        cut = sums.reshape(COUNT_BLOCKS, -1)
        at = [np.flatnonzero(cut[b]) for b in blocks]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([cut[b][x] for b, x in zip(blocks, at)], pa.list_(pa.int64()))],
            ["block", "at", "n"],
        )

    def count(batches):
        sums, held, many = np.zeros(size, np.int64), [], 0
        for b in batches:
            for lines in text_lines(t.as_py() for t in b.column(0)):
                held.append((lines.word & U(size - 1)).astype(np.int32))
                many += len(held[-1])
                if many > size:
                    sums += np.bincount(np.concatenate(held), minlength=size)
                    held, many = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=size)
        yield rows(sums, range(COUNT_BLOCKS))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, at, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                sums.setdefault(block, np.zeros(size // COUNT_BLOCKS, np.int64))[at.values.to_numpy()] += n.values.to_numpy()
        for block, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([x[at]], pa.list_(pa.int64()))], ["block", "at", "n"])

    counts = docs.select(F.col("text").cast("binary")).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    with tidy(docs.sparkSession):
        got = counts.toArrow()  # at most COUNT_BLOCKS rows, with 2 ** RANK_BITS numbers in all
    total = np.zeros((COUNT_BLOCKS, size // COUNT_BLOCKS), np.int64)
    for block, at, n in zip(got.column("block").to_pylist(), got.column("at"), got.column("n")):
        total[block][at.values.to_numpy()] = n.values.to_numpy()
    total = total.ravel()
    rank = np.empty(size, np.int32)
    rank[np.argsort(total, kind="stable")] = np.arange(size, dtype=np.int32)
    return Ranks(rank, int((total <= 1).sum()), int((total <= RARE).sum()))


def most_missing(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many words of a line of n words a partner may lack."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64)


def most_apart(n: np.ndarray, threshold: float) -> np.ndarray:
    """In how many words two lines may differ that have n words together, each line's repeats left out."""
    return n - 2 * np.ceil(threshold / (1 + threshold) * n - 1e-9).astype(np.int64)


def adjacent_pairs(n: np.ndarray, rare: np.ndarray, threshold: float) -> np.ndarray:
    """Of how many pairs of adjacent frequent words at least one is whole in any partner that shares no rare word."""
    return np.floor(2 * (1 - threshold) * n + 1e-9).astype(np.int64) + 1 - 2 * rare


def signatures(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: a hash, the parity of its tokens' bits, and that of half of its tokens (0 for a short line)."""
    m = mixed(sets.token)
    bit, half = U(1) << (m >> U(58)), (m >> U(57) & U(1)).astype(bool)
    part = np.bitwise_xor.reduceat(np.where(half, bit, U(0)), sets.start)
    return np.add.reduceat(m, sets.start), np.bitwise_xor.reduceat(bit, sets.start), np.where(sets.size > SHORT_LINE, part, U(0))


def prefix_keys(sets: Sets, ranks: Ranks, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which each set is listed, and how many it has.

    A key is KEY_BITS of hash and then a position: the place of a rare word, or how many rare words a line has that is
    listed under a pair of frequent ones. A set so small that one more word takes it below the threshold matches only
    its equals, which grouping brings together; it has no keys.
    """
    token, start, n = sets
    line, place = np.repeat(np.arange(len(n)), n), within(n)
    rank = token >> U(HASH_BITS)
    rare = rank < U(ranks.rare)
    own = np.add.reduceat(rare.astype(np.int64), start)
    missing, paired = most_missing(n, threshold), n >= threshold * (n + 1) - 1e-9
    alone = np.flatnonzero(rare & (rank >= U(ranks.single)) & (place <= missing[line]) & paired[line])
    pairs = np.where(paired & (own <= missing), np.minimum(adjacent_pairs(n, own, threshold), n - own - 1), 0)
    at = np.repeat(start + own, pairs) + within(pairs)
    hashed = np.concatenate((mixed(token[alone]), mixed(token[at] * U(0x9E3779B97F4A7C15) + token[at + 1] if len(at) else token[at])))
    most = (1 << POS_BITS) - 1
    position = np.minimum(np.concatenate((place[alone], np.repeat(own, pairs))), most)  # less only lets more pass
    keys = (hashed >> U(64 - KEY_BITS)).astype(np.int64) << POS_BITS | position
    single = np.bincount(line[alone], minlength=len(n))
    count = single + pairs
    out, begin = np.empty(len(keys), np.int64), np.cumsum(count) - count
    out[np.repeat(begin, single) + within(single)] = keys[: len(alone)]
    out[np.repeat(begin + single, pairs) + within(pairs)] = keys[len(alone) :]
    return out, count


def line_rows(docs: DataFrame, ranks: Ranks, threshold: float, min_words: int) -> DataFrame:
    """doc_id, k, line, sid, par, half, n and keys of every line of at least min_words words.

    sid and par name the line's class. A task gives the keys of equal sets once, as the bytes of 64-bit numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        noted: set[bytes] = set()
        for b in batches:
            for lines in text_lines(t.as_py() for t in b.column(2)):
                whole = np.flatnonzero(lines.count >= max(1, min_words))
                word = lines.word[np.repeat(lines.count >= max(1, min_words), lines.count)]
                ends = np.concatenate(([0], np.cumsum(lines.count[whole])))
                for at in range(0, len(whole), 1 << LINE_BITS):
                    some = whole[at : at + (1 << LINE_BITS)]
                    sets = ordered_sets(lines.count[some], word[ends[at] : ends[at + len(some)]], ranks.rank)
                    yield rows(b, lines.text[some], lines.number[some], sets, noted)

    def rows(b, text, number, sets, noted):
        sid, par, half = signatures(sets)
        keys, count = prefix_keys(sets, ranks, threshold)
        names = np.stack((sid, par), axis=1).tobytes()
        new = np.zeros(len(sid), bool)
        for i in np.flatnonzero(count).tolist():
            name = names[16 * i : 16 * i + 16]
            if name not in noted:
                new[i] = True
                if len(noted) < MOST_NOTED:
                    noted.add(name)
        keys, count = keys[np.repeat(new, count)], np.where(new, count, 0)
        ends = np.concatenate(([0], np.cumsum(8 * count))).astype(np.int32)
        listed = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(keys)])
        at = pa.array(text)
        longs = [pa.array(x.view(np.int64)) for x in (sid, par, half)]
        arrays = [b.column(0).take(at), b.column(1).take(at), pa.array(number.astype(np.int32)), *longs, pa.array(sets.size.astype(np.int32)), listed]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "k", "line", "sid", "par", "half", "n", "keys"])

    return docs.select("doc_id", "k", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, k bigint, line int, sid bigint, par bigint, half bigint, n int, keys binary")


#: id hints at the order of the lines; at holds a line's words and its position under the key.
POSTING = ["key", "sid", "par", "half", "id", "at"]
KEY, SID, PAR, HALF, ID, AT = range(6)


def _listed(lines: DataFrame) -> DataFrame:
    """keys, sid, par, half, id, n of the lines that have keys."""
    whole = lines.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    hint = F.col("doc_id").cast("bigint") if whole else F.conv(F.hex(F.substring(F.encode(F.col("doc_id").cast("string"), "UTF-8"), 1, 7)), 16, 10).cast("bigint")
    return lines.filter(F.octet_length("keys") > 0).select("keys", *CLASS, "half", F.coalesce(hint, F.lit(-1 << 62)).alias("id"), F.col("n").cast("bigint").alias("n"))


def _flat(b: pa.RecordBatch) -> np.ndarray:
    """The postings (rows of POSTING) of a batch of _listed()."""
    lists = b.column(0)
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset :][: len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
    line = np.repeat(np.arange(len(lists)), np.diff(ends) // 8)
    key = np.frombuffer(lists.buffers()[2] or b"", np.int64, len(line), ends[0])
    sid, par, half, id, n = (c.to_numpy()[line] for c in b.columns[1:])
    return np.stack((key >> POS_BITS, sid, par, half, id, n << POS_BITS | key & ((1 << POS_BITS) - 1)))


def squeezed(rows: np.ndarray) -> bytes:
    """Rows of POSTING in few bytes.

    Hashes are sent as they are, and half only where it is not 0. Compressed are the rest of the key, the steps of the
    ids, which mostly ascend, and at, the bytes of one place together.
    """
    long = rows[HALF] != 0
    steps = np.stack((np.diff(rows[ID], prepend=0), rows[AT]))
    places = steps.view(np.uint8).reshape(*steps.shape, 8).transpose(0, 2, 1).copy()
    small = b"".join(((rows[KEY] >> 32).astype(np.uint8).tobytes(), long.tobytes(), places.tobytes()))
    own = (long.sum(), rows[KEY].astype(np.uint32), rows[SID], rows[PAR], rows[HALF, long])
    return b"".join((*(x.tobytes() for x in own), pa.Codec("zstd", compression_level=1).compress(small, asbytes=True)))


def expanded(data: pa.Buffer, n: int) -> np.ndarray:
    """What squeezed() was given: n columns."""
    rows, m = np.zeros((len(POSTING), n), np.int64), np.frombuffer(data, np.int64, 1)[0]
    small = pa.Codec("zstd").decompress(data[8 + 20 * n + 8 * m :], 18 * n)
    rows[KEY] = np.frombuffer(small, np.uint8, n)
    rows[KEY] <<= 32
    rows[KEY] |= np.frombuffer(data, np.uint32, n, 8)
    rows[SID : PAR + 1] = np.frombuffer(data, np.int64, 2 * n, 8 + 4 * n).reshape(2, n)
    rows[HALF, np.frombuffer(small, bool, n, n)] = np.frombuffer(data, np.int64, m, 8 + 20 * n)
    steps = np.frombuffer(small, np.uint8, 16 * n, 2 * n).reshape(2, 8, n)
    rows[ID : AT + 1] = steps.transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]
    rows[ID] = np.cumsum(rows[ID])
    return rows


def partners(lines: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes that pass the filters (key null), and the classes that are open (with the list's key).

    Columns key, sid, par, sid2, par2. A pair is missing only if each of its lines is open in every list where they
    meet and pass. A task sends its postings as bytes, one row for each bucket of lists.
    """
    listed = _listed(lines)
    with tidy(lines.sparkSession):
        total = listed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = 1 + total // 8 // BUCKET

    def pack(batches):
        held, many = [], 0
        for b in batches:
            held.append(_flat(b))
            many += held[-1].shape[1]
            if many > BUCKET:
                yield packed(np.concatenate(held, axis=1))
                held, many = [], 0
        if many:
            yield packed(np.concatenate(held, axis=1))

    def packed(rows):
        bucket = rows[KEY] % buckets
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[:, order]
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        many = np.diff(np.append(start, len(bucket)))
        data = [squeezed(rows[:, i : i + n]) for i, n in zip(start.tolist(), many.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array(many), pa.array(data, pa.binary())], ["bucket", "n", "data"])

    def meet(batches):
        now, lists = None, None
        for b in batches:
            for bucket, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if bucket != now:
                    if lists is not None:
                        yield from lists.end()
                    now, lists = bucket, Lists(threshold)
                yield from lists.add(expanded(data.as_buffer(), n))
        if lists is not None:
            yield from lists.end()

    dealt = listed.mapInArrow(pack, "bucket bigint, n bigint, data binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "key bigint, sid bigint, par bigint, sid2 bigint, par2 bigint")


class Lists:
    """The lists of one bucket, which come in any order: rows of POSTING."""

    def __init__(self, threshold: float):
        self.threshold, self.rows, self.many = threshold, [], 0
        self.first: dict[int, np.ndarray] = {}  # the first lines of long lists, whose other lines are not held
        self.hold = HOLD

    def add(self, rows: np.ndarray):
        self.rows.append(rows)
        self.many += rows.shape[1]
        if self.many > self.hold:
            rows, start, length = self.lists(single=True)  # a list of one class may go on
            long = length > LONG_LIST
            yield from self.long_lists(rows, start[long], length[long])
            self.rows = [rows[:, np.repeat(~long, length)]]
            self.many = self.rows[0].shape[1]
            self.hold = max(HOLD, 2 * self.many)  # short lists stay

    def lists(self, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows by key, each class once a list but for rare repeats; where lists begin, and their lengths.

        Lists of one row are left out, unless single is set.
        """
        rows = np.concatenate(self.rows, axis=1) if self.rows else np.zeros((len(POSTING), 0), np.int64)
        order = np.argsort(rows[KEY] << (63 - KEY_BITS) | rows[SID] & ((1 << 63 - KEY_BITS) - 1))
        key = rows[KEY][order]
        if not single:
            again = np.concatenate(([False], key[1:] == key[:-1]))[: len(key)]
            order = order[again | np.append(again[1:], False)[: len(key)] | (np.isin(key, list(self.first)) if self.first else False)]
        rows = rows[:, order]
        same = (rows[:3, 1:] == rows[:3, :-1]).all(axis=0)
        rows = rows[:, np.concatenate(([True], ~same))[: rows.shape[1]]]
        start = np.flatnonzero(np.concatenate(([True], rows[KEY, 1:] != rows[KEY, :-1]))[: rows.shape[1]])
        return rows, start, np.diff(np.append(start, rows.shape[1]))

    def end(self):
        rows, start, length = self.lists()
        long = length > LONG_LIST
        if self.first:
            long |= np.isin(rows[KEY, start], list(self.first))
        yield from self.long_lists(rows, start[long], length[long])
        short = ~long & (length > 1)
        rows, length = rows[:, np.repeat(short, length)], length[short]
        step = np.cumsum(length * (length - 1) // 2) // MOST_TESTED
        cuts = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1]))[: len(step)])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(length)]):
            at = int(length[:a].sum())
            yield from self.short_lists(rows[:, at : at + int(length[a:b].sum())], length[a:b])

    def short_lists(self, rows, length):
        end = np.repeat(np.cumsum(length), length)
        n, pos = rows[AT] >> POS_BITS, rows[AT] & ((1 << POS_BITS) - 1)
        apart_of = most_apart(np.arange(2 * n.max() + 1), self.threshold) if n.max() < 1 << 20 else None
        index, got = np.arange(len(end)), []
        after = end - index  # rows of the list from there on
        for d in range(1, length.max()):
            more = after > d
            index, after = index[more], after[more]
            got.append(self.passing(rows, n, pos, index, index + d, apart_of))
        i, j, apart = (np.concatenate(x) for x in zip(*got))
        other = (rows[SID : PAR + 1, i] != rows[SID : PAR + 1, j]).any(axis=0)  # a repeat is no partner of its class
        i, j, apart = i[other], j[other], apart[other]
        many = np.bincount(np.concatenate((i, j)), minlength=rows.shape[1]) > MOST_PARTNERS
        give = ~(many[i] & many[j])
        if many.any():
            x, y, e = np.concatenate((i, j)), np.concatenate((j, i)), np.tile(np.arange(len(i)), 2)
            ahead = many[x] & (rows[ID, y] <= rows[ID, x])
            x, y, e = x[ahead], y[ahead], e[ahead]
            give[e[_among_first(x, apart[e], NEAREST)]] = True
            give[e[_among_first(x, rows[ID, y], 1)]] = True
            yield _rows(rows[KEY, many], rows[SID : PAR + 1, many], rows[SID : PAR + 1, many])
        yield _rows(None, rows[SID : PAR + 1, i[give]], rows[SID : PAR + 1, j[give]])

    def passing(self, rows, n, pos, i, j, apart_of=None):
        """Which rows i and j pass the filters, and how many words differ at least."""
        par, half = rows[PAR], rows[HALF]
        together = n[i] + n[j]
        most = most_apart(together, self.threshold) if apart_of is None else apart_of[together]
        both = par[i] ^ par[j]
        apart = _bits(both)
        ok = np.flatnonzero((apart <= most) & (pos[i] + pos[j] <= most))
        i, j, most, both, apart = i[ok], j[ok], most[ok], both[ok], apart[ok].astype(np.int64)
        part = half[i] ^ half[j]
        split = _bits(part).astype(np.int64) + _bits(both ^ part)
        less, more = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        apart = np.where(less > SHORT_LINE, split, apart)
        ok = (apart <= most) & (less >= self.threshold * more - 1e-9)
        return i[ok], j[ok], apart[ok]

    def long_lists(self, rows, start, length):
        """Lines of long lists with the nearest of the list's first lines that pass; all of them are open."""
        for s, m in zip(start.tolist(), length.tolist()):
            own = rows[:, s : s + m]
            first = self.first.setdefault(int(own[KEY, 0]), own[:, np.argsort(own[ID], kind="stable")[:FIRST_LINES]])
            f = first.shape[1]
            both, got = np.concatenate((first, own), axis=1), []
            n, pos = both[AT] >> POS_BITS, both[AT] & ((1 << POS_BITS) - 1)
            for x in range(f):
                i, j, apart = self.passing(both, n, pos, np.full(m, x), np.arange(f, f + m))
                ahead = (both[ID, i] <= both[ID, j]) & (both[SID : PAR + 1, i] != both[SID : PAR + 1, j]).any(axis=0)
                got.append((i[ahead], j[ahead], apart[ahead]))
            i, j, apart = (np.concatenate(x) for x in zip(*got))
            give = _among_first(j, apart, NEAREST) | _among_first(j, both[ID, i], 1)
            yield _rows(None, both[SID : PAR + 1, i[give]], both[SID : PAR + 1, j[give]])
            yield _rows(own[KEY], own[SID : PAR + 1], own[SID : PAR + 1])


def _rows(key: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows of partners(): the class with the smaller name first."""
    swap = (a[0] > b[0]) | ((a[0] == b[0]) & (a[1] > b[1]))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    keys = pa.nulls(a.shape[1], pa.int64()) if key is None else pa.array(key)
    return pa.RecordBatch.from_arrays([keys, *map(pa.array, (*a, *b))], ["key", "sid", "par", "sid2", "par2"])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(U))


def _among_first(group: np.ndarray, by: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the `most` of their group that are least in `by`."""
    least, width = (int(by.min()), int(by.max()) - int(by.min()) + 1) if len(by) else (0, 1)
    one = len(group) > 0 and (int(group.max()) + 1) * width < 1 << 62  # both fit one number
    order = np.argsort(group * width + (by - least)) if one else np.lexsort((by, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))[: len(g)] if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    out = np.zeros(len(g), bool)
    out[order] = rank < most
    return out


#: So many lines are looked up at once.
SLICE = 1 << 18


class Sieve:
    """A Bloom filter of numbers, of 16 bits for each up to MOST_BITS in all; beyond, it lets more through."""

    MOST_BITS = 27
    SPOTS = 3

    def __init__(self, numbers: DataFrame, hashed, columns: list[str]):
        """hashed: gives a 64-bit hash from the arrays of the given columns of numbers, a stored table."""
        with tidy(numbers.sparkSession):
            self.bits = min(self.MOST_BITS, max(16, (16 * numbers.count()).bit_length()))
            spots = self.spots

            def set_bits(batches):
                for b in batches:
                    at = spots(hashed(*(c.to_numpy() for c in b.columns))).ravel()
                    word, of = np.unique(at >> 6, return_inverse=True)
                    value = np.zeros(len(word), U)
                    np.bitwise_or.at(value, of, U(1) << (at & 63).astype(U))
                    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["w", "v"])

            words = numbers.select(*columns).mapInArrow(set_bits, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.int64)
        self.words[words.column("w").to_numpy()] = words.column("v").to_numpy()

    def spots(self, h: np.ndarray) -> np.ndarray:
        return np.stack([(mixed(h + U(i)) >> U(64 - self.bits)).astype(np.int64) for i in range(self.SPOTS)])

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        at = self.spots(h)
        return (self.words[at >> 6] >> (at & 63) & 1).all(axis=0)


def line_hash(k: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mixed(k.view(U) + line.astype(U) * U(0x9E3779B97F4A7C15))


def line_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """known (sid, par, first: a stored table) with the texts of those lines, as words."""
    sieve = Sieve(known.select(*CLASS, "first.k", "first.line"), line_hash, ["k", "line"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            own = [t.as_py() or b"" for t in b.column(2)]
            many = np.fromiter((t.count(b"\n") + 1 for t in own), np.int64, len(own))
            doc, number = np.repeat(np.arange(len(own)), many), within(many)
            some = [np.flatnonzero(sieve.may_hold(line_hash(b.column(1).to_numpy()[doc[i : i + SLICE]], number[i : i + SLICE]))) + i for i in range(0, len(doc), SLICE)]
            some = np.concatenate(some) if some else np.zeros(0, np.int64)
            text, last, split = [], -1, []
            for i, n in zip(doc[some].tolist(), number[some].tolist()):
                if i != last:
                    last, split = i, own[i].split(b"\n")
                text.append(split[n])
            at = pa.array(doc[some])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(number[some].astype(np.int32)), pa.array(text, pa.binary())], ["doc_id", "k", "line", "words"])

    found = docs.select("doc_id", "k", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, k bigint, line int, words binary")
    found = found.select(F.struct("doc_id", "k", "line").alias("found"), F.col("k").alias("k_"), F.col("line").alias("line_"), "words")
    right = known.select(*CLASS, "first", F.col("first.k").alias("k_"), F.col("first.line").alias("line_"))
    own = F.when(F.col("found").eqNullSafe(F.col("first")), F.col("words"))
    once = found.join(right, ["k_", "line_"]).groupBy("k_", "line_", *CLASS)  # rows lie as the join dealt them
    return once.agg(F.first("first").alias("first"), F.first(own, ignorenulls=True).alias("words")).filter("words is not null").select(*CLASS, "first", "words")


def line_words(line: bytes) -> frozenset[bytes]:
    return frozenset(line.lower().split())


def similar(a: frozenset, b: frozenset, threshold: float) -> bool:
    shared = len(a & b)
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The later class of each pair (sid, par, sid2, par2: a stored table) whose sets of words are similar enough."""
    ids = pairs.select(*CLASS).union(pairs.select("sid2", "par2")).distinct()
    known = stored(classes.select(*CLASS, "first").join(ids, CLASS, "left_semi"))
    texts = stored(line_texts(docs, known))
    a, b = (texts.select(*[F.col(c).alias(f"{c}{v}") for c in (*CLASS, "first", "words")]) for v in ("", "2"))
    both = pairs.join(a, CLASS).join(b, ["sid2", "par2"])  # texts are sent, and split in the tasks where they meet
    later = F.col("first") < F.col("first2")
    names = [F.when(later, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in CLASS]

    def near(batches):
        for b in batches:
            sets: dict[bytes, frozenset] = {}
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                for t in (x, y):
                    if t not in sets:
                        sets[t] = line_words(t)
                ok.append(similar(sets[x], sets[y], threshold))
            yield b.select(CLASS).filter(pa.array(ok, pa.bool_()))

    out = stored(both.select(*names, "words", "words2").mapInArrow(near, "sid bigint, par bigint").distinct())
    dropped(known, texts)
    return out


def left_open(lines: DataFrame, rest: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The open classes (rest: key, sid, par, a stored table) that an earlier line of their list is similar to.

    A list comes in descending order of its lines, each with its words: an open line is held when it comes, until a
    line that comes later matches it. The open lines of a list are parted into blocks of about BLOCK, each of which
    meets the whole list.
    """
    sieve = Sieve(rest, lambda key: mixed(key.view(U)), ["key"])

    def some(batches):
        for b in batches:
            rows = _flat(b)
            rows = rows[:, sieve.may_hold(mixed(rows[KEY].view(U)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], POSTING)

    listed = _listed(lines).mapInArrow(some, ", ".join(f"{c} bigint" for c in POSTING)).drop("id")
    blocks = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("bigint").alias("blocks"))
    members = stored(listed.join(blocks, "key").dropDuplicates(["key", *CLASS]))
    known = stored(classes.select(*CLASS, "first").join(members.select(*CLASS), CLASS, "left_semi"))
    texts = stored(line_texts(docs, known))
    own = rest.withColumn("open", F.lit(True))
    whole = members.join(own, ["key", *CLASS], "left").join(texts, CLASS)
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    whole = whole.select("key", *CLASS, "half", "at", "first", "words", block, F.when(F.col("open"), F.pmod(F.xxhash64("sid"), F.col("blocks"))).alias("own"))
    dealt = whole.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("first"))
    asked = F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("asked")

    def run(batches):
        now = None
        for b in batches:
            group = np.stack([c.to_numpy() for c in b.columns[:2]])
            cuts = np.flatnonzero(np.concatenate(([True], (group[:, 1:] != group[:, :-1]).any(axis=0)))[: b.num_rows])
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows]):
                name = tuple(group[:, i])
                if now is None or now.name != name:
                    now = Asked(name, threshold)
                found = now.meet(b.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], CLASS)

    rows = dealt.select("key", "block", *CLASS, "half", "at", asked, "words")
    out = stored(rows.mapInArrow(run, "sid bigint, par bigint").distinct())
    dropped(members, known, texts)
    return out


class Asked:
    """The open lines of one list, or of a block of them, that no line has matched so far."""

    def __init__(self, name: tuple, threshold: float):
        self.name, self.lists = name, Lists(threshold)
        self.rows, self.sets = np.zeros((len(POSTING), 0), np.int64), []

    def meet(self, b: pa.RecordBatch) -> list[tuple[int, int]]:
        """Compare with the next lines of the list, and return the classes that are matched."""
        key, _, sid, par, half, at, asked, words = b.columns
        new = np.stack([c.to_numpy() for c in (key, sid, par, half, key, at)])
        asked, sets = np.flatnonzero(asked.to_numpy(zero_copy_only=False)), [None] * b.num_rows

        def words_of(i: int) -> frozenset:
            if sets[i] is None:
                sets[i] = line_words(words[i].as_py())
            return sets[i]

        held = self.rows.shape[1]
        before = np.concatenate((np.full(held, -1), asked))  # lines that come after it are earlier ones
        open_rows, open_sets = np.concatenate((self.rows, new[:, asked]), axis=1), self.sets + [words_of(i) for i in asked.tolist()]
        both = np.concatenate((open_rows, new), axis=1)
        n, pos = both[AT] >> POS_BITS, both[AT] & ((1 << POS_BITS) - 1)
        many, found = len(before), []
        for x in range(many):
            others = np.arange(before[x] + 1, b.num_rows)
            _, j, apart = self.lists.passing(both, n, pos, np.full(len(others), x), others + many)
            for y in j[np.argsort(apart, kind="stable")].tolist():
                if similar(open_sets[x], words_of(y - many), self.lists.threshold):
                    found.append(x)
                    break
        keep = np.setdiff1d(np.arange(many), found)
        self.rows, self.sets = open_rows[:, keep], [open_sets[x] for x in keep.tolist()]
        return [(int(open_rows[SID, x]), int(open_rows[PAR, x])) for x in found]


def dropped_lines(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """docs: doc_id, k (a hash of doc_id and text), text. Returns doc_id, k and the lines that go, in a stored table."""
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold must lie between {LEAST_THRESHOLD} and 1")
    lines = stored(line_rows(docs, rarity(docs), threshold, min_words))
    classes = stored(lines.groupBy(*CLASS).agg(F.min(F.struct("doc_id", "k", "line")).alias("first"), F.count(F.lit(1)).alias("copies")))
    met = stored(partners(lines, threshold))
    pairs = stored(met.filter("key is null").drop("key").distinct())
    gone = verified(pairs, classes, docs, threshold)
    rest = stored(met.filter("key is not null").select("key", *CLASS).distinct().join(gone, CLASS, "left_anti"))
    dropped(met, pairs)
    if not rest.isEmpty():
        gone = gone.union(left_open(lines, rest, classes, docs, threshold)).distinct()
    touched = classes.join(gone.withColumn("later", F.lit(True)), CLASS, "left").filter("copies > 1 or later").select(*CLASS, "first", F.coalesce("later", F.lit(False)).alias("later"))
    out = lines.select(*CLASS, "doc_id", "k", "line").join(touched.hint("shuffle_hash"), CLASS)  # one row a class
    out = out.filter(F.col("later") | (F.struct("doc_id", "k", "line") != F.col("first")))
    by_doc = stored(out.groupBy("doc_id", "k").agg(F.collect_set("line").alias("gone")))
    dropped(lines, classes, rest, gone)
    return by_doc


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines that match an earlier one; columns n_lines and n_removed are added.

    Lines are parted by line feeds, words by white space; A-Z count as a-z. Lines of fewer than min_words words always
    stay. Earlier means a smaller doc_id (null first), then a smaller hash of the row's id and text, then a smaller
    line number; rows that repeat both doc_id and text are one document and get the same result. A null text stays
    null, with no lines. Other columns are kept; a column called n_lines or n_removed is replaced. An empty table gives
    no rows. The threshold may lie between 0.7 and 1.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    others = [F.col(f"`{c}`") for c in cols if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.struct(*others).alias("_row"))
    by_doc = dropped_lines(keyed.select("doc_id", "k", "text"), threshold, min_words).withColumnsRenamed({"doc_id": "_id", "k": "_k"})
    both = keyed.join(by_doc.hint("shuffle_hash"), (keyed["k"] == by_doc["_k"]) & keyed["doc_id"].eqNullSafe(by_doc["_id"]), "left")
    both = both.select("doc_id", "text", "_row", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.when(F.size("gone") > 0, F.split("text", "\n", -1)).alias("all"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone"), lambda i: F.get("all", i))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))))
    shown = [(text if c == "text" else F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`")).alias(c) for c in cols]
    return both.select(*shown, count.cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=EVERY_LINE).select("doc_id", "n_lines", "n_removed", "text")
