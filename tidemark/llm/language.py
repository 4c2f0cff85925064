"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of its letters, each
rotated by the letter's place; a text's vector bundles (adds) those of its trigrams, and a language's prototype bundles
the vectors of its texts, less the mean of all languages. A text gets the language whose prototype has the largest
cosine with it.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, tidy

DIMENSIONS = 512
SHARPNESS = 20.0
#: So many places of a text are looked at at once, and so many trigrams are held, by their vectors or while they are made.
CHUNK = 1 << 18
MOST_TRIGRAMS = 8_192
SLICE = 2_048
MOST_LETTERS = 4_096
#: At most about this many texts of each language are learned from.
TEXTS_A_LANGUAGE = 3_000
#: accepted() rejects a text of a lower score: one that is about as like several languages, thus like none of them.
LEAST_SCORE = 0.4
UNKNOWN = "und"


class Encoder:
    """Text vectors. Letter vectors follow from the code point alone, so all workers agree.

    Holds the vectors of at most MOST_TRIGRAMS trigrams and MOST_LETTERS letters: 19 MB at 512 dimensions.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((MOST_TRIGRAMS, dimensions), np.float32)
        #: for each UTF-16 unit: itself for a letter (surrogates count as letters), else a space
        self.code = np.array([c if chr(c).isalpha() or 0xD800 <= c < 0xE000 else 32 for c in range(65_536)], np.uint16)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= MOST_LETTERS:
                self.letters.clear()
            self.letters[code] = np.random.default_rng(code).integers(0, 2, self.d).astype(np.int8) * 2 - 1
        return self.letters[code]

    def made(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of trigrams, a row each."""
        out = np.ones((len(grams), self.d), np.int8)
        for turn, shift in ((2, 32), (1, 16), (0, 0)):
            codes, at = np.unique(grams >> np.uint64(shift) & np.uint64(0xFFFF), return_inverse=True)
            out *= np.stack([np.roll(self.letter(c), turn) for c in codes.tolist()])[at]
        return out.astype(np.float32)

    def bundled(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each as often as counted."""
        total = np.zeros(self.d, np.float32)
        for i in range(0, len(grams), SLICE):
            some, n = grams[i : i + SLICE], counts[i : i + SLICE].astype(np.float32)
            at = np.fromiter((self.rows.get(g, -1) for g in some.tolist()), np.int64, len(some))
            new = at < 0
            if new.any():
                vectors = self.made(some[new])
                total += n[new] @ vectors
                if len(self.rows) + len(vectors) <= MOST_TRIGRAMS:
                    first = len(self.rows)
                    self.matrix[first : first + len(vectors)] = vectors
                    self.rows.update(zip(some[new].tolist(), range(first, first + len(vectors))))
            if not new.all():
                total += n[~new] @ self.matrix[at[~new]]
        return total

    def vector(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None where there is no letter."""
        text = (text or "").lower()
        code = self.code[np.frombuffer(f" {text} ".encode("utf-16-le", "surrogatepass"), np.uint16)]
        letter = code != 32
        if not letter.any() or not has_letter(text):
            return None
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after a run of letters, and the first one
        keep[0] = True
        code, total = code[keep], np.zeros(self.d)
        for at in range(0, len(code) - 2, CHUNK):
            part = code[at : at + CHUNK + 2].astype(np.uint64)
            grams, counts = np.unique(part[:-2] << np.uint64(32) | part[1:-1] << np.uint64(16) | part[2:], return_counts=True)
            total += self.bundled(grams, counts)
        norm = float(np.linalg.norm(total))
        return total / norm if norm else total


@cache
def encoder_of(dimensions: int) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(dimensions)


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def prototypes(docs: DataFrame, texts_a_language: int = TEXTS_A_LANGUAGE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their centred unit prototypes, learned from docs (doc_id, text, lang).

    Of a language with more texts than texts_a_language, about so many are taken by a hash of the id. Only sums leave
    the workers. Every language is learned; the driver and each worker hold 4 KB for each at 512 dimensions.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    million = 1_000_000
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), texts_a_language / F.count(F.lit(1))).alias("share"))
    # a row for each language, of which every worker holds a whole vector later
    some = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < (F.col("share") * million).cast("int"))

    def run(batches):
        encoder, sums = encoder_of(dimensions), {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                v = encoder.vector(text.as_py())
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = some.select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    with tidy(docs.sparkSession):
        rows = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in rows})
    place, out = {lang: i for i, lang in enumerate(langs)}, np.zeros((len(langs), dimensions))
    for r in rows:
        out[place[r.lang], r.at] = r.x
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        out -= out.mean(0)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return langs, out


def classified(text: Column, langs: list[str], vectors: np.ndarray, sharpness: float = SHARPNESS) -> Column:
    """lang_pred and score of a text, as a struct.

    und and 0 for a null text, a text without a letter, or where no language was learned. The score is the share of
    the best language in the exponentials of the scaled cosines.
    """

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(vectors.shape[1])
        pred, score = [], []
        for text in texts:
            v = encoder.vector(text.as_py()) if langs else None
            if v is None:
                pred.append(UNKNOWN), score.append(0.0)
                continue
            x = sharpness * (vectors @ v)
            p = np.exp(x - x.max())
            pred.append(langs[int(x.argmax())]), score.append(float(p.max() / p.sum()))
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned only from rows that are not held out.

    Rows that repeat get equal results, a null doc_id is not held out, an empty table gives no rows.
    """
    base = docs.select("doc_id", "text", "lang", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    langs, vectors = prototypes(base.filter(~F.col("held_out")))
    return base.select("doc_id", "held_out", classified(F.col("text"), langs, vectors).alias("x")).select("doc_id", "held_out", "x.lang_pred", "x.score")


def accepted(docs: DataFrame, least: float = LEAST_SCORE, languages: set[str] | None = None) -> DataFrame:
    """docs without those that are rejected: language unknown, score under least, or not among languages (None: all).

    Every column is kept, and the whole table where no language could be learned. Rows that repeat share their fate.
    """
    base = docs.withColumn("_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    langs, vectors = prototypes(base.filter(~F.col("_out")))
    if not langs:
        return docs
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), classified(F.col("text"), langs, vectors).alias("_x"))
    pred = F.col("_x.lang_pred")
    wanted = pred != UNKNOWN if languages is None else pred.isin(sorted(languages))
    return named.filter(wanted & (F.col("_x.score") >= least)).select("_row.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
