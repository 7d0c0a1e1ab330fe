"""Words that are near in spelling, found by equi-joins on phonetic codes with letters left out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnorm import deletions, jaro_winkler, typo_distance

_SOUNDS = str.maketrans({"k": "c", "q": "c", "j": "i", "y": "i", "w": "v", "0": "o", "1": "i"})
#: Letters from which on a word is coded by its segments, since its deletions grow with the square of its length.
SEGMENTED = 30
#: Two errors touch four segments at most (a swap may touch two), so one of five stays whole.
SEGMENTS = 5
#: Letters from which on two words within the error limit are surely above any Jaro-Winkler bound up to 0.9.
SURELY_ALIKE = 60


def rendering(word: str) -> str:
    """The word as it sounds: one letter for k/c/q, i/j/y, v/w; no h."""
    return word.translate(_SOUNDS).replace("h", "")


def limit_for(word: str) -> int:
    """How many typing errors a word of this length may hold: 2 from 7 letters, 1 from 5, none in shorter ones."""
    return 2 if len(word) >= 7 else 1 if len(word) >= 5 else 0



def blocking_codes(word: str) -> list[str]:
    """Codes of which any two words within their error limits share one.

    Short words: their sound with up to two letters left out. Long ones: a segment of the word, as cut for its own length
    and for every length and place two errors may lead to.
    """
    codes = []
    if len(word) <= SEGMENTED + 2:
        codes += deletions(rendering(word), limit_for(word))
    if len(word) >= SEGMENTED - 2:
        for n in range(max(len(word) - 2, SEGMENTS), len(word) + 3):
            cuts = [n * i // SEGMENTS for i in range(SEGMENTS + 1)]
            for k in range(SEGMENTS):
                for shift in range(-2, 3):
                    at = cuts[k] + shift
                    if 0 <= at and at + cuts[k + 1] - cuts[k] <= len(word):
                        codes.append(f"{n}|{k}|{word[at : at + cuts[k + 1] - cuts[k]]}")
    return list(dict.fromkeys(codes))


def near_words(words: DataFrame, least_similarity: float = 0.8) -> DataFrame:
    """Pairs (a, b, d) of different words of ``words`` (word), both ways, at most two typing errors apart.

    Blocks are ``blocking_codes``; two words share a block only if they're a few letters apart, so blocks stay small
    whatever the number of rows. Accepted are pairs within the error limit and of Jaro-Winkler similarity
    ``least_similarity`` or more. Words of fewer than five letters may hold no error and so are near no other. A word may
    be several tokens joined by blanks; words of any length are compared. Null words give nothing.
    """

    coded_schema = pa.schema([("word", pa.string()), ("codes", pa.list_(pa.int64()))])
    pair_schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("d", pa.int32())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            flat, ends = [], [0]
            for w in batch.column(0).to_pylist():
                flat += [digest(v) - (1 << 63) for v in blocking_codes(w)]
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), lists.cast(coded_schema.field(1).type)], schema=coded_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, d = [], [], []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                limit = min(limit_for(x), limit_for(y))
                far = typo_distance(x, y, limit)
                if far <= limit and (min(len(x), len(y)) >= SURELY_ALIKE or jaro_winkler(x, y) >= least_similarity):
                    a += [x, y]
                    b += [y, x]
                    d += [far, far]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(d, pa.int32())], schema=pair_schema)

    # Codes are about fifty for a word, so the few bytes of words are dealt out to all tasks first.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = words.select("word").where(F.length("word") >= 5).distinct().repartition(tasks)
    coded = distinct.mapInArrow(codes, "word string, codes array<bigint>").select("word", F.explode("codes").alias("code"))
    # One shuffle of the codes; a block holds the few words that are some letters apart, never all rows of a hot word.
    blocks = coded.groupBy("code").agg(F.collect_list("word").alias("block")).where(F.size("block") > 1)
    pairs = blocks.select(F.explode("block").alias("x"), "block").select("x", F.explode("block").alias("y")).where(F.col("x") < F.col("y")).distinct()
    return pairs.mapInArrow(compare, "a string, b string, d int")
