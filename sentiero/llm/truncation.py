"""Texts cut off by field limits or in transfer: length spikes per source, and ends that no whole line has."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..runtime import stage

_NINES = str.maketrans("012345678", "999999999")
_TOKEN = re.compile(r"[^\W\d_]+|9+\.9+|9+|_+|[^\w\s]")
#: Marks that a field limit leaves in place of the rest.
CUT_MARKS = ("…", "[continua]", "[continued]", "[...]", "[…]")
_TERMINAL = frozenset(".!?。！？;")
_CLOSING = frozenset(")]}\"'`>»”’*")
_PAIRS = (("(", ")"), ("[", "]"), ("{", "}"))
_NUMBERS = re.compile(r"\s*\d+(?:\s+-?\d+\.\d+|\s+NaN)+\s*$")


def _tail(line: str) -> str:
    """The shape of a line's end: its last two tokens (three where the last is a number), digits as 9, whole numbers of
    any length alike; dots of an ellipsis are one token."""
    dots = line.endswith("...")
    end = _end_part(line)
    found = _TOKEN.findall(end.rstrip(".").translate(_NINES) if dots else end.translate(_NINES))
    found = found[-3 if found and found[-1].startswith("9") else -2 :]
    shape = ["9" if t.startswith("9") and "." not in t else "9." + t.rpartition(".")[2] if t.startswith("9") else t for t in found]
    return " ".join([*shape, "..."] if dots else shape)


def _end_part(line: str) -> str:
    """The end of a line that holds its last three tokens whole: 60 characters where these hold three blanks, else all."""
    end = line[-60:]
    return end if end.rstrip().count(" ") >= 4 else line


def _decided(line: str) -> bool:
    """Whether a line's last character alone tells that it is whole."""
    return (line[-1] in _TERMINAL or line[-1] in _CLOSING) and not line.endswith("...")


def _digest(tail: str) -> int:
    return xxhash.xxh3_64_intdigest(tail.encode("utf-8", "surrogatepass")) - (1 << 63)


def _open_brackets(line: str) -> bool:
    return any(line.count(a) > line.count(b) for a, b in _PAIRS)


def end_of(text: str) -> tuple[str, int]:
    """(verdict, key): "whole", "cut", or "ask" with the hash of an end whose use at line ends decides."""
    head = text.lstrip()[:1]
    if head in ("{", "[") and re.match(r'\s*[{\[]\s*(?:["{\[\]}]|$)', text):
        try:
            json.loads(text, strict=False)
            return "whole", 0
        except ValueError:
            return "cut", 0
    body = text.rstrip("\n\r ")
    if not body:
        return "whole", 0
    fences = len(re.findall(r"^\s{0,3}(?:```|~~~)", body, re.M))
    if fences % 2:
        return "cut", 0
    if text.endswith(("\n", "\r")):
        return "whole", 0
    above, _, line = body.rpartition("\n")
    if _open_brackets(line):
        return "cut", 0
    if _NUMBERS.match(line):
        before = above.rpartition("\n")[2]
        if _NUMBERS.match(before) and len(before.split()) > len(line.split()):
            return "cut", 0
    return ("whole", 0) if _decided(line) else ("ask", _digest(_tail(line)))


def text_ends(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One scan of the texts: a row of each text's lengths and end, and rows of counted line ends.

    Rows (id, source, chars, bytes, verdict, mark, terminal, end, lines): for texts with lines null; for counted ends only end and
    lines. Ends are counted over all lines that another line follows, so a cut text adds none of its own.
    """

    kind = df.schema[key].dataType.simpleString()
    long, text_kind = LongType(), StringType()
    parts = {"id": df.schema[key].dataType, "source": text_kind, "chars": long, "bytes": long, "verdict": text_kind, "mark": BooleanType(), "terminal": BooleanType(), "end": long, "lines": long}
    schema = to_arrow_schema(StructType([StructField(n, t) for n, t in parts.items()]))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def flush(ends: Counter) -> pa.RecordBatch:
        tails: Counter = Counter()
        for line, n in ends.items():
            tails[_tail(line)] += n
        return batch_of([(None,) * 7 + (_digest(t), n) for t, n in tails.items()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: Counter = Counter()
        for batch in batches:
            rows = []
            for k, t, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if t is None:
                    continue
                verdict, end = end_of(t)
                rows.append((k, s, len(t), len(t.encode("utf-8", "surrogatepass")), verdict, bool(t.rstrip().endswith(CUT_MARKS) or (verdict == "ask" and t.rstrip()[-1:].isdigit())), t[-1:] in _TERMINAL, end if verdict == "ask" else None, None))
                if t.lstrip()[:1] not in ("{", "["):
                    ends.update(_end_part(line) for line in t.split("\n")[:-1] if line and not _decided(line))
            yield batch_of(rows)
            if len(ends) > 200_000:
                yield flush(ends)
                ends = Counter()
        yield flush(ends)

    cols = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{source}`").alias("s")).where(F.col("k").isNotNull())
    return cols.mapInArrow(scan, f"id {kind}, source string, chars bigint, bytes bigint, verdict string, mark boolean, terminal boolean, end bigint, lines bigint")


def length_spikes(texts: DataFrame, least: int = 5, times: float = 8.0) -> DataFrame:
    """(source, unit, top): sources whose length histogram, in characters or bytes, has a spike at its maximum.

    The spike is the count at the greatest length (in bytes also up to three below, where a character of several bytes
    was not split); it must hold ``least`` texts and ``times`` what the lengths below, from 80 %, hold on average.
    """
    units = texts.select(F.coalesce("source", F.lit("")).alias("source"), F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "len"))
    hist = units.groupBy("source", "unit", "len").agg(F.count("*").alias("n"))
    top = hist.groupBy("source", "unit").agg(F.max("len").alias("top"))
    slack = F.when(F.col("unit") == "bytes", 3).otherwise(0)
    at = hist.join(top, ["source", "unit"]).withColumn("in_top", F.col("len") >= F.col("top") - slack)
    sums = at.groupBy("source", "unit", "top").agg(F.sum(F.when(F.col("in_top"), F.col("n")).otherwise(0)).alias("spike"), F.sum(F.when(~F.col("in_top") & (F.col("len") >= 0.8 * F.col("top")), F.col("n")).otherwise(0)).alias("below"))
    usual = F.col("below") * (slack + 1) / (0.2 * F.col("top"))
    return sums.where((F.col("spike") >= least) & (F.col("spike") >= times * usual)).select("source", "unit", "top")


def truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(id, source, chars, at_limit, unterminated, truncated) of every non-null text of ``df``.

    A text is truncated if it lies at its source's spike length, in characters or bytes, and has no whole end or shows a
    limit's mark there; or, at any length, if its end is none a whole text has: JSON that breaks off, an open code fence
    or bracket, a shorter row under a table, or a last line without a final mark whose last two tokens end no line
    followed by another. Ends are counted over all texts; an end counts as whole if it closes one line for ten texts
    that end with it. A final line break, terminal punctuation or a closing bracket or quote is a whole end; at the
    spike a number that isn't closed by any of these is none. ``unterminated`` is the plain test of its own: at a spike
    length, in characters or bytes, and the last character is no terminal punctuation. Null sources are one source; repeated rows of a key count once; empty texts are whole; an empty table
    gives no rows.
    """
    scanned = stage(text_ends(df, key, text, source))
    texts = scanned.where(F.col("id").isNotNull())
    texts = texts.groupBy("id").agg(F.max(F.struct("source", "chars", "bytes", "verdict", "mark", "terminal", "end")).alias("r")).select("id", "r.*")
    lines = scanned.where(F.col("id").isNull()).groupBy("end").agg(F.sum("lines").alias("lines"))
    asked = texts.where(F.col("end").isNotNull()).groupBy("end").agg(F.count("*").alias("texts"))
    known = asked.join(lines, "end").where(10 * F.col("lines") >= F.col("texts")).select("end", F.lit(True).alias("known"))
    spikes = length_spikes(texts)
    limit = lambda unit: spikes.where(F.col("unit") == unit).select(F.col("source").alias("src"), F.col("top").alias(f"top_{unit}"))
    named = texts.withColumn("src", F.coalesce("source", F.lit(""))).join(limit("chars"), "src", "left").join(limit("bytes"), "src", "left").join(known, "end", "left")
    at_limit = F.coalesce(F.col("chars") == F.col("top_chars"), F.lit(False)) | F.coalesce((F.col("bytes") >= F.col("top_bytes") - 3) & (F.col("bytes") <= F.col("top_bytes")), F.lit(False))
    broken = (F.col("verdict") == "cut") | ((F.col("verdict") == "ask") & F.col("known").isNull())
    return named.select("id", "source", "chars", at_limit.alias("at_limit"), (at_limit & ~F.col("terminal")).alias("unterminated"), (broken | (at_limit & F.col("mark"))).alias("truncated"))


def truncation_report(flags: DataFrame) -> DataFrame:
    """(source, texts, at_limit, unterminated, truncated_texts, share) per source: how many lie at a length spike, how many of
    these have no terminal punctuation, and how many are truncated by both tests together."""
    counts = [F.count_if(c).alias(n) for c, n in (("at_limit", "at_limit"), ("unterminated", "unterminated"), ("truncated", "truncated_texts"))]
    return flags.groupBy("source").agg(F.count("*").alias("texts"), *counts).withColumn("share", F.col("truncated_texts") / F.col("texts"))
