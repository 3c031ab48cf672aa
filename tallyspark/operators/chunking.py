"""Cutting texts: overlapping chunks, lossless passages, pieces at word boundaries, packing into batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import reachable

_ROWS = 2_000


def overlapping(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, chunk) of a text whose white space is collapsed.

    A chunk ends at the last blank in its second half, if there is one; the next one starts `overlap` before that end, and at least one
    character further on.  The blanks are found once; each end is a look-up among them.
    """
    flat = " ".join(text.split())
    blanks = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32) == ord(" "))
    at, last = 0, len(flat)
    while at < last - size:
        near = int(np.searchsorted(blanks, at + size)) - 1
        stop = int(blanks[near]) if near >= 0 and blanks[near] >= at + size // 2 else at + size
        yield at, stop, flat[at:stop]
        at = max(at + 1, stop - overlap)
    if flat:
        yield at, last, flat[at:]


#: White space and all else, by Unicode.
_GAP, _INK = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"


def _matched(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(`key`, `position` from 1, `start`, `end`, `text`) of all matches of a pattern.

    What lies between the matches comes from splitting at them, so places are running sums of lengths: all of it is expressions.  The sums are
    made before the matches become rows, which carry no array along.
    """
    pattern = f"(?sU){pattern}"
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").select("k", "t", found.alias("found"))
    gaps = F.transform(F.slice(F.split("t", pattern, -1), F.lit(1), F.size("found")), F.length)
    rows = rows.select("k", "found", running(F.zip_with(gaps, F.transform("found", F.length), lambda g, n: g + n)).alias("ends"))
    placed = rows.select("k", F.posexplode(F.arrays_zip("found", "ends")).alias("i", "x")).select("k", "i", F.col("x.found").alias("text"), F.col("x.ends").alias("end"))
    return placed.select(F.col("k").alias(key), (F.col("i") + 1).alias("position"), (F.col("end") - F.length("text")).alias("start"), "end", "text")


def running(numbers: Column, block: int = 128) -> Column:
    """The running sums of an array of integers.  An array grows by copying, so sums are made within blocks, and those of the blocks' totals are added:
    n * (block + n / block ** 2) steps or so, not n * n."""

    def sums(part: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("now"))
        added = lambda acc, x: F.struct(F.concat(acc["all"], F.array(acc["now"] + x)).alias("all"), (acc["now"] + x).alias("now"))
        return F.aggregate(part, start, added, lambda acc: acc["all"])

    def whole(of: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(of) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda b: sums(F.slice(of, b * block + 1, F.lit(block))))
        return F.get(F.transform(F.array(parts), shifted), F.lit(0))

    def shifted(parts: Column) -> Column:
        ends = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        before = F.concat(F.array(F.lit(0)), ends)
        return F.flatten(F.get(F.transform(F.array(before), lambda of: F.transform(parts, lambda p, b: F.transform(p, lambda x: x + F.get(of, b)))), F.lit(0)))

    once = F.get(F.transform(F.array(numbers), lambda of: F.when(F.size(of) > 0, whole(of)).otherwise(F.array().cast("array<int>"))), F.lit(0))
    return once


def exploded(df: DataFrame, key: str, text: str, cut: Callable[[str], Iterator[tuple[int, int, str]]]) -> DataFrame:
    """(`key`, `position` from 1, `start`, `end`, `text`) for what `cut` makes of each text; null texts make nothing.

    A cut depends on the one before, so each text is cut in Python, batch by batch, without a shuffle; output leaves in batches, so memory
    does not grow with the number of parts.
    """
    reachable(df.sparkSession)
    sent = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    kind = sent.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0), b.column(1), strict=True):
                for i, (start, end, part) in enumerate(cut(t.as_py()), 1):
                    rows.append((k.as_py(), i, start, end, part))
                    if len(rows) >= _ROWS:
                        yield batch(rows, b.column(0).type)
                        rows = []
            if rows:
                yield batch(rows, b.column(0).type)

    def batch(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        kinds = [of, pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k", "position", "start", "end", "text"])

    return sent.mapInArrow(run, f"k {kind}, position int, start int, end int, text string").withColumnRenamed("k", key)


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5000, overlap: int = 400) -> DataFrame:
    if size < 64 or not 0 <= overlap < size:
        raise ValueError("size must be 64 or more, overlap non-negative and smaller")
    return exploded(df, key, text, lambda t: overlapping(t, size, overlap))


def lossless(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4000) -> DataFrame:
    """Passages without overlap or loss: each has `size` characters and goes on to the next white space."""
    if size < 1:
        raise ValueError("size must be positive")
    return _matched(df, key, text, rf".{{{size - 1}}}(?:{_GAP}|{_INK}+(?:{_GAP}|\z))|.+")


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5000) -> DataFrame:
    """Pieces of whole words, at most `size` characters unless a single word is longer."""
    return _matched(df, key, text, rf"{_INK}(?:.{{0,{max(0, size - 2)}}}{_INK})?(?!{_INK})|{_INK}+")


def packed(df: DataFrame, group: str, order: list[str], size: str, budget: int, overhead: int = 0, separator: int = 2, max_items: int = 32) -> DataFrame:
    """`df` with `batch`, from 1 within each group: in order, as many rows as `max_items` and the bytes of the budget allow.

    A running sum that starts anew is no window frame, so groups are sorted and stream through their tasks, of which each holds one
    Arrow batch whatever the size of a group.  A row that does not fit by itself is an error.
    """
    reachable(df.sparkSession)
    room = budget - overhead
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, rows, used = object(), 0, 0, 0
        for part in parts:
            numbers = []
            for of, n in zip(part[group], part[size], strict=True):
                if n > room:
                    raise ValueError("a row exceeds the budget")
                fresh = of != now
                if fresh or rows == max_items or used + separator + n > room:
                    now, batch, rows, used = of, 1 if fresh else batch + 1, 1, n
                else:
                    rows, used = rows + 1, used + separator + n
                numbers.append(batch)
            yield part.assign(batch=numbers)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInPandas(stream, f"{schema}, batch int")


#: Texts below this length are not halved.
HALVED = 256


def halves(parts: list[dict]) -> list[list[dict]] | None:
    """A batch in two: by rows, or a single row's text at the end of the white space nearest to its middle, if that is in its middle half."""
    if len(parts) > 1:
        return [parts[: len(parts) // 2], parts[len(parts) // 2 :]]
    (row,) = parts
    text, size = row["text"], len(row["text"])
    if size < HALVED:
        return None
    middle = size // 2
    back = len(re.search(r"\S*\Z", text[:middle].rstrip() if text[middle].isspace() else text[:middle])[0])
    before = len(text[:middle].rstrip() if text[middle].isspace() else text[:middle]) - back
    after = middle + re.match(r"\S*\s*", text[middle:]).end()
    near = min((before, after), key=lambda c: (abs(c - middle), c))
    cut = near if size // 4 <= near <= 3 * size // 4 else middle
    edge = row.get("start", 0) + cut
    return [[{**row, "text": text[:cut], "end": edge}], [{**row, "text": text[cut:], "start": edge}]]
