"""Cuts texts above a limit into overlapping pieces at natural boundaries, with content-defined positions.

A rolling hash over the last ``WINDOW`` characters marks landmarks (one position in ``SPACING``). From the begin of
a piece, the first landmark beyond ``least`` new characters is taken and moved to the nearest natural boundary
between ``least`` and ``most`` new characters: the end of a paragraph, line or sentence, else of a word, else the
landmark itself (never inside a line end or before a combining mark). Landmarks depend on the characters around
them alone, so an edit changes the pieces next to it and the later ones fall back into step.

Defined results: only texts of more than ``limit`` code points are cut; null and empty texts never are. A piece has
at most ``size`` characters, exactly ``overlap`` of which repeat the end of the piece before it (so an overlap, unlike
a cut, may begin anywhere). Without the overlaps the pieces add up to the text. Of repeated rows of an id only those of
its latest time count, and of these the largest. Rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SPACING = 16, 128
_LINE_ENDS = np.array([0x0A, 0x0D, 0x2028, 0x2029, 0x85])
_SENTENCE_ENDS = np.array([ord(c) for c in ".!?;:…。！？；："])
_WIDE_ENDS = np.array([ord(c) for c in "。！？；："])
_SPACES = np.array([0x20, 0x09, 0xA0, 0x3000, *range(0x2000, 0x200B)])
_FACTORS = np.array([pow(0x01000193, k, 1 << 32) for k in range(WINDOW)], dtype=np.uint32)


def landmarks(codes: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash asks for a cut, ascending."""
    value = np.zeros(len(codes), dtype=np.uint32)
    for k in range(min(WINDOW, len(codes))):
        value[k:] += codes[: len(codes) - k] * _FACTORS[k]
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    return np.flatnonzero((value >> np.uint32(16)) % SPACING == 0) + 1


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions after lines and sentences, and after words."""
    line, space = np.isin(codes, _LINE_ENDS), np.isin(codes, _SPACES)
    line[:-1] &= ~((codes[:-1] == 0x0D) & (codes[1:] == 0x0A))
    sentence = np.isin(codes, _SENTENCE_ENDS)
    strong = line | np.isin(codes, _WIDE_ENDS)
    strong[1:] |= sentence[:-1] & space[1:]
    return np.flatnonzero(strong) + 1, np.flatnonzero(space) + 1


def _nearest(positions: np.ndarray, low: int, high: int, wanted: int) -> int | None:
    a, b = np.searchsorted(positions, low), np.searchsorted(positions, high, side="right")
    if a == b:
        return None
    k = np.searchsorted(positions[a:b], wanted) + a
    around = [int(positions[i]) for i in (k - 1, k) if a <= i < b]
    return min(around, key=lambda p: (abs(p - wanted), p))


def _unsplit(text: str, at: int, low: int) -> int:
    """A cut with no natural boundary near goes back before line ends and combining marks it would split."""
    import unicodedata

    first = at
    while at > low and (unicodedata.combining(text[at]) or text[at] in "️‍" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at if at > low else first


def cuts(text: str, least: int, most: int) -> list[int]:
    """Ends of the pieces' new characters, the last one the text's end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = landmarks(codes)
    strong, weak = boundaries(codes)
    ends, start = [], 0
    while len(codes) - start > most:
        low, high = start + least, start + most
        k = np.searchsorted(marks, low)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= high else high
        cut = _nearest(strong, low, high, mark)
        cut = cut if cut is not None else _nearest(weak, low, high, mark)
        start = cut if cut is not None else _unsplit(text, mark, low)
        ends.append(start)
    return [*ends, len(codes)]


def _cut(size: int, overlap: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, texts = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                begin = 0
                for n, end in enumerate(cuts(text, least, size - overlap)):
                    first = max(0, begin - overlap)
                    rows.append(row)
                    numbers.append(n)
                    starts.append(first)
                    texts.append(text[first:end])
                    begin = end
            own = pa.array(rows, pa.int64())
            kept = [c.take(own) for c, name in zip(batch.columns, batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], [*names, "piece_no", "start", "piece"])

    return run


def cut_oversized(df: DataFrame, key: str, text: str, keep: list[str], order: str, limit: int = 2000, size: int = 1000, overlap: int = 100, least: int = 350) -> DataFrame:
    """(key, kept columns, piece_no, start, piece) of the texts above ``limit``; ``order`` tells the latest of repeated rows."""
    latest = df.groupBy(F.col(key).alias("of")).agg(F.max(order).alias("latest"))  # without the texts
    long = df.where(F.length(text) > limit).select(F.col(key).alias("key"), F.struct(F.col(order).alias("o"), F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("s"))
    one = long.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("s").alias("s"))
    # no row is later than the latest; an equality would become a join key and shuffle the texts again
    one = one.join(latest, F.col("key") == F.col("of")).where(F.col("latest").isNull() | (F.col("s.o") >= F.col("latest"))).select("key", *[f"s.k{i}" for i in range(len(keep))], "s.text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema.fields if f.name != "text")
    pieces = one.mapInArrow(_cut(size, overlap, least), f"{kinds}, piece_no int, start int, piece string")
    return pieces.select(F.col("key").alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "piece_no", "start", "piece")
