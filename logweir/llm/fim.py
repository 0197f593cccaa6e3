"""Fill-in-the-middle: a document's prefix, middle and suffix in another order, between marks.

Cuts are drawn in units (lines or code points) and made in bytes. A text is mostly ASCII, where the n-th code point is the n-th byte; the
exceptions are characters of several bytes. ``Exceptions`` records only their positions and excess bytes, for all texts of a batch at
once, and converts cuts either way by a binary search; between exceptions it is plain arithmetic, and no text is decoded.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logweir.llm.common import Batches, batch

MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "character")


class Exceptions:
    """Characters of more than one byte in ``data`` (UTF-8 bytes): where they are and how many bytes they have beyond one."""

    def __init__(self, data: np.ndarray) -> None:
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        self.before = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)))  # excess bytes before each exception, and in all
        self.at_char = self.at_byte - self.before[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before byte ``cut``."""
        return cut - self.before[np.searchsorted(self.at_byte, cut)]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before code point ``cut``."""
        return cut + self.before[np.searchsorted(self.at_char, cut)]


def _draws(key: str | None, seed: int) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{key or ''}".encode()).digest()[:16])


def _cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray, draws: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """For texts at ``start`` to ``end`` of ``data``: units, and the bytes and code points where prefix and middle end."""
    index = Exceptions(data)
    if unit == "line":
        breaks = np.flatnonzero(data == 10)
        first, last = np.searchsorted(breaks, start), np.searchsorted(breaks, end)
        open_end = (end > start) & (np.append(data, 10)[end - 1] != 10)  # the last line has no break
        n = last - first + open_end
        at = np.append(breaks + 1, 0)  # the byte after each line
    else:
        n = index.chars(end) - index.chars(start)
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    bytes_of = []
    for units in (np.minimum(one, two), np.maximum(one, two)):
        if unit == "line":
            cut = at[np.minimum(first + units - 1, len(at) - 1)]
            bytes_of.append(np.where(units == 0, start, np.where(units > last - first, end, cut)))
        else:
            bytes_of.append(index.bytes(index.chars(start) + units))
    low, high = bytes_of
    return n, low, high, index.chars(low) - index.chars(start), index.chars(high) - index.chars(low)


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that a reader can't mistake: none empty, none in another, and no end of one is a start of one."""
    prefix, suffix, middle = marks
    for a, b in product(marks, marks):
        if not a or (a is not b and a in b) or any(b.startswith(a[i:]) for i in range(1, len(a))):
            raise ValueError(f"marks {a!r} and {b!r} could be confused")
    if len(set(marks)) < 3:
        raise ValueError("the three marks must differ")
    return prefix, suffix, middle


def transform(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    rate: int = 100,
    spm_rate: int = 50,
    marks: tuple[str, str, str] = MARKS,
    seed: int = 7,
) -> DataFrame:
    """Every row's key with ``n`` (units of its text), ``form``, ``prefix_chars``, ``middle_chars`` (code points) and ``output``.

    Units are lines with their break, or code points. Four 32-bit numbers of the SHA-256 of seed and key draw the two cuts, whether the text is
    transformed (``rate`` in 100) and its form: ``psm`` is prefix, suffix, middle, each after its mark; ``spm`` suffix, prefix, middle (``spm_rate`` in
    100). Texts that are null or empty, hold a mark or aren't drawn are ``plain``: the output is the text (null: empty), the two lengths
    are null. Rows with one key are cut by the same draws; a null key draws as an empty one. Texts are never shortened, other columns are not read,
    and an empty table gives no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    p, s, m = (x.encode() for x in checked_marks(marks))
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def cut(batches: Batches) -> Batches:
        for b in batches:
            texts = [(x or "").encode() for x in b["text"].to_pylist()]
            keys = b["key"].to_pylist()
            end = np.cumsum([len(x) for x in texts], dtype=np.int64)
            start = end - [len(x) for x in texts]
            draws = np.array([_draws(k, seed) for k in keys], np.int64).reshape(-1, 4)
            n, *places = _cuts(np.frombuffer(b"".join(texts), np.uint8), start, end, draws, unit)
            forms, prefixes, middles, outputs = [], [], [], []
            for t, low, high, before, inside, d in zip(texts, places[0] - start, places[1] - start, *places[2:], draws, strict=True):
                if not t or d[2] % 100 >= rate or p in t or s in t or m in t:
                    form, before, inside = "plain", None, None
                elif d[3] % 100 < spm_rate:
                    form, t = "spm", b"".join((s, t[high:], p, t[:low], m, t[low:high]))
                else:
                    form, t = "psm", b"".join((p, t[:low], s, t[high:], m, t[low:high]))
                forms.append(form), prefixes.append(before), middles.append(inside), outputs.append(t)
            output = pa.array(outputs, pa.binary()).cast(pa.string())
            yield batch(schema, keys, n, forms, prefixes, middles, output)

    kind = df.schema[key].dataType
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    rows = rows.mapInArrow(cut, "key string, n long, form string, prefix_chars long, middle_chars long, output string")
    return rows.select(F.col("key").cast(kind).alias(key), "n", "form", "prefix_chars", "middle_chars", "output")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``transform`` made ``output`` of."""
    p, s, m = checked_marks(marks)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substr(F.substring_index(output, second, 1), F.lit(len(first) + 1))
        rest = F.substr(output, F.lit(len(first) + len(second) + 1) + F.char_length(one))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.lit(len(m) + 1) + F.char_length(two))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
