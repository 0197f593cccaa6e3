"""Phrases whose words occur together more often than apart, from a weighted de Bruijn graph of the corpus.

Texts are cut into pieces, pieces into words. An edge of the graph is a run of ``longest`` words, weighted by its occurrences; its nodes are its
first and its last ``longest - 1`` words, so that edges that follow one another overlap in a node. Nothing shorter is counted by itself: a run's
occurrences are the flow out of its node (all edges that begin with it) and a correction, the pieces that end with it.

A task makes the graph of a slab of text and keeps it compacted: along a path whose inner nodes have one edge in and one out, of one weight, the
words are written once and not once for each edge. The graphs are a table of the shared folder. From it every edge goes to a cell by a hash of all its
words, so that neither a frequent word nor a frequent pair makes a cell large; the cells add up weights, answer with the runs that are frequent,
and send the flow of their nodes on to the cells of the next shorter length, where the corrections are added. So each length is one exchange
of compressed counts, a task holds a slab or a cell, and no machine holds a vocabulary.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from logweir.functions.ranks import first_rows
from logweir.llm.common import Batches, batch, discard, pieces, runs, stored

SLAB = 8 << 20  # bytes of text whose graph a task makes at a time
CELL = 1 << 20  # about so many edges of slabs go to a cell
NO_LANG = "und"

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BREAKS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_WORD = rb"[^ \t.,;:!?\n-\r]+"


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(256, np.uint8)
    kind[list(_GAPS)], kind[list(_BREAKS)] = 1, 2
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


_KIND, _LOWER = _classes()


def _packed(head: dict, *arrays: np.ndarray) -> bytes:
    """A head and arrays of numbers as bytes: like bytes of all numbers of an array side by side, compressed."""
    import zstandard

    told = json.dumps(head | {"arrays": [(a.dtype.str, len(a)) for a in arrays]}).encode()
    side = b"".join(np.ascontiguousarray(a).reshape(-1, 1).view(np.uint8).T.tobytes() for a in arrays if len(a))
    return struct.pack("<I", len(told)) + told + zstandard.ZstdCompressor(level=1).compress(side)


def _unpacked(data: bytes) -> tuple[dict, list[np.ndarray]]:
    import zstandard

    (n,) = struct.unpack_from("<I", data)
    head = json.loads(data[4 : 4 + n])
    side, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 + n :]), np.uint8), 0, []
    for kind, length in head["arrays"]:
        width = np.dtype(kind).itemsize
        part = side[at : at + width * length]
        at += width * length
        out.append(np.ascontiguousarray(part.reshape(width, -1).T).view(kind).ravel() if length else np.zeros(0, kind))
    return head, out


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and the bytes of an array of words."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    data = words.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.diff(offsets).astype(np.int32), held


def _words_of(lengths: np.ndarray, held: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(held.tobytes())])


def _sums(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct code, by first appearance: its first row, and the exact sum of ``n`` (its rows, without ``n``)."""
    number, known = pd.factorize(codes)
    first = np.empty(len(known), np.int64)
    first[number[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the last one written is the first row
    if n is None:
        return first, np.bincount(number, minlength=len(known))
    sums = np.zeros(len(known), np.int64)
    np.add.at(sums, number, n)
    return first, sums


def _hashes(words: pa.Array) -> np.ndarray:
    """A number of 64 bits for each word: its bytes times powers of an odd number."""
    lengths, held = _bytes_of(words)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begins = np.cumsum(lengths, dtype=np.int64) - lengths
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _STEP))
    codes = (held.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(held)) - np.repeat(begins, lengths)]
    codes = np.add.reduceat(codes, begins) * _MIX
    return codes ^ (codes >> np.uint64(32))


@dataclass
class Counts:
    """How often runs of one length occur: a row has the place of its language, then the places of its words in the vocabulary."""

    langs: list[str]
    words: pa.Array
    rows: np.ndarray
    n: np.ndarray

    @property
    def length(self) -> int:
        return self.rows.shape[1] - 1

    def packed(self) -> bytes:
        """In the order of the runs, so that neighbours are alike and the first words are steps of 0 or little more."""
        order = np.argsort(self.codes())
        rows = self.rows[order].T.astype(np.int32)
        rows[1] = np.diff(rows[1], prepend=0)
        return _packed({"langs": self.langs, "width": len(rows)}, *_bytes_of(self.words), rows.ravel(), self.n[order].astype(np.int64))

    @classmethod
    def unpacked(cls, data: bytes) -> Counts:
        head, (lengths, held, rows, n) = _unpacked(data)
        rows = rows.reshape(head["width"], -1)
        rows[1] = np.cumsum(rows[1])
        return cls(head["langs"], _words_of(lengths, held), rows.T, n)

    def codes(self) -> np.ndarray:
        """A number for each row, alike for like rows."""
        code, most = self.rows[:, 0].astype(np.int64), max(1, len(self.langs))
        size = max(1, len(self.words))
        for column in self.rows.T[1:]:
            if most * size >= 1 << 62:
                code, known = pd.factorize(code)
                most = max(1, len(known))
            code, most = code * size + column, most * size
        return code

    def summed(self) -> Counts:
        """Each distinct run once."""
        first, n = _sums(self.codes(), self.n)
        return Counts(self.langs, self.words, self.rows[first], n)

    def flow(self) -> Counts:
        """The flow out of the nodes: counts of the runs without their last word."""
        return Counts(self.langs, self.words, self.rows[:, :-1], self.n).summed()

    def cells(self, bits: int) -> Iterator[tuple[int, Counts]]:
        """The rows by cell, each with only its own words."""
        if not len(self.n):
            return
        own = _hashes(self.words)
        code = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)[self.rows[:, 0]]
        for column in self.rows.T[1:]:
            code = (code ^ (code >> np.uint64(31))) * _STEP + own[column]
        cell = ((code * _MIX) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(code), np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        place = np.zeros(len(self.words), np.int32)
        for at, end in zip(first, np.append(first[1:], len(cell)), strict=True):
            rows = self.rows[order[at:end]]
            if rows.size * 8 < len(place):
                used = np.unique(rows[:, 1:])
            else:
                flag = np.zeros(len(place), bool)
                flag[rows[:, 1:]] = True
                used = np.flatnonzero(flag)
            place[used] = np.arange(len(used), dtype=np.int32)
            rows = np.column_stack((rows[:, :1], place[rows[:, 1:]]))
            yield int(cell[at]), Counts(self.langs, self.words.take(pa.array(used)), rows, self.n[order[at:end]])


def merged(parts: list[Counts]) -> Counts:
    """Counts of several vocabularies in one, each distinct run once."""
    every = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
    places = every.indices.to_numpy(zero_copy_only=False)
    langs = {x: i for i, x in enumerate(sorted({x for p in parts for x in p.langs}))}
    rows, at = [], 0
    for p in parts:
        names = np.array([langs[x] for x in p.langs], np.int32)
        rows.append(np.column_stack((names[p.rows[:, 0]], places[at : at + len(p.words)][p.rows[:, 1:]])) if len(p.n) else p.rows)
        at += len(p.words)
    return Counts(list(langs), every.dictionary, np.concatenate(rows), np.concatenate([p.n for p in parts])).summed()


@dataclass
class Graph:
    """A slab's edges as compacted paths, and the runs that pieces end with."""

    langs: list[str]
    words: pa.Array
    walk: np.ndarray  # the words of all paths, one path after the other
    length: np.ndarray  # words of each path
    lang: np.ndarray
    n: np.ndarray  # the weight of all edges of the path
    ends: list[Counts]  # by length, from one word

    @property
    def longest(self) -> int:
        return len(self.ends) + 1

    def packed(self) -> bytes:
        ends = [x for e in self.ends for x in (e.rows.T.ravel().astype(np.int32), e.n)]
        return _packed({"langs": self.langs, "longest": self.longest}, *_bytes_of(self.words), self.walk, self.length, self.lang, self.n, *ends)

    @classmethod
    def unpacked(cls, data: bytes) -> Graph:
        head, (lengths, held, walk, length, lang, n, *ends) = _unpacked(data)
        words = _words_of(lengths, held)
        corrections = [Counts(head["langs"], words, ends[2 * i].reshape(i + 2, -1).T, ends[2 * i + 1]) for i in range(head["longest"] - 1)]
        return cls(head["langs"], words, walk, length, lang, n, corrections)

    def edges(self) -> Counts:
        each = self.length - self.longest + 1  # edges of a path
        begins = np.cumsum(self.length, dtype=np.int64) - self.length
        places = np.repeat(begins - (np.cumsum(each, dtype=np.int64) - each), each) + np.arange(int(each.sum()))
        rows = np.column_stack([np.repeat(self.lang, each), *(self.walk[places + i] for i in range(self.longest))])
        return Counts(self.langs, self.words, rows, np.repeat(self.n, each))


def graph(parts: list[tuple[str, bytes, int]], longest: int) -> Graph:
    """The compacted graph of texts, each with its language and the number of words at its end that are there for what stands before them only."""
    langs = sorted({x for x, _, _ in parts})
    number = {x: i for i, x in enumerate(langs)}
    data = np.frombuffer(b"\n".join([b"", *(t for _, t, _ in parts), b""]), np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the first byte and the last are breaks, so starts and ends alternate
    breaks = np.flatnonzero(kind == 2)
    held = _LOWER[data[inside]]
    del data, kind, inside
    start, end = edge[0::2], edge[1::2]
    total = len(start)
    words = _words_of((end - start).astype(np.int32), held).dictionary_encode()
    del held, end
    order = pc.sort_indices(words.dictionary).to_numpy()  # like words side by side take less room
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    word = rank[words.indices.to_numpy(zero_copy_only=False)]
    words = words.dictionary.take(pa.array(order))
    at = np.arange(total)
    closes = np.unique(np.searchsorted(start, breaks))  # the places after each piece's last word
    closes = closes[closes > 0]
    left = np.repeat(closes, np.diff(closes, prepend=0)) - at  # words from here to the end of the piece
    until = np.searchsorted(start, np.cumsum([len(t) + 1 for _, t, _ in parts], dtype=np.int64))  # the place after each text's last word
    each = np.diff(until, prepend=0)
    lang = np.repeat(np.array([number[x] for x, _, _ in parts], np.int32), each)
    counted = at < np.repeat(until - np.array([c for _, _, c in parts], np.int64), each)

    def rows(first: np.ndarray, length: int) -> np.ndarray:
        return np.column_stack([lang[first], *(word[first + i] for i in range(length))]).astype(np.int32)

    run, size, ends = lang * np.int64(max(1, len(words))) + word, 0, []
    for length in range(1, longest):
        if length > 1:
            size = int(run.max(initial=0)) + 1
            run = np.where(left >= length, run * size + np.append(run[1:], 0), -1)
        run = pd.factorize(run)[0]  # rows that are too short have a number too; it isn't asked for
        last = np.flatnonzero(counted & (left == length))
        first, n = _sums(run[last])
        ends.append(Counts(langs, words, rows(last[first], length), n))
    begins = np.flatnonzero(counted & (left >= longest))
    nodes = int(run.max(initial=0)) + 1
    # single words are loops at the node of no words: their own number will do, and no path joins them
    source, target = (run[begins], run[begins + 1]) if longest > 1 else (run[begins], run[begins])
    first, n = _sums(source * nodes + target)
    out, into = np.bincount(source[first], minlength=nodes), np.bincount(target[first], minlength=nodes)
    unary = (out == 1) & (into == 1) & (longest > 1)
    place = begins[first]
    follows = (np.diff(place) == 1) & (np.diff(n) == 0) & unary[target[first[:-1]]] if len(first) else np.zeros(0, bool)
    heads = np.flatnonzero(np.concatenate(([True], ~follows))) if len(first) else np.zeros(0, np.int64)
    each = np.diff(np.append(heads, len(first)))
    length = (each + longest - 1).astype(np.int32)
    spots = np.repeat(place[heads] - (np.cumsum(length, dtype=np.int64) - length), length) + np.arange(int(length.sum()))
    return Graph(langs, words, word[spots], length, lang[place[heads]], n[heads], ends)


def _parts(lang: str, data: bytes, longest: int) -> Iterator[tuple[str, bytes, int]]:
    """A text in parts of about ``SLAB`` bytes, cut after a break; in a piece that is longer, between words, with the words that follow as context."""
    at = 0
    while len(data) - at > SLAB:
        end = max(data.rfind(bytes([c]), at, at + SLAB) for c in _BREAKS) + 1
        if end > at:
            yield lang, data[at:end], 0
            at = end
            continue
        end = max(data.rfind(bytes([c]), at, at + SLAB) for c in _GAPS) + 1
        if end <= at:  # a word longer than a slab
            found = re.compile(rb"[ \t.,;:!?\n-\r]").search(data, at + SLAB)
            end = found.start() if found else len(data)
        context = re.compile(rb"(?:[ \t]*" + _WORD + rb"){0,%d}" % (longest - 1)).match(data, end).group()
        yield lang, data[at:end] + context, len(re.findall(_WORD, context))
        at = end
    if len(data) > at:
        yield lang, data[at:], 0


def _graphs(df: DataFrame, lang: str, text: str, longest: int) -> DataFrame:
    schema = pa.schema([("graph", pa.binary()), ("edges", pa.int64())])

    def build(batches: Batches) -> Batches:
        held: list[tuple[str, bytes, int]] = []
        size = 0

        def close() -> pa.RecordBatch:
            made = graph(held, longest)
            return batch(schema, [made.packed()], [int((made.length - longest + 1).sum())])

        for b in batches:
            for name, t in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                for part in _parts(NO_LANG if name is None else name, (t or "").encode(), longest):
                    if held and size + len(part[1]) > SLAB:
                        yield close()
                        held, size = [], 0
                    held.append(part)
                    size += len(part[1])
        if held:
            yield close()

    return df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(build, "graph binary, edges long")


_ASKED = pa.schema([("cell", pa.int64()), ("counts", pa.binary())])
_FOUND = pa.schema([("cell", pa.int64()), ("counts", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])


def _sent(counts: Counts, bits: int) -> Batches:
    for cell, own in counts.cells(bits):
        yield batch(_ASKED, [cell], [own.packed()])


def _asked(graphs: DataFrame, length: int, longest: int, bits: int) -> DataFrame:
    """What the slabs know of runs of one length: edges if they are the longest, else the ends of pieces."""

    def ask(batches: Batches) -> Batches:
        for b in batches:
            for data in b["graph"].to_pylist():
                own = Graph.unpacked(data)
                yield from _sent(own.edges() if length == longest else own.ends[length - 1], bits)

    return graphs.select("graph").mapInArrow(ask, "cell long, counts binary")


def _answered(asked: DataFrame, least: int, bits: int) -> DataFrame:
    """Cells add up: rows for frequent runs, one for each language's words in the cell (no phrase), and rows of flow for the next shorter length."""

    def answer(batches: Batches) -> Batches:
        for run in runs(batches):
            parts = [Counts.unpacked(x) for b in run for x in b["counts"].to_pylist()]
            own = merged(parts)
            often = np.flatnonzero(own.n >= least)
            used, place = np.unique(own.rows[often, 1:], return_inverse=True)
            held = own.words.take(pa.array(used)).cast(pa.string()).to_numpy(zero_copy_only=False)
            place = place.reshape(len(often), own.length)
            langs = np.array(own.langs, dtype=object)
            for at in range(0, len(often), 1 << 16):
                rows = often[at : at + (1 << 16)]
                phrases = reduce(lambda x, y: x + " " + y, [held[c] for c in place[at : at + (1 << 16)].T])
                yield batch(_FOUND, [None] * len(rows), [None] * len(rows), langs[own.rows[rows, 0]], phrases, own.n[rows])
            if own.length == 1:
                sums = np.zeros(len(langs), np.int64)
                np.add.at(sums, own.rows[:, 0], own.n)
                yield batch(_FOUND, [None] * len(langs), [None] * len(langs), langs, [None] * len(langs), sums)
            else:
                for cell, flow in own.flow().cells(bits):
                    yield batch(_FOUND, [cell], [flow.packed()], [None], [None], [None])

    return asked.mapInArrow(answer, "cell long, counts binary, lang string, phrase string, a long")


def counts(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 1) -> DataFrame:
    """All runs of 1 to ``longest`` words that occur at least ``least`` times in a language: lang, words, phrase, a; and for each language
    a row of 0 words without a phrase, whose ``a`` counts all its words.

    Occurrences lie within a piece and may overlap. A null language is ``und``, a null text is empty; equal rows count as often as they are there;
    texts of any length are counted whole; other columns are not read; an empty table gives no rows.
    """
    if longest < 1 or least < 1:
        raise ValueError("longest and least are 1 or more")
    graphs = stored(_graphs(df, lang, text, longest), "phrase-graphs")
    cells = pieces(graphs.agg(F.sum("edges")).first()[0] or 0, CELL)
    bits, above, found = cells.bit_length() - 1, None, []
    for length in range(longest, 0, -1):
        asked = _asked(graphs, length, longest, bits)
        if above is not None:
            asked = asked.unionByName(above.filter("counts is not null").select("cell", "counts"))
        dealt = asked.repartition(cells, "cell").sortWithinPartitions("cell")
        above = stored(_answered(dealt, least, bits), f"phrase-counts-{length}")
        words = F.when(F.col("phrase").isNull(), 0).otherwise(length).alias("words")
        found.append(above.filter("counts is null").select("lang", words, "phrase", "a"))
    every = reduce(DataFrame.unionByName, found)
    totals = every.filter("words = 0").groupBy("lang").agg(F.sum("a").alias("a")).select("lang", F.lit(0).alias("words"), F.lit(None).cast("string").alias("phrase"), "a")
    out = stored(every.filter("words > 0").unionByName(totals), "phrase-counts")
    discard(graphs, *found)
    return out


def _side(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def mine(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate has 2 to ``longest`` words and a >= ``least`` occurrences. Cut after some words, its parts occur l and r times; the score is
    floor(1000000 * a * a / (l * r)) of the cut where that is least, the first such. Candidates that lie in a longer one with at least
    ``inside`` percent of their occurrences go. n counts the words of the language. By score, then a, descending, then phrase; so equal scores have
    one order. Rows, texts and languages count as in ``counts``.
    """
    known = counts(df, lang, text, longest, least)
    several = known.filter("words > 1").withColumn("w", F.split("phrase", " "))
    # a longer phrase that holds this one holds one of one word more that does, and that occurs at least as often
    longer = several.filter("words > 2").select("lang", "a", F.explode(F.array(F.expr(_side("w", "1", "words - 1")), F.expr(_side("w", "2", "words - 1")))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    free = several.join(most, ["lang", "phrase"], "left").filter(f"most is null or 100 * most < {int(inside)} * a")
    cuts = free.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr(_side("w", "1", "cut")).alias("first"), F.expr(_side("w", "cut + 1", "words - cut")).alias("rest"))
    parts = known.filter(f"words between 1 and {longest - 1}")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    wide = {c: f"cast({c} as decimal(19, 0))" for c in ("a", "l", "r")}
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(38, 0)) * ({wide['a']} * {wide['a']})) div ({wide['l']} * {wide['r']})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = best.withColumn("_score", -F.col("score")).withColumn("_a", -F.col("a"))
    first = first_rows(order, ["lang"], ["_score", "_a", "phrase"], top, "rank")
    totals = known.filter("words = 0").select("lang", F.col("a").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
