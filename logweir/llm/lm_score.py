"""Language-model scores: cross-entropy difference of two matched bigram models.

One model is counted over the target documents, one over all documents. They are matched: one vocabulary, one order, one
smoothing. A word's probability after the word before it is (pair + weight * alone) / (word before + weight), where ``alone`` is its
add-one share of all words, one unseen word included. A document's score is its loss per word under the target model less that under the
background model; the lower, the more it reads like the target.

Every word, word before and pair has a count of its own, however many there are; each goes by a code of 64 bits. Documents are cut into
blocks of about ``BLOCK_WORDS`` words, kept as files of the shared folder. A block sends each of its distinct codes once, with its counts in the
block, to the code's cell; the cell adds up the counts of all blocks and answers each block in the order it asked. So a frequent word is one
row for each block, a task holds a block or a cell, and no machine holds a model.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import Batches, batch, discard, pieces, remove_path, runs, shared_path, stored

KEPT_WORDS = 400_000
BLOCK_WORDS, BLOCK_ROWS = 1 << 20, 1 << 16
CELLS, CELL_WORDS = 1 << 10, 1 << 23
START = 0x5DEECE66D  # the code before the first word
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_KINDS = np.uint64(3)  # the two lowest bits of a code: 0 a word, 1 a word before, 2 a pair
_CODES: dict[bytes, int] = {}


def _word_codes(text: str | None) -> np.ndarray:
    found = (text or "").encode().split()
    if len(_CODES) > KEPT_WORDS:
        _CODES.clear()
    for w in set(found).difference(_CODES):
        _CODES[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_CODES.__getitem__, found), np.uint64, len(found))


def _squeeze(values: np.ndarray) -> bytes:
    """Like bytes of all numbers side by side, compressed."""
    import zstandard

    side = np.ascontiguousarray(values).reshape(-1, 1).view(np.uint8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(side) if side else b""


def _unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, dtype)
    side = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(side.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class Block:
    """Documents of one block: their keys, lengths in words, and words by their place in the block's sorted vocabulary."""

    def __init__(self, keys: list[int | None], lengths: np.ndarray, vocabulary: np.ndarray, words: np.ndarray) -> None:
        self.keys, self.lengths, self.vocabulary, self.words = keys, lengths, vocabulary, words

    @classmethod
    def of(cls, keys: list[int | None], found: list[np.ndarray]) -> Block:
        vocabulary, words = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True)
        return cls(keys, np.array([len(x) for x in found], np.int64), vocabulary, words.astype(np.uint32))

    def save(self, path: str) -> None:
        known = np.array([k is not None for k in self.keys], bool)
        keys = np.array([k or 0 for k in self.keys], np.int64)
        held = io.BytesIO()
        packed = {"vocabulary": np.diff(self.vocabulary, prepend=np.uint64(0)), "words": self.words}
        np.savez(held, keys=keys, known=known, lengths=self.lengths, **{n: np.frombuffer(_squeeze(x), np.uint8) for n, x in packed.items()})
        folder, file = pafs.FileSystem.from_uri(path)
        folder.create_dir(file.rpartition("/")[0], recursive=True)
        with folder.open_output_stream(file) as out:
            out.write(held.getvalue())

    @classmethod
    def load(cls, path: str) -> Block:
        folder, file = pafs.FileSystem.from_uri(path)
        with folder.open_input_stream(file) as f:
            held = np.load(io.BytesIO(f.read()))
        keys = [int(k) if known else None for k, known in zip(held["keys"], held["known"], strict=True)]
        vocabulary = np.cumsum(_unsqueeze(held["vocabulary"].tobytes(), np.uint64), dtype=np.uint64)
        return cls(keys, held["lengths"], vocabulary, _unsqueeze(held["words"].tobytes(), np.uint32))

    def grams(self) -> Grams:
        n = len(self.vocabulary)
        word = self.words.astype(np.int64)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        ends = np.cumsum(self.lengths)
        before[(ends - self.lengths)[self.lengths > 0]] = n
        pairs, pair = np.unique(before * max(n, 1) + word, return_inverse=True)
        pair_before, pair_word = np.divmod(pairs, max(n, 1))
        contexts = np.append(self.vocabulary, np.uint64(START))
        codes = (contexts[pair_before] * _PAIR + self.vocabulary[pair_word]) if len(pairs) else np.zeros(0, np.uint64)
        codes = (codes ^ (codes >> np.uint64(31))) * _MIX
        kinds = (self.vocabulary * _MIX, contexts * _MIX, codes)
        codes = np.concatenate([k & ~_KINDS | np.uint64(i) for i, k in enumerate(kinds)])
        order = np.argsort(codes, kind="stable")
        return Grams(word, before, pair, pair_word, pair_before, codes[order], order)


@dataclass
class Grams:
    word: np.ndarray  # of each place in the text
    before: np.ndarray
    pair: np.ndarray
    pair_word: np.ndarray  # of each distinct pair
    pair_before: np.ndarray
    codes: np.ndarray  # sorted: of the vocabulary, of the words before (the start last), of the pairs
    order: np.ndarray

    def counts(self, n_words: int, kept: np.ndarray | None = None) -> np.ndarray:
        """How often each code occurs in the block, or at the kept places."""
        parts = ((self.word, n_words), (self.before, n_words + 1), (self.pair, len(self.pair_word)))
        return np.concatenate([np.bincount(x if kept is None else x[kept], minlength=n) for x, n in parts])[self.order]


def _blocks(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """A row for each document: block, place there, key, number of words. The words themselves are in the blocks' files."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64())])

    def cut(batches: Batches) -> Batches:
        keys: list[int | None] = []
        found: list[np.ndarray] = []
        words = 0

        def close() -> Batches:
            number = uuid.uuid4().int >> 65
            block = Block.of(keys, found)
            block.save(f"{path}/{number}")
            yield batch(schema, [number] * len(keys), range(len(keys)), keys, block.lengths)

        for b in batches:
            for k, t in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                keys.append(k)
                found.append(_word_codes(t))
                words += len(found[-1])
                if words >= BLOCK_WORDS or len(keys) >= BLOCK_ROWS:
                    yield from close()
                    keys, found, words = [], [], 0
        if keys:
            yield from close()

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(cut, "block long, place long, key long, n_words long")


def _asked(flagged: DataFrame, path: str, bits: int) -> DataFrame:
    """A row for each block and cell: the codes of the block that lie in the cell, with their counts there."""
    schema = pa.schema([("cell", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])

    def ask(batches: Batches) -> Batches:
        for b in batches:
            for number, places in zip(b["block"].to_pylist(), b["own"].to_pylist(), strict=True):
                block = Block.load(f"{path}/{number}")
                grams, n = block.grams(), len(block.vocabulary)
                own = np.zeros(len(block.keys), bool)
                own[np.array(places, np.int64)] = True
                counts = np.stack([grams.counts(n), grams.counts(n, np.repeat(own, block.lengths))], axis=1)
                cells = (grams.codes >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.diff(cells, prepend=-1))
                rows = []
                for at, end in zip(first, np.append(first[1:], len(cells)), strict=True):
                    rows.append((int(cells[at]), number, _squeeze(np.diff(grams.codes[at:end], prepend=np.uint64(0))), _squeeze(counts[at:end])))
                yield batch(schema, *zip(*rows, strict=True))  # the start is in every block, so there is a row

    return flagged.mapInArrow(ask, "cell long, block long, codes binary, counts binary")


def _answers(asked: DataFrame) -> DataFrame:
    """The rows of ``_asked`` with the counts over all blocks. A cell's first row also has its sums: distinct words, words, the target's words."""
    names = ("cell", "part", "counts", "vocabulary", "words", "own_words")
    schema = pa.schema([(n, pa.binary() if n == "counts" else pa.int64()) for n in names])

    def answer(batches: Batches) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            rows = [r for b in run for r in zip(*(b[n].to_pylist() for n in ("cell", "block", "codes", "counts")), strict=True)]
            codes = [np.cumsum(_unsqueeze(r[2], np.uint64), dtype=np.uint64) for r in rows]
            counts = np.concatenate([_unsqueeze(r[3], np.int64).reshape(-1, 2) for r in rows])
            distinct, which = np.unique(np.concatenate(codes), return_inverse=True)
            sums = np.zeros((len(distinct), 2), np.int64)
            for model in (0, 1):
                part = counts[:, model]
                hit = np.flatnonzero(part)
                np.add.at(sums[:, model], which[hit], part[hit])
            words = (distinct & _KINDS) == 0
            totals = (int(words.sum()), *(int(x) for x in sums[words].sum(axis=0)))
            at, out = 0, []
            for (cell, block, *_), own in zip(rows, codes, strict=True):
                out.append((block, cell, _squeeze(sums[which[at : at + len(own)]]), *totals))
                at, totals = at + len(own), (0, 0, 0)
            for at in range(0, len(out), 512):
                yield batch(schema, *zip(*out[at : at + 512], strict=True))

    return asked.mapInArrow(answer, "cell long, part long, counts binary, vocabulary long, words long, own_words long")


def _losses(answers: DataFrame, path: str, totals: tuple[float, float], vocabulary: int, weight: float) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])

    def losses(batches: Batches) -> Batches:
        for run in runs(batches):
            block = Block.load(f"{path}/{run[0]['cell'][0].as_py()}")
            grams, n = block.grams(), len(block.vocabulary)
            sums = np.concatenate([_unsqueeze(x, np.int64).reshape(-1, 2) for b in run for x in b["counts"].to_pylist()])
            counts = np.empty(sums.shape)
            counts[grams.order] = sums
            words, before, pairs = np.split(counts, [n, 2 * n + 1])
            document = np.repeat(np.arange(len(block.keys)), block.lengths)
            found = []
            for model in (1, 0):
                alone = (words[grams.pair_word, model] + 1.0) / (totals[model] + vocabulary)
                loss = -np.log((pairs[:, model] + weight * alone) / (before[grams.pair_before, model] + weight))
                found.append(np.bincount(document, loss[grams.pair], len(block.keys)) / np.maximum(block.lengths, 1))
            yield batch(schema, block.keys, block.lengths, *found)

    return answers.mapInArrow(losses, "key long, n_words long, target_loss double, background_loss double")


def score(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", weight: float = 100.0) -> DataFrame:
    """Every document's ``n_words``, ``target_loss``, ``background_loss`` (nats per word) and ``score``, their difference.

    ``target``: the keys of the target documents. A text without words (null, empty, blank) has losses and score 0. A key
    on several rows: each is scored, and each counts. With an empty target its model is that of unseen words. Other columns are
    not read; an empty table gives no rows. Two pairs whose codes are alike share a count: of n distinct ones about n * n / 2^63.
    """
    spark = df.sparkSession
    path = shared_path(spark, "lm-blocks")
    docs = stored(_blocks(df, key, text, path), "lm-documents")
    n_blocks, n_words = docs.agg(F.sum((F.col("place") == 0).cast("long")), F.sum("n_words")).first()
    n_blocks, n_words = n_blocks or 0, n_words or 0
    # the target's keys grow with the documents: they are never broadcast, whatever the size
    mine = target.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct()
    own = docs.filter("key is not null").join(mine.hint("merge"), "key", "left_semi").select("block", "place")
    own = own.unionByName(docs.filter("place = 0").select("block", F.lit(None).cast("long").alias("place")))  # blocks without target
    flagged = own.groupBy("block").agg(F.collect_list("place").alias("own")).repartition(max(1, n_blocks), "block")
    cells = max(CELLS, pieces(n_words, CELL_WORDS))
    asked = _asked(flagged, path, cells.bit_length() - 1).repartition(min(cells, pieces(n_words, CELL_WORDS // 4)), "cell").sortWithinPartitions("cell")
    answers = stored(_answers(asked), "lm-answers")
    distinct, *totals = (x or 0 for x in answers.agg(F.sum("vocabulary"), F.sum("words"), F.sum("own_words")).first())
    given = answers.select("cell", "part", "counts").repartition(max(1, n_blocks), "cell").sortWithinPartitions("cell", "part")
    scored = stored(_losses(given, path, (totals[0], totals[1]), distinct + 1, weight), "lm-scores")
    discard(docs, answers)
    remove_path(spark, path)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("key", key)
