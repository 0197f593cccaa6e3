"""Packing documents into sequences of a fixed number of tokens.

Documents are encoded whole and end with one id. A document is cut into full sequences from its start; these need no packing. What is left over, one
piece of a document at most, is placed by first-fit decreasing: longest first, each into the first sequence of its group with room. A tournament tree
over the sequences' free room finds that sequence in logarithmic time. Pieces are numbered as they are written to a table of the shared folder;
groups are random, by a hash of that number, so that neither long documents nor rows that repeat make a group large: each has about
``group_rows`` pieces and is packed independently.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import Batches, batch, pieces, stored
from logweir.llm.tokens import default_tokenizer, encoder

LENGTH = 1024
END_ID = 0
GROUP_ROWS = 20_000

PIECES = "key long, number long, start long, length long, ids_crc32 long, doc_tokens long"
FULL = 1 << 62  # sequences of one full piece are numbered from here


class Room:
    """A tournament tree: each inner node holds the larger free room of its two sides, so the root knows if anything fits."""

    def __init__(self, places: int, room: int) -> None:
        self.leaves = 1 << max(0, (places - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def take(self, length: int) -> tuple[int, int]:
        """Put a piece into the first place with room: (place, room it had)."""
        most, node = self.most, 1
        if most[1] < length:
            raise ValueError("nothing has room")
        while node < self.leaves:
            node *= 2
            if most[node] < length:
                node += 1
        place, had = node - self.leaves, most[node]
        most[node] = had - length
        while node > 1:
            node //= 2
            larger = max(most[2 * node], most[2 * node + 1])
            if most[node] == larger:
                break
            most[node] = larger
        return place, had


def first_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing (ties: as given) of pieces no longer than ``length``: each piece's bin and offset there."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == length).sum())  # these come first and fill a bin each
    bins[order[:full]] = np.arange(full)
    if full < len(lengths):
        tree = Room(len(lengths) - full, length)
        for i in order[full:].tolist():
            place, had = tree.take(int(lengths[i]))
            bins[i], offsets[i] = full + place, length - had
    return bins, offsets


def encode_pieces(df: DataFrame, key: str, text: str, length: int, end_id: int, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with a ``number`` of its own; with ``with_ids`` also its token ids (binary, little-endian u32)."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [(n, pa.int64()) for n in ("key", "number", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 34
        for b in batches:
            rows = []
            for k, ids in zip(b["key"].to_pylist(), encoder(tokenizer).encode(b["text"].to_pylist()), strict=True):
                ids += end
                tokens = len(ids) // 4
                for at in range(0, tokens, length):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((k, number, at, len(part) // 4, zlib.crc32(part), tokens, part)[: len(fields)])
                    number += 1
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(fields)))

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None, seed: int = 0, group_rows: int = GROUP_ROWS, with_ids: bool = False) -> DataFrame:
    """Pack all documents (null text: empty, so the end id alone).

    Returns one row per piece: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (and ``ids``
    with ``with_ids``). Equal rows are documents of their own, in groups of their own; a null key stays null. Other columns are not read; an empty
    table gives no rows. Sequence ids are unique, not gapless: group number and place in the group, or the number of a full piece.
    Which pieces share a sequence depends on the layout of the table, for rows are told apart by their place in it.
    """
    rows = stored(encode_pieces(df, key, text, length, end_id, tokenizer or default_tokenizer(), with_ids), "pieces")
    rest = rows.filter(F.col("length") < length)
    groups = pieces(rest.count(), group_rows)
    out = f"{PIECES}, sequence_id long, offset long" + ", ids binary" * with_ids

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        # a stable order: the shuffle deals rows in any
        pdf = pdf.sort_values("number", ignore_index=True)
        bins, pdf["offset"] = first_fit(pdf["length"].to_numpy(), length)
        pdf["sequence_id"] = (pdf["grp"].to_numpy().astype(np.int64) << 32) + bins
        return pdf.drop(columns="grp")

    placed = rest.withColumn("grp", F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(groups))).groupBy("grp").applyInPandas(place, out)
    full = rows.filter(F.col("length") == length).withColumns({"sequence_id": F.col("number") + F.lit(FULL), "offset": F.lit(0).cast("long")})
    return placed.unionByName(full).drop("number").withColumnRenamed("key", key)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The token ids of each sequence from pieces packed ``with_ids``, padded to ``length`` (binary, little-endian u32)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    fill = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), (F.lit(length) - F.sum("length")).cast("int")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.concat(joined, fill).alias("ids"))
