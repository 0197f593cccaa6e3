"""Token ids of whole texts by the tokenizers library.

For a byte-level tokenizer, a text is cut before every single space that stands between two other characters than white
space: its pattern always starts a new piece there, and no merge crosses pieces, so the ids of a text are the ids of its cuts in
a row. Each worker keeps the ids of recent cuts and of their pieces. A new piece goes to the library's model; what the library
would do around that for every occurrence is done once. Texts with white space in other places or with the string of an added
token, and all texts of other kinds of tokenizers, are encoded by the library in one go.
"""

from __future__ import annotations

import json
import os

import numpy as np

KEPT_CUTS = 500_000
MARKS = frozenset(",.;:!?)|%$&*#")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it can be seen in Latin-1, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """``encode(texts)`` gives the ids of each text as little-endian unsigned 32-bit bytes; None counts as an empty text."""

    def __init__(self, path: str, kept: int = KEPT_CUTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.added = [x["content"] for x in parts.get("added_tokens") or [] if x["content"]]
        split = parts["pre_tokenizer"] or {}
        self.byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not parts["normalizer"] and not parts["post_processor"]
        self.model = self.tokenizer.model
        # Fixed value: the published pattern of byte-level tokenizers.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.letters = byte_letters()
        self.kept = kept
        self.cuts: list[dict[str, bytes]] = [{}, {}]  # young and old
        self.known: list[dict[str, bytes]] = [{}, {}]

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        ids = self.known[1].get(piece)
        if ids is None:
            text = piece.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])
        self.known[0][piece] = ids
        return ids

    def _learn(self, cuts: set[str]) -> None:
        """Ids of cuts that are not among the young ones. Cuts with white space at an end, and empty ones, stay unknown."""
        for kept in (self.cuts, self.known):
            if len(kept[0]) > self.kept:  # what is still in use comes back from the old ones
                kept[:] = [{}, kept[0]]
        (young, old), known, make = self.cuts, self.known[0], self._piece
        for cut in cuts:
            ids = old.get(cut)
            if ids is None:
                first = cut[:1] == " "
                bare = cut[1:] if first else cut
                if not bare or bare.strip() != bare:
                    continue
                text = bare if first else f" {bare}"
                # letters are one piece, and one mark after letters is another
                if bare.isalpha():
                    ids = known.get(text) or make(text)
                elif bare[-1] in MARKS and bare[:-1].isalpha():
                    ids = (known.get(text[:-1]) or make(text[:-1])) + (known.get(text[-1]) or make(text[-1]))
                else:
                    ids = b"".join([known.get(p) or make(p) for p in self.pieces(text)])
            young[cut] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.byte_level:
            return self._direct([t or "" for t in texts])
        out: list[bytes] = [b""] * len(texts)
        waiting: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        unknown: set[str] = set()
        get = self.cuts[0].get
        whole: list[int] = []
        for i, text in enumerate(texts):
            if text and any(x in text for x in self.added):
                whole.append(i)
            elif text:
                cuts = text.split(" ")
                cuts[0] = f" {cuts[0]}"  # the first cut has no space before it; no other cut has a space in it
                ids = list(map(get, cuts))
                if None in ids:
                    gaps = [j for j, x in enumerate(ids) if x is None]
                    unknown.update([cuts[j] for j in gaps])
                    waiting.append((i, cuts, ids, gaps))
                else:
                    out[i] = b"".join(ids)
        if unknown:
            self._learn(unknown)
        get = self.cuts[0].get
        for i, cuts, ids, gaps in waiting:
            for j in gaps:
                ids[j] = get(cuts[j])
            if None in ids:
                whole.append(i)
            else:
                out[i] = b"".join(ids)
        for i, ids in zip(whole, self._direct([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
