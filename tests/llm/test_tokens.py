import random
import zlib

import numpy as np
import pytest
from helpers import FOLDER, crc, documents, read, whole_ids

from logweir.llm import packing, token_files
from logweir.llm.catalog import QUERIES
from logweir.llm.common import shared_path
from logweir.llm.tokens import Encoder, default_tokenizer

ODD = [None, "", " ", "  two  spaces ", "a\n\nb \n c", "ends with space ", "\tx", "<|endoftext|> x", "it's I'll 12 345!!", "é ü 中文 　 x", "word " * 3000 + "end"]


def test_cuts_give_the_ids_of_whole_texts():
    r = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "ab", "B", "é", "'s", "'", "7", "23", "!", " \n", " ", "　", "中", "\x1c", "​", "<|endoftext|>", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(20_000)] + ODD
    plain = Encoder(default_tokenizer())
    assert Encoder(default_tokenizer(), kept=200).encode(texts) == plain._direct([t or "" for t in texts])


def test_strings_of_added_tokens_are_their_ids(spark):
    """As the library has it by default: also inside words, after spaces and more than once."""
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "one <|endoftext|> two <|endoftext|><|endoftext|>", "a <|endoftext| > b", "plain words", None]
    plain = Tokenizer.from_file(default_tokenizer())
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(default_tokenizer()).encode(texts)] == want
    pieces = packing.pack(documents(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in pieces} == {i: (len(x) + 1, crc([*x, packing.END_ID])) for i, x in enumerate(want)}


def test_files_round_trip(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no key"), (3, "again"), (3, "again")]
    df = documents(spark, rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "start")
    path = shared_path(spark, "test-files")
    manifest = token_files.write(df, path, frame_ids=64)
    got = token_files.read(spark, path).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = whole_ids([t for _, t in ordered], 2)
    starts = np.cumsum([0] + [len(x) for x in ids])
    want = sorted((-1 if k is None else k, int(s), len(x), crc(x)) for (k, _), s, x in zip(ordered, starts, ids, strict=False))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    found = {}
    for r in manifest.collect():
        for k, parts in token_files.read_documents(path, r.file, {3, 30, None}).items():
            found.setdefault(k, []).extend(parts)
    assert len(found[3]) == 3 and len(found[None]) == 1
    assert (found[30][0] == whole_ids([ODD[10]], 2)[0]).all()


def test_a_damaged_frame_is_noticed(tmp_path):
    with open(tmp_path / "x.zst", "wb") as out:
        w = token_files.FileWriter(out, 8)
        for k in range(5):
            w.add(k, np.arange(6 * k, dtype="<u4").tobytes())
        w.close()
    data = bytearray((tmp_path / "x.zst").read_bytes())
    data[20] ^= 255
    (tmp_path / "y.zst").write_bytes(data)
    with pytest.raises(Exception):
        token_files.read_documents(str(tmp_path), "y.zst", {0, 1, 2, 3, 4})
    # any zstandard tool reads the whole file
    import zstandard

    with open(tmp_path / "x.zst", "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole == b"".join(np.arange(6 * k, dtype="<u4").tobytes() for k in range(5))


def test_files_of_no_documents(spark):
    path = shared_path(spark, "test-none")
    token_files.write(documents(spark, []), path)
    assert token_files.read(spark, path).count() == 0


def test_op6_over_its_table(spark):
    docs = read("documents").sort_values("doc_id")
    ids = whole_ids(docs["text"], 2)
    starts = np.cumsum([0] + [len(x) for x in ids])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_files"].job(spark, FOLDER).collect()}
    assert got == {k: (int(s), len(x), crc(x)) for k, s, x in zip(docs["doc_id"], starts, ids, strict=False)}


def _packed_right(rows, got, length=1024):
    """Each id lies in exactly one piece, and pieces lie in their sequences without gaps."""
    want = sorted((-1 if k is None else k, len(x), crc(x)) for (k, _), x in zip(rows, whole_ids([t for _, t in rows], 0), strict=True))
    by_row, by_sequence = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at <= length
    for r in got:
        by_row.setdefault((-1 if r.doc_id is None else r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    assert sum(n for p in by_row.values() for _, n, _ in p) == sum(n for _, n, _ in want)
    return by_sequence


def test_packing_of_odd_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no key"), (3, "again"), (3, "again")]
    df = documents(spark, rows).withColumnRenamed("lang", "sequence_id").withColumnRenamed("source", "length")
    got = packing.pack(df, with_ids=True)
    pieces = got.collect()
    _packed_right(rows, pieces)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    whole = packing.sequences(got).collect()
    assert all(len(r.ids) == 4 * 1024 for r in whole) and sum(r.used for r in whole) == sum(r.length for r in pieces)
    assert packing.pack(documents(spark, [])).count() == 0


def test_no_group_is_large(spark):
    """Rows that repeat and very long documents: a group holds about as many pieces as asked for, and full pieces are in none."""
    rows = [(3, "again and again")] * 6_000 + [(None, "no key")] * 3_000 + [(i, "long word " * 20_000) for i in range(10, 14)]
    df = documents(spark, rows).repartition(5)
    pieces = packing.pack(df, group_rows=500).collect()
    by_sequence = _packed_right(rows, pieces)
    groups = {}
    for r in pieces:
        if r.sequence_id < packing.FULL:
            groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
        else:
            assert (r.offset, r.length) == (0, 1024)
    assert sum(groups.values()) == 9_004 and max(groups.values()) < 700
    assert sum(s >= packing.FULL for s in by_sequence) == sum(r.length == 1024 for r in pieces) > 100


def test_op3_over_its_table(spark):
    docs = read("documents")
    rows = list(zip(docs["doc_id"].tolist(), docs["text"], strict=True))
    got = QUERIES["op3_packing"].job(spark, FOLDER).collect()
    by_sequence = _packed_right(rows, got)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (k, _), ids in zip(rows, whole_ids([t for _, t in rows], 0), strict=True):
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    used = sum(r.length for r in got)
    assert used / (1024 * len(by_sequence)) > 0.97


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 65, rng.integers(0, 80))
        bins, offsets = packing.first_fit(lengths, 64)
        free, order = [], sorted(range(len(lengths)), key=lambda i: -lengths[i])
        for i in order:
            place = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            if place == len(free):
                free.append(64)
            assert (bins[i], offsets[i]) == (place, 64 - free[place])
            free[place] -= lengths[i]
