"""Phrases from the de Bruijn graph against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS

from logweir.llm import collocations
from logweir.llm.catalog import QUERIES

ODD = [
    None, "", " ", "a", "a b", "a b c", "A b C d", "a b. c d, e", "a  b\tc", "...", "a\x0bb\x0cc\rd", "é ü é ü é ü", "x x x x x x", "a,b;c:d!e?f",
    "ab cd ef", "İstanbul ÉTÉ Kelvin", " a b ", "a.b.c a.b.c", "漢字 かな 漢字 かな", "to be or not to be to be or not to be",
]


def plain_pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain_counts(rows, longest):
    """{(lang, words, phrase): a}, with the number of words under (lang, 0, None)."""
    out = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in plain_pieces(text):
            if p:
                out[lang, 0, None] += len(p)
            for k in range(1, longest + 1):
                for i in range(len(p) - k + 1):
                    out[lang, k, " ".join(p[i : i + k])] += 1
    return out


def plain_mine(rows, longest=3, least=10, inside=50, top=2000):
    f = plain_counts(rows, longest)
    often = {k: a for k, a in f.items() if k[1] > 1 and a >= least}
    out = {}
    for (lang, k, phrase), a in often.items():
        w = phrase.split(" ")
        if any(o[0] == lang and o[1] > k and 100 * b >= inside * a and any(o[2].split(" ")[i : i + k] == w for i in range(o[1] - k + 1)) for o, b in often.items()):
            continue
        cuts = []
        for c in range(1, k):
            x, y = f[lang, c, " ".join(w[:c])], f[lang, k - c, " ".join(w[c:])]
            cuts.append((1_000_000 * a * a // (x * y), c, x, y))
        score, _, x, y = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, x, y, f[lang, 0, None], score))
    return sorted((lang, i + 1, *r[3:]) for lang, found in out.items() for i, r in enumerate(sorted(found)[:top]))


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, (lang, t) in enumerate(rows)], DOCS)


def some_texts(n, seed, words=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "the", "OF"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, 30)))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_counts(spark, longest):
    rows = [(lang, t) for t in ODD for lang in ("en", "de\n", None)] + some_texts(200, 1)
    got = collocations.counts(table_of(spark, rows).repartition(5), longest=longest).collect()
    assert len(got) == len({(r.lang, r.words, r.phrase) for r in got})
    assert {(r.lang, r.words, r.phrase): r.a for r in got} == plain_counts(rows, longest)


@pytest.mark.parametrize("longest,least,inside,top", [(3, 10, 50, 2000), (4, 3, 50, 25), (2, 2, 0, 10), (3, 2, 90, 1)])
def test_mine(spark, longest, least, inside, top):
    rows = [("en", t) for t in ODD] + some_texts(400, 2) + [("en", "one and the same passage of words, repeated.")] * 30
    got = collocations.mine(table_of(spark, rows).withColumnsRenamed({"source": "a", "n_chars": "phrase"}), longest=longest, least=least, inside=inside, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_mine(rows, longest, least, inside, top)


def test_empty_and_null(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.mine(table_of(spark, [(None, None), ("en", ""), ("en", "...")])).collect() == []


def _sums(graphs, longest):
    out = Counter()
    for g in graphs:
        for own in [*g.ends, g.edges()]:
            for row, n in zip(own.rows, own.n, strict=True):
                out[own.langs[row[0]], tuple(own.words[int(i)].as_py().decode() for i in row[1:])] += int(n)
    return out


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
@pytest.mark.parametrize("slab", [1, 7, 40, 1 << 20])
def test_texts_in_parts(monkeypatch, longest, slab):
    """A text longer than a slab, with and without breaks, has the edges and ends that the whole text has."""
    monkeypatch.setattr(collocations, "SLAB", slab)
    texts = ["aa bb cc dd ee ff gg hh", "aa bb. cc dd ee\nff gg,hh ii jj kk ll mm nn", "averyverylongword of a kind  that\tgoes on", " . , ", "x y. z", *[t for t in ODD if t]]
    for text in texts:
        parts = list(collocations._parts("en", text.encode(), longest))
        got = _sums([collocations.graph([p], longest) for p in parts], longest)
        want = Counter()
        for p in plain_pieces(text):
            for i in range(len(p)):
                if i + longest <= len(p):
                    want["en", tuple(p[i : i + longest])] += 1
                else:
                    want["en", tuple(p[i:])] += 1
        assert got == want, text


def test_paths_are_compacted_and_kept_in_bytes():
    text = ("a passage of a dozen words that is repeated in every one of these documents\n" * 9).encode()
    own = collocations.Graph.unpacked(collocations.graph([("en", text, 0)], 3).packed())
    edges = own.edges()
    assert len(own.n) <= 3 and len(own.walk) < len(edges.n) + 3 * len(own.n) and set(edges.n) == {9}
    assert _sums([own], 3) == _sums([collocations.graph([("en", text, 0)], 3)], 3)


def test_codes_of_large_vocabularies():
    """Codes that would pass 64 bits are renumbered on the way."""
    words = [b"%d" % i for i in range(60_000)]
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = np.column_stack([rng.integers(0, 2, 2000), *(rng.integers(0, len(words), 2000) for _ in range(5))]).astype(np.int32)
    own = collocations.Counts(["a", "b"], pa.array(words, pa.binary()), np.concatenate((rows, rows[:500])), np.ones(2500, np.int64)).summed()
    assert len(own.n) == 2000 and own.n.sum() == 2500 and {tuple(r) for r in own.rows} == {tuple(r) for r in rows}
    parts = list(own.cells(4))
    assert len(parts) == 16 and sum(len(c.n) for _, c in parts) == 2000
    again = collocations.merged([c for _, c in parts] + [collocations.Counts.unpacked(own.packed())])
    assert (again.n.sum(), len(again.n)) == (5000, 2000)


def test_counts_pass_64_bits(spark):
    """Products of large counts are exact: a * a * 1000000 is beyond 64 bits here."""
    a, b = 5_000_000_011, 7_000_000_001
    one = spark.sql(f"select (cast(1000000 as decimal(38, 0)) * (cast({a} as decimal(19, 0)) * cast({a} as decimal(19, 0)))) div (cast({b} as decimal(19, 0)) * cast({b} as decimal(19, 0))) s")
    assert one.first().s == 1_000_000 * a * a // (b * b)


def test_op12_has_a_rank_for_each_row(spark):
    rows = QUERIES["op12_collocations"].job(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r.rank)
    assert rows and all(sorted(x) == list(range(1, len(x) + 1)) for x in by.values())
