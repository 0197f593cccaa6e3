"""Plain versions that the operators are held against."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, rows):
    """Rows (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return (text or "").encode().split()


def word_sets(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    k = min(width, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def jaccard_groups(rows, least=0.8):
    """{(doc_id, text): (class_id, group_id, n_links)} by comparing all pairs."""
    sets = [word_sets(t) for _, t in rows]
    n, links = len(rows), []
    for i in range(n):
        for j in range(i + 1, n):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b) - 1e-9:
                links.append((i, j))
    return _described([k for k, _ in rows], sets, links)


def _described(keys, sets, links):
    n = len(keys)
    root, out = reach(n, links), []
    degree = np.zeros(n, int)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    low = lambda ids: min((k for k in ids if k is not None), default=None)
    group, same = {}, {}
    for i in range(n):
        group.setdefault(root[i], []).append(keys[i])
        same.setdefault(sets[i], []).append(keys[i])
    for i in range(n):
        alone = not sets[i]
        out.append((keys[i] if alone else low(same[sets[i]]), low(group[root[i]]), int(degree[i])))
    return out


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)))


def vector_groups(rows, least=0.93):
    """[(n_links, component_id)] of rows (key, vector, label)."""
    links = []
    for i, (_, v, x) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            w, y = rows[j][1], rows[j][2]
            if x is not None and x == y and usable(v) and usable(w) and len(v) == len(w) and cosine(v, w) >= least:
                links.append((i, j))
    return [(n, g) for _, g, n in _described([r[0] for r in rows], [frozenset([i]) for i in range(len(rows))], links)]


def neighbours(rows, every, number):
    """{(query, rank): (vec_id, score)} of rows (key, vector): vectors of one length are compared, a key's best vector counts, and none is its own neighbour."""
    by_size = {}
    for k, v in rows:
        if k is not None and usable(v):
            by_size.setdefault(len(v), []).append((k, v))
    found = {}
    for own in by_size.values():
        keys = np.array([k for k, _ in own])
        m = np.array([v for _, v in own], float)
        m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
        several = len(set(keys.tolist())) < len(keys)
        for i in np.flatnonzero(keys % every == 0):
            score = m @ m[i]
            take = range(len(keys)) if several else np.lexsort((keys, -np.round(score, 12)))[: number + 1]
            best = found.setdefault(int(keys[i]), {})
            for j in take:
                if keys[j] != keys[i]:
                    best[int(keys[j])] = max(best.get(int(keys[j]), -2.0), float(score[j]))
    out = {}
    for k, best in found.items():
        order = sorted(best, key=lambda j: (-round(best[j], 12), j))[:number]
        out |= {(k, r + 1): (j, best[j]) for r, j in enumerate(order)}
    return out


def whole_ids(texts, end):
    """Token ids of whole texts by the library alone, each with the end id."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def read(name, folder=FOLDER) -> pd.DataFrame:
    import pyarrow.parquet as pq

    return pq.read_table(f"{folder}/{name}.parquet").to_pandas()
