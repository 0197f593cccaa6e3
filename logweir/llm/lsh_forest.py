"""N-gram Jaccard join by a MinHash LSH forest.

Texts are sets of their runs of five words. Equal sets are one class. Each class has a signature of min-hashes, split into
trees; a tree is the prefix trie of its part of all signatures. Two classes are candidates if they share a prefix in some
tree. The join starts with the longest prefixes and shortens them until the links that it must be missing, as estimated
from those it finds and their chance to be found, are fewer than the target recall allows. Candidates whose whole
signatures agree far too little are no candidates. What is left joins classes into families, in which all pairs are
verified exactly, so links inside a family can't be missed.

Buckets and families of any size are cut into blocks, and each pair of blocks is a piece of work of its own: no task holds a
bucket or a family, and pairs live only inside a task. What tasks send on is linear in what they read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logweir.llm.common import WORD, Batches, batch, discard, runs, stored
from logweir.llm.components import components, stars

_MIX1, _MIX2, _WORD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS = 200_000
PAIRS_PER_FLUSH = 1 << 18


@dataclass(frozen=True)
class Forest:
    words: int = 5
    similarity: float = 0.8
    trees: int = 20
    depth: int = 6
    recall: float = 0.9995
    slack: float = 5.0  # standard errors below the similarity at which a signature still counts
    seed: int = 1
    bucket_block: int = 2048  # classes
    family_block: int = 100_000  # runs of words

    @property
    def hashes(self) -> int:
        return self.trees * self.depth

    @property
    def least_agreement(self) -> int:
        s = self.similarity
        return int(np.floor(self.hashes * s - self.slack * np.sqrt(self.hashes * s * (1 - s))))

    def chance(self, similarity: np.ndarray, depth: int) -> np.ndarray:
        """That two sets share a prefix of ``depth`` in some tree."""
        return 1.0 - (1.0 - similarity**depth) ** self.trees


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_WORDS: dict[bytes, int] = {}


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of ``words`` words, ascending. A shorter text is one run; without words: none.

    Words are what ASCII white space separates.
    """
    found = (text or "").encode().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > KEPT_WORDS:
        _WORDS.clear()
    for w in set(found).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    width = min(words, len(codes))
    run = np.full(len(codes) - width + 1, np.uint64(width))
    for i in range(width):
        run = run * _WORD + codes[i : i + len(run)]
    return np.unique(_mixed(run))


@cache
def _hashes(number: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, number, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, number, np.uint64)


def signature(found: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    odd, add = _hashes(hashes, seed)
    least = np.full(hashes, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        np.minimum(least, (odd[:, None] * found[None, at : at + 2048] + add[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def signed(df: DataFrame, key: str, text: str, forest: Forest) -> DataFrame:
    """Each row's key, hash of its text, class (a hash of its set; null without words), number of runs, signature."""
    schema = pa.schema([("key", pa.int64()), ("text_hash", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())])

    def sign(batches: Batches) -> Batches:
        for b in batches:
            cls, n, sig = [], [], []
            for t in b["text"].to_pylist():
                found = shingles(t, forest.words)
                n.append(len(found))
                cls.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                sig.append(signature(found, forest.hashes, forest.seed).tobytes() if len(found) else None)
            yield batch(schema, b["key"], b["text_hash"], cls, n, sig)

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(sign, "key long, text_hash long, cls long, n int, sig binary")


def _cells(df: DataFrame, group: str, number: Column, block: Column) -> DataFrame:
    """Rows of groups cut into ``number`` blocks: one copy for each pair of blocks that the row's own takes part in."""
    df = df.withColumn("blocks", number).withColumn("block", block)
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))
    return df.withColumn("cell", cell).withColumn("pair", F.col("block") != F.col("other")).drop("other", "blocks")


def _pairs_of_runs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows in the same run, a bounded number at a time. Runs: by start and size."""
    for size in np.unique(sizes):
        if size < 2:
            continue
        begin = starts[sizes == size]
        if size <= 256:
            i, j = np.triu_indices(int(size), 1)
            each = max(1, PAIRS_PER_FLUSH // len(i))
            for at in range(0, len(begin), each):
                part = begin[at : at + each, None]
                yield (part + i).ravel(), (part + j).ravel()
        else:
            step = 512
            for s in begin.tolist():
                for x in range(0, int(size), step):
                    for y in range(x, int(size), step):
                        i, j = np.meshgrid(np.arange(x, min(x + step, size)), np.arange(y, min(y + step, size)), indexing="ij")
                        upper = i < j
                        yield s + i[upper], s + j[upper]


def candidates(classes: DataFrame, depth: int, forest: Forest) -> DataFrame:
    """Stars of classes that share a prefix of ``depth`` hashes in some tree and agree in enough of their signatures.

    Rows a, b, weight: a link if weight is null; otherwise ``weight`` pairs that agree in ``a`` hashes.
    """
    width = 4 * depth
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * (4 * forest.depth) + 1, F.lit(width)))))
    tries = classes.select("cls", tree.alias("tree", "bucket")).drop("tree")
    shared = tries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = tries.join(shared, "bucket")
    blocks = F.ceil(F.col("size") / forest.bucket_block)
    members = _cells(members, "bucket", blocks, F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")))
    members = members.select("cls", "cell", "block", "pair").join(classes.select("cls", "sig"), "cls")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("weight", pa.float64())])
    least, trees, deep = forest.least_agreement, forest.trees, forest.depth

    def compare(batches: Batches) -> Batches:
        seen = np.zeros(trees * deep + 1)
        for held in runs(batches):
            t = pa.Table.from_batches(held)
            cell, cls, block = (t[c].to_numpy() for c in ("cell", "cls", "block"))
            cross = t["pair"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(len(cls), trees * deep)
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(cell)])))
            a, b = [], []
            for i, j in _pairs_of_runs(starts, sizes):
                due = ~cross[i] | (block[i] != block[j])
                i, j = i[due], j[due]
                for at in range(0, len(i), 8192):
                    x, y = i[at : at + 8192], j[at : at + 8192]
                    same = sig[x] == sig[y]
                    agree = same.sum(axis=1)
                    near = agree >= least
                    x, y, same, agree = x[near], y[near], same[near], agree[near]
                    found_in = same.reshape(-1, trees, deep)[:, :, :depth].all(axis=2).sum(axis=1)
                    np.add.at(seen, agree, 1.0 / np.maximum(found_in, 1))
                    a.append(cls[x])
                    b.append(cls[y])
                if sum(map(len, a)) > 4 * PAIRS_PER_FLUSH:
                    p, q = stars(np.concatenate(a), np.concatenate(b))
                    a, b = [p], [q]
            if a and (p := stars(np.concatenate(a), np.concatenate(b)))[0].size:
                yield batch(schema, p[0], p[1], [None] * len(p[0]))
        hit = np.flatnonzero(seen)
        if hit.size:
            yield batch(schema, hit, np.full(len(hit), -1), seen[hit])

    return members.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long, weight double")


def search(classes: DataFrame, forest: Forest) -> DataFrame:
    """Links between classes that may be similar, with prefixes as short as the target recall asks for."""
    for depth in range(forest.depth, 0, -1):
        found = stored(candidates(classes, depth, forest), "candidates")
        agreed = found.filter("weight is not null").groupBy("a").agg(F.sum("weight").alias("weight")).toArrow().to_pandas()
        similarity = agreed["a"].to_numpy(float) / forest.hashes
        similar = similarity >= forest.similarity
        seen = agreed["weight"].to_numpy(float)[similar]
        there = (seen / forest.chance(similarity[similar], depth)).sum()
        # without a single pair the target is judged at the similarity itself
        recall = seen.sum() / there if there else float(forest.chance(np.array(forest.similarity), depth))
        if recall >= forest.recall or depth == 1:
            break
        discard(found)
    return found.filter("weight is null").select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many runs of words each set on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    if len(left) * len(right) <= 64:
        for x, p in enumerate(left):
            for y, q in enumerate(right):
                out[x, y] = len(np.intersect1d(p, q, assume_unique=True))
        return out
    ids, where = np.unique(np.concatenate(left + right), return_inverse=True)
    own = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    on_left = own < len(left)
    shared = np.zeros(len(ids), bool)
    shared[where[on_left]] = True
    both = np.zeros(len(ids), bool)
    both[where[~on_left]] = True
    both &= shared
    column = np.cumsum(both) - 1
    use = both[where]
    row, col = own[use], column[where[use]]
    for at in range(0, int(both.sum()), 4096):
        here = (col >= at) & (col < at + 4096)
        table = np.zeros((len(left) + len(right), 4096), np.float32)
        table[row[here], col[here] - at] = 1.0
        out += table[: len(left)] @ table[len(left) :].T
    return out


def verify(families: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """All links inside families, exactly. ``families``: family, cls, copies, n, key, text_hash.

    Rows: cls, links (copies of other classes linked to it, as seen in one cell), root (a class that it reaches there).
    """
    sizes = families.groupBy("family").agg(F.sum("n").alias("runs"))
    members = families.join(sizes, "family")
    blocks = F.ceil(F.col("runs") / forest.family_block)
    members = _cells(members, "family", blocks, F.pmod(F.xxhash64("cls", F.lit(11)), F.col("blocks")))
    # equal rows bring a class more than once: the first counts
    members = members.select("cls", "copies", "cell", "block", "pair", F.col("key").alias("k"), F.col("text_hash").alias("h"))
    found = members.join(texts, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("text_hash"))).select("cls", "copies", "cell", "block", "pair", "text")
    parts = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    width, least = forest.words, forest.similarity

    def compare(batches: Batches) -> Batches:
        for held in runs(batches):
            t = pa.Table.from_batches(held)
            cell = t["cell"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            ends = np.concatenate((starts[1:], [len(cell)]))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                part = t.slice(s, e - s)
                cls, first = np.unique(part["cls"].to_numpy(), return_index=True)
                if len(cls) < 2:
                    continue
                part = part.take(first)
                copies, block, cross = (part[c].to_numpy() for c in ("copies", "block", "pair"))
                sets = [shingles(x, width) for x in part["text"].to_pylist()]
                out.append(_links(cls, copies, block, bool(cross[0]), sets, least))
            if out:
                yield batch(schema, *(np.concatenate(c) for c in zip(*out, strict=True)))

    return found.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(compare, "cls long, links long, root long")


def _links(cls: np.ndarray, copies: np.ndarray, block: np.ndarray, cross: bool, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sets], np.float64)
    if cross:
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        if block.min() == block.max():
            left, right = left[:0], right[:0]
    else:
        left = right = np.arange(len(cls))
    links, a, b = np.zeros(len(cls), np.int64), [cls[:0]], [cls[:0]]
    for x in range(0, len(left), 512):
        for y in range(0, len(right), 512):
            i, j = left[x : x + 512], right[y : y + 512]
            if not cross and y < x:
                continue
            both = overlaps([sets[k] for k in i], [sets[k] for k in j]).astype(np.float64)
            near = both >= least * (size[i][:, None] + size[j][None, :] - both) - 1e-9
            if not cross:
                near &= i[:, None] < j[None, :]
            links[i] += near @ copies[j]
            links[j] += copies[i] @ near
            p, q = np.nonzero(near)
            p, q = stars(cls[i[p]], cls[j[q]])
            a.append(p)
            b.append(q)
    node, root = stars(np.concatenate(a), np.concatenate(b))
    top = cls.copy()
    top[np.searchsorted(cls, node)] = root
    linked = links > 0
    return cls[linked], links[linked], top[linked]


def join(df: DataFrame, key: str = "doc_id", text: str = "text", forest: Forest | None = None) -> DataFrame:
    """Every row's key and ``text_hash``, class, group and links, at a Jaccard similarity of ``forest.similarity`` or more.

    ``class_id``: the smallest key among rows with the same runs of words. ``n_links``: other rows that are linked
    directly, those of the same class included. ``group_id``: the smallest key that links lead to. Rows without words (null,
    empty or blank texts) link with nothing and are their own class and group; so do null keys count only where a class or group
    has no other (then its ids are null). Equal rows are rows of one class. Other columns are not read; an empty table
    gives no rows.
    """
    return _joined(df, key, text, forest or Forest()).drop("root").withColumnRenamed("key", key)


def _joined(df: DataFrame, key: str, text: str, forest: Forest) -> DataFrame:
    rows = stored(signed(df, key, text, forest), "signatures")
    with_words = rows.filter("cls is not null")
    classes = stored(
        with_words.groupBy("cls").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.min("key").alias("class_id"), F.min(F.struct("key", "text_hash")).alias("one")), "classes"
    )
    links = search(classes, forest)
    families = components(links).withColumnRenamed("node", "cls").withColumnRenamed("root", "family")
    described = classes.select("cls", "copies", "n", F.col("one.key").alias("key"), F.col("one.text_hash").alias("text_hash"))
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    verified = stored(verify(families.join(described, "cls"), texts, forest), "verified")
    counts = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    small = classes.select("cls", "copies", "class_id").join(groups, "cls", "left").join(counts, "cls", "left")
    small = small.withColumn("root", F.coalesce("root", "cls"))
    smallest = small.groupBy("root").agg(F.min("class_id").alias("group_id"))
    small = stored(small.join(smallest, "root").select("cls", "root", "class_id", "group_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "groups")
    discard(classes, links, families, verified, groups)
    grouped = with_words.select("key", "text_hash", "cls").join(small, "cls").drop("cls")
    alone = rows.filter("cls is null").select("key", "text_hash", F.lit(None).cast("long").alias("root"), F.col("key").alias("class_id"), F.col("key").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return grouped.unionByName(alone)


def keep(df: DataFrame, key: str = "doc_id", text: str = "text", forest: Forest | None = None) -> DataFrame:
    """The rows of ``df``, all columns, without all but one row of each group: the one with the smallest key, then text hash.

    Null keys come after all others. Rows without words all stay. Of rows with equal key and text any one stays.
    """
    names, row = df.columns, ["__null", "__key", "__hash"]
    found = _joined(df, key, text, forest or Forest()).filter("root is not null")
    found = found.select("root", F.col("key").isNull().alias("__null"), F.coalesce("key", F.lit(0)).alias("__key"), F.col("text_hash").alias("__hash"))
    first = found.groupBy("root", *row).count().groupBy("root").agg(F.min(F.struct(*row, F.col("count").alias("__rows"))).alias("one"))
    kept = stored(first.select("one.*"), "kept")
    has_words = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    worded = df.filter(has_words).withColumns({"__null": F.col(key).isNull(), "__key": F.coalesce(F.col(key).cast("long"), F.lit(0)), "__hash": F.xxhash64(text)})
    out = worded.join(kept.filter("__rows = 1"), row, "left_semi").select(*names).unionByName(df.filter(~has_words))
    several = kept.filter("__rows > 1")
    if several.isEmpty():
        return out
    ones = worded.join(several, row, "left_semi").groupBy(*row).agg(F.first(F.struct(*[F.col(c) for c in names])).alias("__one"))
    return out.unionByName(ones.select("__one.*"))
