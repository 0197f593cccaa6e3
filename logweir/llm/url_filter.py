"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame and SQL functions only. The model is trained from a small labelled URL table by gradient descent inside one
expression: the fold's state is the weights of the features that occur in that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 1 << 14
SIZES = (3, 4, 5)
EPOCHS = 300
RATE = 2.0
DECAY = 0.0005
MOST_LABELLED = 500

# verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# url, 1: to block
LABELLED = (
    ("http://www.cheap-pills.example.com/fr/176/", 1),
    ("https://cheap-meds-online.example.org/buy/now", 1),
    ("http://best-casino-bonus.example.com/win/free-spins", 1),
    ("https://free-casino.example.org/slots?ref=x", 1),
    ("http://spam-farm.example.org/en/728", 1),
    ("https://link-farm.example.com/links/1.html", 1),
    ("http://replica-watches.example.com/cheap/sale", 1),
    ("https://pills-discount.example.org/order", 1),
    ("http://win-money-fast.example.com/click/here", 1),
    ("https://hot-singles.example.org/adult/free", 1),
    ("http://adult-cams.example.com/live", 1),
    ("https://payday-loans-now.example.org/apply?id=3", 1),
    ("http://free-download-crack.example.com/keygen/setup.exe", 1),
    ("https://spam-mailer.example.com/bulk/list", 1),
    ("http://lottery-winner.example.org/claim/prize", 1),
    ("https://seo-farm.example.com/backlinks/cheap", 1),
    ("http://online-pharmacy.example.org/viagra", 1),
    ("https://bet-casino.example.com/poker", 1),
    ("http://www.example.com/en/about", 0),
    ("https://blog.thering.example.org/en/331", 0),
    ("https://m.therin.example.com/fr/770", 0),
    ("http://news.example.org/en/2024/05/world", 0),
    ("https://library.example.com/en/books/catalog.html", 0),
    ("http://university.example.org/research/papers", 0),
    ("https://docs.example.com/en/guide/install", 0),
    ("http://museum.example.org/es/collection/12", 0),
    ("https://www.tionsh.example.com/es/240.html", 0),
    ("http://ththre.example.org/de/825", 0),
    ("https://recipes.example.com/en/soup.html", 0),
    ("http://weather.example.org/en/city/forecast", 0),
    ("https://city-council.example.com/en/minutes/2023", 0),
    ("http://history.example.org/en/article/54", 0),
    ("https://science.example.com/de/artikel/9", 0),
    ("http://www.therend.example.org/es/61/", 0),
    ("https://travel-notes.example.com/en/spain", 0),
    ("http://open-data.example.org/tables/7", 0),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (struct ``rule``, ``verdict``) whose host is the url's or a parent of it and whose path starts the url's. Of equally long ones the first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The distinct hashed character n-grams of host and path, each with its ends marked."""

    def of(name: str, part: Column, n: int) -> Column:
        marked = F.concat(F.lit("^"), part, F.lit("$"))
        last = F.length(marked) - (n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(name), F.substring(marked, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*[of(name, part, n) for name, part in (("h", host), ("p", path)) for n in SIZES]))


def labelled(spark: SparkSession, rows: Sequence[tuple[str, int]] = LABELLED) -> DataFrame:
    """A labelled URL table from a list."""
    values = ", ".join("('{}', {})".format(u.replace("\\", "\\\\").replace("'", "\\'"), int(y)) for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def fit(table: DataFrame, buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> tuple[list[float], float]:
    """Weights by bucket and the bias, from columns ``url`` and ``label`` (1: block; null labels teach nothing).

    The table is small by contract (``MOST_LABELLED`` rows): all of it is one row's arrays. No row at all: zero weights.
    """
    host, path = parts(F.col("url"))
    rows = table.filter("label is not null").select("url", F.col("label").cast("double").alias("y"), grams(host, path, buckets).alias("grams"))
    size = rows.count()
    if size > MOST_LABELLED:
        raise ValueError(f"the labelled table has {size} rows; it may have {MOST_LABELLED}")
    if not size:
        return [0.0] * buckets, 0.0
    examples = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "grams"))).alias("all"))
    numbered = examples.select(F.posexplode("all").alias("e", "row"))
    numbered = numbered.select("e", "row.y", F.explode("row.grams").alias("bucket"), (1 / F.sqrt(F.size("row.grams"))).alias("x"))
    # features by number, each with the examples that have it; examples with the numbers of their features
    features = numbered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("e", "x"))).alias("of"))
    features = features.agg(F.array_sort(F.collect_list(F.struct("bucket", "of"))).alias("features"))
    joined = examples.unionByName(features, allowMissingColumns=True).agg(F.first("all", ignorenulls=True).alias("all"), F.first("features", ignorenulls=True).alias("features"))
    joined = joined.select("features", F.expr("map_from_arrays(transform(features, f -> f.bucket), transform(features, (f, i) -> i))").alias("number"), "all")
    joined = joined.select("features", F.expr("transform(all, r -> struct(r.y as y, 1 / sqrt(greatest(size(r.grams), 1)) as x, transform(r.grams, g -> number[g]) as f))").alias("examples"))
    descent = f"""
        aggregate(
            sequence(1, {epochs}),
            struct(transform(features, f -> 0D) as w, 0D as b),
            (s, t) -> aggregate(
                array(transform(examples, r -> (1 / (1 + exp(-(s.b + r.x * aggregate(r.f, 0D, (z, i) -> z + s.w[i]))))) - r.y)),
                s,
                (u, error) -> struct(
                    transform(features, (f, i) -> s.w[i] - {rate}D * ({decay}D * s.w[i] + aggregate(f.of, 0D, (g, o) -> g + error[o.e] * o.x) / size(examples))) as w,
                    s.b - {rate}D * aggregate(error, 0D, (g, e) -> g + e) / size(examples) as b
                )
            )
        )"""
    model = joined.select(F.expr(descent).alias("m"), F.transform("features", lambda f: f["bucket"]).alias("bucket")).first()
    weights = [0.0] * buckets
    if model is None:  # no example has a gram
        share = rows.agg(F.avg("y")).first()[0]
        return weights, 1.0 if share > 0.5 else -1.0
    for b, w in zip(model["bucket"], model["m"]["w"], strict=True):
        weights[b] = w
    return weights, model["m"]["b"]


def probability(host: Column, path: Column, weights: Sequence[float], bias: float) -> Column:
    """That a url is to be blocked. The weights are a literal: ``len(weights)`` is its bound."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    found = grams(host, path, len(weights))
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(found), F.lit(1))))))


def judge(df: DataFrame, table: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """All columns of ``df`` that do not clash with the new ones: ``host``, ``path``, ``rule``, ``probability``, ``verdict``.

    A rule that fits decides; else the model blocks from ``threshold`` on. Urls without a host and path (null, empty, no
    ``://``) have no n-gram but the marked ends and are judged by that. Equal rows are judged alike, one row each.
    """
    weights, bias = fit(table)
    new = ["host", "path", "rule", "probability", "verdict"]
    kept = [c for c in df.columns if c not in new]
    host, path = parts(F.col(url))
    rows = df.select(*kept, F.struct(host.alias("host"), path.alias("path")).alias("__url"))
    rows = rows.select(*kept, "__url.host", "__url.path")
    ruled = rows.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("probability", probability(F.col("host"), F.col("path"), weights, bias))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("probability") >= threshold, "block").otherwise("allow"))
    return scored.select(*kept, "host", "path", F.col("__rule.rule").alias("rule"), "probability", verdict.alias("verdict"))
