"""Pages of a large ordered table, found by rank.

Sorting a table up to a page far inside it costs memory and time with the page's offset. Instead the sort key is read as numbers, a histogram
counts the rows of each range of them, running counts say which range holds the page's first row and which its last, and those ranges are
split again until few rows are left. Their keys are looked at, and the page is what lies between two keys: a filter, and a sort of the
page alone. A round is one aggregate of at most ``BUCKETS`` rows or so; the rounds grow with the bits of the key, not with the table or the offset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

BUCKETS = 4096
FEW = 10_000  # rows whose keys are looked at one by one
PIECE = 7  # bytes of a text in one number


def _pieces(name: str, longest: int) -> list[Column]:
    """A text as numbers that sort like it: its bytes by sevens, then its length."""
    data = F.col(name).cast("binary")
    parts = [F.rpad(F.hex(F.substring(data, 1 + i, PIECE)), 2 * PIECE, "0") for i in range(0, longest, PIECE)]
    return [F.conv(p, 16, 10).cast("bigint") for p in parts] + [F.octet_length(name).cast("bigint")]


def descending(df: DataFrame, columns: list[str], longest: dict[str, int]) -> list[Column]:
    """Numbers, never null, whose ascending order is the descending order of ``columns``, nulls last."""
    out = []
    for name in columns:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.StringType):
            numbers = _pieces(name, longest.get(name) or 0)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            numbers = [F.unix_micros(c.cast("timestamp"))]
        elif isinstance(kind, T.DateType):
            numbers = [F.unix_date(c).cast("bigint")]
        elif isinstance(kind, T.IntegralType):
            numbers = [c.cast("bigint")]
        else:
            raise TypeError(f"pages can't be ordered by {name}, {kind.simpleString()}")
        # ~x turns the order round, and can't overflow as -x can
        out += [c.isNull().cast("bigint"), *(F.coalesce(F.bitwise_not(n), F.lit(0).cast("bigint")) for n in numbers)]
    return out


@dataclass
class Range:
    """Rows whose first numbers are ``same`` and whose next one lies between ``low`` and ``high``; ``before`` rows come before it."""

    same: list[int]
    low: int
    high: int
    before: int
    rows: int

    def holds(self, numbers: list[str]) -> Column:
        out = F.col(numbers[len(self.same)]).between(self.low, self.high)
        for name, value in zip(numbers, self.same):
            out = out & (F.col(name) == value)
        return out


def _split(keys: DataFrame, names: list[str], at: Range, rank: int) -> Range:
    """The part of a range that holds a rank."""
    name = names[len(at.same)]
    width = max(1, (at.high - at.low) // BUCKETS + 1)
    counted = keys.filter(at.holds(names)).groupBy(F.expr(f"{name} div {width}L").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
    before = at.before
    for r in sorted(counted.collect(), key=lambda r: r.low):
        if rank < before + r.n:
            return Range(at.same, r.low, r.high, before, r.n)
        before += r.n
    raise ValueError("the table changed while it was paged")


def _key_at(keys: DataFrame, names: list[str], whole: Range, rank: int) -> tuple[tuple[int, ...], int, int]:
    """The key of the row with this rank (from 0), how many rows come before that key, and how many have it."""
    at = whole
    while at.rows > FEW:
        if at.low == at.high:
            if len(at.same) + 1 == len(names):  # all of them have one key
                return (*at.same, at.low), at.before, at.rows
            following = names[len(at.same) + 1]
            bounds = keys.filter(at.holds(names)).agg(F.min(following), F.max(following)).first()
            at = Range([*at.same, at.low], bounds[0], bounds[1], at.before, at.rows)
        else:
            at = _split(keys, names, at, rank)
    found = sorted(tuple(r) for r in keys.filter(at.holds(names)).collect())
    key = found[rank - at.before]
    first = found.index(key)
    return key, at.before + first, found.count(key)


def _nothing(found: DataFrame, total: DataFrame) -> DataFrame:
    """A row of nulls and the total."""
    return total.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema], "total")


def page_of(found: DataFrame, columns: list[str], limit: int | None, offset: int) -> DataFrame:
    """The rows from ``offset`` on, ``limit`` at most (None: all), descending by ``columns`` (nulls last), each with ``total``, the number of all rows.

    A page without rows is one row of nulls with the total. Rows alike in all of ``columns`` have no order of their own. A first page of at most
    ``FEW`` rows, or all rows, is a plan that nothing has run for; for other pages the ranges are counted now.
    """
    if offset < 0 or limit is not None and limit < 0:
        raise ValueError("limit and offset are not negative")
    order = [F.desc_nulls_last(c) for c in columns]
    if offset == 0 and (limit is None or 0 < limit <= FEW):
        total = found.agg(F.count(F.lit(1)).alias("total"))
        page = found if limit is None else found.orderBy(*order).limit(limit)
        # the total is one row; the page can be any number
        counted = page.crossJoin(F.broadcast(total))
        return counted.unionByName(_nothing(found, total.filter("total = 0"))).orderBy(*order)
    texts = [c for c in columns if isinstance(found.schema[c].dataType, T.StringType)]
    first = descending(found, columns[:1], {})[0]
    facts = found.agg(F.count(F.lit(1)), F.min(first), F.max(first), *[F.max(F.octet_length(c)) for c in texts]).first()
    total = facts[0]
    end = total if limit is None else min(total, offset + limit)
    if offset >= end:
        return _nothing(found, found.sparkSession.range(1).select(F.lit(total).cast("bigint").alias("total")))
    numbers = descending(found, columns, dict(zip(texts, facts[3:], strict=True)))
    names = [f"_n{i}" for i in range(len(numbers))]
    keys = found.select(*[n.alias(a) for n, a in zip(numbers, names, strict=True)])
    whole = Range([], facts[1], facts[2], 0, total)
    low, low_before, low_rows = _key_at(keys, names, whole, offset)
    high, high_before, high_rows = _key_at(keys, names, whole, end - 1)
    key = F.struct(*numbers)

    def lit(values: tuple[int, ...]) -> Column:
        return F.struct(*[F.lit(v).cast("bigint") for v in values])

    def like(values: tuple[int, ...], rows: int, all_rows: int) -> DataFrame:
        alike = found.filter(key == lit(values))
        return alike if rows == all_rows else alike.limit(rows)

    if low == high:
        page = like(low, end - offset, low_rows)
    else:
        inner = found.filter((key > lit(low)) & (key < lit(high)))
        page = inner.unionByName(like(low, low_before + low_rows - offset, low_rows)).unionByName(like(high, end - high_before, high_rows))
        if low_before + low_rows - offset == low_rows and end - high_before == high_rows:  # no row of the first or the last key stays out
            page = found.filter((key >= lit(low)) & (key <= lit(high)))
    return page.withColumn("total", F.lit(total).cast("bigint")).orderBy(*order)
