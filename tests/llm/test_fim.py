"""Fill-in-the-middle against a plain version that works on decoded strings, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from helpers import DOCS, FOLDER, read
from pyspark.sql import functions as F

from logweir.llm import fim
from logweir.llm.catalog import QUERIES

ODD = [
    "", None, "\n", "\n\n", "one line", "one\ntwo\nthree", "ends with a break\n", "a\n\n\nb", " \n ", "é", "é\nß\n漢字\n😀😀\nplain\n", "😀" * 50,
    "has <P> in it\nand more", "<S>", "x<M>y", "<P", "<\nP>\n<", "\r\n\r\n", "a<\n<S\nS>", "line " * 30_000 + "\n" + "漢 \n" * 20_000,
]


def draws(key, seed=7):
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def plain(key, text, unit="line", rate=100, spm_rate=50):
    text = text or ""
    parts = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n, (a, b, c, d) = len(parts), draws(key)
    if not text or any(x in text for x in fim.MARKS) or c % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(parts[:low]), "".join(parts[low:high]), "".join(parts[high:])
    if d % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(df, **options):
    rows = fim.transform(df, **options).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in rows), key=repr)


@pytest.mark.parametrize("unit", fim.UNITS)
@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (50, 0), (0, 50), (90, 100)])
def test_odd_texts(spark, unit, rate, spm_rate):
    rows = [(i + 100 * k, t) for k in range(6) for i, t in enumerate(ODD)] + [(None, "no key\nat all"), (3, "again\nand\nagain"), (3, "again\nand\nagain")]
    # columns named like the results
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS).withColumnsRenamed({"lang": "output", "source": "form", "n_chars": "n"})
    want = sorted(((k, *plain(k, t, unit, rate, spm_rate), t or "") for k, t in rows), key=repr)
    assert made(df.repartition(3), unit=unit, rate=rate, spm_rate=spm_rate) == want


def test_empty_table(spark):
    assert made(spark.createDataFrame([], DOCS)) == []


def test_other_marks_and_seed(spark):
    df = spark.createDataFrame([(i, f"a\nb{i}\nc") for i in range(20)], "doc_id long, text string")
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    out = fim.transform(df, marks=marks, seed=8)
    back = out.select("doc_id", "form", fim.restore(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: f"a\nb{i}\nc" for i in range(20)}
    assert {r.form for r in back} == {"psm", "spm"}


@pytest.mark.parametrize("marks", [("", "b", "c"), ("a", "a", "c"), ("ab", "xab", "c"), ("<a", "b<", "c"), ("aa", "b", "c")])
def test_marks_that_could_be_confused(spark, marks):
    with pytest.raises(ValueError):
        fim.checked_marks(marks)


def test_exceptions_convert_every_cut():
    text = "aé漢😀z\n" * 5
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.Exceptions(data)
    cuts = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in cuts])
    assert (index.bytes(cuts) == places).all()
    assert (index.chars(places) == cuts).all()
    assert len(index.at_byte) == 15


def test_op13_over_its_table(spark):
    docs = read("documents")
    got = {r.doc_id: r for r in QUERIES["op13_fill_in_middle"].job(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        n, form, before, inside, output = plain(k, t)
        r = got[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, before, inside)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
