"""Character references in the JVM against the standard library, on all names and on odd rows."""

import html
import random
from html import entities

from pyspark.sql import functions as F

from tidegraph.functions import text as T


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.decode_references(F.col("x")).alias("y"), T.clean_html(F.col("x")).alias("z"))
    for r in rows.collect():
        assert r.y == html.unescape(texts[r.i]), repr(texts[r.i])
        if "<" not in texts[r.i]:
            assert r.z == " ".join(r.y.split()), repr(texts[r.i])


def test_all_names(spark):
    names = sorted(entities.html5)
    check(spark, [f"a &{n} b" for n in names] + [f"&{n}x;&{n}" for n in names if not n.endswith(";")])


def test_numbers(spark):
    odd = [0, 1, 9, 11, 13, 31, 32, 38, 65, 127, 128, 129, 159, 160, 255, 256, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 2**31, 2**40, 10**30]
    check(spark, [t for n in odd for t in (f"x&#{n};y", f"&#{n}z", f"&#x{n:x};", f"&#X{n:X}g", f"&#000000000{n};", f"&#x0000000000{n:x};")])


def test_odd_texts(spark):
    check(spark, ["", "&", "&&", "&;", "& amp;", "&amp;lt;", "&&amp;&", "&#;", "&#x;", "&#xg;", "&ampamp;", "&notit;", "&notin;", "&" + "a" * 40 + ";", "&lt&gt", "x&nbsp;y&#160;&#8195;z", "&\ud7ff;", "\x01&amp;\x02", "&amp\n;", "no reference"])
    rng = random.Random(7)
    bits = ["&", "#", "x", ";", "amp", "lt", "not", "in", "1", "38", "f", " ", "é", "\n", "&#", "&#x", "copy", "😀", "frac12", "CounterClockwiseContourIntegral"]
    check(spark, ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000)])


def test_no_python_and_one_constant(spark):
    plan = spark.range(3).select(T.clean_html(F.concat(F.lit("&eacute;"), F.col("id").cast("string"))).alias("t"))
    assert [r.t for r in plan.collect()] == ["é0", "é1", "é2"]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "str_to_map" not in text and "Python" not in text
