import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import bits as B


def text_words(t):
    t = t + "0" * (-len(t) % 64)
    out = []
    for i in range(0, len(t), 64):
        v = int(t[i : i + 64], 2)
        out.append(v - (1 << 64) if v >> 63 else v)
    return out


@pytest.mark.parametrize("size", [32, 64, 128, 31, 63, 127, 33, 65, 129, 416])
def test_bit_strings(spark, size):
    r = random.Random(size)
    pairs = [("".join(r.choice("01") for _ in range(size)), "".join(r.choice("01") for _ in range(size))) for _ in range(12)]
    pairs += [("0" * size, "1" * size), ("1" * size, "1" * size)]
    df = spark.createDataFrame([(i, text_words(a), text_words(b)) for i, (a, b) in enumerate(pairs)], "id int, a array<bigint>, b array<bigint>")
    pos = size // 2

    def op(f):
        return lambda a, b: "".join(f(x, y) for x, y in zip(a, b, strict=True))

    show = lambda c: F.replace(B.to_text(c, size), F.lit("|"), F.lit(""))
    rows = df.select(
        "id", show("a").alias("text"), B.count("a").alias("n"), B.distance("a", "b").alias("d"), B.near("a", "b", size // 3).alias("near"), B.get_bit("a", pos, size).alias("bit"), B.get_bit("a", size, size).alias("out"),
        B.indices("a", size).alias("ones"), B.indices("a", size, 0).alias("zeros"), B.next_free("a", pos, size).alias("free"), show(B.bit_and("a", "b")).alias("and_"), show(B.bit_or("a", "b")).alias("or_"),
        show(B.bit_xor("a", "b")).alias("xor_"), show(B.bit_not("a", size)).alias("not_"), B.count(B.bit_not("a", size)).alias("n_not"), B.less("a", "b").alias("less"), show(B.set_bit("a", pos, 1, size)).alias("set1"),
        show(B.set_bit("a", pos, 0, size)).alias("set0"), B.to_hex("a").alias("hex"), B.from_hex(B.to_hex("a"), B.n_words(size)).alias("back"), F.col("a"), B.count(B.constant(size, 1)).alias("ones_n"), B.count(B.constant(size, 0)).alias("zeros_n"),
        B.count(B.bit_and(B.random_words(size, "id"), B.bit_not(B.constant(size, 1), size))).alias("pad"),
    ).collect()
    for row in rows:
        a, b = pairs[row.id]
        assert row.text == a and row.n == a.count("1") and row.d == sum(x != y for x, y in zip(a, b, strict=True))
        assert row.near == (row.d <= size // 3) and row.bit == int(a[pos]) and row.out is None
        assert row.ones == [i for i, x in enumerate(a) if x == "1"] and row.zeros == [i for i, x in enumerate(a) if x == "0"]
        assert row.free == next((i for i in [*range(pos, size), *range(pos)] if a[i] == "0"), size)
        assert row.and_ == op(lambda x, y: "1" if x == y == "1" else "0")(a, b)
        assert row.or_ == op(lambda x, y: "1" if "1" in (x, y) else "0")(a, b)
        assert row.xor_ == op(lambda x, y: "1" if x != y else "0")(a, b)
        assert row.not_ == op(lambda x, _: "10"[int(x)])(a, b) and row.n_not == size - row.n
        assert row.less == (a < b) and row.set1[pos] == "1" and row.set0[pos] == "0"
        assert row.back == row.a and row.ones_n == size and row.zeros_n == 0 and row.pad == 0


def test_sizes_that_differ(spark):
    df = spark.createDataFrame([([-1, 1], [-1])], "a array<bigint>, b array<bigint>")
    row = df.select(B.distance("a", "b").alias("d"), B.bit_and("a", "b").alias("x"), B.less("b", "a").alias("less")).first()
    assert row.d == 1 and row.x is None and row.less


def test_null_and_out_of_bounds(spark):
    df = spark.createDataFrame([(None,)], "a array<bigint>")
    row = df.select(B.count("a").alias("n"), B.to_text("a", 64).alias("t"), B.set_bit("a", 99, 1, 64).alias("s")).first()
    assert row.n is None and row.s is None
