"""The text dump of a store: one line for each row, families in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import bits as B

FAMILIES = ("variable", "type", "value", "typeinv", "valueinv", "vector", "simhash", "nofvec", "noftypeno", "noffeatno", "lshmodel", "firel")


def _line(family: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{family}: "), F.concat_ws(" ", *parts))


def _text(number: str) -> Column:
    return F.col(number).cast("string")


def floats(vec: str) -> Column:
    return F.array_join(F.transform(F.col(vec), lambda x: F.format_string("%.6f", x.cast("double"))), " ")


def dump_lines(types: DataFrame, features: DataFrame, relations: DataFrame, vectors: DataFrame, model: DataFrame, variables: DataFrame, bits: int) -> DataFrame:
    """``(family INT, key STRING, line STRING)`` of every row, each once.

    ``key`` orders the lines of a family: names by bytes, numbers with leading zeros. A vector's line holds its
    components only; the model is a line with its name and one for each row of its matrix.
    """

    def key(*cols: str) -> Column:
        return F.concat(*[F.format_string("%010d", F.col(c)) for c in cols])

    parts = {
        "variable": variables.select(F.col("name").alias("key"), _line("variable", F.col("name"), F.col("value")).alias("line")),
        "type": types.select(F.col("type").alias("key"), _line("type", F.col("type"), _text("typeno")).alias("line")),
        "value": features.select(F.col("feature").alias("key"), _line("value", F.col("feature"), _text("featno")).alias("line")),
        "typeinv": types.select(key("typeno").alias("key"), _line("typeinv", _text("typeno"), F.col("type")).alias("line")),
        "valueinv": features.select(key("featno").alias("key"), _line("valueinv", _text("featno"), F.col("feature")).alias("line")),
        "vector": vectors.select(key("typeno", "featno").alias("key"), _line("vector", floats("vec")).alias("line")),
        "simhash": vectors.select(key("typeno", "featno").alias("key"), _line("simhash", _text("typeno"), _text("featno"), B.to_text("lsh", bits)).alias("line")),
        "nofvec": vectors.groupBy("typeno").agg(F.count("*").alias("n")).select(key("typeno").alias("key"), _line("nofvec", _text("typeno"), _text("n")).alias("line")),
        "noftypeno": types.agg(F.count("*").alias("n")).select(F.lit("").alias("key"), _line("noftypeno", _text("n")).alias("line")),
        "noffeatno": features.agg(F.count("*").alias("n")).select(F.lit("").alias("key"), _line("noffeatno", _text("n")).alias("line")),
        "lshmodel": model.select(key("row_no").alias("key"), floats("coeffs").alias("line")).unionByName(model.limit(1).select(F.lit("").alias("key"), F.lit("lshmodel:").alias("line"))),
        "firel": relations.select(key("featno").alias("key"), _line("firel", _text("featno"), F.array_join(F.transform("typenos", lambda t: t.cast("string")), " ")).alias("line")),
    }
    return reduce(DataFrame.unionByName, [parts[f].select(F.lit(i).alias("family"), "key", "line") for i, f in enumerate(FAMILIES)])


def store_lines(store) -> DataFrame:
    return dump_lines(store.types(), store.features(), store.relations(), store.vectors(), store._table("model"), store.variables(), store.model().total_bits)


def write_dump(lines: DataFrame, path: str) -> None:
    """Writes the lines in order, as text files that follow each other by name."""
    lines.orderBy("family", "key").select("line").write.mode("overwrite").text(path)
