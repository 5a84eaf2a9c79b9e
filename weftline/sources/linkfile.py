"""Link files: declarations ``* PAGE = [->] {PAGE} ;`` and the files written from a graph.

A name is made of letters, digits, ``_`` and characters beyond ASCII. Declarations may span lines. ``->`` before a name
declares a redirect; plain names are links, repeated ones count again. A page with at least one link is defined; one
with a redirect only isn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = r"[\x01-\x20]"
_NAME = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Declarations of a file or folder: ``(seq BIGINT, page, body, problem)``.

    The separator ``;`` splits the text, so that large files are read in parallel; ``seq`` follows the order of
    files and places. ``problem`` is null or says why a declaration is left out: an illegal character, no rule, or a
    missing name. What follows the last ``;`` counts as a declaration if it is one.
    """
    raw = spark.read.option("lineSep", ";").text(path).where(F.col("value").rlike(r"[^\x01-\x20]"))
    t = F.col("value")
    illegal = rf"[^{_NAME[1:-1]}{_SPACE[1:-1]}*=>\-]|-(?!>)|(?<!-)>"
    rule = rf"^{_SPACE}*\*{_SPACE}*({_NAME}*){_SPACE}*=([^*=]*)$"
    problem = F.when(t.rlike(illegal), "illegal character").when(~t.rlike(rule), "not a declaration").when(F.regexp_extract(t, rule, 1) == "", "no name")
    return raw.select(F.monotonically_increasing_id().alias("seq"), F.regexp_extract(t, rule, 1).alias("page"), F.regexp_extract(t, rule, 2).alias("body"), problem.alias("problem"))


def rule_targets(rules: DataFrame) -> DataFrame:
    """``(seq, page, target, kind)`` with ``kind`` ``link`` or ``redirect``, one row for each name of a body.

    Doubled arrows count as one; an arrow without a name declares nothing.
    """
    ok = rules.where(F.col("problem").isNull())
    parts = F.regexp_extract_all("body", F.lit(rf"((?:->{_SPACE}*)*{_NAME}+)"), F.lit(1))
    each = ok.select("seq", "page", F.posexplode(parts).alias("pos", "part"))
    kind = F.when(F.col("part").startswith("->"), "redirect").otherwise("link")
    return each.select("seq", "pos", "page", F.regexp_extract("part", rf"({_NAME}+)$", 1).alias("target"), kind.alias("kind"))


def graph(targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Defined pages ``(page)``, edges ``(src, dst, cnt)`` and redirects ``(page, ptr)``, the last of a page."""
    links = targets.where("kind = 'link'")
    pages = links.select("page").distinct()
    edges = links.groupBy(F.col("page").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("cnt"))
    moved = targets.where((F.col("kind") == "redirect") & (F.col("page") != F.col("target")))
    last = moved.groupBy("page").agg(F.max(F.struct("seq", "pos", "target")).alias("m")).select("page", F.col("m.target").alias("ptr"))
    return pages, edges, last


def rule_text(edges: DataFrame, redirects: DataFrame) -> DataFrame:
    """Declarations of a graph, one line for each edge and redirect: ``(value)``.

    One declaration for each page would gather all links of a page in one row; the file means the same.
    """
    names = F.array_join(F.array_repeat("dst", F.col("cnt").cast("int")), " ")
    a = edges.select(F.concat(F.lit("* "), "src", F.lit(" = "), names, F.lit(" ;")).alias("value"))
    return a.unionByName(redirects.select(F.concat(F.lit("* "), "page", F.lit(" = -> "), "ptr", F.lit(" ;")).alias("value")))


def write_weights(weights: DataFrame, path: str) -> None:
    """``name TAB value`` lines."""
    weights.select("page", "weight").write.mode("overwrite").option("sep", "\t").csv(path)


def write_redirects(redirects: DataFrame, path: str) -> None:
    """``from TAB to`` lines."""
    redirects.select("page", "ptr").write.mode("overwrite").option("sep", "\t").csv(path)
