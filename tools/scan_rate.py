"""Rate of the full hash scan: python tools/scan_rate.py [VECTORS [QUERIES [BITS]]] prints comparisons a second.

Hashes are random and of one type; each query meets all vectors and keeps its 20 nearest. The time holds the blocks'
shuffle and the merge of their results, not the making of the hashes.
"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F

from weftline.functions import bits as B
from weftline.operators import search
from weftline.session import Cut, local_session


def main(args):
    n, asked, bits = (int(a) for a in (*args, *("1000000", "1000", "2048")[len(args) :]))
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores), "scan")
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.range(n).select(F.lit(1).alias("typeno"), F.col("id").cast("int").alias("featno"), B.random_words(bits, "id").alias("lsh"))
    vectors = Cut(spark, "scan").keep(rows)
    queries = vectors.where(F.col("featno") < asked).withColumn("query_id", F.col("featno").cast("bigint"))
    search.search(vectors.where("featno < 1000"), queries.where("featno < 10"), bits=bits, k=20, min_sim=0.9).count()
    began = time.perf_counter()
    found = search.search(vectors, queries, bits=bits, k=20, min_sim=0.9).count()
    took = time.perf_counter() - began
    print(f"{n} vectors of {bits} bits, {asked} queries, {cores} cores: {took:.1f} s, {found} rows, {n * asked / took:.3g} comparisons/s, {took / asked * 1000:.1f} ms a query")


if __name__ == "__main__":
    main(sys.argv[1:])
