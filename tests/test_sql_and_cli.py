import numpy as np
import pytest

from weftline import cli
from weftline.functions import sql
from weftline.operators import lshmodel
from weftline.sources.store import VectorStore


def test_sql_functions(spark):
    model = lshmodel.create_model(8, 4, 8, seed=2)
    assert sql.register(spark, model) == [*sql.FUNCTIONS, "simhash"]
    row = spark.sql("SELECT bits_set(array(7L, -1L)) AS n, hamming(array(1L, 0L), array(0L)) AS d, lsh_weight(104, 416) AS w, vec_cosine(array(3D, 4D), array(6D, 8D)) AS c, vec_cosine(array(0D), array(1D)) AS z, vec_cosine(array(1D), array(1D, 2D)) AS x").first()
    assert (row.n, row.d, row.w, row.z, row.x) == (67, 1, 0.8, 0.0, None) and abs(row.c - 1) < 1e-12
    v = [float(i - 3) for i in range(8)]
    df = spark.createDataFrame([(v,), (None,), ([1.0],)], "v array<double>")
    assert [r.h for r in df.selectExpr("simhash(v) AS h").collect()] == [model.hash(np.array([v]))[0].tolist(), None, None]


def test_page_weight_command(spark, tmp_path):
    (tmp_path / "links").write_text("* A = B C ; * B = -> C ; * C = A A B ;")
    cli.main(["pageweight", "--inlinks", "-n", "10", "-r", f"{tmp_path}/r", f"{tmp_path}/links", f"{tmp_path}/out"])
    lines = sorted(x for p in (tmp_path / "out").glob("*.csv") for x in p.read_text().splitlines())
    assert lines == ["A\t5", "C\t10"]
    assert [x for p in (tmp_path / "r").glob("*.csv") for x in p.read_text().splitlines()] == ["B\tC"]


def test_dump_command(spark, tmp_path):
    s = VectorStore.create(spark, f"file://{tmp_path}/s", "vecdim=8;bits=4;variations=2;lextypes=E")
    cli.main(["dump", s.path, f"{tmp_path}/out"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "type: E 1" in text and "noffeatno: 0" in text


def test_bad_arguments():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["pageweight"])
