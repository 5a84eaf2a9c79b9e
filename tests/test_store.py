import pytest

from weftline import config as C
from weftline.operators import lshmodel
from weftline.sources import dump
from weftline.sources.store import StoreError, VectorStore
from weftline.streaming.ingest import batch_writer, ingest


def vec(i, dim=8):
    return [float((i * 7 + k * 3) % 11 - 5) for k in range(dim)]


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore.create(spark, f"file://{tmp_path}/s", "vecdim=8;bits=4;variations=8;lextypes=E,N:V", seed=9)


def filled(store):
    tx = store.transaction()
    tx.define_vector("N", "b", vec(1))
    tx.define_vector("E", "a", vec(2))
    tx.define_feature("V", "a")
    tx.define_vector("N", "b", vec(3))
    tx.define_vector("X", "c_1", [])
    tx.define_type("Y")
    tx.commit()
    return store


def test_create_and_open(spark, store, tmp_path):
    path = f"file://{tmp_path}/s"
    with pytest.raises(StoreError):
        VectorStore.create(spark, path)
    other = VectorStore.open(spark, path, "vecdim=99;recall=0.5")
    assert other.config.ignored == ("vecdim",) and other.config.vecdim == 8 and other.config.lexer.recall == 0.5
    assert other.model().equals(store.model()) and other.config.lexer.lextypes == {"E": 0, "N": 0, "V": 1}
    assert [r.type for r in other.list_types().collect()] == ["E", "N", "V"]
    with pytest.raises(StoreError):
        VectorStore.open(spark, f"file://{tmp_path}/none")
    with pytest.raises(StoreError):
        VectorStore.open(spark, path, "lextypes=Q")
    for version in ("2.0", "1.7", "x", ""):
        with pytest.raises(StoreError):
            VectorStore._check_version(version)


def test_commit(store):
    s = filled(store)
    assert {r.type: r.typeno for r in s.types().collect()} == {"E": 1, "N": 2, "V": 3, "X": 4, "Y": 5}
    assert {r.feature: r.featno for r in s.features().collect()} == {"b": 1, "a": 2, "c_1": 3}
    assert s.vector("N", "b") == vec(3) and s.vector("V", "a") == [] and s.vector("N", "nope") == []
    assert s.feature_types("a") == ["E", "V"] and s.feature_types("zz") == []
    assert (s.n_types(), s.n_features(), s.n_vectors("N"), s.n_vectors("nope")) == (5, 3, 1, 0)
    assert s.hash_of("N", "b") == lshmodel.pack(s.model().bits(__import__("numpy").array([vec(3)])))[0].tolist()
    assert s.type_no("N") == 2 and s.type_no("nope") == 0 and s.feature_no("zz") == 0 and s.type_name(2) == "N" and s.feature_name(2) == "a"
    with pytest.raises(StoreError):
        s.feature_name(99)


def test_second_commit_keeps_numbers_and_counts_keys_once(store, spark):
    s = filled(store)
    tx = s.transaction()
    tx.define_vector("N", "b", vec(5))
    tx.define_vector("N", "d", vec(6))
    tx.define_feature("E", "b")
    tx.commit()
    again = VectorStore.open(spark, s.path)
    assert again.feature_no("d") == 4 and again.vector("N", "b") == vec(5) and again.n_vectors("N") == 2
    assert again.feature_types("b") == ["N", "E"]
    assert again.feature_at("N", 1) == 4 and again.feature_at("N", 2) == 0
    assert [r.featno for r in again.hashes("N", 2).collect()] == [4]


def test_rollback_clear_and_compact(store, spark):
    s = filled(store)
    tx = s.transaction()
    tx.define_vector("N", "zz", vec(1))
    tx.rollback()
    assert tx.commit() == s.commit_no and s.feature_no("zz") == 0
    s.set_variable("who", "me")
    before = sorted(map(tuple, s.relations().collect()))
    s.compact()
    assert sorted(map(tuple, s.relations().collect())) == before and s.vector("N", "b") == vec(3)
    assert s.vacuum() == 0 and s.vacuum(older_than=0) > 0
    assert len(s.files.names(f"{s.path}/vectors")) == 1 and VectorStore.open(spark, s.path).vector("N", "b") == vec(3)
    tx = s.transaction()
    tx.define_vector("E", "gone", vec(1))
    tx.clear()
    tx.define_vector("N", "first", vec(4))
    tx.commit()
    s = VectorStore.open(spark, s.path) if not s.config.lexer.lextypes else s
    assert [r.feature for r in s.features().collect()] == ["first"] and s.feature_no("first") == 1 and s.type_no("N") == 1
    assert s.variable("who") == "me" and s.variable("none") == "" and s.model().total_bits == 32


def test_two_writers(store, spark):
    a, b = VectorStore.open(spark, store.path), VectorStore.open(spark, store.path)
    a.set_variable("x", "1")
    with pytest.raises(Exception, match="(?i)exist"):
        b.set_variable("x", "2")
    b.refresh()
    assert b.variable("x") == "1"


@pytest.mark.parametrize("dies_at", ["types", "features", "feature_types", "vectors", "marker"])
def test_a_commit_that_dies_leaves_no_trace(store, spark, monkeypatch, dies_at):
    """Killed after any segment or in the middle of the marker: old rows only, and later commits work."""
    s = filled(store)
    append, write = VectorStore._append, type(s.files).write_new

    def half(self, name, df, commit):
        out = append(self, name, df, commit)
        if name == dies_at:
            raise KeyboardInterrupt
        return out

    def torn(self, path, text):
        write(self, path, text[: len(text) // 2])
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if dies_at == "marker":
            m.setattr(type(s.files), "write_new", torn)
        else:
            m.setattr(VectorStore, "_append", half)
        tx = s.transaction()
        tx.define_vector("ghost", "ghost", vec(1))
        with pytest.raises(KeyboardInterrupt):
            tx.commit()
    for again in (VectorStore.open(spark, s.path), s):
        again.refresh()
        assert again.type_no("ghost") == 0 and again.feature_no("ghost") == 0 and again.vector("N", "b") == vec(3)
    s.set_variable("after", "1")
    assert VectorStore.open(spark, s.path).type_no("ghost") == 0
    tx = s.transaction()
    tx.define_vector("N", "late", vec(7))
    tx.commit()
    again = VectorStore.open(spark, s.path)
    assert again.vector("N", "late") == vec(7) and again.variable("after") == "1" and again.type_no("ghost") == 0 and again.feature_no("late") == 4


def test_readers_outlive_a_compaction(store, spark):
    s = filled(store)
    reader = VectorStore.open(spark, s.path)
    frame = reader.vectors("N")
    s.compact()
    assert frame.count() == 1 and reader.vector("N", "b") == vec(3)


def test_a_batch_that_dies_counts_once(store, spark, monkeypatch):
    rows = spark.createDataFrame([(1, "N", "s1", vec(1))], "seq bigint, type string, feature string, vec array<float>")
    mark = VectorStore._mark
    with monkeypatch.context() as m:
        m.setattr(VectorStore, "_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            batch_writer(store, "t")(rows, 0)
    assert VectorStore.open(spark, store.path).n_vectors("N") == 0
    batch_writer(store, "t")(rows, 0)
    commit = store.commit_no
    batch_writer(store, "t")(rows, 0)
    again = VectorStore.open(spark, store.path)
    assert again.commit_no == commit and again.n_vectors("N") == 1 and again.variable("stream:t") == "0" and mark is VectorStore._mark


def test_cursor_and_errors(store, spark):
    s = filled(store)
    c = s.feature_cursor()
    assert c.fetch(2) == ["a", "b"] and c.fetch(2) == ["c_1"] and c.fetch(2) == []
    c.skip("b")
    assert c.fetch(1) == ["b"] and c.fetch(1) == ["c_1"]
    c.skip_prefix("c")
    assert c.fetch(5) == ["c_1"] and c.fetch(5) == []
    with pytest.raises(Exception, match="no feature with number 99"):
        s.decode(spark.createDataFrame([(2, 99)], "typeno int, featno int")).collect()
    s.config = C.create_config("vecdim=300")
    with pytest.raises(StoreError):
        s.hash_of("N", "b")


def test_scans(store):
    s = filled(store)
    assert [r.feature for r in s.feature_scan().collect()] == ["a", "b", "c_1"]
    assert s.feature_seek("b").feature == "b" and s.feature_seek("bb").feature == "c_1" and s.feature_seek("d") is None
    assert [r.feature for r in s.feature_prefix("c").collect()] == ["c_1"]
    assert s.feature_page(2) == ["a", "b"] and s.feature_page(2, "b") == ["c_1"] and s.feature_page(5, prefix="b") == ["b"]


def test_search(store, spark):
    s = filled(store)
    s.prepare("N")
    assert [(r.rank, r.feature, r.weight) for r in s.find_similar("N", vec(3), 5, 0.9).collect()] == [(1, "b", 1.0)]
    assert [(r.feature, r.weight) for r in s.find_similar("N", vec(3), 5, 0.9, real_weights=True).collect()] == [("b", 1.0)]
    with pytest.raises(StoreError):
        s.find_similar("nope", vec(1), 5, 0.9)
    with pytest.raises(StoreError):
        s.prepare("nope")
    with pytest.raises(StoreError):
        s.transaction().define_vector("N", "q", [1.0])


def test_encode_decode_and_unusable_definitions(store, spark):
    s = filled(store)
    tx = s.transaction()
    rows = [(1, "N", "e1", [float("nan")] * 8), (2, "N", "e2", [1.0]), (3, None, "e3", vec(1)), (4, "N", None, vec(1)), (5, "N", "e1", vec(2)), (5, "N", "e1", vec(2)), (6, "N", "e1", [])]
    tx.define_frame(spark.createDataFrame(rows, "seq bigint, type string, feature string, vec array<double>"))
    tx.commit()
    assert s.vector("N", "e1") == vec(2) and s.vector("N", "e2") == [] and s.feature_types("e2") == ["N"] and s.feature_no("e3") == 0
    named = spark.createDataFrame([("N", "e1"), ("?", "?")], "type string, feature string")
    got = {(r.type, r.feature): (r.typeno, r.featno) for r in s.encode(named).collect()}
    assert got["?", "?"] == (0, 0) and got["N", "e1"] == (2, s.feature_no("e1"))


def test_dump(store, tmp_path):
    s = filled(store)
    lines = dump.store_lines(s).orderBy("family", "key").collect()
    assert [r.family for r in lines] == sorted(r.family for r in lines) and len({r.family for r in lines}) == 12
    text = [r.line for r in lines]
    assert "type: N 2" in text and "valueinv: 1 b" in text and "firel: 2 1 3" in text and "noffeatno: 3" in text and "nofvec: 2 1" in text
    assert any(t.startswith("vector: ") and t.count(".") == 8 for t in text) and text.count("lshmodel:") == 1
    dump.write_dump(dump.store_lines(s), f"{tmp_path}/dump")
    got = [line for p in sorted((tmp_path / "dump").glob("part-*")) for line in p.read_text().splitlines()]
    assert got == text


def test_stream(store, spark, tmp_path):
    rows = [(i, "N", f"f{i % 20}", vec(i)) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "seq bigint, type string, feature string, vec array<float>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("seq bigint, type string, feature string, vec array<float>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest(feed, store, "t", f"{tmp_path}/offsets", once=True).awaitTermination()
    s = VectorStore.open(spark, store.path)
    assert s.n_vectors("N") == 20 and s.variable("stream:t") == "2"
    commit = s.commit_no
    batch_writer(s, "t")(spark.createDataFrame(rows, "seq bigint, type string, feature string, vec array<float>"), 1)
    assert s.commit_no == commit  # a batch that was committed is left out


def test_configuration():
    c = C.create_config("vecdim=300")
    assert (c.bits, c.variations, c.total_bits, c.words) == (64, 32, 2048, 32)
    assert [(x.bits, x.variations) for x in map(C.create_config, ("vecdim=121", "vecdim=64", "vecdim=768"))] == [(32, 26), (32, 13), (64, 82)]
    assert [C.filter_benches(w) for w in (32, 13, 7, 82, 1)] == [4, 3, 1, 4, 1]
    assert C.parse_lextypes("E, N:V/W") == {"E": 0, "N": 0, "V": 1, "W": 2} and C.parse_lextypes("") == {}
    assert C.create_config(c.text()) == c
    for bad in ("lextypes=E,,N", "lextypes=E;spacesb=ab", "nope=1", "vecdim", "vecdim=0", "lextypes=E?"):
        with pytest.raises(C.ConfigError):
            C.create_config(bad)
