"""A typed vector store in a directory of Parquet segments.

Every commit writes segments under names of its own and then a marker file that lists them; nothing that a reader sees is
rewritten. Readers take segments from markers only, and the latest row of each key from them, so that what a commit
left behind that died before its marker is never seen, whatever is written later. Markers are created exclusively, so
that of two writers of one commit the second fails; a marker that was cut off counts as none, and its number isn't used
again. ``compact`` merges the segments; open readers keep the old ones until ``vacuum`` deletes what is out of use.

Tables (each with the partition columns ``segment`` and ``commit``)::

    types(typeno, type)  features(featno, feature)  feature_types(featno, typeno, pos)
    vectors(typeno, featno, vec, lsh), partitioned by typeno  meta(name, value)  model(row_no, coeffs)
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftline import config as C
from weftline.functions import bits as B
from weftline.operators import lshmodel, search
from weftline.operators.upsert import encode_names, latest
from weftline.session import Cut

#: Version of the layout: stores of another major or a later minor version can't be opened.
VERSION = (1, 0)

SCHEMAS = {
    "types": "typeno int, type string, commit bigint",
    "features": "featno int, feature string, commit bigint",
    "feature_types": "featno int, typeno int, pos bigint, commit bigint",
    "vectors": "featno int, vec array<float>, lsh array<bigint>, commit bigint, typeno int",
    "meta": "name string, value string, commit bigint",
    "model": "row_no int, coeffs array<double>, commit bigint",
}
DEFINITIONS = "seq bigint, type string, feature string, vec array<float>"


class StoreError(RuntimeError):
    pass


class _Files:
    """The few file operations that Spark's readers and writers don't offer, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        p = self.path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def write_new(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        f = self.fs.open(self.path(path))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def age(self, path: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self.fs.getFileStatus(self.path(path)).getModificationTime() / 1000


@dataclass(frozen=True)
class Marker:
    """What a commit made visible: its segments, and the commits up to which rows of the other tables no longer count."""

    base: int  # of data: a commit that cleared or merged the store
    kept: int  # of variables and the model: a commit that merged the store
    segments: dict[str, str]

    def text(self) -> str:
        return json.dumps({"base": self.base, "kept": self.kept, "segments": self.segments})

    @classmethod
    def read(cls, text: str) -> "Marker | None":
        try:
            d = json.loads(text)
            return cls(d["base"], d["kept"], d["segments"])
        except (ValueError, KeyError, TypeError):
            return None


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, config: C.StoreConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.commit_no, self.next_no = 0, 1
        self.base, self.kept = 0, 0
        self.files = _Files(spark, path)
        self._marks: dict[int, Marker | None] = {}
        self._held: dict[str, DataFrame] = {}
        self._model: lshmodel.LshModel | None = None

    # -- creating and opening -------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: str = "", *, seed: int = 1, model: lshmodel.LshModel | None = None) -> "VectorStore":
        """Makes a store with a seeded model (or the one given), its configuration and the types of ``lextypes``."""
        conf = C.create_config(config)
        store = cls(spark, path, conf)
        if store.files.names(f"{store.path}/_commits"):
            raise StoreError(f"there is a store in {path}")
        model = model or lshmodel.create_model(conf.vecdim, conf.bits, conf.variations, seed)
        if model.dim != conf.vecdim or model.total_bits != conf.total_bits:
            raise StoreError("the model doesn't fit the configuration")
        parts = {
            "model": lshmodel.to_frame(spark, model),
            "meta": spark.createDataFrame([("version", f"{VERSION[0]}.{VERSION[1]}"), ("config", conf.text())], "name string, value string"),
        }
        if conf.lexer.lextypes:
            parts["types"] = spark.createDataFrame([(i, t) for i, t in enumerate(conf.lexer.lextypes, 1)], "typeno int, type string")
        store._write(parts)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: str = "") -> "VectorStore":
        """Opens the last commit. Parameters of the model are ignored here (``config.ignored`` lists them)."""
        store = cls(spark, path, C.StoreConfig())
        store.refresh()
        if not store.commit_no:
            raise StoreError(f"no store in {path}")
        store._check_version(store.variable("version"))
        store.config = C.open_config(C.create_config(store.variable("config")), config)
        known = {r["type"] for r in store.types().collect()}
        if missing := set(store.config.lexer.lextypes) - known:
            raise StoreError(f"undefined types in lextypes: {sorted(missing)}")
        for name in store.config.memtypes:
            store.prepare(name)
        return store

    @staticmethod
    def _check_version(text: str) -> None:
        try:
            major, minor = map(int, text.split("."))
        except ValueError:
            raise StoreError(f"unreadable version {text!r}") from None
        if major != VERSION[0] or minor > VERSION[1]:
            raise StoreError(f"version {text} can't be read by {VERSION[0]}.{VERSION[1]}")

    def refresh(self) -> None:
        """Goes on to the last commit."""
        seen = [int(n.split(".")[0]) for n in self.files.names(f"{self.path}/_commits") if n.endswith(".json")]
        for n in seen:
            if self._marks.get(n) is None:
                self._marks[n] = Marker.read(self.files.read(f"{self.path}/_commits/{n:012d}.json"))
        last = max((n for n in seen if self._marks[n]), default=0)
        if last != self.commit_no:
            self.release()
            self._model = None
        self.commit_no, self.next_no = last, max(seen, default=0) + 1
        if last:
            self.base, self.kept = self._marks[last].base, self._marks[last].kept

    def _write(self, parts: dict[str, DataFrame], base: int | None = None, kept: int | None = None) -> int:
        """Writes the parts as segments of a new commit and makes them visible together."""
        commit, segments = self.next_no, {}
        for name, df in parts.items():
            segments[name] = self._append(name, df, commit)
        self._mark(commit, Marker(self.base if base is None else base, self.kept if kept is None else kept, segments))
        return commit

    def _mark(self, commit: int, marker: Marker) -> None:
        self.files.write_new(f"{self.path}/_commits/{commit:012d}.json", marker.text())
        self._marks[commit] = marker
        self.commit_no, self.next_no, self.base, self.kept = commit, commit + 1, marker.base, marker.kept
        self.release()

    def _append(self, name: str, df: DataFrame, commit: int) -> str:
        """Writes a segment, which no marker names yet, and returns its name."""
        segment = uuid.uuid4().hex[:16]
        target = f"{self.path}/{name}/segment={segment}/commit={commit}"
        if name == "vectors":
            df.repartition("typeno", F.pmod(F.xxhash64("featno"), F.lit(16))).sortWithinPartitions("typeno", "featno").write.partitionBy("typeno").parquet(target)
        else:
            df.write.parquet(target)
        return segment

    def _table(self, name: str) -> DataFrame:
        """Rows of a table in the segments of visible commits, with their commit."""
        floor = self.kept if name in ("meta", "model") else self.base
        marks = ((c, m) for c, m in sorted(self._marks.items()) if m and floor < c <= self.commit_no and name in m.segments)
        paths = [f"{self.path}/{name}/segment={m.segments[name]}/commit={c}" for c, m in marks]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*paths)
        return df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])

    # -- metadata -------------------------------------------------------------------------------------------------

    def types(self) -> DataFrame:
        """``(typeno, type)``; names are in byte order when listed."""
        return self._table("types").select("typeno", "type")

    def list_types(self) -> DataFrame:
        return self.types().select("type").orderBy("type")

    def features(self) -> DataFrame:
        return self._table("features").select("featno", "feature")

    def variables(self) -> DataFrame:
        return latest(self._table("meta"), ["name"], ["commit"], ["commit", "value"]).select("name", "value")

    def variable(self, name: str) -> str:
        """The value of a variable, an empty string if it isn't set."""
        row = self.variables().where(F.col("name") == name).first()
        return row["value"] if row else ""

    def set_variable(self, name: str, value: str) -> None:
        self._write({"meta": self.spark.createDataFrame([(name, value)], "name string, value string")})

    def config_text(self) -> str:
        return self.variable("config")

    def model(self) -> lshmodel.LshModel:
        if self._model is None:
            self._model = lshmodel.from_frame(self._table("model"))
        return self._model

    # -- features -------------------------------------------------------------------------------------------------

    def feature_scan(self) -> DataFrame:
        return self.features().orderBy("feature")

    def feature_seek(self, key: str) -> Row | None:
        """The first feature whose name isn't below ``key``."""
        return self.features().where(F.col("feature") >= key).orderBy("feature").limit(1).first()

    def feature_prefix(self, prefix: str) -> DataFrame:
        return self.features().where(F.col("feature").startswith(prefix)).orderBy("feature")

    def feature_cursor(self) -> "FeatureCursor":
        return FeatureCursor(self)

    def feature_page(self, n: int, after: str | None = None, prefix: str = "") -> list[str]:
        """The next ``n`` names after the last one read: pages need no cursor on the server."""
        df = self.features()
        if after is not None:
            df = df.where(F.col("feature") > after)
        if prefix:
            df = df.where(F.col("feature").startswith(prefix))
        return [r["feature"] for r in df.select("feature").orderBy("feature").limit(n).collect()]

    def type_no(self, name: str) -> int:
        row = self.types().where(F.col("type") == name).first()
        return row["typeno"] if row else 0

    def feature_no(self, name: str) -> int:
        row = self.features().where(F.col("feature") == name).first()
        return row["featno"] if row else 0

    def type_name(self, no: int) -> str:
        row = self.types().where(F.col("typeno") == no).first()
        if row is None:
            raise StoreError(f"no type with number {no}")
        return row["type"]

    def feature_name(self, no: int) -> str:
        row = self.features().where(F.col("featno") == no).first()
        if row is None:
            raise StoreError(f"no feature with number {no}")
        return row["feature"]

    def encode(self, named: DataFrame) -> DataFrame:
        """``(type, feature)`` columns to ``(typeno, featno)``, 0 for unknown names."""
        out = named.join(F.broadcast(self.types()), "type", "left").join(self.features(), "feature", "left")
        return out.withColumns({"typeno": F.coalesce("typeno", F.lit(0)), "featno": F.coalesce("featno", F.lit(0))})

    def decode(self, numbered: DataFrame) -> DataFrame:
        """``(typeno, featno)`` columns to ``(type, feature)``; an unknown number is an error when rows are read."""
        out = numbered.join(F.broadcast(self.types()), "typeno", "left").join(self.features(), "featno", "left")

        def known(name: str, no: str):
            return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"no {name} with number "), F.col(no).cast("string"))))

        return out.withColumns({"type": known("type", "typeno"), "feature": known("feature", "featno")})

    def relations(self) -> DataFrame:
        """``(featno, typenos ARRAY<INT>)`` in the order in which they were defined."""
        listed = self._table("feature_types").groupBy("featno").agg(F.array_sort(F.collect_list(F.struct("commit", "pos", "typeno"))).alias("l"))
        return listed.select("featno", F.transform("l", lambda s: s["typeno"]).alias("typenos"))

    def feature_types(self, feature: str) -> list[str]:
        """Names of the types of a feature, empty if it is unknown."""
        of = self._table("feature_types").join(self.features().where(F.col("feature") == feature), "featno")
        rows = of.join(F.broadcast(self.types()), "typeno").orderBy("commit", "pos").select("type").collect()
        return [r["type"] for r in rows]

    # -- vectors --------------------------------------------------------------------------------------------------

    def vectors(self, type_name: str | None = None) -> DataFrame:
        """``(typeno, featno, vec, lsh)``: the last definition of each key; one type reads one partition."""
        df = self._table("vectors")
        if type_name is not None:
            df = df.where(F.col("typeno") == self.type_no(type_name))
        top = df.groupBy("typeno", "featno").agg(F.max(F.struct("commit", "vec", "lsh")).alias("m"))
        return top.select("typeno", "featno", "m.vec", "m.lsh")

    def prepare(self, type_name: str) -> DataFrame:
        """The hashes of a type, held in memory until the next commit; an undefined type is an error."""
        if type_name not in self._held:
            if not self.type_no(type_name):
                raise StoreError(f"undefined type {type_name!r}")
            self._held[type_name] = self.vectors(type_name).cache()
        return self._held[type_name]

    def hashes(self, type_name: str, start: int = 1, n: int | None = None) -> DataFrame:
        """``(featno, lsh)`` of a type from a number on, in their order."""
        df = (self._held.get(type_name) or self.vectors(type_name)).where(F.col("featno") >= start).select("featno", "lsh").orderBy("featno")
        return df if n is None else df.limit(n)

    def hash_of(self, type_name: str, feature: str) -> list[int] | None:
        """The hash of a feature, null if it has none; one that isn't of the model's size is an error."""
        row = self.vectors(type_name).where(F.col("featno") == self.feature_no(feature)).first()
        if row and len(row["lsh"] or []) != self.config.words:
            raise StoreError(f"corrupt hash of {feature!r} in {type_name!r}")
        return row["lsh"] if row else None

    def feature_at(self, type_name: str, position: int) -> int:
        """The number of the ``position``-th vector (from 0) of a type, 0 if there are fewer."""
        row = self.vectors(type_name).select("featno").orderBy("featno").offset(position).limit(1).first() if position >= 0 else None
        return row["featno"] if row else 0

    def vector(self, type_name: str, feature: str) -> list[float]:
        """The vector of a feature, empty if there is none."""
        row = self.vectors(type_name).where(F.col("featno") == self.feature_no(feature)).first()
        return list(row["vec"]) if row else []

    def n_types(self) -> int:
        return self.types().count()

    def n_features(self) -> int:
        return self.features().count()

    def n_vectors(self, type_name: str | None = None) -> int:
        return self.vectors(type_name).count()

    # -- search ---------------------------------------------------------------------------------------------------

    def find_similar(self, type_name: str, vec: list[float], k: int, min_sim: float, factor: float = 0.8, real_weights: bool = False, prefilter: bool = False) -> DataFrame:
        """The features of a type most similar to a vector: ``(rank, feature, weight)``."""
        no = self.type_no(type_name)
        if not no:
            raise StoreError(f"undefined type {type_name!r}")
        if len(vec) != self.config.vecdim:
            raise StoreError(f"the vector has {len(vec)} components, the store {self.config.vecdim}")
        asked = self.spark.createDataFrame([(1, no, [float(x) for x in vec])], "query_id bigint, typeno int, vec array<float>")
        return self.find_similar_batch(asked, k, min_sim, factor, real_weights, prefilter, self._held.get(type_name)).select("rank", "feature", "weight").orderBy("rank")

    def find_similar_batch(self, queries: DataFrame, k: int, min_sim: float, factor: float = 0.8, real_weights: bool = False, prefilter: bool = False, vectors: DataFrame | None = None) -> DataFrame:
        """Many searches at once: ``(query_id, rank, feature, weight)`` for ``(query_id, typeno, vec)``."""
        vectors = self.vectors() if vectors is None else vectors
        hashed = lshmodel.hash_vectors(queries, self.model())
        run = search.reranked if real_weights else search.search
        found = run(vectors, hashed, bits=self.model().total_bits, k=k, min_sim=min_sim, factor=factor, prefilter=prefilter)
        return found.join(self.features(), "featno").select("query_id", "rank", "feature", "weight")

    # -- writing --------------------------------------------------------------------------------------------------

    def transaction(self) -> "Transaction":
        return Transaction(self)

    def compact(self) -> None:
        """Merges all segments into one of each table. The old ones stay for readers that are open (:meth:`vacuum`)."""
        if self.next_no >= 1 << 22:
            raise StoreError("too many commits")
        merged = {
            "types": self.types(),
            "features": self.features(),
            "feature_types": self._table("feature_types").select("featno", "typeno", (F.col("commit") * F.lit(1 << 40) + F.col("pos")).alias("pos")),
            "vectors": self.vectors(),
            "meta": self.variables(),
            "model": self._table("model").select("row_no", "coeffs"),
        }
        before = self.next_no - 1
        self._write(merged, before, before)
        self._model = None

    def vacuum(self, older_than: float = 7 * 24 * 3600) -> int:
        """Deletes segments and markers that the last commit doesn't need, if they are older than so many seconds.

        Returns the number of segments deleted. Readers that were opened before the commit which put them out of use
        can't read on, and what a running commit has written must be younger.
        """
        self.refresh()
        live = {(name, s) for c, m in self._marks.items() if m for name, s in m.segments.items() if c > (self.kept if name in ("meta", "model") else self.base)}
        gone = 0
        for name in SCHEMAS:
            for n in self.files.names(f"{self.path}/{name}"):
                path = f"{self.path}/{name}/{n}"
                if n.startswith("segment=") and (name, n[8:]) not in live and self.files.age(path) >= older_than:
                    self.files.delete(path)
                    gone += 1
        for c in [c for c in self._marks if c <= min(self.base, self.kept)]:
            path = f"{self.path}/_commits/{c:012d}.json"
            if self.files.age(path) >= older_than:
                self.files.delete(path)
                del self._marks[c]
        return gone

    def release(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()

    def close(self, compact: bool = False) -> None:
        if compact:
            self.compact()
        self.release()

    def bit_text(self) -> DataFrame:
        """``(typeno, featno, bits)`` of all hashes."""
        return self.vectors().select("typeno", "featno", B.to_text("lsh", self.model().total_bits).alias("bits"))


class FeatureCursor:
    """A position in the names of the features, in byte order: no state lies anywhere but here."""

    def __init__(self, store: VectorStore):
        self.store, self.start, self.after, self.prefix = store, "", None, ""

    def skip(self, name: str) -> None:
        """Goes to the first name that isn't below ``name``."""
        self.start, self.after, self.prefix = name, None, ""

    def skip_prefix(self, prefix: str) -> None:
        """Goes to the first name with the prefix; only such names follow."""
        self.start, self.after, self.prefix = prefix, None, prefix

    def fetch(self, n: int) -> list[str]:
        """The next ``n`` names, fewer at the end."""
        df = self.store.features().where(F.col("feature") >= self.start if self.after is None else F.col("feature") > self.after)
        if self.prefix:
            df = df.where(F.col("feature").startswith(self.prefix))
        names = [r["feature"] for r in df.select("feature").orderBy("feature").limit(n).collect()]
        self.after = names[-1] if names else self.after
        return names


@dataclass
class Transaction:
    """Definitions that a commit writes together. Later definitions of a key in it replace earlier ones."""

    store: VectorStore
    rows: list[tuple] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)
    cleared: bool = False
    variables: dict[str, str] = field(default_factory=dict)

    def set_variable(self, name: str, value: str) -> None:
        """A variable of the store that becomes visible with the definitions."""
        self.variables[name] = value

    def define_type(self, name: str) -> None:
        self.rows.append((len(self.rows), name, None, None))

    def define_feature(self, type_name: str, feature: str) -> None:
        self.rows.append((len(self.rows), type_name, feature, None))

    def define_vector(self, type_name: str, feature: str, vec: list[float]) -> None:
        """An empty vector defines the feature only."""
        if vec and len(vec) != self.store.config.vecdim:
            raise StoreError(f"the vector has {len(vec)} components, the store {self.store.config.vecdim}")
        self.rows.append((len(self.rows), type_name, feature, [float(x) for x in vec] or None))

    def define_frame(self, df: DataFrame) -> None:
        """Definitions in bulk: ``(seq, type, feature, vec)``; the highest ``seq`` of a key counts."""
        self.frames.append(df.select(F.col("seq").cast("bigint"), "type", "feature", F.col("vec").cast("array<float>")))

    def clear(self) -> None:
        """Deletes all but variables and the model, before what this transaction defines."""
        self.cleared = True
        self.rows.clear()
        self.frames.clear()

    def rollback(self) -> None:
        self.rows.clear()
        self.frames.clear()
        self.variables.clear()
        self.cleared = False

    def commit(self) -> int:
        """Writes the definitions and returns the number of the commit.

        Names keep their numbers; new ones get the next, in the order in which they were first defined. Vectors are
        hashed on the way. A null type is ignored, a null feature defines the type only; null, empty and unusable
        vectors (another size, components that are null or not finite) define the feature only.
        """
        s, spark = self.store, self.store.spark
        cut = Cut(spark, "commit")
        frames = list(self.frames)
        if self.rows:
            frames.append(spark.createDataFrame(self.rows, DEFINITIONS))
        if not frames and not self.cleared and not self.variables:
            return s.commit_no
        parts: dict[str, DataFrame] = {}
        base = s.base
        if self.cleared:
            s = VectorStore(spark, s.path, s.config)
            s._marks, s.commit_no, s.kept = self.store._marks, self.store.commit_no, self.store.kept
            s.base = base = self.store.next_no - 1
        if self.variables:
            parts["meta"] = spark.createDataFrame(list(self.variables.items()), "name string, value string")
        if frames:
            parts |= self._parts(s, cut, frames)
        commit = self.store._write(parts, base)
        self.rollback()
        return commit

    def _parts(self, s: VectorStore, cut: Cut, frames: list[DataFrame]) -> dict[str, DataFrame]:
        defs = frames[0]
        for p in frames[1:]:
            defs = defs.unionByName(p)
        defs = cut.keep(defs.where(F.col("type").isNotNull()))
        types = cut.keep(encode_names(cut, s.types(), defs, "type", "typeno", "seq"))
        features = cut.keep(encode_names(cut, s.features(), defs, "feature", "featno", "seq"))
        coded = cut.keep(defs.where(F.col("feature").isNotNull()).join(F.broadcast(types), "type").join(features, "feature").select("seq", "typeno", "featno", "vec"))
        known = s._table("feature_types").select("featno", "typeno")
        dim = s.config.vecdim
        usable = (F.size("vec") == dim) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        last = latest(coded.where(usable), ["typeno", "featno"], ["seq"], ["seq", "vec"]).drop("seq")
        return {
            "types": types.join(s.types().select("typeno"), "typeno", "left_anti"),
            "features": features.join(s.features().select("featno"), "featno", "left_anti"),
            "feature_types": coded.groupBy("featno", "typeno").agg(F.min("seq").alias("pos")).join(known, ["featno", "typeno"], "left_anti"),
            "vectors": lshmodel.hash_vectors(last, s.model()).select("featno", "vec", "lsh", "typeno"),
        }
