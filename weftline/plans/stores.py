"""Queries over a vector store built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.config import LexerConfig
from weftline.functions import vec as V
from weftline.operators import lexer, lshmodel
from weftline.session import shared_path, table
from weftline.sources import dump
from weftline.sources.store import VectorStore
from weftline.streaming.ingest import ingest

_STORES: dict[tuple[str, str], str] = {}


def definitions(spark, sf_dir):
    """Rows of the test tables as definitions: ``(seq, type, feature, vec)``."""
    v, t = table(spark, sf_dir, "vectors"), table(spark, sf_dir, "types")
    f = table(spark, sf_dir, "features").distinct()
    return v.join(F.broadcast(t), "typeno").join(f, "featno").select("seq", "type", "feature", "vec")


def store(spark, sf_dir) -> VectorStore:
    """The store of a data directory, made once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = shared_path(spark, "store")
        model = lshmodel.from_frame(table(spark, sf_dir, "lsh_model"))
        made = VectorStore.create(spark, path, "vecdim=64", model=model)
        made.set_variable("origin", "test tables")
        tx = made.transaction()
        tx.define_frame(definitions(spark, sf_dir))
        tx.commit()
        _STORES[key] = path
    return VectorStore.open(spark, _STORES[key])


def store_types(spark, sf_dir):
    return store(spark, sf_dir).types()


def store_features(spark, sf_dir):
    return store(spark, sf_dir).features()


def store_variables(spark, sf_dir):
    return store(spark, sf_dir).variables()


def store_relations(spark, sf_dir):
    return store(spark, sf_dir).relations().select("featno", F.array_join(F.transform("typenos", lambda t: t.cast("string")), ",").alias("typenos"))


def store_counts(spark, sf_dir):
    """Vectors of each type."""
    s = store(spark, sf_dir)
    return s.vectors().groupBy("typeno").agg(F.count("*").alias("n_vectors"), F.min("featno").alias("first_featno"))


def store_vectors(spark, sf_dir):
    """Vectors by name: both dictionaries and the upsert."""
    s = store(spark, sf_dir)
    return s.decode(s.vectors()).select("type", "feature", F.round(V.norm("vec"), 6).alias("norm"), F.element_at("lsh", 1).alias("word0"))


def feature_prefix_scan(spark, sf_dir):
    return store(spark, sf_dir).feature_prefix("le").select("feature")


def feature_page(spark, sf_dir):
    """The 20 names that follow a name: the limit is the page."""
    s = store(spark, sf_dir)
    return s.features().where(F.col("feature") > "m").select("feature").orderBy("feature").limit(20)


def hash_range(spark, sf_dir):
    """The first 50 hashes of a type from a number on: a range read with its limit."""
    s = store(spark, sf_dir)
    return s.hashes("T1", 100, 50).select("featno", F.element_at("lsh", 1).alias("word0"))


def dump_text(spark, sf_dir):
    return dump.store_lines(store(spark, sf_dir))


def stream_ingest(spark, sf_dir):
    """The definitions as a stream into an empty store; the outcome equals that of one commit."""
    src = shared_path(spark, "feed")
    definitions(spark, sf_dir).write.parquet(src)
    model = lshmodel.from_frame(table(spark, sf_dir, "lsh_model"))
    target = VectorStore.create(spark, shared_path(spark, "store"), "vecdim=64", model=model)
    feed = spark.readStream.schema("seq bigint, type string, feature string, vec array<float>").parquet(src)
    ingest(feed, target, "feed", shared_path(spark, "offsets"), once=True).awaitTermination()
    out = VectorStore.open(spark, target.path)
    return out.vectors().groupBy("typeno").agg(F.count("*").alias("n_vectors")).join(out.types(), "typeno").select("type", "n_vectors")


def _rows(spark, rows):
    return spark.createDataFrame([(str(k), str(v)) for k, v in rows], "what string, value string")


def store_recovery(spark, sf_dir):
    """A store after a commit that died before its marker, one rolled back, a variable, and a compaction under an open reader."""
    s = VectorStore.create(spark, shared_path(spark, "store"), "vecdim=64;lextypes=T2,T1", model=lshmodel.from_frame(table(spark, sf_dir, "lsh_model")))
    tx = s.transaction()
    tx.define_frame(definitions(spark, sf_dir).where(F.col("type").isin("T1", "T2", "T3")))
    tx.define_type("T9")
    tx.commit()
    s._append("types", spark.createDataFrame([(99, "ghost")], "typeno int, type string"), s.next_no)  # no marker follows
    undone = s.transaction()
    undone.define_vector("T1", "undone", [1.0] * 64)
    undone.rollback()
    undone.commit()
    s.set_variable("after", "crash")
    reader = VectorStore.open(spark, s.path)
    held = reader.vectors().groupBy("typeno").count()
    s.compact()
    merged = VectorStore.open(spark, s.path, "vecdim=7")
    cleared = s.transaction()
    cleared.clear()
    cleared.define_type("T5")
    cleared.commit()
    empty = VectorStore.open(spark, s.path) if not s.config.lexer.lextypes else s
    named = [("reader", held.join(reader.types(), "typeno")), ("merged", merged.vectors().groupBy("typeno").count().join(merged.types(), "typeno"))]
    rows = [(f"{k} {r['type']}", r["count"]) for k, df in named for r in df.collect()]
    rows += [("types", ",".join(r["type"] for r in merged.list_types().collect())), ("first", f"{merged.type_no('T2')},{merged.type_no('T1')}"), ("undone", merged.feature_no("undone")), ("after", merged.variable("after")), ("ignored", ",".join(merged.config.ignored)), ("dim", merged.config.vecdim)]
    rows += [("cleared", ",".join(r["type"] for r in empty.list_types().collect())), ("left", empty.n_vectors() + empty.n_features()), ("kept", empty.variable("after"))]
    return _rows(spark, rows)


def store_points(spark, sf_dir):
    """Point reads: seek, cursor, numbers and names both ways, one vector and hash, the held type, positions."""
    s = store(spark, sf_dir)
    cursor = s.feature_cursor()
    cursor.skip_prefix("le")
    pages = cursor.fetch(3) + cursor.fetch(4)
    cursor.skip("m")
    at = s.feature_at("T1", 3)
    name = s.feature_name(at)
    one = s.encode(spark.createDataFrame([("T1", name), ("no such", "no such")], "type string, feature string")).orderBy(F.desc("featno")).collect()
    s.prepare("T1")
    held = s.hashes("T1", at, 1).first()
    best = s.find_similar("T1", s.vector("T1", name), 1, 0.9, real_weights=True).first()
    rows = [
        ("seek", s.feature_seek("m").feature), ("prefix", ",".join(pages)), ("skip", ",".join(cursor.fetch(2))), ("at", at), ("beyond", s.feature_at("T1", 10**6)), ("name", name), ("type", s.type_name(s.type_no("T1"))),
        ("encoded", f"{one[0].typeno},{one[0].featno},{one[1].typeno},{one[1].featno}"), ("first", round(s.vector("T1", name)[0], 5)), ("hash", s.hash_of("T1", name)[0]), ("held", f"{held.featno},{held.lsh[0]}"),
        ("none", len(s.vector("T1", "no such"))), ("types", ",".join(s.feature_types(name))), ("counts", f"{s.n_types()},{s.n_features()},{s.n_vectors('T1')}"), ("weight", round(best.weight, 4)),
    ]
    s.release()
    return _rows(spark, rows)


def model_matrix(spark, sf_dir):
    """The base matrix, seeded rotations, and a model written and read back."""
    base = lshmodel.base_matrix(64, 12)
    rows = [(r, c, float(round(v, 9))) for r, line in enumerate(base) for c, v in enumerate(line)]
    model, again = lshmodel.create_model(64, 12, 3, 5), lshmodel.create_model(64, 12, 3, 5)
    path = shared_path(spark, "model")
    lshmodel.to_frame(spark, model).write.parquet(path)
    kept = lshmodel.from_frame(spark.read.parquet(path))
    checks = [model.equals(again), kept.equals(model), not model.equals(lshmodel.create_model(64, 12, 3, 6)), kept.matrix.shape == (36, 64), kept.total_bits == 36 and kept.words == 1]
    rows += [(-1, i, float(ok)) for i, ok in enumerate(checks)]
    return spark.createDataFrame(rows, "row_no int, col_no int, value double")


def _lexer_queries(s):
    f = s.features()
    after = f.select((F.col("featno") - 1).alias("featno"), F.col("feature").alias("next"))
    pair = F.concat_ws("_", "feature", "next")
    return f.join(after, "featno", "left").select(F.col("featno").cast("bigint").alias("query_id"), F.array(pair, F.lit(""), F.concat("feature", F.lit("_of"))).alias("fields"), F.lit(-1).alias("n"), F.lit(0.5).alias("min_weight"))


def sentence_guesses(spark, sf_dir):
    """Each feature's name and the next, an empty field, and the first name again before an unknown word, read by the lexer."""
    s = store(spark, sf_dir)
    found = lexer.lex(_lexer_queries(s), s.features(), s.relations(), s.types(), s.vectors(), LexerConfig(lextypes={"T1": 0, "T2": 0, "T3": 1, "T4": 2}, coversim=0.8))
    terms = F.array_join(F.transform("terms", lambda t: F.concat(t["type"], F.lit(":"), t["value"])), " ")
    return found.select("query_id", terms.alias("terms"), F.round("weight", 5).alias("weight"))


QUERIES = {f.__name__: f for f in (store_types, store_features, store_variables, store_relations, store_counts, store_vectors, feature_prefix_scan, feature_page, hash_range, dump_text, stream_ingest, store_recovery, store_points, model_matrix, sentence_guesses)}

_DEF = """
WITH d AS (SELECT DISTINCT v.seq, t.type, f.feature, v.vec FROM vectors v JOIN types t USING (typeno) JOIN (SELECT DISTINCT featno, feature FROM features) f USING (featno)),
tn AS (SELECT CAST(row_number() OVER (ORDER BY min(seq), type) AS INT) AS typeno, type FROM d GROUP BY type),
fn AS (SELECT CAST(row_number() OVER (ORDER BY min(seq), feature) AS INT) AS featno, feature FROM d GROUP BY feature),
c AS (SELECT seq, typeno, featno, vec FROM d JOIN tn USING (type) JOIN fn USING (feature)),
rel AS (SELECT featno, string_agg(CAST(typeno AS VARCHAR), ',' ORDER BY pos, typeno) AS typenos, string_agg(CAST(typeno AS VARCHAR), ' ' ORDER BY pos, typeno) AS spaced FROM (SELECT featno, typeno, min(seq) AS pos FROM c GROUP BY 1, 2) GROUP BY featno),
sv AS (SELECT typeno, featno, CAST(vec AS DOUBLE[]) AS vec FROM (SELECT *, row_number() OVER (PARTITION BY typeno, featno ORDER BY seq DESC) AS rn FROM c
  WHERE vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE rn = 1),
"""

_SH = (
    _DEF
    + """
h AS (SELECT typeno, featno, any_value(s.vec) AS vec, string_agg(CASE WHEN list_inner_product(s.vec, CAST(m.coeffs AS DOUBLE[])) >= 0 THEN '1' ELSE '0' END, '' ORDER BY m.row_no) AS t
  FROM sv s CROSS JOIN lsh_model m GROUP BY typeno, featno),
"""
)
_WORD0 = "CAST(CAST(substr(t, 1, 64) AS BIT) AS BIGINT) AS word0"
_CONFIG = "vecdim=64;bits=32;variations=13;coversim=0.8;recall=0.8;spacesb=_;linksb=-"
_VARS = f"(SELECT * FROM (VALUES ('version', '1.0'), ('config', '{_CONFIG}'), ('origin', 'test tables')) AS x(name, value))"
_F6 = "array_to_string(list_transform({0}, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ' ')"

# the lexer by recursion: all readings of each field, their types, all sentences, and the greedy cover of each
_LEXER = _DEF.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + """
q AS (SELECT a.featno AS query_id, a.feature, a.feature || coalesce('_' || b.feature, '') AS pair FROM fn a LEFT JOIN fn b ON b.featno = a.featno + 1),
fields AS (SELECT query_id, 1 AS k, pair AS t FROM q UNION ALL SELECT query_id, 2, feature || '_of' FROM q),
pos AS (SELECT query_id, k, t, p, substr(t, p + 1, 1) IN ('_', '-') AS sep, p = 0 OR substr(t, p, 1) IN ('_', '-') AS head FROM (SELECT *, unnest(range(0, length(t))) AS p FROM fields)),
ends AS (SELECT query_id, k, p AS e FROM pos WHERE p > 0 AND sep UNION ALL SELECT query_id, k, length(t) FROM fields),
span AS (SELECT query_id, k, t, p, e, substr(t, p + 1, e - p) AS s FROM pos JOIN ends USING (query_id, k) WHERE (sep OR head) AND p < e
  UNION ALL SELECT query_id, k, t, p, length(t), substr(t, p + 1) || '-' FROM pos WHERE sep OR head),
move AS (SELECT query_id, k, p, e + CASE WHEN substr(t, e + 1, 1) IN ('_', '-') THEN 1 ELSE 0 END AS nxt, 0 AS u, ['F' || featno] AS item FROM span JOIN fn ON replace(s, '-', '_') = replace(feature, '-', '_')
  UNION ALL SELECT query_id, k, p, p + 1, 0, [] FROM pos WHERE sep
  UNION ALL SELECT query_id, k, p, e + CASE WHEN substr(t, e + 1, 1) IN ('_', '-') THEN 1 ELSE 0 END, 1, ['W' || substr(t, p + 1, e - p)]
    FROM (SELECT query_id, k, t, p, min(e) AS e FROM pos JOIN ends USING (query_id, k) WHERE NOT sep AND e > p GROUP BY ALL)),
way AS (SELECT query_id, k, CAST(0 AS BIGINT) AS at, 0 AS un, CAST([] AS VARCHAR[]) AS items FROM fields
  UNION ALL SELECT w.query_id, w.k, m.nxt, w.un + m.u, list_concat(w.items, m.item) FROM way w JOIN move m ON m.query_id = w.query_id AND m.k = w.k AND m.p = w.at),
full_way AS (SELECT DISTINCT w.query_id, w.k, un, items FROM way w JOIN fields f ON f.query_id = w.query_id AND f.k = w.k AND w.at >= length(f.t)),
least AS (SELECT *, min(un) OVER (PARTITION BY query_id, k) AS lu FROM full_way),
reading AS (SELECT query_id, k, items FROM (SELECT *, min(len(items)) OVER (PARTITION BY query_id, k) AS ls FROM least WHERE un = lu) WHERE len(items) <= ls + 1),
prio AS (SELECT typeno, type, p FROM tn JOIN (VALUES ('T1', 0), ('T2', 0), ('T3', 1), ('T4', 2)) AS x(type, p) USING (type)),
kind AS (SELECT featno, typeno, type FROM (SELECT *, min(p) OVER (PARTITION BY featno) AS best FROM (SELECT DISTINCT featno, typeno FROM c) JOIN prio USING (typeno)) WHERE p = best),
opt AS (SELECT 'F' || featno AS item, coalesce(type, '') || ':' || feature AS term, coalesce(typeno, 0) AS typeno, featno FROM fn LEFT JOIN kind USING (featno)
  UNION SELECT DISTINCT i, ':' || substr(i, 2), 0, 0 FROM (SELECT unnest(items) AS i FROM reading) WHERE starts_with(i, 'W')),
var AS (SELECT query_id, k, items, 0 AS n, CAST([] AS VARCHAR[]) AS terms FROM reading
  UNION ALL SELECT v.query_id, v.k, v.items, v.n + 1, list_append(v.terms, o.term) FROM var v JOIN opt o ON o.item = v.items[v.n + 1] WHERE v.n < len(v.items)),
done AS (SELECT DISTINCT query_id, k, terms FROM var WHERE n = len(items)),
sent AS (SELECT DISTINCT a.query_id, list_concat(a.terms, b.terms) AS terms FROM done a JOIN done b ON b.query_id = a.query_id AND a.k = 1 AND b.k = 2),
term AS (SELECT DISTINCT query_id, x.term, o.typeno, o.featno FROM (SELECT query_id, unnest(terms) AS term FROM sent) x JOIN opt o USING (term)),
tv AS (SELECT query_id, term, vec FROM term JOIN sv USING (typeno, featno)),
near AS (SELECT a.query_id, a.term, b.term AS other FROM tv a JOIN tv b ON a.query_id = b.query_id WHERE list_cosine_similarity(a.vec, b.vec) > 0.8 AND isfinite(list_cosine_similarity(a.vec, b.vec)) UNION SELECT query_id, term, term FROM term),
grp AS (SELECT query_id, term, list(other) AS g FROM near GROUP BY ALL),
one AS (SELECT query_id, terms, unnest(terms) AS term FROM sent),
cov AS (SELECT query_id, terms, list(g) AS rest, 0 AS n FROM one JOIN grp USING (query_id, term) GROUP BY ALL
  UNION ALL SELECT query_id, terms, list_filter(rest, lambda g: NOT list_contains(g, top)), n + 1 FROM (
    SELECT *, (list_sort(list_transform(list_distinct(flatten(rest)), lambda x: {'c': -len(list_filter(flatten(rest), lambda y: y = x)), 'x': x}))[1]).x AS top FROM cov WHERE len(rest) > 0)),
w AS (SELECT query_id, terms, 1.3 / (n + (len(terms) - len(list_distinct(terms))) + 0.3 * len(terms)) AS w FROM cov WHERE len(rest) = 0),
"""

ORACLE = {
    "store_types": _DEF + "z AS (SELECT 1) SELECT typeno, type FROM tn",
    "store_features": _DEF + "z AS (SELECT 1) SELECT featno, feature FROM fn",
    "store_variables": f"SELECT name, value FROM {_VARS}",
    "store_relations": _DEF + "z AS (SELECT 1) SELECT featno, typenos FROM rel",
    "store_counts": _DEF + "z AS (SELECT 1) SELECT typeno, count(*) AS n_vectors, min(featno) AS first_featno FROM sv GROUP BY typeno",
    "store_vectors": _SH + f"z AS (SELECT 1) SELECT type, feature, round(sqrt(list_inner_product(vec, vec)), 6) AS norm, {_WORD0} FROM h JOIN tn USING (typeno) JOIN fn USING (featno)",
    "feature_prefix_scan": _DEF + "z AS (SELECT 1) SELECT feature FROM fn WHERE starts_with(feature, 'le')",
    "feature_page": _DEF + "z AS (SELECT 1) SELECT feature FROM fn WHERE feature > 'm' ORDER BY feature LIMIT 20",
    "hash_range": _SH + f"z AS (SELECT 1) SELECT featno, {_WORD0} FROM h JOIN tn USING (typeno) WHERE type = 'T1' AND featno >= 100 ORDER BY featno LIMIT 50",
    "dump_text": _SH
    + f"""z AS (SELECT 1)
SELECT 0 AS family, name AS key, 'variable: ' || name || ' ' || value AS line FROM {_VARS}
UNION ALL SELECT 1, type, 'type: ' || type || ' ' || typeno FROM tn UNION ALL SELECT 2, feature, 'value: ' || feature || ' ' || featno FROM fn
UNION ALL SELECT 3, printf('%010d', typeno), 'typeinv: ' || typeno || ' ' || type FROM tn UNION ALL SELECT 4, printf('%010d', featno), 'valueinv: ' || featno || ' ' || feature FROM fn
UNION ALL SELECT 5, printf('%010d%010d', typeno, featno), 'vector: ' || {_F6.format("vec")} FROM h
UNION ALL SELECT 6, printf('%010d%010d', typeno, featno), 'simhash: ' || typeno || ' ' || featno || ' ' || array_to_string(list_transform(range(0, 7), lambda i: substr(t, CAST(1 + 64 * i AS INT), 64)), '|') FROM h
UNION ALL SELECT 7, printf('%010d', typeno), 'nofvec: ' || typeno || ' ' || count(*) FROM h GROUP BY typeno
UNION ALL SELECT 8, '', 'noftypeno: ' || count(*) FROM tn UNION ALL SELECT 9, '', 'noffeatno: ' || count(*) FROM fn
UNION ALL SELECT 10, printf('%010d', row_no), {_F6.format("coeffs")} FROM lsh_model UNION ALL SELECT 10, '', 'lshmodel:'
UNION ALL SELECT 11, printf('%010d', featno), 'firel: ' || featno || ' ' || spaced FROM rel""",
    "store_recovery": _DEF
    + """d3 AS (SELECT typeno, featno, type, vec FROM c JOIN tn USING (typeno) WHERE type IN ('T1', 'T2', 'T3')),
n AS (SELECT type, count(*) AS n FROM sv JOIN tn USING (typeno) WHERE type IN ('T1', 'T2', 'T3') GROUP BY type)
SELECT k || ' ' || type AS what, CAST(n AS VARCHAR) AS value FROM n, (VALUES ('reader'), ('merged')) AS v(k)
UNION ALL SELECT * FROM (VALUES ('types', 'T1,T2,T3,T9'), ('first', '1,2'), ('undone', '0'), ('after', 'crash'), ('ignored', 'vecdim'), ('dim', '64'), ('cleared', 'T5'), ('left', '0'), ('kept', 'crash')) AS x(what, value)""",
    "store_points": _SH
    + f"""t1 AS (SELECT typeno FROM tn WHERE type = 'T1'),
p AS (SELECT featno, feature, vec, {_WORD0} FROM h JOIN fn USING (featno) WHERE typeno = (SELECT typeno FROM t1) ORDER BY featno LIMIT 1 OFFSET 3),
z AS (SELECT 1)
SELECT 'seek' AS what, min(feature) AS value FROM fn WHERE feature >= 'm'
UNION ALL SELECT 'prefix', string_agg(feature, ',' ORDER BY feature) FROM (SELECT feature FROM fn WHERE starts_with(feature, 'le') ORDER BY feature LIMIT 7)
UNION ALL SELECT 'skip', string_agg(feature, ',' ORDER BY feature) FROM (SELECT feature FROM fn WHERE feature >= 'm' ORDER BY feature LIMIT 2)
UNION ALL SELECT 'at', CAST(featno AS VARCHAR) FROM p UNION ALL SELECT 'name', feature FROM p
UNION ALL SELECT 'encoded', (SELECT typeno FROM t1) || ',' || featno || ',0,0' FROM p
UNION ALL SELECT 'first', CAST(round(vec[1], 5) AS VARCHAR) FROM p UNION ALL SELECT 'hash', CAST(word0 AS VARCHAR) FROM p UNION ALL SELECT 'held', featno || ',' || word0 FROM p
UNION ALL SELECT 'types', string_agg(type, ',' ORDER BY pos, typeno) FROM (SELECT c.typeno, type, min(seq) AS pos FROM c JOIN p USING (featno) JOIN tn ON tn.typeno = c.typeno GROUP BY 1, 2)
UNION ALL SELECT 'counts', (SELECT count(*) FROM tn) || ',' || (SELECT count(*) FROM fn) || ',' || (SELECT count(*) FROM h WHERE typeno = (SELECT typeno FROM t1))
UNION ALL SELECT * FROM (VALUES ('beyond', '0'), ('type', 'T1'), ('none', '0'), ('weight', '1.0')) AS x(what, value)""",
    "model_matrix": """
WITH r AS (SELECT r, CAST(floor(r * (64 / 12)) AS INT) AS lo, CASE WHEN r = 11 THEN 64 ELSE CAST(floor((r + 1) * (64 / 12)) AS INT) END AS hi FROM range(0, 12) t(r))
SELECT CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, round(CASE WHEN c >= lo AND c < hi THEN 1 / (hi - lo) ELSE -1 / (64 - (hi - lo)) END, 9) AS value FROM r, range(0, 64) s(c)
UNION ALL SELECT -1, CAST(i AS INT), 1.0 FROM range(0, 5) u(i)""",
    "sentence_guesses": _LEXER
    + """top AS (SELECT *, w / max(w) OVER (PARTITION BY query_id) AS weight FROM w)
SELECT CAST(query_id AS BIGINT) AS query_id, array_to_string(terms, ' ') AS terms, round(weight, 5) AS weight FROM top WHERE weight > 0.5 + 1.2e-7""",
    "stream_ingest": _DEF + "z AS (SELECT 1) SELECT type, count(*) AS n_vectors FROM sv JOIN tn USING (typeno) GROUP BY type",
}
