"""Clusters of mutually similar vectors, by MinHash over sets of nearest directions and an exact pass over what it leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.cells import blobs, distinct_vectors, fit_cells, in_tasks, matrix, routed, units
from weftline.llm.components import connected_components
from weftline.session import Cut

#: Directions in a vector's set: one in so many of the signed ones, and at least so many.
DIRECTION_SHARE, DIRECTIONS = 10, 40
#: A model with fewer rows is filled up with seeded random directions, since small sets tell little.
LEAST_ROWS = 416
#: Least Jaccard similarity of two sets whose vectors are compared. Of pairs at cosine 0.8 to 0.95 of 64 components
#: and 416 directions 99 in 100 have 0.42 or more, of pairs below 0.7 as many have 0.14 or less.
LEAST_JACCARD = 0.3
#: MinHash bands and rows in a band. Of pairs at cosine 0.8 to 0.95 all but 2 in 10,000 meet in a band.
BANDS, ROWS = 80, 3
#: As in the search for neighbours: cells visited at most and the margin of their centroids.
PROBES, MARGIN = 6, 0.12
#: Vectors of a type, or of a component, that one task takes; of larger ones each pair of blocks goes to a task.
BLOCK = 1 << 15
#: Products of the exact pass held at once, and more than single precision and rounding can move a cosine.
_TILE, SLACK = 1 << 21, 2e-5
#: Links that are listed rather than found anew each time a loose part is split.
LISTED = 1 << 23


def direction_sets(unit: np.ndarray, rows: np.ndarray, m: int | None = None) -> np.ndarray:
    """The ``m`` of the signed directions ``+rows`` and ``-rows`` that lie nearest to each vector.

    Near vectors share many of these; unrelated ones share about as many as chance gives. Directions are numbered
    ``0 .. 2 * len(rows) - 1``.
    """
    p = unit @ rows.T
    m = min(m or max(DIRECTIONS, 2 * len(rows) // DIRECTION_SHARE), p.shape[1])
    at = np.argpartition(-np.abs(p), m - 1, axis=1)[:, :m]
    return at + np.where(np.take_along_axis(p, at, 1) < 0, len(rows), 0)


def signatures(sets: np.ndarray, universe: int, hashes: int, seed: int = 11) -> np.ndarray:
    """MinHash: for each of ``hashes`` permutations of the universe the least rank of a set's members."""
    rng = np.random.default_rng(seed)
    kind = np.uint16 if universe <= 1 << 16 else np.uint32
    members = np.ascontiguousarray(sets.T, dtype=np.int32)
    out = np.empty((hashes, len(sets)), dtype=kind)
    for h in range(hashes):
        np.take(rng.permutation(universe).astype(kind), members).min(axis=0, out=out[h])
    return out.T


def band_links(unit: np.ndarray, sets: np.ndarray, universe: int, least: float, bands: int = BANDS, rows: int = ROWS, least_jaccard: float = LEAST_JACCARD) -> np.ndarray:
    """Verified links ``(a, b)``, ``a < b``, between rows that share a band.

    In each bucket the first row leads: it is compared with all others, exact Jaccard similarity first and exact
    cosine last. Rows that reach the thresholds are linked to it; among the rest the next row leads, and so on until
    none is left. No bucket is capped, and a bucket of mutually similar rows costs one comparison for each row.
    """
    n = len(sets)
    sig = signatures(sets, universe, bands * rows)
    keys = np.zeros((n, bands), dtype=np.int64)
    for r in range(rows):
        keys = keys * universe + sig[:, r::rows]
    keys = keys * bands + np.arange(bands)
    row = np.repeat(np.arange(n), bands)
    order = np.lexsort((row, keys.ravel()))
    key, row = keys.ravel()[order], row[order]
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    big = np.bincount(group)[group] > 1
    group, row = group[big], row[big]
    group = np.cumsum(np.r_[0, group[1:] != group[:-1]]) if len(group) else group

    member = np.zeros((n, universe), dtype=bool)
    member[np.arange(n)[:, None], sets] = True
    bits = np.packbits(member, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
    size = sets.shape[1]

    links: list[np.ndarray] = []
    waiting = np.ones(len(row), dtype=bool)  # not yet linked to a leader of its bucket, nor one itself
    led = np.zeros(len(row), dtype=bool)
    seen = np.empty(0, dtype=np.int64)
    good = np.empty(0, dtype=bool)
    while len(row):
        n_groups = group[-1] + 1
        lead = np.full(n_groups, -1)
        w = np.flatnonzero(waiting)[::-1]
        lead[group[w]] = w  # the first waiting entry of each group
        at = lead[group]
        led[lead] = True
        waiting[lead] = False
        e = np.flatnonzero(~led)
        a, b = row[at[e]], row[e]
        pair = np.minimum(a, b) * np.int64(n) + np.maximum(a, b)
        fresh = _distinct(pair)
        spot = np.searchsorted(seen, fresh)
        if len(seen):
            fresh = fresh[seen[np.minimum(spot, len(seen) - 1)] != fresh]
        ok = _similar(fresh // n, fresh % n, unit, bits, size, least, least_jaccard)
        links.append(fresh[ok])
        spot = np.searchsorted(seen, fresh)
        seen, good = np.insert(seen, spot, fresh), np.insert(good, spot, ok)
        waiting[e[good[np.searchsorted(seen, pair)]]] = False
        live = np.zeros(n_groups, dtype=bool)
        live[group[waiting]] = True
        keep = live[group]
        row, waiting, led = row[keep], waiting[keep], led[keep]
        group = np.cumsum(np.r_[0, np.diff(group[keep]) != 0]) if len(row) else row
    found = _distinct(np.concatenate(links)) if links else np.empty(0, dtype=np.int64)
    return np.stack([found // n, found % n], axis=1) if len(found) else np.empty((0, 2), dtype=np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in ascending order; by sorting, which is much faster here than hashing."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _similar(a, b, unit, bits, size, least, least_jaccard, block: int = 1 << 16) -> np.ndarray:
    out = np.zeros(len(a), dtype=bool)
    for s in range(0, len(a), block):
        x, y = a[s : s + block], b[s : s + block]
        both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        k = np.flatnonzero(both >= least_jaccard * (2 * size - both))
        out[s + k] = np.einsum("ij,ij->i", unit[x[k]], unit[y[k]]) >= least
    return out


def components(n: int, links: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(n)
    while len(links):
        old = label.copy()
        low = np.minimum(label[links[:, 0]], label[links[:, 1]])
        np.minimum.at(label, links[:, 0], low)
        np.minimum.at(label, links[:, 1], low)
        label = label[label]
        if (label == old).all():
            break
    return label


def near_pairs(unit: np.ndarray, least: float, first: int | None = None, label=None):
    """All pairs ``(a, b)`` of rows at a cosine of ``least`` or more (to 6 digits), a part at a time.

    Products in single precision choose what is checked exactly. With ``first`` only pairs of a row before it and one
    from there on are given. ``label`` is a function whose present labels of the rows tell pairs that aren't wanted.
    """
    x, limit = unit.astype(np.float32), np.float32(least - SLACK)
    s, end = 0, len(x) if first is None else first
    while s < end:
        c = s if first is None else first
        e = min(end, s + max(1, _TILE // max(1, len(x) - c)))
        hit = x[s:e] @ x[c:].T >= limit
        now = label() if label else None
        if label and np.count_nonzero(hit) > _TILE >> 4:  # a dense group, most of which is joined already
            hit &= now[s:e, None] != now[None, c:]
        a, b = np.divmod(np.flatnonzero(hit), len(x) - c)
        a, b = a + s, b + c
        new = (a < b) & (now[a] != now[b]) if label else a < b
        a, b = a[new], b[new]
        good = np.empty(len(a), dtype=bool)
        for k in range(0, len(a), 1 << 16):
            part = slice(k, k + (1 << 16))
            good[part] = np.round(np.einsum("ij,ij->i", unit[a[part]], unit[b[part]]), 6) >= least
        if good.any():
            yield a[good], b[good]
        s = e


def linked_labels(unit: np.ndarray, label: np.ndarray, least: float, first: int | None = None) -> np.ndarray:
    """For each label ``0 .. k - 1`` the smallest one that links (:func:`near_pairs`) join it with; rows of a label belong together."""
    root = np.arange(label.max() + 1)
    for a, b in near_pairs(unit, least, first, lambda: root[label]):
        pair = _distinct(root[label[a]] * np.int64(len(root)) + root[label[b]])
        root = components(len(root), np.stack(np.divmod(pair, len(root)), axis=1))[root]
    return root


def _regrouping(unit: np.ndarray, least: float):
    """A function that gives rows left over from groups their components by links among themselves.

    The links of the first rows are listed, if there aren't too many; later rows are some of them.
    """
    listed: list[np.ndarray] = []

    def parts(rows, group):
        order = np.argsort(group, kind="stable")
        return np.split(rows[order], np.flatnonzero(np.diff(group[order])) + 1)

    def all_links(rows, group):
        found, n = [np.empty((0, 2), dtype=np.int64)], 0
        for part in parts(rows, group):
            for a, b in near_pairs(unit[part], least):
                n += len(a)
                if n > LISTED:
                    return None
                found.append(np.stack([part[a], part[b]], axis=1))
        return np.concatenate(found)

    def regroup(rows, group):
        if not listed:
            listed.append(all_links(rows, group))
        out = np.arange(len(unit))
        if listed[0] is not None:
            free = np.zeros(len(unit), dtype=bool)
            free[rows] = True
            listed[0] = listed[0][free[listed[0]].all(axis=1)]
            return components(len(unit), listed[0])[rows]
        for part in parts(rows, group):
            out[part] = part[linked_labels(unit[part], np.arange(len(part)), least)]
        return out[rows]

    return regroup


def split_groups(unit: np.ndarray, group: np.ndarray, least: float, regroup=None) -> np.ndarray:
    """The medoid of each row, -1 for rows whose group is -1.

    Of a component the row with the highest degree, weighted by similarity, becomes a medoid: the one with the largest
    sum of cosines to all rows of the component, which their summed vector gives without listing pairs (to 6 digits of
    the mean; the first of equals). It takes all rows of the component that are similar to it; what is left over is
    a looser part, of which ``regroup(rows, groups)`` tells the components and which is split in the same way. A row
    whose partners all went to other medoids is left as its own.
    """
    medoid = np.full(len(unit), -1)
    rows, group = np.flatnonzero(group >= 0), group[group >= 0]
    regroup = regroup or _regrouping(unit, least)
    while len(rows):
        group = np.unique(group, return_inverse=True)[1]
        sums = np.zeros((group.max() + 1, unit.shape[1]))
        np.add.at(sums, group, unit[rows])
        mean = np.round(np.einsum("ij,ij->i", unit[rows], sums[group]) / np.bincount(group)[group], 6)
        order = np.lexsort((rows, -mean, group))
        head = rows[order[np.r_[True, np.diff(group[order]) != 0]]]
        mine = head[group]
        close = (np.round(np.einsum("ij,ij->i", unit[rows], unit[mine]), 6) >= least) | (rows == mine)
        medoid[rows[close]] = mine[close]
        rows, group = rows[~close], group[~close]
        group = regroup(rows, group) if len(rows) else group
    return medoid


def split_loose(unit: np.ndarray, links: np.ndarray, least: float) -> np.ndarray:
    """:func:`split_groups` of the components of given links; rows without links have the medoid -1."""
    n = len(unit)
    linked = np.bincount(links.ravel(), minlength=n) > 0 if len(links) else np.zeros(n, dtype=bool)

    def regroup(rows, _):
        free = np.zeros(n, dtype=bool)
        free[rows] = True
        return components(n, links[free[links].all(axis=1)])[rows]

    return split_groups(unit, np.where(linked, components(n, links), -1), least, regroup)


LABELS = "typeno int, featno int, label bigint"


def _ids(typeno: int, feat: np.ndarray) -> np.ndarray:
    return (np.int64(typeno) << np.int64(32)) | (feat.astype(np.int64) & np.int64(0xFFFFFFFF))


def _cell_labels(model: np.ndarray, least: float):
    schema = pa.schema([("typeno", pa.int32()), ("featno", pa.int32()), ("label", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        feat = np.asarray(table["featno"])
        if len(feat) < 2:
            return schema.empty_table()
        order = np.argsort(feat)
        feat, unit = feat[order], units(blobs(table["vec"])[order])
        links = band_links(unit, direction_sets(unit, model), 2 * len(model), least)
        rows = np.unique(links)
        typeno = table["typeno"][0].as_py()
        label = _ids(typeno, feat)[components(len(feat), links)[rows]]
        return pa.table([pa.array(c, t) for c, t in zip((np.full(len(rows), typeno), feat[rows], label), schema.types, strict=True)], schema=schema)

    return run


FOUND = "typeno int, featno int, medoid int, sim double"
_FOUND = pa.schema([("typeno", pa.int32()), ("featno", pa.int32()), ("medoid", pa.int32()), ("sim", pa.float64())])


def _found(typ: np.ndarray, feat: np.ndarray, unit: np.ndarray, medoid: np.ndarray) -> pa.Table:
    rows = np.flatnonzero(medoid >= 0)
    at = medoid[rows]
    cols = typ[rows], feat[rows], feat[at], np.einsum("ij,ij->i", unit[rows], unit[at])
    return pa.table([pa.array(c, t) for c, t in zip(cols, _FOUND.types, strict=True)], schema=_FOUND)


def _labelled(table: pa.Table, known: pa.Table):
    """Vectors of a type in order, with the labels known of them and their own ids for the others."""
    feat = np.asarray(table["featno"])
    order = np.argsort(feat)
    feat, unit = feat[order], units(blobs(table["vec"])[order])
    label = _ids(table["typeno"][0].as_py(), feat)
    if known.num_rows:
        label[np.searchsorted(feat, np.asarray(known["featno"]))] = np.asarray(known["label"])
    return order, feat, unit, label


def _type_clusters(least: float):
    """Clusters of a type that one task holds."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return _FOUND.empty_table()
        _, feat, unit, label = _labelled(table, known)
        code = np.unique(label, return_inverse=True)[1]
        group = linked_labels(unit, code, least)[code]
        group = np.where(np.bincount(group)[group] > 1, group, -1)
        return _found(np.full(len(feat), table["typeno"][0].as_py()), feat, unit, split_groups(unit, group, least))

    return run


def _component_clusters(least: float):
    """Clusters of some whole components."""

    def run(table: pa.Table) -> pa.Table:
        typ, feat = np.asarray(table["typeno"]), np.asarray(table["featno"])
        order = np.lexsort((feat, typ))
        unit = units(blobs(table["vec"])[order])
        group = np.unique(np.asarray(table["comp"])[order], return_inverse=True)[1]
        return _found(typ[order], feat[order], unit, split_groups(unit, group, least))

    return run


def _block_links(least: float):
    """Links between labels, as a forest, of the vectors of two blocks or of one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return schema.empty_table()
        order, _, unit, label = _labelled(table, known)
        first, a, b = None, table["a"][0].as_py(), table["b"][0].as_py()
        if a != b:
            late = np.asarray(table["block"])[order] == b
            unit, label, first = unit[np.argsort(late, kind="stable")], label[np.argsort(late, kind="stable")], int((~late).sum())
        names, code = np.unique(label, return_inverse=True)
        root = linked_labels(unit, code, least, first)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(names[moved]), pa.array(names[root[moved]])], schema=schema)

    return run


def _packed(df: DataFrame) -> DataFrame:
    """``df`` with ``vec`` as packed float32 components."""
    names = df.columns

    def run(batches):
        for batch in batches:
            raw = np.ascontiguousarray(matrix(batch.column("vec")), dtype=np.float32) if batch.num_rows else ()
            cols = [pa.array([r.tobytes() for r in raw], pa.binary()) if c == "vec" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'vec' else t}" for c, t in df.dtypes))


def _large(rows: DataFrame, by: str) -> dict[int, int]:
    """Blocks of each type or component of more than ``BLOCK`` rows, of which there are few."""
    return {r[by]: -(-r["count"] // BLOCK) for r in rows.groupBy(by).count().where(F.col("count") > BLOCK).collect()}


def _exact_components(rows: DataFrame, labels: DataFrame, by: str, large: dict[int, int], least: float) -> DataFrame:
    """``(node, comp)`` of all labels that are linked to others within a value of ``by``.

    ``rows`` are ``(by, typeno, featno, vec)`` and ``labels`` ``(by, featno, label)`` of those that have one; the others
    are labelled with their ids. Each pair of blocks is multiplied in one task and gives one row a label at most.
    """
    sizes = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col(by)], F.lit(1)) if large else F.lit(1)

    def paired(df):
        there = df.withColumn("block", F.pmod(F.xxhash64("featno"), sizes).cast("int"))
        there = there.withColumn("with", F.explode(F.sequence(F.lit(0), sizes.cast("int") - 1)))
        return there.withColumns({"a": F.least("block", "with"), "b": F.greatest("block", "with")}).drop("with").groupBy(by, "a", "b")

    return connected_components(paired(_packed(rows)).cogroup(paired(labels)).applyInArrow(_block_links(least), "a bigint, b bigint"))


def _large_clusters(cut: Cut, rows: DataFrame, labels: DataFrame, large: dict[int, int], least: float, dim: int) -> DataFrame:
    """``(typeno, featno, medoid, sim)`` of types of many blocks: as :func:`split_groups`, a step at a time over all tasks.

    Components that one task holds are split there. Of larger ones the summed vector chooses the medoid, members are
    held against it, and those left over make components anew.
    """
    joined = _exact_components(rows, labels, "typeno", large, least)
    node = rows.join(labels, ["typeno", "featno"], "left").withColumn("node", F.coalesce("label", _id("typeno", "featno")))
    own = node.join(joined, "node", "left").where("label is not null or comp is not null")
    rest = cut.keep(own.select("typeno", "featno", "vec", F.coalesce("comp", "node").alias("comp")))
    found = []
    while True:
        large = _large(rest, "comp")
        small = rest.where(~F.col("comp").isin(*large)) if large else rest
        buckets = max(1, -(-2 * small.count() // BLOCK))
        parts = _packed(small).groupBy(F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("bucket"))
        found.append(cut.keep(parts.applyInArrow(_component_clusters(least), FOUND)))
        if not large:
            break
        wide = cut.keep(rest.where(F.col("comp").isin(*large)).withColumn("unit", _unit("vec", dim)))
        sums = wide.groupBy("comp").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("unit", F.lit(i))) for i in range(dim)]).alias("total"))
        central = F.round(_dot("unit", "total") / F.col("n"), 6)
        scored = wide.join(sums, "comp").select("comp", F.struct(central.alias("mean"), (-F.col("featno")).alias("f"), "unit").alias("h"))
        heads = scored.groupBy("comp").agg(F.max("h").alias("h")).select("comp", (-F.col("h.f")).alias("medoid"), F.col("h.unit").alias("head"))
        held = cut.keep(wide.join(heads, "comp").select("typeno", "featno", "vec", "comp", "medoid", _dot("unit", "head").alias("sim")))
        close = (F.round("sim", 6) >= least) | (F.col("featno") == F.col("medoid"))
        found.append(held.where(close).select("typeno", "featno", "medoid", "sim"))
        left = cut.keep(held.where(~close).select("typeno", "featno", "vec", "comp"))
        cut.drop(wide, rest)
        none = left.select("comp", "featno", F.col("comp").alias("label")).limit(0)
        joined = _exact_components(left, none, "comp", _large(left, "comp"), least).withColumnRenamed("comp", "part")
        part = left.withColumn("node", _id("typeno", "featno")).join(joined, "node", "left")
        rest = cut.keep(part.select("typeno", "featno", "vec", F.coalesce("part", "node").alias("comp")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _id(typeno: str, featno: str):
    return F.shiftleft(F.col(typeno).cast("bigint"), 32).bitwiseOR(F.col(featno).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def _divided(v, by, dim: int):
    """``v`` divided by a number, which a lambda would compute anew for each component."""
    return F.zip_with(v, F.array_repeat(by, dim), lambda x, y: x / y)


def _unit(vec: str, dim: int):
    v = F.transform(vec, lambda x: x.cast("double"))
    v = _divided(v, F.array_max(F.transform(v, F.abs)), dim)  # very long and very short vectors
    return _divided(v, F.sqrt(_dot(v, v)), dim)


def clusters(vectors: DataFrame, model: DataFrame, *, least: float = 0.8, probes: int = PROBES, margin: float = MARGIN, dim: int | None = None) -> DataFrame:
    """Clusters of the current vectors of each type: ``(typeno, featno, cluster_featno, medoid, sim)``.

    One row for each current vector with a similar one; one whose similar ones are all in other clusters, as at the
    end of a chain, is a cluster of its own. ``cluster_featno`` is the smallest ``featno`` of the
    cluster, ``medoid`` its member with the largest sum of cosines to the others (of equals to 6 digits of the mean
    the smallest ``featno``; of copies one counts), ``sim`` the cosine to it, which is ``least`` or more.
    Vectors have ``dim`` components, by default as many as most rows of the model.

    Method. The set of a vector are the directions of ``model`` (the rows that make the sign bits of ``lsh``, either
    way round) nearest to it. MinHash bands over the sets give candidate pairs; exact Jaccard similarity and then
    the exact cosine verify them. The groups that they form are then completed: an exact pass over all pairs of a type
    gives every link between different groups, or vectors without one, that reaches ``least`` (to 6 digits).
    Components of all links are split round medoids of the highest degree, links weighted by their similarity
    (:func:`split_groups`). So ``probes``, ``margin`` and the bands decide how much the exact pass has to list,
    never what is found.

    Plan. Vectors are sent once to the few cells round whose centroids they lie, and candidates are found within
    cells; a cell sends back one row for each linked vector and no pairs. The exact pass takes a type of up to
    ``BLOCK`` vectors in one task, which gives its clusters too. Of larger types it takes each pair of blocks in a
    task, which gives a forest of links between groups; components of more than ``BLOCK`` vectors are summed by
    partial aggregation (:func:`_large_clusters`). Its products grow with the square of a type. Exact copies are set
    aside first and follow the one that stands for them.

    Edge cases. See :func:`cells.current_vectors` for keys, repeats and unusable vectors. Copies without any other
    similar vector form a cluster of their own. Rows of the model that are null or of another size are ignored; a
    model without any usable row is an error. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    cut = Cut(spark, "cluster")
    rows = [r["coeffs"] for r in model.where(F.size("coeffs") > 0).orderBy("row_no").select("coeffs").collect()]
    sizes = [len(r) for r in rows]
    dim = max(set(sizes), key=sizes.count, default=0) if dim is None else dim
    usable = np.array([r for r in rows if len(r) == dim and None not in r], dtype=np.float64).reshape(-1, dim)
    usable = usable[np.isfinite(usable).all(axis=1) & usable.any(axis=1)]
    if not len(usable):
        raise ValueError(f"the model has no directions of {dim} components")
    usable = np.vstack([usable, np.random.default_rng(7).standard_normal((max(0, LEAST_ROWS - len(usable)), dim))])
    current, same, single = distinct_vectors(cut, vectors, dim)
    cells = fit_cells(single)
    cells.parts[:] = 1
    placed = in_tasks(routed(single, cells, probes=probes, margin=margin), cells).applyInArrow(_cell_labels(units(usable), least), LABELS)
    labels = cut.keep(placed.groupBy("typeno", "featno").agg(F.min("label").alias("label")))
    rows = single.select("typeno", "featno", "vec")
    large = _large(rows, "typeno")
    many = F.col("typeno").isin(*large)
    few_rows, few_labels = (df.where(~many) if large else df for df in (_packed(rows), labels))
    found = few_rows.groupBy("typeno").cogroup(few_labels.groupBy("typeno")).applyInArrow(_type_clusters(least), FOUND)
    if large:
        found = found.unionByName(_large_clusters(cut, rows.where(many), labels.where(many), large, least, dim))
    found = cut.keep(found)

    rep_of = found.select("typeno", F.col("featno").alias("rep"), "medoid", "sim")
    copied = same.where(F.col("featno") != F.col("rep")).join(rep_of, ["typeno", "rep"], "left")
    lone = same.join(rep_of.select("typeno", "rep"), ["typeno", "rep"], "left_anti").select("typeno", "featno", F.col("rep").alias("medoid"), F.lit(1.0).alias("sim"))
    copied = copied.where(F.col("medoid").isNotNull()).select("typeno", "featno", "medoid", "sim")
    everyone = cut.keep(found.unionByName(copied).unionByName(lone))
    first = everyone.groupBy("typeno", "medoid").agg(F.min("featno").alias("cluster_featno"))
    return everyone.join(first, ["typeno", "medoid"]).select("typeno", "featno", "cluster_featno", "medoid", "sim")


def described(found: DataFrame, typical: int = 3) -> DataFrame:
    """Each cluster with its size and most typical members: ``(typeno, cluster_featno, size, rank, featno, sim)``.

    Typical are the members nearest to the medoid, itself first; ties go to the smaller ``featno``.
    """
    order = Window.partitionBy("typeno", "cluster_featno").orderBy(F.desc(F.round("sim", 6)), "featno")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical)
    sizes = found.groupBy("typeno", "cluster_featno").agg(F.count("*").alias("size"))
    return best.join(sizes, ["typeno", "cluster_featno"]).select("typeno", "cluster_featno", "size", "rank", "featno", F.round("sim", 6).alias("sim"))
