"""Embedding near-dedup: p-stable hashing of normalised vectors, then exact cosines.

Unit vectors of cosine >= c are within Euclidean distance sqrt(2 - 2c). Each table hashes a
vector by `width`-quantised Gaussian projections, as the p-stable scheme for that distance
does, so near ones share a bucket in at least one of the tables. All pairs of a bucket are
compared exactly, in blocks of bounded memory, and counted in the first table in which the
pair shares a bucket, so that degrees are right without writing pairs down. Only the edges
of a bucket's components leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lean, stable, table, written

COSINE, TABLES, PROJECTIONS, WIDTH = 0.98, 12, 14, 2.0
BLOCK = 2048  # rows of a bucket that one task compares with as many others
SEED = 77


def projections(dim: int, tables: int = TABLES, count: int = PROJECTIONS, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dim)
    return rng.normal(size=(dim, tables * count)), rng.uniform(0, width, tables * count)


def buckets(unit: np.ndarray, tables: int = TABLES, count: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """For each unit vector its bucket in each table, 64 bits."""
    a, b = projections(unit.shape[1], tables, count, width)
    cell = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, count)
    key = np.zeros((len(unit), tables), np.uint64)
    for k in range(count):
        key = (key ^ cell[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def usable(vectors: list[list | None]) -> list[np.ndarray | None]:
    """Each vector in double precision; None where it can link with nothing."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None
        if v is not None and len(v) and not any(c is None for c in v):
            x = np.array(v, np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out


def near_groups(table_: DataFrame, cosine: float = COSINE, tables: int = TABLES, count: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per row of vec_id, embedding, label: vec_id, n_links, component_id, kept.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and neither do vectors of different lengths. Equal vectors of one
    label are compared once and counted as often as they occur. Rows that share a vec_id are
    vectors of their own; a null vec_id never names a component that has another.
    """
    rows = table_.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            ids, labels, vectors = (c.to_pylist() for c in batch.columns)
            xs = usable(vectors)
            raw = [x.tobytes() if x is not None and y is not None else None for x, y in zip(xs, labels, strict=True)]
            names = [xxhash.xxh3_64_intdigest(r, seed=y & 0xFFFFFFFF) - (1 << 63) if r is not None else None for r, y in zip(raw, labels, strict=True)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(names, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "name", "v"])

    own = stable(rows.mapInArrow(named, "vec_id long, label long, name long, v binary"))
    # One of all equal vectors stands for them.
    kinds = own.where("name is not null").groupBy("name").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            name, copies, label, raw = (c.to_pylist() for c in batch.columns)
            keys = np.zeros((len(raw), tables), np.uint64)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.stack([np.frombuffer(raw[i]) for i in at])
                x /= np.abs(x).max(1, keepdims=True)
                keys[at] = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), tables, count, width) ^ np.uint64(size)
            keys ^= np.array(label, np.int64).view(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
            yield pa.record_batch([pa.array(name, pa.int64()), pa.array(copies, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(raw, pa.binary())], names=["name", "copies", "keys", "v"])

    vectors, drop_vectors = written(kinds.select("name", "copies", "label", "v").mapInArrow(lean(hashed), "name long, copies long, keys binary, v binary"))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, tables)
            t = np.tile(np.arange(tables, dtype=np.uint64), len(keys))
            bucket = ((keys.ravel() ^ t * np.uint64(0x9FB21C651E98DF25)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
            yield pa.record_batch([pa.array(bucket), pa.array(t.astype(np.int32)), pa.array(np.repeat(batch.column(0).to_numpy(), tables))], names=["bucket", "t", "name"])

    # Names first: buckets with one entry give nothing, and of buckets that hold the same vectors in several tables the
    # first has compared them all. Only then is each vector sent to the buckets that are left; large ones are compared block by block.
    entries, drop_entries = written(vectors.select("name", "keys").mapInArrow(lean(entered), "bucket long, t int, name long"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("t").alias("t"), F.bit_xor(F.xxhash64("name")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "name")).alias("y")).where("size > 1")
    sizes = sizes.groupBy("size", "x", "y").agg(F.min(F.struct("t", "bucket")).alias("first")).select(F.col("first.bucket").alias("bucket"), "size")
    blocks = F.ceil(F.col("size") / block).cast("int")
    entries = entries.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("name"), blocks).cast("int"))
    entries = entries.select("bucket", "t", "name", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).join(vectors, "name")
    entries = entries.select("bucket", "t", "name", "copies", "keys", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        key = None
        names: list[int] = []
        links: list[int] = []
        edges: list[tuple[int, int]] = []

        def end():
            if len(group) > 1:
                found, joined = _bucket_links(group, cosine)
                names.extend(n for n, k in found if k)
                links.extend(k for _, k in found if k)
                edges.extend(joined)

        def told():
            n, m = len(names), len(edges)
            out = pa.record_batch([pa.array(names + [a for a, _ in edges], pa.int64()), pa.array(links + [None] * m, pa.int64()), pa.array([None] * n + [b for _, b in edges], pa.int64())], names=["name", "links", "to"])
            names.clear()
            links.clear()
            edges.clear()
            return out

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r[0], r[7], r[8]) != key:
                    end()
                    group, key = [], (r[0], r[7], r[8])
                group.append(r)
            if len(names) + len(edges) > 1 << 14:
                yield told()
        end()
        yield told()

    found = entries.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(compared, "name long, links long, to long")
    found = stable(found)
    drop_vectors()
    drop_entries()
    degree = found.where("links is not null").groupBy("name").agg(F.sum("links").alias("links"))
    roots = components(found.where("to is not null").select(F.col("name").alias("a"), F.col("to").alias("b")).distinct())
    told = kinds.select("name", "copies", "least").join(degree, "name", "left").join(roots, F.col("name") == F.col("node"), "left")
    told = told.select("name", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "name").alias("root"))
    smallest = told.groupBy("root").agg(F.min("least").alias("component"))
    told = told.join(smallest, "root").select("name", "links", "component")
    out = own.select("vec_id", "name").join(told, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _bucket_links(group: list[tuple], cosine: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """([(name, how many vectors link to it here first)], edges of the components) between two blocks of a bucket."""
    t, lo, hi = group[0][1], group[0][7], group[0][8]
    names = np.array([r[2] for r in group], np.int64)
    copies = np.array([r[3] for r in group], np.int64)
    keys = np.array([np.frombuffer(r[4], np.uint64) for r in group])
    x = np.array([np.frombuffer(r[5]) for r in group])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.array([r[6] for r in group])
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    links = np.zeros(len(group), np.int64)
    top = list(range(len(group)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a in range(0, len(left), 256):
        some = left[a : a + 256]
        ok = x[some] @ x[right].T >= cosine
        if lo == hi:
            ok &= some[:, None] != right[None]
        p, q = np.nonzero(ok)
        p, q = some[p], right[q]
        first = np.ones(len(p), bool)
        for e in range(t):
            first &= keys[p, e] != keys[q, e]
        np.add.at(links, p[first], copies[q[first]])
        if lo != hi:
            np.add.at(links, q[first], copies[p[first]])
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            if top[i] != top[j]:
                u, v = find(i), find(j)
                top[max(u, v)] = min(u, v)
    return list(zip(names.tolist(), links.tolist(), strict=True)), [(int(names[i]), int(names[find(i)])) for i in range(len(group)) if find(i) != i]


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND len(list_filter(embedding, lambda t: t <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.vec_id),
m AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.links, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.vec_id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
