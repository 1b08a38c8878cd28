"""Near-duplicate vectors by an epsilon grid order join (Böhm et al., 2001).

Vectors are projected on their leading principal directions, cut into cells of the
width of the search radius, and sorted by cell. Intervals of that sequence are joined
from the top: a pair of intervals whose boxes lie further apart than the radius is
skipped with all that is in it. The topmost intervals are blocks, one in a partition of
a checkpointed table. A task reads two of them from there, so that no vector is shuffled
for the pairs it is in, and joins them piece by piece in the same way, and exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.llm.common import keep, table
from reviewloom.llm.components import components

COSINE = 0.95
DIRECTIONS = 6
BLOCK = 2048
TILE = 256
BLOCKS = 16  # of larger tables, more where there are many cores
BLOCK_BYTES = 8 * 1024 * 1024
UNSURE = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, and one that is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~bad & nonzero, F.lit(False))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of doubles, padded with zeros to ``width``."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame, width: int, wanted: int) -> np.ndarray:
    """Leading principal directions of all unit vectors; sums are added up by Spark, ``width`` squared of them."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), width))
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        upper = np.triu_indices(width + 1)
        yield pa.RecordBatch.from_pydict({"i": upper[0], "j": upper[1], "v": total[upper]})

    sums = vectors.select("vector").mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    full = np.zeros((width + 1, width + 1))
    for i, j, v in sums.collect():
        full[i, j] = full[j, i] = v
    count = max(full[width, width], 1.0)
    mean = full[:width, width] / count
    spread = full[:width, :width] / count - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1][:, :wanted]


def block_size(count: int, row_bytes: int, least: int, cores: int) -> int:
    """Vectors in a block: a growing table has larger blocks of at most ``BLOCK_BYTES``, and then more of them."""
    wanted = max(BLOCKS, math.isqrt(8 * cores))  # a few pairs of blocks for each core
    return max(1, min(max(least, -(-count // wanted)), BLOCK_BYTES // row_bytes))


def _blocks(classes: DataFrame, width: int, directions: np.ndarray, radius: float, least: int) -> DataFrame:
    """Blocks of the grid order, one in a partition: ``block, ids, sizes, dims, data`` and box ``l0.., h0..``."""
    k = directions.shape[1]
    names = [f"c{i}" for i in range(k)]
    kind = _number(classes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), width)
            at = np.floor((_unit(x) @ directions) / radius).astype(np.int32)
            raw = pa.array([row.tobytes() for row in x.astype(kind)], pa.binary())
            dims = batch.column(2).value_lengths().cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), dims, raw, *(pa.array(at[:, i]) for i in range(k))],
                ["id", "n", "dims", "data", *names],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([(name, "ascending") for name in [*names, "id"]])
        data = b"".join(rows["data"].to_pylist())
        at = _unit(np.frombuffer(data, dtype=kind).reshape(-1, width).astype(np.float64)) @ directions
        one = {"block": [rows["block"][0].as_py()], "data": [data]}
        one |= {c: [rows[f].to_numpy().astype(np.int64).tobytes()] for c, f in (("ids", "id"), ("sizes", "n"), ("dims", "dims"))}
        for i in range(k):
            one |= {f"l{i}": [at[:, i].min()], f"h{i}": [at[:, i].max()]}
        yield pa.RecordBatch.from_pydict(one)

    cells = ", ".join(f"{name} int" for name in names)
    placed = classes.select("id", "n", "vector").mapInArrow(project, f"id long, n long, dims int, data binary, {cells}")
    count = classes.count()
    size = block_size(count, width * np.dtype(kind).itemsize, least, classes.sparkSession.sparkContext.defaultParallelism)
    parts = max(1, -(-count // size))
    # neighbouring ranges make a block, should Spark have cut more of them
    placed = placed.repartitionByRange(parts, *names, "id").coalesce(parts)
    box = ", ".join(f"l{i} double, h{i} double" for i in range(k))
    return keep(
        placed.withColumn("block", F.spark_partition_id().cast("long")).mapInArrow(
            gather, f"block long, data binary, ids binary, sizes binary, dims binary, {box}"
        )
    )


def block_pairs(blocks: DataFrame, k: int, radius: float) -> DataFrame:
    """Pairs of blocks, the first not behind the second, whose boxes are within the radius: ``i_`` and ``j_`` and a name of ``blocks``.

    Tasks take the two from the table itself, so the pairs are neither shuffled nor written.
    """
    i, j = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ij")
    apart = sum(
        (
            F.pow(
                F.greatest(F.lit(0.0), F.col(f"i_l{d}") - F.col(f"j_h{d}"), F.col(f"j_l{d}") - F.col(f"i_h{d}")), F.lit(2)
            )
            for d in range(k)
        ),
        F.lit(0.0),
    )
    close = (F.col("i_block") <= F.col("j_block")) & (apart <= radius * radius + 1e-9)
    return i.join(j.hint("shuffle_replicate_nl"), close)


class _Links:
    """Links found in a pair of blocks: how many vectors each one links with, and which belong together."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.counts = np.zeros(len(sizes), dtype=np.int64)
        self.root = np.arange(len(sizes))

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        np.add.at(self.counts, u, self.sizes[v])
        np.add.at(self.counts, v, self.sizes[u])
        ru, rv = self.root[u], self.root[v]
        open_pairs = np.unique(np.stack([ru[ru != rv], rv[ru != rv]], axis=1), axis=0)
        if not len(open_pairs):
            return
        up = {int(r): int(r) for r in np.unique(open_pairs)}

        def find(r: int) -> int:
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        for a, b in open_pairs.tolist():
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        to = np.arange(len(self.root))
        to[list(up)] = [find(r) for r in up]
        self.root = to[self.root]


def join_blocks(
    one: dict, other: dict | None, width: int, kind: str, directions: np.ndarray, cosine: float
) -> pa.RecordBatch:
    """Links between two blocks, or within one: rows ``id, n`` (vectors linked with) and ``id, other`` (a tree of links)."""
    sides = [one] if other is None else [one, other]
    ids, sizes, dims = (np.concatenate([np.frombuffer(s[c], dtype=np.int64) for s in sides]) for c in ("ids", "sizes", "dims"))
    raw = np.concatenate([np.frombuffer(s["data"], dtype=kind).reshape(-1, width) for s in sides]).astype(np.float64)
    unit = _unit(raw)
    at = unit @ directions
    rough = unit.astype(np.float32)
    least = cosine - UNSURE - (width + 2) * 2.0**-22  # no cosine is further off in single precision
    reach = 2 - 2 * cosine + 1e-9  # squared distance of unit vectors
    links = _Links(sizes)

    def join(a: int, b: int, c: int, d: int) -> None:
        """Intervals [a, b) and [c, d) of the order; the same interval is joined with itself once."""
        gap = np.maximum(0, np.maximum(at[a:b].min(0) - at[c:d].max(0), at[c:d].min(0) - at[a:b].max(0)))
        if (gap * gap).sum() > reach:
            return
        if b - a > TILE or d - c > TILE:
            first = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > TILE else [(a, b)]
            second = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > TILE else [(c, d)]
            for x in first:
                for y in second:
                    if (a, b) != (c, d) or x <= y:
                        join(*x, *y)
            return
        if (rough[a:b] @ rough[c:d].T).max() < least:
            return
        found = unit[a:b] @ unit[c:d].T
        u, v = np.nonzero(found >= cosine - UNSURE)
        unsure = np.abs(found[u, v] - cosine) <= UNSURE
        u, v = u + a, v + c
        ok = dims[u] == dims[v]
        for i in np.nonzero(unsure)[0]:
            p, q = raw[u[i]], raw[v[i]]
            ok[i] &= math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q)) >= cosine
        if (a, b) == (c, d):
            ok &= u < v
        links.add(u[ok], v[ok])

    n = len(np.frombuffer(one["ids"], dtype=np.int64))
    if other is None:
        join(0, n, 0, n)
    else:
        join(0, n, n, len(ids))
    linked = np.nonzero(links.counts)[0]
    tree = linked[links.root[linked] != linked]
    none = pa.nulls(len(linked), pa.int64())
    return pa.RecordBatch.from_pydict(
        {
            "id": np.concatenate([ids[linked], ids[tree]]),
            "other": pa.concat_arrays([none, pa.array(ids[links.root[tree]])]),
            "n": np.concatenate([links.counts[linked], np.zeros(len(tree), np.int64)]),
        }
    )


def _number(rows: DataFrame) -> str:
    """How components of ``vector`` are stored: as they are in the table, which needs half the bytes for float."""
    return "float32" if rows.schema["vector"].dataType.elementType == T.FloatType() else "float64"


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    directions: int = DIRECTIONS,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row; vectors link at a cosine of ``cosine`` (above 0) or more.

    NULL vectors and ids, zero vectors, and vectors with NULL or non-finite components
    link with nothing. Vectors of different lengths do not link. Equal vectors are
    joined as one and counted as many; repeated rows count as vectors of their own.
    An empty table gives no rows. Other columns are not read.
    """
    single = getattr(vectors.schema[vector_col].dataType, "elementType", None) == T.FloatType()
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    # rows without a negative zero, as it equals zero; equal vectors then have equal digests
    plain = F.transform(vector, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), plain.alias("vector"))
    good = F.col("vec_id").isNotNull() & usable(F.col("vector"))
    valid = rows.filter(good)
    classes = keep(valid.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    other = rows.filter(~good).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if width is None:
        return other
    radius = math.sqrt(2 - 2 * cosine)
    axes = principal_directions(classes, width, min(directions, width))
    blocks = _blocks(classes, width, axes, radius, block)
    kind = _number(classes)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = (
                    {c: batch.column(f"{side}_{c}")[row].as_py() for c in ("block", "ids", "sizes", "dims", "data")}
                    for side in "ij"
                )
                yield join_blocks(one, two if one["block"] != two["block"] else None, width, kind, axes, cosine)

    wanted = [f"{side}_{c}" for side in "ij" for c in ("block", "ids", "sizes", "dims", "data")]
    pairs = block_pairs(blocks, axes.shape[1], radius).select(*wanted)
    found = keep(pairs.mapInArrow(join, "id long, other long, n long"))
    counts = found.filter("other IS NULL").groupBy("id").agg(F.sum("n").alias("linked"))
    joined = components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    # rows find their class by a digest of the vector, or by all of it should two classes share one
    digest = [F.xxhash64("vector").alias("key"), F.xxhash64(F.lit(1), "vector").alias("key2")]
    keys = ["key", "key2"]
    if not classes.select(*digest).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        digest, keys = [F.col("vector")], ["vector"]
    per_class = (
        classes.select("id", "n", *digest)
        .join(counts, "id", "left")
        .join(joined, "id", "left")
        .select(
            *keys,
            (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    placed = valid.select("vec_id", *digest).join(per_class, keys).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )
    return placed.unionByName(other)


def op9_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.id = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
"""
