"""Centroid clustering with scalar lookup tables.

The vectors are stored once in blocks, every component as a code: its place in
the list of the integer values that occur in its dimension of the block.  Per
round and block a table holds, for each dimension, occurring value and
centroid, the squared difference; a vector's distances to all centroids are
the sum of one table row per dimension (NumPy gathers), without a product.
New centroids come from counts of (cluster, code) pairs in the same way.

Tables are as large as a block's values, not as the data: a block has at most
one Arrow batch of rows.  A round sends ``centroids x (dimensions + 1)`` sums
through the executors; the driver holds the centroids.  Equal vectors, however
many, are counted where they lie.

Edge cases: vectors that are null, hold null or non-finite components or have
another number of components take no part; a null id hashes as an empty one;
rows that share an id are told apart by their components when the first
centroids are drawn, and equal rows may both be drawn (the smaller number then
takes the vectors); with fewer vectors than centroids there are as many
centroids as vectors; an empty table gives an empty result; other columns are
left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.int_vectors import int_vectors, matrix
from quarry.llm.stored import stored
from quarry.llm.vectors import sum_vectors

_BLOCK = "ids array<long>, codes binary, sizes binary, occurring binary"
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Block:
    """Codes of a block's vectors and, per dimension, the values they stand for."""

    def __init__(self, codes: np.ndarray, occurring: list[np.ndarray]):
        self.codes, self.occurring = codes, occurring        # codes: dimension x row

    @classmethod
    def of(cls, x: np.ndarray) -> Block:
        pairs = [np.unique(x[:, d], return_inverse=True) for d in range(x.shape[1])]
        return cls(np.stack([c.reshape(-1) for _, c in pairs]), [v for v, _ in pairs])

    def pack(self) -> tuple[bytes, bytes, bytes]:
        sizes = np.array([len(v) for v in self.occurring], dtype=np.int32)
        kind = np.uint16 if sizes.max(initial=0) <= 1 << 16 else np.uint32
        return self.codes.astype(kind).tobytes(), sizes.tobytes(), np.concatenate(self.occurring).astype("i8").tobytes()

    @classmethod
    def unpack(cls, codes: bytes, sizes: bytes, occurring: bytes) -> Block:
        size = np.frombuffer(sizes, dtype=np.int32)
        kind = np.uint16 if size.max() <= 1 << 16 else np.uint32
        return cls(np.frombuffer(codes, dtype=kind).reshape(len(size), -1),
                   np.split(np.frombuffer(occurring, dtype=np.int64), np.cumsum(size)[:-1]))

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (ties: the smaller number) and the squared
        distance of every vector."""
        far = max(float(np.abs(v).max()) for v in self.occurring) + float(np.abs(centroids).max())
        if far * far * len(self.occurring) >= float(1 << 62):
            raise OverflowError("a squared distance may leave the range of a long")
        kind = np.int32 if far * far * len(self.occurring) < float(1 << 31) else np.int64
        out = np.zeros((self.codes.shape[1], len(centroids)), dtype=kind)
        for d, values in enumerate(self.occurring):
            table = (values[:, None] - centroids[None, :, d]) ** 2
            out += table.astype(kind)[self.codes[d]]
        at = np.argmin(out, axis=1)
        return at, out[np.arange(len(out)), at].astype(np.int64)

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Per cluster the vector sum and the number of vectors, ``k x (dimensions + 1)``."""
        out = np.zeros((k, len(self.occurring) + 1), dtype=np.int64)
        for d, values in enumerate(self.occurring):
            m = len(values)
            out[:, d] = np.bincount(cluster * m + self.codes[d], minlength=k * m).reshape(k, m) @ values
        out[:, -1] = np.bincount(cluster, minlength=k)
        return out


def _unpacked(batch):
    for ids, *raw in zip(*(batch.column(c).to_pylist() for c in ("ids", "codes", "sizes", "occurring"))):
        yield ids, Block.unpack(*raw)


def _blocks(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            packed = Block.of(matrix(b.column("x"))).pack()
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())),
                 *[pa.array([p], pa.binary()) for p in packed]], names=["ids", "codes", "sizes", "occurring"])
    return rows.mapInArrow(run, _BLOCK)


def _summed(blocks: DataFrame, size: int, of) -> np.ndarray:
    def per_task(batches):
        out = np.zeros(size, dtype=np.int64)
        for b in batches:
            for _, block in _unpacked(b):
                out += of(block).ravel()
        return out
    return sum_vectors(blocks, per_task, size, np.int64)


def cluster_centroids(vectors: DataFrame, id_col: str, vec_col: str, dims: int = 64, k: int = 40,
                      rounds: int = 5, seed: str = "2") -> DataFrame:
    """Every vector of ``dims`` sound components: ``vec_id``, ``cluster`` (int),
    ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``, after ``rounds`` rounds from the ``k`` vectors with the
    smallest SHA-256 of ``seed:id``."""
    spark = vectors.sparkSession
    rows = int_vectors(vectors, id_col, vec_col).filter(F.size("x") == dims)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(drawn.alias("drawn"), "x").orderBy("drawn", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], _OUT)
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    k = len(centroids)
    blocks = stored(_blocks(rows), "clustering-blocks")

    for _ in range(rounds):
        def of(block, centroids=centroids):
            return block.sums(block.nearest(centroids)[0], k)
        sums = _summed(blocks, k * (dims + 1), of).reshape(k, dims + 1)
        full = sums[:, -1] > 0
        centroids = centroids.copy()
        centroids[full] = sums[full, :-1] // sums[full, -1:]

    def inertias(block):
        cluster, distance = block.nearest(centroids)
        out = np.zeros(k, dtype=np.int64)
        np.add.at(out, cluster, distance)
        return out
    inertia = _summed(blocks, k, inertias)
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()],
                       dtype=object)
    total = int(inertia.sum())

    def run(batches):
        for b in batches:
            for ids, block in _unpacked(b):
                cluster, distance = block.nearest(centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance),
                     pa.array(inertia[cluster]), pa.array(np.full(len(ids), total)), pa.array(digests[cluster])],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, _OUT)
