"""Maximum inner product search with score-aware (anisotropic) product quantisation.

Vectors are cut into subspaces of a few dimensions, each coded in four bits. Codebooks and codes minimise the
residual with its part along the vector weighted `ETA` times, since that part moves the products that matter.
A block of queries scans a block of codes by lookup tables, two subspaces to a byte. The best `keep` of each block are
scored exactly in double precision on the original vectors, which sets a bar: the k-th of their scores. Then every row
is scored exactly whose code score plus its error bound, the norm of its residual times that of the query, reaches the
bar. So each block's best k are exact, ties included, and the best `k` of all blocks are the answer.

Codebooks are fitted on a bounded sample; they decide how many rows are scored exactly, never which are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import bounded, materialize, tidy
from foliospark.llm.vectors import matrix, usable

#: Rows of the smallest hashes on which codebooks are fitted; dimensions of a subspace; weight of the parallel part.
SAMPLE, DIMS, ETA = 5_000, 2, 4.0
QUERIES, ROWS, KEEP = 2048, 8192, 128


class Quantiser:
    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta  # books: subspaces, 16, dimensions

    @classmethod
    def fit(cls, x: np.ndarray, eta: float = ETA, dims: int = DIMS, rounds: int = 4) -> Quantiser:
        x = _padded(x, dims)
        parts = x.reshape(len(x), -1, dims).transpose(1, 0, 2)
        rng = np.random.default_rng(11)
        books = []
        for p in parts:  # plain k-means to begin with
            c = p[rng.choice(len(p), 16, replace=len(p) < 16)] + 1e-9 * rng.standard_normal((16, dims))
            for _ in range(8):
                code = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
                for j in range(16):
                    if (code == j).any():
                        c[j] = p[code == j].mean(0)
            books.append(c)
        q = cls(np.array(books), eta)
        u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        for _ in range(rounds):  # least squares of the weighted residual, one subspace at a time
            codes = q.codes(x)
            along = sum(((x[:, m * dims : m * dims + dims] - q.books[m][codes[:, m]]) * u[:, m * dims : m * dims + dims]).sum(1) for m in range(len(books)))
            for m in range(len(books)):
                pm, um = x[:, m * dims : m * dims + dims], u[:, m * dims : m * dims + dims]
                own = ((pm - q.books[m][codes[:, m]]) * um).sum(1)
                rest = along - own
                for j in range(16):
                    i = codes[:, m] == j
                    if i.any():
                        a = i.sum() * np.eye(dims) + (eta - 1) * um[i].T @ um[i]
                        b = pm[i].sum(0) + (eta - 1) * (um[i] * (rest[i] + (pm[i] * um[i]).sum(1))[:, None]).sum(0)
                        q.books[m][j] = np.linalg.solve(a, b)
                along = rest + ((pm - q.books[m][codes[:, m]]) * um).sum(1)
        return q

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Each subspace's code of each row, by coordinate descent on the weighted residual."""
        d = self.books.shape[2]
        x = _padded(x, d)
        u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        out = np.zeros((len(x), len(self.books)), np.uint8)
        flat, turn = [], []
        for m, c in enumerate(self.books):
            r = x[:, None, m * d : m * d + d] - c[None]
            flat.append((r * r).sum(2))
            turn.append((r * u[:, None, m * d : m * d + d]).sum(2))
            out[:, m] = flat[m].argmin(1)
        at = np.arange(len(x))
        along = sum(t[at, out[:, m]] for m, t in enumerate(turn))
        for _ in range(sweeps):
            for m in range(len(self.books)):
                rest = along - turn[m][at, out[:, m]]
                out[:, m] = (flat[m] + (self.eta - 1) * (rest[:, None] + turn[m]) ** 2).argmin(1)
                along = rest + turn[m][at, out[:, m]]
        return out

    def residuals(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row's code score can be from its product with a query of norm 1, rounding included."""
        m, _, d = self.books.shape
        x = _padded(x, d)
        gap = np.sqrt(((x - self.books[np.arange(m), codes].reshape(len(x), -1)) ** 2).sum(1))
        return gap * (1 + 1e-9) + 4e-16 * (m * d + 8) * (np.sqrt((x * x).sum(1)) + gap)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of packed codes the 256 partial products with a query."""
        m, _, d = self.books.shape
        t = np.einsum("mjd,md->mj", self.books, _padded(query[None], d)[0].reshape(m, d))
        if m % 2:
            t = np.concatenate([t, np.zeros((1, 16))])
        return (t[1::2, :, None] + t[::2, None, :]).reshape(len(t) // 2, 256)


def _padded(x: np.ndarray, d: int) -> np.ndarray:
    gap = -x.shape[1] % d
    return np.concatenate([x, np.zeros((len(x), gap))], 1) if gap else x


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the order of dimensions, so that equal rows score alike."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def _one_each(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One row of each id, ids ascending: of several the lexicographically smallest vector."""
    own, first, n = np.unique(ids, return_index=True, return_counts=True)
    for i in np.flatnonzero(n > 1).tolist():
        rows = np.flatnonzero(ids == own[i])
        first[i] = rows[np.lexsort(x[rows].T[::-1])[0]]
    return first


def search(vectors: DataFrame, wanted: Column, k: int = 20, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `wanted` holds, the k rows of largest inner product.

    A row isn't its own candidate. Vectors that are null, empty, zero, or hold a null or non-finite component take no
    part, as do rows without vec_id; vectors meet those of their own width. Ties go to the smaller vec_id; with fewer
    than k others all are returned. Rows with one vec_id count as one, that of the lexicographically smallest vector
    of a width. No rows give no rows; other columns are ignored.
    """
    bounded(vectors.sparkSession)
    fit = vectors.where(usable() & F.col("vec_id").isNotNull())
    out = None
    for r in fit.groupBy(F.size("embedding").alias("width")).count().orderBy("width").collect():  # one row a width
        found = _search(fit.where(F.size("embedding") == r["width"]), wanted, k, **options)
        out = found if out is None else out.union(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(fit: DataFrame, wanted: Column, k: int, queries: int = QUERIES, rows: int = ROWS, keep: int = KEEP, sample: int = SAMPLE) -> DataFrame:
    """`search` among vectors of one width."""
    fit = fit.select("vec_id", "embedding")
    chosen = fit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # of bounded size
    quantiser = Quantiser.fit(matrix(chosen.column("embedding")))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("embedding"))
                codes = quantiser.codes(x)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array([c.tobytes() for c in quantiser.pack(codes)], pa.binary()), pa.array(quantiser.residuals(x, codes))], ["vec_id", "embedding", "codes", "gap"])

    kind = fit.schema["embedding"].dataType.simpleString()
    coded = materialize(fit.mapInArrow(code, f"vec_id long, embedding {kind}, codes binary, gap double"), "codes")
    asked = coded.where(wanted).select(F.col("vec_id").alias("query_id"), "embedding")
    qb, rb = max(1, -(-asked.count() // queries)), max(1, -(-coded.count() // rows))
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("r"), "query_id", "embedding")
    right = coded.select(F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(rb)).cast("int").alias("r"), "vec_id", "embedding", "codes", "gap")

    def scan(key, qs, rs):
        tidy()
        found: list[list] = [[], [], []]
        if qs.num_rows and rs.num_rows:
            x = matrix(rs.column("embedding"))
            order = _one_each(rs.column("vec_id").to_numpy(), x)
            ids, x = rs.column("vec_id").to_numpy()[order], np.asfortranarray(x[order])
            gap = rs.column("gap").to_numpy()[order]
            codes = np.frombuffer(b"".join(rs.column("codes").to_pylist()), np.uint8).reshape(rs.num_rows, -1)[order]
            codes = np.ascontiguousarray(codes.T)
            asking = matrix(qs.column("embedding"))
            first = _one_each(qs.column("query_id").to_numpy(), asking)
            for q, v in zip(qs.column("query_id").to_numpy()[first].tolist(), asking[first], strict=True):
                own = ids != q
                best = np.flatnonzero(own)
                if len(best) > max(keep, k):
                    near = np.zeros(len(x))
                    for t, c in zip(quantiser.tables(v), codes, strict=True):
                        near += t[c]
                    near[~own] = -np.inf
                    seed = np.argpartition(-near, max(keep, k) - 1)[: max(keep, k)]
                    bar = np.partition(products(x[seed], v), -k)[-k]
                    best = np.flatnonzero(own & ~(near + gap * np.sqrt(v @ v) * (1 + 1e-9) < bar))
                exact = products(x[best], v) if 2 * len(best) < len(x) else products(x, v)[best]
                top = np.lexsort((ids[best], -exact))[:k]
                found[0].append(np.full(len(top), q))
                found[1].append(ids[best][top])
                found[2].append(exact[top])
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(scan, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
