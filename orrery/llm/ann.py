"""Nearest neighbours by score-aware quantisation, four-bit scans and exact
reranking.

Vectors are scaled to length one, so that the inner product is the cosine, and
cut into subspaces of two dimensions with 16 centroids each: four bits per
subspace. Codebooks and codes minimise an anisotropic loss: the residual's part
parallel to the vector, which moves high scores, weighs more than the part
across it. A query becomes a table of 16 scores per subspace, quantised to
bytes; a scan adds up table entries for all codes of a block. The best of each
block are scored exactly, in double precision, on the original vectors. Their
k-th best score and the known residuals of the codes bound the scan's score of
every class that can be as near; all classes within the bound are scored
exactly too, so that the result is that of brute force.

Equal vectors are one class first (with the smallest ids, as many as a query
can need), so that a very common vector costs one code. The index stays where it
is: queries are broadcast to it, QUERY_BYTES at a time, and a task scans its classes
block by block, holding the best of every query. These bound what a later block
has to score exactly, and only they are shuffled. Every query meets every class.

Codebooks are fitted on at most FIT_ROWS classes, those of smallest hash;
every class is indexed.

Defined results: vectors that are null, empty, zero, of another length than
most, or hold null or non-finite components take no part, nor do null ids;
repeated rows of an id and vector are one; ties go to the smaller id; a query
with fewer candidates gets all of them; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.session import prepare

#: Bound of the sample that codebooks are fitted on.
FIT_ROWS = 8192
SUB, CENTROIDS, ROUNDS = 2, 16, 6
#: Weight of the parallel residual against the orthogonal one.
ETA = 3.0
#: Bytes of queries that are broadcast at once, queries that are scanned at once,
#: and the classes that they meet then.
QUERY_BYTES, QUERY_BLOCK, CLASS_BLOCK = 1 << 24, 512, 4096
#: Candidates of a block that are scored exactly first, per query.
RERANK = 256
#: Allowance for rounding in double precision.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, safe from overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, summed per row in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB)))


def encode(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (row, subspace) of unit rows by coordinate descent on the loss
    |r|**2 + (ETA - 1) * (r . x)**2 for the residual r."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, SUB)
    diff = parts[:, :, None, :] - books[None]
    own = (diff**2).sum(3)
    along = (diff * parts[:, :, None, :]).sum(3)
    codes = own.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            best = (own[:, j] + (ETA - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[rows, j, best]
            codes[:, j] = best
    return codes.astype(np.uint8)


def fit(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Codebooks (subspace, 16, SUB) for unit rows: alternately encode and solve
    the anisotropic least squares of each centroid, others held."""
    x = _padded(x)
    n, m = len(x), x.shape[1] // SUB
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, m, SUB)
    books = np.stack([parts[rng.choice(n, CENTROIDS, replace=n < CENTROIDS), j] for j in range(m)])
    for _ in range(ROUNDS):
        codes = encode(x, books)
        made = np.stack([books[j][codes[:, j]] for j in range(m)], 1)
        along = ((parts - made) * parts).sum((1, 2))
        for j in range(m):
            rest = along - ((parts[:, j] - made[:, j]) * parts[:, j]).sum(1)
            for c in range(CENTROIDS):
                at = codes[:, j] == c
                if not at.any():
                    continue
                p = parts[at, j]
                # minimise |p - b|^2 + (ETA - 1) * (rest + p.p - p.b)^2 over b
                lhs = len(p) * np.eye(SUB) + (ETA - 1) * p.T @ p
                rhs = p.sum(0) + (ETA - 1) * p.T @ (rest[at] + (p * p).sum(1))
                books[j, c] = np.linalg.solve(lhs, rhs)
            now = books[j][codes[:, j]]
            along = rest + ((parts[:, j] - now) * parts[:, j]).sum(1)
            made[:, j] = now
    return books


def residuals(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part along x, length of the part across it) of the residuals of unit rows."""
    r = x - np.concatenate([books[j][codes[:, j]] for j in range(len(books))], 1)
    along = (r * x).sum(1)
    return along, np.sqrt(((r - along[:, None] * x) ** 2).sum(1))


def least(score: float, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Least inner product of a unit query with the decoded rows whose cosine is
    `score` or more. For a row x with residual r, of parts `along` and `across`,
    it is s * (1 - along) - q . r_across at a cosine s, and q . r_across is at
    most sqrt(1 - s**2) * across. That grows with s from 0 on if along < 1."""
    part = math.sqrt(max(0.0, 1 - score * score)) if score > 0 else 1.0
    return np.where(along < 1, score * (1 - along) - part * across, -np.inf) - SLACK


def _tables(queries: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte tables (query, subspace, centroid), and the factor and shift of each
    query that lead from sums of entries back to inner products."""
    m = len(books)
    tables = np.einsum("qms,mcs->qmc", _padded(queries).reshape(len(queries), m, SUB), books)
    floor = tables.min(2, keepdims=True)
    step = (tables - floor).max((1, 2), keepdims=True) / 255 + 1e-30
    return np.rint((tables - floor) / step).astype(np.uint16), step[:, 0, 0], floor[:, :, 0].sum(1)


def _sums(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    low, high = codes & 15, codes >> 4
    # 257 entries of a byte fit in 16 bits
    out = np.zeros((len(tables), len(codes)), np.uint16 if tables.shape[1] <= 257 else np.uint32)
    for j in range(tables.shape[1]):
        out += tables[:, j][:, (low if j % 2 == 0 else high)[:, j // 2]]
    return out


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate scores (query, row), up to a factor and a shift per query:
    sums of byte tables over four-bit codes (two to a byte, packed)."""
    return _sums(_tables(queries, books)[0], codes)


def pack4(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def _index(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Classes with their vectors, packed codes and the codes' residuals."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = np.stack([np.frombuffer(b, np.float32) for b in batch.column("vector").to_pylist()])
        x = _padded(unit(raw.astype(np.float64)))
        codes = encode(x, books)
        along, across = residuals(x, codes, books)
        packed = pa.array([c.tobytes() for c in pack4(codes)], pa.binary())
        cols = [batch.column("class"), batch.column("vector"), packed, pa.array(along), pa.array(across)]
        yield pa.RecordBatch.from_arrays(cols, names=["class", "vector", "codes", "along", "across"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of all batches, about `size` at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _search(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    """The classes of a task that are nearest to each query: k and one more, as
    one may hold nothing but the query itself."""
    most, scaled = k + 1, unit(queries.astype(np.float64))
    best = np.full((len(ids), most), -np.inf)
    owner = np.full((len(ids), most), np.iinfo(np.int64).max)
    for table in _blocks(batches, CLASS_BLOCK):
        order = np.argsort(table.column("class").to_numpy(), kind="stable")
        classes = table.column("class").to_numpy()[order]
        x = np.stack([np.frombuffer(b, np.float32) for b in table.column("vector").to_pylist()])[order]
        codes = np.stack([np.frombuffer(b, np.uint8) for b in table.column("codes").to_pylist()])[order]
        along, across = (table.column(c).to_numpy()[order] for c in ("along", "across"))
        for begin in range(0, len(ids), QUERY_BLOCK):
            tables, step, shift = _tables(scaled[begin : begin + QUERY_BLOCK], books)
            approx = _sums(tables, codes)
            for j in range(len(approx)):
                i = begin + j
                # entries are off by half a step at most
                decoded = (approx[j] + len(books) / 2) * step[j] + shift[j]
                at = np.zeros(0, np.int64)
                if best[i, -1] == -np.inf:
                    first = max(rerank, most)
                    at = np.argpartition(-decoded, min(first, len(classes) - 1))[:first]
                    exact = cosine(queries[i], x[at])
                    _keep(best[i], owner[i], exact, classes[at])
                near = decoded >= least(best[i, -1], along, across) if best[i, -1] > -np.inf else np.ones(len(classes), bool)
                near[at] = False
                more = np.flatnonzero(near)
                if len(more):
                    _keep(best[i], owner[i], cosine(queries[i], x[more]), classes[more])
    row, place = np.nonzero(best > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(owner[row, place]), pa.array(best[row, place])], names=["query_id", "class", "score"])


def _keep(best: np.ndarray, owner: np.ndarray, scores: np.ndarray, classes: np.ndarray) -> None:
    """Put those scores and classes that belong there among the best, in place."""
    scores, classes = np.concatenate((best, scores)), np.concatenate((owner, classes))
    order = np.lexsort((classes, -scores))[: len(best)]
    best[:], owner[:] = scores[order], classes[order]


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of rows (vec_id, embedding)
    that is a query its k nearest among all others, by cosine."""
    spark = rows.sparkSession
    prepare(spark, 2048)
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"), is_query.alias("q"))
    own = own.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # -0.0 becomes 0.0, so that equal vectors have equal bytes
    own = own.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float"))).withColumn("dims", F.size("v"))
    common = own.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = own.where(F.col("dims") == common["dims"]).select("vec_id", "v", "q")
    first = own.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    members = first.withColumn("class", F.min("vec_id").over(W.partitionBy("v"))).checkpoint()
    classes = members.where("n = 1").select("class", "v")
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(FIT_ROWS).toPandas()
    books = fit(unit(np.stack(sample["v"].to_numpy()).astype(np.float64)))
    rows = _to_bytes(classes, "class long", ("class",))
    index = rows.mapInArrow(partial(_index, books=books), "class long, vector binary, codes binary, along double, across double").checkpoint()
    asked = own.where("q").select(F.col("vec_id").alias("query_id"), "v").distinct().checkpoint()
    turns = max(1, -(-asked.count() * 4 * common["dims"] // QUERY_BYTES))
    found = []
    for turn in range(turns):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).orderBy("query_id").toArrow()
        ids = some.column("query_id").to_numpy()
        queries = np.stack(some.column("v").to_numpy()).astype(np.float32) if len(ids) else np.zeros((0, common["dims"]), np.float32)
        sent = spark.sparkContext.broadcast((ids, queries, books))

        def run(batches, sent=sent):
            return _search(batches, *sent.value, k, rerank)

        near = index.mapInArrow(run, "query_id long, class long, score double")
        if turns > 1:  # what was broadcast may go before the next turn
            near = near.checkpoint()
            sent.destroy()
        found.append(near)
    near = reduce(DataFrame.unionAll, found)
    best = near.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "class"))).where(F.col("r") <= k + 1)
    ids = best.join(members.select("class", "vec_id"), "class").where("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ids.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pack_vectors(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        flat, at = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32), np.asarray(v.offsets)
        at = at - at[0] if len(at) else at
        raw = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(raw, pa.binary())], names=[*keep, "vector"])


def _to_bytes(df: DataFrame, kinds: str, keep: tuple[str, ...]) -> DataFrame:
    return df.mapInArrow(partial(_pack_vectors, keep=keep), kinds + ", vector binary")
