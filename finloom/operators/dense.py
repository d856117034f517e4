"""Vectors: exact nearest neighbours in blocks of queries, an LSH index, cosine, checks and an offline embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.operators.lexical import top_k
from finloom.plans.runtime import small, spread

#: Queries that one pass holds in a worker; more are answered in further passes.
QUERY_BLOCK = 4096


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def knn(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", query: str = "query", metric: str = "l2") -> DataFrame:
    """(query, doc, distance, rank): the exact k nearest of every query among all vectors.

    ``queries`` has ``query`` and ``vector``. Each Arrow batch of vectors is one matrix product with a block of at most
    ``QUERY_BLOCK`` queries (the broadcast's bound) and passes on only its own k best, so what is shuffled does not grow
    with the vectors' length. ``metric``: l2 (squared), cosine or dot (negated). Null vectors, those with a null, NaN or
    infinite part, and those of another length are no one's neighbours; ties go to the smaller id."""
    spark = vectors.sparkSession
    usable = lambda df: df.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = usable(queries.select(query, vector))
    n = asked.count()
    q_type, v_type = queries.schema[query].dataType.simpleString(), vectors.schema[vec_id].dataType.simpleString()
    src = spread(usable(vectors.select(F.col(vec_id).alias("doc"), F.col(vector).alias("v"))))
    blocks, out = max(1, -(-n // QUERY_BLOCK)), None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)
        rows = mine.collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [np.asarray(r[1], np.float64) for r in rows]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, vecs = sent.value
            for frame in batches:
                parts = []
                sizes = frame["v"].map(len).to_numpy()
                for d in set(map(len, vecs)):
                    have = np.flatnonzero(sizes == d)
                    if not len(have):
                        continue
                    which = [i for i, v in enumerate(vecs) if len(v) == d]
                    m = np.stack(frame["v"].to_numpy()[have]).astype(np.float64)
                    q = np.stack([vecs[i] for i in which])
                    dot = q @ m.T
                    if metric == "l2":
                        dist = (q**2).sum(1)[:, None] + (m**2).sum(1)[None, :] - 2 * dot
                    elif metric == "cosine":
                        norms = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((m**2).sum(1))[None, :]
                        dist = 1 - np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)
                    else:
                        dist = -dot
                    ids = frame["doc"].to_numpy()[have]
                    for r, i in enumerate(which):
                        near = np.lexsort((ids, np.round(dist[r], 6)))[:k]
                        parts.append(pd.DataFrame({"query": names[i], "doc": ids[near], "distance": dist[r][near]}))
                yield pd.concat(parts) if parts else pd.DataFrame({"query": [], "doc": [], "distance": []})

        part = src.mapInPandas(run, f"query {q_type}, doc {v_type}, distance double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, "query", k, "distance", descending=False).withColumnRenamed("query", query)


def lsh_knn(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", query: str = "query", bits: int = 6, tables: int = 16, seed: int = 7) -> DataFrame:
    """Approximate (query, doc, distance, rank) by random hyperplanes: vectors and queries meet in buckets of equal
    signs, of which each has ``tables``; the query's buckets with one sign flipped are looked up too. Every vector is
    indexed; nothing is fitted. The join is on (table, bucket), with only the asked buckets' vectors kept."""
    width = len(queries.select(vector).filter(F.col(vector).isNotNull()).first()[0])
    planes = np.random.default_rng(seed).standard_normal((tables * bits, width))

    @F.pandas_udf("array<int>")
    def signs(v: pd.Series) -> pd.Series:
        m = (np.stack(v.to_numpy()) @ planes.T > 0).reshape(len(v), tables, bits)
        return pd.Series(list((m * (1 << np.arange(bits))).sum(2).astype(np.int32)))

    fit = lambda df: df.filter(F.size(vector) == width)
    base = fit(vectors).select(F.col(vec_id).alias("doc"), F.posexplode(signs(vector)).alias("t", "b"))
    flips = F.array(*[F.lit(0), *[F.lit(1 << i) for i in range(bits)]])
    asked = fit(queries).select(query, F.posexplode(signs(vector)).alias("t", "b0")).withColumn("f", F.explode(flips)).select(query, "t", F.col("b0").bitwiseXOR(F.col("f")).alias("b"))
    # Only ids meet; the vectors are fetched once for each pair that met.
    near = base.join(small(asked), ["t", "b"]).select(query, "doc").distinct()
    near = near.join(fit(vectors).select(F.col(vec_id).alias("doc"), F.col(vector).alias("v")), "doc").join(small(fit(queries).select(query, F.col(vector).alias("q"))), query)
    dist = F.aggregate(F.zip_with("v", "q", lambda a, b: (a.cast("double") - b.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    return top_k(near.select(query, "doc", dist.alias("distance")), query, k, "distance", descending=False)


def check_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64) -> DataFrame:
    """(vec_id, ok, problem) of every row; problem is null where the vector is right."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != dim, "dimension").when(bad, "not finite")
    return vectors.select(vec_id, problem.isNull().alias("ok"), problem.alias("problem"))


def hash_embedder(dim: int = 64):
    """An offline stand-in for an embedding model: signed hashes of a text's terms, of unit length. Null gives zeros."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[int, int]] = {}
        for s in texts:
            out = []
            for t in s:
                v = np.zeros(dim)
                for w in (t or "").lower().split():
                    if w not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                        memo[w] = (h % dim, 1 if h >> 63 else -1)
                    i, sign = memo[w]
                    v[i] += sign
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.Series(out)

    return embed
