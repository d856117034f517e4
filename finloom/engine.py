"""The engine: indexes over a table of chunks, and searches of many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.config import SearchConfig
from finloom.functions.text import words
from finloom.operators import dense, fusion, lexical
from finloom.operators.predicates import compile_where
from finloom.plans.runtime import few, ship, small

LEGS = ["lexical", "dense"]


class Engine:
    """``chunks`` with an id, a text and metadata; ``embed`` is a pandas UDF string -> array<float>.

    Indexes are built lazily from the table, or taken ready-made (``index`` from ``read_index``, ``vectors`` with the id
    and ``embedding``). Filters are applied before ranking in both legs; corpus statistics stay those of the whole table.
    """

    def __init__(self, chunks: DataFrame, embed: Callable | None = None, key: str = "chunk_id", text: str = "text", fields: tuple[str, ...] = ("text", "ticker", "doc_type"), index: lexical.Index | None = None, vectors: DataFrame | None = None, config: SearchConfig = SearchConfig(), aliases: dict[str, str] | None = None):
        ship(chunks.sparkSession)
        self.chunks, self.key, self.text, self.config = chunks, key, text, config
        self.embed = embed or dense.hash_embedder()
        self.aliases = aliases or {"company": "ticker"}
        self.index = index or lexical.build_index(chunks, key, *[f for f in fields if f in chunks.columns], split=words)
        self.vectors = vectors if vectors is not None else chunks.filter(F.length(text) > 0).select(key, self.embed(text).alias("embedding"))

    def _allowed(self, where: dict | None) -> DataFrame | None:
        return self.chunks.filter(compile_where(where, self.aliases)).select(F.col(self.key).alias("doc")) if where else None

    def lexical(self, queries: DataFrame, k: int, where: dict | None = None, match_all: bool = False) -> DataFrame:
        """(query, doc, score, rank) of BM25; ``queries`` has ``query`` and ``question``."""
        found = lexical.bm25(self.index, queries, "query", "question", match_all)
        allowed = self._allowed(where)
        return lexical.top_k(found if allowed is None else found.join(allowed, "doc", "left_semi"), "query", k)

    def dense(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        """(query, doc, distance, rank) of the nearest vectors."""
        allowed = self._allowed(where)
        vectors = self.vectors if allowed is None else self.vectors.join(allowed.withColumnRenamed("doc", self.key), self.key, "left_semi")
        return dense.knn(vectors, queries.select("query", self.embed("question").alias("embedding")), k, self.key)

    def search(self, queries: DataFrame, k: int = 10, where: dict | None = None) -> DataFrame:
        """(query, doc, rank, score, ranks and shares of the legs): both legs over-fetched, fused, the best k."""
        n = self.config.fetch(k)
        lw, dw = self.config.weights()
        fused = fusion.fuse({"lexical": (self.lexical(queries, n, where), lw), "dense": (self.dense(queries, n, where), dw)}, k=self.config.rrf_k)
        return fusion.best(fused, LEGS, k)

    def explain(self, queries: DataFrame, k: int = 10, where: dict | None = None) -> DataFrame:
        return fusion.explain(self.search(queries, k, where), LEGS)

    def retrieve(self, queries: DataFrame, k: int = 5, where: dict | None = None, rescore: Callable | None = None) -> DataFrame:
        """The best k with their texts. ``rescore(df) -> df`` may add a column ``rescored`` to the pool (a model, rules);
        then that decides, the fused rank breaking ties."""
        n = max(k, min(self.config.pool, 4 * k))
        pool = few(self.search(queries, n, where), queries, n)
        rows = self.chunks.withColumnRenamed(self.key, "doc").join(pool, "doc").join(small(queries.select("query", "question")), "query")
        rows = rescore(rows) if rescore else rows.withColumn("rescored", F.col("score"))
        return lexical.top_k(rows.withColumnRenamed("rank", "fused_rank"), "query", k, "rescored", ties="fused_rank", digits=9)

    def prompts(self, queries: DataFrame, k: int = 5, where: dict | None = None, source: str = "doc_id") -> DataFrame:
        """(query, prompt) with the best k as sources."""
        return fusion.build_prompts(self.retrieve(queries, k, where), "query", "rank", source, self.text, "question")

    def stats(self) -> DataFrame:
        return self.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(self.key).alias("ids"), F.count(self.text).alias("with_text"))
