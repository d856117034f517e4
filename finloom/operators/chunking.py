"""Units into token-bounded chunks: packing, merging, sliding windows and the pipelines over filings and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finloom.config import ChunkConfig
from finloom.functions.text import token_count, tokens
from finloom.plans.runtime import spread

def overlap_tokens(n: str | Column, ratio: float) -> Column:
    return F.floor((F.col(n) if isinstance(n, str) else n) * ratio).cast("int")


def pack(sizes: str | Column, target: int, least: int) -> Column:
    """Pack numbers (from 1) of an array of sizes, in order: a unit joins the open pack if that stays below ``target``
    or the pack is still below ``least``. A fold, for the sum starts anew with every pack."""
    arr = F.col(sizes) if isinstance(sizes, str) else sizes
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("c"), F.array().cast("array<int>").alias("out"))

    def step(s, u):
        u = F.coalesce(u, F.lit(0)).cast("bigint")
        joins = (s["n"] > 0) & ((s["c"] + u < target) | (s["c"] < least))
        n = F.when(joins, s["n"]).otherwise(s["n"] + 1)
        return F.struct(n.alias("n"), F.when(joins, s["c"] + u).otherwise(u).alias("c"), F.concat(s["out"], F.array(n)).alias("out"))

    return F.aggregate(arr, start, step, lambda s: s["out"])


def merge_small(sizes: str | Column, least: int) -> Column:
    """Group numbers (from 1): pieces are joined until the group has ``least``; a small rest joins the last group."""
    arr = F.col(sizes) if isinstance(sizes, str) else sizes
    start = F.struct(F.lit(1).alias("n"), F.lit(0).cast("bigint").alias("c"), F.array().cast("array<int>").alias("out"))

    def step(s, u):
        u = F.coalesce(u, F.lit(0)).cast("bigint")
        new = s["c"] >= least
        n = F.when(new, s["n"] + 1).otherwise(s["n"])
        return F.struct(n.alias("n"), F.when(new, u).otherwise(s["c"] + u).alias("c"), F.concat(s["out"], F.array(n)).alias("out"))

    return F.aggregate(arr, start, step, lambda s: F.transform(s["out"], lambda x: F.when((s["c"] < least) & (x == s["n"]) & (x > 1), x - 1).otherwise(x)))


def windows(n: str | Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """array<struct<start, end>> of the windows over n tokens; the first that reaches the end is the last; none for 0."""
    col = (F.col(n) if isinstance(n, str) else n).cast("int")
    last = F.greatest(F.lit(0), F.ceil((col - cfg.max_tokens) / cfg.step)).cast("int")
    return F.when(col > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * cfg.step).alias("start"), F.least(i * cfg.step + cfg.max_tokens, col).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def window_chunks(df: DataFrame, key: str, text: str, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row a window: ``key``, ``piece``, ``start_token``, ``end_token``, overlaps with its neighbours and the text.

    The text is split into tokens once and sliced; overlaps are closed forms, so nothing is shuffled."""
    base = spread(df.select(key, text)).select(key, tokens(text).alias("_t")).withColumn("_w", windows(F.size("_t"), cfg))
    # An outer explode: for an inner one the optimizer infers a filter that splits the text a second time.
    rows = base.select(key, "_t", "_w", F.posexplode_outer("_w").alias("_i", "_s")).filter("_i is not null")
    n = F.size("_w")
    before = F.when(F.col("_i") > 0, F.greatest(F.lit(0), F.try_element_at("_w", F.greatest(F.col("_i"), F.lit(1)))["end"] - F.col("_s.start"))).otherwise(0)
    after = F.when(F.col("_i") < n - 1, F.greatest(F.lit(0), F.col("_s.end") - F.try_element_at("_w", F.least(F.col("_i") + 2, n))["start"])).otherwise(0)
    return rows.select(
        key, (F.col("_i") + 1).alias("piece"), F.col("_s.start").alias("start_token"), F.col("_s.end").alias("end_token"), before.cast("int").alias("overlap_with_prev"), after.cast("int").alias("overlap_with_next"),
        F.array_join(F.slice("_t", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")), " ").alias("text"),
    )


def pack_rows(units: DataFrame, keys: list[str], order: str, text: str, cfg: ChunkConfig = ChunkConfig(), ids: str | None = None) -> DataFrame:
    """Rows of a group packed in order: ``keys``, ``pack``, ``n_units``, ``n_tokens``, ``text`` (joined by a space) and,
    with ``ids``, ``source_units``. A group is one document's section: its units are collected, which is what packing
    in order needs and what a document bounds. Units without a token are left out."""
    u = F.struct(F.col(order).alias("o"), token_count(text).cast("int").alias("n"), F.col(text).alias("t"), (F.col(ids) if ids else F.lit(None).cast("string")).alias("id"))
    rows = units.filter(token_count(text) > 0).groupBy(*keys).agg(F.sort_array(F.collect_list(u)).alias("_u"))
    rows = rows.withColumn("_p", pack(F.transform("_u", lambda x: x["n"]), cfg.target_tokens, cfg.min_tokens))
    flat = rows.select(*keys, F.explode(F.arrays_zip("_u", "_p")).alias("z")).select(*keys, F.col("z._p").alias("pack"), "z._u.*")
    out = flat.groupBy(*keys, "pack").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("o", "t", "id"))).alias("_s"))
    more = [F.transform("_s", lambda x: x["id"]).alias("source_units")] if ids else []
    return out.select(*keys, "pack", "n_units", "n_tokens", F.array_join(F.transform("_s", lambda x: x["t"]), " ").alias("text"), *more)


def chunk_documents(units: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Units (``UNIT_SCHEMA``'s doc_id, chunk_id, doc_type, section_id, phase, exchange_id, unit_index, text) to chunks.

    Filings are packed by section; transcripts' prepared remarks by phase; their questions and answers by exchange.
    What exceeds the window's size becomes overlapping windows. Transcript units without phase, and question-and-answer
    units without exchange, are left out; unknown document types give no chunk."""
    filing = F.col("doc_type").isin("10-K", "10-Q")
    group = F.when(filing, F.concat(F.lit("s:"), F.coalesce("section_id", F.lit("FULL")))).when(F.col("phase") == "prepared_remarks", F.lit("p:prepared")).when(F.col("phase") == "qa", F.concat(F.lit("q:"), F.col("exchange_id")))
    usable = units.filter(filing | (F.col("doc_type") == "earnings_transcript")).withColumn("_g", group).filter("_g is not null")
    # An exchange is one chunk whatever its size: it is packed with no target.
    packed = pack_rows(usable.filter(~F.col("_g").startswith("q:")), ["doc_id", "_g"], "unit_index", "text", cfg, "chunk_id")
    whole = pack_rows(usable.filter(F.col("_g").startswith("q:")), ["doc_id", "_g"], "unit_index", "text", ChunkConfig(2**31 - 1, cfg.min_tokens, cfg.max_tokens, cfg.overlap_ratio), "chunk_id")
    both = packed.unionByName(whole)
    kind = F.when(F.col("n_tokens") > cfg.max_tokens, "windowed_overlap").when(F.col("_g").startswith("s:"), "section_packed").when(F.col("_g").startswith("p:"), "prepared_packed").otherwise("qa_exchange")
    first = usable.groupBy("doc_id", "_g").agg(F.min("unit_index").alias("_first"))
    rows = both.join(first, ["doc_id", "_g"]).withColumn("chunk_type", kind).withColumn("_t", tokens("text")).withColumn("_w", F.when(F.col("chunk_type") == "windowed_overlap", windows("n_tokens", cfg)).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))))
    rows = rows.select("doc_id", "_g", "_first", "pack", "chunk_type", "source_units", "n_tokens", "text", "_t", F.posexplode("_w").alias("_i", "_s"))
    windowed = F.col("chunk_type") == "windowed_overlap"
    w = Window.partitionBy("doc_id").orderBy("_first", "_g", "pack", "_i")
    return rows.withColumn("_no", F.row_number().over(w)).select(
        F.format_string("%s_chunk_%04d", "doc_id", "_no").alias("chunk_id"), "doc_id", "source_units", "chunk_type",
        F.when(windowed, F.col("_s.end") - F.col("_s.start")).otherwise(F.col("n_tokens")).cast("int").alias("chunk_tokens"), F.col("_s.start").cast("int").alias("start_token"), F.col("_s.end").cast("int").alias("end_token"),
        F.when(windowed, F.array_join(F.slice("_t", F.col("_s.start") + 1, F.greatest(F.col("_s.end") - F.col("_s.start"), F.lit(1))), " ")).otherwise(F.col("text")).alias("text"),
    )


def semantic_chunks(df: DataFrame, key: str, text: str, size: int = 1000) -> DataFrame:
    """(key, piece, start, end, text): paragraphs gathered greedily up to ``size`` characters; a longer paragraph falls
    into sentences, a longer sentence is cut hard. Offsets are true ones of the text."""
    import re

    import pandas as pd

    kind = f"{key} {df.schema[key].dataType.simpleString()}, piece int, start int, end int, text string"
    part = re.compile(r"\S[\s\S]*?(?=\n\s*\n|\s*$)")
    sentence = re.compile(r"\S[\s\S]*?(?:[.!?](?=\s)|$)")

    def spans(t: str):
        for m in part.finditer(t):
            if m.end() - m.start() <= size:
                yield m.span()
                continue
            for s in sentence.finditer(t, *m.span()):
                for k in range(s.start(), s.end(), size):
                    yield k, min(k + size, s.end())

    def run(batches):
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text], strict=True):
                a = z = None
                no = 0
                for s, e in spans(t or ""):
                    if a is not None and e - a > size:
                        no += 1
                        out.append((k, no, a, z, t[a:z]))
                        a = None
                    a, z = (s if a is None else a), e
                if a is not None:
                    out.append((k, no + 1, a, z, t[a:z]))
            yield pd.DataFrame(out, columns=[key, "piece", "start", "end", "text"])

    return df.select(key, text).mapInPandas(run, kind)
