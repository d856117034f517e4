"""Variant spellings of names typed by people, linked to the one they mean.

Spellings are read into forms (given name, initials, surname, or an organisation's words). The name parts are sharded
into tries, and in each shard a Levenshtein automaton walks the trie for every part, so that only spellings within the
edits that a part of their length may have ever meet (a swap of neighbours is one). Forms whose parts meet are checked
in either order of their parts, and each form points to the best more frequent or fuller form that it can be a variant
of; following the pointers gives the entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.llm.names import FULL, Name, cost, parse
from finloom.plans.runtime import stored

#: Letters that a part needs to meet others than itself; letters from which two edits may lie between parts.
SHORTEST, LONG = 2, 9
#: Words of a shard that one trie holds and that walk it in one task; larger shards are split on both sides.
SHARD_WORDS = 2_000


def most_edits(n: int) -> int:
    """Edits within which parts meet, by the letters of the shorter one."""
    return 2 if n >= LONG else 1


class Automaton:
    """The nondeterministic Levenshtein automaton of a word for ``most`` edits, its states kept as bits."""

    def __init__(self, word: str, most: int = 1):
        self.n, self.most, self.mask = len(word), most, {}
        for i, c in enumerate(word):
            self.mask[c] = self.mask.get(c, 0) | 1 << i
        self.accept = 1 << self.n
        self.all = (self.accept << 1) - 1

    def start(self) -> tuple[int, ...]:
        """Positions reached with 0, 1, ... edits, then those in the middle of a swap after as many."""
        return (*((1 << e + 1) - 1 for e in range(self.most + 1)), *(0 for _ in range(self.most)))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        m, k = self.mask.get(c, 0), self.most
        new = [(state[0] & m) << 1]
        for e in range(1, k + 1):
            # The letter matches, is added, stands for another, or ends a swap; or a letter of the word was dropped.
            new.append(((state[e] & m) << 1 | state[e - 1] | state[e - 1] << 1 | new[e - 1] << 1 | (state[k + e] & m) << 2) & self.all)
        return (*new, *(state[e] & m >> 1 for e in range(k)))

    def dead(self, state: tuple[int, ...]) -> bool:
        return not any(state)

    def edits(self, state: tuple[int, ...]) -> int:
        return next((e for e in range(self.most + 1) if state[e] & self.accept), self.most + 1)


def _one(n: int) -> int:
    return 1


def trie_neighbours(words: list[str], asked: list[str] | None = None, most: Callable[[int], int] = _one) -> Iterator[tuple[str, str]]:
    """Ordered pairs (one of ``asked``, by default of ``words``; another of ``words``) within the edits that ``most``
    allows the shorter one, by walking one trie with every asked word's automaton."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    for w in words if asked is None else asked:
        a = Automaton(w, most(len(w)))
        todo = [(root, a.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    if child != w and a.edits(state) <= most(min(len(w), len(child))):
                        yield w, child
                elif not a.dead(after := a.step(state, c)):
                    todo.append((child, after))


def shards(word: str, two: bool = False) -> list[str]:
    """Keys of which two words within one edit share at least one: an edit leaves the first or the last part of the
    shorter word as it is. With ``two`` also those of words within two edits, of which the shorter one is long: two
    edits leave the first, the last or, moved by one at most, the middle part as it is."""
    out = []
    for n in (len(word), len(word) - 1):
        p = max(1, (n - 1) // 2)
        out += [f"{n}<{word[:p]}", f"{n}>{word[len(word) - p :]}"]
    for n in (len(word), len(word) - 1, len(word) - 2) if two else ():
        if n >= LONG:
            p = (n - 2) // 3
            out += [f"{n}[{word[:p]}", f"{n}]{word[len(word) - p :]}", *(f"{n}={word[p + 1 + k : 2 * p + 1 + k]}" for k in (-1, 0, 1))]
    return out


def _shards(word: Column, two: bool) -> Column:
    """The same keys as an expression."""
    n = F.length(word)
    text = lambda m, mark, part: F.concat(m.cast("string"), F.lit(mark), part)
    out = []
    for m in (n, n - 1):
        p = F.greatest(F.lit(1), F.floor((m - 1) / 2).cast("int"))
        out += [text(m, "<", F.left(word, p)), text(m, ">", F.right(word, p))]
    for m in (n, n - 1, n - 2) if two else ():
        p = F.floor((m - 2) / 3).cast("int")
        keys = [text(m, "[", F.left(word, p)), text(m, "]", F.right(word, p)), *(text(m, "=", F.substring(word, p + 2 + k, p)) for k in (-1, 0, 1))]
        out += [F.when(m >= LONG, key) for key in keys]
    return F.array_distinct(F.array_compact(F.array(*out)))


def neighbours(words: DataFrame, two: bool = False) -> DataFrame:
    """(word, near): all ordered pairs of different words of ``words.word`` within one edit, with ``two`` within two
    where the shorter one is long. One trie a shard; a shard of more than ``SHARD_WORDS`` words is split into blocks of
    words that are held and words that walk, and every pair of blocks is a task's group of its own."""
    most = most_edits if two else _one

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = sorted(set(rows.loc[rows["held"], "word"]))
        asked = sorted(set(rows.loc[~rows["held"], "word"]))
        return pd.DataFrame(list(trie_neighbours(held, asked, most)), columns=["word", "near"])

    sharded = words.filter(F.length("word") >= SHORTEST).select("word", F.explode(_shards(F.col("word"), two)).alias("shard"))
    sharded = stored(sharded, "shards")
    parts = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shard", F.ceil(F.col("n") / SHARD_WORDS).cast("int").alias("parts"))
    own = sharded.join(parts, "shard").withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    every = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = every.select("shard", F.col("mine").alias("a"), F.col("other").alias("b"), "word", F.lit(True).alias("held")).unionByName(every.select("shard", F.col("other").alias("a"), F.col("mine").alias("b"), "word", F.lit(False).alias("held")))
    # A stated number of parts: the rows are few, but each is work.
    rows = rows.repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "shard", "a", "b")
    return rows.groupBy("shard", "a", "b").applyInPandas(run, "word string, near string").distinct()


def read_names(values: DataFrame, col: str) -> DataFrame:
    """``values`` with ``given``, ``initials``, ``surname`` and ``firm`` of its spellings; all null without letters."""

    @F.pandas_udf("given string, initials string, surname string, firm string")
    def read(s: pd.Series) -> pd.DataFrame:
        got = [parse(x) if x is not None else None for x in s]
        return pd.DataFrame([(None,) * 4 if n is None else (n.given, n.initials, n.surname, " ".join(sorted(n.firm))) for n in got], columns=["given", "initials", "surname", "firm"])

    return values.withColumn("_n", read(col)).select(*values.columns, "_n.given", "_n.initials", "_n.surname", "_n.firm")


def _turned(forms: DataFrame) -> DataFrame:
    """Forms in the order given name, surname: where the last part is mostly others' given name and the first is not,
    the two were typed in the other order."""
    both = forms.filter("given <> ''")
    seen = both.select(F.col("given").alias("w"), F.col("n").alias("g"), F.lit(0).alias("s")).unionByName(both.select(F.col("surname").alias("w"), F.lit(0).alias("g"), F.col("n").alias("s")))
    given = seen.groupBy("w").agg(((F.sum("g") - F.sum("s")) / (F.sum("g") + F.sum("s"))).alias("bias"))
    a, b = given.select(F.col("w").alias("given"), F.col("bias").alias("bg")), given.select(F.col("w").alias("surname"), F.col("bias").alias("bs"))
    swap = (F.col("given") != "") & (F.col("bs") > 0.5) & (F.col("bg") < 0)
    return (
        forms.join(a, "given", "left")
        .join(b, "surname", "left")
        .select(
            *[c for c in forms.columns if c not in ("given", "surname", "initials")],
            F.when(swap, F.col("surname")).otherwise(F.col("given")).alias("given"),
            F.when(swap, F.col("given")).otherwise(F.col("surname")).alias("surname"),
            F.when(swap, F.concat(F.left("surname", F.lit(1)), F.substring("initials", 2, 99))).otherwise(F.col("initials")).alias("initials"),
        )
    )


def link_names(table: DataFrame, col: str = "speaker") -> DataFrame:
    """One row per different non-null spelling in ``col``, exactly as written: ``name``, ``entity`` (the most frequent
    spelling of whom it names), ``n_rows`` (its rows) and ``n_variants`` (spellings of the entity, itself included).

    Blank spellings and those without letters are entities of their own. Repeated rows only count; ties are broken by
    spelling; further columns are ignored; an empty table gives an empty result. Only distinct spellings are shuffled,
    after a partial count. A spelling that could mean several (a lone surname that two people bear) stays alone.
    """
    spark = table.sparkSession
    values = stored(read_names(table.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("n")), "name"), "names")
    key = F.concat_ws("|", "given", "initials", "surname", "firm")
    forms = values.filter("surname is not null").groupBy("given", "initials", "surname", "firm").agg(F.sum("n").alias("n")).withColumn("typed", key)
    forms = stored(_turned(forms).withColumn("id", key), "forms")
    # Small plans over stored tables: the driver keeps every plan that it has run.
    merged = stored(forms.groupBy("id", "given", "initials", "surname", "firm").agg(F.sum("n").alias("n")), "merged")

    # Parts that meet in a trie, every part meeting itself; near: the words within the edits that their length allows.
    parts = merged.select(F.explode(F.array("surname", "given", "firm")).alias("word")).filter("word <> ''").distinct()
    near = neighbours(parts, two=True)
    near = stored(near.unionByName(parts.select("word", F.col("word").alias("near"))), "near")
    met = lambda df, col, name: df.join(near.select(F.col("word").alias(col), F.col("near").alias(name)), col)

    # Full names meet on (surname, full given name): either part may differ by edits, the given name may be a short
    # form, and the parts may stand in either order. Nobody meets all bearers of a surname.
    short = F.broadcast(spark.createDataFrame([(k, f) for k, fs in FULL.items() for f in fs], "word string, full string"))
    whole = lambda df, col: df.join(short.select(F.col("word").alias(col), "full"), col, "left").withColumn("full", F.coalesce("full", col))
    fulls = merged.filter("given <> ''")
    heads = stored(whole(fulls.withColumn("g", F.col("given")), "g").drop("g").withColumnRenamed("surname", "s"), "heads")
    both = met(met(fulls, "surname", "s"), "given", "g")
    asking = whole(both.select("id", "n", "given", "initials", "surname", "firm", F.explode(F.array(F.struct("s", "g"), F.struct(F.col("g").alias("s"), F.col("s").alias("g")))).alias("k")).select("*", "k.s", "k.g").drop("k"), "g").drop("g")
    as_b = lambda df, *keys: df.select(*keys, *[F.col("s" if c == "surname" and "surname" not in df.columns else c).alias(f"b_{c}") for c in ("id", "given", "initials", "surname", "firm", "n")])
    pairs = stored(asking.join(as_b(heads, F.col("s"), F.col("full")), ["s", "full"]).drop("s", "full"), "pairs")

    # Initials meet, of (surname, initial), the most frequent form of every full given name with every string of initials,
    # and of every string of initials alone.
    first = lambda df, s, i, *per: df.groupBy(F.col(s).alias("s"), F.left(i, F.lit(1)).alias("i"), *per).agg(F.max_by(F.struct("id", "given", "initials", F.col(s).alias("surname"), "firm", "n"), F.struct("n", "id")).alias("h")).select("s", "i", "h.*")
    initial = merged.filter("given = '' and initials <> ''")
    per = lambda c: F.concat_ws("|", c, "initials").alias("_per")
    tops = first(heads, "s", "full", per("full")).unionByName(first(heads, "s", "given", per("given"))).unionByName(first(initial, "surname", "initials", F.col("initials").alias("_per")))
    pairs = pairs.unionByName(met(initial.withColumn("i", F.left("initials", F.lit(1))), "surname", "s").join(as_b(tops, "s", "i"), ["s", "i"]).select(*pairs.columns))

    firms = merged.filter("firm <> ''")
    pairs = pairs.unionByName(met(firms, "firm", "s").join(as_b(firms, F.col("firm").alias("s")), "s").select(*pairs.columns))

    @F.pandas_udf("double")
    def apart(g: pd.Series, i: pd.Series, s: pd.Series, f: pd.Series, g2: pd.Series, i2: pd.Series, s2: pd.Series, f2: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d, e, h, k, m in zip(g, i, s, f, g2, i2, s2, f2, strict=True):
            out.append((0.0 if d == m else 0.5) if d and m else 9.0 if d or m else cost(Name(a, b, c), Name(e, h, k)))
        return pd.Series(out, dtype="float64")

    # A better form is fuller (a full given name before initials before a lone surname) or as full and more frequent.
    full = lambda p: F.when(F.col(f"{p}given") != "", 2).when(F.col(f"{p}firm") != "", 2).when(F.col(f"{p}initials") != "", 1).otherwise(0)
    better = (full("b_") > full("")) | ((full("b_") == full("")) & ((F.col("b_n") > F.col("n")) | ((F.col("b_n") == F.col("n")) & (F.col("b_id") < F.col("id")))))
    pairs = pairs.filter((F.col("id") != F.col("b_id")) & better).dropDuplicates(["id", "b_id"])
    pairs = pairs.withColumn("cost", apart("given", "initials", "surname", "firm", "b_given", "b_initials", "b_surname", "b_firm")).filter("cost < 5")
    pairs = stored(pairs, "costs")

    def follow(best: DataFrame) -> DataFrame:
        """Every form with the end of its pointers; each round doubles their reach."""
        tree = stored(merged.join(best, "id", "left").select("id", "n", "given", "initials", "surname", "firm", F.coalesce("up", "id").alias("up")), "tree")
        while True:
            step = tree.join(tree.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up").select(*[c for c in tree.columns if c != "up"], F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved"))
            step = stored(step, "tree")
            tree = step.drop("moved")
            if not step.filter("moved").limit(1).count():
                return tree

    of_initials = (F.col("given") == "") & (F.col("firm") == "")
    best = pairs.filter(~of_initials).groupBy("id").agg(F.min_by("b_id", F.struct("cost", -F.col("b_n"), "b_id")).alias("up"))
    bearers = follow(best).select(F.col("id").alias("b_id"), F.col("up").alias("b_root"))
    # Initials go to the nearest, full names before initials and their own initials before others; where these are
    # different bearers they stay alone.
    asked = pairs.filter(of_initials).join(bearers, "b_id").withColumn("far", F.struct("cost", F.when(F.col("b_given") != "", 0).when(F.col("b_initials") == F.col("initials"), 1).otherwise(2).alias("kind")))
    asked = asked.join(asked.groupBy("id").agg(F.min("far").alias("least")), "id").filter("far = least")
    asked = asked.groupBy("id").agg(F.min("far.kind").alias("kind"), F.count_distinct("b_root").alias("bearers"), F.collect_set("b_initials").alias("all"), F.max_by("b_initials", F.length("b_initials")).alias("longest"), F.min_by("b_id", F.struct(-F.col("b_n"), "b_id")).alias("up"))
    asked = asked.filter(F.when(F.col("kind") == 0, F.col("bearers") == 1).otherwise(F.forall("all", lambda x: F.col("longest").startswith(x))))
    tree = follow(best.unionByName(asked.select("id", "up")))
    # A lone surname belongs to its bearer where there is only one.
    lone = tree.filter("firm = '' and initials = ''")
    roots = tree.filter("firm = '' and initials <> '' and id = up").select(F.col("surname").alias("near"), F.col("id").alias("root"))
    bearer = lone.join(near, lone["surname"] == near["word"]).join(roots, "near").withColumn("same", F.col("near") == F.col("word")).filter("same or least(length(near), length(word)) > 3")
    bearer = bearer.groupBy("id").agg(F.min(F.when(F.col("same"), F.col("root"))).alias("r1"), F.max(F.when(F.col("same"), F.col("root"))).alias("r2"), F.min("root").alias("q1"), F.max("root").alias("q2"))
    bearer = bearer.select("id", F.when(F.col("r1") == F.col("r2"), F.col("r1")).when(F.col("r1").isNull() & (F.col("q1") == F.col("q2")), F.col("q1")).alias("root"))
    tree = tree.join(bearer, "id", "left").select("id", F.coalesce("root", "up").alias("root"))

    of = forms.select("typed", "id").join(tree, "id").select("typed", "root")
    named = values.withColumn("typed", F.when(F.col("surname").isNull(), F.concat(F.lit("\u0000"), "name")).otherwise(key)).join(of, "typed", "left").select("name", "n", F.coalesce("root", "typed").alias("root"))
    named = stored(named, "named")
    heads = named.groupBy("root").agg(F.max_by("name", F.struct("n", "name")).alias("entity"), F.count(F.lit(1)).alias("n_variants"))
    return named.join(heads, "root").select("name", "entity", F.col("n").alias("n_rows"), "n_variants")


def same_name_pairs(links: DataFrame) -> DataFrame:
    """(speaker_a, speaker_b): all pairs of spellings of one entity, the smaller by code point first."""
    a, b = links.select(F.col("name").alias("speaker_a"), "entity"), links.select(F.col("name").alias("speaker_b"), "entity")
    return a.join(b, "entity").filter("speaker_a < speaker_b").select("speaker_a", "speaker_b")
