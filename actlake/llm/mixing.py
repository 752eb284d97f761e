"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, all in SQL functions.

1. Targets: the weights' shares of ``share`` times all words; a target stops at ``repeats`` times its source's size
   and what is cut goes to the others by weight, until none is above (``source_targets``).
2. A source's documents stand in pseudo-random order on a line of words, which is walked until the quota (the target,
   rounded) is met, a second time if need be. The walked line is cut into blocks of ``block_words`` words. So every
   source's quota is met to the word, and no document gives more than ``repeats`` times its size.
3. The blocks' numbers per source are split among the output shards by a binary tree: at each node the left half's
   blocks are a multivariate-hypergeometric draw from the node's (``splitting_tree``). This is the law of dealing all
   blocks out at random, with exact shard sizes, and never looks at single blocks.
4. Each shard takes the next run of its source's permuted blocks: disjoint by construction. Inside a shard the blocks
   are ordered by a hash.

Null source is a source of its own, last in order. Null text has size 0. Repeated rows are separate documents.
Empty tables give empty results. Reruns agree: all randomness is hashes of ids and ``seed``.
The number of sources is taken to be small (one row each is ranked in one task); documents, blocks and words are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

SEED = "mix"
MULTIPLIER = 2654435761  # a prime above every number of blocks: b -> b * MULTIPLIER + c is a permutation


def sized(docs: DataFrame) -> DataFrame:
    """Every row with its size, source key and place in its source's order; ``part`` splits hot sources."""
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)))
    return (
        docs.withColumn("size", word_count(F.col("text")))
        .withColumn("no_source", F.col("source").isNull())
        .withColumn("source_key", F.coalesce(F.col("source"), F.lit("")))
        .withColumn("place", order)
        .withColumn("part", F.substring("place", 1, 3))
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: source_size, weight, target, rank (1 for the first by code point, null last)."""
    per = rows.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "source_key")))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = ranked.withColumn("left", left).withColumn("heavy", heavy)
    filled = filled.withColumn("full", F.col("most") * F.col("heavy") <= F.col("left") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("heavy"))).over(every)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight"))
    return filled.withColumn("target", target).select("no_source", "source_key", "source_size", "rank", "weight", "target")


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for how many of ``good`` among ``total`` are in a sample of ``drawn``: inversion of the distribution at ``u``.

    Probabilities are summed within 12 standard deviations of the mean and 24 more; what lies beyond is less than a
    double can hold beside 1. They are scaled by the largest, so that nothing under- or overflows.
    """
    mean = f"({drawn} * {good} / greatest({total}, 1D))"
    spread = f"(12 * sqrt({mean} * (1 - {good} / greatest({total}, 1D)) * greatest({total} - {drawn}, 0D) / greatest({total} - 1, 1D)) + 24)"
    low = f"greatest(0D, {drawn} - ({total} - {good}), floor({mean} - {spread}))"
    high = f"least({good}, {drawn}, ceil({mean} + {spread}))"
    ratio = "ln((h.good - x) * (h.drawn - x) / ((x + 1) * (h.total - h.good - h.drawn + x + 1)))"
    span = "transform(sequence(cast(h.low as bigint), cast(h.high as bigint)), v -> cast(v as double))"
    step = f"if(x < h.high, {ratio}, 0D)"
    peak = f"aggregate({span}, struct(0D as l, 0D as m), (t, x) -> struct(t.l + {step} as l, greatest(t.m, t.l) as m), t -> t.m)"
    mass = f"aggregate({span}, struct(0D as l, 0D as s), (t, x) -> struct(t.l + {step} as l, t.s + exp(t.l - peak) as s), t -> t.s)"
    pick = (
        f"aggregate({span}, struct(0D as l, 0D as s, -1D as k), (t, x) -> struct(t.l + {step} as l, t.s + exp(t.l - peak) as s,"
        " if(t.k < 0 and (t.s + exp(t.l - peak) >= h.u * mass or x >= h.high), x, t.k) as k), t -> t.k)"
    )
    given = f"struct({total} as total, {good} as good, {drawn} as drawn, {u} as u, {low} as low, {high} as high)"
    return _let("h", given, _let("peak", peak, _let("mass", mass, pick)))


def splitting_tree(counts: DataFrame, shards: int) -> DataFrame:
    """Split ``counts`` (rank, blocks) exactly among ``shards`` shards: rows (rank, shard, blocks).

    One row is a node; each level halves every node's shards. Shard sizes differ by the rounding of halves only.
    """
    nodes = counts.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("blocks").cast("double").alias("blocks")))).alias("s")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("wide"), F.col("s.rank").alias("ranks"), F.col("s.blocks").alias("blocks")
    )
    while shards > 1:
        shards = (shards + 1) // 2
        total = F.aggregate("blocks", F.lit(0.0), lambda a, x: a + x)
        nodes = nodes.withColumn("half", F.floor((F.col("wide") + 1) / 2).cast("int")).withColumn("total", total)
        nodes = nodes.withColumn("want", F.when(F.col("wide") > 1, F.floor(F.col("total") * F.col("half") / F.col("wide")).cast("double")).otherwise(F.col("total")))
        # source by source: a draw from what is left, of what is still wanted; each with its own uniform number
        uniform = f"(xxhash64('{SEED}', first, wide, i) & 9007199254740991) / 9007199254740992D"
        sources = f"zip_with(blocks, sequence(1, size(blocks)), (b, i) -> struct(b as b, {uniform} as u))"
        start = "struct(total as total, want as want, cast(array() as array<double>) as got)"
        taken = "struct(a.total - y.b as total, a.want - k as want, concat(a.got, array(k)) as got)"
        chosen = f"aggregate({sources}, {start}, (a, y) -> {_let('k', _hypergeometric('a.total', 'y.b', 'a.want', 'y.u'), taken)}, a -> a.got)"
        nodes = nodes.withColumn("got", F.when(F.size("blocks") > 0, F.expr(chosen)).otherwise(F.col("blocks")))
        rest = F.zip_with("blocks", "got", lambda a, b: a - b)
        left = F.struct(F.col("first"), F.col("half").alias("wide"), F.col("ranks"), F.col("got").alias("blocks"))
        right = F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("wide") - F.col("half")).alias("wide"), F.col("ranks"), rest.alias("blocks"))
        children = F.when(F.col("wide") > 1, F.array(left, right)).otherwise(F.array(F.struct("first", "wide", "ranks", "blocks")))
        nodes = nodes.select(F.explode(children).alias("n")).select("n.*")
    leaf = F.arrays_zip("ranks", "blocks")
    return nodes.select(F.col("first").alias("shard"), F.explode(leaf).alias("e")).select(F.col("e.ranks").alias("rank"), "shard", F.col("e.blocks").cast("long").alias("blocks"))


def dealt_targets(rows: DataFrame, weights: tuple[int, ...], share: float, repeats: int, shards: int, block_words: int) -> DataFrame:
    """``source_targets`` with quota, number of blocks and ``ends``: shard s takes the turns below ends[s] that no earlier shard has."""
    targets = source_targets(rows, weights, share, repeats).withColumn("quota", F.floor(F.col("target") + 0.5))
    targets = targets.withColumn("blocks", F.ceil(F.col("quota") / block_words))
    split = splitting_tree(targets.select("rank", "blocks"), shards)
    ends = split.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("s"))
    ends = ends.select(
        "rank",
        F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["blocks"])).alias("ends"),
    )
    return targets.join(ends, "rank")


def _shard(block: Column) -> Column:
    """The shard of a source's block: its turn in permuted order among the ``ends``."""
    turn = F.pmod(block * F.lit(MULTIPLIER).cast("long") + F.pmod(F.xxhash64(F.lit(SEED), "source_key"), F.col("blocks")), F.col("blocks"))
    return F.size(F.filter("ends", lambda e: e <= turn))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, shards: int = 64, block_words: int = 4096) -> DataFrame:
    """Deal the words of ``docs`` (doc_id, text, source) out to shards. One row per document:

    doc_id, source, size, source_size, target, taken and ``pieces``: array of struct(pass, start, words, shard, block),
    ``start`` being a word's number in the document, ``block`` the block's place in the shard's order.
    """
    rows = sized(docs.select("doc_id", "source", "text")).drop("text")
    targets = dealt_targets(rows, weights, share, repeats, shards, block_words)
    key = ["no_source", "source_key"]
    parts = rows.groupBy(*key, "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key, "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    line = line.join(parts, [*key, "part"]).join(targets, key)
    line = line.withColumn("at", F.col("at") + F.col("base"))

    def of_pass(number: int) -> Column:
        start = F.col("at") + F.col("source_size") * number
        stop = F.least(start + F.col("size"), F.col("quota"))
        first, last = F.floor(start / block_words), F.floor((stop - 1) / block_words)

        def piece(block: Column) -> Column:
            begin = F.greatest(start, block * block_words)
            words = F.least(stop, (block + 1) * block_words) - begin
            return F.struct(F.lit(number).alias("pass"), (begin - start).alias("start"), words.alias("words"), _shard(block).alias("shard"), F.xxhash64(F.lit(SEED), "rank", block).alias("block"))

        return F.when(stop > start, F.transform(F.sequence(first, last), piece)).otherwise(F.array())

    line = line.withColumn("pieces", F.concat(*[of_pass(n) for n in range(repeats)]))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return line.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces")


def shards_of(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The pieces of ``mix`` as rows in their shards, in the shard's shuffled order."""
    rows = mixed.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
    dealt = rows.repartition(partitions, "shard", "block") if partitions else rows.repartition("shard", "block")
    return dealt.sortWithinPartitions("shard", "block", "doc_id", "start")


def whole_documents(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, shards: int = 64, block_words: int = 4096, partition_words: int = 1 << 20
) -> DataFrame:
    """Mix whole documents: each row of ``docs`` as often as the mix takes it (0 to ``repeats`` times), same columns.

    A document is taken once for each pass that reaches its first word before the quota is met, so a source is over
    its quota by less than one document. The line is cut into blocks as in ``mix``; a block's documents are those whose
    first words it holds, in each pass by their places in that pass. The blocks are dealt to the shards by the splitting
    tree. A shard's documents are ordered by a hash; each shard is as many partitions, of consecutive ranges of that hash,
    as hold about ``partition_words`` words each. Documents without words are kept once, in a shard
    by their hash. Rows of equal id and size stand in order of a hash of their texts; which of several equal rows is taken does not matter.
    """
    rows = sized(docs.select("doc_id", "source", "text")).drop("text")
    key = ["no_source", "source_key"]
    parts = rows.groupBy(*key, "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    # written, so that their sizes are known: small ones are then broadcast and texts meet them without a shuffle
    targets = written(dealt_targets(rows, weights, share, repeats, shards, block_words), "llm-mix-targets")
    parts = written(parts.join(targets, key), "llm-mix-parts")
    total = targets.agg(F.sum("source_size")).head()[0] or 0
    pieces = int(total * share) // (shards * partition_words) + 1
    packed = sized(docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")).withColumn("mark", F.xxhash64("text")).drop("text", "source")
    inside = Window.partitionBy(*key, "part").orderBy("place", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    line = packed.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, [*key, "part"])
    line = line.withColumn("at", F.col("at") + F.col("base"))

    def of_pass(number: int) -> Column:
        start = F.col("at") + F.col("source_size") * number
        shard = _shard(F.floor(start / block_words))
        turn = F.xxhash64(F.lit(SEED), F.lit(number), "place", "at")
        taken = F.array(F.struct(shard.alias("shard"), turn.alias("turn")))
        return F.when((F.col("size") > 0) & (start < F.col("quota")), taken).otherwise(F.array())

    turn = F.xxhash64(F.lit(SEED), "place")
    empty = F.array(F.struct(F.pmod(turn, F.lit(shards)).cast("int").alias("shard"), turn.alias("turn")))
    deals = F.when(F.col("size") > 0, F.concat(*[of_pass(n) for n in range(repeats)])).otherwise(empty)
    out = line.select("row", F.explode(deals).alias("deal"))
    # which of the shard's equal ranges of 2 ** 32 high halves the turn falls in
    piece = F.floor((F.shiftright("deal.turn", 32) + F.lit(1 << 31)) * pieces / float(1 << 32)).cast("int")
    out = out.repartitionById(shards * pieces, F.col("deal.shard") * pieces + piece)
    return out.sortWithinPartitions("deal.turn").select("row.*")
