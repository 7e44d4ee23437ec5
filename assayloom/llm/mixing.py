"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Every source is cut into 256 blocks by the hash of the document id. A pass draws the blocks of a source in a
permuted order; passes follow each other until the words of the source's target are drawn, and the last
block is drawn up to a cut. The draws of all sources are split over the output shards by a binary tree: a
node hands half of its draws to its left child, and how many of them come from each source is one
multivariate-hypergeometric draw, made by going through the sources' draws and taking each with probability
(still needed) / (still there). Leaves are shards; each takes its quota of every source from disjoint runs of
that source's permuted draws, and orders its rows by a hash.

Tables besides the documents have one row per source, or one per source and block. No key of a shuffle is a
source alone where documents move: a source of any share is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayloom.llm.rows import free_name, quoted, whole_text
from assayloom.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
SHARD_LEVELS = 4
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _hash(*parts: Column | str) -> Column:
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", F.lit(SEED), *texts).cast("binary"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, key, h, block, size). ``key`` is the source with null as the empty text and "s" before others."""
    source = quoted(source_col).cast("string")
    return docs.select(
        quoted(id_col).alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("key"),
        _hash(F.coalesce(quoted(id_col).cast("string"), F.lit(""))).alias("h"), word_count(whole_text(text_col)).alias("size"),
    ).withColumn("block", F.substring("h", 1, 2))


def targets(blocks: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(key, source, source_size, target) from block sizes: one row per source, so one task orders them.

    Sources in code-point order, null last, take the weights in turn. The level at which sources stop at
    ``most`` times their size is found from running sums over the sources by cap / weight.
    """
    sources = blocks.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "key")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * budget - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(every)["level"]
    return rows.withColumn("chosen", level).select("key", "source", "source_size", F.least("cap", F.col("chosen") * F.col("weight")).alias("target"))


def draws(blocks: DataFrame, goals: DataFrame, passes: int = MOST) -> DataFrame:
    """(key, block, turn, j, size, need): the j-th draw of a source; ``need`` is how many of its words are taken."""
    turns = F.explode(F.array(*[F.lit(t) for t in range(passes)])).alias("turn")
    rows = blocks.where("size > 0").select("key", "block", "size", turns)
    rows = rows.withColumn("order", _hash(F.col("key"), F.col("block"), F.col("turn")))
    by = W.partitionBy("key").orderBy("turn", "order", "block")
    before = F.coalesce(F.sum("size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("from", before).withColumn("j", (F.row_number().over(by) - 1).cast("long"))
    goal = goals.select("key", F.floor(F.col("target") + 0.5).alias("goal"))
    return rows.join(goal, "key").where("from < goal").select("key", "block", "turn", "j", "size", F.least("size", F.col("goal") - F.col("from")).alias("need"))


def shard_quotas(drawn: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """(key, shard, first, quota): runs of draws for each of 2^levels shards, exact over sources and shards.

    The tree's table has one row per node, with one count per source.
    """
    counts = drawn.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("have")).select(F.lit(0).cast("long").alias("node"), "have")
    for level in range(levels):
        nodes = nodes.select(F.lit(level).alias("level"), "node", "have", _left(F.col("have"), level, F.col("node")).alias("left"))
        right = F.zip_with("have", "left", lambda a, b: F.struct(a["key"].alias("key"), (a["n"] - b["n"]).alias("n")))
        child = F.inline(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("have")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("have"))))
        nodes = nodes.select(child)
    quotas = nodes.select(F.col("node").alias("shard"), F.inline("have")).withColumnRenamed("n", "quota")
    before = W.partitionBy("key").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return quotas.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def _left(have: Column, level: int, node: Column) -> Column:
    """One multivariate-hypergeometric draw: half of a node's draws, as counts per source."""
    total = F.aggregate(have, F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    odd = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), node), F.lit(2))
    start = F.struct(
        F.floor((total + odd) / 2).cast("long").alias("need"), total.alias("there"),
        F.array().cast("array<struct<key:string,n:bigint>>").alias("out"),
    )

    def one_source(acc: Column, source: Column) -> Column:
        inner = F.struct(acc["need"].alias("need"), acc["there"].alias("there"), F.lit(0).cast("long").alias("got"))

        def one_draw(a: Column, j: Column) -> Column:
            chance = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), node, source["key"], j), F.lit(1 << 40)) / float(1 << 40)
            take = F.when((j <= source["n"]) & (chance * a["there"] < a["need"]), 1).otherwise(0).cast("long")
            gone = F.when(j <= source["n"], 1).otherwise(0).cast("long")
            return F.struct((a["need"] - take).alias("need"), (a["there"] - gone).alias("there"), (a["got"] + take).alias("got"))

        walk = F.sequence(F.lit(1).cast("long"), F.greatest(source["n"], F.lit(1).cast("long")))
        done = F.aggregate(walk, inner, one_draw)
        return F.struct(
            done["need"].alias("need"), done["there"].alias("there"),
            F.concat(acc["out"], F.array(F.struct(source["key"].alias("key"), done["got"].alias("n")))).alias("out"),
        )

    return F.aggregate(have, start, one_source, lambda acc: acc["out"])


def _cuts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, block, turn, cut, cut_need, cut_size): the hash up to which a partly drawn block is taken.

    Sizes by four more hash digits find the part of the block that holds the cut, so only a 65,536th of a
    block is ordered row by row. Rows that share a hash (repeated ids) are cut in proportion.
    """
    inside = rows.join(edges, ["key", "block"]).select("key", "block", "turn", "need", "h", "size", F.substring("h", 3, 4).alias("sub"))

    def crossing(table: DataFrame, by: str) -> DataFrame:
        before = W.partitionBy("key").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        run = table.withColumn("from", F.coalesce(F.sum("size").over(before), F.lit(0)))
        return run.where((F.col("from") < F.col("need")) & (F.col("from") + F.col("size") >= F.col("need")))

    parts = inside.groupBy("key", "block", "turn", "need", "sub").agg(F.sum("size").alias("size"))
    part = crossing(parts, "sub").select("key", "sub", (F.col("need") - F.col("from")).alias("part_need"))
    last = inside.join(part, ["key", "sub"]).groupBy("key", "block", "turn", "h", F.col("part_need").alias("need")).agg(F.sum("size").alias("size"))
    return crossing(last, "h").select("key", "block", "turn", F.col("h").alias("cut"), (F.col("need") - F.col("from")).alias("cut_need"), F.col("size").alias("cut_size"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST, levels: int = SHARD_LEVELS) -> tuple[DataFrame, DataFrame]:
    """(sized rows, block plan). The block plan has one row per source and block: the source's size and target,
    and the draws of the block, null if there are none."""
    rows = stage_table(sized(docs, id_col, text_col, source_col), "sized")
    blocks = stage_table(rows.groupBy("key", "source", "block").agg(F.sum("size").alias("size")), "blocks")
    goals = stage_table(targets(blocks, weights, budget, most), "targets")
    drawn = stage_table(draws(blocks, goals, most), "draws")
    quotas = shard_quotas(drawn, levels).where("quota > 0")
    shards = quotas.select("key", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("j"))
    edges = drawn.where("need < size").select("key", "block", "turn", "need")
    cuts = _cuts(rows, edges)
    placed = drawn.join(shards, ["key", "j"]).join(cuts, ["key", "block", "turn"], "left")
    taken = F.collect_list(F.struct("turn", "shard", "cut", "cut_need", "cut_size")).alias("drawn")
    every = blocks.select("key", "block").join(goals.select("key", "source_size", "target"), "key")
    return rows, stage_table(every.join(placed.groupBy("key", "block").agg(taken), ["key", "block"], "left"), "plan")


def _taken(size: Column, h: Column, draw: Column) -> Column:
    share = F.least(size, F.floor(draw["cut_need"] * size / draw["cut_size"]))
    return (
        F.when(draw["cut"].isNull() | (h < draw["cut"]), size).when(h == draw["cut"], share).otherwise(F.lit(0)).cast("long")
    )


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of ``docs``.

    Null texts have size 0 and nothing is taken of them. The null source is a source, the last one. Null ids
    share one place in the permutation, as repeated ids do; each row still counts. No row is taken more than
    ``most`` times. An empty table gives no rows. The same rows give the same result on any cluster.
    """
    rows, planned = plan(docs, id_col, text_col, source_col, weights, budget, most)
    joined = rows.join(planned, ["key", "block"])
    words = F.transform(F.col("drawn"), lambda d: _taken(F.col("size"), F.col("h"), d))
    taken = F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST, shard_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """The mixed rows: every draw of a document is one row with all its columns, shuffled inside its shard.

    The one document at the cut of a source gives its first words only; ``length_col``, if given, is set to
    the length of its new text. With ``shard_col`` the shard number is added; rows are laid out by shard
    either way. Rows of size 0 are never drawn.
    """
    planned = plan(docs, id_col, text_col, source_col, weights, budget, most)[1].where("drawn IS NOT NULL")
    names = {n: free_name(docs, n) for n in ("key", "block", "h", "size", "drawn", "draw", "words", "shuffle")}
    source = quoted(source_col).cast("string")
    planned = planned.select(F.col("key").alias(names["key"]), F.col("block").alias(names["block"]), F.col("drawn").alias(names["drawn"]))
    h = _hash(F.coalesce(quoted(id_col).cast("string"), F.lit("")))
    rows = docs.withColumns({names["h"]: h, names["size"]: word_count(whole_text(text_col)), names["key"]: F.coalesce(F.concat(F.lit("s"), source), F.lit(""))})
    rows = rows.withColumn(names["block"], F.substring(names["h"], 1, 2)).join(planned, [names["key"], names["block"]])
    rows = rows.withColumn(names["draw"], F.explode(names["drawn"]))
    rows = rows.withColumn(names["words"], _taken(F.col(names["size"]), F.col(names["h"]), F.col(names["draw"]))).where(F.col(names["words"]) > 0)
    # Chunks of a word and the white space behind it; the first may start with white space.
    chunks = F.split(quoted(text_col), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.rlike(quoted(text_col), F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    head = F.array_join(F.slice(chunks, F.lit(1), (F.col(names["words"]) + lead).cast("int")), "")
    text = F.when(F.col(names["words"]) < F.col(names["size"]), head).otherwise(quoted(text_col))
    draw = F.col(names["draw"])
    shuffle = _hash(draw["shard"], draw["turn"], F.col(names["h"]))
    cut = F.col(names["words"]) < F.col(names["size"])
    length = {length_col: F.when(cut, F.length(head)).otherwise(quoted(length_col))} if length_col else {}
    rows = rows.withColumns({text_col: text, names["shuffle"]: F.struct(draw["shard"], shuffle), **length})
    out = [quoted(c) for c in docs.columns] + ([draw["shard"].alias(shard_col)] if shard_col else [])
    return rows.repartitionByRange(names["shuffle"]).sortWithinPartitions(names["shuffle"]).select(*out)
