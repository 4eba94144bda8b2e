"""Operator 3: mixing sources to target weights, in DataFrame functions only.

Every source gets a target of words and is dealt by a hash into blocks (a power of two). A source is
passed over as many whole times as fit its target; of one more pass it gives the blocks at the head
of a permuted order, and of the next blocks the documents that fit what is left. That makes exact
block quotas. A splitting tree halves the range of output shards again and again and draws for the
left half, without replacement, as many blocks as it has room for: the count of each source is
hypergeometric given those before it, so the counts are multivariate hypergeometric. Leaves get
runs of the permuted blocks of each source that no other leaf gets, and order their documents by a
hash.

Blocks grow with the mixture so that there are at most about `BLOCKS` of them: what is known of
blocks stays small (it is one row's array at the root of the tree), and goes to the documents. The
blocks at the end of a source's target grow too; they are cut into finer ones, and those again,
until the documents among which the end is looked for are about 4 * `FILL_WORDS` words of a source
at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import WORD, join_small
from loomspark.sources.tables import written

#: No document is taken more often.
MOST = 3
#: Blocks of the whole table, about, at most; words of a block and of a shard, at least; blocks of a shard, at least.
BLOCKS, BLOCK_WORDS, SHARD_WORDS, SHARD_BLOCKS = 1 << 16, 256, 1 << 22, 16
#: Words, at least, of the blocks from which the end of a source's target is filled; shards, where there are blocks for them.
FILL_WORDS, SHARDS = 1 << 16, 8
#: Equal rows of a source that stay together when documents are dealt.
MANY = 1_000


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) that hashes its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


def sizes(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (a number of its own), doc_id, source, size (words of the whole text; null: 0), content (its hash), and columns to keep, named keep_."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("content"), *(F.col(c).alias("keep_" + c) for c in keep or []))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, n_docs, ord, weight and target of every source.

    Sources in code-point order, null last, weigh 1, 2, 3 and again; they share all sizes by
    weight, but none gets over MOST times its own size, and what is over goes to the others by
    weight until none is above. Filling all at one level, the sources that stop first are those of
    least size for their weight, so one pass in that order finds who stops.
    The table of sources is small beside the documents (one row each) and ordered in one task.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weighed = by_source.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", (F.col("ord") % 3 + 1).cast("double"))
    most = F.lit(MOST) * F.col("source_size")
    before = Window.orderBy(most / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    filled = (
        weighed.withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum(most).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stops", most * F.col("left_weight") <= F.col("left_words") * F.col("weight"))
    )
    level = F.max(F.when(~F.col("stops"), F.col("left_words") / F.col("left_weight"))).over(whole)
    filled = filled.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    return filled.select("source", "source_size", "n_docs", "ord", "weight", F.when(F.col("stops"), most.cast("double")).otherwise(F.least(most.cast("double"), F.col("weight") * F.col("level"))).alias("target"))


def plan(documents: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with their block and copies; the sources with their quotas.

    Documents: row, doc_id, source, size, source_size, target, block, copies, taken. Sources: source,
    ord, n_blocks, passes (whole ones), head (further blocks, those at the edge included).
    """
    sized = written(sizes(documents, keep))
    by_source = written(targets(sized).coalesce(1))
    n_sources, total = by_source.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    block_words = max(block_words, -(-total // BLOCKS))
    fill = max(FILL_WORDS, SHARD_BLOCKS * block_words)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    # a power of two, so that an odd multiplier permutes the blocks
    n_blocks = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("source_size").cast("double") / F.lit(float(block_words)) + F.lit(1e-9))))).cast("long")
    key = lambda: F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    by_source = by_source.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("n_blocks", n_blocks).withColumn("key", key())
    keyed = sized.withColumn("key", key()).drop("source")
    placed = join_small(keyed, by_source, ["key"], rows=n_sources).withColumn("order", F.xxhash64(F.lit(seed), "key", "content", "size")).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "content", "key"), F.col("n_blocks")))
    odd = F.xxhash64(F.lit(seed + 2), "key").bitwiseOR(F.lit(1))
    placed = placed.withColumn("place", F.pmod(F.pmod(odd, F.col("n_blocks")) * F.col("block") + F.pmod(F.xxhash64(F.lit(seed + 3), "key"), F.col("n_blocks")), F.col("n_blocks")))
    # the head of the further pass: whole blocks while they are well within the rest, then blocks that are looked through
    edge = _edge(placed.select("key", "rest", "place", "size"), "place", "rest", fill, n_sources)
    placed = join_small(placed, edge, ["key"], "left", rows=n_sources)
    at_edge = F.coalesce((F.col("place") > F.col("full_place")) & (F.col("place") <= F.col("last_place")) & (F.col("size") > 0), F.lit(False))
    at_end = _narrowed(placed.where(at_edge).select("row", "key", "content", "order", "place", "size", (F.col("rest") - F.col("words_before")).alias("gap")), 2 * (fill + block_words), n_sources, seed)
    chosen = written(_filled(at_end.where("looked")).select("row", "more").unionByName(at_end.where("not looked").select("row", "more")))
    in_edge = placed.where(at_edge).join(chosen, "row")
    others = placed.where(~at_edge).withColumn("more", F.coalesce((F.col("place") <= F.col("full_place")).cast("int"), F.lit(0)))
    shared = ["row", "doc_id", "source", "ord", "size", "source_size", "target", "passes", "order", "place", "n_blocks", *("keep_" + c for c in keep or []), "more"]
    docs = others.select(*shared).unionByName(in_edge.select(*shared))
    docs = docs.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(1)).withColumn("taken", F.col("copies") * F.col("size"))
    head = F.greatest(F.coalesce("last_place", F.lit(-1)), F.coalesce("full_place", F.lit(-1))) + 1
    quotas = by_source.join(edge, "key", "left").select("key", "source", "ord", "n_blocks", "passes", head.alias("head"))
    return docs, quotas


def _edge(docs: DataFrame, at: str, gap: str, fill: int, n_sources: int) -> DataFrame:
    """key, full_place, last_place and words_before of sources: the last place whose words, with those before, are `fill` within the gap; the last that is looked through; words up to the former."""
    blocks = written(docs.groupBy("key", gap, at).agg(F.sum("size").alias("block_words")).withColumn("lot", F.shiftright(at, 8)))
    lots = blocks.groupBy("key", "lot").agg(F.sum("block_words").alias("lot_words"))
    lots = lots.select("key", "lot", (F.sum("lot_words").over(Window.partitionBy("key").orderBy("lot")) - F.col("lot_words")).alias("before"))
    within = F.sum("block_words").over(Window.partitionBy("key", "lot").orderBy(at))
    blocks = join_small(blocks.withColumn("within", within), lots, ["key", "lot"], rows=n_sources + 2 * BLOCKS // 256).withColumn("upto", F.col("before") + F.col("within"))
    whole, looked = F.col("upto") + fill <= F.col(gap), (F.col("upto") - F.col("block_words") < F.col(gap) + fill) & (F.col(gap) > 0)
    edge = blocks.where(whole | looked).groupBy("key").agg(F.max(F.when(whole, F.col(at))).alias("full_place"), F.max(at).alias("last_place"), F.max(F.when(whole, F.col("upto"))).alias("words_before"))
    full = F.coalesce("full_place", F.lit(-1))
    return written(edge.select("key", full.alias("full_place"), F.when(F.col("last_place") > full, F.col("last_place")).alias("last_place"), F.coalesce("words_before", F.lit(0)).alias("words_before")))


def _narrowed(docs: DataFrame, words: int, n_sources: int, seed: int) -> DataFrame:
    """Documents at the end of their source's target, of about so many words a source, with `more` (1 if taken) and looked (left to be looked through).

    They are dealt into finer blocks: those well within the gap are taken, those far beyond aren't,
    and the ones between are dealt again while they have many words.
    """
    docs, level = docs.withColumns({"more": F.lit(0), "looked": F.lit(True)}), 0
    if words > 4 * FILL_WORDS:
        # equal rows are dealt alike however the table is partitioned, unless there are very many of them
        many = written(docs.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).drop("n").withColumn("many", F.lit(True)))
        docs = join_small(docs, many, ["key", "content"], "left").withColumn("apart", F.when(F.col("many"), F.col("row")).otherwise(0)).drop("many")
    while words > 4 * FILL_WORDS:
        block_words = max(FILL_WORDS // SHARD_BLOCKS, -(-words // BLOCKS))
        fill = max(FILL_WORDS, SHARD_BLOCKS * block_words)
        n = max(1, -(-words // block_words))
        docs = written(docs.withColumn("fine", F.pmod(F.xxhash64(F.lit(seed + 6 + level), "content", "apart"), F.lit(n).cast("long"))))
        edge = _edge(docs.where("looked").select("key", "gap", "fine", "size"), "fine", "gap", fill, n_sources)
        docs = join_small(docs, edge, ["key"], "left", rows=n_sources)
        taken_, between = F.col("fine") <= F.col("full_place"), (F.col("fine") > F.col("full_place")) & (F.col("fine") <= F.col("last_place"))
        more = F.when(F.col("looked"), F.coalesce(taken_, F.lit(False)).cast("int")).otherwise(F.col("more"))
        docs = docs.withColumns({"more": more, "gap": F.col("gap") - F.coalesce("words_before", F.lit(0)), "looked": F.col("looked") & F.coalesce(between, F.lit(False))}).drop("fine", "full_place", "last_place", "words_before")
        words, level = 2 * (fill + block_words), level + 1
    return docs


def _filled(in_edge: DataFrame) -> DataFrame:
    """`more` is 1 for the documents that fill the gap of their source: three of four in order while they fit, then of all others that fit what is left the largest, and so on, so that small ones come last and fill it."""
    source = Window.partitionBy("key")
    order = lambda *by: source.orderBy(*by, "place", "order", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for by in ((), *[(F.desc("size"),)] * 4):
        fits = (F.col("more") == 0) & (F.col("size") <= F.col("gap")) & (F.lit(bool(by)) | (F.pmod("order", F.lit(4)) > 0))
        in_edge = in_edge.withColumn("until", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order(*by))).withColumn("now", (fits & (F.col("until") <= F.col("gap"))).cast("int"))
        in_edge = in_edge.withColumn("gap", F.col("gap") - F.sum(F.col("now") * F.col("size")).over(source)).withColumn("more", F.col("more") + F.col("now"))
    return in_edge


def shard_counts(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """shard, ord and n (blocks of that source): leaves of the splitting tree.

    A row is a node: its range of shards and its count of each source. Nodes are split at once,
    level by level; the draws of a node are folds over its blocks, one uniform number each.
    """
    total = F.col("passes") * F.col("n_blocks") + F.col("head")
    root = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), total.cast("long").alias("n")))).alias("counts")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.transform("counts", lambda c: c["n"]).alias("counts"), F.transform("counts", lambda c: c["ord"]).alias("ords"))
    node, depth = root, 0
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    while (1 << depth) < shards:
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("long")
        node = node.withColumn("mid", mid).withColumn("room", F.floor(add(F.col("counts")) * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long"))

        def draw(state: Column, count: Column) -> Column:
            # hypergeometric: of `room` places among `left` blocks, those that fall on this source's `count`
            def one(urn: Column, i: Column) -> Column:
                hit = (_uniform(F.lit(seed), F.col("lo"), F.col("hi"), F.size(state["taken"]), i) * urn["left"] < urn["room"]).cast("long")  # noqa: B023
                return F.struct((urn["left"] - 1).alias("left"), (urn["room"] - hit).alias("room"), (urn["hits"] + hit).alias("hits"))

            start = F.struct(state["left"].alias("left"), state["room"].alias("room"), F.lit(0).cast("long").alias("hits"))
            urn = F.aggregate(F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>")), start, one)
            return F.struct(urn["left"].alias("left"), urn["room"].alias("room"), F.concat(state["taken"], F.array(urn["hits"])).alias("taken"))

        start = F.struct(add(F.col("counts")).alias("left"), F.col("room").alias("room"), F.array().cast("array<bigint>").alias("taken"))
        node = node.withColumn("taken", F.aggregate("counts", start, draw)["taken"])
        left = F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("taken").alias("counts"))
        right = F.struct(F.col("mid").alias("lo"), F.col("hi"), F.zip_with("counts", "taken", lambda a, b: a - b).alias("counts"))
        halves = F.when(F.col("hi") - F.col("lo") > 1, F.array(left, right)).otherwise(F.array(F.struct("lo", "hi", "counts")))
        node = written(node.select(F.explode(halves).alias("half"), "ords").select("half.*", "ords"))
        depth += 1
    return node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("ords", "counts")).alias("c")).select("shard", F.col("c.ords").alias("ord"), F.col("c.counts").alias("n"))


def mix(documents: DataFrame, seed: int = 0, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """The documents with what the mixture takes of them, the mixture itself, its number of shards and its words.

    Documents, one row for each of the table's: row (a number of its own), doc_id, source (null
    too), size, source_size, target, copies, taken (copies times size). Mixture, a row for each
    time a document is taken: row, doc_id, copy (from 0), shard and position (its order within
    the shard), and columns of the table to keep, named keep_.

    Null texts have size 0; a null source is a source; rows with a null doc_id and repeated rows
    are documents like others. Documents of size 0 are kept once and take 0 words; a source
    without words has target 0. An empty table gives empty tables. Other columns are ignored.
    Each source's words come within a document of its target, never over.
    """
    docs, quotas = plan(documents, seed, keep=keep)
    docs = docs if keep else written(docs)
    quotas = written(quotas)
    about = quotas.agg(F.coalesce(F.sum(F.col("passes") * F.col("n_blocks") + F.col("head")), F.lit(0)).alias("blocks")).first()
    words = docs.agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]
    shards = max(1, min(about["blocks"] // SHARD_BLOCKS, max(SHARDS, -(-words // SHARD_WORDS))))
    leaves = shard_counts(quotas, shards, seed)
    run = Window.partitionBy("ord").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = leaves.withColumn("start", F.coalesce(F.sum("n").over(run), F.lit(0))).where("n > 0")
    drawn = runs.select("shard", "ord", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at"))
    # whole passes stand one after another in a source's permuted blocks, then the further pass
    each = docs.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("at", F.col("copy") * F.col("n_blocks") + F.col("place"))
    # what no leaf draws is in no shard: a wrong tree shows in the counts
    out = join_small(each.where("size > 0"), drawn, ["ord", "at"], rows=about["blocks"])
    # documents without words may stand past the last block drawn
    none = each.where("size = 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 5), "order", "row"), F.lit(shards)))
    columns = ["row", "doc_id", "copy", F.col("shard"), F.xxhash64(F.lit(seed + 4), "copy", "order").alias("position"), *("keep_" + c for c in keep or [])]
    return docs, out.select(*columns).unionByName(none.select(*columns)), shards, words


def taken(documents: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and shards (number of output shards a document went to), counted in the mixture."""
    docs, mixture, *_ = mix(documents, seed)
    counted = mixture.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("shards"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return docs.join(counted, "row", "left").select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), F.coalesce("shards", F.lit(0)).alias("shards"))


def take(documents: DataFrame, seed: int = 0) -> DataFrame:
    """The documents, each row as often as the mixture takes it, with all their columns: shard after shard, shuffled within.

    Texts are shuffled once, by shard; shards of more than about SHARD_WORDS words are cut into
    parts along their order, so that no task gets more.
    """
    _, mixture, shards, words = mix(documents, seed, keep=documents.columns)
    parts = max(1, -(-words // (shards * SHARD_WORDS)))
    part = F.floor(F.shiftrightunsigned(F.col("position"), 11).cast("double") / F.lit(float(1 << 53)) * parts)
    ordered = mixture.withColumn("part", part).repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", F.shiftrightunsigned(F.col("position"), 11), "row")
    return ordered.select(*(F.col("keep_" + c).alias(c) for c in documents.columns))
