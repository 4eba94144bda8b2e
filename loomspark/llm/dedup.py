"""Operator 2: near-duplicate detection by chosen-path set similarity join over minwise tokens.

Documents with equal shingle sets are one class, found by a fingerprint of the set. Classes have
signatures of minwise tokens, and go down a number of independent trees. At a node every class
goes on to the children of the minwise tokens that the node selects (one coordinate always, a
second one at times, so that the expected number of branches is one over the similarity sought);
similar classes share children, others part.

What is compared at a node: if few classes lie outside the node's largest component of links
found so far, those are compared with all of the node, which settles it. Otherwise up to `PIVOTS`
of them are, and the node branches. A dense group is linked through its pivots this way and then
counts as one component, so its pairs are never listed; a diverse group falls apart by branching.
Pairs whose signatures are alike are confirmed on their full shingle sets, and the confirmed links
make the components by large-star and small-star rounds. Each step is a join or an aggregation by
node; no group is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import BROADCAST_ROWS, LOWER, hashes, join_small, mix, slices, words
from loomspark.sources.tables import written

#: Minwise tokens of a signature; independent trees; classes of a node that are compared with all of it; pivots of a large node.
TOKENS, TREES, FEW, PIVOTS = 64, 12, 256, 4
#: Links of an end that stay together: an end of more is dealt over as many tasks as it has times so many.
HUB = 512
#: Trees that are gone through with one pivot a node before all others.
FIRST = 2
#: Chunks of a node that meet its probes in one task.
STRIP = 16
#: A group of copies of the share 1 / HEAVY of all rows joins by a broadcast.
HEAVY = 1_000
#: Bins of a sketch (a power of two).
BINS = 512
_ODD = np.random.default_rng(11).integers(1, 1 << 62, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(12).integers(1, 1 << 62, TOKENS, dtype=np.uint64)


def shingles(data: np.ndarray, off: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = LOWER[data]
    starts, lengths = words(low, off)
    h = hashes(low, starts, lengths)
    first = np.searchsorted(starts, off)
    powers = [mix(np.array([k + 1], np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1) for k in range(width)]
    whole = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k, p in enumerate(powers):
        whole += h[k : len(whole) + k] * p
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:  # the whole sequence is one shingle, unlike any of `width` words
            out.append(mix(np.array([sum(int(h[a + k]) * int(powers[k][0]) for k in range(b - a)) + int(b - a) * 0x2545F4914F6CDD1D & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens of a set, 32 bits each."""
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        part = (((s[i : i + 4096, None] ^ _ADD) * _ODD) >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, part.min(0), out=out)
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte of the smallest hash in each of BINS equal ranges, 0 where there is none. s is sorted."""
    bins, first = np.unique(s >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(np.int64)] = np.maximum(s[first] & np.uint64(255), 1).astype(np.uint8)
    return out


def sketches(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, its minwise tokens (array of int) and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(batches, limit=1 << 20):
            sets = shingles(data, off, width)
            with np.errstate(over="ignore"):
                one = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
                two = np.array([mix(x ^ np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64) for x in sets], np.uint64)
            tokens = np.stack([signature(x) for x in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, TOKENS * len(sets) + 1, TOKENS, dtype=np.int32)), pa.array(tokens.ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, pa.array([sketch(x).tobytes() for x in sets], pa.binary())],
                ["doc_id", "n_shingles", "one", "two", "tokens", "sketch"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, one long, two long, tokens array<int>, sketch binary")


def _alike(nodes: DataFrame, j: float) -> DataFrame:
    """Of rows (node, settled, members, probes), the pairs of a member with a probe of another component whose sketches don't rule out a similarity of j.

    Bins that are empty in both say nothing; the share of equal ones among the others estimates
    the similarity, and pairs up to four deviations below j go on to be confirmed. Bins sample
    the union of the sets without replacement, so the deviation is less where they hold most of it.
    A pair that meets in several settled nodes is given in the first of them alone.
    """

    def columns(lists: pa.ListArray) -> tuple:
        flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int)
        mine = flat.field("mine")
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(mine).to_numpy(zero_copy_only=False))]).astype(int)
        sketches_ = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        return flat.field("cls").to_numpy(), flat.field("comp").to_numpy(), flat.field("n").to_numpy(), sketches_, mine.flatten().to_numpy(), at, ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 48) for b in batches for i in range(0, b.num_rows, 48)):  # as many pairs of lists at a time
            a_cls, a_comp, a_n, a_bins, a_mine, a_at, a_ends = columns(batch.column("members"))
            b_cls, b_comp, b_n, b_bins, b_mine, b_at, b_ends = columns(batch.column("probes"))
            out: set[tuple[int, int]] = set()
            for i, (node, settled) in enumerate(zip(batch.column("node").to_pylist(), batch.column("settled").to_pylist(), strict=True)):
                a, b = slice(a_ends[i], a_ends[i + 1]), slice(b_ends[i], b_ends[i + 1])
                low, high = np.minimum(a_n[a, None], b_n[None, b]), np.maximum(a_n[a, None], b_n[None, b])
                rows, cols = np.nonzero((a_comp[a, None] != b_comp[None, b]) & (a_cls[a, None] != b_cls[None, b]) & (low >= j * high))
                for k in range(0, len(rows), 16384):
                    r, c = rows[k : k + 16384] + a.start, cols[k : k + 16384] + b.start
                    x, y = a_bins[r], b_bins[c]
                    some = np.maximum(((x | y) > 0).sum(1), 1)
                    whole = np.maximum((a_n[r] + b_n[c]) / (1 + j), some + 1)
                    near = ((x == y) & (x > 0)).sum(1) / some >= j - 4 * np.sqrt(j * (1 - j) / some * (1 - some / whole)) - 1 / some
                    for p, q in zip(r[near], c[near], strict=True):
                        if not settled or node == min(set(a_mine[a_at[p] : a_at[p + 1]].tolist()).intersection(b_mine[b_at[q] : b_at[q + 1]].tolist())):
                            out.add((min(a_cls[p], b_cls[q]), max(a_cls[p], b_cls[q])))
            found = np.array(sorted(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return nodes.mapInArrow(run, "a long, b long")


def _confirm(documents: DataFrame, pairs: DataFrame, numerator: int, width: int) -> DataFrame:
    """Of distinct pairs (a member, b probe), those with 100 * intersection >= numerator * union on full sets."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct())
    few = ids.count() <= 5 * BROADCAST_ROWS  # single ids of 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in shingles(data, off, width)], pa.binary())], ["cls", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good[i] = both and 100 * both >= numerator * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(run, "cls long, set binary"))
    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """cls and comp (the smallest cls reachable) of all ends of links (a, b), by large-star and small-star rounds."""

    def star(edges: DataFrame, n_edges: int, small: bool) -> DataFrame:
        near = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links")).withColumn("m", F.least("u", "m"))
        parts = F.floor((F.col("links") - 1) / F.lit(HUB)) + 1
        if n_edges > HUB:
            # all links have 2 * n_edges ends, so that few can be hubs
            hubs = least.where(F.col("links") > HUB).select("u", parts.alias("parts"))
            near = join_small(near, hubs, ["u"], "left", rows=2 * n_edges // HUB if 2 * n_edges // HUB <= BROADCAST_ROWS else None)
            near = near.withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)))).drop("parts")
            met = near.join(least.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), ["u", "part"])
        else:
            met = near.join(least, "u")
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) if small else met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (out.unionByName(least.select("u", F.col("m").alias("v"))) if small else out).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        n = edges.count()
        # a large star gives a link of either end at most for each that there is
        edges = written(star(star(edges, n, False), 2 * n, True).distinct())
        # stars are left once every end has one root and no root is an end
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty():
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct())


def _join_components(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components so far, joined by further links between classes."""
    if comps is None:
        return written(components(links))
    n = comps.count()
    between = links
    for c in ("a", "b"):
        between = join_small(between, comps.select(F.col("cls").alias(c), F.col("comp").alias(f"{c}_comp")), [c], "left", rows=n)
    merged = written(components(between.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))).select(F.col("cls").alias("comp"), F.col("comp").alias("root")))
    old = join_small(comps, merged, ["comp"], "left").select("cls", F.coalesce("root", "comp").alias("comp"))
    return written(old.unionByName(merged.select(F.col("comp").alias("cls"), F.col("root").alias("comp"))).distinct())


def _node(parent: Column, coordinate: Column) -> Column:
    """The child to which a minwise token leads."""
    return F.xxhash64(parent, coordinate, F.element_at("tokens", (coordinate + 1).cast("int")))


def _children(node: Column, second: int) -> Column:
    """Where a class goes on to from a node: by one minwise token, and by another one at `second` of 100 nodes."""
    coordinate = F.pmod(F.xxhash64(F.lit(1), node), F.lit(TOKENS))
    other = F.pmod(coordinate + 1 + F.pmod(F.xxhash64(F.lit(2), node), F.lit(TOKENS - 1)), F.lit(TOKENS))
    one = F.array(_node(node, coordinate))
    return F.when(F.pmod(F.xxhash64(F.lit(4), node), F.lit(100)) < second, F.concat(one, F.array(_node(node, other)))).otherwise(one)


def near_duplicates(documents: DataFrame, percent: int = 85, width: int = 3, trees: int = TREES, few: int = FEW, deepest: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents.

    Links are pairs of texts with 100 * intersection >= percent * union of their shingle sets.
    Texts without words and null texts have no shingles and are linked with nothing. Rows that
    share a doc_id count as one document in the links; rows with a null doc_id give links to
    nothing, have a null component_id and are kept. Repeated rows each give a row. Other columns
    are ignored; an empty table gives an empty result.

    Nodes that are still unsettled at level `deepest` are settled by comparing all their classes
    that lie outside the largest component with the whole node, however many.
    """
    read = written(sketches(documents, width))
    classes = read.where("doc_id is not null and n_shingles > 0").groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("cls"), F.min("tokens").alias("tokens"), F.min("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes)
    fingerprint = ["one", "two", "n_shingles"]
    # an id that stands in rows of different texts ties them together
    again = written(read.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    comps: DataFrame | None = None
    if not again.isEmpty():
        tied = read.join(again, "doc_id").select("doc_id", *fingerprint).distinct().join(classes.select("cls", *fingerprint), fingerprint)
        comps = _join_components(None, tied.select(F.col("doc_id").alias("a"), F.col("cls").alias("b")).where("a <> b"))
    j = percent / 100
    second = int(100 * (1 / j - 1))

    # The root of each tree selects coordinates of its own: trees are independent.
    order = np.random.default_rng(5).permutation(TOKENS)
    picks = [(t, int(order[(t + trees * k) % TOKENS])) for k in range(2) for t in range(trees) if k == 0 or np.random.default_rng(100 + t).integers(100) < second]
    root = F.array(*[F.struct(_node(F.lit(-1 - t).cast("long"), F.lit(c)).alias("node"), F.lit(t).alias("tree")) for t, c in picks])
    light = classes.select("cls", F.explode(root).alias("r")).select("cls", F.col("r.node").alias("node"), F.col("r.tree").alias("tree"))
    shared = light.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    members = written(light.join(shared, "node"))
    probe = F.struct("cls", "comp", "n", "sketch", "mine")
    tested: DataFrame | None = None
    for level in range(-1, deepest + 1):
        # First the nodes of some trees are linked through a pivot each, so that dense groups are
        # components before their pairs could be listed; then all trees are gone through.
        first, last = level < 0, level == deepest
        with_comp = members.where(F.col("tree") < FIRST) if first else members
        with_comp = with_comp.withColumn("comp", F.col("cls")) if comps is None else with_comp.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        by_comp = with_comp.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c"))
        nodes = by_comp.groupBy("node").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("major"), F.count(F.lit(1)).alias("n_comps")).where("n_comps > 1")
        outside = F.col("n") - F.col("major.c")
        nodes = written(nodes.select("node", F.col("major.comp").alias("major"), "n", outside.alias("outside"), (F.lit(last) | (outside <= (1 if first else few))).alias("settled")))
        if not first and nodes.isEmpty():
            break
        at = join_small(with_comp, nodes, ["node"]).select("cls", F.struct("node", "tree", "comp", "settled", (F.col("comp") == F.col("major")).alias("inner"), F.col("n").alias("n_node"), "outside").alias("at"))
        at = at.groupBy("cls").agg(F.collect_list("at").alias("at"))  # as many as a class has nodes: some for each tree
        mine = F.array_sort(F.transform(F.filter("at", lambda x: x["settled"]), lambda x: x["node"]))
        active = written(at.join(classes.select("cls", F.col("n_shingles").alias("n"), "sketch"), "cls").select("cls", "n", "sketch", mine.alias("mine"), F.explode("at").alias("at")).select("at.*", "cls", "n", "sketch", "mine"))
        # probes: all outside the largest component where they are few (at the last level in lots, however many); else some pivots
        outer = active.where(~F.col("inner"))
        lots = F.pmod(F.xxhash64("cls"), F.ceil(F.col("outside") / F.lit(few))) if last else F.lit(0).cast("long")
        pivot_lot = F.pmod(F.xxhash64(F.lit(3), "comp"), F.lit(1 if first else PIVOTS))
        pivots = outer.where(~F.col("settled")).groupBy("node", pivot_lot.alias("lot")).agg(F.min(F.struct(F.xxhash64("cls").alias("h"), probe.alias("p"))).alias("m"), F.max("n_node").alias("n_node")).select("node", F.lit(0).cast("long").alias("lot"), F.col("m.p").alias("p"), "n_node")
        chosen = outer.where("settled").select("node", lots.alias("lot"), probe.alias("p"), "n_node").unionByName(pivots)
        # the probes of a node with many members go to several tasks
        strips = F.sequence(F.lit(0).cast("long"), F.floor(F.ceil(F.max("n_node") / F.lit(few)) / F.lit(STRIP)))
        probes = chosen.groupBy("node", "lot").agg(F.collect_list("p").alias("probes"), strips.alias("strips")).select("node", "probes", F.explode("strips").alias("strip"))
        lots_of_members = F.pmod(F.xxhash64(F.lit(5), "cls"), F.ceil(F.col("n_node") / F.lit(few)))
        chunks = active.groupBy("node", "settled", lots_of_members.alias("chunk")).agg(F.collect_list(probe).alias("members"))
        met = chunks.withColumn("strip", F.floor(F.col("chunk") / F.lit(STRIP))).join(probes, ["node", "strip"])
        pairs = _alike(met.select("node", "settled", "members", "probes"), j).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)  # no pair is confirmed twice
        comps = _join_components(comps, written(_confirm(documents, pairs, percent, width)))
        if first:
            continue
        # on to children, three levels at once: pivots have met all of their node and stay behind
        rest = active.where(~F.col("settled")).join(pivots.select("node", F.col("p.cls").alias("cls")), ["node", "cls"], "left_anti").join(classes.select("cls", "tokens"), "cls").select("cls", "tree", "tokens", "node")
        children = _children(F.col("node"), second)
        for _ in range(2):
            children = F.flatten(F.transform(children, lambda n: _children(n, second)))
        rest = rest.select("cls", "tree", F.explode(children).alias("node"))
        members = written(rest.select("cls", "tree", "node"))
        if last or members.isEmpty():
            break

    # classes of the documents: the smallest id of each set, then of each component
    ends = classes.select("cls", *fingerprint, "copies")
    if comps is not None:
        ends = ends.join(comps, "cls", "left").withColumn("cls", F.coalesce("comp", "cls")).drop("comp")
    # sets of many copies are few, and their rows don't go to one task; empty sets and rows without an id meet nothing
    documents_ = read.select("doc_id", "n_shingles", "one", "two")
    least = max(1, read.count() // HEAVY)
    heavy = written(ends.where(F.col("copies") >= least).drop("copies"))
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    some = documents_.where(linkable).join(F.broadcast(heavy.withColumnRenamed("cls", "found")), fingerprint, "left")
    light = some.where("found is null").drop("found").join(ends.where(F.col("copies") < least).drop("copies"), fingerprint, "left")
    joined = some.where("found is not null").withColumnRenamed("found", "cls").unionByName(light).unionByName(documents_.where(~linkable).withColumn("cls", F.lit(None).cast("long")))
    own = F.when(F.col("n_shingles") > 0, F.coalesce("cls", "doc_id")).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
