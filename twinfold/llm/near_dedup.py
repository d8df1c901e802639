"""Near-duplicates by SetSketch registers, confirmed on whole shingle sets.

1. Every text becomes its set of word shingles, a 128-bit fingerprint of that set and a sketch. Equal sets are one node.
2. Nodes that agree in a band of registers share a bucket. With 40 bands of 5 registers two sets at similarity 0.8 miss
   each other with a probability of 0.672 ** 40, about 1e-7.
3. Elements that no other node of any shared bucket has bound what a node can share: two sets x and y with u and v such
   elements are similar only if 9 * (x - u) and 9 * (y - v) are 4 * (x + y) or more. And similar sets differ in a ninth of
   x + y elements at most, so that of 512 parity bits of their elements no more can differ. Both bounds are exact, and
   they take most of those out that were edited too far to be linked.
4. In each bucket one node, the hub, is paired with those that are not yet in its component: the node whose buckets hold
   most others, which is the middle of a cloud of near copies. A pair is compared by sketch (likelihood) and, if it may be
   similar, on its whole sets. Links join components, and a bucket whose nodes are all in one component is done.
5. What is left goes on with GROWTH times as many hubs in each round, drawn by hash; hubs have met all others and leave. A
   bucket of so few nodes, or so many hubs, that its pairs are PAIRS_PER_ENTRY a node or less is compared pair by pair and
   done. So the number of rounds is at most the logarithm, to base GROWTH, of the largest bucket. Large buckets are dealt
   out in blocks, each block of nodes with each block of hubs, so that no task has a whole one.

No pair of a shared bucket is left out unless a chain of confirmed links joins both already. A group of n copies costs
about n pairs, not n * n. Every step is a join or an aggregation; the driver sees counts only.

Edge cases: a null or empty text, or one without words, has an empty set and is alone. A text of fewer than 4 words is one
shingle. A null id takes part but never names a component that has ids. Rows with one id and different texts are judged
by their own texts; of rows with one id and no words, and of rows that are equal in id and text, ``dedup`` keeps one. Other
columns pass through. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm import sketch_batches
from twinfold.llm.components import components, extended
from twinfold.llm.frames import Scratch, col, free_name, small_batches

#: Pairs for each node of a bucket, up to which all of them are compared once its hubs have met the others.
PAIRS_PER_ENTRY = 32
#: How many times more hubs each round has.
GROWTH = 8
#: Nodes, or hubs, of one bucket in one block.
BLOCK = 4096
#: Ids, or pairs, up to which they are broadcast (some 100 bytes each).
BROADCAST_IDS = 200_000

_ODD = sketch_batches.ODD


def _differ(a: str, b: str) -> Column:
    """Parity bits in which two sides differ, given how their columns are named."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a.format(p)).bitwiseXOR(F.col(b.format(p)))) for p in _ODD])


def _fits(n: Column, own: Column, m: Column, their: Column) -> Column:
    """Whether sets of sizes n and m may be similar, of which own and their elements are in no other set."""
    return (100 * F.least(n, m) >= 80 * F.greatest(n, m)) & (9 * (n - own) >= 4 * (n + m)) & (9 * (m - their) >= 4 * (n + m))


def _seal(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


class Search:
    """One run over a table of (id, text). ``rounds`` counts those it took."""

    def __init__(self, docs: DataFrame):
        self.docs, self.scratch, self.rounds = docs, Scratch(docs.sparkSession, "near-dedup"), 0
        small_batches(docs.sparkSession)

    @classmethod
    def of(cls, docs: DataFrame, text_col: str, id_col: str) -> Search:
        return cls(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")))

    def run(self) -> DataFrame:
        """id, seal, n, root, component: one row for each row of the table."""
        scratch = self.scratch
        prints = scratch.save(self.docs.select("id", _seal(F.col("text")).alias("seal"), F.arrow_udf(sketch_batches.prints, sketch_batches.PRINT)("text").alias("p")).select("id", "seal", "p.*"))
        some = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "seal")).alias("some")  # a row that has the text
        nodes = scratch.save(prints.filter("n > 0").groupBy("node").agg(some, F.first("n").alias("n"), F.first("sketch").alias("sketch"), *[F.first(p).alias(p) for p in _ODD]))
        shared = self.shared(nodes)
        self.nodes = scratch.save(nodes.join(shared.select("node").distinct(), "node", "left_semi"))
        self.texts = self.texts_of_nodes()
        hopeful = self.hopeful(shared)
        scratch.drop(shared)
        roots = self.links(hopeful)
        ranked = scratch.save(nodes.select("node", F.col("some.id").alias("rep")).join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")))
        named = scratch.save(ranked.groupBy("root").agg(F.min("rep").alias("component")))
        named = scratch.save(ranked.join(named, "root").select("node", "root", "component"))
        scratch.drop_but(prints, named)
        found = prints.select("id", "seal", "n", "node").join(named, "node", "left")
        return found.select("id", "seal", "n", "root", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))

    def shared(self, nodes: DataFrame) -> DataFrame:
        """bucket, node, n: of buckets with two nodes or more."""
        entries = self.scratch.save(nodes.select("node", "n", F.explode(F.arrow_udf(sketch_batches.bands, "array<bigint>")("sketch")).alias("bucket")))
        several = self.scratch.save(entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket"))
        kept = self.scratch.save(entries.join(several, "bucket", "left_semi").select("bucket", "node", "n"))
        self.scratch.drop(entries, several)
        return kept

    def texts_of_nodes(self) -> DataFrame:
        """node, text: one text for each node that shares a bucket."""
        wanted, n = self.nodes.select("node", "some.id", "some.seal"), self.nodes.count()
        wanted = wanted.select("node", F.col("id").alias("of"), F.col("seal").alias("like"))
        wanted = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
        texts = self.docs.withColumn("seal", _seal(F.col("text")))
        found = self.scratch.save(texts.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("seal") == F.col("like"))).select("node", "text"))
        return found if found.count() == n else self.scratch.save(found.dropDuplicates(["node"]))  # rows that repeat

    def hopeful(self, shared: DataFrame) -> DataFrame:
        """bucket, node, n, own, size: the entries that some other node of the bucket may be similar to; size is the bucket's."""
        start = self.scratch.count
        # a node by two hashes, which can be told apart where one of them could not, and fit aggregates of whole numbers
        elements = self.texts.select(F.xxhash64("node").alias("of"), F.xxhash64("node", F.lit(1)).alias("and_of"), F.explode(F.arrow_udf(sketch_batches.elements, "array<bigint>")("text")).alias("element"))
        alone = elements.groupBy("element").agg(F.count("*").alias("n"), F.min("of").alias("of"), F.min("and_of").alias("and_of")).filter("n = 1")
        own = self.scratch.save(alone.groupBy("of", "and_of").agg(F.count("*").alias("own")))
        sized = shared.withColumn("of", F.xxhash64("node")).withColumn("and_of", F.xxhash64("node", F.lit(1))).join(own, ["of", "and_of"], "left").select("bucket", "node", "n", F.coalesce("own", F.lit(0)).alias("own"))
        left = self.scratch.save(sized.filter("5 * own <= n"))  # else not even a subset of 4/5 is left
        least = self.scratch.save(left.groupBy("bucket").agg(F.min("n").alias("least"), F.count("*").alias("size")).filter("size > 1"))
        hopeful = self.scratch.save(left.join(least, "bucket").filter("9 * (n - own) >= 4 * (n + least)").select("bucket", "node", "n", "own", "size"))
        self.scratch.drop_but(hopeful, since=start)
        return hopeful

    @staticmethod
    def sides(pairs: DataFrame, of: Callable[[str], DataFrame]) -> DataFrame:
        """The pairs with what ``of`` has for a and for b. Few pairs go to the table, many meet it by key."""
        if pairs.count() > BROADCAST_IDS:
            return pairs.join(of("a"), "a").join(of("b"), "b")
        sent = F.broadcast(pairs)
        return of("a").join(sent, "a").join(of("b").join(sent, "b"), ["a", "b"])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that are linked."""
        side = lambda x: self.nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", *_ODD)])
        text = lambda x: self.texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        close = self.sides(pairs, side).filter(9 * _differ("{}_a", "{}_b") <= F.col("n_a") + F.col("n_b"))
        likely = self.scratch.save(close.filter(F.arrow_udf(sketch_batches.may_link, "boolean")("n_a", "n_b", "sketch_a", "sketch_b")).select("a", "b"))
        found = self.scratch.save(self.sides(likely, text).filter(F.arrow_udf(sketch_batches.are_linked, "boolean")("text_a", "text_b")).select("a", "b"))
        self.scratch.drop(likely)
        return found

    def by_centres(self, live: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of each bucket's centre with the others, and the entries without the centres."""
        scratch, start = self.scratch, self.scratch.count
        weight = scratch.save(live.groupBy("node").agg(F.sum("size").alias("weight")))
        hubs = live.join(weight, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n", "own"), F.struct("weight", "node")).alias("h"))
        hubs = scratch.save(hubs.select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.own").alias("hub_own")))
        met = live.join(hubs, "bucket").filter(F.col("node") != F.col("hub"))
        met = scratch.save(met.select("bucket", "node", "n", "own", "hub", _fits(*map(F.col, ("n", "own", "hub_n", "hub_own"))).alias("fits")))
        pairs = scratch.save(met.filter("fits").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
        scratch.drop_but(met, pairs, since=start)
        return pairs, met.select("bucket", "node", "n", "own")

    def by_hubs(self, live: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of that many hubs a bucket, or all, with the others, and the entries of nodes that were no hubs."""
        size, node = F.col("size"), F.col("node")
        drawn = F.shiftrightunsigned(F.xxhash64(F.lit(hubs), node), 11) / float(1 << 53) < hubs / size
        live = live.withColumn("hub", (size - 1 <= 2 * PAIRS_PER_ENTRY) | (size <= hubs) | drawn)
        place = lambda blocks: F.pmod(F.xxhash64(F.lit("block"), node), blocks)
        each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
        blocks = F.ceil(size / F.lit(BLOCK))
        few = F.when(size - 1 <= 2 * PAIRS_PER_ENTRY, 1).otherwise(F.ceil(F.least(size, F.lit(hubs)) / F.lit(BLOCK))).cast("long")
        met = live.withColumns({"i": place(blocks), "few": few}).withColumn("j", each(F.col("few"))).drop("few", "size")
        own = ("node", "n", "own", "label", *_ODD)
        hub = live.filter("hub").select("bucket", *[F.col(c).alias(f"hub_{c}") for c in own], place(few).alias("j"), each(blocks).alias("i"))
        once = ~F.col("hub") | (node < F.col("hub_node"))
        fits = (F.col("label") != F.col("hub_label")) & once & _fits(*map(F.col, ("n", "own", "hub_n", "hub_own"))) & (9 * _differ("{}", "hub_{}") <= F.col("n") + F.col("hub_n"))
        pairs = met.join(hub, ["bucket", "i", "j"]).filter(fits).select(F.col("node").alias("a"), F.col("hub_node").alias("b")).distinct()
        return self.scratch.save(pairs), live.filter("not hub").select("bucket", "node", "n", "own")

    def links(self, entries: DataFrame) -> DataFrame:
        """node, root of each node that is linked to a smaller one."""
        scratch, start = self.scratch, self.scratch.count
        roots, left, live = None, entries, entries
        for self.rounds in count():
            if self.rounds:
                label = F.coalesce("root", "node") if roots is not None else F.col("node")
                labelled = scratch.save((left.join(roots, "node", "left") if roots is not None else left).select(*left.columns, label.alias("label")))
                hashes = F.xxhash64("label"), F.xxhash64(F.lit(1), "label")
                differ = reduce(lambda x, y: x | y, [F.min(h) != F.max(h) for h in hashes])
                sizes = scratch.save(labelled.groupBy("bucket").agg(F.count("*").alias("size"), differ.alias("open")).filter("open").select("bucket", "size"))
                open_ = scratch.save(labelled.join(sizes, "bucket"))
                live = scratch.save(open_.join(self.nodes.select("node", *_ODD), "node"))  # few are left by now, and the bits rule most pairs out
                scratch.drop_but(roots, live, since=start)
            if live.isEmpty():
                return roots if roots is not None else entries.select("node", F.col("node").alias("root")).limit(0)
            pairs, left = self.by_hubs(live, GROWTH**self.rounds) if self.rounds else self.by_centres(live)
            more = self.confirmed(pairs)
            if not more.isEmpty():
                roots = components(more, scratch) if roots is None else extended(roots, more, scratch)


def classes(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id, kept: one row for each document."""
    found = Search.of(docs, text_col, id_col).run()
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each class, with its own columns.

    Rows are known by id and text. Of each class one such key stays, and the others go; a key that stays and has several
    rows loses all but one.
    """
    scratch, search = Scratch(docs.sparkSession, "near-dedup-kept"), Search.of(docs, text_col, id_col)
    found = search.run()
    # rows without words are in no class: those with an id stay once, the others all
    alone = F.when(F.col("n") == 0, F.struct("id"))
    keys = found.filter("n > 0 or id is not null").groupBy("id", "seal", "root", alone.alias("alone"), "component").agg(F.count("*").alias("rows"))
    keys = scratch.save(keys)
    search.scratch.drop_but()
    first = scratch.save(keys.filter(F.col("id").eqNullSafe(F.col("component"))).groupBy("root", "alone").agg(F.min(F.struct("id", "seal")).alias("first")))
    # one row of each class is left in ``first``; the keys that go are those that are first of no class
    named = first.select(F.col("first.id").alias("id"), F.col("first.seal").alias("seal"), F.lit(True).alias("stays"))
    judged = keys.select("id", "seal", "rows").alias("k").join(named.alias("f"), F.expr("k.id <=> f.id and k.seal = f.seal"), "left")
    judged = scratch.save(judged.select("k.id", "k.seal", "k.rows", F.col("stays").isNotNull().alias("stays")).filter("not stays or rows > 1"))
    own, seal, like, stays = (free_name(docs, x) for x in ("id", "seal", "like", "stays"))
    n = judged.count()
    scratch.drop(keys, first)
    gone = judged.select(F.col("id").alias(own), F.col("seal").alias(like), F.col("stays").alias(stays))
    gone = F.broadcast(gone) if n <= BROADCAST_IDS else gone
    sealed = docs.withColumn(seal, _seal(col(text_col).cast("string")))
    out = sealed.join(gone, col(id_col).eqNullSafe(col(own)) & (col(seal) == col(like)), "left")
    kept = out.filter(col(stays).isNull()).select(*[col(c) for c in docs.columns])
    if judged.filter("stays").isEmpty():
        return kept
    again = out.filter(col(stays)).dropDuplicates([id_col, seal]).select(*[col(c) for c in docs.columns])
    return kept.unionByName(again)
