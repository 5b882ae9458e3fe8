"""Reachability over chains.

An edge is *inner* where its source has no other out-edge and its target no other in-edge. Inner edges form chains, of which a long
path mostly consists. Path doubling gives every node its chain and its place in it in as many rounds as the logarithm of the
longest chain, each a join of a row a node of theirs with itself; counts along a chain are doubled with it, so no chain has to fit into a task.
What is left is a graph of chains: its edges lead from a chain's last node to the first node of another (or, in a ring,
the same). Searches walk that graph only, with the chains' lengths as weights, and their answers are spread over the chains' nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.schema import SINK
from tracewarden.sources.shared import measured, removed, written

#: Binary logarithm of a sketch's registers: 12 for a standard error of some 1.6 %.
PRECISION = 12
#: Tables of pairs that are put into one.
TABLES = 10


def _doubled(first: DataFrame, most: int, least: bool = False) -> tuple[DataFrame, int]:
    """Pointers (id, at, hops, sinks) jumped to their ends, and how many still move after jumps of ``most`` steps: those in rings.

    ``sinks`` is summed over the nodes from ``id`` up to ``at``, ``at`` not included; with ``least``, ``low`` is the least id among them.
    """
    state, steps = written(first, "pointers"), 1
    while True:
        further = state.select(F.col("id").alias("to"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("sinks").alias("more_sinks"), *[F.col("low").alias("next_low")] * least)
        met = state.join(further, F.col("at") == F.col("to"))
        lows = [F.least("low", "next_low").alias("low")] * least
        new, told = measured(met.select("id", F.col("next").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("sinks") + F.col("more_sinks")).alias("sinks"), (F.col("more") > 0).alias("moved"), *lows), "pointers", moved=F.count_if("moved"))
        removed(state)
        state, steps = new, 2 * steps
        if not told["moved"] or steps > 2 * most:
            return state, told["moved"] or 0


@dataclass
class Chains:
    """``members`` (id, chain, pos, upto, flag), a row a node: ``flag`` is 1 for a sink, ``upto`` counts sinks up to the node;
    ``chains`` (chain, size, sinks); ``links`` (chain, to, size, sinks, goes), with those of ``to`` and whether edges may lead on from there. A
    chain is named by its first node; nodes without inner edges are chains of their own, and no step over chains looks at them."""

    members: DataFrame
    chains: DataFrame
    links: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, forward: bool = True) -> Chains:
        """The chains of a graph, or of its reverse. Edges to missing nodes and to the node itself don't count."""
        a, b = ("src", "dst") if forward else ("dst", "src")
        ids = nodes.select("id", (F.col("type") == SINK).cast("long").alias("flag"))
        goes = edges.select(F.col(a).alias("id")).distinct().withColumn("goes", F.lit(True))
        ends = ids.join(goes, "id", "left").select(F.col("id").alias("dst"), "flag", F.coalesce("goes", F.lit(False)).alias("goes"))
        known = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src <> dst").join(ends, "dst")
        known = known.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        # neighbours in a sorted table tell copies of an edge and a node's only edge, whose number is of no interest
        outward, inward = Window.partitionBy("src").orderBy("dst"), Window.partitionBy("dst").orderBy("src")
        only = lambda c, w: F.lag(c).over(w).isNull() & F.lead(c).over(w).isNull()
        known = known.withColumn("again", F.coalesce(F.lag("dst").over(outward) == F.col("dst"), F.lit(False))).filter("NOT again").drop("again")
        known = known.withColumn("inner", only("dst", outward)).withColumn("inner", F.col("inner") & only("src", inward))
        known = written(known, "links")
        inner = known.filter("inner")
        heads = inner.select(F.col("src").alias("id")).join(inner.select(F.col("dst").alias("id")), "id", "left_anti").join(ids, "id")
        still, moves = F.lit(0).cast("long"), F.lit(1).cast("long")
        first = inner.select(F.col("dst").alias("id"), "flag", F.col("src").alias("at"), moves.alias("hops"), F.col("flag").alias("sinks"))
        first, told = measured(first.unionByName(heads.select("id", "flag", F.col("id").alias("at"), still.alias("hops"), still.alias("sinks"))), "first", n=F.count(F.lit(1)))
        placed, open_ = _doubled(first.drop("flag"), told["n"] or 1)
        rings = None
        if open_:  # rings: each is cut before its least node
            ring = written(first.join(placed.filter("moved").select("id"), "id", "left_semi"), "rings")
            low, _ = _doubled(ring.drop("flag").withColumn("low", F.col("id")), open_, least=True)
            cut = ring.join(low.select("id", "low"), "id").withColumn("head", F.col("id") == F.col("low"))
            cut = cut.select("id", F.when(F.col("head"), F.col("id")).otherwise(F.col("at")).alias("at"), F.when(F.col("head"), 0).otherwise(F.col("hops")).cast("long").alias("hops"), F.when(F.col("head"), 0).otherwise(F.col("sinks")).cast("long").alias("sinks"))
            rings = cut.filter("head").select(F.col("id").alias("chain"), F.col("id").alias("to"), F.lit(True).alias("goes"))
            placed = placed.filter("NOT moved").select("id", "at", "hops", "sinks").unionByName(_doubled(cut, open_)[0].select("id", "at", "hops", "sinks"))
        heads = first.select(F.col("id").alias("chain"), F.col("flag").alias("head_flag"))
        linked = placed.select("id", F.col("at").alias("chain"), F.col("hops").alias("pos"), "sinks").join(heads, "chain").join(first.select("id", "flag"), "id")
        linked = written(linked.select("id", "chain", "pos", (F.col("sinks") + F.col("head_flag")).alias("upto"), "flag"), "members")
        alone = written(ids.join(linked.select("id"), "id", "left_anti").select("id", F.col("id").alias("chain"), still.alias("pos"), F.col("flag").alias("upto"), "flag"), "members")
        long = written(linked.groupBy("chain").agg((F.max("pos") + 1).alias("size"), F.max("upto").alias("sinks"), F.max_by("id", "pos").alias("tail")), "chains")
        # other edges lead from a chain's last node to a chain's first one; a ring's cut edge leads to its own
        links = known.filter("NOT inner").join(long.select(F.col("tail").alias("src"), "chain"), "src", "left")
        links = links.select(F.coalesce("chain", "src").alias("chain"), F.col("dst").alias("to"), "flag", "goes")
        links = links if rings is None else links.unionByName(rings.withColumn("flag", still))
        links = links.join(long.select(F.col("chain").alias("to"), "size", "sinks"), "to", "left")
        links = links.select("chain", "to", F.coalesce("size", moves).alias("size"), F.coalesce("sinks", "flag").alias("sinks"), "goes")
        chains = long.drop("tail").unionByName(alone.select("chain", moves.alias("size"), F.col("flag").alias("sinks")))
        return cls(linked.unionByName(alone), chains, written(links, "links"))

    def covered(self, roots: DataFrame) -> DataFrame:
        """(root, chain, size, sinks): the chains that each root chain's end leads to. One job a level of the graph of chains; a level adds the pairs
        that are new, and those from which nothing leads on aren't looked at again."""
        columns, kept = ("root", "chain", "size", "sinks", "goes"), []
        begun = roots.select(F.col("chain").alias("root")).distinct().join(self.links, F.col("root") == F.col("chain")).select("root", F.col("to").alias("chain"), *columns[2:])
        fresh, told = measured(begun, "covered", n=F.count_if("goes"))
        seen = fresh
        while told["n"]:
            step = fresh.filter("goes").select("root", F.col("chain").alias("at")).join(self.links.withColumnRenamed("chain", "at"), "at").select("root", F.col("to").alias("chain"), *columns[2:])
            new = step.dropDuplicates(["root", "chain"]).join(seen.select("root", "chain"), ["root", "chain"], "left_anti")
            fresh, told = measured(new.select(*columns), "covered", n=F.count_if("goes"))
            kept.append(fresh)
            seen = seen.unionByName(fresh)
            if len(kept) == TABLES:
                seen, kept = written(seen, "covered"), []
        return seen.drop("goes")

    def spread(self, roots: DataFrame) -> DataFrame:
        """(root, chain, hops): the chains that each root chain's end leads to, with the least number of edges from there to
        their first node. One job a level of the graph of chains; only improved rows go on."""
        sizes = self.chains.select("chain", F.col("size").alias("step"))
        out = self.links.select("chain", "to").join(sizes, "chain")
        known, told = measured(roots.select(F.col("chain").alias("root")).distinct().join(self.links, F.col("root") == F.col("chain")).select("root", F.col("to").alias("chain"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("fresh")), "spread", n=F.count(F.lit(1)))
        count = told["n"]
        while count:
            step = known.filter("fresh").join(out, "chain").groupBy("root", F.col("to").alias("chain")).agg(F.min(F.col("hops") + F.col("step")).alias("new"))
            met = known.select("root", "chain", "hops").join(step, ["root", "chain"], "full")
            better = F.col("new").isNotNull() & (F.col("hops").isNull() | (F.col("new") < F.col("hops")))
            table, told = measured(met.select("root", "chain", F.when(better, F.col("new")).otherwise(F.col("hops")).alias("hops"), better.alias("fresh")), "spread", n=F.count_if("fresh"))
            removed(known)
            known, count = table, told["n"]
        return known.select("root", "chain", "hops")

    def _started(self, starts: DataFrame) -> DataFrame:
        """(source_id, root, pos, upto, flag, size, sinks) of the starts (column ``source_id``)."""
        return starts.join(self.members.withColumnRenamed("id", "source_id"), "source_id").join(self.chains, "chain").withColumnRenamed("chain", "root")

    def counts(self, starts: DataFrame) -> DataFrame:
        """(source_id, reaches, sinks): how many other nodes, and sinks among them, each start reaches. Rows are starts and chains, not pairs of nodes."""
        begun = written(self._started(starts), "starts")
        found = self.covered(begun.select(F.col("root").alias("chain")))
        other = F.col("chain") != F.col("root")
        sums = found.groupBy("root").agg(F.sum(F.when(other, F.col("size"))).alias("more"), F.sum(F.when(other, F.col("sinks"))).alias("more_sinks"), F.max((~other).cast("long")).alias("again"))
        none = lambda c: F.coalesce(F.col(c), F.lit(0))
        met = begun.join(sums, "root", "left")
        # in a ring, what stands before the start in its chain is reached as well
        reaches = F.col("size") - 1 - F.col("pos") + none("more") + F.when(none("again") > 0, F.col("pos")).otherwise(0)
        sinks = F.col("sinks") - F.col("upto") + none("more_sinks") + F.when(none("again") > 0, F.col("upto") - F.col("flag")).otherwise(0)
        return met.select("source_id", reaches.cast("long").alias("reaches"), sinks.cast("long").alias("sinks"))

    def reached(self, starts: DataFrame) -> DataFrame:
        """(source_id, id, depth): every node that each start reaches, itself at depth 0, with the least number of edges."""
        begun = written(self._started(starts), "starts").select("source_id", "root", F.col("pos").alias("start"), "size")
        nodes = self.members.select("id", "chain", "pos")
        own = begun.join(nodes, F.col("root") == F.col("chain")).filter("pos >= start").select("source_id", "id", (F.col("pos") - F.col("start")).alias("depth"))
        found = self.spread(begun.select(F.col("root").alias("chain")))
        rest = begun.join(found, "root").join(nodes, "chain").filter("chain <> root OR pos < start")
        return own.unionByName(rest.select("source_id", "id", (F.col("size") - 1 - F.col("start") + F.col("hops") + F.col("pos")).alias("depth"))).withColumn("depth", F.col("depth").cast("int"))

    def estimates(self, precision: int = PRECISION) -> DataFrame:
        """(id, reaches): about how many other nodes each node reaches.

        A chain's nodes are a sketch; sketches are merged along the graph of chains until none changes, so rows are chains and nodes, never
        pairs. What a node reaches within its chain is counted exactly; only the rest has the sketches' error (some 1.04 / sqrt(2 ** precision)).
        """
        whole = written(self.members.groupBy("chain").agg(F.hll_sketch_agg("id", F.lit(precision)).alias("own")), "sketches")
        state, changed = whole.select("chain", F.lit(None).cast("binary").alias("beyond"), F.lit(0).cast("long").alias("n")), True
        while changed:
            sent = self.links.join(state.join(whole, "chain").select(F.col("chain").alias("to"), F.when(F.col("beyond").isNull(), F.col("own")).otherwise(F.hll_union("own", F.coalesce("beyond", "own"))).alias("sketch")), "to")
            merged = sent.groupBy("chain").agg(F.hll_union_agg("sketch").alias("beyond"))
            new = whole.select("chain").join(merged, "chain", "left").withColumn("n", F.coalesce(F.hll_sketch_estimate("beyond"), F.lit(0)))
            table, told = measured(new.join(state.select("chain", F.col("n").alias("before")), "chain").withColumn("grown", F.col("n") != F.col("before")), "beyond", grown=F.count_if("grown"))
            state, changed = table.select("chain", "beyond", "n"), told["grown"]
        both = state.join(whole, "chain").join(self.chains, "chain")
        inside = F.col("n") == F.hll_sketch_estimate(F.hll_union("own", F.coalesce("beyond", "own")))
        rated = both.select("chain", "n", "size", (F.col("beyond").isNotNull() & inside).alias("ring"))
        reaches = F.when(F.col("ring"), F.greatest(F.col("n") - 1, F.col("size") - 1)).otherwise(F.col("n") + F.col("size") - 1 - F.col("pos"))
        return self.members.join(rated, "chain").select("id", reaches.cast("long").alias("reaches"))
