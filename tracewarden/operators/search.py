"""Level-synchronous search with predecessor tables.

A state is (source, node, depth) with a 64-bit rank and what is tainted there. A level is one join with the edges; of
the states that reach the same node at one depth, the first in queue order survives, chosen by a row limit that Spark
applies before and after the exchange. Queue order is the order of the parents, then of the edges' ids. Ranks keep it
without looking at other states: a state owns an interval of 64-bit numbers, and each out-edge of its node, by its place in the
order of ids, gets an equal part of it; nodes with one out-edge use up nothing. Where intervals would become too
narrow, all states of the level are numbered afresh.

Several levels are one job: rows that are done pass through a level unchanged, so that the plan stays a line. A state names its
predecessor at the start of its job by that one's rank and lists only the nodes since; while few states are live a job has many levels, and
where many are, a job is one level and rows have a fixed width. Paths are put together from the hits alone, by one join a job.

A search can be pruned by the distance to a sink: a backward search over all sinks at once labels each node with the least number
of edges to any of them; edges to nodes without a label, and states that are too deep for their label, are never built. Labels take
a pass over all edges a level, so a search asks for them only when its states have outgrown the edges.

Where at most one edge leads to a node, states of a source never meet: nothing has to be compared, a sanitized state stands in no clean one's
way and is dropped, and a search that counts each node once needs no memory but of its source (the first node that a walk could meet again).
Few states are sent to large edges, not the other way round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from math import log

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracewarden.schema import SANITIZER, SINK, SOURCE
from tracewarden.sources.shared import measured, removed, width, written

#: Levels of the first job, and of later ones while at most MANY states are live.
FIRST, CHAIN, MANY = 5, 10, 2_000_000
#: Ranks are below this number.
SPACE = 1 << 62
#: Bytes of edges from which the largest node is looked for, and its edges from which a node's are numbered in parts.
HUB_BYTES, HUB = 1 << 30, 1_000_000
#: An estimate of bytes beyond this says that the size isn't known.
UNKNOWN = 1 << 60
#: Bytes of edges that go to every task instead of being dealt anew for each level.
SMALL = 32 << 20
#: States that go to every task instead, where edges don't.
FEW = 100_000
_STATE = ("source_id", "node", "depth", "rank", "room", "base", "via", "vars", "cleared", "sanitized", "node_type", "node_class", "hit")
_NONE = "cast(array() AS array<string>)"
#: States that a ``clean`` search asks for.
_WANTED = f"node_type = '{SINK}' AND NOT sanitized"


@dataclass(frozen=True)
class Around:
    """Edges whose target exists, with what a search needs of it: src, dst, edge_type, dst_type, dst_class, of calls args and params as
    JSON texts (lists would be most of what reading the edges costs; empty for none and of other edges, where nothing asks for them), the place of the edge among those of its source, and their number; ``most`` of them at one node, ``count`` in all,
    some ``size`` bytes; at most ``into`` edges lead to one node; ``starts`` nodes have edges."""

    table: DataFrame
    most: int
    count: int = 0
    size: int = 0
    into: int = 2
    starts: int = 1

    @property
    def apart(self) -> bool:
        """Whether no two states of a source can meet in a node at one depth (by induction: its only in-edge brings one)."""
        return self.into <= 1

    def clean(self) -> Around:
        """Without the edges into sanitizers."""
        return replace(self, table=self.table.filter(F.col("dst_type") != SANITIZER))

    def towards(self, sinks: DataFrame, hops: int) -> Around:
        """Only edges whose target is within ``hops`` edges of a sink (column ``node``), with that number as ``hops_left``."""
        labels = sink_distance(self.table, sinks, hops).select(F.col("node").alias("dst"), F.col("hops").alias("hops_left"))
        return Around(written(self.table.join(labels, "dst"), "towards"), self.most, self.count, self.size, self.into, self.starts)


def _in_parts(linked: DataFrame) -> DataFrame:
    """Places by parts of a node's edges: within the first three characters of the id, and of these among each other."""
    linked = linked.dropDuplicates(["src", "edge_id"]).withColumn("part", F.substring("edge_id", 1, 3))
    within = Window.partitionBy("src", "part").orderBy("edge_id")
    sizes = linked.groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("src")
    before = sizes.select("src", "part", (F.sum("n").over(every.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(every).alias("edges"))
    numbered = linked.withColumn("at", F.row_number().over(within) - 1).join(before, ["src", "part"])
    return numbered.withColumn("place", F.col("before") + F.col("at")).drop("part", "before", "at")


def _at_once(linked: DataFrame) -> DataFrame:
    by_id = Window.partitionBy("src").orderBy("edge_id")
    marked = linked.withColumn("place", F.dense_rank().over(by_id).cast("long") - 1).withColumn("again", F.coalesce(F.lag("edge_id").over(by_id) == F.col("edge_id"), F.lit(False)))
    return marked.filter(~F.col("again")).drop("again").withColumn("edges", F.count(F.lit(1)).over(Window.partitionBy("src")))


def edges_size(edges: DataFrame) -> int:
    """Bytes of edges, by Spark's own estimate."""
    return int(str(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _of_call(names: str) -> Column:
    return F.when(F.coalesce(F.col("edge_type") != "call", F.lit(False)) | (F.size(names) < 1), "").otherwise(F.coalesce(F.to_json(names), F.lit("")))


def adjacency(nodes: DataFrame, edges: DataFrame, hub_bytes: int = HUB_BYTES) -> Around:
    """Edges with equal ids count once; edges to missing nodes lead nowhere."""
    target = nodes.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"), F.coalesce("vuln_class", F.lit("")).alias("dst_class"), "params")
    linked = edges.select("src", "dst", F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), "args").join(target, "dst")
    linked = linked.withColumns({k: _of_call(k) for k in ("args", "params")})
    size = edges_size(edges)
    into = Observation()
    # a running number needs no group in memory; its largest is the largest number of edges into a node
    number = F.row_number().over(Window.partitionBy("dst").orderBy("dst")) if size < UNKNOWN else F.lit(2)
    linked = linked.withColumn("into", number).observe(into, F.max("into").alias("into")).drop("into")
    hubs = hub_bytes < 0 or size > hub_bytes and (edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > HUB
    placed = _in_parts(linked) if hubs else _at_once(linked)
    held = F.octet_length("src") + F.octet_length("dst") + F.octet_length("args") + F.octet_length("params") + 100
    dealt = None if hubs or not SMALL < size < UNKNOWN else "src"  # each level joins them by their source
    table, told = measured(placed.drop("edge_id"), "adjacency", dealt, most=F.max("edges"), count=F.count(F.lit(1)), size=F.sum(held.cast("long")), starts=F.count_if(F.col("place") == 0))
    return Around(table, told["most"] or 1, told["count"] or 0, told["size"] or 0, into.get.get("into") or 1, told["starts"] or 1)


def live_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) of the edges whose target exists."""
    return edges.select("src", "dst").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def sink_distance(around: DataFrame, sinks: DataFrame, hops: int) -> DataFrame:
    """(node, hops): the least number of edges from each node to one of the sinks, up to ``hops``. Jobs have 1, 2, 4 and more levels, so
    that a search that soon has nothing left to label ends soon."""
    back = around.select(F.col("dst").alias("to"), F.col("src").alias("from"))
    state, at, live = written(sinks.select("node", F.lit(0).alias("hops")).distinct(), "labels"), 0, 1
    while at < hops and live:
        old, last = state, min(at + min(at + 1, CHAIN), hops)
        for k in range(at + 1, last + 1):
            fresh = F.col("hops") == k - 1
            met = state.join(back, F.when(fresh, F.col("node")).otherwise(F.concat(F.lit("\0"), "node")) == F.col("to"), "left")
            both = F.array(F.struct("node", "hops"), F.struct(F.col("from").alias("node"), F.lit(k).alias("hops")))
            state = met.select(F.explode(both).alias("s")).select("s.*").filter("node IS NOT NULL").groupBy("node").agg(F.min("hops").alias("hops"))
        state, told = measured(state, "labels", live=F.count_if(F.col("hops") == last))
        removed(old)
        at, live = last, told["live"]
    return state


@dataclass(frozen=True)
class Rule:
    """How a search goes on. ``gated``: call edges need a tainted argument and taint the callee's parameters; ``ends``: a path
    ends at its first unsanitized sink; ``once``: each node counts once for a source, at its first depth, and with ``clean`` only unsanitized
    states at sinks are asked for; ``sound`` and ``class_aware`` keep states apart by what has been cleared; ``most``: the longest path in nodes."""

    gated: bool = False
    ends: bool = False
    once: bool = False
    clean: bool = False
    sound: bool = False
    class_aware: bool = False
    most: int | None = None

    def only_clean(self, apart: bool) -> bool:
        """Whether a sanitized state neither is asked for nor keeps a clean one from being the first."""
        return self.clean and apart or self.ends and not self.class_aware and (apart or self.sound)


@dataclass
class Found:
    """States of a search (hits, or with ``once`` all), the states at the start of each job but the first, the live states after each job, and
    the least and the largest depth of each job's hits."""

    rows: DataFrame
    bases: list[tuple[int, DataFrame]] = field(default_factory=list)
    live: list[int] = field(default_factory=list)
    depths: set[int] = field(default_factory=set)

    @property
    def one_depth(self) -> bool:
        """Whether all hits have the same depth."""
        return len(self.depths) <= 1

    def with_paths(self) -> DataFrame:
        """The rows with ``path``: the nodes from the source on."""
        rows = self.rows.withColumn("at", F.col("depth"))
        for seed, table in reversed(self.bases):
            later = F.col("at") > seed
            rows = rows.withColumn("key", F.when(later, F.col("base")).otherwise(F.lit(-1).cast("long"))).join(table, ["source_id", "key"], "left").drop("key")
            rows = rows.withColumns({"via": F.when(later, F.concat("base_via", "via")).otherwise(F.col("via")), "base": F.when(later, F.col("base_base")).otherwise(F.col("base")), "at": F.when(later, F.lit(seed)).otherwise(F.col("at"))}).drop("base_via", "base_base")
        return rows.withColumn("path", F.concat(F.array("source_id"), "via")).drop("at", "via", "base")


def _level(before: str, depth: int, seed: int, rule: Rule, pruned: bool, hint: str, apart: bool, few: bool, most: int, listed: bool) -> str:
    """SQL of all states after one more level than the table ``before`` has; ``seed``: the depth from which states list their nodes.
    ``apart``: no two states can meet in a node; ``few``: all states of ``before`` are live, and only those they lead to are wanted; ``most``: edges of a node; ``listed``: states list their nodes."""
    live = f"(depth = {depth - 1} AND NOT hit)"
    goes = "src IS NOT NULL"
    final = rule.ends and depth == rule.most  # no level follows: of a row only what tells the first, a hit and its path
    if rule.gated:
        goes += f" AND (edge_type <> 'call' OR coalesce(arrays_overlap(vars, from_json(args, 'array<string>')), false))"
    if pruned:
        goes += f" AND hops_left + {depth} <= {rule.most}"
    if rule.only_clean(apart):
        goes += f" AND dst_type <> '{SANITIZER}'"
    if rule.once and apart:
        goes += " AND dst <> source_id"
    room = "(room div coalesce(edges, 1))"
    new = {
        "node": "dst", "depth": str(depth), "room": room, "rank": f"rank + coalesce(place, 0) * {room}",
        "base": f"if(depth = {seed}, rank, base)", "via": f"if(depth = {seed}, {_NONE}, via)" if listed else "via",  # its node is added behind the exchange
        "vars": "if(edge_type = 'call' AND params <> '', from_json(params, 'array<string>'), vars)" if rule.gated else "vars",
        "cleared": f"if(dst_type = '{SANITIZER}', array_sort(array_union(cleared, array(dst_class))), cleared)" if rule.class_aware else "cleared",
        "sanitized": f"sanitized OR dst_type = '{SANITIZER}'", "node_type": "dst_type", "node_class": "dst_class",
    }
    rest = {"room": "0L", "vars": _NONE} | ({} if rule.class_aware else {"cleared": _NONE, "node_class": "''"}) if final else {}
    new = {k: c for k, c in new.items() if k not in rest}
    met = f"{before} LEFT JOIN around ON if({live}, node, concat(char(0), source_id)) = src"  # done rows meet no edge
    if few:
        moved = f"SELECT {hint} source_id, hit, {', '.join(f'{c} AS {k}' for k, c in new.items())} FROM {before} JOIN around ON node = src WHERE {goes}"
    elif rule.once:  # a state stays beside those it leads to
        stays = ", ".join(f"'{c}', {c}" for c in ("source_id", "hit", *new))
        leads = ", ".join(f"'{k}', {c}" for k, c in {"source_id": "source_id", "hit": "hit", **new}.items())
        # where states can meet, the earlier ones are needed to tell which node is new
        stays = f"if(NOT {live} OR ({_WANTED}), named_struct({stays}), NULL)" if rule.clean and apart else f"named_struct({stays})"
        moved = f"SELECT m.* FROM (SELECT {hint} explode(array({stays}, if({live} AND {goes}, named_struct({leads}), NULL))) AS m FROM {met}) WHERE m IS NOT NULL"
    else:
        moved = f"SELECT {hint} source_id, hit, {', '.join(f'if({live}, {c}, {k}) AS {k}' for k, c in new.items())} FROM {met} WHERE NOT {live} OR ({goes})"
    alone = apart and not (rule.once and not few and most > 1)  # a state stays once an edge
    keys = ["source_id", "node"] if rule.once else ["source_id", "node", "depth"] + ["sanitized"] * rule.sound + ["cleared"] * rule.class_aware
    first = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {'depth, ' * rule.once}rank) AS n FROM ({moved})) WHERE n = 1" if not alone else moved
    clean = "NOT array_contains(cleared, node_class)" if rule.class_aware else "NOT sanitized"
    hit = f"hit OR (depth = {depth} AND node_type = '{SINK}' AND {clean})" if rule.ends else "hit"
    given = {c: c for c in _STATE} | rest | {"hit": hit}
    if listed:
        given["via"] = f"if(depth = {depth}, concat(via, array(node)), via)"
    return f"SELECT {', '.join(f'{c} AS {k}' for k, c in given.items())} FROM ({first})"


def levels(state: DataFrame, around: Around, seed: int, last: int, rule: Rule, begun: int | None = None, few: bool = False, listed: bool = True) -> DataFrame:
    """All states after the levels from ``seed`` to ``last``: one SQL text, a table of it a level, each read once by the next.
    ``begun``: the depth from which they list their nodes, if not ``seed``."""
    pruned = "hops_left" in around.table.columns
    hint = f"/*+ BROADCAST(level{seed}) */" if few else "/*+ BROADCAST(around) */" if around.size <= SMALL else ""
    tables = [f"level{d} AS ({_level(f'level{d - 1}', d, begun or seed, rule, pruned, hint, around.apart, few, around.most, listed)})" for d in range(seed + 1, last + 1)]
    text = f"WITH around AS (SELECT * FROM {{around}}), level{seed} AS (SELECT * FROM {{state}}), {', '.join(tables)} SELECT * FROM level{last}"
    return state.sparkSession.sql(text, state=state, around=around.table)


def _renumbered(states: DataFrame, live: int, space: int) -> tuple[DataFrame, int]:
    """The states with new ranks in the same order and equal rooms: places in a sorted table, by its parts."""
    parts = width(states.sparkSession)
    ranged = states.repartitionByRange(parts, "source_id", "rank").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row a part
    room = space // max(1, live)
    at = F.row_number().over(Window.partitionBy("part").orderBy("source_id", "rank"))
    numbered = ranged.withColumn("at", at).join(F.broadcast(before), "part").withColumns({"rank": (F.coalesce("before", F.lit(0)) + F.col("at") - 1) * F.lit(room), "room": F.lit(room).cast("long")})
    return written(numbered.select(*states.columns), "renumbered"), room


def _together(around: Around, count: int, many: int, most: int) -> int:
    """Levels of one job over large edges: so many, up to ``most``, that its states stay within the number of edges."""
    mean, room = around.count / around.starts, max(around.count, many)
    return max(1, min(most, int(log(max(1, room / max(1, count))) / log(mean)))) if mean > 1.01 else most


def search(around: Around, starts: DataFrame, rule: Rule, first: int = FIRST, chain: int = CHAIN, many: int = MANY, space: int = SPACE, few: int = FEW, small: int = SMALL, listed: bool = True, narrowed: Callable[[int], Around] | None = None) -> Found:
    """The states that ``starts`` (source_id, vars) lead to; their paths can be put together if they are ``listed``. ``narrowed`` gives the edges within so many hops of a sink, should states outgrow edges."""
    none = F.array().cast("array<string>")
    state = starts.select("source_id", F.col("source_id").alias("node"), F.lit(1).alias("depth"), F.lit(0).cast("long").alias("rank"), F.lit(space).cast("long").alias("room"), F.lit(0).cast("long").alias("base"), none.alias("via"), "vars", none.alias("cleared"), F.lit(False).alias("sanitized"), F.lit(SOURCE).alias("node_type"), F.lit("").alias("node_class"), F.lit(False).alias("hit"))
    depth, seed, room, count, found, done = 1, 1, space, None, Found(state), []
    kept = rule.once and not around.apart  # earlier states tell which nodes are new
    large = around.size > small
    if rule.only_clean(around.apart):
        around = around.clean()
    while rule.most is None or depth < rule.most:
        sent = large and not kept and count is not None and count <= few
        if narrowed and count is not None and count > around.count:
            around, narrowed = narrowed(rule.most - depth), None
        n = first if count is None else chain if count <= many else 1
        if sent:
            n = 1
        elif large and count is None and around.most > 1:
            n = min(n, _together(around, starts.count(), many, n))
        elif large and count is not None:
            n = min(n, _together(around, count, many, first))
        if rule.most is not None:
            n = min(n, rule.most - depth)
        if around.most > 1:
            fit = int(log(max(1, room)) / log(around.most) - 1e-9)
            if fit < 1 and count is not None:
                fresh, room = _renumbered(frontier, count, space)
                state = state.filter(~live).unionByName(fresh) if kept else fresh
                frontier = fresh
                fit = int(log(max(1, room)) / log(around.most) - 1e-9)
                seed = 0  # states name their predecessors by the new ranks
            if fit < 1:
                raise ValueError(f"{count} states and {around.most} edges of a node are too many for 64-bit ranks")
            n = min(n, fit)
        if count is not None and not (sent and seed and depth - seed < 2 * chain):  # few states go on listing their nodes
            seed = depth
            found.bases.append((depth, frontier.select("source_id", F.col("rank").alias("key"), F.col("base").alias("base_base"), F.col("via").alias("base_via"))))
        before = depth if done or kept else 0
        state, depth = levels(state, around, depth, depth + n, rule, seed, sent, listed), depth + n
        live = (F.col("depth") == depth) & ~F.col("hit")
        state, told = measured(state, "states", live=F.count_if(live), room=F.min(F.when(live, F.col("room"))), least=F.min(F.when(F.col("hit"), F.col("depth"))), largest=F.max(F.when(F.col("hit"), F.col("depth"))))
        if rule.once and not kept:
            done.append(state.filter(F.col("depth") > before).filter(_WANTED if rule.clean else "true"))
        elif not rule.once:
            done.append(state.filter("hit"))
        count, room = told["live"] or 0, told["room"] or 0
        found.live.append(count)
        found.depths |= {told["least"], told["largest"]} - {None}
        frontier = state.filter(live)
        if not count:
            break
        if not kept:
            state = frontier
    if kept:
        found.rows = state
    else:
        found.rows = done[0] if done else state.filter("hit" if not rule.once else "true")
        for table in done[1:]:
            found.rows = found.rows.unionByName(table)
    return found
