"""N-gram Jaccard join by signature trees.

Two documents link when their sets of distinct word shingles have a Jaccard similarity of at least the
threshold t. Equal sets form one class. A link needs ``ceil(t * n)`` common shingles, so in any common
order of all shingles the first ``n - ceil(t * n) + 1`` of both sets share one. The order is by document
count, rarest first (counted exactly enough, see ``common.count_part``), then by hash: most documents hold
enough unique shingles that they can't link with anything and go no further.

The rest meet in candidate groups, with their whole sets. A group's task builds a signature tree: its
leaves are documents, and each inner node holds the OR of its children's shingle bitmaps, their range of
set sizes, and whether all of them are known to be linked. A traversal of the tree against itself drops
every node pair whose largest possible overlap is under the least overlap that a link needs, and every
pair inside one linked component, and compares the sets of the document pairs that are left.

No task holds more than a bounded part of a candidate group. A larger group is dealt into blocks, which are linked
by themselves; then the blocks' leaders, one for each cluster, are linked with each other, so that the near copies of one
text become one cluster however many they are. What is left are links between different clusters: the sets outside the
group's largest cluster visit every block. A group of one cluster is thus compared once, set by set; only a group of many
large clusters costs more than its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common
from tracewarden.llm.components import components

#: Children of a tree node.
FAN = 8
#: Classes, and bytes of sets, in a block of a candidate group.
HALF, HALF_BYTES = 2048, 24 << 20
_MARK = np.uint64(0xA5A5A5A55A5A5A5A)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (64-bit hashes, sorted) of each row, and the rows' bounds.

    Words are lower-cased (A-Z); a row with fewer words than ``size``, but some, has its whole sequence as one shingle.
    """
    sets, counts = [np.zeros(0, np.uint64)], []
    for first, last in common.slices(offsets, 1 << 19):
        part = common.lowered(data[offsets[first] : offsets[last]])
        starts, ends, rows = common.word_bounds(part, offsets[first : last + 1] - offsets[first])
        words = common.word_hashes(part, starts, ends)
        grams = common.gram_hashes(words, size)
        for a, b in zip(rows.tolist(), rows[1:].tolist()):
            if b - a >= size:
                found = np.unique(grams[a : b - size + 1])
            elif b > a:
                found = common.mix(common.gram_hashes(words[a:b], b - a) ^ (_MARK + np.uint64(b - a)))
            else:
                found = words[:0]
            sets.append(found)
            counts.append(len(found))
    return np.concatenate(sets), np.append(0, np.cumsum(np.array(counts, np.int64)))


def least_overlap(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of two sets with ``total`` elements together for den * both >= num * either."""
    return -(-num * total // (num + den))


def _sums(values: np.ndarray, bounds: np.ndarray, how: np.ufunc) -> np.ndarray:
    """``how`` over each run of values; 0 for empty runs."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = how.reduceat(values, bounds[:-1][some])
    return out


class Linked:
    """Union-find over the positions of a group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)


class SignatureTree:
    """A tree over sets: levels[0] are the sets themselves in the given order, levels[-1] the top nodes."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, labels: np.ndarray):
        n = len(order)
        sizes = np.array([len(sets[i]) for i in order], np.int64)
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(1.0, float(np.median(sizes))))), 9, 14))
        bitmaps = np.zeros((n, bits // 64), np.uint64)
        for row, i in enumerate(order.tolist()):
            at = np.unique(sets[i] & np.uint64(bits - 1))
            np.bitwise_or.at(bitmaps[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        # shingles of a set beyond one a bit
        excess = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, excess, labels[order])]
        while n > FAN:
            starts = np.arange(0, n, FAN)
            bitmaps, low, high, excess, label = self.levels[-1]
            first = label[starts]
            same = (np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)) & (first >= 0)
            self.levels.append((np.bitwise_or.reduceat(bitmaps, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(excess, starts), np.where(same, first, -1 - np.arange(len(starts)))))
            n = len(starts)

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether a set below x and another below y, not known to be linked, may still link."""
        bitmaps, low, high, excess, label = self.levels[level]
        keep = ((label[x] != label[y]) | (label[x] < 0)) & (high[x] * den >= num * low[y]) & (high[y] * den >= num * low[x])
        at = np.flatnonzero(keep)
        need = least_overlap(low[x[at]] + low[y[at]], num, den)
        most = np.minimum(high[x[at]], high[y[at]])
        for k in range(0, len(at), 4096):
            some = at[k : k + 4096]
            shared = np.bitwise_count(bitmaps[x[some]] & bitmaps[y[some]]).sum(1, dtype=np.int64)
            most[k : k + 4096] = np.minimum(most[k : k + 4096], shared + np.minimum(excess[x[some]], excess[y[some]]))
        keep[at[most < need]] = False
        return keep

    def pairs(self, num: int, den: int):
        """Pairs of positions (batches, x < y) that survive the traversal, depth first so that few wait at a time."""
        top = len(self.levels) - 1
        n = len(self.levels[top][1])
        x, y = np.triu_indices(n) if top else np.triu_indices(n, 1)
        waiting = [(top, x, y)]
        while waiting:
            level, x, y = waiting.pop()
            if len(x) > 2048:
                waiting += [(level, x[k : k + 2048], y[k : k + 2048]) for k in range(0, len(x), 2048)]
                continue
            keep = self.possible(level, x, y, num, den)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if not level:
                yield x, y
                continue
            m = len(self.levels[level - 1][1])
            cx = (x[:, None, None] * FAN + np.arange(FAN)[None, :, None]) + np.zeros((1, 1, FAN), np.int64)
            cy = (y[:, None, None] * FAN + np.arange(FAN)[None, None, :]) + np.zeros((1, FAN, 1), np.int64)
            inside = (cx < m) & (cy < m) & ((cx < cy) if level == 1 else (cx <= cy))
            waiting.append((level - 1, cx[inside], cy[inside]))


def linked_labels(sets: list[np.ndarray], num: int, den: int, halves: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the first position that it reaches by links of den * both >= num * either.

    With ``halves`` (0 or 1), only pairs across the halves need to be found; others may be. Sets that have
    the same ``known`` label are known to be linked.
    """
    n, linked = len(sets), Linked(len(sets))
    if known is not None:
        _, first, back = np.unique(known, return_index=True, return_inverse=True)
        for i, j in enumerate(first[back].tolist()):
            linked.join(i, j)
    sizes = np.array([len(s) for s in sets], np.int64)

    def links(a: int, b: int) -> bool:
        x, y = (sets[a], sets[b]) if sizes[a] <= sizes[b] else (sets[b], sets[a])
        if len(x) * den < num * len(y):
            return False
        at = np.searchsorted(y, x)
        both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
        return den * both >= num * (len(x) + len(y) - both)

    # near copies stand next to each other in the order of a smallest shingle: join those first
    for shift in (0, 21, 42) if n > 2 else ():
        least = np.array([s[0] if not shift else common.mix(s ^ np.uint64(shift)).min() for s in sets], np.uint64)
        order = np.lexsort((sizes, least)).tolist()
        for a, b in zip(order, order[1:]):
            if linked.root(a) != linked.root(b) and links(a, b):
                linked.join(a, b)
    labels = linked.labels()
    tree_order = np.lexsort((sizes, labels))
    tree = SignatureTree(sets, tree_order, labels)
    for x, y in tree.pairs(num, den):
        for a, b in zip(tree_order[x].tolist(), tree_order[y].tolist()):
            if halves is not None and halves[a] == halves[b]:
                continue
            if linked.root(a) != linked.root(b) and links(a, b):
                linked.join(a, b)
    return linked.labels()


def _candidate_edges(table: pa.Table, num: int, den: int) -> pa.Table:
    """Edges between classes that share a prefix shingle and whose sizes allow a link, as stars of runs of sizes."""
    cells = [np.frombuffer(x.as_buffer(), np.uint64).reshape(3, -1) for x in table.column("blob")]
    shingle, owner, size = np.concatenate(cells, axis=1)
    owner, size = owner.view(np.int64), size.astype(np.int64)
    order = np.lexsort((owner, size, shingle))
    shingle, owner, size = shingle[order], owner[order], size[order]
    again = np.append(False, (shingle[1:] == shingle[:-1]) & (owner[1:] == owner[:-1]))
    shingle, owner, size = shingle[~again], owner[~again], size[~again]
    joined = (shingle[1:] == shingle[:-1]) & (size[:-1] * den >= num * size[1:])
    run = np.cumsum(np.append(True, ~joined)) - 1
    if not len(run):
        return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
    least = np.minimum.reduceat(owner, np.flatnonzero(np.append(True, ~joined)))[run]
    edges = np.unique(np.stack([owner, least], 1)[owner != least], axis=0)
    return pa.table({"src": pa.array(np.ascontiguousarray(edges[:, 0])), "dst": pa.array(np.ascontiguousarray(edges[:, 1]))})


ROWS_SCHEMA = "kind int, doc_id long, n long, d1 long, d2 long, part int, blob binary"


def _rows(chunk: int, table: pa.Table, flags: pa.Table, size: int, num: int, den: int, parts: int) -> pa.Table:
    """What a chunk says: a row for each document (kind 0, with the chunk as part), each distinct candidate set (kind 1), postings by
    part (kind 2)."""
    ids, null, _, data, offsets = common.ordered_rows(table)
    sets, bounds = shingle_sets(data, offsets, size)
    n = np.diff(bounds)
    uniq, back = np.unique(sets, return_inverse=True)
    often = common.totals_of(flags, len(uniq))[back]
    d1 = _sums(common.mix(sets + np.uint64(1)), bounds, np.add).view(np.int64)
    d2 = _sums(common.mix(sets ^ _MARK), bounds, np.add).view(np.int64)
    prefix = n - -(-num * n // den) + 1
    unique = _sums((often < 2).astype(np.int64), bounds, np.add)
    seen, owners = set(), []
    tokens, which = [], []
    for row in np.flatnonzero((n > 0) & (unique < prefix)).tolist():
        name = (int(d1[row]), int(d2[row]), int(n[row]))
        if name in seen:
            continue
        seen.add(name)
        a, b = bounds[row], bounds[row + 1]
        order = np.lexsort((sets[a:b], often[a:b]))[: prefix[row]]
        order = order[often[a:b][order] > 1]
        owners.append(row)
        tokens.append(sets[a:b][order])
        which.append(np.full(len(order), row))
    total = len(ids)
    out = {"kind": [np.zeros(total, np.int32)], "doc_id": [ids], "n": [n], "d1": [d1], "d2": [d2], "part": [np.full(total, chunk, np.int32)]}
    blobs: list[bytes | None] = [None] * total
    masks = [null]
    if owners:
        rows = np.array(owners)
        blobs += [sets[bounds[r] : bounds[r + 1]].tobytes() for r in owners]
        tokens, which = np.concatenate(tokens), np.concatenate(which)
        order = np.argsort(tokens, kind="stable")
        tokens, which = tokens[order], which[order]
        edges = np.searchsorted(common.parts_of(tokens, parts), np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edges))
        blobs += [np.stack([tokens[edges[p] : edges[p + 1]], d1[which[edges[p] : edges[p + 1]]].view(np.uint64), n[which[edges[p] : edges[p + 1]]].astype(np.uint64)]).tobytes() for p in some]
        zeros = np.zeros(len(some), np.int64)
        for name, kept, posted in (("kind", np.ones(len(rows), np.int32), np.full(len(some), 2, np.int32)), ("doc_id", ids[rows], zeros), ("n", n[rows], zeros), ("d1", d1[rows], zeros), ("d2", d2[rows], zeros), ("part", np.zeros(len(rows), np.int32), some.astype(np.int32))):
            out[name] += [kept, posted]
        masks.append(np.zeros(len(rows) + len(some), bool))
    columns = {k: np.concatenate(v) for k, v in out.items()}
    arrays = {k: pa.array(v.astype(np.int32 if k in ("kind", "part") else np.int64)) for k, v in columns.items()}
    arrays["doc_id"] = pa.array(columns["doc_id"], pa.int64(), mask=np.concatenate(masks))
    return pa.table(arrays | {"blob": pa.array(blobs, pa.binary())})


def _links(table: pa.Table, num: int, den: int) -> pa.Table:
    """The links within a cell, as edges from each class to the first one that it reaches."""
    comp, half, node, label = (np.asarray(table.column(n)) for n in ("comp", "half", "node", "label"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("blob")]
    order = np.lexsort((node, comp))
    cuts = np.append(np.flatnonzero(np.append(True, comp[order][1:] != comp[order][:-1])), len(order))
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(cuts, cuts[1:]):
        members = order[a:b]
        if len(members) < 2:
            continue
        halves = half[members]
        guests = halves.min() != halves.max()
        labels = linked_labels([sets[i] for i in members], num, den, halves if guests else None, label[members] if guests else None)
        src.append(node[members])
        dst.append(node[members][labels])
    src, dst = np.concatenate(src), np.concatenate(dst)
    return pa.table({"src": pa.array(src[src != dst]), "dst": pa.array(dst[src != dst])})


def _blocks(members: DataFrame, name: str, half: int, half_bytes: int) -> DataFrame:
    """(comp, name): into how many blocks the sets of each component go, by their number and bytes; ``members`` has comp and n."""
    return members.groupBy("comp").agg(F.expr(f"cast(greatest(ceil(count(1) / {half}), ceil(sum(n * 8) / {half_bytes})) as int)").alias(name))


def _links_of(placed: DataFrame, num: int, den: int) -> DataFrame:
    return placed.select("cell", "comp", "half", "node", "label", "blob").groupBy("cell").applyInArrow(lambda t: common.released(_links(t, num, den)), "src long, dst long")


def _all_links(sets: DataFrame, groups: DataFrame, num: int, den: int, parts: int, half: int, half_bytes: int) -> DataFrame:
    """(src, dst): edges that connect what is linked, of ``sets`` (node, n, blob) in candidate ``groups`` (node, component)."""
    members = sets.join(groups.withColumnRenamed("component", "comp"), "node")
    members = members.join(_blocks(members, "blocks", half, half_bytes).filter("blocks > 1"), "comp", "left").fillna(1, ["blocks"])
    members = common.written(members.withColumn("mine", F.expr("cast(pmod(xxhash64(node), blocks) as int)")), "members")
    alone = members.select("*", F.lit(0).alias("half"), F.col("node").alias("label"))
    links = common.written(_links_of(alone.withColumn("cell", F.expr(f"if(blocks = 1, pmod(xxhash64(comp), {2 * parts}), xxhash64(comp, mine))")), num, den), "links")
    large = members.filter("blocks > 1")
    if large.select("comp").isEmpty():
        return links

    def labelled(edges: DataFrame) -> DataFrame:
        found = components(edges).withColumnRenamed("component", "label")
        return large.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))

    leaders = labelled(links).filter("label = node").drop("label")
    leaders = leaders.join(_blocks(leaders, "rooms", half, half_bytes), "comp").withColumn("cell", F.expr("xxhash64(comp, pmod(xxhash64(node, 1), rooms))"))
    links = common.written(links.unionByName(_links_of(leaders.select("*", F.lit(0).alias("half"), F.col("node").alias("label")), num, den)), "links")
    named = common.written(labelled(links), "named")
    sizes = named.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("comp").agg(F.max_by("label", F.struct("k", F.negative("label"))).alias("main"))
    minor = named.join(largest, "comp").filter("label <> main").drop("main")
    rooms = _blocks(minor, "rooms", half, half_bytes)
    hosts = named.join(rooms, "comp").select("*", F.explode(F.expr("sequence(0, rooms - 1)")).alias("room"), F.lit(0).alias("half"))
    guests = minor.join(rooms, "comp").withColumn("room", F.expr("cast(pmod(xxhash64(node, 2), rooms) as int)"))
    guests = guests.drop("mine").select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("mine"), F.lit(1).alias("half"))
    both = hosts.unionByName(guests).withColumn("cell", F.expr("xxhash64(comp, mine, room, 3)"))
    return links.unionByName(_links_of(both, num, den))


def jaccard_groups(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", half: int = HALF, half_bytes: int = HALF_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents grouped by links of den * intersection >= num * union.

    ``component_id`` is the smallest id that a document reaches by links, itself included. Sets hold distinct
    shingles of ``size`` lower-cased words (fewer words: the whole sequence); a document without words has
    an empty set, links with nothing and is its own component. Null texts count as empty; a null id takes
    part, but is nobody's smallest id (a component of null ids alone has a null component_id); repeated
    rows link with each other. Other columns are not read; an empty table gives an empty table. Copies are
    one class and are never paired; large groups are compared in blocks of about ``half`` classes
    or ``half_bytes`` bytes of sets, whichever is less (a single longer set is a block). A word may have any length.
    Writes intermediate tables to the shared folder.
    """
    many, parts = common.groups_of(docs, text_col)
    chunks = common.in_chunks(docs, many, id_col, text_col)

    def send(table: pa.Table) -> pa.Table:
        *_, data, offsets = common.ordered_rows(table)
        keys, counts = np.unique(shingle_sets(data, offsets, size)[0], return_counts=True)
        return common.keys_table(table.column("chunk")[0].as_py(), keys, counts, parts)

    totals = common.counted(chunks, send)
    told = common.written(chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(lambda key, t, f: _rows(key[0].as_py(), t, f, size, num, den, parts), ROWS_SCHEMA), "shingles")

    # a class asks and hears once a chunk: a text that a third of all rows hold is one row a chunk, never one key with all rows
    name = ["d1", "d2", "n"]
    rows = told.filter("kind = 0 and n > 0").select("doc_id", *name, F.col("part").alias("chunk"))
    cells = rows.groupBy(*name, "chunk").agg(F.min("doc_id").alias("rep"))
    classes = cells.groupBy(*name).agg(F.min("rep").alias("rep"))
    edges = told.filter("kind = 2").select("part", "blob").groupBy("part").applyInArrow(lambda t: _candidate_edges(t, num, den), "src long, dst long")
    groups = components(edges)
    groups = groups.union(groups.select("component", "component").distinct().toDF("node", "component"))
    sets = told.filter("kind = 1").groupBy("d1").agg(F.first("n").alias("n"), F.first("blob").alias("blob")).withColumnRenamed("d1", "node")
    links = _all_links(sets, groups, num, den, parts, half, half_bytes)
    # links run between classes, so that those of null ids take part; each component is then named by its smallest id
    found = components(links)
    found = found.union(found.select("component", "component").distinct().toDF("node", "component"))
    least = found.join(classes, found["node"] == classes["d1"]).groupBy("component").agg(F.min("rep").alias("least"))
    found = found.join(least, "component").select(F.col("node").alias("d1"), "least")
    named = classes.join(found, "d1", "left").select(*name, F.coalesce("least", "rep").alias("component_id"))
    told_to = cells.drop("rep").join(named, name)
    linked = rows.join(told_to, [*name, "chunk"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = told.filter("kind = 0 and n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
