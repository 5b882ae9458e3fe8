"""Repair of conversation structure: cheapest edits by Four-Russians tables of cost vectors.

A row of a conversation is one of nine symbols (must go; or s, u, a, other by its role's initial, whole or truncated).
An automaton with four states (nothing yet, after s, u, a) accepts ``(s?(ua)+)?``; the *cost vector* at a place holds, by
state, the least cost of all edits from there on. Less their minimum there are only a few such vectors, so for every
block of four symbols and every vector behind it a table holds the vector before it and what the minimum grew by. A
conversation is run backward a block a lookup; then each block is expanded backward symbol by symbol and
traced forward, where at every place the first letter of the alphabet that keeps the cost least is taken.

Rows are gathered by (conversation, range of BUCKET turn numbers). Nearly all conversations lie in one range. For a longer
one each range is first made a function of the vector behind it and the state before it (a few bytes), the functions are put together in
order, and then all ranges are traced side by side: no task holds more rows of a conversation than a range's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.bpe import ranges
from tracewarden.llm.common import written

#: Turn numbers of a range, symbols of a table's block, and cells of a matrix that are worked at once.
BUCKET, _BLOCK, _CELLS = 4096, 4, 1 << 22
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: White space, and the ends of a whole sentence.
_WHITE, _ENDS = " \t\n\x0b\x0c\r", ".!?"
_SYMBOLS = "bsuaoSUAO"  # b stands for every row that must go; what follows the last symbol is no row
_NO_ROW = len(_SYMBOLS)
_NEXT_INSERT = (2, 2, 3, 2)
_DELETE, _KEEP, _TO_USER, _TO_ASSISTANT, _NEW_USER, _NEW_ASSISTANT = range(6)
_LETTERS = np.frombuffer(b"DKRRII", np.uint8)
_NULL_RANGE = -(1 << 52)


def _moves(symbol: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, edit, cost, next state) of the edits that use up a row, in the order of their letters."""
    if symbol == _NO_ROW:
        return [("", -1, 0, state)]
    out = [("D", _DELETE, DELETE, state)]
    if symbol:
        extra = TRUNCATED if symbol > 4 else 0
        kind = (symbol - 1) % 4
        after = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}[state].get(kind)
        if after is not None:
            out.append(("K", _KEEP, extra, after))
        wanted = _NEXT_INSERT[state]
        out.append(("R", _TO_USER if wanted == 2 else _TO_ASSISTANT, REROLE + extra, wanted))
    return out


class Tables:
    """All cost vectors, single steps, block steps, and what a trace emits.

    ``vectors[i]``: costs by state less their minimum; ``step``/``grow`` [vector behind, symbol]: vector before, growth of
    the minimum; ``blocks``/``block_grow`` the same by block code. A token is (vector behind, symbol, state): ``after[token]`` is the
    state behind its row, ``edits[first[token] : first[token] + count[token]]`` its edits; ``end_edits[state]`` those behind the last row.
    """

    def __init__(self):
        end = self._inserted(np.array([0, 99, 99, 0]))
        self.vectors, known, todo = [end], {tuple(end): 0}, 0
        step, grow = [], []
        while todo < len(self.vectors):
            behind = self.vectors[todo]
            step.append([])
            grow.append([])
            for symbol in range(_NO_ROW + 1):
                costs = self._before(behind, symbol)
                least = int(costs.min())
                key = tuple((costs - least).tolist())
                if key not in known:
                    known[key] = len(self.vectors)
                    self.vectors.append(costs - least)
                step[-1].append(known[key])
                grow[-1].append(least)
            todo += 1
        self.step, self.grow, self.vectors = np.array(step, np.int16), np.array(grow, np.int64), np.array(self.vectors)
        base = _NO_ROW + 1
        codes = np.arange(base**_BLOCK)
        self.blocks = np.tile(np.arange(len(step), dtype=np.int16)[:, None], (1, len(codes)))
        self.block_grow = np.zeros(self.blocks.shape, np.int64)
        for k in range(_BLOCK):  # the last symbol of a block is its code's last digit
            digit = codes // base**k % base
            self.block_grow += self.grow[self.blocks, digit]
            self.blocks = self.step[self.blocks, digit]
        edits, self.after, counts = [], [], []
        for v in range(len(step)):
            for symbol in range(base):
                costs = self._before(self.vectors[v], symbol)
                for state in range(4):
                    made, at = self._traced(costs, self.vectors[v], symbol, state)
                    edits += made
                    counts.append(len(made))
                    self.after.append(at)
        self.edits, self.after, self.count = np.array(edits, np.int64), np.array(self.after, np.int64), np.array(counts, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.end_edits = [[], [_NEW_USER, _NEW_ASSISTANT], [_NEW_ASSISTANT], []]

    @staticmethod
    def _inserted(costs: np.ndarray) -> np.ndarray:
        """Costs where any number of rows may be inserted first: two are enough, as a third leads back."""
        for _ in range(2):
            costs = np.minimum(costs, INSERT + costs[list(_NEXT_INSERT)])
        return costs

    def _before(self, behind: np.ndarray, symbol: int) -> np.ndarray:
        return self._inserted(np.array([min(cost + int(behind[q]) for _, _, cost, q in _moves(symbol, state)) for state in range(4)])) if symbol != _NO_ROW else behind

    @staticmethod
    def _traced(costs: np.ndarray, behind: np.ndarray, symbol: int, state: int) -> tuple[list[int], int]:
        """The edits from a state up to and with the row, least letters first among the cheapest; and the state behind."""
        made: list[int] = []
        if symbol == _NO_ROW:
            return made, state
        while True:
            target = _NEXT_INSERT[state]
            choices = [(letter, edit, cost + int(behind[q]), q) for letter, edit, cost, q in _moves(symbol, state)]
            choices.append(("I", _NEW_USER if target == 2 else _NEW_ASSISTANT, INSERT + int(costs[target]), target))
            letter, edit, _, q = min(c for c in choices if c[2] == costs[state])
            made.append(edit)
            state = q
            if letter != "I":
                return made, state

    def run(self, rows: np.ndarray, behind: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vector before, growth, state behind, tokens) of rows of symbols, a whole number of blocks wide."""
        n, width = rows.shape
        base = _NO_ROW + 1
        parts = rows.reshape(n, width // _BLOCK, _BLOCK).astype(np.int64)
        codes = parts @ (base ** np.arange(_BLOCK - 1, -1, -1))
        held = np.empty((n, width // _BLOCK), np.int16)
        grown, vector = np.zeros(n, np.int64), behind.astype(np.int16)
        for k in range(width // _BLOCK - 1, -1, -1):
            held[:, k] = vector
            grown += self.block_grow[vector, codes[:, k]]
            vector = self.blocks[vector, codes[:, k]]
        tokens = np.empty((n, width), np.int32)
        for k in range(width // _BLOCK):
            inner = [held[:, k]]
            for j in range(_BLOCK - 1, 0, -1):
                inner.append(self.step[inner[-1], parts[:, k, j]])
            for j in range(_BLOCK):
                token = (inner[_BLOCK - 1 - j].astype(np.int64) * base + parts[:, k, j]) * 4 + state
                tokens[:, _BLOCK * k + j] = token
                state = self.after[token]
        return vector, grown, state, tokens


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _matrices(symbols: pa.Array, lanes: int = 1):
    """(rows, matrix of symbol numbers) for strings of like length, some cells at a time; ``lanes`` more are made of each row."""
    number = np.full(256, 255, np.uint8)
    number[np.frombuffer(_SYMBOLS.encode(), np.uint8)] = np.arange(len(_SYMBOLS))
    number[ord("d")] = 0
    texts = [s.encode() for s in symbols.to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths
    widths = np.maximum(_BLOCK, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for width in np.unique(widths).tolist():
        members = np.flatnonzero(widths == width)
        size = max(1, _CELLS // (width * lanes))
        for k in range(0, len(members), size):
            some = members[k : k + size]
            filled = np.arange(width) < lengths[some][:, None]
            matrix = np.full((len(some), width), _NO_ROW, np.uint8)
            matrix[filled] = number[data[ranges(starts[some], lengths[some])]]
            yield some, matrix


def _edited(symbols: pa.Array, behind: pa.Array, state: pa.Array, last: pa.Array) -> pa.Array:
    """The trace of each string: (cost, audit, picks); see ``edits``."""
    t, n = tables(), len(symbols)
    behind, state, last = np.asarray(behind), np.asarray(state), np.asarray(last.cast(pa.int8())) > 0
    cost = np.zeros(n, np.int64)
    of, audits, picks, sizes, kept_sizes = [], [], [], [], []
    for some, matrix in _matrices(symbols):
        vector, grown, ended, tokens = t.run(matrix, behind[some], state[some])
        cost[some] = grown + t.vectors[vector, state[some]]
        made = [(t.end_edits[s] if x else []) for s, x in zip(ended.tolist(), last[some].tolist(), strict=True)]
        counts = t.count[tokens]
        flat = t.edits[ranges(t.first[tokens].ravel(), counts.ravel())]
        at = np.repeat(np.tile(np.arange(1, matrix.shape[1] + 1), len(some)), counts.ravel())
        lane = np.repeat(np.arange(len(some)), counts.sum(1))
        extra = np.array([x for e in made for x in e], np.int64)
        flat, at = np.append(flat, extra), np.append(at, np.zeros(len(extra), np.int64))
        lane = np.append(lane, np.repeat(np.arange(len(some)), [len(e) for e in made]))
        order = np.argsort(lane, kind="stable")
        flat, at, lane = flat[order], at[order], lane[order]
        kind = np.array([-1, 0, 1, 2, 1, 2])[flat]
        code = np.where(flat >= _NEW_USER, 0, at) * 4 + kind
        keep = kind >= 0
        of.append(some)
        audits.append(_LETTERS[flat])
        picks.append(code[keep])
        sizes.append(np.bincount(lane, minlength=len(some)))
        kept_sizes.append(np.bincount(lane[keep], minlength=len(some)))
    join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
    back = np.argsort(join(of, np.int64), kind="stable")
    size, kept = join(sizes, np.int64), join(kept_sizes, np.int64)
    letters = join(audits, np.uint8)[ranges((np.cumsum(size) - size)[back], size[back])]
    chosen = join(picks, np.int64)[ranges((np.cumsum(kept) - kept)[back], kept[back])]
    bounds = lambda x: pa.array(np.append(0, np.cumsum(x[back])).astype(np.int32))
    text = pa.Array.from_buffers(pa.string(), n, [None, bounds(size).buffers()[1], pa.py_buffer(letters.tobytes())])
    return pa.StructArray.from_arrays([pa.array(cost), text, pa.ListArray.from_arrays(bounds(kept), pa.array(chosen.astype(np.int32)))], names=["cost", "audit", "picks"])


def edits(symbols: Column, behind: Column, state: Column, last: Column) -> Column:
    """(cost, audit, picks) of a string of symbols: what is behind it (number of a cost vector), the state before it and whether it ends the conversation are given.

    A pick is four times the row's place (from 1; 0: a new row) and 0 for a kept role, 1 for user, 2 for assistant.
    """
    return F.arrow_udf(_edited, "cost long, audit string, picks array<int>")(symbols, behind, state, last)


def _mapped(symbols: pa.Array) -> pa.Array:
    """For each string, by vector behind: vector before (2 bytes), growth (8 bytes), state behind by state before (1 byte each)."""
    t = tables()
    count = len(t.vectors)
    out: list[bytes] = [b""] * len(symbols)
    for some, matrix in _matrices(symbols, lanes=4 * count):
        behind = np.tile(np.repeat(np.arange(count), 4), len(some))
        vector, grown, ended, _ = t.run(np.repeat(matrix, 4 * count, axis=0), behind, np.tile(np.arange(4), len(some) * count))
        for k, row in enumerate(some.tolist()):
            cut = slice(4 * count * k, 4 * count * (k + 1))
            out[row] = vector[cut][::4].astype("<i2").tobytes() + grown[cut][::4].astype("<i8").tobytes() + ended[cut].astype(np.uint8).tobytes()
    return pa.array(out, pa.binary())


_COMPOSED = "conv_id long, range long, behind int, state int, last boolean, total long, crossing long"


def _composed(found: pd.DataFrame) -> pd.DataFrame:
    """What is behind each range of one conversation and the state before it, from the ranges' functions; one small row a range."""
    t = tables()
    count = len(t.vectors)
    found = found.sort_values("range").reset_index(drop=True)
    n = len(found)
    maps = [(np.frombuffer(m, "<i2", count), np.frombuffer(m, "<i8", count, 2 * count), np.frombuffer(m, np.uint8, 4 * count, 10 * count).reshape(count, 4)) for m in found["map"]]
    behind, vector, total = np.zeros(n, np.int32), 0, 0
    for k in range(n - 1, -1, -1):
        behind[k] = vector
        total += int(maps[k][1][vector])
        vector = int(maps[k][0][vector])
    total += int(t.vectors[vector, 0])
    states, state, crossing, before = np.zeros(n, np.int32), 0, 0, ""
    for k in range(n):
        states[k] = state
        state = int(maps[k][2][behind[k], state])
        if found["head"][k]:
            crossing += bool(before) and before + found["head"][k] not in ("su", "ua", "au")
            before = found["tail"][k]
    return pd.DataFrame({"conv_id": found["conv_id"], "range": found["range"], "behind": behind, "state": states, "last": np.arange(n) == n - 1, "total": total, "crossing": crossing})


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with known damage, dealt by crc32 of ``conv_id:turn`` modulo 20 (a null is one space).

    0 drops the row (it stays, marked ``dropped``, so that its conversation stays known), 1 empties the text, 2 takes
    ``[.!?]`` out of it, 3 repeats the row, 4 sets the role user.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode("times").alias("time")).drop("time")


def _range_of(turn: Column, bucket: int) -> Column:
    """The range of a turn number, in whole numbers; null ones come before all others."""
    return F.coalesce((turn - F.pmod(turn, F.lit(bucket))) / bucket, F.lit(_NULL_RANGE)).cast("long")


def _ranges(rows: DataFrame, wide: DataFrame | None, bucket: int) -> DataFrame:
    """A row for each conversation and range: its rows in order, their symbols and initials. ``many``: the conversation has other ranges."""
    rest = F.rtrim("text", F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    mark = F.when(rest == "", "b").when(F.substring(rest, -1, 1).isin(*_ENDS), initial).otherwise(F.upper(initial))
    row = F.when(~F.col("dropped"), F.struct("turn", "role", "text", initial.alias("initial"), mark.alias("mark")))
    dealt = rows.select("conv_id", _range_of(F.col("turn"), bucket).alias("range"), row.alias("row"), F.lit(False).alias("many"))
    if wide is not None:
        dealt = dealt.unionByName(wide.withColumn("row", F.lit(None).cast(dealt.schema["row"].dataType)).withColumn("many", F.lit(True)))
    found = dealt.groupBy("conv_id", "range").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.max("many").alias("many"))
    # copies of earlier rows: neighbours in the order of role, text and place
    placed = found.withColumn("placed", F.array_sort(F.transform("rows", lambda r, i: F.struct(r.role.alias("role"), r.text.alias("text"), i.alias("i")))))
    same = F.zip_with("placed", F.slice("placed", 2, F.size("placed")), lambda x, y: F.when((x.role == y.role) & (x.text == y.text), y.i))
    placed = placed.withColumn("copies", F.filter(same, lambda i: i.isNotNull())).drop("placed")
    symbol = lambda r, i: F.when(r.mark == "b", "b").when(F.array_contains("copies", i), "d").otherwise(r.mark)
    return placed.select("conv_id", "range", "many", "rows", F.array_join(F.transform("rows", symbol), "").alias("symbols"), F.transform("rows", lambda r: r.initial).alias("initials"))


def _counts(found: DataFrame) -> DataFrame:
    """Adds what is counted in a range: faults, illegal neighbours and turn numbers."""
    number = lambda letters: (F.length("symbols") - F.length(F.translate("symbols", letters, ""))).cast("long")
    legal = lambda x, y: F.concat(x, y).isin("su", "ua", "au")
    illegal = F.size(F.filter(F.zip_with("initials", F.slice("initials", 2, F.size("initials")), lambda x, y: y.isNotNull() & ~legal(x, y)), lambda x: x)).cast("long")
    turns = F.transform(F.filter("rows", lambda r: r.turn.isNotNull()), lambda r: r.turn)
    return found.withColumns({"blank": number("b"), "duplicate": number("d"), "truncated": number("SUAO"), "illegal": illegal, "turns": F.size(F.array_distinct(turns)).cast("long"), "low": F.array_min(turns), "high": F.array_max(turns)})


def _repaired() -> Column:
    """The rows that are left or new, as ``role:text``, one a line; null without any."""
    row = lambda p: F.element_at("rows", F.floor(p / 4).cast("int"))
    role = lambda p: F.when(p % 4 == 0, row(p).role).when(p % 4 == 1, "user").otherwise("assistant")
    line = lambda p: F.concat(role(p), F.lit(":"), F.when(p < 4, "").otherwise(row(p).text))
    return F.when(F.size("edited.picks") > 0, F.array_join(F.transform("edited.picks", line), "\n"))


_RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def _gaps(low: Column, high: Column, turns: Column) -> Column:
    return F.coalesce(high - low + 1 - turns, F.lit(0)).cast("long")


def _short(found: DataFrame) -> DataFrame:
    """Conversations of one range."""
    traced = _counts(found).withColumn("edited", edits(F.col("symbols"), F.lit(0), F.lit(0), F.lit(True)))
    return traced.select("conv_id", _gaps(F.col("low"), F.col("high"), F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("edited.cost").alias("cost"), F.col("edited.audit").alias("audit"), F.coalesce(_repaired(), F.lit("")).alias("repaired"))


def _long(found: DataFrame) -> DataFrame:
    """Conversations of several ranges: copies between ranges by digest, functions of ranges put together, ranges traced side by side."""
    rows = written(found, "ranges")
    on = lambda x, y, *more: x["conv_id"].eqNullSafe(y["conv_id_"]) if not more else x["conv_id"].eqNullSafe(y["conv_id_"]) & (x[more[0]] == y[f"{more[0]}_"])
    renamed = lambda x: x.select(*[F.col(c).alias(f"{c}_") for c in x.columns])
    each = rows.select("conv_id", "range", "symbols", F.posexplode("rows").alias("i", "r")).filter(~F.substring("symbols", F.col("i") + 1, F.lit(1)).isin("b", "d"))
    keys = each.select("conv_id", "range", "i", F.sha2(F.concat(F.length("r.role").cast("string"), F.lit(":"), F.col("r.role"), F.col("r.text")).cast("binary"), 256).alias("key"))
    first = renamed(keys.groupBy("conv_id", "key").agg(F.min("range").alias("range")))
    again = keys.join(first, on(keys, first, "key")).filter("range > range_").groupBy("conv_id", "range").agg(F.collect_set("i").alias("again"))
    again = renamed(again)
    marks = rows.select("conv_id", "range", "symbols", F.when(F.size("initials") > 0, F.get("initials", F.lit(0))).alias("head"), F.when(F.size("initials") > 0, F.element_at("initials", -1)).alias("tail"))
    marks = marks.join(again, on(marks, again, "range"), "left").drop("conv_id_", "range_")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length("symbols"), F.lit(1))), lambda i: F.when(F.array_contains("again_", i - 1), "d").otherwise(F.substring("symbols", i, F.lit(1))))
    marks = written(marks.withColumn("symbols", F.when(F.col("again_").isNull(), F.col("symbols")).otherwise(F.array_join(every, ""))).drop("again_"), "symbols")
    mapped = marks.select("conv_id", "range", "head", "tail", F.arrow_udf(_mapped, "binary")("symbols").alias("map"))
    placed = renamed(mapped.groupBy("conv_id").applyInPandas(_composed, _COMPOSED))
    traced = marks.select("conv_id", "range", "symbols").join(placed, on(marks, placed, "range")).select("conv_id", "range", "symbols", F.col("total_").alias("total"), F.col("crossing_").alias("crossing"), edits(F.col("symbols"), F.col("behind_"), F.col("state_"), F.col("last_")).alias("edited"))
    traced = renamed(traced)
    whole = rows.drop("symbols").join(traced, on(rows, traced, "range")).drop("conv_id_", "range_")
    whole = _counts(whole.withColumnsRenamed({"symbols_": "symbols", "edited_": "edited"})).withColumn("part", F.struct("range", F.col("edited.audit").alias("audit"), _repaired().alias("repaired")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    done = whole.groupBy("conv_id").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.max("total_").alias("cost"), F.max("crossing_").alias("crossing"), F.sort_array(F.collect_list("part")).alias("parts"))
    joined = lambda c, by: F.array_join(F.transform("parts", lambda p: p[c]), by)
    return done.select("conv_id", _gaps(F.col("low"), F.col("high"), F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("crossing")).alias("illegal"), "cost", joined("audit", "").alias("audit"), joined("repaired", "\n").alias("repaired"))


def repair(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): the cheapest repair of each conversation.

    ``rows``: conv_id, turn, role, text and, if given, ``dropped`` (such a row only makes its conversation known). A
    conversation's rows are taken by turn (nulls first; ties by role, then text). Null roles and texts are one space; rows of
    a null conv_id are one conversation. Keep costs 0, Rerole 3, Delete 4 (a must for blank rows and copies of earlier ones), Insert 3, a
    truncated row that stays 3 more. ``audit`` is the edits' initials, the least in ASCII among the cheapest, so that the
    roles' initials match ``(s?(ua)+)?``; ``repaired`` the rows that result. Rows of ``bucket`` consecutive turn numbers of a
    conversation are one group, however often a number repeats. An empty table gives an empty table; other columns are not read.
    """
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    places = rows.select("conv_id", _range_of(F.col("turn"), bucket).alias("range")).distinct()
    wide = places.groupBy("conv_id").agg(F.collect_list("range").alias("ranges")).filter(F.size("ranges") > 1)
    wide = written(wide.select("conv_id", F.explode("ranges").alias("range")), "wide")
    if wide.isEmpty():
        return _short(_ranges(rows, None, bucket))
    found = _ranges(rows, wide, bucket)
    return _short(found.filter(~F.col("many"))).unionByName(_long(found.filter("many")))


def digest(repaired: DataFrame) -> DataFrame:
    return repaired.select(*_RESULT[:-1], F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
