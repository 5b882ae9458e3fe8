"""Chat formatting in budgeted windows, by DataFrame functions alone.

A turn is written between marks that tell its role; control strings inside texts are broken by an escape that can be
undone. Long conversations are cut into windows of at most ``budget`` tokens: prefix sums of the turns' tokens say how many whole
turns still fit, every window begins with the system turn and with some turns of history, and the loss mask names only the
assistant texts that are new in a window.

Rows meet by (conversation, range of RANGE turn numbers), one exchange of the text; windows don't span two ranges, so that no
task holds more than a range. A range's last turns are sent to the next range as history, and the system turn to every range of
its conversation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers of a range, tokens of a window, tokens and turns of its history, tokens that a turn's marks count.
RANGE, BUDGET, HISTORY, HISTORY_TURNS, MARK_TOKENS = 256, 512, 128, 8, 2
_NULL_RANGE = -(1 << 56)
#: A token is a run of ASCII word characters or another visible character.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D ]"


@dataclass(frozen=True)
class Template:
    """Opening and closing marks by role; other roles are named between two marks of their own.

    Marks begin with one of the ``escapes``' characters and hold no other mark; the escape letters stand for these characters and
    for the backslash (``s``).
    """

    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    escapes: tuple[tuple[str, str], ...] = (("<", "a"), ("[", "b"))

    @property
    def marks(self) -> tuple[str, ...]:
        """All control strings."""
        return tuple(m for _, *pair in self.roles for m in pair) + self.other

    def escaped(self, text: Column) -> Column:
        letter = dict(self.escapes)
        return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(f"\\{letter[m[0]]}{m[1:]}")), self.marks, F.replace(text, F.lit("\\"), F.lit("\\s")))

    def unescaped(self, text: Column) -> Column:
        plain = reduce(lambda c, x: F.replace(c, F.lit(f"\\{x[1]}"), F.lit(x[0])), self.escapes, text)
        return F.replace(plain, F.lit("\\s"), F.lit("\\"))

    def opened(self, role: Column) -> Column:
        """What comes before a turn's text."""
        named = F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.other[1]))
        return reduce(lambda c, r: F.when(role == r[0], F.lit(r[1])).otherwise(c), self.roles, named)

    def closed(self, role: Column) -> Column:
        return reduce(lambda c, r: F.when(role == r[0], F.lit(r[2])).otherwise(c), self.roles, F.lit(self.other[2]))

    def turns(self, formatted: Column) -> Column:
        """The turns (role, text) of a formatted window."""
        quoted = lambda m: f"\\Q{m}\\E"
        pattern = "(?s)" + "|".join(f"{quoted(a)}.*?{quoted(b)}" for a, b in [*(r[1:] for r in self.roles), (self.other[0], self.other[2])])
        inner = lambda p, a, b: F.substr(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))

        def parsed(piece: Column) -> Column:
            named = inner(piece, self.other[0], self.other[2])
            role = F.substring_index(named, self.other[1], 1)
            text = F.substr(named, F.length(role) + len(self.other[1]) + 1)
            for name, a, b in self.roles:
                here = F.startswith(piece, F.lit(a))
                role, text = F.when(here, F.lit(name)).otherwise(role), F.when(here, inner(piece, a, b)).otherwise(text)
            return F.struct(self.unescaped(role).alias("role"), self.unescaped(text).alias("text"))

        return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), parsed)


TEMPLATE = Template()


def _prefixes(values: Column) -> Column:
    """0 and the sums of the first 1, 2, ... values (long)."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def ranges_of_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, span: int = RANGE, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, range, many, windows): the windows of each range of a conversation in order; ``many``: it has other ranges. See ``format_windows``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    of = F.coalesce((F.col("turn") - F.pmod("turn", F.lit(span))) / span, F.lit(_NULL_RANGE)).cast("long")
    body, opened = template.escaped(F.col("text")), template.opened(F.col("role"))
    rows = rows.withColumn("range", of).withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + MARK_TOKENS).cast("long")).withColumns({"body": body, "opened": opened})
    turn = F.struct("turn", "role", F.concat("opened", "body", template.closed(F.col("role"))).alias("written"), "tokens", F.length("opened").alias("lead"), F.length("body").alias("size"))
    rows = rows.select("conv_id", "range", turn.alias("row"))
    # 0: the system turn of an earlier range, 1: history from the range before, 2: turns of the range itself
    ahead = (F.pmod("row.turn", F.lit(span)) >= span - history_turns) & F.lit(history_turns > 0)
    placed = F.when(ahead, F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("more")), F.struct(F.lit(1).alias("kind"), F.lit(1).alias("more")))).otherwise(F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("more"))))
    sent = rows.withColumn("p", F.explode(placed)).select("conv_id", (F.col("range") + F.col("p.more")).alias("range"), F.struct(F.col("p.kind").alias("kind"), "row.*").alias("row"), F.lit(False).alias("many"))
    places = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).select("conv_id", of.alias("range")).distinct()
    wide = places.groupBy("conv_id").agg(F.collect_list("range").alias("ranges")).filter(F.size("ranges") > 1).select("conv_id", F.explode("ranges").alias("range"))
    heads = rows.filter("row.role = 'system'").groupBy(F.col("conv_id").alias("of")).agg(F.min(F.struct("range", "row")).alias("head"))
    known = wide.join(heads, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    copy = F.when(F.col("head.range") < F.col("range"), F.struct(F.lit(0).alias("kind"), "head.row.*"))
    sent = sent.unionByName(known.select("conv_id", "range", copy.alias("row"), F.lit(True).alias("many")))
    met = sent.groupBy("conv_id", "range").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.max("many").alias("many"))
    met = met.withColumn("low", F.size(F.filter("rows", lambda r: r.kind < 2)) + 1).filter(F.size("rows") >= F.col("low"))
    system = F.array_position(F.transform("rows", lambda r: (r.kind != 1) & (r.role == "system")), F.lit(True)).cast("int")
    met = met.withColumns({"system": system, "sums": _prefixes(F.transform("rows", lambda r: r.tokens)), "places": _prefixes(F.transform("rows", lambda r: F.length(r.written).cast("long")))})
    before = lambda a, i: F.element_at(a, i.cast("int"))  # noqa: E731  the sum of what comes before the i-th
    tokens = lambda i: before("sums", i + 1) - before("sums", i)
    kept = lambda i: (F.col("system") > 0) & (F.col("system") < i)
    held = lambda i: F.when(kept(i), tokens(F.col("system"))).otherwise(F.lit(0).cast("long"))

    def repeated(i: Column) -> Column:
        """How many turns before the i-th fit as history."""
        room = F.least(F.lit(history), F.greatest(F.lit(0), F.lit(budget) - held(i) - tokens(i)))
        fits = lambda k: (i - k > F.col("system")) & (before("sums", i) - before("sums", F.greatest(i - k, F.lit(1))) <= room)
        return F.size(F.filter(F.sequence(F.lit(1), F.lit(max(1, history_turns))), fits)).cast("int") if history_turns > 0 else F.lit(0).cast("int")

    window = "array<struct<first:int,back:int,used:bigint>>"
    new = lambda i, back: F.struct(i.cast("int").alias("first"), back.alias("back"), (held(i) + before("sums", i + 1) - before("sums", i - back)).alias("used"))

    def packed(done: Column, i: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).used + tokens(i) <= budget)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.first.alias("first"), last.back.alias("back"), (last.used + tokens(i)).alias("used"))))
        return F.when(fits, grown).otherwise(F.concat(done, F.array(new(i, repeated(i)))))

    cut = met.withColumn("cut", F.aggregate(F.sequence(F.col("low"), F.size("rows")), F.array().cast(window), packed))

    def built(w: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at("cut", k + 2).first - 1, F.size("rows"))
        start = w.first - w.back
        lead = F.when(kept(w.first), F.array(before("rows", F.col("system")).written)).otherwise(F.array().cast("array<string>"))
        at = F.when(kept(w.first), F.length(before("rows", F.col("system")).written)).otherwise(0)
        parts = F.concat(lead, F.transform(F.slice("rows", start, end - start + 1), lambda r: r.written))
        targets = F.filter(F.sequence(w.first, end), lambda i: before("rows", i).role == "assistant")
        loss = F.transform(targets, lambda i: F.struct((at + before("places", i) - before("places", start) + before("rows", i).lead).cast("int").alias("start"), before("rows", i).size.alias("length")))
        return F.struct(k.cast("int").alias("window"), w.used.alias("n_tokens"), (w.back + F.size(lead)).alias("n_repeated"), (end - w.first + 1).alias("n_new"), F.array_join(parts, "").alias("formatted"), loss.alias("loss"))

    return cut.select("conv_id", "range", "many", F.transform("cut", built).alias("windows"))


def format_windows(conversations: DataFrame, **options) -> DataFrame:
    """(conv_id, range, window, n_tokens, n_repeated, n_new, formatted, loss): training windows of all conversations.

    A window holds the conversation's first system turn (if it comes earlier), up to ``history`` tokens of the ``history_turns`` turns
    before, and as many whole new turns as ``budget`` tokens allow, at least one: a single turn beyond the budget is a
    window of its own. ``loss`` lists (start, length) of the new assistant texts in ``formatted``, in characters; repeated turns come first
    (``n_repeated``) and are never in it. Rows are taken by turn (nulls first; ties by role and text); null roles and texts are
    empty; rows of a null conv_id are one conversation; repeated rows are turns of their own. A window ends where a range of ``span`` turn numbers does;
    history doesn't reach over a whole empty range, nor beyond rows without a turn number. Other columns are not read, an empty table gives an empty one.
    """
    return ranges_of_windows(conversations, **options).select("conv_id", "range", F.explode("windows").alias("w")).select("conv_id", "range", "w.*")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts are full of control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return rows.unionByName(probe)


def digest(found: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests by conversation of ``ranges_of_windows``, read back from the formatted windows.

    Conversations of one range are digested where they are; of longer ones the texts are put together, as one digest asks for.
    """
    turns = F.flatten(F.transform("windows", lambda w: F.slice(template.turns(w.formatted), w.n_repeated + 1, F.greatest(w.n_new, F.lit(1)))))
    said = F.flatten(F.transform("windows", lambda w: F.transform(w.loss, lambda x: template.unescaped(F.substr(w.formatted, x.start + 1, x.length)))))
    read = found.select("conv_id", "range", "many", turns.alias("turns"), F.array_join(said, "").alias("loss"), F.aggregate("windows", F.lit(0).cast("long"), lambda n, w: n + F.length(w.formatted)).alias("formatted_chars"))
    read = read.select("conv_id", "range", "many", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"), "loss", "formatted_chars")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    small = read.select("conv_id", "n_turns", "formatted_chars", F.length("loss").cast("long").alias("loss_chars"), F.when(~F.col("many"), F.struct(sha(F.col("turns")).alias("turns"), sha(F.col("loss")).alias("loss"))).alias("done"), F.when(F.col("many"), F.struct("range", "turns", "loss")).alias("part"))
    whole = small.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.sum("loss_chars").alias("loss_chars"), F.max("done").alias("done"), F.sort_array(F.collect_list("part")).alias("parts"))
    joined = lambda c: sha(F.array_join(F.transform("parts", lambda p: p[c]), ""))
    return whole.select("conv_id", "n_turns", F.coalesce(F.col("done.turns"), joined("turns")).alias("turns_sha256"), "loss_chars", F.coalesce(F.col("done.loss"), joined("loss")).alias("loss_sha256"), "formatted_chars")
