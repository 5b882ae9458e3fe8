"""Conversation repair and chat formatting against plain versions."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb

from tracewarden.llm import chat, oracle, repair

SF = "/root/testdata/sf0.001"
sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged_brute(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            out.append((conv, None))
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, (turn, role, text))] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit) by trying all edits at all places, with at most two new rows before each."""

    @lru_cache(None)
    def best(i, state, new):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if new < 2:
            q, role = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}[state]
            c, a, t = best(i, q, new + 1)
            found.append((c + 3, "I" + a, (f"{role}:", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for letter, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    q = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, name[:1] if letter == "K" else name[0]))
                    if q is not None:
                        c, a, t = best(i + 1, q, 0)
                        found.append((c + price + more, letter + a, (f"{name}:{text}", *t)))
        return min(found) if found else (10**9, "", ())

    return best(0, 0, 0)


def repaired_brute(rows):
    conversations = {}
    for conv, row in damaged_brute(rows):
        conversations.setdefault(conv, []).extend([row] if row else [])
    out = []
    for conv, found in conversations.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            rest = text.rstrip(WHITE)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(found, found[1:]))
        cost, audit, texts = cheapest(found, faults)
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(texts))))
    return sorted(out, key=str)


def random_rows(rng, n, convs=12, turns=14):
    texts = ["Good.", "Good.", "Fine!", "cut off", "", " \t", None, "Why? ", "a.b", "Ends. \x0b", "é…", "Line\ntwo."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "User"]
    rows = [(rng.choice([None, *range(convs)]), rng.choice([None, *range(turns)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    return rows + rng.choices(rows, k=n // 10)


def repaired(spark, rows, bucket=repair.BUCKET):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, repair.digest(repair.repair(repair.damage(df), bucket=bucket)).collect()), key=str)


def test_repair_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert repaired(spark, rows) == repaired_brute(rows)


def test_repair_random(spark):
    rng = random.Random(3)
    rows = random_rows(rng, 240)
    want = repaired_brute(rows)
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, bucket=4) == want  # many ranges of a conversation
    assert repaired(spark, [], bucket=4) == []


def test_long_conversation(spark):
    """One conversation holds most rows: ranges of 16 turn numbers and one range give the same."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"Number {t}.", f"cut {t}", ""])) for t in range(-50, 650)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    want = repaired_brute(rows)
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, bucket=16) == want


def test_tables_against_all_strings():
    """Costs and audits of all strings of up to four symbols, and of longer random ones."""
    import itertools

    import pyarrow as pa

    rng = random.Random(1)
    cases = ["".join(x) for n in range(5) for x in itertools.product("bsuaoUA", repeat=n)] + ["".join(rng.choices("bdsuaoSUAO", k=rng.randint(5, 40))) for _ in range(300)]
    n = len(cases)
    found = repair._edited(pa.array(cases), pa.array([0] * n), pa.array([0] * n), pa.array([True] * n)).to_pylist()
    for case, got in zip(cases, found):
        rows = [(0, {"b": "x", "d": "x", "o": "x"}.get(c.lower(), c.lower()), "t") for c in case]
        faults = ["blank" if c in "bd" else "truncated" if c.isupper() else "" for c in case]
        cost, audit, _ = cheapest(rows, faults)
        assert (got["cost"], got["audit"]) == (cost, audit), case


def chat_brute(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return sorted([(c, len(r), sha("".join(f"{x[2]}\n{x[3]}\n" for x in r)), sum(len(x[3]) for x in r if x[2] == "assistant"), sha("".join(x[3] for x in r if x[2] == "assistant"))) for c, r in ((c, sorted(r)) for c, r in conversations.items())], key=str)


HARD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\s\\a\\b", "<<SYS>>x<</SYS>>", "<", "<<", "<<s>", "[[INST]", "[END][/ROLE]", "tail <", "é  ü\n", "<s>" * 5, "\\<s>", "😀 [ROLE]", None]


def test_chat_round_trip(spark):
    """Unique turns, so that the order by turn is the only one; ranges of four turn numbers and one range alike."""
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE]", "", None]), "".join(rng.choice(HARD) or "" for _ in range(rng.randint(0, 4)))) for c in (None, 1, 2, 3) for t in [None, *rng.sample(range(-20, 40), 25)]]
    rows.append((5, None, "assistant", None))
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"span": 4, "history_turns": 2}, {"budget": 9, "history": 5}, {"budget": 1, "history": 0, "history_turns": 0}):
        found = chat.digest(chat.ranges_of_windows(df, **options))
        assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == chat_brute(rows), options
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digest(chat.ranges_of_windows(empty)).count() == 0
    assert [r.n_turns for r in chat.digest(chat.ranges_of_windows(chat.with_probe(empty))).collect()] == [2]


def test_windows(spark):
    """Budget, system turn, history and mask of every window, by a plain packing of the turns."""
    rng = random.Random(6)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], " ".join("w" for _ in range(rng.randint(0, 12)))) for c in range(6) for t in range(30)]
    found = chat.format_windows(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", window string"), budget=30, history=10, history_turns=3)
    windows = {}
    for w in found.collect():
        windows.setdefault(w.conv_id, []).append(w)
    for c in range(6):
        mine = [r for r in rows if r[0] == c]
        n = [len(re.findall(r"\w+", r[3])) + 2 for r in mine]
        i = 0
        for w in sorted(windows[c], key=lambda w: w.window):
            used = n[0] if i and c % 2 else 0
            room, back = min(10, max(0, 30 - used - n[i])), 0
            while back < 3 and i - back - 1 >= c % 2 and sum(n[i - back - 1 : i]) <= room:
                back += 1
            used += sum(n[i - back : i])
            j = i
            while j < 30 and (j == i or used + n[j] <= 30):
                used += n[j]
                j += 1
            turns = ([mine[0]] if i and c % 2 else []) + mine[i - back : j]
            marks = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
            text, loss = "", []
            for k, (_, _, role, said) in enumerate(turns):
                text += marks[role][0]
                if role == "assistant" and k >= len(turns) - (j - i):
                    loss.append((len(text), len(said)))
                text += said + marks[role][1]
            assert (w.formatted, [tuple(x) for x in w.loss], w.n_tokens, w.n_repeated, w.n_new) == (text, loss, used, len(turns) - (j - i), j - i)
            i = j
        assert i == 30


def test_history_and_system_of_later_ranges(spark):
    rows = [(1, 0, "system", "rule")] + [(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(1, 20)]
    found = chat.format_windows(spark.createDataFrame(rows, SCHEMA), span=8, history_turns=2, budget=100).orderBy("range").collect()
    assert [w.n_repeated for w in found] == [0, 3, 3]
    assert found[1].formatted.startswith("<<SYS>>rule<</SYS>>[INST]t6[/INST]<s>t7</s>[INST]t8[/INST]")


def test_chat_is_native(spark):
    df = chat.digest(chat.ranges_of_windows(chat.with_probe(spark.read.parquet(f"{SF}/conversations.parquet"))))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|MapPartitions", plan)


def test_chat_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = db.execute(oracle.CHAT)
    names = [d[0] for d in want.description]
    got = chat.digest(chat.ranges_of_windows(chat.with_probe(spark.read.parquet(f"{SF}/conversations.parquet"))))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
