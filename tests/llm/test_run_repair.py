"""Structure repair against exhaustive search, a plain dynamic program over strings, and the whole query by brute force."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from deckloom.llm import run_repair
from deckloom.llm.queries import QUERIES
from deckloom.llm.run_repair import History, Repair, precedes, repair_messages, repair_report

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
SF_DIR = "/root/testdata/sf0.001"


def allowed(state, initial):
    return initial == NEXT[state] or (state == "" and initial == "s")


def strings(rows, most_inserts):
    """Every edit string with its cost that repairs rows of (initial, fault)."""
    def go(i, state):
        for k in range(most_inserts + 1):
            at = state
            for _ in range(k):
                at = NEXT[at]
            if i == len(rows):
                if at in ("", "a"):
                    yield "I" * k, 2 * k
                continue
            initial, fault = rows[i]
            left = fault == "truncated"
            options = [("D", at, 3)]
            if fault not in ("blank", "duplicate"):
                options.append(("R", NEXT[at], 2 + left))
                if allowed(at, initial):
                    options.append(("K", initial, left))
            for edit, then, cost in options:
                for rest, more in go(i + 1, then):
                    yield "I" * k + edit + rest, 2 * k + cost + more
    return min((cost, text) for text, cost in go(0, ""))


def plain(rows):
    """The same by a table of strings for each state."""
    def inserted(front):
        new = dict(front)
        for state, (cost, text) in front.items():
            new[NEXT[state]] = min(new.get(NEXT[state], (cost + 2, text + "I")), (cost + 2, text + "I"))
        return new

    front = {"": (0, "")}
    for initial, fault in rows:
        now, left = {}, fault == "truncated"
        for state, (cost, text) in inserted(front).items():
            options = [(state, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                options.append((NEXT[state], cost + 2 + left, "R"))
                if allowed(state, initial):
                    options.append((initial, cost + left, "K"))
            for then, price, edit in options:
                now[then] = min(now.get(then, (price, text + edit)), (price, text + edit))
        front = now
    front = inserted(front)
    return min(front[s] for s in ("", "a") if s in front)


def edits(rows):
    repair, out = Repair(), []
    for initial, fault in rows:
        out += repair.add((0, {"s": "system", "u": "user", "a": "assistant"}.get(initial, initial), "t", fault))
    return "".join(e for e, _, _ in out + repair.finish())


def cost_of(rows, audit):
    cost, i = 0, 0
    for edit in audit:
        cost += COST[edit]
        if edit != "I":
            cost += rows[i][1] == "truncated" and edit != "D"
            i += 1
    return cost


FAULTS = [None, "blank", "duplicate", "truncated"]


def test_exhaustive():
    for n in range(4):
        for initials in product("suax", repeat=n):
            for faults in product([None, "blank", "truncated"], repeat=n):
                rows = list(zip(initials, faults))
                assert edits(rows) == strings(rows, 2 if n < 3 else 1)[1], rows


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7, 1])
def test_long_runs(monkeypatch, modulus):
    """Against the plain program, with a good hash and with hashes that collide often or always."""
    monkeypatch.setattr(run_repair, "MODULUS", modulus)
    rng = random.Random(modulus)
    for n in (1, 5, 63, 64, 65, 300):
        for weights in ((1, 4, 4, 1), (0, 1, 0, 0), (1, 1, 1, 1), (5, 1, 1, 0), (0, 0, 1, 0)):
            rows = [(rng.choices("suax", weights)[0], rng.choices(FAULTS, (6, 1, 1, 2))[0]) for _ in range(n)]
            audit = edits(rows)
            assert (cost_of(rows, audit), audit) == plain(rows)


def test_order_of_histories():
    rng = random.Random(5)
    root = History(None)
    chains = [("", root)]
    for _ in range(300):
        text, node = rng.choice(chains)
        edit = rng.choice("DIKR")
        chains.append((text + edit, History(node, edit)))
    for _ in range(2000):
        (a, x), (b, y) = rng.choice(chains), rng.choice(chains)
        if a != b:
            assert precedes(x, y) == (a < b)


def brute(rows):
    """Report of one run from (turn, role, text) rows, nulls kept."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        ends = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not ends else "duplicate" if (role, text) in seen else None if ends[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit = plain([(r[1][:1], f) for r, f in zip(rows, faults)])
    state, i, out = "", 0, []
    for edit in audit:
        role, text = rows[i][1:] if edit != "I" else ("", "")
        i += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = {"u": "user", "a": "assistant"}[NEXT[state]]
        state = role[:1]
        out.append(f"{role}:{text}")
    turns = {r[0] for r in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_runs_of_the_project(spark):
    """Runs with text ids, nulls, ties, repeats, clashing columns, other roles and a run of thousands of messages."""
    rng = random.Random(9)
    texts = ["Plan the deck.", "Done!", "cut o", "", " \n", None, "Why?", "wide ", "Ünï."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    runs = {f"t{i}": [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 12))]
            for i in range(60)}
    runs["long"] = [(i, ["user", "assistant"][i % 2 if i % 7 else rng.randrange(2)], f"{i}.") for i in range(4000)]
    runs[None] = [(1, "user", "Hi."), (1, "user", "Hi."), (2, "assistant", "x" * 300_000)]
    rows = [(k, *r, "x", 7) for k, own in runs.items() for r in own]
    rng.shuffle(rows)
    messages = spark.createDataFrame(rows, "trace_id string, turn bigint, role string, text string, edit string, _at int")
    traces = spark.createDataFrame([("none",), ("t1",), ("t1",)], "trace_id string")
    got = {r["trace_id"]: tuple(r[f] for f in FACTS) for r in repair_report(repair_messages(messages.repartition(3), traces)).collect()}
    assert got == {k: brute(own) for k, own in (runs | {"none": []}).items()}


def test_edit_rows(spark):
    messages = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "ok")],
                                     "trace_id bigint, turn bigint, role string, text string")
    got = [tuple(r) for r in repair_messages(messages).orderBy("place").collect()]
    assert got == [(1, 1, "K", 0, "user", "Hi.", "user", None), (1, 2, "D", 1, "user", "Hi.", "user", "duplicate"),
                   (1, 3, "R", 2, "assistant", "ok", "tool", "truncated")]


def test_empty(spark):
    messages = spark.createDataFrame([], "trace_id string, turn bigint, role string, text string")
    assert repair_report(repair_messages(messages)).count() == 0


def test_query(spark):
    """The registered query on the whole table, damaged and repaired by brute force."""
    runs = {}
    for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect():
        own = runs.setdefault(r["conv_id"], [])
        harm = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = r["role"], r["text"]
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        own += [(r["turn"], "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    got = {r["conv_id"]: tuple(r[f] for f in FACTS) for r in QUERIES["op11_run_repair"](spark, SF_DIR).collect()}
    assert got == {k: brute(own) for k, own in runs.items()}
