"""Conversation repair against a search over all edits, short and cut into blocks."""

import hashlib
import heapq
import random
import zlib

import pytest

from pulseframe.llm import conversations as C
from tests.oracle import check

TURNS = "conv_id long, turn long, role string, text string, n int, part int, gone boolean"


def cheapest(rows):
    """Least (cost, audit) by a best-first search over (row, state), whole strings compared. rows: (initial, must go, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        role = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", at, role))
        if at < len(rows):
            initial, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if not gone:
                if initial == role or initial == "s" and state == "":
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", at + 1, initial))
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", at + 1, role))


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        own = []
        for c, turn, role, text in table:
            if c == conv:
                blank = " "
                kind = zlib.crc32(f"{blank if c is None else c}:{blank if turn is None else turn}".encode()) % 20
                role, text = role if role is not None else " ", text if text is not None else " "
                role, text = "user" if kind == 4 else role, "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
                own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, rows, faults = set(), [], []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            rows.append((role[:1], faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
            seen.add((role, text))
        cost, audit = cheapest(rows)
        lines, at, state = [], 0, ""
        for e in audit:
            role = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(role + ":")
                state = role[0]
                continue
            _, was, text = own[at]
            at += 1
            if e != "D":
                lines.append((was if e == "K" else role) + ":" + text)
                state = was[0] if e == "K" else role[0]
        turns = [t for t, *_ in own if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, table):
    got = C.report(C.damaged(spark.createDataFrame([(*r, 1, 2, True) for r in table], TURNS).repartition(3))).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}


def table_of(seed, n_conv=60, longest=25):
    r = random.Random(seed)
    out = []
    for c in range(n_conv):
        turn = 0
        for i in range(r.randrange(1, longest)):
            turn += r.choice((1, 1, 1, 2, 0))
            role = r.choice(("system",) * (i == 0) * 3 + ("user", "assistant") * 4 + ("tool", "", None, "system"))
            out.append((c, turn if r.random() < 0.95 else None, role, r.choice(("Yes.", "No!", "well", "a. \t", "", " ", None, "Ünï?", f"t{i}.", f"t{i}.", f"t{i}."))))
    return out + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, 2, "assistant", "Ho."), (None, None, None, None)]


@pytest.mark.parametrize("block", [1024, 4])
def test_equals_search(spark, monkeypatch, block):
    """Also with conversations cut into many blocks."""
    monkeypatch.setattr(C, "BLOCK", block)
    table = table_of(block)
    assert found(spark, table) == brute(table)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 20)
    r = random.Random(4)
    table = [(7, i // 2 if i % 50 else None, r.choice(("user", "assistant", "system")), r.choice(("Same.", f"t{i}.", f"t{i}", ""))) for i in range(700)] + [(8, 1, "user", "Hi."), (8, 2, "assistant", "Ho.")]
    assert found(spark, table) == brute(table)


def test_conversations_without_rows(spark):
    gone = [(c, t, "user", "Hi.") for c in range(200) for t in (1,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone and set(found(spark, gone).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}


def test_turns_come_out(spark):
    turns = spark.createDataFrame([(1, 1, "user", "Hi.", False), (1, 2, "user", "There?", False), (2, 1, "assistant", "Cut", False)], "conv_id long, turn long, role string, text string, gone boolean")
    got = sorted(tuple(r) for r in C.repaired_turns(turns).select("conv_id", "place", "role", "text").collect())
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", "There?")]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 1000])
def test_walk_costs_what_the_vectors_say(n):
    r = random.Random(n)
    symbols = "".join(r.choice("DsuaxSUAX") for _ in range(n))
    edits, state = C.walk(symbols, C.END, C.START)
    edits += C.closing(state)
    turns, cost = C.apply(edits, symbols, [(0, "r", "t")] * n, C.START)
    assert cost == C.costs_before(symbols, C.END)[C.START] == cheapest([(s.lower() if s != "D" else "x", s == "D", s.isupper() and s != "D") for s in symbols])[0]


def test_sql(spark, sf):
    check(spark, "op13", C.op13_checkpointed_repair, C.OP13_SQL, sf)
