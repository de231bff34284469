"""Repair of conversations against an independent search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from reviewlens.llm import conversations

SPACE = "[\x20\x09-\x0D]"
STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
CLASHING = "_at _part _conv codes places audit cost state last end key first".split()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = spaced[2], spaced[3]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def judged(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub(f"{SPACE}+$", "", text)
        fault = "blank" if not re.search("[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, faults):
    """Shortest path over (place, state), by cost and then by the audit so far among equal lengths of it."""
    # Uniform-cost search that keeps, per node, all audits of least cost; small inputs only.
    best, heap = {}, [(0, "", 0, "", ())]
    done = {}
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if done.get((i, state), cost) < cost or (i, state, audit) in best:
            continue
        done[i, state], best[i, state, audit] = cost, made
        for role in ("user", "assistant"):
            if role[0] in STATES[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*made, (role, ""))))
        if i == len(rows):
            continue
        (_, _, role, text), fault = rows[i], faults[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 if fault == "truncated" else 0
        if role[:1] in STATES[state]:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*made, (role, text))))
        for other in ("user", "assistant"):
            if other[0] in STATES[state]:
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, other[0], (*made, (other, text))))
    n = len(rows)
    least = min(done[n, s] for s in ("", "a") if (n, s) in done)
    audit, made = min((a, m) for (i, s, a), m in best.items() if i == n and s in ("", "a") and done[i, s] == least)
    return least, audit, made


def expected(rows, brute=True):
    after, out = damaged(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest()))
        faults = judged(own)
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = cheapest(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def sample(conversations=60, longest=7, seed=1):
    rng, rows = random.Random(seed), []
    texts = ["Hello there.", "no end", "Why?", "", " \t\n", None, "End! \n", "Hello there.", "x", "a.b"]
    for conv in [*range(conversations), None]:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", "", "sage"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, rng.choice(texts)))
    # Every turn of these is dropped.
    dropped = [(c, t) for c in range(1000, 1100) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    return rows + [(c, t, "user", "Gone.") for c, t in dropped] + rows[:5]


def table(spark, rows):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], f"conv_id long, turn long, role string, text string, {extra}").repartition(3)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows_per_range", [20_000, 20])
def test_repair_equals_search_over_all_edits(spark, rows_per_range):
    """Also with conversations cut into several segments."""
    rows = sample()
    assert result(conversations.repair(table(spark, rows), rows_per_range=rows_per_range)) == expected(rows)


def test_segments_do_not_change_a_long_conversation(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"Turn {t}.", ""])) for t in range(900)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(8, 30) for t in range(10)]
    whole = result(conversations.repair(table(spark, rows)))
    cut = conversations.segments(conversations.faults(conversations.ordered(conversations.damage(table(spark, rows)), rows_per_range=100)))
    assert cut.where("conv_id = 7").count() > 3
    assert result(conversations.repair(table(spark, rows), rows_per_range=100)) == whole


def test_equal_rows_throughout_are_split(spark):
    rows = [(1, 1, "user", "Same.")] * 500
    placed = conversations.ordered(table(spark, rows).select("conv_id", "turn", "role", "text"), rows_per_range=50)
    assert placed.groupBy("_part").count().agg({"count": "max"}).first()[0] < 250
    (row,) = conversations.repair(table(spark, rows), damaged=False, rows_per_range=50).collect()
    assert (row["duplicate"], row["cost"], row["audit"]) == (499, 4 * 499 + 3, "K" + "D" * 499 + "I")


def test_empty_table(spark):
    out = conversations.repair(table(spark, []).limit(0))
    assert out.count() == 0
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_checkpoints_give_the_same_walk_as_all_vectors():
    rng = random.Random(8)
    for _ in range(200):
        codes = "".join(rng.choice(conversations.FINE + conversations.GONE + conversations.CUT) for _ in range(rng.randrange(40)))
        audit, roles, state, cost = conversations.walk(codes, conversations.END, conversations.NOTHING, True)
        spent = {"K": 0, "R": 3, "D": 4, "I": 3}
        at, total = 0, 0
        for edit in audit:
            total += spent[edit] + (3 if edit in "KR" and codes[at] in conversations.CUT else 0)
            assert edit != "K" or codes[at] not in conversations.GONE
            at += edit != "I"
        assert total == cost and at == len(codes) and state in (conversations.NOTHING, conversations.ASSISTANT) and len(roles) == len(audit)
        assert cost == conversations.through(conversations.matrix(codes), conversations.END)[conversations.NOTHING]


def test_a_very_long_text_is_read_to_its_end(spark):
    rows = [(1, 1, "user", "word " * 200_000 + "end."), (1, 2, "assistant", " " * 300_000 + "no end" + " " * 300_000)]
    (row,) = conversations.repair(table(spark, rows), damaged=False).collect()
    assert (row["truncated"], row["blank"], row["audit"]) == (1, 0, "KK")
