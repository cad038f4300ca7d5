"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib

from kinweave.llm import repair

RNG = random.Random(7)


def plain_best(rows):
    """(cost, audit, lines) of the cheapest edits of rows (role, text, fault), of equal cost the least audit."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def put_in(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, lines) in list(out.items()):
                t = "a" if s == "u" else "u"
                one = (cost + 3, audit + "I", (*lines, ("assistant" if t == "a" else "user", "")))
                if t not in out or one < out[t]:
                    out[t] = one
        return out

    for role, text, fault in rows:
        now = {}

        def offer(s, one):
            if s not in now or one < now[s]:
                now[s] = one

        for s, (cost, audit, lines) in put_in(best).items():
            offer(s, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            t = "a" if s == "u" else "u"
            offer(t, (cost + 3 + more, audit + "R", (*lines, ("assistant" if t == "a" else "user", text))))
            if role[:1] in follow[s]:
                offer(follow[s][role[:1]], (cost + more, audit + "K", (*lines, (role, text))))
        best = now
    return min(v for s, v in put_in(best).items() if s in ("", "a"))


def plain_repair(turns):
    told = {}
    for conv, turn, role, text in turns:
        rows = told.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in told.items():
        rows.sort()
        seen, faults = set(), []
        for _, _, role, text in rows:
            last = text.strip(" \t\n\v\f\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns_of = {t for numbered, t, _, _ in rows if numbered}
        cost, audit, lines = plain_best([(r[2], r[3], f) for r, f in zip(rows, faults, strict=True)])
        bad = sum((a[2] or " ")[0] + (b[2] or " ")[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(turns_of) - min(turns_of) + 1 - len(turns_of) if turns_of else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, cost, audit, digest)
    return out


def dialogues():
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "same.", "same.", "a. b", "end. \n"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(RNG.randrange(1, 14)):
            rows.append((conv, RNG.choice([turn, turn, turn, turn + 2, None]), RNG.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), RNG.choice(texts)))
    rows += [(100, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(900)]
    rows += [(101, 5, "user", "again.")] * 50 + [(101, t, "user", "hot.") for t in range(50)]
    RNG.shuffle(rows)
    return rows


def test_repairs_are_those_of_a_plain_search(spark):
    rows = dialogues()
    want = plain_repair(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for sizes in ({}, {"long_rows": 3, "block_rows": 3}):  # the second: nearly all are long, and of many blocks
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair(turns, **sizes).collect()}
        assert got == want
    kinds = {letter for r in want.values() for letter in r[6]}
    assert kinds == set("KRDI")


def test_hot_conversations_are_told_apart_by_count(spark, monkeypatch):
    monkeypatch.setattr(repair, "MOST_HUBS", 3)
    rows = dialogues()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(turns, long_rows=50, block_rows=16).collect()}
    assert got == plain_repair(rows)


def test_empty_long_and_clashing(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1000) if zlib.crc32(f"2:{t}".encode()) % 20 == 9)
    long_text = "word " * 500_000 + "end."
    turns = spark.createDataFrame([(1, gone, "user", "x.", "e"), (2, kept, "user", long_text, "e")], "conv_id long, turn long, role string, text string, audit string")
    got = {r.conv_id: r for r in repair.repair(turns).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2].audit == "KI" and got[2].repaired_sha256 == hashlib.sha256(f"user:{long_text}\nassistant:".encode()).hexdigest()
