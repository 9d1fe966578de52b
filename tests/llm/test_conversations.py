"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversations, queries

CONV = "conv_id long, turn long, role string, text string, place int, togo string, piece string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return out


def plain(rows):
    """Reports by conversation: the cheapest way of least letters, kept for every (rows done, state)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
        seen, faults, illegal, before = set(), [], 0, None
        for _, _, role, text in held:
            core = text.rstrip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
            if before is not None and before + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            before = role[:1]

        def closed(ways):
            for _ in range(4):
                for s, (cost, audit, lines) in list(ways.items()):
                    for to, name in (("u", "user"), ("a", "assistant")):
                        if (to == "a") == (s == "u"):
                            new = (cost + 5, audit + "I", (*lines, f"{name}:"))
                            ways[to] = min(ways.get(to, new), new)
            return ways

        ways = closed({"": (0, "", ())})
        for (_, _, role, text), fault in zip(held, faults):
            after = {}

            def offer(s, way):
                after[s] = min(after.get(s, way), way)

            for s, (cost, audit, lines) in ways.items():
                offer(s, (cost + 2, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                torn = 5 * (fault == "truncated")
                first = role[:1]
                if (first == "s" and s == "") or (first == "u" and s != "u") or (first == "a" and s == "u"):
                    offer(first, (cost + torn, audit + "K", (*lines, f"{role}:{text}")))
                to, name = ("a", "assistant") if s == "u" else ("u", "user")
                offer(to, (cost + 1 + torn, audit + "R", (*lines, f"{name}:{text}")))
            ways = closed(after)
        cost, audit, lines = min(w for s, w in ways.items() if s in ("", "a"))
        turns = {r[1] for r in held if r[1] is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def drawn(rng, conv, n, texts):
    return [(conv, rng.choice([None, t, t]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts))
            for t in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["Yes.", "no", " ", "", None, "What?", "a\tb! \n", "é è.", "Stop!", "x" * 3000 + ".", "one", "two."]
    out = [r for conv in [None, *range(60)] for r in drawn(rng, conv, rng.randrange(1, 9), texts)]
    out += drawn(rng, 100, 700, [f"text {k}{e}" for k in range(200) for e in ".,"])
    out += [(101, 3, "user", "Same.")] * 400
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def framed(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], CONV)


@pytest.mark.parametrize("pieces", ["4", "37"])
def test_repair_equals_plain_search(spark, rows, pieces):
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    try:
        damage = conversations.damage(framed(spark, rows))
        assert sorted(map(repr, map(tuple, damage.collect()))) == sorted(map(repr, damaged(rows)))
        assert got(conversations.repair(damage)) == plain(damaged(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repaired_rows_hash_to_the_report(spark, rows):
    damage = conversations.damage(framed(spark, rows))
    fixed = conversations.repaired(damage).orderBy("conv_id", "place").collect()
    for conv, report in got(conversations.repair(damage)).items():
        lines = [r for r in fixed if r["conv_id"] == conv]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in lines).encode()).hexdigest() == report[-1]
        assert "".join(r["edit"] for r in lines) == report[-2].replace("D", "")


def test_long_runs_use_powers_of_the_transition():
    rng = random.Random(2)
    for _ in range(300):
        symbols = [rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9]) for _ in range(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 12))]
        matrix = conversations.piece_matrix(conversations.runs_of(symbols))
        step = conversations.END
        for s in reversed(symbols):
            step = conversations._before(conversations.power(s, 0), step)
        assert conversations._before(matrix, conversations.END) == step
        state, cost, letters = conversations.unroll(conversations.runs_of(symbols), 0, conversations.END, True)
        assert state in (conversations.START, conversations.ASSISTANT) and cost == step[0]


def test_empty_tables_and_dropped_conversations(spark, tmp_path):
    empty = framed(spark, [])
    assert conversations.repair(conversations.damage(empty)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    framed(spark, [(gone, 0, "user", "Hello."), (None, None, None, None)]).write.parquet(f"{tmp_path}/conversations.parquet")
    out = got(queries.op11(spark, str(tmp_path)))
    assert out[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(out) == {gone, None}
    framed(spark, []).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op11(spark, f"{tmp_path}/none").where(F.lit(True)).collect() == []
