import functools
import hashlib
import random
import re
import zlib

from strandsift.llm import repair
from strandsift.llm.queries import op13_repair

_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
_TO = {"s": 1, "u": 2, "a": 3}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def cheapest(roles, faults):
    """(cost, audit, output as (role or None, row or None)) by trying every edit."""
    n = len(roles)

    @functools.cache
    def best(i, state, inserted):
        options = [(0, "", ())] if i == n and state in (0, 3) else []
        expected = _NEXT[state]

        def add(cost, edit, rest, said):
            if rest is not None:
                options.append((cost + rest[0], edit + rest[1], said + rest[2]))

        if inserted < 3:
            add(2, "I", best(i, _TO[expected], inserted + 1), ((expected, None),))
        if i < n:
            add(3, "D", best(i + 1, state, 0), ())
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if roles[i] == expected or roles[i] == "s" and state == 0:
                    add(cut, "K", best(i + 1, _TO[roles[i]], 0), ((None, i),))
                add(2 + cut, "R", best(i + 1, _TO[expected], 0), ((expected, i),))
        return min(options, key=lambda o: o[:2]) if options else None

    for i in range(n, -1, -1):  # from the end, so that no recursion is deep
        for inserted in (3, 2, 1, 0):
            for state in range(4):
                best(i, state, inserted)
    return best(0, 0, 0)


def brute(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for r in own:
            found = _SEEN.findall(r[3])
            faults.append("blank" if not found else "duplicate" if r[2:] in seen else "truncated" if found[-1] not in ".!?" else "")
            seen.add(r[2:])
        turns = [r[1] for r in own if r[1] is not None]
        roles = [r[2][:1] for r in own]
        cost, audit, said = cheapest(tuple(roles), tuple(faults))
        lines = [f"{own[i][2] if role is None else {'u': 'user', 'a': 'assistant'}[role]}:{'' if i is None else own[i][3]}" for role, i in said]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_whole_table_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(op13_repair(spark, small)) == brute(rows)


def test_odd_rows(spark):
    """Nulls in all columns, unknown and empty roles, ties, repeated rows, negative turns, turns in several runs."""
    rnd = random.Random(5)
    texts = [None, "", "  ", "a.", "b", "hello! ", "x\n", "yes?", "mm", "q.", "é…", "z" * 5000]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(-3, 700)]), rnd.choice(["system", "user", "assistant", "tool", "", None, "User"]), rnd.choice(texts)) for _ in range(1500)]
    rows += rows[:200]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, audit string").repartition(3)
    assert as_dict(repair.repair(df)) == brute(rows)


def test_a_long_conversation_and_one_without_rows(spark):
    rnd = random.Random(6)
    rows = [("long", t, rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b!", "c", f"n{t}.", f"m{t}?"])) for t in range(1500)]
    gone = next(i for i in range(1000) if zlib.crc32(f"g{i}:1".encode()) % 20 == 0)
    rows.append((f"g{gone}", 1, "user", "hello."))
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(4)
    got = as_dict(repair.repair(df))
    assert got == brute(rows)
    assert got[f"g{gone}"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # a conversation of one turn alone, and an empty table
    same = spark.createDataFrame([(1, None, "user", f"t{i % 7}.") for i in range(1300)], "conv_id long, turn long, role string, text string")
    assert as_dict(repair.repair(same)) == brute([tuple(r) for r in same.collect()])
    assert repair.repair(df.limit(0)).count() == 0


def test_every_short_signature_is_solved_as_by_brute_force():
    rnd = random.Random(7)
    chars = repair.FINE + repair.TRUNCATED + repair.BLANK[:2] + repair.DUPLICATE[:2]
    for n in range(6):
        for _ in range(300):
            signature = "".join(rnd.choice(chars) for _ in range(n))
            kinds = {**dict.fromkeys(repair.FINE, ""), **dict.fromkeys(repair.TRUNCATED, "truncated"), **dict.fromkeys(repair.BLANK, "blank"), **dict.fromkeys(repair.DUPLICATE, "duplicate")}
            roles = tuple(repair.FINE[next(k for k in (repair.FINE, repair.TRUNCATED, repair.BLANK, repair.DUPLICATE) if c in k).index(c)] for c in signature)
            assert repair.solve(signature) == cheapest(roles, tuple(kinds[c] for c in signature))[:2]


def test_each_distinct_signature_is_solved_once(spark):
    """Of 300 conversations of the same two shapes, two signatures are left."""
    rows = [(f"{i}:", t, role, text) for i in range(300) for t, (role, text) in enumerate([("user", "a."), ("assistant", "b." if i % 2 else "b")])]
    rows = [r for r in rows if zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 > 4]
    found = repair.signatures(repair.damage(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")))
    assert repair.solved(found).count() == len({r.signature for r in found.collect()}) <= 6
