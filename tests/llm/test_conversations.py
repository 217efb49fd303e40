import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm.conversations import repair_damaged, solve_sorted

INK = re.compile(r"[^\x20\x09-\x0D]")
TO = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
KEPT = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}


def cheapest(rows):
    """(cost, audit, lines) of (role, text, fault), each state's best edits spelled out."""

    def inserts(layer):
        for _ in range(4):
            for q, (c, a, o) in list(layer.items()):
                to, role = TO[q]
                if to not in layer or (c + 2, a + "I") < layer[to][:2]:
                    layer[to] = (c + 2, a + "I", [*o, role + ":"])
        return layer

    layer = inserts({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}

        def put(q, new, after=after):
            if q not in after or new[:2] < after[q][:2]:
                after[q] = new

        for q, (c, a, o) in layer.items():
            put(q, (c + 3, a + "D", o))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (q, role[:1]) in KEPT:
                    put(role[0], (c + more, a + "K", [*o, f"{role}:{text}"]))
                to, new = TO[q]
                put(to, (c + 2 + more, a + "R", [*o, f"{new}:{text}"]))
        layer = inserts(after)
    return min((layer[q] for q in ("", "a") if q in layer), key=lambda x: x[:2])


def brute(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        own = convs.setdefault(conv_id, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv_id, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv_id, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            ink = INK.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = cheapest([(r[1], r[2], f) for r, f in zip(own, faults)])
        out.append((conv_id, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string, fault string, answer string, state string").repartition(3)
    got = sorted((tuple(r) for r in repair_damaged(df).collect()), key=str)
    assert got == brute([r[:4] for r in rows])
    return got


def row(*values):
    return (*values, "x", "y", "z", "w")


def test_answers_of_short_signatures_are_the_cheapest():
    """Every signature of up to four symbols, against all edit sequences up to a length, and against the spelled-out program."""
    symbols = "suaoSUAOx"
    named = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    every = sorted("".join(p) for n in range(4) for p in itertools.product(symbols, repeat=n))
    pattern = re.compile(r"(s?(ua)+)?")
    for signature, cost, audit in solve_sorted(iter(every)):
        rows = [(named.get(s.lower(), "tool"), "t", "blank" if s == "x" else "truncated" if s.isupper() else "") for s in signature]
        assert (cost, audit) == cheapest(rows)[:2]
        if len(signature) <= 2:  # all edit sequences outright
            best = []
            for n in range(len(signature) + 5):
                for edits in itertools.product("DIKR", repeat=n):
                    if sum(e != "I" for e in edits) != len(signature):
                        continue
                    for new in itertools.product("ua", repeat=sum(e in "IR" for e in edits)):
                        fresh, at, price, roles = iter(new), iter(signature), 0, ""
                        for e in edits:
                            s = "" if e == "I" else next(at)
                            price += {"D": 3, "I": 2, "K": 0, "R": 2}[e] + (e in "KR" and s.isupper())
                            roles += "" if e == "D" else s.lower() if e == "K" else next(fresh)
                            if s == "x" and e != "D":
                                price += 1_000
                        if pattern.fullmatch(roles):
                            best.append((price, "".join(edits)))
            assert min(best) == (cost, audit), signature


def test_random_conversations(spark):
    rnd = random.Random(3)
    texts = ["Hi.", "no end", "", "  \n", None, "What?", "ü!\n", "a" * 50 + ".", "日本。", ". x", "\x0b?\x0c"]
    rows = [
        row(c, rnd.choice([None, t, t, t, t * 2]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rnd.choice(texts))
        for c in [None, *range(250)] for t in range(rnd.randrange(1, 12))
    ]
    got = check(spark, rows)
    assert len(got) == 251 and sum(r[3] for r in got) and sum(r[4] for r in got)


def test_conversations_that_lose_every_row(spark):
    gone = [c for c in range(4_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    got = check(spark, [row(c, 0, "user", "Hi.") for c in gone])
    assert {r[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_long_conversation_and_many_of_one_signature(spark):
    rows = [row(-1, t, ("user", "assistant")[t % 2], f"line {t}" + "." * (t % 5 != 0)) for t in range(3_000)]
    rows += [row(c, t, ("user", "assistant")[t], f"{c}.") for c in range(1_200) for t in (0, 1)]
    rows += [row(5_000, 0, "user", "long " * 200_000), row(5_000, 1, "assistant", "Yes.")]
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    df = spark.createDataFrame([row(1, 1, None, None)], "conv_id long, turn long, role string, text string, at string, fault string, answer string, state string").limit(n)
    assert repair_damaged(df).count() == n
