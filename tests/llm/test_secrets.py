import hashlib
import random
import re

from tidemark.llm.secrets import KINDS, redact, scan_secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def shown(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def texts(seed=1, n=150):
    rnd = random.Random(seed)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    bits = [
        lambda: "password=" + hexes(rnd.randrange(5, 12)), lambda: 'Api_Key: "' + hexes(40) + '"', lambda: "token=secret:" + hexes(9), lambda: "AKIA" + "AB12" * rnd.randrange(1, 6), lambda: hexes(rnd.randrange(28, 70)),
        lambda: "secret:short", lambda: "AKIAAKIA" + "Z9" * 5, lambda: "paſſword=abcdefghij", lambda: "toKen=abcdefghij", lambda: "ÄÖ日本🎉", lambda: "ordinary words here", lambda: "apikey = 'x.y-z_0+/='", lambda: "client_id = abcd1234",
        lambda: "https://db.example.com:5432/x", lambda: "wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLEKEY",
    ]
    return [(i, rnd.choice([" ", "", "\n"]).join(rnd.choice(bits)() for _ in range(rnd.randrange(0, 14)))) for i in range(n)]


def test_base_spans_equal_brute_force(documents):
    rows = texts() + [(1000, None), (1001, "")]
    for r in scan_secrets(documents(rows)).collect():
        want = brute(dict(rows)[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(shown(want).encode()).hexdigest()
        assert set(filter(None, shown(want).split(","))) <= set(r["spans"].split(","))


def test_weak_parts_need_their_complements(documents):
    key, material = "AKIA" + "ABCD1234EFGH5678", "wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLEKEY"
    rows = [
        (1, f"{key} and {material} at https://s3.example.com/bucket"), (2, material), (3, f"{key}{' far' * 200} {material}"), (4, "https://s3.example.com/bucket"),
        (5, f"client_id=abcd1234 token=abcdefgh12345"), (6, "client_id=abcd1234 and no more"),
    ]
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in scan_secrets(documents(rows)).collect()}
    assert got[1] == ["access", "material", "endpoint"]
    assert got[2] == [] and got[4] == [] and got[6] == []
    assert got[3] == ["access"]  # beyond the scope
    assert got[5] == ["client", "assign"]


def test_parts_that_span_stretches_meet(documents):
    long = "aB3" * 300
    rows = [(k, " " * k + "AKIA" + "AB12" * 5 + " " * 250 + long) for k in range(0, 600, 37)]
    for r in scan_secrets(documents(rows)).collect():
        assert [s.split(":")[0] for s in r["spans"].split(",")] == ["access", "material"]


def test_redaction(documents):
    rows = texts(4, 60)
    docs = documents(rows)
    out = redact(docs)
    assert out.columns == docs.columns
    found = {r["doc_id"]: r for r in out.collect()}
    assert len(found) == 60
    for d, t in rows:
        assert not brute(found[d]["text"]) or brute(t) != brute(found[d]["text"])
        assert found[d]["n_chars"] == len(found[d]["text"])
        if not brute(t):
            assert "[SECRET]" not in found[d]["text"] or "client_id" in t or "https" in t


def test_defined_results_for_odd_rows(edge, nothing):
    rows = scan_secrets(edge).collect()
    assert len(rows) == 9 and all(r["spans"] == "" for r in rows if r["doc_id"] != 6)
    assert scan_secrets(nothing).count() == 0
    assert redact(edge).count() == 9 and redact(nothing).count() == 0
