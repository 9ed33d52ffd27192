import hashlib
import random
import re

from lodestone.llm.secrets import RULES, redacted, scan
from lodestone.llm.trigrams import query

BASE = {
    "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def brute(text):
    spans = []
    for n, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text or ""):
            if {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}[kind](m):
                spans.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(spans)


def texts():
    r = random.Random(6)
    bits = ["password", "PassWord", "token", "secret", "api_key", "apiKey", "=", ": ", ' = "', "'", "AKIA", "Z9" * 7, "ABCD", "deadbeef" * 4, "0f" * 9, "abcdefgh12", "short", "é𝄞", " ", "\n", "x", "passwd:", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(400)] + ["token=secret:abcdefghijk", "", None, "AKIAAKIA" + "B" * 12, "k = " + "a" * 3000]


def test_equals_brute_force(spark):
    rows = [(i if i % 50 else None, t, "a") for i, t in enumerate(texts())] + [(3, "token: abcdefghij", "b")] * 2
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(5)).collect()
    seen = sorted(((g.doc_id, g.n_assign, g.n_access, g.n_hex, g.base_sha256) for g in got), key=str)
    want = []
    for d, t, _ in rows:
        b = brute(t)
        want.append((d, *(sum(x[1] == n for x in b) for n in range(3)), hashlib.sha256(",".join(x[2] for x in b).encode()).hexdigest()))
    assert seen == sorted(want, key=str)
    for g in got:
        base = ",".join(s for s in g.spans.split(",") if s.split(":")[0] in BASE)
        assert hashlib.sha256(base.encode()).hexdigest() == g.base_sha256
    assert any("github:" in g.spans for g in got) and any("private_key:" in g.spans for g in got)


def test_queries_hold_of_every_match():
    r = random.Random(7)
    for t in filter(None, texts()):
        for rule in RULES:
            if re.search(rule.pattern, t, re.A):
                low = t.lower()
                assert all(any(all(g in low for g in alt) for alt in clause) for clause in query(rule.pattern))
    assert not query("[0-9a-f]{32,}") and not query("a?b?c?") and r


def test_redacted(spark):
    rows = [(1, "my token = abcdefgh12 ok 𝄞 password: " + "0f" * 20 + " end", 5), (2, None, 0), (3, "clean", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in redacted(df).collect()}
    assert got[1].text == "my [SECRET] ok 𝄞 [SECRET] end" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean" and redacted(df).columns == df.columns
    assert redacted(df.limit(0)).count() == 0 and scan(df.limit(0)).count() == 0
