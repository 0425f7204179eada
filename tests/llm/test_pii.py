import hashlib
import random
import re
import time

from cohortwise.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    own = [int(d) for d in digits][::-1]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def brute(text):
    """The rules as they are stated, one plain search per kind."""
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end()))
    return sorted(found)


def test_base_matches_stated_rules():
    rng = random.Random(3)
    fixed = [
        "a@b.c@d.e", "x..y@-.-", "@a.b", "a@b", "a@b..c", "a@@b.c", "é.a@b.co.uk.", "a@b.c.d-e_f@g.h",
        "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.0003.255", "1.2.3.4a", "999.1.2.3.4",
        "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "4111111111111111 1",
        "+1 (988) 555-2485", "+1 2", "+12345678901234567", "++1 234 567 8901 ", "x" * 300 + "@" + "y.z" * 90,
    ]
    made = ["".join(rng.choice("ab1234567890.@-+ ()_%é\n") for _ in range(rng.randrange(60))) for _ in range(20000)]
    made += ["".join(rng.choice("1290 -.+(") for _ in range(rng.randrange(80))) for _ in range(5000)]
    for text in fixed + made:
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    began = time.time()
    for text in ("a" * 400_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "a." * 100_000 + "@b", "1 " * 100_000):
        list(pii._tokens(text, pii.base_spans(text)))
    assert time.time() - began < 30


def expected(text):
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in brute(text)]


def test_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        base, g = expected(r.text), got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        for kind, _ in PATTERNS:
            assert g[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in base)
        assert set(base) <= set(filter(None, g.spans.split(",")))
    assert sum(r.n_email for r in got.values()) > 0


def seeded():
    """Contexts that hold addresses, one of them obscured, and the same shapes elsewhere."""
    rows = [(k, f"row {k} is here please write to user{k}@mail.example.com today thanks", None, None) for k in range(12)]
    rows.append((100, "so please write to hidden77(at)mail today thanks", None, None))
    rows.append((101, "order code hidden99x shipped to the store", None, None))
    rows.append((102, "call hidden77(at)mail", None, None))
    return rows


def test_contexts_discover_identifiers(documents):
    got = {r.doc_id: r for r in pii.find(documents(seeded(), extra="row")).collect()}
    text = seeded()[12][1]
    start = text.index("hidden77")
    assert got[100].spans == f"email:{start}:{start + len('hidden77(at)mail')}" and got[100].n_email == 0
    assert got[102].spans == "email:5:21" and got[101].spans == ""
    assert got[3].n_email == 1 and got[3].n_added == 0


def test_redaction(documents):
    df = documents(seeded() + [(200, None), (201, ""), (None, "x 1.2.3.4 +1 (988) 555-2485 y")], extra="added")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[0].text == "row 0 is here please write to <EMAIL> today thanks"
    assert got[100].text == "so please write to <EMAIL> today thanks" and got[100].added == "x"
    assert got[200].text is None and got[201].text == "" and got[None].text == "x <IP> <PHONE> y"
    assert pii.redact(df).columns == df.columns


def test_odd_rows(documents):
    rows = [(1, None), (1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd"), (2, "z " * 100_000 + "a@b.cd")]
    got = sorted(((r.doc_id or 0, r.spans) for r in pii.find(documents(rows)).collect()))
    assert got == [(0, "email:0:6"), (1, ""), (1, "email:0:6"), (1, "email:0:6"), (2, "email:200000:200006")]
    assert pii.find(documents([])).collect() == [] and pii.redact(documents([])).collect() == []
