import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tallyfold.llm import queries
from tallyfold.llm import secret_scan as ss

DOCS = "doc_id long, text string, row int, kind string, p int"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_of(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def battery_of(token):
    """Encoding and p-value of a token, from the textbook formulas."""
    body = token.rstrip("=")
    name, alphabet = next(((e, a) for e, a, shows in ss.ENCODINGS if re.search(shows, body)), (None, None))
    if name is None:
        return None
    n, k, x = len(body), len(alphabet), [alphabet.index(c) for c in body]
    tail = lambda z: math.erfc(abs(z) / 2**0.5)
    chi = sum((c - n / k) ** 2 / (n / k) for c in Counter(x).values()) + (k - len(set(x))) * n / k
    cube = 2 / (9 * (k - 1))
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - cube)) / cube**0.5
    p_chi = 0.5 * math.erfc(z / 2**0.5)
    high = [v >= k // 2 for v in x]
    a = high.count(False)
    b = n - a
    p_runs = 0.0
    if a and b:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = tail((1 + sum(u != v for u, v in zip(high, high[1:], strict=False)) - mean) / var**0.5)
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    pairs = [(u, v) for i, (u, v) in enumerate(zip(x, x[1:], strict=False)) if (i + 1) % ss.BLOCK]
    p_serial = tail((sum((u - m) * (v - m) for u, v in pairs) / var + 1 / n) * n**0.5) if var else 0.0
    return name, n, 1 - (1 - min(p_chi, p_runs, p_serial)) ** 3


def plain(texts):
    """base spans and all spans of each text."""
    base = [base_of(t) for t in texts]
    tested = []
    for d, text in enumerate(texts):
        for m in re.finditer(ss.TOKEN, text):
            if not any(s < m.end() and e > m.start() for s, _, e in base[d]) and (b := battery_of(m[0])):
                tested.append((d, m.start(), m.end(), (b[0], math.floor(2 * math.log2(b[1] / ss.LEAST)) if b[1] > ss.LEAST else 0), b[2]))
    spans = [list(b) for b in base]
    for key in {t[3] for t in tested}:
        ps = [t[4] for t in tested if t[3] == key]
        above = [sum(p >= k / ss.STEPS for p in ps) for k in range(ss.STEPS)]
        rand = min((above[k] + above[k] ** 0.5 + 1) / (1 - k / ss.STEPS) for k in range(ss.STEPS // 2 + 1))
        k = next((k for k in range(1, ss.STEPS) if above[k] and rand * (1 - k / ss.STEPS) >= (1 - ss.SHARE) * above[k]), None)
        for d, s, e, own, p in tested:
            if own == key and k is not None and p >= k / ss.STEPS:
                spans[d].append((s, 3, e))
    return base, [sorted(s) for s in spans]


def written(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in spans)


def key_of(rng, n, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def texts():
    rng = random.Random(5)
    words = "the of and station river morning light with some old house under".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hexa = lambda n: key_of(rng, n, "0123456789abcdef")
    out = [None, "", "Password = 'hunter22!' é PASSWD:abc token=secret=abcdef", "secret=token: abcdefgh", "\U0001f511é api-key: x api_key:\"" + hexa(30), "ſecret=abcdefgh toKen=abcdefgh apikey  =  A.b/c-d"]
    out += ["AKIA" + "A1" * 7, "xAKIA" + "B2" * 8 + "b", "AKIAAKIA" + "Z9" * 9, "AKIA", hexa(23), hexa(24) + "g" + hexa(25).upper() + hexa(31)]
    out += [f"{prose(9)} {key_of(rng, rng.randint(20, 90))} {prose(5)}\n" for _ in range(40)]
    out += [f"{prose(9)} {key_of(rng, 43)}= {key_of(rng, 40, ss.ENCODINGS[7][1])} {key_of(rng, 32, ss.ENCODINGS[2][1])} {key_of(rng, 9000)}" for _ in range(4)]
    out += [f"{prose(3)} {'-'.join(rng.choice(words) for _ in range(9)).title()}-{rng.randint(1900, 2030)} {''.join(rng.choice(words) for _ in range(6))}{rng.randint(1, 99)}" for _ in range(60)]
    out += ["a1" * 20, "0123456789abcdefghijklmnopqrstuvwxyz", "Aa1" * 30, "z" * 40 + "1", "550e8400-e29b-41d4-a716-446655440000", "A1" + "a" * 30, "passwd: " + "Q" * 60_000]
    return out


def test_query_equals_plain(spark, tmp_path):
    own = texts()
    base, spans = plain([t or "" for t in own])
    docs = spark.createDataFrame([(i, t, 1, "own", 2) for i, t in enumerate(own)], DOCS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_secret_scan(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    for d in range(len(own)):
        n = [sum(k == kind for _, kind, _ in base[d]) for k in range(3)]
        assert got[d] == (*n, hashlib.sha256(written(base[d]).encode()).hexdigest(), written(spans[d])), own[d]
    assert len(got) == len(own) and sum(k == 3 for s in spans for _, k, _ in s) > 40
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(queries.OP12_SQL).fetchall()} == got


def test_random_keys_are_found_and_ordinary_strings_left_alone(spark):
    own = texts()
    docs = spark.createDataFrame([(i, t, 1, "own", 2) for i, t in enumerate(own)], DOCS)
    found = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in ss.find_secrets(docs).collect()}
    keys = range(12, 56)
    assert sum(bool(found[d]) for d in keys) >= 0.8 * len(keys)
    assert sum(len(found[d]) for d in range(56, len(own))) <= 0.1 * sum(map(len, found.values()))


def test_battery_equals_the_formulas(spark):
    rng = random.Random(2)
    tokens = [key_of(rng, n, a) for n in (20, 33, 4096, 4097, 10_000) for _, a, _ in ss.ENCODINGS] + ["a1" * 20, "b" * 30 + "7", "Abc1+/" * 9 + "==", "wordsonly" * 4, "12345678901234567890"]
    rows = ss.battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()
    for r in rows:
        wanted = battery_of(r.token)
        assert (r.encoding is None) == (wanted is None)
        if wanted:
            assert r.encoding == wanted[0] and r.p == pytest.approx(wanted[2], abs=2e-6)


def test_p_values_of_random_tokens_are_about_uniform(spark):
    rng = random.Random(3)
    tokens = spark.createDataFrame([(key_of(rng, 64),) for _ in range(2000)], "token string")
    ps = sorted(r.p for r in ss.battery(tokens).collect())
    assert max(abs(p - i / len(ps)) for i, p in enumerate(ps)) < 0.1


def test_repeated_rows_and_null_identifiers(spark):
    rows = [(1, "token=abcdef", 1, "", 2)] * 3 + [(None, "token=abcdef", 1, "", 2), (None, None, 1, "", 2)]
    found = ss.listed(ss.find_secrets(spark.createDataFrame(rows, DOCS))).collect()
    assert sorted(r.spans for r in found) == ["", *["assign:0:12"] * 4]


def test_no_python_in_the_plan_and_empty_tables(spark):
    found = ss.find_secrets(spark.createDataFrame([], DOCS))
    assert found.count() == 0 and "Python" not in found._jdf.queryExecution().executedPlan().toString()
