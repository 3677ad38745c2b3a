"""Filter audit, personal data and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import odd, rows, write  # noqa: F401

from mosaica.llm import filter_audit, periodic, pii, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# ---- runs


def plain_runs(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_words(seed):
    """Words with stretches of periods of every kind beside and inside each other."""
    r, out = random.Random(seed), []
    while len(out) < r.choice((30, 120, 500)):
        unit = [r.randrange(r.choice((1, 2, 3, 50))) for _ in range(r.choice((1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40)))]
        if r.random() < 0.3:
            unit = unit * r.randrange(1, 5) + [r.randrange(3)] * r.randrange(3)
        more = unit * r.choice((1, 2, 3, 4, 9, 30))
        out += more[: len(more) - r.randrange(len(unit))]
        out += [r.randrange(60) for _ in range(r.choice((0, 0, 1, 5, 20)))]
    return np.array(out[:900], np.int64)


def test_runs_are_those_of_plain_search():
    texts = [made_words(s) for s in range(150)] + [np.zeros(n, np.int64) for n in (0, 1, 23, 24, 25, 400)] + [np.arange(50)]
    texts += [np.tile(np.arange(q), 4)[: 3 * q + e] for q in (1, 5, 7, 8, 9, 15, 16, 63, 64, 100, 128, 140, 255, 256, 257) for e in (-1, 0, 1)]
    together = periodic.runs_of(texts)
    assert sum(map(len, together)) > 250
    for t, got in zip(texts, together, strict=True):
        assert got == plain_runs(t.tolist())


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_few_letters_with_short_blocks(seed, monkeypatch):
    # blocks shorter than periods, so windows come in pieces and blocks are often periodic themselves
    monkeypatch.setattr(periodic, "MOST_BLOCK", 16)
    monkeypatch.setattr(periodic, "AT_ONCE", 64)
    r = random.Random(seed)
    for _ in range(40):
        q = r.randrange(20, 110)
        unit = [0] * q
        for _ in range(r.randrange(1, 4)):
            unit[r.randrange(q)] = 1
        w = [0] * r.randrange(30) + (unit * 5)[: r.randrange(3 * q - 2, 5 * q)] + [0] * r.randrange(60) + [2] * r.randrange(2) + unit * r.randrange(4)
        assert periodic.runs_of([np.array(w)])[0] == plain_runs(w)


def test_runs_do_not_cross_texts():
    t = np.tile(np.arange(5), 4)
    assert periodic.runs_of([t, t, t]) == [[], [], []]


def test_transform_multiplies_polynomials():
    rng = np.random.default_rng(2)
    for n in (2, 8, 16, 32, 64, 128, 256):
        a, b = (rng.integers(0, periodic.PRIME, n) for _ in range(2))
        want = [0] * n
        for i in range(n):
            for j in range(n):
                want[(i + j) % n] = (want[(i + j) % n] + int(a[i]) * int(b[j])) % periodic.PRIME
        f = [periodic.transform(periodic._mod(x.astype(float))[None]) for x in (a, b)]
        got = periodic.transform(periodic._mod(f[0] * f[1]), True)[0]
        assert [int(x) * pow(n, -1, periodic.PRIME) % periodic.PRIME for x in got] == want


def plain_digest(doc_id, text):
    w = SPACE.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (str(doc_id), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


RUN_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_query_on_odd_rows_and_many_ids(spark, odd, tmp_path):  # noqa: F811
    folder, docs, *_ = odd
    got = rows(spark, "op13_periodic_runs", folder)
    assert sorted(map(str, ((str(r["doc_id"]), *(r[c] for c in RUN_COLUMNS)) for r in got))) == sorted(str(plain_digest(i, t)) for i, t, *_ in docs)
    r = random.Random(3)
    more = [(i, "\t".join(f"w{r.randrange(40)}" for _ in range(r.randrange(120))) + " é x", "aa", "s", 0) for i in range(300)]
    got = rows(spark, "op13_periodic_runs", write(tmp_path, documents=more))
    want = [plain_digest(i, t) for i, t, *_ in more]
    assert sum(x[1] for x in want) > 8
    assert sorted(map(str, ((str(r["doc_id"]), *(r[c] for c in RUN_COLUMNS)) for r in got))) == sorted(map(str, want))


def test_runs_and_collapsed_texts_keep_columns(spark, monkeypatch):
    monkeypatch.setattr(periodic, "STEP", 50)  # texts are split in steps
    data = [(1, "a b " * 20 + "c", 7), (2, "no run here", 8), (3, None, 9), (4, "", 1), (5, "x" * 400 + " y", 2)]
    df = spark.createDataFrame(data, "doc_id int, text string, `a.b` int")
    got = {r["doc_id"]: r for r in periodic.with_runs(df).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 40, 2)] and all(got[i]["runs"] == [] for i in (2, 3, 4, 5))
    out = {r["doc_id"]: r for r in periodic.collapsed(df).collect()}
    assert [out[i]["text"] for i in range(1, 6)] == ["a b c", *(t for _, t, _ in data[1:])] and out[2]["a.b"] == 8


# ---- personal data

EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and plain_luhn(d),
        "phone": lambda m: 10 <= len(re.sub(r"[^0-9]", "", m)) <= 15,
    }
    return sorted((m.start(), k, m.end()) for k, (name, x) in enumerate(EXPRESSIONS.items()) for m in re.finditer(x, text) if good[name](m[0]))


def noisy(seed):
    r = random.Random(seed)
    bits = ["@", "a@b.c", "x.y+z@host", ".com", ".", "-", " ", "  ", "+", "1", "23", "255.", "256.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "+1 (555) 123-4567", "+49.30.1234567", "é", " ", "٣", "\n", "10.0.0.1", "0000255.1.1.1", "http://a.b/c?d", "iban ", "DE89 3704 0044 0532 0130 00", "account no. 12345678", "((", ")", "b@c@d.e", "_", "%", "١"]
    return "".join(r.choice(bits) for _ in range(r.randrange(1, 40)))


def test_base_spans_are_those_of_the_expressions():
    find, some = pii.Finder(), [0] * pii.BASE
    for seed in range(4000):
        text = noisy(seed)
        got = [s for s in find(text) if s[1] < pii.BASE]
        assert got == plain_spans(text), text
        for _, k, _ in got:
            some[k] += 1
    assert min(some) > 300


def test_added_spans_are_whole_and_valid():
    find = pii.Finder()
    cases = {
        "see https://user@ex-ample.org:8080/a/b?c=d, now": ["url https://user@ex-ample.org:8080/a/b?c=d"],
        "(http://a.b/c) xhttp://no.pe http:// http://[::1]/x": ["url http://a.b/c", "url http://[::1]/x"],
        "IBAN: DE89 3704 0044 0532 0130 00 AND MORE": ["account DE89 3704 0044 0532 0130 00"],
        "iban GB82WEST12345698765432.": ["account GB82WEST12345698765432"],
        "Account number: 123-45678 X and account of people, SSN 078-05-1120": ["account 123-45678", "account 078-05-1120"],
        "accounts 12345678, my account is 12": [],
        "routing no. 021000021": ["account 021000021"],
    }
    for text, want in cases.items():
        assert [f"{pii.KINDS[k]} {text[a:b]}" for a, k, b in find(text) if k >= pii.BASE] == want


@pytest.mark.parametrize("part", ["IBAN ", "http://", "@", "a@", "+1(", "1.", "1 ", "a", "9", "+", "account no ", "1.1.1.", "x@y."])
def test_long_texts_are_looked_at_once(part):
    import time

    find, text = pii.Finder(), part * 100_000
    began = time.process_time()
    find(text)
    assert time.process_time() - began < 5


def test_personal_data_of_odd_rows(spark, odd, tmp_path):  # noqa: F811
    folder, docs, *_ = odd
    more = [(i, noisy(i), "aa", "s", 0) for i in range(300)] + [(None, "a@b.cc", None, None, None)] * 2
    for where, data in ((folder, docs), (write(tmp_path, documents=more), more)):
        got = rows(spark, "op12_pii", where)
        want = []
        for i, t, *_ in data:
            spans = plain_spans(t or "")
            listed = ",".join(f"{list(EXPRESSIONS)[k]}:{a}:{b}" for a, k, b in spans)
            want.append((str(i), *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
            names = set(listed.split(",")) - {""}
            assert any(names <= set(r["spans"].split(",")) for r in got if r["doc_id"] == i)
        assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == sorted(want)


def test_redacted_texts_keep_columns(spark):
    df = spark.createDataFrame([(1, "mail me@x.yy or 10.0.0.1 now", 5), (2, None, 6), (3, "clean", 7)], "doc_id int, text string, `a.b` int")
    got = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == ["mail [EMAIL] or [IP] now", None, "clean"] and got[3]["a.b"] == 7
    spans = pii.with_spans(df).where("doc_id = 1").first()["spans"]
    assert [tuple(s) for s in spans] == [("email", 5, 12), ("ip", 16, 24)]


# ---- filter audit


def plain_audit(docs, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    texts = {}
    for i, t, *_ in docs:
        texts.setdefault(t or "", []).append(i)
    parts = {}
    for i, t, _, source, _ in docs:
        t = t or ""
        w = SPACE.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i for j in texts[t]),
        }
        parts.setdefault(source or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, rows_ in parts.items():
        made, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows_
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                failing = sum(f in r[0] for r in rows_)
                made.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows_), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*m, total[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows(spark, odd, tmp_path):  # noqa: F811
    folder, docs, *_ = odd
    _, labels, _ = __import__("test_queries").odd_documents()
    r = random.Random(5)
    words = ["aa", "Bb", "c#", "dd", "é", "FF"]
    more = [(i % 170, " ".join(r.choice(words[: 1 + i % 6]) + str(r.randrange(400)) for _ in range(r.choice((3, 150, 260)))), "aa", (None, "", "s", "t")[i % 4], 0) for i in range(200)]
    more += [(i + 500, more[i % 9][1], "aa", "t", 0) for i in range(60)]
    judged = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i in range(0, 600, 2)] + [(4, 1, 1)]
    for where, data, marks in ((folder, docs, labels), (write(tmp_path, documents=more, labels=judged), more, judged)):
        got = sorted(tuple(x[c] for c in AUDIT) for x in rows(spark, "op11_filter_audit", where))
        assert got == plain_audit(data, marks)
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.execute(f"create view {t} as select * from '{where}/{t}.parquet'")
        assert sorted(con.execute(f"select {', '.join(AUDIT)} from ({queries.AUDIT_SQL})").fetchall()) == got


def test_audit_matches_sql_on_the_smallest_tables(spark):
    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = sorted(tuple(x[c] for c in AUDIT) for x in rows(spark, "op11_filter_audit", data))
    assert got == sorted(con.execute(f"select {', '.join(AUDIT)} from ({queries.AUDIT_SQL})").fetchall())


def test_other_filters_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "t", i % 4, 1) for i in range(10)], "doc_id int, text string, mask int, `_hash` int")
    out = filter_audit.failures(docs, name="failed")
    assert out.columns == ["doc_id", "mask", "_hash", "failed"]
    assert sum(r["failed"] >> 4 for r in out.collect()) == 9
    got = filter_audit.interactions(docs, F.lit(None), "XY", "mask", {"odd": F.col("doc_id") % 2 == 1}).collect()
    assert sorted((r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["odd"], r["shapley"]) for r in got) == [("XY", 1, 5, 5, 0, 3, 5, 8), ("XY", 2, 3, 2, 2, 2, 0, 6), ("YX", 1, 6, 4, 0, 2, 2, 6), ("YX", 2, 3, 3, 2, 3, 3, 8)]
    with pytest.raises(ValueError, match="between 1 and 6"):
        filter_audit.interactions(docs, F.lit("p"), "ABCDEFG")
