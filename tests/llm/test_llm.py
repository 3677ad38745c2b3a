"""Training-data operators against brute force, exact round trips and edge cases."""

import base64
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from mosaica.llm import bpe, chat, decontaminate, embedding_dedup, langid, quality, sharding, simhash, substring, toxicity
from mosaica.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, fp string, label string, shard int, ids int, _n int"
PATH, PATTERN = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
WORDS = [f"w{i}x" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [None, "", " \n\t", "A", "a b", "Ünïcode   \x00 text", "x" * 5000, "the the the " * 300]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "f", "l", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 120) for i in range(12)]
    return ODD + base + [base[0], base[1] + " tail", base[0]] + ODD[:3]


def closure(n, linked):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_against_all_pairs(spark, texts):
    def plain(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in low.translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if x]
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [plain(t) for t in texts]
    want = closure(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs(spark, texts)).collect()}
    assert [got[i]["fp"] % (1 << 64) for i in range(len(fp))] == fp
    assert [got[i]["component_id"] for i in range(len(fp))] == want


def test_simhash_links_equal_all_pairs_on_near_fingerprints(spark):
    r = random.Random(3)
    x = [r.getrandbits(64) for _ in range(20)]
    x += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in x for _ in range(4)]
    x = sorted(set(x))
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    from mosaica.llm.common import components

    comp = {r["node"]: r["component"] for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    want = closure(len(x), lambda i, j: (x[i] ^ x[j]).bit_count() <= 2)
    got = [comp.get(v, v) for v in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_bpe_is_the_librarys(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.digests(docs(spark, texts), PATH, PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    rows = bpe.decode(bpe.encode(docs(spark, texts), PATH, PATTERN), PATH, PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)


def test_prefix_table_appends_and_edits():
    t, r = bpe.PrefixBPE(bpe.load_ranks(PATH)), random.Random(5)
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=t.ids, special_tokens={})
    for _ in range(60):
        piece = bytes(r.choice(b"the quick_brown-fox  aaaa\xc3\xa9") for _ in range(r.randrange(1, 400)))
        table = bpe.PrefixTable(t, piece[:7]).append(piece[7:])
        assert table.tokens() == own._core_bpe.encode_single_piece(piece)
        at = r.randrange(len(piece))
        gone, new = r.randrange(4), bytes(r.choice(b"the ox") for _ in range(r.randrange(4)))
        edited = piece[:at] + new + piece[at + gone :]
        if edited:
            assert table.edit(at, min(gone, len(piece) - at), new).tokens() == own._core_bpe.encode_single_piece(edited)


def test_shards_keep_groups_and_slots(spark, texts):
    rows = docs(spark, texts).selectExpr("doc_id", "text", "cast(octet_length(coalesce(text, '')) + 8 as long) as size")
    got = sharding.shard(rows, "text", "size", ["doc_id"], shards=4).join(rows.select("doc_id", "text"), "doc_id").collect()
    assert len(got) == len(texts)
    by, slots = {}, {}
    for r in got:
        by.setdefault(r["text"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_schedule_is_longest_first():
    assert sharding.schedule([(7, "a"), (7, "b"), (6, "c"), (6, "d"), (5, "e")], 2) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    near = x[:20] + 0.08 * rng.standard_normal((20, 8))
    v = [list(map(float, r)) for r in [*x, *near, x[0], x[0]]] + [None, [0.0] * 8, [float("nan")] * 8, [None] * 8]
    lab = [i % 3 for i in range(len(v))]
    lab[60:80], lab[80], lab[81] = lab[:20], 0, None
    rows = spark.createDataFrame([(i, a, b, 1) for i, (a, b) in enumerate(zip(v, lab, strict=True))], "vec_id long, embedding array<float>, label int, node int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(rows).collect()}
    f = [None if a is None or any(c is None or not math.isfinite(c) for c in a) or not any(a) else np.float32(a).astype(float) for a in v]

    def linked(i, j):
        return f[i] is not None and f[j] is not None and lab[i] is not None and lab[i] == lab[j] and f[i] @ f[j] / np.linalg.norm(f[i]) / np.linalg.norm(f[j]) >= 0.98

    assert [got[i]["n_links"] for i in range(len(v))] == [sum(linked(i, j) for j in range(len(v)) if j != i) for i in range(len(v))]
    assert [got[i]["component_id"] for i in range(len(v))] == closure(len(v), linked)


def test_embeddings_of_other_lengths_cost_only_their_own_links(spark):
    rng = np.random.default_rng(6)
    v = []
    for width, n in ((1, 2), (8, 20), (12, 10), (40, 1)):
        x = rng.standard_normal((n, width))
        v += [list(map(float, r)) for r in [*x, *(x + 0.01 * rng.standard_normal(x.shape))][: max(1, 2 * n if n > 1 else 1)]]
    rows = spark.createDataFrame([(i, a, 1) for i, a in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(rows).collect()}

    def linked(i, j):
        return len(v[i]) == len(v[j]) and np.dot(v[i], v[j]) / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.98

    assert [got[i]["n_links"] for i in range(len(v))] == [sum(linked(i, j) for j in range(len(v)) if j != i) for i in range(len(v))]
    assert [got[i]["component_id"] for i in range(len(v))] == closure(len(v), linked)


def test_decontamination_against_shingles(spark):
    items = [(i, prose(100 + i, 30) + ". " + prose(200 + i, 12) + ".") for i in range(30)] + [(98, ""), (99, None), (30, "one two")]
    held = [prose(i, 300) + " " + items[i][1] + " " + prose(50 + i, 300) for i in range(10)]
    partly = [prose(70, 200) + " " + " ".join(items[11][1].split()[:15]) + " " + prose(71, 90)]
    d = docs(spark, held + partly + ODD + [prose(80, 4000)])
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(d, b).collect()}
    assert got == {(i, i) for i in range(10)}
    assert decontaminate.clean(d, b).count() == d.count() - 10
    assert decontaminate.matches(d.limit(0), b).count() == 0 and decontaminate.matches(d, b.limit(0)).count() == 0


def test_repeated_passages(spark):
    shared = prose(900, 70)
    a, b = prose(901, 100) + " " + shared + " " + prose(902, 90), prose(903, 60) + " " + shared + " " + prose(904, 30)
    w = shared.split()
    w[35] = "changed"
    c = prose(905, 80) + " " + " ".join(w) + " " + prose(906, 10)
    d = docs(spark, [a, b, c, prose(907, 300), prose(908, 49), prose(908, 49), a] + ODD)
    got = sorted(tuple(r) for r in substring.duplicate_passages(d).select("doc_id", "start", "end", "copy_of", "whole").collect())
    assert got == [(1, 60, 130, 0, False), (2, 80, 150, 0, False), (6, 0, 260, 0, True)]
    left = {r["doc_id"]: r["text"] for r in substring.remove_passages(d).collect()}
    assert set(left) == set(range(15)) - {6} and left[0] == a
    assert left[1].split() == b.split()[:60] + b.split()[130:]


def edited(seed, n):
    """A passage of n words, and it with a word replaced, inserted or deleted in its middle third, if both have 50 words and similarity 0.8."""
    r, p = random.Random(seed), prose(seed, n).split()
    at = r.randrange(n // 3, 2 * n // 3)
    q = (p[:at] + ["new"] + p[at + 1 :], p[:at] + ["new"] + p[at:], p[:at] + p[at + 1 :])[seed % 3]
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (p, q))
    return [(" ".join(p), " ".join(q))] if len(q) >= 50 and len(a & b) >= 0.8 * len(a | b) else []


def test_passages_with_a_word_replaced_inserted_or_deleted(spark):
    pairs = [x for i in range(120) for x in edited(3000 + i, (52, 60, 75, 90, 100)[i % 5])]
    d = docs(spark, [prose(5000 + 2 * i + k, 60) + " " + x + " " + prose(7000 + 2 * i + k, 60) for i, pair in enumerate(pairs) for k, x in enumerate(pair)])
    got = {r["doc_id"]: r for r in substring.duplicate_passages(d).collect()}
    assert len(pairs) >= 110 and all(i % 2 and r["copy_of"] == i - 1 for i, r in got.items())
    assert len(got) >= 0.97 * len(pairs)
    whole = [(got[2 * i + 1]["start"], got[2 * i + 1]["end"]) == (60, 60 + len(q.split())) for i, (_, q) in enumerate(pairs) if 2 * i + 1 in got]
    assert sum(whole) >= 0.9 * len(whole)


def test_extents_against_all_intervals():
    r, least = np.random.default_rng(8), 46
    for t in range(40):
        a = r.integers(1, 1 << 60, 160).astype(np.uint64)
        cut = 80 + int(r.integers(-40, 40))
        b = [a[:cut], r.integers(1, 1 << 60, t % 4).astype(np.uint64), a[cut + t % 3 :]]
        b, c = np.concatenate(b), 40 if cut > 80 else 110
        a[: c - 25] ^= np.uint64(0x5555 << 40)
        a[c + 40 :] ^= np.uint64(0x3333 << 40)
        k = c if cut > 80 else c + t % 4 - t % 3
        x, y = (substring.contexts(h, np.array([p])) for h, p in ((a, c), (b, k)))
        sa, sb = substring.tokens(a), substring.tokens(b)
        place = {v: i for i, v in enumerate(sb)}
        at = [place.get(v) for v in sa]
        ends = [i for i, v in enumerate(at) if v is not None and abs(i - c) <= substring.REACH and abs(v - k) <= substring.REACH]
        want = (-1, -1)
        for lo in (i for i in ends if i <= c and at[i] <= k):
            for hi in (j for j in ends if j >= c and at[j] >= k):
                u, v = set(sa[lo : hi + 1]), set(sb[at[lo] : at[hi] + 1])
                if min(len(u), len(v)) >= least and len(u & v) >= 0.8 * len(u | v):
                    want = (max(want[0], c - lo), max(want[1], hi - c))
        assert tuple(int(e[0]) for e in substring.extents(x, y, 0.8, least)[:2]) == want


def test_compact_windows_cover_each_subsequence_once():
    h = np.random.default_rng(4).integers(0, 1 << 60, 60).astype(np.uint64)
    got = substring.compact_windows(h, 10)
    for i in range(60):
        for j in range(i + 9, 60):
            c = i + int(h[i : j + 1].argmin())
            assert sum(lo <= i <= k <= j <= hi and k == c for lo, k, hi in got) == 1


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b\\n"), (2, 0, "user", "a"), (2, 1, "assistant", "</turn>\n### user:\n\\"), (3, 0, "user", "a"), (4, 0, None, None), (5, 0, "user", "a"), (5, 1, "assistant", "b\\n"), (5, 2, "user", "é" * 9)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn int, role string, text string, node int")
    nodes, members = chat.prefix_tree(df)
    got = {r["conv_id"]: r for r in chat.read_back(nodes, members).collect()}
    for i in range(1, 6):
        mine = [(r or "", t or "") for c, _, r, t in rows if c == i]
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert got[i]["loss_chars"] == sum(len(t) for r, t in mine if r == "assistant")
    tree = nodes.collect()
    assert len(tree) == 5  # shared turns are there once
    at = {r["node"]: r for r in tree}
    spans = sorted((r["start"], r["end"]) for r in tree)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    of = {}
    for m in members.collect():
        of.setdefault(m["conv_id"], []).append((m["depth"], m["node"]))
    for path in of.values():
        path.sort()
        for k, (_, n) in enumerate(path):
            above = [at[x] for _, x in path[:k]]
            assert sum(i["end"] - i["start"] for i in at[n]["attends"]) == at[n]["position"] == sum(x["end"] - x["start"] for x in above)
            held = {p for i in at[n]["attends"] for p in range(i["start"], i["end"])}
            assert held == {p for x in above for p in range(x["start"], x["end"])}


def test_language_of_held_out_texts(spark):
    r = random.Random(1)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, make("abcde" if i % 2 else "defgü", 60), "aa" if i % 2 else "dd") for i in range(60)]
    df = spark.createDataFrame(rows + [(60, None, "aa"), (61, "12 !", None)], "doc_id long, text string, lang string")
    p = langid.learn(df.where("doc_id < 40"))
    got = {r["doc_id"]: r for r in langid.identify(df, p).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(40, 60))
    assert got[60]["lang_pred"] == got[61]["lang_pred"] == "und" and all(0 <= g["score"] <= 1 for g in got.values())


def test_quality_without_labels(spark):
    good = [prose(i, 40 + i) for i in range(60)]
    bad = [" ".join(w + "***" for w in prose(i, 60).split()) for i in range(8)] + ["Ab " * 80 for _ in range(4)]
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs(spark, good + bad + ODD)).collect()}
    assert sum(got[i] for i in range(60)) >= 58
    assert not any(got[i] for i in range(60, 68))
    assert not got[72] and not got[73]


def test_quality_finds_each_kind_of_fault(spark):
    good = [prose(i, 60 + i) for i in range(160)]
    repeated = [" ".join(w for w in prose(i, 8).split() for _ in range(9)) for i in range(8)]
    decorated = [" ".join(w + "!!" for w in prose(i, 60).split()) for i in range(8)]
    symbols = [" ".join(["#$%", "{}", "***", "||"] * 20) for _ in range(8)]
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs(spark, good + repeated + decorated + symbols)).collect()}
    assert all(got[i] for i in range(160))
    assert not any(got[i] for i in range(160, 184))


def test_columns_with_the_operators_own_names_stay(spark, texts):
    import corpus_pipeline

    names = ["_t", "_text", "_id", "_spans", "_hash", "_nth", "th", "hash", "of", "kept", "quality_score", "_new"]
    df = docs(spark, texts).select("doc_id", "text", *[F.col("shard").alias(n) for n in names])
    items = spark.createDataFrame([(1, prose(500, 40))], "item_id long, text string")
    for out in (
        corpus_pipeline.good_documents(spark, df, ""),
        substring.remove_passages(df),
        decontaminate.clean(df, items),
        corpus_pipeline.one_of_each(spark, df, ""),
    ):
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[n] == 1 for r in rows for n in names)


def test_toxicity_held_out(spark):
    r = random.Random(2)
    rows = [(i, prose(i, 50) + (" nasty you " + r.choice(["vile", "awful"]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.where("doc_id < 300"))
    got = {r["doc_id"]: r for r in model.score(docs(spark, [t for _, t, _ in rows[300:]] + ODD, 300)).collect()}
    assert all(got[i]["predicted"] == rows[i][2] for i in range(300, 400))
    assert all(0 <= g["score"] <= 1 for g in got.values()) and len(got) == 108
