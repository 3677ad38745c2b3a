"""The registered queries on a small folder of odd rows, and on empty tables, against plain versions."""

import hashlib
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_llm import ODD, PATH, PATTERN, closure, prose

import corpus_pipeline
from mosaica.llm import bpe, common, decontaminate, langid, quality, queries, sharding, simhash, substring, toxicity

KINDS = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "conversations": [("conv_id", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string())],
}


def write(folder, **rows):
    for name, kinds in KINDS.items():
        columns = list(zip(*rows.get(name, []), strict=True)) or [[]] * len(kinds)
        pq.write_table(pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds, columns, strict=True)}), f"{folder}/{name}.parquet")
    return str(folder)


def odd_documents():
    r = random.Random(9)
    leak = [prose(4000 + i, 40) + ". " + prose(4100 + i, 10) + "." for i in range(6)]
    base = [prose(i, 90 + i) for i in range(50)]
    shared = prose(4200, 70)
    texts = [*base, *ODD, base[3], base[4], base[3] + " x", *(base[10 + i] + " " + leak[i] for i in range(4)), base[20] + " " + shared, base[21] + " " + shared + " tail", "Ab! " * 70]
    docs = [(i, t, None if i % 7 == 0 else ("aa", "bb")[i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    docs += [(5, base[5], "aa", "s", 1)] * 4 + [(None, base[6], None, None, None), (None, None, None, None, None), (2, "an other text of a known id", "aa", "s", 2)]
    labels = [(i, 1, int(r.random() < 0.3)) for i in range(40)] + [(None, None, None), (3, None, None), (3, 0, 1)]
    return docs, labels, [*enumerate(leak), (90, None), (91, ""), (92, leak[0]), (None, "some item without an id at all")]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    docs, labels, items = odd_documents()
    talk = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c###"), (2, 1, "assistant", "c###"), (None, 0, None, None), (3, None, "assistant", ""), (4, 0, "user", "é" * 9000)]
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12, 6)).astype(np.float32)
    vectors = [(i, list(map(float, v)), i % 2) for i, v in enumerate([*x, *x[:5]])] + [(3, list(map(float, x[3])), 1), (None, list(map(float, x[0])), 0), (50, None, 1), (51, [0.0] * 6, 1), (52, [1.0], None), (53, [None] * 6, 1), (54, [1.0, 2.0], 1)]
    folder = write(tmp_path_factory.mktemp("odd"), documents=docs, labels=labels, benchmark=items, conversations=talk, embeddings=vectors)
    return folder, docs, items, talk, vectors


def rows(spark, name, folder):
    return queries.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    got = rows(spark, name, write(tmp_path))
    assert [r["conv_id"] for r in got] == [-7] if name == "op6_chat_format" else got == []


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path)).collect() == []


def test_tokens_of_odd_rows(spark, odd):
    folder, docs, *_ = odd
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids := own.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in docs)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op2_byte_bpe", folder)) == want


def test_fingerprints_of_odd_rows(spark, odd):
    folder, docs, *_ = odd
    fp = [simhash.fingerprint((t or "").encode()) for _, t, *_ in docs]
    low = closure(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    first = {}
    for (i, *_), c in zip(docs, low, strict=True):
        first[c] = min((x for x in (first.get(c), i) if x is not None), default=None)
    want = sorted((str(i), f"{p:016x}", str(first[c])) for (i, *_), p, c in zip(docs, fp, low, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows(spark, "op7_simhash", folder)) == want


def test_shards_of_odd_rows(spark, odd):
    folder, docs, *_ = odd
    got = rows(spark, "op9_sharding", folder)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_languages_and_toxicity_of_odd_rows(spark, odd):
    folder, docs, *_ = odd
    held = {str(i): i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in docs}
    for name in ("op5_language_id", "op8_toxicity"):
        got = rows(spark, name, folder)
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in docs)
        assert all(r["held_out"] == held[str(r["doc_id"])] and 0 <= r["score"] <= 1 for r in got)
        if name == "op5_language_id":
            texts = {i: t for i, t, *_ in docs[:-7]}
            assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[r["doc_id"]] or ""))) for r in got if r["doc_id"] not in (None, 2))
        else:
            assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_vectors_of_odd_rows(spark, odd):
    *_, vectors = odd
    v = [None if x is None or any(c is None for c in x) or not any(x) else np.array(x) for _, x, _ in vectors]
    linked = lambda i, j: v[i] is not None and v[j] is not None and vectors[i][2] is not None and vectors[i][2] == vectors[j][2] and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.98
    low = closure(len(v), linked)
    first = {}
    for (i, *_), c in zip(vectors, low, strict=True):
        first[c] = min((x for x in (first.get(c), i) if x is not None), default=None)
    want = sorted((str(i), sum(linked(k, j) for j in range(len(v)) if j != k), str(first[c])) for k, ((i, *_), c) in enumerate(zip(vectors, low, strict=True)))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rows(spark, "op1_embedding_dedup", odd[0])) == want


def test_conversations_of_odd_rows(spark, odd):
    folder, _, _, talk, _ = odd
    line = "\\### Assistant: </turn> ok"
    by = {}
    for c, t, r, x in [*talk, (-7, 0, "user", line), (-7, 1, "assistant", line)]:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in by.items():
        loss = "".join(x for *_, r, x in sorted(turns) if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in sorted(turns))), len(loss), sha(loss))
    got = {r["conv_id"]: r for r in rows(spark, "op6_chat_format", folder)}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    escaped = line.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
    assert got[-7]["formatted_chars"] == sum(len(f"### {r}:\n{escaped}</turn>\n") for r in ("user", "assistant"))


def plain_leaks(docs, items):
    out = []
    for i, t, *_ in docs:
        w = decontaminate.words((t or "").encode())
        held = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        for item, x in items:
            parts = [p for p in decontaminate.question_and_answer((x or "").encode()) if p]
            sets = [{tuple(p[k : k + min(5, len(p))]) for k in range(max(1, len(p) - 4))} for p in parts]
            if sets and all(sum(g in held[len(g)] for g in s) >= 0.8 * len(s) for s in sets):
                out.append((str(i), str(item)))
    return sorted(out)


@pytest.mark.parametrize("most", [20_000, 2])
def test_leaks_of_odd_rows(spark, odd, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", most)  # with 2 items an index there are several passes
    folder, docs, items, *_ = odd
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in rows(spark, "op10_decontamination", folder)) == plain_leaks(docs, items) != []


def test_pipeline_of_odd_rows(spark, odd):
    folder, docs, items, *_ = odd
    table, stages = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        table = common.stored(stage(spark, table, folder))
        stages.append(table.collect())
    good, one, cut, clean, tokens = stages
    assert {str(r["doc_id"]) for r in good} >= {str(i) for i in range(50)} and all((r["text"] or "").strip() for r in good)
    groups = {}
    for r in good:
        groups.setdefault((r["text"] or ""), set()).add(r["doc_id"])
    assert {r["text"] for r in one} <= set(groups) and len({r["text"] for r in one}) == len(one)
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    assert not plain_leaks([(r["doc_id"], r["text"]) for r in clean], items)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    texts = sorted((str(r["doc_id"]), own.encode_ordinary(r["text"] or "")) for r in clean)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in tokens) == texts and all(r["exact"] for r in tokens)
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(tokens)


def test_scores_and_shards_keep_columns_with_the_operators_own_names(spark):
    names = ["_key", "_part", "_at", "_start", "_salt", "_group", "features", "probability", "_raw", "_calibrated", "x", "row", "score_", "_found"]
    df = spark.createDataFrame([(i, prose(i, 20), 28, *[i] * len(names)) for i in range(30)], ["doc_id", "text", "size", *names])
    shards = sharding.shard(df, "text", "size", ["doc_id"], 3)
    labelled = df.select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    scores = toxicity.learn(labelled).score(df)
    langs = langid.identify(df, langid.learn(df.withColumn("lang", F.lit("aa"))))
    for out in (shards, scores, langs):
        got = out.collect()
        assert len(got) == 30 and all(r[n] == r["doc_id"] for r in got for n in names)


def test_loads_are_those_of_plain_scheduling(spark):
    r = random.Random(4)
    sizes = [int(1.3 ** r.randrange(40)) + 1 for _ in range(300)]
    df = spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(sizes)], "doc_id long, text string, size long")
    got = sharding.shard(df, "text", "size", ["doc_id"], 5).groupBy("shard").agg(F.sum("size")).collect()
    plain = [0] * 5
    for s in sorted(sizes, reverse=True):
        plain[plain.index(min(plain))] += s
    assert max(x[1] for x in got) <= max(plain) + sum(sizes) / (5 * sharding.FINE) + 1


def test_simhash_cells_lose_no_pair(spark):
    r = random.Random(8)
    x = [r.getrandbits(64) for _ in range(300)]
    x += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in x[:60] for _ in range(3)]
    x = sorted(set(x))
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    d = simhash.distances(np.array(x, np.uint64))
    assert len(simhash.cuts(np.stack([np.bincount(c, minlength=65) for c in d.T]), 2, 16)) >= 4
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), cell=16)
    comp = {r["node"]: r["component"] for r in common.components(found).collect()}
    want = closure(len(x), lambda i, j: (x[i] ^ x[j]).bit_count() <= 2)
    got = [comp.get(v, v) for v in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_many_cells_of_vectors_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((60, 16))
    x = np.concatenate([c + 0.55 * rng.standard_normal((50, 16)) for c in centers])
    near = x[:400] + 0.035 * np.linalg.norm(x[:400], axis=1, keepdims=True) * rng.standard_normal((400, 16)) / 2
    v = np.concatenate([x, near]).astype(np.float32).astype(float)
    from mosaica.llm import embedding_dedup

    table = spark.createDataFrame([(i, list(map(float, a)), 1) for i, a in enumerate(v)], "vec_id long, embedding array<float>, label int")
    index = embedding_dedup.fit(table.selectExpr("vec_id as node", "embedding as v"), len(v), 1, 0.98)
    assert len(index.words[0]) ** 2 > 40
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum() - len(v)
    got = sum(r["n_links"] for r in embedding_dedup.near_duplicates(table).collect())
    assert want > 300 and 0.99 * want <= got <= want


def edited(seed, n, kind):
    """A passage of n words, and it with words replaced, inserted or deleted at random places, as many as leave its shingles a similarity of 0.8."""
    r, p = random.Random(seed), prose(10_000 + seed, n).split()
    while True:
        q = list(p)
        for _ in range(r.randrange(1, 2 + n // 60)):
            at = r.randrange(2, len(q) - 2)
            q[at : at + (kind != "inserted")] = [] if kind == "deleted" else [f"new{r.randrange(99)}"]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (p, q))
        if len(q) >= 50 and len(a & b) >= 0.8 * len(a | b):
            return p, q


def test_edited_passages_are_found_and_covered(spark):
    made = [(k, n, *edited(1000 * n + 10 * i + j, n, k)) for j, k in enumerate(("replaced", "inserted", "deleted")) for n in (55, 70, 90, 120, 200, 300) for i in range(8)]
    texts = [prose(1_000_000 + 2 * i + side, 70) + " " + " ".join(pair[side]) + " " + prose(2_000_000 + 2 * i + side, 70) for i, (_, _, *pair) in enumerate(made) for side in (0, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {}
    for r in substring.duplicate_passages(df).collect():
        assert r["doc_id"] % 2 == 1 and r["copy_of"] == r["doc_id"] - 1
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for kind in ("replaced", "inserted", "deleted"):
        found, covered = [], []
        for i, (k, _, _, q) in enumerate(made):
            if k == kind:
                held = {p for lo, hi in spans.get(2 * i + 1, []) for p in range(lo, hi)}
                found.append(bool(held))
                covered.append(len(held & set(range(70, 70 + len(q)))) / len(q) if held else None)
        share = [c for c in covered if c is not None]
        print(kind, sum(found), len(found), round(sum(share) / len(share), 3))
        assert sum(found) >= 0.9 * len(found) and sum(share) >= 0.9 * len(share)


def test_weak_labels_find_the_labellers_accuracies():
    rng, n = np.random.default_rng(5), 40_000
    kinds = ["a", "a", "b", "b", "a", "b"]  # a kind with fewer than three labellers is not told exactly from votes
    share = np.array([0.85, 0.1, 0.05])
    bad = np.array([[0.01, 0.03, 0.005, 0.02, 0.0, 0.02], [0.9, 0.6, 0.04, 0.02, 0.3, 0.03], [0.02, 0.03, 0.8, 0.55, 0.01, 0.7]])
    y = rng.choice(3, n, p=share)
    v = np.where(rng.random((n, 6)) < 0.1, -1, (rng.random((n, 6)) >= bad[y]).astype(int))
    seen, count = np.unique(v, axis=0, return_counts=True)
    model = quality.fit_labels(seen, count.astype(float), kinds)
    assert np.abs(model.share - share).max() < 0.01 and np.abs(model.bad - bad).max() < 0.05
    true = np.array([((v[:, j] == 1) == (y == 0))[v[:, j] >= 0].mean() for j in range(6)])
    assert np.abs(model.accuracy() - true).max() < 0.01
    best = quality.WeakLabels(share, np.clip(bad, 1e-6, None)).posterior(v)  # by the true rates
    assert ((model.posterior(v) >= 0.5) == (y == 0)).mean() > ((best >= 0.5) == (y == 0)).mean() - 0.003
    assert quality.fit_labels(np.zeros((0, 6), int), np.zeros(0), kinds).posterior(v[:3]).shape == (3,)


def test_grams_of_long_texts_are_counted_once(monkeypatch):
    x = langid.lowered(prose(3, 4000) + " ,;. Ünï")
    whole = langid.grams(x)
    monkeypatch.setattr(langid, "STEP", 1000)
    cut = langid.grams(x)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def test_scripts_are_told_apart(spark):
    r = random.Random(6)
    make = lambda lo, n: "".join(chr(lo + r.randrange(200)) for _ in range(n))
    starts = {"one": 0x4E00, "two": 0xAC00, "three": 0x4F00}
    data = [(i, make(starts[k], 300), k) for i in range(30) for k in starts]
    df = spark.createDataFrame([(i, t, k) for i, (_, t, k) in enumerate(data)], "doc_id long, text string, lang string")
    got = langid.identify(df, langid.learn(df.where("doc_id < 60"))).where("doc_id >= 60").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_fingerprints_and_leaks_of_texts_past_the_steps(monkeypatch):
    text = prose(11, 5000).encode()
    items = [(1, prose(500, 30).encode()), (2, " ".join(prose(11, 5000).split()[997:1030]).encode())]
    whole, index = simhash.fingerprint(text), decontaminate.Index(items)
    found = index.search(text)
    monkeypatch.setattr(simhash, "STEP", 100)
    monkeypatch.setattr(decontaminate, "STEP", 100)
    assert simhash.fingerprint(text) == whole and index.search(text) == found and [f[0] for f in found] == [2]
    w = text.decode().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    assert whole == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_word_hashes_of_words_past_the_steps(monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(substring, "STEP", 16)
    known = {}
    for _ in range(400):
        text = bytes(r.choice(b"abcAB \n\x0b\xc3") for _ in range(r.randrange(120)))
        words, h = text.lower().split(), substring.word_hashes(text)
        assert len(words) == len(h) and all(known.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))
    assert len(set(known.values())) == len(known)


def test_large_index_is_small():
    import pickle

    r = random.Random(1)
    items = [(i, b" ".join(b"w%d" % r.randrange(60_000) for _ in range(30))) for i in range(20_000)]
    assert len(pickle.dumps(decontaminate.Index(items))) < 100e6


def test_entry_without_the_training_data_modules(monkeypatch):
    import __spark_entry__

    for name in ("mosaica.llm.queries", "mosaica.llm.pipeline_query"):
        monkeypatch.setitem(sys.modules, name, None)
    assert "flagship_field_scores" in __spark_entry__.queries() and not any(n.startswith("op") for n in __spark_entry__.queries())
