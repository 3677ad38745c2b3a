"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (n = 1..3) in rank order. A text's own most
frequent n-grams are ranked the same way, and its distance to a profile is the sum of how far each n-gram
is out of place (a fixed penalty if the profile lacks it). The nearest profile names the language.

Letters are folded to lower case; any run of other characters is one boundary. An n-gram is a 20-bit hash
of its code points, so letters of all scripts count alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaica.llm.common import col, free, map_batches, per_text, ready

#: N-grams in a profile, and bits of an n-gram.
TOP, BITS = 300, 20
#: Labelled rows that profiles are learnt from (an expected number: rows are drawn by a hash), and the most languages; more are an error.
SAMPLE, MOST_LANGS = 20_000, 10_000
#: N-grams counted at a time.
STEP = 1 << 20

_letter = np.array([chr(i).isalpha() for i in range(0x110000)])
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)]


def lowered(text: str | None) -> np.ndarray:
    """Code points of a text, lower-cased, with a 0 for each run of what isn't a letter, and one at either end."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_letter[x], x, np.uint32(0))
    x = np.concatenate([np.zeros(1, np.uint32), x, np.zeros(1, np.uint32)])
    return x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]


def _hashed(x: np.ndarray, n: int) -> np.ndarray:
    h = sum((x[i : len(x) - n + 1 + i] * _ODD[i] for i in range(n)), np.uint32(n))
    return ((h ^ (h >> np.uint32(15))) * _ODD[3]) >> np.uint32(32 - BITS)


def grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (hashes) of lowered() points and their counts; a boundary alone is none. Long texts are counted in steps, each n-gram once."""
    total = np.zeros(1 << BITS, np.int64) if len(x) > STEP else None
    for at in range(0, len(x), STEP):
        part = x[at : at + STEP + 2]
        ids = np.concatenate([_hashed(part[:STEP][part[:STEP] != 0], 1), _hashed(part[: STEP + 1], 2), _hashed(part, 3)])
        if total is None:
            return np.unique(ids, return_counts=True)
        total += np.bincount(ids, minlength=1 << BITS)
    i = np.flatnonzero(total)
    return i, total[i]


def ranked(ids: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent ids first, ties by id."""
    if len(ids) > top:
        keep = counts >= np.partition(counts, -top)[-top]
        ids, counts = ids[keep], counts[keep]
    return ids[np.lexsort((ids, -counts))][:top]


@dataclass
class Profiles:
    langs: list[str]
    tops: list[np.ndarray]

    def __post_init__(self):
        # for each n-gram the profiles that hold it, with its rank there
        gram = np.concatenate([np.zeros(0, np.int64), *self.tops])
        order = np.argsort(gram, kind="stable")
        self.start = np.searchsorted(gram[order], np.arange((1 << BITS) + 1)).astype(np.int32)
        self.lang = np.concatenate([np.zeros(0, np.int32), *(np.full(len(t), i, np.int32) for i, t in enumerate(self.tops))])[order]
        self.rank = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(t), dtype=np.int32) for t in self.tops)])[order]

    def __reduce__(self):
        return Profiles, (self.langs, self.tops)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 for a text in the very order of the profile, 0 if it shares no n-gram; ties to the first language."""
        points = lowered(text)
        if not self.langs or not points.any():
            return "und", 0.0
        own = ranked(*grams(points))
        first, n = self.start[own], self.start[own + 1] - self.start[own]
        held = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        nearer = TOP - np.abs(self.rank[held] - np.repeat(np.arange(len(own)), n))  # than if the profile lacked it
        far = TOP * len(own) - np.bincount(self.lang[held], nearer, len(self.langs))
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (TOP * len(own)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages of docs, from about `sample` rows drawn by a hash of `key`.

    Rows with a null text or lang don't count, texts without letters add nothing, repeated rows count each time. Without
    rows there are no languages. More than MOST_LANGS languages are an error, as profiles go to every task.
    """
    ready(docs.sparkSession)
    docs = docs.where(col(text).isNotNull() & col(lang).isNotNull()).select(col(lang).cast("string").alias("lang"), col(text).alias("text"), col(key).alias("key"))
    share = min(1.0, sample / max(docs.count(), 1))
    docs = docs.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 40)) <= int(share * (1 << 40))).select("lang", "text")

    def count_grams(batch: pa.RecordBatch) -> dict:
        by: dict[str, list] = {}
        for lg, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if (x := lowered(t.as_py())).any():
                by.setdefault(lg, []).append(grams(x))
        langs, ids, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lg, found in by.items():
            i, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            langs += [lg] * len(i)
            ids.append(i.astype(np.int64))
            counts.append(np.bincount(inverse, np.concatenate([f[1] for f in found])).astype(np.int64))
        return {"lang": pa.array(langs, pa.string()), "gram": pa.array(np.concatenate(ids)), "n": pa.array(np.concatenate(counts))}

    counts = map_batches(docs, count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # a language has at most 2 ** BITS rows
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TOP)
    by: dict[str, list] = {}
    for r in top.orderBy("lang", "r").limit(TOP * MOST_LANGS + 1).collect():
        by.setdefault(r["lang"], []).append(r["gram"])
    if len(by) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    return Profiles(list(by), [np.array(v) for v in by.values()])


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs without the text, with `lang_pred` and `score`. Null texts and texts without a letter are `und`, score 0.

    Other columns stay, but any named lang_pred or score are replaced. Every row, repeated ones too, is predicted by itself
    from its whole text; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make():
        return lambda t: dict(zip(("lang", "score"), shared.value.predict(t.decode("utf-8", "surrogatepass")), strict=True))

    rest = [col(c) for c in docs.columns if c not in (text, "lang_pred", "score")]
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
    own = free(docs, "_found")
    rows = docs.select(*rest, per_text(make, "struct<lang: string, score: double>", kind)(col(text)).alias(own))
    return rows.select(*rest, F.col(own)["lang"].alias("lang_pred"), F.col(own)["score"].alias("score"))
