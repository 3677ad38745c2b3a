"""Quality classifier with a weak-label model.

Heuristic labellers vote good (1), bad (0) or abstain (-1) on each text. Several look for the same kind of
fault, so their votes depend on each other; given the kind of fault they are taken not to. The classes are
therefore good documents and one class for each kind of fault. How often each combination of votes occurs is
counted over all documents; expectation-maximisation over these counts estimates how often each labeller
says bad in each class, and so its accuracy, and the share of each class, without any label. The posterior
of a document's votes then labels a bounded sample, on which a hashed linear scorer is trained; the scorer
alone judges.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import Memo, map_batches, per_text, ready, stored

#: Different texts that the scorer is trained on (an expected number: texts are drawn by a hash), and hashed features.
SAMPLE, BUCKETS = 12_000, 512
#: Score from which a document is kept.
KEEP = 0.5
#: Distinct words whose features a worker remembers; when full, it starts again.
MEMO = 100_000

_SYMBOLS = b"#$%&*<>\\^`{|}~!"
_MARKS = {bytes([c]) for c in _SYMBOLS}
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_run = re.compile(rb"(.)\1+", re.DOTALL)
_SHAPE = bytes(b"A"[0] if 65 <= i <= 90 else b"a"[0] if 97 <= i <= 122 or i > 127 else b"0"[0] if 48 <= i <= 57 else i for i in range(256))


def shape(word: bytes) -> bytes:
    """A word with its letters, capitals and digits each as one sign, runs of a sign as one."""
    return _run.sub(rb"\1", word.translate(_SHAPE))


class Words:
    """What is known of each word of a text: hashed shape, number (for equality), and whether it is bare or decorated."""

    def __init__(self):
        self.memo = Memo(self._know, MEMO)

    def _know(self, w: bytes) -> int:
        bare = not w.translate(None, _SYMBOLS + b".,;:-")
        decorated = w[-1:] in _MARKS and w[-2:-1] == w[-1:]
        return xxhash.xxh64_intdigest(w) >> 24 << 20 | xxhash.xxh32_intdigest(shape(w)) % (BUCKETS // 2) << 2 | bare << 1 | decorated

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))


def rates(text: bytes, words: list[bytes], known: np.ndarray) -> list[float]:
    """Of a text with words: symbols a character, capitals a letter, words without letters, words equal to the one before, distinct words, mean word length, words that end in a doubled symbol, letters and digits a character of words."""
    n, size = len(words), len(b"".join(words))
    letters = len(text) - len(text.translate(None, _LETTERS))
    return [
        (len(text) - len(text.translate(None, _SYMBOLS))) / len(text),
        (len(text) - len(text.translate(None, _UPPER))) / max(1, letters),
        np.count_nonzero(known & 2) / n,
        np.count_nonzero(known[1:] >> 20 == known[:-1] >> 20) / n,
        len(set(words)) / n,
        size / n,
        np.count_nonzero(known & 1) / n,
        (len(text) - len(text.translate(None, _LETTERS + b"0123456789"))) / size,
    ]


#: Each labeller with the kind of fault it looks for, and its vote from the rates and the number of words: good, bad, or between the two bounds none.
RULES = [
    ("symbols", "symbols", lambda r, n: 1 if r[0] < 0.01 else 0 if r[0] > 0.03 else -1),
    ("capitals", "capitals", lambda r, n: 1 if r[1] < 0.15 else 0 if r[1] > 0.4 else -1),
    ("bare_symbols", "symbols", lambda r, n: 1 if r[2] < 0.02 else 0 if r[2] > 0.1 else -1),
    ("repeats", "repetition", lambda r, n: 1 if r[3] < 0.03 else 0 if r[3] > 0.15 else -1),
    ("variety", "repetition", lambda r, n: -1 if n < 50 else 0 if r[4] < min(0.2, 10 / n) else 1 if r[4] > 0.3 else -1),
    ("decorated", "symbols", lambda r, n: 1 if r[6] < 0.02 else 0 if r[6] > 0.1 else -1),
    ("letters", "symbols", lambda r, n: 1 if r[7] > 0.9 else 0 if r[7] < 0.8 else -1),
    ("word_length", "word_length", lambda r, n: 0 if r[5] > 25 or (n > 20 and r[5] < 2) else 1 if 3 <= r[5] <= 12 else -1),
]
KINDS = [k for _, k, _ in RULES]


def votes(text: bytes, know: Words) -> list[int]:
    """One vote of each labeller; all abstain on a text without words."""
    words = text.split()
    if not words:
        return [-1] * len(RULES)
    r = rates(text, words, know(words))
    return [rule(r, len(words)) for _, _, rule in RULES]


@dataclass
class WeakLabels:
    """share[c] of the documents is of class c (0: good, then one for each kind of fault); bad[c][j]: how often labeller j, when it votes, says bad there.

    An abstention says nothing.
    """

    share: np.ndarray
    bad: np.ndarray

    def classes(self, v: np.ndarray) -> np.ndarray:
        """The probability of each class for each row of votes."""
        odds = np.log(self.share) + (v == 0) @ np.log(self.bad.T) + (v == 1) @ np.log(1 - self.bad.T)
        p = np.exp(odds - odds.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        return self.classes(v)[:, 0]

    def accuracy(self) -> np.ndarray:
        """For each labeller how often it is right when it votes, on good documents and those with any fault."""
        return self.share @ np.vstack([1 - self.bad[:1], self.bad[1:]])


#: Where EM starts, which names the classes: how often labellers say bad on good documents, on those with their fault, and on those with an other.
#: These rates also count as PRIOR votes each, so that no rate is 0 or 1; more votes outweigh them.
ON_GOOD, ON_OWN, ON_OTHER, PRIOR = 0.005, 0.5, 0.02, 10.0
#: The share of good documents that EM starts from.
GOOD = 0.8


def fit_labels(v: np.ndarray, n: np.ndarray, kinds: list[str] = KINDS, rounds: int = 300) -> WeakLabels:
    """EM over distinct vote rows v (a column for each labeller, which looks for the fault named in kinds) with counts n."""
    names = list(dict.fromkeys(kinds))
    first = np.array([[ON_GOOD] * len(kinds)] + [[ON_OWN if k == name else ON_OTHER for k in kinds] for name in names])
    model = WeakLabels(np.array([GOOD] + [(1 - GOOD) / len(names)] * len(names)), first)
    for _ in range(rounds if len(v) else 0):
        w = model.classes(v) * n[:, None]
        bad = (w.T @ (v == 0) + PRIOR * first) / (w.T @ (v >= 0) + PRIOR)
        done = np.abs(bad - model.bad).max() < 1e-9
        model = WeakLabels((w.sum(0) + 1) / (w.sum() + w.shape[1]), bad)
        if done:
            break
    return model


def hashed(text: bytes, know: Words) -> np.ndarray:
    """Hashed features of a text: shapes of its words and of neighbours, and repeats, as shares of its words."""
    x, words = np.zeros(BUCKETS), text.split()
    if not words:
        return x
    known = know(words)
    half, s = BUCKETS // 2, known >> 2 & (BUCKETS // 2 - 1)
    x[:half] = np.bincount(s, minlength=half)
    x[half:-1] = np.bincount((s[:-1] * 40503 + s[1:]) % (half - 1), minlength=half - 1)
    x[-1] = np.count_nonzero(known[1:] >> 20 == known[:-1] >> 20)
    return x / len(words)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500))))


def weak_labels(docs: DataFrame, text: str = "text") -> WeakLabels:
    """The label model of docs, from the votes on every document."""
    ready(docs.sparkSession)
    names = [f"v{j}" for j in range(len(RULES))]

    def run(batches):
        know = Words()
        for batch in batches:
            if batch.num_rows:
                v = np.array([votes(t.as_py() or b"", know) for t in batch.column(0)], np.int32)
                seen, n = np.unique(v, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(seen[:, j]) for j in range(len(names))), pa.array(n)], names=[*names, "n"])

    counts = docs.select(F.col(text).cast("binary")).mapInArrow(run, ", ".join(f"{n} int" for n in names) + ", n long")
    rows = counts.groupBy(*names).agg(F.sum("n")).collect()  # at most 3 ** labellers rows
    return fit_labels(np.array([r[:-1] for r in rows]).reshape(-1, len(names)), np.array([r[-1] for r in rows], float))


def train(docs: DataFrame, labels: WeakLabels, text: str = "text", sample: int = SAMPLE) -> Scorer:
    """The scorer, trained on the posteriors of about `sample` different texts; each counts as good and as bad by its posterior.

    Texts are drawn by their hash, and copies of a text count once, whatever the size of docs.
    """
    ready(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    n = texts.agg(F.approx_count_distinct(F.xxhash64("t"), 0.02)).first()[0]
    share = min(1.0, sample / max(n, 1))
    drawn = texts.where(F.pmod(F.xxhash64("t", F.lit(3)), F.lit(1 << 40)) <= int(share * (1 << 40))).dropDuplicates(["t"])

    def run(batch: pa.RecordBatch) -> dict:
        know, texts = Words(), batch.column(0).to_pylist()
        p = labels.posterior(np.array([votes(t, know) for t in texts]))
        return {"p": pa.array(p), "x": pa.array([hashed(t, know) for t in texts], pa.list_(pa.float64()))}

    rows = stored(map_batches(drawn, run, "p double, x array<double>"))
    both = rows.select(array_to_vector("x").alias("features"), F.explode(F.expr("array(struct(1d AS label, p AS weight), struct(0d AS label, 1 - p AS weight))")).alias("y"))
    both = both.select("features", "y.label", "y.weight").where("weight > 0.001")
    if both.select("label").distinct().count() < 2:
        return Scorer(np.zeros(BUCKETS), 10.0)
    model = LogisticRegression(maxIter=40, regParam=1e-4, weightCol="weight").fit(both)
    return Scorer(model.coefficients.toArray(), float(model.intercept))


def quality_score(scorer: Scorer):
    """A column function: the scorer's opinion (0..1) of a whole text; 0 for one without words (null, empty, blank)."""

    def make():
        know = Words()
        return lambda t: scorer.score(hashed(t, know)) if t.strip() else 0.0

    return per_text(make, "double", pa.float64())


def classify(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs with `quality_score` (0..1, higher: better) and `kept` (score >= keep): one row for each row.

    Texts without words (null, empty, blank) score 0 and are not kept. Repeated rows score alike. Columns of docs with
    these two names are replaced. An empty table gives no rows.
    """
    scorer = train(docs, weak_labels(docs, text), text)
    return docs.drop(*({"quality_score", "kept"} - {text})).withColumn("quality_score", quality_score(scorer)(F.col(text))).withColumn("kept", F.col("quality_score") >= keep)


def good(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs (every column as it is) that classify() keeps."""
    scorer = train(docs, weak_labels(docs, text), text)
    return docs.where(quality_score(scorer)(F.col(text)) >= keep)
