"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, plus signs, digits, schemes and words that announce an account. A parser
for each kind of anchor looks at the text around it only: it expands to both sides as far as the kind's alphabet goes and then checks what
it has (parts of an address, the check digits of a card or an IBAN). An anchor inside what its own kind has already taken is
passed over, so spans of one kind never overlap, are found from left to right, and every character is looked at a bounded number of times.

Base kinds are those of fixed expressions (email, ip, card, phone); the others (url, account) are added beside them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import col, free, ready

#: Kinds of spans, in the order that breaks ties; the first four are the base ones.
KINDS = ["email", "ip", "card", "phone", "url", "account"]
BASE = 4

# Alphabets, lengths and cues.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
CARD_DIGITS, PHONE_DIGITS, PART = (14, 19), (10, 15), 255
SCHEMES = ["http://", "https://", "ftp://", "ftps://", "ssh://", "sftp://"]
CUES = ["iban", "account", "acct", "a/c", "routing", "sort code", "ssn", "social security", "passport", "tax id", "konto", "cuenta", "compte"]

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_chain = re.compile(r"[0-9](?:[ -]?[0-9])*")
_quads = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_number = re.compile(r"[0-9]+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_address = re.compile(r"[^\s<>\"'`{}|\\^]+")
_host = re.compile(r"(?:[^/?#@]*@)?(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?(?=[/?#]|$)")
_between = re.compile(r"(?: ?(?:number|num|no|nr|code|id|is)\b\.?)? ?[#:=]? ?(?:is )?")
_identifier = re.compile(r"[A-Z0-9](?:[ -]?[A-Z0-9]){0,47}")  # an IBAN has at most 34, in groups of four
_country = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_prefix = re.compile(r"[A-Z]{2} ?[0-9]{2}")
_edge = re.compile(r"[A-Za-z0-9_]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    back = [int(d) for d in digits[::-1]]
    return (sum(back[::2]) + sum(twice[d] for d in back[1::2])) % 10 == 0


def iban(text: str) -> bool:
    """Whether letters and digits are an IBAN whose check digits fit."""
    if not _country.fullmatch(text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Finder:
    """Finds spans (start, kind, end) in texts; places are code points and end is excluded."""

    def __init__(self):
        self.anchors = ahocorasick.Automaton()
        for d in DIGITS:
            self.anchors.add_word(d, (self._digit, 1))
        self.anchors.add_word("@", (self._at, 1))
        self.anchors.add_word("+", (self._plus, 1))
        for words, parse in ((SCHEMES, self._scheme), (CUES, self._cue)):
            for w in words:
                for x in {w, w.upper(), w.capitalize(), w.title()}:
                    self.anchors.add_word(x, (parse, len(x)))
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        self.text, self.found, self.taken = text, [], [0] * len(KINDS)
        self.chain = self.quads = self.run = self.stop = 0  # how far what stands around the anchors so far was looked at
        for last, (parse, n) in self.anchors.iter(text):
            parse(last - n + 1, last + 1)
        return sorted(self.found)

    def _take(self, kind: str, start: int, end: int) -> None:
        k = KINDS.index(kind)
        self.found.append((start, k, end))
        self.taken[k] = end

    def _at(self, at: int, after: int) -> None:
        """An email address: what can stand before the sign, back to the address before, and labels joined by dots."""
        text, low, start = self.text, self.taken[0], at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _domain.match(text, after)):
            self._take("email", start, m.end())

    def _digit(self, at: int, _: int) -> None:
        """A card number from the first digit of a chain, and an address of four numbers from the first digit of a number."""
        if at >= self.chain:
            self.chain = _chain.match(self.text, at).end()
            if self.chain - at >= CARD_DIGITS[0]:
                digits = self.text[at : self.chain].replace(" ", "").replace("-", "")
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    self._take("card", at, self.chain)
        if at >= self.quads:
            if m := _quads.match(self.text, at):
                self.quads = m.end()
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= PART for x in m[0].split(".")):
                    self._take("ip", at, self.quads)
            else:
                self.quads = _number.match(self.text, at).end()

    def _plus(self, at: int, _: int) -> None:
        """A telephone number: its country's first digit, digits and what may stand between them, up to the last digit."""
        if m := _phone.match(self.text, at):
            if PHONE_DIGITS[0] <= sum(map(m[0].count, DIGITS)) <= PHONE_DIGITS[1]:
                self._take("phone", at, m.end())

    def _scheme(self, at: int, after: int) -> None:
        """An address with a scheme: to white space or what can't stand in one, without the punctuation of the sentence; its host must be one."""
        text = self.text
        if after >= self.run and (m := _address.match(text, after)):
            self.run, self.stop = m.end(), m.end()
            while text[self.stop - 1] in ".,;:!?)]*_" and self.stop > after:
                self.stop -= 1
        if at < self.taken[4] or at and text[at - 1].isalnum() or after >= self.stop:
            return
        if _host.match(text, after, self.stop):
            self._take("url", at, self.stop)

    def _cue(self, at: int, after: int) -> None:
        """An account after a word that announces one: letters and digits in groups; an IBAN by its check digits, else at least six digits in the first groups that hold one."""
        text = self.text
        if at < self.taken[5] or at and _edge.match(text, at - 1) or _edge.match(text, after):
            return
        m = _identifier.match(text, _between.match(text, after).end())
        if not m or m.end() <= self.taken[5]:
            return
        start, whole = m.start(), m[0]
        for n in range(len(whole), 14 if _prefix.match(whole) else len(whole), -1):
            if whole[n - 1] not in " -" and iban(whole[:n].replace(" ", "").replace("-", "")):
                self._take("account", start, start + n)
                return
        end = start
        for group in re.finditer(r"[A-Z0-9]+", whole):
            if not any(c in DIGITS for c in group[0]):
                break
            end = start + group.end()
        if sum(map(text[start:end].count, DIGITS)) >= 6 and not _edge.match(text, end):
            self._take("account", start, end)


def listed(spans: list[tuple[int, int, int]]) -> str:
    """Spans as kind:start:end, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _over_texts(finish: Callable[[str, list[tuple[int, int, int]]], object], kind: str, arrow: pa.DataType, texts: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = Finder()
        for column in batches:
            out = []
            for t in column:
                text = t.as_py().decode("utf-8", "replace") if t.is_valid else ""
                out.append(finish(text, find(text)))
            yield pa.array(out, arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()(texts.cast("string").cast("binary"))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """docs with `name`: the personal data of each text as (kind, start, end) in code points, end excluded, by start and then kind; [] for a null or clean text."""
    ready(docs.sparkSession)
    make = lambda _, spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
    return docs.withColumn(name, _over_texts(make, "array<struct<kind: string, start: long, end: long>>", SPAN, col(text)))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with [KIND] for each span; of spans that overlap the first is named and all are covered."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with [EMAIL], [IP], [CARD], [PHONE], [URL] or [ACCOUNT] for personal data; clean and null texts stay as they are."""
    ready(docs.sparkSession)
    new = _over_texts(lambda t, spans: masked(t, spans) if spans else None, "string", pa.string(), col(text))
    own = free(docs, "_masked")
    rows = docs.withColumn(own, new)
    return rows.withColumn(text, F.coalesce(own, col(text))).drop(own)


DIGESTS = {**{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string()}


def _summary(_: str, spans: list[tuple[int, int, int]]) -> dict:
    count = [0] * len(KINDS)
    for _, k, _ in spans:
        count[k] += 1
    base = listed([s for s in spans if s[1] < BASE])
    return {f"n_{k}": n for k, n in zip(KINDS, count, strict=True)} | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": listed(spans)}


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_url, n_account, base_sha256, spans): a row for each row of docs.

    spans lists all spans as kind:start:end, base_sha256 is the digest of such a list of the base ones. A null text counts as empty; repeated rows
    and null ids each keep their row; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    kind = "struct<" + ", ".join(f"{n}: {'string' if t == pa.string() else 'long'}" for n, t in DIGESTS.items()) + ">"
    made = _over_texts(_summary, kind, pa.struct(list(DIGESTS.items())), col(text))
    return docs.select(col(doc_id).alias("doc_id"), made.alias("d")).select("doc_id", "d.*")
