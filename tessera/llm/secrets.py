"""Secret scan: fixed patterns, and guess-cost dynamic programming for values in credential contexts."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

KINDS = ("assign", "access", "hex", "guess")
#: Fixed patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a credential is expected; its name may have further parts, and a scheme may stand before the
#: value, which runs to white space, a quote or a bracket.
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth|secret|signing|encryption|master|account|client)[_-]?key|credentials?|auth(?:orization)?)"""
    r"""(?i:[_-]?(?:key|token|secret|password|value|string|base64|b64|[0-9]{1,3})){0,3}["']?[\x20\t]*(?::|=>?)[\x20\t]*["'`]?(?:(?i:bearer|basic|token)[\x20\t]+["'`]?)?([^\s"'`,;<>(){}\[\]]{6,})""",
    re.ASCII,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

#: Common words in passwords, most common first: a fixed list; callers may give their own.
COMMON = tuple(
    """password admin user login welcome test secret token qwerty letmein master dragon monkey shadow sunshine princess
    football baseball hello love money summer winter spring autumn monday friday january february march april june july
    august september october november december the and for you that this with have from not are was but all can your
    example sample changeme default root guest public private key value null none true false undefined string required
    optional hidden redacted here foo bar baz demo staging production server client access api auth basic bearer http
    https www com net org company office home work account name email phone city london paris berlin madrid star angel
    tiger soccer hockey killer pepper ginger cookie cheese coffee orange banana apple purple yellow black white silver
    gold blue green red king queen jack lucky happy magic power super batman superman matrix computer internet system
    service database config setting option number code open world secure safe pass word""".split()
)
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: Dates: year first, day first, a year alone.
DATES = tuple(
    map(
        re.compile,
        (
            r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])",
            r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d",
            r"(?:19|20)\d\d",
        ),
    )
)
_NEXT = {a + b for row in KEYBOARD for a, b in zip(row, row[1:], strict=False)} | {b + a for row in KEYBOARD for a, b in zip(row, row[1:], strict=False)}
_LEET = str.maketrans("@4310$57!", "aaeiosst" + "i")


def vocabulary(path: str) -> tuple[str, ...]:
    """COMMON and after it the words of three letters or more that a vocabulary file has, in its order (frequent ones first)."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = (t[1:].lower() for t in sorted(ids, key=ids.__getitem__) if t[0] == "\u0120")
    return tuple(dict.fromkeys([*COMMON, *(w for w in words if len(w) > 2 and w.isascii() and w.isalpha())]))


class GuessCost:
    """log10 of the guesses for a value: the cheapest way to cut it into words, dates, repeats, keyboard walks and other spans."""

    def __init__(self, words: tuple[str, ...] = COMMON):
        self.rank = {}
        for k, w in enumerate(words):
            self.rank.setdefault(w.lower(), k + 1)
        self.longest = max(map(len, self.rank), default=0)

    def __call__(self, value: str) -> float:
        n, low = len(value), value.lower()
        plain = low.translate(_LEET)
        pool = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)
        each, join = math.log10(max(pool, 10)), math.log10(2)
        dates: dict[int, list[int]] = {}
        for i in range(n):
            if low[i].isdigit():
                for date in DATES:
                    if m := date.match(low, i):
                        dates.setdefault(m.end(), []).append(i)
        best = [0.0] + [math.inf] * n
        repeats, walks = _Spans(best, 3), _Spans(best, 4)
        for j in range(1, n + 1):
            if j > 1 and value[j - 1] != value[j - 2]:
                repeats.begin(j - 1)
            if j > 1 and low[j - 2 : j] not in _NEXT:
                walks.begin(j - 1)
            cost = best[j - 1] + each  # brute force
            for i in range(max(0, j - self.longest), j - 2):
                r = self.rank.get(low[i:j])
                if r:
                    cost = min(cost, best[i] + math.log10(r + 1) + join * (value[i:j] != low[i:j]) + join)
                elif r := self.rank.get(plain[i:j]):
                    cost = min(cost, best[i] + math.log10(r + 1) + 3 * join)
            for i in dates.get(j, ()):
                cost = min(cost, best[i] + math.log10(366 * 200 if j - i > 4 else 200) + join)
            cost = min(cost, repeats.least(j) + math.log10(pool) + join, walks.least(j) + math.log10(4 * 47) + join)
            best[j] = cost
        return best[n]


class _Spans:
    """The least best[i] + log10(j - i) over the starts i, ``size`` or more before j, since the run that holds j began.

    A start that is no better than an earlier one when it can first be used never is later, as the ratio of
    their lengths only falls; so few starts are kept, however long the run.
    """

    def __init__(self, best: list[float], size: int):
        self.best, self.size, self.starts, self.first = best, size, [], 0

    def begin(self, first: int) -> None:
        self.starts, self.first = [], first

    def least(self, j: int) -> float:
        out = min((self.best[i] + math.log10(j - i) for i in self.starts), default=math.inf)
        i = j - self.size
        if i >= self.first and self.best[i] + math.log10(self.size) < out:
            self.starts.append(i)
            out = self.best[i] + math.log10(self.size)
        return out


class Scanner:
    """Spans of secrets in a text, in code points with exclusive ends."""

    def __init__(self, words: tuple[str, ...] = COMMON, threshold: float = 10.0):
        self.cost, self.threshold = GuessCost(words), threshold

    def __call__(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """(start, kind, end) of all spans in order, and the ranges that hold the secrets themselves."""
        spans, values = [], []
        low = text.lower()
        if any(h in low for h in HINTS):
            for m in ASSIGN.finditer(text):
                if m.end(2) - m.start(2) >= 6:
                    spans.append((m.start(), 0, m.end()))
                    values.append(m.span(2))
            covered = [(s, e) for s, _, e in spans]
            at = 0
            for m in CONTEXT.finditer(text):
                s, e = m.span(1)
                while at < len(covered) and covered[at][1] <= s:
                    at += 1
                inside = at < len(covered) and covered[at][0] <= s and e <= covered[at][1]
                if not inside and self.cost(m[1]) >= self.threshold:
                    spans.append((s, 3, e))
                    values.append((s, e))
        if "AKIA" in text:
            for m in ACCESS.finditer(text):
                if m.end() - m.start() >= 20:
                    spans.append((m.start(), 1, m.end()))
                    values.append(m.span())
        for m in HEX.finditer(text):
            spans.append((m.start(), 2, m.end()))
            values.append(m.span())
        spans.sort()
        return spans, sorted(values)

    def redact(self, text: str, mark: str = "[secret]") -> str:
        """text with each secret value replaced; overlapping ones by one mark."""
        out, end = [], 0
        for s, e in self(text)[1]:
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return text if not out else "".join(out) + text[end:]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: tuple[str, ...] = COMMON, threshold: float = 10.0) -> DataFrame:
    """Secrets in every whole text.

    Returns id_col, n_assign, n_access, n_hex, n_guess, base_sha256 and spans. The span of an
    assignment is its whole match. A guess span is a value in a credential context that takes
    10**threshold guesses or more and lies in no assignment. A null text counts as empty: no spans.
    Null ids and repeated rows stay, a row each; other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"

    @tidy
    def run(batches):
        scanner = Scanner(words, threshold)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = scanner(text.as_py() or "")[0]
                kinds = [k for _, k, _ in spans]
                base = joined([x for x in spans if x[1] < 3])
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redacted(text: Column, words: tuple[str, ...] = COMMON, threshold: float = 10.0) -> Column:
    """text with its secrets replaced by a mark; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        scanner = Scanner(words, threshold)
        return texts.map(lambda t: None if t is None else scanner.redact(t))

    return run(text)
