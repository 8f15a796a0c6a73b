"""Language ID by mixture inference: expectation-maximisation over n-gram likelihoods of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy
from tessera.llm.textkit import SLICE_BYTES, Words, slices, text_buffers

CODES = 1 << 16
ROUNDS = 12
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (also of U+00C0 to U+00DE), other ASCII as a space."""
    out = _FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[up] += 0x20
    return out


def trigram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of the three bytes round each byte, which bytes lie in words, and the folded bytes.

    Rows are apart: beyond an edge of a row stands a space.
    """
    low = folded(data)
    before = np.full(len(low), 0x20, dtype=np.uint32)
    after = np.full(len(low), 0x20, dtype=np.uint32)
    before[1:] = low[:-1]
    after[:-1] = low[1:]
    full = np.diff(offsets) > 0
    before[offsets[:-1][full]] = 0x20
    after[offsets[1:][full] - 1] = 0x20
    code = (((before << 16) | (low.astype(np.uint32) << 8) | after) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return code, low != 0x20, low


def counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, code, n: the n-grams of each language over all rows; rows with a null text or language are left out."""

    @tidy
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            langs = batch.column(1).to_pylist()
            for i, j in slices(offsets):
                code, inside, _ = trigram_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row = np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))
                names = sorted(set(langs[i:j]))
                which = np.array([names.index(x) for x in langs[i:j]])[row - i] if len(row) else row
                for k, name in enumerate(names):
                    total.setdefault(name, np.zeros(CODES, np.int64))
                    total[name] += np.bincount(code[inside & (which == k)], minlength=CODES)
        for name, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "code", "n"])

    found = docs.select(text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    return found.mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class MixtureModel:
    """log P(n-gram | language) for a list of languages; the driver holds len(langs) * CODES numbers."""

    def __init__(self, table: pd.DataFrame, smoothing: float = 0.5):
        self.langs = sorted(table["lang"].unique().tolist())
        n = np.zeros((len(self.langs), CODES))
        n[np.searchsorted(self.langs, table["lang"]), table["code"].to_numpy()] = table["n"]
        self.log = np.log((n + smoothing) / (n.sum(axis=1, keepdims=True) + smoothing * CODES)).astype(np.float32).T.copy() if self.langs else None

    def _em(self, odds: np.ndarray, base: np.ndarray, first: np.ndarray, row: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (documents x languages) and log-likelihoods; odds: each word's likelihoods over its best."""
        size = np.diff(np.append(first, len(row)))[:, None]
        weight = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            share = odds * weight[row]
            share /= share.sum(axis=1, keepdims=True) + np.float32(1e-30)
            weight = (np.add.reduceat(share, first, axis=0) / size).astype(np.float32)
        like = np.log((odds * weight[row]).sum(axis=1) + np.float32(1e-30)).astype(np.float64) + base
        return weight, np.add.reduceat(like, first)

    def infer(self, data: np.ndarray, offsets: np.ndarray, blanks: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Which rows have words, their proportions of each language, zero outside the chosen set, and the share of ``blanks`` that is explained.

        Each word is of one language; EM gives the proportions. From the full set the least language
        goes as long as that raises the likelihood less half a log of the words for each language.
        The proportions add up to 1 whatever the text is. So each word of ``blanks``, the words between blanks
        of the same rows, is held against no language, where all n-grams are alike: it is explained if
        its letters are likelier in a language of the set. Numbers are not; signs alone are no words.
        """
        code, inside, _ = trigram_codes(data, offsets)
        edge = np.empty(len(inside) + 1, dtype=bool)
        edge[0], edge[-1] = True, True
        edge[1:-1] = ~inside[:-1]
        edge[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(inside & edge[:-1])
        row = np.searchsorted(offsets, start, side="right") - 1
        if not len(start):
            return np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32), np.zeros(0)
        score = self.log[code[inside]]
        place = np.cumsum(inside)[start] - 1
        score = np.add.reduceat(score, place, axis=0)
        best = score.max(axis=1, keepdims=True)
        odds = np.exp(score - best)
        base = best[:, 0].astype(np.float64)
        docs, first, size = np.unique(row, return_index=True, return_counts=True)
        dense = np.repeat(np.arange(len(docs)), size)
        allowed = np.ones((len(docs), len(self.langs)), dtype=np.float32)
        weight, like = self._em(odds, base, first, dense, allowed)
        price = 0.5 * np.log(np.maximum(size, 2))
        open_ = np.arange(len(docs))
        for left in range(len(self.langs) - 1, 0, -1):
            if not len(open_):
                break
            fewer = allowed[open_].copy()
            small = np.where(fewer > 0, weight[open_], np.inf).argmin(axis=1)
            fewer[np.arange(len(open_)), small] = 0
            if left == 1:  # one language is left: nothing to iterate
                only = fewer.argmax(axis=1)
                trial = fewer
                words, starts, again = self._words(first, size, open_)
                value = np.add.reduceat(np.log(odds[words, only[again]] + np.float32(1e-30)).astype(np.float64) + base[words], starts)
            else:
                words, starts, again = self._words(first, size, open_)
                trial, value = self._em(odds[words], base[words], starts, again, fewer)
            better = value + price[open_] >= like[open_]
            at = open_[better]
            allowed[at], weight[at], like[at] = fewer[better], trial[better], value[better]
            open_ = at
        if blanks is None:
            return docs, weight, None
        gain = score + (np.diff(np.append(place, inside.sum())) * np.log(CODES)).astype(np.float32)[:, None]
        word = np.searchsorted(blanks.start, start, side="right")
        head = np.flatnonzero(np.diff(word, prepend=0))
        gain = np.where(allowed[dense[head]] > 0, np.add.reduceat(gain, head, axis=0), -np.inf).max(axis=1)
        real = np.logical_or.reduceat(inside | ((data >= 48) & (data <= 57)), blanks.start)
        return docs, weight, np.bincount(dense[head], gain > 0) / np.bincount(blanks.row[real])[docs]

    @staticmethod
    def _words(first: np.ndarray, size: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = size[docs]
        starts = np.cumsum(n) - n
        words = np.arange(n.sum()) - np.repeat(starts - first[docs], n)
        return words, starts, np.repeat(np.arange(len(docs)), n)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> MixtureModel:
    """A model from all rows of docs that have a text and a language; what is collected is bounded by languages x CODES."""
    return MixtureModel(counts(docs, text_col, lang_col).toPandas())


def _judged(model: MixtureModel, column: pa.Array, explain: bool = False) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Language, score, language set and, with ``explain``, the share of words that a language of that set explains, for each text."""
    data, offsets = text_buffers(column)
    pred, score, sets, whole = ["und"] * len(column), np.zeros(len(column)), [""] * len(column), np.zeros(len(column))
    limit = max(1 << 16, 4 * SLICE_BYTES // max(4, len(model.langs)))  # a number for each byte and language
    for i, j in slices(offsets, limit) if model.langs else ():
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part])])
        plain = letters[at[1:]] > letters[at[:-1]]
        blanks = Words(data, offsets, i, j) if explain else None
        rows, weight, share = model.infer(part, at, blanks)
        if explain:
            whole[i + rows] = share
        order = np.argsort(-weight, axis=1, kind="stable")
        for r, w, o in zip(rows.tolist(), weight.tolist(), order.tolist(), strict=True):
            if plain[r] or any(c.isalpha() for c in bytes(part[at[r] : at[r + 1]]).decode()):
                pred[i + r], score[i + r] = model.langs[o[0]], min(1.0, w[o[0]])
                sets[i + r] = ",".join(f"{model.langs[k]}:{w[k]:.4f}" for k in o if w[k] > 0)
    return pred, score, sets, whole


def identify(docs: DataFrame, model: MixtureModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score and languages of every whole text.

    lang_pred is the language of the largest proportion, score that proportion, languages the chosen
    set as name:proportion, largest first (ties by name). A text that is null, empty or without any
    letter is ``und`` with score 0 and no languages, and so is every text if the model knows no
    language. Null ids and repeated rows stay, a row each; other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        for batch in batches:
            pred, score, sets, _ = _judged(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=[id_col, "lang_pred", "score", "languages"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, languages string")


def keep(docs: DataFrame, model: MixtureModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has languages: those of its chosen set explain a share of ``least`` or more of the words between blanks.

    However many languages a text has, it stays; what goes is ``und``, or has more words that no chosen
    language explains (``MixtureModel.infer``): numbers, keys, noise, scripts and languages not learnt.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            pred, _, _, whole = _judged(shared.value, batch.column(place), explain=True)
            yield batch.filter(pa.array([p != "und" and w >= least for p, w in zip(pred, whole.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_: Column) -> Column:
    """Whether a document's text and language are kept from training: crc32 of its id as text mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))
