"""Quality rules: base counts, and lines marked content or boilerplate by a linear-chain CRF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy
from tessera.llm.textkit import Words, mix, ngram_hashes, prefix_hashes, slices, span_hash, text_buffers

SYMBOLS = b"#*$%&|<>"
#: Line features say which of these bounds a share or a size is over; the last ones where a line stands.
SHARES = (0.02, 0.06, 0.12, 0.25, 0.5)
SIZES = (1, 4, 12, 40)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1  # upper case
_CLASS[97:123] = 2  # lower case
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[list(SYMBOLS)] = 4
_CLASS[list(b"!?;:@=_~^/\\{}[]()\"+`")] = 5
_CLASS[list(b".,'-")] = 6
N_FEATURES = 1 + len(SIZES) + 5 * len(SHARES) + 4 + 2


class Lines:
    """The lines with a word of a slice: bounds, row, words, hash and features."""

    def __init__(self, words: Words):
        data, offsets = words.data, words.offsets
        breaks = np.flatnonzero(data == 10)
        start = np.concatenate([offsets[:-1], breaks + 1])
        start.sort(kind="stable")
        row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
        row = np.sort(np.concatenate([np.arange(words.rows), row_of_break]), kind="stable")
        last = np.append(row[1:] != row[:-1], True)
        end = np.where(last, offsets[row + 1], np.append(start[1:], 0) - 1)
        first = np.searchsorted(words.start, start)
        count = np.searchsorted(words.start, end) - first
        some = count > 0
        self.start, self.end, self.row, self.n_words = start[some], end[some], row[some], count[some]
        self.hash = span_hash(prefix_hashes(data), self.start, self.end)
        # equal to an earlier line of the same row: all but the first of each hash in a row
        order = np.lexsort((np.arange(len(self.row)), self.hash, self.row))
        again = np.zeros(len(order), dtype=bool)
        if len(order):
            again[order[1:]] = (self.hash[order[1:]] == self.hash[order[:-1]]) & (self.row[order[1:]] == self.row[order[:-1]])
        self.again = again
        kinds = _CLASS[data]
        size = np.maximum(self.end - self.start, 1)
        share = []
        for k in (1, 3, 4, 5, 6):
            total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
            share.append((total[self.end] - total[self.start]) / size)
        hashes = words.hashes()
        repeated = _repeated_words(words, hashes)
        doubled = np.zeros(len(hashes), dtype=bool)
        doubled[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
        at = np.searchsorted(words.start, self.start)

        def of_words(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag)])
            return (total[at + self.n_words] - total[at]) / np.maximum(self.n_words, 1)

        self.word_repeats = repeated
        edge = np.append(True, self.row[1:] != self.row[:-1])[: len(self.row)]
        features = [np.ones(len(self.row)), *(self.n_words > b for b in SIZES), *(s > b for s in share for b in SHARES)]
        features += [again, of_words(repeated) > 0.5, of_words(doubled) > 0.25, size / self.n_words > 14, edge, np.append(edge[1:], True)[: len(edge)]]
        self.x = np.column_stack(features).astype(np.float32)


def _repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Which words lie in a window of five words that the row has twice or more."""
    windows, first = ngram_hashes(hashes, words.row, 5)
    out = np.zeros(len(words.row) + 1, dtype=np.int64)
    if len(windows):
        keys = windows ^ mix(words.row[first].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = first[twice]
        np.add.at(out, at, 1)
        np.add.at(out, at + 5, -1)
    return np.cumsum(out[:-1]) > 0


class LineCrf:
    """A linear chain over lines with states boilerplate (0) and content (1)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> LineCrf:
        """Maximum likelihood by Adam, gradients by forward-backward over all chains at once."""
        emit, move = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
        if not len(x):
            emit[0, 1] = 1.0  # nothing to learn from: all lines are content
            return cls(emit, move)
        # longest chains first, line by line of all chains: step t is rows at[t] to at[t + 1], of the chains with over t lines
        order = np.argsort(-sizes, kind="stable")
        begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        at = np.concatenate([[0], np.cumsum(live)])
        wide = len(live)
        place = np.concatenate([begin[:k] + t for t, k in enumerate(live)])
        x, y = x[place], y[place]
        after = np.arange(at[1], len(x))  # lines with one before, and that one
        before = after - np.repeat(live[:-1], live[1:])
        last = at[length - 1] + np.arange(len(length))
        chain = np.concatenate([np.arange(k) for k in live])
        target = np.eye(2)[y]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[before], y[after]), 1)
        m, v, step = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)], 0
        for _ in range(rounds):
            score = x @ emit
            forward, backward = score.copy(), np.zeros_like(score)
            for t in range(1, wide):
                come = forward[at[t - 1] : at[t - 1] + live[t]]
                forward[at[t] : at[t + 1]] += np.logaddexp(come[:, :1] + move[0], come[:, 1:] + move[1])
            for t in range(wide - 2, -1, -1):
                ahead = score[at[t + 1] : at[t + 2]] + backward[at[t + 1] : at[t + 2]]
                backward[at[t] : at[t] + live[t + 1]] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            total = np.logaddexp(forward[last, 0], forward[last, 1])[chain]
            alone = np.exp(forward + backward - total[:, None])
            grad_emit = x.T @ (alone - target) / len(x) + decay * emit
            both = forward[before][:, :, None] + move + (score + backward)[after][:, None, :] - total[after][:, None, None]
            grad_move = (np.exp(both).sum(axis=0) - seen) / len(x) + decay * move
            step += 1
            for k, (p, g) in enumerate(((emit, grad_emit), (move, grad_move))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return cls(emit, move)

    def viterbi(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The likeliest state of every line; a tie is content."""
        out = np.zeros(len(x), dtype=np.int8)
        if not len(x):
            return out
        score = x @ self.emit
        order = np.argsort(-sizes, kind="stable")
        begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        wide = int(length[0])
        live = np.searchsorted(-length, -np.arange(wide), side="left")  # chains with over t lines come first
        back: list[np.ndarray] = []
        state = score[begin]
        for t in range(1, wide):
            k = live[t]
            paths = state[:k, :, None] + self.move  # from, to
            come = (paths[:, 1] >= paths[:, 0]).astype(np.int8)
            state[:k] = np.maximum(paths[:, 0], paths[:, 1]) + score[begin[:k] + t]
            back.append(come)
        now = (state[:, 1] >= state[:, 0]).astype(np.int8)
        for t in range(wide - 1, -1, -1):
            k = live[t]
            out[begin[:k] + t] = now[:k]
            if t:
                now[:k] = back[t - 1][np.arange(k), now[:k]]
        return out


def _slices(column):
    data, offsets = text_buffers(column)
    for i, j in slices(offsets):
        words = Words(data, offsets, i, j)
        yield i, j, words, Lines(words)


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineCrf:
    """Fit a CRF on at most ``sample`` labelled documents, those whose ids have the least hashes,
    and on all lines of each.

    Labels are of documents. Lines of good documents count as content, lines of bad ones as
    boilerplate; then lines of bad documents that a first model takes for content count as such, and
    the model is fitted again. Rows without a text or a label are left out; of several texts of one id
    that of the least hash counts, and the least of several labels.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = chosen.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull()).join(F.broadcast(chosen), "_id")
    first = F.min_by("_t", F.struct(F.md5("_t"), "_t"))  # one text an id, whatever the order of the rows
    rows = rows.groupBy("_id", "_y").agg(first.alias("_t"))

    @tidy
    def run(batches):
        for batch in batches:
            ys = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, words, lines in _slices(batch.column(1)):
                for r in range(j - i):
                    mine = np.flatnonzero(lines.row == r)
                    if len(mine):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + r, 1), pa.array([int(ys[i + r])], pa.int32()), pa.array([lines.x[mine].astype(np.uint8).tobytes()], pa.binary())], names=["_id", "_y", "_x"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select("_id", "_t", "_y").mapInArrow(run, f"_id {kind}, _y int, _x binary").toPandas().sort_values("_id", kind="stable")
    if found.empty:
        return LineCrf.fit(np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros(0, int))
    chains = [np.frombuffer(x, np.uint8).reshape(-1, N_FEATURES) for x in found["_x"]]
    sizes = np.array([len(c) for c in chains])
    x, good = np.concatenate(chains).astype(np.float64), np.repeat(found["_y"].to_numpy() > 0, sizes)
    first = LineCrf.fit(x, good.astype(int), sizes)
    relabelled = np.where(good, 1, (x @ (first.emit[:, 1] - first.emit[:, 0]) > 2.0).astype(int))
    return LineCrf.fit(x, relabelled, sizes)


def judge(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5) -> DataFrame:
    """Counts and verdict for every whole text.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    content_share (words in content lines over all words, 0 without words). base_failed: fewer than 10
    words, or over a fifth of them in repeated five-word windows. kept: not base_failed, and content
    has a share of ``least_share`` or more. A null or empty text has no words and fails. Null ids and
    repeated rows stay, a row each; other columns are not carried.
    """
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True

    @tidy
    def run(batches):
        for batch in batches:
            for i, j, words, lines in _slices(batch.column(1)):
                at, rows = words.offsets, j - i
                total = lambda mask: (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))
                n = words.counts.astype(np.int64)
                chars = total(words.inside & ((words.data & 0xC0) != 0x80))
                dup = np.bincount(lines.row[lines.again], minlength=rows).astype(np.int64)
                repeat = np.bincount(words.row[lines.word_repeats], minlength=rows).astype(np.int64)
                chains, sizes = np.unique(lines.row, return_counts=True)
                state = model.viterbi(lines.x, sizes)
                share = np.bincount(lines.row, weights=lines.n_words * state, minlength=rows) / np.maximum(n, 1)
                failed = (n < 10) | (100 * repeat > 20 * n)
                columns = [n, chars, total(symbol[words.data]), dup, repeat, failed, ~failed & (share >= least_share), share]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), *map(pa.array, columns)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
