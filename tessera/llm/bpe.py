"""BPE encoding and decoding with a contiguous rank array.

Each short word holds its parts and the ranks of adjacent parts in one row of two small arrays; a
step scans the row for the least rank, joins that pair, deletes the boundary by moving the rest one
place left, and refreshes the two ranks beside it. Rows of many words step together. Words of over
``SHORT`` bytes, for which scanning again and again is quadratic, keep the ranks in a heap instead;
both give the same parts, since ties go to the leftmost pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import tidy

SHORT = 128
CACHE = 300_000
_NONE = np.int32(2**31 - 1)
#: White space as Unicode has it, for all versions in use.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space and the run of other characters after it, or white space: no word of WORDS crosses such a unit.
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PURE = re.compile(rb" ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+|'(?:s|t|re|ve|m|ll|d)")
#: Characters that are neither white space nor letters nor digits, and start no contraction.
TAIL = ".,!?;:%$#*&|"
WORDS = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class RankArrayBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, k in vocab.items():
            self.bytes_of[k] = bytes(letters[c] for c in word)
        for word, k in self.special.items():
            self.bytes_of[k] = word.encode()
        self.single = np.zeros(256, dtype=np.int32)
        for letter, b in letters.items():
            self.single[b] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self._table(keys, order)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        # if no merge joins two kinds of ASCII characters, units need not be split before merging
        self.apart = all(PURE.fullmatch(x) for x in (self.bytes_of[k] for k in self.merged.tolist()) if x.isascii())
        self.cache: dict[str, bytes] = {}

    def _table(self, keys: np.ndarray, order: np.ndarray) -> None:
        """An open-addressing table from pair to rank, for vectorised look-ups."""
        bits = 19
        while (1 << bits) < 8 * len(keys):
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << bits, _NONE, dtype=np.int32)
        self.probes = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._home(keys).tolist(), strict=True)):
            steps = 1
            while self.slot_key[at] != -1:
                at = (at + 1) & self.mask
                steps += 1
            self.slot_key[at], self.slot_rank[at] = key, rank
            self.probes = max(self.probes, steps)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of parts, or the largest value if it does not merge; a negative part is none."""
        keys = left.astype(np.int64) * self.width + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._home(keys)
        out = np.full(len(keys), _NONE, dtype=np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            have = self.slot_key[at]
            hit = have == keys[open_]
            out[open_[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (have != -1)
            if not go.any():
                break
            open_, at = open_[go], (at[go] + 1) & self.mask
        return out

    def _short(self, words: list[bytes]) -> list[bytes]:
        """Words of one length class: rows of parts and of adjacent ranks, all rows stepping together."""
        n, wide = len(words), max(map(len, words)) + 1
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        parts = np.full((n, wide), -1, dtype=np.int32)
        parts[row, col] = self.single[flat]
        near = np.full((n, wide), _NONE, dtype=np.int32)
        inner = col < size[row] - 1
        r, c = row[inner], col[inner]
        near[r, c] = self.ranks(parts[r, c], parts[r, c + 1])
        at = np.arange(n)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        columns = np.arange(wide)
        while len(at):
            best = near.argmin(axis=1)
            least = near[np.arange(len(at)), best]
            stop = least == _NONE
            if stop.any():
                done.append((at[stop], parts[stop]))
                go = ~stop
                at, parts, near, best, least = at[go], parts[go], near[go], best[go], least[go]
                if not len(at):
                    break
            lines = np.arange(len(at))
            # delete the boundary after ``best``: what stands right of it moves one place left
            right = columns[None, :] > best[:, None]
            np.copyto(parts[:, :-1], parts[:, 1:], where=right[:, :-1])
            np.copyto(near[:, :-1], near[:, 1:], where=right[:, :-1])
            parts[lines, best] = self.merged[least]
            near[lines, best] = self.ranks(parts[lines, best], parts[lines, np.minimum(best + 1, wide - 1)])
            left = np.flatnonzero(best > 0)
            near[left, best[left] - 1] = self.ranks(parts[left, best[left] - 1], parts[left, best[left]])
        out: list[bytes] = [b""] * n
        for where, rows in done:
            counts = (rows >= 0).sum(axis=1)
            packed = rows[rows >= 0].astype("<u4").tobytes()
            end = 0
            for k, c in zip(where.tolist(), (4 * counts).tolist(), strict=True):
                out[k] = packed[end : end + c]
                end += c
        return out

    def _long(self, word: bytes) -> bytes:
        """A long word: the same merges, the least rank from a heap."""
        parts = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank_of, width = self.rank_of, self.width
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of.get(parts[i] * width + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or parts[i] != a or (j := after[i]) >= n or parts[j] != b:
                continue
            parts[i], alive[j] = int(self.merged[r]), False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank_of.get(parts[x] * width + parts[y])) is not None:
                    heapq.heappush(heap, (q, x, parts[x], parts[y]))
        return np.array([p for p, ok in zip(parts, alive, strict=True) if ok], dtype="<u4").tobytes()

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of these words into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            n = len(raw)
            if n > SHORT:
                self.cache[w] = self._long(raw)
            else:
                by_size.setdefault(n // 4 if n < 32 else 64 if n < 64 else SHORT, []).append((w, raw))
        for group in by_size.values():
            for i in range(0, len(group), 8_000):
                some = group[i : i + 8_000]
                self.cache.update(zip([w for w, _ in some], self._short([raw for _, raw in some]), strict=True))

    def learn(self, units: set[str]) -> None:
        """Put the ids of these units into the cache."""
        cache = self.cache
        alone = [u for u in units if u.isascii() and "'" not in u] if self.apart else []
        rest = units.difference(alone) if alone else units
        split, missing = [], set()
        for u in rest:
            w = u.rstrip(TAIL)
            if w.isalpha() or w[:1] == " " and w[1:].isalpha():
                words = [w, u[len(w) :]] if len(w) < len(u) else [u]
            else:
                words = WORDS.findall(u)
            if len(words) == 1:
                alone.append(u)
            else:
                split.append((u, words))
                missing.update([x for x in words if x not in cache])
        missing.difference_update(alone)
        alone.extend(missing)
        self.encode_words(alone)
        cache.update([(u, b"".join([cache[x] for x in words])) for u, words in split])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        pending: list[list[str | bytes]] = []
        for text in texts:
            pieces = self.split_special.split(text) if self.split_special else [text]
            row: list = []
            for k, piece in enumerate(pieces):
                if k % 2:
                    row.append(np.uint32(self.special[piece]).astype("<u4").tobytes())
                elif piece:
                    row.append(UNITS.findall(piece))
            pending.append(row)
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        missing: set[str] = set()
        for row in pending:
            for x in row:
                if not isinstance(x, bytes):
                    missing.update(x)
        missing = {u for u in missing if u not in cache}
        if missing:
            self.learn(missing)
        for row in pending:
            out.append(b"".join([x if isinstance(x, bytes) else b"".join(map(cache.__getitem__, x)) for x in row]))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[k] for k in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, RankArrayBpe] = {}


def encoder(path: str) -> RankArrayBpe:
    """One encoder for each file and process."""
    if path not in _loaded:
        _loaded[path] = RankArrayBpe(path)
    return _loaded[path]


def text_groups(texts: list[str | None], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters; null counts as empty."""
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text, then decode the ids.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read. Returns id_col,
    n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, token_ids (little-endian unsigned 32-bit
    integers). A null text counts as empty (no tokens); null ids and repeated rows stay as they are,
    a row each; other columns are not carried; an empty table gives no rows.
    """
    more = ", token_ids binary" if ids else ""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"

    @tidy
    def run(batches):
        bpe = encoder(tokenizer)
        for batch in batches:
            at = 0
            for texts in text_groups_of(batch.column(1)):
                packed = bpe.encode_batch(texts)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in packed], pa.string()),
                ] + ([pa.array(packed, pa.binary())] if ids else [])
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def text_groups_of(column: pa.Array) -> Iterator[list[str]]:
    """text_groups over an Arrow column, without a list of the whole column."""
    for i in range(0, len(column), 256):
        yield from text_groups(column.slice(i, 256).to_pylist())


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The text of each row's token_ids; null ids give a null text."""

    @tidy
    def run(batches):
        bpe = encoder(tokenizer)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"{id_col} {tokens.schema[id_col].dataType.simpleString()}, text string")
