"""Encoding a corpus with a byte-level BPE tokenizer: speculate, verify, repair.

Texts are cut into words by the tokenizer's pattern; each distinct word of an Arrow
batch is encoded once. A greedy longest match, run over all byte positions of the
batch at once, proposes tokens. A sequence of tokens is the tokenizer's own exactly
when every two neighbours are (each pair would survive if it stood alone), so all
adjacent pairs are tested with vectorised look-ups in the merge history, and only
words with a failing pair are merged exactly, rule by rule. Narrow: no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.functions.batches import slices

# Fixed value: how the tokenizer cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Words longer than this many bytes are worked on by themselves, so that a batch stays small.
CHUNK_BYTES = 8_000_000


class Encoder:
    """Tables of one vocabulary. ids are ranks: a token with a smaller id was merged earlier."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.words = regex.compile(pattern).findall
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Trie: the first two bytes by a dense table, deeper ones by a hash of (node, byte).
        nodes: dict[bytes, int] = {b"": 0}
        for token in ranks:
            for k in range(1, len(token) + 1):
                nodes.setdefault(token[:k], len(nodes))
        self.token = np.full(len(nodes), -1, np.int32)
        for token, r in ranks.items():
            self.token[nodes[token]] = r
        self.second = np.zeros(65536, np.int32)
        deep: dict[int, int] = {}
        for prefix, node in nodes.items():
            if len(prefix) == 2:
                self.second[prefix[0] * 256 + prefix[1]] = node
            elif len(prefix) > 2:
                deep[nodes[prefix[:-1]] * 256 + prefix[-1]] = node
        self.edge = _Hash(np.fromiter(deep, np.int64, len(deep)), np.fromiter(deep.values(), np.int64, len(deep)))
        self.longest = max(map(len, ranks))
        self.length = np.zeros(size, np.int32)
        for token, r in ranks.items():
            self.length[r] = len(token)
        # The merge that made each token; single bytes are made of themselves.
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.merge: dict[tuple[int, int], int] = {}
        for token, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged([ranks[token[i : i + 1]] for i in range(len(token))], r)
                if len(parts) == 2:
                    self.left[r], self.right[r] = parts
                    self.merge[parts[0], parts[1]] = r
        keys = np.fromiter((a << 20 | b for a, b in self.merge), np.int64, len(self.merge))
        self.pair = _Hash(keys, np.fromiter(self.merge.values(), np.int64, len(self.merge)))
        self.repaired = 0

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)})

    def _merged(self, ids: list[int], below: int | None = None) -> list[int]:
        """Exact merging: the pair with the smallest rank first, the leftmost among equals."""
        merge, none = self.merge, 1 << 40
        ranks = [merge.get(p, none) for p in zip(ids, ids[1:])]
        limit = none if below is None else below
        while ranks:
            r = min(ranks)
            if r >= limit:
                break
            i = ranks.index(r)
            ids[i : i + 2] = [r]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = merge.get((r, ids[i + 1]), none)
            if i:
                ranks[i - 1] = merge.get((ids[i - 1], r), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """Exact merging of a long word with a heap over a linked list."""
        import heapq

        n, merge = len(ids), self.merge
        nxt, prv, live = list(range(1, n)) + [-1], list(range(-1, n - 1)), list(ids)
        heap = [(r, i) for i in range(n - 1) if (r := merge.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if live[i] >= 0 else -1
            if j < 0 or merge.get((live[i], live[j])) != r:
                continue
            live[i], live[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (q := merge.get((r, live[nxt[i]]))) is not None:
                    heapq.heappush(heap, (q, i))
            if prv[i] >= 0 and (q := merge.get((live[prv[i]], r))) is not None:
                heapq.heappush(heap, (q, prv[i]))
        return [t for t in live if t >= 0]

    def exact(self, word: bytes) -> list[int]:
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        return self._merged(ids) if len(ids) < 200 else self._merged_long(ids)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether they stay apart when their bytes are merged from scratch.

        The boundary is followed back through the merges of both tokens, the later one
        first; a merge across it that came earlier than what followed would have won.
        """
        n = len(a)
        ok = np.ones(n, bool)
        at, x, y, limit = np.arange(n), a.astype(np.int64), b.astype(np.int64), np.full(n, 1 << 40, np.int64)
        while len(at):
            joined = self.pair.get(x << 20 | y)
            lost = (joined >= 0) & (joined < limit)
            ok[at[lost]] = False
            go = ~lost
            at, x, y, limit = at[go], x[go], y[go], limit[go]
            whole_x, whole_y = self.right[x] == x, self.left[y] == y
            go = ~(whole_x & whole_y)
            at, x, y, limit, whole_x, whole_y = at[go], x[go], y[go], limit[go], whole_x[go], whole_y[go]
            open_x = ~whole_x & ((x > y) | whole_y)
            limit = np.where(open_x, x, y + 1)
            x, y = np.where(open_x, self.right[x], x), np.where(open_x, y, self.left[y])
        return ok

    def greedy(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from each word's start to its end: tokens, and the word each belongs to."""
        n, total = len(begin), len(data)
        size = np.repeat(end - begin, end - begin) - (np.arange(total) - np.repeat(begin, end - begin))  # bytes left in the word
        best, step = self.base[data], np.ones(total, np.int32)
        at = np.flatnonzero(size >= 2)
        node = self.second[data[at].astype(np.int32) * 256 + data[at + 1]]
        depth = 2
        while True:
            go = node > 0
            at, node = at[go], node[go]
            if not len(at):
                break
            token = self.token[node]
            hit = token >= 0
            best[at[hit]], step[at[hit]] = token[hit], depth
            go = size[at] > depth
            at, node = at[go], node[go]
            node = np.maximum(self.edge.get(node.astype(np.int64) * 256 + data[at + depth]), 0)
            depth += 1
        # Follow the steps from all word starts at once.
        marks = np.zeros(total, bool)
        word, pos = np.arange(n)[end > begin], begin[end > begin]
        stop = end[word]
        while len(pos) > 64:
            marks[pos] = True
            pos = pos + step[pos]
            go = pos < stop
            pos, stop = pos[go], stop[go]
        if len(pos):
            steps = step
            for p, e in zip(pos.tolist(), stop.tolist()):
                seen = []
                while p < e:
                    seen.append(p)
                    p += int(steps[p])
                marks[seen] = True
        where = np.flatnonzero(marks)
        return best[where], np.searchsorted(end, where, "right")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, in order, and the offsets of each word's tokens."""
        ids, counts = [], []
        lo = 0
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        while lo < len(words):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, "right")))
            a, b = self._encode_chunk(words[lo:hi], sizes[lo:hi])
            ids.append(a)
            counts.append(b)
            lo = hi
        if not ids:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def _encode_chunk(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(sizes)
        ids, owner = self.greedy(data, end - sizes, end)
        same = owner[1:] == owner[:-1]
        left = np.flatnonzero(same)
        key = ids[left].astype(np.int64) << 20 | ids[left + 1]
        code, distinct = pd.factorize(key)
        fine = self.compatible(distinct >> 20, distinct & 0xFFFFF)
        failing = np.unique(owner[left[~fine[code]]])
        counts = np.bincount(owner, minlength=len(words))
        if not len(failing):
            return ids, counts
        self.repaired += len(failing)
        fixed = [self.exact(words[w]) for w in failing.tolist()]
        keep = np.ones(len(words), bool)
        keep[failing] = False
        counts[failing] = [len(f) for f in fixed]
        out = np.empty(counts.sum(), np.int32)
        fill = np.repeat(keep, counts)
        out[fill] = ids[keep[owner]]
        out[~fill] = np.fromiter((t for f in fixed for t in f), np.int32, sum(map(len, fixed)))
        return out, counts

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, in order, and the offsets of each text's ids. Null and '' have none."""
        number: dict[str, int] = {}
        seq: list[int] = []
        lengths = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = self.words(t)
                lengths[i] = len(found)
                seq.extend([number.setdefault(w, len(number)) for w in found])
        ids, offsets = self.encode_words([w.encode("utf-8") for w in number])
        order = np.array(seq, np.int64)
        size = np.diff(offsets)[order]
        starts = np.cumsum(size) - size
        flat = ids[np.repeat(offsets[:-1][order] - starts, size) + np.arange(size.sum())] if len(order) else np.zeros(0, np.int32)
        word_ends = np.concatenate(([0], np.cumsum(size)))
        return flat, word_ends[np.concatenate(([0], np.cumsum(lengths)))]


class _Hash:
    """Open addressing over int64 keys; look-ups of whole arrays. Missing keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.mask, self.shift = np.int64((1 << bits) - 1), np.int64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            at = np.flatnonzero(free)
            first[at[np.unique(slot[at], return_index=True)[1]]] = True
            self.keys[slot[first]], self.values[slot[first]] = keys[todo[first]], values[todo[first]]
            todo, slot = todo[~first], (slot[~first] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        seen = self.keys[slot]
        hit = seen == keys
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero(~hit & (seen >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            seen = self.keys[slot[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    """The vocabulary file of byte_bpe_50k among the public tokenizers installed."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _encoder(name: str, content: dict[bytes, int]) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(content)
    return _ENCODERS[name]


def encode(df: DataFrame, column: str = "text", out: str = "ids", vocabulary: str | None = None, count_only: bool = False) -> DataFrame:
    """``df`` without ``column`` and with its token ids in ``out`` (array of int, no special tokens).

    Null and empty texts have an empty list. ``count_only`` gives the number of tokens
    (int) instead. The vocabulary (about 1 MB, fixed) is read on the driver and
    broadcast. Whole texts; repeated rows stay; a column named like the output is
    replaced.
    """
    path = vocabulary or default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    keep = [c for c in df.columns if c not in (out, column)]
    kind = T.IntegerType() if count_only else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, kind, False)])
    data = df.select(*keep, F.col(column).cast("string").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, shared.value)
        for batch in slices(batches):
            flat, offsets = enc.encode_batch(batch.column(batch.num_columns - 1).to_pylist())
            if count_only:
                col = pa.array(np.diff(offsets).astype(np.int32))
            else:
                col = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], col], names=[*keep, out])

    return data.mapInArrow(work, schema)


def decode(df: DataFrame, column: str = "ids", out: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``df`` without ``column`` and with the text that its token ids stand for in ``out``; null ids give null.

    The bytes of the tokens are taken from the vocabulary as one Arrow array and cut at the rows' ends.
    """
    path = vocabulary or default_vocabulary()
    tokens = sorted((int(b), base64.b64decode(a)) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x))
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    keep = [c for c in df.columns if c not in (out, column)]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, T.StringType())])
    data = df.select(*keep, F.col(column).cast("array<int>").alias("__ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, words = zip(*shared.value)
        table = pa.array(words, pa.large_binary())
        at = np.full(max(numbers) + 1, -1, np.int64)
        at[list(numbers)] = np.arange(len(numbers))
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            ends = np.cumsum(np.concatenate(([0], np.asarray(pc.fill_null(pc.list_value_length(ids), 0)))))
            taken = table.take(pa.array(at[np.asarray(ids.flatten())]))
            offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
            texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets[ends].tobytes()), taken.buffers()[2] if len(taken) else pa.py_buffer(b""))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.if_else(ids.is_valid(), texts, None).cast(pa.string())], names=[*keep, out])

    return data.mapInArrow(work, schema)
