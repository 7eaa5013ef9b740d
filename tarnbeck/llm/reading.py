"""Reading level of each document, from boosted regression trees.

Labelled documents (a bounded sample; the bound is ``MAX_LABELLED``) give a lexicon
of token difficulty and a model; every document is then scored in the Arrow batches
it arrives in. The features are distributions over a document's whole text: lengths,
token difficulty and its spread over sentences, syntax marks, and cohesion between
neighbouring sentences. Predictions made for sources left out of training calibrate
the scale.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.functions.batches import slices
from tarnbeck.llm.bpe import _Hash
from tarnbeck.llm.unify_text import INVISIBLE, _points, _tables

#: Labelled documents that a model is fitted on; a larger set is sampled by the hash of its ids.
MAX_LABELLED = 12_000
#: Characters of text in that sample, as it is trained on in one process: documents are taken in the order of the hash as far as they fit.
MAX_LABELLED_CHARS = 100_000_000

# Words that tie sentences together.
CONNECTIVES = "因此 此外 然而 但是 由于 其中 同时 因为 所以 另外 从而 而且 并且 however therefore because although moreover which that when".split()
_BANDS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5)
_HAN, _WORD, _DIGIT, _END, _COMMA, _SEMI, _OPEN, _SPACE, _MARK = 1, 2, 3, 4, 5, 6, 7, 8, 9


def _classes() -> np.ndarray:
    if not hasattr(_classes, "table"):
        t = np.zeros(0x110000, np.uint8)
        t[0x3400:0xA000] = t[0x20000:0x32000] = t[0x3040:0x3100] = t[0xAC00:0xD7A4] = _HAN
        for cp in range(0x530):
            if chr(cp).isalpha():
                t[cp] = _WORD
        t[ord("0") : ord("9") + 1] = _DIGIT
        for group, kind in (("。!?！？…\n", _END), (",，、", _COMMA), (";；:：", _SEMI), ("(（[【“\"'《", _OPEN), (" \t", _SPACE), ("%‰/<>=±≤≥°μ×+-|", _MARK)):
            for c in group:
                t[ord(c)] = kind
        _classes.table = t
    return _classes.table


def _plain() -> tuple[np.ndarray, np.ndarray]:
    """Compatibility form in lower case of each code point that has a single one, and the characters that show nothing."""
    if not hasattr(_plain, "tables"):
        form = np.arange(0x110000, dtype=np.uint32)
        for lo, hi in ((0x41, 0x600), (0x1E00, 0x3400), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20)):
            for cp in range(lo, hi):
                c = unicodedata.normalize("NFKC", chr(cp)).lower()
                if len(c) == 1:
                    form[cp] = ord(c)
        _plain.tables = form, _tables().flag == INVISIBLE
    return _plain.tables


def _mix(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return (x & np.uint64(0x7FFFFFFFFFFFFFFF)).astype(np.int64)


@dataclass
class Parsed:
    """Tokens of a batch: key, sentence and document of each; characters by class."""

    n: int
    key: np.ndarray
    sentence: np.ndarray
    doc_of_sentence: np.ndarray
    chars: np.ndarray  # documents x classes
    sentence_chars: np.ndarray
    sentence_commas: np.ndarray

    def sorted_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Order that puts equal tokens of a document side by side, in text order, and whether each equals the one before."""
        cell = _mix(self.key ^ (self.doc_of_sentence[self.sentence].astype(np.int64) * 0x9E3779B1))
        order = np.argsort(cell, kind="stable")
        return order, np.diff(cell[order]) == 0


def parse(texts: list[str]) -> Parsed:
    """Han bigrams and words as 63-bit keys, vectorised over all texts."""
    n = len(texts)
    form, hidden = _plain()
    points = _points(pa.array([t.replace("\uffff", "") for t in texts], pa.string()))[0]
    points = form[points[~hidden[points]]]
    points = np.where(points == 0x0D, 10, points)
    owner = np.cumsum(points == 0xFFFF) - (points == 0xFFFF)
    end_doc = points == 0xFFFF
    kind = _classes()[np.where(end_doc, 0, points)]
    # A full stop ends a sentence before white space only.
    after = np.concatenate((kind[1:], [0]))
    kind = np.where((points == ord(".")) & ((after == _SPACE) | (after == _END)), _END, kind)
    stop = (kind == _END) | end_doc
    sentence = np.cumsum(stop) - stop
    n_sentences = int(stop.sum())
    doc_of_sentence = owner[np.flatnonzero(stop)] if n_sentences else np.zeros(0, np.int64)
    chars = np.bincount(owner * 16 + kind, minlength=n * 16).reshape(n, 16)
    chars[:, 0] -= 1  # the mark that ends each text
    han = kind == _HAN
    pair = np.flatnonzero(han[:-1] & han[1:])
    pair_key = _mix(points[pair].astype(np.int64) << 21 | points[pair + 1])
    word = kind == _WORD
    first = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    if len(first):
        at = np.flatnonzero(word)
        run = np.searchsorted(first, at, "right") - 1
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))[np.minimum(at - first[run], 63)]
            word_key = _mix(np.add.reduceat(points[at].astype(np.uint64) * power, np.searchsorted(at, first)))
    else:
        word_key = np.zeros(0, np.int64)
    where = np.concatenate((pair, first))
    order = np.argsort(where, kind="stable")
    key = np.concatenate((pair_key, word_key))[order]
    where = where[order]
    return Parsed(n, key, sentence[where], doc_of_sentence, chars, np.bincount(sentence, ~stop, n_sentences), np.bincount(sentence, kind == _COMMA, n_sentences))


def _quantiles(values: np.ndarray, group: np.ndarray, n: int, qs: tuple[float, ...], empty: float) -> np.ndarray:
    """Quantiles (lower) of ``values`` within each of ``n`` groups."""
    order = np.lexsort((values, group))
    v, count = values[order], np.bincount(group, minlength=n)
    start = np.cumsum(count) - count
    out = np.full((n, len(qs)), empty)
    full = count > 0
    for j, q in enumerate(qs):
        out[full, j] = v[(start + np.floor((count - 1) * q).astype(np.int64))[full]]
    return out


def _mean(values: np.ndarray, group: np.ndarray, n: int, empty: float) -> np.ndarray:
    count = np.bincount(group, minlength=n)
    return np.where(count > 0, np.bincount(group, values, n) / np.maximum(count, 1), empty)


def _connective_index() -> _Hash:
    if not hasattr(_connective_index, "hash"):
        keys = np.array(sorted(set(parse(CONNECTIVES).key.tolist())), np.int64)
        _connective_index.hash = _Hash(keys, np.arange(len(keys)))
    return _connective_index.hash


def features(p: Parsed, lexicon: Lexicon) -> np.ndarray:
    """One row of features for each document."""
    n, doc = p.n, p.doc_of_sentence[p.sentence]
    level = lexicon.difficulty(p.key)
    known = ~np.isnan(level)
    ns = len(p.doc_of_sentence)
    tokens = np.bincount(p.sentence, minlength=ns)
    real = tokens > 0
    sd = p.doc_of_sentence
    s_level = _mean(level[known], p.sentence[known], ns, lexicon.centre)
    scored = np.bincount(p.sentence[known], minlength=ns) > 0
    weight = tokens * scored
    total = np.maximum(np.bincount(sd, weight, n), 1)
    sentences = np.bincount(sd[real], minlength=n)
    size = np.maximum(p.chars.sum(axis=1), 1)
    cols = [
        # length
        np.log1p(size), np.log1p(sentences), _mean(p.sentence_chars[real], sd[real], n, 0.0),
        *_quantiles(p.sentence_chars[real], sd[real], n, (0.1, 0.25, 0.5, 0.75, 0.9, 1.0), 0.0).T,
        # vocabulary
        _mean(level[known], doc[known], n, lexicon.centre), *_quantiles(level[known], doc[known], n, (0.1, 0.25, 0.5, 0.75, 0.9), lexicon.centre).T,
        1 - _mean(known.astype(float), doc, n, 1.0),
        np.bincount(sd, weight * s_level, n) / total,
        *_quantiles(s_level[scored], sd[scored], n, (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0), lexicon.centre).T,
        *(np.bincount(sd, weight * (s_level > b), n) / total for b in _BANDS),
        *(_mean((s_level[scored] > b).astype(float), sd[scored], n, 0.0) for b in _BANDS),
        # syntax
        *(p.chars[:, k] / size for k in (_HAN, _WORD, _DIGIT, _COMMA, _SEMI, _OPEN, _MARK, _END)),
        _mean(p.sentence_commas[real], sd[real], n, 0.0), *_quantiles(p.sentence_commas[real], sd[real], n, (0.5, 0.9), 0.0).T,
    ]
    # types, cohesion: equal tokens of a document side by side, in text order
    order, same = p.sorted_tokens()
    gap = np.diff(p.sentence[order])
    cell = doc[order]
    new = np.concatenate(([True], ~same))[: len(order)]
    fresh = new | np.concatenate(([True], gap > 0))[: len(order)]  # first of its kind in its sentence
    follows = np.concatenate(([False], same & (gap == 1)))[: len(order)]
    cols.append(np.bincount(cell[new], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1))
    cols.append(_mean(follows[fresh].astype(float), cell[fresh], n, 0.0))
    cols.append(_mean((_connective_index().get(p.key) >= 0).astype(float), doc, n, 0.0))
    return np.column_stack(cols).astype(np.float32)


#: Tokens, the number of documents that hold each, and the sum of those documents' levels.
Stats = tuple[np.ndarray, np.ndarray, np.ndarray]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], totals: list[np.ndarray]) -> Stats:
    if not sum(map(len, keys)):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    key, count, total = np.concatenate(keys), np.concatenate(counts), np.concatenate(totals)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
    return key[first], np.add.reduceat(count[order], first), np.add.reduceat(total[order], first)


def token_stats(p: Parsed, level: np.ndarray) -> Stats:
    order, same = p.sorted_tokens()
    first = order[np.concatenate(([True], ~same))[: len(order)]]
    return _summed([p.key[first]], [np.ones(len(first))], [level[p.doc_of_sentence[p.sentence[first]]]])


@dataclass
class Lexicon:
    """Difficulty of tokens: the smoothed mean level of the documents that hold them."""

    keys: np.ndarray
    values: np.ndarray
    centre: float

    @classmethod
    def of(cls, stats: list[Stats], centre: float, prior: float = 2.0, least: int = 3) -> Lexicon:
        key, count, total = _summed([s[0] for s in stats], [s[1] for s in stats], [s[2] for s in stats])
        value = (total + prior * centre) / (count + prior)
        keep = np.flatnonzero(count >= least)
        return cls(key[keep], value[keep], centre)

    def difficulty(self, keys: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_index"):
            self._index = _Hash(self.keys, np.arange(len(self.keys)))
        at = self._index.get(keys)
        return np.where(at >= 0, np.append(self.values, np.nan)[at], np.nan)

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values, "centre": self.centre}


@dataclass
class Boosted:
    """Gradient-boosted regression trees on binned features, squared loss."""

    trees: int = 160
    depth: int = 4
    rate: float = 0.1
    bins: int = 48
    least: int = 8
    share: float = 0.6
    seed: int = 7
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value by heap position

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        self.base = float(y.mean())
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, n, f = self._binned(x), len(y), x.shape[1]
        width = self.bins + 1
        flat = b + np.arange(f) * width
        score = np.full(n, self.base)
        self.nodes = []
        for _ in range(self.trees):
            rows = np.flatnonzero(rng.random(n) < self.share)
            use = np.sort(rng.permutation(f)[: max(1, int(f * 0.5))])
            residual = y - score
            size = 2 ** (self.depth + 1)
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            node = np.ones(n, np.int64)
            value[1] = residual[rows].mean() if len(rows) else 0.0
            for level in range(self.depth):
                lo, k = 2**level, 2**level
                at = node[rows] - lo
                live = at >= 0
                r, at = rows[live], at[live]
                if not len(r):
                    break
                cell = (at[:, None] * (f * width) + flat[r][:, use]).ravel()
                count = np.bincount(cell, minlength=k * f * width).reshape(k, f, width)[:, use]
                total = np.bincount(cell, np.repeat(residual[r], len(use)), k * f * width).reshape(k, f, width)[:, use]
                cl, tl = count.cumsum(2)[:, :, :-1], total.cumsum(2)[:, :, :-1]
                ca, ta = count.sum(2, keepdims=True), total.sum(2, keepdims=True)
                cr, tr = ca - cl, ta - tl
                gain = np.where((cl >= self.least) & (cr >= self.least), tl**2 / np.maximum(cl, 1) + tr**2 / np.maximum(cr, 1) - ta**2 / np.maximum(ca, 1), -1.0)
                best = gain.reshape(k, -1).argmax(1)
                for i in range(k):
                    j, c = divmod(int(best[i]), width - 1)
                    if gain[i, j, c] > 1e-7:
                        me = lo + i
                        feature[me], cut[me] = use[j], c
                        value[2 * me], value[2 * me + 1] = tl[i, j, c] / cl[i, j, c], tr[i, j, c] / cr[i, j, c]
                node = self._descend(b, node, feature, cut, lo, 2 * lo)
            self.nodes.append((feature, cut, value))
            score += self.rate * value[node]
        return self

    @staticmethod
    def _descend(b: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, lo: int, hi: int) -> np.ndarray:
        f = feature[node]
        go = (node >= lo) & (node < hi) & (f >= 0)
        right = b[np.arange(len(node)), np.maximum(f, 0)] > cut[node]
        return np.where(go, 2 * node + right, node)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        b = self._binned(x)
        for feature, cut, value in self.nodes:
            node = np.ones(len(x), np.int64)
            for level in range(self.depth):
                node = self._descend(b, node, feature, cut, 2**level, 2 ** (level + 1))
            out += self.rate * value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve closest to the points (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    xs, blocks = x[order], []
    for a, b in zip(xs, y[order]):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, last = blocks.pop()
            u, m, _ = blocks[-1]
            blocks[-1] = [(u * m + v * n) / (m + n), m + n, last]
    knots, at = [], 0
    for v, n, _ in blocks:
        knots.append((float(xs[at : at + n].mean()), v))
        at += n
    k = np.array(knots)
    return k[:, 0], k[:, 1]


@dataclass
class ReadingModel:
    lexicon: Lexicon
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]
    report: list[dict]

    def score(self, texts: list[str]) -> np.ndarray:
        raw = self.trees.predict(features(parse(texts), self.lexicon))
        return np.clip(np.interp(raw, *self.knots), 1, 5)




def train(texts: list[str], level: np.ndarray, source: list[str | None], folds: int = 4) -> ReadingModel:
    """Fit on labelled texts; sources are left out in turn to calibrate and to report errors.

    What is left out gives nothing to the fold that predicts it: neither trees nor token difficulty
    see a left-out source or a copy of one of its texts, and a fold's reported errors are those under knots fitted without it.
    """
    names = [s or "" for s in source]
    count: dict[str, int] = {}
    for s in names:
        count[s] = count.get(s, 0) + 1
    load, place = [0] * folds, {}
    for s, c in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        place[s], load[k] = k, load[k] + c
    number: dict[str, int] = {}
    same = np.array([number.setdefault(t, len(number)) for t in texts])  # copies have one number
    fold = np.array([place[s] for s in names])
    if len(set(fold.tolist())) < 2:
        fold = same % folds
    # Token difficulty for training rows comes from documents of other parts, so that none sees its own label or a copy's.
    part = same % 5
    held_in = np.zeros((len(number), folds), bool)
    held_in[same, fold] = True
    bars = held_in[same]  # the folds that a row is no training row of: its own, and those of its copies
    cells: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(fold.tolist(), map(tuple, bars.tolist()), part.tolist())):
        cells.setdefault(key, []).append(i)
    chunks = [(key, rows) for key, own in sorted(cells.items()) for rows in np.array_split(np.array(own), max(1, len(own) // 500))]
    read = lambda rows: parse([texts[i] for i in rows.tolist()])
    stats = [token_stats(read(rows), level[rows]) for _, rows in chunks]

    def lexicon_without(left: int | None, away: int | None) -> Lexicon:
        """From all rows but those that fold ``left`` bars and those of part ``away``."""
        use = [(left is None or not bar[left]) and own != away for (_, bar, own), _ in chunks]
        seen = [rows for (_, rows), u in zip(chunks, use) if u]
        return Lexicon.of([s for s, u in zip(stats, use) if u], float(level[np.concatenate(seen)].mean()) if seen else float(level.mean()))

    every = [None, *sorted(set(fold.tolist()))]
    lexicons = {(k, j): lexicon_without(k, j) for k in every for j in (None, *range(5))}
    x: dict[int | None, np.ndarray] = {}
    for (own, bar, j), rows in chunks:
        p = read(rows)
        for k in every:
            if k is None or k == own or not bar[k]:
                mine = features(p, lexicons[k, None if k is not None and k == own else j])
                if k not in x:
                    x[k] = np.zeros((len(texts), mine.shape[1]), np.float32)
                x[k][rows] = mine
    held = np.full(len(texts), level.mean())
    for k in every[1:]:
        rest = np.flatnonzero(~bars[:, k])
        if len(rest) >= 20:
            held[fold == k] = Boosted().fit(x[k][rest], level[rest]).predict(x[k][fold == k])
    done = np.clip(held, 1, 5)
    for k in every[1:]:
        rest = ~bars[:, k]
        if rest.any():
            done[fold == k] = np.clip(np.interp(held[fold == k], *isotonic(held[rest], level[rest])), 1, 5)
    report = []
    for s in sorted(count):
        m = np.array([t == s for t in names])
        report.append({"source": s, "n": int(m.sum()), "mean_abs_error": float(np.abs(done[m] - level[m]).mean()), "within_half": float((np.abs(done[m] - level[m]) <= 0.5).mean())})
    return ReadingModel(lexicons[None, None], Boosted().fit(x[None], level), isotonic(held, level), report)


def labelled(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, chars: int = MAX_LABELLED_CHARS) -> DataFrame:
    """(doc_id, text, source, level): documents with the mean of their readers' levels; at most ``limit``, by hash of the id.

    The sample is drawn from the labels alone and broadcast (``limit`` rows), so only the sample's texts are
    shuffled; labels of blank or unknown documents drop out after it, and so do texts that do not fit into ``chars`` characters in all.
    """
    mean = labels.where("doc_id is not null and reading_level is not null").groupBy("doc_id", "reader").agg(F.avg("reading_level").alias("r")).groupBy("doc_id").agg(F.avg("r").alias("level"))
    chosen = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    docs = documents.select("doc_id", "text", "source").where(F.trim(F.regexp_replace("text", r"(?U)\s+", "")) != "")
    sample = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample only
    return sample.withColumn("__chars", so_far).where(F.col("__chars") <= chars).drop("__chars")


def fit_reading_model(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> ReadingModel | None:
    """The model, or None where fewer than 20 documents are labelled."""
    rows = labelled(documents, labels, limit).toPandas().sort_values("doc_id", kind="stable")  # the same folds at every parallelism
    if len(rows) < 20:
        return None
    return train(rows["text"].tolist(), rows["level"].to_numpy(float), [s if isinstance(s, str) else None for s in rows["source"]])


def reading_levels(df: DataFrame, model: ReadingModel | None, column: str = "text", out: str = "reading_level", score: str = "reading_score") -> DataFrame:
    """``df`` with a level from 1 to 5 and the score it was rounded from.

    Null and blank texts, and all texts where there is no model, get null. Repeated
    rows get the same level. Columns named like the outputs are replaced. Narrow: the
    model is broadcast, about 1 MB.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in (out, score)]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, T.IntegerType()), T.StructField(score, T.DoubleType())])
    data = df.select(*keep, F.col(column).cast("string").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1)
            full = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"[^\s\p{Z}\p{Cf}]"), False))
            value, valid = np.zeros(batch.num_rows), full & (m is not None)
            if valid.any():
                value[valid] = m.score(texts.filter(pa.array(valid)).to_pylist())
            level = pa.array(np.floor(value + 0.5).astype(np.int32), pa.int32(), mask=~valid)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], level, pa.array(value, pa.float64(), mask=~valid)], names=[*keep, out, score])

    return data.mapInArrow(work, schema)
