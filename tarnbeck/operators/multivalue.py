"""Several values packed in one field: one row per value, position kept.

A batch's string buffer is decoded once to code points; quote parity, bracket
depth and separator masks are computed over the whole batch with numpy, the
child offsets follow from the masks and the items are cut from the buffer as one
Arrow array. Commas and slashes beside letters or digits are looked at one by one
(:func:`protections`). Rows whose quotes or brackets do not pair up, and those with a
straight quote after a digit, go through :func:`scan_cuts`, which states the same
rules one character at a time in one pass; :func:`split_paths` counts them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.functions.batches import slices

# Separators as they look; compatibility forms are folded to them first.
SEPARATORS = "、,;/|\t\n\r\x0b\x0c\x85  ;⁄∕∣ǀ¦،؛‚"
BRACKETS = {"(": ")", "[": "]", "{": "}", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "⟨": "⟩"}
QUOTES = {"“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "‹": "›", "〝": "〞", "„": "”"}
STRAIGHT = "\"'"
# Unit symbols that may stand on either side of a slash.
UNITS = frozenset(
    "g kg mg μg ug ng pg t L l mL ml μL uL dL cL m cm mm km m2 cm2 m3 cm3 w v s h d min mol mmol μmol umol "
    "nmol kJ J kcal cal Cal IU CFU cfu MPN MPa kPa Pa W kW r rpm wt vol dw fw cells spores".split()
)

#: The closing mark of each opening one, by code point.
_PARTNER = np.zeros(0x110000, np.uint32)
for _a, _b in {**BRACKETS, **QUOTES}.items():
    _PARTNER[ord(_a)] = ord(_b)

OTHER, SEP, SPACE, HIDDEN, OPEN, CLOSE, DOUBLE, SINGLE, DIGIT, LATIN = range(10)


def hidden(ch: str) -> bool:
    """Characters that show nothing: format characters, variation selectors and fillers."""
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠㅤﾠ᠎" or "︀" <= ch <= "️"


def _looks(ch: str) -> str:
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 else ch


def _kind(ch: str) -> int:
    if hidden(ch):
        return HIDDEN
    c = _looks(ch)
    if c in SEPARATORS:
        return SEP
    if c.isspace():
        return SPACE
    if c == '"':
        return DOUBLE
    if c == "'":
        return SINGLE
    if c in BRACKETS or c in QUOTES:
        return OPEN
    if c in BRACKETS.values() or c in QUOTES.values():
        return CLOSE
    if c.isascii() and c.isdigit():
        return DIGIT
    if c.isalpha() and ord(c) < 0x0530:
        return LATIN
    return OTHER


class _Tables:
    kinds: np.ndarray | None = None
    looks: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and appearance of every code point; built once in a Python worker."""
    if _Tables.kinds is None:
        kinds, looks = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for lo, hi in ((0, 0x3100), (0xF900, 0x10000), (0xE0000, 0xE0200)):
            for cp in range(lo, hi):
                if 0xD800 <= cp < 0xE000:
                    continue
                kinds[cp], looks[cp] = _kind(chr(cp)), ord(_looks(chr(cp)))
        _Tables.kinds, _Tables.looks = kinds, looks
    return _Tables.kinds, _Tables.looks


_DASH = "-‐‑–−"


def _digit(c: str) -> bool:
    return c.isascii() and c.isdigit()


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum() or c.isalpha() and ord(c) < 0x0530


def _run(text: str, i: int) -> int:
    """End of the letters, digits and primes from ``i`` on."""
    while i < len(text) and (_word(text[i]) or text[i] in "'′"):
        i += 1
    return i


def _locant(s: str) -> bool:
    s = s.strip("'′")
    return len(s) == 1 or s.isdigit()


def protections(text: str, marks: list[int]) -> list[bool]:
    """Whether each mark of a folded text without hidden characters is part of a number, a chemical name, a unit or a standard's code.

    Chains of positions (N,N,N-) are followed once, whichever of their commas is asked for, so time is linear in the text.
    """
    n = len(text)
    named: dict[int, bool] = {}

    def names(i: int) -> bool:
        """Whether positions follow the comma at ``i`` up to a hyphen: N,N- 2,N- α,β-"""
        way, good = [], False
        while i not in named:
            way.append(i)
            hi = _run(text, i + 1)
            if not _locant(text[i + 1 : hi]) or hi == n or text[hi] != ",":
                good = _locant(text[i + 1 : hi]) and hi < n and text[hi] in _DASH
                break
            i = hi
        else:
            good = named[i]
        named.update(dict.fromkeys(way, good))
        return good

    def kept(i: int) -> bool:
        mark = text[i]
        if mark not in ",/" or i == 0 or i + 1 == n:
            return False
        before, after = text[i - 1], text[i + 1]
        if _digit(before) and _digit(after):
            return True
        if not (_word(before) or before in "'′%") or not _word(after):
            return False
        lo = i
        while lo and (_word(text[lo - 1]) or text[lo - 1] in "'′%"):
            lo -= 1
        left = text[lo:i]
        if mark == ",":
            return _locant(left) and names(i)
        hi = _run(text, i + 1)
        right = text[i + 1 : hi]
        if left.lstrip("0123456789.") in UNITS or left.endswith("%"):
            tail = right
            if right.isdigit():  # g/100 g
                at = hi
                while at < n and text[at] == " ":
                    at += 1
                hi = at
                while hi < n and _word(text[hi]):
                    hi += 1
                tail = text[at:hi]
            if tail.lstrip("0123456789") in UNITS:
                return True
        # a standard's code: letters, a slash, and T, Z or the like
        return left.rstrip("0123456789").isascii() and left.rstrip("0123456789").isupper() and len(left) <= 6 and right in ("T", "Z", "TS", "TR", "GT", "XG")

    return [kept(i) for i in marks]


def _closings(seen: str, kinds: list[int]) -> dict[int, int]:
    """Where each opening mark closes, if it does: brackets and paired quotes by a stack of each kind, a straight double quote at the
    end of the next odd run of such quotes (doubled ones stand for one), an apostrophe at the next one that ends a value."""
    n, close = len(seen), {}
    for a, b in {**BRACKETS, **QUOTES}.items():
        if a in seen and b in seen:
            open_ = []
            for k, c in enumerate(seen):
                if c == a:
                    open_.append(k)
                elif c == b and open_:
                    close[open_.pop()] = k
    later, run, ends = -1, 0, -1  # the next odd run's last quote; quotes of this run from here on, and its last
    apostrophe, solid = -1, SEP  # the next apostrophe that ends a value; the kind of the next character that is no space
    for k in range(n - 1, -1, -1):
        if kinds[k] == DOUBLE:
            if not run:
                ends = k
            close[k] = ends if run % 2 else later
            run += 1
        elif run:
            later, run = ends if run % 2 else later, 0
        if kinds[k] == SINGLE:
            close[k] = apostrophe
            apostrophe = k if solid == SEP else apostrophe
        if kinds[k] != SPACE:
            solid = kinds[k]
    return close


def _shown(text: str) -> tuple[list[int], str]:
    """Places of the characters that show something, and what they look like."""
    keep = [i for i, c in enumerate(text) if not hidden(c)]
    return keep, "".join(_looks(text[i]) for i in keep)


def scan_cuts(text: str) -> list[int]:
    """Indexes of the separators of one text, by the rules taken one character at a time, in one pass.

    An opening mark counts only if its closing mark follows; an apostrophe opens
    only at the start of a value and closes only at its end; a straight double quote
    after a digit is an inch mark.
    """
    keep, seen = _shown(text)
    kinds = [_kind(c) for c in seen]
    close = _closings(seen, kinds)
    marks = [i for i, k in enumerate(kinds) if k == SEP]
    spared = {i for i, p in zip(marks, protections(seen, marks)) if p}
    cuts, i, start = [], 0, True
    while i < len(seen):
        k = kinds[i]
        if k == SEP:
            if i not in spared:
                cuts.append(keep[i])
                start = True
        elif k != SPACE:
            opens = k == OPEN or k == DOUBLE and not (i and kinds[i - 1] == DIGIT) or k == SINGLE and start
            start = False
            if opens and close.get(i, -1) > i:
                i = close[i]
        i += 1
    return cuts


def unquote(item: str) -> str:
    """Without surrounding white space and without quotes that enclose the value whole."""
    s = item.strip()
    while len(s) >= 2:
        first, last = _looks(s[0]), _looks(s[-1])
        if first in STRAIGHT and last == first:
            inner = s[1:-1]
            pair = s[0] * 2
            if s[0] in inner.replace(pair, ""):
                return s
            s = inner.replace(pair, s[0]).strip()
            return s
        if QUOTES.get(first) == last:
            depth = 0
            for k, c in enumerate(s):
                depth += (_looks(c) == first) - (_looks(c) == last)
                if not depth and k < len(s) - 1:
                    return s
            return s[1:-1].strip()
        return s
    return "" if s and _looks(s) in STRAIGHT else s


def _per_row(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Running sum within each row, the value itself counted."""
    total = np.cumsum(values, dtype=np.int64)
    before = np.concatenate(([0], total))[starts]
    return total - before[rows]


def split_batch(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All items of a batch, in order, and for each the index of its row.

    Empty items are dropped. Null rows have none.
    """
    return _split(column)[:2]


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Items, their rows, and which rows went through the scanner."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column]) if column.offset else column
    n = len(column)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi) if data is not None and hi else np.zeros(0, np.uint8)
    head = np.flatnonzero((raw[lo:hi] & 0xC0) != 0x80)  # byte of each character
    points = np.frombuffer(raw[lo:hi].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.searchsorted(head, offsets - lo)
    rows = np.repeat(np.arange(n), np.diff(starts))
    table, looks = _tables()
    kind, look = table[points], looks[points]
    begin = starts[:-1]

    depth_move = np.zeros(len(points), np.int64)
    depth_move[kind == OPEN], depth_move[kind == CLOSE] = 1, -1
    depth = _per_row(depth_move, begin, rows)
    parity = _per_row(kind == DOUBLE, begin, rows) & 1
    mask = (kind == SEP) & (depth == 0) & (parity == 0)

    # An apostrophe opens a value at its start and closes it at its end; any other is a letter.
    solid = np.flatnonzero((kind != HIDDEN) & (kind != SPACE))
    single = np.flatnonzero(kind == SINGLE)
    place = np.searchsorted(solid, single)
    before, after = solid[np.maximum(place - 1, 0)], solid[np.minimum(place + 1, len(solid) - 1)] if len(solid) else single
    starts_value = (place == 0) | (rows[before] != rows[single]) | (kind[before] == SEP) if len(single) else np.zeros(0, bool)
    ends_value = (place + 1 >= len(solid)) | (rows[after] != rows[single]) | (kind[after] == SEP) if len(single) else np.zeros(0, bool)
    edge = single[starts_value | ends_value]
    quoted_move = np.zeros(len(points), np.int64)
    quoted_move[edge] = 1
    quoted = _per_row(quoted_move, begin, rows) & 1
    mask &= quoted == 0

    # Rows that need the scanner: marks that do not pair or cross, and straight quotes after a digit, which may be inch marks.
    odd = np.zeros(n, bool)
    filled = np.flatnonzero(np.diff(starts) > 0)
    last = starts[filled + 1] - 1
    odd[filled[(depth[last] != 0) | (parity[last] != 0) | (quoted[last] != 0)]] = True
    odd[rows[depth < 0]] = True
    odd[rows[(kind == DOUBLE) & (depth > 0)]] = True
    odd[rows[single[starts_value & ends_value]]] = True
    odd[rows[edge[(depth[edge] != 0) | (parity[edge] != 0)]]] = True
    odd[rows[single[starts_value & (quoted[single] == 0)]]] = True  # running sums count the mark itself: an opening one is the odd one
    odd[rows[single[ends_value & (quoted[single] == 1)]]] = True
    quote = np.flatnonzero(kind == DOUBLE)
    quote = quote[quote > 0]
    odd[rows[quote[kind[quote - 1] == DIGIT]]] = True
    # Opening and closing marks of one depth take turns in a row where all pair up; each must close its own kind.
    marks = np.flatnonzero((kind == OPEN) | (kind == CLOSE))
    marks = marks[~odd[rows[marks]]]
    level = depth[marks] + (kind[marks] == CLOSE)
    marks = marks[np.lexsort((marks, level, rows[marks]))]
    odd[rows[marks[::2][_PARTNER[look[marks[::2]]] != look[marks[1::2]]]]] = True

    # A comma or slash beside a letter or digit may belong to a name.
    at = np.flatnonzero(mask & ((look == ord(",")) | (look == ord("/"))))
    near = np.zeros(len(at), bool)
    for step in (-1, 1):
        beside = np.clip(at + step, 0, max(0, len(points) - 1))
        near |= (rows[beside] == rows[at]) & np.isin(kind[beside], (DIGIT, LATIN, HIDDEN, SINGLE))
    at = at[near & ~odd[rows[at]]]
    for group in np.split(at, np.flatnonzero(np.diff(rows[at])) + 1) if len(at) else ():
        first = starts[rows[group[0]]]
        keep, seen = _shown(column[int(rows[group[0]])].as_py())
        spared = protections(seen, np.searchsorted(keep, group - first).tolist())
        mask[group[np.array(spared)]] = False

    mask &= ~odd[rows] if len(rows) else mask
    cuts = [np.flatnonzero(mask)]
    for r in np.flatnonzero(odd).tolist():
        cuts.append(np.array(scan_cuts(column[r].as_py()), np.int64) + starts[r])
    cut = np.sort(np.concatenate(cuts).astype(np.int64))

    # Child offsets: each row's start, and around each separator; the separators themselves are cut away.
    head_end = np.append(head, hi - lo) + lo
    edges = np.concatenate((offsets[:-1], head_end[cut], head_end[cut + 1]))
    owner = np.concatenate((np.arange(n), rows[cut], rows[cut]))
    is_item = np.concatenate((np.ones(n, bool), np.zeros(len(cut), bool), np.ones(len(cut), bool)))
    position = np.concatenate((starts[:-1] * 2, cut * 2 + 1, cut * 2 + 2))
    order = np.lexsort((position, owner))
    edges, owner, is_item = np.append(edges[order], hi), owner[order], is_item[order]
    segments = pa.LargeStringArray.from_buffers(len(owner), pa.py_buffer(edges.astype(np.int64).tobytes()), data)
    items = pc.utf8_trim_whitespace(segments.filter(pa.array(is_item)))
    owner = owner[is_item]
    wrapped = pc.match_substring_regex(items, "^[\"'“‘「『«‹〝„＂＇]")
    if pc.any(wrapped).as_py():
        items = pc.if_else(wrapped, pa.array([unquote(s) if q else "" for s, q in zip(items.to_pylist(), wrapped.to_pylist())], pa.large_string()), items)
    shown = pc.replace_substring_regex(items, "[\\p{Cf}\\x{34f}\\x{115f}\\x{1160}\\x{3164}\\x{ffa0}\\x{fe00}-\\x{fe0f}\\p{Z}\\s]", "")
    full = pc.greater(pc.binary_length(shown), 0)
    return items.filter(full).cast(pa.string()), owner[np.asarray(full)], odd


#: Bytes of repeated columns in one output batch; Arrow strings end at 2 GB.
OUTPUT_BYTES = 64_000_000


def _weights(columns: list[pa.Array], n: int) -> np.ndarray:
    """Bytes that one repetition of each row takes."""
    size = np.full(n, 64, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += np.asarray(pc.fill_null(pc.binary_length(c), 0)).astype(np.int64)
        elif pa.types.is_nested(c.type):
            size += max(1, c.nbytes // max(1, n))
    return size


def split_values(df: DataFrame, column: str, out_pos: str = "pos", out_item: str = "item", least: int = 1) -> DataFrame:
    """One row per value of ``column``: the other columns, repeated, the position from 1, and the item.

    Null, empty and separator-only fields give no row; repeated values keep their own
    position; ``least`` leaves out fields with fewer values. ``column`` itself is not repeated
    (a long field would be multiplied by its own length); the output columns replace columns of
    the same name. Narrow: no shuffle.
    """
    keep = [c for c in df.columns if c not in (column, out_pos, out_item)]
    data = df.select(*keep, F.col(column).cast("string").alias("__packed"))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out_pos, T.IntegerType()), T.StructField(out_item, T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            *others, packed = batch.columns
            items, owner = split_batch(packed)
            count = np.bincount(owner, minlength=batch.num_rows)
            first = np.cumsum(count) - count
            pos = (np.arange(len(owner)) - first[owner] + 1).astype(np.int32)
            wanted = np.flatnonzero(count[owner] >= least)
            weight = np.cumsum(_weights(others, batch.num_rows)[owner[wanted]])
            lo = 0
            while lo < len(wanted):
                done = weight[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(weight, done + OUTPUT_BYTES, "right")))
                rows = wanted[lo:hi]
                at = pa.array(owner[rows])
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in others), pa.array(pos[rows]), items.take(pa.array(rows))], names=[*keep, out_pos, out_item])
                lo = hi

    return data.mapInArrow(cut, schema)


def split_paths(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, path, n_rows): how many rows went through the masks and how many through the scanner; null and empty ones count as masks."""
    data = df.select(*by, F.col(column).cast("string").alias("__packed"))
    schema = T.StructType([*df.select(*by).schema.fields, T.StructField("path", T.StringType())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            odd = _split(batch.column(batch.num_columns - 1))[2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.where(odd, "scanner", "masks").tolist(), pa.string())], names=[*by, "path"])

    return data.mapInArrow(tell, schema).groupBy(*by, "path").agg(F.count("*").alias("n_rows"))
