"""Visually identical text with different characters, brought to one form.

Values with nothing but plain characters never leave the JVM. The others are
dictionary-encoded in each Arrow batch, and each distinct value is worked on once:
default-ignorable characters go, the compatibility composition (NFKC) is taken,
white space is mapped, look-alike letters are folded where their neighbours show
what they stand for, and the full case folding follows. All steps run over the
batch's code points at once; no shuffle.
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
from tarnbeck.llm.lookalikes import GREEK_INSIDE, KANA, RADICALS, TO_CYRILLIC, TO_LATIN

WIDTH, ACCENT, INVISIBLE, SPACE, LOOKALIKE = 1, 2, 4, 8, 16
KINDS = {WIDTH: "width", ACCENT: "accent", INVISIBLE: "invisible", SPACE: "space", LOOKALIKE: "lookalike"}
#: A value without any of these (Java regex) is already in one form, up to case and blanks.
SUSPECT = (
    "[^\\x{09}\\x{0A}\\x{0D}\\x{20}-\\x{7E}\\x{B0}\\x{B1}\\x{B7}\\x{D7}\\x{3001}-\\x{3003}\\x{3008}-\\x{3011}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}"
    "\\x{20000}-\\x{2F7FF}\\x{2018}-\\x{201D}\\x{2264}\\x{2265}]"
)

_NONE, _LATIN, _FOREIGN, _HAN, _KANA = range(5)


def _ignorable(cp: int) -> bool:
    return (
        cp in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0)
        or 0x180B <= cp <= 0x180F
        or 0x200B <= cp <= 0x200F
        or 0x202A <= cp <= 0x202E
        or 0x2060 <= cp <= 0x206F
        or 0xFE00 <= cp <= 0xFE0F
        or 0xFFF0 <= cp <= 0xFFF8
        or 0xE0000 <= cp <= 0xE0FFF
        or cp < 32 and cp not in (9, 10, 11, 12, 13)
        or 0x7F <= cp < 0xA0 and cp != 0x85
    )


class _T:
    """Lookup tables by code point; built once in a Python worker."""

    ready = False
    flag: np.ndarray
    script: np.ndarray
    one: np.ndarray
    to_latin: np.ndarray
    to_cyrillic: np.ndarray
    kana: np.ndarray
    pictograph: np.ndarray


def _tables() -> type[_T]:
    if _T.ready:
        return _T
    size = 0x110000
    flag, script, one = np.zeros(size, np.uint8), np.zeros(size, np.uint8), np.arange(size, dtype=np.uint32)
    spans = ((0, 0x3300), (0xA000, 0xA100), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
    for lo, hi in spans:
        for cp in range(lo, hi):
            if 0xD800 <= cp < 0xE000:
                continue
            c = chr(cp)
            if _ignorable(cp):
                flag[cp] = INVISIBLE
            elif unicodedata.category(c) in ("Zs", "Zl", "Zp") and cp != 32:
                flag[cp], one[cp] = SPACE, 32 if unicodedata.category(c) == "Zs" else 10
            elif 0xFF10 <= cp <= 0xFF19 or 0xFF21 <= cp <= 0xFF3A or 0xFF41 <= cp <= 0xFF5A or 0xFF61 <= cp <= 0xFFDC or 0xFFE8 <= cp <= 0xFFEE:
                flag[cp] = WIDTH
            elif 0x2E80 <= cp <= 0x2FD5 and (c in RADICALS or unicodedata.decomposition(c)):
                flag[cp] = LOOKALIKE
            elif (0xF900 <= cp <= 0xFB06 or 0x2F800 <= cp <= 0x2FA1F or 0x1D400 <= cp <= 0x1D7FF) and unicodedata.decomposition(c):
                flag[cp] = LOOKALIKE
            if 0x370 <= cp < 0x530 and c.isalpha():
                script[cp] = _FOREIGN
            elif cp < 0x250 and c.isalpha() and c not in "ªº" and cp != 0xB5:
                script[cp] = _LATIN
            elif 0x30A0 <= cp < 0x3100 and cp != 0x30FB:
                script[cp] = _KANA
    script[0x3400:0xA000] = script[0x20000:0x32000] = _HAN
    to_latin, to_cyrillic, kana = (np.zeros(size, np.uint32) for _ in range(3))
    for table, pairs in ((to_latin, TO_LATIN), (to_cyrillic, TO_CYRILLIC), (kana, KANA)):
        for a, b in pairs.items():
            table[ord(a)] = ord(b)
    for a, b in RADICALS.items():
        one[ord(a)] = ord(b)
    one[0x0D] = 10
    pictograph = np.zeros(size, bool)
    for lo, hi in ((0x1F000, 0x20000), (0x2190, 0x2BFF + 1), (0x00A9, 0x00AA), (0x00AE, 0x00AF), (0x203C, 0x203D), (0x2049, 0x204A), (0x2122, 0x2123), (0x3030, 0x3031), (0xE0020, 0xE0080)):
        pictograph[lo:hi] = True
    pictograph[[0x200D, 0xFE0F, 0xFE0E]] = False
    _T.flag, _T.script, _T.one, _T.to_latin, _T.to_cyrillic, _T.kana, _T.pictograph, _T.ready = flag, script, one, to_latin, to_cyrillic, kana, pictograph, True
    return _T


def _points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values, with U+FFFF (no character) after each, and the value each belongs to."""
    joined = "￿".join(values.to_pylist()) + "￿"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 0xFFFF
    return points, np.cumsum(ends) - ends


def _nfkc(values: list[str]) -> pa.Array:
    """Compatibility composition of distinct values (Arrow's utf8_normalize does not compose)."""
    return pa.array([unicodedata.normalize("NFKC", v) for v in values], pa.string())


def _text(points: np.ndarray) -> pa.Array:
    whole = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array(whole.split("￿")[:-1], pa.string())


def _runs(script: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the run of ``which`` characters that each belongs to (undefined elsewhere)."""
    start = which & ~np.concatenate(([False], which[:-1]))
    return np.cumsum(start) - 1, int(start.sum())


def _fold_lookalikes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with look-alike letters replaced, and a mask of the replaced ones."""
    t = _tables()
    out, script = points.copy(), t.script[points]
    letter = (script == _LATIN) | (script == _FOREIGN)
    foreign = script == _FOREIGN
    latin_of = t.to_latin[points]
    if foreign.any():
        run, n = _runs(script, letter)
        r = run[letter]
        latin = np.bincount(r, script[letter] == _LATIN, n) > 0
        genuine_at = foreign & (latin_of == 0)
        genuine = np.bincount(r, genuine_at[letter], n)
        cyrillic = np.bincount(r, (genuine_at & (points >= 0x400))[letter], n) > 0
        first = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
        last = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False])))
        # A run of look-alikes next to a Cyrillic word, one blank or hyphen between, is a word of that language.
        near = np.zeros(n, bool)
        if n > 1:
            gap = first[1:] - last[:-1] == 2
            between = points[np.minimum(last[:-1] + 1, len(points) - 1)]
            gap &= (between == 32) | (between == 45)
            near[1:] |= gap & cyrillic[:-1]
            near[:-1] |= gap & cyrillic[1:]
        to_latin = np.where(latin, ~cyrillic, (genuine == 0) & ~near)
        hit = np.zeros(len(points), bool)
        hit[letter] = to_latin[r] & foreign[letter] & (latin_of[letter] > 0)
        out[hit] = latin_of[hit]
        # Greek letters that are Latin only between Latin letters, and Latin ones within a Cyrillic word.
        for a, b in GREEK_INSIDE.items():
            at = np.flatnonzero(points == ord(a))
            at = at[(at > 0) & (at + 1 < len(points))]
            at = at[(script[at - 1] == _LATIN) & (script[at + 1] == _LATIN)]
            out[at] = ord(b)
        back = np.zeros(len(points), bool)
        back[letter] = (latin & cyrillic)[r] & (script[letter] == _LATIN) & (t.to_cyrillic[points[letter]] > 0)
        out[back] = t.to_cyrillic[points[back]]
    kana = script == _KANA
    if kana.any():
        run, n = _runs(script, kana)
        r = run[kana]
        first = np.flatnonzero(kana & ~np.concatenate(([False], kana[:-1])))
        last = np.flatnonzero(kana & ~np.concatenate((kana[1:], [False])))
        looks = np.bincount(r, t.kana[points[kana]] == 0, n) == 0
        same = np.bincount(r, points[kana] != points[first][r], n) == 0
        beside = (script[np.maximum(first - 1, 0)] == _HAN) & (first > 0) | (script[np.minimum(last + 1, len(points) - 1)] == _HAN)
        hit = np.zeros(len(points), bool)
        hit[kana] = (looks & same & beside)[r]
        out[hit] = t.kana[points[hit]]
    return out, out != points


def unify_values(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The one form of each (non-null) value, and the kinds of characters that had to give way."""
    t = _tables()
    n = len(values)
    if not n:
        return values, np.zeros(0, np.uint8)
    values = pa.array([v.replace("￿", "") for v in values.to_pylist()], pa.string())
    points, owner = _points(values)
    flag = t.flag[points]
    # Joiners and variation selectors of an emoji are part of it.
    before = t.pictograph[np.concatenate(([0], points[:-1]))]
    emoji = before & np.isin(points, (0x200D, 0xFE0E, 0xFE0F)) | np.isin(points, (0x200D,)) & np.concatenate(([False], (points == 0xFE0F)[:-1]))
    emoji |= (points >= 0xE0020) & (points < 0xE0080)
    flag[emoji] = 0
    kinds = np.zeros(n, np.uint8)
    for bit in (WIDTH, INVISIBLE, SPACE, LOOKALIKE):
        kinds[owner[flag == bit]] |= bit

    shown = points[t.flag[points] != INVISIBLE]
    text = _text(shown)
    # Accents: a mark that composes with what stands before it.
    marks = pc.match_substring_regex(text, "[\\x{300}-\\x{36f}\\x{1100}-\\x{11ff}\\x{3099}\\x{309a}]")
    for i in np.flatnonzero(np.asarray(marks)).tolist():
        s = text[i].as_py()
        for a, b in zip(s, s[1:]):
            if (unicodedata.combining(b) or "ᅡ" <= b <= "ᇿ") and len(unicodedata.normalize("NFC", a + b)) == 1:
                kinds[i] |= ACCENT
                break
    points, owner = _points(_nfkc(text.to_pylist()))
    points = t.one[points]
    folded, changed = _fold_lookalikes(points)
    kinds[owner[changed]] |= LOOKALIKE
    # Chains of blanks and of line ends are one; none at either end.
    form = pc.replace_substring_regex(_text(folded), "[ \\t\\x{b}\\f]*\\n\\s*", "\n")
    form = pc.utf8_trim_whitespace(pc.replace_substring_regex(form, "[ \\t\\x{b}\\f]+", " "))
    return _nfkc([s.casefold() for s in form.to_pylist()]), kinds


def unify(df: DataFrame, column: str, out: str = "unified", kinds: str = "kinds") -> DataFrame:
    """``df`` with the one form of ``column`` in ``out`` and the kinds of characters that gave way in ``kinds``.

    kinds is an array of ``width``, ``accent``, ``invisible``, ``space`` and ``lookalike``, empty for plain text. Chinese
    full-width punctuation, raised and lowered digits and other compatibility forms
    are unified too but named by no kind; so are letters of another script used for
    their own sake, which stay. Null gives null and an empty array, blank text ``''``.
    Columns named like the outputs are replaced; repeated rows stay. Whole texts.
    """
    keep = [c for c in df.columns if c not in (out, kinds)]
    source, suspect = f"__{column}_raw", f"__{column}_suspect"
    raw = F.col(column).cast("string")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "[ \\t\\x0b\\f]*[\\n\\r]\\s*", "\n"), "[ \\t\\x0b\\f]+", " "))
    plain = F.regexp_replace(plain, "^\\s+|\\s+$", "")
    data = df.select(*keep, raw.alias(source), plain.alias(out), F.coalesce(raw.rlike(SUSPECT), F.lit(False)).alias(suspect))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, T.StringType()), T.StructField(kinds, T.ArrayType(T.StringType(), False))])
    names = {i: pa.array([[v for b, v in KINDS.items() if i & b]], pa.list_(pa.string())) for i in range(32)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -3):
            text, form, mask = (batch.column(batch.num_columns - i) for i in (3, 2, 1))
            bits = np.zeros(batch.num_rows, np.uint8)
            rows = np.flatnonzero(np.asarray(mask))
            if len(rows):
                coded = text.take(pa.array(rows)).dictionary_encode()
                done, kind = unify_values(coded.dictionary)
                index = np.asarray(coded.indices)
                bits[rows] = kind[index]
                form = pc.replace_with_mask(form, mask, done.take(coded.indices).cast(form.type))
            lists = pa.concat_arrays([names[i] for i in range(32)]).take(pa.array(bits.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], form, lists], names=[*keep, out, kinds])

    return data.mapInArrow(work, schema)
