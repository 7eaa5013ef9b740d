"""Free-entered values mapped to the entry of a canonical list that they mean.

A multi-pattern automaton over canonical names and aliases finds embedded mentions
in the unified form of a value; the longest of them that do not overlap win, and a
mention decides if nothing but packing and labelling words surrounds it. What remains
goes to token-set similarity: the value's parts in any order, compared as sets of
characters with the list's own, under an allowance of one slip of the pen. The list
is bounded and checked, so it is broadcast; the values are narrow work on the
distinct values of each Arrow batch.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect, bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import permutations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.functions.batches import slices
from tarnbeck.llm.food_words import AFTER, BEFORE, TRADITIONAL
from tarnbeck.llm.unify_text import unify_values
from tarnbeck.operators.multivalue import split_batch, unquote

#: More names and aliases than this are refused: the index is broadcast (about 2 KB a name).
MAX_NAMES = 200_000
_TRAD = str.maketrans(TRADITIONAL)
_BEFORE = re.compile(r"^\s*(?:" + "|".join(BEFORE) + r")\s*")
_AFTER = re.compile(r"\s*(?:" + "|".join(AFTER) + r")\s*$")
_BREAKS = re.compile(r"[\t\n\r\v\f\x85\u2028\u2029]+")
_GAPS = re.compile(r"[\s\-—_()（）\[\]·、,;:/|\"'“”「」.!?。]+")


def simplified(values: list[str]) -> list[str]:
    """Unified forms in simplified characters."""
    return [s.translate(_TRAD) for s in unify_values(pa.array(values, pa.string()))[0].to_pylist()]


def solid(s: str) -> str:
    return _GAPS.sub("", s)


@dataclass
class NameIndex:
    """The canonical list: exact forms, the automaton, and the forms that hold each token (character)."""

    forms: dict[str, str] = field(default_factory=dict)
    literal: set[str] = field(default_factory=set)
    inverted: dict[str, list[str]] = field(default_factory=dict)
    pairs: set[str] = field(default_factory=set)
    longest: int = 0
    automaton: ahocorasick.Automaton | None = None

    @classmethod
    def build(cls, rows: list[tuple[str, str, list[str] | None]]) -> NameIndex:
        """rows: entry_id, name, aliases. Where a form names several entries, a name goes before an alias, then the smaller id."""
        tagged = [(0, e, n) for e, n, _ in rows if e and n and n.strip()] + [(1, e, a) for e, _, al in rows if e for a in al or () if a and a.strip()]
        if len(tagged) > MAX_NAMES:
            raise ValueError(f"the canonical list has {len(tagged)} names; at most {MAX_NAMES} are broadcast")
        index = cls(literal={n for k, _, n in tagged if k == 0})
        for (_, e, _n), form in sorted(zip(tagged, simplified([n for _, _, n in tagged])), key=lambda x: x[0][:2]):
            index.forms.setdefault(solid(form), e)
        for f in index.forms:
            for token in set(f):
                index.inverted.setdefault(token, []).append(f)
            index.pairs.update(a + b for a, b in zip("^" + f, f + "$"))
        index.longest = max(map(len, index.forms), default=0)
        index.automaton = ahocorasick.Automaton()
        for f in index.forms:
            index.automaton.add_word(f, f)
        if index.forms:
            index.automaton.make_automaton()
        return index

    # -- mentions -----------------------------------------------------------------------
    def mentions(self, s: str) -> list[tuple[int, str]]:
        """(start, form) of the longest mentions that do not overlap, longest first taken."""
        if not self.forms:
            return []
        found = sorted(((len(f), -(end - len(f) + 1), f) for end, f in self.automaton.iter(s)), reverse=True)
        taken: list[tuple[int, str]] = []  # by start; they do not overlap, so only the neighbours need a look
        for n, neg, f in found:
            at = bisect(taken, -neg, key=lambda t: t[0])
            before, after = taken[at - 1] if at else None, taken[at] if at < len(taken) else None
            if (before is None or before[0] + len(before[1]) <= -neg) and (after is None or after[0] >= -neg + n):
                taken.insert(at, (-neg, f))
        return taken

    def mentioned(self, s: str, levels: list[tuple[int, int]]) -> str | None:
        """The one entry whose mentions in the whole of ``s`` leave nothing but gaps and packing words around them."""
        at = [i for i, c in enumerate(s) if not _GAPS.fullmatch(c)]  # where each letter of the solid form stands
        found = self.mentions("".join(s[i] for i in at))
        for lo, hi in levels:
            a, b = bisect_left(at, lo), bisect_left(at, hi)
            inside = [(i, f) for i, f in found if i < b and i + len(f) > a]
            # The mentions do not overlap: they fill the level exactly if none reaches beyond it and their lengths add up.
            if inside and inside[0][0] >= a and sum(len(f) for _, f in inside) == b - a and len({self.forms[f] for _, f in inside}) == 1:
                return self.forms[inside[0][1]]
        return None

    # -- token sets ---------------------------------------------------------------------
    def candidates(self, s: str) -> list[str]:
        """The forms that may be ``s``, its parts in any order, with at most one slip.

        A slip adds at most one token to a value, so of any two of its tokens a form holds
        one: the two that the fewest forms hold are looked up, the rest is checked.
        """
        have = set(s)
        rare = sorted(have, key=lambda t: (len(self.inverted.get(t, ())), t))[:2]
        held = dict.fromkeys(f for t in rare for f in self.inverted.get(t, ()))
        return [f for f in held if abs(len(f) - len(s)) <= 1 and len(have.difference(f)) <= 1 and len(set(f) - have) <= 1]

    def slip(self, s: str, f: str) -> float | None:
        """Cost of ``s`` for ``f``: 0 if equal, else of a letter left out, put in, doubled, mistaken, or two swapped; None if more."""
        if s == f:
            return 0.0
        costs = []
        if len(f) == len(s) + 1 and len(f) >= 3:
            if any(f[:i] + f[i + 1 :] == s for i in range(len(f))):
                costs.append(1.0)
        elif len(f) == len(s) - 1 and len(f) >= 2:
            for i in range(len(s)):
                if s[:i] + s[i + 1 :] == f:
                    if i and s[i] == s[i - 1] or i + 1 < len(s) and s[i] == s[i + 1]:
                        costs.append(0.8)
                    elif 0 < i < len(s) - 1:  # a letter put in; at an end it would be another word
                        costs.append(1.2)
        elif len(f) == len(s):
            at = [k for k in range(len(s)) if f[k] != s[k]]
            if len(at) == 2 and at[1] == at[0] + 1 and f[at[0]] == s[at[1]] and f[at[1]] == s[at[0]]:
                costs.append(0.9)
            elif len(at) == 1 and len(s) >= 3:
                k = at[0]
                ringed = "^" + s + "$"
                # A letter that makes sense between its neighbours is another food, not a slip.
                if not (ringed[k : k + 2] in self.pairs and ringed[k + 1 : k + 3] in self.pairs):
                    costs.append(1.1)
        return min(costs, default=None)

    def joined(self, s: str) -> list[tuple[float, int, str, str]]:
        """(slip, rank, order, form) of the token-set join: the forms that the parts of ``s`` make in some order."""
        parts = [p for p in _GAPS.split(s) if p]
        whole = "".join(parts)
        if not 1 <= len(whole) <= self.longest + 1:  # longer ones are more than one slip away from every name
            return []
        few = list(dict.fromkeys([whole, *("".join(p) for p in permutations(parts))])) if len(parts) <= 3 else None
        out = []
        for f in self.candidates(whole):
            for rank, o in enumerate(few) if few else ((int(o != whole), o) for o in arrangements(parts, f)):
                cost = self.slip(o, f)
                if cost is not None:
                    out.append((cost, rank, o, f))
        return out

    # -- stages -------------------------------------------------------------------------
    def peeled(self, s: str) -> list[tuple[int, int]]:
        """Spans of ``s``: all of it, and what is left as packing and labelling words are taken off its ends."""
        seen = [(0, len(s))]
        for lo, hi in seen:  # grows as it is read
            cur = s[lo:hi]
            for pattern in (_BEFORE, _AFTER):
                m = pattern.search(cur)
                if m and m.group() and m.group() != cur:
                    a, b = (m.end(), len(cur)) if pattern is _BEFORE else (0, m.start())
                    rest = cur[a:b]
                    a, b = a + len(rest) - len(rest.lstrip()), b - len(rest) + len(rest.rstrip())
                    if a < b and (lo + a, lo + b) not in seen:
                        seen.append((lo + a, lo + b))
        return seen

    def resolve(self, s: str) -> str:
        """The entry that the unified value ``s`` means, or ''."""
        return self.staged(s)[0]

    def staged(self, s: str) -> tuple[str, str]:
        """That entry, and what found it: ``mention``, ``token set`` (the same characters in another order of parts), ``slip``, or ``none``."""
        levels = self.peeled(s)
        hit = self.mentioned(s, levels)
        if hit is not None:
            return hit, "mention"
        found = [(depth, self.joined(s[lo:hi])) for depth, (lo, hi) in enumerate(levels)]
        for _, rows in found:  # without a slip, the fullest value first, so that no letter is lost to a packing word
            exact = [(rank, f) for cost, rank, _, f in rows if not cost]
            if exact:
                return self.forms[min(exact)[1]], "token set"
        best = [(cost + 0.05 * rank + 1 - len(set(o) & set(f)) / len(set(o) | set(f)), -depth, self.forms[f]) for depth, rows in found for cost, rank, o, f in rows if len(o) >= 2]
        return (min(best)[2], "slip") if best else ("", "none")


def arrangements(parts: list[str], form: str) -> Iterator[str]:
    """The orders of ``parts``, joined, that agree with ``form`` up to one slip; others are left as soon as they disagree."""

    def fits(s: str) -> bool:
        n = next((i for i, (a, b) in enumerate(zip(s, form)) if a != b), min(len(s), len(form)))
        if n == len(s):
            return True
        swapped = s[n : n + 2] == form[n : n + 2][::-1] and form.startswith(s[n + 2 :], n + 2)
        return swapped or form.startswith(s[n + 1 :], n) or form.startswith(s[n + 1 :], n + 1) or form.startswith(s[n:], n + 1)

    def grow(done: str, rest: list[str]) -> Iterator[str]:
        if not rest:
            yield done
        for p in dict.fromkeys(rest):
            if fits(done + p):
                left = rest.copy()
                left.remove(p)
                yield from grow(done + p, left)

    return iter(dict.fromkeys(grow("", parts)))


def _single(values: list[str]) -> list[bool]:
    """Whether each value holds at most one food; tabs and line ends separate like marks do."""
    marked = simplified([_BREAKS.sub("、", v.strip()) for v in values])
    items, owner = split_batch(pa.array([_stripped(v) for v in marked], pa.string()))
    count: dict[int, int] = {}
    for item, row in zip(items.to_pylist(), owner.tolist()):
        count[row] = count.get(row, 0) + (len(solid(item)) > 1)
    return [count.get(i, 0) < 2 for i in range(len(values))]


def _stripped(v: str) -> str:
    while (cut := _AFTER.sub("", v)) != v:
        v = cut
    return v


def _unwrapped(v: str) -> str:
    return unquote(v.strip(" 、,;/|")).strip()


_INDEX: dict[str, NameIndex] = {}


def _index(name: str, rows: list[tuple[str, str, list[str] | None]]) -> NameIndex:
    """The index of the broadcast list ``name``, built once in each Python worker (the last one is kept)."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = NameIndex.build(rows)
    return _INDEX[name]


def map_to_canonical(df: DataFrame, column: str, canonical: DataFrame, out: str = "entry_id", stage: str | None = None) -> DataFrame:
    """``df`` with the entry each value of ``column`` means in ``out``, and how it was found in ``match``.

    canonical: entry_id, name, aliases; at most MAX_NAMES names (checked, then
    broadcast). ``match`` is ``name`` (literally a canonical name), ``mapped``, ``none``
    (no entry: ``out`` is ''), ``several`` (more than one food) or ``blank`` (null or
    blank); ``out`` is null for the last two. ``stage`` names a column for what found it (see
    :meth:`NameIndex.staged`; else as ``match``). An empty list maps nothing. Repeated rows
    stay; columns named like the outputs are replaced. Narrow: no shuffle.
    """
    rows = canonical.select("entry_id", "name", "aliases").limit(MAX_NAMES + 1).collect()
    shared = df.sparkSession.sparkContext.broadcast([(r[0], r[1], list(r[2] or ())) for r in rows])
    name = uuid.uuid4().hex
    new_columns = [out, "match", *([stage] if stage else [])]
    keep = [c for c in df.columns if c not in new_columns]
    data = df.select(*keep, F.col(column).cast("string").alias("__typed"))
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(c, T.StringType()) for c in new_columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared.value)
        known: dict[str | None, tuple[str | None, str, str]] = {}
        for batch in slices(batches):
            coded = batch.column(batch.num_columns - 1).dictionary_encode()
            values = coded.dictionary.to_pylist()
            if len(known) > 200_000:  # a cache of finished values, kept small
                known = {}
            new = [v for v in values if v not in known]
            forms = simplified(new)
            for v, s, one in zip(new, forms, _single(new)):
                if v in index.literal:
                    known[v] = (index.forms[solid(s)], "name", "name")
                elif not s:
                    known[v] = (None, "blank", "blank")
                elif not one:
                    known[v] = (None, "several", "several")
                else:
                    e, by = index.staged(_unwrapped(s) or s)
                    known[v] = (e, "mapped" if e else "none", by)
            entry, how, by = (pa.array([known[v][i] for v in values], pa.string()).take(coded.indices) for i in range(3))
            found = [entry, how.fill_null("blank"), *([by.fill_null("blank")] if stage else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*keep, *new_columns])

    return data.mapInArrow(work, schema)
