"""Text functions: normal forms, tokens, spans, extraction and quality.

Everything but NFKC stays in the JVM; NFKC runs on the distinct values of an Arrow
batch, and only for values that are not plain ASCII.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dashes that count as one, and character ranges of Chinese text (Java regex).
DASHES = "‐‑‒–—−﹘﹣－"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{20000}-\x{2ffff}"
WORD = r"[A-Za-z0-9_]+(?:[./-][A-Za-z0-9_]+)*"
# Prefixes of standards' numbers.
STANDARD = r"(?i)^(GB(?:/T|T|/Z|Z)?|NY(?:/T|T)?|SN(?:/T|T)?|DB\d*(?:/T|T)?|ISO|CAC|JJF|JJG|FS(?:/T|T)?|SQ(?:/T|T|/Z|Z)?)(\d[\d.]*(?:-\d{4})?)$"
STANDARD_MENTION = r"(?<![A-Za-z])(?:GB|NY|SN|FS|SQ)(?:/[TZ])?\s*\d+(?:\.\d+)*(?:[-—–]\d{4})?"
# Field weights of phrase hits.
FIELD_WEIGHTS = {"name": 100, "project": 100, "title": 60, "definition": 45, "scope": 35, "table": 30, "body": 20}
OTHER_WEIGHT, EXACT_NAME_BONUS, MAX_SPANS = 10, 1000, 20


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    # Each distinct value once. Arrow's own utf8_normalize leaves NFC and NFKC decomposed.
    coded = values.dictionary_encode()
    return pa.array([unicodedata.normalize("NFKC", v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def nfkc(c: Column | str) -> Column:
    """Compatibility composition; ASCII values do not leave the JVM."""
    c = _c(c)
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_nfkc(c))


def squeeze(c: Column | str) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(_c(c), r"(?U)\s+", "")


def clean(c: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def match_form(c: Column | str) -> Column:
    """For look-ups: NFKC, no white space, lower case."""
    return F.lower(squeeze(nfkc(c)))


def search_form(c: Column | str) -> Column:
    """For phrase search: NFKC, one dash, no white space, case kept."""
    return squeeze(F.translate(nfkc(c), DASHES, "-" * len(DASHES)))


def standard_form(c: Column | str) -> Column:
    """A standard's number in one spelling (prefix upper case, T and Z behind a slash); other text unchanged."""
    s = search_form(c)
    prefix = F.regexp_replace(F.upper(F.regexp_extract(s, STANDARD, 1)), r"(?<=[A-Z0-9])(?<!/)([TZ])$", "/$1")
    return F.when(s.rlike(STANDARD), F.concat(prefix, F.regexp_extract(s, STANDARD, 2))).otherwise(s)


# Filter keys that hold a standard's number, and those that hold an identity.
STANDARD_KEYS = ("designation", "family", "method_standard", "judgment_standard")
IDENTITY_KEYS = ("record_id", "version_id", "node_id", "project_id", "review_state", "namespace", "record_type")


def filter_form(key: str, c: Column | str) -> Column:
    """The form in which values of a filter key are compared: a standard's number in one spelling, identities in NFKC without blanks around
    them, a year of four digits (else null), anything else as :func:`search_form`. Null and blank values are null."""
    c = _c(c).cast("string")
    form = standard_form(c) if key in STANDARD_KEYS else F.trim(nfkc(c)) if key in IDENTITY_KEYS else search_form(c)
    if key == "year":
        form = F.when(form.rlike(r"^\d{4}$"), form)
    return F.when(squeeze(c) != "", form)


def family_of(c: Column | str) -> Column:
    """A standard's number without its year."""
    return F.regexp_replace(F.trim(_c(c)), r"\s*[-—–]\s*\d{4}$", "")


def year_of(c: Column | str) -> Column:
    y = F.regexp_extract(_c(c), r"[-—–]\s*(\d{4})$", 1)
    return F.when(y != "", y.cast("int"))


def standards_in(c: Column | str) -> Column:
    """Numbers of standards mentioned, in order, each once, white space reduced to one blank."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(c), F.lit(STANDARD_MENTION), F.lit(0)), clean))


def clauses_in(c: Column | str) -> Column:
    """Clauses cited (A.1, 3.2.4), leaving out headings at line starts, tags and formula labels."""
    s = F.regexp_replace(F.regexp_replace(_c(c), r"(?m)^\s*(?:[A-Z]\.)?\d+(?:\.\d+)*\s", " "), r"<[^>]*>|[（(]\s*[A-Z]?\.?\d+\s*[)）]", " ")
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?<![A-Za-z0-9.])(?:[A-Z](?:\.\d+)+|\d+(?:\.\d+)+)(?=的|中|规定|条|款)"), F.lit(0)))


def tokens(c: Column | str, query: bool = False, normalised: bool = False) -> Column:
    """Index terms: single Chinese characters (c:) and pairs (g:), words (w:), their letters (a:) and pairs (b:).

    The query side keeps singles only of one-character parts and drops whole words,
    which a substring of a word could not demand. Words over 1000 bytes have no w: term;
    their letters and pairs are kept, as they are what finds a phrase. Sorted, each once.
    """
    s = _c(c) if normalised else search_form(c)
    han = F.regexp_extract_all(s, F.lit(f"[{HAN}]+"), F.lit(0))
    word = F.regexp_extract_all(s, F.lit(WORD), F.lit(0))
    pairs = lambda parts, tag: F.flatten(
        F.transform(parts, lambda p: F.when(F.length(p) >= 2, F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.concat(F.lit(tag), p.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>")))
    )
    kept = (lambda parts: F.filter(parts, lambda p: F.length(p) == 1)) if query else (lambda parts: parts)
    singles = lambda parts, tag: F.transform(F.filter(F.flatten(F.transform(kept(parts), lambda p: F.split(p, ""))), lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    out = [singles(han, "c:"), pairs(han, "g:"), singles(word, "a:"), pairs(word, "b:")]
    if not query:
        out.append(F.transform(F.filter(word, lambda w: F.octet_length(w) <= 1000), lambda w: F.concat(F.lit("w:"), w)))
    return F.array_sort(F.array_distinct(F.concat(*out)))


def symbols(c: Column | str) -> Column:
    """Index terms (s:) of the characters that are neither Chinese nor letters, digits or underscores, each once."""
    found = F.array_distinct(F.regexp_extract_all(_c(c), F.lit(f"[^{HAN}A-Za-z0-9_]"), F.lit(0)))
    return F.transform(found, lambda x: F.concat(F.lit("s:"), x))


_HAN_RUN = re.compile("[㐀-䶿一-鿿\U00020000-\U0002ffff]+")
_WORD_RUN = re.compile(WORD)
# What Unicode counts as white space.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def search_form_of(phrase: str) -> str:
    """:func:`search_form` of one phrase, without a job."""
    return _WHITE.sub("", unicodedata.normalize("NFKC", phrase).translate(str.maketrans(DASHES, "-" * len(DASHES))))


def phrase_terms(form: str) -> list[str]:
    """The query side's :func:`tokens` of a phrase, without a job; its :func:`symbols` if it has none."""
    out = set()
    for runs, single, pair in ((_HAN_RUN.findall(form), "c:", "g:"), (_WORD_RUN.findall(form), "a:", "b:")):
        for run in runs:
            out.update([single + run] if len(run) == 1 else (pair + run[i : i + 2] for i in range(len(run) - 1)))
    return sorted(out or {"s:" + c for c in form})


def count_of(c: Column | str, phrase: Column | str) -> Column:
    """Non-overlapping occurrences of ``phrase``."""
    c, phrase = _c(c), _c(phrase)
    return F.when(F.length(phrase) > 0, ((F.length(c) - F.length(F.replace(c, phrase, F.lit("")))) / F.length(phrase)).cast("int"))


def spans(c: Column | str, phrase: Column | str) -> Column:
    """Offsets (from 0) of the first MAX_SPANS non-overlapping occurrences: array of struct<start, end>."""
    c, phrase = _c(c), _c(phrase)
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def take(acc: Column, _: Column) -> Column:
        pos = F.position(phrase, c, acc["at"] + 1)
        hit = (pos > 0) & (acc["at"] >= 0)
        span = F.struct((pos - 1).cast("int").alias("start"), (pos - 1 + F.length(phrase)).cast("int").alias("end"))
        return F.struct(F.when(hit, (pos - 1 + F.length(phrase)).cast("int")).otherwise(F.lit(-1)).alias("at"), F.when(hit, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_SPANS)), step, take)["found"]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def normalised_spans(raw: pa.Array, phrase: pa.Array) -> pa.Array:
    """Raw offsets of the occurrences of a phrase in the search form of a text; at most MAX_SPANS.

    An occurrence that begins or ends within one raw character (a ligature) takes
    that character whole. Null text or phrase gives null, an empty phrase no span.
    """
    out = []
    for text, want in zip(raw.to_pylist(), phrase.to_pylist()):
        if text is None or want is None:
            out.append(None)
            continue
        form, origin = [], []
        # Composition may reach over characters: clusters of a base and its marks are normalised together.
        i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and (unicodedata.combining(text[j]) or "ᅡ" <= text[j] <= "ᇿ" or text[j] in "゙゚ﾞﾟ"):
                j += 1
            for ch in unicodedata.normalize("NFKC", text[i:j]):
                if not ch.isspace():
                    form.append("-" if ch in DASHES else ch)
                    origin.append((i, j))
            i = j
        flat, found, at = "".join(form), [], 0
        while want and len(found) < MAX_SPANS and (at := flat.find(want, at)) >= 0:
            found.append({"start": origin[at][0], "end": origin[at + len(want) - 1][1]})
            at += len(want)
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def quality_flags(c: Column | str) -> Column:
    """Array of what is wrong with a text: empty, garbled, repeated, symbols."""
    c = _c(c)
    seen = F.regexp_replace(c, r"(?U)\s+", "")
    n = F.length(seen)
    symbols = F.length(F.regexp_replace(seen, r"[^\p{P}\p{S}]", ""))
    flags = F.array(
        F.when(c.isNull() | (n == 0), F.lit("empty")),
        F.when(c.rlike(r"\x{FFFD}|[\x{E000}-\x{F8FF}]|\(cid:\d+\)"), F.lit("garbled")),
        F.when(c.rlike(r"(\S)\1{19,}"), F.lit("repeated")),
        F.when((n > 0) & (symbols * 2 > n), F.lit("symbols")),
    )
    return F.array_compact(flags)


def review_flags(c: Column | str) -> Column:
    """Array of what a reader should look at: formulas, comparisons, units and percentages, which extraction garbles easily."""
    marks = r"[<>=≤≥±×÷∑√^²³₀-₉]|(?<![\p{L}\p{N}_])(?:mg|kg|g|mL|L|mmol|CFU)\s*[/·]|\p{Nd}\s*%"
    return F.array_compact(F.array(F.when(_c(c).rlike(marks), F.lit("formula_comparison_unit_review"))))


def names_of(c: Column | str) -> Column:
    """Search keys of a listed name: the name, and the parts before and inside its brackets."""
    c = clean(c)
    inner = F.regexp_extract(c, r"[（(]([^（()）]+)[)）]", 1)
    outer = F.trim(F.regexp_replace(c, r"[（(][^（()）]*[)）]", ""))
    return F.array_distinct(F.filter(F.array(c, outer, inner), lambda x: x.isNotNull() & (x != "")))


def food_terms(c: Column | str, prefixes: str = "新鲜|生鲜|鲜食|冷冻|冰鲜|鲜|生") -> Column:
    """Parts of a typed value at its separators, each with and without a leading state word."""
    parts = F.filter(F.transform(F.split(_c(c), r"[、,，;；/／|｜\n\t]+"), clean), lambda x: x != "")
    bare = F.transform(parts, lambda p: F.when(F.length(F.regexp_replace(p, f"^(?:{prefixes})", "")) >= 2, F.regexp_replace(p, f"^(?:{prefixes})", "")).otherwise(p))
    return F.array_distinct(F.concat(parts, bare))


def query_terms(c: Column | str, aliases: dict[str, str], prefixes: str = "新鲜|生鲜|鲜食|冷冻|冰鲜|鲜|生") -> Column:
    """What a typed value is looked up as: its match form, that without a leading state word, and the alias of either, each once."""
    form = match_form(c)
    bare = F.regexp_replace(form, f"^(?:{prefixes})(?=.{{2,}})", "")
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    terms = F.array(form, bare)
    return F.array_distinct(F.array_compact(F.concat(terms, F.transform(terms, lambda t: F.try_element_at(names, t)))))


def without_folios(c: Column | str) -> Column:
    """Without lines that hold only a page number."""
    return F.regexp_replace(_c(c), r"(?m)^[ \t]*\d+[ \t]*(?:\n|\z)", "")


def excerpt(c: Column | str, pattern: str, before: int = 1, after: int = 2) -> Column:
    """The first line that matches, with its neighbours: struct<line, text>; null without a match."""
    lines = F.split(_c(c), "\n")
    hit = F.transform(lines, lambda x: x.rlike(pattern))
    at = F.array_position(hit, True)
    lo = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.struct(at.cast("int").alias("line"), F.array_join(F.slice(lines, lo.cast("int"), (at + after - lo + 1).cast("int")), "\n").alias("text")))
