"""Splitting oversized texts at natural boundaries.

One bounded-quantifier pattern does the cutting inside the JVM: its alternatives are
ordered by the strength of the boundary they end at, each consumes as much as the
limit allows, and the last one falls back to single characters. SQL array functions
then put the overlap in front of each piece and count its offset. Everything is narrow: no shuffle, no
Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may end a piece, strongest first (Java regex, looking behind and ahead).
CLAUSE = r"(?<=\n)(?=[ \t\x{3000}]*(?:\d{1,3}(?:\.\d{1,3})*|[A-Z](?:\.\d{1,3})+|第[一二三四五六七八九十百\d]+[章节条款])[ \t\x{3000}.、．])"
ROW = r"(?<=\|\n|\|\r\n)"
LINE = r"(?<=[\n\r\x{2028}\x{2029}])(?!(?<=\r)\n)"
SENTENCE = r"(?<=[。！？；…]|[。！？；…][”’」』）)\"]|[.!?;]\s|[.!?;][\"')]\s)(?![”’」』）)])"
PAUSE = r"(?<=[，、,：:\s])"
#: Never before a combining mark, a joiner or a variation selector, nor after a joiner.
CHARACTER = r"(?<!\x{200D})(?![\p{M}\x{200D}\x{FE0E}\x{FE0F}])"


def cutting_pattern(limit: int, least: int) -> str:
    """A pattern whose matches, taken one after the other, cover a whole text."""
    if not 0 < least <= limit:
        raise ValueError("need 0 < least <= limit")
    half = max(least, limit // 2)
    parts = [f".{{1,{limit}}}\\z"]
    parts += [f".{{{half},{limit}}}{b}" for b in (CLAUSE, ROW, LINE, SENTENCE)]
    parts += [f".{{{least},{limit}}}{b}" for b in (LINE, SENTENCE)] if half > least else []
    parts += [f".{{{half},{limit}}}{PAUSE}", f".{{{least},{limit}}}{CHARACTER}", f".{{1,{limit}}}"]
    return "(?s)" + "|".join(parts)


def cut(text: Column, max_chars: int, overlap_chars: int) -> Column:
    """Array of the pieces of ``text`` without overlap; a text within the limit is one piece."""
    if not 0 <= overlap_chars < max_chars:
        raise ValueError("need 0 <= overlap_chars < max_chars")
    pattern = cutting_pattern(max_chars - overlap_chars, min(max(1, overlap_chars), max_chars - overlap_chars))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def offsets(lengths: Column) -> Column:
    """The sum of all elements before each one, of an array of any length.

    Sums of blocks of 64 come first, then each element adds those before it in its
    block, so neither time nor memory is the square of the array's length.
    """

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, n: a + n)

    def before(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(n) - 1, 6)), lambda b: total(F.slice(n, F.shiftleft(b, 6) + 1, F.lit(64))))
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("at"))
        firsts = F.aggregate(blocks, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["at"], a["sum"]).alias("at")))["at"]
        return _let(firsts, lambda at: F.transform(n, lambda _, i: at[F.shiftright(i, 6)] + total(F.slice(n, i - i % 64 + 1, i % 64))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(_let(lengths, before))


def pieces(df: DataFrame, column: str, max_chars: int, overlap_chars: int, least_pieces: int = 1) -> DataFrame:
    """One row per piece: the other columns, piece_no (from 1), n_pieces, start (character offset), piece.

    Pieces have at most ``max_chars`` Unicode characters; each but the first begins with
    the last ``overlap_chars`` characters before it (fewer only if twice the overlap
    exceeds the limit and the piece before is shorter). Null and empty texts give no row; repeated
    rows stay; columns named like the outputs are replaced. ``column`` itself is not repeated on
    its pieces, so a text of any length takes memory in proportion to it. ``least_pieces=2`` leaves
    out texts within the limit.
    """
    outputs = ("piece_no", "n_pieces", "start", "piece")
    keep = [c for c in df.columns if c not in (*outputs, column)]
    text = F.col(column).cast("string")
    wanted = text.isNotNull() & (text != "")
    if least_pieces > 1:  # exactly the texts beyond the limit have more than one
        wanted &= F.length(text) > max_chars
    fresh = df.where(wanted).select(*keep, cut(text, max_chars, overlap_chars).alias("__cuts"))
    if least_pieces > 2:
        fresh = fresh.where(F.size("__cuts") >= least_pieces)

    def placed(cuts: Column) -> Column:
        last = lambda i: F.when(i > 0, F.substring(F.get(cuts, i - 1), -overlap_chars, overlap_chars)).otherwise("") if overlap_chars else F.lit("")
        return _let(
            offsets(F.transform(cuts, F.length)),
            lambda at: F.transform(cuts, lambda x, i: F.struct(F.size(cuts).alias("n_pieces"), (at[i] - F.length(last(i))).alias("start"), F.concat(last(i), x).alias("piece"))),
        )

    row = fresh.select(*keep, F.posexplode(_let(F.col("__cuts"), placed)).alias("__i", "__p"))
    return row.select(*keep, (F.col("__i") + 1).alias("piece_no"), "__p.n_pieces", "__p.start", "__p.piece")


def oversized(df: DataFrame, column: str, max_chars: int, overlap_chars: int) -> DataFrame:
    """Rows of ``df`` whose text has to be cut into more than one piece, with n_pieces."""
    text = F.col(column).cast("string")
    count = F.size(cut(text, max_chars, overlap_chars))
    return df.where(text.isNotNull()).withColumn("n_pieces", count).where("n_pieces > 1")
