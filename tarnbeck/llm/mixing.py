"""Mixing sources to target shares of all tokens, by Pfair scheduling.

Each source's documents, in an order drawn by hash, form a stream that is cut into
half blocks of tokens, one for each slot of the mixture. Slots are dealt out in frames.
At the end of a frame a source with weight w has its floor(w*T) half blocks of T slots
in all, and those whose next deadline is earliest have one more: exact integers, so
nothing drifts, however long the mixture is. Within a frame the k-th of a source's n
half blocks has the release time floor(k*F/n) and the deadline ceil((k+1)*F/n), and
earliest deadline first over the released ones fills the slots. Either step is less than a half
block off, so a source is less than one block off its share at every moment.

The driver keeps two numbers for each source and frame; the frames are scheduled by
the executors. Positions within a source come from sums over (source, hash range) cells, at most
BUCKETS for each source, so a source with a third of all rows is spread over as many
tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.llm.bpe import encode
from tarnbeck.session import materialize

#: Slots of a frame: what one task schedules at a time.
FRAME = 100_000
BUCKETS = 4096
BLOCK_TOKENS = 8192
#: More sources than this are refused: the targets are held by the driver, with two numbers for each frame.
MAX_SOURCES = 10_000


def whole_weights(shares: dict[str, float]) -> dict[str, int]:
    """The shares as whole numbers in exactly the same proportion, as they are written (0.1 is a tenth)."""
    exact = {s: Fraction(str(w)) for s, w in shares.items()}
    unit = lcm(*(f.denominator for f in exact.values()))
    return {s: int(f * unit) for s, f in exact.items()}


def frames(weights: dict[str, int], slots: int, frame: int = FRAME) -> list[dict[str, tuple[int, int]]]:
    """For each frame up to ``slots``, each source's first half block and how many it has.

    After every frame each source is less than one off its share of all slots so far,
    and the counts add up to the slots. A source that is ahead stays so until its share has
    caught up; among the others the earliest deadline goes first, which leaves every later
    deadline within reach.
    """
    whole, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for end in range(frame, slots + frame, frame):
        new = {s: max(done[s], n * end // whole) for s, n in weights.items()}
        due = sorted((-(-(new[s] + 1) * whole // n), s) for s, n in weights.items() if new[s] * whole < n * end)
        for _, s in due[: end - sum(new.values())]:
            new[s] += 1
        out.append({s: (done[s], new[s] - done[s]) for s in weights})
        done = new
    return out


def pfair(counts: dict[str, int], wanted: dict[str, int] | None = None) -> list[str]:
    """The source of each slot of a frame: earliest deadline first among the released.

    Stops early once each source has what is ``wanted`` of it.
    """
    period = sum(counts.values())
    left = {s: n for s, n in (counts if wanted is None else wanted).items() if n > 0}
    coming = [(0, s, 0) for s in sorted(counts) if counts[s]]  # release, source, half block
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(period):
        if not left:
            break
        while coming and coming[0][0] <= t:
            _, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(k + 1) * period // counts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if left.get(s) == k + 1:
            del left[s]
        if k + 1 < counts[s]:
            heapq.heappush(coming, ((k + 1) * period // counts[s], s, k + 1))
    return out


def _scheduled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            seen = dict(zip(r["source"], r["first"]))
            sources, blocks = pfair(dict(zip(r["source"], r["count"])), dict(zip(r["source"], r["wanted"]))), []
            for s in sources:
                blocks.append(seen[s])
                seen[s] += 1
            slots = range(r["start"], r["start"] + len(sources))
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(blocks, pa.int64()), pa.array(slots, pa.int64())], names=["source", "block", "slot"])


@dataclass
class Mixture:
    """rows: the uses of documents, to be read in order of (slot, start, doc_id); shares: the report by source."""

    rows: DataFrame
    shares: DataFrame


def mix(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, slots: int = FRAME, seed: int = 0) -> Mixture:
    """The longest mixture in which every source holds its share.

    sized: doc_id, source, n_tokens (documents without tokens are left out; repeated doc_ids are documents of their own).
    targets: source, target_share, max_repeats; repeated sources take their first row by share, null or
    non-positive shares and repeats and null sources are left out. A target source without tokens is reported with none,
    and its share falls to the others in proportion; corpus sources without a target
    are not used. The length is that at which the first source has used each document
    ``max_repeats`` times. rows: doc_id, source, n_tokens, repeat (from 0), start (tokens of the source
    before it), slot (of half a block; ``slots`` of them are a frame). shares: source, target_share, aimed_share, max_repeats, available_tokens, mixed_tokens, actual_share, n_uses,
    most_repeats.
    """
    spark = sized.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    wanted = {}
    for r in sorted((r for r in rows if r[0] is not None and (r[1] or 0) > 0 and (r[2] or 0) > 0), key=lambda r: (r[0], -r[1], r[2])):
        wanted.setdefault(r[0], (float(r[1]), int(r[2])))
    known = spark.createDataFrame([(s, w, m) for s, (w, m) in wanted.items()], "source string, target_share double, max_repeats int")
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    docs = sized.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0").join(F.broadcast(known.select("source")), "source")
    docs = docs.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    docs = materialize(docs, "sized")
    cells = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("cell_tokens"))
    available = {r["source"]: r["n"] for r in cells.groupBy("source").agg(F.sum("cell_tokens").alias("n")).collect()}
    weights = whole_weights({s: wanted[s][0] for s in available})
    whole, half = sum(weights.values()), max(1, block_tokens // 2)
    length = min((Fraction(available[s] * wanted[s][1] * whole, n) for s, n in weights.items()), default=Fraction(0))
    quotas = {s: length * n // whole for s, n in weights.items()}
    blocks = {s: -(-q // half) for s, q in quotas.items()}
    last = max((-(-blocks[s] * whole // n) for s, n in weights.items()), default=0)  # the slot by which every block has met its deadline
    plan = []
    for i, counts in enumerate(frames(weights, last, slots)):
        names = sorted(counts)
        plan.append((i * slots, names, [counts[s][0] for s in names], [counts[s][1] for s in names], [min(counts[s][1], max(0, blocks[s] - counts[s][0])) for s in names]))
    schedule = spark.createDataFrame(plan, "start long, source array<string>, first array<long>, count array<long>, wanted array<long>")
    schedule = schedule.mapInArrow(_scheduled, "source string, block long, slot long")
    quota = spark.createDataFrame(
        [(s, n / whole, available[s], quotas[s]) for s, n in weights.items()],
        "source string, aimed_share double, available_tokens long, quota long",
    )
    before = cells.withColumn("before", F.sum("cell_tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before.select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["source", "bucket"])
    placed = placed.withColumn("offset", F.col("before") + F.col("inside")).join(F.broadcast(quota), "source").where("offset < quota")
    uses = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1 - offset) div available_tokens")))).withColumn("start", F.expr("repeat * available_tokens + offset"))
    uses = uses.withColumn("block", F.expr(f"start div {half}")).join(schedule, ["source", "block"])
    uses = uses.select("doc_id", "source", "n_tokens", F.col("repeat").cast("int").alias("repeat"), "start", "slot")
    mixed = uses.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("n_uses"), (F.max("repeat") + 1).alias("most_repeats"))
    report = known.join(F.broadcast(quota.drop("quota")), "source", "left").join(mixed, "source", "left")
    total = F.sum("mixed_tokens").over(Window.partitionBy())  # one row for each source
    report = report.withColumn("actual_share", F.coalesce(F.col("mixed_tokens"), F.lit(0)) / F.when(total > 0, total)).fillna(0, ["available_tokens", "mixed_tokens", "n_uses", "most_repeats", "aimed_share", "actual_share"])
    return Mixture(uses, report.select("source", "target_share", "aimed_share", "max_repeats", "available_tokens", "mixed_tokens", "actual_share", "n_uses", "most_repeats"))


def deviations(mixture: Mixture, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, deviation, allowed): the most tokens by which a source is off its aimed share at any moment of the mixture.

    A source is furthest off just before or just after one of its own slots, or at the end, so each slot is looked at
    once. ``allowed`` is one block, and what documents that are not cut can add to it: at most one document of the source itself, or the
    source's share of one of every other. Running sums go by cells of 4,096 slots, so no task sorts the whole mixture.
    """
    cell = F.expr("slot div 4096")
    slots = mixture.rows.groupBy("source", "slot").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest")).withColumn("cell", cell)
    cells = slots.groupBy("cell", "source").agg(F.sum("n").alias("n"))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    over = cells.groupBy("cell").agg(F.sum("n").alias("n")).select("cell", F.coalesce(F.sum("n").over(upto.orderBy("cell")), F.lit(0)).alias("all_before"))
    own = cells.select("cell", "source", F.coalesce(F.sum("n").over(upto.partitionBy("source").orderBy("cell")), F.lit(0)).alias("own_before"))
    at = slots.join(over, "cell").join(own, ["cell", "source"])
    inside = lambda *by: F.sum("n").over(Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    at = at.withColumn("all_after", F.col("all_before") + inside("cell")).withColumn("own_after", F.col("own_before") + inside("cell", "source"))
    known = mixture.shares.where("aimed_share > 0").select("source", "aimed_share", "mixed_tokens")
    off = lambda own, every: F.abs(F.col(own) - F.col("aimed_share") * F.col(every))
    at = at.withColumn("all_until", F.col("all_after") - F.col("n")).withColumn("own_until", F.col("own_after") - F.col("n")).join(F.broadcast(known), "source")
    most = at.groupBy("source").agg(F.max(F.greatest(off("own_after", "all_after"), off("own_until", "all_until"))).alias("most"), F.max("longest").alias("longest"))
    every = Window.partitionBy()  # one row for each source
    end = known.join(most, "source").withColumn("all", F.sum("mixed_tokens").over(every)).withColumn("longest_all", F.sum("longest").over(every))
    allowed = block_tokens + F.greatest(F.col("longest"), F.col("aimed_share") * (F.col("longest_all") - F.col("longest")))
    return end.select("source", F.greatest("most", off("mixed_tokens", "all")).alias("deviation"), allowed.alias("allowed"))


def mix_documents(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, **options: int) -> Mixture:
    """:func:`mix` of doc_id, source, text, sized in tokens of a public tokenizer."""
    return mix(encode(documents.select("doc_id", "source", "text"), "text", "n_tokens", vocabulary, count_only=True), targets, **options)
