"""Mixing sources to target weights (problem 9): subset-sum fitting of token budgets.

Documents are counted by exact token length per source; a bounded-knapsack dynamic programme picks how many of each
length fill what whole copies leave of a source's budget, and seeded hashing picks which documents those are.  In large
budgets most of each length is taken in proportion first, and the programme gets the rest; where that leaves a gap, it gets
more, up to the whole budget.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.skew import hot_aware_join
from loamline.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens left for the dynamic programme at first and at most (in units of the lengths' common divisor), and the bits of
#: reachable sums it holds at once.
WIDTH, WIDEST, HELD_BITS = 1 << 15, 1 << 26, 1 << 32
#: Documents of one source and length that one task may rank.
RANKED_AT_ONCE = 50_000
_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a rank file's bytes; built once per worker."""
    key = zlib.crc32(ranks)
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of whole texts, without the texts.  NULL texts and sources are left out.  The rank file
    (about 1 MB) is read by the driver and travels with the function."""
    ranks = Path(tokenizer).read_bytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(tokens, pa.int64())], names=["doc_id", "source", "tokens"])

    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return cut(docs.mapInArrow(count, "doc_id long, source string, tokens long"), "tokens")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum comes as near below ``budget`` as any choice can.

    Reachable sums are the bits of one integer; each length is added in powers of two up to its count.  The sums before
    some of the steps are kept and those between them made again to read the choice back."""
    take = [0] * len(lengths)
    fitting = [i for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]) if 0 < lengths[i] <= budget and counts[i] > 0]
    if not fitting:
        return take
    unit = math.gcd(*(lengths[i] for i in fitting))
    budget //= unit
    steps: list[tuple[int, int]] = []
    for i in fitting:
        left, part = min(counts[i], budget * unit // lengths[i]), 1
        while left > 0:
            steps.append((i, min(part, left)))
            left, part = left - steps[-1][1], part * 2
    mask, stride = (1 << (budget + 1)) - 1, max(1, -(-len(steps) * (budget + 1) // HELD_BITS))

    def after(reach: int, step: tuple[int, int]) -> int:
        return reach | (reach << (step[1] * lengths[step[0]] // unit)) & mask

    held, reach, done = [], 1, 0
    for n, step in enumerate(steps):
        if n % stride == 0:
            held.append(reach)
        reach, done = after(reach, step), n + 1
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for block in range((done - 1) // stride, -1, -1):
        part = steps[block * stride : min(done, (block + 1) * stride)]
        before = [held[block]]
        for step in part[:-1]:
            before.append(after(before[-1], step))
        for step, reached in zip(reversed(part), reversed(before), strict=True):
            if not reached >> at & 1:
                take[step[0]] += step[1]
                at -= step[1] * lengths[step[0]] // unit
    return take


def _core(lengths: list[int], counts: list[int], budget: int, width: int) -> list[int]:
    """A part of each length in proportion, as far as about ``width`` of the budget is left: so the sample keeps the lengths'
    distribution."""
    total, room = sum(x * n for x, n in zip(lengths, counts, strict=True)), max(0, budget - width)
    take = [n * room // total for n in counts]
    left = budget - sum(x * n for x, n in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: (-(counts[i] * room % total), -lengths[i]))
    for i in order:
        if left <= width:
            return take
        if take[i] < counts[i] and lengths[i] <= left - width:
            take[i], left = take[i] + 1, left - lengths[i]
    while left > 2 * width:  # longer documents don't fit any more: shorter ones, evenly
        fits = [i for i in order if take[i] < counts[i] and 0 < lengths[i] <= left - width]
        if not fits:
            break
        each = max(1, (left - width) // sum(lengths[i] for i in fits))
        for i in fits:
            k = max(0, min(each, counts[i] - take[i], (left - width) // lengths[i]))
            take[i], left = take[i] + k, left - k * lengths[i]
    return take


def fill(lengths: list[int], counts: list[int], budget: int, width: int = WIDTH) -> list[int]:
    """Numbers to take of each length so that they come as near below a budget as any choice can.

    Most is taken in proportion, the knapsack fills what is left.  If a gap remains, the knapsack gets eight times as much
    to choose from, until there is none or it has had the whole budget; only where more than WIDEST units of tokens
    are open and still don't close the gap, it stays."""
    if budget >= sum(x * n for x, n in zip(lengths, counts, strict=True)):
        return list(counts)
    best, gap = [0] * len(lengths), budget
    unit = math.gcd(*lengths) or 1
    while True:
        core = _core(lengths, counts, budget, width) if width < budget else [0] * len(lengths)
        left = budget - sum(x * n for x, n in zip(lengths, core, strict=True))
        if left // unit <= 2 * WIDEST:
            more = knapsack(lengths, [n - t for n, t in zip(counts, core, strict=True)], left)
            take = [t + m for t, m in zip(core, more, strict=True)]
            missed = budget - sum(x * n for x, n in zip(lengths, take, strict=True))
            if missed < gap:
                best, gap = take, missed
        if gap < unit or width >= budget or width // unit >= WIDEST:
            return best
        width *= 8


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies and extra documents by length for one source."""
    quota, repeats = int(pdf["quota"].iloc[0]), int(pdf["max_repeats"].iloc[0])
    pdf = pdf.sort_values("tokens")
    lengths, counts = pdf["tokens"].tolist(), pdf["n"].tolist()
    once = sum(x * n for x, n in zip(lengths, counts, strict=True))
    copies = min(repeats, quota // once) if once else 0
    extra = [0] * len(lengths) if copies >= repeats else fill(lengths, counts, quota - copies * once)
    return pd.DataFrame({"source": pdf["source"], "tokens": lengths, "n": counts, "copies": copies, "extra": extra})


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies) and its report by source.

    A source's budget is its target share of ``total_tokens`` (default: the tokens of all documents of the listed
    sources).  With ``balanced`` the total is the largest at which every source that has documents can meet its share among
    those sources, so no source that falls short makes the others' shares larger.  Every document of a source is used equally often as whole copies fit the budget, at most ``max_repeats``
    times; documents chosen by length and seeded hash are used once more.  Where all allowed repeats don't reach the
    budget (or a source has no documents) the report says so: ``met`` is false and ``tokens_mixed`` lower.  Documents
    without tokens, or of unlisted or NULL sources, are not used; repeated rows of a document count once; a target that
    is NULL or negative counts as 0, and max_repeats NULL as 1.  Equal hashes are ordered by doc_id.
    """
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.greatest(F.coalesce(F.nanvl("target_share", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    counted = token_counts(documents, tokenizer)
    histogram = cut(counted.where("tokens > 0").select("doc_id", "source", "tokens").distinct().groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).join(listed, "source"), "lengths")
    if balanced:
        held = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).where("share > 0")
        whole = held.agg(F.sum("share").alias("share")).first().share or 1.0
        listed = listed.join(held.select("source", F.lit(True).alias("held")), "source", "left").withColumn("target_share", F.when(F.col("held"), F.col("target_share") / whole).otherwise(0.0)).drop("held")
        histogram = histogram.withColumn("target_share", F.col("target_share") / whole)
        total_tokens = int((held.agg(F.min(F.col("tokens") * F.col("repeats") / F.col("share"))).first()[0] or 0.0) * whole)
    if total_tokens is None:
        total_tokens = histogram.agg(F.sum(F.col("n") * F.col("tokens"))).first()[0] or 0
    quota = F.floor(F.col("target_share") * F.lit(total_tokens) + F.lit(1e-6)).cast("long")
    # a source's histogram has one row per distinct length, however many documents there are
    plan = cut(histogram.withColumn("quota", quota).groupBy("source").applyInPandas(_plan, "source string, tokens long, n long, copies int, extra long"), "mix-plan")
    rows = hot_aware_join(counted.distinct(), plan.withColumn("weight", F.col("n")), ["source", "tokens"], "weight")
    spread = F.ceil(F.col("n") / F.lit(RANKED_AT_ONCE))
    rows = rows.withColumn("dice", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.col("dice"), spread))
    group = ["source", "tokens", "bucket"]
    sizes = rows.where(F.col("extra") > 0).groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.max("extra").alias("wanted"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = sizes.withColumn("take", F.greatest(F.least(F.col("wanted") - before, F.col("size")), F.lit(0))).select(*group, "take")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("dice", "doc_id"))  # at most about RANKED_AT_ONCE rows
    chosen = rows.join(shares, group, "left").withColumn("more", F.when(F.col("take").isNull(), 0).otherwise(F.when(rank <= F.col("take"), 1).otherwise(0)))
    mixed = chosen.select("doc_id", "source", "tokens", (F.col("copies") + F.col("more")).cast("int").alias("copies")).where("copies > 0")
    by_source = plan.groupBy("source").agg(
        F.sum(F.col("n") * F.col("tokens")).alias("tokens_available"), F.sum((F.col("copies") * F.col("n") + F.col("extra")) * F.col("tokens")).alias("tokens_mixed"), F.max(F.col("copies") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("most_used")
    )
    report = listed.join(by_source, "source", "left").fillna(0, ["tokens_available", "tokens_mixed", "most_used"]).withColumn("tokens_wanted", quota)
    everything = Window.partitionBy()  # one row per listed source
    return mixed, report.select(
        "source", "target_share", "max_repeats", "tokens_available", "tokens_wanted", "tokens_mixed", F.col("most_used").cast("int").alias("most_used"),
        F.round(F.col("tokens_mixed") / F.greatest(F.sum("tokens_mixed").over(everything), F.lit(1)), 6).alias("actual_share"),
        (F.col("tokens_mixed") >= F.col("tokens_wanted") * 0.999).alias("met"),
    )
