"""Mixing sources to target weights: Pfair scheduling, in DataFrame functions.

A source's text is cut into blocks of equal size. Block j of a source with c of D shares is
released in slot floor(jD/c) and due by slot ceil((j+1)D/c); in each slot the released block
that is due first runs. A source then never is a whole block ahead of or behind its weight.
The schedule of one period of D slots says where every block goes; when a source runs out, a
new period starts with the shares of the others. Only the sources' totals leave the cluster.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, table

BLOCK = 1 << 16  # characters
#: Example weights: the hot source of the test tables first, the others in four tiers.
SHARES = {"src0": 8, **{f"src{i}": 1 + i % 4 for i in range(1, 20)}}


def period(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period of sum(shares) slots, earliest deadline first."""
    d = sum(shares.values())
    releases: list[list[tuple[int, str, int]]] = [[] for _ in range(d)]
    for s, c in shares.items():
        for j in range(c):
            releases[j * d // c].append((-(-(j + 1) * d // c), s, j))
    due: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in shares}
    for slot in range(d):
        for r in releases[slot]:
            heapq.heappush(due, r)
        if due:
            out[heapq.heappop(due)[1]].append(slot)
    return out


def schedule(totals: dict[str, int], shares: dict[str, int], default: int = 1) -> list[tuple]:
    """(source, first, past, shares, period, start, slots): blocks first <= j < past of the source
    run in slot start + (j - first) // shares * period + slots[(j - first) % shares]."""
    done = dict.fromkeys(totals, 0)
    start, out = 0, []
    while active := sorted(s for s in totals if done[s] < totals[s]):
        weights = {s: shares.get(s, default) for s in active}
        d, slots = sum(weights.values()), period(weights)
        left = {s: totals[s] - done[s] for s in active}
        # The first source to run out ends the phase, after the slot of its last block.
        length = min((left[s] - 1) // weights[s] * d + slots[s][(left[s] - 1) % weights[s]] + 1 for s in active)
        for s in active:
            n = length // d * weights[s] + sum(x < length % d for x in slots[s])
            if n:
                out.append((s, done[s], done[s] + n, weights[s], d, start, slots[s]))
                done[s] += n
        start += length
    return out


def mix(docs: DataFrame, shares: dict[str, int] | None = None, block: int = BLOCK, default: int = 1) -> DataFrame:
    """docs with block, slot and place: every row once, in the order (slot, place).

    A source's rows are taken in a fixed shuffle (a hash of doc_id and text); a row lies in the
    block in which its first character falls and place is that character's number in the
    block, so a row longer than a block leaves the next ones empty. Sources without a weight
    get `default` shares; null sources are a source of their own. Null texts count as
    empty, and every text as one more character. Equal rows are placed one after another.
    """
    shares = shares or SHARES
    if min([default, *shares.values()]) < 1:
        raise ValueError("shares are positive whole numbers")
    named = docs.withColumns({"__mix_source": F.coalesce(F.col("source").cast("string"), F.lit("\0null")), "__mix_size": F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1, "__mix_hash": F.xxhash64("text")})
    placed = running(named, ["__mix_source"], ["doc_id", "__mix_hash"], "__mix_size", "__mix_at")
    totals = {r["__mix_source"]: -(-r["n"] // block) for r in named.groupBy("__mix_source").agg(F.sum("__mix_size").alias("n")).collect()}
    rows = schedule(totals, shares, default)
    # One row per source, with its phases: at most the square of the number of sources in all.
    phases: dict[str, list[tuple]] = {s: [] for s in totals}
    for s, *phase in rows:
        phases[s].append(tuple(phase))
    plan = docs.sparkSession.createDataFrame(list(phases.items()), "__mix_source string, __mix_phases array<struct<first:long,past:long,shares:long,period:long,start:long,slots:array<long>>>")
    found = placed.withColumn("block", F.floor(F.col("__mix_at") / F.lit(block))).join(F.broadcast(plan) if len(rows) <= 4096 else plan, "__mix_source")
    found = found.withColumn("__mix_phase", F.get(F.filter("__mix_phases", lambda p: (F.col("block") >= p.first) & (F.col("block") < p.past)), 0))
    phase = lambda name: F.col(f"__mix_phase.{name}")
    j = F.col("block") - phase("first")
    slot = phase("start") + F.floor(j / phase("shares")) * phase("period") + F.element_at(phase("slots"), (j % phase("shares") + 1).cast("int"))
    found = found.withColumn("slot", slot.cast("long")).withColumn("place", (F.col("__mix_at") - F.col("block") * block).cast("long"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("block", "slot", "place")], "block", "slot", "place")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", F.length("text").cast("long").alias("chars"), "block", "slot", "place")


