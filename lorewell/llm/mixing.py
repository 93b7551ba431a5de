"""Records of several sources mixed to target shares of the total size.

A mix's total is the largest at which every source that has documents can reach its share without a document being
used more than ``max_repeats`` times (or a total given as a parameter; then shares that can't be reached stay short).
A source's budget is filled by whole rounds of all its documents first. The remaining budget is a subset-sum problem
over the counts of documents by exact token length: each length gives its proportional part, and what is then missing
is fitted by bounded-knapsack dynamic programming over the counts that are left. The documents of each length are then
selected by the rank of a seeded hash. Each source of each mix is fitted in a task of its own from its counts by length;
the driver sees a row for each source.

Defined results: documents of length 0 and those of sources that no mix names (or of null source) are not drawn; a
source without documents has share 0 and the others keep their budgets; where no subset meets a budget to the token,
the largest sum below it is taken; ties are ranked by the hash; a null source, share or
number of repeats in a request draws nothing; an empty table gives an empty draw.
"""

from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.tokens import TOKENIZER, ranged, token_count
from lorewell.session import written


def fitted(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length sum up to ``budget``, or to the largest sum below it that is found."""
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or not counts:
        return {}
    if budget >= total:
        return dict(counts)
    longest = max(counts)
    # the proportional part of every length, with room left for the exact fit
    part = max(0.0, (budget - 4 * longest) / total)
    taken = {n: int(c * part) for n, c in counts.items()}
    left = budget - sum(n * k for n, k in taken.items())
    for n in sorted(counts, key=lambda n: (-(counts[n] * part) % 1, -n)):  # by the largest part cut off
        if left > 4 * longest and taken[n] < counts[n] and counts[n] * part > taken[n]:
            taken[n] += 1
            left -= n
    for n in sorted(counts, reverse=True):
        more = min(counts[n] - taken[n], max(0, (left - 4 * longest) // n))
        taken[n] += more
        left -= more * n
    # bounded knapsack over what is left: reachable sums as bits, a step for each bundle of one length
    bundles = []
    for n in sorted(counts):
        spare, size = min(counts[n] - taken[n], left // n), 1
        while spare > 0:
            bundles.append((n, min(size, spare)))
            spare -= bundles[-1][1]
            size *= 2
    for n, k in _chosen(bundles, left):
        taken[n] += k
    return {n: k for n, k in taken.items() if k}


def _chosen(bundles: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The bundles (length, times) whose sum is the largest that fits.

    Sums that can be reached are bits. They are kept before every ``stride``-th bundle only and computed again from
    there on the way back, so memory grows with the square root of the number of bundles.
    """
    mask, stride = (1 << (room + 1)) - 1, isqrt(len(bundles)) + 1
    kept, reach = [], 1
    for i, (n, k) in enumerate(bundles):
        if i % stride == 0:
            kept.append(reach)
        reach |= (reach << (n * k)) & mask
    at, out = reach.bit_length() - 1, []
    for j in range(len(kept) - 1, -1, -1):
        own = bundles[j * stride : (j + 1) * stride]
        rows = [kept[j]]
        for n, k in own[:-1]:
            rows.append(rows[-1] | (rows[-1] << (n * k)) & mask)
        for (n, k), before in zip(reversed(own), reversed(rows)):
            if not before >> at & 1:
                out.append((n, k))
                at -= n * k
    return out


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, doc_id, tokens, copies) of all documents drawn.

    ``targets``: mix_name, source, target_share, max_repeats (a small table of requests).
    """
    spark = documents.sparkSession
    wanted = [r.asDict() for r in targets.select("mix_name", "source", "target_share", "max_repeats").collect()]  # requests
    named = F.broadcast(spark.createDataFrame([(x,) for x in sorted({r["source"] for r in wanted if r["source"] is not None})], "source string"))
    sizes = documents.join(named, "source", "left_semi").select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("tokens"))
    sizes = written(sizes, "sizes").where("tokens > 0")
    lengths = written(sizes.groupBy("source", "tokens").agg(F.count("*").alias("n")), "lengths")
    totals, largest = {}, 0
    for source, n, most in lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")), F.max("n")).collect():  # a row for each source named
        totals[source], largest = int(n), max(largest, int(most))
    rounds, budgets = [], []
    for mix in sorted({r["mix_name"] for r in wanted}, key=str):
        own = [r for r in wanted if r["mix_name"] == mix and totals.get(r["source"]) and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
        if not own:
            continue
        whole = total_tokens or min(r["max_repeats"] * totals[r["source"]] / r["target_share"] for r in own)
        for r in own:
            s = r["source"]
            budget = min(round(r["target_share"] * whole), r["max_repeats"] * totals[s])
            times = min(budget // totals[s], r["max_repeats"])
            rounds.append((len(rounds), mix, s, int(times)))
            if times < r["max_repeats"]:
                budgets.append((rounds[-1][0], s, int(budget - times * totals[s])))
    if not rounds:
        return spark.createDataFrame([], "mix_name string, source string, doc_id bigint, tokens bigint, copies bigint")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        got = fitted({int(n): int(c) for n, c in zip(rows["tokens"], rows["n"])}, int(rows["budget"].iloc[0]))
        return pd.DataFrame({"part": rows["part"].iloc[0], "tokens": list(got), "taken": list(got.values())}).astype({"part": "int32", "tokens": "int64", "taken": "int64"})

    asked = F.broadcast(spark.createDataFrame(budgets, "part int, source string, budget bigint"))
    # one task for each part: its rows are the source's lengths, not its documents
    taken = lengths.join(asked, "source").repartition(max(1, len(budgets)), "part").groupBy("part").applyInPandas(fit, "part int, tokens bigint, taken bigint")
    taken = written(taken, "taken")
    order = ranged(sizes, ["source", "tokens"], F.xxhash64("doc_id", F.lit(seed)), largest)
    drawn = order.join(F.broadcast(spark.createDataFrame(rounds, "part int, mix_name string, source string, times bigint")), "source")
    drawn = drawn.join(taken, ["part", "tokens"], "left")
    copies = F.col("times") + F.when(F.col("rank") < F.coalesce("taken", F.lit(0)), 1).otherwise(0)
    return drawn.select("mix_name", "source", "doc_id", "tokens", copies.cast("bigint").alias("copies")).where("copies > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """What every source of every mix really has: tokens, documents, the most copies, and the share of the mix."""
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("whole"))
    rows = targets.select("mix_name", "source", "target_share", "max_repeats").join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("mix_name", "source", "target_share", "max_repeats", zero("tokens"), zero("documents"), zero("most_copies"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"))
