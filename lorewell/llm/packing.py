"""Items of varying length into containers of fixed capacity.

An item above the capacity is cut into full containers and a rest; no other item is cut. The rests and the other items
are counted by exact length (never more than ``capacity`` counts, whatever the data). Over this histogram the
configuration linear program

    minimise sum of x_p  over patterns p,  so that  sum of a_lp x_p >= n_l  for every length l

is solved by multiplicative weights: every length has a weight, the best pattern for the weights is priced by dynamic
programming over the capacity (a bounded knapsack), the pattern is used as often as moves its most covered length by a
set part, and covered lengths lose weight. A length that is
covered takes no more part, so every length is covered exactly once. Uses are rounded so that their running sum stays
what it is; what that leaves is a histogram again and is solved in the same way. As soon as rounding carries little, a
pattern is priced for each of the last containers. So every item lies in a priced pattern, and the number of prices
depends on the lengths and patterns, not on the items. The first weights bound the program from below (``Plan.bound``).

The histograms of all capacities are solved side by side, each in a task of its own; the driver sees none of them.
Each item finds its container by its rank among the items of its length.

Defined results: items of length 0 (null or empty text) need no room and get no container; ties in length are ranked
by a seeded hash; an empty table gives no containers; a capacity below 1 is an error.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.tokens import TOKENIZER, ranged, token_count
from lorewell.session import written

STEP = 1.0  # the share of its most covered length's items that a pattern takes at once
RATE = 0.3  # how fast covered lengths lose weight
LONGEST = 0.2  # how much more a token of a longer item counts, so that short ones are kept for the gaps
CORE, NEAR = 3, 2e-2  # a price is found among the lengths that fill CORE containers, if it is within NEAR of the bound
PART = 4  # solving ends when rounding carries less than this part of what is left


@dataclass
class Plan:
    """Patterns ((length, times), ...) with how often each is used, in order of container number.

    ``bound``: no packing has fewer containers; ``rounded``: how many items the rounded solutions carry."""

    patterns: list[tuple[tuple[tuple[int, int], ...], int]]
    bound: float = 0.0
    rounded: int = 0

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.patterns)


def _filled(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The most valuable pattern within the capacity, by bounded-knapsack dynamic programming: value, times by index."""
    best = np.zeros(capacity + 1)
    bundles = []
    for j in range(len(lengths)):
        length, left, size = int(lengths[j]), min(int(most[j]), capacity // int(lengths[j])), 1
        while left > 0:
            k = min(size, left)
            w = k * length
            trial = best[: capacity + 1 - w] + k * values[j]
            better = trial > best[w:]
            np.maximum(best[w:], trial, out=best[w:])
            bundles.append((j, k, w, better))
            left -= k
            size *= 2
    c, out = capacity, {}
    for j, k, w, better in reversed(bundles):
        if c >= w and better[c - w]:
            out[j] = out.get(j, 0) + k
            c -= w
    return float(best[capacity]), out


def _priced(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The best pattern (indices, times) and an upper bound of all patterns' values.

    The lengths of the highest value by token are tried first; their pattern is taken if it reaches the fractional
    knapsack's bound but for ``NEAR``, else all lengths are tried.
    """
    usable = np.flatnonzero((most > 0) & (lengths <= capacity))
    order = usable[np.argsort(-(values[usable] / lengths[usable]), kind="stable")]
    room = np.minimum(most[order], capacity // lengths[order]) * lengths[order]
    filled = np.cumsum(room)
    whole = int(np.searchsorted(filled, capacity, side="right"))
    bound = float((values[order[:whole]] * (room[:whole] // lengths[order[:whole]])).sum())
    if whole < len(order):
        bound += float(values[order[whole]] / lengths[order[whole]]) * (capacity - (int(filled[whole - 1]) if whole else 0))
    wide = CORE
    while True:
        core = order[: int(np.searchsorted(filled, wide * capacity)) + 12]
        value, times = _filled(lengths[core], values[core], most[core], capacity)
        if len(core) == len(order):
            bound = value
        if value >= bound * (1 - NEAR):
            break
        wide *= 4
    at = np.array(sorted(times), dtype=np.int64)
    return core[at], np.array([times[int(j)] for j in at], dtype=np.int64), bound


def _solved(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, float]:
    """Patterns, how often each is used (fractions that cover every length once), and a lower bound."""
    share, cover = lengths / capacity, np.zeros(len(lengths))
    patterns, uses = [], []
    least = float((lengths * counts).sum()) / capacity
    while (open_ := cover < 1).any():
        values = share * (1 + LONGEST * share) * np.exp(-RATE * (cover - cover[open_].min()))
        at, times, bound = _priced(lengths, values, np.where(open_, counts, 0), capacity)
        if not patterns:
            least = max(least, float((counts * values).sum()) / bound)
        gain = times / counts[at]
        # the most covered length moves by a step, and none beyond its items
        use = min(step / float(gain.max()), float(((1 - cover[at]) / gain).min()))
        patterns.append((at, times))
        uses.append(use)
        cover[at] += use * gain
        cover[cover > 1 - 1e-9] = 1.0
    return patterns, np.array(uses), least


def plan(histogram: dict[int, int], capacity: int, step: float = STEP) -> Plan:
    """Patterns for items counted by length (1..capacity)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    if not histogram:
        return Plan([])
    every = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in every], dtype=np.int64)
    total = int(left.sum())
    out: Counter = Counter()
    least = 0.0

    def take(at: np.ndarray, times: np.ndarray, n: int) -> None:
        if n > 0:
            left[at] -= n * times
            out[tuple(zip(every[at].tolist(), times.tolist()))] += n

    # solutions of what is left, as long as rounding them carries a part of it
    while left.any():
        there = np.flatnonzero(left)
        patterns, uses, bound = _solved(every[there], left[there], capacity, step)
        least = max(least, bound)
        before, done = int(left.sum()), 0.0
        # uses are rounded so that their sum stays what it is: a pattern that is used a third of a time is used once in three
        for k in np.argsort(-uses, kind="stable"):
            at, times = there[patterns[k][0]], patterns[k][1]
            n = int(done + float(uses[k]) + 0.5) - int(done + 0.5)
            done += float(uses[k])
            take(at, times, min(n, int((left[at] // times).min())))
        if (before - int(left.sum())) * PART < before:
            break
    rounded = total - int(left.sum())
    # what rounding leaves: a pattern for each price, the longest items first
    while left.any():
        there = np.flatnonzero(left)
        lengths = every[there]
        share = lengths / capacity
        at, times, _ = _priced(lengths, share * (1 + LONGEST * share), left[there], capacity)
        take(there[at], times, int((left[there[at]] // times).min()))
    return Plan(sorted(out.items(), key=lambda x: (-x[1], x[0])), least, rounded)


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens)."""
    return documents.select("doc_id", token_count(F.col("text"), tokenizer).alias("tokens"))


SLOTS = "spec int, capacity bigint, rest bigint, starts array<bigint>, bases array<bigint>, times array<bigint>, containers bigint, bound double, items bigint, rounded bigint"


def solved(histograms: DataFrame, tasks: int, step: float = STEP) -> DataFrame:
    """From (spec, capacity, rest, n): of every length from which rank on which containers take it (``starts``,
    ``bases``) and how many each (``times``); and of the whole spec its containers and bound. A spec's histogram has fewer than ``capacity`` rows."""

    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        capacity, counts = int(rows["capacity"].iloc[0]), {int(x): int(n) for x, n in zip(rows["rest"], rows["n"])}
        found = plan(counts, capacity, step)
        table: dict[int, list[tuple[int, int, int]]] = {}
        seen: dict[int, int] = {}
        base = 0
        for pattern, n in found.patterns:
            for length, a in pattern:
                table.setdefault(length, []).append((seen.get(length, 0), base, a))
                seen[length] = seen.get(length, 0) + n * a
            base += n
        whole = (base, found.bound, sum(counts.values()), found.rounded)
        out = [(rows["spec"].iloc[0], capacity, length, *map(list, zip(*x)), *whole) for length, x in table.items()]
        return pd.DataFrame(out, columns=[x.split()[0] for x in SLOTS.split(", ")])

    return histograms.repartition(tasks, "spec").groupBy("spec", "capacity").applyInPandas(apply, SLOTS)


def _requests(specs: DataFrame) -> list[tuple[str, int]]:
    found = sorted({(r["spec_name"], int(r["capacity_tokens"])) for r in specs.select("spec_name", "capacity_tokens").where("capacity_tokens IS NOT NULL").collect()}, key=str)  # requests
    if any(capacity < 1 for _, capacity in found):
        raise ValueError("capacity must be positive")
    return found


def _name(requests: list[tuple[str, int]]):
    return F.get(F.array(*[F.lit(name).cast("string") for name, _ in requests]), F.col("spec")).alias("spec_name")


PACKED = "spec_name string, container_id bigint, doc_id bigint, piece bigint, start_token bigint, tokens bigint"


def planned(sizes: DataFrame, requests: list[tuple[str, int]]) -> tuple[DataFrame, DataFrame]:
    """(items, slots): every item once for each spec with its full containers and rest, and the specs' solutions."""
    wanted = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(capacity).cast("bigint").alias("capacity")) for i, (_, capacity) in enumerate(requests)])
    items = sizes.where("tokens > 0").select("doc_id", "tokens", F.explode(wanted).alias("s")).select("s.*", "doc_id", F.floor(F.col("tokens") / F.col("s.capacity")).cast("bigint").alias("full"), (F.col("tokens") % F.col("s.capacity")).alias("rest"))
    histograms = items.where("rest > 0").groupBy("spec", "capacity", "rest").agg(F.count("*").alias("n"))
    return items, written(solved(histograms, 2 * len(requests)), "slots")


def packed(sizes: DataFrame, requests: list[tuple[str, int]], seed: int = 0) -> DataFrame:
    """(spec_name, container_id, doc_id, piece, start_token, tokens): where every piece of every item lies."""
    if not requests:
        return sizes.sparkSession.createDataFrame([], PACKED)
    items, slots = planned(sizes, requests)
    largest, documents = items.groupBy("spec", "capacity", "rest").count().agg(F.max("count"), F.sum("count")).first()
    spec = ["spec", "capacity"]
    rests = ranged(items.where("rest > 0").select(*spec, "rest", "doc_id", "full"), [*spec, "rest"], F.xxhash64("doc_id", F.lit(seed)), largest or 0)
    rests = rests.join(slots.drop("containers"), [*spec, "rest"]).withColumn("k", F.expr("size(filter(starts, s -> s <= rank)) - 1"))
    place = F.expr("bases[k] + (rank - starts[k]) div times[k]")
    rests = rests.select("spec", place.alias("container_id"), "doc_id", F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("start_token"), F.col("rest").alias("tokens"))
    # full containers are numbered behind the others: the numbers of a document's pieces follow each other
    before = ranged(items.where("full > 0").select(*spec, "doc_id", "full"), spec, F.xxhash64("doc_id", F.lit(seed)), (documents or 0) // len(requests), F.col("full"), "before")
    fulls = before.join(slots.groupBy(*spec).agg(F.max("containers").alias("containers")), spec, "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    fulls = fulls.select("spec", (F.coalesce("containers", F.lit(0)) + F.col("before") + F.col("piece")).alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("tokens"))
    return rests.unionByName(fulls).select(_name(requests), "container_id", "doc_id", "piece", "start_token", "tokens")


def pack(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """Every spec's containers. ``specs``: spec_name, capacity_tokens (a small table of requests; a null capacity is none)."""
    return packed(written(sized(documents, tokenizer), "sizes"), _requests(specs), seed)


def bounds(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(spec_name, capacity_tokens, items, rounded, containers, bound) of the rests: how many items the first rounded
    solution carries, the containers used, and below how many no packing can come."""
    requests = _requests(specs)
    schema = "spec_name string, capacity_tokens bigint, items bigint, rounded bigint, containers bigint, bound double"
    if not requests:
        return documents.sparkSession.createDataFrame([], schema)
    _, slots = planned(written(sized(documents, tokenizer), "sizes"), requests)
    return slots.select(_name(requests), F.col("capacity").alias("capacity_tokens"), "items", "rounded", "containers", "bound").distinct()
