"""Near-duplicate slide texts by SimHash and the generalised pigeonhole principle.

The bits of the fingerprints are parted into groups; bits that go together share a group. Two fingerprints
that differ in at most ``t`` bits must, for any thresholds of the groups that sum to ``t`` less the number of
groups plus one, differ in some group by at most its threshold. Each fingerprint gets thresholds of its
own: a dynamic program spends them where few candidates are expected. It then probes the index
of group values within these thresholds, and every candidate is verified.

Fingerprints that are linked to the least fingerprint of one of their index entries are joined beforehand, and
only fingerprints not yet joined are compared. A crowd of near copies thus never meets itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import give_back, packed, stored, unpacked
from deckloom.llm.components import least_nodes

#: Words of a shingle, and bits by which linked fingerprints may differ.
SHINGLE_WORDS, RADIUS = 4, 4
SEED = 42
#: Numbers of groups that are weighed against each other, and the largest threshold of a group.
GROUPS, WIDEST = (3, 4, 5), 2
#: Candidates that cost as much as one probe.
PROBE_COST = 20.0
#: Bytes of text handled at once.
SLICE_BYTES = 1 << 22
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, A-Z in lower case."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(len(found) - words + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(
        starts[:n].tolist(), ends[min(words, len(found)) - 1:].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes, the bits set in over half of them; zero for none."""
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.concatenate([hashes[i] for i in some])
    # Eight counters share a 64-bit number, so runs of at most 255 hashes are added up first.
    runs = [np.arange(0, sizes[i], 255) for i in some]
    first = np.cumsum(sizes[some]) - sizes[some]
    run_starts = np.concatenate([r + f for r, f in zip(runs, first, strict=True)])
    of_text = np.cumsum([0, *map(len, runs)])[:-1]
    bits = np.zeros(len(some), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat(flat >> np.uint64(shift) & _ONES, run_starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
        most = counts * 2 > sizes[some][:, None]
        bits |= (most.astype(np.uint64) << (np.arange(8) * 8 + shift).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    out[some] = bits
    return out


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """SimHash of a text as a bigint; null and wordless texts have zero."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found, held, size = [], [], 0
            for text in batch:
                held.append(shingle_hashes(text or "", words))
                size += len(text or "")
                if size >= SLICE_BYTES:
                    found.append(majority_bits(held))
                    held, size = [], 0
            found.append(majority_bits(held))
            yield pd.Series(np.concatenate(found).view(np.int64))
            give_back()

    return simhash(text)


def gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each value, as a small number."""
    out = np.zeros(len(values), np.int64)
    for place, bit in enumerate(bits):
        out |= (values >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << place
    return out


def group_bits(together: np.ndarray, groups: int) -> list[list[int]]:
    """Part 64 bits into groups of like size, the most correlated together."""
    left, out = set(range(64)), []
    for k in range(groups):
        size = 64 // groups + (k < 64 % groups)
        rest = sorted(left)
        square = together[np.ix_(rest, rest)]
        own = [rest[i] for i in np.unravel_index(np.argmax(square), square.shape)] if size < len(rest) else rest
        own = sorted(set(own))
        while len(own) < size:
            others = sorted(left - set(own))
            own.append(others[int(np.argmax(together[np.ix_(others, own)].sum(axis=1)))])
        out.append(sorted(own))
        left -= set(own)
    return out


def masks(width: int, distance: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), distance)], np.int64)


class Plan:
    """Groups of bits, and what a probe of each is expected to find."""

    def __init__(self, groups: list[list[int]], counts: list[tuple[np.ndarray, np.ndarray]], total: int, radius: int):
        self.groups, self.total, self.radius = groups, max(total, 1), radius
        self.thresholds = list(range(-1, WIDEST + 1))
        # By group and half: how many fingerprints lie at each distance of each value of that half.
        self.near = [[np.stack([sum(c[np.arange(len(c)) ^ m] for m in masks(len(c).bit_length() - 1, d))
                                if d < len(c).bit_length() else np.zeros(len(c)) for d in range(WIDEST + 1)])
                      for c in halves] for halves in counts]

    def costs(self, values: np.ndarray) -> np.ndarray:
        """Expected candidates and probes: fingerprint by group by threshold."""
        out = np.zeros((len(values), len(self.groups), len(self.thresholds)))
        for g, bits in enumerate(self.groups):
            low, high = split(bits)
            a, b = self.near[g][0][:, gather(values, low)], self.near[g][1][:, gather(values, high)]
            found = np.zeros(len(values))
            probes = 0
            for t in range(WIDEST + 1):
                found = found + sum(a[e] * b[t - e] for e in range(t + 1)) / self.total
                probes += comb(len(bits), t)
                out[:, g, t + 1] = found + PROBE_COST * probes
        return out

    def allot(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds of each fingerprint's groups that cost least, and that cost."""
        costs = self.costs(values)
        target = self.radius - len(self.groups) + 1
        sums = {0: (np.zeros(len(values)), np.zeros((len(values), 0), np.int64))}
        for g in range(len(self.groups)):
            after: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for so_far, (cost, chosen) in sums.items():
                for k, t in enumerate(self.thresholds):
                    own = cost + costs[:, g, k]
                    path = np.column_stack([chosen, np.full(len(values), t)])
                    if so_far + t not in after:
                        after[so_far + t] = (own, path)
                    else:
                        best, kept = after[so_far + t]
                        better = own < best
                        after[so_far + t] = (np.where(better, own, best), np.where(better[:, None], path, kept))
            sums = after
        cost, chosen = sums[target]
        return chosen, cost

    def entries(self, values: np.ndarray) -> np.ndarray:
        """Index keys of each fingerprint: one for each group."""
        return np.column_stack([gather(values, bits) | g << 32 for g, bits in enumerate(self.groups)])

    def probes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of fingerprints and the keys that they probe."""
        chosen, _ = self.allot(values)
        at, keys = [], []
        for g, bits in enumerate(self.groups):
            own = gather(values, bits)
            for t in range(WIDEST + 1):
                users = np.flatnonzero(chosen[:, g] >= t)
                flips = masks(len(bits), t)
                keys.append((own[users][:, None] ^ flips).ravel() | g << 32)
                at.append(np.repeat(users, len(flips)))
        return np.concatenate(at), np.concatenate(keys)


def split(bits: list[int]) -> tuple[list[int], list[int]]:
    return bits[:(len(bits) + 1) // 2], bits[(len(bits) + 1) // 2:]


def _tally(nodes: DataFrame, count, schema: str) -> list:
    """Sum up bounded counts that each partition makes of its fingerprints."""
    keys = [part.split()[0] for part in schema.split(", ")]
    return nodes.select("fp").mapInPandas(count, schema + ", n long").groupBy(*keys).agg(F.sum("n").alias("n")).collect()


def _bit_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((65, 65), np.int64)
    for frame in frames:
        values = frame["fp"].to_numpy(np.int64).view(np.uint64)
        bits = (values[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
        bits = np.column_stack([bits, np.ones(len(bits))])
        total += (bits.T @ bits).astype(np.int64)
    a, b = np.nonzero(total)
    yield pd.DataFrame({"a": a, "b": b, "n": total[a, b]})


def make_plan(nodes: DataFrame, radius: int) -> Plan:
    """Groups and expectations from counts over all fingerprints; the counts collected are bounded."""
    total = np.zeros((65, 65))
    for row in _tally(nodes, _bit_pairs, "a long, b long"):
        total[row["a"], row["b"]] = row["n"]
    n = total[64, 64]
    share = total[64, :64] / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    together = np.abs((total[:64, :64] / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(together, 0)
    ways = {m: group_bits(together, m) for m in GROUPS if m <= radius + 1}
    halves = [(m, g, h, bits) for m, groups in ways.items() for g, own in enumerate(groups) for h, bits in enumerate(split(own))]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(1 << len(bits), np.int64) for *_, bits in halves]
        for frame in frames:
            values = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for own, (*_, bits) in zip(sums, halves, strict=True):
                own += np.bincount(gather(values, bits), minlength=len(own))
        for own, (m, g, h, _) in zip(sums, halves, strict=True):
            some = np.flatnonzero(own)
            yield pd.DataFrame({"m": m, "g": g, "h": h, "value": some, "n": own[some]})

    counts = {(m, g, h): np.zeros(1 << len(bits)) for m, g, h, bits in halves}
    for row in _tally(nodes, count, "m long, g long, h long, value long"):
        counts[row["m"], row["g"], row["h"]][row["value"]] = row["n"]
    plans = [Plan(groups, [(counts[m, g, 0], counts[m, g, 1]) for g in range(m)], int(n), radius)
             for m, groups in ways.items()]

    def spend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(plans))
        for frame in frames:
            values = frame["fp"].to_numpy(np.int64).view(np.uint64)
            sums += [plan.allot(values)[1].sum() for plan in plans]
        yield pd.DataFrame({"k": range(len(plans)), "n": sums.astype(np.int64)})

    spent = {row["k"]: row["n"] for row in _tally(nodes, spend, "k long")}
    return plans[min(spent, key=lambda k: (spent[k], k), default=0)]


def roots_of(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root`` of distinct fingerprints (``fp``): the least fingerprint that links of at most ``radius`` bits reach."""
    plan = make_plan(nodes, radius)

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = plan.entries(frame["fp"].to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"fp": np.repeat(frame["fp"].to_numpy(), keys.shape[1]), "key": keys.ravel(),
                                "joined": np.repeat(frame["joined"].to_numpy(), keys.shape[1])})

    def probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 4096):
                part = frame.iloc[start:start + 4096]
                at, keys = plan.probes(part["fp"].to_numpy(np.int64).view(np.uint64))
                yield pd.DataFrame({"fp": part["fp"].to_numpy()[at], "key": keys, "joined": part["joined"].to_numpy()[at]})

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius

    columns = "fp long, key long, joined long"
    index = nodes.select("fp", F.col("fp").alias("joined")).mapInPandas(entries, columns)
    least = index.groupBy("key").agg(F.min("fp").alias("first"))
    stars = index.join(least, "key").where((F.col("fp") != F.col("first")) & near("fp", "first"))
    groups = least_nodes(stars.select(F.col("fp").alias("a"), F.col("first").alias("b")))
    named = stored(nodes.select("fp").join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("joined")), "joined")

    # Of each index entry, the group with most fingerprints; the rest of the entry is few as a rule.
    index = named.mapInPandas(entries, columns)
    sizes = index.groupBy("key", "joined").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "joined"))["joined"].alias("main"),
                                    F.count(F.lit(1)).alias("n_groups"))
    others = index.join(main, "key").where("n_groups > 1 OR joined = main")
    others = others.select("key", (F.col("joined") == F.col("main")).alias("is_main"), F.col("fp").alias("other"),
                           F.col("joined").alias("other_joined"))
    asked = named.mapInPandas(probes, columns).join(main, "key").select("fp", "key", "joined", F.explode(F.array_compact(F.array(
        F.when(F.col("joined") != F.col("main"), F.lit(True)), F.when(F.col("n_groups") > 1, F.lit(False))))).alias("is_main"))
    found = asked.join(others, ["key", "is_main"]).where((F.col("joined") != F.col("other_joined")) & near("fp", "other"))
    links = least_nodes(found.select(F.col("joined").alias("a"), F.col("other_joined").alias("b")))
    final = named.join(links.withColumnRenamed("node", "joined"), "joined", "left")
    return final.select("fp", F.coalesce("root", "joined").alias("root"))


def _fingerprinted(slides: DataFrame, words: int) -> DataFrame:
    rows = slides.select("slide_id", F.xxhash64("text").alias("_text"), fingerprint(F.col("text"), words).alias("fp"))
    return stored(rows, "fingerprints")


def _rooted(rows: DataFrame, radius: int) -> DataFrame:
    return rows.join(roots_of(stored(rows.select("fp").distinct(), "nodes"), radius), "fp")


def near_duplicates(slides: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``slide_id, fingerprint, component_id`` of every slide row (``slide_id, text``; more columns are left aside).

    ``fingerprint`` is 16 hexadecimal digits; slides whose fingerprints differ in at most ``radius`` bits are linked,
    and ``component_id`` is the least slide id that links reach. Null, empty and wordless texts have
    fingerprint zero and are linked like any other; a component without any id has a null one.
    Repeated rows stay, an empty table gives an empty result.
    """
    rows = _rooted(_fingerprinted(slides, words), radius)
    ids = rows.groupBy("root").agg(F.min("slide_id").alias("component_id"))
    return rows.join(ids, "root").select("slide_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(slides: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the slides of each ``root`` in ``rows`` (``slide_id, _text, root``), the row of the least id and text hash."""
    key = F.struct(F.col("slide_id").isNull().alias("_null"), F.coalesce("slide_id", F.lit(0)).alias("_id"), "_text")
    kept = rows.groupBy("root").agg(F.min(key).alias("_k")).select("_k.*")
    marked = packed(slides, "slide_id", "text").withColumn("_text", F.xxhash64("text")).select(
        "_row", F.col("slide_id").isNull().alias("_null"), F.coalesce("slide_id", F.lit(0)).alias("_id"), "_text")
    one = marked.join(kept, ["_null", "_id", "_text"], "left_semi").dropDuplicates(["_null", "_id", "_text"])
    return unpacked(one, slides.columns)


def keep_one(slides: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """Of each component of ``near_duplicates``, one slide row with all its columns: that of the least id.

    Among rows of one id the one of the least text hash stays, among equal ones one of them.
    """
    return one_of_each(slides, _rooted(_fingerprinted(slides, words), radius))
