"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has a bit set if more than half of the hashed features of a text have it set.
Two fingerprints that differ in at most ``radius`` bits agree, on at least one group i of a
partition of the bits, up to t_i bits, for any thresholds with sum(t_i + 1) = radius + 1.
Bits that vary together are put into one group, which leaves the other groups selective, and
the thresholds are allocated by dynamic programming on the candidates that each would cost.
Every fingerprint is stored under its bits of each group, probes what is within t_i of them,
and candidates are verified on all bits.

Buckets of more than ``HOT_BUCKET`` fingerprints (near copies by the thousand) are not paired.
Their members, and those that probe them, meet at points instead: two fingerprints differ in at
most ``radius`` bits exactly if some point is within radius / 2 of both, so each sends its
neighbourhood of points and is linked to the smallest that meets it there. This finds the same
components with a fixed number of rows per fingerprint.

Copies share a fingerprint and are one node. Only a bounded sample of fingerprints is used to
choose groups and thresholds; they change the cost, never the result. Defined results: a text
that is null or has no word has fingerprint zero and is linked like any other; repeated rows
each get their row; rows without id get the smallest id of their component (null if it has none).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm import words
from cartloom.llm.components import components
from cartloom.llm.tables import share_by_hash
from cartloom.session import materialize

RADIUS = 2
SHINGLE = 3
#: Fingerprints that are looked at to choose groups and thresholds.
SAMPLE = 2048
HOT_BUCKET = 64
#: Hashes whose bits are unpacked at once.
_CHUNK = 1 << 16


def _features(text: bytes, shingle: int) -> list[bytes]:
    """Shingles of lower-cased words, repeats included."""
    tokens = text.lower().split()  # bytes: A-Z only, and exactly the separators of words
    if not tokens:
        return []
    if len(tokens) <= shingle:
        return [b" ".join(tokens)]
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [line[b:e] for b, e in zip(begins[: len(tokens) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def _bits(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), _CHUNK):
        part = hashes[first : first + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    features = _features(text or b"", shingle)
    if not features:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(f, seed) for f in features), np.uint64, len(features))
    return _bits(hashes)


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = 42) -> Column:
    """The 64 bits of a text as a long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary())
        return pa.array([_fingerprint(t.as_py(), shingle, seed) for t in raw], pa.int64())

    return of(text)


@dataclass(frozen=True)
class Plan:
    """Groups of bits and the number of differing bits that each is probed for (-1: not at all)."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _grouped(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of about equal size; each grows by the bit that correlates most with it."""
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    free, groups = set(range(64)), []
    for g in range(m):
        size = (64 - sum(map(len, groups))) // (m - g)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def choose_plan(sample: np.ndarray, total: int, radius: int = RADIUS) -> Plan:
    """The cheapest number of groups and thresholds for ``total`` fingerprints like ``sample``."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    best: tuple[float, Plan] | None = None
    for m in range(2, radius + 2):
        groups = _grouped(bits.astype(np.float32), m)
        costs = []
        for group in groups:
            part = bits[:1024, group].astype(np.float32)
            differ = part @ (1 - part).T
            distance = (differ + differ.T)[np.triu_indices(len(part), 1)]
            row = [0.0]
            for t in range(radius + 1):
                probes = sum(comb(len(group), k) for k in range(t + 1))
                seen = float((distance <= t).mean()) if len(distance) else 0.0
                row.append(probes + total * max(seen, probes / 2.0 ** len(group)))
            costs.append(row)
        # least[b]: cheapest thresholds of the groups so far that use up b of radius + 1
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in least.items():
                for t in range(-1, radius + 1):
                    b = used + t + 1
                    if b <= radius + 1 and (b not in step or cost + row[t + 1] < step[b][0]):
                        step[b] = (cost + row[t + 1], (*chosen, t))
            least = step
        cost, thresholds = least[radius + 1]
        if best is None or cost < best[0]:
            best = (cost, Plan(tuple(map(tuple, groups)), thresholds))
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits, most: int) -> list[int]:
    """All masks that set at most ``most`` of ``bits``."""
    masks = [0]
    for b in bits:
        masks += [x | (1 << b) for x in masks if x.bit_count() < most]
    return masks


def _keys(fps: DataFrame, plan: Plan, probing: bool) -> DataFrame:
    """(k, part, bits, fp): where a fingerprint is stored, or what it probes."""
    entries = [
        F.struct(F.lit(i).alias("part"), F.lit(_signed(sum(1 << b for b in group))).alias("own"), F.lit(_signed(x)).alias("flip"))
        for i, (group, t) in enumerate(zip(plan.groups, plan.thresholds, strict=True)) if t >= 0
        for x in _flips(group, t if probing else 0)
    ]
    bits = F.col("fp").bitwiseAND(F.col("e.own")).bitwiseXOR(F.col("e.flip"))
    return fps.select("k", "fp", F.explode(F.array(*entries)).alias("e")).select("k", "e.part", bits.alias("bits"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (k, a, b) that connect all of ``fps (k, fp)``, distinct, that are within an even ``radius``.

    ``k`` numbers kinds of fingerprints, which are never linked with each other.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    sample = share_by_hash(fps, "fp", SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    plan = choose_plan(sample, fps.count(), radius) if len(sample) else Plan((tuple(range(64)),), (radius,))
    bucket = ["k", "part", "bits"]
    stored, probes = _keys(fps, plan, False), _keys(fps, plan, True)
    counts = stored.groupBy(*bucket).agg(F.count("*").alias("n"))
    cold = stored.join(counts.where(F.col("n") <= hot_bucket).select(*bucket), bucket)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = (
        probes.withColumnRenamed("fp", "a").join(cold.withColumnRenamed("fp", "b"), bucket)
        .where("a < b").where(near).select("k", "a", "b").distinct()
    )
    hot = counts.where(F.col("n") > hot_bucket).select(*bucket)
    meeting = materialize(probes.join(hot, bucket, "left_semi").select("k", "fp").distinct(), "simhash-hot")
    masks = F.array(*[F.lit(_signed(x)) for x in _flips(range(64), radius // 2)])
    points = meeting.select("k", "fp", F.explode(masks).alias("mask")).select(
        "k", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point")
    )
    least = points.groupBy("k", "point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = points.join(least, ["k", "point"]).where("fp <> b").select("k", F.col("fp").alias("a"), "b")
    return pairs.unionAll(met)


def grouped(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``marked (doc_id, fp)``; root is its smallest fingerprint."""
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(links(fps.select(F.lit(0).alias("k"), "fp"), radius).select("a", "b"))
    own = fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    ids = own.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return own.join(ids, "root").select("fp", "root", "component_id")


def near_copies(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    marked = materialize(
        documents.select("doc_id", fingerprint(F.col("text"), shingle, seed).alias("fp")), "simhash-fingerprints"
    )
    groups = materialize(grouped(marked, radius), "simhash-components").withColumnRenamed("fp", "group_fp")
    return marked.join(groups, F.col("fp") == F.col("group_fp")).select("doc_id", "fp", "component_id")


_NO_ID = (1 << 63) - 1


def _identified(documents: DataFrame) -> list[Column]:
    """What tells rows apart: the id, null last, and two hashes of the text; equal rows are alike."""
    text = F.coalesce("text", F.lit(""))
    return [
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")
    ]


def one_of_each(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """All columns of one document of each component: the smallest id, rows without id last.

    Of rows with the same id, the one with the smallest hashes of its text stays; of equal rows, one.
    Texts are read for their fingerprints and again when the rows that go are taken out; only ids
    and hashes are compared in between.
    """
    key = ["id", "h1", "h2"]
    prints = documents.select(*_identified(documents), fingerprint(F.col("text"), shingle, seed).alias("fp"))
    marked = materialize(prints.groupBy(*key, "fp").agg(F.count("*").alias("n")), "simhash-fingerprints")
    groups = grouped(marked.select(F.col("id").alias("doc_id"), "fp"), radius).select(F.col("fp").alias("group_fp"), "root")
    rooted = materialize(
        marked.join(groups, F.col("fp") == F.col("group_fp")).select("root", F.struct(*key).alias("who"), "n"), "simhash-rooted"
    )
    first = rooted.groupBy("root").agg(F.min("who").alias("first")).withColumnRenamed("root", "first_root")
    found = rooted.join(first, F.col("root") == F.col("first_root"))
    action = F.when(F.col("who") != F.col("first"), "drop").when(F.col("n") > 1, "once")
    actions = materialize(
        found.select(*[F.col("who")[c].alias(f"action_{c}") for c in key], action.alias("action")).where("action IS NOT NULL"),
        "simhash-actions",
    )
    keyed = documents.select(F.struct(*documents.columns).alias("row"), *_identified(documents))
    same = (F.col("id") == F.col("action_id")) & (F.col("h1") == F.col("action_h1")) & (F.col("h2") == F.col("action_h2"))
    decided = keyed.join(actions, same, "left")
    kept = decided.where("action IS NULL").select("row")
    if actions.where("action = 'once'").limit(1).count():
        kept = kept.unionAll(decided.where("action = 'once'").dropDuplicates(key).select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in documents.columns])
