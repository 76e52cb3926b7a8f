"""Problem 3: near-duplicate blocks by circulant MinHash."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import checkpointed, rows

WORD = re.compile(r"[a-zA-Z_]\w+")
BITS = 20  # the permutations act on 2**BITS places
BANDS, ROWS = 48, 6  # a pair at 0.75 misses all bands with a chance of (1 - 0.75**6)**48 = 8e-5
_MASK = (1 << BITS) - 1


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """First permutation, and all windows of the second one over BANDS*ROWS circular shifts."""
    rng = np.random.default_rng(7)
    first = rng.permutation(1 << BITS).astype(np.int32)
    second = rng.permutation(1 << BITS).astype(np.int32)
    k = BANDS * ROWS
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _codes(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of the distinct words and their counts, in the order of the codes."""
    counts = Counter(words)
    out = np.empty(len(counts), np.uint32)
    for i, w in enumerate(counts):
        c = known.get(w)
        if c is None:
            c = known[w] = _hash32(w)
        out[i] = c
    n = np.fromiter(counts.values(), np.int32, len(counts))
    order = np.argsort(out, kind="stable")
    return out[order], n[order]


def _hash32(w: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(w) >> 32


def signature(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a bag: BANDS*ROWS coordinates from two permutations.

    A word with count c stands for c elements (word, 1) ... (word, c), so the
    Jaccard similarity of the element sets is the bag similarity: the sum of
    the smaller counts over the sum of the larger ones. Coordinate k is the
    least value of the second permutation, shifted by k, over the elements'
    places under the first.
    """
    first, windows = _permutations()
    occurrence = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    x = np.repeat(codes.astype(np.uint64), counts) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return windows[first[(x >> np.uint64(40)).astype(np.int64) & _MASK]].min(axis=0)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: the band's number over a hash of its coordinates."""
    s = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        h = (h ^ s[:, r]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return ((np.arange(BANDS, dtype=np.uint64) << np.uint64(48)) | (h >> np.uint64(16))).astype(np.int64)


def pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag as bytes: the width of a count, the codes, the counts."""
    width = np.uint8 if counts.max(initial=0) < 256 else np.int32
    return bytes([np.dtype(width).itemsize]) + codes.tobytes() + counts.astype(width).tobytes()


def unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    w = bag[0]
    n = (len(bag) - 1) // (4 + w)
    return np.frombuffer(bag, np.uint32, n, 1), np.frombuffer(bag, np.uint8 if w == 1 else np.int32, n, 1 + 4 * n).astype(np.int32)


def bags(blocks: DataFrame, min_words: int = 25) -> DataFrame:
    """Bag of each block with at least ``min_words`` words: ordinal, bag_id, total, bag; null texts have none."""
    def run(b: dict[str, list]) -> dict[str, list]:
        from xxhash import xxh3_128_digest

        out: dict[str, list] = {k: [] for k in ("ordinal", "bag_id", "total", "bag")}
        known: dict[str, int] = {}
        for o, t in zip(b["ordinal"], b["source_code"], strict=True):
            words = words_of(t) if t else []
            if len(words) < min_words:
                continue
            packed = pack(*_codes(words, known))
            out["ordinal"].append(o)
            out["bag_id"].append(xxh3_128_digest(packed)[:12])
            out["total"].append(len(words))
            out["bag"].append(packed)
        return out

    return rows(blocks.select("ordinal", "source_code"), run, "ordinal long, bag_id binary, total int, bag binary")


def _bands(found: DataFrame) -> DataFrame:
    """(key, ordinal, total) for each band of each bag; within a task equal bags are banded once."""
    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("ordinal", "total", "keys")}
        for o, i, n, bag in zip(b["ordinal"], b["bag_id"], b["total"], b["bag"], strict=True):
            if i not in seen:
                seen.add(i)
                out["ordinal"].append(o)
                out["total"].append(n)
                out["keys"].append(band_keys(signature(*unpack(bag))))
        return out

    seen: set[bytes] = set()
    return rows(found, run, "ordinal long, total int, keys array<long>").select(F.explode("keys").alias("key"), "ordinal", "total")


def bag_similarity(a: bytes, b: bytes) -> float:
    """Sum of the smaller counts over the sum of the larger counts of two packed bags."""
    (ca, na), (cb, nb) = unpack(a), unpack(b)
    if not len(ca) or not len(cb):
        return 0.0
    at = np.searchsorted(cb, ca)
    at[at == len(cb)] = 0
    same = cb[at] == ca
    inner = int(np.minimum(na[same], nb[at[same]]).sum())
    return inner / (int(na.sum()) + int(nb.sum()) - inner)


def similar_pairs(blocks: DataFrame, threshold: float = 0.75, min_words: int = 25) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the class of each block, and the links between class representatives.

    members: ordinal, rep - blocks whose bags are equal form a class, and its
    least ordinal represents it; a class is banded once in a task however many
    copies it has. pairs: rep_a < rep_b, similarity - classes that share a
    band key, of sizes that allow the threshold, whose exact bag similarity
    reaches it. No key, copy or candidate is dropped or capped. Null and short
    texts have no class; repeated rows of one ordinal count once.
    """
    found = checkpointed(bags(blocks, min_words))
    ids = found.select("ordinal", "bag_id").dropDuplicates(["ordinal"])
    members = ids.join(ids.groupBy("bag_id").agg(F.min("ordinal").alias("rep")), "bag_id").select("ordinal", "rep")
    banded = _bands(found.select("ordinal", "bag_id", "total", "bag"))
    a = banded.select("key", F.col("ordinal").alias("a"), F.col("total").alias("total_a"))
    b = banded.select("key", F.col("ordinal").alias("b"), F.col("total").alias("total_b"))
    size_fits = F.least("total_a", "total_b") >= F.greatest("total_a", "total_b") * F.lit(threshold)
    candidates = a.join(b, "key").filter((F.col("a") < F.col("b")) & size_fits).select("a", "b").distinct()
    texts = found.select("ordinal", "bag").dropDuplicates(["ordinal"])
    both = candidates.join(texts.select(F.col("ordinal").alias("a"), F.col("bag").alias("bag_a")), "a").join(texts.select(F.col("ordinal").alias("b"), F.col("bag").alias("bag_b")), "b")

    def verify(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("a", "b", "similarity")}
        for p, q, s, t in zip(x["a"], x["b"], x["bag_a"], x["bag_b"], strict=True):
            v = 1.0 if s == t else bag_similarity(s, t)
            if v >= threshold:
                out["a"].append(p)
                out["b"].append(q)
                out["similarity"].append(v)
        return out

    linked = rows(both, verify, "a long, b long, similarity double")
    of = members.select(F.col("ordinal").alias("a"), F.col("rep").alias("x")), members.select(F.col("ordinal").alias("b"), F.col("rep").alias("y"))
    pairs = (
        linked.join(of[0], "a").join(of[1], "b").filter("x <> y")
        .select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "similarity").dropDuplicates(["rep_a", "rep_b"])
    )
    return members, pairs


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links between blocks: those of their classes, and all within a class; ordinal_a < ordinal_b."""
    m = members.select("ordinal", "rep")
    left, right = m.select(F.col("ordinal").alias("x"), F.col("rep").alias("rep_a")), m.select(F.col("ordinal").alias("y"), F.col("rep").alias("rep_b"))
    across = pairs.select("rep_a", "rep_b").join(left, "rep_a").join(right, "rep_b").select("x", "y")
    within = left.join(right.withColumnRenamed("rep_b", "rep_a"), "rep_a").filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("ordinal_a"), F.greatest("x", "y").alias("ordinal_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each block: ordinal, group_id (least ordinal it is linked with), group_size, links of its class.

    Components by alternating large-star and small-star steps over the links
    between classes: each step is two aggregations, labels only fall, and the
    lineage is cut by a reliable checkpoint each time. It stops when a step
    changes nothing.
    """
    links = pairs.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
    edges = checkpointed(links)
    for _ in count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    degree = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    label = members.join(edges.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("root")), "rep", "left").join(degree, "rep", "left")
    label = label.select("ordinal", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    size = label.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return label.join(size, "group_id").select("ordinal", "group_id", "group_size", "links")
