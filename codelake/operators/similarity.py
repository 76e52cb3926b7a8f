"""Near-duplicate blocks: bags of words, MinHash bands, exact bag similarity; and the md5 signature."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b, md5

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.batches import rows
from codelake.functions.text import tokens
from codelake.operators.graph import cut_lineage

HASHES = 64  # coordinates of the md5 signature
BANDS, BAND_ROWS = 48, 6
PLACES = ("p0", "p1", "p2", "p3")  # numbers that say which of 256 places a text's elements take


def bags(texts: DataFrame, least: int = 5) -> DataFrame:
    """(id, token, n, total): words of each text and how often, for texts of at least ``least`` words; null texts have none.

    ``texts``: id, source_code. Counts are made within the row, so nothing is shuffled.
    """
    t = texts.select("id", F.array_sort(tokens("source_code")).alias("w")).filter(F.size("w") >= least)
    return t.select("id", F.size("w").alias("total"), F.explode("w").alias("token")).groupBy("id", "token", "total").agg(F.count("*").alias("n"))


def representatives(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reps, members): one text of each set of equal texts (its least id) with its copies, and (id, rep) for all.

    Repeated rows of one id count once. They are settled by hashes, so a text is shuffled once.
    """
    t = texts.filter("source_code is not null").withColumn("h", F.unhex(F.sha2("source_code", 256)))
    ids = t.select("id", "h").dropDuplicates(["id"])
    classes = ids.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = classes.join(t.groupBy("h").agg(F.any_value("source_code").alias("source_code")).hint("merge"), "h")  # merged before the shuffle
    return reps.select(F.col("rep").alias("id"), "source_code", "copies"), ids.join(classes.hint("merge"), "h").select("id", "rep")


_WORD = re.compile(r"[a-zA-Z_]\w+")
KNOWN = 100_000  # words whose hashes a task keeps; beyond that it starts anew


def _word_hashes(word: str, hashes: int) -> np.ndarray:
    return np.array([int(md5(f"{i}:{word}".encode()).hexdigest()[:8], 16) for i in range(hashes)], np.int64)


_RNG = np.random.default_rng(11)
_ODD = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def band_keys(elements: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash of a set of 64-bit numbers; a pair at 0.75 misses all bands with a chance of 8e-5."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 512):  # in pieces, so a long text takes no more memory
        x = elements[at : at + 512, None] * _ODD
        x += _ADD
        np.minimum(least, x.min(axis=0), out=least)
    least >>= np.uint64(16)
    key = np.zeros(BANDS, np.uint64)
    for r in range(BAND_ROWS):
        key = (key ^ least.reshape(BANDS, BAND_ROWS)[:, r]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(32)
    return ((np.arange(BANDS, dtype=np.uint64) << np.uint64(48)) | (key >> np.uint64(16))).astype(np.int64)


def elements_of(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit number for each word and occurrence, from a code of each word."""
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    x = np.repeat(codes, counts) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> np.uint64(31)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


def pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag as bytes: the width of a count, the codes by 6 bytes in ascending order, the counts."""
    order = np.argsort(codes)
    width = np.uint8 if counts.max(initial=0) < 256 else np.int32
    return bytes([np.dtype(width).itemsize]) + codes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + counts[order].astype(width).tobytes()


def unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = bag[0]
    n = (len(bag) - 1) // (6 + width)
    codes = np.zeros((n, 8), np.uint8)
    codes[:, :6] = np.frombuffer(bag, np.uint8, 6 * n, 1).reshape(n, 6)
    return codes.view("<u8")[:, 0], np.frombuffer(bag, np.uint8 if width == 1 else np.int32, n, 1 + 6 * n).astype(np.int64)


def common(a: bytes, b: bytes) -> int:
    """Sum of the lesser counts of two packed bags."""
    (ca, na), (cb, nb) = unpack(a), unpack(b)
    _, x, y = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    return int(np.minimum(na[x], nb[y]).sum())


def places(elements: np.ndarray) -> np.ndarray:
    """Which of 256 places hold an element, as four numbers of 64 bits."""
    held = np.zeros(64 * len(PLACES), bool)
    held[(elements & np.uint64(64 * len(PLACES) - 1)).astype(np.int64)] = True
    return np.packbits(held).view(np.int64)


def sketches(texts: DataFrame, hashes: int = HASHES, least: int = 5) -> DataFrame:
    """(id, copies, total, signature, bag, p0 to p3) of each text of at least ``least`` words; null texts have none.

    Coordinate i of the signature is the least of the first 32 bits of
    md5("i:word") over the text's words; a task hashes each word of its
    vocabulary once. ``bag`` holds the words by codes of 48 bits, so that two
    words of a pair are taken for one about once in 10**11 pairs of texts; it
    gives one number for each word and occurrence, and p0 to p3 are their
    ``places``. Nothing is shuffled.
    """
    known: dict[str, np.ndarray] = {}
    codes: dict[str, int] = {}

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "copies", "total", "signature", "bag", *PLACES)}
        for i, t, c in zip(b["id"], b["source_code"], b["copies"], strict=True):
            words = _WORD.findall(t.lower() if t.isascii() else t) if t else []
            if len(words) < least:
                continue
            counts = Counter(words if t.isascii() else [w.lower() for w in words])
            for kept in (known, codes):
                if len(kept) > KNOWN:
                    kept.clear()
            for w in counts if hashes else ():
                if w not in known:
                    known[w] = _word_hashes(w, hashes)
            for w in counts:
                if w not in codes:
                    codes[w] = int.from_bytes(blake2b(w.encode(), digest_size=6).digest(), "little")
            bag = np.fromiter((codes[w] for w in counts), np.uint64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
            out["id"].append(i)
            out["copies"].append(c)
            out["total"].append(len(words))
            out["signature"].append(np.min([known[w] for w in counts], axis=0) if hashes else [])
            out["bag"].append(pack(*bag))
            for p, v in zip(PLACES, places(elements_of(*bag)).tolist(), strict=True):
                out[p].append(v)
        return out

    return rows(texts.select("id", "source_code", "copies"), run, f"id long, copies long, total int, signature array<long>, bag binary, {', '.join(f'{p} long' for p in PLACES)}")


def bands(sketch: DataFrame) -> DataFrame:
    """(id, total, key): the band keys of each text."""
    def run(b: dict[str, list]) -> dict[str, list]:
        return {"id": b["id"], "total": b["total"], "keys": [band_keys(elements_of(*unpack(x))) for x in b["bag"]]}

    return rows(sketch.select("id", "total", "bag"), run, "id long, total int, keys array<long>").select("id", "total", F.explode("keys").alias("key"))


def signatures(sketch: DataFrame, first: int = HASHES) -> DataFrame:
    """(id, i, value): the first coordinates of each signature."""
    return sketch.select("id", F.posexplode(F.slice("signature", 1, first)).alias("i", "value"))


def candidates(sketch: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b): texts that share a band key and whose sizes allow the threshold, a < b.

    The sides of this and the next joins are merged: Spark takes a sketch for a share of the stored file
    and its bands for no more than that, so it would broadcast them.
    """
    band = bands(sketch)
    left, right = band.select("key", F.col("id").alias("a"), F.col("total").alias("ta")), band.select("key", F.col("id").alias("b"), F.col("total").alias("tb"))
    return left.join(right.hint("merge"), "key").filter((F.col("a") < F.col("b")) & (F.least("ta", "tb") >= threshold * F.greatest("ta", "tb"))).select("a", "b").distinct()


def verified(pairs: DataFrame, sketch: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b, similarity): candidate pairs whose sum of lesser over sum of greater counts reaches the threshold.

    A place that one text holds and the other doesn't is an element that they
    don't share. Pairs that can't reach the threshold for that are left out
    before the bags are joined.
    """
    side = lambda n, *more: sketch.select(F.col("id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in more)).hint("merge")
    of = lambda inner: inner / (F.col("total_a") + F.col("total_b") - inner)
    alone = lambda x, y: F.col(f"total_{x}") - sum((F.bit_count(F.col(f"{p}_{x}").bitwiseAND(F.bitwise_not(f"{p}_{y}"))) for p in PLACES), F.lit(0))
    near = pairs.join(side("a", "total", *PLACES), "a").join(side("b", "total", *PLACES), "b").filter(of(F.least(alone("a", "b"), alone("b", "a"))) >= threshold).select("a", "b", "total_a", "total_b")

    def inner(x: dict[str, list]) -> dict[str, list]:
        return {n: x[n] for n in ("a", "b", "total_a", "total_b")} | {"inner_n": [common(p, q) for p, q in zip(x["bag_a"], x["bag_b"], strict=True)]}

    p = rows(near.join(side("a", "bag"), "a").join(side("b", "bag"), "b"), inner, "a long, b long, total_a int, total_b int, inner_n long").withColumn("similarity", of(F.col("inner_n")))
    return p.filter(F.col("similarity") >= threshold).select("a", "b", F.round("similarity", 3).alias("similarity"))


def duplicate_pairs(texts: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of equal texts, and links between class representatives found by bands and verified exactly."""
    reps, members = representatives(texts)
    sketch = cut_lineage(sketches(reps, 0))
    return members, verified(candidates(sketch, threshold), sketch, threshold)


def duplicate_count(texts: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row, dup_n: the number of pairs of texts that are alike, copies included.

    Pairs are not written: a class of n copies has n(n-1)/2, and a link between
    classes of n and m copies stands for n times m. Texts of fewer words than ``sketches`` takes have none.
    """
    sketch = cut_lineage(sketches(representatives(texts)[0], 0))
    links = verified(candidates(sketch, threshold), sketch, threshold)
    size = lambda n: sketch.select(F.col("id").alias(n), F.col("copies").alias(f"n{n}")).hint("merge")
    across = links.join(size("a"), "a").join(size("b"), "b")
    parts = sketch.select((F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("n")).unionByName(across.select((F.col("na") * F.col("nb")).alias("n")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("dup_n"))
