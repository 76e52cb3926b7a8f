"""Problem 7: evaluation texts leaking into training text."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import rows

WORD = re.compile(r"[^\W_]+")
SEED = 5  # words under the running hash
BLOCK_WORDS = 2_000_000  # words of test items that are held by a task at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, case folded."""
    return [w.casefold() for w in WORD.findall(text)] if text else []


def running_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of each run of ``k`` codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _BASE + codes[i : i + n]
    return h


class Index:
    """Seeds of a block of test items, built once in each task."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        where: dict[int, list[tuple[int, int]]] = {}
        for eval_id, prompt in items:
            codes = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words_of(prompt)], np.uint64)
            at = len(self.items)
            self.items.append((eval_id, codes))
            for j, h in enumerate(running_hashes(codes, SEED).tolist()):
                where.setdefault(h, []).append((at, j))
        self.where = where
        self.seeds = np.array(sorted(where), np.uint64)

    def tiles(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """(eval_id, longest tile, number of tiles, words tiled, share of the item's words) for each item with a seed in the text."""
        ws = words_of(text)
        if len(ws) < SEED or not len(self.seeds):
            return []
        get = self.words.get
        codes = np.array([get(w, 0) for w in ws], np.uint64)
        h = running_hashes(codes, SEED)
        at = np.searchsorted(self.seeds, h)
        at[at == len(self.seeds)] = 0
        hits = np.flatnonzero(self.seeds[at] == h)
        if not len(hits):
            return []
        pairs: dict[int, list[tuple[int, int]]] = {}
        for i in hits.tolist():
            for item, j in self.where[int(h[i])]:
                pairs.setdefault(item, []).append((i, j))
        return [(self.items[item][0], *tile(seeds, codes, self.items[item][1])) for item, seeds in pairs.items()]


def tile(seeds: list[tuple[int, int]], text: np.ndarray, item: np.ndarray) -> tuple[int, int, int, float]:
    """Greedy string tiling of an item with a text from their shared seeds.

    Seeds on one diagonal that follow each other form a maximal match; the
    longest unmarked match is marked again and again, the first in the text if
    several are as long, and what overlaps a mark is shortened, until no match
    of ``SEED`` words is left. Result: longest tile, tiles, words tiled, share.
    """
    runs: list[list[int]] = []
    last: dict[int, list[int]] = {}
    for i, j in sorted(seeds):
        run = last.get(i - j)
        if run is not None and run[0] + run[2] == i:
            run[2] += 1
        else:
            run = [i, j, 1]
            runs.append(run)
            last[i - j] = run
    matches = [(n + SEED - 1, i, j) for i, j, n in runs if (text[i : i + SEED] == item[j : j + SEED]).all()]
    if not matches:
        return 0, 0, 0, 0.0
    longest = max(m[0] for m in matches)
    used_t, used_i = np.zeros(len(text), bool), np.zeros(len(item), bool)
    tiles = covered = 0
    open_ = sorted(matches, key=lambda m: (-m[0], m[1], m[2]))
    while open_:
        n, i, j = open_.pop(0)
        free = ~(used_t[i : i + n] | used_i[j : j + n])
        if free.all():
            used_t[i : i + n] = used_i[j : j + n] = True
            tiles, covered = tiles + 1, covered + n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        parts = [(int(b - a), i + int(a), j + int(a)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= SEED]
        if parts:
            open_ = sorted([*open_, *parts], key=lambda m: (-m[0], m[1], m[2]))
    return longest, tiles, covered, covered / max(1, len(item))


def leaks(documents: DataFrame, items: DataFrame, min_run: int = 15, min_cover: float = 0.6) -> DataFrame:
    """Documents that hold a passage of a test item: doc_id, eval_id, longest_run, tiles, words, cover.

    A pair counts if a tile has ``min_run`` consecutive words, or if the tiles
    cover ``min_cover`` of the item's words, which also finds passages in
    another order. The test items are the stated query set: they are taken in
    blocks of at most ``BLOCK_WORDS`` words, each block is sent to every task,
    and every document is read whole against it, so nothing is shuffled but
    the result. Null texts and prompts, and items shorter than ``SEED`` words,
    never leak; repeated rows of one doc_id or eval_id count once.
    """
    spark = documents.sparkSession
    size = F.length("prompt")
    parts = items.select("eval_id", "prompt").filter("prompt is not null").dropDuplicates(["eval_id"])
    total = parts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // (BLOCK_WORDS * 4)))  # a word and its gap take four characters or more on average
    docs = documents.select("doc_id", "text").filter("text is not null")
    out = None
    for k in range(blocks):
        block = parts.filter(F.pmod(F.xxhash64("eval_id"), F.lit(blocks)) == k) if blocks > 1 else parts
        held = spark.sparkContext.broadcast([(r["eval_id"], r["prompt"]) for r in block.orderBy("eval_id").toLocalIterator()])
        found = rows(docs, _searcher(held, min_run, min_cover), "doc_id long, eval_id long, longest_run int, tiles int, words int, cover double")
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["doc_id", "eval_id"])


def _searcher(held, min_run: int, min_cover: float):
    cache: list[Index] = []

    def search(b: dict[str, list]) -> dict[str, list]:
        if not cache:
            cache.append(Index(held.value))
        out: dict[str, list] = {k: [] for k in ("doc_id", "eval_id", "longest_run", "tiles", "words", "cover")}
        for d, t in zip(b["doc_id"], b["text"], strict=True):
            for e, longest, n, words, cover in cache[0].tiles(t):
                if longest >= min_run or cover >= min_cover:
                    for k, v in zip(out, (d, e, longest, n, words, round(cover, 6)), strict=True):
                        out[k].append(v)
        return out

    return search


def leak_rates(found: DataFrame, items: DataFrame) -> DataFrame:
    """Items, leaked items and documents for each suite; a null suite is a group of its own."""
    per = found.groupBy("eval_id").agg(F.count_distinct("doc_id").alias("docs"))
    return items.select("eval_id", "suite").dropDuplicates(["eval_id"]).join(per, "eval_id", "left").groupBy("suite").agg(
        F.count("*").alias("items"), F.count("docs").alias("leaked"), F.coalesce(F.sum("docs"), F.lit(0)).alias("hits"))


__all__ = ["Index", "leak_rates", "leaks", "tile", "words_of"]
