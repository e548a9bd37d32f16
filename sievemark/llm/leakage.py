"""Evaluation texts leaking into training text, by greedy string tiling.

Texts are reduced to letters and digits, without case and width.

1. *Seeds*: the hash of every short window is taken, and of each stretch of windows as long as the least run only the least
   hash is a seed. A run that two texts share has such a stretch in both, and so a seed that both have.
   The seeds of documents and items are joined; a bitmap of the items' seeds, of fixed size, keeps most of the
   others out of the shuffle. Documents are read once, and only those with a seed in the bitmap are kept.
2. *Tiles*: for each document and item that met, the windows of ``min_run`` characters both share are found by a
   Karp-Rabin hash and joined to maximal common runs. These are marked as tiles, the longest first, none
   overlapping another in either text. So passages are found in whatever order they come.
3. *Threshold*: the tiles give the part of the item that leaked; what covers too little is left out.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.session import durable

#: Characters of texts handled at a time.
CHUNK_CHARS = 1_000_000
#: The bitmap of the items' seeds has two to this many bits, whatever the number of items. With more seeds than bits it keeps
#: less out of the shuffle, and nothing that belongs in it.
BITMAP_BITS = 24
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point to its folded form: lower case, one width; 0 for all but letters and decimal digits."""
    out = np.zeros(0x32400, dtype=np.uint32)
    for cp in range(len(out)):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d.startswith(("<wide>", "<narrow>")):
            ch = chr(int(d.split()[1], 16))
        ch = ch.lower()[:1]
        kind = unicodedata.category(ch)
        if kind[0] == "L" or kind == "Nd":
            out[cp] = ord(ch)
    return out


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits of all texts, folded, one after the other, and where each text starts (and the last ends)."""
    table = _fold_table()
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.where(raw < len(table), table[np.minimum(raw, len(table) - 1)], 0).astype(np.uint32)
    keep = folded > 0
    before = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum([0, *map(len, texts)])
    return folded[keep], before[ends]


def window_hashes(chars: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` characters (one per start), by doubling."""
    n = len(chars) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, block = None, 0, 1, (chars.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xD6E8FEB86659FD93)
    base = _BASE
    while power <= width:
        if width & power:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, power, 1 << 64)) + part
            done += power
        if power * 2 <= width:
            block = block[:-power] * np.uint64(pow(base, power, 1 << 64)) + block[power:]
        power *= 2
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def seeds_of(texts: list[str], min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of texts: (text, hash). Texts that share a run of ``min_run`` characters share a seed."""
    width = (min_run + 1) // 2
    chars, start = fold(texts)
    least = window_hashes(chars, width).view(np.uint64)
    done, wanted = 1, min_run - width + 1
    while done < wanted:  # least of each stretch of ``wanted`` windows, by doubling
        step = min(done, wanted - done)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        done += step
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, dtype=np.int64)
    # a seed may stay the same over the end of a text: every text's own stretches start anew
    begins = start[:-1][np.diff(start) >= min_run]
    at = np.union1d(first, begins[begins < len(least)])
    owner = np.searchsorted(start, at, "right") - 1
    inside = at + min_run <= start[owner + 1]
    return owner[inside], least[at[inside]].view(np.int64)


def bitmap_of(seeds: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bitmap of the hashes in ``seeds.seed``, put together on the executors: 64-bit words, of which at most all come to the driver."""
    word, bit = F.shiftrightunsigned("seed", 70 - bits), F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, 20) & 63 as int))")
    rows = seeds.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def in_bitmap(seeds: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap."""
    h = seeds.view(np.uint64)
    shift = np.uint64(64 - (len(bitmap).bit_length() - 1))
    return (bitmap[(h >> shift).astype(np.int64)] >> (h >> np.uint64(20) & np.uint64(63)) & np.uint64(1)) > 0


def runs_of_seeds(doc_at: np.ndarray, doc_hash: np.ndarray, item_hash: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs of seeds along diagonals: (first place in the document, in the item, number of seeds).

    ``doc_at`` are the places of the document's seeds, rising, ``doc_hash`` their hashes; ``item_hash`` are
    the hashes of all windows of the item. Runs are kept by diagonal, so repetitive texts stay cheap.
    """
    order = np.argsort(doc_hash, kind="stable")
    sorted_hash = doc_hash[order]
    lo, hi = np.searchsorted(sorted_hash, item_hash, "left"), np.searchsorted(sorted_hash, item_hash, "right")
    open_d = open_s = np.zeros(0, dtype=np.int64)  # diagonals of the open runs, rising, and where in the item each began
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(len(item_hash) + 1):
        now = doc_at[order[lo[j] : hi[j]]] - j if j < len(item_hash) else open_d[:0]
        if len(open_d):
            goes_on = np.isin(open_d, now, assume_unique=True)
            d, s = open_d[~goes_on], open_s[~goes_on]
            if len(d):
                found.append((s + d, s, j - s))
            began = np.full(len(now), j)
            began[np.isin(now, open_d, assume_unique=True)] = open_s[goes_on]
        else:
            began = np.full(len(now), j)
        open_d, open_s = now, began
    return [(int(i), int(j), int(n)) for x in found for i, j, n in zip(*x, strict=True)]


def tile(runs: list[tuple[int, int, int]], doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, in the item, length): common runs of ``width`` or more characters, the longest
    first (then the earliest), cut where an earlier tile already covers either text."""
    heap = []
    for i, j, n in runs:
        size = n + width - 1
        if np.array_equal(doc[i : i + size], item[j : j + size]):  # else the hashes agree by chance
            heap.append((-size, i, j))
    heapq.heapify(heap)
    taken_doc, taken_item = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    out = []
    while heap:
        neg, i, j = heapq.heappop(heap)
        size = -neg
        free = ~(taken_item[j : j + size] | taken_doc[i : i + size])
        if free.all():
            out.append((i, j, size))
            taken_item[j : j + size] = taken_doc[i : i + size] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= width:
                heapq.heappush(heap, (-int(b - a), i + int(a), j + int(a)))
    return out


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield ids[start : k + 1], texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


class Windows:
    """A folded text with the hashes of its windows of ``width`` characters."""

    def __init__(self, text: str, width: int) -> None:
        self.chars, self.width = fold([text])[0], width
        self.hashes = window_hashes(self.chars, width)
        self.known = np.unique(self.hashes)

    def places(self, other: Windows) -> np.ndarray:
        """The places of the windows that ``other`` has too."""
        if not len(other.known):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(other.known, self.hashes), len(other.known) - 1)
        return np.flatnonzero(other.known[at] == self.hashes)


def leak(doc: Windows, item: Windows, least: float = 0.0) -> tuple[int, int, int, int] | None:
    """``(tiles, covered, longest, item length)`` of a document and an item, or None without a common run, or if tiles cover
    less than a part ``least`` of the item."""
    width, size = item.width, len(item.chars)
    touched = item.places(doc)
    if not len(touched) or np.minimum(np.diff(touched), width).sum() + width < least * size:  # tiles can't cover more than the windows touch
        return None
    at = doc.places(item)
    tiles = tile(runs_of_seeds(at, doc.hashes[at], item.hashes), doc.chars, item.chars, width)
    covered = sum(t[2] for t in tiles)
    return (len(tiles), covered, max(t[2] for t in tiles), size) if tiles and covered >= least * size else None


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "item_text", min_run: int = 30, least_coverage: float = 0.0, bits: int = BITMAP_BITS) -> DataFrame:
    """Every document that shares a run of ``min_run`` letters and digits with an item, with the item:
    ``(doc_key, item_key, n_tiles, n_covered, longest, coverage)``, a row per document and item.

    ``coverage`` is the part of the item's letters and digits that tiles cover; pairs with less than
    ``least_coverage`` are left out. Case and width don't count, and nothing but letters and decimal digits does.
    Null texts share nothing; rows with null keys are left out; of a key with several texts the one counts that is
    covered most. What is broadcast is a bitmap of 2**``bits`` bits whatever the number of items; documents and
    items meet by a join on their seeds, and documents without a seed of an item are not kept or shuffled.
    """
    doc = docs.where(F.col(doc_text).isNotNull() & F.col(doc_key).isNotNull()).select(F.col(doc_key).alias("d"), F.col(doc_text).alias("dt"))
    item = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).alias("it")).distinct()
    item = item.withColumn("iv", F.xxhash64("i", "it"))

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, part in _chunks(b["iv"].tolist(), b["it"].tolist()):
                owner, hashes = seeds_of(part, min_run)
                yield pd.DataFrame({"iv": np.array(ids, dtype=np.int64)[owner], "seed": hashes})

    of_items = durable(item.select("iv", "it").mapInPandas(seeds, "iv bigint, seed bigint").distinct(), "seeds")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(of_items, bits))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        for b in batches:
            for at, part in _chunks(list(range(len(b))), b["dt"].tolist()):
                owner, hashes = seeds_of(part, min_run)
                hit = in_bitmap(hashes, bitmap)
                if hit.any():
                    rows = pd.DataFrame({"row": np.array(at)[owner[hit]], "seed": hashes[hit]}).drop_duplicates().groupby("row")["seed"].agg(list)
                    yield b.iloc[rows.index].assign(seeds=rows.to_numpy())

    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    found = durable(doc.mapInPandas(search, f"d {kinds[0]}, dt string, seeds array<bigint>").withColumn("dv", F.xxhash64("d", "dt")), "found")
    met = found.select("dv", F.explode("seeds").alias("seed")).join(of_items, "seed").select("dv", "iv").distinct()
    pairs = found.select("dv", "d", "dt").distinct().join(met.join(item, "iv").select("dv", "i", "it"), "dv")

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str, Windows] | None = None
        known: dict[str, Windows] = {}
        for b in batches:
            got = []
            for d, i, dt, it in zip(b["d"], b["i"], b["dt"], b["it"], strict=True):
                if last is None or last[0] != dt:  # the items of a document come one after the other
                    last = dt, Windows(dt, min_run)
                if it not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[it] = Windows(it, min_run)
                result = leak(last[1], known[it], least_coverage)
                if result:
                    got.append((d, i, *result[:3], result[1] / result[3]))
            if got:
                yield pd.DataFrame(got, columns=["d", "i", "n_tiles", "n_covered", "longest", "coverage"])

    out = pairs.select("d", "i", "dt", "it").mapInPandas(tiles, f"d {kinds[0]}, i {kinds[1]}, n_tiles int, n_covered int, longest int, coverage double")
    best = F.max(F.struct("n_covered", "n_tiles", "longest", "coverage"))
    return out.groupBy(F.col("d").alias(doc_key), F.col("i").alias(item_key)).agg(best.alias("b")).select(doc_key, item_key, "b.n_tiles", "b.n_covered", "b.longest", "b.coverage")
