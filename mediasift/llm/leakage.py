"""Evaluation texts leaking into training text.

Each test item is cut into n-grams. A first scan of the corpus counts in how many documents each of them
occurs. Seeds are the rare ones: of every window of an item that is long enough for a verbatim leak the
rarest long n-gram, so a verbatim passage always holds a seed, and of every wider window the short n-grams about as rare
as its rarest one, which survive edits. Rarity is judged inside each window, so it does not depend on the size of the
corpus. A second scan finds the documents with seeds and aligns them with the items by Smith-Waterman around the
seeds: the alignment score decides what is reported, and the longest unbroken run tells verbatim copies.

Units are words (runs of letters and digits, lower case); for items with
Chinese characters single letters, characters and digits. Units and n-grams are 64-bit hashes in sorted arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..ship import ship

WORD = re.compile(r"[^\W_]+")
HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f]")
#: Items are broadcast in blocks of about this many units (some 60 bytes a unit in each worker); more blocks mean more scans, not fewer items.
BLOCK_UNITS = 1_000_000
#: Short n-grams are seeds up to this many times as frequent as the rarest of their window; a document needs two of an item.
NEARLY, TOGETHER = 4, 2
#: Characters of documents that are handled at once, and cells of an alignment table.
BATCH_CHARS, CELLS = 2_000_000, 1_000_000


@dataclass(frozen=True)
class Mode:
    """How texts are cut: ``gram`` units make a seed of a verbatim copy, ``run`` units in a row such a copy; ``brief`` units
    make a seed of an edited copy, of which each window of ``wide`` units has one at least."""

    chars: bool
    gram: int
    run: int
    brief: int
    wide: int


WORDS = Mode(chars=False, gram=5, run=12, brief=3, wide=12)
CHARS = Mode(chars=True, gram=12, run=24, brief=6, wide=24)


def units(text: str, mode: Mode) -> list[str]:
    words = WORD.findall(text.lower())
    return list("".join(words)) if mode.chars else words


def mode_of(item: str) -> Mode:
    return CHARS if HAN.search(item) else WORDS


def encode(texts: list[str], mode: Mode) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of all texts in a row, and where each text starts (one more entry than texts)."""
    if mode.chars:
        solid = ["".join(WORD.findall(t.lower())) for t in texts]
        sizes = [len(t) for t in solid]
        codes = np.frombuffer("".join(solid).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        codes = (codes + np.uint64(0x9E37)) * np.uint64(0xBF58476D1CE4E5B9)
        codes ^= codes >> np.uint64(29)
    else:
        words = [WORD.findall(t.lower()) for t in texts]
        sizes = [len(w) for w in words]
        codes = pd.util.hash_array(np.array([x for w in words for x in w], dtype=object), categorize=False) if any(sizes) else np.empty(0, dtype=np.uint64)
    return codes, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` units from each place on, texts not regarded."""
    if len(codes) < n:
        return np.empty(0, dtype=np.uint64)
    base, out = np.uint64(0x9E3779B97F4A7C15 + 2 * n), np.zeros(len(codes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * base + codes[j : len(codes) - n + 1 + j]
        out ^= out >> np.uint64(31)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def _places(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text of each place where ``n`` units of one text begin, and the places."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(len(text))
    whole = at + n <= starts[text + 1] if len(text) else np.empty(0, dtype=bool)
    return text[whole], at[whole]


class Known:
    """A sorted set of hashes with a fast first test."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.first = np.zeros(1 << self.BITS, dtype=bool)
        self.first[(self.sorted >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``hashes`` that are in the set, and their numbers in it."""
        if not len(self.sorted):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        maybe = np.flatnonzero(self.first[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        same = self.sorted[number] == hashes[maybe]
        return maybe[same], number[same]


class Items:
    """A block of test items of one mode."""

    def __init__(self, rows: list[tuple[object, str]], mode: Mode, edited: bool):
        self.mode, self.edited = mode, edited
        self.ids = [i for i, _ in rows]
        self.codes, self.starts = encode([t for _, t in rows], mode)
        self.sizes = [mode.gram, *([mode.brief] if edited else [])]
        #: Whether some window of a character item has no Chinese character, so that any document may hold it.
        self.any_script = False
        if mode.chars:
            solid = ["".join(units(t, mode)) for _, t in rows]
            least = mode.brief if edited else mode.run
            self.any_script = any(not HAN.search(t[i : i + least]) for t in solid for i in range(max(1, len(t) - least + 1)))
        self.known = {n: Known(grams(self.codes, n)[_places(self.starts, n)[1]]) for n in self.sizes}

    def code(self, k: int) -> np.ndarray:
        return self.codes[self.starts[k] : self.starts[k + 1]]

    def texts_for(self, texts: list[str]) -> list[int]:
        return [i for i, t in enumerate(texts) if not self.mode.chars or self.any_script or HAN.search(t)]

    def seeds(self, frequency: dict[int, np.ndarray]) -> dict[int, tuple[Known, np.ndarray, np.ndarray]]:
        """For each n-gram size the seeds, with their items as slices: seed ``s`` belongs to ``owners[bounds[s]:bounds[s + 1]]``.

        ``frequency`` has the documents of each entry of ``known``. Of each window of ``run`` units that can be in a document, since all its
        n-grams are, the rarest; of each window of ``wide`` units the short n-grams about as rare as its rarest that occurs.
        """
        out = {}
        for n in self.sizes:
            mode, known, often = self.mode, self.known[n].sorted, frequency[n]
            chosen, owner = [], []
            for k in range(len(self.ids)):
                own = np.searchsorted(known, grams(self.code(k), n))
                if not len(own):
                    continue
                f = often[own].astype(np.float64)
                f[f == 0] = np.inf
                if n == mode.gram:
                    wide = mode.run - n + 1
                    if len(own) < wide:
                        continue
                    windows = np.lib.stride_tricks.sliding_window_view(f, wide)
                    whole = np.flatnonzero(np.isfinite(windows).all(axis=1))
                    pick = np.unique(whole + windows[whole].argmin(axis=1))
                else:
                    wide = min(mode.wide - n + 1, len(own))
                    windows = np.lib.stride_tricks.sliding_window_view(f, wide)
                    at, step = np.nonzero(np.isfinite(windows) & (windows <= NEARLY * windows.min(axis=1, keepdims=True)))
                    pick = np.unique(at + step)
                chosen.append(own[pick])
                owner.append(np.full(len(pick), k))
            pairs = np.unique(np.stack([np.concatenate(chosen), np.concatenate(owner)], axis=1), axis=0) if chosen else np.empty((0, 2), dtype=np.int64)
            numbers, bounds = np.unique(pairs[:, 0], return_index=True)
            out[n] = (Known(known[numbers.astype(np.int64)]), np.append(bounds, len(pairs)), pairs[:, 1].astype(np.int64))
        return out


MATCH, MISMATCH, GAP = 2, -1, -1


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Best Smith-Waterman score of each pair of texts (as hashes of units), and their longest run of equal units.

    Pairs of similar size are aligned together, a row of all tables at a time.
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(order):
        group, width = [], 0
        while at < len(order):
            longer = max(width, len(pairs[order[at]][0]))
            if group and (longer * (len(group) + 1) > CELLS or len(pairs[order[at]][1]) > 1.5 * len(pairs[group[0]][1]) + 8):
                break
            group.append(order[at])
            width = longer
            at += 1
        for i, found in zip(group, _align([pairs[i] for i in group], width), strict=True):
            out[i] = found
    return out


def _align(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> list[tuple[int, int]]:
    deep, many = max(len(b) for _, b in pairs), len(pairs)
    # Numbers instead of hashes; what fills up shorter texts equals nothing and can only lower later scores.
    _, number = np.unique(np.concatenate([x for p in pairs for x in p]), return_inverse=True)
    number = number.astype(np.int32)
    doc, item = np.full((many, width), -1, dtype=np.int32), np.full((deep, many), -2, dtype=np.int32)
    at = 0
    for k, (a, b) in enumerate(pairs):
        doc[k, : len(a)] = number[at : at + len(a)]
        item[: len(b), k] = number[at + len(a) : at + len(a) + len(b)]
        at += len(a) + len(b)
    score, run = np.zeros((many, width + 1), dtype=np.int32), np.zeros((many, width + 1), dtype=np.int32)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    best, longest = np.zeros(many, dtype=np.int32), np.zeros(many, dtype=np.int32)
    step = np.zeros_like(score)
    for row in item:
        same = doc == row[:, None]
        np.maximum(score[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), score[:, 1:] + np.int32(GAP), out=step[:, 1:])
        np.maximum(step, 0, out=step)
        # A gap along the document: the best earlier cell less the way from it.
        step += slope
        np.maximum.accumulate(step, axis=1, out=score)
        score -= slope
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        np.maximum(best, score.max(axis=1), out=best)
        np.maximum(longest, run.max(axis=1), out=longest)
        step[:, 0] = 0
    return list(zip(best.tolist(), longest.tolist(), strict=True))


def _stretches(places: np.ndarray, reach: int, length: int) -> list[tuple[int, int]]:
    """Parts of a document within ``reach`` of a seed, merged where they touch."""
    out: list[tuple[int, int]] = []
    for p in np.sort(places).tolist():
        a, b = max(0, p - reach), min(length, p + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _compare(texts: list[str], items: Items, seeds: dict) -> Iterator[tuple[int, int, int, int]]:
    """``(text, item, score, longest run)`` for the texts that hold seeds."""
    mode = items.mode
    codes, starts = encode(texts, mode)
    wanted = []
    for n in items.sizes:
        known, bounds, owners = seeds[n]
        text, at = _places(starts, n)
        found, number = known.find(grams(codes, n)[at])
        times = np.diff(bounds)[number]
        owner = owners[np.repeat(bounds[number], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)] if len(number) else np.empty(0, dtype=np.int64)
        rows = pd.DataFrame({"text": np.repeat(text[found], times), "item": owner, "at": np.repeat(at[found], times), "seed": np.repeat(number, times)})
        if n != mode.gram:  # a short n-gram alone may be chance
            rows = rows[rows.groupby(["text", "item"])["seed"].transform("nunique") >= TOGETHER]
        wanted.append(rows)
    pairs, of = [], []
    for (t, k), places in pd.concat(wanted).groupby(["text", "item"], sort=False)["at"]:
        item, begin, length = items.code(k), starts[t], starts[t + 1] - starts[t]
        # An alignment with a score is at most three times as long as the item, so parts overlap by that much.
        part = max(CELLS // 8, 6 * len(item))
        for a, b in _stretches(places.to_numpy() - begin, 3 * len(item), length):
            for c in range(a, b, part):
                pairs.append((codes[begin + c : begin + min(b, c + part + 3 * len(item))], item))
                of.append((t, k))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for key, (s, r) in zip(of, align(pairs), strict=True):
        had = best.get(key, (0, 0))
        best[key] = (max(s, had[0]), max(r, had[1]))
    for (t, k), (s, r) in best.items():
        yield t, k, s, r


def _cut(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of a batch of at most ``BATCH_CHARS`` characters, or one text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > BATCH_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", min_score: float = 0.4, edited: bool = True, block_units: int = BLOCK_UNITS) -> DataFrame:
    """``doc_id, item_id, score, longest_run, verbatim``: the items of which each document holds a part.

    ``score`` is the alignment score as a part of the item's own; a pair is reported from ``min_score`` on, or if the score is that of 12
    words (24 characters for items with Chinese ones) and as many stand in a row, which is ``verbatim``: these are all
    found. Edited and paraphrased copies (``edited``) are found by their rarer short n-grams. The corpus is read
    twice for each block of items and never shuffled. Null or empty texts and null identifiers hold nothing;
    items shorter than a seed cannot be found. A repeated document or item row gives no second row.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "leaks")
    docs = documents.select(F.col(id_col).alias("doc"), F.col(text).alias("body")).where("doc IS NOT NULL AND body IS NOT NULL AND body <> ''")
    wanted = items.select(F.col(item_col).alias("item"), F.col(text).alias("body")).where("item IS NOT NULL AND body IS NOT NULL").distinct()
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    result = f"doc {kind(docs, 'doc')}, item {kind(wanted, 'item')}, score double, longest_run int, verbatim boolean"
    out = None
    for block in _blocks(wanted, block_units):
        part = scratch.write(_find_block(docs, block, min_score, edited, result))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], result)
    out = out.groupBy("doc", "item").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"), F.max("verbatim").alias("verbatim"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.round("score", 6).alias("score"), "longest_run", "verbatim")


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """Items block by block; the driver holds one block and one partition of items."""
    block, size = [], 0
    for row in items.toLocalIterator():
        # A word takes more than one character, a Chinese character is a unit of its own.
        n = len(row.body) if HAN.search(row.body) else len(row.body) // 4
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row.item, row.body))
        size += n
    if block:
        yield block


def _find_block(docs: DataFrame, rows: list[tuple[object, str]], min_score: float, edited: bool, result: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    blocks = [Items(part, mode, edited) for mode in (WORDS, CHARS) if (part := [(i, t) for i, t in rows if mode_of(t) == mode])]
    sent = sc.broadcast(blocks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        sums = [{n: np.zeros(len(b.known[n].sorted), dtype=np.int64) for n in b.sizes} for b in known]
        for pdf in batches:
            texts = list(pdf["body"])
            for x, y in _cut(texts):
                for b, of in zip(known, sums, strict=True):
                    here = [texts[x + i] for i in b.texts_for(texts[x:y])]
                    codes, starts = encode(here, b.mode)
                    for n in b.sizes:
                        text, at = _places(starts, n)
                        found, number = b.known[n].find(grams(codes, n)[at])
                        if len(found):  # once a document
                            once = np.unique(number * len(here) + text[found]) // len(here)
                            of[n] += np.bincount(once, minlength=len(of[n]))
        for k, of in enumerate(sums):
            for n, times in of.items():
                at = np.flatnonzero(times)
                if len(at):
                    yield pd.DataFrame({"block": np.int32(k), "size": np.int32(n), "number": at, "n": times[at]})

    counted = docs.select("body").mapInPandas(count, "block int, size int, number bigint, n bigint").groupBy("block", "size", "number").agg(F.sum("n").alias("n")).toPandas()
    seeds = []
    for k, b in enumerate(blocks):  # at most a row for each n-gram of the block
        frequency = {}
        for n in b.sizes:
            of = counted[(counted["block"] == k) & (counted["size"] == n)]
            frequency[n] = np.zeros(len(b.known[n].sorted), dtype=np.int64)
            frequency[n][of["number"].to_numpy()] = of["n"].to_numpy()
        seeds.append(b.seeds(frequency))
    sent_seeds = sc.broadcast(seeds)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, start = sent.value, sent_seeds.value
        for pdf in batches:
            texts, ids = list(pdf["body"]), pdf["doc"].tolist()
            for x, y in _cut(texts):
                found = []
                for b, seed in zip(known, start, strict=True):
                    which = b.texts_for(texts[x:y])
                    for t, k, s, r in _compare([texts[x + i] for i in which], b, seed):
                        share = s / (MATCH * len(b.code(k)))
                        verbatim = s >= MATCH * b.mode.run and r >= b.mode.run
                        if share >= min_score or verbatim:
                            found.append((ids[x + which[t]], b.ids[k], share, r, verbatim))
                if found:
                    yield pd.DataFrame(found, columns=["doc", "item", "score", "longest_run", "verbatim"])

    return docs.mapInPandas(compare, result)
