"""Evaluation passages in training pages: template windows joined by hash, slot consistency, alignment."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise
from .normalise import LOST, could_be, words

# Units of measurement that a template abstracts from.
UNITS = ("mg", "g", "kg", "ml", "l", "mm", "cm", "m", "km", "s", "min", "h", "usd", "eur", "percent")
ANCHOR = 4  # words in a row that tie a part of an item to a page beyond a foreign line
FEWEST = 6  # words of an unbroken half that need no rarity
PLAIN, HELD = 0.7, 0.85  # shares that alignments of shared phrases don't reach: of words left, and with slots filled anew
SLOT = 3.0  # names and numbers that are left tell a copy from a chance alignment
GAPS = 3  # a window is two words at most so far apart: what stands between them may differ
BITS = 1 << 24  # of a bitmap of hashes: what is broadcast never grows
CHARS = 1_000_000  # characters of pages worked on at a time


def _hash(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return pd.util.hash_array(np.array(ws, dtype=object), categorize=False) if ws else np.zeros(0, np.uint64)


NUMBER, UNIT, NAME = (np.uint64(x) for x in _hash(["<number>", "<unit>", "<name>"]))


def bitmap(df: DataFrame, column: str) -> Broadcast:
    """Broadcast bitmap of the hashes of a column, BITS long, put together by an aggregate. Its false positives only cost time."""
    at = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words_ = df.groupBy(F.shiftright(at, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(({column} & 63L) AS INT))")).alias("b")).collect()
    bits = np.zeros(BITS // 64, np.int64)
    bits[[r.k for r in words_]] = [r.b for r in words_]
    return df.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool))


def canonical(ws: list[str], h: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Words as a template: numbers, units and names (words that are none of the plain ones) replaced by typed placeholders."""
    out = np.where(plain[(h & np.uint64(BITS - 1)).astype(np.int64)], h, NAME)
    out[[k for k, w in enumerate(ws) if w.isdigit()]] = NUMBER
    out[np.isin(h, _hash(list(UNITS)))] = UNIT
    return out


def windows(t: np.ndarray, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the first word, hash, literal) of all windows: two words in order, up to GAPS apart, as templates t; where a placeholder
    takes part also with the words h that it stands for. Two placeholders make no template window."""
    slot = np.isin(t, (NUMBER, UNIT, NAME))
    at, out, literal = [], [], []
    for g in range(1, GAPS + 1):
        same = owner[g:] == owner[:-g]
        for x, k in ((t, np.flatnonzero(same & ~(slot[g:] & slot[:-g]))), (h, np.flatnonzero(same & (slot[g:] | slot[:-g])))):
            w = (x[k] * np.uint64(0x9E3779B97F4A7C15) + x[k + g]) * np.uint64(0xD6E8FEB86659FD93)
            at.append(k)
            out.append(w ^ (w >> np.uint64(32)))
            literal.append(np.full(len(k), x is h))
    return np.concatenate(at), np.concatenate(out), np.concatenate(literal)


def _words_of_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per word; low: written without capital in this item."""
    for b in batches:
        rows: list[tuple] = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if len(ws := words(text)) >= ANCHOR:
                low = set(words(" ".join(x for x in text.split() if x[:1].islower())))
                rows += [(i, k, w, w in low) for k, w in enumerate(ws)]
        i, k, w, low = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int32()), pa.array(w, pa.string()), pa.array(_hash(list(w)).view(np.int64)), pa.array(low, pa.bool_())], names=["item_id", "k", "w", "h", "low"])


def _windows_of_items(plain: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).to_pylist()
            ws = [w for x in lists for w in x]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            h = _hash(ws)
            at, win, literal = windows(canonical(ws, h, plain.value), h, owner)
            ids = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[at]]), pa.array(win.view(np.int64)), pa.array(literal)], names=["item_id", "win", "literal"])

    return run


def _parts(ids: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """About CHARS characters of whole pages at a time."""
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHARS:
            yield ids[a : k + 1], texts[a : k + 1]
            a, size = k + 1, 0
    if a < len(texts):
        yield ids[a:], texts[a:]


def _pages(plain: Broadcast, wanted: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages as their words (kind 0), how many pages have a plain word (kind 1) and how often a wanted window stands in pages (kind 2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _parts(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lists = [words(t) for t in texts]
                ws = [w for x in lists for w in x]
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                h = _hash(ws)
                known = plain.value[(h & np.uint64(BITS - 1)).astype(np.int64)]
                _, one = np.unique(h[known] * np.uint64(0x9E3779B97F4A7C15) + owner[known].astype(np.uint64), return_index=True)  # a word once a page
                word, n_word = np.unique(h[known][one], return_counts=True)
                _, win, _ = windows(canonical(ws, h, plain.value), h, owner)
                win, n_win = np.unique(win[wanted.value[(win & np.uint64(BITS - 1)).astype(np.int64)]], return_counts=True)
                n = len(ids), len(word), len(win)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(3, dtype=np.int32), n)), pa.array(np.concatenate([np.array(ids, np.int64), word.view(np.int64), win.view(np.int64)])),
                        pa.concat_arrays([pa.array([" ".join(x) for x in lists], pa.string()), pa.nulls(n[1] + n[2], pa.string())]), pa.array(np.concatenate([np.zeros(n[0], np.int64), n_word, n_win]).astype(np.int64)),
                    ],
                    names=["kind", "id", "folded", "n"],
                )

    return run


def _hits(plain: Broadcast, rare: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, window) of the rare windows, once a page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _parts(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lists = [t.split() for t in texts]
                ws = [w for x in lists for w in x]
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                h = _hash(ws)
                at, win, _ = windows(canonical(ws, h, plain.value), h, owner)
                ok = rare.value[(win & np.uint64(BITS - 1)).astype(np.int64)]
                doc, win = np.array(ids, np.int64)[owner[at[ok]]], win[ok]
                o = np.lexsort((win, doc))
                doc, win = doc[o], win[o]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (win[1:] != win[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(win[new].view(np.int64))], names=["doc_id", "win"])

    return run


def _common(masks: list[int], m: int) -> int:
    """Length of the longest common subsequence of an item of m words and a page given by the places of its words in the item, by bits."""
    full = v = (1 << m) - 1
    for x in masks:
        u = v & x
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _aligned(a: list[str], b: list[str], weight: list[float]) -> list[tuple[int, int]]:
    """Pairs of positions of the heaviest common subsequence."""
    s = np.zeros((len(a) + 1, len(b) + 1))
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    bb = np.array([codes[w] for w in b])
    for i, w in enumerate(a):
        hit = np.where(bb == codes[w], s[i, :-1] + weight[i], 0.0)
        s[i + 1, 1:] = np.maximum.accumulate(np.maximum(hit, s[i, 1:]))
    i, j, out = len(a), len(b), []
    while i and j:
        if s[i, j] == s[i - 1, j]:
            i -= 1
        elif s[i, j] == s[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _unbroken(places: dict[str, list[int]], page: list[str], at: list[int]) -> int:
    """Length of the longest stretch of the item that stands unbroken in the page; at: where the page has words of the item."""
    longest, last, before = 0, -9, {}
    for k in at:
        ks = places[page[k]]
        before = {x: before.get(x - 1, 0) + 1 for x in ks} if k == last + 1 else dict.fromkeys(ks, 1)
        last = k
        longest = max(longest, *before.values()) if len(before) > 1 else max(longest, before[ks[0]])
    return longest


def _runs(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []
    for p in pairs:
        if out and out[-1][-1] == (p[0] - 1, p[1] - 1):
            out[-1].append(p)
        else:
            out.append([p])
    return out


def judge(item: list[str], page: list[str], weight: list[float], slots: set[int], least_share: float, sure: float) -> dict | None:
    """Best passage of the page for the item: share of words in order, share of their rarity (weight), longest run, bindings of slots; None
    if no case."""
    m = len(item)
    places: dict[str, list[int]] = {}
    for k, w in enumerate(item):
        places.setdefault(w, []).append(k)
    page = [could_be(w, places) or w if LOST in w else w for w in page]
    total = max(sum(weight), 1e-9)
    room = m + m // 4 + 12
    bits = {w: sum(1 << k for k in ks) for w, ks in places.items()}
    at = [k for k, w in enumerate(page) if w in bits]
    masks = [bits[page[k]] for k in at]
    run = _unbroken(places, page, at)
    # the least words in order of any case: the share asked for, or so many that all slots filled anew make up for the rest
    least = max(1, min(math.ceil(least_share * m - 1e-9), math.ceil(HELD * m - 1e-9) - len(slots)))
    here = {page[k] for k in at}
    most = sum(x for x, w in zip(weight, item, strict=True) if w in here) / total
    enough = min(math.ceil(PLAIN * m - 1e-9), math.ceil(HELD * m - 1e-9) - len(slots))
    if 2 * run < m and ((c := _common(masks, m)) < least or (most < min(least_share, sure) and c < enough)):
        return None
    step = max(1, m // 4)
    # stretches with more of the item's words first: none with fewer than the best has in order can be better
    cuts = [(lo, bisect_left(at, lo), bisect_left(at, lo + room + step)) for lo in range(0, max(1, len(page) - room + step), step)]
    best, where = 0, 0
    for lo, f, t in sorted(cuts, key=lambda x: x[1] - x[2]):
        if t - f <= best:
            break
        if (c := _common(masks[f:t], m)) > best:
            best, where = c, lo

    def result(passage: list[str], anchored: bool) -> dict | None:
        pairs = _aligned(item, passage, [w + 0.1 for w in weight])  # words of every page count a little too
        if anchored:
            pairs = [p for r in _runs(pairs) if len(r) >= ANCHOR for p in r]
        to = dict(pairs)
        bound: dict[str, set[str]] = {}
        moved = []
        for k in sorted(slots):
            if k in to:
                bound.setdefault(item[k], set()).add(item[k])
            else:  # the word between the neighbours, or at an end of the item the one beside its neighbour
                j, after = to.get(k - 1, -9) + 1, to.get(k + 1, -9) - 1
                j, after = (after if k == 0 else j), (j if k == m - 1 else after)
                if 0 <= j == after and j < len(passage):
                    bound.setdefault(item[k], set()).add(passage[j])
                    moved.append(k)
        longest = max(run, *map(len, _runs(pairs)), 0) / m
        share = max(len(pairs), run) / m
        held = (len(pairs) + sum(1 for k in moved if len(bound[item[k]]) == 1)) / m
        rare = sum(weight[i] for i, _ in pairs) / total
        unbroken = 2 * run >= m and run >= FEWEST
        case = held >= HELD or (share >= least_share and (unbroken or share >= PLAIN or rare >= sure or (rare >= least_share and longest >= 0.4)))
        return {"share": max(share, held), "rarity": rare, "run": longest, "rebound": len(moved), "steady": all(len(v) == 1 for v in bound.values())} if case else None

    out = result(page[where : where + room + step], False) if best >= least or 2 * run >= m else None
    return out or (result(page, True) if run >= ANCHOR and len(page) > room + step else None)


def leaked_items(
    pages: DataFrame, items: DataFrame, page_id: str = "doc_id", page_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    least_share: float = 0.5, sure: float = 0.6, common: float = 0.005, enough: float = 1.0, share_m: float = 0.15,
) -> DataFrame:
    """Pages that hold an item's wording, whole or at least half of its words in order in one passage.

    Both sides are folded (case, accents, punctuation, spacing, invisible and look-alike letters, doubly encoded bytes) and canonicalised:
    numbers, units and names are typed placeholders, a name being a word of one item that no item writes without a capital. Template
    windows are two words in order, at most three apart, so that single words in between may differ or be missing; where a placeholder takes
    part, the window also counts with the word it stands for, since copies mostly keep it. Windows of the items
    are a table, joined with the windows of the pages by hash; pages send only windows that a bitmap of fixed size may hold. Windows
    that stand in pages more often than `common` times their number (20 times at least) are phrases everybody uses and don't make a pair,
    but an item keeps its rarest template windows, `enough` x its words, however common they are. Half of an item's words in order leave at least
    m / 3 - 1 windows whole, m being its words, if the page adds none in between; rare ones are a part of them. A page that shares share_m x the
    item's words (of an item with few rare windows a sixth of those) is aligned with it: in the best stretch of 1.25 items, or over
    the whole page by parts of four unbroken words, where a foreign line of any length may lie between.
    A case has at least `least_share` of the item's words in order. Phrases that pages of a language share reach that by chance, so one of
    these must hold besides: half of the item unbroken; 0.7 of the words; `sure` of the rarity of its words (inverse page
    frequency over all pages; a slot counts SLOT times its rarest plain word), or `least_share` of it with a run of 0.4 of the item. An item whose slots are filled anew is a case from 0.85 of
    the words, a slot counting only if it is filled alike wherever the item repeats it.

    Items of fewer than four words are never found. NULL ids or texts match nothing; repeated pages are rows of their own,
    repeated item ids are one item (the larger text); empty tables give an empty result; other columns are ignored.
    Result: item_id, doc_id, share, rarity, run DOUBLE, rebound INT (slots filled anew), steady BOOLEAN (each slot always filled alike).
    """
    docs = pages.select(F.col(page_id).cast("bigint").alias("doc_id"), F.col(page_text).alias("text")).dropna()
    held = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).dropna().groupBy("item_id").agg(F.max("text").alias("text"))
    each = materialise(held.mapInArrow(_words_of_items, "item_id BIGINT, k INT, w STRING, h BIGINT, low BOOLEAN"), "item_words")
    lexicon = each.where(~F.col("w").rlike("^[0-9]+$") & ~F.col("w").isin(*UNITS)).groupBy("w", "h").agg(F.max("low").alias("low"), F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("low OR a < b").select("w", "h")
    lexicon = materialise(lexicon, "lexicon")
    plain = bitmap(lexicon, "h")
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct("k", *c)))
    texts = each.groupBy("item_id").agg(ordered("w").alias("x")).select("item_id", F.transform("x", lambda x: x["w"]).alias("w"))
    wins = materialise(texts.mapInArrow(_windows_of_items(plain), "item_id BIGINT, win BIGINT, literal BOOLEAN").distinct(), "item_windows")
    folded = materialise(docs.mapInArrow(_pages(plain, bitmap(wins, "win")), "kind INT, id BIGINT, folded STRING, n BIGINT"), "folded")
    page = folded.where("kind = 0").select(F.col("id").alias("doc_id"), "folded")
    total = page.count()
    count = lambda kind: folded.where(F.col("kind") == kind).groupBy("id").agg(F.sum("n").alias("n"))
    # rarity of the words of the items; a slot counts SLOT times as much as the item's rarest plain word
    rare = F.when(F.col("plain"), F.log((F.lit(total) + 2) / (F.coalesce("n", F.lit(0)) + 1)))
    known = lexicon.join(count(1).withColumnRenamed("id", "h"), "h", "left").select("w", "n", F.lit(True).alias("plain"))
    item = each.join(known, "w", "left").withColumns({"plain": F.coalesce("plain", F.lit(False)), "weight": rare})
    item = item.withColumn("weight", F.coalesce("weight", SLOT * F.max("weight").over(Window.partitionBy("item_id")), F.lit(1.0)))
    item = materialise(item.groupBy("item_id").agg(ordered("w", "weight", "plain").alias("x"), F.count("*").alias("m")), "items")
    # which windows make pairs
    seen = wins.join(count(2).withColumnRenamed("id", "win"), "win", "left").join(item.select("item_id", "m"), "item_id")
    rank = F.row_number().over(Window.partitionBy("item_id", "literal").orderBy(F.coalesce("n", F.lit(0)), "win"))
    few = (F.coalesce("n", F.lit(0)) <= max(20.0, common * total)) | (~F.col("literal") & (F.col("rank") <= enough * F.col("m")))
    kept = seen.withColumn("rank", rank).where(few).withColumn("of", F.count_if(~F.col("literal")).over(Window.partitionBy("item_id")))
    need = F.greatest(F.lit(1.0), F.least(F.ceil(F.col("m") * share_m), F.ceil(F.col("of") / 6)))
    kept = materialise(kept.where("n IS NOT NULL").select("item_id", "win", need.alias("need")), "kept")
    hits = page.mapInArrow(_hits(plain, bitmap(kept, "win")), "doc_id BIGINT, win BIGINT")
    pairs = hits.join(kept, "win").groupBy("item_id", "doc_id").agg(F.count_distinct("win").alias("n"), F.max("need").alias("need")).where("n >= need").select("item_id", "doc_id")
    per_page = pairs.join(broadcast_if_small(item, 2_000), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "x")).alias("c"))
    found = materialise(per_page, "candidates").join(page, "doc_id").select("doc_id", "folded", "c")
    return found.mapInArrow(_verified(least_share, sure), "item_id BIGINT, doc_id BIGINT, share DOUBLE, rarity DOUBLE, run DOUBLE, rebound INT, steady BOOLEAN").dropDuplicates(["item_id", "doc_id"])


def _verified(least_share: float, sure: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("item_id", "doc_id", "share", "rarity", "run", "rebound", "steady")
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, items in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                page = text.split()
                for c in items:
                    x = c["x"]
                    slots = {y["k"] for y in x if not y["plain"]}
                    if v := judge([y["w"] for y in x], page, [y["weight"] for y in x], slots, least_share, sure):
                        rows.append((c["item_id"], doc, *(v[y] for y in names[2:])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(y, z) for y, z in zip(cols, types, strict=True)], names=list(names))

    return run
