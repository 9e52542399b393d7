"""Long exact spans shared between pages, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import whole_groups
from ..session import broadcast_if_small, materialise, width

PIECE = 1_000_000  # code points worked on at a time
LONGEST = 1024  # windows in one packed string
SALTS = 16  # parts of a key that may be in many pages


def _hash(cp: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit hash of every `length` consecutive code points, from hashes of doubled lengths."""
    mult = np.uint64(0x9E3779B97F4A7C15 ^ (seed * 0x632BE59BD9B4E019 & (1 << 64) - 1) | 1)
    level = (cp.astype(np.uint64) + np.uint64(seed + 1)) * mult
    level ^= level >> np.uint64(31)
    done, have, size = None, 0, 1
    n = len(cp) - length + 1
    while True:
        if length & size:
            tail = level[have : have + n]
            done = tail.copy() if done is None else (done * mult + tail) ^ (done >> np.uint64(27))
            have += size
        if have == length:
            return done
        level = (level[: len(level) - size] * mult + level[size:]) * np.uint64(0xD6E8FEB86659FD93)
        level ^= level >> np.uint64(32)
        size *= 2


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    size = 1
    n = len(x) - w + 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def _pieces(ids: list[int], texts: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(ids, offsets, texts) of about PIECE characters at a time; a longer text comes in slices that overlap by k - 1."""
    own, off, out, size = [], [], [], 0
    for doc, text in zip(ids, texts, strict=True):
        for a in range(0, max(1, len(text) - k + 1), PIECE):
            own.append(doc)
            off.append(a)
            out.append(text[a : a + PIECE + k - 1])
            size += len(out[-1])
            if size >= PIECE:
                yield np.array(own, np.int64), np.array(off, np.int64), out
                own, off, out, size = [], [], [], 0
    if out:
        yield np.array(own, np.int64), np.array(off, np.int64), out


def super_kmers(texts: list[str], k: int, m: int) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, minimiser) of the runs of consecutive windows of k characters that share a minimiser of m."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) < k:
        return none, none, none, none
    low = _sliding_min(_hash(cp, m, 7), k - m + 1)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, np.arange(len(low)), side="right")
    inside = np.arange(len(low)) + k <= ends[owner]
    cut = np.ones(len(low), bool)
    cut[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(cut)
    n = np.diff(np.append(at, len(low)))
    at, n = at[inside[at]], n[inside[at]]
    if len(n) and n.max() > LONGEST:
        parts = -(-n // LONGEST)
        rep = np.repeat(np.arange(len(at)), parts)
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, n = at[rep] + nth * LONGEST, np.minimum(n[rep] - nth * LONGEST, LONGEST)
    own = owner[at]
    return own, at - (ends - sizes)[own], n, low[at].view(np.int64)


def _runs(k: int, m: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, offsets, texts in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), k):
                own, at, n, low = super_kmers(texts, k, m)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array((at + offsets[own]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(low)], names=["doc_id", "at", "n", "mini"])

    return run


def _packed(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed strings of the runs listed with each page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for doc, text, runs in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                for r in runs:
                    out.append((doc, r["at"], r["mini"], text[r["at"] : r["at"] + r["n"] + k - 1]))
                    size += r["n"] + k
                if size > PIECE:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], names=["doc_id", "at", "mini", "packed"])

    return run


def _windows(docs: np.ndarray, starts: np.ndarray, packed: list[str], k: int) -> tuple[np.ndarray, ...]:
    """(string number, offset, hash, hash) of all windows of packed strings."""
    sizes = np.array([len(p) for p in packed])
    cp = np.frombuffer("".join(packed).encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b = _hash(cp, k, 1), _hash(cp, k, 2)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, np.arange(len(a)), side="right")
    ok = np.flatnonzero(np.arange(len(a)) + k <= ends[owner])
    own = owner[ok]
    return own, starts[own] + ok - (ends - sizes)[own], a[ok], b[ok]


def _spans(doc: np.ndarray, at: np.ndarray, k: int) -> pa.RecordBatch:
    """Maximal stretches of consecutive shared windows."""
    o = np.lexsort((at, doc))
    doc, at = doc[o], at[o]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    f = np.flatnonzero(first)
    last = np.append(f[1:], len(doc)) - 1 if len(f) else f
    return pa.RecordBatch.from_arrays([pa.array(doc[f], pa.int64()), pa.array(at[f].astype(np.int32)), pa.array((at[last] + k).astype(np.int32))], names=["doc_id", "a", "b"])


def _count(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Within a bucket: sort its windows and keep those that more than one page has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in whole_groups(batches, ("mini",)):
            own, at, a, b = _windows(c["doc_id"], c["at"].astype(np.int64), list(c["packed"]), k)
            doc = c["doc_id"][own]
            o = np.lexsort((doc, b, a))
            a, b, doc, at = a[o], b[o], doc[o], at[o]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            f = np.flatnonzero(new)
            last = np.append(f[1:], len(a)) - 1
            shared = (doc[f] != doc[last])[np.cumsum(new) - 1]
            if shared.any():
                yield _spans(doc[shared], at[shared], k)

    return run


def _hot_windows(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pack = _packed(k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in pack(batches):
            docs = c.column(0).to_numpy()
            own, at, a, b = _windows(docs, c.column(1).to_numpy().astype(np.int64), c.column(3).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array(docs[own]), pa.array(at.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc_id", "a", "h1", "h2"])

    return run


def shared_spans(pages: DataFrame, page_id: str = "doc_id", page_text: str = "text", least: int = 200, m: int | None = None, hot: int = 5_000) -> DataFrame:
    """How much of each page stands, in stretches of at least `least` characters, letter for letter in another page.

    Windows of `least` code points; consecutive windows with the same minimiser (of m, by default half of `least`) form one run. Runs
    whose minimiser only one page has are dropped first, by a join of numbers alone: windows of equal text have equal minimisers. The
    other runs travel as packed strings to the bucket of their minimiser, where sorting finds the windows of more than one page. A
    minimiser of more than `hot` runs is no bucket of its own: its windows are counted by a mergeable aggregate and joined back, the list of
    shared ones broadcast if counted small, else salted by page, so no task holds them all. Windows are compared by 128 bits of hash. Of exact copies one page stands for all. No pairs of pages are formed.

    One row per page: doc_id, n_chars, shared_chars (characters inside shared stretches), n_spans, longest (of the stretches), share.
    NULL text counts as empty; pages shorter than `least` share nothing; NULL ids are left out; ids name pages (repeated rows are one
    a page); stretches repeated inside one page only do not count; empty tables give an empty result; other columns are ignored.
    """
    m = m or max(8, least // 2)
    docs = pages.select(F.col(page_id).cast("bigint").alias("doc_id"), F.coalesce(page_text, F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    long_docs = docs.where(F.length("text") >= least)
    # exact copies: one page stands for all of them; what has a copy is shared from end to end
    twin = long_docs.select("doc_id", F.md5("text").alias("h1"), F.xxhash64("text").alias("h2")).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    twin = materialise(twin, "copies")
    found = long_docs.mapInArrow(_runs(least, m), "doc_id BIGINT, at INT, n INT, mini BIGINT")
    runs = materialise(found.join(twin.select(F.col("first").alias("doc_id")), "doc_id", "left_semi"), "runs")
    several = materialise(runs.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("mini", (F.col("rows") > hot).alias("hot")), "minimisers")

    def among(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose keys are in a list of distinct ones: broadcast if counted small, else each key spread over SALTS tasks by page."""
        if (small := broadcast_if_small(few, 20_000)) is not few:
            return rows.join(small, keys, "left_semi")
        salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left_semi").drop("salt")

    def packed(mine: DataFrame) -> DataFrame:
        return long_docs.join(mine.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "mini")).alias("runs")), "doc_id").select("doc_id", "text", "runs")

    schema = "doc_id BIGINT, a INT, b INT"
    strings = packed(runs.join(several.where("NOT hot").select("mini"), "mini", "left_semi")).mapInArrow(_packed(least), "doc_id BIGINT, at INT, mini BIGINT, packed STRING")
    spans = strings.repartition(width(docs.sparkSession), "mini").sortWithinPartitions("mini").mapInArrow(_count(least), schema)
    hot_ones = several.where("hot").select("mini")
    if not hot_ones.isEmpty():
        each = materialise(packed(among(runs, hot_ones, ["mini"])).mapInArrow(_hot_windows(least), "doc_id BIGINT, a INT, h1 BIGINT, h2 BIGINT"), "hot_windows")
        twice = materialise(each.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2"), "twice")
        spans = spans.unionByName(among(each, twice, ["h1", "h2"]).select("doc_id", "a", (F.col("a") + least).alias("b")))
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("a", "b"))),
        F.struct(F.lit(0).alias("total"), F.lit(-1).alias("reach"), F.lit(0).alias("spans"), F.lit(0).alias("from"), F.lit(0).alias("longest")),
        lambda s, x: F.struct(
            (s["total"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["reach"]))).alias("total"),
            F.greatest(s["reach"], x["b"]).alias("reach"),
            (s["spans"] + (x["a"] > s["reach"]).cast("int")).alias("spans"),
            F.when(x["a"] > s["reach"], x["a"]).otherwise(s["from"]).alias("from"),
            F.greatest(s["longest"], F.greatest(s["reach"], x["b"]) - F.when(x["a"] > s["reach"], x["a"]).otherwise(s["from"])).alias("longest"),
        ),
    )
    per_page = spans.groupBy("doc_id").agg(fold.alias("s"))
    size = F.length("text")
    sizes = docs.groupBy("doc_id").agg(F.max(size).alias("n_chars"), F.max(F.when(size >= least, F.struct(size.alias("l"), F.md5("text").alias("h1"), F.xxhash64("text").alias("h2")))).alias("k"))
    copied = twin.where("first < last").select("h1", "h2", F.lit(True).alias("copied"))
    whole = sizes.select("doc_id", "n_chars", "k.h1", "k.h2").join(copied, ["h1", "h2"], "left")
    got = lambda c: F.when(F.col("copied"), F.lit(1) if c == "spans" else F.col("n_chars")).otherwise(F.coalesce(F.col(f"s.{c}"), F.lit(0))).cast("bigint")
    return whole.join(per_page, "doc_id", "left").select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), got("total").alias("shared_chars"), got("spans").alias("n_spans"), got("longest").alias("longest"),
        F.when(F.col("n_chars") > 0, got("total") / F.col("n_chars")).otherwise(0.0).alias("share"),
    )
