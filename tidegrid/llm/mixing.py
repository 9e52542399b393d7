"""Mixing sources to target token shares by soft membership and projected-gradient least squares."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Fixed value: the split that comes before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BINS = 4096


def count_tokens(df: DataFrame, text: str, tokenizer: str, name: str = "tokens") -> DataFrame:
    """df without `text`, with the number of its tokens (0 for NULL) by the rank file `tokenizer`, read on the driver. The vocabulary
    travels with the tasks; its size is fixed."""
    vocabulary = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        enc = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array(n, pa.int64())], names=[*rest, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + [f"`{name}` BIGINT"])
    return df.select(*rest, text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Domain:
    name: str
    share: float
    max_repeats: int


def _targets(targets: DataFrame, source: str, share: str, repeats: str) -> list[Domain]:
    rows = targets.groupBy(source).agg(F.max(share).alias("s"), F.max(repeats).alias("r")).where(F.col(source).isNotNull()).orderBy(source).collect()
    return [Domain(r[0], float(r.s or 0.0), int(r.r or 0)) for r in rows]


def posteriors(pages: DataFrame, features: str, label: Column, k: int, fit_rows: int, n: dict[int, int], buckets: int = 4096) -> DataFrame:
    """pages with `p`, an array of k domain probabilities, from logistic regression on hashed words. n: how many rows each label has.

    Only the unlabelled rows are kept; at most about fit_rows labelled rows, drawn by hash of the id, fit the model. With labels of
    fewer than two domains every unlabelled row takes the labels' frequencies (or 1 / k)."""
    lab = pages.withColumn("label", label.cast("double"))
    fresh = lab.where("label IS NULL")
    total = sum(n.values())
    if len(n) < 2:
        return fresh.withColumn("p", F.array(*[F.lit((n.get(i, 0) / total) if total else 1.0 / k) for i in range(k)])).drop(features, "label")
    words = RegexTokenizer(inputCol=features, outputCol="_w", pattern=r"[^\p{L}\p{N}.]+")
    tf = HashingTF(inputCol="_w", outputCol="_x", numFeatures=buckets, binary=True)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1e6 * min(1.0, fit_rows / total))
    sample = tf.transform(words.transform(lab.where("label IS NOT NULL").where(drawn))).select("label", "_x").persist()
    model = LogisticRegression(labelCol="label", featuresCol="_x", probabilityCol="_p", maxIter=20, regParam=0.001).fit(sample)
    sample.unpersist()
    out = model.transform(tf.transform(words.transform(fresh)))
    p = vector_to_array("_p")
    return out.withColumn("p", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at(p, i), F.lit(0.0)))).drop("_w", "_x", "rawPrediction", "_p", "prediction", features, "label")


def mix(
    pages: DataFrame, targets: DataFrame, page_id: str = "doc_id", page_text: str = "text", source: str = "source", hints: tuple[str, ...] = ("host",), share: str = "target_share",
    repeats: str = "max_repeats", *, tokenizer: str, total_tokens: float | None = None, fit_rows: int = 20_000, rounds: int = 500, tolerance: float = 1e-4,
) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): how often each page is used so that each source has its target share of the tokens, and what came of it.

    Membership is soft: a page with a source that has a target belongs to it; a page without source (NULL) belongs to the domains by the
    posterior of a classifier of its words and `hints` columns, in hundredths that sum to 1 (largest remainders). A page of a source without target is not used.
    Rates between 0 and the max_repeats of the page's domain (for soft members the one it is reported under) minimise the squared distance of the domains'
    expected token totals from total_tokens x share by projected gradient, whose sums are Spark aggregates over classes of equal
    membership. total_tokens is by default the largest total for which the labelled pages of every domain that has any can reach its share; shares
    of domains without any page are out of reach, and the others keep their proportions; without labelled pages it is 0.
    Rates become whole repeats by a threshold on a hash of the id, set per domain so that the domain's tokens come out right; a page is
    never used more often than max_repeats.

    mix: doc_id, source (the domain, for soft members the likeliest), tokens, rate, repeats; used pages only. shares: source,
    target_share, actual_share, tokens, pages, most_repeats, converged; one row per target, 0 where nothing could be used. converged is false
    if the rates still moved after `rounds` steps.
    NULL or empty text has no tokens and is not used; NULL ids are left out; repeated rows count as rows; empty tables give an empty
    mix and actual shares of 0; other columns are ignored.
    """
    spark = pages.sparkSession
    domains = _targets(targets, source, share, repeats)
    k = len(domains)
    index = {dm.name: i for i, dm in enumerate(domains)}
    label = F.coalesce(*[F.when(F.col("src") == n, F.lit(i)) for n, i in index.items()]) if k else F.lit(None)
    base = pages.select(F.col(page_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("src"), F.col(page_text).alias("text"), *[F.col(h).cast("string").alias(f"h{j}") for j, h in enumerate(hints)]).where("doc_id IS NOT NULL AND length(text) > 0")
    if not k:
        none = "doc_id BIGINT, source STRING, tokens BIGINT, rate DOUBLE, repeats INT"
        return spark.createDataFrame([], none), spark.createDataFrame([], "source STRING, target_share DOUBLE, actual_share DOUBLE, tokens BIGINT, pages BIGINT, most_repeats INT, converged BOOLEAN")
    sized = materialise(count_tokens(base.select("doc_id", "src", "text"), "text", tokenizer), "sized").where("tokens > 0")
    one_hot = F.array(*[(label == i).cast("double") for i in range(k)])
    hard = sized.where(label.isNotNull()).select("doc_id", "tokens", one_hot.alias("p"))
    words = F.concat_ws(" ", *[f"h{j}" for j in range(len(hints))], "text")
    known = base.where(F.col("src").isNull() | label.isNotNull()).select("doc_id", "src", words.alias("f"))
    labels = {int(r.i): r.n for r in sized.where(label.isNotNull()).groupBy(label.alias("i")).agg(F.count("*").alias("n")).collect()}
    guessed = posteriors(known, "f", label, k, fit_rows, labels).select("doc_id", _hundredths("p").alias("p"))
    soft = sized.where("src IS NULL").select("doc_id", "tokens").join(guessed.dropDuplicates(["doc_id"]), "doc_id")
    limits = F.array(*[F.lit(float(dm.max_repeats)) for dm in domains])
    cap = F.element_at(limits, F.array_position("p", F.array_max("p")).cast("int"))
    member = materialise(hard.unionByName(soft).withColumn("cap", cap), "members")
    classes = materialise(member.groupBy("p", "cap").agg(F.sum("tokens").alias("tokens")), "classes")

    at = lambda i: F.element_at("p", i + 1)
    row = classes.agg(*[F.sum(F.col("tokens") * at(i)).alias(f"t{i}") for i in range(k)], *[F.sum(F.when(at(i) == 1, F.col("tokens") * F.col("cap"))).alias(f"c{i}") for i in range(k)]).first()
    size = [float(row[f"t{i}"] or 0.0) for i in range(k)]
    # what labelled pages alone can give, so that soft members are never needed to reach a share
    room = [float(row[f"c{i}"] or 0.0) for i in range(k)]
    live = [i for i in range(k) if size[i] > 0 and domains[i].share > 0 and domains[i].max_repeats > 0]
    if total_tokens is None:
        total_tokens = min((room[i] / domains[i].share for i in live if room[i] > 0), default=0.0)
    goal = [total_tokens * domains[i].share if i in live else 0.0 for i in range(k)]

    state = classes.withColumn("r", F.lit(0.0))
    moves: list[list[float]] = []
    done, before, converged = 0, float("inf"), False
    for _ in range(rounds):
        sums = state.select("p", "tokens", _walk(moves[done:]).alias("r")).agg(*[F.sum(F.col("tokens") * at(i) * F.col("r")).alias(f"s{i}") for i in range(k)]).first()
        miss = [goal[i] - float(sums[f"s{i}"] or 0.0) for i in range(k)]
        off = sum(x * x for x in miss)
        # met, or as near as the bounds of the rates allow: the steps no longer bring anything
        if converged := all(abs(x) <= tolerance * max(total_tokens, 1.0) for x in miss) or before - off <= tolerance * off:
            break
        before = off
        moves.append([x / size[i] if size[i] > 0 else 0.0 for i, x in enumerate(miss)])
        if len(moves) - done >= 20:  # keeps the expression short
            state = materialise(state.withColumn("r", _walk(moves[done:])), "rates")
            done = len(moves)
    rates = state.select("p", "cap", _walk(moves[done:]).alias("rate"))
    own = F.array_position("p", F.array_max("p")).cast("int")
    used = member.join(rates, ["p", "cap"]).select("doc_id", "tokens", own.alias("k"), "rate", (F.pmod(F.xxhash64("doc_id"), F.lit(BINS)) / BINS).alias("u"), "cap")
    used = used.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("rest", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    # per domain: which hash threshold, relative to the fraction, makes the rounded tokens equal the wanted ones
    score = F.when(F.col("rest") > 1e-9, F.col("u") / F.col("rest"))
    bins = used.where(score.isNotNull()).groupBy("k", F.floor(F.least(score, F.lit(4.0)) * 1024).alias("b")).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("rest")).alias("w")).collect()
    limit = {}
    for i in range(1, k + 1):
        mine = sorted((r.b, float(r.t), float(r.w)) for r in bins if r.k == i)
        want, got, top = sum(w for _, _, w in mine), 0.0, -1
        for b, t, _ in mine:
            if got + t / 2 > want:
                break
            got, top = got + t, b
        limit[i] = float(top + 1) / 1024
    bound = F.element_at(F.array(*[F.lit(limit[i]) for i in range(1, k + 1)]), F.col("k"))
    name = F.element_at(F.array(*[F.lit(dm.name) for dm in domains]), F.col("k"))
    count = F.least(F.col("cap"), F.col("whole") + F.coalesce((F.floor(F.least(score, F.lit(4.0)) * 1024) / 1024 < bound).cast("int"), F.lit(0))).cast("int")
    result = used.select("doc_id", name.alias("source"), "tokens", "rate", count.alias("repeats")).where("repeats > 0")
    per = result.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("pages"), F.max("repeats").alias("most_repeats"))
    whole = per.agg(F.sum("tokens").alias("all_tokens"))
    plan = spark.createDataFrame([(dm.name, dm.share) for dm in domains], "source STRING, target_share DOUBLE")
    shares = plan.join(per, "source", "left").join(F.broadcast(whole), F.lit(True)).select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("all_tokens")), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.lit(converged).alias("converged"),
    )
    return result, shares


def _hundredths(p: str) -> Column:
    """The array p, of sum 1, in whole hundredths of sum 1: rounded down, the rest to the largest remainders (of equal ones the earlier)."""
    down = F.transform(p, lambda x: F.floor(x * 100 + 1e-9))
    rest = F.lit(100) - F.aggregate(down, F.lit(0).cast("bigint"), lambda a, b: a + b)
    # sorted ascending: the largest remainder has the most negative number
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((F.floor(x * 100 + 1e-9) - x * 100).alias("r"), i.alias("i"))))
    place = lambda i: F.array_position(F.transform(order, lambda o: o["i"]), i)
    return F.transform(down, lambda n, i: (n + (place(i) <= rest).cast("int")) / 100.0)


def _walk(steps: list[list[float]]) -> Column:
    """Projected-gradient steps from column r: each moves a page by its memberships and stays between 0 and cap."""
    return reduce(lambda r, s: F.greatest(F.lit(0.0), F.least(F.col("cap"), r + sum((F.element_at("p", i + 1) * x for i, x in enumerate(s)), F.lit(0.0)))), steps, F.col("r"))
