"""The signed Bayesian n-gram model: counts, posteriors, scores, sampling and training."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import sequences as S


@dataclass(frozen=True)
class Config:
    """alpha0 is the prior of each token, lam weighs negatives, eps keeps them from zero, tau0 and decay set the
    temperature. The defaults are fixed values."""

    n: int = 3
    alpha0: float = 0.1
    lam: float = 1.0
    eps: float = 1e-12
    tau0: float = 3.0
    decay: float = 1500.0
    bos: str = S.BOS
    eos: str = S.EOS

    def __post_init__(self):
        if self.n < 2 or self.alpha0 <= 0 or self.lam < 0 or self.eps <= 0:
            raise ValueError("n >= 2, alpha0 > 0, lam >= 0 and eps > 0 are needed")


def vocabulary_of(sequences: DataFrame, config: Config = Config()) -> DataFrame:
    """(domain, token): the distinct tokens of sequences (domain, tokens), without marks."""
    return sequences.select("domain", F.explode(S.strip_marks(F.col("tokens"), config.bos, config.eos)).alias("token")).distinct()


def count(sequences: DataFrame, vocabulary: DataFrame, config: Config = Config()) -> DataFrame:
    """(domain, sign, ctx, token, w): weighted n-gram counts of sequences (domain, tokens, sign, weight, bad_idx).

    sign is pos or neg. Where bad_idx is not null only windows that predict one of these positions count, each once and
    only if the position is within the sequence as given. Weights of zero or less count nothing; nor do windows that
    predict the begin mark or a token outside of vocabulary (domain, token); the end mark counts. Partially aggregated
    before its only large shuffle; the vocabulary is broadcast behind a size check."""
    rows = sequences.where((F.col("weight") > 0) & F.col("tokens").isNotNull()).select("domain", "sign", "weight", "tokens", "bad_idx")
    w = S.windows(rows, F.col("tokens"), config.n, config.bos, config.eos)
    w = w.where(F.col("bad_idx").isNull() | (F.array_contains(F.coalesce("bad_idx", F.array().cast("array<int>")), F.col("pos")) & (F.col("pos") < F.size("tokens"))))
    sums = w.where(F.col("token") != config.bos).groupBy("domain", "sign", "ctx", "token").agg(F.sum(F.col("weight").cast("double")).alias("w"))
    known = vocabulary.select(F.col("domain").alias("_d"), F.col("token").alias("_t")).distinct()
    is_known = F.col("domain").eqNullSafe(F.col("_d")) & (F.col("token") == F.col("_t"))
    return sums.join(known, is_known, "left").where((F.col("token") == config.eos) | F.col("_t").isNotNull()).drop("_d", "_t")


def from_sequences(positive: DataFrame, negative: DataFrame, vocabulary: DataFrame, config: Config = Config(), positive_weight: float = 1.0, negative_weight: float = 1.0) -> DataFrame:
    """count() of whole sequences (domain, tokens), good and bad ones, each with one weight."""
    of = lambda df, sign, w: df.select("domain", "tokens", F.lit(sign).alias("sign"), F.lit(float(w)).alias("weight"), F.lit(None).cast("array<int>").alias("bad_idx"))
    return count(of(positive, "pos", positive_weight).unionByName(of(negative, "neg", negative_weight)), vocabulary, config)


def context_totals(counts: DataFrame) -> DataFrame:
    """(domain, sign, ctx, total), ends included."""
    return counts.groupBy("domain", "sign", "ctx").agg(F.sum("w").alias("total"))


def posterior(c: Column, total: Column, v: Column, alpha0: float) -> Column:
    """The Dirichlet posterior predictive probability of a token; v is the vocabulary's size, without the end mark."""
    return (alpha0 + c) / (v * alpha0 + total)


def score(p_pos: Column, p_neg: Column, lam: float, eps: float) -> Column:
    """p_pos, divided by (p_neg + eps) to the power of lam."""
    return F.when(p_pos <= 0, F.lit(0.0)).when(F.lit(lam == 0), p_pos).otherwise(p_pos * F.pow(p_neg + eps, F.lit(-lam)))


def score_table(counts: DataFrame, vocabulary: DataFrame, config: Config = Config()) -> DataFrame:
    """(domain, ctx, token, p_pos, p_neg, score) for every seen context and every token of its domain's vocabulary.

    Contexts come from counts, at most (v+1)^(n-1) per domain whatever the number of sequences is. This is the whole
    table; for best continuations and for cells that were seen, see seen_scores()."""
    vocab = vocabulary.select("domain", "token").distinct()
    sizes = vocab.groupBy("domain").agg(F.count(F.lit(1)).alias("v"), F.sort_array(F.collect_set("token")).alias("tokens"))
    cells = _cells(counts)
    ctx = cells.groupBy("domain", "ctx").agg(F.sum("pos").alias("pos_total"), F.sum("neg").alias("neg_total"), F.map_from_entries(F.collect_list(F.struct("token", F.struct("pos", "neg")))).alias("seen"))
    grid = ctx.alias("c").join(sizes.alias("s"), F.col("c.domain").eqNullSafe(F.col("s.domain"))).select("c.domain", "ctx", "pos_total", "neg_total", "seen", "v", F.explode("tokens").alias("token"))
    got = F.try_element_at("seen", F.col("token"))
    out = grid.select("domain", "ctx", "token", posterior(F.coalesce(got["pos"], F.lit(0.0)), F.col("pos_total"), F.col("v"), config.alpha0).alias("p_pos"), posterior(F.coalesce(got["neg"], F.lit(0.0)), F.col("neg_total"), F.col("v"), config.alpha0).alias("p_neg"))
    return out.withColumn("score", score(F.col("p_pos"), F.col("p_neg"), config.lam, config.eps))


def _cells(counts: DataFrame) -> DataFrame:
    return counts.groupBy("domain", "ctx", "token").agg(F.sum(F.when(F.col("sign") == "pos", F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("sign") == "neg", F.col("w")).otherwise(0.0)).alias("neg"))


def seen_scores(counts: DataFrame, vocabulary: DataFrame, config: Config = Config(), unseen: bool = False) -> DataFrame:
    """score_table() of the cells that were seen, and with unseen of one more name per context: the first one, in the order
    of names, that was never seen there, which stands for all of them, as they have one score. No row is made of the
    product of contexts and names. Names are numbered within their domain, and the first gap in the numbers seen is the
    first name not seen. Cells of names outside of the vocabulary, such as ends, count in totals only."""
    sizes = vocabulary.select("domain", "token").distinct().groupBy("domain").agg(F.sort_array(F.collect_set("token")).alias("names"))
    sizes = sizes.select(F.col("domain").alias("_d"), "names", F.size("names").alias("v"))
    joined = _cells(counts).join(sizes, F.col("domain").eqNullSafe(F.col("_d"))).withColumn("no", F.array_position("names", F.col("token")))
    by = joined.groupBy("domain", "ctx").agg(F.first("v").alias("v"), F.sum("pos").alias("pos_total"), F.sum("neg").alias("neg_total"), F.array_sort(F.collect_list(F.when(F.col("no") > 0, F.struct("no", "token", "pos", "neg")))).alias("cells"))
    each = F.col("cells")
    if unseen:
        gap = F.size(F.filter(F.transform("cells", lambda c, i: c["no"] == i + 1), lambda same: same)) + 1
        by = by.join(sizes.select("_d", "names"), F.col("domain").eqNullSafe(F.col("_d")))
        none = F.struct(gap.cast("long").alias("no"), F.get("names", gap - 1).alias("token"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
        each = F.when(gap <= F.col("v"), F.concat("cells", F.array(none))).otherwise(F.col("cells"))
    cells = by.select("domain", "ctx", "v", "pos_total", "neg_total", F.explode(each).alias("c"))
    out = cells.select("domain", "ctx", "c.token", posterior(F.col("c.pos"), F.col("pos_total"), F.col("v"), config.alpha0).alias("p_pos"), posterior(F.col("c.neg"), F.col("neg_total"), F.col("v"), config.alpha0).alias("p_neg"))
    return out.withColumn("score", score(F.col("p_pos"), F.col("p_neg"), config.lam, config.eps))


def temperature(t: Column, tau0: float, decay: float) -> Column:
    """From tau0 at step 0 down to 1."""
    return 1 + (tau0 - 1) * F.exp(-t / decay)


def uniform(*key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of a key: the same however rows are partitioned."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)


def window_stats(ledger: DataFrame, every: int) -> DataFrame:
    """(domain, window, first_t, last_t, attempted, accepted, rejected, acceptance_rate) of a ledger (domain, t, accepted)
    per `every` steps, the last window being partial."""
    w = F.floor((F.col("t") - 1) / every).cast("long")
    ok = F.count_if("accepted")
    return ledger.groupBy("domain", w.alias("window")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("attempted"), ok.alias("accepted"), (F.count(F.lit(1)) - ok).alias("rejected"), F.round(ok / F.count(F.lit(1)), 6).alias("acceptance_rate"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finalizer of splitmix64; its three constants are fixed values)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Scores:
    """A domain's scores in memory, worked out from counts where a context is met: bounded by the contexts that were
    seen, not by data."""

    def __init__(self, counts: list[tuple[list[str], str, str, float]], vocabulary: list[str], config: Config):
        self.vocabulary, self.config = sorted(vocabulary), config
        place = {t: i for i, t in enumerate(self.vocabulary)}
        self.seen: dict[tuple, np.ndarray] = {}
        for ctx, token, sign, w in counts:
            cell = self.seen.setdefault(tuple(ctx), np.zeros((2, len(place) + 1)))
            cell[int(sign == "neg"), place.get(token, len(place))] += w
        self.scores: dict[tuple, np.ndarray] = {}
        self.sums: dict[tuple, np.ndarray | None] = {}

    def weights(self, ctx: tuple, tau: float) -> np.ndarray | None:
        """The running sums of the weights score^(1/tau), in the order of the vocabulary; None where a context was never
        seen. Kept for a temperature as long as it stays."""
        if (ctx, tau) not in self.sums:
            if len(self.sums) > 50_000:
                self.sums.clear()
            s = self.of(ctx)
            self.sums[ctx, tau] = None if s is None or not s.any() else np.cumsum((s / s.max()) ** (1 / tau))
        return self.sums[ctx, tau]

    def of(self, ctx: tuple) -> np.ndarray | None:
        if ctx not in self.scores:
            if (cell := self.seen.get(ctx)) is None:
                return None
            c = self.config
            p = (c.alpha0 + cell[:, :-1]) / (len(self.vocabulary) * c.alpha0 + cell.sum(1, keepdims=True))
            self.scores[ctx] = p[0] * (p[1] + c.eps) ** -c.lam if c.lam else p[0]
        return self.scores[ctx]

    def generate(self, seed: int, key: int, length: int, tau: float) -> list[str]:
        """A sequence of a length: each token is drawn with a weight of score^(1/tau), in the order of the vocabulary,
        uniformly where a context was never seen; ends are never drawn."""
        if length < 0 or tau <= 0:
            raise ValueError("length >= 0 and temperature > 0 are needed")
        ctx, out = (self.config.bos,) * (self.config.n - 1), []
        with np.errstate(over="ignore"):
            start = _mix(_mix(np.array([seed & (2**64 - 1)], np.uint64)) ^ np.uint64(key & (2**64 - 1)))
            us = (_mix(start + np.arange(length, dtype=np.uint64)) >> np.uint64(11)) / float(1 << 53)
        for u in us:
            weights = self.weights(ctx, tau)
            if weights is None:
                i = int(u * len(self.vocabulary))
            else:
                i = min(int(np.searchsorted(weights, u * weights[-1])), len(self.vocabulary) - 1)
            out.append(self.vocabulary[i])
            ctx = (*ctx[1:], out[-1])
        return out


#: Attempts that one task generates, and rows of counts and names up to which a model is sent to all workers.
PIECE, SENT = 5_000, 200_000


def generate(attempts: DataFrame, counts: DataFrame, vocabulary: DataFrame, seed: int = 0, config: Config = Config()) -> DataFrame:
    """attempts (domain, attempt, length, tau) with tokens: one sampled sequence each, the same for the same seed and
    attempt however rows are partitioned. A model of up to SENT rows, which are as few as the contexts seen, is sent to
    the workers, and attempts aren't shuffled; a larger one is joined with attempts in pieces of PIECE. A domain without
    a vocabulary gives empty sequences; null tokens are none."""
    spec = attempts.select("domain", F.col("attempt").cast("long").alias("attempt"), "length", "tau")
    seen = counts.select("domain", "ctx", "token", "sign", "w")
    none = [F.lit(None).cast("array<string>").alias("ctx"), "token", F.lit(None).cast("string").alias("sign"), F.lit(None).cast("double").alias("w")]
    table = seen.unionByName(vocabulary.where(F.col("token").isNotNull()).select("domain", *none).distinct())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.schema.fields) + ", tokens array<string>"

    def model(rows: list[dict]) -> Scores:
        return Scores([(r["ctx"], r["token"], r["sign"], r["w"]) for r in rows if r["sign"] is not None], [r["token"] for r in rows if r["sign"] is None], config)

    small = table.limit(SENT + 1).toArrow()
    if small.num_rows <= SENT:
        sent = attempts.sparkSession.sparkContext.broadcast(small)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict = {}
            for r in sent.value.to_pylist():
                by.setdefault(r["domain"], []).append(r)
            models: dict = {}
            for b in batches:
                made = []
                for d, a, n, tau in zip(*(b.column(c).to_pylist() for c in ("domain", "attempt", "length", "tau"))):
                    if d not in models:
                        models[d] = model(by.get(d, []))
                    made.append(models[d].generate(seed, a, n, tau) if models[d].vocabulary else [])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.string()))], [*b.schema.names, "tokens"])

        return spec.mapInArrow(each, schema)
    last = (spec.agg(F.max("attempt").alias("a")).first()["a"] or 0) // PIECE

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        scores = model(right.to_pylist())
        made = [scores.generate(seed, a, n, tau) if scores.vocabulary else [] for a, n, tau in zip(*(left.column(c).to_pylist() for c in ("attempt", "length", "tau")))]
        return left.drop_columns(["piece"]).append_column("tokens", pa.array(made, pa.list_(pa.string())))

    dealt = spec.withColumn("piece", F.floor(F.col("attempt") / PIECE).cast("int"))
    copied = table.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<int>")))
    return dealt.groupBy("domain", "piece").cogroup(copied.groupBy("domain", "piece")).applyInArrow(run, schema)


def _attempts(vocabulary: DataFrame, start: int, end: int) -> DataFrame:
    """(domain, attempt) for attempts from start to end, exclusive, in each domain."""
    return vocabulary.select("domain").distinct().withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(end - 1)).cast("array<long>")))


def merge_counts(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts after feedback: sums by key."""
    return counts.unionByName(delta).groupBy("domain", "sign", "ctx", "token").agg(F.sum("w").alias("w"))


def feedback(verdicts: DataFrame, positive_weight: float = 1.0, negative_weight: float = 1.0, ingest_negatives: bool = True) -> DataFrame:
    """What verdicts (domain, tokens, valid, bad_idx) count as: a valid sequence as a whole; an invalid one only at its
    bad places, and not at all where it has none or negatives aren't taken."""
    pos = verdicts.where("valid").select("domain", "tokens", F.lit("pos").alias("sign"), F.lit(positive_weight).alias("weight"), F.lit(None).cast("array<int>").alias("bad_idx"))
    neg = verdicts.where(~F.col("valid") & (F.size("bad_idx") > 0) & F.lit(ingest_negatives)).select("domain", "tokens", F.lit("neg").alias("sign"), F.lit(negative_weight).alias("weight"), F.array_distinct("bad_idx").alias("bad_idx"))
    return pos.unionByName(neg)


def train(spark: SparkSession, seeds: DataFrame, vocabulary: DataFrame, verdict, samples: int, batch: int, lengths: Column, seed: int = 0, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(counts, ledger): seeds (domain, tokens) are judged and counted, then `samples` sequences per domain are sampled,
    judged by verdict(DataFrame) -> DataFrame with valid, reason, bad_idx, and counted, `batch` at a time. A batch of 1
    is the sequential procedure; larger ones refresh counts once per batch. Duplicates are judged and counted again."""
    vocabulary = cut(vocabulary.select("domain", "token").distinct())
    first = seeds.where(F.size("tokens") > 0)
    counts = cut(count(feedback(verdict(first)), vocabulary, config))
    ledgers = []
    for start in range(0, samples, batch):
        attempts = _attempts(vocabulary, start, min(start + batch, samples)).withColumns({"length": lengths.cast("int"), "tau": temperature(F.col("attempt"), config.tau0, config.decay)})
        made = generate(attempts, counts, vocabulary, seed, config)
        judged = cut(verdict(made.withColumn("t", F.col("attempt") + 1)))
        ledgers.append(judged.select("domain", "t", "tokens", "valid", "reason", "bad_idx"))
        counts = cut(merge_counts(counts, count(feedback(judged), vocabulary, config)))
    ledger = ledgers[0] if ledgers else judged_none(spark)
    for more in ledgers[1:]:
        ledger = ledger.unionByName(more)
    return counts, ledger


def judged_none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "domain string, t long, tokens array<string>, valid boolean, reason string, bad_idx array<int>")


def until_valid(spark: SparkSession, counts: DataFrame, vocabulary: DataFrame, verdict, wanted: int, rounds: int, batch: int, length: int, seed: int = 0, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(counts, valid sequences): batches are sampled until every domain has `wanted` distinct valid sequences or the
    rounds are over; duplicates aren't counted again, invalid ones count as negatives as a whole."""
    vocabulary = cut(vocabulary.select("domain", "token").distinct())
    known = spark.createDataFrame([], "domain string, tokens array<string>")
    for r in range(rounds):
        attempts = _attempts(vocabulary, r * batch, (r + 1) * batch).withColumns({"length": F.lit(length), "tau": F.lit(1.0)})
        made = generate(attempts, counts, vocabulary, seed, config).dropDuplicates(["domain", "tokens"])
        judged = cut(verdict(made.join(known.withColumnsRenamed({"domain": "_d", "tokens": "_t"}), F.col("domain").eqNullSafe(F.col("_d")) & (F.col("tokens") == F.col("_t")), "left_anti")))
        known = cut(known.unionByName(judged.where("valid").select("domain", "tokens")))
        weighted = judged.select("domain", "tokens", F.when(F.col("valid"), "pos").otherwise("neg").alias("sign"), F.lit(1.0).alias("weight"), F.lit(None).cast("array<int>").alias("bad_idx"))
        counts = cut(merge_counts(counts, count(weighted, vocabulary, config)))
        have = known.groupBy("domain").count().where(F.col("count") >= wanted).count()
        if have >= vocabulary.select("domain").distinct().count():
            break
    return counts, known


