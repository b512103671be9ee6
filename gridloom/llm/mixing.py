"""Mixing sources to target weights with soft memberships, in DataFrame functions only.

A table of labels names the domain of some documents. A naive Bayes classifier over binned text features (among
them hits of a small lexicon learned from a bounded sample of labelled documents) gives every document posteriors
p over the domains. Nonnegative rates r then minimise the squared gap between the expected domain token totals
sum(r * tokens * p) and the targets, by projected gradient descent from r = 1 in the metric of tokens:

    r <- max(0, r + p . M^-1 (target - sum(r tokens p))),   M = sum(tokens p p')

for which a step of one is safe. p follows from the bins, so tokens are summed by them first and a round is one
aggregation over the sets of bins that occur, whatever the number of documents; rates are a function of p and the rounds'
small vectors, so no table grows with the rounds. ``copies`` rounds a
rate by the hashed id: floor or ceiling, right in expectation.

Bounds: ``most_sample`` labelled documents and ``most_words`` words of lexicon; everything else covers all rows.

Defined results: a null text counts as empty, with no tokens and no influence on the totals. Without labels each
domain is equally likely. Domains that no document can belong to can't reach a positive target; the rest is fitted.
Rows repeated under one id get one rate each, the same. A null id is hashed as null. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import table, written

TOKEN = r"[^\x20\x09-\x0D]+"
#: Bins of a feature.
BINS = 12
FEATURES = ("length", "symbols", "capitals", "digits", "breaks", "lexicon", "width")


def _bin(x: Column) -> Column:
    """A rate a token into bins of doubling width."""
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.log2(1 + 512 * x)))).cast("int")


def features(docs: DataFrame, lexicon: list[str], id_col: str = "doc_id", text_col: str = "text", carried: list[Column] | None = None) -> DataFrame:
    """One row per document, from one scan: doc_id, tokens, bins, and what is ``carried`` along."""
    carried = [c.alias(f"_gl_{k}") for k, c in enumerate(carried or [])]
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *carried)
    t, words = F.col("t"), "|".join(lexicon)
    tokens = F.regexp_count(t, F.lit(TOKEN))
    hits = F.regexp_count(t, F.lit(rf"(?i)\b(?:{words})\b")) if lexicon else F.lit(0)
    d = d.select("doc_id", F.char_length(t).alias("n"), tokens.alias("tokens"), *[F.regexp_count(t, F.lit(p)).alias(k) for k, p in (("s", r"[%$#&*!|=<>{}\[\]\\^~]{2,}"), ("c", r"[A-Z]{2,}"), ("g", r"[0-9]+"), ("b", r"\n"))], hits.alias("x"), *[f"_gl_{k}" for k in range(len(carried))])
    per = lambda c: F.col(c) / F.greatest("tokens", F.lit(1))
    bins = [
        F.least(F.lit(BINS - 1), F.floor(F.log2(1.0 + F.col("n")) / 2)).cast("int"),
        _bin(per("s")),
        _bin(per("c")),
        _bin(per("g")),
        _bin(per("b")),
        F.least(F.lit(BINS - 1), F.col("x")).cast("int"),
        F.least(F.lit(BINS - 1), F.floor(per("n"))).cast("int"),
    ]
    return d.select("doc_id", F.col("tokens").cast("long").alias("tokens"), F.array(*bins).alias("bins"), *[f"_gl_{k}" for k in range(len(carried))])


def learned_lexicon(docs: DataFrame, domains: DataFrame, most_sample: int = 3000, most_words: int = 24, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Words that most unevenly mark documents of one domain, from a bounded sample of labelled documents."""
    sample = F.broadcast(domains.orderBy(F.xxhash64("id"), "id").limit(most_sample))
    some = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("t")).join(sample, "id")
    words = some.select("domain", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"([a-z]{4,})"), 1))).alias("w"))
    per = words.groupBy("w", "domain").agg(F.count(F.lit(1)).alias("n"))
    size = some.groupBy("domain").agg(F.count(F.lit(1)).alias("size"))
    share = per.join(F.broadcast(size), "domain").groupBy("w").agg(F.sum("n").alias("all"), F.max(F.col("n") / F.col("size")).alias("hi"), F.sum(F.col("n") / F.col("size")).alias("sum"))
    lift = (F.col("hi") + 1e-3) / (F.col("sum") - F.col("hi") + 1e-3)
    rows = share.where("all >= 8").orderBy(F.desc(F.col("hi") * F.log(lift)), "w").limit(most_words).collect()
    return [r.w for r in rows]


@dataclass
class Classifier:
    """Naive Bayes over bins: log priors, and log probabilities [feature][bin] a domain."""

    domains: list[str]
    prior: list[float]
    table: dict[str, list[list[float]]]
    lexicon: list[str] = field(default_factory=list)

    def posterior(self, bins: Column) -> dict[str, Column]:
        score = {}
        for k, prior in zip(self.domains, self.prior):
            s = F.lit(prior)
            for f, logs in enumerate(self.table[k]):
                s = s + F.element_at(F.array(*[F.lit(x) for x in logs]), F.element_at(bins, f + 1) + 1)
            score[k] = s
        top = F.greatest(*score.values()) if len(score) > 1 else next(iter(score.values()))
        e = {k: F.exp(s - top) for k, s in score.items()}
        total = sum(e.values(), F.lit(0.0))
        return {k: x / total for k, x in e.items()}


def classifier(feats: DataFrame, domains: DataFrame, names: list[str], lexicon: list[str]) -> Classifier:
    """From all labelled rows: one aggregation to at most features x bins x domains counts."""
    known = feats.join(domains, feats.doc_id == domains.id).select("domain", F.posexplode("bins").alias("f", "bin"))
    n = {(r.domain, r.f, r.bin): r.n for r in known.groupBy("domain", "f", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = {k: sum(v for (d, f, _), v in n.items() if d == k and f == 0) for k in names}
    whole = sum(size.values())
    return Classifier(
        names,
        [float(np.log((size[k] + 1) / (whole + len(names)))) for k in names],
        {k: [[float(np.log((n.get((k, f, b), 0) + 0.5) / (size[k] + 0.5 * BINS))) for b in range(BINS)] for f in range(len(FEATURES))] for k in names},
        lexicon,
    )


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], total: float | None = None, grow_only: bool = False, most: float | None = None, rounds: int = 40, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", carried: list[Column] | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain> for each, rate, copies, and what is ``carried`` along.

    ``domains`` (id, domain) labels some documents; ``targets`` weighs the domains. ``total`` tokens are aimed
    at: by default as many as there are; with ``grow_only`` the least number for which no domain must shrink, and
    no rate falls below 1. ``most`` is the highest rate that the projection allows; without it a domain with next to no
    documents repeats those it has as often as its target asks.
    """
    names = sorted(targets)
    domains = domains.where(F.col("domain").isin(names) & F.col("id").isNotNull()).groupBy("id").agg(F.min("domain").alias("domain"))
    domains = written(domains, "mix-domains")
    lexicon = learned_lexicon(docs, domains, id_col=id_col, text_col=text_col)
    feats = written(features(docs, lexicon, id_col, text_col, carried), "mix-features")
    model = classifier(feats, domains, names, lexicon)
    p = model.posterior(F.col("bins"))
    # posteriors follow from the bins alone: the rounds run on one row for each set of bins, not on documents
    alike = feats.groupBy("bins").agg(F.sum("tokens").alias("tokens"))
    soft = written(alike.select("tokens", *[p[k].alias(f"p_{k}") for k in names]), "mix-posteriors")
    w = F.col("tokens").cast("double")
    cols = [F.col(f"p_{k}") for k in names]
    moments = soft.agg(*[F.coalesce(F.sum(w * a), F.lit(0.0)) for a in cols], *[F.coalesce(F.sum(w * a * b), F.lit(0.0)) for a in cols for b in cols]).first()
    k = len(names)
    have, m = np.array(moments[:k]), np.array(moments[k:]).reshape(k, k)
    weights = np.array([targets[x] for x in names], float)
    weights = weights / weights.sum()
    if grow_only:
        total = max((h / x for h, x in zip(have, weights) if x > 0), default=0.0)
    target = weights * (have.sum() if total is None else total)
    inverse, least = np.linalg.pinv(m), 1.0 if grow_only else 0.0
    allowed = lambda r: F.greatest(F.lit(least), r if most is None else F.least(F.lit(float(most)), r))
    steps: list[list[float]] = []
    rate: Column = F.lit(1.0)
    for _ in range(rounds):
        gap = target - have
        if np.abs(gap).max() <= tolerance * max(1.0, target.sum()):
            break
        steps.append([float(x) for x in inverse @ gap])
        history = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
        rate = F.aggregate(history, F.lit(1.0), lambda r, s: allowed(r + sum((c * F.element_at(s, i + 1) for i, c in enumerate(cols)), F.lit(0.0))))
        before, have = have, np.array(soft.agg(*[F.coalesce(F.sum(w * a * rate), F.lit(0.0)) for a in cols]).first())
        if np.abs(have - before).max() <= tolerance * max(1.0, target.sum()):
            break
    # posteriors as one array, which the optimizer doesn't put into every use of them; no join brings rates to documents
    out = feats.withColumn("_gl_p", F.array(*[p[x] for x in names])).withColumns({f"p_{x}": F.get("_gl_p", i) for i, x in enumerate(names)}).drop("bins", "_gl_p")
    out = out.withColumn("rate", rate)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)
    return out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))


def mixed_documents(docs: DataFrame, domains: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every document as often as its ``copies`` say, with the columns of ``docs``.

    The scan that takes the features writes the columns beside them, so that text moves in no shuffle.
    """
    names = docs.columns
    plan = mix(docs, domains, targets, id_col=id_col, text_col=text_col, carried=[F.col(f"`{c}`") for c in names], **how)
    again = plan.withColumn("_gl_again", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"_gl_{k}").alias(c) for k, c in enumerate(names)])


def label_domains(labels: DataFrame) -> DataFrame:
    """(id, domain) from quality and toxic marks: toxic, good or poor."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).where("domain IS NOT NULL")


#: Target weights of the query op6.
TARGETS = {"good": 0.75, "poor": 0.2, "toxic": 0.05}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)
