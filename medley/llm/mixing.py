"""Mixing to target weights with soft domain membership, in DataFrame operations only.

1. Classifier. At most `sample` labelled documents, those with the smallest id hashes, train a naive Bayes model
   on distinct words (hashed to `buckets`) and three coarse text measures. A feature's log ratio to the average
   domain is shrunk by `shrink` pseudo-occurrences; only features with a ratio of `least` or more in some domain are
   kept. Every document gets posteriors from the domains' shares, the sum of its features' ratios, and how many of
   the kept features a text of its length would hold in each domain (Poisson counts: their absence counts too).
2. Rates. With n_i words and posteriors p_id, domain d's expected total is T_d(r) = sum_i r_i n_i p_id. Projected
   gradient descent from r = 1 minimises sum_d (T_d(r) - goal_d)^2 / T_d(1) over r >= 0 in the metric of the n_i:

       g_d = (T_d(r) - goal_d) / T_d(1);   r_i <- max(0, r_i - sum_d p_id g_d)

   The row sums of the scaled Gram matrix are 1, so a step of 1 is safe. A round is one aggregate over the narrow
   posterior table; only one number per domain reaches the driver. Rates are written every `ROUNDS_WRITTEN` rounds.
3. Copies. A document is taken floor(rate + u) times, u a fixed hash of its id and text in [0, 1).

The goal totals are target weights times a budget; by default the budget keeps the first domain at its present
total, so that documents of it are neither dropped nor repeated for its own sake.

Shuffled: one row per document, after a sum that combines in the task that read it. Broadcast: the model, at
most `buckets` rows; the labelled sample, at most `sample` ids.

Defined results: null and empty texts have no words, weigh nothing and get the domains' shares as posteriors; a
domain without labelled documents has no posterior mass unless none has, then all are alike; a domain without
expected words is left out of the fit; rows that share an id are separate documents; labels of unknown ids
and null labels are ignored; several labels of one id all count; an empty table gives an empty table; `mixed`
passes other columns through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from medley.llm.common import written

SAMPLE = 4000
BUCKETS = 1 << 16
SHRINK = 2.0
LEAST = 1.0
ROUNDS = 60
ROUNDS_WRITTEN = 15
TOLERANCE = 1e-4
WORD_SPACE = "[\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    """Words in order, lower-cased in ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, WORD_SPACE), "")


def _features(words: Column, text: Column) -> Column:
    """Hashed distinct words, and the shares of symbols, capitals and repeated words in coarse steps."""
    size = F.greatest(F.length(text), F.lit(1))
    step = lambda x: F.least(F.lit(6), F.ceil(16 * x)).cast("string")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    distinct = F.array_distinct(words)
    repeated = 1 - F.size(distinct) / F.greatest(F.size(words), F.lit(1))
    measures = F.array(F.concat(F.lit("symbols "), step(symbols / size)), F.concat(F.lit("capitals "), step(capitals / size)), F.concat(F.lit("repeated "), step(repeated)))
    return F.concat(distinct, measures)  # a word holds no space, so a measure is no word


def _exploded(rows: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    listed = rows.withColumn("words", _words(F.col("text"))).withColumn("n", F.size("words").cast("long"))
    return listed.select(*keep, "n", F.explode(_features(F.col("words"), text)).alias("feature")).withColumn(
        "bucket", F.pmod(F.xxhash64("feature"), F.lit(buckets)).cast("int")
    ).drop("feature")


def model(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int, buckets: int, shrink: float, least: float) -> tuple[DataFrame, list[float], list[float]]:
    """(bucket, one log ratio per domain), the domains' log shares, and the share of kept features in their texts."""
    k = len(domains)
    chosen = labels.where(F.col("domain").isin(domains) & F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id", "domain").limit(sample)
    train = written(docs.select("id", "text").join(F.broadcast(chosen), "id").select("domain", "text"))
    shares = {r["domain"]: r["m"] for r in train.groupBy("domain").agg(F.count(F.lit(1)).alias("m")).collect()}
    total = sum(shares.values())
    if not total:
        empty = train.select(F.lit(0).alias("bucket"), *(F.lit(0.0).alias(f"w{d}") for d in range(k))).limit(0)
        return empty, [0.0] * k, [0.0] * k
    per = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{i}") for i, d in enumerate(domains)]
    counts = _exploded(train, ["domain"], buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), *per)
    ratios = [F.log((F.col(f"c{i}") + shrink) / (F.col("c") * (shares.get(d, 0) / total) + shrink)) for i, d in enumerate(domains)]
    named = written(counts.select("bucket", "c", *(r.alias(f"w{i}") for i, r in enumerate(ratios))))
    strong = named.where(F.greatest(F.lit(0.0), *(F.col(f"w{i}") for i in range(k))) >= least)
    every = named.agg(F.sum("c")).first()[0] or 1
    held = strong.agg(*(F.sum(F.col("c") * F.exp(f"w{i}")).alias(f"h{i}") for i in range(k))).first()
    return strong.drop("c"), [math.log(shares[d] / total) if shares.get(d) else -1e6 for d in domains], [(h or 0.0) / every for h in held]


def posteriors(
    docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE, buckets: int = BUCKETS, shrink: float = SHRINK, least: float = LEAST
) -> DataFrame:
    """(rid, id, u, n, p0..): a row per document; `docs` has id and text, `labels` id and domain."""
    k = len(domains)
    weights, shares, held = model(docs, labels, domains, sample, buckets, shrink, least)
    rows = docs.select("id", "text").withColumn("u", F.pmod(F.xxhash64("id", "text"), F.lit(2**32)) / 2**32).withColumn("rid", F.monotonically_increasing_id())
    words = _exploded(rows, ["rid", "id", "u"], buckets)
    # Left join: a document without any strong feature keeps its row.
    summed = words.join(F.broadcast(weights), "bucket", "left").groupBy("rid").agg(
        F.first("id").alias("id"), F.first("u").alias("u"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"w{i}") for i in range(k))
    )
    logits = [F.col(f"w{i}") + F.lit(shares[i]) - F.col("size") * F.lit(held[i]) for i in range(k)]
    top = F.greatest(*logits) if k > 1 else logits[0]
    parts = [F.exp(x - top) for x in logits]
    whole = sum(parts[1:], parts[0])
    # Words of a document without text are the three measures alone: its posteriors are the shares.
    blank = F.col("n") == 0
    by_share = [F.exp(F.lit(s - max(shares))) for s in shares]
    share_sum = sum(by_share[1:], by_share[0])
    return summed.select("rid", "id", "u", "n", *(F.when(blank, s / share_sum).otherwise(p / whole).alias(f"p{i}") for i, (p, s) in enumerate(zip(parts, by_share))))


def fitted_rates(table: DataFrame, targets: dict[str, float], budget: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The posterior table with `rate`."""
    k = len(targets)
    names = [f"T{i}" for i in range(k)]

    def totals(rows: DataFrame) -> list[float]:
        row = rows.agg(*(F.sum(F.col("rate") * F.col("n") * F.col(f"p{i}")).alias(t) for i, t in enumerate(names))).first()
        return [row[t] or 0.0 for t in names]

    rows = written(table.withColumn("rate", F.lit(1.0)))
    start = totals(rows)
    weight = sum(targets.values())
    shares = [w / weight for w in targets.values()]
    size = budget if budget is not None else (start[0] / shares[0] if shares[0] > 0 else sum(start))
    goals = [s * size for s in shares]
    now = start
    for step in range(1, rounds + 1):
        pull = [(x - goal) / first if first > 0 else 0.0 for x, goal, first in zip(now, goals, start)]
        if max(map(abs, pull), default=0.0) <= TOLERANCE:
            break
        move = sum((F.col(f"p{i}") * F.lit(g) for i, g in enumerate(pull)), F.lit(0.0))
        rows = rows.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        if step % ROUNDS_WRITTEN == 0:
            rows = written(rows)
        now = totals(rows)
    return rows


def rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    budget: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "domain",
    **options,
) -> DataFrame:
    """doc_id, n_words, posterior per domain, rate and copies of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).alias("domain"))
    table = fitted_rates(posteriors(rows, named, list(targets), **options), targets, budget)
    return table.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_words"),
        *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(targets)),
        "rate",
        F.floor(F.col("rate") + F.col("u")).cast("long").alias("copies"),
        "u",
    )


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, each as often as its copies say, with all their columns."""
    taken = rates(docs, labels, targets, budget, id_col, text_col, **options).where("copies > 0")
    # Equal rows (same id and text) have equal rates and copies; other rows that share an id differ in u.
    taken = taken.select(F.col("doc_id").alias("id"), "u", "copies").distinct()
    u = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), F.lit(2**32)) / 2**32
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own"), u.alias("own_u"))
    met = rows.join(taken.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("id")) & (F.col("own_u") == F.col("u")))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col("row")[c].alias(c) for c in docs.columns))
