"""Mixing to target weights by soft domain membership; DataFrame functions only on the main path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, least_hashed

WORDS = r"[^\p{L}]+"


@dataclass
class DomainModel:
    """Multinomial naive Bayes over a bounded vocabulary: ``table`` has (word, w0..wK-1), K = len(domains)."""

    domains: list[str]
    prior: list[float]
    table: DataFrame


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: w != "")


def fit_domains(labelled: DataFrame, domain_col: str, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 10_000, vocabulary: int = 4096, max_domains: int = 64) -> DomainModel:
    """Fit on at most ``sample_rows`` labelled rows, those of least hash of the id, and their ``vocabulary`` commonest words.

    Rows without a domain are left out. The vocabulary table is bounded by its parameter, so it can be broadcast.
    """
    rows = labelled.where(F.col(domain_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(domain_col).cast("string").alias("domain"))
    ids = least_hashed(rows.select("id").distinct(), "id", sample_rows)
    words = rows.join(ids, "id", "left_semi").select("domain", F.explode(_words(F.col("text"))).alias("word"))
    counts = cut(words.groupBy("word", "domain").count())
    totals = counts.groupBy("domain").agg(F.sum("count").alias("n")).orderBy("domain").limit(max_domains + 1).collect()
    if len(totals) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    domains, n = [r.domain for r in totals], [r.n for r in totals]
    common = counts.groupBy("word").agg(F.sum("count").alias("c"), *[F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)).alias(f"c{k}") for k, d in enumerate(domains)])
    common = common.orderBy(F.desc("c"), "word").limit(vocabulary)
    table = common.select("word", *[F.log((F.col(f"c{k}") + 0.5) / (n[k] + 0.5 * vocabulary)).alias(f"w{k}") for k in range(len(domains))])
    if not domains:
        table = common.select("word")
    return DomainModel(domains, [x / sum(n) for x in n], cut(table))


def domain_posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 2.0) -> DataFrame:
    """(id, digest, rows, tokens, p0..pK-1): one row for each different (id, text); ``rows`` counts repeats of it.

    The evidence is the mean log likelihood of a text's words times ``sharpness``, shrunk for short texts, so
    memberships stay soft. A text without known words, null or empty, gets the prior. Words are looked up in a
    broadcast vocabulary of bounded size and summed where they are read; only sums are shuffled.
    """
    k = range(len(model.domains))
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), _words(F.col(text_col)).alias("words"))
    # All that a row needs is computed below the explosion, once a row.
    each = split.select("id", "digest", F.size("words").cast("bigint").alias("n"), "words").select("id", "digest", "n", F.explode_outer("words").alias("word"))
    found = each.join(F.broadcast(model.table), "word", "left")
    sums = found.groupBy("id", "digest").agg(F.first("n").alias("tokens"), F.count("*").alias("seen"), F.count("w0").alias("known"), *[F.sum(F.coalesce(f"w{i}", F.lit(0.0))).alias(f"s{i}") for i in k])
    rows = F.round(F.col("seen") / F.greatest("tokens", F.lit(1))).cast("bigint")
    logits = [sharpness * F.col(f"s{i}") / (F.col("known") + 5 * rows) + F.log(F.lit(model.prior[i])) for i in k]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    odds = sums.select("id", "digest", rows.alias("rows"), "tokens", *[F.exp(x - top).alias(f"e{i}") for i, x in enumerate(logits)])
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return odds.select("id", "digest", "rows", "tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in k])


def fit_rates(members: DataFrame, weights: list[float], tolerance: float = 1e-6, max_steps: int = 30) -> tuple[Column, list[float]]:
    """Rates r >= 0 as a column over ``members(rows, tokens, p0..)``, and the shares that they give.

    Least squares on the domains' expected tokens: half the squared gap between sum(r * tokens * p_k) and weight_k
    times all tokens. Projected gradient from r = 1, each domain's gradient scaled by its own tokens; a step needs
    one distributed sum and K numbers on the driver. A row's rate is replayed from the steps, so no state is rewritten.
    """
    k = range(len(weights))
    mass = F.col("rows") * F.col("tokens")
    rate: Column = F.lit(1.0)
    base: list[float] | None = None
    shares: list[float] = []
    for _ in range(max_steps + 1):
        r = members.agg(F.sum(mass).alias("all"), *[F.sum(rate * mass * F.col(f"p{i}")).alias(f"t{i}") for i in k]).first()
        if not r["all"]:
            return rate, [0.0] * len(weights)
        shares = [r[f"t{i}"] / r["all"] for i in k]
        base = base or [max(s, 1e-9) for s in shares]
        gap = [s - w for s, w in zip(shares, weights, strict=True)]
        if max(map(abs, gap)) <= tolerance:
            break
        step = sum((F.lit(g / b) * F.col(f"p{i}") for i, (g, b) in enumerate(zip(gap, base, strict=True))), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - step)
    return rate, shares


def tempered(members: DataFrame, k: int, exponent: float) -> list[float]:
    """Target weights: the domains' expected token shares to the power ``exponent``, normalised."""
    r = members.agg(*[F.sum(F.col("rows") * F.col("tokens") * F.col(f"p{i}")).alias(f"t{i}") for i in range(k)]).first()
    x = [max(r[f"t{i}"] or 0.0, 0.0) ** exponent for i in range(k)]
    return [v / sum(x) if sum(x) else 1 / k for v in x]


def mixing_rates(docs: DataFrame, labelled: DataFrame, domain_col: str, targets: dict[str, float] | None = None, exponent: float = 0.8, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, digest, rows, tokens, p0..pK-1, rate, copies) of each different (id, text) of ``docs``.

    ``labelled`` (id, text, domain) trains the classifier. ``targets`` maps domains to weights, 0 where one is missing;
    by default the shares found, tempered by ``exponent``. copies is the rate rounded down or up at random, by a
    hash of (id, digest), so its expectation is the rate. Without labelled rows every rate is 1.
    """
    model = fit_domains(labelled, domain_col, text_col, id_col)
    if not model.domains:
        plain = docs.groupBy(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).agg(F.count("*").alias("rows"), F.first(F.size(_words(F.col(text_col)))).cast("bigint").alias("tokens"))
        return plain.withColumns({"rate": F.lit(1.0), "copies": F.lit(1).cast("bigint")})
    members = cut(domain_posteriors(docs, model, id_col, text_col))
    weights = tempered(members, len(model.domains), exponent) if targets is None else [targets.get(d, 0.0) / sum(targets.values()) for d in model.domains]
    rate, _ = fit_rates(members, weights)
    chance = F.pmod(F.xxhash64(F.lit(seed), "id", "digest"), F.lit(1 << 30)) / float(1 << 30)
    return members.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance))


def mix(docs: DataFrame, labelled: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row repeated ``copies`` times: 0 leaves it out. Columns are those of ``docs``."""
    plan = mixing_rates(docs, labelled, domain_col, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("copies").alias("_copies"))
    on = docs[id_col].eqNullSafe(plan["_id"]) & (F.xxhash64(docs[text_col]) == plan["_digest"])
    kept = docs.join(plan.where("_copies > 0"), on)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
