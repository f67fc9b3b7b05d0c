"""Mixing sources to target weights by iterative proportional fitting (operator 7).

Documents fall into cells (source, language, topic). The cells' token shares
are raked in turn to the target share of each source, language and topic until
all three marginals fit. A cell's factor (fitted share / own share) gives its
documents' sampling probability, and what a probability above one cannot give
becomes a weight of the document. Everything is DataFrame operations on the
table of cells; documents are read once to count and once to sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 16
ROUNDS_A_TABLE = 4  # rounds planned together before the cells are written
WORD = r"[^\x20\x09-\x0D]+"

# FIXED VALUES: cue strings of the coarse topics, tested in this order.
TOPIC_CUES = (
    ("license", ("License", "Licensed", "licence")),
    ("secret", ("password", "token =", "AKIA")),
    ("contact", ("@", "+1 (")),
    ("shout", ("!!",)),
)
SHORT_TOKENS = 60


def token_count(text: Column) -> Column:
    """White-space-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """Coarse topic from fixed cue strings and length."""
    rule = F.when(tokens == 0, "empty")
    for topic, cues in TOPIC_CUES:
        hit = F.lit(False)
        for cue in cues:
            hit = hit | F.contains(text, F.lit(cue))
        rule = rule.when(hit, topic)
    return rule.when(tokens < SHORT_TOKENS, "short").otherwise("prose")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Targets (value, share): each value's token share to a power, normalised by the rake."""
    return cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, most: float | None = None) -> DataFrame:
    """``cells(<dimensions>, tokens)`` with ``factor``: fitted share / own share.

    ``targets[dimension]`` has (value, share); shares need not sum to one. A
    value without a target, or without tokens, gets factor 0; targets of values
    that do not occur are left out. A null value is a value like any other. One
    round fits each dimension once; the last dimension fits exactly.

    With ``most``, no factor exceeds it: full cells are held there, and the
    following steps fit the marginals with the others, as far as they can.
    """
    fitted = cells
    for d, t in targets.items():
        t = t.select(F.col("value").alias(f"_{d}"), F.col("share").cast("double").alias(f"_t_{d}"))
        fitted = fitted.join(t, fitted[d].eqNullSafe(t[f"_{d}"]), "left").drop(f"_{d}")
    positive = F.lit(True)
    for d in targets:
        positive = positive & (F.coalesce(f"_t_{d}", F.lit(0.0)) > 0)
    fitted = fitted.withColumn("_w", F.when(positive, F.col("tokens").cast("double")).otherwise(0.0))
    # target share of a value spread over its live cells: sums to one over the live values
    for d in targets:
        live = F.max(F.col("_w") > 0).over(Window.partitionBy(d))
        first = F.row_number().over(Window.partitionBy(d).orderBy(*[F.col(x) for x in targets])) == 1
        fitted = fitted.withColumn(f"_s_{d}", F.when(live & first, F.col(f"_t_{d}")).otherwise(0.0))
    sums = fitted.agg(*[F.sum(f"_s_{d}").alias(f"_z_{d}") for d in targets], F.sum("tokens").cast("double").alias("_all"))
    fitted = fitted.crossJoin(F.broadcast(sums))  # one row
    fitted = fitted.select(*cells.columns, "_w", "_all", *[
        F.when(F.col(f"_z_{d}") > 0, F.col(f"_t_{d}") / F.col(f"_z_{d}")).otherwise(0.0).alias(f"_t_{d}") for d in targets])
    fitted = materialize(fitted, "cells")
    for done in range(1, rounds + 1):
        for d in targets:
            total = F.sum("_w").over(Window.partitionBy(d))
            scaled = F.when(total > 0, F.col("_w") * F.col(f"_t_{d}") / total).otherwise(0.0)
            if most is not None:
                scaled = F.least(scaled, F.lit(most) * F.col("tokens") / F.col("_all"))
            fitted = fitted.withColumn("_w", scaled)
        if done % ROUNDS_A_TABLE == 0 or done == rounds:
            fitted = materialize(fitted, "cells")
    share = F.col("tokens") / F.col("_all")
    return fitted.select(*cells.columns, F.when(share > 0, F.col("_w") / share).otherwise(0.0).alias("factor"))


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the id: alike in every run and on every executor."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
          keep: float = 0.5, seed: int = 1, rounds: int = ROUNDS, weighted: bool = True) -> DataFrame:
    """``docs`` with _mix_topic, _mix_tokens, _mix_factor, _mix_keep, _mix_weight and _mix_sampled.

    ``targets`` names the wanted shares, or ``powers`` tempers the own shares
    of source, language and topic. ``keep`` is the wanted part of all tokens:
    a document stays with probability min(1, keep x factor), and its weight
    (keep x factor / probability, 0 if it can't stay) makes the weighted sample
    fit the targets where the probability is cut at one. Without weights
    (``weighted`` false) cells are raked under the bound that a document can stay
    once only, so that the expected tokens themselves fit the targets, as far as
    there are tokens enough.

    Null and empty texts have no tokens: they fall into the topic ``empty``,
    whose factor is 0, and are not sampled. Null sources and languages are
    values of their own. Rows with equal ids share one draw. An empty table
    gives an empty result. Other columns stay.
    """
    tokens = token_count(F.col("text").cast("string"))
    base = docs.withColumn("_mix_tokens", tokens)
    base = base.withColumn("_mix_topic", topic_of(F.col("text").cast("string"), F.col("_mix_tokens")))
    cells = base.groupBy("source", "lang", F.col("_mix_topic").alias("topic")).agg(F.sum("_mix_tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    targets = targets or {d: tempered(cells, d, (powers or {}).get(d, 1.0)) for d in DIMENSIONS}
    factors = rake(cells, targets, rounds, None if weighted else 1 / keep).select(
        F.col("source").alias("_mix_s"), F.col("lang").alias("_mix_l"), F.col("topic").alias("_mix_t"),
        F.col("factor").alias("_mix_factor"))
    wanted = F.lit(keep) * F.col("_mix_factor")
    return (base.join(factors, base["source"].eqNullSafe(factors["_mix_s"]) & base["lang"].eqNullSafe(factors["_mix_l"])
                      & (base["_mix_topic"] == factors["_mix_t"]))
            .withColumn("_mix_keep", F.least(F.lit(1.0), wanted))
            .withColumn("_mix_weight", F.when(F.col("_mix_keep") > 0, wanted / F.col("_mix_keep")).otherwise(0.0))
            .withColumn("_mix_sampled", draw(F.col("doc_id"), seed) < F.col("_mix_keep"))
            .drop("_mix_s", "_mix_l", "_mix_t"))


def sample_plan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, factor, keep_prob, weight, sampled) for every document."""
    rows = mixed(docs.select("doc_id", "text", "source", "lang"), **options)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("_mix_topic").alias("topic"),
                       F.col("_mix_tokens").alias("n_tokens"), F.round("_mix_factor", 6).alias("factor"),
                       F.round("_mix_keep", 6).alias("keep_prob"), F.round("_mix_weight", 6).alias("weight"),
                       F.col("_mix_sampled").alias("sampled"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, with their own columns; they have no weights, so the expected tokens are fitted without."""
    return mixed(docs, **options, weighted=False).where("_mix_sampled").select(*docs.columns)


def plan_sql(powers: dict[str, float], keep: float, seed: int = 1, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``sample_plan``'s rows with tempered targets: the rake, unrolled."""
    cue = lambda cues: " OR ".join(f"contains(text, '{c}')" for c in cues)
    cases = " ".join(f"WHEN {cue(cues)} THEN '{topic}'" for topic, cues in TOPIC_CUES)
    steps = [f"""d AS (SELECT doc_id, source, lang, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n
        FROM documents)""",
             f"""b AS (SELECT *, CASE WHEN n = 0 THEN 'empty' {cases} WHEN n < {SHORT_TOKENS} THEN 'short' ELSE 'prose' END
        AS topic FROM d)""",
             "c AS (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM b GROUP BY ALL)"]
    for x in DIMENSIONS:
        steps.append(f"""t_{x} AS (SELECT {x}, s / sum(s) OVER () AS t FROM
            (SELECT {x}, pow(sum(tokens), {powers[x]}) AS s FROM c GROUP BY {x} HAVING sum(tokens) > 0))""")
    steps.append("""r0 AS (SELECT c.source, c.lang, c.topic, tokens, tokens AS w, t_source.t AS ts, t_lang.t AS tl, t_topic.t AS tt
        FROM c LEFT JOIN t_source ON c.source IS NOT DISTINCT FROM t_source.source
            LEFT JOIN t_lang ON c.lang IS NOT DISTINCT FROM t_lang.lang LEFT JOIN t_topic ON c.topic = t_topic.topic)""")
    last = "r0"
    for k in range(rounds):
        for x, t in zip(DIMENSIONS, ("ts", "tl", "tt")):
            new = f"r{k}_{x}"
            steps.append(f"""{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, ts, tl, tt,
                CASE WHEN sum(w) OVER (PARTITION BY {x}) > 0 THEN w * {t} / sum(w) OVER (PARTITION BY {x}) ELSE 0 END AS w
                FROM {last})""")
            last = new
    steps.append(f"""f AS (SELECT source, lang, topic,
        CASE WHEN tokens > 0 THEN w / (tokens / (SELECT sum(tokens) FROM c)) ELSE 0 END AS factor FROM {last})""")
    return f"""WITH {', '.join(steps)}
        SELECT doc_id, b.source, b.lang, b.topic, n AS n_tokens, round(factor, 6) AS factor,
            round(least(1.0::DOUBLE, {keep} * factor), 6) AS keep_prob,
            round(CASE WHEN factor > 0 THEN {keep} * factor / least(1.0::DOUBLE, {keep} * factor) ELSE 0 END, 6) AS weight,
            ('0x' || md5('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT / 4294967296.0::DOUBLE
                < least(1.0::DOUBLE, {keep} * factor) AS sampled
        FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source AND b.lang IS NOT DISTINCT FROM f.lang AND b.topic = f.topic"""
