"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Tokens are summed per cell (source, language, topic). The cell weights are raked to the target
shares of each dimension in turn until all margins agree with the targets to TOLERANCE; a cell's
calibration factor, its weight over its tokens, gives its documents' sampling probability, so the
expected sample has the target mix.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, text_or_empty

DIMENSIONS = ["source", "lang", "topic"]
#: Targets that are not given: token shares to this power, normalised.
TEMPER = 0.8
#: Rounds of raking between two looks at the margins, the error at which they agree, and the rounds
#: after which targets count as impossible to meet together.
ROUNDS, TOLERANCE, MOST_ROUNDS = 12, 1e-13, 240
#: Up to so many cells (distinct combinations, not documents) are raked in one task and broadcast.
MAX_CELLS = 100_000
#: Copies of each cell's factor where cells are joined by a shuffle, so that a hot cell is many tasks.
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"

Targets = dict[str, dict[str, float]]


def topic_of(text: Column) -> Column:
    """The default topic: what kind of text it is, by the marks it has."""
    return (
        F.when(text.contains("@"), "contact")
        .when(text.contains("|"), "tabular")
        .when(text.contains("!!"), "shouting")
        .otherwise("prose")
    )


def topic_by_words(text: Column, topics: dict[str, list[str]], other: str = "other") -> Column:
    """The topic with the most words of its list in ``text``, lower-cased; ``other`` without any.

    Words are runs without white space or ASCII marks at their ends. Of equal topics the first
    given wins. A null text has ``other``.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    words = F.transform(words, lambda w: F.btrim(w, F.lit(".,;:!?()[]'\"")))

    def found(own: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(own)))

    ranked = [F.struct(found(own).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("topic")) for i, (name, own) in enumerate(topics.items())]
    best = F.array_max(F.array(F.struct(F.lit(0).alias("n"), F.lit(1).alias("i"), F.lit(other).alias("topic")), *ranked))
    return best["topic"]


def _with_margin(cells: DataFrame, d: str, name: str, small: bool) -> DataFrame:
    """``cells`` with the sum of ``weight`` over the cells of the same value of ``d``.

    Many cells are pre-aggregated and joined, so no value's cells meet in one task.
    """
    if small:
        return cells.withColumn(name, F.sum("weight").over(Window.partitionBy(d)))
    sums = cells.groupBy(F.col(d).alias("__v")).agg(F.sum("weight").alias(name))
    return cells.join(sums, F.col(d).eqNullSafe(F.col("__v"))).drop("__v")


def _margin_error(cells: DataFrame) -> float:
    """The largest difference between a margin of ``weight`` and its target."""
    looks = None
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"__t_{d}")).alias("gap")).select("gap")
        looks = sums if looks is None else looks.unionAll(sums)
    return looks.agg(F.max("gap")).first()[0] or 0.0


def rake(cells: DataFrame, targets: Targets | None = None, temper: float = TEMPER, small: bool = True) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: the raked share of all tokens.

    ``targets`` gives shares by dimension and value; a dimension without them is tempered. Shares
    are normalised over the values that have tokens; values that a given target leaves out get
    weight zero, and so do all cells where nothing of a target is left. Null values are a category
    of their own. Targets that no weights meet together (after MOST_ROUNDS the margins are still
    off) end with a warning that names the error, and the weights of the last round. ``small`` rakes
    in one task, otherwise each round is a scratch table.
    """
    totals = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    rows = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        rows = _with_margin(rows, d, "__own", small)
        if targets and d in targets:
            share = F.lit(0.0)
            for value, x in targets[d].items():
                share = F.when(F.col(d).eqNullSafe(F.lit(value)), F.lit(float(x))).otherwise(share)
            share = F.when(F.col("__own") > 0, share).otherwise(F.lit(0.0))
        else:
            share = F.pow("__own", F.lit(temper))
        rows = rows.withColumn(f"__t_{d}", share).drop("__own")
    rows = materialize(rows, "mix-targets")
    sums = {}
    for d in DIMENSIONS:  # each value counts once in the sum of the shares
        sums[d] = rows.groupBy(d).agg(F.max(f"__t_{d}").alias("t")).agg(F.sum("t")).first()[0] or 0.0
    now = rows.withColumns({f"__t_{d}": F.col(f"__t_{d}") / F.lit(sums[d]) if sums[d] else F.lit(0.0) for d in DIMENSIONS})
    now = now.withColumn("weight", F.col("weight") / F.lit(totals) if totals else F.lit(0.0))
    if not totals or not all(sums.values()):
        return now.select(*DIMENSIONS, "tokens", F.lit(0.0).alias("weight"))
    done, last = 0, rows
    while True:
        for n in range(ROUNDS):
            for d in DIMENSIONS:
                now = _with_margin(now, d, "__now", small)
                now = now.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"__t_{d}"), "__now"), F.lit(0.0))).drop("__now")
            if not small or n == ROUNDS - 1:
                now = materialize(now.coalesce(1) if small else now, "mix-round")
                discard(last)
                last = now
        done += ROUNDS
        error = _margin_error(now)
        if error <= TOLERANCE:
            break
        if done >= MOST_ROUNDS:
            warnings.warn(f"targets cannot be met together: margins differ by up to {error:.3g} after {done} rounds", stacklevel=2)
            break
    return now.select(*DIMENSIONS, "tokens", "weight")


def _keys(topic: Column | None) -> dict[str, Column]:
    return {
        "source": F.col("source").cast("string"),
        "lang": F.col("lang").cast("string"),
        "topic": (topic_of(text_or_empty("text")) if topic is None else topic).cast("string"),
    }


def _n_tokens() -> Column:
    return F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long")


def _with_probability(docs: DataFrame, keys: dict[str, Column], n_tokens: Column, targets: Targets | None, temper: float) -> DataFrame:
    """``docs`` with ``__source, __lang, __topic, __weight, __probability, __kept``."""
    rows = docs.select(*[c.alias(d) for d, c in keys.items()], n_tokens.alias("__n"))
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("__n").alias("tokens")), "mix-cells")
    small = cells.count() <= MAX_CELLS
    raked = rake(cells.coalesce(1) if small else cells, targets, temper, small)
    factor = F.coalesce(F.try_divide(F.col("weight"), F.col("tokens").cast("double")), F.lit(0.0))
    most = raked.agg(F.max(factor)).first()[0] or 0.0
    raked = raked.select(
        *[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("weight").alias("__weight"), (factor / F.lit(most) if most else F.lit(0.0)).alias("__probability")
    )
    own = docs.withColumns({f"__own_{d}": c for d, c in keys.items()})
    same = None
    for d in DIMENSIONS:
        match = F.col(f"__own_{d}").eqNullSafe(F.col(f"__{d}"))
        same = match if same is None else same & match
    if small:
        joined = own.join(F.broadcast(raked), same)
    else:  # a hot cell's rows go to SALTS tasks
        spread = raked.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("__row_salt", F.pmod(F.xxhash64(F.col("doc_id"), n_tokens), F.lit(SALTS)).cast("int"))
        joined = joined.join(spread, same & (F.col("__row_salt") == F.col("__salt"))).drop("__salt", "__row_salt")
    key = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return joined.drop(*[f"__own_{d}" for d in DIMENSIONS]).withColumn("__kept", draw < F.col("__probability"))


def mix_probabilities(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None, temper: float = TEMPER) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, kept`` per input row.

    ``topic`` is any column expression over ``docs``: a column of the caller's, or
    :func:`topic_by_words`; by default the class of text of :func:`topic_of`. n_tokens counts
    white-space words. weight is the raked share of the row's cell; probability its calibration
    factor over the largest one, so that the expected tokens of the sample have exactly the raked
    mix. kept compares it with a fixed pseudo-random number of the id, hence does not depend on
    partitions. Null texts have no tokens; null source, lang or topic are categories of their own;
    cells without tokens have probability zero; rows with a null id share one draw; repeated rows
    share theirs. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(d) for d, c in _keys(topic).items()], _n_tokens().alias("n_tokens"))
    rows = materialize(rows, "mix-rows")
    found = _with_probability(rows, {d: F.col(d) for d in DIMENSIONS}, F.col("n_tokens"), targets, temper)
    return found.select(
        "doc_id",
        *[F.col(f"__{d}").alias(d) for d in DIMENSIONS],
        "n_tokens",
        F.col("__weight").alias("weight"),
        F.col("__probability").alias("probability"),
        F.col("__kept").alias("kept"),
    )


def sample_mix(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None, temper: float = TEMPER) -> DataFrame:
    """``docs``, all columns, sampled to the target mix by the verdicts of :func:`mix_probabilities`.

    Verdicts are by row: rows without an id share one draw against their own cells' probabilities.
    """
    return _with_probability(docs, _keys(topic), _n_tokens(), targets, temper).where("__kept").select(docs.columns)


def mixing_sql(rounds: int = 2 * ROUNDS, temper: float = TEMPER, table: str = "documents") -> str:
    """The same computation as one SQL statement, of a fixed number of rounds: enough for margins that agree."""
    steps = [
        f"""r AS (SELECT doc_id, source, lang,
             CASE WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), '|') THEN 'tabular'
                  WHEN contains(coalesce(text, ''), '!!') THEN 'shouting' ELSE 'prose' END AS topic,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {table})""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        steps.append(f"t_{d} AS (SELECT {d}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) OVER () AS t_{d} FROM c GROUP BY {d})")
    joins = " ".join(f"JOIN t_{d} ON c.{d} IS NOT DISTINCT FROM t_{d}.{d}" for d in DIMENSIONS)
    steps.append(f"w0 AS (SELECT c.*, {', '.join(f't_{d}' for d in DIMENSIONS)}, tokens / sum(tokens) OVER () AS weight FROM c {joins})")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            n += 1
            steps.append(
                f"w{n} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * t_{d} / nullif(sum(weight) OVER (PARTITION BY {d}), 0), 0) AS weight) FROM w{n - 1})"
            )
    steps.append(f"f AS (SELECT *, coalesce(weight / nullif(tokens, 0), 0) AS factor FROM w{n})")
    steps.append("p AS (SELECT *, coalesce(factor / nullif(max(factor) OVER (), 0), 0) AS probability FROM f)")
    same = " AND ".join(f"r.{d} IS NOT DISTINCT FROM p.{d}" for d in DIMENSIONS)
    draw = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0"
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(weight, 9) AS weight, "
        f"round(probability, 9) AS probability, {draw} < probability AS kept FROM r JOIN p ON {same}"
    )
