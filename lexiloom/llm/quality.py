"""Quality rules by weak supervision (DataFrame functions only).

Rules look at surface statistics of a text and vote good, bad or abstain. A generative model
with one accuracy for each rule is fitted by expectation-maximisation, and a document is kept
when its posterior probability of being good reaches a threshold. Fitting never touches
documents: the votes of all documents are counted by vote pattern (at most 2^7 = 128 rows),
and the whole EM runs as one SQL expression over that table.

Defined results: a null or empty text has no words, fails the base rule and is not kept;
repeated rows are judged alike; an empty table gives an empty result. Columns of the input
never clash with working columns because the input row travels in a struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import WORD_GAP_CHARS, materialise, table, words_of

WINDOW = 8


@dataclass(frozen=True)
class QualityParams:
    """Thresholds of the rules and of the model; each pair is (good up to, bad from)."""

    min_words: int = 20
    max_repeat_percent: int = 30
    symbols_per_word: tuple[float, float] = (0.02, 0.10)
    shouts_per_word: tuple[float, float] = (0.05, 0.20)
    capitals_per_char: tuple[float, float] = (0.15, 0.35)
    repeats_per_word: float = 0.25
    dup_lines_per_word: float = 0.05
    good_word_length: tuple[float, float] = (2.5, 9.0)
    bad_word_length: tuple[float, float] = (1.8, 14.0)
    iterations: int = 25
    #: Class balance of the model: fixed, as the votes of single rules cannot tell it from their accuracies.
    prior: float = 0.5
    first_accuracy: float = 0.9
    accuracy_bounds: tuple[float, float] = (0.55, 0.99)
    threshold: float = 0.5


DEFAULTS = QualityParams()
N_RULES = 7


def _repeat_words(grams: Column, ordered: Column) -> Column:
    """Words inside windows that occur twice: ``ordered`` holds (window hash, start) sorted."""
    neighbour = lambda k: F.get(ordered, k)["h"]
    again = F.transform(ordered, lambda e, k: F.when((e["h"] == neighbour(k - 1)) | (e["h"] == neighbour(k + 1)), e["i"]))
    starts = F.sort_array(F.filter(again, lambda x: x.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return F.when(F.size(ordered) > 0, covered).otherwise(F.lit(0)).cast("long")


def text_statistics(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The input row as ``row`` (only the columns ``keep``, default all) beside its statistics."""
    kept = df.columns if keep is None else keep
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    split = df.select(row, body.alias("body")).select("row", "body", words_of(F.col("body")).alias("words"), F.split("body", "\n").alias("lines"))
    n = F.size("words")
    gram = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), gram)).otherwise(F.array().cast("array<bigint>"))
    lined = F.filter("lines", lambda x: F.length(F.btrim(x, F.lit(WORD_GAP_CHARS))) > 0)
    counted = split.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit(r"!")).cast("long").alias("n_shouts"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        lined.alias("lined"),
        grams.alias("grams"),
    )
    pairs = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = counted.select(
        "row", "n_words", "word_chars", "n_symbols", "n_shouts", "n_capitals", "grams",
        (F.size("lined") - F.size(F.array_distinct("lined"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), pairs).otherwise(nothing).alias("ordered"),
    )
    return ordered.select("row", "n_words", "word_chars", "n_symbols", "n_shouts", "n_capitals", "n_dup_lines", _repeat_words(F.col("grams"), F.col("ordered")).alias("n_repeat_words"))


def rule_votes(p: QualityParams = DEFAULTS) -> list[Column]:
    """One vote for each rule: 1 good, -1 bad, 0 abstains.

    A missing symptom is no evidence of quality, so the six symptom rules say bad or abstain;
    the last rule says good where words, symbols, shouts and capitals look like prose, so it
    may outvote the two rules on repetition. Texts without words get no votes.
    """
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    length = F.col("word_chars") / words
    symptoms = [
        (F.col("n_symbols") / words, p.symbols_per_word),
        (F.col("n_shouts") / words, p.shouts_per_word),
        (F.col("n_capitals") / chars, p.capitals_per_char),
    ]
    bad = [value >= bounds[1] for value, bounds in symptoms] + [F.col("n_repeat_words") / words >= p.repeats_per_word, F.col("n_dup_lines") / words >= p.dup_lines_per_word, (length < p.bad_word_length[0]) | (length > p.bad_word_length[1])]
    prose = length.between(*p.good_word_length)
    for value, bounds in symptoms:
        prose = prose & (value <= bounds[0])
    worded = F.col("n_words") > 0
    return [F.when(worded & b, -1).otherwise(0) for b in bad] + [F.when(worded & prose, 1).otherwise(0)]


def _posterior(state: Column, votes: Column) -> Column:
    odds = F.zip_with(state["acc"], votes, lambda a, v: v * F.log(a / (1 - a)))
    total = F.aggregate(odds, F.log(state["prior"] / (1 - state["prior"])), lambda s, x: s + x)
    return 1 / (1 + F.exp(-total))


def fit_posteriors(patterns: DataFrame, p: QualityParams = DEFAULTS) -> DataFrame:
    """(votes, n) -> (votes, posterior, accuracies); at most 2^7 rows go in and come out."""
    clip = lambda x, b: F.greatest(F.lit(b[0]), F.least(F.lit(b[1]), x))
    whole = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("seen"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    with_g = lambda s: F.transform("seen", lambda e: F.struct(e["votes"].alias("votes"), e["n"].alias("n"), _posterior(s, e["votes"]).alias("g")))

    def accuracy(rows: Column, j: Column) -> Column:
        vote = lambda e: F.get(e["votes"], j)
        right = total(F.transform(rows, lambda e: e["n"] * F.when(vote(e) == 1, e["g"]).when(vote(e) == -1, 1 - e["g"]).otherwise(0.0)))
        votes = total(F.transform(rows, lambda e: F.when(vote(e) != 0, e["n"]).otherwise(0).cast("double")))
        return F.when(votes > 0, clip(right / votes, p.accuracy_bounds)).otherwise(F.lit(p.first_accuracy))

    def step(state: Column, _: Column) -> Column:
        # The one-element array binds the expectation once for the whole maximisation step.
        return F.get(
            F.transform(
                F.array(with_g(state)),
                lambda rows: F.struct(
                    F.lit(p.prior).alias("prior"),
                    F.transform(F.sequence(F.lit(0), F.lit(N_RULES - 1)), lambda j: accuracy(rows, j)).alias("acc"),
                ),
            ),
            F.lit(0),
        )

    first = F.struct(F.lit(p.prior).alias("prior"), F.array_repeat(F.lit(p.first_accuracy), N_RULES).alias("acc"))
    fitted = whole.filter(F.size("seen") > 0).select("seen", F.aggregate(F.sequence(F.lit(1), F.lit(p.iterations)), first, step).alias("model"))
    each = fitted.select("model", F.explode("seen").alias("e"))
    return each.select(F.col("e.votes").alias("votes"), _posterior(F.col("model"), F.col("e.votes")).alias("posterior"), F.col("model.acc").alias("accuracies"))


def judge(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, p: QualityParams = DEFAULTS) -> DataFrame:
    """Judge every row: ``row`` (input columns), the statistics, ``votes``, ``posterior``, ``base_failed``, ``kept``."""
    stats = text_statistics(df, text_col, keep)
    voted = materialise(stats.withColumn("votes", F.array(*[v.cast("int") for v in rule_votes(p)])), "quality")
    model = fit_posteriors(voted.groupBy("votes").agg(F.count("*").alias("n")), p).select("votes", "posterior")
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    joined = voted.join(F.broadcast(model), "votes", "left")  # bounded: one row for each vote pattern
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= p.threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(p: QualityParams = DEFAULTS) -> str:
    """The same rules and the same EM in DuckDB SQL."""
    votes = [f"v{j}" for j in range(1, N_RULES + 1)]
    odds = " + ".join(f"{v} * ln(a{j} / (1 - a{j}))" for j, v in enumerate(votes, 1))
    rates = [("n_symbols / w", p.symbols_per_word), ("n_shouts / w", p.shouts_per_word), ("n_capitals / c", p.capitals_per_char)]
    bad = [f"{x} >= {b[1]}" for x, b in rates] + [f"n_repeat_words / w >= {p.repeats_per_word}", f"n_dup_lines / w >= {p.dup_lines_per_word}", f"(word_chars / w < {p.bad_word_length[0]} OR word_chars / w > {p.bad_word_length[1]})"]
    prose = " AND ".join([f"word_chars / w BETWEEN {p.good_word_length[0]} AND {p.good_word_length[1]}", *(f"{x} <= {b[0]}" for x, b in rates)])
    cast = [f"CASE WHEN n_words > 0 AND {b} THEN -1 ELSE 0 END AS v{j}" for j, b in enumerate(bad, 1)] + [f"CASE WHEN n_words > 0 AND {prose} THEN 1 ELSE 0 END AS v{N_RULES}"]
    clip = lambda x, b: f"greatest({b[0]}::DOUBLE, least({b[1]}::DOUBLE, {x}))"
    right = lambda v: f"sum(CASE WHEN {v} = 1 THEN n * g WHEN {v} = -1 THEN n * (1 - g) END) / sum(CASE WHEN {v} <> 0 THEN n END)"
    acc = ", ".join(f"CASE WHEN count(CASE WHEN {v} <> 0 THEN 1 END) = 0 THEN {p.first_accuracy}::DOUBLE ELSE {clip(right(v), p.accuracy_bounds)} END AS a{j}" for j, v in enumerate(votes, 1))
    rounds = [f"em0 AS (SELECT {p.prior}::DOUBLE AS prior, {', '.join(f'{p.first_accuracy}::DOUBLE AS a{j}' for j in range(1, N_RULES + 1))})"]
    for k in range(1, p.iterations + 1):
        rounds.append(
            f"em{k} AS MATERIALIZED (SELECT {p.prior}::DOUBLE AS prior, {acc} FROM "
            f"(SELECT pat.*, 1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds}))) AS g FROM pat CROSS JOIN em{k - 1}))"
        )
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS rid FROM documents),
split AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws, string_split(body, chr(10)) AS ls FROM base),
grams AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM split, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
reps AS (SELECT rid, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
stats AS (
  SELECT s.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(body, '!')) AS n_shouts, len(regexp_extract_all(body, '\p{{Lu}}')) AS n_capitals,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN reps r ON s.rid = r.rid),
rates AS (SELECT *, greatest(n_words, 1) AS w, greatest(word_chars, 1) AS c FROM stats),
voted AS (SELECT *, {', '.join(cast)} FROM rates),
pat AS (SELECT {', '.join(votes)}, count(*) AS n FROM voted GROUP BY ALL),
{', '.join(rounds)},
judged AS (SELECT voted.*, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed, 1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds}))) AS posterior FROM voted CROSS JOIN em{p.iterations})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND posterior >= {p.threshold} AS kept FROM judged
"""
