"""Operator 6, quality rules with risk-controlled thresholds, in DataFrame functions only.

Features are counts of one text.  A rule compares a ratio of two counts with a cutoff; cutoffs come from
a fixed grid.  Labelled documents are the holdout: for each stratum, rule and cutoff the number of
good documents that the rule would reject is binomial, and the exact tail probability of seeing that few if the
false rejection rate were ``alpha / rules`` is the cutoff's p-value.  A cutoff is safe if its p-value
is at most ``delta / (strata * rules * cutoffs)`` (Bonferroni), so with probability 1 - delta every
safe cutoff in every stratum rejects at most alpha / rules of the good documents, and all rules
together at most alpha.  Of a rule's safe cutoffs the one that removes most bad documents for each
good one is used; a rule without a safe cutoff, or that removes no bad document, stays off.

The base checks come first and do not depend on labels: under ``min_words`` words, or over
``repeat_percent`` percent of the words inside windows of ``window`` words that the text repeats.  Windows of a text are
compared by their 64-bit hash: a text of n windows has a chance of n^2 / 2^65 of a false repeat.

Defined cases: null text has no words, so it fails the base checks; null language is a stratum of
its own; rows with null or unlabelled ids are judged like others but calibrate nothing; labels are
taken once an id, as their minimum; without labels every rule stays off; an empty table gives an
empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.components import ensure_checkpoint_dir

ALPHA, DELTA, MIN_WORDS, REPEAT_PERCENT, WINDOW, MAX_STRATA = 0.05, 0.1, 20, 30, 8, 10_000
#: rule -> (numerator, denominator, over: reject above the cutoff, else below); cutoffs in thousandths
RULES: dict[str, tuple[str, str, bool, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", True, (50, 100, 200, 400, 800, 1600, 2400)),
    "duplicate_lines": ("n_dup_lines", "n_lines", True, (100, 200, 300, 400, 500, 600, 800)),
    "repeated_words": ("n_repeat_words", "n_words", True, (30, 60, 100, 150, 200, 250, 280)),
    "short_words": ("word_chars", "n_words", False, (2000, 2500, 3000, 3500, 4000, 4500, 5000)),
    "long_words": ("word_chars", "n_words", True, (5500, 6000, 6500, 7000, 8000, 10000, 15000)),
}
_SPACE = r"[\x20\x09-\x0D]+"


def _covered(places: Column, width: int) -> Column:
    """Words that windows at these places cover together: how far each reaches beyond the one before."""
    return F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).cast("long").alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, stratum and the counts that the rules compare."""
    counts = ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # each step's arrays are columns that the next one reads several times, so they are made once a row
    own = own.select(
        "doc_id",
        "stratum",
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(common.WORD)).alias("lines"),
        F.filter(F.split("text", _SPACE, -1), lambda x: x != "").alias("words"),
    )
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(0)))
    own = own.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda w, i: F.xxhash64(F.slice("words", i + 1, F.lit(window)))).alias("windows"),
    )
    # windows in order of their hash, where the text repeats any
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    ranked = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    own = own.select(*counts, F.when(repeats, ranked).alias("ranked"))
    w, n = F.col("ranked"), F.size("ranked")
    before = lambda x, k: (k > 0) & (F.get(w, k - 1)["w"] == x["w"])
    after = lambda x, k: (k < n - 1) & (F.get(w, k + 1)["w"] == x["w"])
    places = F.filter(F.transform(w, lambda x, k: F.when(before(x, k) | after(x, k), x["i"])), lambda i: i.isNotNull())
    return own.select(*counts, F.coalesce(_covered(places, window), F.lit(0).cast("long")).alias("n_repeat_words"))


def _base_failed(min_words: int, repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _rejects(rule: str, cutoff: Column) -> Column:
    """Whole-number comparison of numerator / denominator with cutoff thousandths."""
    top, bottom, over, _ = RULES[rule]
    left, right = F.col(top) * 1000, cutoff * F.col(bottom)
    return left > right if over else left < right


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed, in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(
        steps,
        F.struct(first.cast("double").alias("log"), F.exp(first).cast("double").alias("sum")),
        lambda acc, i: F.struct(
            (acc["log"] + F.log((n - i + 1).cast("double") / i) + odds).alias("log"),
            (acc["sum"] + F.exp(acc["log"] + F.log((n - i + 1).cast("double") / i) + odds)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )


def calibrate(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA, max_strata: int = MAX_STRATA) -> list[tuple]:
    """(stratum, cutoff of each rule or null) from features of labelled rows; one entry a stratum, at
    most ``max_strata`` (checked)."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id is not null and good is not null")
    held = rows.where("not base_failed").join(known.groupBy("doc_id").agg(F.min("good").alias("good")), "doc_id")
    grid = [(r, c) for r, (*_, cuts) in RULES.items() for c in cuts]
    tests = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), _rejects(r, F.lit(c)).alias("hit")) for r, c in grid]))
    counted = held.select("stratum", "good", tests.alias("t")).groupBy("stratum", "t.rule", "t.cutoff").agg(
        F.count_if(F.expr("good > 0")).alias("good"),
        F.count_if(F.expr("good > 0 and t.hit")).alias("lost"),
        F.count_if(F.expr("good = 0 and t.hit")).alias("caught"),
    )
    strata = held.select("stratum").distinct().limit(max_strata + 1).count()
    if strata > max_strata:
        raise ValueError(f"more than {max_strata} strata; raise max_strata")
    level = delta / max(1, strata * len(grid))
    safe = counted.where(binomial_tail(F.col("good"), F.col("lost"), alpha / len(RULES)) <= level)
    safe = safe.withColumn("gain", F.col("caught") - 10 * F.col("lost")).where("gain > 0")
    lenient = F.when(F.col("rule").isin([r for r, x in RULES.items() if x[2]]), F.col("cutoff")).otherwise(-F.col("cutoff"))
    best = safe.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", lenient.alias("l"))).alias("cutoff"))
    return [tuple(r) for r in best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).collect()]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, window: int = WINDOW, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = features(docs, id_col, text_col, stratum_col, window).withColumn("base_failed", _base_failed(min_words, repeat_percent)).checkpoint()
    cutoffs = calibrate(rows, labels, id_col, alpha=alpha, delta=delta)
    schema = "_stratum string, " + ", ".join(f"_{r} long" for r in RULES)
    safe: Sequence[tuple] = cutoffs
    table = F.broadcast(spark.createDataFrame(list(safe), schema))  # MAX_STRATA rows at most
    judged = rows.join(table, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_rejects(rule, F.col(f"_{rule}")), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def _oracle() -> str:
    """The same in DuckDB: words and windows as lists, the tail by lgamma."""
    grid = [(r, c) for r, (*_, cuts) in RULES.items() for c in cuts]

    def hit(rule: str, cutoff: str) -> str:
        top, bottom, over, _ = RULES[rule]
        return f"{top} * 1000 {'>' if over else '<'} {cutoff} * {bottom}"

    tests = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {c} AS cutoff, {'' if RULES[r][2] else '-'}{c} AS lenient, {hit(r, str(c))} AS hit FROM held" for r, c in grid)
    p = ALPHA / len(RULES)
    joined = " ".join(f"LEFT JOIN chosen c{i} ON c{i}.rule = '{r}' AND c{i}.stratum IS NOT DISTINCT FROM f.stratum" for i, r in enumerate(RULES))
    rejected = " OR ".join(f"coalesce({hit(r, f'c{i}.cutoff')}, false)" for i, r in enumerate(RULES))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT k, i, list_aggregate(words[i:i+{WINDOW - 1}], 'string_agg', ' ') AS s
  FROM (SELECT k, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT k, sum(least({WINDOW}, i - coalesce(prev, i - {WINDOW}))) AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM rep) GROUP BY k),
f AS (SELECT w.k, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.k = w.k),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f),
lab AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT b.*, good FROM b JOIN lab ON lab.doc_id = b.doc_id WHERE NOT base_failed),
tests AS ({tests}),
counted AS (SELECT stratum, rule, cutoff, lenient, count(*) FILTER (good > 0) AS n, count(*) FILTER (good > 0 AND hit) AS lost, count(*) FILTER (good = 0 AND hit) AS caught FROM tests GROUP BY ALL),
tail AS (SELECT c.*, list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) AS pv FROM counted c WHERE n > 0),
safe AS (SELECT *, caught - 10 * lost AS gain FROM tail WHERE pv <= {DELTA} / (greatest(1, (SELECT count(*) FROM (SELECT DISTINCT stratum FROM held))) * {len(grid)})),
chosen AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, lenient DESC) AS r FROM safe WHERE gain > 0) WHERE r = 1)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, NOT f.base_failed AND NOT ({rejected}) AS kept
FROM b f {joined}
"""


OP6_SQL = _oracle()
