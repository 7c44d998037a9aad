"""Quality rules whose cutoffs are chosen under control of false rejections.

Every document gets counts (words, symbols, repeated lines, repeated word windows, ...), each rule a number
in thousandths that grows with badness. In every stratum (language) the labelled good documents are halved by a
hash of their ids. One half proposes: rule after rule takes its strictest cutoff with which the rules so far
together reject at most a share of ``room`` * ``alpha`` of that half. The other half certifies: of n good documents
k are rejected by any rule, and P(Binomial(n, alpha) <= k) <= delta / strata rejects the hypothesis that the rules
together have a risk of ``alpha`` or more. The proposal is tested in a fixed order, with all cutoffs moved to
looser ones by as many steps as there are, then by one step less, and so on until a test fails, so no further
correction is needed within a stratum, and strata are corrected for by Bonferroni. So with probability 1 - delta at
least, no stratum loses a share of alpha or more of its good documents to the rules, all of them together. Where
not even the loosest cutoffs pass, the rules are off.

The fixed base rules (fewer than 20 words, or over 30 % of the words in repeated windows) hold everywhere.
Null and empty texts have no words and fail the base rules. A null language is a stratum of its own; labels
are averaged over repeated ids, null ids and null labels ignored; repeated rows of documents are judged one by
one. Without labels no rule is on. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .common import SPACE

ALPHA, DELTA, WINDOW = 0.01, 0.1, 8
#: Share of alpha that the proposing half may spend.
ROOM = 0.75
#: Cutoffs in thousandths, strictest first; a document above its cutoff is rejected.
CUTOFFS = {
    "symbols": [10, 20, 50, 100, 200],
    "marks": [50, 100, 200, 500, 1000],
    "dup_lines": [100, 200, 300, 500, 800],
    "repeats": [20, 50, 100, 200],
    "long_words": [8000, 9000, 10000, 12000, 15000],
}
STEPS = max(map(len, CUTOFFS.values()))
#: Each rule's number from the counts.
METRICS = {
    "symbols": "1000 * n_symbols {div} greatest(word_chars, 1)",
    "marks": "1000 * n_marks {div} greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines {div} greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words {div} greatest(n_words, 1)",
    "long_words": "1000 * word_chars {div} greatest(n_words, 1)",
}


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of so many words found twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["x"] == F.get(s, b)["x"], F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j - 1, j) | same(j, j + 1))
            return F.sort_array(F.transform(found, lambda j: F.get(s, j)["i"]))

        at = F.transform(F.array(ordered), places)[0]
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])

    counted = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))[0]
    return F.when(F.size(words) < window, 0).otherwise(counted).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), text.alias("body"))
    rows = rows.withColumn("bare", F.trim("body", F.lit(SPACE)))
    empty = F.array().cast("array<string>")
    rows = rows.select(
        "doc_id", "stratum", "body", F.when(F.col("bare") == "", empty).otherwise(F.split("bare", r"[\x20\x09-\x0D]+")).alias("words"),
        F.filter(F.split("body", "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "").alias("lines"),
    )
    return rows.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("body", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"), (F.size(F.split("body", "!")) - 1).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def binomial_tail(n: str, k: str, p: float) -> Column:
    """P(Binomial(n, p) <= k), or 1 where k exceeds the mean.

    Below the mean the terms fall by a growing ratio, so those further than ten standard deviations below k add nothing
    to a double: the sum has some 10 sqrt(n p) terms. The last one comes from Stirling's series, the others from it.
    """
    stirling = "({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046728D + 1 / (12 * {x}) - 1 / (360 * power({x}, 3)) + 1 / (1260 * power({x}, 5))"
    # ln x! by the series at x + 10, less the ten factors
    factorial = lambda x: "(" + stirling.format(x=f"(cast({x} as double) + 10)") + "".join(f" - ln({x} + {i}D)" for i in range(1, 11)) + ")"
    last = f"{factorial(n)} - {factorial(k)} - {factorial(f'({n} - {k})')} + {k} * ln({p!r}D) + ({n} - {k}) * ln({1 - p!r}D)"
    terms = f"sequence(0L, least(cast({k} as bigint), cast(10 * sqrt({n} * {p * (1 - p)!r}D) as bigint) + 10))"
    ratio = f"cast({k} - i as double) * {(1 - p) / p!r}D / ({n} - {k} + i + 1)"
    total = f"aggregate({terms}, named_struct('t', 1D, 's', 0D), (a, i) -> named_struct('t', a.t * {ratio}, 's', a.s + a.t), a -> a.s)"
    return F.expr(f"if({k} > {n} * {p!r}D, 1D, least(1D, exp({last}) * {total}))")


def proposals(features: DataFrame, labels: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row a stratum: the place in CUTOFFS that the proposing half chooses for each rule (their number: none), and of the certifying half n and, for
    cutoffs looser by s steps, the rejected good documents k_s.

    A document counts by how many cutoffs of each rule it exceeds, so what follows is over a few thousand patterns a stratum.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("q")).where("q >= 0.5").select("doc_id")
    held = features.join(good, "doc_id", "left_semi")
    exceeded = [sum(((F.expr(METRICS[r].format(div="div")) > c).cast("int") for c in cs[1:]), (F.expr(METRICS[r].format(div="div")) > cs[0]).cast("int")).alias(r) for r, cs in CUTOFFS.items()]
    proposes = (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("proposes")
    rows = held.select("stratum", proposes, *exceeded).groupBy("stratum", "proposes", *CUTOFFS).agg(F.count("*").alias("n"))
    among, over = Window.partitionBy("stratum"), F.lit(False)
    rows = rows.withColumn("half", F.sum(F.when(F.col("proposes"), F.col("n")).otherwise(0)).over(among))
    for r, cs in CUTOFFS.items():
        rejected = [F.sum(F.when(F.col("proposes") & (over | (F.col(r) > c)), F.col("n")).otherwise(0)).over(among) for c in range(len(cs))]
        at = F.lit(len(cs))
        for c in reversed(range(len(cs))):
            at = F.when(rejected[c] <= F.lit(ROOM * alpha) * F.col("half"), c).otherwise(at)
        rows = rows.withColumn(f"at_{r}", at)
        over = over | (F.col(r) > F.col(f"at_{r}"))
    looser = lambda s: reduce(Column.__or__, (F.col(r) > F.col(f"at_{r}") + s for r in CUTOFFS))
    certified = [F.sum(F.when(~F.col("proposes") & looser(s), F.col("n")).otherwise(0)).alias(f"k_{s}") for s in range(STEPS)]
    return rows.groupBy("stratum").agg(F.sum(F.when(F.col("proposes"), 0).otherwise(F.col("n"))).alias("n"), *certified, *(F.max(f"at_{r}").alias(f"at_{r}") for r in CUTOFFS))


def thresholds(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule and the chosen cutoff (null: the rule is off)."""
    found = staged(proposals(features, labels, alpha))
    found = found.crossJoin(F.broadcast(found.agg(F.count("*").alias("strata"))))
    steps, passed = F.lit(STEPS), F.lit(True)
    for s in reversed(range(STEPS)):
        passed = passed & (binomial_tail("n", f"k_{s}", alpha) <= F.lit(delta) / F.col("strata"))
        steps = F.when(passed, s).otherwise(steps)
    found = found.withColumn("steps", steps)
    cutoffs = F.array(*(F.struct(F.lit(r).alias("rule"), F.get(F.array(*map(F.lit, cs)), F.col(f"at_{r}") + F.col("steps")).alias("cutoff")) for r, cs in CUTOFFS.items()))
    return found.select("stratum", F.explode(cutoffs).alias("x")).select("stratum", "x.rule", "x.cutoff")


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every row's counts, base_failed and kept."""
    features = staged(counts(docs))
    chosen = thresholds(features, labels, alpha, delta).where("cutoff is not null").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = [F.expr(METRICS[r].format(div="div")) > F.col("cutoffs")[r] for r in CUTOFFS]
    bad = F.lit(False)
    for o in over:
        bad = bad | F.coalesce(o, F.lit(False))
    # one row a language; the hint is checked against the number of strata
    chosen = F.broadcast(chosen) if chosen.count() <= 10_000 else chosen
    found = features.join(chosen.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")), "left")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~bad).alias("kept"))


def oracle_sql() -> str:
    metrics = {r: m.format(div="//") for r, m in METRICS.items()}
    exceeded = ", ".join(" + ".join(f"({metrics[r]} > {c})::INT" for c in cs) + f" AS {r}" for r, cs in CUTOFFS.items())
    chain, over = "", "false"
    for i, (r, cs) in enumerate(CUTOFFS.items()):
        cases = " ".join(f"WHEN sum(CASE WHEN proposes AND ({over} OR {r} > {c}) THEN n ELSE 0 END) OVER (PARTITION BY lang) <= {ROOM * ALPHA!r}::DOUBLE * half THEN {c}" for c in range(len(cs)))
        chain += f", p{i + 1} AS (SELECT *, CASE {cases} ELSE {len(cs)} END AS at_{r} FROM p{i})"
        over += f" OR {r} > at_{r}"
    looser = " OR ".join(f"{r} > at_{r} + s" for r in CUTOFFS)
    chosen = ", ".join(f"list_extract({cs}, at_{r} + steps + 1) AS cut_{r}" for r, cs in CUTOFFS.items())
    bad = " OR ".join(f"coalesce({metrics[r]} > cut_{r}, false)" for r in CUTOFFS)
    odds, rest = f"ln({ALPHA!r}::DOUBLE / {1 - ALPHA!r}::DOUBLE)", f"ln({1 - ALPHA!r}::DOUBLE)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS x FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)
), dup AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x) > 1
), rep AS (
  SELECT rid, sum(covers)::BIGINT AS n FROM (SELECT rid, least({WINDOW}, i - lag(i, 1, i - {WINDOW}) OVER (PARTITION BY rid ORDER BY i)) AS covers FROM dup) GROUP BY rid
), f AS (
  SELECT d.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, (length(body) - length(replace(body, '!', '')))::BIGINT AS n_marks,
    len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT AS n_lines,
    (len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
     - len(list_distinct(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), good AS (
  SELECT f.* FROM f SEMI JOIN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING avg(quality) >= 0.5) g USING (doc_id)
), p0 AS (
  SELECT *, (sum(CASE WHEN proposes THEN n ELSE 0 END) OVER (PARTITION BY lang))::BIGINT AS half FROM (
    SELECT lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS proposes, {exceeded}, count(*) AS n FROM good GROUP BY ALL)
){chain}, certified AS (
  SELECT lang, s, sum(CASE WHEN NOT proposes THEN n ELSE 0 END) AS n, sum(CASE WHEN NOT proposes AND ({looser}) THEN n ELSE 0 END) AS k FROM p{len(CUTOFFS)}, range({STEPS}) q(s) GROUP BY ALL
), terms AS (
  SELECT lang, s, sum(CASE WHEN i = 0 THEN n * {rest} ELSE ln((n - i + 1)::DOUBLE / i) + {odds} END) OVER (PARTITION BY lang, s ORDER BY i) AS t
  FROM (SELECT *, unnest(range(0, k::BIGINT + 1)) AS i FROM certified WHERE k <= n * {ALPHA!r}::DOUBLE)
), passed AS (
  SELECT lang, s FROM terms GROUP BY lang, s HAVING sum(exp(t)) <= {DELTA!r}::DOUBLE / (SELECT count(DISTINCT coalesce(lang, '')) FROM p0)
), steps AS (
  SELECT lang, min(s) AS steps FROM (SELECT lang, s, row_number() OVER (PARTITION BY lang ORDER BY s DESC) AS nth FROM passed) WHERE nth = {STEPS} - s GROUP BY lang
), chosen AS (
  SELECT DISTINCT p.lang, {chosen} FROM p{len(CUTOFFS)} p JOIN steps ON p.lang IS NOT DISTINCT FROM steps.lang
), verdict AS (
  SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, {bad} AS bad FROM f LEFT JOIN chosen ON f.lang IS NOT DISTINCT FROM chosen.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM verdict
"""
