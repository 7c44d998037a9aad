"""Removal of boilerplate lines by the number of sites that they stand on.

A line is compared without the ASCII white space around it, by two hashes of 64 and 32 bits; blank lines are never
boilerplate. The sites of a line are the distinct sources of its documents (a null source is one site). Each pair of
line and site is counted once, so a line brings no more rows to a task than it has sites, however often it stands.
A HyperLogLog sketch for each line, merged by aggregation, estimates its sites. An estimate clear of the threshold by
``margin`` relative standard errors decides; lines nearer to it get an exact distinct count. Boilerplate lines go from
every document.

Null and empty texts have no lines to remove and stay as they are; repeated rows are cleaned one by one. Columns
named n_lines or n_removed are replaced by those of the result, others are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: A sketch of 2^k registers has a relative standard error of about 1.04 / sqrt(2^k).
LG_K = 12


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def line_key(line: Column) -> Column:
    """Hash of a line without the white space around it; null for a blank line."""
    return F.when(_bare(line) != "", F.xxhash64(_bare(line)))


def line_salt(line: Column) -> Column:
    """A second hash, which tells apart lines of one key."""
    return F.hash(_bare(line))


def _named(line: Column) -> Column:
    return F.struct(line_key(line).alias("key"), line_salt(line).alias("salt"))


def boilerplate(docs: DataFrame, sites: int = 5, margin: float = 5.0, lg_k: int = LG_K) -> DataFrame:
    """The lines, as key and salt, that stand on at least ``sites`` sites."""
    site = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    lines = docs.where("text is not null").select(site.alias("site"), F.explode(F.transform(F.split("text", "\n"), _named)).alias("line"))
    own = ["key", "salt"]
    lines = lines.select("line.key", "line.salt", "site").where("key is not null").distinct()
    if sites <= 1:
        return lines.select(*own).distinct()
    # a line of one site has equal least and greatest site: a cheap exact test before the sketches
    spread = lines.groupBy(*own).agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select(*own)
    sketched = lines.join(spread, own, "left_semi").groupBy(*own).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"))
    error = margin * 1.04 / 2 ** (lg_k / 2)
    sure = sketched.where(F.col("estimate") > sites * (1 + error)).select(*own)
    near = sketched.where(F.col("estimate").between(sites * (1 - error), sites * (1 + error))).select(*own)
    exact = lines.join(near, own, "left_semi").groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") >= sites).select(*own)
    return sure.unionByName(exact)


def without_boilerplate(docs: DataFrame, sites: int = 5, margin: float = 5.0) -> DataFrame:
    """``docs`` with boilerplate lines taken out of text (and n_chars, if there, counted anew), and the columns n_lines and n_removed."""
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"))
    held = own.where("row.text is not null").select("own_id", "own_key", F.explode(F.transform(F.split("row.text", "\n"), _named)).alias("line"))
    held = held.select("own_id", "own_key", "line.key", "line.salt").where("key is not null").join(boilerplate(docs, sites, margin), ["key", "salt"], "left_semi")
    bad = held.groupBy(F.col("own_id").alias("bad_id"), F.col("own_key").alias("bad_key")).agg(F.collect_set(F.struct("key", "salt")).alias("bad"))
    joined = own.join(bad, own.own_id.eqNullSafe(bad.bad_id) & (own.own_key == bad.bad_key), "left")
    lines = F.split("row.text", "\n")
    clean = F.filter(lines, lambda line: ~F.coalesce(F.array_contains("bad", _named(line)), F.lit(False)))
    found = joined.select("row", "bad", lines.alias("lines"), F.when(F.col("bad").isNull(), lines).otherwise(clean).alias("clean"))
    text = F.when(F.col("bad").isNull(), F.col("row.text")).otherwise(F.array_join("clean", "\n"))
    columns = [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    n = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    return found.select(*columns, F.when(F.col("lines").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(n - F.size("clean")).cast("long").alias("n_removed"))


def oracle_sql(sites: int = 5) -> str:
    bare = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, coalesce(source, chr(0)) AS site, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), bad AS (
  SELECT {bare.format('line')} AS bare FROM l WHERE {bare.format('line')} <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {sites}
), gone AS (
  SELECT rid, count(*) AS n FROM l JOIN bad ON {bare.format('line')} = bad.bare GROUP BY rid
), kept AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY i) AS t FROM l LEFT JOIN bad ON {bare.format('line')} = bad.bare WHERE bad.bare IS NULL GROUP BY rid
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(gone.n, 0)::BIGINT AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE length(coalesce(kept.t, '')) END::BIGINT AS clean_chars, md5(CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept.t, '') END) AS clean_md5
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
