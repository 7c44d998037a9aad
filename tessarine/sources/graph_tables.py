"""Triples (h, r, t) from delimited files, Parquet datasets and the star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: table, relation, head prefix, head column, tail prefix, tail column of the graph derived from the star schema
EDGES = [
    ("customer", "cust_in_nation", "c", "c_custkey", "n", "c_nationkey"),
    ("supplier", "supp_in_nation", "s", "s_suppkey", "n", "s_nationkey"),
    ("nation", "nation_in_region", "n", "n_nationkey", "g", "n_regionkey"),
    ("nation", "region_has_nation", "g", "n_regionkey", "n", "n_nationkey"),
    ("orders", "placed_by", "o", "o_orderkey", "c", "o_custkey"),
    ("lineitem", "has_part", "o", "l_orderkey", "p", "l_partkey"),
    ("lineitem", "supplied_by", "p", "l_partkey", "s", "l_suppkey"),
    ("part", "has_brand", "p", "p_partkey", "b", "p_brand"),
    ("events", "did", "u", "user_id", "e", "event_type"),
]


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labelled triples of the graph derived from the star-schema tables."""
    return repeated_star_triples(spark, sf_dir).distinct()


def repeated_star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as often as the tables give them, for operators to which repeats make no difference."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    label = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [read(t).select(label(hp, hc).alias("h"), F.lit(r).alias("r"), label(tp, tc).alias("t")) for t, r, hp, hc, tp, tc in EDGES]
    a = read("nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("g"))
    b = read("nation").select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("g"))
    parts.append(a.join(b, "g").where("a <> b").select(label("n", "a").alias("h"), F.lit("nation_neighbor").alias("r"), label("n", "b").alias("t")))
    return reduce(DataFrame.unionByName, parts)


def star_triples_sql() -> str:
    """The same as a SELECT."""
    parts = [f"SELECT '{hp}' || CAST({hc} AS VARCHAR) AS h, '{r}' AS r, '{tp}' || CAST({tc} AS VARCHAR) AS t FROM {t}" for t, r, hp, hc, tp, tc in EDGES]
    parts.append("SELECT 'n' || CAST(a.n_nationkey AS VARCHAR), 'nation_neighbor', 'n' || CAST(b.n_nationkey AS VARCHAR) FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey")
    return f"SELECT DISTINCT h, r, t FROM ({' UNION ALL '.join(parts)})"


def read_triples(spark: SparkSession, path: str, delimiter: str = "\t", encoding: str = "UTF-8", columns: tuple[int, int, int] = (0, 1, 2)) -> DataFrame:
    """Labelled triples of a delimited file without header (compressed ones too). ``columns``: places of head, relation, tail.

    The label "nan" and empty-looking labels stay text; only rows with fewer columns have nulls and go.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(columns) + 1)])
    rows = spark.read.csv(path, sep=delimiter, encoding=encoding, schema=schema, quote="", nullValue="\0", emptyValue="")
    h, r, t = (F.col(f"c{i}") for i in columns)
    return rows.select(h.alias("h"), r.alias("r"), t.alias("t")).where("h is not null and r is not null and t is not null")


def write_triples(triples: DataFrame, path: str, delimiter: str = "\t") -> None:
    triples.select("h", "r", "t").write.csv(path, sep=delimiter, quote="", compression="gzip")


def write_dataset(splits: dict[str, DataFrame], path: str) -> None:
    """The splits of a dataset as one Parquet table partitioned by split."""
    parts = [df.select("h", "r", "t", F.lit(name).alias("split")) for name, df in splits.items()]
    reduce(DataFrame.unionByName, parts).write.partitionBy("split").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The splits of such a table; a split that is read alone prunes the others' files."""
    table = spark.read.parquet(path)
    return {r.split: table.where(F.col("split") == r.split).drop("split") for r in table.select("split").distinct().collect()}


def literal_matrix(literals: DataFrame, attributes: list[str]) -> DataFrame:
    """(entity, attribute, value) as one row per entity with a column for each attribute, 0 where missing; of several values the greatest."""
    return literals.groupBy("entity").pivot("attribute", attributes).agg(F.max("value")).na.fill(0.0)
