"""Element views over the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartweave.schema import conform


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _tags(**values) -> F.Column:
    """A map of those values that aren't null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, with a tag ``note`` only on errors."""
    e = _table(spark, sf_dir, "events")
    tags = _tags(event_type=F.col("event_type"), k=F.nullif(F.regexp_extract("props", '"k": ?([0-9]+)', 1), F.lit("")), note=F.when(F.col("event_type") == "error", "check"))
    return conform(
        e.select(
            F.lit("node").alias("type"), F.col("event_id").alias("id"), F.col("user_id").alias("uid"), _stamp("ts").alias("timestamp"), tags.alias("tags"),
            (F.col("event_id") % 90).cast("double").alias("lat"), (F.col("event_id") % 180).cast("double").alias("lon"),
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with user and changeset, which are missing on some."""
    c = _table(spark, sf_dir, "customer")
    some = F.col("c_custkey") % 3 != 0
    return conform(
        c.select(
            F.lit("node").alias("type"), F.col("c_custkey").alias("id"), F.when(some, F.col("c_name")).alias("user"), F.when(some, F.col("c_nationkey")).cast("bigint").alias("changeset"),
            F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 2 == 0).alias("visible"), _tags(name=F.col("c_name"), segment=F.col("c_mktsegment")).alias("tags"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
        )
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways through the parts of an order; orders without lines are empty ways."""
    o, line = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    nodes = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("nodes"))
    joined = o.join(nodes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return conform(
        joined.select(
            F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("changeset"), _stamp("o_orderdate").alias("timestamp"), _tags(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("tags"),
            F.coalesce("nodes", F.expr("cast(array() as array<bigint>)")).alias("nodes"),
        )
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the nations of a region."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    member = F.struct(F.lit("relation").alias("type"), F.col("n_nationkey").cast("bigint").alias("ref"), F.col("n_name").alias("role"))
    members = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(member)).alias("members"))
    joined = r.join(members, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return conform(joined.select(F.lit("relation").alias("type"), F.col("r_regionkey").alias("id"), _tags(name=F.col("r_name")).alias("tags"), F.coalesce("members", F.expr("cast(array() as array<struct<type:string,ref:bigint,role:string>>)")).alias("members")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose version is the size of a part."""
    p = _table(spark, sf_dir, "part")
    tags = _tags(name=F.col("p_name"), brand=F.col("p_brand"), type=F.col("p_type"), size=F.col("p_size"))
    return conform(p.select(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.col("p_size").alias("version"), tags.alias("tags"), F.lit(1.5).alias("lat"), F.lit(-2.25).alias("lon")))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the suppliers and then the customers of a nation."""
    n, r, s, c = (_table(spark, sf_dir, x) for x in ("nation", "region", "supplier", "customer"))
    both = s.select(F.col("s_nationkey").alias("nation"), F.lit(0).alias("rank"), F.col("s_suppkey").alias("ref")).union(c.select("c_nationkey", F.lit(1), "c_custkey"))
    member = lambda m: F.struct(F.lit("node").alias("type"), m["ref"].alias("ref"), F.when(m["rank"] == 0, "supplier").otherwise("customer").alias("role"))
    members = both.groupBy("nation").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ref"))), member).alias("members"))
    joined = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(members, F.col("n_nationkey") == F.col("nation"), "left")
    none = F.expr("cast(array() as array<struct<type:string,ref:bigint,role:string>>)")
    return conform(joined.select(F.lit("relation").alias("type"), F.col("n_nationkey").cast("bigint").alias("id"), _tags(name=F.col("n_name"), region=F.col("r_name")).alias("tags"), F.coalesce("members", none).alias("members")))


def all_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).unionByName(orders(spark, sf_dir)).unionByName(regions(spark, sf_dir))
