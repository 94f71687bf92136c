"""The property graph derived from the star-schema tables: nodes, rels, and the schema that governs them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN, VERSION = "run1", "v1"
#: Type, table, primary value and number of the nodes.
KINDS = [
    ("Part", "part", "p_name", "p_partkey"), ("Customer", "customer", "c_name", "c_custkey"), ("Supplier", "supplier", "s_name", "s_suppkey"),
    ("Nation", "nation", "n_name", "n_nationkey"), ("Region", "region", "r_name", "r_regionkey"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_key(kind: str, value) -> object:  # noqa: ANN001
    """type|primary value|schema version."""
    return F.concat_ws("|", F.lit(kind), value.cast("string"), F.lit(VERSION))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedupe_key, node_type, primary_value, run_id, schema_version, seq: one row per extracted node, so
    parts that share a name repeat a key."""
    return reduce(DataFrame.unionByName, [
        table(spark, sf_dir, t).select(
            node_key(kind, F.col(name)).alias("dedupe_key"), F.lit(kind).alias("node_type"), F.col(name).alias("primary_value"),
            F.lit(RUN).alias("run_id"), F.lit(VERSION).alias("schema_version"), F.col(key).cast("long").alias("seq"),
        ) for kind, t, name, key in KINDS
    ])


def rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedupe_key, rel_type, start_dedupe_key, end_dedupe_key, run_id, schema_version. Every 7th customer
    also has its edge reversed, every 5th supplier its edge twice."""
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    nation = lambda x, key: x.join(n, F.col(key) == n.n_nationkey)
    cn, sn = nation(c, "c_nationkey"), nation(s, "s_nationkey")
    ck, sk, nk = node_key("Customer", F.col("c_name")), node_key("Supplier", F.col("s_name")), node_key("Nation", F.col("n_name"))
    pick = lambda x, kind, a, b: x.select(F.lit(kind).alias("rel_type"), a.alias("start_dedupe_key"), b.alias("end_dedupe_key"))
    both = [
        pick(cn, "LOCATED_IN", ck, nk), pick(cn.where("c_custkey % 7 = 0"), "LOCATED_IN", nk, ck),
        pick(sn, "LOCATED_IN", sk, nk), pick(sn.where("s_suppkey % 5 = 0"), "LOCATED_IN", sk, nk),
        pick(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), "PART_OF", nk, node_key("Region", F.col("r_name"))),
    ]
    return reduce(DataFrame.unionByName, both).select(
        F.concat_ws("::", "rel_type", "start_dedupe_key", "end_dedupe_key", F.lit(VERSION)).alias("dedupe_key"),
        "rel_type", "start_dedupe_key", "end_dedupe_key", F.lit(RUN).alias("run_id"), F.lit(VERSION).alias("schema_version"),
    )


#: (start type, end type, edge type) that the locked schema allows.
SCHEMA_EDGES = [("Customer", "Nation", "LOCATED_IN"), ("Supplier", "Nation", "LOCATED_IN"), ("Nation", "Region", "PART_OF")]


def schema_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMA_EDGES, "start_type string, end_type string, rel_type string")


#: An edge that was added to the locked schema later.
AMENDED = ("Supplier", "Nation", "SERVES")


def amended(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([AMENDED], "start_type string, end_type string, rel_type string")


def more_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rels, and a second relationship of some customers and suppliers to their nation."""
    base = rels(spark, sf_dir)
    extra = base.where("rel_type = 'LOCATED_IN' and start_dedupe_key not like 'Nation|%' and length(end_dedupe_key) = 18").distinct()
    key = F.concat_ws("::", F.lit("SERVES"), "start_dedupe_key", "end_dedupe_key", F.lit(VERSION))
    return base.unionByName(extra.withColumns({"rel_type": F.lit("SERVES"), "dedupe_key": key}))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under longer and shorter names, as texts give them."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    long = F.concat_ws(" ", "p_name", F.lower("p_type"))
    name = F.when(k == 0, long).when(k == 1, F.concat(F.lit("The "), "p_name")).otherwise(F.concat(F.lit("a "), F.initcap("p_name"), F.lit(" of "), "p_type"))
    return p.select(
        node_key("Label", name).alias("dedupe_key"), F.lit("Label").alias("node_type"), name.alias("primary_value"),
        F.lit(RUN).alias("run_id"), F.lit(VERSION).alias("schema_version"), F.col("p_partkey").alias("seq"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every other with blank lines between its lines, every fifth with a list and a table at its end."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    more = F.when(F.col("doc_id") % 5 == 0, F.lit("\n\n- item\n\n| a | b |\n|---|:-:|\n| 1 | 2 |")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(text, more).alias("text"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what agents used."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("run"), (F.col("user_id") % 2).cast("string")).alias("run_id"), (F.col("event_id") % 100).alias("candidate_id"), F.col("event_type").alias("agent"),
        F.floor(F.col("value") * 10).alias("tokens_in"), F.floor("value").alias("tokens_out"), (F.col("value") / 1000).alias("cost"), "ts", F.col("event_id").alias("seq"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("seq"))


_NODE = """SELECT '{k}|' || {n} || '|v1' AS dedupe_key, '{k}' AS node_type, {n} AS primary_value, 'run1' AS run_id, 'v1' AS schema_version,
  CAST({i} AS BIGINT) AS seq FROM {t}"""
SQL = "WITH nodes AS (" + " UNION ALL ".join(
    _NODE.format(k=k, t=t, n=n, i=i) for k, t, n, i in KINDS
) + """), ends AS (
  SELECT 'LOCATED_IN' AS rel_type, 'Customer|' || c_name || '|v1' AS a, 'Nation|' || n_name || '|v1' AS b FROM customer
    JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'LOCATED_IN', 'Nation|' || n_name || '|v1', 'Customer|' || c_name || '|v1' FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'LOCATED_IN', 'Supplier|' || s_name || '|v1', 'Nation|' || n_name || '|v1' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'LOCATED_IN', 'Supplier|' || s_name || '|v1', 'Nation|' || n_name || '|v1' FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE s_suppkey % 5 = 0
  UNION ALL SELECT 'PART_OF', 'Nation|' || n_name || '|v1', 'Region|' || r_name || '|v1' FROM nation JOIN region ON n_regionkey = r_regionkey
), rels AS (
  SELECT rel_type || '::' || a || '::' || b || '::v1' AS dedupe_key, rel_type, a AS start_dedupe_key, b AS end_dedupe_key, 'run1' AS run_id,
    'v1' AS schema_version FROM ends
) """
LABELLED = """WITH labelled AS (SELECT 'Label|' || name || '|v1' AS dedupe_key, 'Label' AS node_type, name AS primary_value, seq FROM (
  SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN 'The ' || p_name
    ELSE 'a ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' of ' || p_type END AS name FROM part)) """
MORE_RELS_SQL = """, more_rels AS (SELECT * FROM rels UNION ALL SELECT DISTINCT 'SERVES::' || start_dedupe_key || '::' || end_dedupe_key || '::v1',
  'SERVES', start_dedupe_key, end_dedupe_key, run_id, schema_version
  FROM rels WHERE rel_type = 'LOCATED_IN' AND start_dedupe_key NOT LIKE 'Nation|%' AND length(end_dedupe_key) = 18) """


def both_sql() -> str:
    """The graph's CTEs with the labelled parts among the nodes."""
    labelled = LABELLED.removeprefix("WITH ")
    return SQL.replace("WITH nodes AS (", f"""WITH {labelled}, nodes AS (SELECT dedupe_key, node_type, primary_value, 'run1' AS run_id,
      'v1' AS schema_version, seq FROM labelled UNION ALL """, 1)
