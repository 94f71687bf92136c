"""Queries of findings and their way to proposals, of reads and lists, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import scores as S
from graphweave.operators import curation as C
from graphweave.operators import detect as T
from graphweave.operators import graph as G
from graphweave.operators import jobs as J
from graphweave.operators import reads as R
from graphweave.operators import write as W
from graphweave.plans import model as M
from graphweave.registry_curation import events, marked

Query = Callable[[SparkSession, str], DataFrame]


def generated(stage: int | None, types: list[str] | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = T.generate(M.nodes(s, d), M.more_rels(s, d), M.schema_edges(s), M.amended(s), marked(s, d), {"Part": "brand"}, M.RUN, M.VERSION, stage, types)
        return found.select("candidate_id", "candidate_type", "lane", "severity", "method", F.array_join("refs", " ").alias("refs"), "stage")

    return run


def scored(s: SparkSession, d: str) -> DataFrame:
    """Parts as findings of all types, methods and scores."""
    k = F.col("p_partkey")
    pick = lambda of, *x: F.element_at(F.array(*map(F.lit, x)), (of % len(x) + 1).cast("int"))
    value = F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.concat_ws(" ", "p_name", F.lower("p_type"))).when(k % 4 == 2, F.concat("p_name", F.lit("s"))).otherwise(F.lit(""))
    return M.table(s, d, "part").select(
        k.alias("k"), pick(F.floor(k / 7), *G.TYPES, "other", "probable_duplicate", "probable_duplicate").alias("candidate_type"),
        pick(k, "bidirectional_rel_duplicate", "canonical_inverse_violation", "orphan_node", "degree_outlier", "missing_provenance_node", "missing_provenance_rel", "qualifier_missing", "other").alias("method"),
        F.col("p_name").alias("value_a"), value.alias("value_b"), (0.86 + k % 15 / 100).alias("similarity"), (k % 11 / 10).alias("overlap"), (F.greatest(k % 5 - 2, F.lit(0)) / 10).alias("context"), (k % 6 == 0).alias("contained"))


def pairs(s: SparkSession, d: str) -> DataFrame:
    """Customers of neighbouring numbers as findings: chains of four, in calls of three hundred."""
    k = F.col("c_custkey")
    ref = lambda n: F.concat(F.lit("n"), F.lpad(n.cast("string"), 8, "0"))
    rows = M.table(s, d, "customer").where("c_custkey % 7 <> 3 and c_custkey % 20 <> 19")
    return rows.select(
        F.floor(k / 300).alias("call"), k.alias("seq"), F.concat(F.lit("c"), F.lpad(k.cast("string"), 8, "0")).alias("candidate_id"), F.array(ref(k), ref(k + 1)).alias("refs"),
        F.lit("run1").alias("run_id"), F.lit("v1").alias("schema_version"))


def packets(s: SparkSession, d: str) -> DataFrame:
    """Relationships as violations and duplicates, with what a proposal says of each."""
    n = F.length("start_dedupe_key") + F.length("end_dedupe_key")
    rows = M.rels(s, d).distinct().withColumn("n", n)
    both = F.col("n") % 3 == 2
    found = rows.select(
        F.sha2("dedupe_key", 256).alias("candidate_id"), F.when(both, "exact_rel_duplicate").otherwise("canonical_violation").alias("candidate_type"), F.lit("relationship").alias("lane"),
        F.when(both, "bidirectional_rel_duplicate").when(F.col("n") % 3 == 1, "canonical_inverse_violation").otherwise("canonical_direction_violation").alias("method"),
        F.when(both, F.array("dedupe_key", F.concat("dedupe_key", F.lit("~")))).otherwise(F.array("dedupe_key", "start_dedupe_key", "end_dedupe_key")).alias("refs"),
        F.col("dedupe_key").alias("rel_key"), "rel_type", F.col("start_dedupe_key").alias("start_key"), F.col("end_dedupe_key").alias("end_key"))
    said = rows.select(F.sha2("dedupe_key", 256).alias("candidate_id"), F.when(both, "delete").otherwise("normalize").alias("proposal_class"), F.when(F.col("n") % 2 == 0, "FIXED").alias("normalize_target"))
    return T.packet_targets(said, found)


def queries() -> dict[str, Query]:
    n, r = M.nodes, M.rels
    totals = lambda s, d: G.degree(n(s, d), r(s, d)).select("dedupe_key", (F.col("in_degree") + F.col("out_degree")).alias("total"))

    def consolidated(s: SparkSession, d: str) -> DataFrame:
        p = pairs(s, d)
        out, became = T.consolidated(p, p.select("candidate_id", (F.col("seq") % 9 / 10).alias("score"), F.array(F.concat(F.lit("i"), F.col("seq").cast("string"))).alias("items")))
        rows = out.select("cluster_id", "n", F.array_join("refs", " ").alias("refs"), "score", F.array_join("items", " ").alias("items"))
        return rows.join(became.groupBy("cluster_id").agg(F.count("*").alias("members")), "cluster_id")

    def opened(s: SparkSession, d: str) -> DataFrame:
        p = pairs(s, d)
        proposals = p.select("candidate_id", F.when(F.col("seq") % 5 == 0, "rejected").when(F.col("seq") % 5 == 1, "pending").alias("state"))
        return T.open_candidates(p, p.where("seq % 11 = 0"), proposals, p.where("seq % 2 = 0")).select("candidate_id")

    def orphans(s: SparkSession, d: str) -> DataFrame:
        """Orphans found by two stages are deleted once, in one set."""
        alone = G.orphans(n(s, d), r(s, d))
        found = alone.select(F.sha2("dedupe_key", 256).alias("candidate_id"), F.lit("orphan_node").alias("method"), F.array("dedupe_key").alias("refs"), F.explode(F.array(F.lit(None).cast("int"), F.lit(3))).alias("stage"))
        plan = T.orphan_plan(found, "run1", "ann")
        steps = plan.select("operation", "dedupe_key", *[F.lit(None).cast(t).alias(c) for c, t in (("merge_keys", "array<string>"), ("rel_type", "string"), ("start_key", "string"), ("end_key", "string"), ("put", "map<string,string>"), ("cut", "array<string>"), ("run_id", "string"))])
        nodes = n(s, d).withColumn("properties", F.create_map().cast("map<string,string>"))
        left, _ = W.applied(nodes, r(s, d).withColumn("properties", F.create_map().cast("map<string,string>")), steps)
        rows = plan.select("proposal_id", "approval_id", "dedupe_key")
        return rows.unionByName(left.groupBy("node_type").agg(F.count("*").cast("string").alias("k")).select(F.col("node_type").alias("proposal_id"), F.lit("left").alias("approval_id"), F.col("k").alias("dedupe_key")))

    def contexts(s: SparkSession, d: str) -> DataFrame:
        refs = r(s, d).distinct().select(F.col("dedupe_key").alias("candidate_id"), F.array("start_dedupe_key", "end_dedupe_key").alias("refs"))
        return R.context_of(refs, r(s, d))[0]

    def activity(s: SparkSession, d: str) -> DataFrame:
        e = events(s, d).withColumn("run_id", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string"))))
        return J.activity(e, ["purchase"], run="run1").select("event_id", "event_type")

    return {
        "gr_generate": generated(None), "gr_generate_stage1": generated(1), "gr_generate_stage3": generated(3), "gr_probable_dup_typed": generated(2, ["Part", "Nation"]),
        "gr_probable_dup_scoped": lambda s, d: G.probable_pairs(n(s, d), r(s, d), focus=n(s, d).where("node_type = 'Part' and seq % 3 = 0 or node_type = 'Supplier'")).select("key_a", "key_b", "method", "similarity", "context"),
        "win_dedupe_by_id": lambda s, d: T.first_by_id(scored(s, d).select((F.col("k") % 700).alias("candidate_id"), (F.col("k") % 4).cast("int").alias("stage"), F.array(F.lpad(F.col("k").cast("string"), 8, "0")).alias("refs"))).select("candidate_id", "stage", F.get("refs", 0).alias("ref")),
        "fn_structural_recommendation": lambda s, d: T.recommend(scored(s, d)).select("k", "action", F.round("confidence", 6).alias("confidence")),
        "gr_group_by_shared_refs": lambda s, d: T.packed_batches(pairs(s, d)),
        "gr_consolidate_clusters": consolidated,
        "gr_build_packet": packets,
        "flt_has_proposal": opened,
        "dml_bulk_orphans": orphans,
        "ag_evidence_neighbors": contexts,
        "agg_type_counts": lambda s, d: R.type_counts(scored(s, d)),
        "agg_risk_distribution": lambda s, d: scored(s, d).groupBy(S.risk(F.col("candidate_type"), F.lit(None).cast("string")).alias("risk")).agg(F.count("*").alias("n")),
        "agg_evidence_mix": lambda s, d: scored(s, d).groupBy(F.when(F.col("contained"), "supporting").when(F.col("context") > 0, "corroborating").otherwise("conflicting").alias("classification")).agg(F.count("*").alias("n")),
        "agg_entity_counts": lambda s, d: n(s, d).agg(F.count("*").alias("nodes")).crossJoin(r(s, d).agg(F.count("*").alias("edges"))),
        "page_nodes_total": lambda s, d: R.page(n(s, d).where("node_type = 'Customer'").select("dedupe_key", "seq"), ["dedupe_key", "seq"], 3, 20),
        "page_edges_total": lambda s, d: R.page(r(s, d).where("rel_type = 'PART_OF'").select("dedupe_key"), ["dedupe_key"], 1, 5000),
        "topk_central_bubble": lambda s, d: R.central(totals(s, d)),
        "join_degrees_meta": lambda s, d: R.degrees_with_types(G.degree(n(s, d), r(s, d)), n(s, d)),
        "set_effective_edges": lambda s, d: G.effective_edges(M.schema_edges(s), M.amended(s)).join(r(s, d).groupBy("rel_type").agg(F.count("*").alias("n")), "rel_type", "left").fillna(0, ["n"]),
        "prj_schema_rules": lambda s, d: R.schema_rules(n(s, d).select(F.col("node_type").alias("type"), F.lit("name").alias("primary_property")).distinct(), M.schema_edges(s)),
        "flt_activity_run": activity,
        "agg_docs_by_parser": lambda s, d: R.by_parser(M.table(s, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source")).alias("parser"), F.col("n_chars").alias("n_chunks"))),
        "gr_components_typed": lambda s, d: C.components(pairs(s, d).select(F.get("refs", 0).alias("key_a"), F.get("refs", 1).alias("key_b"))),
    }


_SCORED = """WITH x AS (SELECT p_partkey AS k, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' ' || lower(p_type)
  WHEN 2 THEN p_name || 's' ELSE '' END AS b,
    ['exact_node_duplicate', 'exact_rel_duplicate', 'probable_duplicate', 'canonical_violation', 'structural_anomaly', 'other', 'probable_duplicate',
      'probable_duplicate'][p_partkey // 7 % 8 + 1] AS type,
    ['bidirectional_rel_duplicate', 'canonical_inverse_violation', 'orphan_node', 'degree_outlier', 'missing_provenance_node',
      'missing_provenance_rel', 'qualifier_missing', 'other'][p_partkey % 8 + 1] AS method,
    0.86::DOUBLE + (p_partkey % 15)::DOUBLE / 100 AS jw, (p_partkey % 11)::DOUBLE / 10 AS tok, greatest(p_partkey % 5 - 2, 0)::DOUBLE / 10 AS cj,
      p_partkey % 6 = 0 AS held FROM part),
  y AS (SELECT *, list_distinct(list_filter(string_split(lower(a), ' '), lambda w: w <> '')) AS ta, list_distinct(list_filter(string_split(lower(b),
    ' '), lambda w: w <> '')) AS tb FROM x),
  z AS (SELECT *, len(ta) <> len(tb) AND len(list_intersect(ta, tb)) = least(len(ta), len(tb)) AND a <> '' AND b <> '' AS inside, lower(a) = lower(b)
    AND a <> '' AS same FROM y) """
_ADVICE = """SELECT k, CASE type WHEN 'exact_node_duplicate' THEN 'merge' WHEN 'exact_rel_duplicate' THEN CASE method
  WHEN 'bidirectional_rel_duplicate' THEN 'delete' ELSE 'merge' END WHEN 'canonical_violation' THEN 'normalize'
    WHEN 'structural_anomaly' THEN CASE method WHEN 'orphan_node' THEN 'delete' WHEN 'missing_provenance_node' THEN 'normalize'
      WHEN 'missing_provenance_rel' THEN 'normalize' WHEN 'qualifier_missing' THEN 'normalize' ELSE 'defer' END
    WHEN 'probable_duplicate' THEN CASE WHEN same OR (held AND cj > 0) THEN 'merge' WHEN held THEN 'defer' WHEN jw >= 0.95::DOUBLE THEN 'merge'
      WHEN jw >= 0.9::DOUBLE AND inside THEN CASE WHEN cj > 0 THEN 'merge' ELSE 'defer' END
      WHEN jw >= 0.9::DOUBLE AND (cj > 0 OR tok >= 0.8::DOUBLE) THEN 'merge' ELSE 'defer' END ELSE 'defer' END AS action,
  round(CASE type WHEN 'exact_node_duplicate' THEN 0.95::DOUBLE WHEN 'exact_rel_duplicate' THEN CASE method
    WHEN 'bidirectional_rel_duplicate' THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END
    WHEN 'canonical_violation' THEN CASE method WHEN 'canonical_inverse_violation' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END
    WHEN 'structural_anomaly' THEN CASE method WHEN 'orphan_node' THEN 0.7::DOUBLE WHEN 'degree_outlier' THEN 0.3::DOUBLE
      WHEN 'missing_provenance_node' THEN 0.9::DOUBLE WHEN 'missing_provenance_rel' THEN 0.9::DOUBLE WHEN 'qualifier_missing' THEN 0.8::DOUBLE
      ELSE 0.25::DOUBLE END
    WHEN 'probable_duplicate' THEN CASE WHEN same THEN least(0.95::DOUBLE, greatest(jw, 0.9::DOUBLE)) WHEN held AND cj > 0 THEN 0.8::DOUBLE
      WHEN held THEN 0.55::DOUBLE WHEN jw >= 0.95::DOUBLE AND cj > 0 THEN 0.9::DOUBLE WHEN jw >= 0.95::DOUBLE THEN 0.85::DOUBLE
      WHEN jw >= 0.9::DOUBLE AND inside AND cj > 0 THEN 0.8::DOUBLE WHEN jw >= 0.9::DOUBLE AND inside THEN 0.5::DOUBLE WHEN jw >= 0.9::DOUBLE
        AND cj > 0 THEN 0.75::DOUBLE + least(cj, 0.15::DOUBLE)
      WHEN jw >= 0.9::DOUBLE AND tok >= 0.8::DOUBLE THEN 0.65::DOUBLE WHEN jw >= 0.9::DOUBLE THEN 0.45::DOUBLE ELSE 0.3::DOUBLE END
        ELSE 0.2::DOUBLE END, 6) AS confidence FROM z"""
_RISK = "CASE type WHEN 'probable_duplicate' THEN 'high' WHEN 'structural_anomaly' THEN 'low' ELSE 'medium' END"
_PAIRS = """WITH p AS (SELECT c_custkey AS k, c_custkey // 300 AS call, 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id,
  'n' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS a, 'n' || lpad(CAST(c_custkey + 1 AS VARCHAR), 8, '0') AS b
    FROM customer WHERE c_custkey % 7 <> 3 AND c_custkey % 20 <> 19),
  g AS (SELECT *, k - row_number() OVER (ORDER BY k) AS grp FROM p) """
_CLUSTERS = _PAIRS + """, c AS (SELECT grp, count(*) AS n, string_agg('"' || ref || '"', ',' ORDER BY ref) AS json, string_agg(ref, ' '
  ORDER BY ref) AS refs FROM (SELECT grp, a AS ref, k FROM g UNION SELECT grp, b, k FROM g) GROUP BY 1),
  m AS (SELECT grp, count(*) AS n, min(id) AS single, max((k % 9)::DOUBLE / 10) AS score, string_agg('i' || k, ' ' ORDER BY k) AS items FROM g
    GROUP BY 1),
  refs AS (SELECT grp, string_agg(DISTINCT ref, ' ' ORDER BY ref) AS refs, string_agg(DISTINCT '"' || ref || '"', ','
    ORDER BY '"' || ref || '"') AS json FROM (SELECT grp, a AS ref FROM g UNION SELECT grp, b FROM g) GROUP BY 1)
  SELECT CASE WHEN n = 1 THEN single ELSE {ident} END AS cluster_id, n, refs, score, items, n AS members FROM m JOIN refs USING (grp)"""
_PACKED = _PAIRS.replace("WITH p", "WITH RECURSIVE p") + """, s AS (SELECT call, grp, min(k) AS first, count(*) AS n FROM g GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY call ORDER BY first) AS i FROM s),
  f AS (SELECT call, i, 0 AS batch, 8 - n AS room FROM o WHERE i = 1
    UNION ALL SELECT o.call, o.i, CASE WHEN o.n > f.room THEN f.batch + 1 ELSE f.batch END, CASE WHEN o.n > 8 THEN 0 WHEN o.n > f.room THEN 8 - o.n
      ELSE f.room - o.n END FROM f JOIN o ON o.call = f.call AND o.i = f.i + 1)
  SELECT id AS candidate_id, call, batch FROM g JOIN o USING (call, grp) JOIN f USING (call, i)"""
_PACKETS = """, e AS (SELECT DISTINCT *, length(start_dedupe_key) + length(end_dedupe_key) AS n FROM rels), v AS (SELECT *, sha256(dedupe_key) AS id,
  n % 3 = 2 AS both_, n % 3 = 1 AS inverse, CASE WHEN n % 2 = 0 THEN 'FIXED' WHEN n % 3 = 1 THEN rel_type END AS target FROM e),
  u AS (SELECT *, unnest(CASE WHEN both_ THEN [dedupe_key, dedupe_key || '~'] ELSE [dedupe_key, start_dedupe_key, end_dedupe_key] END) AS ref,
    generate_subscripts(CASE WHEN both_ THEN [dedupe_key, ''] ELSE [dedupe_key, '', ''] END, 1) - 1 AS pos FROM v),
  w AS (SELECT *, NOT both_ AND pos = 0 AND target IS NOT NULL AS again FROM u)
  SELECT id AS candidate_id, CASE WHEN both_ THEN 'delete' WHEN target IS NULL THEN 'defer' ELSE 'normalize' END AS proposal_class, pos, CASE
    WHEN both_ OR pos = 0 THEN 'relationship' ELSE 'node' END AS element_type, ref AS dedupe_key,
    CASE WHEN again THEN target END AS new_type, CASE WHEN again THEN CASE WHEN inverse THEN end_dedupe_key
      ELSE start_dedupe_key END END AS start_key, CASE WHEN again THEN CASE WHEN inverse THEN start_dedupe_key ELSE end_dedupe_key END END AS end_key
      FROM w"""


def alike_sql(pairs: str) -> str:
    """CTEs walk, jw, scored: Jaro-Winkler and token scores of the distinct value pairs of a table with value_a and
    value_b, by walking the first value's characters: mask marks the characters of the second that are taken."""
    from graphweave import registry as Q

    held = Q.contained_sql("value_a", "value_b", Q.content_sql("value_a"), Q.content_sql("value_b"))
    x, y = (Q._TOK.format(v) for v in ("value_a", "value_b"))
    return f""", words AS (SELECT DISTINCT value_a AS a, value_b AS b FROM {pairs}),
  walk AS (SELECT a, b, 0 AS i, repeat('0', length(b)) AS mask, '' AS taken, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach FROM words
    UNION ALL SELECT a, b, i + 1, CASE WHEN j IS NULL THEN mask ELSE substr(mask, 1, j - 1) || '1' || substr(mask, j + 1) END, CASE
      WHEN j IS NULL THEN taken ELSE taken || substr(a, i + 1, 1) END, reach
      FROM (SELECT *, list_filter(range(greatest(i + 1 - reach, 1), least(i + 1 + reach, length(b)) + 1), lambda k: substr(mask, k, 1) = '0'
        AND substr(b, k, 1) = substr(a, i + 1, 1))[1] AS j
        FROM walk WHERE i < length(a))),
  ended AS (SELECT a, b, taken, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda k: substr(mask, k, 1) = '1'),
    lambda k: substr(b, k, 1)), '') AS other FROM walk WHERE i = length(a)),
  jaro AS (SELECT a, b, length(taken)::DOUBLE AS m, len(list_filter(range(1, length(taken) + 1), lambda k: substr(taken, k, 1) <> substr(other, k,
    1)))::DOUBLE / 2 AS moved,
    len(list_filter(range(1, 5), lambda k: k <= least(length(a), length(b)) AND substr(a, 1, k) = substr(b, 1, k)))::DOUBLE AS same FROM ended),
  jw AS (SELECT a, b, CASE WHEN a = b THEN 1::DOUBLE WHEN m = 0 THEN 0::DOUBLE
    ELSE (m / length(a) + m / length(b) + (m - moved) / m) / 3 + same * 0.1::DOUBLE * (1 - (m / length(a) + m / length(b) + (m - moved) / m) / 3) END AS jw
    FROM jaro),
  scored AS (SELECT p.*, jw, {x} AS x, {y} AS y, {held} AS held FROM {pairs} p JOIN jw ON a = value_a AND b = value_b),
  lapped AS (SELECT *, CASE WHEN len(x) + len(y) = 0 THEN 0::DOUBLE ELSE 2::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END AS overlap
    FROM scored),
  links AS (SELECT start_dedupe_key AS k, end_dedupe_key AS o FROM rels UNION SELECT end_dedupe_key, start_dedupe_key FROM rels),
    near_of AS (SELECT k, list(o) AS os FROM links GROUP BY 1),
  likely AS (SELECT node_type, key_a, key_b, value_a, value_b, alike, NOT alike AS contained, CASE WHEN alike THEN 'jaro_winkler_0.90'
    ELSE 'token_containment' END AS method, round(jw, 6) AS similarity, round(overlap, 6) AS overlap,
      CASE WHEN cn = 0 THEN 0::DOUBLE ELSE round(ci::DOUBLE / (cn - ci), 6) END AS context
    FROM (SELECT l.*, windowed AND jw >= 0.9::DOUBLE AND (jw >= 0.95::DOUBLE OR overlap >= 0.5::DOUBLE) AS alike, len(list_intersect(coalesce(n.os,
      []), coalesce(m.os, []))) AS ci, len(coalesce(n.os, [])) + len(coalesce(m.os, [])) AS cn
      FROM lapped l LEFT JOIN near_of n ON n.k = key_a LEFT JOIN near_of m ON m.k = key_b) WHERE alike OR held) """


def compared_sql(types: str = "") -> str:
    """CTE compared: the pairs that the window compares, and those of the token blocks that it doesn't."""
    from graphweave import registry as Q

    held = Q.contained_sql("v.value", "w.value", Q.content_sql("v.value"), Q.content_sql("w.value"))
    return Q.WINDOW.replace("FROM nodes GROUP BY 1, 2)", f"FROM nodes {types} GROUP BY 1, 2)") + f""", compared AS (SELECT *, true AS windowed
      FROM pairs UNION ALL
    SELECT v.node_type, v.dedupe_key, w.dedupe_key, v.value, w.value, false FROM vals v JOIN vals w ON v.node_type = w.node_type
      AND v.dedupe_key < w.dedupe_key AND v.value <> '' AND w.value <> ''
    WHERE {held} AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.node_type = v.node_type AND p.key_a = v.dedupe_key AND p.key_b = w.dedupe_key)) """


_LIKELY_ID = """CASE WHEN alike THEN {one} ELSE {two} END"""


def likely_id() -> str:
    from graphweave.registry import candidate_sql

    refs = """'"' || key_a || '","' || key_b || '"'"""
    return _LIKELY_ID.format(one=candidate_sql("probable_duplicate", "jaro_winkler_0.90", refs), two=candidate_sql("probable_duplicate", "token_containment", refs))


def scoped_sql() -> str:
    """All detectors on the focus."""
    from graphweave import registry as Q
    from graphweave.registry_curation import _FOCUS, _MARK

    mine = ", mine AS (SELECT *, true AS windowed FROM pairs WHERE key_a IN (SELECT dedupe_key FROM focus) OR key_b IN (SELECT dedupe_key FROM focus)) "
    dup = ", dup AS (SELECT dedupe_key FROM nodes WHERE dedupe_key IN (SELECT dedupe_key FROM focus) GROUP BY 1 HAVING count(*) >= 2) "
    return recursive(M.SQL + _FOCUS + Q.WINDOW + mine + alike_sql("mine") + _MARK + Q.violations_sql(Q.ALLOWED, "near") + dup) + f"""SELECT dedupe_key, NULL AS other, method FROM structural
        WHERE dedupe_key IN (SELECT dedupe_key FROM focus) AND (method <> 'orphan_node' OR dedupe_key NOT IN (SELECT dedupe_key FROM dup UNION
          SELECT key_a FROM likely UNION SELECT key_b FROM likely))
      UNION SELECT dedupe_key, NULL, 'exact_node_dedupe_key' FROM dup UNION SELECT key_a, key_b, 'probable_duplicate' FROM likely
      UNION SELECT dedupe_key, NULL, 'exact_rel_dedupe_key' FROM near GROUP BY 1 HAVING count(*) >= 2
      UNION SELECT refs, NULL, 'bidirectional_rel_duplicate' FROM ({Q.BIDIRECTIONAL.replace("FROM rels", "FROM near")}) UNION SELECT dedupe_key, NULL,
        'canonical_violation' FROM bad"""


def clusters_sql() -> str:
    """The probable duplicates with their clusters, enriched by the properties of the nodes that have any."""
    from graphweave.registry_curation import _MARK

    return recursive(M.both_sql() + compared_sql() + alike_sql("compared") + _MARK.replace("FROM nodes LEFT JOIN part", """FROM (SELECT * FROM nodes WHERE node_type <> 'Label') nodes
      LEFT JOIN part""")) + """,
      one AS (SELECT dedupe_key, arg_min(struct_pack(b := brand, k := kind, s := size), seq) AS p FROM mark GROUP BY 1),
      both_ AS (SELECT l.*, (x.p.b = y.p.b)::INT AS sb, (x.p.k = y.p.k)::INT AS sk, (x.p.s = y.p.s)::INT AS ss, (coalesce(x.p.b,
        y.p.b) IS NOT NULL)::INT + (coalesce(x.p.k, y.p.k) IS NOT NULL)::INT + (coalesce(x.p.s, y.p.s) IS NOT NULL)::INT AS names
        FROM likely l LEFT JOIN one x ON x.dedupe_key = key_a LEFT JOIN one y ON y.dedupe_key = key_b),
      rated AS (SELECT *, coalesce(sb = 0 OR sk = 0 OR ss = 0, false) OR coalesce(sb, 1) = 0 OR coalesce(sk, 1) = 0 OR coalesce(ss,
        1) = 0 AS conflict,
        CASE WHEN names = 0 THEN 0::DOUBLE ELSE round((coalesce(sb, 0) + coalesce(sk, 0) + coalesce(ss, 0))::DOUBLE / names, 6) END AS po FROM both_),
      graded AS (SELECT *, round(CASE WHEN contained THEN 0.7::DOUBLE + least(context * 0.15::DOUBLE + po * 0.1::DOUBLE, 0.25::DOUBLE)
        WHEN context = 0 THEN 0.65::DOUBLE * similarity + 0.25::DOUBLE * overlap + 0.1::DOUBLE * po
        ELSE 0.5::DOUBLE * similarity + 0.25::DOUBLE * overlap + 0.15::DOUBLE * context + 0.1::DOUBLE * po END, 4) AS composite FROM rated),
      pairs_of AS (SELECT key_a AS a, key_b AS b FROM likely UNION SELECT key_b, key_a FROM likely), reach AS (SELECT a, a AS b FROM pairs_of UNION
        SELECT reach.a, pairs_of.b FROM reach JOIN pairs_of ON pairs_of.a = reach.b),
      roots AS (SELECT a AS k, min(b) AS cluster FROM reach GROUP BY 1), sizes AS (SELECT cluster, count(*) AS keys FROM roots GROUP BY 1),
      facts AS (SELECT cluster, keys > 8 OR min(node_type) <> max(node_type) OR bool_or(conflict) AS suspect, keys FROM graded JOIN roots ON k = key_a
        JOIN sizes USING (cluster) GROUP BY cluster, keys)
      SELECT key_a, key_b, cluster, keys, suspect, CASE WHEN composite >= 0.8::DOUBLE AND NOT conflict THEN CASE WHEN suspect THEN 'medium'
        ELSE 'high' END WHEN composite >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS band
      FROM graded JOIN roots ON k = key_a JOIN facts USING (cluster)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def generated_sql(stages: tuple[int, ...]) -> str:
    """The findings of the stages; orphans that a duplicate of these names are left out."""
    from graphweave import registry as Q
    from graphweave.registry_curation import _MARK

    one = """'"' || dedupe_key || '"'"""
    parts = []
    if 1 in stages:
        parts = [
            f"SELECT candidate_id, candidate_type, 'node' AS lane, severity, 'exact_node_dedupe_key' AS method, dedupe_key AS refs, 1 AS stage FROM ({Q._NODE_DUP})",
            f"""SELECT candidate_id, candidate_type, 'relationship', severity, 'exact_rel_dedupe_key', dedupe_key, 1
              FROM ({Q._REL_DUP.replace('FROM rels', 'FROM more_rels')})""",
            "SELECT candidate_id, 'exact_rel_duplicate', 'relationship', 'high', 'bidirectional_rel_duplicate', refs, 1 FROM (" + Q.BIDIRECTIONAL.replace("FROM rels", "FROM more_rels") + ")",
            """SELECT DISTINCT candidate_id, 'canonical_violation', 'relationship', severity, 'canonical_' || violation || '_violation',
              dedupe_key || ' ' || start_dedupe_key || ' ' || end_dedupe_key, 1 FROM bad""",
        ]
    if 2 in stages:
        parts.append(f"SELECT {likely_id()}, 'probable_duplicate', 'node', 'medium', method, key_a || ' ' || key_b, 2 FROM likely")
    if 3 in stages:
        ident = "CASE method " + " ".join(f"WHEN '{m}' THEN {Q.candidate_sql('structural_anomaly', m, one)}" for m in ("orphan_node", "missing_provenance_node", "missing_provenance_rel", "qualifier_missing")) + " END"
        named = ["SELECT dedupe_key FROM nodes GROUP BY 1 HAVING count(*) >= 2"] * (1 in stages) + ["SELECT key_a FROM likely", "SELECT key_b FROM likely"] * (2 in stages)
        keep = f"WHERE method <> 'orphan_node' OR dedupe_key NOT IN ({' UNION '.join(named)})" if named else ""
        parts.append(f"""SELECT DISTINCT {ident} AS candidate_id, 'structural_anomaly' AS candidate_type, 'structural' AS lane, severity, method,
          dedupe_key AS refs, 3 AS stage FROM structural {keep}""")
    bad = Q.violations_sql(Q.ALLOWED + ", " + str(M.AMENDED), "more_rels")
    likely = compared_sql() + alike_sql("compared") if 2 in stages else ""
    return recursive(M.SQL + M.MORE_RELS_SQL + likely.replace("FROM rels", "FROM more_rels") + bad + _MARK + " UNION ALL ".join(parts))


def oracle_sql() -> dict[str, str]:
    from graphweave.registry import WINDOW, candidate_sql

    g = M.SQL
    degree = """, deg AS (SELECT k AS dedupe_key, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_degree
      FROM (SELECT DISTINCT dedupe_key AS k FROM nodes) LEFT JOIN (
      SELECT start_dedupe_key AS k, 0 AS i, 1 AS o FROM (SELECT DISTINCT dedupe_key, start_dedupe_key FROM rels) UNION ALL SELECT end_dedupe_key, 1, 0
        FROM (SELECT DISTINCT dedupe_key, end_dedupe_key FROM rels)) USING (k) GROUP BY k) """
    ident = candidate_sql("probable_duplicate", "cluster_merge", "json")
    return {
        "gr_generate": generated_sql((1, 2, 3)),
        "gr_scoped_candidates": scoped_sql(),
        "gr_cluster_validate": clusters_sql(),
        "gr_generate_stage1": generated_sql((1,)),
        "gr_probable_dup": recursive(M.both_sql() + compared_sql() + alike_sql("compared")) + f"""SELECT {likely_id()} AS candidate_id,
          * EXCLUDE (alike, contained), 'medium' AS severity FROM likely""",
        "gr_probable_dup_typed": recursive(g + compared_sql("WHERE node_type IN ('Part', 'Nation')") + alike_sql("compared"))
        + f"""SELECT {likely_id()} AS candidate_id, 'probable_duplicate' AS candidate_type, 'node' AS lane, 'medium' AS severity, method,
          key_a || ' ' || key_b AS refs, 2 AS stage FROM likely""",
        "gr_probable_dup_scoped": recursive(g + WINDOW + """, focus AS (SELECT DISTINCT dedupe_key FROM nodes WHERE node_type = 'Part' AND seq % 3 = 0
          OR node_type = 'Supplier'),
          mine AS (SELECT *, true AS windowed FROM pairs WHERE key_a IN (SELECT dedupe_key FROM focus) OR key_b IN (SELECT dedupe_key FROM focus)) """ + alike_sql("mine")) + """SELECT key_a, key_b, method, similarity, context FROM likely""",
        "gr_generate_stage3": generated_sql((3,)),
        "win_dedupe_by_id": """SELECT p_partkey % 700 AS candidate_id, min(p_partkey % 4) AS stage, arg_min(lpad(CAST(p_partkey AS VARCHAR), 8, '0'),
          (p_partkey % 4, p_partkey)) AS ref FROM part GROUP BY 1""",
        "fn_structural_recommendation": _SCORED + _ADVICE,
        "gr_group_by_shared_refs": _PACKED,
        "gr_consolidate_clusters": _CLUSTERS.replace("{ident}", ident),
        "gr_build_packet": g + _PACKETS,
        "flt_has_proposal": _PAIRS + "SELECT id AS candidate_id FROM p WHERE k % 11 <> 0 AND k % 5 <> 1 AND k % 2 = 0",
        "dml_bulk_orphans": g + """, o AS (SELECT DISTINCT dedupe_key FROM nodes WHERE dedupe_key NOT IN (SELECT start_dedupe_key FROM rels UNION
          SELECT end_dedupe_key FROM rels)),
          p AS (SELECT dedupe_key, sha256('{"candidate_id":"' || sha256(dedupe_key) || '","proposal_class":"delete","run_id":"run1"}') AS proposal_id
            FROM o)
          SELECT proposal_id, sha256('approval:' || proposal_id || ':ann') AS approval_id, dedupe_key FROM p
          UNION ALL SELECT node_type, 'left', CAST(count(*) AS VARCHAR) FROM nodes WHERE dedupe_key NOT IN (SELECT dedupe_key FROM o) GROUP BY 1""",
        "ag_evidence_neighbors": g + """, near AS (SELECT start_dedupe_key AS k, end_dedupe_key AS o FROM rels UNION SELECT end_dedupe_key, start_dedupe_key FROM rels),
          c AS (SELECT dedupe_key AS candidate_id, start_dedupe_key AS ref FROM rels UNION SELECT dedupe_key, end_dedupe_key FROM rels)
          SELECT candidate_id, ref, count(o) AS n, min(o) AS first FROM c LEFT JOIN near ON k = ref GROUP BY 1, 2""",
        "agg_type_counts": _SCORED + "SELECT type AS candidate_type, count(*) AS n FROM x GROUP BY 1",
        "agg_risk_distribution": _SCORED + f"SELECT {_RISK} AS risk, count(*) AS n FROM x GROUP BY 1",
        "agg_evidence_mix": _SCORED + """SELECT CASE WHEN held THEN 'supporting' WHEN cj > 0 THEN 'corroborating'
          ELSE 'conflicting' END AS classification, count(*) AS n FROM x GROUP BY 1""",
        "agg_entity_counts": g + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM rels) AS edges",
        "page_nodes_total": g + """SELECT dedupe_key, seq, count(*) OVER () AS total, count(*) OVER () > 60 AS has_more FROM nodes
          WHERE node_type = 'Customer' ORDER BY dedupe_key, seq LIMIT 20 OFFSET 40""",
        "page_edges_total": g + """SELECT dedupe_key, count(*) OVER () AS total, count(*) OVER () > 5000 AS has_more FROM rels
          WHERE rel_type = 'PART_OF' ORDER BY dedupe_key LIMIT 5000""",
        "topk_central_bubble": g + degree + """, t AS (SELECT dedupe_key, in_degree + out_degree AS total FROM deg ORDER BY total DESC,
          dedupe_key LIMIT 10) SELECT dedupe_key, total, greatest(50 * total // greatest(max(total) OVER (), 1), 8) AS bubble FROM t""",
        "join_degrees_meta": g + degree + """SELECT deg.*, kind AS node_type FROM deg LEFT JOIN (SELECT dedupe_key AS k, max_by(node_type,
          seq) AS kind FROM nodes GROUP BY 1) ON k = dedupe_key""",
        "set_effective_edges": g + f""", e(start_type, end_type, rel_type) AS (VALUES {', '.join(map(str, [*M.SCHEMA_EDGES, M.AMENDED]))})
          SELECT e.rel_type, start_type, end_type, coalesce(n, 0) AS n FROM e LEFT JOIN (SELECT rel_type, count(*) AS n FROM rels
          GROUP BY 1) r ON r.rel_type = e.rel_type""",
        "prj_schema_rules": g + f""", e(a, b, t) AS (VALUES {', '.join(map(str, M.SCHEMA_EDGES))}) SELECT DISTINCT 'node:' || node_type AS rule,
          'name' AS subject FROM nodes UNION ALL SELECT 'edge:' || t, a || ' > ' || b FROM e""",
        "flt_activity_run": """SELECT event_id, event_type FROM events WHERE event_id % 3 < 2 AND event_type IN ('signup', 'error', 'purchase')
          ORDER BY ts DESC, event_id DESC LIMIT 100""",
        "agg_docs_by_parser": """SELECT CASE WHEN doc_id % 4 = 0 OR coalesce(trim(source), '') = '' THEN 'unknown' ELSE source END AS parser,
          count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chunks FROM documents GROUP BY 1""",
        "gr_components_typed": _PAIRS + """, w AS (SELECT grp, a AS ref FROM g UNION SELECT grp, b FROM g) SELECT ref AS dedupe_key,
          min(ref) OVER (PARTITION BY grp) AS root FROM w""",
    }
