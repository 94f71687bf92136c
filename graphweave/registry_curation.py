"""Queries of curation, governance, chunking and jobs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import scores as S
from graphweave.functions.text import jaccard, token_containment, token_overlap, tokens
from graphweave.operators import chunking as K
from graphweave.operators import curation as C
from graphweave.operators import governance as V
from graphweave.operators import graph as G
from graphweave.operators import jobs as J
from graphweave.operators import reads as R
from graphweave.plans import model as M
from graphweave.streaming.jobs import latest_status_stream

Query = Callable[[SparkSession, str], DataFrame]


def events(s: SparkSession, d: str) -> DataFrame:
    """Events as log rows, jobs and proposals."""
    at = lambda key, n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % n + 1).cast("int"))
    level = F.when(F.col("event_type") == "view", "debug").when(F.col("event_type") == "signup", "warning").when(F.col("event_type") == "error", "error").otherwise("info")
    status = F.when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("cancelled")
    return M.table(s, d, "events").withColumns({
        "level": level, "status": status, "proposal_id": F.col("event_id"),
        "state": at("user_id", 6, "pending", "approved", "executed", "rejected", "deferred", "excluded"),
        "wanted": at("event_id", 5, "approved", "rejected", "executed", "pending", "deferred"),
        "kind": at("user_id", 6, "exact_node_duplicate", "exact_rel_duplicate", "probable_duplicate", "canonical_violation", "structural_anomaly", "other"),
        "class": at("event_id", 7, "merge", "delete", "rename", "normalize", "canonicalize", "defer", "none"),
    })


def marked(s: SparkSession, d: str) -> DataFrame:
    """Nodes with a property map; some without a version, some parts without a brand."""
    p = M.table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.lit("Part").alias("node_type"), "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    full = M.nodes(s, d).join(p.hint("merge"), ["node_type", "seq"], "left")  # small as a file, large as a broadcast
    brand = F.when(F.col("seq") % 20 != 0, F.col("p_brand"))
    props = F.map_filter(F.create_map(F.lit("brand"), brand, F.lit("kind"), F.col("p_type"), F.lit("size"), F.col("p_size")), lambda _, v: v.isNotNull())
    return full.select("dedupe_key", "node_type", "seq", F.when(F.col("seq") % 50 != 0, F.col("schema_version")).otherwise(" ").alias("schema_version"), props.alias("properties"))


def enriched(s: SparkSession, d: str) -> DataFrame:
    a, b = tokens(F.col("value_a")), tokens(F.col("value_b"))
    pairs = G.sorted_window_pairs(M.nodes(s, d)).select("node_type", "key_a", "key_b", jaccard(a, b).alias("similarity"), token_overlap(a, b).alias("overlap"), token_containment(F.col("value_a"), F.col("value_b")).alias("contained"))
    props = marked(s, d).groupBy("dedupe_key").agg(F.min_by("properties", "seq").alias("properties"))
    return C.enrich(G.context_jaccard(pairs, M.rels(s, d)), props)


def probable(s: SparkSession, d: str) -> DataFrame:
    """The probable duplicates of all types, enriched."""
    props = marked(s, d).groupBy("dedupe_key").agg(F.min_by("properties", "seq").alias("properties"))
    return C.enrich(G.probable_pairs(M.labelled(s, d).unionByName(M.nodes(s, d)), M.rels(s, d)), props)


def merges(s: SparkSession, d: str) -> DataFrame:
    c = M.nodes(s, d).where("node_type = 'Customer' and seq % 10 < 2").withColumn("g", F.floor(F.col("seq") / 10))
    return c.where("seq % 10 = 1").select("g", F.col("dedupe_key").alias("obsolete"), F.col("seq").alias("nth")).join(c.where("seq % 10 = 0").select("g", F.col("dedupe_key").alias("survivor")), "g").drop("g")


def with_properties(s: SparkSession, d: str) -> DataFrame:
    """rels with a chunk and properties of their own and of the engine."""
    props = F.create_map(F.lit("note"), F.concat(F.lit("from "), "start_dedupe_key"), F.lit("_old"), F.col("dedupe_key"))
    return M.rels(s, d).withColumns({"chunk_id": F.sha2("dedupe_key", 256), "properties": props})


def targets(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "node").when(F.col("event_type") == "signup", "other").otherwise("relationship")
    number = F.floor(F.col("event_id") / 4)
    of = F.element_at(F.array(*map(F.lit, ("merge", "delete", "rename", "normalize", "canonicalize", "defer"))), (number % 6 + 1).cast("int"))
    return M.table(s, d, "events").select(number.alias("proposal_id"), of.alias("proposal_class"), (F.col("event_id") % 4).alias("pos"), kind.alias("element_type"), F.concat(F.lit("k"), (F.col("event_id") * 7 % 1000).cast("string")).alias("dedupe_key"),
        F.when(F.col("event_id") % 3 == 0, "FIXED").alias("new_type"), F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("s"), (F.col("event_id") % 50).cast("string"))).alias("start_key"), F.lit("e").alias("end_key"))


def suppliers(s: SparkSession, d: str) -> DataFrame:
    """What scoped detection looks at: all suppliers and every other part."""
    return M.nodes(s, d).where("node_type = 'Supplier' or node_type = 'Part' and seq % 2 = 0")


def queries() -> dict[str, Query]:
    n, r, t = M.nodes, M.rels, M.table
    nation = lambda s, d: n(s, d).where("node_type = 'Nation' and seq % 5 = 0")

    def scoped(s: SparkSession, d: str) -> DataFrame:
        return C.scoped_detection(n(s, d), r(s, d), M.schema_edges(s), suppliers(s, d))

    def suppressed(s: SparkSession, d: str) -> DataFrame:
        return C.suppress_orphans(C.structural(marked(s, d), r(s, d), {"Part": "brand"}), G.exact_node_duplicates(n(s, d)))

    def sufficient(s: SparkSession, d: str) -> DataFrame:
        e = enriched(s, d)
        i = F.length("key_a").cast("int")
        return e.select("node_type", "key_a", "key_b", F.round(S.sufficiency(F.col("overlap"), F.col("similarity"), F.col("context"), i % 2, i % 3, F.lit(0)), 4).alias("sufficiency"))

    def detached(s: SparkSession, d: str) -> DataFrame:
        left, edges = V.delete_nodes(n(s, d), r(s, d), nation(s, d))
        return left.select("dedupe_key", F.lit("node").alias("what")).unionByName(edges.select("dedupe_key", F.lit("rel").alias("what")))

    def unbroken(s: SparkSession, d: str) -> DataFrame:
        left, edges = V.delete_nodes(n(s, d), r(s, d), nation(s, d))
        return V.invariants(left, edges, n(s, d).where("node_type = 'Region'"), nation(s, d)).unionByName(V.invariants(left, r(s, d), nation(s, d), nation(s, d)).withColumn("name", F.concat(F.lit("before: "), "name")))

    def updated(s: SparkSession, d: str) -> DataFrame:
        m = marked(s, d)
        one = m.groupBy("dedupe_key").agg(F.min("seq").alias("seq")).where("seq % 3 = 0")
        put = one.select("dedupe_key", F.create_map(F.lit("kind"), F.lit("NEW"), F.lit("checked"), F.lit("yes")).alias("put"), F.array(F.lit("size")).alias("cut"))
        p = lambda k: F.element_at("properties", k).alias(k)
        return V.update_nodes(m, put).select("dedupe_key", "seq", p("kind"), p("checked"), p("size"), p("brand"))

    def audit(s: SparkSession, d: str) -> DataFrame:
        e = events(s, d)
        new, clash = V.append_once(e.where("user_id % 2 = 0").select("user_id"), e.select("event_id", "user_id"), "user_id")
        return new.select("event_id", F.lit("appended").alias("outcome")).unionByName(clash.select("event_id", F.lit("conflict").alias("outcome")))

    def archived(s: SparkSession, d: str) -> DataFrame:
        kept, gone, manifest = V.archive(events(s, d).withColumn("run_id", F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string"))))
        rows = kept.select("proposal_id", F.lit("kept").alias("place")).unionByName(gone.select("proposal_id", F.lit("archived").alias("place")))
        return rows.unionByName(manifest.select(F.col("archived").alias("proposal_id"), F.concat_ws(" ", F.lit("manifest"), "run_id", "first_id", "last_id").alias("place")))

    def confirmed(s: SparkSession, d: str) -> DataFrame:
        e = events(s, d)
        token = e.where("event_id % 3 > 0").select(F.col("event_id").alias("token"), (F.col("event_id") - F.col("event_id") % 4).alias("proposal_id"), F.col("ts").alias("issued_at"))
        asked = e.select(F.col("event_id").alias("token"), (F.col("event_id") - F.col("event_id") % 2 * 1).alias("proposal_id"), F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(user_id % 90 as int))").alias("at"))
        return V.confirm(asked, token)

    def proposed(s: SparkSession, d: str) -> DataFrame:
        p = t(s, d, "part").select(F.regexp_replace("p_brand", "#", F.when(F.col("p_size") % 2 == 0, F.lit("_")).otherwise("")).alias("type"), F.when(F.col("p_size") < 40, "Asset").otherwise(F.col("p_type")).alias("node_class"), F.regexp_replace("p_name", " ", F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise("_")).alias("primary_property"))
        e = t(s, d, "nation").select(F.col("n_name").alias("type"), F.concat(F.lit("Brand"), F.col("n_nationkey").cast("string")).alias("start_node_type"), F.lit("Brand_1").alias("end_node_type"))
        locks = t(s, d, "nation").where("n_nationkey < 0").select(F.col("n_name").alias("version_hash"))
        return V.schema_issues(p, e, locks)

    def reused(s: SparkSession, d: str) -> DataFrame:
        x = t(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), (F.col("doc_id") % 4).alias("parser_hash"))
        old = x.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), (F.col("doc_id") % 2).alias("parser_hash"))
        return J.stale(old, x)

    def chunked(s: SparkSession, d: str) -> DataFrame:
        c = K.chunks(K.line_elements(t(s, d, "documents")))  # as these texts have no blank lines
        return c.select("doc_id", "chunk_index", "elements", "chars", F.sha2("text", 256).alias("text_sha256"), F.array_contains("flags", "low_text_density").alias("thin"))

    totals = lambda s, d: G.degree(n(s, d), r(s, d)).select("dedupe_key", (F.col("in_degree") + F.col("out_degree")).alias("total"))
    return {
        "gr_structural": lambda s, d: C.structural(marked(s, d), r(s, d), {"Part": "brand"}),
        "set_suppress_orphans": suppressed,
        "flt_touches_focus": lambda s, d: C.touching(r(s, d), suppliers(s, d)).select("dedupe_key", "rel_type"),
        "gr_scoped_detection": scoped,
        "gr_scoped_candidates": lambda s, d: C.scoped_candidates(n(s, d), r(s, d), M.schema_edges(s), suppliers(s, d), marked(s, d), {"Part": "brand"}),
        "gr_components": lambda s, d: C.components(r(s, d).select(F.col("start_dedupe_key").alias("key_a"), F.col("end_dedupe_key").alias("key_b"))),
        "gr_enrich": lambda s, d: enriched(s, d).select("node_type", "key_a", "key_b", "property_overlap", F.array_join("conflicts", ",").alias("conflicts"), "composite", "band"),
        "gr_cluster_validate": lambda s, d: C.validate_clusters(probable(s, d)).select("key_a", "key_b", "cluster", "keys", "suspect", "band"),
        "gr_neighbourhood_annotate": lambda s, d: C.other_partners(G.sorted_window_pairs(n(s, d))),
        "fn_sufficiency": sufficient,
        "fn_risk": lambda s, d: events(s, d).withColumn("risk", S.risk(F.col("kind"), F.when(F.col("class") != "none", F.col("class")))).select("event_id", "risk", S.budget(F.col("value") * 100, F.col("risk")).alias("budget")),
        "gov_transition": lambda s, d: V.move(events(s, d).select((F.col("event_id") + F.when(F.col("event_id") % 10 == 0, 10**9).otherwise(0)).alias("proposal_id"), "wanted"), events(s, d)),
        "gov_approve": lambda s, d: V.approve(events(s, d).withColumns({"proposal_class": F.col("class"), "override": F.col("event_id") % 9 == 0})),
        "gov_confirm": confirmed,
        "gr_diff_build": lambda s, d: V.plan_steps(targets(s, d)).withColumn("merge_keys", F.array_join("merge_keys", ",")),
        "dml_delete_node": detached,
        "dml_delete_edge": lambda s, d: V.delete_edges(r(s, d), r(s, d).where("rel_type = 'PART_OF'")).select("dedupe_key"),
        "dml_update_node": updated,
        "dml_merge_nodes_collapse": lambda s, d: V.collapse(with_properties(s, d), merges(s, d))[0].select("rel_type", "start_dedupe_key", "end_dedupe_key", "moved", "run_id", "chunk_id", F.element_at("properties", "note").alias("note"), F.element_at("properties", "_old").alias("old"), "dedupe_key"),
        "dml_merge_affected_keys": lambda s, d: V.collapse(with_properties(s, d), merges(s, d))[1],
        "gr_invariants": unbroken,
        "dml_append_audit": audit,
        "dml_proposal_archive": archived,
        "dml_cancel_jobs": lambda s, d: J.cancel(events(s, d)).groupBy("status").agg(F.count("*").alias("n")),
        "val_schema_proposal": proposed,
        "gr_manifest_reuse": reused,
        "fn_chunk_document": chunked,
        "limit_logs": lambda s, d: J.logs(events(s, d), "warning").select("event_id", "level"),
        "flt_activity": lambda s, d: J.activity(events(s, d), ["purchase"]).select("event_id", "event_type"),
        "agg_extraction_status": lambda s, d: J.status_counts(events(s, d), "user_id"),
        "agg_counters": lambda s, d: J.counters(events(s, d).select(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("label"), "value", "ts", "event_id")),
        "page_edges": lambda s, d: R.page(r(s, d).select("dedupe_key", "rel_type"), ["dedupe_key"], 3, 50).select("dedupe_key", "rel_type"),
        "sort_degrees": lambda s, d: totals(s, d).orderBy(F.desc("total"), "dedupe_key"),
        "topk_central": lambda s, d: totals(s, d).orderBy(F.desc("total"), "dedupe_key").limit(10),
        "st_stream_status": lambda s, d: latest_status_stream(s, d, "events.parquet"),
    }


_AT = lambda key, *names: "CASE " + key + " % " + str(len(names)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"
_EV = f"""WITH ev AS (SELECT *, event_id AS proposal_id, CASE event_type WHEN 'view' THEN 'debug' WHEN 'signup' THEN 'warning'
  WHEN 'error' THEN 'error' ELSE 'info' END AS level,
  CASE event_type WHEN 'view' THEN 'complete' WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running'
    ELSE 'cancelled' END AS status,
  {_AT('user_id', 'pending', 'approved', 'executed', 'rejected', 'deferred', 'excluded')} AS state,
    {_AT('event_id', 'approved', 'rejected', 'executed', 'pending', 'deferred')} AS wanted,
  {_AT('user_id', 'medium', 'medium', 'high', 'medium', 'low', 'medium')} AS r1,
    {_AT('event_id', 'high', 'high', 'medium', 'medium', 'low', 'low', 'low')} AS r2 FROM events),
  risky AS (SELECT *, CASE WHEN 'high' IN (r1, r2) THEN 'high' WHEN 'medium' IN (r1, r2) THEN 'medium' ELSE 'low' END AS risk FROM ev) """
_MARK = """, mark AS (SELECT nodes.dedupe_key, nodes.node_type, nodes.seq, CASE WHEN nodes.seq % 50 = 0 THEN ' '
  ELSE nodes.schema_version END AS schema_version, CASE WHEN p_partkey % 20 <> 0 THEN p_brand END AS brand, p_type AS kind,
  CAST(p_size AS VARCHAR) AS size
  FROM nodes LEFT JOIN part ON node_type = 'Part' AND seq = p_partkey),
  structural AS (SELECT DISTINCT dedupe_key, 'orphan_node' AS method, 'medium' AS severity FROM mark WHERE dedupe_key NOT IN (SELECT start_dedupe_key
    FROM rels UNION SELECT end_dedupe_key FROM rels)
    UNION ALL SELECT dedupe_key, 'missing_provenance_node', 'critical' FROM mark WHERE trim(schema_version) = ''
    UNION ALL SELECT dedupe_key, 'qualifier_missing', 'medium' FROM mark WHERE node_type = 'Part' AND brand IS NULL) """
_FOCUS = """, focus AS (SELECT DISTINCT dedupe_key FROM nodes WHERE node_type = 'Supplier' OR node_type = 'Part' AND seq % 2 = 0), near AS (SELECT *
  FROM rels WHERE start_dedupe_key IN (SELECT dedupe_key FROM focus) OR end_dedupe_key IN (SELECT dedupe_key FROM focus)) """
_ENRICH_PARTS = """, one AS (SELECT dedupe_key, arg_min(struct_pack(b := brand, k := kind, s := size), seq) AS p FROM mark GROUP BY 1),
  links AS (SELECT start_dedupe_key AS k, end_dedupe_key AS o FROM rels UNION SELECT end_dedupe_key, start_dedupe_key FROM rels), near AS (SELECT k,
    list(o) AS os FROM links GROUP BY 1),
  split AS (SELECT pairs.*, list_distinct(regexp_extract_all(value_a, '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(value_b, '[a-z0-9]+')) AS y
    FROM pairs),
  met AS (SELECT split.*, len(list_intersect(x, y)) AS i, len(list_intersect(coalesce(n.os, []), coalesce(m.os, []))) AS ci, len(coalesce(n.os,
    [])) + len(coalesce(m.os, [])) AS cn, a.p AS pa, b.p AS pb
    FROM split LEFT JOIN near n ON n.k = key_a LEFT JOIN near m ON m.k = key_b LEFT JOIN one a ON a.dedupe_key = key_a LEFT
      JOIN one b ON b.dedupe_key = key_b),
  scored AS (SELECT node_type, key_a, key_b, CASE WHEN len(x) + len(y) = 0 THEN 0::DOUBLE ELSE i::DOUBLE / (len(x) + len(y) - i) END AS similarity,
    CASE WHEN len(x) + len(y) = 0 THEN 0::DOUBLE ELSE 2::DOUBLE * i / (len(x) + len(y)) END AS overlap,
    {contained} AS contained, CASE WHEN cn = 0 THEN 0::DOUBLE ELSE round(ci::DOUBLE / (cn - ci), 6) END AS context,
    coalesce((pa.b = pb.b)::INT, 0) + coalesce((pa.k = pb.k)::INT, 0) + coalesce((pa.s = pb.s)::INT, 0) AS same, (coalesce(pa.b,
      pb.b) IS NOT NULL)::INT + (coalesce(pa.k, pb.k) IS NOT NULL)::INT + (coalesce(pa.s, pb.s) IS NOT NULL)::INT AS names,
    concat_ws(',', CASE WHEN pa.b <> pb.b THEN 'brand' END, CASE WHEN pa.k <> pb.k THEN 'kind' END, CASE
      WHEN pa.s <> pb.s THEN 'size' END) AS conflicts FROM met),
  props AS (SELECT *, CASE WHEN names = 0 THEN 0::DOUBLE ELSE round(same::DOUBLE / names, 6) END AS property_overlap FROM scored),
  enriched AS (SELECT *, round(CASE WHEN contained THEN 0.7::DOUBLE + least(context * 0.15::DOUBLE + property_overlap * 0.1::DOUBLE, 0.25::DOUBLE)
    WHEN context = 0 THEN 0.65::DOUBLE * similarity + 0.25::DOUBLE * overlap + 0.1::DOUBLE * property_overlap
    ELSE 0.5::DOUBLE * similarity + 0.25::DOUBLE * overlap + 0.15::DOUBLE * context + 0.1::DOUBLE * property_overlap END, 4) AS composite FROM props) """


def enrich_sql() -> str:
    from graphweave import registry as R

    contained = R.contained_sql("value_a", "value_b", R.content_sql("value_a"), R.content_sql("value_b"))
    return _MARK + R.WINDOW + _ENRICH_PARTS.replace("{contained}", contained)


_TARGETS = f"""WITH t AS (SELECT event_id // 4 AS proposal_id,
  {_AT('(event_id // 4)', 'merge', 'delete', 'rename', 'normalize', 'canonicalize', 'defer')} AS class, event_id % 4 AS pos,
    CASE WHEN event_type IN ('view', 'click') THEN 'node' ELSE 'relationship' END AS kind, 'k' || (event_id * 7 % 1000) AS dedupe_key,
      event_id % 3 = 0 AS retype,
    CASE WHEN event_id % 5 > 0 THEN 's' || (event_id % 50) END AS start_key FROM events WHERE event_type <> 'signup'),
  c AS (SELECT *, count(*) FILTER (kind = 'node') OVER p AS n, row_number() OVER (PARTITION BY proposal_id, kind ORDER BY pos) AS nth,
    bool_or(kind = 'relationship' AND retype) OVER p AND class = 'normalize' AS again, string_agg(CASE WHEN kind = 'node' THEN dedupe_key END,
      ',') OVER (p ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nodes
    FROM t WINDOW p AS (PARTITION BY proposal_id)),
  s AS (SELECT proposal_id, CASE WHEN kind = 'node' THEN 'update_node' ELSE 'update_edge' END AS operation, dedupe_key, 0 AS a, dedupe_key AS b,
    NULL AS merge_keys, NULL AS rel_type, NULL AS start_key, NULL AS end_key
      FROM c WHERE class IN ('rename', 'normalize', 'canonicalize') AND NOT again
    UNION ALL SELECT proposal_id, 'delete_edge', dedupe_key, pos * 2, '', NULL, NULL, NULL, NULL FROM c WHERE again AND kind = 'relationship'
      AND retype AND start_key IS NOT NULL
    UNION ALL SELECT proposal_id, 'create_edge', 'FIXED::' || start_key || '::e::v1', pos * 2 + 1, '', NULL, 'FIXED', start_key, 'e' FROM c
      WHERE again AND kind = 'relationship' AND retype AND start_key IS NOT NULL
    UNION ALL SELECT proposal_id, 'merge_nodes', dedupe_key, 0, '', nodes, NULL, NULL, NULL FROM c WHERE class = 'merge' AND n >= 2 AND kind = 'node'
      AND nth = 1
    UNION ALL SELECT proposal_id, 'delete_edge', dedupe_key, pos, '', NULL, NULL, NULL, NULL FROM c WHERE class = 'merge' AND n = 0 AND nth > 1
    UNION ALL SELECT proposal_id, CASE WHEN kind = 'node' THEN 'delete_node' ELSE 'delete_edge' END, dedupe_key, (kind = 'node')::INT, dedupe_key,
      NULL, NULL, NULL, NULL FROM c WHERE class = 'delete') """
_GONE = """, gone AS (SELECT dedupe_key AS k FROM nodes WHERE node_type = 'Nation' AND seq % 5 = 0), edges_left AS (SELECT * FROM rels
  WHERE start_dedupe_key NOT IN (SELECT k FROM gone) AND end_dedupe_key NOT IN (SELECT k FROM gone)) """
_MOVED = """, m AS (SELECT a.dedupe_key AS o, b.dedupe_key AS s, a.seq AS nth FROM nodes a JOIN nodes b ON a.node_type = 'Customer'
  AND b.node_type = 'Customer' AND a.seq % 10 = 1 AND b.seq = a.seq - 1),
  x AS (SELECT rel_type, dedupe_key AS k, start_dedupe_key, end_dedupe_key, coalesce(p.s, start_dedupe_key) AS a, coalesce(q.s, end_dedupe_key) AS b,
    p.o IS NOT NULL OR q.o IS NOT NULL AS moved,
    p.o IS NOT NULL AND q.o IS NOT NULL AS both_gone, coalesce(least(p.nth, q.nth), -1) AS nth FROM rels LEFT JOIN m p ON p.o = start_dedupe_key LEFT
      JOIN m q ON q.o = end_dedupe_key) """
_CHUNKS = """WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),
  1) AS pos FROM documents),
  els AS (SELECT doc_id, trim(line) AS text, regexp_matches(trim(line), '^#{1,6} +[^ ]') AS heading, row_number() OVER (PARTITION BY doc_id
    ORDER BY pos) AS k FROM lines WHERE trim(line) <> ''),
  step AS (SELECT doc_id, k, 0 AS chunk_index, length(text) AS chars FROM els WHERE k = 1
    UNION ALL SELECT e.doc_id, e.k, s.chunk_index + (e.heading OR s.chars + 2 + length(e.text) > 1000)::INT, CASE WHEN e.heading
      OR s.chars + 2 + length(e.text) > 1000 THEN length(e.text) ELSE s.chars + 2 + length(e.text) END
      FROM step s JOIN els e ON e.doc_id = s.doc_id AND e.k = s.k + 1)
  SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, count(*) AS elements, CAST(max(step.chars) AS BIGINT) AS chars, sha256(string_agg(text,
    chr(10) || chr(10) ORDER BY k)) AS text_sha256, max(step.chars) < 20 AS thin FROM step JOIN els USING (doc_id, k) GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    from graphweave.registry import WINDOW

    g, _ENRICH = M.SQL, enrich_sql()
    degree = """SELECT k AS dedupe_key, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM (SELECT DISTINCT dedupe_key AS k FROM nodes) LEFT
      JOIN (SELECT start_dedupe_key AS k, 1 AS n FROM (SELECT DISTINCT dedupe_key, start_dedupe_key FROM rels) UNION ALL SELECT end_dedupe_key, 1
      FROM (SELECT DISTINCT dedupe_key, end_dedupe_key FROM rels)) USING (k) GROUP BY 1"""
    moves = " OR ".join(f"(e.state = '{a}' AND q.wanted = '{b}')" for a, b in V.TRANSITIONS)
    return {
        "gr_structural": g + _MARK + "SELECT * FROM structural",
        "set_suppress_orphans": g + _MARK + """SELECT * FROM structural WHERE method <> 'orphan_node' OR dedupe_key NOT IN (SELECT dedupe_key
          FROM nodes GROUP BY 1 HAVING count(*) >= 2)""",
        "flt_touches_focus": g + _FOCUS + "SELECT dedupe_key, rel_type FROM near",
        "gr_scoped_detection": g + _FOCUS + """, dup AS (SELECT dedupe_key FROM nodes WHERE dedupe_key IN (SELECT dedupe_key FROM focus) GROUP BY 1
          HAVING count(*) >= 2)
          SELECT dedupe_key, 'exact_node_dedupe_key' AS method FROM dup UNION SELECT dedupe_key, 'orphan_node' FROM focus
            WHERE dedupe_key NOT IN (SELECT start_dedupe_key FROM rels UNION SELECT end_dedupe_key FROM rels) AND dedupe_key NOT IN (SELECT dedupe_key
            FROM dup)
          UNION SELECT dedupe_key, 'exact_rel_dedupe_key' FROM near GROUP BY 1 HAVING count(*) >= 2 UNION SELECT dedupe_key, 'canonical_violation'
            FROM near WHERE start_dedupe_key LIKE 'Nation|%' AND rel_type = 'LOCATED_IN'""",
        "gr_components": g.replace("WITH nodes", "WITH RECURSIVE nodes") + """, links AS (SELECT start_dedupe_key AS a, end_dedupe_key AS b FROM rels
          UNION SELECT end_dedupe_key, start_dedupe_key FROM rels), reach AS (SELECT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach
          JOIN links ON links.a = reach.b) SELECT a AS dedupe_key, min(b) AS root FROM reach GROUP BY 1""",
        "gr_enrich": g + _ENRICH + """SELECT node_type, key_a, key_b, property_overlap, conflicts, composite, CASE WHEN composite >= 0.8
          AND conflicts = '' THEN 'high' WHEN composite >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM enriched""",
        "gr_neighbourhood_annotate": g + WINDOW + """, sides AS (SELECT key_a, key_b, key_a AS dedupe_key, key_b AS partner, value_b AS value
          FROM pairs UNION SELECT key_a, key_b, key_b, key_a, value_a FROM pairs),
          others AS (SELECT s.key_a, s.key_b, s.dedupe_key, list_sort(list_distinct(list(o.value) FILTER (o.partner <> s.partner))) AS vs FROM sides s
            JOIN sides o USING (dedupe_key) GROUP BY 1, 2, 3)
          SELECT key_a, key_b, dedupe_key, len(coalesce(vs, [])) AS others, array_to_string(list_slice(coalesce(vs, []), 1, 10), ',') AS first_others
            FROM others""",
        "fn_sufficiency": g + _ENRICH + """SELECT node_type, key_a, key_b, round(least(1::DOUBLE, CASE WHEN overlap >= 0.95 THEN 0.5::DOUBLE
          WHEN overlap >= 0.9 THEN 0.4::DOUBLE WHEN overlap >= 0.85 THEN 0.3::DOUBLE ELSE 0::DOUBLE END + least(context, 0.2::DOUBLE)
          + CASE WHEN similarity >= 0.5 THEN 0.05::DOUBLE
            ELSE 0::DOUBLE END + 0.3::DOUBLE * (length(key_a) % 2) + 0.15::DOUBLE * (length(key_a) % 3)), 4) AS sufficiency FROM enriched""",
        "fn_risk": _EV + """SELECT event_id, risk, CAST(trunc(value * 100 * CASE risk WHEN 'low' THEN 0.5::DOUBLE WHEN 'high' THEN 1.5::DOUBLE
          ELSE 1::DOUBLE END) AS BIGINT) AS budget FROM risky""",
        "gov_transition": _EV + f"""SELECT q.id AS proposal_id, e.state, q.wanted, CASE WHEN e.state IS NULL THEN 'unknown' WHEN {moves} THEN 'moved'
          ELSE 'illegal' END AS outcome FROM (SELECT event_id + CASE WHEN event_id % 10 = 0 THEN 1000000000 ELSE 0 END AS id, wanted FROM ev) q LEFT
          JOIN ev e ON e.event_id = q.id""",
        "gov_approve": _EV + f"""SELECT proposal_id, state, {_AT('event_id', 'merge', 'delete', 'rename', 'normalize', 'canonicalize', 'defer', 'none')} AS proposal_class,
          CASE WHEN state = 'approved' THEN 'none' WHEN state <> 'pending' THEN 'conflict' WHEN event_id % 7 < 2 OR event_id % 9 = 0 THEN 'token'
            ELSE 'approve' END AS outcome FROM ev""",
        "gov_confirm": _EV + """SELECT event_id AS token, event_id - event_id % 2 AS proposal_id, CASE WHEN event_id % 3 = 0 THEN 'unknown'
          WHEN event_id % 4 > 1 THEN 'mismatch' WHEN user_id % 90 >= 60 THEN 'expired' ELSE 'confirmed' END AS outcome FROM ev""",
        "gr_diff_build": _TARGETS + """SELECT proposal_id, row_number() OVER (PARTITION BY proposal_id ORDER BY a, b) - 1 AS step, operation,
          dedupe_key, merge_keys, rel_type, start_key, end_key FROM s""",
        "dml_delete_node": g + _GONE + """SELECT dedupe_key, 'node' AS what FROM nodes WHERE dedupe_key NOT IN (SELECT k FROM gone) UNION ALL
          SELECT dedupe_key, 'rel' FROM edges_left""",
        "dml_delete_edge": g + "SELECT dedupe_key FROM rels WHERE rel_type <> 'PART_OF'",
        "dml_update_node": g + _MARK + """, hit AS (SELECT dedupe_key AS k FROM mark GROUP BY 1 HAVING min(seq) % 3 = 0) SELECT dedupe_key, seq, CASE
          WHEN k IS NULL THEN kind ELSE 'NEW' END AS kind, CASE WHEN k IS NOT NULL THEN 'yes' END AS checked, CASE
          WHEN k IS NULL THEN size END AS size, brand FROM mark LEFT JOIN hit ON k = dedupe_key""",
        "dml_merge_nodes_collapse": g + _MOVED + """SELECT rel_type, a AS start_dedupe_key, b AS end_dedupe_key, bool_and(moved) AS moved,
          'run1' AS run_id, arg_min(sha256(k), (nth, k)) AS chunk_id,
          arg_min('from ' || start_dedupe_key, (nth, k)) AS note, CASE WHEN NOT bool_and(moved) THEN arg_min(k, (nth, k)) END AS old,
          CASE WHEN bool_and(moved) THEN rel_type || '::' || a || '::' || b || '::v1' ELSE arg_min(k, (nth, k)) END AS dedupe_key FROM x
            WHERE NOT moved OR (a <> b AND NOT both_gone) GROUP BY 1, 2, 3""",
        "dml_merge_affected_keys": g + _MOVED + """SELECT start_dedupe_key AS dedupe_key FROM x WHERE moved UNION SELECT end_dedupe_key FROM x
          WHERE moved UNION SELECT o FROM m UNION SELECT s FROM m""",
        "gr_invariants": g + _GONE + """SELECT 'missing' AS name, 0::BIGINT AS broken UNION ALL SELECT 'left over', 0 UNION ALL SELECT 'dangling end',
          0 UNION ALL SELECT 'before: missing', count(*) FROM gone UNION ALL SELECT 'before: left over', 0
          UNION ALL SELECT 'before: dangling end', count(*) FROM (SELECT start_dedupe_key AS k FROM rels UNION SELECT end_dedupe_key FROM rels)
            WHERE k IN (SELECT k FROM gone)""",
        "dml_append_audit": "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'conflict' ELSE 'appended' END AS outcome FROM events",
        "dml_proposal_archive": _EV + """SELECT proposal_id, CASE WHEN state = 'executed' THEN 'kept' ELSE 'archived' END AS place FROM ev
          UNION ALL SELECT count(*), 'manifest run' || (event_id % 3) || ' ' || min(event_id) || ' ' || max(event_id) FROM ev
            WHERE state <> 'executed' GROUP BY event_id % 3""",
        "dml_cancel_jobs": _EV + "SELECT CASE WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM ev GROUP BY 1",
        "val_schema_proposal": """WITH t AS (SELECT replace(p_brand, '#', CASE WHEN p_size % 2 = 0 THEN '_' ELSE '' END) AS type, CASE
          WHEN p_size < 40 THEN 'Asset' ELSE p_type END AS class,
            replace(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN ' ' ELSE '_' END) AS prop FROM part),
          e AS (SELECT n_name AS type, 'Brand' || n_nationkey AS a, 'Brand_1' AS b FROM nation), ends AS (SELECT a AS type FROM e UNION SELECT b
            FROM e)
          SELECT 'node_count' AS rule, CAST(count(*) AS VARCHAR) AS subject FROM t HAVING count(*) NOT BETWEEN 1 AND 50 UNION ALL SELECT 'edge_count',
            CAST(count(*) AS VARCHAR) FROM e HAVING count(*) NOT BETWEEN 1 AND 100
          UNION ALL SELECT 'duplicate_type', type FROM (SELECT type, unnest(range(1, count(*))) FROM t GROUP BY type)
          UNION ALL SELECT 'node_class', type FROM t WHERE class NOT IN ('Entity', 'Event', 'Concept', 'Document', 'Location', 'Asset', 'Metric',
            'Role')
          UNION ALL SELECT 'pascal_case', type FROM t WHERE NOT regexp_matches(type, '^[A-Z][^_]*$') UNION ALL SELECT 'screaming_snake_case', type
            FROM e WHERE NOT regexp_matches(type, '^[A-Z_]*[A-Z][A-Z_]*$')
          UNION ALL SELECT 'undefined_start_node_type', a FROM e WHERE a NOT IN (SELECT type FROM t) UNION ALL SELECT 'undefined_end_node_type', b
            FROM e WHERE b NOT IN (SELECT type FROM t)
          UNION ALL SELECT DISTINCT 'orphan_type', type FROM t WHERE type NOT IN (SELECT type FROM ends) UNION ALL SELECT 'snake_case', type FROM t
            WHERE lower(prop) <> prop OR contains(prop, ' ')""",
        "gr_manifest_reuse": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'content_changed'
          WHEN doc_id % 4 <> doc_id % 2 THEN 'parser_changed' ELSE 'reuse' END AS outcome FROM documents""",
        "fn_chunk_document": _CHUNKS,
        "limit_logs": _EV + "SELECT event_id, level FROM ev WHERE level IN ('warning', 'error') ORDER BY ts DESC, event_id DESC LIMIT 1000",
        "flt_activity": _EV + """SELECT event_id, event_type FROM ev WHERE level IN ('warning', 'error') OR event_type = 'purchase' ORDER BY ts DESC,
          event_id DESC LIMIT 100""",
        "agg_extraction_status": _EV + """SELECT user_id, count(*) AS total, count(*) FILTER (status = 'complete') AS complete,
          count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status IN ('queued',
          'running')) AS pending FROM ev GROUP BY 1""",
        "agg_counters": "SELECT event_type AS name, user_id % 3 AS label, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1, 2",
        "page_edges": g + "SELECT dedupe_key, rel_type FROM rels ORDER BY dedupe_key LIMIT 50 OFFSET 100",
        "sort_degrees": g + degree,
        "topk_central": g + degree + " ORDER BY total DESC, dedupe_key LIMIT 10",
        "st_stream_status": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1, 2",
    }
