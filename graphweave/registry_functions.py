"""Queries of single functions, filters, joins and windows, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import scores as S
from graphweave.functions import text as X
from graphweave.operators import chunking as K
from graphweave.operators import curation as C
from graphweave.operators import documents as D
from graphweave.operators import graph as G
from graphweave.operators import jobs as J
from graphweave.operators import machine
from graphweave.operators import reads as R
from graphweave.operators import write as W
from graphweave.plans import model as M
from graphweave.registry_curation import events, marked, suppliers, with_properties
from graphweave.registry_documents import chunks, jobs
from graphweave.registry_findings import pairs
from graphweave.registry_governed import incoming_rels, snapshot_rels, without_regions

Query = Callable[[SparkSession, str], DataFrame]


def names(s: SparkSession, d: str) -> DataFrame:
    """Each part's name beside the name and type of the part after it."""
    p = M.table(s, d, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", F.lit("The"), "p_name", F.lower("p_type")).alias("b"))
    return p.select("p_partkey", F.col("p_name").alias("a")).join(after, "p_partkey")


def sides(s: SparkSession, d: str) -> DataFrame:
    """Parts that are sixty-four numbers apart, whose names are alike, with their properties."""
    m = marked(s, d).where("node_type = 'Part'").select("seq", "properties")
    other = m.select((F.col("seq") - 64).alias("seq"), F.col("properties").alias("other"))
    return m.join(other, "seq")


def numbers(s: SparkSession, d: str) -> DataFrame:
    """Scores of all sizes."""
    k = F.col("p_partkey")
    return M.table(s, d, "part").select(k.alias("k"), (k % 101 / 100).alias("sim"), (k % 11 / 10).alias("lap"), (k % 5 / 10).alias("ctx"), (k % 7 == 0).alias("held"), (k % 4 / 4).alias("props"),
                                        F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("conflicts"))


def queries() -> dict[str, Query]:
    n, r, t = M.nodes, M.rels, M.table
    on_names = lambda f: lambda s, d: names(s, d).select("p_partkey", f(F.col("a"), F.col("b")).alias("score"))

    def created(s: SparkSession, d: str) -> DataFrame:
        """Nodes are created once per key; a request without a label fails."""
        asked = t(s, d, "part").select(F.col("p_partkey").alias("seq"), M.node_key("Made", F.col("p_name")).alias("dedupe_key"), F.when(F.col("p_partkey") % 50 == 0, "").otherwise("Made").alias("node_type"))
        have = asked.where("seq % 9 = 0").select("dedupe_key").distinct()
        return W.create_nodes(asked, have)

    def schema_of(s: SparkSession, d: str) -> DataFrame:
        wrong = G.canonical_violations(M.more_rels(s, d), n(s, d), M.schema_edges(s)).select("dedupe_key", "violation").distinct()
        rows = M.more_rels(s, d).select("dedupe_key").distinct()
        return rows.join(wrong, "dedupe_key", "left").select("dedupe_key", F.coalesce("violation", F.lit("allowed")).alias("found"))

    def valued(s: SparkSession, d: str) -> DataFrame:
        """Both nodes of each pair with what is known of them."""
        one = marked(s, d).groupBy("dedupe_key").agg(F.min_by("properties", "seq").alias("p"), F.min("seq").alias("seq"))
        side = lambda x: one.select(F.col("dedupe_key").alias(f"key_{x}"), F.col("seq").alias(f"seq_{x}"), F.element_at("p", "brand").alias(f"brand_{x}"), F.element_at("p", "size").alias(f"size_{x}"))
        return G.sorted_window_pairs(n(s, d)).select("key_a", "key_b").join(side("a"), "key_a", "left").join(side("b"), "key_b", "left")

    def actions(s: SparkSession, d: str) -> DataFrame:
        _, acts = W.merge_edges(snapshot_rels(s, d), incoming_rels(s, d), without_regions(s, d))
        return acts.agg(*[F.sum(c).cast("long").alias(c) for c in ("created", "matched", "skipped")])

    def ended(s: SparkSession, d: str) -> DataFrame:
        _, acts = W.merge_edges(snapshot_rels(s, d), incoming_rels(s, d), without_regions(s, d))
        return acts.select("rel_type", "start_dedupe_key", "end_dedupe_key", (F.col("skipped") == 0).alias("held"))

    def folded(s: SparkSession, d: str) -> DataFrame:
        return K.chunks(K.line_elements(t(s, d, "documents"))).select("doc_id", "chunk_index", "elements", "chars")

    def flushed(s: SparkSession, d: str) -> DataFrame:
        rows = K.line_elements(t(s, d, "documents")).withColumns({"raw": F.col("doc_id") % 3 == 0, "page": F.when(F.col("doc_id") % 7 > 0, F.lit(2))})
        return K.chunks(rows, 1, 250).select("doc_id", "chunk_index", F.array_join("flags", ",").alias("flags"), F.coalesce("start_page", F.lit(-1)).alias("start_page"), "error")

    def results(s: SparkSession, d: str) -> DataFrame:
        """Version and totals of a run, zeros where it has none."""
        runs = s.createDataFrame([("run1",), ("run9",)], "run_id string")
        have = n(s, d).groupBy("run_id").agg(F.count("*").alias("nodes"), F.max("schema_version").alias("version"))
        edges = r(s, d).groupBy("run_id").agg(F.count("*").alias("edges"), F.count_distinct("rel_type").alias("edge_types"))
        rows = runs.join(have, "run_id", "left").join(edges, "run_id", "left").fillna(0, ["nodes", "edges", "edge_types"])
        return rows.select("run_id", "nodes", "edges", "edge_types", "version")

    def vectored(s: SparkSession, d: str) -> DataFrame:
        v = t(s, d, "embeddings")
        return v.crossJoin(F.broadcast(v.where("vec_id = 7").select(F.col("embedding").alias("q")))).select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("q")), 5).alias("score"))

    def united(s: SparkSession, d: str) -> DataFrame:
        """Three detectors and candidates of old, with columns that only some have."""
        rows = pairs(s, d).select("candidate_id", "seq").withColumn("candidate_type", F.lit("old"))
        for found in (G.exact_node_duplicates(n(s, d)), G.exact_rel_duplicates(r(s, d)), G.canonical_violations(r(s, d), n(s, d), M.schema_edges(s)).withColumn("candidate_type", F.lit("canonical_violation"))):
            rows = rows.unionByName(found.select("candidate_id", "candidate_type", "severity").distinct(), allowMissingColumns=True)
        return rows.fillna(-1, ["seq"])

    def generated(s: SparkSession, d: str) -> DataFrame:
        """Calls of three runs: one that may go on, one in cooldown, one without a locked schema; findings of the first alone."""
        at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k") * 10)
        calls = s.range(3).select(F.col("id").alias("k"), F.concat(F.lit("run"), (F.col("id") + 1).cast("string")).alias("run_id")).select(F.col("k").alias("call_id"), "run_id", at.alias("at"))
        ran = s.createDataFrame([("run1", 1_699_999_000), ("run2", 1_700_000_000)], "run_id string, t long").select("run_id", F.timestamp_seconds("t").alias("at"))
        locks = s.createDataFrame([("run1",), ("run2",)], "run_id string")
        said = machine.guarded(calls, ran, locks, 30)
        errors = said.where("outcome <> 'ok'").select(F.col("call_id").cast("string").alias("dedupe_key"), F.col("retry_after").cast("string").alias("other"), F.col("outcome").alias("method"))
        found = C.scoped_candidates(n(s, d), r(s, d), M.schema_edges(s), suppliers(s, d), marked(s, d), {"Part": "brand"})
        return found.crossJoin(F.broadcast(said.where("outcome = 'ok'").select("call_id"))).select(*found.columns).unionByName(errors)

    jw = X.jaro_winkler
    return {
        "flt_run_type": lambda s, d: n(s, d).where((F.col("run_id") == M.RUN) & (F.col("node_type") == "Nation")).select("dedupe_key"),
        "flt_strip_governance": lambda s, d: with_properties(s, d).select("dedupe_key", F.array_join(F.map_keys(W.user_properties(F.col("properties"))), ",").alias("names")).distinct(),
        "flt_excluded": lambda s, d: pairs(s, d).join(pairs(s, d).where("seq % 11 = 0").select("candidate_id"), "candidate_id", "left_anti").select("candidate_id"),
        "flt_requested_ids": lambda s, d: pairs(s, d).join(pairs(s, d).where("seq % 2 = 0").select("candidate_id"), "candidate_id", "left_semi").select("candidate_id"),
        "flt_log_level": lambda s, d: events(s, d).where(J.level_rank(F.col("level")) >= 2).groupBy("level").agg(F.count("*").alias("n")),
        "prj_candidate_out": lambda s, d: G.exact_node_duplicates(n(s, d)).select("candidate_id", "candidate_type", "severity", F.array("dedupe_key")[0].alias("ref")),
        "join_rel_types": lambda s, d: G.canonical_violations(r(s, d), n(s, d), M.schema_edges(s).where("false")).select("dedupe_key", "start_type", "end_type"),
        "join_rel_schema": schema_of,
        "join_cand_nodes": valued,
        "join_edge_endpoints": ended,
        "join_vector": vectored,
        "dml_create_node": created,
        "agg_write_actions": actions,
        "agg_adjacency": lambda s, d: G.neighbors(r(s, d)).groupBy("dedupe_key").agg(F.count("*").alias("n"), F.min("neighbor").alias("first")),
        "agg_distinct_tokens": lambda s, d: names(s, d).select("p_partkey", F.array_join(F.array_sort(X.tokens(F.col("b"))), " ").alias("tokens")),
        "win_neighbourhood": lambda s, d: G.sorted_window_pairs(n(s, d)).select("node_type", "key_a", "key_b", (F.col("key_a") == F.col("key_b")).alias("own")),
        "win_first_wins": lambda s, d: n(s, d).groupBy("dedupe_key").agg(F.min_by("primary_value", "seq").alias("value"), F.min("seq").alias("seq")),
        "win_last_wins": lambda s, d: events(s, d).groupBy("user_id").agg(F.max_by("level", F.struct("ts", "event_id")).alias("level")),
        "win_chunk_fold": folded,
        "limit_neighbour_values": lambda s, d: C.other_partners(G.sorted_window_pairs(n(s, d))),
        "set_candidates_union": united,
        "set_jaccard": on_names(lambda a, b: F.round(X.jaccard(X.tokens(a), X.tokens(b)), 6)),
        "set_property_keys": lambda s, d: sides(s, d).select("seq", F.array_join(F.array_sort(F.array_union(F.map_keys(S.own_properties(F.col("properties"))), F.map_keys(S.own_properties(F.col("other"))))), ",").alias("names")),
        "fn_jaro_winkler": lambda s, d: names(s, d).select("p_partkey", F.round(jw("a", "b"), 6).alias("score")),
        "fn_jaro": lambda s, d: names(s, d).select("p_partkey", F.round(X.jaro("a", "b"), 6).alias("score")),
        "fn_token_overlap": on_names(lambda a, b: F.round(X.token_overlap(X.tokens(a), X.tokens(b)), 6)),
        "fn_jaccard": on_names(lambda a, b: F.round(X.jaccard(X.content_tokens(a), X.content_tokens(b)), 6)),
        "fn_content_tokens": lambda s, d: names(s, d).select("p_partkey", F.array_join(F.array_sort(X.content_tokens(F.col("b"))), " ").alias("tokens")),
        "fn_token_containment": on_names(X.token_containment),
        "fn_primary_value": lambda s, d: names(s, d).select("p_partkey", X.primary_value(F.when(F.col("p_partkey") % 9 > 0, F.concat(F.lit(" \t"), "b", F.lit("\n")))).alias("value")),
        "fn_classify_element": lambda s, d: D.elements(M.blocks(s, d)).select("doc_id", "pos", "element_type"),
        "fn_flush_quality": flushed,
        "fn_dedupe_key": lambda s, d: t(s, d, "supplier").select(M.node_key("Supplier", F.col("s_name")).alias("dedupe_key")),
        "fn_composite": lambda s, d: numbers(s, d).select("k", S.composite(*[F.col(c) for c in ("sim", "lap", "ctx", "held", "props")]).alias("score")),
        "fn_confidence_band": lambda s, d: numbers(s, d).select("k", S.band(F.col("sim"), F.col("conflicts")).alias("band")),
        "fn_property_overlap": lambda s, d: sides(s, d).select("seq", F.round(S.property_overlap(F.col("properties"), F.col("other")), 6).alias("score")),
        "fn_contradictions": lambda s, d: sides(s, d).select("seq", F.array_join(S.contradictions(F.col("properties"), F.col("other")), ",").alias("names")),
        "fn_budget": lambda s, d: numbers(s, d).select("k", S.budget(F.col("k") * 10 + 5, F.when(F.col("held"), "high").when(F.col("k") % 2 == 0, "low").otherwise("medium")).alias("budget")),
        "fn_cosine": vectored,
        "st_pipeline_status": lambda s, d: jobs(s, d).where("run_id = 'run2'").select("chunk_id", "status"),
        "st_extraction_results": results,
        "st_scoped_generate": generated,
        "src_rels_by_run": lambda s, d: r(s, d).where(F.col("run_id") == M.RUN).orderBy("dedupe_key").select("dedupe_key", "rel_type"),
        "src_chunk_flags": lambda s, d: chunks(s, d).select("chunk_id", F.explode("flags").alias("flag")),
    }


_NAMES = """WITH p AS (SELECT x.p_partkey, x.p_name AS a, 'The ' || y.p_name || ' ' || lower(y.p_type) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1) """
_SIDES = """, two AS (SELECT x.seq, [x.brand, x.kind, x.size] AS v, [y.brand, y.kind, y.size] AS w FROM mark x JOIN mark y ON x.node_type = 'Part' AND y.node_type = 'Part' AND y.seq = x.seq + 64),
  named AS (SELECT seq, ['brand', 'kind', 'size'][i] AS name, v[i] AS x, w[i] AS y FROM two, (VALUES (1), (2), (3)) t(i)) """
_NUM = """WITH x AS (SELECT p_partkey AS k, (p_partkey % 101)::DOUBLE / 100 AS sim, (p_partkey % 11)::DOUBLE / 10 AS lap, (p_partkey % 5)::DOUBLE / 10 AS ctx, p_partkey % 7 = 0 AS held, (p_partkey % 4)::DOUBLE / 4 AS props FROM part) """
_COS = "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 5) AS score FROM embeddings"


def oracle_sql() -> dict[str, str]:
    from graphweave import registry as Q
    from graphweave import registry_curation as U
    from graphweave import registry_documents as P
    from graphweave import registry_findings as N
    from graphweave import registry_governed as V

    g, tok = M.SQL, Q._TOK.format
    marks = g + U._MARK + _SIDES
    both = lambda f: f"len(list_intersect({f('a')}, {f('b')}))"
    size = lambda f: f"(len({f('a')}) + len({f('b')}))"
    jaccard = lambda f: f"SELECT p_partkey, round(CASE WHEN {size(f)} = 0 THEN 0::DOUBLE ELSE {both(f)}::DOUBLE / ({size(f)} - {both(f)}) END, 6) AS score FROM p"
    allowed = Q.violations_sql(Q.ALLOWED, "more_rels")
    walked = N.alike_sql("named_pairs").split(",\n  links AS")[0].replace("FROM rels", "FROM more_rels")
    return {
        "flt_run_type": g + "SELECT dedupe_key FROM nodes WHERE node_type = 'Nation'",
        "flt_strip_governance": g + "SELECT DISTINCT dedupe_key, 'note' AS names FROM rels",
        "flt_excluded": N._PAIRS + "SELECT id AS candidate_id FROM p WHERE k % 11 <> 0",
        "flt_requested_ids": N._PAIRS + "SELECT id AS candidate_id FROM p WHERE k % 2 = 0",
        "flt_log_level": U._EV + "SELECT level, count(*) AS n FROM ev WHERE level IN ('warning', 'error') GROUP BY 1",
        "prj_candidate_out": g + f"SELECT candidate_id, candidate_type, severity, dedupe_key AS ref FROM ({Q._NODE_DUP})",
        "join_rel_types": g + Q.BAD.replace("WHERE NOT EXISTS (SELECT 1 FROM allowed WHERE a = start_type", "WHERE NOT EXISTS (SELECT 1 FROM allowed WHERE false AND a = start_type") + "SELECT dedupe_key, start_type, end_type FROM bad",
        "join_rel_schema": g + M.MORE_RELS_SQL + allowed + "SELECT DISTINCT m.dedupe_key, coalesce(violation, 'allowed') AS found FROM more_rels m LEFT JOIN bad ON bad.dedupe_key = m.dedupe_key",
        "join_cand_nodes": g + Q.WINDOW + U._MARK + """, one AS (SELECT dedupe_key AS k, min(seq) AS seq, arg_min(struct_pack(b := brand, s := size), seq) AS p FROM mark GROUP BY 1)
          SELECT key_a, key_b, a.seq AS seq_a, a.p.b AS brand_a, a.p.s AS size_a, b.seq AS seq_b, b.p.b AS brand_b, b.p.s AS size_b
          FROM pairs LEFT JOIN one a ON a.k = key_a LEFT JOIN one b ON b.k = key_b""",
        "join_edge_endpoints": g + V._EDGES + "SELECT rel_type, start_dedupe_key, end_dedupe_key, ok AS held FROM seen",
        "join_vector": _COS,
        "dml_create_node": """WITH a AS (SELECT p_partkey AS seq, 'Made|' || p_name || '|v1' AS dedupe_key, p_partkey % 50 = 0 AS blank FROM part)
          SELECT seq, dedupe_key, CASE WHEN blank THEN 'incomplete' WHEN dedupe_key IN (SELECT dedupe_key FROM a WHERE seq % 9 = 0) THEN 'matched'
            WHEN seq = min(CASE WHEN NOT blank THEN seq END) OVER (PARTITION BY dedupe_key) THEN 'created' ELSE 'matched' END AS outcome FROM a""",
        "agg_write_actions": g + V._EDGES + "SELECT count(*) FILTER (ok AND NOT old) AS created, CAST(sum(n - (NOT old)::INT) FILTER (ok) AS BIGINT) AS matched, CAST(sum(n) FILTER (NOT ok) AS BIGINT) AS skipped FROM seen",
        "agg_adjacency": g + "SELECT k AS dedupe_key, count(DISTINCT o) AS n, min(o) AS first FROM (SELECT start_dedupe_key AS k, end_dedupe_key AS o FROM rels UNION ALL SELECT end_dedupe_key, start_dedupe_key FROM rels) GROUP BY 1",
        "agg_distinct_tokens": _NAMES + f"SELECT p_partkey, array_to_string(list_sort({tok('b')}), ' ') AS tokens FROM p",
        "win_neighbourhood": g + Q.WINDOW + "SELECT node_type, key_a, key_b, key_a = key_b AS own FROM pairs",
        "win_first_wins": g + "SELECT dedupe_key, min_by(primary_value, seq) AS value, min(seq) AS seq FROM nodes GROUP BY 1",
        "win_last_wins": U._EV + "SELECT user_id, arg_max(level, (ts, event_id)) AS level FROM ev GROUP BY 1",
        "win_chunk_fold": f"SELECT doc_id, chunk_index, elements, chars FROM ({U._CHUNKS})",
        "limit_neighbour_values": g + Q.WINDOW + """, own AS (SELECT * FROM pairs),
          s AS (SELECT key_a, key_b, key_a AS k, key_b AS p, value_b AS v FROM own UNION SELECT key_a, key_b, key_b, key_a, value_a FROM own),
          o AS (SELECT s.key_a, s.key_b, s.k, list_sort(list_distinct(list(x.v) FILTER (x.p <> s.p))) AS vs FROM s JOIN s x USING (k) GROUP BY 1, 2, 3)
          SELECT key_a, key_b, k AS dedupe_key, len(coalesce(vs, [])) AS others, array_to_string(list_slice(coalesce(vs, []), 1, 10), ',') AS first_others FROM o""",
        "set_candidates_union": g + N._PAIRS.replace("WITH p AS", ", p AS") + Q.violations_sql(Q.ALLOWED) + f"""SELECT id AS candidate_id, k AS seq, 'old' AS candidate_type, NULL AS severity FROM p
          UNION ALL SELECT candidate_id, -1, candidate_type, severity FROM ({Q._NODE_DUP}) UNION ALL SELECT candidate_id, -1, candidate_type, severity FROM ({Q._REL_DUP})
          UNION ALL (SELECT DISTINCT candidate_id, -1, 'canonical_violation', severity FROM bad)""",
        "set_jaccard": _NAMES + jaccard(tok),
        "set_property_keys": marks + "SELECT seq, string_agg(name, ',' ORDER BY name) FILTER (coalesce(x, y) IS NOT NULL) AS names FROM named GROUP BY 1",
        "fn_jaro_winkler": N.recursive(g + M.MORE_RELS_SQL + _NAMES.replace("WITH p AS", ", p AS") + ", named_pairs AS (SELECT p_partkey, a AS value_a, b AS value_b FROM p) " + walked) + " SELECT p_partkey, round(jw, 6) AS score FROM scored",
        "fn_jaro": N.recursive(g + M.MORE_RELS_SQL + _NAMES.replace("WITH p AS", ", p AS") + ", named_pairs AS (SELECT p_partkey, a AS value_a, b AS value_b FROM p) " + walked) + """ SELECT p_partkey, round(CASE WHEN a = b THEN 1::DOUBLE WHEN m = 0 THEN 0::DOUBLE ELSE (m / length(a) + m / length(b) + (m - moved) / m) / 3 END, 6) AS score
          FROM named_pairs JOIN jaro ON a = value_a AND b = value_b""",
        "fn_token_overlap": _NAMES + f"SELECT p_partkey, round(CASE WHEN {size(tok)} = 0 THEN 0::DOUBLE ELSE 2::DOUBLE * {both(tok)} / {size(tok)} END, 6) AS score FROM p",
        "fn_jaccard": _NAMES + jaccard(Q.content_sql),
        "fn_content_tokens": _NAMES + f"SELECT p_partkey, array_to_string(list_sort({Q.content_sql('b')}), ' ') AS tokens FROM p",
        "fn_token_containment": _NAMES + f"SELECT p_partkey, {Q.contained_sql('a', 'b', Q.content_sql('a'), Q.content_sql('b'))} AS score FROM p",
        "fn_primary_value": _NAMES + "SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN lower(b) ELSE '' END AS value FROM p",
        "fn_classify_element": Q._ELEMENTS + f"SELECT doc_id, pos, {Q._KIND} AS element_type FROM els WHERE text <> ''",
        "fn_flush_quality": """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
            els AS (SELECT doc_id, trim(line) AS text, pos FROM lines WHERE trim(line) <> ''),
            grown AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, length(text) AS n, lag(length(text)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM els)
          SELECT d.doc_id, CASE WHEN g.k IS NOT NULL THEN g.k - 1 END AS chunk_index, CASE WHEN g.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n < 20 THEN 'low_text_density' END, CASE WHEN d.doc_id % 3 = 0 THEN 'raw_fallback' END) END AS flags,
            CASE WHEN d.doc_id % 7 > 0 THEN 2 ELSE -1 END AS start_page, CASE WHEN g.k IS NOT NULL AND d.doc_id % 7 = 0 THEN 'missing_page_info' END AS error FROM documents d JOIN grown g USING (doc_id)""",
        "fn_dedupe_key": "SELECT 'Supplier|' || s_name || '|v1' AS dedupe_key FROM supplier",
        "fn_composite": _NUM + """SELECT k, round(CASE WHEN held THEN 0.7::DOUBLE + least(ctx * 0.15::DOUBLE + props * 0.1::DOUBLE, 0.25::DOUBLE) WHEN ctx = 0 THEN 0.65::DOUBLE * sim + 0.25::DOUBLE * lap + 0.1::DOUBLE * props
          ELSE 0.5::DOUBLE * sim + 0.25::DOUBLE * lap + 0.15::DOUBLE * ctx + 0.1::DOUBLE * props END, 4) AS score FROM x""",
        "fn_confidence_band": _NUM + "SELECT k, CASE WHEN sim >= 0.8::DOUBLE AND k % 3 > 0 THEN 'high' WHEN sim >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM x",
        "fn_property_overlap": marks + "SELECT seq, round(count(*) FILTER (x = y)::DOUBLE / count(coalesce(x, y)), 6) AS score FROM named GROUP BY 1",
        "fn_contradictions": marks + "SELECT seq, coalesce(string_agg(name, ',' ORDER BY name) FILTER (x <> y), '') AS names FROM named GROUP BY 1",
        "fn_budget": _NUM + "SELECT k, CAST(trunc((k * 10 + 5) * CASE WHEN held THEN 1.5::DOUBLE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END) AS BIGINT) AS budget FROM x",
        "fn_cosine": _COS,
        "st_pipeline_status": P._C + "SELECT chunk_id, status FROM job WHERE run_id = 'run2'",
        "st_extraction_results": g + """SELECT r AS run_id, count(dedupe_key) AS nodes, (SELECT count(*) FROM rels WHERE rels.run_id = r) AS edges, (SELECT count(DISTINCT rel_type) FROM rels WHERE rels.run_id = r) AS edge_types,
          max(schema_version) AS version FROM (VALUES ('run1'), ('run9')) v(r) LEFT JOIN nodes ON run_id = r GROUP BY 1""",
        "st_scoped_generate": f"SELECT * FROM ({N.scoped_sql()}) UNION ALL SELECT '1', '21', 'execution_cooldown' UNION ALL SELECT '2', NULL, 'schema_not_locked'",
        "src_rels_by_run": g + "SELECT dedupe_key, rel_type FROM rels",
        "src_chunk_flags": P._C + "SELECT chunk_id, 'low_ocr_confidence' AS flag FROM chunk WHERE ocr UNION ALL SELECT chunk_id, 'low_text_density' FROM chunk WHERE thin UNION ALL SELECT chunk_id, 'raw_fallback' FROM chunk WHERE raw",
    }
