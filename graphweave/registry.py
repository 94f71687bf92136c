"""The queries of the graph engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import registry_agents, registry_curation, registry_documents, registry_findings, registry_functions, registry_governed
from graphweave.functions.text import STOPWORDS
from graphweave.operators import documents as D
from graphweave.operators import graph as G
from graphweave.operators import reads as R
from graphweave.plans import model as M

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    n, r, t = M.nodes, M.rels, M.table

    def topk(s: SparkSession, d: str) -> DataFrame:
        v = t(s, d, "embeddings")
        return G_first(v)

    def G_first(v: DataFrame) -> DataFrame:
        row = v.orderBy("vec_id").select("embedding").first()
        return D.cosine_topk(v, list(row[0]) if row else [])

    def second_page(rows: DataFrame, key: list[str], size: int) -> DataFrame:
        """Behind the last key of the first page, which a reader of pages has."""
        last = R.page_after(rows, key, None, size).orderBy(*map(F.desc, key)).first()
        return R.page_after(rows, key, tuple(last[k] for k in key) if last else None, size)

    def found(s: SparkSession, d: str) -> DataFrame:
        keep = ("candidate_id", "candidate_type", "severity")
        wrong = G.canonical_violations(r(s, d), n(s, d), M.schema_edges(s)).withColumn("candidate_type", F.lit("canonical_violation"))
        rows = G.exact_node_duplicates(n(s, d)).select(*keep).unionByName(G.exact_rel_duplicates(r(s, d)).select(*keep))
        return rows.unionByName(wrong.select(*keep).distinct())

    return {
        "src_nodes": lambda s, d: n(s, d).where(F.col("run_id") == M.RUN).select("dedupe_key", "node_type", "seq"),
        "src_nodes_by_type": lambda s, d: n(s, d).where("node_type = 'Supplier'").select("dedupe_key", "seq"),
        "src_rels": lambda s, d: r(s, d).select("dedupe_key", "rel_type"),
        "agg_node_counts": lambda s, d: n(s, d).groupBy("node_type").agg(F.count("*").alias("n")),
        "agg_edge_counts": lambda s, d: r(s, d).groupBy("rel_type").agg(F.count("*").alias("n")),
        "agg_degree": lambda s, d: G.degree(n(s, d), r(s, d)),
        "agg_degree_outlier": lambda s, d: G.degree_outliers(G.degree(n(s, d), r(s, d))),
        "join_orphans": lambda s, d: G.orphans(n(s, d), r(s, d)),
        "join_neighbors": lambda s, d: G.neighbors(r(s, d)),
        "page_nodes": lambda s, d: second_page(n(s, d).select("dedupe_key", "seq"), ["dedupe_key", "seq"], 50),
        "agg_exact_node_dup": lambda s, d: G.exact_node_duplicates(n(s, d)),
        "agg_exact_rel_dup": lambda s, d: G.exact_rel_duplicates(r(s, d)),
        "agg_bidir_rel_dup": lambda s, d: G.bidirectional_duplicates(r(s, d)),
        "gr_canonical_violation": lambda s, d: G.canonical_violations(r(s, d), n(s, d), M.schema_edges(s)),
        "gr_canonical_violation_amended": lambda s, d: G.canonical_violations(M.more_rels(s, d), n(s, d), M.schema_edges(s), M.amended(s)),
        "join_sorted_window": lambda s, d: G.sorted_window_pairs(n(s, d)),
        "fn_token_scores": lambda s, d: G.window_scores(n(s, d)),
        "join_token_block": lambda s, d: G.token_pairs(M.labelled(s, d)),
        "gr_probable_dup": lambda s, d: G.probable_duplicates(M.labelled(s, d).unionByName(n(s, d)), r(s, d)),
        "agg_candidate_groups": lambda s, d: G.candidate_groups(found(s, d)),
        "agg_candidate_members": lambda s, d: G.candidate_members(found(s, d)).select("candidate_type", "candidate_id", "place"),
        "dml_merge_nodes": lambda s, d: G.merge_nodes(n(s, d)),
        "ids_documents": lambda s, d: D.identities(t(s, d, "documents")),
        "fn_text_to_elements": lambda s, d: D.elements(M.blocks(s, d)).select("doc_id", "pos", "element_type", F.sha2("text", 256).alias("text_sha256")),
        "topk_evidence_query": topk,
        "st_upsert_job_status": lambda s, d: D.latest_status(t(s, d, "events")),
        "agg_telemetry": lambda s, d: D.telemetry(M.records(s, d)),
        "st_telemetry_run": lambda s, d: D.telemetry_of_run(M.records(s, d), "run1"),
        "agg_histogram": lambda s, d: D.histogram(M.samples(s, d), s.createDataFrame([("view",), ("never",)], "name string").unionByName(M.samples(s, d).select("name"))),
        **registry_agents.queries(),
        **registry_curation.queries(),
        **registry_documents.queries(),
        **registry_governed.queries(),
        **registry_findings.queries(),
        **registry_functions.queries(),
    }


def candidate_sql(kind: str, method: str, refs: str) -> str:
    """The id of a finding in SQL; refs is the JSON array's inside."""
    return f"""sha256('{{"candidate_type":"{kind}","detection_method":"{method}","involved_element_refs":[' || {refs} || '],"run_id":"run1","schema_version":"v1"}}')"""


_ONE = """'"' || dedupe_key || '"'"""
_NODE_DUP = f"""SELECT {candidate_sql('exact_node_duplicate', 'exact_node_dedupe_key', _ONE)} AS candidate_id, 'exact_node_duplicate' AS candidate_type,
    'high' AS severity, node_type, dedupe_key, count(*) AS duplicate_count FROM nodes GROUP BY node_type, dedupe_key HAVING count(*) >= 2"""
_REL_DUP = f"""SELECT {candidate_sql('exact_rel_duplicate', 'exact_rel_dedupe_key', _ONE)} AS candidate_id, 'exact_rel_duplicate' AS candidate_type,
    'high' AS severity, rel_type, dedupe_key, count(*) AS duplicate_count, min(start_dedupe_key) AS start_dedupe_key, min(end_dedupe_key) AS end_dedupe_key
    FROM rels GROUP BY rel_type, dedupe_key HAVING count(*) >= 2"""
_THREE = """'"' || least(dedupe_key, start_dedupe_key, end_dedupe_key) || '","' || list_sort([dedupe_key, start_dedupe_key, end_dedupe_key])[2] || '","'
    || greatest(dedupe_key, start_dedupe_key, end_dedupe_key) || '"'"""


def violations_sql(allowed: str, rels: str = "rels") -> str:
    """CTE bad: the relationships that the allowed (start type, end type, type) rows don't hold."""
    inverse = "EXISTS (SELECT 1 FROM allowed WHERE a = end_type AND b = start_type AND t = rel_type)"
    ident = [candidate_sql("canonical_violation", f"canonical_{m}_violation", _THREE) for m in ("inverse", "direction")]
    return f""", kinds AS (SELECT dedupe_key AS k, max_by(node_type, seq) AS kind FROM nodes GROUP BY 1), allowed(a, b, t) AS (VALUES {allowed}),
      typed AS (SELECT dedupe_key, rel_type, start_dedupe_key, end_dedupe_key, coalesce(x.kind, '') AS start_type, coalesce(y.kind, '') AS end_type
        FROM {rels} LEFT JOIN kinds x ON x.k = start_dedupe_key LEFT JOIN kinds y ON y.k = end_dedupe_key),
      bad AS (SELECT CASE WHEN {inverse} THEN {ident[0]} ELSE {ident[1]} END AS candidate_id, *, CASE WHEN {inverse} THEN 'inverse' ELSE 'direction' END AS violation,
        CASE WHEN {inverse} THEN 'high' ELSE 'medium' END AS severity
        FROM typed WHERE NOT EXISTS (SELECT 1 FROM allowed WHERE a = start_type AND b = end_type AND t = rel_type)) """


BIDIRECTIONAL = """SELECT sha256('{"candidate_type":"exact_rel_duplicate","detection_method":"bidirectional_rel_duplicate","involved_element_refs":["' || string_agg(k, '","' ORDER BY k) || '"],"run_id":"run1","schema_version":"v1"}') AS candidate_id,
          rel_type, string_agg(k, ' ' ORDER BY k) AS refs, count(*) AS edges
          FROM (SELECT DISTINCT rel_type, dedupe_key AS k, least(start_dedupe_key, end_dedupe_key) AS a, greatest(start_dedupe_key,
            end_dedupe_key) AS b FROM rels
            WHERE start_dedupe_key <> end_dedupe_key AND dedupe_key NOT IN (SELECT dedupe_key FROM rels GROUP BY 1 HAVING count(*) >= 2))
              GROUP BY rel_type, a, b HAVING count(*) >= 2"""
ALLOWED = ", ".join(map(str, M.SCHEMA_EDGES))
BAD = violations_sql(ALLOWED)
_FOUND = f""", found AS (SELECT candidate_id, candidate_type, severity FROM ({_NODE_DUP}) UNION ALL SELECT candidate_id, candidate_type, severity FROM ({_REL_DUP})
  UNION ALL SELECT DISTINCT candidate_id, 'canonical_violation', severity FROM bad) """
_DEGREE = """SELECT k AS dedupe_key, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_degree
  FROM (SELECT DISTINCT dedupe_key AS k FROM nodes) LEFT JOIN (
    SELECT start_dedupe_key AS k, 0 AS i, 1 AS o FROM (SELECT DISTINCT dedupe_key, start_dedupe_key FROM rels)
    UNION ALL SELECT end_dedupe_key, 1, 0 FROM (SELECT DISTINCT dedupe_key, end_dedupe_key FROM rels)) USING (k) GROUP BY k"""
_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def content_sql(value: str) -> str:
    """The content tokens of a value."""
    return f"list_filter({_TOK.format(value)}, lambda t: length(t) > 1 AND t NOT IN {_STOP})"


def contained_sql(a: str, b: str, x: str, y: str) -> str:
    """Whether the smaller of the content token lists x and y of the values a and b lies in the larger."""
    shorter = f"CASE WHEN len({x}) < len({y}) THEN {a} ELSE {b} END"
    return f"(len({x}) <> len({y}) AND least(len({x}), len({y})) >= 2 AND length(trim({shorter})) >= 3 AND len(list_intersect({x}, {y})) = least(len({x}), len({y})))"


WINDOW = """, vals AS (SELECT node_type, dedupe_key, max_by(trim(lower(primary_value)), seq) AS value FROM nodes GROUP BY 1, 2),
  ranked AS (SELECT nodes.node_type, nodes.dedupe_key, value, row_number() OVER (PARTITION BY nodes.node_type ORDER BY value, nodes.dedupe_key) AS k
    FROM nodes JOIN vals ON vals.node_type = nodes.node_type AND vals.dedupe_key = nodes.dedupe_key WHERE value <> ''),
  pairs AS (SELECT DISTINCT a.node_type, least(a.dedupe_key, b.dedupe_key) AS key_a, greatest(a.dedupe_key, b.dedupe_key) AS key_b,
      CASE WHEN a.dedupe_key > b.dedupe_key THEN b.value ELSE a.value END AS value_a, CASE WHEN a.dedupe_key > b.dedupe_key THEN a.value ELSE b.value END AS value_b
    FROM ranked a JOIN ranked b ON a.node_type = b.node_type AND b.k BETWEEN a.k + 1 AND a.k + 4) """
_ELEMENTS = """WITH src AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END
    || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || '- item' || chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| 1 | 2 |'
      ELSE '' END AS text FROM documents),
  cut AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS block, generate_subscripts(string_split(text, chr(10) || chr(10)),
    1) - 1 AS pos FROM src),
  els AS (SELECT doc_id, pos, regexp_replace(block, '^\\s+|\\s+$', '', 'g') AS text FROM cut) """
_KIND = """CASE WHEN regexp_matches(trim(string_split(text, chr(10))[1]), '^#{1,6}\\s+\\S') THEN 'heading'
  WHEN regexp_matches(text, '(?m)^\\|?[\\s\\-:]+(\\|[\\s\\-:]+)+\\|?\\s*$') THEN 'table'
  WHEN regexp_matches(trim(string_split(text, chr(10))[1]), '^([-*+]\\s+|[0-9]+[.)]\\s+)') THEN 'list_item' ELSE 'paragraph' END"""
_RECORDS = """WITH rec AS (SELECT 'run' || (user_id % 2) AS run_id, event_id % 100 AS candidate_id, event_type AS agent, CAST(floor(value * 10) AS BIGINT) AS tokens_in,
    CAST(floor(value) AS BIGINT) AS tokens_out, value / 1000 AS cost, ts, event_id AS seq FROM events),
  last AS (SELECT run_id, candidate_id, agent, arg_max(struct_pack(i := tokens_in, o := tokens_out, c := cost), (ts, seq)) AS x FROM rec GROUP BY 1, 2, 3) """
_SORTED = """WITH kept AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r
  FROM events WHERE value IS NOT NULL),
  got AS (SELECT name, list_sort(list(value)) AS v FROM kept WHERE r <= 10000 GROUP BY 1),
  named AS (SELECT name, coalesce(v, []) AS v, len(coalesce(v, [])) AS n FROM (SELECT DISTINCT event_type AS name FROM events WHERE value IS NOT NULL
    UNION SELECT 'view' UNION SELECT 'never') LEFT JOIN got USING (name)) """
_AT = "coalesce(v[greatest(CAST(floor(n * {q}::DOUBLE) AS INT), 1)], 0)"


def oracle_sql() -> dict[str, str]:
    g = M.SQL
    return {
        "src_nodes": g + "SELECT dedupe_key, node_type, seq FROM nodes WHERE run_id = 'run1'",
        "src_nodes_by_type": g + "SELECT dedupe_key, seq FROM nodes WHERE node_type = 'Supplier'",
        "src_rels": g + "SELECT dedupe_key, rel_type FROM rels",
        "agg_node_counts": g + "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1",
        "agg_edge_counts": g + "SELECT rel_type, count(*) AS n FROM rels GROUP BY 1",
        "agg_degree": g + _DEGREE,
        "agg_degree_outlier": g + f"""SELECT dedupe_key, total FROM (SELECT dedupe_key, in_degree + out_degree AS total,
          avg(in_degree + out_degree) OVER () AS m, stddev_pop(in_degree + out_degree) OVER () AS s, count(*) OVER () AS n FROM ({_DEGREE}))
          WHERE n >= 3 AND s > 0 AND total > m + 3 * s""",
        "join_orphans": g + "SELECT DISTINCT dedupe_key FROM nodes WHERE dedupe_key NOT IN (SELECT start_dedupe_key FROM rels UNION SELECT end_dedupe_key FROM rels)",
        "join_neighbors": g + "SELECT start_dedupe_key AS dedupe_key, end_dedupe_key AS neighbor FROM rels UNION SELECT end_dedupe_key, start_dedupe_key FROM rels",
        "page_nodes": g + "SELECT dedupe_key, seq FROM nodes ORDER BY dedupe_key, seq LIMIT 50 OFFSET 50",
        "agg_exact_node_dup": g + _NODE_DUP,
        "agg_exact_rel_dup": g + _REL_DUP,
        "agg_bidir_rel_dup": g + BIDIRECTIONAL,
        "gr_canonical_violation": g + BAD + "SELECT * FROM bad",
        "gr_canonical_violation_amended": g + M.MORE_RELS_SQL + violations_sql(ALLOWED + ", " + str(M.AMENDED), "more_rels") + "SELECT * FROM bad",
        "join_sorted_window": g + WINDOW + "SELECT * FROM pairs",
        "fn_token_scores": g + WINDOW + f""", tok AS (SELECT *, {_TOK.format('value_a')} AS x, {_TOK.format('value_b')} AS y,
          {content_sql('value_a')} AS cx, {content_sql('value_b')} AS cy FROM pairs),
          met AS (SELECT *, len(list_intersect(x, y)) AS i FROM tok)
          SELECT node_type, key_a, key_b, round(CASE WHEN len(x) + len(y) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * i / (len(x) + len(y)) END,
            6) AS token_overlap,
            round(CASE WHEN len(x) + len(y) = 0 THEN 0.0::DOUBLE ELSE i::DOUBLE / (len(x) + len(y) - i) END, 6) AS jaccard,
              {contained_sql('value_a', 'value_b', 'cx', 'cy')} AS containment FROM met""",
        "join_token_block": M.LABELLED + f""", vals AS (SELECT node_type, dedupe_key, max_by(trim(lower(primary_value)), seq) AS v FROM labelled
          GROUP BY 1, 2),
          tok AS (SELECT *, {content_sql('v')} AS t FROM vals)
          SELECT a.node_type, a.dedupe_key AS key_a, b.dedupe_key AS key_b, a.v AS value_a, b.v AS value_b FROM tok a
            JOIN tok b ON a.node_type = b.node_type AND a.dedupe_key < b.dedupe_key
          WHERE {contained_sql('a.v', 'b.v', 'a.t', 'b.t')}""",
        "agg_candidate_groups": g + BAD + _FOUND + """SELECT candidate_type, CASE candidate_type WHEN 'exact_node_duplicate' THEN 'node'
          ELSE 'relationship' END AS lane, count(*) AS total,
          count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
            count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
          min_by(candidate_id, (CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, candidate_id)) AS first_id
            FROM found GROUP BY 1""",
        "agg_candidate_members": g + BAD + _FOUND + """SELECT candidate_type, candidate_id, row_number() OVER (PARTITION BY candidate_type
          ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, candidate_id) AS place FROM found""",
        "dml_merge_nodes": g + """SELECT dedupe_key, min_by(primary_value, seq) AS primary_value, min(seq) AS created_seq, max(seq) AS last_seen_seq,
          count(*) - 1 AS matched FROM nodes GROUP BY 1""",
        "ids_documents": """SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, sha256('run1' || chr(0) || coalesce(source,
          '') || chr(0) || sha256(coalesce(text, ''))) AS doc_hash FROM documents""",
        "fn_text_to_elements": _ELEMENTS + f"SELECT doc_id, pos, {_KIND} AS element_type, sha256(text) AS text_sha256 FROM els WHERE text <> ''",
        "topk_evidence_query": """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[])
          FROM embeddings ORDER BY vec_id LIMIT 1)), 5) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10""",
        "st_upsert_job_status": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1, 2",
        "agg_telemetry": _RECORDS + """SELECT agent, CAST(sum(x.i) AS BIGINT) AS tokens_in, CAST(sum(x.o) AS BIGINT) AS tokens_out, round(sum(x.c),
          4) AS cost, count(*) AS invocations FROM last GROUP BY 1""",
        "st_telemetry_run": _RECORDS + "SELECT candidate_id, agent, x.i AS tokens_in, x.o AS tokens_out, x.c AS cost FROM last WHERE run_id = 'run1'",
        "agg_histogram": _SORTED + f"""SELECT name, n, round(coalesce(list_sum(v), 0), 4) AS total, coalesce(v[1], 0) AS least, coalesce(v[-1],
          0) AS most,
          round(CASE WHEN n > 0 THEN list_sum(v) / n ELSE 0 END, 6) AS mean, {_AT.format(q=0.5)} AS p50, {_AT.format(q=0.95)} AS p95,
            {_AT.format(q=0.99)} AS p99 FROM named""",
        **registry_curation.oracle_sql(),
        **registry_documents.oracle_sql(),
        **registry_governed.oracle_sql(),
        **registry_agents.oracle_sql(),
        **registry_findings.oracle_sql(),
        **registry_functions.oracle_sql(),
    }
