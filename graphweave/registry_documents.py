"""Queries of documents, chunks, extraction and evidence, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import scores as S
from graphweave.functions.text import guard, sanitize
from graphweave.operators import documents as D
from graphweave.operators import extraction as E
from graphweave.operators import reads as R
from graphweave.plans import model as M
from graphweave.sources import documents as X

Query = Callable[[SparkSession, str], DataFrame]


def files(s: SparkSession, d: str) -> DataFrame:
    """Documents as files under all kinds of names; every fifth in Latin-1."""
    names = F.array(*map(F.lit, ("a.txt", "b.pdf", "c", "d.MD", "e.docx", "f.xlsx", "g.tar.gz", ".txt", "h.", "dir.x/i")))
    content = F.when(F.col("doc_id") % 5 == 0, F.encode("text", "ISO-8859-1")).when(F.col("doc_id") % 11 == 0, F.lit("  ").cast("binary")).otherwise(F.encode("text", "UTF-8"))
    content = F.when(F.col("doc_id") % 13 == 2, F.concat(F.lit("%PDF").cast("binary"), content)).otherwise(content)
    return M.table(s, d, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % 10 + 1).cast("int")).alias("name"), content.alias("content"))


def chunks(s: SparkSession, d: str) -> DataFrame:
    """The lines of documents as chunks of two runs."""
    lines = M.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "line")).withColumn("text", F.btrim("line")).where("text <> ''")
    flags = F.array_compact(F.array(
        F.when(F.col("chunk_index") % 7 == 0, "low_ocr_confidence"), F.when(F.char_length("text") < 20, "low_text_density"), F.when(F.col("doc_id") % 3 == 0, "raw_fallback")))
    page = F.floor(F.col("chunk_index") / 3)
    rows = lines.select(F.concat(F.lit("run"), (F.col("doc_id") % 2 + 1).cast("string")).alias("run_id"), "doc_id", "chunk_index", page.alias("start_page"), "text", flags.alias("flags"))
    return X.chunk_rows(rows)


def held(s: SparkSession, d: str) -> DataFrame:
    stamp = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id * 7 % 100 as int))")
    return X.manifests(chunks(s, d), M.table(s, d, "documents")).withColumn("created_at", stamp)


def jobs(s: SparkSession, d: str) -> DataFrame:
    """Three of four chunks have a job."""
    k = (F.col("doc_id") + F.col("chunk_index")) % 4
    rows = chunks(s, d).where(k != 2).select("run_id", "doc_id", "chunk_id", F.when(k == 0, "complete").when(k == 1, "failed").otherwise("running").alias("status"), F.col("chunk_index").alias("created"))
    return rows.withColumn("matched", F.when(F.col("created") % 2 == 0, 1))


def extracted(s: SparkSession, d: str) -> DataFrame:
    """Nodes as if read from chunks of eight parts each, some with blank or foreign parts."""
    kind = F.when(F.col("p_partkey") % 97 == 0, "Gadget").when(F.col("p_partkey") % 101 == 0, F.lit("  ")).otherwise(F.lit("Part"))
    value = F.when(F.col("p_partkey") % 103 == 0, F.lit("  ")).otherwise(F.concat("p_name", F.lit("  no "), F.col("p_partkey").cast("string"), F.lit(" ")))
    return M.table(s, d, "part").select(F.floor(F.col("p_partkey") / 8).alias("chunk_id"), kind.alias("node_type"), value.alias("primary_value"), F.col("p_partkey").alias("seq"))


def linked(s: SparkSession, d: str) -> DataFrame:
    return M.table(s, d, "part").select(F.floor(F.col("p_partkey") / 8).alias("chunk_id"), F.when(F.col("p_partkey") % 89 == 0, "MADE_BY").otherwise(F.lit("PART_OF")).alias("rel_type"))


def queries() -> dict[str, Query]:
    t = M.table

    def binary(s: SparkSession, d: str) -> DataFrame:
        return X.file_hashes(s, d, "*.parquet")

    def chunk_lookup(s: SparkSession, d: str) -> DataFrame:
        c = chunks(s, d)
        wrong = F.when(F.col("chunk_index") % 5 == 0, F.upper("chunk_id")).when(F.col("chunk_index") % 5 == 1, F.reverse("chunk_id")).otherwise(F.col("chunk_id"))
        got = X.chunk_text(c.select(wrong.alias("chunk_id")), c)
        return got.select("chunk_id", F.sha2("text", 256).alias("text_sha256"), "outcome")

    def deleted(s: SparkSession, d: str) -> DataFrame:
        asked = s.range(0, 40).select((F.col("id") * 50 - 100).alias("doc_id"))
        out, *left = X.delete_documents(asked, held(s, d), chunks(s, d), jobs(s, d))
        rows = out.select(F.col("doc_id").alias("n"), "outcome")
        for name, df in zip(("manifests", "chunks", "jobs"), left, strict=True):
            rows = rows.unionByName(df.agg(F.count("*").alias("n")).select("n", F.lit(f"{name} left").alias("outcome")))
        return rows

    def stored(s: SparkSession, d: str) -> DataFrame:
        """Written per run to the shared folder, and read back."""
        import uuid

        from graphweave.plans.tables import shared_dir

        where = f"{shared_dir(s)}/manifests-{uuid.uuid4().hex}"
        X.store(held(s, d).select("run_id", "doc_id", "source", "content_hash", "n_chunks"), where)
        return s.read.parquet(where).where("run_id = 'run2'").select("run_id", "doc_id", "source", "content_hash", "n_chunks")

    def promoted(s: SparkSession, d: str) -> DataFrame:
        good, bad = E.promote(extracted(s, d), "run1", "v1")
        return good.select("seq", "dedupe_key").unionByName(bad.select((-F.col("chunk_id") - 1).alias("seq"), F.lit("rejected").alias("dedupe_key")))

    def conformed(s: SparkSession, d: str) -> DataFrame:
        types = s.createDataFrame([("Part",)], "type string"), s.createDataFrame([("PART_OF",)], "type string")
        nodes = extracted(s, d).withColumn("node_type", sanitize(F.col("node_type")))
        bad = E.rejected_chunks(nodes, linked(s, d), *types)
        kept = E.conforming(nodes, bad).groupBy("chunk_id").agg(F.count("*").alias("n"))
        return kept.select("chunk_id", F.lit("kept").alias("kind"), F.col("n").cast("string").alias("type")).unionByName(bad)

    def models(s: SparkSession, d: str) -> DataFrame:
        c = chunks(s, d).withColumns({"score": (F.col("chunk_index") - 3) / 20, "doc_hash": F.when(F.col("chunk_index") % 6 == 0, F.substring("chunk_id", 1, 60)).otherwise(F.col("chunk_id"))})
        rules = {"text": E.not_blank(F.regexp_replace("text", r"^[A-M].*", " ")), "doc_hash": E.is_hash(F.col("doc_hash")), "score": F.col("score").between(0, 1)}
        return E.model_errors(c, rules).where(F.size("errors") > 0).select("chunk_id", F.array_join("errors", ",").alias("errors"))

    def guarded(s: SparkSession, d: str) -> DataFrame:
        more = F.element_at(F.array(*map(F.lit, ("plain merge of two", "then MATCH (n)", "detach  delete n", "use eval (x)", "```run```", "a set n.x = 1", "os.system('x')", "re-create (all)"))), (F.col("item_id") % 8 + 1).cast("int"))
        texts = t(s, d, "benchmark").select("item_id", F.concat_ws(" ", "text", more).alias("text"))
        return texts.select("item_id", guard(F.lit("a rule"), F.col("text")).alias("kind"))

    def vectors(s: SparkSession, d: str) -> DataFrame:
        return t(s, d, "embeddings").withColumn("run_id", F.concat(F.lit("run"), (F.col("vec_id") % 2).cast("string")))

    def asked(s: SparkSession, d: str) -> DataFrame:
        """Three stated queries: the vectors that stand for the values of three keys."""
        v = t(s, d, "embeddings").where("vec_id in (3, 14, 15)")
        key = F.when(F.col("vec_id") == 3, "Part|small ring|v1").when(F.col("vec_id") == 14, "R::Part|a|v1::Part|b|v1::v1").otherwise("no bars")
        return v.select(F.concat_ws(" ", R.query_value(key), F.col("vec_id").cast("string")).alias("query"), F.col("embedding").alias("q"), F.col("vec_id").alias("pos"))

    def keyed(s: SparkSession, d: str) -> DataFrame:
        """Every 50th supplier's key, looked up by the value in it: a toy embedding deals values to vectors."""
        v = t(s, d, "embeddings")
        many = v.agg((F.max("vec_id") + 1).alias("many"))
        keys = M.nodes(s, d).where("node_type = 'Supplier' and seq % 50 = 0").select(R.query_value(F.col("dedupe_key")).alias("query"))
        value = F.col("query")
        place = (F.char_length(value) * 31 + F.ascii(F.reverse(value)) * 7 + F.ascii(F.substring(value, -2, 1))) % F.col("many")
        wanted = keys.crossJoin(F.broadcast(many)).select("query", place.alias("vec_id"))
        return wanted.join(v.select("vec_id", F.col("embedding").alias("q")), "vec_id").select("query", "q")

    def by_key(s: SparkSession, d: str) -> DataFrame:
        return R.nearest(vectors(s, d).where("run_id = 'run1'"), keyed(s, d), 10)

    def of_run(s: SparkSession, d: str) -> DataFrame:
        row = t(s, d, "embeddings").orderBy("vec_id").select("embedding").first()
        return D.cosine_topk(vectors(s, d), list(row[0]) if row else [], 60, "run1")

    def in_context(s: SparkSession, d: str) -> DataFrame:
        q = asked(s, d)
        return R.first_per_chunk(R.nearest(vectors(s, d), q.select("query", "q")).join(q.select("query", "pos"), "query"))

    ids = lambda s, d: chunks(s, d).select("run_id", "doc_id", "chunk_index", "chunk_id", "locator")
    return {
        "src_binary": binary,
        "src_detect_type": lambda s, d: files(s, d).select("doc_id", X.file_type(F.col("name"), F.col("content")).alias("file_type")),
        "src_raw_text": lambda s, d: X.raw_text(files(s, d)).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "error"),
        "fn_locator": ids,
        "src_chunks_by_doc": lambda s, d: X.chunks_of(chunks(s, d), "run1", t(s, d, "documents").where("doc_id % 4 = 0")),
        "src_chunk_text": chunk_lookup,
        "src_manifests": lambda s, d: X.list_manifests(held(s, d), "run1").select("doc_id", "source", "content_hash", "n_chunks", F.get("chunk_ids", 0).alias("first_chunk")),
        "src_collection_stats": lambda s, d: X.collection_stats(chunks(s, d), s.createDataFrame([("run1",), ("run2",), ("run3",)], "run_id string")),
        "dml_store_manifest": stored,
        "dml_delete_document": deleted,
        "dml_delete_chunks": lambda s, d: X.delete_chunks(chunks(s, d), chunks(s, d).where("chunk_index % 2 = 0")).select("run_id", "chunk_id"),
        "join_manifest_chunks_jobs": lambda s, d: X.pending_chunks(held(s, d), jobs(s, d)),
        "limit_batches": lambda s, d: X.pending_chunks(held(s, d), jobs(s, d), 8).groupBy("doc_id", "batch").agg(F.count("*").alias("n")),
        "join_semi_text": lambda s, d: jobs(s, d).where("status = 'running'").select("chunk_id").join(chunks(s, d).select("chunk_id", "text"), "chunk_id").select("chunk_id", F.sha2("text", 256).alias("text_sha256")),
        "agg_quality_summary": lambda s, d: D.quality_summary(chunks(s, d)),
        "st_doc_chunks": lambda s, d: R.flag_summary(chunks(s, d).join(held(s, d).where("run_id = 'run2'").select("doc_id"), "doc_id", "left_semi")),
        "agg_jobs": lambda s, d: R.job_summary(jobs(s, d)),
        "agg_entity_yield": lambda s, d: R.entity_yield(jobs(s, d)),
        "prj_chunk_out": lambda s, d: R.complete(chunks(s, d).withColumn("text", F.when(F.col("chunk_index") > 0, F.col("text"))), ["text", "locator"]).select("chunk_id", "locator", "doc_id"),
        "flt_payload_complete": lambda s, d: R.complete(chunks(s, d).withColumn("text", F.when(F.col("chunk_index") % 3 > 0, F.col("text"))), ["text"]).groupBy("doc_id").agg(F.count("*").alias("n")),
        "flt_schema_conformance": conformed,
        "ag_promote": promoted,
        "fn_sanitize_unicode": lambda s, d: extracted(s, d).select("seq", sanitize(F.col("primary_value")).alias("clean")),
        "val_models": models,
        "fn_safety_guard": guarded,
        "fn_cost": lambda s, d: t(s, d, "documents").select("doc_id", F.round(S.cost(F.char_length("text"), F.lit(40)), 6).alias("cost")),
        "topk_by_key": by_key,
        "topk_evidence_run": of_run,
        "topk_candidate_evidence": lambda s, d: R.best_scores(R.nearest(vectors(s, d), asked(s, d).select("query", "q"))),
        "win_best_score": lambda s, d: R.best_scores(R.nearest(vectors(s, d), asked(s, d).select("query", "q"), 50)),
        "ag_evidence_context": in_context,
        "page_by_doc": lambda s, d: R.page_of_document(chunks(s, d), F.col("doc_id") == 8, 10, 2),
        "st_evidence_query": lambda s, d: R.page_of_document(chunks(s, d), F.col("doc_id") % 50 == 0, 500),
    }


_CH = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
  chunk AS (SELECT doc_id, 'run' || (doc_id % 2 + 1) AS run_id, pos AS chunk_index, pos // 3 AS start_page, trim(line) AS text,
    sha256(doc_id || chr(0) || (pos // 3) || chr(0) || pos) AS chunk_id,
    'p' || (pos // 3) || ':c' || pos AS locator, pos % 7 = 0 AS ocr, length(trim(line)) < 20 AS thin, doc_id % 3 = 0 AS raw FROM lines
      WHERE trim(line) <> ''),
  job AS (SELECT run_id, doc_id, chunk_id, CASE (doc_id + chunk_index) % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'running' END AS status,
    chunk_index AS created,
    CASE WHEN chunk_index % 2 = 0 THEN 1 END AS matched FROM chunk WHERE (doc_id + chunk_index) % 4 <> 2) """
_C = "WITH " + _CH
_NAMES = "['a.txt', 'b.pdf', 'c', 'd.MD', 'e.docx', 'f.xlsx', 'g.tar.gz', '.txt', 'h.', 'dir.x/i']"
_TYPE = f"""CASE WHEN doc_id % 10 IN (0, 3) THEN 'text' WHEN doc_id % 10 = 1 THEN 'pdf' WHEN doc_id % 10 = 4 THEN 'docx' WHEN doc_id % 10 IN (5, 6) THEN 'unknown'
  WHEN doc_id % 13 = 2 THEN 'pdf' WHEN doc_id % 5 = 0 AND regexp_matches(text, '[^\\x00-\\x7F]') THEN 'unknown' ELSE 'text' END"""
_RAW = f"""WITH f AS (SELECT doc_id, {_TYPE} AS t, CASE WHEN doc_id % 13 = 2 THEN '%PDF' ELSE '' END || CASE WHEN doc_id % 5 <> 0
  AND doc_id % 11 = 0 THEN '  ' ELSE text END AS body FROM documents)
  SELECT doc_id, CASE WHEN t = 'text' AND trim(body) <> '' THEN sha256(body) END AS text_sha256, CASE WHEN t <> 'text' THEN 'unsupported_type'
    WHEN trim(body) = '' THEN 'empty_text' END AS error FROM f"""
_EX = """WITH x AS (SELECT p_partkey AS seq, p_partkey // 8 AS chunk_id, CASE WHEN p_partkey % 97 = 0 THEN 'Gadget' WHEN p_partkey % 101 = 0 THEN ''
  ELSE 'Part' END AS node_type,
  CASE WHEN p_partkey % 103 = 0 THEN '' ELSE p_name || ' no ' || p_partkey END AS primary_value, CASE WHEN p_partkey % 89 = 0 THEN 'MADE_BY'
    ELSE 'PART_OF' END AS rel_type FROM part) """
_PEND = """, left_ AS (SELECT c.doc_id, c.chunk_id, coalesce(j.status, 'new') AS status, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.chunk_index) - 1 AS nth
  FROM chunk c LEFT JOIN job j USING (chunk_id) WHERE coalesce(j.status, '') <> 'complete') """
_NEAR = """WITH q AS (SELECT vec_id AS pos, CASE vec_id WHEN 3 THEN 'small ring 3' WHEN 14 THEN 'a 14' ELSE 'no bars 15' END AS query,
  CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (3, 14, 15)),
  s AS (SELECT pos, query, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 5) AS score FROM embeddings, q WHERE {where}),
  near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= {k}) """


def oracle_sql() -> dict[str, str]:
    near = lambda k=10, where="true": _NEAR.format(k=k, where=where)
    return {
        "src_detect_type": f"SELECT doc_id, {_TYPE} AS file_type FROM documents",
        "src_raw_text": _RAW,
        "fn_locator": _C + "SELECT run_id, doc_id, chunk_index, chunk_id, locator FROM chunk",
        "src_chunks_by_doc": _C + "SELECT doc_id, chunk_id, locator, length(text) AS text_length FROM chunk WHERE run_id = 'run1' AND doc_id % 4 = 0",
        "src_chunk_text": _C + """, asked AS (SELECT CASE chunk_index % 5 WHEN 0 THEN upper(chunk_id) WHEN 1 THEN reverse(chunk_id)
          ELSE chunk_id END AS chunk_id FROM chunk)
          SELECT a.chunk_id, sha256(c.text) AS text_sha256, CASE WHEN NOT regexp_full_match(a.chunk_id, '[0-9a-f]{64}') THEN 'INVALID_CHUNK_ID'
            WHEN c.chunk_id IS NULL THEN 'CHUNK_NOT_FOUND' ELSE 'found' END AS outcome
          FROM asked a LEFT JOIN chunk c USING (chunk_id)""",
        "src_manifests": _C + """SELECT doc_id, coalesce(source, '') AS source, sha256(coalesce(documents.text, '')) AS content_hash,
          count(*) AS n_chunks, arg_min(chunk_id, chunk_index) AS first_chunk
          FROM chunk JOIN documents USING (doc_id) WHERE run_id = 'run1' GROUP BY 1, 2, 3""",
        "src_collection_stats": _C + """SELECT r AS run_id, count(chunk_id) > 0 AS found, count(chunk_id) AS points FROM (VALUES ('run1'), ('run2'),
          ('run3')) v(r) LEFT JOIN chunk ON run_id = r GROUP BY 1""",
        "dml_store_manifest": _C + """SELECT run_id, doc_id, coalesce(source, '') AS source, sha256(coalesce(documents.text, '')) AS content_hash,
          count(*) AS n_chunks FROM chunk JOIN documents USING (doc_id) WHERE run_id = 'run2' GROUP BY 1, 2, 3, 4""",
        "dml_delete_document": _C + """, asked AS (SELECT i * 50 - 100 AS doc_id FROM range(40) r(i)), gone AS (SELECT DISTINCT doc_id FROM chunk
          JOIN asked USING (doc_id))
          SELECT doc_id AS n, CASE WHEN doc_id IN (SELECT doc_id FROM gone) THEN 'deleted' ELSE 'not_found' END AS outcome FROM asked
          UNION ALL SELECT count(DISTINCT doc_id), 'manifests left' FROM chunk WHERE doc_id NOT IN (SELECT doc_id FROM gone)
          UNION ALL SELECT count(*), 'chunks left' FROM chunk WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT count(*), 'jobs left'
            FROM job WHERE doc_id NOT IN (SELECT doc_id FROM gone)""",
        "dml_delete_chunks": _C + "SELECT run_id, chunk_id FROM chunk WHERE chunk_index % 2 = 1",
        "join_manifest_chunks_jobs": _C + _PEND + "SELECT doc_id, chunk_id, status, nth // 5 AS batch FROM left_",
        "limit_batches": _C + _PEND + "SELECT doc_id, nth // 8 AS batch, count(*) AS n FROM left_ GROUP BY 1, 2",
        "join_semi_text": _C + "SELECT chunk_id, sha256(text) AS text_sha256 FROM chunk JOIN job USING (chunk_id) WHERE status = 'running'",
        "agg_quality_summary": _C + """SELECT doc_id, count(*) FILTER (ocr) AS low_ocr_confidence, count(*) FILTER (thin) AS low_text_density,
          count(*) FILTER (raw) AS raw_fallback, count(*) FILTER (ocr OR thin OR raw) AS flagged_chunks, count(*) AS total_chunks FROM chunk
          GROUP BY 1""",
        "st_doc_chunks": _C + """SELECT count(*) FILTER (ocr) AS low_ocr_confidence, count(*) FILTER (thin) AS low_text_density,
          count(*) FILTER (raw) AS raw_fallback FROM chunk WHERE run_id = 'run2'""",
        "agg_jobs": _C + """SELECT run_id, count(*) AS total, count(*) FILTER (status = 'complete') AS complete,
          count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS pending FROM job GROUP BY 1""",
        "agg_entity_yield": _C + "SELECT CAST(sum(created + coalesce(matched, 0)) FILTER (status = 'complete') AS BIGINT) AS entities FROM job",
        "prj_chunk_out": _C + "SELECT chunk_id, locator, doc_id FROM chunk WHERE chunk_index > 0",
        "flt_payload_complete": _C + "SELECT doc_id, count(*) AS n FROM chunk WHERE chunk_index % 3 > 0 GROUP BY 1",
        "flt_schema_conformance": _EX + """, bad AS (SELECT chunk_id, 0 AS k, node_type AS type FROM x WHERE node_type <> 'Part' UNION ALL
          SELECT chunk_id, 1, rel_type FROM x WHERE rel_type <> 'PART_OF')
          SELECT chunk_id, CASE WHEN min(k) = 0 THEN 'node' ELSE 'edge' END AS kind, arg_min(type, (k, type)) AS type FROM bad GROUP BY 1
          UNION ALL SELECT chunk_id, 'kept', CAST(count(*) AS VARCHAR) FROM x WHERE chunk_id NOT IN (SELECT chunk_id FROM bad) GROUP BY 1""",
        "ag_promote": _EX + """, bad AS (SELECT DISTINCT chunk_id FROM x WHERE node_type = '' OR primary_value = '')
          SELECT seq, node_type || '|' || primary_value || '|v1' AS dedupe_key FROM x WHERE chunk_id NOT IN (SELECT chunk_id FROM bad) UNION ALL
            SELECT -chunk_id - 1, 'rejected' FROM bad""",
        "fn_sanitize_unicode": _EX + "SELECT seq, primary_value AS clean FROM x",
        "val_models": _C + """, e AS (SELECT chunk_id, concat_ws(',', CASE WHEN chunk_index % 6 = 0 THEN 'doc_hash' END, CASE
          WHEN chunk_index NOT BETWEEN 3 AND 23 THEN 'score' END, CASE WHEN regexp_matches(text, '^[A-M]') THEN 'text' END) AS errors FROM chunk)
          SELECT chunk_id, errors FROM e WHERE errors <> ''""",
        "fn_safety_guard": """SELECT item_id, CASE WHEN item_id % 8 IN (1, 2, 5, 7) THEN 'mutation' WHEN item_id % 8 IN (3, 4,
          6) THEN 'executable' END AS kind FROM benchmark""",
        "fn_cost": "SELECT doc_id, round((length(text) + 40)::DOUBLE / 1000 * 0.001::DOUBLE, 6) AS cost FROM documents",
        "topk_by_key": """WITH k AS (SELECT s_name AS query, (length(s_name) * 31 + ascii(s_name[-1:]) * 7 + ascii(s_name[-2:-2])) % (SELECT max(vec_id) + 1 FROM embeddings) AS v FROM supplier WHERE s_suppkey % 50 = 0),
          s AS (SELECT query, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 5) AS score FROM k JOIN embeddings x ON x.vec_id = v, embeddings e WHERE e.vec_id % 2 = 1)
          SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10""",
        "topk_evidence_run": """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[])
          FROM embeddings ORDER BY vec_id LIMIT 1)), 5) AS score
          FROM embeddings WHERE vec_id % 2 = 1 ORDER BY score DESC, vec_id LIMIT 50""",
        "topk_candidate_evidence": near() + "SELECT vec_id, max(score) AS score FROM near GROUP BY 1",
        "win_best_score": near(50) + "SELECT vec_id, max(score) AS score FROM near GROUP BY 1",
        "ag_evidence_context": near() + "SELECT arg_min(query, pos) AS query, vec_id, arg_min(score, pos) AS score FROM near GROUP BY vec_id",
        "page_by_doc": _C + "SELECT chunk_id, 0.0 AS score FROM chunk WHERE doc_id = 8 ORDER BY chunk_id LIMIT 10 OFFSET 2",
        "st_evidence_query": _C + "SELECT chunk_id, 0.0 AS score FROM chunk WHERE doc_id % 50 = 0 ORDER BY chunk_id LIMIT 200",
    }
