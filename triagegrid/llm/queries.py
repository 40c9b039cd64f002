"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm import alignment, covertree, language, linededup, ngramjoin, packing, phrases, pieces, quality, secrets, sharding, urls, warc
from triagegrid.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(spark, docs, quality.fit_lines(spark, docs, table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(spark, docs))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n"))
    gone = linededup.repeated_lines(spark, table(spark, sf_dir, "documents"), least=1)
    return linededup.with_gone(docs, gone).select(
        "doc_id",
        F.when(F.col("n") < 0, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__los"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("__los", ","), F.lit("")).alias("removed"),
    )


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The text goes through encoding and back; what comes back is held against it.
    done = pieces.encode(spark, docs, tokenizer_path("piece_bpe_32k.model"), keep_text=True)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return done.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.score_urls(spark, table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where(~language.held_out()))
    return language.identify(spark, docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.links(spark, table(spark, sf_dir, "embeddings"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


ORACLE: dict[str, str] = {
    "op10_cover_tree": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v),
        z AS (SELECT * FROM u WHERE l > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.95 * a.l * b.l),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, k.b FROM reach r JOIN link k ON r.b = k.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
        n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
        SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
        FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
    "op11_phrases": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws, count(*) AS m FROM p GROUP BY ALL),
        g AS (SELECT lang, m, unnest(ws) AS w1, unnest(ws[2:]) AS w2, unnest(ws[3:]) AS w3 FROM w),
        one AS (SELECT lang, w1, sum(m) AS f FROM g GROUP BY ALL),
        two AS (SELECT lang, w1, w2, sum(m) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
        three AS (SELECT lang, w1, w2, w3, sum(m) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING sum(m) >= 10),
        size AS (SELECT lang, sum(f) AS n FROM one GROUP BY 1),
        longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, w1 AS x, w2 AS y, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
        c2 AS (
            SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, a.f AS l, b.f AS r, 1 AS cut FROM two t JOIN one a ON a.lang = t.lang AND a.w1 = t.w1
                JOIN one b ON b.lang = t.lang AND b.w1 = t.w2 LEFT JOIN longer o ON o.lang = t.lang AND o.x = t.w1 AND o.y = t.w2
            WHERE t.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * t.f)
        ), c3 AS (
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, a.f AS l, b.f AS r, 1 AS cut FROM three t JOIN one a ON a.lang = t.lang AND a.w1 = t.w1 JOIN two b ON b.lang = t.lang AND b.w1 = t.w2 AND b.w2 = t.w3
            UNION ALL
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, a.f, b.f, 2 FROM three t JOIN two a ON a.lang = t.lang AND a.w1 = t.w1 AND a.w2 = t.w2 JOIN one b ON b.lang = t.lang AND b.w1 = t.w3
        ), s AS (SELECT *, CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS score FROM (FROM c2 UNION ALL FROM c3)),
        low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE nth = 1)
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN size USING (lang) WHERE rank <= 2000
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN top <> page_id THEN top END AS refers_to FROM t
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) r USING (doc_id)
    """,
}
