"""The queries op1_ to op10_ over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm import iblt, jaccard, langid, mixing, packing, pii, quality, sharding, tsmedia, warc
from spotlattice.llm.util import fresh_path, id_remainder, n_words, stored, table

#: The key of the surrogates in the queries and the pipeline: not a secret. Whoever replaces real data gives a key of their own.
SURROGATE_KEY = "public key of the synthetic tables"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with its personal data and secrets replaced, and the number of mentions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, secret=SURROGATE_KEY, count="n_mentions").select("doc_id", "text", "n_mentions")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-first backoff over every whole text; learns only from ids whose crc32 mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = langid.train_model(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of 2,048 words; no bin has two equal texts or two documents of one source."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC files in the shared folder, and return what the archives hold."""
    root = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS owner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN owner > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner > page_id THEN owner END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND payload_bytes >= 1000
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-ensemble quality of every whole text; learns labels only from ids whose crc32 mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    model = quality.train(docs, labels)
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a transport stream and back: what is returned is read from the stored stream."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    info = tsmedia.media_features(tsmedia.with_media(docs)).select("doc_id", "n_bytes", "media_info.*")
    last = F.try_element_at("pts", F.lit(-1))
    feature = F.format_string("pes=%d;last_pts=%d;access=%d;last_access=%d", F.size("pts"), last, F.size("access_points"), F.try_element_at("access_points", F.lit(-1)))
    return info.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 5, 2, 1 takes of each document, and in which of the splitting tree's 16 shards."""
    text = F.col("text")
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(text).alias("words"), F.xxhash64(text).alias("text")), "words")
    return mixing.taken_words(mixing.mix(docs, size="words")).withColumn("target", F.round("target", 6))


def _tree_sql(shards: int = 16) -> str:
    """The levels t1, t2, ... of the splitting tree over the blocks t0(k, block, lo, hi)."""
    step = """t{n} AS (SELECT k, block, CASE WHEN r <= (n * (mid - lo)) // (hi - lo) THEN lo ELSE mid END AS lo, CASE WHEN r <= (n * (mid - lo)) // (hi - lo) THEN mid ELSE hi END AS hi FROM (
  SELECT *, (lo + hi) // 2 AS mid, count(*) OVER (PARTITION BY lo, hi) AS n, row_number() OVER (PARTITION BY lo, hi ORDER BY md5('7:{level}:' || k || ':' || block), k, block) AS r FROM t{level}))"""
    return ",\n".join(step.format(n=i + 1, level=i) for i in range((shards - 1).bit_length()))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS w FROM s),
f AS (SELECT *, cap::DOUBLE / w AS fill FROM w),
p AS (SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS tw,
             coalesce(sum(cap) OVER o, 0) AS cb, coalesce(sum(w) OVER o, 0) AS wb FROM f
      WINDOW o AS (ORDER BY fill, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, fill * (tw - wb)::DOUBLE <= (t - cb)::DOUBLE AS capped FROM p),
r AS (SELECT *, t - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS rest,
             tw - sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS rest_w FROM c),
g AS (SELECT k, source_size, t, CASE WHEN capped THEN cap::DOUBLE ELSE rest::DOUBLE * w / nullif(rest_w, 0) END AS target FROM r),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS goal, greatest(1, ceil(t::DOUBLE / 512)::BIGINT) AS bw FROM g),
t0 AS (SELECT k, unnest(range(goal // bw + 1))::BIGINT AS block, 0 AS lo, 16 AS hi FROM q WHERE goal > 0),
{_tree_sql()},
quota AS (SELECT k, lo AS shard, count(*) AS n FROM t4 GROUP BY ALL),
slots AS (SELECT k, shard, row_number() OVER (PARTITION BY k ORDER BY shard) AS r FROM quota, unnest(range(n)) AS j(i)),
dealt AS (SELECT b.k, b.block, shard FROM (SELECT k, block, row_number() OVER (PARTITION BY k ORDER BY md5('7:deal:' || k || ':' || block), block) AS r FROM t0) b JOIN slots USING (k, r)),
x AS (SELECT d.*, row_number() OVER o AS rank, coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d WINDOW o AS (PARTITION BY k ORDER BY h, doc_id)),
y AS (SELECT x.doc_id, x.k, x.rank, x.size, x.start, q.source_size, q.target, q.goal, q.bw, q.goal // greatest(q.source_size, 1) AS whole, q.goal % greatest(q.source_size, 1) AS rem FROM x JOIN q USING (k)),
z AS (SELECT k, rank, least((pass * source_size + start) // bw, goal // bw) AS block, CASE WHEN pass < whole THEN size ELSE greatest(0, least(size, rem - start)) END AS words FROM y, unnest(range(whole + 1)) AS p(pass)),
v AS (SELECT k, rank, shard, sum(words)::BIGINT AS words FROM z JOIN dealt USING (k, block) WHERE words > 0 GROUP BY ALL),
u AS (SELECT k, rank, sum(words)::BIGINT AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS by_shard FROM v GROUP BY ALL)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0) AS taken, coalesce(by_shard, '') AS by_shard FROM y LEFT JOIN u USING (k, rank)
"""


def op8_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph sketches of every text and its edited text, compared by peeling."""
    return iblt.compare_with_edited(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by proportional stratified interleaving."""
    out = sharding.interleave(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksums of the texts by the table of the reflected polynomial.
OP9_SQL = r"""
WITH RECURSIVE bits(b, k, v) AS (SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, row_number() OVER () AS row, encode(coalesce(text, '')) AS bytes, md5('11:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, (octet_length(bytes) + 16)::BIGINT AS size, h,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS text_crc32 FROM d, tab),
f AS (SELECT *, (2 * (row_number() OVER (PARTITION BY k ORDER BY h, doc_id, text_crc32) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY k)) AS f, count(*) OVER () AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY f, k, h, doc_id, text_crc32) - 1 AS pos FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((pos * 40) // n)::INT AS shard, pos - ((pos * 40) // n * n + 39) // 40 AS slot, NULL::INT AS grown_shard FROM p
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles reach a Jaccard similarity of 0.9."""
    return jaccard.link_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS t(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT i, j FROM c JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(i, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.i)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT i AS doc_id, min(root) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""


QUERIES = {"op1_pii_surrogates": op1_pii_surrogates, "op2_language_id": op2_language_id, "op3_best_fit_packing": op3_best_fit_packing, "op4_warc": op4_warc, "op5_quality": op5_quality, "op6_transport_stream": op6_transport_stream, "op7_mixing": op7_mixing, "op8_iblt_fingerprint": op8_iblt_fingerprint, "op9_sharding": op9_sharding, "op10_jaccard_join": op10_jaccard_join}
ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op7_mixing": OP7_SQL, "op9_sharding": OP9_SQL, "op10_jaccard_join": OP10_SQL}
