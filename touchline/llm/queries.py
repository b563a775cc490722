"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import codes, embeddings, lines, merkle, mixing, packing, quality, sharding, simhash, store, substring, topk, toxicity
from touchline.llm.common import table_path

#: Bytes of text in a shard: so few that small tables split too.
SHARD_BYTES = 128 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.selected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", F.col("_score").alias("log_weight"), F.col("_key").alias("gumbel_key"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-store")
    store.write(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=0)
    store.verify(spark, path)
    return store.digests(spark, path)


def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    learn = table(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.score(table(spark, sf_dir, "documents"), learn, threshold=0.7)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "offending")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return substring.remove_repeats(docs, window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most=2)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    tampered = F.when(~odd, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents"), text_now=tampered))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean(table(spark, sf_dir, "documents")).drop("kept_text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_best_fit_packing, op2_quality_resampling, op3_exact_top_k, op4_extendible_sharding, op5_token_store, op6_toxicity_mil, op7_substring_dedup, op8_simhash_near_dedup, op9_source_mixing, op10_embedding_near_dedup, op11_merkle_manifest, op12_vector_codes, op13_line_rules, pipeline)
    return {f.__name__: f for f in own}


OP3 = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_sql(limit: int) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), l AS (
  SELECT d.*, depth, h >> (60 - depth) AS prefix
  FROM d CROSS JOIN (SELECT unnest(range(0, 25))::INTEGER AS depth)
), s AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM l GROUP BY depth, prefix
  HAVING sum(n_bytes) <= {limit} OR count(*) = 1
), f AS (
  SELECT l.doc_id, l.n_bytes, l.depth, l.prefix, s.shard_bytes, l.h,
         row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS r
  FROM l JOIN s USING (depth, prefix)
)
SELECT doc_id, n_bytes, depth, prefix,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, shard_bytes
FROM f WHERE r = 1
"""


OP7 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS pos FROM d
), h AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS m FROM p WHERE pos + 34 <= len(w)
), t AS (
  SELECT m FROM h GROUP BY m HAVING count(*) > 1
), r AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS i FROM h JOIN t USING (m)
), g AS (
  SELECT doc_id, count(*) AS n_removed, list(i) AS gone FROM r GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS most FROM s
), c AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(most) OVER b, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT total, used, weights FROM c WHERE weight * (total - used) / weights <= most ORDER BY most / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT c.source, source_size, n, coalesce(least(weight * (l.total - l.used) / l.weights, most::DOUBLE), most::DOUBLE) AS target FROM c LEFT JOIN l ON true
), q AS (
  SELECT source, seat, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source NULLS LAST) AS r
  FROM (SELECT source, target, unnest(range(1, ceil(source_size * 2 / 256)::BIGINT + 1)) AS seat FROM t) WHERE target > 0
), p AS (
  SELECT t.*, (SELECT count(*) FROM q WHERE q.source IS NOT DISTINCT FROM t.source AND r <= (SELECT round(sum(target) / 256) FROM t)) AS quota FROM t
), x AS (
  SELECT rid, doc_id, d.source, size, source_size, target, quota, h, h % ceil(n / 4000)::BIGINT AS shard
  FROM (SELECT *, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size), 1, 15))::BIGINT AS h FROM d) d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), k AS (
  SELECT source, shard, sum(size)::BIGINT AS cell, any_value(quota) AS source_quota FROM x GROUP BY source, shard
), ks AS (
  SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY cell::DOUBLE / (2 * seat - 1) DESC, shard) AS r
  FROM (SELECT *, unnest(range(1, ceil(cell * 2 / 256)::BIGINT + 1)) AS seat FROM k) WHERE cell > 0
), kq AS (
  SELECT k.*, (SELECT count(*) FROM ks WHERE ks.source IS NOT DISTINCT FROM k.source AND ks.shard = k.shard AND r <= ks.source_quota) AS quota FROM k
), b AS (
  SELECT source, shard, quota, block, row_number() OVER (PARTITION BY source, shard ORDER BY ('0x' || substr(md5('mix-blocks|' || coalesce(source, 'null') || '|' || shard || '|' || block), 1, 15))::BIGINT, block) AS r
  FROM (SELECT *, unnest(range(0, ceil(cell * 2 / 256)::BIGINT)) AS block FROM kq)
), o AS (
  SELECT rid, x.source, x.shard, size, coalesce(sum(size) OVER (PARTITION BY x.source, x.shard ORDER BY h, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x
), y AS (
  SELECT rid, o.source, o.shard, size, pos + copy * cell AS a FROM o JOIN k ON o.source IS NOT DISTINCT FROM k.source AND o.shard = k.shard CROSS JOIN range(0, 2) r(copy) WHERE size > 0
), g AS (
  SELECT rid, sum(least(a + size, (y.block + 1) * 256) - greatest(a, y.block * 256))::BIGINT AS taken
  FROM (SELECT *, unnest(range((a // 256)::BIGINT, ((a + size - 1) // 256)::BIGINT + 1)) AS block FROM y) y JOIN b ON y.source IS NOT DISTINCT FROM b.source AND y.shard = b.shard AND y.block = b.block AND b.r <= b.quota
  GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM x LEFT JOIN g USING (rid)
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), c AS (
  SELECT vec_id AS node, vec_id AS reach FROM v
  UNION
  SELECT l.b, c.reach FROM c JOIN l ON c.node = l.a
), m AS (
  SELECT node AS vec_id, min(reach) AS component_id FROM c GROUP BY node
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN m USING (vec_id)
"""


OP11 = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text, replace(text, chr(10), '') AS changed FROM documents
), f AS (
  SELECT rid, doc_id, source,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id::VARCHAR, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars::VARCHAR, '-') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, coalesce(octet_length(encode(changed)) || ':' || changed, '-') AS changed_body
  FROM d
), bits AS (
  SELECT n, 0 AS k, n::UINTEGER AS v FROM (SELECT unnest(range(0, 256)) AS n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT n, v FROM bits WHERE k = 8
), ids AS (
  SELECT rid, doc_id::VARCHAR AS s FROM d WHERE doc_id IS NOT NULL
), r AS (
  SELECT rid, s, 0 AS k, 4294967295::UINTEGER AS v FROM ids
  UNION ALL
  SELECT rid, s, r.k + 1, xor(r.v >> 8, crc.v) FROM r JOIN crc ON crc.n = xor(r.v & 255, ord(s[r.k + 1])::UINTEGER) & 255 WHERE r.k < length(s)
), even AS (
  SELECT rid FROM r WHERE k = length(s) AND xor(v, 4294967295::UINTEGER) % 2 = 0
), l AS (
  SELECT f.rid, doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN even.rid IS NULL THEN body ELSE changed_body END) AS now FROM f LEFT JOIN even USING (rid)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l
), t AS (
  SELECT source, 0 AS level, i, leaf AS h, n FROM p
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, i // 3, n
), s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, i, subroot AS h, n FROM s
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3, n
), a AS (
  SELECT rid, source, 0 AS level, i, n, now AS fold, '' AS proof FROM p
  UNION ALL
  SELECT a.rid, a.source, a.level + 1, a.i // 3, (a.n + 2) // 3, sha256(string_agg(CASE WHEN t.i = a.i THEN a.fold ELSE t.h END, '' ORDER BY t.i)),
         a.proof || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> a.i), '')
  FROM a JOIN t ON t.source IS NOT DISTINCT FROM a.source AND t.level = a.level AND t.i // 3 = a.i // 3 WHERE a.n > 1
  GROUP BY a.rid, a.source, a.level, a.i, a.n, a.fold, a.proof
), b AS (
  SELECT rid, 0 AS level, s.i, s.n, fold, proof FROM a JOIN s ON s.source IS NOT DISTINCT FROM a.source WHERE a.n = 1
  UNION ALL
  SELECT b.rid, b.level + 1, b.i // 3, (b.n + 2) // 3, sha256(string_agg(CASE WHEN u.i = b.i THEN b.fold ELSE u.h END, '' ORDER BY u.i)),
         b.proof || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> b.i), '')
  FROM b JOIN u ON u.level = b.level AND u.i // 3 = b.i // 3 WHERE b.n > 1
  GROUP BY b.rid, b.level, b.i, b.n, b.fold, b.proof
)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(b.proof) AS proof_sha256, b.fold AS folded_root, b.fold = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN b ON b.rid = p.rid AND b.n = 1
"""


def op12_sql(rounds: int) -> str:
    """The rounds of Lloyd one after the other, each from all assignments."""
    floor = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = ""
    for r in range(rounds + 1):
        steps += f""", k{r} AS MATERIALIZED (
  SELECT rid, part, min(d * 256 + entry) // 256 AS d, (min(d * 256 + entry) % 256)::INTEGER AS entry
  FROM (SELECT v.rid, v.part, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM v JOIN b{r} b USING (part)) GROUP BY rid, part
)"""
        if r < rounds:
            steps += f""", b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(x ORDER BY pos) AS x FROM (
      SELECT part, entry, pos, ({floor})::BIGINT AS x FROM (SELECT k.part, k.entry, unnest(v.x) AS x, unnest(range(len(v.x))) AS pos FROM k{r} k JOIN v USING (rid, part)) GROUP BY part, entry, pos
    ) GROUP BY part, entry) n USING (part, entry)
)"""
    return f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), o AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS rid FROM e
), v AS MATERIALIZED (
  SELECT rid, part, x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS x FROM o CROSS JOIN (SELECT unnest(range(4)) AS part)
), b0 AS MATERIALIZED (
  SELECT part, rid AS entry, x FROM v WHERE rid < 256
){steps}, c AS (
  SELECT rid, string_agg(lower(lpad(hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM k{rounds} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN o USING (rid)
"""


OP13_WORDS = r"list_filter(regexp_split_to_array(%s, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {OP13_WORDS % "coalesce(text, '')"} AS w FROM documents
), l AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), m AS (
  SELECT rid, line, {OP13_WORDS % "line"} AS w FROM l
), n AS (
  SELECT rid, line, w, len(w) AS n,
         len(list_filter(w, lambda x: regexp_matches(x, '[.!?…。！？؟।]["''”’»)\]]*$'))) AS stops,
         len(list_filter(w, lambda x: regexp_matches(x, '([!?]{{2,}}|[#*$%&|<>]{{2,}})["''”’»)\]]*$'))) AS noise,
         len(list_filter(w, lambda x: regexp_full_match(x, '[|<>»«·•/\x5C–—-]+'))) AS separators,
         len(list_filter(w, lambda x: NOT regexp_full_match(x, '[!-/:-@\[-`{{-~]*(home|menu|login|logout|next|previous|back|top|search|share|print|contact|about|help|sitemap|archive|categories|tags|more)[!-/:-@\[-`{{-~]*', 'i'))) AS others,
         regexp_matches(line, 'all rights reserved|privacy policy|terms of use|terms of service|cookie|javascript|released under|licensed under|permission is hereby granted|copyright ©|subscribe to our|click here|lorem ipsum', 'i') AS stock
  FROM m WHERE len(w) > 0
), g AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(n) FILTER (stops = 0 OR noise > 0.2::DOUBLE * n OR separators > greatest(1, 0.1::DOUBLE * n) OR (n <= 8 AND others = 0) OR (n <= 60 AND stock)), 0)::BIGINT AS lost_words
  FROM n GROUP BY rid
), p AS (
  SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2
), q AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM p
), r AS (
  SELECT rid, count(DISTINCT pos)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM q WHERE c > 1) GROUP BY rid
), a AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN g USING (rid) LEFT JOIN r USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= 0.5 * n_words AS kept FROM a
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": OP3, "op4_extendible_sharding": op4_sql(SHARD_BYTES), "op7_substring_dedup": OP7, "op9_source_mixing": OP9, "op10_embedding_near_dedup": OP10, "op11_merkle_manifest": OP11, "op12_vector_codes": op12_sql(4), "op13_line_rules": OP13}
