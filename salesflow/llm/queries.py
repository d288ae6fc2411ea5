"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm import (
    centroid_clusters, chat_format, decontaminate, domain_score, embedding_links, exact_dedup, language_id, line_dedup,
    mixing, private_spans, simhash, spelling, token_files,
)

END_ID = 2
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, sf_dir, "documents"))


def op6_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans.private_report(_table(spark, sf_dir, "documents"))


def op9_domain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that ``labels`` calls of good quality and not toxic."""
    good = _table(spark, sf_dir, "labels").filter("quality = 1 and coalesce(toxic, 0) = 0")
    return domain_score.score_words(_table(spark, sf_dir, "documents"), good.select("doc_id"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
                                    "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_chats(rows.unionByName(control)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"), min_points=10)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, max_bits=3)


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_embeddings(_table(spark, sf_dir, "embeddings"), min_cosine=0.9)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), min_points=6, min_count=5, ratio=5, typo_every=199)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_private_spans": op6_private_spans,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_domain_score": op9_domain_score,
    "op10_chat_format": op10_chat_format,
    "op11_embedding_links": op11_embedding_links,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_spelling": op13_spelling,
}

# The contracts' white space and A-Z lower-casing, as DuckDB text.
_WHITE = r"[\x20\x09-\x0D]"
_STRIP = f"regexp_replace({{}}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The chat template, and what its escapes do to a text.
_ESCAPED = "replace(replace({}, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l')"



def _clusters_sql(rounds: int) -> str:
    """The rounds unrolled: p holds (vec, d, v), c0 the first centroids, c1, c2, ... those after each round."""
    def nearest(i: int) -> str:
        return (f"a{i} AS (SELECT vec, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (SELECT vec, c, sum((p.v - m.v) * "
                f"(p.v - m.v)) AS dist FROM p JOIN c{i} m USING (d) GROUP BY vec, c) GROUP BY vec)")

    steps = [f"""{nearest(i)},
s{i} AS (SELECT c, d, floor_div(sum(p.v), count(*)) AS v FROM a{i} JOIN p USING (vec) GROUP BY c, d),
c{i + 1} AS (SELECT c, d, coalesce(s{i}.v, o.v) AS v FROM c{i} o LEFT JOIN s{i} USING (c, d))""" for i in range(rounds)]
    steps.append(nearest(rounds))
    return f"""
WITH k AS (SELECT row_number() OVER () AS vec, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS (SELECT vec, unnest(range(64)) AS d, floor(256 * unnest(embedding)::DOUBLE)::HUGEINT AS v FROM k),
f AS (SELECT vec, row_number() OVER (ORDER BY sha256('2:' || vec_id), vec) - 1 AS c FROM k),
c0 AS (SELECT c, d, v FROM f JOIN p USING (vec) WHERE c < 40),
{(", " + chr(10)).join(steps)},
g AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY c),
t AS (SELECT c, sum(dist) AS own FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, dist::BIGINT AS distance, own::BIGINT AS cluster_inertia,
       (SELECT sum(dist) FROM a{rounds})::BIGINT AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN k USING (vec) JOIN t USING (c) JOIN g USING (c)""".replace(
        "floor_div(sum(p.v), count(*))", "((sum(p.v) - ((sum(p.v) % count(*)) + count(*)) % count(*)) // count(*))")


ORACLES = {
    "op11_embedding_links": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e,
  coalesce(len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
           AND len(list_filter(e, lambda x: x <> 0)) > 0, false) AS able FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.able AND b.able AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS m FROM v UNION SELECT l.w, r.m FROM r JOIN l ON l.u = r.vec_id),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.u = c.vec_id""",
    "op12_centroid_clusters": _clusters_sql(5),
    # crc32 is taken byte by byte over its table; near words share what is left when a code point goes.
    "op13_spelling": f"""
WITH RECURSIVE t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384)
                                   ELSE c // 2 END, n) ORDER BY n) AS crcs FROM range(256) AS b(n)),
r AS (SELECT doc_id, {_LOWER.format(r"unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+'))")} AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(
        flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda s:
                CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195::BIGINT, unicode(s)::BIGINT - 64] END)),
        lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295)) AS crc FROM g, t),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2)
                       ELSE run END AS word FROM h) GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
d AS (SELECT word, i, length(word) AS points, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.points = b.points
        AND a.word <> b.word
      UNION SELECT a.word, b.word FROM d a JOIN w b ON a.rest = b.word
      UNION SELECT b.word, a.word FROM d a JOIN w b ON a.rest = b.word),
p AS (SELECT e.word, count(*) AS n_near, max(v.n) AS top, arg_min(near, (-v.n, near)) AS best
      FROM e JOIN w v ON v.word = e.near GROUP BY e.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN best END AS form,
             CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM w LEFT JOIN p USING (word)),
o AS (SELECT word, word AS root FROM f UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.root
      WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f
JOIN (SELECT o.word, o.root FROM o JOIN f ON f.word = o.root WHERE f.form IS NULL) USING (word)""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, 2.0 * sum(size)::DOUBLE AS cap,
             (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
-- pour the pool: sources fill up in order of cap by weight; the level is that of the first which does not
p AS (SELECT *, 1.5 * sum(source_size) OVER () AS pool, sum(weight) OVER () AS weights,
             coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before
      FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (pool - cap_before) / (weights - weight_before) AS level FROM p),
o AS (SELECT arg_min(level, weight_before) AS level FROM l WHERE level * weight < cap),
t AS (SELECT l.source, source_size, least(cap, coalesce(o.level * weight, cap)) AS target,
             ('0x' || substr(md5('42:' || CASE WHEN source IS NULL THEN '1' ELSE '0' || source END), 1, 8))::BIGINT
               / 4294967296.0::DOUBLE AS u
      FROM l LEFT JOIN o ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, substr(digest, 1, 3), doc_id NULLS LAST,
                                   digest)::DOUBLE AS nth FROM d),
c AS (SELECT doc_id, size, source_size, target,
             CASE WHEN source_size > 0 THEN least(floor(u + target / source_size * nth) - floor(u + target / source_size * (nth - 1)),
                                                  ceil(target / source_size)) ELSE 0 END AS copies
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken FROM c""",
    "op10_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, n, role, chr(92) || '### Assistant: </turn> ok'
           FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, role)),
e AS (SELECT *, {_ESCAPED.format('text')} AS body,
             replace(replace({_ESCAPED.format('role')}, '>', chr(92) || 'g'), chr(10), chr(92) || 'n') AS head FROM c),
a AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length('<turn ') + length(head) + 2 + length(body) + 9) AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM a""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(norm) AS text_sha256
FROM g""",
    "op7_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM d),
k AS (SELECT doc_id, n, line, {_LOWER.format(_STRIP.format('line'))} AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, n, line, first_id IS NOT NULL AND k.doc_id <> first_id AS gone
      FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
}
