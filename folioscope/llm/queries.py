"""The operators applied to the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import table
from folioscope.llm.op3_licenses import oracle_sql as op3_licenses_sql

# A checksum in SQL: the table's 256 entries by eight shifts each, then one step a byte.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda j: CAST(ascii(CAST(doc_id AS VARCHAR)[j]) AS BIGINT))),
  lambda s, c: xor(s >> 8, list_reduce(list_prepend(xor(s, c) & 255, range(8)), lambda t, _: CASE WHEN t % 2 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END))))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    from folioscope.llm.op1_mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(max(size) AS BIGINT) AS longest FROM sized GROUP BY source),
s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         source_size * 2 AS cap FROM s0),
s2 AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS full_at,
         least(CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE, CAST(sum(cap) OVER () AS DOUBLE)) AS budget FROM s1),
s3 AS (
  SELECT *, (budget - CAST(coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS v FROM s2),
s4 AS (SELECT *, coalesce(max(CASE WHEN v <= full_at THEN v END) OVER (), max(full_at) OVER ()) AS level FROM s3),
targets AS (SELECT source, source_size, weight, budget, level, least(weight * level, CAST(cap AS DOUBLE)) AS target FROM s4),
served AS (
  SELECT z.doc_id, z.size, z.key, t.*, CAST(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS words
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, key, size, budget, level, CAST(words + c.copy * source_size AS DOUBLE) / weight AS finish FROM served, (VALUES (0), (1)) c(copy) WHERE size > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, key ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT doc_id, key, CAST(sum(size) AS BIGINT) AS taken FROM ordered WHERE total <= budget GROUP BY doc_id, key)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(t.taken, 0) AS taken
FROM served s LEFT JOIN taken t ON s.key = t.key
"""


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, by near-equal bytes."""
    from folioscope.llm.op4_sharding import shard

    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document when passages of 50 words stay in their first document alone."""
    from folioscope.llm.op9_substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL["op9_substrings"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM d),
g AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS passage FROM s),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY passage) < doc_id AS again FROM g),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
k AS (
  SELECT w.doc_id, w.word, w.pos,
         coalesce(bool_or(f.again) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS removed
  FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.pos = f.pos),
r AS (SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and near-duplicate component."""
    from folioscope.llm.op10_simhash import hex_of, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: by pattern, and by character models on top."""
    from folioscope.llm.op2_secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings in every document."""
    from folioscope.llm.op3_licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_licenses"] = op3_licenses_sql()


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    from folioscope.llm.op5_decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    from folioscope.llm.op8_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


ORACLE_SQL["op8_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-odds of keeping each document."""
    from folioscope.llm.op7_quality import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-model and n-gram scores of every document, a fifth of them held out."""
    from folioscope.llm.op6_lm import score_documents

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return score_documents(table(spark, sf_dir, "documents"), held_out)


@query
def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what the rendered text and the loss mask say of each."""
    from folioscope.llm.op11_chat import formatted, read_back, with_control_case

    return read_back(formatted(with_control_case(table(spark, sf_dir, "conversations")))).drop("n_tokens", "n_loss_tokens")


ORACLE_SQL["op11_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
e AS (
  SELECT *, replace(text, chr(92), chr(92) || chr(92)) AS doubled FROM t),
f AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(length(role) + length(doubled) + len(regexp_extract_all(text, '<(turn|says|/turn)>')) + 19) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM f
"""


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in a Merkle manifest, and whether it verifies as received: half of the texts arrive without line breaks."""
    from folioscope.llm.op12_manifest import manifest

    stripped = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.translate("text", "\n", ""))
    return manifest(table(spark, sf_dir, "documents"), stripped).withColumnRenamed("id", "doc_id")


ORACLE_SQL["op12_manifest"] = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS k, doc_id, source, text, CASE WHEN doc_id IS NULL THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS i, lang, CAST(n_chars AS VARCHAR) AS n,
         CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS got
  FROM (SELECT *, CRC AS crc FROM documents)),
l AS (
  SELECT k, doc_id, source,
         sha256(HEAD || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(HEAD || coalesce(strlen(got) || ':' || got, '-')) AS changed FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up AS (
  SELECT source, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY source, level, pos // 3),
sub AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3),
root AS (SELECT node AS root FROM top WHERE n = 1),
runs AS (
  SELECT source, level, pos, coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY source, level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY source, level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM up WHERE n > 1),
top_runs AS (
  SELECT level, pos, coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM top WHERE n > 1),
steps AS (
  SELECT p.k, 0 AS tree, r.level, r.a, r.b FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND r.pos = p.pos // CAST(pow(3, r.level) AS BIGINT)
  UNION ALL
  SELECT p.k, 1, r.level, r.a, r.b FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source JOIN top_runs r ON r.pos = s.pos // CAST(pow(3, r.level) AS BIGINT)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tree, level) AS step, count(*) OVER (PARTITION BY k) AS steps FROM steps),
proofs AS (SELECT k, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM numbered GROUP BY k),
fold AS (
  SELECT k, 0 AS step, changed AS node FROM placed
  UNION ALL
  SELECT fold.k, fold.step + 1, sha256(n.a || fold.node || n.b) FROM fold JOIN numbered n ON n.k = fold.k AND n.step = fold.step + 1),
ends AS (SELECT k, arg_max(node, step) AS folded_root FROM fold GROUP BY k)
SELECT p.doc_id, p.leaf, s.subroot, root.root, coalesce(proofs.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source JOIN ends e USING (k) LEFT JOIN proofs USING (k), root
""".replace("HEAD", " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("i", "source", "lang", "n"))).replace("CRC", _CRC32)


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's divergence from the others of its language, and its terms above the language's."""
    from folioscope.llm.op13_divergence import audit

    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3),
sizes AS (SELECT lang, count(*) AS kept FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM cell),
l0 AS (SELECT lang, term, sum(n) AS n FROM cell GROUP BY ALL),
l AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM l0),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - l.q) * (p.p - l.q)) // l.q AS BIGINT) AS value
          FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.n > 0 AND p.p > l.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
