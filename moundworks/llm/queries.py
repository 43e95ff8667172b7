"""The registered text queries: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from moundworks.llm import bpe, decontamination, extraction, language, licences, merkle, quality, resampling, sharding, simhash, substrings, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8
#: File of the installed public_tokenizers package.
TOKENIZER = "byte_bpe_50k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out("doc_id", 3, 1)))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_words(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = language.held_out("doc_id", 5, 0)
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_items=False)


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents")).drop("spans")


@query
def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("body")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, unnest(range(0, 35)) AS t(k)),
words AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES["op7_decontamination"] = r"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS s, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
        FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, s, array_to_string(w[i:i + s - 1], ' ') AS x
       FROM d, (SELECT DISTINCT s FROM win), unnest(range(1, len(w) - s + 2)) AS t(i)),
occ AS (SELECT doc_id, i, s, item_id FROM dw JOIN win USING (x, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + s)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(n, ',' ORDER BY n) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS n FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

ORACLES["op9_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
             min(page_id) OVER (PARTITION BY sha256(h)) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND low <> page_id THEN low END AS refers_to
FROM s"""

#: CRC-32 of the UTF-8 bytes of text ``x``, bit by bit: each byte is mixed in, then eight steps follow.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(0, strlen({x})),
    lambda i: [CAST('0x' || substr(hex({x}), CAST(2 * i + 1 AS INT), 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, leaf, now, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
               CASE WHEN {CRC32.format(x="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS now
        FROM documents)),
grown AS (
  SELECT source, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM grown WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
subroots AS (
  SELECT source, lvl AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM grown WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
below AS (
  SELECT source, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM grown WHERE n > 1 GROUP BY ALL),
beside AS (
  SELECT lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT doc_id, leaf, now, lvl, pos // CAST(pow(3, lvl) AS BIGINT) % 3 AS i, hs
  FROM leaves JOIN below ON leaves.source IS NOT DISTINCT FROM below.source AND run = pos // CAST(pow(3, lvl + 1) AS BIGINT)
  UNION ALL
  SELECT doc_id, leaf, now, height + lvl, s.pos // CAST(pow(3, lvl) AS BIGINT) % 3, hs
  FROM leaves JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source JOIN beside ON run = s.pos // CAST(pow(3, lvl + 1) AS BIGINT)),
paths AS (
  SELECT doc_id, leaf, now, lvl, array_to_string(hs[1:i], '') AS l, array_to_string(hs[i + 2:], '') AS r FROM steps),
folded AS (
  SELECT doc_id, leaf, now AS h, 0 AS lvl FROM leaves
  UNION ALL
  SELECT f.doc_id, f.leaf, sha256(l || h || r), f.lvl + 1 FROM folded f JOIN paths p ON f.doc_id = p.doc_id AND f.leaf = p.leaf AND f.lvl = p.lvl),
ended AS (SELECT doc_id, leaf, max_by(h, lvl) AS folded_root FROM folded GROUP BY ALL),
proofs AS (SELECT doc_id, leaf, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256 FROM paths GROUP BY ALL)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM leaves JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source JOIN (SELECT h FROM top WHERE n = 1) t ON true
JOIN ended USING (doc_id, leaf) LEFT JOIN proofs USING (doc_id, leaf)"""

ORACLES["op13_importance_resampling"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x
  FROM benchmark),
dw AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
bw AS (SELECT x, count(*) AS n FROM b GROUP BY x),
cells AS (SELECT x, {CRC32.format(x="x")} % 10000 AS c FROM (SELECT DISTINCT x FROM (SELECT x FROM dw UNION ALL SELECT x FROM bw))),
raw AS (SELECT c, sum(n) AS s FROM dw JOIN cells USING (x) GROUP BY c),
aim AS (SELECT c, sum(n) AS t FROM bw JOIN cells USING (x) GROUP BY c),
gain AS (
  SELECT c, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM raw) + 10000) AS DOUBLE)
                                 / CAST((s + 1) * ((SELECT coalesce(sum(t), 0) FROM aim) + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM raw LEFT JOIN aim USING (c)),
weights AS (SELECT doc_id, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM dw JOIN cells USING (x) JOIN gain USING (c) GROUP BY doc_id),
scores AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scores LEFT JOIN drawn USING (doc_id)"""

#: For pages whose article is one well-formed element of headings and paragraphs, as all given ones are.
ORACLES["op12_html_extraction"] = r"""
WITH parts AS (
  SELECT page_id, url, generate_subscripts(p, 1) AS i, unnest(p) AS x
  FROM (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS p FROM pages)),
texts AS (
  SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
         '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS x FROM parts),
joined AS (SELECT page_id, url, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (x <> ''), '') AS text FROM texts GROUP BY ALL)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined"""
