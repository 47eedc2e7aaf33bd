"""The registered corpus queries, one per operator, and their reference SQL for DuckDB."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelake.llm import decontam, langid, merkle, neardup, pieces, pii, quality, ranked, substring, suffixes, tokencount, tokenids, urlfilter
from pipelake.llm.common import ascii_lower, table

URL_RULES = (
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)
#: A host is listed when one of its name parts (between dots and hyphens) is one of these.
LISTED_HOST_PARTS = r"(^|[.-])(spam|bets|casino|pills|loans|warez)([.-]|$)"


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, F.col("key").rlike(LISTED_HOST_PARTS))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = rf"""
WITH s AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
r AS (SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM s),
p AS (SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT page_id, max_by(h || rules.p, length(h || rules.p)) AS rule, max_by(action, length(h || rules.p)) AS action
        FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(host, '{LISTED_HOST_PARTS}') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i:i+7] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY doc_id),
m AS (SELECT doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        len(string_split(t, chr(10))) AS n_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed
         OR word_chars > 25 * n_words OR word_chars < 2 * n_words
         OR n_symbols * 10 > n_words
         OR n_dup_lines * 2 > n_lines
         OR len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) * 10 < n_words * 6
         OR len(regexp_extract_all(t, '(?m)(\.\.\.|…)[\x20\x09\x0D]*$')) * 10 > n_lines * 3
         OR len(regexp_extract_all(t, '(?m)^[\x20\x09]*[-*•]')) * 10 > n_lines * 9
         OR len(regexp_extract_all(t, '!!')) * 4 > n_words) AS kept
FROM b
"""


#: Folder of the public vocabulary files; set it where they are elsewhere.
TOKENIZER_DIR = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, f"{TOKENIZER_DIR}/word_bpe_49k.json").select("doc_id", "n_words", "n_tokens")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(f"{TOKENIZER_DIR}/byte_bpe_50k.json", encoding="utf-8") as file:
        model = file.read()
    segments = tokenids.encode_documents(table(spark, sf_dir, "documents"), model)
    return tokenids.read_documents(tokenids.write_segments(segments))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws]
               ELSE list_transform(range(1, len(ws)), lambda i: ws[i:i + 1]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 12] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM g) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r),
k AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws
              ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeated_strings(table(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as two hex digits each; strings are cut from segments of 400 starts, which is quicker than from a long text.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT doc_id, b, h[2 * b + 1:2 * b + 998] AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 400)) AS b FROM d WHERE len(h) >= 200)),
g AS (SELECT doc_id, b + i AS i, h[2 * i - 1:2 * i + 198] AS s FROM (SELECT doc_id, b, h, unnest(range(1, least(400, len(h) // 2 - 99) + 1)) AS i FROM z)),
f AS (SELECT s, min({'d': doc_id, 'i': i}) AS m FROM g GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM g JOIN f USING (s) WHERE {'d': doc_id, 'i': i} > m),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY ALL),
q AS (SELECT doc_id, h, coalesce(k, 0) AS k, coalesce(lag(b) OVER w, 1) AS a, a AS b, lead(a) OVER w IS NULL AS final, b AS e
      FROM d LEFT JOIN p USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
c AS (SELECT doc_id, any_value(h) AS h, count(b) AS n_spans, coalesce(sum(e - b), 0) AS n_removed,
        string_agg(CASE WHEN b IS NULL THEN h ELSE h[2 * a - 1:2 * b - 2] || CASE WHEN final THEN h[2 * e - 1:] ELSE '' END END, '' ORDER BY k) AS kept
      FROM q GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM c
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


OP12_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qc AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, a GROUP BY term),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM n, a),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM qc JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = merkle.leaf_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in columns])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = merkle.build(docs, columns=columns, carry={"claimed": F.when(tampered, altered)}).leaves
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("path"))
    return leaves.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


_PARENTS_SQL = "list_transform(range((len(l) + 7) // 8), lambda i: sha256(array_to_string(l[8 * i + 1:8 * i + 8], '')))"
#: crc32 (reflected, polynomial EDB88320) of the decimal id, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
        lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295))"""
_STEP_SQL = """SELECT f.doc_id, f.leaf, f.claimed, f.lang, {up} f.p // 8, f.k + 1,
        sha256(array_to_string(list_concat(r[1:f.p % 8], [f.orig], r[f.p % 8 + 2:8]), '')),
        sha256(array_to_string(list_concat(r[1:f.p % 8], [f.claim], r[f.p % 8 + 2:8]), '')),
        f.proof || array_to_string(list_concat(r[1:f.p % 8], r[f.p % 8 + 2:8]), '')"""
OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
        CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claimed FROM documents),
lv(lang, k, l) AS (SELECT lang, 0, list(leaf ORDER BY doc_id NULLS FIRST, leaf) FROM d GROUP BY lang
        UNION ALL SELECT lang, k + 1, {_PARENTS_SQL} FROM lv WHERE len(l) > 1),
sub AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS p FROM lv WHERE len(l) = 1),
tv(k, l) AS (SELECT 0, list(subroot ORDER BY p) FROM sub UNION ALL SELECT k + 1, {_PARENTS_SQL} FROM tv WHERE len(l) > 1),
f(doc_id, leaf, claimed, lang, p, k, orig, claim, proof) AS (
  SELECT doc_id, leaf, claimed, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1, 0, leaf, coalesce(claimed, leaf), '' FROM d
  UNION ALL
  {_STEP_SQL.format(up="")} FROM (SELECT f.*, l[8 * (f.p // 8) + 1:8 * (f.p // 8) + 8] AS r FROM f JOIN lv ON lv.lang IS NOT DISTINCT FROM f.lang AND lv.k = f.k AND len(l) > 1) f),
e AS (SELECT f.*, subroot, sub.p AS q FROM f JOIN sub ON sub.lang IS NOT DISTINCT FROM f.lang JOIN lv ON lv.lang IS NOT DISTINCT FROM f.lang AND lv.k = f.k AND len(l) = 1),
g(doc_id, leaf, claimed, lang, subroot, p, k, orig, claim, proof) AS (
  SELECT doc_id, leaf, claimed, lang, subroot, q, 0, orig, claim, proof FROM e
  UNION ALL
  {_STEP_SQL.format(up="f.subroot,")} FROM (SELECT g.*, l[8 * (g.p // 8) + 1:8 * (g.p // 8) + 8] AS r FROM g JOIN tv ON tv.k = g.k AND len(l) > 1) f)
SELECT doc_id, leaf, subroot, l[1] AS root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = l[1] AS verified
FROM g JOIN tv ON tv.k = g.k AND len(l) = 1
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, n, ws[i:i + n - 1] AS s FROM (
        SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0))),
lengths AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS s FROM (
        SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN lengths ON len(ws) >= n)),
h AS (SELECT doc_id, item_id, i, p.n FROM p JOIN g ON p.n = g.n AND p.s = g.s),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in ("email", "ip", "card", "phone")],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.PieceModel.read(f"{TOKENIZER_DIR}/piece_bpe_32k.model")
    decoded = pieces.encode(table(spark, sf_dir, "documents"), model, decoded=True)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


def queries() -> dict:
    found = {}
    for name, value in globals().items():
        if name.startswith("op") and name[2:3].isdigit() and callable(value):
            found[name] = value
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in queries() if (sql := globals().get(f"{name.split('_')[0].upper()}_SQL"))}
