"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.llm import ann, cap_filters, common, conversation_repair, exact_dedup, fill_middle, html_text, line_dedup, mixing, near_join, packing, quality, secrets, url_filter


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deletions(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"), capacity=1024)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = quality.quality_scores(docs.select("doc_id", "text", "n_chars"), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_sources(mixing.with_domain(docs))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_spans(secrets.scan_secrets(common.table(spark, sf_dir, "documents")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(common.table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(common.table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(common.table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(common.table(spark, sf_dir, "embeddings"))


def _weights_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in mixing.WEIGHTS.get(level, {}).items())
    return f"(CASE {level} {cases} ELSE 1.0 END)::DOUBLE" if cases else "1.0::DOUBLE"


def _level_sql(depth: int) -> str:
    """The budgets of one level of the tree: b0 has the root's, b1 those of domains, and so on."""
    nodes = mixing.LEVELS[: depth + 1]
    level, parents = nodes[-1], nodes[:-1]
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    by = f"{part} ORDER BY cap / w, {level}"
    above = f"JOIN b{depth} USING ({', '.join(parents)})" if parents else f", b{depth}"
    return f"""
n{depth} AS (SELECT {', '.join(nodes)}, sum(supply)::DOUBLE * 2 AS cap, any_value(b) AS b, {_weights_sql(level)} AS w
  FROM leaf {above} GROUP BY {', '.join(nodes)}),
l{depth} AS (SELECT *, (b - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM n{depth}),
b{depth + 1} AS (SELECT {', '.join(nodes)}, greatest(0, least(cap, w * max(l) OVER ({part}))) AS b FROM l{depth})"""


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) <> ''
         THEN 'domain' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4)::VARCHAR ELSE 'none' END AS domain,
    coalesce(len(regexp_extract_all(text, '[^ 	

]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM d GROUP BY ALL),
b0 AS (SELECT floor(sum(supply)::BIGINT * 0.6::DOUBLE) AS b FROM leaf),{",".join(map(_level_sql, range(3)))},
plan AS (SELECT domain, lang, source, supply, floor(b + 1e-6)::BIGINT AS budget FROM leaf JOIN b3 USING (domain, lang, source)),
e AS (SELECT *, CASE WHEN supply > 0 THEN least(budget // supply, 2) ELSE 0 END AS epochs FROM plan),
r AS (SELECT *, CASE WHEN epochs < 2 THEN budget - epochs * supply ELSE 0 END AS rest FROM e),
k AS (SELECT d.*, epochs, rest, md5('17:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM d JOIN r USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id NULLS FIRST, n_tokens
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens,
       (epochs + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""

OP8_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{common.UPPER}', '{common.UPPER.lower()}') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
h AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule
  FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

def _way(state: str, cost: str, edit: str, line: str = "''", when: str = "TRUE") -> str:
    """A way {c: cost, a: audit, r: lines, each after a newline} of OP11_SQL that goes on from one in a column; null if it can't."""
    return (
        f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {state}.r || {line}}} END"
    )


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_USER, _ASSISTANT, _NOW = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
#: After a run of inserts: t0 to t3, from the states s0 (start), s1 (after s), s2 (after u), s3 (after a).
_RUNS = f"""
  s0 AS t0, s1 AS t1,
  {_least("s2", _way("s0", "5", "I", _USER), _way("s1", "5", "I", _USER), _way("s3", "5", "I", _USER))} AS t2,
  {_least("s3", _way("s2", "5", "I", _ASSISTANT), *[_way(s, "10", "II", f"{_USER} || {_ASSISTANT}") for s in ("s0", "s1")])} AS t3"""
_KEPT = "solid AND NOT duplicate AND i0 = '{}'"
_EDITS = f"""
  {_way("t0", "2", "D")} AS s0,
  {_least(_way("t1", "2", "D"), _way("t0", "more", "K", _NOW, _KEPT.format("s")))} AS s1,
  {_least(_way("t2", "2", "D"), *[_way(t, "more", "K", _NOW, _KEPT.format("u")) for t in ("t0", "t1", "t3")],
          *[_way(t, "1 + more", "R", f"{_USER} || text", "solid AND NOT duplicate") for t in ("t0", "t1", "t3")])} AS s2,
  {_least(_way("t3", "2", "D"), _way("t2", "more", "K", _NOW, _KEPT.format("a")),
          _way("t2", "1 + more", "R", f"{_ASSISTANT} || text", "solid AND NOT duplicate"))} AS s3"""

OP11_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: unicode(key[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS kind
  FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crc WHERE kind <> 0),
sorted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         regexp_matches(text, '[^\x20\x09-\x0D]') AS solid, role[1] AS i0
  FROM damaged),
f AS (
  SELECT *, seen AND solid AS duplicate,
         solid AND NOT seen AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         lag(i0) OVER (PARTITION BY conv_id ORDER BY i) || i0 AS met
  FROM sorted),
turns AS (SELECT *, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM f),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0,
         {", ".join("CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS s" + str(k) for k in (1, 2, 3))}
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, i, {_EDITS}
  FROM (SELECT r.conv_id, r.i, role, text, i0, solid, duplicate, more, {_RUNS}
        FROM ways w JOIN turns r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(NOT solid) AS blank,
         count_if(duplicate) AS duplicate, count_if(cut) AS truncated, count_if(met NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM turns GROUP BY conv_id),
best AS (
  SELECT c.*, {_least("t0", "t3")} AS b
  FROM counts c JOIN (SELECT conv_id, i, {_RUNS} FROM ways) w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(b.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN best x ON g.conv_id IS NOT DISTINCT FROM x.conv_id
"""

OP12_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, l, len(l) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
         ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, t, n, form, CASE WHEN lo = 0 THEN '' ELSE array_to_string(l[1:lo], '') END AS a,
         CASE WHEN lo = hi THEN '' ELSE array_to_string(l[lo + 1:hi], '') END AS b,
         CASE WHEN hi = n THEN '' ELSE array_to_string(l[hi + 1:n], '') END AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_html_text": op5_html_text,
        "op6_source_mixing": op6_source_mixing,
        "op7_nearest_vectors": op7_nearest_vectors,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_url_filter": op10_url_filter,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_near_vectors": op13_near_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op10_url_filter": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
