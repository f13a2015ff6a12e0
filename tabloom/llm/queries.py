"""Queries of the text operators on the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(docs_of(spark, sf_dir)).drop("spans")


@query("op3_decontaminate", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import flagged

    return flagged(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "benchmark"))


@query("op4_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(docs_of(spark, sf_dir))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytebpe import digests

    return digests(docs_of(spark, sf_dir))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predictions

    return predictions(docs_of(spark, sf_dir))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import predictions

    return predictions(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxic import predictions

    return predictions(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import score

    return score(docs_of(spark, sf_dir))


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosenpath import similar_texts

    return similar_texts(docs_of(spark, sf_dir))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(docs_of(spark, sf_dir)).drop("edges")


@query("op12_filter_audit", r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM c p, c q, c r, c s, c t
      WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
st AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
              coalesce(list_sum([1 << (ascii(filter_order[j]) - 65) FOR j IN range(1, step)]), 0)::INT AS earlier
       FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
x AS (SELECT part, filter_order, step, own,
             sum(n) FILTER (mask & (own | earlier) = 0) AS kept,
             sum(n) FILTER (mask & own > 0 AND mask & earlier = 0) AS removed,
             sum(n) FILTER (mask & own > 0 AND mask & earlier > 0) AS redundant,
             sum(n) FILTER (mask = own) AS unique_fails,
             sum(good) FILTER (mask & own > 0 AND mask & earlier = 0) AS good_lost,
             sum(bad) FILTER (mask & own > 0 AND mask & earlier = 0) AS toxic_lost
      FROM m, st GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM x
""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interaction import filter_audit

    return filter_audit(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))


@query("op13_line_dedup", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, rid, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT k.*, s.key IS NULL OR doc_id = top AS stays FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM x GROUP BY rid
""")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_digests

    return line_digests(docs_of(spark, sf_dir))


@query("op11_conversation_repair", r"""
WITH RECURSIVE b AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)),
        lambda c, x: list_reduce(list_concat([xor(c, x)], [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]),
          lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 20 AS dealt FROM b),
d AS (SELECT cid, turn, CASE WHEN dealt = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN dealt = 1 THEN '' WHEN dealt = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE dealt WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM h)),
o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
             trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM d),
f AS (SELECT *, role[1] AS ini, lag(role[1]) OVER (PARTITION BY cid ORDER BY pos) AS prev,
             CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 THEN 'd'
                  WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
n AS (SELECT cid, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cid),
ins AS (SELECT * FROM (VALUES (0, '', 0, 0), (1, '', 1, 0), (2, '', 2, 0), (3, '', 3, 0),
                              (0, 'I', 2, 5), (1, 'I', 2, 5), (2, 'I', 3, 5), (3, 'I', 2, 5)) AS v(q, pre, q1, c1)),
act AS (SELECT * FROM (VALUES ('D', 0, 0, 2), ('D', 1, 1, 2), ('D', 2, 2, 2), ('D', 3, 3, 2),
                              ('R', 0, 2, 1), ('R', 1, 2, 1), ('R', 2, 3, 1), ('R', 3, 2, 1),
                              ('s', 0, 1, 0), ('u', 0, 2, 0), ('u', 1, 2, 0), ('u', 3, 2, 0), ('a', 2, 3, 0)) AS v(a, q1, q2, c2)),
w AS (SELECT cid, 0::BIGINT AS pos, 0 AS q, {'cost': 0, 'path': ''} AS best FROM n
      UNION ALL
      SELECT w.cid, w.pos + 1, q2,
             min({'cost': best.cost + c1 + c2 + CASE WHEN fault = 't' AND a <> 'D' THEN 5 ELSE 0 END,
                  'path': best.path || pre || CASE WHEN a IN ('D', 'R') THEN a ELSE 'K' END})
      FROM w JOIN f ON f.cid = w.cid AND f.pos = w.pos + 1 JOIN ins USING (q) JOIN act USING (q1)
      WHERE a = 'D' OR (fault IN ('', 't') AND (a = 'R' OR a = ini)) GROUP BY w.cid, w.pos, q2),
e AS (SELECT cid, min({'cost': best.cost + c1, 'path': best.path || pre}) AS best
      FROM w JOIN n USING (cid) JOIN ins USING (q) WHERE pos = n AND q1 IN (0, 3) GROUP BY cid),
l AS (SELECT cid, i, best.path[i] AS c FROM (SELECT *, unnest(range(1, len(best.path) + 1)) AS i FROM e)),
p AS (SELECT *, count(*) FILTER (c <> 'I') OVER (PARTITION BY cid ORDER BY i) AS pos,
             count(*) FILTER (c <> 'D') OVER (PARTITION BY cid ORDER BY i) AS k FROM l),
r AS (SELECT p.cid, p.c, k, role, ini, CASE WHEN p.c = 'I' THEN '' ELSE text END AS text
      FROM p LEFT JOIN f ON f.cid = p.cid AND f.pos = p.pos WHERE p.c <> 'D'),
z AS (SELECT cid, max((k = 1 AND c = 'K' AND ini = 's')::INT) AS lead FROM r GROUP BY cid),
t AS (SELECT cid, sha256(string_agg(CASE WHEN c = 'K' THEN role WHEN (k - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || text, chr(10) ORDER BY k)) AS sha FROM r JOIN z USING (cid) GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.path, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM b) LEFT JOIN n USING (cid) LEFT JOIN e USING (cid) LEFT JOIN t USING (cid)
""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damage_report

    return damage_report(docs_of(spark, sf_dir, "conversations"))
