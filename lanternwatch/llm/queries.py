"""Registered queries of the training-data operators, with oracle SQL where SQL can say it."""

from __future__ import annotations

from lanternwatch.llm import bpe, conversations, decontamination, embeddings, htmltext, infill, langid, lines, minhash, mixing, quality, substrings, toxicity
from lanternwatch.llm.common import table

ASCII_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_decontamination(spark, sf_dir):
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("k")


def op3_html_extraction(spark, sf_dir):
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    return infill.infill_report(table(spark, sf_dir, "documents"))


def op12_bpe(spark, sf_dir):
    import public_tokenizers  # the vocabulary files of the machine; their path is a parameter of the operator

    return bpe.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def _words_sql(source: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all({ASCII_LOWER_SQL.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source}"


OP1_SQL = f"""
WITH d AS ({_words_sql("documents", "doc_id")}),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM ({_words_sql("benchmark", "item_id")}) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER_SQL.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, least(len(w), 4) AS n FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s, n FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
sizes AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.n = y.n AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.c + q.c - i)),
reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
comp AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(c, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

OP5_SQL = r"""
WITH raw AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
masked AS (SELECT doc_id, line_no, raw, trim(regexp_replace(regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM raw),
lines AS (SELECT doc_id, line_no, raw, line, t, len(t) AS n, array_to_string(t[1:4], ' ') AS lead FROM (SELECT *, string_split(line, ' ') AS t FROM masked WHERE line <> '') WHERE len(t) >= 3),
busy AS (SELECT n, lead FROM lines GROUP BY ALL HAVING count(*) >= 10),
dist AS (SELECT n, lead, line, t, count(DISTINCT doc_id) AS docs FROM lines JOIN busy USING (n, lead) GROUP BY ALL),
tok AS (SELECT n, lead, line, docs, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM dist),
common AS (SELECT n, lead, pos, token, TRUE AS c FROM tok WHERE pos >= 4 AND token <> '<*>' GROUP BY ALL HAVING sum(docs) >= 10),
marked AS (SELECT tok.*, coalesce(c, pos < 4 AND token <> '<*>') AS fixed FROM tok LEFT JOIN common USING (n, lead, pos, token)),
temp AS (SELECT n, lead, line, string_agg(CASE WHEN fixed THEN token ELSE '<*>' END, ' ' ORDER BY pos) AS template FROM marked GROUP BY 1, 2, 3 HAVING avg(fixed::INT) >= 0.5),
placed AS (SELECT doc_id, line_no, n, lead, template FROM lines JOIN temp USING (n, lead, line)),
rec AS (SELECT n, lead, template, min((doc_id, line_no)) AS f FROM placed GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
exact AS (SELECT doc_id, line_no, n, line, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS whole,
                 contains(line, '<*>') AND 1 - len(list_filter(t, lambda x: x = '<*>')) / n < 0.5 AS numbers FROM lines),
rep AS (SELECT doc_id, line_no, numbers, CASE WHEN numbers THEN whole ELSE line END AS key, CASE WHEN n >= 50 THEN 2 ELSE 10 END AS least FROM exact WHERE n >= 50 OR numbers),
twice AS (SELECT numbers, key, least, min((doc_id, line_no)) AS f FROM rep GROUP BY ALL HAVING count(DISTINCT doc_id) >= least),
drops AS (SELECT doc_id, line_no FROM placed JOIN rec USING (n, lead, template) WHERE (doc_id, line_no) <> f
          UNION SELECT doc_id, line_no FROM rep JOIN twice USING (numbers, key, least) WHERE (doc_id, line_no) <> f),
kept AS (SELECT doc_id, count(*) AS n_lines, count(d.line_no) AS n_dropped, string_agg(CASE WHEN d.line_no IS NULL THEN raw END, chr(10) ORDER BY line_no) AS t
         FROM raw LEFT JOIN drops d USING (doc_id, line_no) GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT w.doc_id, i FROM w JOIN f USING (s) WHERE w.doc_id > least),
marked AS (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50)::INT AS fresh FROM hit),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
counts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS upto FROM runs GROUP BY 1),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s, a AS e FROM runs UNION ALL SELECT doc_id, upto, 1000000000 FROM counts),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS k FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(doc_id::VARCHAR || ':' || md5(coalesce(text, '')) || ':17'), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][r % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
-- the level of the fill: what the budget leaves after the full sources, by the weights of the rest
levels AS (SELECT ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce((SELECT sum(y.cap) FROM w y WHERE (y.cap / y.weight, y.r) < (x.cap / x.weight, x.r)), 0))
                  / (SELECT sum(y.weight) FROM w y WHERE (y.cap / y.weight, y.r) >= (x.cap / x.weight, x.r)) AS level, x.* FROM w x),
open AS (SELECT arg_min(level, (cap / weight, r)) AS level FROM levels WHERE level * weight <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, open.level * weight), cap) AS target FROM w, open),
c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY h % (SELECT floor(sqrt(count(*)))::BIGINT FROM documents), h, doc_id) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, size, h, e, (cum + e * source_size)::BIGINT / target AS finish FROM c, (SELECT unnest([0, 1]) AS e) WHERE size > 0 AND target > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, e ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM copies),
cut AS (SELECT min((finish, h, doc_id, e)) AS cut FROM run WHERE middle > (SELECT sum(target) FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM run, cut WHERE cut IS NULL OR (finish, h, doc_id, e) < cut GROUP BY 1)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken, source, coalesce(n, 0)::BIGINT AS n_taken FROM c LEFT JOIN n USING (doc_id)
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
          AND list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT a AS vec_id, a AS other FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
comp AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN comp USING (vec_id)
"""

OP11_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
             ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM h),
f AS (SELECT *, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
parts AS (SELECT *, left(t, p) AS pre, substr(t, p + 1, m) AS mid, substr(t, p + m + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

# A state holds its least cost (12 digits) and audit as one string, so LEAST takes the cheapest and of these the first.
def _plus(state: str, cost: str, letter: str) -> str:
    return f"lpad((left({state}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || {state}[13:] || '{letter}'"


OP13_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT keyed.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 20 AS h FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 100), sha256(text), copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM damaged),
seen AS (SELECT *, shown = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
judged AS (SELECT conv_id, turn, role, text, i, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated, pair NOT IN ('su', 'ua', 'au') AS clash FROM seen),
conv AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                count(*) FILTER (clash) AS illegal, list(role[1] ORDER BY i) AS kinds, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts, list(blank OR duplicate ORDER BY i) AS gone, list(CASE WHEN truncated THEN 3 ELSE 0 END ORDER BY i) AS cut
         FROM judged GROUP BY conv_id),
walk AS (SELECT conv_id, 0 AS i, kinds, gone, cut, repeat('0', 12) AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conv
    UNION ALL
    SELECT conv_id, i + 1, kinds, gone, cut, {_plus("s0", "4", "D")},
           least({_plus("s1", "4", "D")}, CASE WHEN NOT g AND kind = 's' THEN {_plus("s0", "c", "K")} END),
           least({_plus("t2", "4", "D")}, CASE WHEN NOT g THEN least({_plus("b", "c + 3", "R")}, CASE WHEN kind = 'u' THEN {_plus("b", "c", "K")} END) END),
           least({_plus("t3", "4", "D")}, CASE WHEN NOT g THEN least({_plus("t2", "c + 3", "R")}, CASE WHEN kind = 'a' THEN {_plus("t2", "c", "K")} END) END)
    FROM (SELECT *, least(s0, s1, t3) AS b FROM
         (SELECT *, least(s3, {_plus("t2", "3", "I")}) AS t3, kinds[i + 1] AS kind, gone[i + 1] AS g, cut[i + 1] AS c FROM
         (SELECT *, least(s2, {_plus("least(s0, s1, s3)", "3", "I")}) AS t2 FROM walk WHERE i < len(kinds))))),
ended AS (SELECT conv_id, least(s0, s3, {_plus("s2", "3", "I")}, {_plus("s1", "6", "II")}) AS best FROM walk WHERE i = len(kinds)),
letters AS (SELECT conv_id, best[13:] AS audit, left(best, 12)::BIGINT AS cost, generate_subscripts(string_split(best[13:], ''), 1) AS p, unnest(string_split(best[13:], '')) AS letter FROM ended WHERE best[13:] <> ''),
steps AS (SELECT conv_id, p, letter, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS n FROM letters),
turns AS (SELECT steps.*, roles, texts, max(CASE WHEN n = 1 AND letter = 'K' AND roles[i][1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY steps.conv_id) AS shift FROM steps JOIN conv ON steps.conv_id IS NOT DISTINCT FROM conv.conv_id WHERE letter <> 'D'),
fixed AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN roles[i] WHEN (n - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE texts[i] END, chr(10) ORDER BY n)) AS repaired FROM turns GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(left(best, 12)::BIGINT, 0) AS cost, coalesce(best[13:], '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN conv ON ids.conv_id IS NOT DISTINCT FROM conv.conv_id
LEFT JOIN ended ON ids.conv_id IS NOT DISTINCT FROM ended.conv_id LEFT JOIN fixed ON ids.conv_id IS NOT DISTINCT FROM fixed.conv_id
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash": op2_minhash,
    "op3_html_extraction": op3_html_extraction,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_bpe": op12_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op2_minhash": OP2_SQL, "op5_line_dedup": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op10_embedding_dedup": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op13_conversation_repair": OP13_SQL}
