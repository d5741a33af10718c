"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

import hashlib

from medialens.llm.chat import CONTROLS, END, TEXT, TURN
from medialens.llm.quality import MAX_DOCS_PER_HOST
from medialens.llm.queries import SHARDS, URL_RULES
from medialens.llm.sharding import TABLE_SIZE


def _slots() -> str:
    """Owners of the slots, each shard's preference order walked from its start at every turn."""

    def order(name: str):
        d = hashlib.md5(name.encode()).hexdigest()
        first, step = int(d[:16], 16) % TABLE_SIZE, int(d[16:], 16) % (TABLE_SIZE - 1) + 1
        return ((first + j * step) % TABLE_SIZE for j in range(TABLE_SIZE))

    wishes, owner = [order(s) for s in SHARDS], {}
    turn = 0
    while len(owner) < TABLE_SIZE:
        slot = next(x for x in wishes[turn % len(SHARDS)] if x not in owner)
        owner[slot] = turn % len(SHARDS)
        turn += 1
    return ",".join(str(owner[i]) for i in range(TABLE_SIZE))


def op2() -> str:
    return f"""
WITH t AS (SELECT string_split('{_slots()}', ',') AS slots),
k AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS BIGINT) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(slots[slot + 1], 3, '0') AS shard FROM k, t"""


WORD_SPLIT = r"[ \t\n\x0B\f\r]+"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{WORD_SPLIT}'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT rid, unnest([i, i+1, i+2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM rep GROUP BY rid),
m AS (SELECT rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (rid)),
l AS (SELECT rid, doc_id, t, source, CAST('0x' || substr(md5(trim(regexp_replace(lower(x), '{WORD_SPLIT}', ' ', 'g'))), 1, 15) AS BIGINT) AS line,
  CAST(len(list_filter(regexp_split_to_array(x, '{WORD_SPLIT}'), lambda y: y <> '')) AS BIGINT) AS words FROM (SELECT rid, doc_id, t, source, unnest(ls) AS x FROM w)),
frequent AS (SELECT source, line FROM (SELECT DISTINCT source, line, md5(t) AS document FROM l) GROUP BY ALL HAVING count(*) > {MAX_DOCS_PER_HOST}),
lost AS (SELECT rid, CAST(count(*) AS BIGINT) AS n, CAST(sum(words) AS BIGINT) AS words FROM l JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY rid),
v AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lost.n, 0) AS n_frequent_lines, coalesce(lost.words, 0) AS n_frequent_words FROM m LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT 100 * n_frequent_words > 50 * n_words AS kept, n_frequent_lines, n_frequent_words FROM v"""


def op4() -> str:
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{a}', '{r}')" for a, r in URL_RULES)
    return f"""
WITH r(h, p, action, rule) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT rid, page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
f AS (SELECT rid, rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, length(h) DESC, action DESC) AS k FROM s JOIN r ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM s LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)"""


def op5() -> str:
    """Sizes of the formatted text follow from the template: the same markers for each turn, a
    backslash for each backslash and each control string."""

    def escaped(c: str) -> str:
        out = f"replace({c}, chr(92), chr(92) || chr(92))"
        for x in CONTROLS:
            out = f"replace({out}, '{x}', '{x[0]}' || chr(92) || '{x[1:]}')"
        return out

    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


def op11() -> str:
    """Offsets come from the engine's own zone conversion: those of a day before and after tell whether a wall time is unique."""
    two = "[0-9]{2}"
    clock = "(?:[T ](?:(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?|(?:0[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9])? ?[AP]M)(?: ?(?:Z|[+-](?:0[0-9]|1[0-4]):?[0-5][0-9]))?)?"
    names = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    offset = lambda u: f"(epoch_us(timezone(zone, timezone('UTC', make_timestamp({u})))) - ({u}))"
    return rf"""
WITH s AS (SELECT row_number() OVER () AS rid, stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM stamps),
g AS (SELECT *, regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}') AS epoch,
  CASE WHEN regexp_full_match(t, '20{two}-{two}-{two}{clock}') THEN [t[1:4], t[6:7], t[9:10], t[11:]]
       WHEN regexp_full_match(t, '20{two}{two}{two}{clock}') THEN [t[1:4], t[5:6], t[7:8], t[9:]]
       WHEN regexp_full_match(t, '{two}[.]{two}[.]20{two}{clock}') THEN [t[7:10], t[4:5], t[1:2], t[11:]]
       WHEN regexp_full_match(t, '{two} (?:{names}) 20{two}{clock}') THEN [t[8:11], lpad(CAST(list_position(string_split('{names}', '|'), t[4:6]) AS VARCHAR), 2, '0'), t[1:2], t[12:]]
       WHEN regexp_full_match(t, '{two}/{two}/20{two}{clock}') THEN [t[7:10], t[4:5], t[1:2], t[11:]] END AS f,
  coalesce(t[3:3] = '/', false) AS slash FROM s),
d AS (SELECT *, try_cast(f[1] || '-' || f[2] || '-' || f[3] AS DATE) AS dmy, CASE WHEN slash THEN try_cast(f[1] || '-' || f[3] || '-' || f[2] AS DATE) END AS mdy, replace(f[4], ' ', '') AS c FROM g),
c AS (SELECT *, regexp_extract(c, '^T?([0-9]{{2}}):', 1) AS h, regexp_extract(c, ':([0-9]{{2}})', 1) AS m, regexp_extract(c, '^T?{two}:{two}:({two})', 1) AS sec, regexp_extract(c, '([AP])M', 1) AS half, regexp_extract(c, '(Z|[+-][0-9:]+)$', 1) AS own FROM d),
o AS (SELECT *, CASE WHEN h = '' THEN 0 ELSE (CASE WHEN half = '' THEN CAST(h AS BIGINT) ELSE CAST(h AS BIGINT) % 12 + CASE WHEN half = 'P' THEN 12 ELSE 0 END END) * 3600 + CAST(m AS BIGINT) * 60 + CAST(CASE WHEN sec = '' THEN '0' ELSE sec END AS BIGINT) END AS tod,
  CASE WHEN own = '' THEN NULL WHEN own = 'Z' THEN 0 ELSE (CAST(own[2:3] AS BIGINT) * 60 + CAST(right(own, 2) AS BIGINT)) * CASE WHEN own[1:1] = '-' THEN -60 ELSE 60 END END AS east,
  f IS NOT NULL AND (dmy IS NOT NULL OR mdy IS NOT NULL) AND (own <> '' OR zone IS NOT NULL) AS good FROM c),
v AS (SELECT source, count(*) FILTER (mdy IS NULL) AS days, count(*) FILTER (dmy IS NULL) AS months FROM o WHERE good AND slash AND (dmy IS NULL OR mdy IS NULL) GROUP BY source),
k AS (SELECT o.*, good AND dmy <> mdy AS twofold, coalesce(days, 0) AS days, coalesce(months, 0) AS months FROM o LEFT JOIN v ON o.source IS NOT DISTINCT FROM v.source),
w AS (SELECT *, epoch_us(CAST(CASE WHEN twofold AND months > days THEN mdy ELSE coalesce(dmy, mdy) END AS TIMESTAMP)) + tod * 1000000 AS wall FROM k),
z AS (SELECT *, {offset("wall - 86400000000")} AS before, {offset("wall + 86400000000")} AS after FROM w WHERE good AND east IS NULL),
q AS (SELECT rid, before, after, before <> after AND {offset("wall - before")} = before AS old_holds, before = after OR {offset("wall - after")} = after AS new_holds FROM z)
SELECT stamp_id, CASE WHEN epoch THEN CAST(t AS BIGINT) * CASE WHEN length(t) = 10 THEN 1000000 ELSE 1000 END WHEN NOT coalesce(good, false) THEN NULL WHEN east IS NOT NULL THEN wall - east * 1000000 WHEN old_holds AND NOT new_holds THEN wall - before ELSE wall - after END AS utc_us,
  CASE WHEN epoch THEN 'epoch' WHEN NOT coalesce(good, false) THEN 'bad' WHEN NOT coalesce(twofold, false) THEN 'plain' WHEN days <> months THEN 'votes' ELSE 'default' END AS rule,
  coalesce(twofold, false) OR coalesce(before <> after AND old_holds = new_holds, false) AS ambiguous
FROM w LEFT JOIN q USING (rid)"""


OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS u FROM d),
c AS (SELECT *, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u[3] % 100 >= 90 THEN 'plain' WHEN u[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, '<P>' || substr(t, 1, a) AS p, '<M>' || substr(t, a + 1, b - a) AS m, '<S>' || substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

OP13 = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": op2(), "op3_quality_rules": OP3, "op4_url_filters": op4(), "op5_chat_formatting": op5(), "op11_timestamps": op11(), "op12_fill_in_middle": OP12, "op13_exact_topk": OP13}
