"""SQL (DuckDB) for the queries of parlance.queries, under the same names and columns."""

from __future__ import annotations

from parlance.functions.text import FORBIDDEN

_PAIRS = "SELECT doc_id, CAST(quality AS VARCHAR) AS gold, CAST(toxic AS VARCHAR) AS pred FROM labels"
_PER_CLASS = """
  SELECT {by} c.class, CAST(sum(CASE WHEN gold = class AND pred = class THEN n ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN gold <> class AND pred = class THEN n ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN gold = class AND pred <> class THEN n ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN gold = class THEN n ELSE 0 END) AS BIGINT) AS support
  FROM counts, (SELECT unnest({classes}) AS class) c GROUP BY {by} c.class"""
_RATIOS = """
  SELECT {by} class, tp, fp, fn, support, tp / nullif(tp + fp, 0) AS precision, tp / nullif(support, 0) AS recall,
    CASE WHEN tp > 0 THEN 2.0 * (tp / (tp + fp)) * (tp / support) / (tp / (tp + fp) + tp / support) WHEN support > 0 THEN 0.0 END AS f1
  FROM c"""
_MACRO = """SELECT {by} avg(CASE WHEN support > 0 THEN coalesce(precision, 0) END) AS macro_precision,
  avg(CASE WHEN support > 0 THEN coalesce(recall, 0) END) AS macro_recall, avg(CASE WHEN support > 0 THEN coalesce(f1, 0) END) AS macro_f1 FROM p {group}"""
_KAPPA = """
  SELECT {by} sum(n) AS total, sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n) AS observed,
    (sum(CASE WHEN gold = '0' THEN n ELSE 0 END) * sum(CASE WHEN pred = '0' THEN n ELSE 0 END)
     + sum(CASE WHEN gold = '1' THEN n ELSE 0 END) * sum(CASE WHEN pred = '1' THEN n ELSE 0 END)) / (sum(n) * sum(n)) AS expected
  FROM counts {group}"""
_WORDS = "list_filter(regexp_split_to_array({t}, '[ \\t\\r\\n]+'), lambda w: w <> '')"
_SPLIT = """
WITH RECURSIVE g AS (SELECT lang, source, count(*) AS n, row_number() OVER (ORDER BY lang || chr(1) || source) AS k FROM documents GROUP BY lang, source),
f AS (SELECT CAST(0 AS BIGINT) AS k, count(*) - 2 * (count(*) // 10) AS l0, count(*) // 10 AS l1, count(*) // 10 AS l2, CAST(0 AS BIGINT) AS s0, CAST(0 AS BIGINT) AS s1, CAST(0 AS BIGINT) AS s2 FROM documents
  UNION ALL SELECT k, l0 - s0, l1 - s1, l2 - s2, s0, s1, s2 FROM (SELECT k, l0, l1, l2,
    b0 + CAST(b0 < l0 AND CAST(b1 < l1 AND x1 > x0 AS INT) + CAST(b2 < l2 AND x2 > x0 AS INT) < n - b0 - b1 - b2 AS BIGINT) AS s0,
    b1 + CAST(b1 < l1 AND CAST(b0 < l0 AND x0 >= x1 AS INT) + CAST(b2 < l2 AND x2 > x1 AS INT) < n - b0 - b1 - b2 AS BIGINT) AS s1,
    b2 + CAST(b2 < l2 AND CAST(b0 < l0 AND x0 >= x2 AS INT) + CAST(b1 < l1 AND x1 >= x2 AS INT) < n - b0 - b1 - b2 AS BIGINT) AS s2
    FROM (SELECT k, n, l0, l1, l2, e0 - floor(e0) AS x0, e1 - floor(e1) AS x1, e2 - floor(e2) AS x2, least(l0, CAST(floor(e0) AS BIGINT)) AS b0, least(l1, CAST(floor(e1) AS BIGINT)) AS b1, least(l2, CAST(floor(e2) AS BIGINT)) AS b2
      FROM (SELECT g.k, g.n, l0, l1, l2, coalesce(CAST(g.n * l0 AS DOUBLE) / nullif(l0 + l1 + l2, 0), 0) AS e0, coalesce(CAST(g.n * l1 AS DOUBLE) / nullif(l0 + l1 + l2, 0), 0) AS e1, coalesce(CAST(g.n * l2 AS DOUBLE) / nullif(l0 + l1 + l2, 0), 0) AS e2
        FROM f JOIN g ON g.k = f.k + 1)))),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha1('7|' || doc_id), doc_id) - 1 AS rank FROM documents),
split AS (SELECT doc_id, lang, source, CASE WHEN rank < s0 THEN 'train' WHEN rank < s0 + s1 THEN 'dev' WHEN rank < s0 + s1 + s2 THEN 'test' END AS split FROM r JOIN g USING (lang, source) JOIN f USING (k))
"""
_FOLD = "trim(regexp_replace(lower(replace(translate({t}, '‘’‚‛′“”„″‐‑‒–—\u00a0\u202f', '''''''''''\"\"\"\"-----  '), '…', '...')), '[ \\t\\r\\n]+', ' ', 'g'))"
_TURN_WORDS = """
WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace('[sighs] ' || text, '\\[[^\\]]+\\]', ' ', 'g'))) AS s FROM conversations),
c AS (SELECT conv_id, turn, s, list_transform(range(1, length(s) + 1), lambda i: regexp_matches(substring(s, i, 1), '[a-z'']')) AS f FROM t),
k AS (SELECT conv_id, turn, regexp_extract_all(s, '[a-z'']+') AS words, list_filter(range(1, len(f) + 1), lambda i: f[i] AND (i = 1 OR NOT f[i - 1])) AS starts FROM c)
"""
_ITEMS = """
WITH b AS (SELECT item_id, """ + _WORDS.format(t="lower(text)") + """ AS w FROM benchmark),
g AS (SELECT item_id, w, w[-1] AS gold FROM b),
c AS (SELECT DISTINCT item_id, gold, unnest(w) AS o FROM g),
d AS (SELECT item_id, gold, o, row_number() OVER (PARTITION BY item_id ORDER BY sha1('draw|' || item_id || '|' || o), o) AS n FROM c WHERE o <> gold),
u AS (SELECT item_id, o FROM d WHERE n <= 3 UNION ALL SELECT item_id, gold FROM g),
q AS (SELECT item_id, list(o ORDER BY sha1('show|' || item_id || '|' || o), o) AS options FROM u GROUP BY item_id HAVING count(*) = 4),
i AS (SELECT q.item_id, g.gold, g.w, q.options FROM q JOIN g USING (item_id))
"""
_ANSWERS = _ITEMS + """,
r AS (SELECT *, trim(lower(CASE WHEN item_id % 3 = 0 THEN upper(gold) WHEN item_id % 3 = 1 THEN 'it is ' || w[1] ELSE '' END)) AS said FROM i),
h AS (SELECT *, list_filter(options, lambda o: lower(o) = said) AS equal, list_filter(options, lambda o: contains(said, lower(o))) AS held FROM r),
a AS (SELECT *, CASE WHEN said = '' THEN NULL WHEN len(equal) > 0 THEN equal[1] WHEN len(held) = 1 THEN held[1] END AS answer FROM h)
"""
_CATALOG = """
WITH scenes AS (SELECT r_name AS scene FROM region),
own AS (SELECT r_name AS scene, n_name AS event FROM nation JOIN region ON n_regionkey = r_regionkey),
shared AS (SELECT DISTINCT r_name AS scene, c_mktsegment AS event FROM customer JOIN region ON length(c_mktsegment) % 5 = r_regionkey),
general AS (SELECT DISTINCT p_brand AS event FROM part),
forbidden AS (SELECT r_name AS scene, event FROM general JOIN region ON ascii(right(event, 1)) % 5 = r_regionkey),
pool AS (SELECT scene, event, 0 AS branch FROM own UNION ALL SELECT scene, event, 1 FROM shared
  UNION ALL SELECT s.scene, g.event, 2 FROM scenes s, general g WHERE NOT EXISTS (SELECT 1 FROM forbidden f WHERE f.scene = s.scene AND f.event = g.event))
"""
_STEPS = """
WITH docs AS (SELECT doc_id, lang, n_chars FROM documents),
ok AS (SELECT doc_id FROM docs WHERE (n_chars % 100) / 100.0 >= 0.6 AND doc_id % 4 <> 0),
attempts AS (SELECT doc_id, unnest(range(0, doc_id % 4 + 1)) AS pass FROM docs),
tries AS (SELECT doc_id, count(*) AS n_attempts FROM attempts GROUP BY doc_id),
steps AS (SELECT d.doc_id, d.lang, t.n_attempts, CASE WHEN ok.doc_id IS NOT NULL THEN 'accepted' WHEN t.n_attempts >= 3 THEN 'abandoned' ELSE 'regenerate' END AS state
  FROM docs d JOIN tries t USING (doc_id) LEFT JOIN ok USING (doc_id))
"""
_CACHES = """
WITH rows AS (SELECT event_id, event_type || '-' || user_id AS answer, event_id % 6 = 0 AS error FROM events),
a AS (SELECT * FROM rows WHERE event_id % 3 <> 1),
b AS (SELECT event_id, answer || '!' AS answer, event_id % 10 = 0 AS error FROM rows WHERE event_id % 4 <> 2)
"""
_PACK = """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, 0 AS chunk, s AS size FROM t WHERE n = 1
  UNION ALL SELECT t.conv_id, t.turn, t.n, CASE WHEN f.size + t.s <= 2000 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.size + t.s <= 2000 THEN f.size + t.s ELSE t.s END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.n = f.n + 1),
packed AS (SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, min(turn) AS first, max(turn) AS last, CAST(max(size) AS BIGINT) AS size FROM f GROUP BY conv_id, chunk)
"""
_FORBIDDEN = "CASE " + " ".join("WHEN regexp_matches(text, '{}') THEN '{}'".format(*(x.replace("'", "''") for x in (p, label))) for label, p in FORBIDDEN) + " END"
_SPOKEN = "trim(regexp_replace(text, '\\[[^\\]]+\\]', ' ', 'g'))"
_REASON = f"""
  SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'invalid speaker' WHEN trim(coalesce(text, '')) = '' THEN 'empty text'
    ELSE coalesce({_FORBIDDEN}, CASE WHEN len({_WORDS.format(t=_SPOKEN)}) > 60 THEN 'too long' END) END AS reason FROM conversations"""
_FIRST_REASON = f"SELECT conv_id, arg_min(reason, turn) FILTER (WHERE reason IS NOT NULL) AS reason FROM ({_REASON}) GROUP BY conv_id"
_UTTERANCES = """
WITH u AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen,
  CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM conversations)
"""
_FILL = "CAST(c{i} = 0 AND greatest(c0, c1, c2) > 1 AS BIGINT)"
_FILLS = "".join(
    f"""s{i} AS (SELECT * EXCLUDE (c0, c1, c2), c0 + g * ({int(i == 0)} - CAST(c0 = m AS BIGINT)) AS c0, c1 + g * ({int(i == 1)} - CAST(c1 = m AND c0 < m AS BIGINT)) AS c1,
  c2 + g * ({int(i == 2)} - CAST(c2 = m AND c0 < m AND c1 < m AS BIGINT)) AS c2 FROM (SELECT * EXCLUDE (g, m), {_FILL.format(i=i)} AS g, greatest(c0, c1, c2) AS m FROM {f's{i - 1}' if i else 'c'})),
"""
    for i in range(3)
)
_FILES = """
WITH r AS (SELECT lang, source, 'f' || doc_id || '.wav' AS name FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha1('s|' || name), name) - 1 AS rank, count(*) OVER (PARTITION BY lang, source) AS n FROM r),
x AS (SELECT *, n * CAST(0.9 AS DOUBLE) AS x0, n * CAST(0.05 AS DOUBLE) AS x1 FROM n),
f AS (SELECT *, x0 - floor(x0) AS d0, x1 - floor(x1) AS d1, n - CAST(floor(x0) AS BIGINT) - 2 * CAST(floor(x1) AS BIGINT) AS rest FROM x),
c AS (SELECT lang, source, name, rank, n, CAST(floor(x0) AS BIGINT) + CAST(2 * CAST(d1 > d0 AS BIGINT) < rest AS BIGINT) AS c0, CAST(floor(x1) AS BIGINT) + CAST(CAST(d0 >= d1 AS BIGINT) < rest AS BIGINT) AS c1,
  CAST(floor(x1) AS BIGINT) + CAST(CAST(d0 >= d1 AS BIGINT) + 1 < rest AS BIGINT) AS c2, 0 AS g, 0 AS m FROM f),
""" + _FILLS + """t AS (SELECT lang, source, name, rank, CASE WHEN n < 3 THEN 1 ELSE c0 END AS a, CASE WHEN n < 3 THEN n - 1 ELSE c1 END AS b FROM s2)
SELECT lang, source, name, CASE WHEN rank < a THEN 'train' WHEN rank < a + b THEN 'dev' ELSE 'test' END AS split FROM t"""
_OFFSET = "-20 * log10(m / CAST(2 AS DOUBLE))"

_SCENARIOS = """
WITH e AS (SELECT *, ['pivot', 'verbal', 'behavioral', 'ambient'][turn % 4 + 1] AS reaction FROM conversations WHERE turn % 3 <> 2),
c AS (SELECT conv_id, count(*) AS n_events, count(*) FILTER (reaction = 'pivot') AS p, count(*) FILTER (reaction = 'verbal') AS v, count(*) FILTER (reaction = 'behavioral') AS b, count(*) FILTER (reaction = 'ambient') AS a,
  bool_or(turn % 2 = 0 AND turn % 5 = 4) AS rare,
  string_agg(role || '/loud_knock_' || turn || ':' || CASE WHEN turn % 2 = 1 THEN 'calm' ELSE '-' END || ':' || ['early', 'middle', 'late', '-'][turn % 4 + 1], ',' ORDER BY turn) AS events FROM e GROUP BY conv_id),
s AS (SELECT i.conv_id, coalesce(n_events, 0) AS n_events, coalesce(p, 0) AS p, coalesce(v, 0) AS v, coalesce(b, 0) AS b, coalesce(a, 0) AS a, coalesce(p + v + b, 0) AS n_reacted_to, coalesce(rare, false) AS any_rare, coalesce(p > 0, false) AS has_pivot, events,
  CASE WHEN i.conv_id % 7 = 0 THEN i.conv_id % 2 = 0 END AS flag, CASE i.conv_id % 3 WHEN 0 THEN 'Theme ' || i.conv_id WHEN 1 THEN 'Plain ' || i.conv_id END AS label FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c USING (conv_id))
"""
_SUMMARIES = """
WITH b AS (SELECT unnest([25, 75, 200]) AS budget), f AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
r AS (SELECT c.conv_id, turn, budget, ['pivot', 'verbal', 'behavioral', 'ambient', ''][turn % 5 + 1] AS reaction, turn % 4 = 1 AS rare, (c.conv_id + turn + budget) % 3 = 0 AS m, (c.conv_id + turn) % 7 = 0 AS d, CASE WHEN c.conv_id % 5 > 0 THEN f.text END AS summary
  FROM conversations c LEFT JOIN f USING (conv_id), b),
g AS (SELECT *, summary IS NOT NULL OR bool_or(m) OVER (PARTITION BY conv_id, budget) AS used FROM r)
"""
_MANIFESTS = """
WITH m AS (SELECT conv_id, turn, r_name AS scene, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rank, 'x/' || n_name AS event_id, ['pivot', 'verbal', 'behavioral', 'ambient', 'other'][turn % 5 + 1] AS reaction,
  turn * CAST(2 AS DOUBLE) AS t, CASE WHEN turn % 6 < 5 THEN CAST(12 AS DOUBLE) - turn END AS margin_db FROM conversations JOIN nation ON n_nationkey = (conv_id + turn) % 25 LEFT JOIN region ON r_regionkey = conv_id % 6)
"""
#: Conversations as timelines, and what is wrong with the tag of the turn behind each event that requires one.
_TAGGED = """
WITH t AS (SELECT conv_id, turn, turn % 4 = 3 AS heard, CASE WHEN conv_id % 6 = 5 OR role = 'user' THEN 'A' ELSE 'B' END AS speaker,
    trim(coalesce(CASE WHEN turn % 4 = 0 AND turn > 0 THEN ['', '[gasps] ', 'It stopped. [gasps] ', 'Well... [gasps] ', 'So [Gasps] '][conv_id % 5 + 1] ELSE '' END || text, '')) AS text FROM conversations),
faults AS (SELECT e.conv_id, e.turn, CASE WHEN n.turn IS NULL OR e.conv_id % 5 = 0 THEN 'tag missing' WHEN e.conv_id % 5 = 1 THEN 'tag opens the turn' WHEN e.conv_id % 5 = 2 THEN 'tag after a sentence' WHEN e.conv_id % 5 = 3 THEN 'tag after an ellipsis'
    WHEN regexp_extract(lower(substring(n.text, 13)), '[a-z'']+') = 'so' THEN 'tag between equal words' END AS fault
  FROM t AS e LEFT JOIN t AS n ON n.conv_id = e.conv_id AND n.turn = e.turn + 1 WHERE e.heard AND e.conv_id % 2 = 1)"""
_TODOS = """
WITH size AS (SELECT count(*) * 10 AS n FROM part), x AS (SELECT unnest(range(0, 4)) AS x),
c AS (SELECT p.x AS p, v.x AS v, b.x AS b, a.x AS a, row_number() OVER (ORDER BY p.x + v.x + b.x + a.x, p.x, v.x, b.x) AS k FROM x p, x v, x b, x a WHERE p.x <= 1 AND p.x + v.x + b.x + a.x <= 3),
q AS (SELECT *, n // 30 + CASE WHEN k <= n % 30 THEN 1 ELSE 0 END AS quota FROM c, size),
comps AS (SELECT 'P' || p || 'V' || v || 'B' || b || 'A' || a AS composition, p, v, b, a, quota FROM q WHERE quota > 0), pivots AS (SELECT CAST(sum(quota) FILTER (p = 1) AS BIGINT) AS pivots FROM comps)
"""
_SCENARIO_EVENTS = _TODOS + """,
u AS (SELECT composition, p, v, b, a, unnest(range(0, quota)) AS u FROM comps),
s AS (SELECT row_number() OVER (ORDER BY sha1('composition|' || composition || '|' || p || '|' || v || '|' || b || '|' || a || '|' || u)) - 1 AS local, p, v, b, p + v + b + a AS n FROM u),
h AS (SELECT local, row_number() OVER (ORDER BY sha1('rare|' || local), local) AS k FROM s WHERE p = 1),
t AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS t FROM part), z AS (SELECT unnest(range(1, 11)) AS z)
SELECT format('{}__s{:02d}', p_partkey, z) AS scenario_id, s.n, s.n AS n_different, p AS n_pivot, 0 AS n_late_pivots, CASE WHEN h.k <= round(size.n * 0.05) THEN 1 ELSE 0 END AS n_rare, s.n AS n_places, p + v + b AS n_registers
FROM t, z JOIN s ON s.local = t.t * 10 + z.z - 1 LEFT JOIN h USING (local), size WHERE s.n > 0"""

#: Gain at 40 samples a second, t samples after a rare event's end.
_RARE_GAIN = "(CASE WHEN {t} < 0 OR {t} >= 60 THEN 1 WHEN {t} <= 1 THEN 1 + (power(10, -0.3) - 1) * {t} WHEN {t} < 44 THEN power(10, -0.3) ELSE power(10, -0.3) + (1 - power(10, -0.3)) * ({t} - 44) / 15 END)"

#: A number in [0, 1) from a hash of salt and columns.
_UNIFORM = "(CAST(('0x' || substring(sha1('{salt}' || {of}), 1, 8)) AS BIGINT) / 4294967296)"

ORACLES = {
    "confusion_long": f"SELECT gold, pred, count(*) AS n FROM ({_PAIRS}) GROUP BY gold, pred",
    "confusion_dense": f"""
      WITH p AS (SELECT gold, CASE WHEN doc_id % 7 = 0 THEN 'invalid' ELSE pred END AS pred FROM ({_PAIRS})),
      g AS (SELECT unnest(['0', '1', '2']) AS gold), q AS (SELECT unnest(['0', '1', '2', 'invalid']) AS pred)
      SELECT g.gold, q.pred, count(p.gold) AS n FROM g CROSS JOIN q LEFT JOIN p ON p.gold = g.gold AND p.pred = q.pred GROUP BY g.gold, q.pred""",
    "confusion_row_norm": f"""
      WITH g AS (SELECT unnest(['0', '1']) AS gold), q AS (SELECT unnest(['0', '1']) AS pred),
      c AS (SELECT g.gold, q.pred, count(p.gold) AS n FROM g CROSS JOIN q LEFT JOIN ({_PAIRS}) p ON p.gold = g.gold AND p.pred = q.pred GROUP BY g.gold, q.pred)
      SELECT gold, pred, n, coalesce(n / nullif(sum(n) OVER (PARTITION BY gold), 0), 0.0) AS share FROM c""",
    "per_class_prf": f"WITH counts AS (SELECT gold, pred, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL), c AS ({_PER_CLASS.format(by='', classes="['0','1','2']")}) {_RATIOS.format(by='')}",
    "macro_prf": f"WITH counts AS (SELECT gold, pred, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL), c AS ({_PER_CLASS.format(by='', classes="['0','1','2']")}), p AS ({_RATIOS.format(by='')}) {_MACRO.format(by='', group='')}",
    "kappa": f"WITH counts AS (SELECT gold, pred, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL), k AS ({_KAPPA.format(by='', group='')}) SELECT observed, expected, CASE WHEN expected < 1 THEN (observed - expected) / (1 - expected) END AS kappa FROM k",
    "metrics_by_stratum": f"""
      WITH counts AS (SELECT lang, gold, pred, count(*) AS n FROM ({_PAIRS}) JOIN documents USING (doc_id) GROUP BY ALL
        UNION ALL SELECT 'all', gold, pred, count(*) FROM ({_PAIRS}) JOIN documents USING (doc_id) GROUP BY gold, pred),
      c AS ({_PER_CLASS.format(by='lang,', classes="['0','1']")}), p AS ({_RATIOS.format(by='lang,')}), m AS ({_MACRO.format(by='lang,', group='GROUP BY lang')}), k AS ({_KAPPA.format(by='lang,', group='GROUP BY lang')})
      SELECT lang, macro_precision, macro_recall, macro_f1, observed, expected, CASE WHEN expected < 1 THEN (observed - expected) / (1 - expected) END AS kappa FROM m JOIN k USING (lang)""",
    "balanced_accuracy": f"""
      WITH counts AS (SELECT gold, pred, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL), c AS ({_PER_CLASS.format(by='', classes="['0','1']")}), p AS ({_RATIOS.format(by='')})
      SELECT sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, avg(coalesce(f1, 0)) AS macro_f1 FROM p""",
    "mcnemar_exact": f"""
      WITH c AS (SELECT lang, source, count(*) FILTER (gold = '1' AND pred = '0') AS correct, count(*) FILTER (gold = '0' AND pred = '1') AS reversed
        FROM ({_PAIRS}) JOIN documents USING (doc_id) GROUP BY lang, source),
      t AS (SELECT *, correct + reversed AS n, greatest(correct, reversed) AS k FROM c)
      SELECT lang, source, correct, reversed, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(k, n + 1),
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 9) AS p FROM t""",
    "paired_table": """
      WITH i AS (SELECT doc_id - doc_id % 2 AS pair_id, doc_id % 2 = 0 AS gold, CASE WHEN quality = 1 THEN toxic = 1 END AS pred FROM labels),
      s AS (SELECT pair_id, count(*) FILTER (gold) AS np, count(*) FILTER (NOT gold) AS nm, max(CASE WHEN gold THEN CAST(pred AS INT) END) AS yes, max(CASE WHEN NOT gold THEN CAST(pred AS INT) END) AS no FROM i GROUP BY pair_id),
      t AS (SELECT count(*) FILTER (np > 0 AND nm > 0) AS n_pairs, count(*) FILTER (np > 0 AND nm > 0 AND yes = 1 AND no = 0) AS correct, count(*) FILTER (np > 0 AND nm > 0 AND yes = 0 AND no = 1) AS reversed,
        count(*) FILTER (np > 0 AND nm > 0 AND yes = 1 AND no = 1) AS always_yes, count(*) FILTER (np > 0 AND nm > 0 AND yes = 0 AND no = 0) AS always_no FROM s),
      h AS (SELECT count(*) AS n_items, count(*) FILTER (pred IS NULL) AS n_unreadable, coalesce(count(*) FILTER (gold AND pred) / nullif(count(*) FILTER (gold), 0), 0.0) AS hit_rate,
        coalesce(count(*) FILTER (NOT gold AND pred) / nullif(count(*) FILTER (NOT gold), 0), 0.0) AS false_alarm_rate FROM i),
      m AS (SELECT *, correct + reversed AS n, greatest(correct, reversed) AS k FROM t, h),
      q AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END AS p FROM m)
      SELECT n_pairs, n_items, n_unreadable, correct, reversed, always_yes, always_no, hit_rate, false_alarm_rate, coalesce(correct / nullif(n_pairs, 0), 0.0) AS paired_accuracy,
        hit_rate - false_alarm_rate AS sensitivity, round(p, 9) AS mcnemar_p, CASE WHEN p < 0.05 AND correct > reversed THEN 'discriminates' ELSE 'does not discriminate' END AS verdict FROM q""",
    "share_vs_base": """
      WITH c AS (SELECT user_id % 3 AS team, event_type, count(*) AS n_present, count(*) FILTER (value > 50) AS n_mentioned FROM events GROUP BY ALL),
      s AS (SELECT *, n_present / sum(n_present) OVER (PARTITION BY team) AS share_present, n_mentioned / nullif(sum(n_mentioned) OVER (PARTITION BY team), 0) AS share_mentioned FROM c)
      SELECT *, n_mentioned / n_present AS recall, share_mentioned - share_present AS lift FROM s""",
    "upper_median_words": f"SELECT role, count(*) AS n, list_sort(list(w))[count(*) // 2 + 1] AS median FROM (SELECT role, len({_WORDS.format(t='text')}) AS w FROM conversations) GROUP BY role",
    "top5_ties": """
      WITH c AS (SELECT event_type, user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL),
      r AS (SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, f) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""",
    "mcq_items": _ITEMS + "SELECT item_id, gold, array_to_string(options, ' / ') AS options FROM i",
    "mcq_score": _ANSWERS + """SELECT item_id % 3 AS "group", count(*) AS n_items, count(*) FILTER (answer IS NULL) AS n_unreadable, count(*) FILTER (answer = gold) AS n_correct,
      count(*) FILTER (answer = gold) / count(*) AS accuracy, count(*) FILTER (answer = gold) / nullif(count(answer), 0) AS accuracy_on_readable FROM a GROUP BY item_id % 3""",
    "mcq_positions": _ANSWERS + "SELECT list_position(options, answer) - 1 AS position, count(*) AS n FROM a WHERE answer IS NOT NULL GROUP BY 1",
    "summary_items": """
      WITH s AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id), b AS (SELECT unnest([25, 75, 200]) AS budget)
      SELECT conv_id, n_turns, budget, conv_id || '::summary::' || budget AS item_id FROM s, b""",
    "grounding_items": _MANIFESTS + """, g AS (SELECT m.*, f.f FROM m, (SELECT unnest([0, 1]) AS f) f WHERE (conv_id + f) % 3 < 2),
      u AS (SELECT conv_id, f, min(rank) AS rank FROM g WHERE turn % 3 > 0 AND CASE WHEN f = 0 THEN turn % 2 = 1 ELSE turn >= conv_id % 9 END GROUP BY conv_id, f),
      i AS (SELECT m.*, f, unnest([true, false]) AS gold FROM u JOIN m USING (conv_id, rank) WHERE NOT (conv_id % 4 = 0 AND f = 1) AND NOT (conv_id % 5 = 0 AND rank >= 2))
      SELECT conv_id || '::pair::' || f || CASE WHEN gold THEN '::present' ELSE '::muted' END AS item_id, conv_id || '::pair::' || f AS pair_id, conv_id, scene, CASE WHEN gold THEN '/scenes/' ELSE '/without' || f || '/' END || conv_id || '.wav' AS audio, event_id, t AS start_s, margin_db, reaction, gold FROM i""",
    "event_runs": """
      WITH a AS (SELECT *, row_number() OVER w AS n, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a)
      SELECT user_id, run, any_value(event_type) AS event_type, min(n) AS start, count(*) AS length FROM b GROUP BY user_id, run HAVING count(*) >= 2""",
    "timeline_position": _UTTERANCES + """
      , s AS (SELECT *, CAST(turn % 3 AS INT) AS band FROM u WHERE role = 'assistant')
      SELECT conv_id, turn, seen, total, ['early', 'middle', 'late'][band + 1] AS slot,
        CASE WHEN total < 3 THEN true ELSE seen / total >= band / CAST(3.0 AS DOUBLE) - CAST(0.10 AS DOUBLE) AND seen / total <= (band + 1) / CAST(3.0 AS DOUBLE) + CAST(0.10 AS DOUBLE) END AS fits FROM s""",
    "after_turn_idx": _UTTERANCES + "SELECT conv_id, turn, CASE WHEN seen > 0 THEN seen - 1 END AS after_turn FROM u WHERE role <> 'user'",
    "speaker_anchor": """
      WITH p AS (SELECT *, CASE WHEN role = 'user' THEN turn END AS place, turn % 2 AS speaker FROM conversations)
      SELECT conv_id, turn, coalesce(
        max(place) OVER (PARTITION BY conv_id, speaker ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(place) OVER (PARTITION BY conv_id, speaker ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
        max(place) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(place) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS anchor FROM p""",
    "next_utterance": """
      WITH p AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_turn FROM conversations)
      SELECT p.conv_id, p.turn, p.next_turn, length(c.text) AS next_n_chars FROM p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.next_turn""",
    "pack_chunks": _PACK + "SELECT * FROM packed",
    "midpoint_bounds": """
      WITH t AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS start FROM events)
      SELECT event_id, coalesce((lag(start + 1.5) OVER w + start) / 2, start) AS bound_start, coalesce((start + 1.5 + lead(start) OVER w) / 2, start + 1.5) AS bound_end
      FROM t WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id)""",
    "pause_gap": """
      WITH t AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, lead(epoch_us(ts) / 1e6) OVER w AS nxt, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT user_id, arg_min(nxt, n) AS gap_at, round(arg_min(nxt - t, n), 4) AS gap FROM t WHERE nxt - t >= 3600 GROUP BY user_id""",
    "validation_reason": _FIRST_REASON,
    "turn_cap": """
      WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n_utterances, count(*) FILTER (role = 'assistant') AS e, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS p FROM conversations GROUP BY conv_id),
      m AS (SELECT *, CASE WHEN p = 1 THEN 2 + e + 1 ELSE 2 END AS most FROM c)
      SELECT conv_id, n_utterances, most, CASE WHEN n_utterances < 2 THEN 'too few' WHEN n_utterances > most THEN 'too many' END AS reason FROM m""",
    "timeline_report": f"""
      WITH w AS (SELECT conv_id, turn, role, len({_WORDS.format(t='text')}) AS w FROM conversations),
      s AS (SELECT conv_id, count(*) AS n_turns, CAST(sum(w) AS BIGINT) AS n_words, max(w) AS longest_turn FROM w GROUP BY conv_id),
      a AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM w),
      b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM a),
      r AS (SELECT conv_id, max(n) AS longest_run FROM (SELECT conv_id, run, count(*) AS n FROM b GROUP BY ALL) GROUP BY conv_id)
      SELECT * FROM s JOIN r USING (conv_id) JOIN ({_FIRST_REASON}) USING (conv_id)""",
    "shifted_turns": """
      WITH t AS (SELECT conv_id, turn, coalesce(sum((length(text) % 4) * CAST(0.25 AS DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM conversations)
      SELECT conv_id, turn, turn * CAST(2 AS DOUBLE) + shift AS new_start, turn * CAST(2 AS DOUBLE) + CAST(1.5 AS DOUBLE) + shift AS new_end FROM t""",
    "rescaled_turns": """
      WITH t AS (SELECT conv_id, turn, turn * 2.0 + 2.0 AS e, CAST(conv_id % 17 + 2 AS DOUBLE) / max(CAST(turn * 2 + 2 AS DOUBLE)) OVER (PARTITION BY conv_id) AS f FROM conversations),
      u AS (SELECT *, CASE WHEN f BETWEEN CAST(0.85 AS DOUBLE) AND CAST(1.25 AS DOUBLE) AND abs(f - 1) > CAST(1e-4 AS DOUBLE) THEN f ELSE CAST(1 AS DOUBLE) END AS factor FROM t)
      SELECT conv_id, turn, round(factor, 9) AS factor, round(CAST(e AS DOUBLE) * factor, 9) AS new_end FROM u""",
    "sample_spans": """
      SELECT conv_id, turn, CAST(greatest(0, least(floor((turn - 0.5) * 44100), 200000)) AS BIGINT) AS first, CAST(greatest(0, least(floor((turn + 0.75) * 44100), 200000)) AS BIGINT) AS last FROM conversations""",
    "chunk_offsets": _PACK + "SELECT conv_id, chunk, coalesce(CAST(sum(size / 16) OVER (PARTITION BY conv_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS \"offset\" FROM packed",
    "forbidden_pattern_hits": f"SELECT doc_id, label FROM (SELECT doc_id, {_FORBIDDEN} AS label FROM documents) WHERE label IS NOT NULL",
    "tag_strip": "SELECT page_id, length(s) AS n, md5(s) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS s FROM pages)",
    "prosody_strip": "SELECT conv_id, turn, trim(regexp_replace('[sighs] ' || text || ' [laughs softly] end', '\\[[^\\]]+\\]', ' ', 'g')) AS spoken FROM conversations",
    "degenerate_text": """
      WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS w, regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', '', 'g') AS dense FROM documents),
      a AS (SELECT doc_id, max(n) AS top_word_count FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY ALL) GROUP BY doc_id),
      g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) AS x FROM w WHERE len(w) >= 4),
      b AS (SELECT doc_id, max(n) AS top_run_count FROM (SELECT doc_id, x, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
      SELECT w.doc_id, len(w.w) AS n_words, top_word_count, top_run_count, CASE WHEN dense = '' THEN 'empty reply' WHEN length(dense) > 20 AND len(list_distinct(string_split(dense, ''))) <= 2 THEN 'one or two characters'
        WHEN len(w.w) = 0 THEN 'no alphabetic word' WHEN top_word_count > 8 AND top_word_count > len(w.w) * 0.3 THEN 'a word repeats'
        WHEN len(w.w) > 12 AND top_run_count > 8 THEN 'a run repeats' END AS reason FROM w LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
    "quote_evidence": f"""
      WITH d AS (SELECT doc_id, {_FOLD.format(t='text')} AS t FROM documents), b AS (SELECT item_id, {_FOLD.format(t='text')} AS q FROM benchmark)
      SELECT doc_id, item_id FROM d JOIN b ON contains(t, q)""",
    "reply_readers": """
      WITH t AS (SELECT conv_id, turn, (CASE turn % 3 WHEN 0 THEN 'Yes, ' WHEN 1 THEN 'no: ' ELSE 'yes and no ' END) || (CASE WHEN conv_id % 2 = 0 THEN 'verbal' ELSE 'pivot or ambient' END) AS said FROM conversations)
      SELECT conv_id, turn, said, CASE turn % 3 WHEN 0 THEN true WHEN 1 THEN false END AS presence, CASE WHEN conv_id % 2 = 0 THEN 'verbal' END AS reaction FROM t""",
    "event_names": "SELECT doc_id, lang || '_bell_' || doc_id AS name, lang || ' bell ' || doc_id AS pretty FROM documents",
    "safe_ids": """
      WITH p AS (SELECT page_id, url, coalesce(nullif(substring(regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g'), 1, 24), ''), 'id') AS s FROM pages),
      c AS (SELECT s, arg_min(url, page_id) AS first FROM p GROUP BY s)
      SELECT page_id, CASE WHEN url IS DISTINCT FROM first THEN substring(s, 1, 15) || '-' || substring(sha1(url), 1, 8) ELSE s END AS safe_id FROM p JOIN c USING (s)""",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "loose_json_reply": """
      SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 5, 7) THEN 'ok' WHEN event_id % 10 IN (2, 3, 8) THEN 'ok_literal' WHEN event_id % 10 = 6 THEN 'empty_response' ELSE 'no_json' END AS status,
        CASE WHEN event_id % 10 NOT IN (4, 6, 9) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
    "compositions30": """
      WITH n AS (SELECT unnest(range(0, 4)) AS x), c AS (SELECT p.x AS "pivot", v.x AS verbal, b.x AS behavioral, a.x AS ambient FROM n p, n v, n b, n a WHERE p.x <= 1 AND p.x + v.x + b.x + a.x <= 3),
      k AS (SELECT conv_id, count(*) FILTER (turn % 4 = 0) AS "pivot", count(*) FILTER (turn % 4 = 1) AS verbal, count(*) FILTER (turn % 4 = 2) AS behavioral, count(*) FILTER (turn % 4 = 3) AS ambient FROM (SELECT conv_id, CASE WHEN turn % 3 <> 2 THEN turn END AS turn FROM conversations) GROUP BY conv_id),
      m AS (SELECT "pivot", verbal, behavioral, ambient, count(*) AS scenarios FROM k GROUP BY ALL)
      SELECT row_number() OVER (ORDER BY "pivot" + verbal + behavioral + ambient, "pivot", verbal, behavioral) - 1 AS position, 'P' || "pivot" || 'V' || verbal || 'B' || behavioral || 'A' || ambient AS composition, "pivot", verbal, behavioral, ambient, coalesce(scenarios, 0) AS scenarios FROM c LEFT JOIN m USING ("pivot", verbal, behavioral, ambient)""",
    "quota_even": "SELECT o_orderpriority, i, total // 7 + CASE WHEN i < total % 7 THEN 1 ELSE 0 END AS quota FROM (SELECT o_orderpriority, count(*) AS total FROM orders GROUP BY 1), (SELECT unnest(range(0, 7)) AS i)",
    "quota_weighted": """
      WITH g AS (SELECT lang, source, count(*) AS w FROM documents GROUP BY ALL), e AS (SELECT *, CAST(100 * w AS DOUBLE) / sum(w) OVER (PARTITION BY lang) AS x FROM g),
      f AS (SELECT *, CAST(floor(x) AS BIGINT) AS fl FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY x - fl DESC, source) AS rank, 100 - sum(fl) OVER (PARTITION BY lang) AS rest FROM f)
      SELECT lang, source, fl + CASE WHEN rank <= rest THEN 1 ELSE 0 END AS quota FROM r""",
    "stratified_split": _SPLIT + "SELECT * FROM split",
    "file_partition_sha1": _FILES,
    "split_report": _SPLIT + "SELECT split, count(*) AS n, count(DISTINCT source) AS templates, count(DISTINCT lang) AS themes FROM split GROUP BY split",
    "leak_audit": _SPLIT + "SELECT source, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM split GROUP BY source HAVING count(DISTINCT split) > 1",
    "pool_check": _SPLIT + """, p AS (SELECT lang || '/' || source AS pool, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM split GROUP BY 1)
      SELECT * FROM p WHERE train = 0 OR dev = 0 OR test = 0""",
    "round_robin_shards": "SELECT page_id, (row_number() OVER (ORDER BY page_id, url) - 1) % 4 AS shard FROM pages",
    "register_cycle": """
      WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha1('r|' || p_partkey), p_partkey) - 1 AS rank FROM part),
      c AS (SELECT *, rank // 7 AS cycle FROM r)
      SELECT p_partkey, cycle, CAST(string_split(list_sort(list_transform(range(7), lambda i: sha1('cycle|' || p_brand || '|' || cycle || '|' || i) || '#' || i))[rank % 7 + 1], '#')[2] AS BIGINT) AS register FROM c""",
    "event_balance": """
      WITH e AS (SELECT CASE WHEN l_suppkey % 10 = 7 THEN 'rare_events/' WHEN l_suppkey % 3 = 0 THEN 'general/' ELSE 'yard/' END || l_suppkey AS id, l_returnflag AS f FROM lineitem),
      c AS (SELECT id, count(*) AS used, count(*) FILTER (f = 'A') AS a, count(*) FILTER (f = 'N') AS n, count(*) FILTER (f = 'R') AS r FROM e GROUP BY 1),
      u AS (SELECT *, starts_with(id, 'general/') AS g, row_number() OVER (ORDER BY used) - 1 AS k, count(*) OVER () AS m FROM c WHERE NOT starts_with(id, 'rare_events/')),
      o AS (SELECT sum(a) / sum(used) AS share_pivot, sum(n) / sum(used) AS share_verbal, CAST(0 AS DOUBLE) AS share_behavioral, sum(r) / sum(used) AS share_ambient FROM u),
      d AS (SELECT unnest([abs(a / used - share_pivot), abs(n / used - share_verbal), CAST(0 AS DOUBLE), abs(r / used - share_ambient)]) AS gap FROM u, o)
      SELECT (SELECT count(*) FROM e) AS n_placements, (SELECT count(*) FROM c) AS n_event_ids, min(used) AS least, max(used) AS most, max(used) FILTER (k = m // 2) AS median, count(*) FILTER (g) AS n_general, count(*) FILTER (NOT g) AS n_scene,
        round(coalesce(avg(used) FILTER (g), 0), 6) AS mean_general, round(coalesce(avg(used) FILTER (NOT g), 0), 6) AS mean_scene, round(coalesce(sum(used) FILTER (g), 0) / sum(used), 6) AS share_general,
        (SELECT round(share_pivot, 6) FROM o) AS share_pivot, (SELECT round(share_verbal, 6) FROM o) AS share_verbal, (SELECT share_behavioral FROM o) AS share_behavioral, (SELECT round(share_ambient, 6) FROM o) AS share_ambient,
        (SELECT round(100 * avg(gap), 6) FROM d) AS mean_gap, (SELECT round(100 * max(gap), 6) FROM d) AS max_gap FROM u""",
    "catalog_pool": _CATALOG + "SELECT scene, event, CAST(branch AS BIGINT) AS branch FROM pool",
    "catalog_gaps": _CATALOG + "SELECT s.scene, count(DISTINCT event) AS n FROM scenes s LEFT JOIN pool p ON p.scene = s.scene GROUP BY s.scene HAVING count(DISTINCT event) < 26",
    "catalog_unknown": "SELECT o_orderkey, o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "catalog_summary": _CATALOG + """SELECT 'own' AS bank, count(*) AS n FROM own UNION ALL SELECT 'shared', count(*) FROM shared UNION ALL SELECT 'general', count(*) FROM general
      UNION ALL SELECT 'scenes', count(*) FROM scenes UNION ALL SELECT 'forbidden', count(*) FROM forbidden""",
    "accept_filter": "SELECT doc_id, (n_chars % 100) / 100.0 >= 0.6 AND coalesce(CASE WHEN doc_id % 5 > 0 THEN doc_id % 4 <> 0 END, false) AS accepted FROM documents",
    "regen_list": _STEPS + "SELECT doc_id, n_attempts, state FROM steps",
    "stratum_acceptance": _STEPS + """SELECT lang, count(*) AS n, count(*) FILTER (state = 'accepted') AS n_accepted, count(*) FILTER (state = 'accepted') / count(*) AS acceptance_rate, count(*) FILTER (state = 'accepted' AND doc_id % 3 = 0) AS n_first_try,
      count(*) FILTER (state = 'accepted' AND doc_id % 3 = 0) / count(*) AS first_try_rate, sum(n_attempts) / count(*) AS mean_attempts FROM steps GROUP BY lang""",
    "attempt_history": _STEPS + "SELECT doc_id, doc_id % 3 = 0 AS first, (doc_id + max(pass)) % 3 = 0 AS last, count(*) AS n FROM attempts GROUP BY doc_id",
    "rescue_rule": _TAGGED + """, e AS (SELECT conv_id, turn, conv_id + turn AS k, EXISTS (SELECT 1 FROM faults f WHERE f.conv_id = t.conv_id AND f.turn = t.turn AND fault IS NULL) AS confirmed FROM t WHERE heard),
      r AS (SELECT *, CASE WHEN k % 4 > 0 THEN 'behavioral' ELSE 'verbal' END AS gold, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 3 > 0 THEN 'ambient' ELSE 'behavioral' END AS pred FROM e),
      x AS (SELECT *, gold = 'behavioral' AND pred = 'ambient' AND confirmed AS rescued FROM r)
      SELECT conv_id, count(*) AS n_sounds, count(*) FILTER (gold = pred OR rescued) AS n_correct, count(*) FILTER (pred = 'missing') AS n_missing, count(*) FILTER (rescued) AS n_rescued, count(*) FILTER (gold = pred OR rescued) = count(*) AS reactions_ok FROM x GROUP BY conv_id""",
    "cosine_pairs": """
      SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3""",
    "cosine_accept": """
      WITH c AS (SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
      SELECT vec_id, cosine, cosine >= CAST(0.1 AS DOUBLE) AS accepted FROM c""",
    "carried_fields": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 3 <> 0 THEN upper(lang) END AS lang, source FROM documents",
    "cache_union": _CACHES + "SELECT event_id, answer, error FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY error, k) AS n FROM (SELECT *, 0 AS k FROM a UNION ALL SELECT *, 1 FROM b)) WHERE n = 1",
    "cache_completeness": _CACHES + """, c AS (SELECT * FROM b WHERE event_id % 8 <> 3 OR error)
      SELECT coalesce(a.event_id, c.event_id) AS event_id, CASE WHEN c.event_id IS NULL THEN 'missing' WHEN a.event_id IS NULL THEN 'intruder' WHEN a.answer IS DISTINCT FROM c.answer THEN 'divergent' WHEN c.error THEN 'error' ELSE 'ok' END AS finding
      FROM a FULL JOIN c ON a.event_id = c.event_id""",
    "cache_runs": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "cache_reparse": _CACHES + "SELECT event_id, CASE WHEN NOT error AND event_id % 9 = 0 THEN upper(answer) ELSE answer END AS answer, NOT error AND event_id % 9 = 0 AND upper(answer) <> answer AS changed FROM a",
    "resume_pending": "SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')",
    "summary_merge": "SELECT o_orderpriority AS task, CASE WHEN o_orderpriority < '3' THEN -count(*) ELSE count(*) END AS n FROM orders GROUP BY 1",
    "distance_level": f"""
      WITH t AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity / 4 AS m, CAST(CASE l_returnflag WHEN 'A' THEN -20 WHEN 'R' THEN -17 ELSE -23 END AS DOUBLE) AS base FROM lineitem)
      SELECT l_orderkey, l_linenumber, round(greatest(base + greatest(least({_OFFSET}, 4), -9), -34), 6) AS level, round(CASE WHEN m > 2 THEN greatest(18000 * power(2 / m, 0.6), 3500) END, 6) AS cutoff FROM t""",
    "duck_limit": """
      WITH t AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, -30 + l_quantity / 3 AS e FROM lineitem), b AS (SELECT *, round(e + 25, 2) AS m FROM t)
      SELECT l_orderkey, l_linenumber, round(greatest(-9, -greatest(-14 - e, 0)), 6) AS duck,
        CASE WHEN m >= 0 AND m < 6 THEN '0-6 dB' WHEN m >= 6 AND m < 10 THEN '6-10 dB' WHEN m >= 10 AND m < 15 THEN '10-15 dB' WHEN m >= 15 THEN '15-inf dB' ELSE 'unknown' END AS bucket FROM b""",
    "background_jitter": """
      WITH u AS (SELECT DISTINCT conv_id, CAST(('0x' || substring(sha1('bg|' || conv_id), 1, 8)) AS BIGINT) / 4294967296 AS u FROM conversations), r AS (SELECT *, (u * 90) % 30 AS rest FROM u)
      SELECT conv_id, round(-32 + (2 * u - 1) * 3, 6) AS lufs, round(CASE WHEN rest > 0 AND rest < 1 THEN 1 - rest ELSE 0 END, 6) AS pad FROM r""",
    "signal_fade": """
      WITH t AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v, i: v * power(sin(pi() / 2 * least(least(i - 1, 64 - i) / CAST(7 AS DOUBLE), 1)), 2)) AS x FROM embeddings)
      SELECT vec_id, round(x[1], 9) + 0 AS x0, round(x[2], 9) AS x1, round(x[5], 9) AS x4, round(x[8], 9) AS x7, round(x[31], 9) AS x30, round(x[58], 9) AS x57, round(x[64], 9) + 0 AS x63,
        round(list_sum(list_transform(x, lambda v, i: v * i)), 6) AS weighted FROM t""",
    "signal_trim": """
      WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      v AS (SELECT vec_id, e, list_transform(range(1, 65), lambda i: sqrt(list_sum(list_transform(range(i - 2, i + 2), lambda j: power(e[greatest(1, least(64, j))], 2))) / 4 + 1e-12)) AS v FROM t),
      l AS (SELECT vec_id, e, list_filter(range(1, 65), lambda i: v[i] >= list_max(v) * power(10, CAST(-0.3 AS DOUBLE))) AS loud FROM v),
      c AS (SELECT vec_id, e, greatest(1, loud[1] - 12) AS a, least(64, loud[-1] + 12) AS b FROM l)
      SELECT vec_id, b - a + 1 AS n, round(e[a], 9) AS first FROM c""",
    "voice_pair": """
      WITH u AS (SELECT DISTINCT conv_id, CAST(floor(CAST(('0x' || substring(sha1('voice|' || conv_id), 1, 8)) AS BIGINT) / 4294967296 * 8) AS BIGINT) AS a, CAST(floor(CAST(('0x' || substring(sha1('other|' || conv_id), 1, 8)) AS BIGINT) / 4294967296 * 7) AS BIGINT) AS b FROM conversations)
      SELECT conv_id, a AS voice_a, (a + 1 + b) % 8 AS voice_b FROM u""",
    "streaming_tumbling": "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "streaming_session": """
      WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "canonical_records": _SCENARIOS + """
      SELECT CAST(conv_id AS VARCHAR) AS scenario_id, CASE WHEN conv_id % 4 = 0 THEN 'Template' ELSE coalesce(label, '') END AS theme_title, CASE WHEN conv_id % 3 = 0 THEN 'About' ELSE '' END AS theme_description, label AS theme_label,
        CASE WHEN conv_id % 2 = 0 THEN 'subject ' ELSE 'made ' END || conv_id AS subject, CASE WHEN conv_id % 5 = 0 THEN 'clerk' ELSE 'guest' END AS role_a, 'owner' AS role_b, n_events, n_reacted_to, 'r' || n_reacted_to AS stratum,
        any_rare OR coalesce(flag, false) AS has_rare, has_pivot, coalesce(flag, any_rare) AS has_rare_event, coalesce(events, '') AS events FROM s""",
    "record_distributions": _SCENARIOS + """
      SELECT kind, value, count(*) AS n FROM (
        SELECT 'composition' AS kind, 'P' || p || 'V' || v || 'B' || b || 'A' || a AS value FROM s UNION ALL SELECT 'n_events', CAST(n_events AS VARCHAR) FROM s UNION ALL SELECT 'scene', 'scene_' || conv_id % 4 FROM s
        UNION ALL SELECT 'relation', CASE WHEN conv_id % 5 = 0 THEN 'clerk' ELSE 'guest' END || ' / owner' FROM s UNION ALL SELECT 'flag', 'pivot' FROM s WHERE has_pivot UNION ALL SELECT 'flag', 'rare' FROM s WHERE coalesce(flag, any_rare)
        UNION ALL SELECT 'reaction', reaction FROM e UNION ALL SELECT 'event', role || '/loud_knock_' || turn FROM e) GROUP BY ALL""",
    "inferred_verdicts": """
      WITH r AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'not an object' WHEN event_id % 7 = 0 THEN 'subject empty or too short' WHEN event_id % 5 = 0 THEN 'invalid reaction' END AS reason FROM events)
      SELECT event_id, CASE WHEN reason IS NULL THEN 'a subject' END AS subject, CASE WHEN reason IS NULL THEN event_type || '=verbal' || CASE WHEN event_type <> 'click' THEN ',click=pivot' ELSE '' END END AS predicted, CASE WHEN reason IS NULL THEN 'ghost' END AS spurious, reason FROM r""",
    "judge_verdicts": f"""
      WITH t AS (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:3], ' ') AS first, {_FOLD.format(t='text')} AS folded FROM conversations),
      q AS (SELECT conv_id, turn, folded, {_FOLD.format(t='first')} AS quote FROM t),
      f AS (SELECT conv_id, turn, len(list_filter(string_split(quote, ' '), lambda w: w <> '')) >= 2 AND contains(folded, quote) AS ok FROM q)
      SELECT conv_id, turn, CASE WHEN ok THEN 'bell' ELSE '' END AS heard, CASE WHEN ok THEN 'dog' ELSE '' END AS nature, '' AS discussed, 'horn' AS off_list, CASE WHEN ok THEN 'cat' ELSE 'bell,bell,dog,cat' END AS no_evidence FROM f""",
    "summary_scores": _SUMMARIES + """, c AS (SELECT budget, reaction, count(*) AS n_present, count(*) FILTER (m) AS n_mentioned, count(*) FILTER (d) AS n_discussed FROM g WHERE used AND reaction <> '' GROUP BY budget, reaction)
      SELECT *, n_present / sum(n_present) OVER w AS share_present, n_mentioned / nullif(sum(n_mentioned) OVER w, 0) AS share_mentioned, n_mentioned / n_present AS recall FROM c WINDOW w AS (PARTITION BY budget)""",
    "summary_scores_by_sound": _SUMMARIES + """, u AS (SELECT conv_id, turn, any_value(reaction) AS reaction, max(CAST(m AS INT)) AS m, max(CAST(d AS INT)) AS d FROM g WHERE used AND reaction <> '' AND NOT rare GROUP BY conv_id, turn),
      c AS (SELECT reaction, count(*) AS n_present, CAST(sum(m) AS BIGINT) AS n_mentioned, CAST(sum(d) AS BIGINT) AS n_discussed FROM u GROUP BY reaction)
      SELECT *, n_present / sum(n_present) OVER () AS share_present, n_mentioned / nullif(sum(n_mentioned) OVER (), 0) AS share_mentioned, n_mentioned / n_present AS recall FROM c""",
    "summary_lengths": _SUMMARIES + f""", s AS (SELECT conv_id, budget, any_value(summary) AS summary, bool_or(m) AS any_m FROM g WHERE used GROUP BY conv_id, budget),
      w AS (SELECT budget, any_m, CASE WHEN summary <> '' THEN len({_WORDS.format(t='summary')}) END AS w FROM s)
      SELECT budget, count(*) AS n_scenes, list_sort(list(w) FILTER (w IS NOT NULL))[count(w) // 2 + 1] AS median_words, count(*) FILTER (w > 1.5 * budget) / nullif(count(w), 0) AS over_budget_rate, count(*) FILTER (NOT any_m) AS n_without FROM w GROUP BY budget""",
    "scene_items": _MANIFESTS + """, i AS (SELECT DISTINCT conv_id, scene, conv_id || '::scene' AS item_id FROM m WHERE scene IS NOT NULL),
      d AS (SELECT item_id, r_name AS o, row_number() OVER (PARTITION BY item_id ORDER BY sha1('draw|' || item_id || '|' || r_name)) AS k FROM i, region WHERE r_name <> scene),
      u AS (SELECT item_id, o FROM d WHERE k <= 3 UNION ALL SELECT item_id, scene FROM i)
      SELECT item_id, conv_id, scene, scene AS gold, string_agg(o, ' / ' ORDER BY sha1('show|' || item_id || '|' || o)) AS options FROM u JOIN i USING (item_id) GROUP BY ALL""",
    "sound_items": _CATALOG.replace("WITH scenes", "WITH scenes", 1) + _MANIFESTS.replace("WITH m AS", ", m AS", 1) + """, i AS (SELECT conv_id, scene, conv_id || '::mcq-sound::' || rank AS item_id, t, reaction, margin_db, replace(replace(event_id, 'x/', ''), '_', ' ') AS gold FROM m WHERE scene IS NOT NULL),
      names AS (SELECT DISTINCT scene, replace(event, '_', ' ') AS o FROM pool),
      d AS (SELECT item_id, o, row_number() OVER (PARTITION BY item_id ORDER BY sha1('draw|' || item_id || '|' || o)) AS k FROM i JOIN names USING (scene) WHERE NOT EXISTS (SELECT 1 FROM i AS h WHERE h.conv_id = i.conv_id AND h.gold = o)),
      u AS (SELECT item_id, o FROM d WHERE k <= 3 UNION ALL SELECT item_id, gold FROM i),
      q AS (SELECT item_id, string_agg(o, ' / ' ORDER BY sha1('show|' || item_id || '|' || o)) AS options FROM u GROUP BY item_id HAVING count(*) = 4)
      SELECT item_id, conv_id, scene, t, gold, options, reaction, margin_db FROM i JOIN q USING (item_id)""",
    "reaction_items": _MANIFESTS + "SELECT conv_id || '::reaction::' || rank AS item_id, conv_id, scene, event_id, t AS start_s, margin_db, reaction AS gold FROM m WHERE reaction <> 'other'",
    "gold_sounds": _MANIFESTS + "SELECT conv_id, event_id, replace(replace(event_id, 'x/', ''), '_', ' ') AS name, reaction, turn % 3 = 0 AS is_rare, margin_db FROM m",
    "word_offsets": f"""
      WITH t AS (SELECT conv_id, turn, lower({_SPOKEN}) AS s FROM conversations),
      z AS (SELECT conv_id, turn, unnest(regexp_extract_all(s, '[^a-z'']*[a-z'']+')) AS piece, generate_subscripts(regexp_extract_all(s, '[^a-z'']*[a-z'']+'), 1) AS n FROM t),
      o AS (SELECT conv_id, turn, regexp_extract(piece, '[a-z'']+$') AS word, sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY n) - length(regexp_extract(piece, '[a-z'']+$')) AS place FROM z)
      SELECT conv_id, turn, count(*) AS n, CAST(sum(place) AS BIGINT) AS places, CAST(max(place) AS BIGINT) AS last, CAST(sum(length(word)) AS BIGINT) AS letters FROM o GROUP BY conv_id, turn""",
    "resume_offsets": r"""
      WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(CASE WHEN turn % 3 = 0 THEN text || '... ' || text ELSE text END, '\[[^\]]+\]', ' ', 'g'))) AS s FROM conversations),
      c AS (SELECT conv_id, turn, s, list_transform(range(1, length(s) + 1), lambda i: regexp_matches(substring(s, i, 1), '[a-z'']')) AS f FROM t),
      k AS (SELECT conv_id, turn, s, list_filter(range(1, len(f) + 1), lambda i: f[i] AND (i = 1 OR NOT f[i - 1])) AS starts FROM c),
      w AS (SELECT conv_id, turn, s, starts[n] - 1 AS off, n - 1 AS n, (n - 1) * CAST(0.4 AS DOUBLE) + ((n - 1) // 7) * CAST(1.3 AS DOUBLE) AS z FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS n FROM k)),
      l AS (SELECT *, lag(z) OVER v + CAST(0.3 AS DOUBLE) AS ended, lag(off) OVER v AS before FROM w WINDOW v AS (PARTITION BY conv_id, turn ORDER BY n)),
      b AS (SELECT conv_id, turn, min(z) AS o FROM w WHERE off > least(CASE WHEN contains(s, '...') THEN instr(s, '...') END, CASE WHEN contains(s, '…') THEN instr(s, '…') END) - 1 GROUP BY conv_id, turn),
      p AS (SELECT conv_id, turn, min(z) AS o FROM l WHERE z - ended >= 1.2 AND NOT regexp_matches(replace(replace(substring(s, before + 1, off - before), '...', ' '), '…', ' '), '[.!?]') GROUP BY conv_id, turn)
      SELECT conv_id, turn, CAST(round(least(b.o, p.o), 6) AS DOUBLE) AS "offset", CASE WHEN b.o <= coalesce(p.o, b.o) THEN 'break' WHEN p.o IS NOT NULL THEN 'pause' END AS kind
      FROM (SELECT DISTINCT conv_id, turn FROM w) LEFT JOIN b USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn)""",
    "event_tags": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[laughs]' WHEN 2 THEN '[clears throat]' END AS tag, CASE WHEN event_id % 2 = 0 THEN '[gunshot]' END AS effect FROM events",
    "composition_sequence": """
      WITH n AS (SELECT unnest(range(0, 4)) AS x), c AS (SELECT p.x AS p, v.x AS v, b.x AS b, a.x AS a FROM n p, n v, n b, n a WHERE p.x <= 1 AND p.x + v.x + b.x + a.x <= 3),
      e AS (SELECT *, CAST((SELECT count(*) FROM part) AS DOUBLE) * power(CAST(2 AS DOUBLE), p) / sum(power(CAST(2 AS DOUBLE), p)) OVER () AS x, row_number() OVER (ORDER BY p + v + b + a, p, v, b) - 1 AS position FROM c),
      q AS (SELECT *, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, position) <= (SELECT count(*) FROM part) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM e),
      u AS (SELECT 'P' || p || 'V' || v || 'B' || b || 'A' || a AS composition, p, v, b, a, unnest(range(0, quota)) AS u FROM q)
      SELECT row_number() OVER (ORDER BY sha1('composition|' || composition || '|' || p || '|' || v || '|' || b || '|' || a || '|' || u)) - 1 AS local, composition FROM u""",
    "scenario_todos": _TODOS + """
      SELECT 'scene' AS kind, r_name AS value, n // 5 + CASE WHEN row_number() OVER (ORDER BY r_name) <= n % 5 THEN 1 ELSE 0 END AS n FROM region, size UNION ALL
      SELECT 'gender', g, n // 4 + CASE WHEN k <= n % 4 THEN 1 ELSE 0 END FROM (VALUES ('FF', 1), ('FM', 2), ('MF', 3), ('MM', 4)) v(g, k), size UNION ALL
      SELECT 'relation', lower(n_name), n // 25 + CASE WHEN row_number() OVER (ORDER BY n_name || '|' || lower(n_name)) <= n % 25 THEN 1 ELSE 0 END FROM nation, size UNION ALL
      SELECT 'composition', composition, quota FROM comps UNION ALL
      SELECT 'rare', 'with pivot 1', least(CAST(round(n * 0.05) AS BIGINT), pivots) FROM size, pivots UNION ALL SELECT 'rare', 'no', n - least(CAST(round(n * 0.05) AS BIGINT), pivots) FROM size, pivots""",
    "scenario_events": _SCENARIO_EVENTS,
    "distance_ranges": """
      WITH e AS (SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN 'beach' WHEN 1 THEN 'rare_events' ELSE 'rural' END AS ns, event_type AS leaf, event_id % 2 = 0 AS office FROM events),
      r AS (SELECT n, CAST(CASE WHEN ns = 'beach' AND leaf = 'view' THEN 5 WHEN ns = 'rare_events' THEN CASE WHEN leaf = 'click' THEN 300 ELSE 5 END WHEN leaf = 'view' THEN 5 WHEN office THEN 1 ELSE 1.5 END AS DOUBLE) AS near,
        CAST(CASE WHEN ns = 'beach' AND leaf = 'view' THEN 60 WHEN ns = 'rare_events' THEN CASE WHEN leaf = 'click' THEN 3000 ELSE 60 END WHEN leaf = 'view' THEN 60 WHEN office THEN 6 ELSE 20 END AS DOUBLE) AS far FROM e)
      SELECT n, near, far, round(near + (far - near) * (CAST(('0x' || substring(sha1('m|' || n), 1, 8)) AS BIGINT) / 4294967296), 6) AS metres, round(least(0.25, near * near / (near * near + CAST(4 AS DOUBLE) * (1 / CAST(0.05 AS DOUBLE) - 1))), 9) AS wet FROM r""",
    "rare_pool": _CATALOG + "SELECT scene, event FROM pool WHERE branch = 2",
    "event_layers": """
      SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'rare'
        WHEN CAST(('0x' || substring(sha1('layer|' || event_id), 1, 8)) AS BIGINT) / 4294967296 < 0.35 THEN 'supporting' ELSE 'core' END END AS layer FROM events""",
    "spaced_turns": """
      WITH t AS (SELECT conv_id, turn, turn * CAST(2 AS DOUBLE) AS s, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN CAST(0 AS DOUBLE) WHEN conv_id % 7 = 0 AND turn = 0 THEN NULL ELSE turn * CAST(2 AS DOUBLE) + 1.5 END AS e, conv_id % 3 * CAST(4 AS DOUBLE) + 5 AS l, turn = max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
      b AS (SELECT *, CASE WHEN e IS NOT NULL THEN greatest(0, least(l, e)) END AS c FROM t),
      w AS (SELECT *, NOT last AND (c IS NULL OR coalesce(c < lag(c) OVER (PARTITION BY conv_id ORDER BY turn), false)) AS wrong FROM b),
      v AS (SELECT *, bool_or(wrong) OVER (PARTITION BY conv_id) OR n < 2 AS stays FROM w),
      g AS (SELECT *, CASE WHEN last OR stays THEN 0 ELSE CAST(0.2 AS DOUBLE) + CAST(0.7 AS DOUBLE) * (CAST(('0x' || substring(sha1('gap|' || conv_id || '|' || turn), 1, 8)) AS BIGINT) / 4294967296) END AS gap FROM v),
      m AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved, lag(c) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM g)
      SELECT conv_id, turn, round(gap, 6) AS gap, round(CASE WHEN stays THEN s ELSE coalesce(p + moved, 0) END, 6) AS new_start, round(CASE WHEN stays THEN e WHEN last THEN l + moved ELSE c + moved END, 6) AS new_end FROM m""",
    "template_faults": """
      WITH t AS (SELECT n_regionkey, n_nationkey AS i, CASE WHEN n_nationkey % 8 = 3 THEN 'same' WHEN n_nationkey % 8 = 6 THEN '' ELSE lower(n_name) END AS title, n_nationkey % 11 = 7 AS short FROM nation),
      r AS (SELECT n_regionkey, i, CASE WHEN title = '' THEN 'empty title' WHEN short THEN 'description too short' WHEN row_number() OVER (PARTITION BY n_regionkey, title ORDER BY i) > 1 THEN 'duplicate title' END AS reason FROM t)
      SELECT n_regionkey, CASE WHEN count(*) <> 5 THEN 'wrong count' ELSE arg_min(reason, i) FILTER (WHERE reason IS NOT NULL) END AS reason, CASE WHEN count(*) = 5 THEN min(i) FILTER (WHERE reason IS NOT NULL) END AS position FROM r GROUP BY n_regionkey""",
    "word_table": _TURN_WORDS + "SELECT conv_id, turn, position - 1 AS position, words[position] AS word, starts[position] - 1 AS offset FROM (SELECT *, unnest(range(1, len(words) + 1)) AS position FROM k)",
    "turns_from_words": _TURN_WORDS + """,
      b AS (SELECT conv_id, turn, turn * 60.0::DOUBLE + (starts[1] - 1) / 16 AS s, turn * 60.0::DOUBLE + (starts[-1] - 1 + length(words[-1])) / 16 AS e FROM k WHERE len(words) > 0),
      l AS (SELECT conv_id, max(turn) * 60.0::DOUBLE + 120 AS duration FROM conversations WHERE conv_id % 5 > 0 GROUP BY conv_id),
      m AS (SELECT conv_id, turn, e, duration, (lag(e) OVER w + s) / 2 AS before, (e + lead(s) OVER w) / 2 AS after FROM b LEFT JOIN l USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id, turn, coalesce(before, 0) AS turn_start, coalesce(after, duration, e) AS turn_end FROM m""",
    "turns_by_source": """
      WITH n AS (SELECT conv_id, count(*) AS n, CASE WHEN conv_id % 3 = 0 THEN 'alignment' WHEN conv_id % 3 = 1 AND conv_id % 2 = 0 THEN 'meta' WHEN conv_id % 5 < 4 THEN 'plain' END AS source FROM conversations GROUP BY conv_id)
      SELECT conv_id, source, n FROM n WHERE source IS NOT NULL""",
    "voices_by_gender": """
      WITH p AS (SELECT n_name AS v, CASE WHEN n_nationkey % 3 = 0 THEN 'f' ELSE 'm' END AS g FROM nation),
      l AS (SELECT list(v ORDER BY v) AS every, list(v ORDER BY v) FILTER (g = 'f') AS f, list(v ORDER BY v) FILTER (g = 'm') AS m FROM p),
      s AS (SELECT DISTINCT conv_id, CASE conv_id % 4 WHEN 1 THEN 'f' WHEN 2 THEN 'm' WHEN 3 THEN 'x' END AS gender_a, CASE WHEN conv_id % 3 = 0 THEN 'f' ELSE 'm' END AS gender_b,
        CAST('0x' || substring(sha1('voice|' || conv_id), 1, 8) AS BIGINT) / 4294967296 AS ua, CAST('0x' || substring(sha1('voice b|' || conv_id), 1, 8) AS BIGINT) / 4294967296 AS ub FROM conversations),
      a AS (SELECT s.*, CASE gender_a WHEN 'f' THEN f WHEN 'm' THEN m ELSE every END AS pa, CASE WHEN gender_a IS NULL THEN every WHEN gender_b = 'f' THEN f ELSE m END AS pb FROM s, l),
      c AS (SELECT *, pa[1 + CAST(floor(ua * len(pa)) AS BIGINT)] AS voice_a FROM a),
      r AS (SELECT *, list_filter(pb, lambda x: x <> voice_a) AS rest FROM c)
      SELECT conv_id, gender_a, gender_b, voice_a, rest[1 + CAST(floor(ub * len(rest)) AS BIGINT)] AS voice_b FROM r""",
    "speaker_gains": """
      WITH l AS (SELECT user_id, event_type, 20 * log10(sqrt(avg(value * value) + 1e-12) + 1e-12) AS level FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type),
      o AS (SELECT *, avg(level) OVER (PARTITION BY user_id) - level AS off FROM l)
      SELECT user_id, event_type, round(level, 4) AS level, round(CASE WHEN abs(off) < 0.1 THEN 0 ELSE greatest(least(off, 12), -12) END, 4) AS gain FROM o""",
    "made_again": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "frequent_answers": _ANSWERS + "SELECT answer, count(*) AS n FROM a WHERE answer IS NOT NULL GROUP BY answer ORDER BY n DESC, answer LIMIT 5",
    "transcripts": """
      WITH t AS (SELECT conv_id, string_agg(CASE WHEN turn % 3 = 2 THEN '[SOUND: e/knock_' || turn % 4 || ']' WHEN turn % 7 <> 6 THEN (CASE role WHEN 'user' THEN 'A' ELSE 'B' END) || ': ' || coalesce(text, '') END, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id),
      e AS (SELECT conv_id, 'e/knock_' || turn % 4 AS id, min(turn) AS first FROM conversations WHERE turn % 3 = 2 GROUP BY ALL)
      SELECT conv_id, coalesce(said, '') AS transcript, coalesce(heard, '') AS heard FROM t LEFT JOIN (SELECT conv_id, string_agg(id, ',' ORDER BY first) AS heard FROM e GROUP BY conv_id) USING (conv_id)""",
    "event_prompts": """
      WITH l AS (SELECT conv_id, turn, 'x/hum_' || turn AS id, '    - x/hum_' || turn || '  →  ' || ['PIVOT', 'VERBAL', 'AMBIENT'][turn % 3 + 1] || (CASE turn % 3 WHEN 2 THEN '  (rare, disruptive)' ELSE '' END)
        || (CASE turn % 4 WHEN 0 THEN '   [PLACEMENT: in the FIRST THIRD of the conversation]' WHEN 2 THEN '   [PLACEMENT: in the LAST THIRD of the conversation]' ELSE '' END)
        || (CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN chr(10) || '        move calm: stop short' || chr(10) || '        tags: [gasps], [sighs]' WHEN turn % 3 = 1 AND turn % 2 = 1 THEN chr(10) || '        move terse: ask about it' ELSE '' END) AS line FROM conversations),
      p AS (SELECT conv_id, 'Pivot ' || coalesce(arg_min(id, turn) FILTER (turn % 3 = 0), '') || chr(10) || string_agg('    - ' || id, chr(10) ORDER BY turn) || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS task FROM l GROUP BY conv_id)
      SELECT conv_id, 'system' AS role, 'Write.' AS content FROM p UNION ALL SELECT conv_id, 'user', task FROM p""",
    "revealed_sounds": """
      SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 'A sound occurs.' WHEN event_id % 3 = 1 THEN printf('A sound at %.1f s.', event_id / 2) ELSE printf('A sound at %.1f s: ', event_id / 2) || 'soft ' || coalesce(replace(event_type, '_', ' '), '') || '.' END AS said,
        '  - ' || event_type || chr(10) || '  - none of them' AS options FROM events""",
    "listening_clues": """
      WITH t AS (SELECT conv_id, turn, lower(text) AS low, lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS before FROM conversations),
      w AS (SELECT *, list_filter(list_sort(list_distinct(regexp_extract_all(before, '[a-z]{6,}'))), lambda x: contains(low, x)) AS echoed FROM t)
      SELECT conv_id, turn, CASE WHEN contains(low, 'ther') OR contains(low, 'east') OR contains(low, 'hall') THEN 'ther east hall' END AS place,
        concat_ws(',', CASE WHEN contains(low, 'answer') THEN 'answer' END, CASE WHEN contains(low, 'tion') THEN 'tion of' END, CASE WHEN contains(low, 'ther') AND contains(low, 'that') THEN 'ther that' END) AS sounds,
        array_to_string(echoed[1:4], ',') AS echoed FROM w""",
    "event_placements": """
      WITH u AS (SELECT conv_id, turn, turn % 4 AS k, turn % 3 = 2 AS heard, count(*) FILTER (turn % 3 <> 2 AND turn % 7 <> 6) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations)
      SELECT conv_id, turn, 'e/knock_' || k AS event_id, CASE WHEN k = 0 THEN 'rare' WHEN k = 1 OR (k = 2 AND conv_id % 2 = 1) THEN 'supporting' ELSE 'core' END AS layer,
        CASE WHEN seen > 0 THEN seen - 1 END AS after_turn, k < 3 AND conv_id % 3 = k AS is_behavioural, CASE WHEN k = 1 THEN 'verbal' END AS reaction FROM u WHERE heard""",
    "shard_sizes": "SELECT s AS shard, count(o_orderkey) AS n FROM range(7) r(s) LEFT JOIN orders ON o_orderkey % 6 = s AND s <> 3 GROUP BY s",
    "signal_rare_duck": f"""
      WITH t AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v, i: v * least({_RARE_GAIN.format(t='(i - 3)')}, {_RARE_GAIN.format(t='(i - 21)')})) AS x FROM embeddings)
      SELECT vec_id, {', '.join(f'round(x[{i + 1}], 9) + 0 AS x{i}' for i in (1, 2, 3, 30, 50, 63))}, round(list_sum(list_transform(x, lambda v, i: v * i)), 6) AS weighted FROM t""",
    "audio_formats": """
      WITH f AS (SELECT p_partkey, coalesce(['mp3', 'pcm', 'opus'][p_partkey % 3 + 1] || '_' || CASE WHEN p_partkey % 4 > 0 THEN CAST((p_partkey % 5 + 1) * 8000 AS VARCHAR) END || CASE WHEN p_partkey % 2 = 0 THEN '_128' ELSE '' END, 'mp3_high_64') AS f FROM part)
      SELECT p_partkey, nullif(regexp_extract(f, '^mp3_[^_]*_([0-9]+)$', 1), '') || 'k' AS bitrate, CAST(regexp_extract(f, '_([0-9]+)(_|$)', 1) AS BIGINT) AS rate, round(p_partkey * 1000 / 88200, 6) AS seconds FROM f""",
    "final_dialogues": """
      SELECT CAST(conv_id AS VARCHAR) AS scenario_id, 'scene_' || conv_id % 4 AS scene, 'train' AS split, 'F' AS gender_a, count(*) FILTER (turn % 3 <> 2) AS n_events, count(*) FILTER (turn % 3 <> 2 AND turn % 7 <> 6) AS n_turns_total,
        count(*) FILTER (turn % 3 <> 2 AND turn % 7 <> 6 AND role = 'user') AS n_turns_a, count(*) FILTER (turn % 3 <> 2 AND turn % 7 <> 6 AND role <> 'user') AS n_turns_b, count(*) FILTER (turn % 3 = 2) AS n_events_in_timeline,
        md5(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS texts,
        string_agg(CASE WHEN turn % 3 = 2 THEN 'event' WHEN turn % 7 = 6 THEN 'pause' ELSE 'utterance' END, ',' ORDER BY turn) AS types FROM conversations WHERE conv_id % 9 > 0 GROUP BY conv_id""",
    "batch_results": """
      SELECT CASE WHEN o_orderkey % 4 > 0 THEN '' ELSE 'c' END || o_orderkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 'batch:succeeded' WHEN 'O' THEN 'batch:errored:' || CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'unknown' END ELSE 'batch:expired' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS reply, CASE WHEN o_orderstatus = 'O' THEN 'O' END AS parameter FROM orders""",
    "master_levels": """
      SELECT p_partkey AS scenario_id, CASE WHEN p_partkey % 5 = 0 THEN '/a/' || p_partkey || '.mp3' ELSE '/scenes/' || p_partkey || '.wav' END AS path,
        CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 0 THEN p_partkey / -8 END AS master_input_lufs, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 1 THEN 1.0::DOUBLE END AS master_limiter_gain FROM part""",
    "regeneration_report": _STEPS + """, x AS (SELECT *, state = 'accepted' AS ok, doc_id % 7 > 0 AND doc_id % 5 = 0 AS rare, lang = 'en' AS pvt FROM steps)
      SELECT count(*) AS n, count(*) FILTER (ok) AS n_accepted, count(*) FILTER (state = 'regenerate') AS n_regenerate, count(*) FILTER (state = 'abandoned') AS n_abandoned, count(*) FILTER (ok) / count(*) AS acceptance_rate,
        count(*) FILTER (rare) AS n_rare, count(*) FILTER (rare AND ok) AS n_rare_accepted, count(*) FILTER (rare AND ok) / nullif(count(*) FILTER (rare), 0) AS rare_rate, count(*) FILTER (NOT rare) AS n_usual, count(*) FILTER (NOT rare AND ok) AS n_usual_accepted,
        count(*) FILTER (NOT rare AND ok) / nullif(count(*) FILTER (NOT rare), 0) AS usual_rate, count(*) FILTER (pvt) AS n_pivot, count(*) FILTER (pvt AND ok) AS n_pivot_accepted, count(*) FILTER (pvt AND ok) / nullif(count(*) FILTER (pvt), 0) AS pivot_rate,
        CAST(sum(doc_id % 4 % 2) AS BIGINT) AS n_rescued FROM x""",
    "inference_metrics": """
      WITH e AS (SELECT doc_id, doc_id % 13 AS k, CASE WHEN doc_id % 13 > 1 AND doc_id % 6 > 0 THEN (doc_id % 10) / CAST(10 AS DOUBLE) END AS c, CASE WHEN quality = 1 THEN 'behavioral' ELSE 'ambient' END AS g, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN toxic = 1 THEN 'behavioral' ELSE 'ambient' END AS p, quality = toxic OR (quality <> 1 AND toxic <> 1) AS alike FROM labels),
      r AS (SELECT l.lang, e.*, coalesce(c >= 0.5, false) AS topic, alike AND doc_id % 11 > 0 AND doc_id % 2 = 0 AS exact FROM (SELECT doc_id, unnest([lang, 'all']) AS lang FROM documents) l JOIN e USING (doc_id) WHERE k > 1)
      SELECT lang, count(*) AS n, 2 * count(*) AS n_sounds, CAST(sum(1 + CAST(p <> 'missing' AS INT)) AS BIGINT) AS n_typed, count(*) FILTER (doc_id % 11 = 0) AS n_missing, CAST(sum(doc_id % 3) AS BIGINT) AS n_spurious, sum(CAST(g = p AS INT) + CAST(doc_id % 2 = 0 AS INT)) / (2 * count(*)) AS sound_accuracy,
        count(c) AS n_subjects, round(avg(c), 9) AS mean_cosine, count(*) FILTER (topic) / count(*) AS topic_rate, count(*) FILTER (exact) / count(*) AS reaction_rate, count(*) FILTER (topic AND exact) / count(*) AS accept_rate FROM r GROUP BY lang""",
    "timeline_validation": _TAGGED + f""",
      u AS (SELECT *, lag(speaker, 1) OVER w AS s1, lag(speaker, 2) OVER w AS s2 FROM t WHERE NOT heard WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      a AS (SELECT conv_id, turn, coalesce(CASE WHEN text = '' THEN 'empty text' END, {_FORBIDDEN}, CASE WHEN {_SPOKEN} = '' THEN 'no speech' WHEN len({_WORDS.format(t=_SPOKEN)}) > 150 THEN 'too long' WHEN s1 = speaker AND s2 = speaker THEN 'same speaker in a row' END) AS reason FROM u),
      own AS (SELECT conv_id, min(turn) AS position, arg_min(reason, turn) AS reason FROM a WHERE reason IS NOT NULL GROUP BY conv_id),
      c AS (SELECT conv_id, count(*) FILTER (NOT heard) AS n, count(*) FILTER (heard) AS e, count(DISTINCT speaker) FILTER (NOT heard) AS speakers, min(turn) FILTER (heard) AS first FROM t GROUP BY conv_id),
      p AS (SELECT conv_id, count(*) AS rest FROM t JOIN c USING (conv_id) WHERE NOT heard AND turn > first AND conv_id % 3 = 0 GROUP BY conv_id),
      x AS (SELECT *, sum(CAST(NOT heard AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS seen, sum(CAST(NOT heard AS INT)) OVER (PARTITION BY conv_id) AS total FROM t),
      o AS (SELECT conv_id, min(turn) AS at FROM x WHERE heard AND conv_id % 2 = 0 AND total >= 3 AND seen / total > CAST(1 AS DOUBLE) / 3 + CAST(0.1 AS DOUBLE) GROUP BY conv_id),
      m AS (SELECT conv_id, min(turn) AS at FROM t JOIN c USING (conv_id) WHERE NOT heard AND e > 0 AND regexp_matches(lower(text), '(^|[^a-z0-9_])loud($|[^a-z0-9_])') AND regexp_matches(lower(text), '(^|[^a-z0-9_])knock($|[^a-z0-9_])') GROUP BY conv_id),
      g AS (SELECT conv_id, min(turn) AS at, arg_min(fault, turn) AS fault FROM faults WHERE fault IS NOT NULL GROUP BY conv_id),
      r AS (SELECT c.conv_id, CASE WHEN own.reason IS NOT NULL THEN own.reason WHEN n < 2 THEN 'too few turns' WHEN n > 6 + CASE WHEN c.conv_id % 3 = 0 AND e > 0 THEN e + 1 ELSE 0 END THEN 'too many turns'
        WHEN c.conv_id % 3 = 0 AND e > 0 AND coalesce(rest, 0) < 4 THEN 'pivot too late' WHEN o.at IS NOT NULL THEN 'event outside its slot' WHEN m.at IS NOT NULL THEN 'names the event' WHEN g.at IS NOT NULL THEN g.fault WHEN speakers <> 2 THEN 'missing speakers' END AS reason, own.position, o.at AS slot_at, m.at AS named_at, g.at AS tag_at, g.fault
        FROM c LEFT JOIN own USING (conv_id) LEFT JOIN p USING (conv_id) LEFT JOIN o USING (conv_id) LEFT JOIN m USING (conv_id) LEFT JOIN g USING (conv_id))
      SELECT conv_id, reason IS NULL AS valid, reason, CASE WHEN position IS NOT NULL THEN position WHEN reason = 'event outside its slot' THEN slot_at WHEN reason = 'names the event' THEN named_at WHEN reason = fault THEN tag_at END AS position FROM r""",
    "spaced_signals": """
      WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, vec_id % 20 + 10 AS b0, vec_id % 20 + 30 AS b1, vec_id % 4 AS g0, vec_id % 7 AS g1 FROM embeddings),
      l AS (SELECT *, list_transform(x, lambda v: v * v) AS q FROM e),
      a AS (SELECT *, b0 - 6 + list_position(q[b0 - 5:b0 + 6], list_min(q[b0 - 5:b0 + 6])) - 1 AS c0 FROM l),
      c AS (SELECT *, greatest(c0, b1 - 6) + list_position(q[greatest(c0, b1 - 6) + 1:b1 + 6], list_min(q[greatest(c0, b1 - 6) + 1:b1 + 6])) - 1 AS c1 FROM a),
      y AS (SELECT *, list_concat(list_concat(x[1:c0], list_transform(range(g0), lambda i: CAST(0 AS DOUBLE))), list_concat(list_concat(x[c0 + 1:c1], list_transform(range(g1), lambda i: CAST(0 AS DOUBLE))), x[c1 + 1:])) AS y FROM c)
      SELECT vec_id, c0 AS cut0, c1 AS cut1, len(y) AS n, round(list_sum(list_transform(y, lambda v, i: v * i)), 6) AS weighted FROM y""",
    "register_use": _TODOS + """,
      k AS (SELECT 'pivot' AS reaction, ['calm', 'angry', 'afraid'] AS names, sum(quota * p) AS c FROM comps UNION ALL SELECT 'verbal', ['terse', 'warm'], sum(quota * v) FROM comps UNION ALL SELECT 'behavioral', ['quick'], sum(quota * b) FROM comps),
      i AS (SELECT *, unnest(range(0, len(names))) AS i, CAST(c AS BIGINT) // len(names) AS cycle, CAST(c AS BIGINT) % len(names) AS rest FROM k),
      r AS (SELECT *, row_number() OVER (PARTITION BY reaction ORDER BY sha1('event-cycle|' || reaction || '|' || cycle || '|' || i)) AS place FROM i)
      SELECT reaction, names[i + 1] AS register, cycle + CAST(place <= rest AS BIGINT) AS n FROM r WHERE cycle + CAST(place <= rest AS BIGINT) > 0
      UNION ALL SELECT 'ambient', NULL, CAST(sum(quota * a) AS BIGINT) FROM comps HAVING sum(quota * a) > 0""",
    "strengthened_turns": r"""
      WITH s AS (SELECT conv_id, turn, turn % 6 AS k, text, regexp_extract(' ' || text, '^(\s*[^.!?]*[.!?]?)', 1) AS one FROM conversations),
      c AS (SELECT *, upper(replace(regexp_replace(one, '\.$', '!'), 'ß', 'SS')) || substring(' ' || text, length(one) + 1) AS loud FROM s),
      o AS (SELECT *, CASE k WHEN 0 THEN '[annoyed] ' || text WHEN 1 THEN loud WHEN 2 THEN text || '  now' WHEN 3 THEN 'Wait [angry]' || loud WHEN 4 THEN text || ' [laughs] Yes ' END AS said FROM c)
      SELECT conv_id, turn, CASE WHEN said IS NULL THEN text ELSE trim(regexp_replace(said, '[ \t]{2,}', ' ', 'g')) END AS said FROM o""",
    "timeline_items": """
      WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN 'event' ELSE 'utterance' END AS type FROM conversations)
      SELECT conv_id, type, count(*) AS n, count(*) FILTER (type <> 'event') AS n_spoken, sum(CASE WHEN type <> 'event' THEN length(text) END) AS letters, max(turn) AS "last" FROM t GROUP BY conv_id, type""",
    "request_batches": """
      WITH RECURSIVE o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 501 = 0 THEN 1000000 ELSE o_custkey % 97 * 40 + o_orderkey % 13 END AS bytes FROM orders),
      f AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, sum(bytes) OVER (ORDER BY o_orderkey) AS upto FROM o WHERE bytes <= 60000),
      b AS (SELECT CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS pos, CAST(0 AS HUGEINT) AS before UNION ALL
        SELECT batch + 1, pos, before FROM (SELECT b.batch, min(f.pos) AS pos, min(f.upto - f.bytes) AS before FROM b JOIN f ON f.pos > b.pos AND (f.pos - b.pos >= 40 OR f.upto - b.before > 60000) GROUP BY b.batch)),
      n AS (SELECT f.o_orderkey, f.bytes, max(b.batch) AS batch FROM f JOIN b ON b.pos <= f.pos GROUP BY ALL)
      SELECT batch, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(o_orderkey) AS "first", max(o_orderkey) AS "last" FROM n GROUP BY batch
      UNION ALL SELECT NULL, count(*), CAST(sum(bytes) AS BIGINT), min(o_orderkey), max(o_orderkey) FROM o WHERE bytes > 60000 HAVING count(*) > 0""",
    "stored_passes": """
      WITH p AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'three' WHEN o_orderkey % 3 = 0 THEN 'two' WHEN o_orderkey % 4 < 3 THEN 'one' END AS last FROM orders),
      k AS (SELECT o_orderkey, CASE last WHEN 'three' THEN -o_totalprice WHEN 'two' THEN 2 * o_totalprice WHEN 'one' THEN o_totalprice END AS price, last FROM p)
      SELECT o_orderkey, CASE WHEN price >= 0 THEN price END AS price, CASE WHEN price >= 0 THEN last END AS "pass", NOT coalesce(price >= 0 AND last <> 'one', false) AS pending FROM k""",
    "streaming_attempts": """
      WITH a AS (SELECT doc_id, unnest(range(0, doc_id % 4 + 1)) AS pass FROM documents), n AS (SELECT doc_id, count(*) AS n_attempts, bool_or((doc_id + pass) % 3 = 0) AS ok FROM a GROUP BY doc_id)
      SELECT doc_id, n_attempts, CASE WHEN ok THEN 'accepted' WHEN n_attempts >= 3 THEN 'abandoned' ELSE 'regenerate' END AS state FROM n""",
    "event_takes": "WITH files AS (" + _FILES + """),
      e AS (SELECT lang || '/' || source AS pool, split, name FROM files UNION ALL SELECT lang || '/' || source, '', name FROM files),
      r AS (SELECT *, row_number() OVER (PARTITION BY pool, split ORDER BY sha1('file|' || name), name) - 1 AS k, count(*) OVER (PARTITION BY pool, split) AS n FROM e),
      w AS (SELECT conv_id, turn, lang || '/' || source AS pool, ['train', 'dev', 'test', ''][turn % 4 + 1] AS split, CAST(('0x' || substring(sha1('take|' || conv_id || '-' || turn), 1, 8)) AS BIGINT) / 4294967296 AS u FROM conversations LEFT JOIN documents ON doc_id = conv_id)
      SELECT conv_id, turn, w.pool, w.split, r.name FROM w LEFT JOIN r ON r.pool = w.pool AND r.split = w.split AND r.k = CAST(floor(u * n) AS BIGINT)""",
    "alignment_forms": """
      SELECT conv_id, CASE WHEN conv_id % 5 <> 3 THEN count(*) END AS n, CASE WHEN conv_id % 5 <> 3 THEN string_agg(role, ',' ORDER BY turn) END AS speakers, CASE WHEN conv_id % 5 <> 3 THEN CAST(sum(turn * 2) AS DOUBLE) END AS starts,
        CASE WHEN conv_id % 5 = 4 THEN 0 WHEN conv_id % 5 <> 3 THEN CAST(sum(turn * 2 + 1.5) AS DOUBLE) END AS ends, conv_id % 5 <> 3 AS timed FROM conversations GROUP BY conv_id""",
    "turn_overlaps": """
      WITH e AS (SELECT user_id, event_id, (epoch_us(ts) - 1704067200000000) / CAST(1000000 AS DOUBLE) AS s, value * 60 AS n FROM events),
      t AS (SELECT conv_id % 150 AS user_id, conv_id, turn, CAST((conv_id * 7919 + turn * 86400) % 2592000 AS DOUBLE) AS s, length(text) / CAST(4 AS DOUBLE) * CASE WHEN turn = 2 THEN 500 ELSE 1 END AS n FROM conversations)
      SELECT event_id, conv_id, turn, round(least(e.s + e.n, t.s + t.n) - greatest(e.s, t.s), 4) AS shared FROM e JOIN t USING (user_id) WHERE e.s < t.s + t.n AND t.s < e.s + e.n AND e.n > 0 AND t.n > 0""",
    "signal_shapes": f"""
      WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, {_UNIFORM.format(salt='cut', of="'|' || vec_id")} AS u FROM embeddings),
      a AS (SELECT *, list_transform(x, lambda v: abs(v)) AS m, list_transform(x, lambda v, i: sqrt((v * v + x[greatest(i - 1, 1)] * x[greatest(i - 1, 1)]) / 2 + 1e-12)) AS l, list_transform(range(1, 56), lambda s: list_sum(list_transform(x[s:s + 9], lambda v: v * v))) AS w, 5 + CAST(floor(u * 35) AS BIGINT) AS s FROM e),
      p AS (SELECT *, list_position(m, list_max(m)) - 1 AS p FROM a)
      SELECT vec_id, round(list_sum(list_transform(x, lambda v, i: v * i * CASE WHEN i > 56 THEN power(cos(0.5 * pi() * (i - 57) / 7), 2) ELSE 1 END)), 6) AS released,
        round(list_sum(list_transform(range(1, 101), lambda i: i * CASE WHEN i <= 54 THEN x[i] WHEN i <= 64 THEN x[i] * (1 - (i - 55) / CAST(10 AS DOUBLE)) + x[i - 54] * (i - 55) / CAST(10 AS DOUBLE) ELSE x[i - 54] END)), 6) AS looped,
        round(list_sum(list_transform(x[1:40], lambda v, i: v * i * CASE WHEN i > 32 THEN 1 - (i - 33) / CAST(7 AS DOUBLE) ELSE 1 END)), 6) AS cut,
        round(list_sum(list_transform(x, lambda v, i: v * i * CASE WHEN i <= 40 THEN 1 + (power(10, CAST(-0.3 AS DOUBLE)) - 1) * (least(1, (i - 1) / CAST(9 AS DOUBLE)) - greatest(0, least(1, (i - 31) / CAST(9 AS DOUBLE)))) ELSE 1 END)), 6) AS ducked,
        round(list_sum(list_transform(x[s + 1:s + 20], lambda v, i: v * i)), 6) AS "window", CASE WHEN p BETWEEN 1 AND 10 THEN 64 - p ELSE 64 END AS aligned, list_position(w, list_max(w)) - 1 AS loudest,
        round(least(1, power(10, CAST(-0.5 AS DOUBLE)) / list_max(m)), 9) AS "limit", round(20 * log10(greatest(list_avg(l[55:64]), 1e-12) / list_aggregate(l, 'quantile_cont', 0.9)), 6) AS tail FROM p""",
    "room_shapes": f"""
      WITH c AS (SELECT conv_id, turn, 'scene_' || conv_id % 5 AS scene, ['train', 'dev', '', NULL][conv_id % 4 + 1] AS split, [0.25, 0.5, 1, 1, 1][turn % 5 + 1] AS bias, {_UNIFORM.format(salt='m', of="'|' || conv_id || '|' || turn")} AS u FROM conversations)
      SELECT conv_id, turn, CASE WHEN split <> '' THEN round(0.9 + 0.2 * {_UNIFORM.format(salt='room0', of="'|' || scene || '|' || split")}, 9) ELSE 1 END AS room0, CASE WHEN split <> '' THEN round(0.9 + 0.2 * {_UNIFORM.format(salt='room1', of="'|' || scene || '|' || split")}, 9) ELSE 1 END AS room1,
        CASE WHEN split <> '' THEN round(0.75 + 0.5 * {_UNIFORM.format(salt='room2', of="'|' || scene || '|' || split")}, 9) ELSE 1 END AS room2, round(2 + 40 * CAST(bias AS DOUBLE) * u, 6) AS metres FROM c""",
    "generated_subjects": f"""
      WITH w AS (SELECT conv_id, turn, array_to_string({_WORDS.format(t='text')}[1:(conv_id * 7 + turn * 11) % 71], ' ') AS said FROM conversations), n AS (SELECT *, len({_WORDS.format(t='said')}) AS n FROM w)
      SELECT conv_id, turn, md5(said) AS digest, CASE WHEN n = 0 THEN 'empty subject' WHEN n < 4 THEN 'subject too short' WHEN n > 60 THEN 'subject too long' END AS fault FROM n""",
    "reply_lists": "SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "reply_values": """SELECT p_partkey, [true, false, true, NULL][p_partkey % 4 + 1] AS presence, CASE WHEN p_partkey % 3 = 0 THEN ['pivot', 'verbal', 'behavioral', 'ambient'][p_partkey % 4 + 1] WHEN p_partkey % 3 = 1 THEN 'verbal' END AS reaction FROM part""",
    "behavioural_events": """
      SELECT conv_id, coalesce(string_agg(CASE WHEN turn % 4 IN (0, 2) AND (conv_id % 4 < 2 OR (conv_id % 4 = 2 AND (conv_id + turn) % 2 = 0)) THEN 'e' || turn END, ',' ORDER BY 'e' || turn), '') AS ids FROM conversations GROUP BY conv_id""",
    "speakers_across": """
      WITH s AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 > 0 AND turn % 5 < 3 THEN role END AS speaker FROM conversations)
      SELECT conv_id, turn, lead(turn) OVER w IS NULL OR speaker IS NOT DISTINCT FROM lead(speaker) OVER w AS same_across FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "unvoiced_events": "SELECT conv_id, turn, conv_id % 4 IN (0, 2) AS made FROM conversations WHERE NOT (conv_id % 4 < 2 AND turn % 3 = 0)",
    "synthesis_plans": _PACK + """, t2 AS (SELECT conv_id, count(*) AS n_inputs, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM conversations GROUP BY conv_id)
      SELECT conv_id, n_inputs, total_chars, count(*) AS n_chunks, string_agg("first" || '-' || ("last" + 1), ',' ORDER BY chunk) AS chunk_ranges FROM packed JOIN t2 USING (conv_id) GROUP BY conv_id, n_inputs, total_chars""",
    "cache_verdicts": """
      WITH e AS (SELECT event_id AS i, event_type, event_type || CASE WHEN event_id % 2 = 0 THEN '-a' ELSE '-b' END AS task FROM events),
      c AS (SELECT *, NOT (event_type = 'click' AND i % 11 = 0) AND task <> 'error-a' AS held, task = 'purchase-b' AND i % 9 = 0 AS error, task = 'purchase-a' AND i % 7 = 0 AS other, CASE WHEN i % 5 > 0 THEN CASE WHEN event_type = 'view' AND i % 10 = 2 THEN 'other' ELSE 'one' END END AS run FROM e),
      n AS (SELECT task, count(*) AS n_items, count(*) FILTER (held) AS n_cached, count(*) FILTER (NOT held) AS n_missing, 0 AS n_intruders, count(*) FILTER (held AND other) AS n_divergent, count(*) FILTER (held AND error) AS n_errors, count(DISTINCT run) FILTER (held) AS n_settings FROM c GROUP BY task)
      SELECT *, CASE WHEN n_cached = 0 THEN 'no cache' WHEN n_missing + n_divergent + n_errors > 0 OR n_settings > 1 THEN 'refused' ELSE 'ok' END AS verdict FROM n""",
    "summary_mentions": _SUMMARIES + "SELECT budget, count(*) AS n_sounds, count(*) FILTER (m) AS n_mentioned, count(*) FILTER (m) / count(*) AS mention_rate FROM g WHERE used AND reaction <> '' GROUP BY budget",
    "summary_mentions_over_budgets": _SUMMARIES + """, s AS (SELECT conv_id, turn, count(*) FILTER (m) AS n_budgets FROM g WHERE used AND reaction <> '' GROUP BY conv_id, turn)
      SELECT n_budgets, count(*) AS n, (SELECT count(*) FILTER (n_budgets > 0) / count(*) FROM s) AS mention_rate, (SELECT sum(n_budgets) / nullif(count(*) FILTER (n_budgets > 0), 0) FROM s) AS budgets_per_mentioned FROM s GROUP BY n_budgets""",
    "judged_summaries": _MANIFESTS + """, g AS (SELECT conv_id, list(replace(replace(event_id, 'x/', ''), '_', ' ') ORDER BY rank) AS names FROM m GROUP BY conv_id), b AS (SELECT unnest([25, 75, 200]) AS budget),
      f AS (SELECT g.*, budget, len(list_filter(string_split(lower(coalesce(text, '')), ' ')[1:3], lambda w: w <> '')) >= 2 AS quoted FROM g CROSS JOIN b LEFT JOIN conversations c ON c.conv_id = g.conv_id AND c.turn = 0),
      k AS (SELECT *, list_transform(names, lambda x, i: i - 1) AS at FROM f)
      SELECT conv_id || '::summary::' || budget AS item_id, len(names) AS n_gold,
        CASE WHEN budget <> 75 THEN CASE WHEN quoted THEN array_to_string(list_filter(names, lambda x, i: (i - 1) % 6 = 0), ',') ELSE '' END END AS heard, CASE WHEN budget <> 75 THEN CASE WHEN quoted THEN array_to_string(list_filter(names, lambda x, i: (i - 1) % 6 = 4), ',') ELSE '' END END AS nature,
        CASE WHEN budget <> 75 THEN CASE WHEN quoted THEN array_to_string(list_filter(names, lambda x, i: (i - 1) % 6 = 2), ',') ELSE '' END END AS discussed, CASE WHEN budget <> 75 THEN array_to_string(list_filter(names, lambda x, i: (i - 1) % 2 = 1 OR NOT quoted), ',') END AS no_evidence FROM k""",
    "dataset_split_report": _TODOS + """,
      u AS (SELECT composition, p, v, b, a, unnest(range(0, quota)) AS u FROM comps),
      s AS (SELECT row_number() OVER (ORDER BY sha1('composition|' || composition || '|' || p || '|' || v || '|' || b || '|' || a || '|' || u)) - 1 AS local, composition, p, v, b, a FROM u),
      h AS (SELECT local, row_number() OVER (ORDER BY sha1('rare|' || local), local) AS k FROM s WHERE p = 1),
      l AS (SELECT r_name AS scene, unnest(range(0, n // 5 + CASE WHEN place <= n % 5 THEN 1 ELSE 0 END)) AS u FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS place FROM region), size),
      z AS (SELECT scene, row_number() OVER (ORDER BY sha1('scene|' || scene || '|' || u)) - 1 AS local FROM l),
      t AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 10 < 8 THEN 'train' WHEN p_size % 10 = 8 THEN 'dev' ELSE 'test' END AS split, row_number() OVER (ORDER BY p_partkey) - 1 AS t FROM part),
      y AS (SELECT split, p_partkey, p_brand, scene, composition, p, v, b, a, coalesce(h.k <= round(n * 0.05), false) AS rare FROM t, (SELECT unnest(range(0, 10)) AS i) i, size JOIN s ON s.local = t.t * 10 + i.i JOIN z ON z.local = s.local LEFT JOIN h ON h.local = s.local WHERE split <> 'dev'),
      sc AS (SELECT split, count(*) AS n_scenes, min(n) AS least_scene, max(n) AS most_scene FROM (SELECT split, scene, count(*) AS n FROM y GROUP BY ALL) GROUP BY split), cc AS (SELECT split, count(*) AS n_compositions, min(n) AS least_composition, max(n) AS most_composition FROM (SELECT split, composition, count(*) AS n FROM y GROUP BY ALL) GROUP BY split)
      SELECT split, count(*) AS n_scenarios, count(DISTINCT p_partkey) AS n_templates, count(DISTINCT p_brand) AS n_themes, count(*) FILTER (rare) AS n_rare, any_value(n_scenes) AS n_scenes, any_value(least_scene) AS least_scene, any_value(most_scene) AS most_scene, any_value(n_compositions) AS n_compositions, any_value(least_composition) AS least_composition, any_value(most_composition) AS most_composition,
        CAST(sum(p + v + b + a) AS BIGINT) AS n_events, CAST(sum(p) AS BIGINT) AS n_pivot, CAST(sum(v) AS BIGINT) AS n_verbal, CAST(sum(b) AS BIGINT) AS n_behavioral, CAST(sum(a) AS BIGINT) AS n_ambient, round(sum(p) / sum(p + v + b + a), 9) AS share_pivot, round(sum(v) / sum(p + v + b + a), 9) AS share_verbal, round(sum(b) / sum(p + v + b + a), 9) AS share_behavioral, round(sum(a) / sum(p + v + b + a), 9) AS share_ambient
      FROM y JOIN sc USING (split) JOIN cc USING (split) GROUP BY split""",
    "source_audit": """
      WITH c AS (SELECT conv_id, ['train', 'dev', 'train', '', 'test', NULL][conv_id % 6 + 1] AS split, CASE WHEN turn % 4 > 0 THEN 'take' || length(text) % 23 END AS take, CASE WHEN conv_id % 3 > 0 THEN 'bed' || conv_id % 7 END AS bed FROM conversations),
      u AS (SELECT DISTINCT conv_id, split, unnest([take, bed]) AS source FROM c WHERE split <> ''), n AS (SELECT source, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n FROM u WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT split) > 1)
      SELECT * FROM n UNION ALL SELECT NULL, '', count(DISTINCT conv_id) FROM c WHERE coalesce(split, '') = '' HAVING count(*) > 0""",
    "rare_exclusions": """
      WITH r AS (SELECT DISTINCT CASE WHEN p_partkey % 40 = 0 THEN lower(p_brand) ELSE p_brand END AS event, coalesce(r_name, 'MOON') AS scene FROM part LEFT JOIN region ON r_regionkey = p_partkey % 6)
      SELECT event, scene, CASE WHEN event NOT IN (SELECT p_brand FROM part) THEN 'unknown event' ELSE 'unknown scene' END AS fault FROM r WHERE event NOT IN (SELECT p_brand FROM part) OR scene = 'MOON'""",
    "layer_sets": """
      WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN '' ELSE CASE WHEN turn % 5 = 4 THEN 'rare_events/' ELSE 'x/' END || 'e' || (conv_id + turn) % 6 END AS id, CASE WHEN turn % 3 = 0 THEN 'rare_events/' ELSE 'x/' END || 'e' || turn % 8 AS el FROM conversations),
      l AS (SELECT DISTINCT conv_id, id, CASE WHEN turn % 9 = 8 OR starts_with(id, 'rare_events/') THEN 'rare' WHEN CAST(('0x' || substring(sha1('layer|' || conv_id || '|' || id), 1, 8)) AS BIGINT) / 4294967296 < 0.35 THEN 'supporting' ELSE 'core' END AS layer FROM c WHERE turn % 2 = 0 AND id <> ''),
      k AS (SELECT conv_id, id, layer FROM l AS o WHERE layer = 'rare' OR NOT EXISTS (SELECT 1 FROM l AS r WHERE r.conv_id = o.conv_id AND r.id = o.id AND r.layer = 'rare')),
      e AS (SELECT DISTINCT conv_id, el AS id, CASE WHEN turn % 4 = 3 THEN 'supporting' WHEN starts_with(el, 'rare_events/') THEN 'rare' ELSE 'core' END AS layer FROM c WHERE turn % 4 IN (1, 3) AND conv_id % 4 > 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.conv_id = c.conv_id AND l.id = c.el)),
      a AS (SELECT * FROM k UNION SELECT * FROM e)
      SELECT conv_id, coalesce(string_agg(id, ',' ORDER BY id) FILTER (layer = 'core'), '') AS core, coalesce(string_agg(id, ',' ORDER BY id) FILTER (layer = 'supporting'), '') AS supporting, coalesce(string_agg(id, ',' ORDER BY id) FILTER (layer = 'rare'), '') AS rare
      FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN a USING (conv_id) GROUP BY conv_id""",
    "flat_templates": """
      WITH r AS (SELECT p_brand AS category, p_type AS theme, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS "index", p_name AS title, CAST(p_size AS VARCHAR) AS description FROM part)
      SELECT replace(category || '__' || theme || '__' || CASE WHEN "index" < 10 THEN '0' ELSE '' END || "index", ' ', '_') AS template_id, category, theme, "index", title, description FROM r""",
    "finished_dataset": """
      WITH d AS (SELECT conv_id AS i, count(*) AS n, conv_id % 7 > 0 AS known FROM conversations WHERE conv_id % 4 < 3 GROUP BY conv_id),
      r AS (SELECT conv_id AS i, bool_or(turn % 3 <> 2 AND turn % 2 = 0 AND turn % 5 = 4) AS rare FROM conversations GROUP BY conv_id),
      t AS (SELECT *, CASE WHEN i % 4 = 0 THEN 'Template' WHEN i % 3 = 0 THEN 'Theme ' || i WHEN i % 3 = 1 THEN 'Plain ' || i END AS title FROM d JOIN r USING (i))
      SELECT CAST(i AS VARCHAR) AS scenario_id, CASE WHEN known THEN 'scene_' || i % 4 END AS scene, CASE WHEN known THEN CASE WHEN i % 2 = 0 THEN 'subject ' || i ELSE 'made ' || i END END AS subject, known AND rare AS has_rare_event, n, CASE WHEN known THEN CAST(i % 10 AS VARCHAR) END AS template_id,
        CASE WHEN i % 3 = 0 THEN 'own ' || i WHEN known THEN 'c' END AS category, CASE WHEN i % 6 = 0 THEN '{"title": "My title"}' WHEN known THEN title END AS theme, CASE WHEN i % 6 = 0 THEN 'My title' END AS theme_label, 'm' AS metadata, CASE WHEN i % 5 = 0 THEN 'dev' WHEN known THEN 'train' END AS split FROM t""",
    "pending_subjects": f"""
      WITH s AS (SELECT conv_id, least((conv_id * 5) % 67, len({_WORDS.format(t='text')})) AS n FROM conversations WHERE turn = 1)
      SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM s WHERE n BETWEEN 4 AND 60)""",
}
ORACLES["pending_dialogues"] = f"SELECT conv_id FROM ({ORACLES['timeline_validation']}) WHERE NOT valid"
