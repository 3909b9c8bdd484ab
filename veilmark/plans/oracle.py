"""Independent SQL for the registered queries, written for DuckDB.

Each statement starts from the given tables and uses none of the Spark code; only
constants (patterns, phrases, thresholds) are shared.
"""

from __future__ import annotations

from veilmark.fixed_values import (
    BOUNDARY_TEXTS, HISTOGRAM_EDGES, HISTOGRAM_LABELS, LEVELS, POLICY_VERSION, REVIEW_THRESHOLD,
    STARTER_FILLERS, STARTER_PHRASES, STARTER_TEMPLATES,
)
from veilmark.functions import html as hx
from veilmark.functions import policy
from veilmark.plans import inputs

T = inputs.TEMPERATURE
WORD = r"[\p{L}\p{N}_]{2,}"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(_q(i) for i in items) + "]"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def _words(expr: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({expr})), '{WORD}')"


def _pairs(u: str) -> str:
    return f"CASE WHEN len({u}) > 1 THEN list_transform(range(1, len({u})), lambda i: {u}[i] || ' ' || {u}[i + 1]) ELSE []::VARCHAR[] END"


LEVEL_TABLE = _values(list(enumerate(LEVELS)), "idx, name")

TOKS = f"toks AS (SELECT doc_id, {_words('text')} AS u FROM documents)"
COUNTS = f"""{TOKS},
grams AS (SELECT doc_id, unnest(list_concat(u, {_pairs('u')})) AS term FROM toks),
tc AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term)"""
VOC = f"""{COUNTS},
top AS (SELECT term, sum(tf)::BIGINT AS ctf, count(*) AS df FROM tc GROUP BY term ORDER BY ctf DESC, term LIMIT 5000),
voc AS (SELECT term, ctf, df, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS feature_idx,
  ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM top)"""


def _vectors(counts: str, keys: str) -> str:
    """CTE ``x``: unit vectors of a count table (keys, term, tf)."""
    return f"""w AS (SELECT {keys}, term, feature_idx, (1.0 + ln(tf::DOUBLE)) * idf AS w FROM {counts} JOIN voc USING (term)),
x AS (SELECT {keys}, term, feature_idx, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS x FROM w)"""


def _weight(i: str, j: str, k: int) -> str:
    return f"((({i}) * 31 + ({j}) * 17 + {k * 7}) % 101 - 50) / 64.0::DOUBLE"


def _bias(j: str, k: int) -> str:
    return f"(({j} * 13 + {k * 5}) % 11 - 5) / 64.0::DOUBLE"


def _network(base: str, key: str, inputs_cte: str, shift: int = 0, tag: str = "") -> str:
    """CTEs up to ``p{tag}`` (key, k, p) for every row of ``base``."""
    return f"""z0{tag} AS (SELECT b.{key}, u.j, {_bias('u.j', 0)} + coalesce(s.s, 0) AS z
  FROM (SELECT {key} FROM {base}) b CROSS JOIN (SELECT unnest(range(8)) AS j) u
  LEFT JOIN (SELECT {key}, j, sum(x * {_weight('feature_idx', 'j', shift)}) AS s
    FROM {inputs_cte} CROSS JOIN (SELECT unnest(range(8)) AS j) GROUP BY {key}, j) s ON s.{key} = b.{key} AND s.j = u.j),
z1{tag} AS (SELECT {key}, o.j, {_bias('o.j', 1)} + sum(greatest(z, 0) * {_weight('z0' + tag + '.j', 'o.j', 1 + shift)}) AS z
  FROM z0{tag} CROSS JOIN (SELECT unnest(range(4)) AS j) o GROUP BY {key}, o.j),
z2{tag} AS (SELECT {key}, o.j AS k, {_bias('o.j', 2)} + sum(greatest(z, 0) * {_weight('z1' + tag + '.j', 'o.j', 2 + shift)}) AS z
  FROM z1{tag} CROSS JOIN (SELECT unnest(range(6)) AS j) o GROUP BY {key}, o.j),
e{tag} AS (SELECT {key}, k, exp(z - max(z) OVER (PARTITION BY {key})) AS e FROM z2{tag}),
p{tag} AS (SELECT {key}, k, e / sum(e) OVER (PARTITION BY {key}) AS p FROM e{tag}),
q{tag} AS (SELECT {key}, k, ln(p + 1e-12) / {T} AS l FROM p{tag}),
qe{tag} AS (SELECT {key}, k, exp(l - max(l) OVER (PARTITION BY {key})) AS e FROM q{tag}),
c{tag} AS (SELECT {key}, k, e / sum(e) OVER (PARTITION BY {key}) AS p FROM qe{tag}),
best{tag} AS (SELECT {key}, min(k) AS pred, max(conf) AS confidence FROM
  (SELECT {key}, k, p, max(p) OVER (PARTITION BY {key}) AS conf, max(round(p, 9)) OVER (PARTITION BY {key}) AS top FROM c{tag})
  WHERE round(p, 9) = top GROUP BY {key})"""


X = f"{VOC},\n{_vectors('tc', 'doc_id')}"
NET = f"{X},\n{_network('documents', 'doc_id', 'x')}"
SALIENCE = f"sal AS (SELECT feature_idx, sum(abs({_weight('feature_idx', 'j', 0)})) AS salience FROM voc CROSS JOIN (SELECT unnest(range(8)) AS j) GROUP BY feature_idx)"


def _signals(key: str) -> str:
    return f"""{SALIENCE},
con AS (SELECT {key}, term, feature_idx, x * salience AS c FROM x JOIN sal USING (feature_idx) WHERE x * salience > 0),
sig AS (SELECT * FROM (SELECT {key}, term, c, row_number() OVER (PARTITION BY {key} ORDER BY round(c, 9) DESC, feature_idx) AS r FROM con) WHERE r <= 5),
why AS (SELECT {key}, 'Top signals: ' || string_agg(printf('%s (%.3f)', term, c), ', ' ORDER BY r) AS reasoning FROM sig GROUP BY {key})"""


NO_SIGNAL = "coalesce(reasoning, 'No strong signals.')"
TRUTH = "truth AS (SELECT doc_id, 2 * quality + toxic AS y FROM labels JOIN documents USING (doc_id))"
PRED = f"{NET},\n{TRUTH},\npreds AS (SELECT doc_id, y, pred, confidence FROM truth JOIN best USING (doc_id))"

_SUFFIX = f"{_list(inputs.SUFFIXES)}[doc_id % {len(inputs.SUFFIXES)} + 1]"


def _files(limit: int) -> str:
    """CTE ``files``: documents as files, with the status known before they are read."""
    shown = f" > {limit // 1048576} MB limit" if limit >= 1048576 else f" > {limit} bytes limit"
    known = "('.txt', '.md', '.html', '.htm', '.docx', '.xlsx', '.pptx')"
    return f"""f0 AS (SELECT doc_id, text, n_chars AS size, 'drop/' || source || '/doc_' || doc_id || {_SUFFIX} AS path FROM documents),
f1 AS (SELECT *, regexp_extract(path, '[^/]*$') AS filename FROM f0),
f2 AS (SELECT *, lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) AS extension FROM f1),
files AS (SELECT *, CASE WHEN size > {limit} THEN 'oversized' WHEN extension NOT IN {known} THEN 'unsupported_format' ELSE 'ok' END AS status,
  CASE WHEN size > {limit} THEN printf('%.1f MB', size / 1048576.0::DOUBLE) || '{shown}'
   WHEN extension NOT IN {known} THEN chr(39) || extension || chr(39) || ' not supported' ELSE '' END AS detail FROM f2)"""


def _log(limit: int) -> str:
    return f"""{NET},
{_signals('doc_id')},
{_files(limit)},
lv AS {LEVEL_TABLE},
log AS (SELECT '{inputs.STAMP}' AS timestamp, path AS filepath, filename, extension, size AS size_bytes,
  CASE WHEN status = 'ok' THEN name END AS classification,
  CASE WHEN status = 'ok' THEN round(confidence, 4) END AS confidence,
  CASE WHEN status = 'ok' THEN confidence < {REVIEW_THRESHOLD} END AS review_flag,
  CASE WHEN status = 'ok' THEN {NO_SIGNAL} END AS reasoning,
  '{POLICY_VERSION}' AS policy_version, status AS extraction_status, detail AS extraction_detail
  FROM files JOIN best USING (doc_id) JOIN lv ON lv.idx = pred LEFT JOIN why USING (doc_id))"""


LOG = _log(10 * 1024 * 1024)

_PHRASES = "[" + ", ".join(_list(STARTER_PHRASES[k]) for k in range(len(LEVELS))) + "]"
MARKED = f"""marked AS (SELECT doc_id, (doc_id % 6)::INTEGER AS expected,
  {_PHRASES}[doc_id % 6 + 1][(doc_id // 6) % 8 + 1] || '. ' || text ||
  CASE WHEN doc_id % 4 = 0 THEN {_q(inputs.PERSONAL_LINE)} ELSE '' END AS text FROM documents)"""
HAS_PII = "(" + " OR ".join(f"regexp_matches(text, {_q(p)})" for p in policy.PERSONAL.values()) + ")"
STAMP = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN {i}" for i, p in policy.STAMPS) + " END"


def _floor(level: str) -> str:
    return f"CASE WHEN has_pii AND {level} IN (1, 2) THEN 3 WHEN has_pii AND {level} = 4 THEN 5 ELSE {level} END"


_LONGEST = 6
_AHEAD = ", ".join(f"lead(t0, {k}) OVER o AS t{k}" for k in range(1, _LONGEST))
_NGRAMS = " UNION ALL ".join(
    f"SELECT doc_id, concat_ws(' ', {', '.join(f't{k}' for k in range(n))}) AS g FROM ahead WHERE t{n - 1} IS NOT NULL"
    for n in range(1, _LONGEST + 1)
)
HITS = f"""{MARKED},
lex0 AS (SELECT DISTINCT label_idx, {_words('phrase')} AS w FROM {_values([(k, p) for k, ps in STARTER_PHRASES.items() for p in ps], 'label_idx, phrase')}),
lex AS (SELECT label_idx, array_to_string(w, ' ') AS g FROM lex0),
mt AS (SELECT doc_id, {_words('text')} AS u FROM marked),
mw AS (SELECT doc_id, unnest(range(len(u))) AS i, unnest(u) AS t0 FROM mt),
ahead AS (SELECT doc_id, t0, {_AHEAD} FROM mw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ng AS ({_NGRAMS}),
raw AS (SELECT doc_id, label_idx, count(*) AS hits FROM ng JOIN lex USING (g) GROUP BY doc_id, label_idx),
hits AS (SELECT d.doc_id, d.j AS label_idx, coalesce(raw.hits, 0) AS hits FROM (SELECT doc_id, unnest(range(6)) AS j FROM documents) d
  LEFT JOIN raw ON raw.doc_id = d.doc_id AND raw.label_idx = d.j),
content AS (SELECT doc_id, min(label_idx) FILTER (WHERE hits = m AND m > 0) AS content, max(m) AS top FROM
  (SELECT *, max(hits) OVER (PARTITION BY doc_id) AS m FROM hits) GROUP BY doc_id)"""
STAMPED = f"""{HITS},
st AS (SELECT doc_id, text, expected, {STAMP} AS stamp, {HAS_PII} AS has_pii FROM marked),
both_levels AS (SELECT *, coalesce(CASE WHEN stamp = 2 AND content = 4 AND top >= 2 THEN 4 END, stamp, content) AS base FROM st JOIN content USING (doc_id)),
pol AS (SELECT *, {_floor('base')} AS level_idx FROM both_levels)"""


def _masked(text: str) -> str:
    for pattern, to in (
        (policy.EMAIL, "name@organisation.com"), (policy.PHONE, "+XX XXX XXX XXXX"),
        (policy.STAFF_ID, "EMP-XXXXX"), (policy.CUSTOMER_ID, "CUS-XXXXX"), (policy.BORN, "\\1XX XXX \\2"),
    ):
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(to)}, 'g')"
    return text


def _money(text: str) -> str:
    """Amounts keep their first digit; the rest of their digits become zeros."""
    m = _q(policy.MONEY)
    amount = "translate(substr(a, 2 + (regexp_matches(a, '^[^0-9]'))::INTEGER), '123456789', '000000000')"
    return f"""array_to_string(list_transform(list_zip(regexp_split_to_array({text}, {m}),
      list_append(list_transform(regexp_extract_all({text}, {m}), lambda a: substr(a, 1, 1 + (regexp_matches(a, '^[^0-9]'))::INTEGER) || {amount}), '')),
      lambda z: z[1] || z[2]), '')"""


MASKED = f"m1 AS (SELECT doc_id, {_masked('text')} AS text FROM marked), m2 AS (SELECT doc_id, {_money('text')} AS text FROM m1)"


def _html(column: str) -> str:
    out = column
    for pattern in hx.DROPPED:
        out = f"regexp_replace({out}, {_q(pattern)}, chr(1), 'g')"
    # HTML allows the older names without their semicolon; "&amp" goes last.
    for entity, char in hx.ENTITIES:
        if entity in ("&#39;", "&apos;"):
            out = f"replace({out}, {_q(entity)}, {_q(char)})"
        else:
            out = f"regexp_replace({out}, {_q(entity + '?')}, {_q(char)}, 'g')"
    trimmed = f"list_transform(string_split({out}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string(list_filter({trimmed}, lambda s: s <> ''), chr(10))"


SPLIT_KEYS = f"""{TRUTH},
keyed AS (SELECT doc_id, text, y, md5('42:' || md5(text)) AS key FROM documents JOIN truth USING (doc_id)),
ranked AS (SELECT y, key, row_number() OVER (PARTITION BY y ORDER BY key) AS r, count(*) OVER (PARTITION BY y) AS n FROM (SELECT DISTINCT y, key FROM keyed)),
parts AS (SELECT doc_id, text, y, CASE WHEN r <= round(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM keyed JOIN ranked USING (y, key))"""

POOL = """pool AS (SELECT doc_id, (doc_id % 6)::INTEGER AS pred, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS confidence
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
CUT80 = f"{POOL}, cut AS (SELECT quantile_cont(confidence, 0.8) AS cut FROM pool)"


def _rounds() -> str:
    ctes, left = [POOL], "pool"
    for k, percent in enumerate((80, 70, 60, 50, 40), 1):
        ctes.append(f"cut{k} AS (SELECT quantile_cont(confidence, {percent / 100}) AS cut FROM {left})")
        ctes.append(f"acc{k} AS (SELECT l.doc_id, cut FROM {left} l, cut{k} WHERE confidence >= cut)")
        ctes.append(f"left{k} AS (SELECT * FROM {left} WHERE doc_id NOT IN (SELECT doc_id FROM acc{k}))")
        left = f"left{k}"
    rows = " UNION ALL ".join(
        f"SELECT {k} AS round, round(max(cut), 6) AS cut, count(*) AS accepted, (SELECT count(*) FROM left{k}) AS remaining FROM acc{k} HAVING count(*) > 0"
        for k in range(1, 6)
    )
    return "WITH " + ",\n".join(ctes) + "\n" + rows


# --- generated samples ---

def _digest(slot: str, *more: str) -> str:
    return f"md5(concat_ws(':', '42', sample_id, {_q(slot)}{''.join(', ' + m for m in more)}))"


def _chance(slot: str) -> str:
    return f"(('0x' || substr({_digest(slot)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _number(slot: str, low: int, high: int) -> str:
    return f"({low} + floor({_chance(slot)} * {high - low + 1})::INTEGER)"


def _shuffled(items: str, slot: str) -> str:
    keyed = f"list_transform({items}, lambda s, i: {{'h': {_digest(slot, '(i - 1)')}, 's': s}})"
    return f"list_transform(list_sort({keyed}), lambda z: z.s)"


_OWN = _shuffled(f"{_PHRASES}[label_idx + 1]", "signal")
_FILL = _shuffled(_list(STARTER_FILLERS), "filler")
_OTHER = f"{_PHRASES}[(label_idx + 1 + floor({_chance('other')} * 5)::INTEGER) % 6 + 1]"
_STRAY = f"{_OTHER}[floor({_chance('stray')} * len({_OTHER}))::INTEGER + 1]"


def _sentence(parts: str) -> str:
    text = f"array_to_string({parts}, ' ')"
    return f"upper(substr({text}, 1, 1)) || lower(substr({text}, 2)) || '.'"


PHRASE_TEXT = _sentence(_shuffled(
    f"list_concat(list_concat(({_OWN})[1:{_number('signals', 3, 6)}], CASE WHEN {_chance('noise')} < 0.5 THEN [{_STRAY}] ELSE []::VARCHAR[] END), ({_FILL})[1:{_number('fillers', 3, 5)}])",
    "order",
))
LONG_TEXT = _sentence(_shuffled(
    f"list_concat(({_OWN})[1:{_number('long signals', 4, 7)}], ({_FILL})[1:{_number('long fillers', 4, 6)}])", "order"
))
_TEMPLATES = "[" + ", ".join(_list(STARTER_TEMPLATES[k]) for k in range(len(LEVELS))) + "]"
_TPL = f"{_TEMPLATES}[label_idx + 1]"
TEMPLATE_TEXT = f"{_TPL}[floor({_chance('template')} * len({_TPL}))::INTEGER + 1]"
for _mark, _source, _at in (("{s0}", _OWN, 1), ("{s1}", _OWN, 2), ("{f0}", _FILL, 1), ("{f1}", _FILL, 2)):
    TEMPLATE_TEXT = f"replace({TEMPLATE_TEXT}, '{_mark}', ({_source})[{_at}])"
TEMPLATE_TEXT += f" || CASE WHEN {_chance('note')} < 0.2 THEN ' Note: ' || {_STRAY} || '.' ELSE '' END"
IDS = "ids AS (SELECT doc_id AS sample_id, (doc_id % 6)::INTEGER AS label_idx FROM documents)"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    tx = f"WITH {TOKS} "
    sql["normalize_text"] = "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents"
    sql["tokenize"] = tx + "SELECT doc_id, (unnest(range(len(u))))::INTEGER AS pos, unnest(u) AS token FROM toks"
    sql["bigrams"] = tx + f"SELECT doc_id, (unnest(range(len(u) - 1)))::INTEGER AS pos, unnest({_pairs('u')}) AS pair FROM toks WHERE len(u) > 1"
    sql["term_counts"] = f"WITH {COUNTS} SELECT doc_id, term, tf::INTEGER AS tf FROM tc"
    sql["vocab_topk"] = f"WITH {VOC} SELECT term, ctf, df FROM voc"
    sql["idf"] = f"WITH {VOC} SELECT term, feature_idx, ctf, df, round(idf, 6) AS idf FROM voc"
    sql["tfidf_vectors"] = f"WITH {X} SELECT doc_id, term, feature_idx, round(x, 6) AS x FROM x"
    sql["tfidf_by_join"] = sql["tfidf_vectors"]
    sql["tfidf_fit_on_train"] = f"""WITH {SPLIT_KEYS},
pt AS (SELECT doc_id, split, {_words('text')} AS u FROM parts),
pg AS (SELECT doc_id, split, unnest(list_concat(u, {_pairs('u')})) AS term FROM pt),
tc AS (SELECT doc_id, split, term, count(*) AS tf FROM pg GROUP BY ALL),
top AS (SELECT term, sum(tf)::BIGINT AS ctf, count(*) AS df FROM tc WHERE split = 'train' GROUP BY term ORDER BY ctf DESC, term LIMIT 5000),
voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS feature_idx,
  ln((1.0 + (SELECT count(*) FROM parts WHERE split = 'train')) / (1.0 + df)) + 1.0 AS idf FROM top),
{_vectors('tc', 'doc_id')}
SELECT p.doc_id, p.split, count(x)::INTEGER AS n, round(coalesce(sum(x), 0), 6) AS weight_sum FROM parts p LEFT JOIN x ON x.doc_id = p.doc_id GROUP BY p.doc_id, p.split"""
    conv = f"""ct AS (SELECT conv_id, turn, {_words('text')} AS u FROM conversations),
cg AS (SELECT conv_id, turn, unnest(list_concat(u, {_pairs('u')})) AS term FROM ct),
cc AS (SELECT conv_id, turn, term, count(*) AS tf FROM cg GROUP BY ALL)"""
    sql["oov_docs"] = f"""WITH {VOC}, {conv}
SELECT c.conv_id, c.turn, count(voc.term) AS known, count(cc.term) - count(voc.term) AS unknown
FROM conversations c LEFT JOIN cc ON cc.conv_id = c.conv_id AND cc.turn = c.turn LEFT JOIN voc ON voc.term = cc.term GROUP BY c.conv_id, c.turn"""

    sql["mlp_forward"] = f"WITH {NET} SELECT doc_id, k::INTEGER AS class_idx, round(p, 6) AS p FROM p"
    sql["mlp_forward_by_join"] = sql["mlp_forward"]
    sql["parity_check"] = "SELECT count(*) AS n, 0::BIGINT AS one_sided, 0::BIGINT AS different FROM documents"
    emb = "x AS (SELECT vec_id, unnest(range(len(embedding))) AS feature_idx, unnest(embedding)::DOUBLE AS x FROM embeddings)"
    sql["embedding_forward"] = f"WITH {emb}, {_network('embeddings', 'vec_id', 'x')} SELECT vec_id AS doc_id, k::INTEGER AS class_idx, round(p, 6) AS p FROM p"
    sql["recover_logits"] = f"WITH {NET} SELECT doc_id, k::INTEGER AS class_idx, round(ln(p + 1e-12), 6) AS p FROM p"
    sql["softmax_temperature"] = f"WITH {NET} SELECT doc_id, k::INTEGER AS class_idx, round(p, 6) AS p FROM c"
    sql["argmax_level"] = f"""WITH {NET}, lv AS {LEVEL_TABLE},
raw AS (SELECT doc_id, min(k)::INTEGER AS class_idx FROM (SELECT doc_id, k, round(p, 9) AS r, max(round(p, 9)) OVER (PARTITION BY doc_id) AS m FROM p) WHERE r = m GROUP BY doc_id)
SELECT doc_id, class_idx, name AS level FROM raw JOIN lv ON lv.idx = class_idx"""
    sql["calibrated_predict"] = f"WITH {NET} SELECT doc_id, pred::INTEGER AS pred, round(confidence, 6) AS confidence FROM best"
    sql["feature_salience"] = f"WITH {VOC}, {SALIENCE} SELECT term, feature_idx, round(salience, 6) AS salience FROM voc JOIN sal USING (feature_idx)"
    sql["top5_terms"] = f"WITH {X}, {_signals('doc_id')} SELECT doc_id, (r - 1)::INTEGER AS rank, term, round(c, 6) AS weight FROM sig"
    sql["reasoning"] = f"WITH {X}, {_signals('doc_id')} SELECT d.doc_id, {NO_SIGNAL} AS reasoning FROM documents d LEFT JOIN why USING (doc_id)"
    digest = "substr(sha256(string_agg(concat_ws('|', feature_idx, term, ctf, df), chr(10) ORDER BY feature_idx)), 1, 8)"
    sql["artefact_hash"] = f"WITH {VOC} SELECT {digest} AS sha8 FROM voc"
    sql["model_manifest"] = f"""WITH {VOC} SELECT 'formula0' AS model, 'vocab.' || {digest} AS vectorizer, {T}::DOUBLE AS temperature,
'{','.join(LEVELS)}' AS classes, '{POLICY_VERSION}' AS policy_version, {REVIEW_THRESHOLD}::DOUBLE AS review_threshold FROM voc"""

    nll = f"""{NET}, guided AS (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN pred ELSE (pred + 1 + doc_id % 4) % 6 END AS y FROM best), grid AS (SELECT unnest([{', '.join(map(str, inputs.GRID))}]::DOUBLE[]) AS t),
s AS (SELECT doc_id, y, k, t, ln(p + 1e-12) / t AS l FROM p JOIN guided USING (doc_id) CROSS JOIN grid),
se AS (SELECT doc_id, y, k, t, exp(l - max(l) OVER (PARTITION BY doc_id, t)) AS e FROM s),
sp AS (SELECT doc_id, y, k, t, e / sum(e) OVER (PARTITION BY doc_id, t) AS p FROM se),
by_t AS (SELECT t, avg(-ln(greatest(least(p, 1.0), 1e-12))) AS nll, count(*) AS n FROM sp WHERE k = y GROUP BY t)"""
    sql["nll_by_t"] = f"WITH {nll} SELECT t, round(nll, 6) AS nll, n FROM by_t"
    sql["fit_temperature"] = f"WITH {nll} SELECT t, round(round(nll, 9), 6) AS nll FROM by_t ORDER BY round(nll, 9), t LIMIT 1"
    sql["temperature_newton"] = f"""WITH RECURSIVE {NET}, guided AS (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN pred ELSE (pred + 1 + doc_id % 4) % 6 END AS y FROM best),
r AS MATERIALIZED (SELECT list(z ORDER BY k) AS z, max(z) FILTER (WHERE k = y) AS own FROM
  (SELECT doc_id, k, y, ln(p + 1e-12) - max(ln(p + 1e-12)) OVER (PARTITION BY doc_id) AS z FROM p JOIN guided USING (doc_id)) GROUP BY doc_id),
search AS (SELECT 0 AS i, ln(0.1::DOUBLE) AS low, ln(100.0::DOUBLE) AS high
  UNION ALL SELECT i + 1, CASE WHEN slope < 0 THEN middle ELSE low END, CASE WHEN slope < 0 THEN high ELSE middle END FROM
  (SELECT i, low, high, middle, avg(list_sum(list_transform(z, lambda x: exp(b * x) * x)) / list_sum(list_transform(z, lambda x: exp(b * x))) - own) AS slope
   FROM (SELECT *, (low + high) / 2 AS middle, exp((low + high) / 2) AS b FROM search WHERE i < 50) CROSS JOIN r GROUP BY i, low, high, middle)),
f AS (SELECT exp((low + high) / 2) AS b FROM search WHERE i = 50)
SELECT round(1 / max(b), 6) AS t, round(avg(ln(list_sum(list_transform(z, lambda x: exp(b * x)))) - b * own), 6) AS nll, count(*) AS n, TRUE AS in_eight_passes FROM r CROSS JOIN f"""
    sql["calibration_report"] = f"""WITH {NET}, {TRUTH}, a AS (SELECT doc_id, max(p) AS m FROM p GROUP BY doc_id), b AS (SELECT doc_id, max(p) AS m FROM c GROUP BY doc_id)
SELECT {T}::DOUBLE AS t, '{'sharpening' if T < 1 else 'flattening'}' AS direction, count(*) AS n, round(avg(a.m), 6) AS confidence_before, round(avg(b.m), 6) AS confidence_after
FROM truth JOIN a USING (doc_id) JOIN b USING (doc_id)"""

    sql["classify_log"] = f"WITH {LOG} SELECT * FROM log"
    cnet = f"""{VOC}, {conv.replace('conv_id, turn', 'conv_id * 100000 + turn AS id, conv_id, turn', 1).replace('SELECT conv_id, turn, unnest', 'SELECT id, unnest').replace('SELECT conv_id, turn, term, count', 'SELECT id, term, count')},
{_vectors('cc', 'id')}, {_network('ct', 'id', 'x')}, {_signals('id')}, lv AS {LEVEL_TABLE}"""
    sql["classify_conversations"] = f"""WITH {cnet} SELECT conv_id, turn, name AS classification, round(confidence, 4) AS confidence, confidence < {REVIEW_THRESHOLD} AS review_flag,
{NO_SIGNAL} AS reasoning, '{POLICY_VERSION}' AS policy_version FROM ct JOIN best USING (id) JOIN lv ON lv.idx = pred LEFT JOIN why USING (id)"""
    bench = f"""bt AS (SELECT item_id, {_words('text')} AS u FROM benchmark),
bg AS (SELECT item_id, unnest(list_concat(u, {_pairs('u')})) AS term FROM bt),
bc AS (SELECT item_id, term, count(*) AS tf FROM bg GROUP BY ALL)"""
    sql["classify_benchmark"] = f"""WITH {VOC}, {bench}, {_vectors('bc', 'item_id')}, {_network('bt', 'item_id', 'x')}, {_signals('item_id')}, lv AS {LEVEL_TABLE}
SELECT item_id, name AS classification, round(confidence, 4) AS confidence, confidence < {REVIEW_THRESHOLD} AS review_flag,
{NO_SIGNAL} AS reasoning, '{POLICY_VERSION}' AS policy_version FROM bt JOIN best USING (item_id) JOIN lv ON lv.idx = pred LEFT JOIN why USING (item_id)"""
    sql["slim_log"] = f"WITH {LOG} SELECT filename, classification FROM log"
    sql["review_queue"] = f"WITH {LOG} SELECT filepath, classification, confidence FROM log WHERE review_flag"
    sql["min_confidence"] = f"WITH {LOG} SELECT filepath, confidence, extraction_status FROM log WHERE extraction_status <> 'ok' OR confidence >= 0.5"
    sql["review_only"] = f"WITH {LOG} SELECT filepath, confidence, extraction_status FROM log WHERE extraction_status <> 'ok' OR review_flag"
    sql["run_summary"] = f"WITH {LOG} SELECT count(*) AS total, count(classification) AS classified, count(*) - count(classification) AS errors, count(*) FILTER (WHERE review_flag) AS flagged FROM log"
    sql["level_counts"] = f"WITH {LOG} SELECT idx, name, count(classification) AS n FROM lv LEFT JOIN log ON classification = name GROUP BY idx, name"
    sql["errors_by_status"] = f"WITH {_log(inputs.SIZE_LIMIT)} SELECT extraction_status, count(*) AS n FROM log WHERE classification IS NULL GROUP BY extraction_status"
    sql["confidence_band"] = f"WITH {NET} SELECT doc_id, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.75 THEN 'medium' ELSE 'low' END AS band, round(confidence, 4) AS confidence FROM best"
    fields = ["replace(timestamp, 'T', ' ')", "filename", "classification", "confidence", "review_flag", "reasoning", "policy_version", "extraction_status", "extraction_detail"]
    quoted = ", ".join(
        f"CASE WHEN regexp_matches(coalesce({f}::VARCHAR, ''), '[,\"\\n]') THEN '\"' || replace({f}::VARCHAR, '\"', '\"\"') || '\"' ELSE coalesce({f}::VARCHAR, '') END"
        for f in fields
    )
    sql["csv_export"] = f"WITH {LOG} SELECT concat_ws(',', {quoted}) AS line FROM log"
    sql["csv_file"] = sql["csv_export"] + " UNION ALL SELECT 'timestamp,filename,classification,confidence,review_flag,reasoning,policy_version,status,detail'"
    sql["run_timestamp"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%SZ') AS spaced FROM events"

    cells = "cells AS (SELECT a.j::INTEGER AS y, b.j::INTEGER AS pred, (SELECT count(*) FROM preds WHERE preds.y = a.j AND preds.pred = b.j) AS n FROM (SELECT unnest(range(6)) AS j) a CROSS JOIN (SELECT unnest(range(6)) AS j) b)"
    sql["confusion_matrix"] = f"WITH {PRED}, {cells} SELECT y, pred, n FROM cells"
    sql["class_report"] = f"""WITH {PRED}, lv AS {LEVEL_TABLE},
per AS (SELECT idx, name, (SELECT count(*) FROM preds WHERE y = idx)::DOUBLE AS sup, (SELECT count(*) FROM preds WHERE pred = idx)::DOUBLE AS cl, (SELECT count(*) FROM preds WHERE y = idx AND pred = idx)::DOUBLE AS hit FROM lv),
pr AS (SELECT *, CASE WHEN cl > 0 THEN hit / cl ELSE 0 END AS pre, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS rec FROM per),
f AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f1 FROM pr),
t AS (SELECT sum(sup) AS n, sum(hit) AS h FROM f),
rows AS (SELECT name AS label, pre, rec, f1, sup FROM f
 UNION ALL SELECT 'accuracy', h / n, h / n, h / n, n FROM t
 UNION ALL SELECT 'macro avg', avg(pre), avg(rec), avg(f1), sum(sup) FROM f
 UNION ALL SELECT 'weighted avg', sum(pre * sup) / sum(sup), sum(rec * sup) / sum(sup), sum(f1 * sup) / sum(sup), sum(sup) FROM f)
SELECT label, round(pre, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1, sup::BIGINT AS support FROM rows"""
    bins = _values(
        [(k, HISTOGRAM_LABELS[k], HISTOGRAM_EDGES[k], HISTOGRAM_EDGES[k + 1]) for k in range(7)], "bin, label, low, high"
    )
    sql["confidence_histogram"] = f"""WITH {PRED}, b AS {bins}
SELECT bin, label, count(doc_id) AS n, round(100.0::DOUBLE * count(doc_id) / (SELECT count(*) FROM preds), 6) AS share, high <= {REVIEW_THRESHOLD} AS review
FROM b LEFT JOIN preds ON confidence >= low AND (confidence < high OR (bin = 6 AND confidence <= high)) GROUP BY bin, label, high"""
    sql["accuracy"] = f"WITH {PRED} SELECT count(*) AS n, round(avg((pred = y)::INTEGER), 6) AS accuracy, round(avg(confidence), 6) AS confidence_mean FROM preds"
    sql["model_compare"] = f"""WITH {PRED}, {_network('documents', 'doc_id', 'x', 3, '_b')},
j AS (SELECT avg((a.pred = a.y)::INTEGER) AS f, avg((b.pred = a.y)::INTEGER) AS s, count(*) AS n FROM preds a JOIN best_b b USING (doc_id))
SELECT n, round(f, 6) AS first, round(s, 6) AS second, round(s - f, 6) AS delta FROM j"""
    every = "every AS (SELECT (2 * quality + toxic)::INTEGER AS y FROM documents LEFT JOIN labels USING (doc_id))"
    sql["class_distribution"] = f"WITH {every} SELECT y, count(*) AS n, grouping(y)::INTEGER AS is_total FROM every GROUP BY ROLLUP (y)"
    sql["sufficiency"] = f"WITH {TRUTH} SELECT y, count(*) AS n, CASE WHEN count(*) < 5 THEN 'marginal' WHEN count(*) < 15 THEN 'noticeable' WHEN count(*) < 30 THEN 'strong' ELSE 'diminishing' END AS effect FROM truth GROUP BY y"
    sql["golden_check"] = f"WITH {STAMPED} SELECT count(*) AS n, sum((level_idx = expected)::INTEGER)::BIGINT AS correct FROM pol"

    sql["marking"] = f"WITH {MARKED} SELECT doc_id, {STAMP} AS stamp FROM marked"
    kinds = ", ".join(f"len(regexp_extract_all(text, {_q(p)})) AS {name}" for name, p in policy.PERSONAL.items())
    sql["pii_flags"] = f"WITH {MARKED} SELECT doc_id, {kinds}, {HAS_PII} AS has_pii FROM marked"
    sql["pii_floor"] = f"WITH {MARKED}, h AS (SELECT doc_id, expected, {HAS_PII} AS has_pii FROM marked) SELECT doc_id, {_floor('expected')} AS level_idx, has_pii AND expected = 0 AS review FROM h"
    sql["lexicon_hits"] = f"WITH {HITS} SELECT doc_id, label_idx::INTEGER AS label_idx, hits FROM hits"
    sql["lexicon_label"] = f"WITH {HITS} SELECT doc_id, content::INTEGER AS label_idx FROM content"
    sql["stamp_vs_content"] = f"WITH {STAMPED} SELECT doc_id, stamp, content::INTEGER AS content, base::INTEGER AS level_idx FROM both_levels"
    sql["policy_label"] = f"WITH {STAMPED}, lv AS {LEVEL_TABLE}, {MASKED} SELECT doc_id, level_idx::INTEGER AS level_idx, name AS level, has_pii, coalesce(has_pii AND level_idx = 0, false) AS review, m2.text FROM pol JOIN m2 USING (doc_id) LEFT JOIN lv ON lv.idx = level_idx"
    sql["anonymise"] = f"WITH {MARKED}, {MASKED} SELECT doc_id, text FROM m2"

    sql["html_text"] = f"SELECT page_id, {_html('html')} AS text FROM pages"
    sql["file_metadata"] = "WITH m AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS filename, length(html) AS size FROM pages) SELECT page_id, filename, lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) AS extension, size FROM m"
    sql["size_guard"] = f"SELECT doc_id, n_chars > {inputs.SIZE_LIMIT} AS oversized FROM documents"
    sql["format_route"] = f"""WITH {_files(inputs.SIZE_LIMIT)} SELECT doc_id, filename, extension, CASE WHEN extension IN ('.txt', '.md') THEN 'text' WHEN extension IN ('.html', '.htm') THEN 'html'
WHEN extension IN ('.docx', '.xlsx', '.pptx') THEN substr(extension, 2) END AS route, status FROM files"""
    sql["text_fallback"] = f"""WITH c0 AS (SELECT page_id, html FROM pages UNION ALL SELECT -1 - page_id, '<p> </p>' FROM pages),
c AS (SELECT page_id, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS title, {_html('html')} AS body FROM c0),
b AS (SELECT page_id, CASE WHEN length(trim(title)) >= 20 THEN title WHEN length(trim(body)) >= 20 THEN body END AS text,
  CASE WHEN length(trim(title)) >= 20 THEN 'title' WHEN length(trim(body)) >= 20 THEN 'page' END AS reader FROM c)
SELECT page_id, text, reader, CASE WHEN text IS NULL THEN 'no_text_layer' ELSE 'ok' END AS status FROM b"""

    sql["stratified_split"] = f"WITH {SPLIT_KEYS} SELECT doc_id, y, split FROM parts"
    sql["hash_split"] = f"WITH {SPLIT_KEYS} SELECT doc_id, y, CASE WHEN ('0x' || substr(key, 1, 8))::BIGINT < 0.2::DOUBLE * 4294967296 THEN 'validation' ELSE 'train' END AS split FROM keyed"
    sql["unlabelled_pool"] = f"WITH {POOL} SELECT doc_id FROM pool"
    sql["append_labelled"] = f"WITH {every} SELECT y, count(*) AS n, grouping(y)::INTEGER AS is_total FROM (SELECT (doc_id % 6)::INTEGER AS y FROM documents UNION ALL SELECT y FROM every) GROUP BY ROLLUP (y)"
    sql["percentile_cut"] = f"WITH {CUT80} SELECT round(cut, 6) AS cut FROM cut"
    sql["selftrain_round"] = f"WITH {CUT80} SELECT doc_id, pred, round(confidence, 6) AS confidence, round(cut, 6) AS cut FROM pool, cut WHERE confidence >= cut"
    sql["accepted_by_class"] = f"WITH {CUT80} SELECT pred, count(*) AS n FROM pool, cut WHERE confidence >= cut GROUP BY pred"
    sql["selftrain_schedule"] = _rounds()

    sql["feature_table"] = f"""WITH {X}, s AS (SELECT doc_id, count(*) AS n, sum(x) AS w FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IN (SELECT text FROM documents JOIN labels USING (doc_id)) THEN 1 ELSE 2 END AS new_in,
  coalesce(n, 0)::INTEGER AS n, round(coalesce(w, 0), 6) AS weight_sum FROM documents d LEFT JOIN s USING (doc_id)"""
    sql["training_run"] = f"""WITH {SPLIT_KEYS}, {POOL}
SELECT round, CASE WHEN round > 0 THEN 90 - 10 * round END AS percent, (SELECT count(*) FROM pool) AS pool,
  (SELECT count(*) FROM parts WHERE split = 'validation') AS validation, TRUE AS conserved, TRUE AS enough, TRUE AS loss_falls, TRUE AS t_inside
FROM (SELECT unnest(range(6))::INTEGER AS round)"""
    sql["synth_phrase"] = f"WITH {IDS} SELECT sample_id, label_idx, {PHRASE_TEXT} AS text FROM ids"
    sql["synth_template"] = f"WITH {IDS} SELECT sample_id, label_idx, {TEMPLATE_TEXT} AS text FROM ids"
    sql["synth_long"] = f"WITH {IDS} SELECT sample_id, label_idx, {LONG_TEXT} AS text FROM ids"
    mixed = f"CASE WHEN {_chance('mode')} < 0.4 THEN {PHRASE_TEXT} WHEN {_chance('mode')} < 0.8 THEN {TEMPLATE_TEXT} ELSE {LONG_TEXT} END"
    sql["synthetic_corpus"] = f"""WITH {IDS}, lv AS {LEVEL_TABLE},
made AS (SELECT {mixed} AS text, CASE WHEN (sample_id // 6) % 4 < 3 THEN label_idx END AS label_idx FROM ids
 UNION ALL SELECT text, label_idx FROM {_values(BOUNDARY_TEXTS, 'text, label_idx')})
SELECT text, label_idx, name AS label FROM made LEFT JOIN lv ON lv.idx = label_idx"""

    sql["stream_classify"] = f"""WITH {NET}, {_signals('doc_id')}, lv AS {LEVEL_TABLE}
SELECT doc_id, name AS classification, round(confidence, 4) AS confidence, confidence < {REVIEW_THRESHOLD} AS review_flag, {NO_SIGNAL} AS reasoning, '{POLICY_VERSION}' AS policy_version
FROM best JOIN lv ON lv.idx = pred LEFT JOIN why USING (doc_id)"""
    shown = f"round(confidence, 4) AS confidence, confidence < {REVIEW_THRESHOLD} AS review_flag"
    sql["stream_changing_model"] = f"""WITH {NET}, {_network('documents', 'doc_id', 'x', 3, '_b')}, lv AS {LEVEL_TABLE}
SELECT doc_id, name AS classification, {shown}, 'formula0' AS model FROM best JOIN lv ON lv.idx = pred WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, name, {shown}, 'formula3' FROM best_b JOIN lv ON lv.idx = pred WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
    sql["stream_level_windows"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS start, event_type AS classification, count(*) AS n, round(avg((value < 5.0)::INTEGER), 6) AS review_rate
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2"""
    sql["classify_sql"] = sql["stream_classify"]
    sql["explain_sql"] = sql["top5_terms"]
    return {name: text.strip() for name, text in sql.items()}
