"""DuckDB SQL for every registered query (the correctness oracle).

The views mirror ``spanlab.plans.testviews`` in plain SQL; the queries restate each
operator's semantics independently of the Spark code (windows and list lambdas).
"""

from __future__ import annotations

from spanlab.functions import text as T
from spanlab.operators import prompts as PR
from spanlab.plans import testviews as V


# Sentence ends as line ends (H8, H9).
SENTENCES = r"""regexp_replace(input_text, '([.!?][''")\]]?)\s+', '\1' || chr(10), 'g')"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _demojize(expr: str) -> str:
    pairs = sorted(V.EMOJI_TABLE, key=lambda p: (-len(p[0]), p[0]))
    out = expr
    for emo, name in pairs:
        out = f"replace({out}, {_q(emo)}, {_q(':' + name + ':')})"
    return out


def clean_sql(expr: str) -> str:
    no_url = f"regexp_replace({_demojize(expr)}, {_q(T.URL_PATTERN)}, '', 'g')"
    ws = f"trim(regexp_replace({no_url}, {_q(T.WHITESPACE_RUN)}, ' ', 'g'))"
    return f"regexp_replace({ws}, '_+', '', 'g')"


def strip_dots_sql(expr: str) -> str:
    return f"trim({expr}, '.')"


def similarity_sql(a: str, b: str) -> str:
    lcs = (
        f"list_reduce(range(1, length({a}) + 1), lambda prev, i: list_reduce(range(1, length({b}) + 1), "
        f"lambda cur, j: list_concat(cur, [CASE WHEN substring({a}, i, 1) = substring({b}, j, 1) "
        f"THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END]), [0]), "
        f"list_transform(range(0, length({b}) + 1), lambda z: 0))[length({b}) + 1]"
    )
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 WHEN {a} = {b} THEN 100 "
        f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 "
        f"ELSE CAST(round_even(100.0::DOUBLE * (CAST(2 * {lcs} AS DOUBLE) / CAST(length({a}) + length({b}) AS DOUBLE)), 0) AS INTEGER) END)"
    )


def partial_sql(g: str, p: str) -> str:
    gw, pw = f"string_split({g}, ' ')", f"string_split({p}, ' ')"
    return (
        f"(CASE WHEN {g} = {p} THEN 'COR' "
        f"WHEN len({gw}) = len({pw}) THEN CASE WHEN len(list_filter(range(1, len({gw}) + 1), lambda k: {gw}[k] = {pw}[k])) > 0 THEN 'PAR' ELSE 'INC' END "
        f"WHEN len({gw}) > len({pw}) THEN CASE WHEN len(list_filter({pw}, lambda w: contains({g}, w))) > 0 THEN 'PAR' ELSE 'INC' END "
        f"ELSE CASE WHEN len(list_filter({gw}, lambda w: contains({p}, w))) > 0 THEN 'PAR' ELSE 'INC' END END)"
    )


def exact_sql(g: str, p: str) -> str:
    return f"(CASE WHEN {g} = {p} THEN 'COR' ELSE 'INC' END)"


def split_spans_sql(expr: str) -> str:
    low = f"lower({expr})"
    return f"(CASE WHEN {low} IS NULL OR {low} = 'none' THEN []::VARCHAR[] ELSE string_split({low}, '; ') END)"


def phrase_sql(w: str, tag: str, id_col: str, n: int) -> str:
    """``n`` words of the list ``w`` from a place that md5 of the tag and the id names."""
    at = f"(('0x' || substr(md5('{tag}:' || CAST({id_col} AS VARCHAR)), 1, 8))::BIGINT % greatest(len({w}) - {n} + 1, 1))"
    return f"array_to_string({w}[{at} + 1:{at} + {n}], ' ')"


def views() -> str:
    runs_c = _list(V.CLASS_RUNS)
    runs_s = _list(V.SPAN_RUNS)
    emojis = _list([e for e, _ in V.EMOJI_TABLE])
    n_emoji = len(V.EMOJI_TABLE)
    flip = f"CASE WHEN target_text = {_q(T.POSITIVE_CLASS_TEXT)} THEN {_q(T.NEGATIVE_CLASS_TEXT)} ELSE {_q(T.POSITIVE_CLASS_TEXT)} END"
    return f"""
texts AS (SELECT CAST(doc_id AS VARCHAR) AS tweet_id, text AS tweet FROM documents),
noisy_texts AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS tweet_id,
         d.text || ' ' || coalesce(p.url || ' ', '') || {_q(V.NOISE_TOKEN + ' ')} ||
         list_extract({emojis}, CAST(('0x' || substr(md5('emoji:' || CAST(d.doc_id AS VARCHAR)), 1, 2))::BIGINT % {n_emoji} AS INTEGER) + 1) AS tweet
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id),
class_labels AS (SELECT CAST(doc_id AS VARCHAR) AS tweet_id, CASE WHEN toxic = 1 THEN 'ADE' ELSE 'NoADE' END AS label FROM labels),
span_base AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
span_raw AS (SELECT doc_id, text, unnest([{phrase_sql('w', 'a', 'doc_id', 3)}, {phrase_sql('w', 'b', 'doc_id', 2)}]) AS label FROM span_base),
span_labels AS (
  SELECT CAST(doc_id AS VARCHAR) AS tweet_id, 'ADE' AS type, CAST(instr(text, label) - 1 AS INTEGER) AS "begin",
         CAST(instr(text, label) - 1 + length(label) AS INTEGER) AS "end", label FROM span_raw),
uniq_texts AS (SELECT tweet_id, min(tweet) AS tweet FROM texts WHERE tweet_id IS NOT NULL GROUP BY tweet_id),
prepared_class AS (
  SELECT t.tweet_id, t.tweet, {_q(T.CLASS_PREFIX)} AS prefix, {clean_sql('t.tweet')} AS input_text,
         CASE coalesce(l.label, 'NoADE') WHEN 'ADE' THEN {_q(T.CLASS_TARGETS['ADE'])} WHEN 'NoADE' THEN {_q(T.CLASS_TARGETS['NoADE'])} END AS target_text
  FROM uniq_texts t LEFT JOIN (SELECT tweet_id, min(label) AS label FROM class_labels GROUP BY tweet_id) l USING (tweet_id)),
span_first AS (
  SELECT tweet_id, label FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY "begin", "end", label, type) AS rn FROM span_labels) WHERE rn = 1),
span_joined AS (SELECT tweet_id, string_agg(label, '; ' ORDER BY "begin", "end", label) AS label FROM span_labels GROUP BY tweet_id),
prepared_spans AS (
  SELECT t.tweet_id, t.tweet, {_q(T.SPAN_PREFIX)} AS prefix, {clean_sql('t.tweet')} AS input_text, coalesce(l.label, 'none') AS target_text
  FROM uniq_texts t LEFT JOIN span_first l USING (tweet_id)),
span_gold AS (SELECT t.tweet_id, t.tweet, coalesce(l.label, 'none') AS gold FROM uniq_texts t LEFT JOIN span_joined l USING (tweet_id)),
class_runs AS (
  SELECT run, tweet_id, tweet, prefix, input_text, target_text,
         CASE WHEN substr(md5(run || ':' || tweet_id), 3, 1) = 'f' THEN p0 || '.' ELSE p0 END AS predicted_text
  FROM (SELECT pc.*, r.run, CASE WHEN substr(md5(r.run || ':' || pc.tweet_id), 1, 2) < '40' THEN ({flip}) ELSE target_text END AS p0
        FROM prepared_class pc, (SELECT unnest({runs_c}) AS run) r)),
span_runs AS (
  SELECT run, tweet_id, tweet, prefix, input_text, target_text,
    CASE WHEN d IN ('0','1','2','3','4','5') THEN gold
         WHEN d IN ('6','7') THEN s1
         WHEN d IN ('8','9') THEN {phrase_sql('w', 'c', 'tweet_id', 2)}
         WHEN d IN ('a','b') THEN 'none'
         WHEN d = 'c' THEN {phrase_sql('w', 'b', 'tweet_id', 2)} || '; ' || s1
         WHEN d = 'd' THEN concat_ws('; ', {', '.join(phrase_sql('w', f'many{k}', 'tweet_id', 1 + k % 3) for k in range(6))})
         WHEN d = 'e' THEN gold || '.'
         ELSE s1 || ' ' || w[len(w)] END AS predicted_text
  FROM (SELECT ps.*, g.gold, r.run, string_split(ps.tweet, ' ') AS w,
               {phrase_sql("string_split(ps.tweet, ' ')", 'a', 'ps.tweet_id', 3)} AS s1,
               substr(md5(r.run || ':' || ps.tweet_id), 1, 1) AS d
        FROM prepared_spans ps JOIN span_gold g USING (tweet_id), (SELECT unnest({runs_s}) AS run) r)),
class_gold_raw AS (
  SELECT tweet_id, CASE label WHEN 'ADE' THEN {_q(T.CLASS_TARGETS['ADE'])} WHEN 'NoADE' THEN {_q(T.CLASS_TARGETS['NoADE'])} END AS target_text FROM class_labels),
span_gold_raw AS (SELECT tweet_id, target_text FROM prepared_spans WHERE tweet_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)),
span_norm AS (SELECT run, tweet_id, tweet, lower(trim(predicted_text, '.')) AS predicted_text FROM span_runs),
class_norm AS (SELECT run, tweet_id, tweet, lower(trim(predicted_text, '.')) AS predicted_text FROM class_runs),
span_counts AS (SELECT tweet_id, predicted_text, count(*) AS counts FROM span_norm WHERE tweet_id IS NOT NULL AND predicted_text IS NOT NULL GROUP BY ALL),
span_majority AS (SELECT * FROM span_counts WHERE counts * 2 >= {len(V.SPAN_RUNS)}),
span_rest AS (SELECT * FROM span_counts WHERE tweet_id NOT IN (SELECT tweet_id FROM span_majority)),
span_cands AS (SELECT tweet_id, list_sort(list(predicted_text)) AS all_spans FROM span_rest WHERE predicted_text IS DISTINCT FROM 'none' GROUP BY tweet_id),
class_counts AS (SELECT tweet_id, predicted_text, count(*) AS counts FROM class_norm WHERE tweet_id IS NOT NULL AND predicted_text IS NOT NULL GROUP BY ALL),
class_vote AS (
  SELECT tweet_id, predicted_text, counts FROM (
    SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY counts DESC, predicted_text) AS rn FROM class_counts) WHERE rn = 1),
eval_table AS (
  SELECT r.run, r.tweet_id, trim(r.predicted_text, '.') AS pred_labels, g.gold AS gold_labels
  FROM span_runs r JOIN span_gold g USING (tweet_id))
"""


def common_block_best_sql(a: str, b: str) -> str:
    """Longest common block of lower(a), lower(b) as ``{nn: -length, s: start in a}``; earliest in a.

    Enumerates the substrings of ``a`` (the spans are short phrases)."""
    la, lb = f"lower({a})", f"lower({b})"
    cands = (
        f"list_filter(flatten(list_transform(range(1, length({a}) + 1), lambda s: "
        f"list_transform(range(1, length({a}) - s + 2), lambda n: {{'nn': -n, 's': s}}))), "
        f"lambda c: contains({lb}, substring({la}, c.s, -c.nn)))"
    )
    return f"list_sort({cands})[1]"


def consensus_sql(spans: str, key: str, seed: int = 25) -> str:
    pairs = (
        f"flatten(list_transform(range(1, len({spans})), lambda i: list_transform(range(i + 1, len({spans}) + 1), "
        f"lambda j: {{'a': {spans}[i], 'b': {spans}[j], 'o': (i - 1) * len({spans}) + (j - 1)}})))"
    )
    return pairs


def _greedy_sql(g: str, p: str) -> str:
    pairs = (
        f"list_sort(flatten(list_transform(range(0, len({g})), lambda gi: list_transform(range(0, len({p})), "
        f"lambda pj: {{'ns': -{similarity_sql(f'{g}[gi + 1]', f'{p}[pj + 1]')}, 'gi': gi, 'pj': pj}}))))"
    )
    init = "{'ug': []::BIGINT[], 'up': []::BIGINT[], 'm': []::STRUCT(gi BIGINT, pj BIGINT)[]}"
    return (
        f"list_reduce({pairs}, lambda acc, x: CASE WHEN list_contains(acc.ug, x.gi) OR list_contains(acc.up, x.pj) THEN acc "
        f"ELSE {{'ug': list_append(acc.ug, x.gi), 'up': list_append(acc.up, x.pj), 'm': list_append(acc.m, {{'gi': x.gi, 'pj': x.pj}})}} END, {init})"
    )


def _eval_spans_sql(keep: str, src: str = "eval_table") -> str:
    row = lambda gold, pred, pa, ex: f"{{'gold': {gold}, 'pred': {pred}, 'partial': {pa}, 'exact': {ex}, 'strict': {ex}}}"
    ge, pe = "gs[q.gi + 1]", "ps[q.pj + 1]"
    matched = f"list_transform(fold.m, lambda q: {row(ge, pe, partial_sql(ge, pe), exact_sql(ge, pe))})"
    left_g = f"list_transform(list_filter(range(0, len(gs)), lambda k: NOT list_contains(fold.ug, k)), lambda k: {row('gs[k + 1]', _q('none'), _q('MIS'), _q('MIS'))})"
    left_p = f"list_transform(list_filter(range(0, len(ps)), lambda k: NOT list_contains(fold.up, k)), lambda k: {row(_q('none'), 'ps[k + 1]', _q('SPU'), _q('SPU'))})"
    return f"""
x0 AS (SELECT {keep}, coalesce(lower(gold_labels), 'none') AS g, coalesce(lower(pred_labels), 'none') AS p,
              {split_spans_sql('gold_labels')} AS gs, {split_spans_sql('pred_labels')} AS ps FROM {src}),
x1 AS (SELECT *, CASE WHEN len(gs) > 0 AND len(ps) > 0 THEN {_greedy_sql('gs', 'ps')} END AS fold FROM x0),
x2 AS (SELECT {keep}, CASE
   WHEN len(gs) = 0 AND len(ps) = 0 THEN [{row('g', 'p', _q('COR'), _q('COR'))}]
   WHEN len(ps) = 0 THEN [{row('g', 'p', _q('MIS'), _q('MIS'))}]
   WHEN len(gs) = 0 THEN [{row('g', 'p', _q('SPU'), _q('SPU'))}]
   ELSE list_concat({matched}, {left_g}, {left_p}) END AS rows FROM x1),
matches AS (SELECT {keep}, unnest(rows, recursive := true) FROM x2)"""


def _scores_sql(by: str) -> str:
    byc = f"{by}, " if by else ""
    return f"""
lv AS (SELECT {byc}'partial' AS level, partial AS status FROM matches UNION ALL
       SELECT {byc}'exact', exact FROM matches UNION ALL SELECT {byc}'strict', strict FROM matches),
cnt AS (SELECT {byc}level, count_if(status = 'COR') AS correct, count_if(status = 'INC') AS incorrect,
        count_if(status = 'PAR') AS partial, count_if(status = 'MIS') AS missed, count_if(status = 'SPU') AS spurius
        FROM lv GROUP BY ALL),
pr AS (SELECT *, (CASE WHEN level = 'partial' THEN correct + 0.5::DOUBLE * partial ELSE CAST(correct AS DOUBLE) END) / (correct + incorrect + partial + spurius) AS precision,
              (CASE WHEN level = 'partial' THEN correct + 0.5::DOUBLE * partial ELSE CAST(correct AS DOUBLE) END) / (correct + incorrect + partial + missed) AS recall FROM cnt),
scores AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * ((precision * recall) / (precision + recall)) END AS f1_score FROM pr)"""


def _report_sql(src: str, label: str, pred: str, by: str = "") -> str:
    byc = f"{by}, " if by else ""
    return f"""
conf AS (SELECT {byc}{label} AS t, {pred} AS p, count(*) AS n FROM {src} GROUP BY ALL),
roles AS (SELECT {byc}t AS c, n AS t, 0 AS p, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM conf
          UNION ALL SELECT {byc}p AS c, 0 AS t, n AS p, 0 AS tp FROM conf),
per0 AS (SELECT {byc}c, CAST(sum(t) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS npred, CAST(sum(tp) AS BIGINT) AS tp FROM roles WHERE c IS NOT NULL GROUP BY ALL),
per1 AS (SELECT {byc}c AS class, CASE WHEN npred = 0 THEN 0.0::DOUBLE ELSE tp / npred END AS precision,
         CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support END AS recall, support, tp FROM per0),
per AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE (2.0::DOUBLE * precision * recall) / (precision + recall) END AS f1_score FROM per1),
summ AS (SELECT {byc}sum(tp) AS _tp, sum(support) AS _n, avg(precision) AS _mp, avg(recall) AS _mr, avg(f1_score) AS _mf,
         sum(precision * support) AS _wp, sum(recall * support) AS _wr, sum(f1_score * support) AS _wf FROM per GROUP BY ALL)
SELECT {byc}class, precision, recall, f1_score, support FROM per
UNION ALL SELECT {byc}'accuracy', NULL::DOUBLE, NULL::DOUBLE, _tp / _n, CAST(_n AS BIGINT) FROM summ
UNION ALL SELECT {byc}'macro avg', _mp, _mr, _mf, CAST(_n AS BIGINT) FROM summ
UNION ALL SELECT {byc}'weighted avg', _wp / _n, _wr / _n, _wf / _n, CAST(_n AS BIGINT) FROM summ"""


def _prompt_values() -> str:
    rows = ", ".join(
        f"({_q(p['prompt'])}, {_q(p['input_tpl'])}, {_q(p['neg_tpl'])}, {_q(p['pos_tpl'])}, {_q(p['marker'])})" for p in PR.PROMPTS
    )
    return f"(VALUES {rows}) AS pt(prompt, input_tpl, neg_tpl, pos_tpl, marker)"


def _with(body: str, extra: str = "") -> str:
    ex = ("," + extra) if extra else ""
    return f"WITH {views()}{ex}\n{body}"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["b7_clean_text"] = _with(f"SELECT tweet_id, {clean_sql('tweet')} AS input_text FROM noisy_texts")
    q["b3_prepared_class"] = _with("SELECT tweet_id, prefix, input_text, target_text FROM prepared_class")
    q["d1_attach_labels_first"] = _with("SELECT tweet_id, target_text FROM prepared_spans")
    q["d1_attach_labels_join"] = _with("SELECT tweet_id, gold AS target_text FROM span_gold")
    q["b9_model_input"] = _with("SELECT tweet_id, prefix || ': ' || input_text AS model_input FROM prepared_class")
    apply = (
        f"SELECT pt.prompt, ps.tweet_id, {_q(T.SPAN_PREFIX)} AS prefix, replace(pt.input_tpl, '{{}}', ps.input_text) AS input_text, "
        f"CASE WHEN ps.target_text = 'none' THEN pt.neg_tpl ELSE replace(pt.pos_tpl, '{{}}', ps.target_text) END AS target_text, pt.marker "
        f"FROM prepared_spans ps, {_prompt_values()}"
    )
    q["b8_apply_prompts"] = _with("SELECT prompt, tweet_id, prefix, input_text, target_text FROM applied", f"applied AS ({apply})")
    q["b10_unwrap_prompt"] = _with(
        "SELECT prompt, tweet_id, CASE WHEN contains(target_text, marker) THEN trim(replace(target_text, marker, ''), '.') ELSE 'none' END AS unwrapped FROM applied",
        f"applied AS ({apply})",
    )
    q["e1_vote_counts"] = _with("SELECT * FROM span_counts")
    q["e2_majority_texts"] = _with("SELECT * FROM span_majority")
    q["d4_without_majority"] = _with("SELECT * FROM span_rest")
    q["d4_without_majority_window"] = _with("SELECT * FROM span_rest")
    q["e3_candidate_spans"] = _with("SELECT tweet_id, array_to_string(all_spans, ' | ') AS all_spans FROM span_cands")
    cons = f"""
pairs AS (SELECT tweet_id, all_spans, unnest({consensus_sql('all_spans', 'tweet_id')}) AS pr FROM span_cands),
blocks0 AS (SELECT tweet_id, all_spans, pr.o AS o, pr.a AS a, {common_block_best_sql('pr.a', 'pr.b')} AS bx FROM pairs),
blocks AS (SELECT tweet_id, all_spans, o, coalesce(substring(a, bx.s, -bx.nn), '') AS m FROM blocks0),
good AS (SELECT tweet_id, o, m, len(list_filter(all_spans, lambda s: contains(s, m))) AS c FROM blocks WHERE length(m) >= 5),
best AS (SELECT tweet_id, m FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY c DESC, o) AS rn FROM good) WHERE rn = 1),
fallback AS (SELECT tweet_id, s AS m FROM (SELECT tweet_id, s, row_number() OVER (PARTITION BY tweet_id ORDER BY md5('25:' || tweet_id || ':' || s), s) AS rn
             FROM (SELECT tweet_id, unnest(all_spans) AS s FROM span_cands)) WHERE rn = 1),
consensus AS (SELECT c.tweet_id, coalesce(b.m, f.m) AS predicted_text FROM span_cands c LEFT JOIN best b USING (tweet_id) LEFT JOIN fallback f USING (tweet_id)),
ensemble AS (SELECT tweet_id, predicted_text FROM span_majority UNION ALL SELECT tweet_id, predicted_text FROM consensus),
run0 AS (SELECT tweet_id, tweet FROM span_runs WHERE run = (SELECT min(run) FROM span_runs)),
ens_text AS (SELECT e.tweet_id, e.predicted_text, r.tweet FROM ensemble e LEFT JOIN run0 r USING (tweet_id))"""
    q["j2_common_span"] = _with("SELECT tweet_id, predicted_text FROM consensus", cons)
    q["j3_span_ensemble"] = _with("SELECT tweet_id, predicted_text FROM ensemble", cons)
    q["d2_attach_text"] = _with("SELECT tweet_id, predicted_text, tweet FROM ens_text", cons)
    q["j1_majority_vote"] = _with("SELECT * FROM class_vote")
    class_ens = "cls_text AS (SELECT v.tweet_id, v.predicted_text, v.counts, r.tweet FROM class_vote v LEFT JOIN (SELECT tweet_id, tweet FROM class_runs WHERE run = (SELECT min(run) FROM class_runs)) r USING (tweet_id))"
    q["j4_class_ensemble"] = _with("SELECT tweet_id, predicted_text, counts, tweet FROM cls_text", class_ens)
    q["b14_submission_spans"] = _with(
        """SELECT tweet_id, 'ADE' AS predicted_class, CAST(st AS VARCHAR) AS span_start, CAST(st + length(sp) AS VARCHAR) AS span_end, sp AS span
           FROM (SELECT tweet_id, trim(predicted_text, '.') AS sp, CAST(instr(lower(tweet), lower(trim(predicted_text, '.'))) - 1 AS INTEGER) AS st
                 FROM ens_text WHERE trim(predicted_text, '.') IS DISTINCT FROM 'none') WHERE st <> -1""",
        cons,
    )
    q["b14_dropped_count"] = _with(
        """SELECT count_if(instr(lower(tweet), lower(trim(predicted_text, '.'))) = 0) AS n_dropped
           FROM ens_text WHERE trim(predicted_text, '.') IS DISTINCT FROM 'none'""",
        cons,
    )
    q["b14_submission_class"] = _with(
        "SELECT tweet_id, 'ADE' AS predicted_class, '0' AS span_start, '0' AS span_end, '-' AS span FROM cls_text WHERE trim(predicted_text, '.') = 'adverse event problem'",
        class_ens,
    )
    q["b13_span_offsets"] = _with(
        """SELECT run, tweet_id, CAST(instr(lower(tweet), lower(p)) - 1 AS INTEGER) AS span_start,
                  CAST(instr(lower(tweet), lower(p)) - 1 + length(p) AS INTEGER) AS span_end
           FROM (SELECT run, tweet_id, tweet, trim(predicted_text, '.') AS p FROM span_runs) WHERE p IS DISTINCT FROM 'none'"""
    )
    sims = f"""
sp AS (SELECT run, tweet_id, {split_spans_sql('gold_labels')} AS g, {split_spans_sql('pred_labels')} AS p FROM eval_table),
pairs AS (SELECT run, tweet_id, g, p, unnest(flatten(list_transform(range(0, len(g)), lambda gi: list_transform(range(0, len(p)), lambda pj: {{'gi': gi, 'pj': pj}})))) AS x FROM sp),
sims AS (SELECT run, tweet_id, g[x.gi + 1] AS gold, p[x.pj + 1] AS pred, {similarity_sql('g[x.gi + 1]', 'p[x.pj + 1]')} AS similarity FROM pairs)"""
    q["i1_similarity"] = _with("SELECT * FROM sims", sims)
    q["i2_pair_status"] = _with(
        f"SELECT run, tweet_id, gold, pred, {partial_sql('gold', 'pred')} AS partial, {exact_sql('gold', 'pred')} AS exact FROM sims", sims
    )
    q["i4_eval_spans"] = _with("SELECT * FROM matches", _eval_spans_sql("run, tweet_id"))
    q["e6_span_scores"] = _with("SELECT * FROM scores", _eval_spans_sql("run, tweet_id") + "," + _scores_sql("run"))
    q["i5_evaluate_extraction"] = _with("SELECT * FROM scores", _eval_spans_sql("tweet_id") + "," + _scores_sql(""))
    long_rows = " UNION ALL ".join(
        f"SELECT level || '_{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM scores"
        for m in ["correct", "incorrect", "partial", "missed", "spurius", "precision", "recall", "f1_score"]
    )
    q["a9_metrics_long"] = _with(long_rows, _eval_spans_sql("tweet_id") + "," + _scores_sql(""))
    rep_src = "rep_src AS (SELECT v.tweet_id, v.predicted_text, g.target_text AS gold_text FROM class_vote v LEFT JOIN prepared_class g USING (tweet_id))"
    q["e7_classification_report"] = "WITH " + views() + "," + rep_src + "," + _report_sql("rep_src", "gold_text", "predicted_text")
    q["e7_report_per_run"] = (
        "WITH " + views() + ", rr AS (SELECT run, target_text, lower(trim(predicted_text, '.')) AS pred FROM class_runs),"
        + _report_sql("rr", "target_text", "pred", "run")
    )
    cerr = f"""
cerr AS (SELECT r.*, replace(r.run, 'assert_', '') AS model,
           CASE WHEN r.predicted_text IS NOT DISTINCT FROM 'healthy okay' THEN 'NoADE' ELSE 'ADE' END AS class, g.label
         FROM class_runs r LEFT JOIN (SELECT tweet_id, CASE WHEN target_text IS NOT DISTINCT FROM 'healthy okay' THEN 'NoADE' ELSE 'ADE' END AS label FROM class_gold_raw) g USING (tweet_id)),
cerr2 AS (SELECT *, CASE WHEN class = 'ADE' AND label = 'NoADE' THEN 'fp' WHEN label = 'ADE' AND class = 'NoADE' THEN 'fn' END AS error_kind FROM cerr)"""
    q["k1_class_errors"] = _with(
        "SELECT model, count_if(error_kind = 'fp') AS n_fp, count_if(error_kind = 'fn') AS n_fn, count(label) AS n_with_gold FROM cerr2 GROUP BY model",
        cerr,
    )
    q["k1_error_rows"] = _with("SELECT run, model, tweet_id, class, label, error_kind FROM cerr2 WHERE error_kind IS NOT NULL", cerr)
    q["e8_nonnull_counts_fn"] = _with(
        "SELECT model, count(tweet_id) AS tweet_id, count(tweet) AS tweet, count(class) AS class, count(label) AS label FROM cerr2 WHERE error_kind = 'fn' GROUP BY model",
        cerr,
    )
    q["e8_nonnull_counts"] = _with(
        "SELECT model, count(tweet_id) AS tweet_id, count(tweet) AS tweet, count(class) AS class, count(label) AS label FROM cerr2 WHERE error_kind = 'fp' GROUP BY model",
        cerr,
    )
    serr = """
serr AS (SELECT r.run, replace(r.run, 'ner_', '') AS model, r.tweet_id, r.tweet, trim(r.predicted_text, '.') AS predicted_text, g.target_text AS gold_text
         FROM span_runs r LEFT JOIN span_gold_raw g USING (tweet_id)),
serr2 AS (SELECT *, gold_text IS DISTINCT FROM predicted_text AS mismatch,
            gold_text IS DISTINCT FROM 'none' AND predicted_text IS NOT DISTINCT FROM 'none' AS fn,
            gold_text IS NOT DISTINCT FROM 'none' AND predicted_text IS DISTINCT FROM 'none' AS fp,
            gold_text IS DISTINCT FROM 'none' AND predicted_text IS DISTINCT FROM 'none' AND gold_text IS DISTINCT FROM predicted_text AS partial FROM serr)"""
    q["k2_span_errors"] = _with(
        "SELECT model, count_if(mismatch) AS n_mismatch, count_if(fn) AS n_fn, count_if(fp) AS n_fp, count_if(partial) AS n_partial FROM serr2 GROUP BY model",
        serr,
    )
    q["k2_error_rows"] = _with("SELECT model, tweet_id, predicted_text, gold_text, fn, fp, partial FROM serr2 WHERE mismatch", serr)
    q["k3_error_example"] = _with(
        """SELECT model, tweet, predicted_text, gold_text FROM (
             SELECT *, row_number() OVER (PARTITION BY model ORDER BY tweet_id) AS rn FROM serr2 WHERE partial) WHERE rn = 1""",
        serr,
    )
    q["e4_value_counts"] = _with("SELECT target_text AS value, count(*) AS count FROM prepared_class WHERE target_text IS NOT NULL GROUP BY 1")
    wc = f"trim(regexp_replace(input_text, {_q(T.WHITESPACE_RUN)}, ' ', 'g'))"
    q["e5_avg_words"] = _with(
        f"SELECT avg(CAST(CASE WHEN {wc} = '' THEN 0 ELSE len(string_split({wc}, ' ')) END AS DOUBLE)) AS avg_words, count(input_text) AS n_texts "
        f"FROM prepared_class WHERE target_text = {_q(T.POSITIVE_CLASS_TEXT)}"
    )
    q["e10_class_sizes"] = _with(
        "SELECT CASE WHEN target_text IS DISTINCT FROM 'none' THEN 'ade' ELSE 'none' END AS label, count(*) AS n FROM prepared_spans GROUP BY 1"
    )
    q["e11_distinct_texts"] = _with("SELECT count(DISTINCT tweet) AS n_distinct FROM texts")
    _balance_queries(q)
    _augment_queries(q)
    q["m1_best_checkpoint"] = m1_sql(patience=3)
    q["h9_markov_generate"] = h9_sql()
    _model_queries(q)
    q["a1_read_tsv"] = _with("SELECT tweet_id, label FROM class_labels")
    q["a1_read_tsv_unquoted"] = _with("SELECT tweet_id, regexp_replace(tweet, '[\\n\\r\\t]', ' ', 'g') AS tweet FROM texts")
    q["a2_read_splits"] = _with(
        """SELECT CASE WHEN substr(md5('split:' || tweet_id), 1, 1) < 'd' THEN 'train' ELSE 'valid' END AS split, 'tweet' AS kind, tweet_id, regexp_replace(tweet, '[\\n\\r\\t]', ' ', 'g') AS value FROM texts
           UNION ALL SELECT CASE WHEN substr(md5('split:' || tweet_id), 1, 1) < 'd' THEN 'train' ELSE 'valid' END, 'label', tweet_id, label FROM class_labels"""
    )
    q["a3_csv_roundtrip"] = _with("SELECT tweet_id, tweet, prefix, input_text, target_text FROM prepared_spans")
    q["a3_parquet_roundtrip"] = q["a3_csv_roundtrip"]
    # A CSV round trip reads an empty field as null (as the pandas reader does).
    q["a4_read_runs"] = _with("SELECT run, tweet_id, NULLIF(predicted_text, '') AS predicted_text FROM span_runs")
    q["a6_load_ensemble"] = q["d2_attach_text"]
    q["a7_prompt_folders"] = (
        _with(
            f"SELECT tweet_id, NULLIF(replace(input_tpl, '{{}}', input_text), '') AS input_text, NULLIF(CASE WHEN target_text = 'none' THEN neg_tpl "
            f"ELSE replace(pos_tpl, '{{}}', target_text) END, '') AS target_text FROM prepared_spans, {_prompt_values()} WHERE pt.prompt = 'prompt2'"
        )
    )
    q["a8_write_submission"] = q["b14_submission_spans"]
    q["f1_ordered_votes"] = _with(
        "SELECT tweet_id, predicted_text, counts, row_number() OVER (ORDER BY tweet_id) - 1 AS position FROM class_vote"
    )
    q["a9_ordered_metrics"] = f"SELECT metric, value, row_number() OVER (ORDER BY metric) - 1 AS position FROM ({q['a9_metrics_long']})"
    q["a5_run_names"] = _with(
        """SELECT run, CASE WHEN starts_with(run, 'assert') THEN 'classification' ELSE 'detection' END AS task,
                  CASE WHEN starts_with(run, 'ner') THEN replace(run, 'ner_', '') WHEN starts_with(run, 'assert') THEN replace(run, 'assert_', '') ELSE run END AS model,
                  count(*) AS n FROM (SELECT run FROM class_runs UNION ALL SELECT run FROM span_runs) GROUP BY run"""
    )
    return q


def _model_queries(q: dict) -> None:
    ws = _q(T.WHITESPACE_RUN)
    mi = "prefix || ': ' || input_text"
    words = lambda e: f"string_split(trim(regexp_replace({e}, {ws}, ' ', 'g')), ' ')"
    vocab = f"""
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY md5(token), token) + 2 AS INTEGER) AS id FROM (
  SELECT DISTINCT token FROM (SELECT unnest({words('input_text')}) AS token FROM prepared_class) WHERE token <> '')),
toks AS (SELECT tweet_id, 0 AS side, unnest(list_transform({words(mi)}[1:129], lambda t, i: {{'pos': i, 'token': t}})) AS x FROM prepared_class
         UNION ALL SELECT tweet_id, 1, unnest(list_transform({words('target_text')}[1:129], lambda t, i: {{'pos': i, 'token': t}})) FROM prepared_class),
looked AS (SELECT tweet_id, side, x.pos AS pos, coalesce(v.id, 2) AS id FROM toks LEFT JOIN vocab v ON v.token = x.token),
grouped AS (SELECT tweet_id, list(id ORDER BY pos) FILTER (WHERE side = 0) AS s, list(id ORDER BY pos) FILTER (WHERE side = 1) AS t FROM looked GROUP BY tweet_id)"""
    pad = lambda arr, v: f"list_concat({arr}, [1], list_transform(range(0, 130 - len({arr}) - 1), lambda z: {v}))"
    q["b16_encode_fixed"] = _with(
        f"""SELECT tweet_id, {pad('s', 0)} AS input_ids,
                   list_concat(list_transform(range(0, len(s) + 1), lambda z: 1), list_transform(range(0, 130 - len(s) - 1), lambda z: 0)) AS attention_mask,
                   {pad('t', -100)} AS labels FROM grouped""",
        vocab,
    )
    q["l1_predict_batches"] = _with(
        f"SELECT tweet_id, CASE WHEN substr(md5({mi}), 1, 1) IN ('0','1','2','3') THEN {_q(T.POSITIVE_CLASS_TEXT)} ELSE {_q(T.NEGATIVE_CLASS_TEXT)} END AS predicted_text FROM prepared_class"
    )
    q["l1_predict_k"] = _with(
        f"""SELECT tweet_id, CAST(nth AS INTEGER) AS nth, CASE WHEN nth = 1 THEN CAST(length({mi}) AS VARCHAR)
                   WHEN substr(md5({mi}), 1, 1) IN ('0','1','2','3') THEN {_q(T.POSITIVE_CLASS_TEXT)} ELSE {_q(T.NEGATIVE_CLASS_TEXT)} END AS predicted_text
            FROM prepared_class, (SELECT unnest([0, 1]) AS nth)"""
    )
    p2 = next(p for p in PR.PROMPTS if p["prompt"] == "prompt2")
    marker = _q(p2["marker"])
    unwrap = lambda e: f"CASE WHEN contains({e}, {marker}) THEN trim(replace({e}, {marker}, ''), '.') ELSE 'none' END"
    at = "(('0x' || substr(md5(mi), 2, 8))::BIGINT % greatest(len(w) - 2, 1))"
    l3 = f"""
l3_in AS (SELECT tweet_id, {_q(T.SPAN_PREFIX)} || ': ' || replace({_q(p2['input_tpl'])}, '{{}}', input_text) AS mi, string_split(input_text, ' ') AS w,
                 CASE WHEN target_text = 'none' THEN {_q(p2['neg_tpl'])} ELSE replace({_q(p2['pos_tpl'])}, '{{}}', target_text) END AS target_text
          FROM prepared_spans),
l3_pred AS (SELECT tweet_id, target_text, CASE WHEN substr(md5(mi), 1, 1) IN ('0','1','2','3','4','5','6','7')
                 THEN replace({_q(p2['pos_tpl'])}, '{{}}', array_to_string(w[{at} + 1:{at} + 3], ' ')) ELSE {_q(p2['neg_tpl'])} END AS predicted_text FROM l3_in),
l3_table AS (SELECT tweet_id, target_text, {unwrap('target_text')} AS gold_labels, {unwrap('predicted_text')} AS pred_labels FROM l3_pred)"""
    q["l3_predictions"] = _with("SELECT tweet_id, target_text, pred_labels AS predicted_text FROM l3_table", l3)
    q["l3_evaluate_class"] = (
        "WITH " + views() + f", lc AS (SELECT target_text, CASE WHEN substr(md5({mi}), 1, 1) IN ('0','1','2','3') THEN {_q(T.POSITIVE_CLASS_TEXT)} ELSE {_q(T.NEGATIVE_CLASS_TEXT)} END AS pred FROM prepared_class),"
        + _report_sql("lc", "target_text", "pred")
    )
    q["l3_evaluate_run"] = _with("SELECT * FROM scores", l3 + "," + _eval_spans_sql("tweet_id", "l3_table") + "," + _scores_sql(""))


def h9_sql(
    last: str = "SELECT text FROM first0 UNION SELECT text FROM first1", tries: int = 10, min_words: int = 10, max_words: int = 25
) -> str:
    """H9 replayed: ranges of draws per state and next word, walks as a recursive CTE per round."""
    ws = _q(T.WHITESPACE_RUN)
    b, e = "'___BEGIN__'", "'___END__'"
    n = "(SELECT n FROM h9_n)"

    def walk(name: str, rnd: int, sents: str) -> str:
        draw = f"(('0x' || substr(md5('25:walk:{rnd}:' || CAST(w.sent AS VARCHAR) || ':' || CAST(w.try AS VARCHAR) || ':' || CAST(w.step AS VARCHAR)), 1, 15))::BIGINT % t.tot)"
        nxt = f"coalesce(o.nxt, {e})"
        new_words = f"CASE WHEN {nxt} = {e} THEN w.words ELSE list_append(w.words, o.nxt) END"
        return f"""
{name}(sent, try, step, words, state, done) AS (
  SELECT s.sent, tr.try, 0, []::VARCHAR[], {b} || ' ' || {b}, false FROM ({sents}) s, (SELECT unnest(range(0, {tries})) AS try) tr
  UNION ALL
  SELECT w.sent, w.try, w.step + 1, {new_words},
         array_to_string(list_append(string_split(w.state, ' '), {nxt})[2:3], ' '),
         {nxt} = {e} OR len({new_words}) > {max_words}
  FROM {name} w JOIN h9_tot t ON t.state = w.state LEFT JOIN h9_cum o ON o.state = w.state AND o.lo <= {draw} AND {draw} < o.hi
  WHERE NOT w.done AND w.step <= {max_words})"""

    def firsts(name: str) -> str:
        return f"""(SELECT sent, arg_min(text, try) AS text FROM (
              SELECT sent, try, array_to_string(words, ' ') AS text FROM {name}
              WHERE done AND len(words) BETWEEN {min_words} AND {max_words}) x
            WHERE text NOT IN (SELECT known FROM h9_known) GROUP BY sent)"""

    return f"""WITH RECURSIVE {views()},
h9_pos AS (SELECT input_text FROM prepared_class WHERE target_text = {_q(T.POSITIVE_CLASS_TEXT)}),
h9_sent AS (SELECT w FROM (SELECT string_split(trim(regexp_replace(l, {ws}, ' ', 'g')), ' ') AS w
                           FROM (SELECT unnest(string_split({SENTENCES}, chr(10))) AS l FROM h9_pos)) WHERE w[1] <> ''),
h9_p AS (SELECT [{b}, {b}] || w || [{e}] AS p FROM h9_sent),
h9_occ0 AS (SELECT array_to_string(p[k - 2:k - 1], ' ') AS state, p[k] AS nxt
            FROM (SELECT p, unnest(range(3, len(p) + 1)) AS k FROM h9_p)),
h9_cnt AS (SELECT state, nxt, count(*) AS c FROM h9_occ0 GROUP BY state, nxt),
h9_cum AS (SELECT state, nxt, CAST(sum(c) OVER (PARTITION BY state ORDER BY nxt) AS BIGINT) - c AS lo, CAST(sum(c) OVER (PARTITION BY state ORDER BY nxt) AS BIGINT) AS hi FROM h9_cnt),
h9_tot AS (SELECT state, CAST(sum(c) AS BIGINT) AS tot FROM h9_cnt GROUP BY state),
h9_known AS (SELECT DISTINCT array_to_string(w, ' ') AS known FROM h9_sent),
h9_n AS (SELECT greatest(0, (SELECT count(*) FROM prepared_class) // 5 - (SELECT count(*) FROM h9_pos)) AS n),
{walk("walk0", 0, f"SELECT unnest(range(0, {n})) AS sent")},
first0 AS {firsts("walk0")},
have0 AS (SELECT count(DISTINCT text) AS have FROM first0),
{walk("walk1", 1, f"SELECT unnest(range({n}, {n} + {n} - (SELECT have FROM have0))) AS sent WHERE (SELECT have FROM have0) BETWEEN 1 AND {n} - 1")},
first1 AS {firsts("walk1")}
{last}"""


def m1_sql(patience: int = 3, delta: float = 0.0) -> str:
    """M1 as a recursive CTE: one evaluation per recursion step and run."""
    b0 = "CASE WHEN r.best IS NULL OR r.best = 0 THEN e.v ELSE r.best END"
    bs0 = "CASE WHEN r.best IS NULL OR r.best = 0 THEN e.step ELSE r.best_step END"
    imp = f"(CASE WHEN ({b0}) <> 0 THEN e.v - ({b0}) < {delta}::DOUBLE ELSE e.v - ({b0}) > {delta}::DOUBLE END)"
    counts = "(NOT e.e)"
    return f"""WITH RECURSIVE {views()},
plog AS (SELECT 'run_' || CAST(user_id AS VARCHAR) AS run, ts, event_id, CAST(value AS DOUBLE) AS v, coalesce(event_type = 'view', false) AS e
         FROM events WHERE user_id IS NOT NULL),
ev AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS step, v, e FROM plog),
rec(run, step, best, best_step, cnt, stop) AS (
  SELECT DISTINCT run, 0::BIGINT, NULL::DOUBLE, NULL::BIGINT, 0::BIGINT, NULL::BIGINT FROM ev
  UNION ALL
  SELECT r.run, e.step,
         CASE WHEN {imp} THEN e.v ELSE {b0} END,
         CASE WHEN {imp} THEN e.step ELSE {bs0} END,
         CASE WHEN {imp} THEN 0 WHEN {counts} AND r.cnt < {patience} THEN r.cnt + 1 ELSE r.cnt END,
         CASE WHEN NOT {imp} AND {counts} AND r.cnt >= {patience} THEN e.step END
  FROM rec r JOIN ev e ON e.run = r.run AND e.step = r.step + 1
  WHERE r.stop IS NULL)
SELECT run, step AS n_evals, best_step, best AS best_value, stop AS stop_step
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM rec WHERE step > 0) WHERE rn = 1"""


def _key(*parts: str) -> str:
    """md5 of '25' and the parts joined by ':' (parts are SQL expressions)."""
    return "md5('25' || " + " || ".join(f"':' || {p}" for p in parts) + ")"


def _draw(key: str, n: str) -> str:
    return f"(('0x' || substr({key}, 1, 15))::BIGINT % ({n}))"


def _unit(key: str) -> str:
    return f"(('0x' || substr({key}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _augment_queries(q: dict) -> None:
    ws = _q(T.WHITESPACE_RUN)
    words = f"string_split(trim(regexp_replace(input_text, {ws}, ' ', 'g')), ' ')"
    syn = f"""
syn_words AS (SELECT unnest({words}) AS word FROM prepared_class),
syn_rank AS (SELECT word, row_number() OVER (ORDER BY md5(word), word) AS r FROM (SELECT DISTINCT word FROM syn_words WHERE word <> '')),
syn_pairs AS (SELECT word, r, CASE WHEN r % 2 = 1 THEN r + 1 ELSE r - 1 END AS pr FROM syn_rank
              UNION ALL SELECT word, r, r % (SELECT count(*) FROM syn_rank) + 1 FROM syn_rank),
synonyms AS (SELECT DISTINCT a.word, CASE WHEN a.r % 3 = 0 THEN 'v' ELSE 'n' END AS pos, b.word AS synonym
             FROM syn_pairs a JOIN syn_rank b ON b.r = a.pr WHERE a.word <> b.word),
pos_rows AS (SELECT tweet_id, input_text, {words} AS w FROM prepared_class WHERE target_text = {_q(T.POSITIVE_CLASS_TEXT)})"""
    q["h0_synonym_table"] = _with("SELECT * FROM synonyms", syn)

    def choices(tag: str, pos: str | None = None) -> str:
        cond = f"WHERE s.pos = {_q(pos)}" if pos else ""
        return f"""
ch_{tag}_w AS (SELECT DISTINCT tweet_id, unnest(w) AS word FROM pos_rows),
ch_{tag}_s AS (SELECT DISTINCT s.word, s.synonym FROM synonyms s {cond}),
ch_{tag} AS (SELECT d.tweet_id, d.word, arg_min(s.synonym, {_key('d.tweet_id', _q(tag), 'd.word', 's.synonym').replace("'25' || ':' || d.tweet_id || ':' || " + _q(tag), "'25' || ':' || " + _q(tag) + " || ':' || d.tweet_id")}) AS synonym
             FROM ch_{tag}_w d JOIN ch_{tag}_s s USING (word) GROUP BY ALL)"""

    # H1: one word per text (lowest pick hash) replaced everywhere.
    q["h1_synonym_replace"] = _with(
        f"""SELECT p.tweet_id, array_to_string(CASE WHEN c.word IS NULL THEN p.w ELSE list_transform(p.w, lambda t: CASE WHEN t = c.word THEN c.synonym ELSE t END) END, ' ') AS augmented
            FROM pos_rows p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY {_key(_q('sr-pick'), 'tweet_id', 'word')}, word) AS rn FROM ch_sr) WHERE rn = 1) c USING (tweet_id)""",
        syn + "," + choices("sr"),
    )
    kept = f"list_filter(w, lambda t, i: {_unit(_key(_q('rd'), 'tweet_id', 'CAST(i - 1 AS VARCHAR)'))} >= 0.2::DOUBLE)"
    keep_one = f"[w[{_draw(_key(_q('rd-keep'), 'tweet_id'), 'len(w)')} + 1]]"
    q["h2_random_delete"] = _with(
        f"SELECT tweet_id, array_to_string(CASE WHEN len(w) <= 1 THEN w WHEN len({kept}) = 0 THEN {keep_one} ELSE {kept} END, ' ') AS augmented FROM pos_rows",
        syn,
    )
    i = _draw(_key(_q("rs-a"), "tweet_id"), "len(w)")
    j = f"(({i} + 1 + {_draw(_key(_q('rs-b'), 'tweet_id'), 'greatest(len(w) - 1, 1)')}) % len(w))"
    q["h3_random_swap"] = _with(
        f"""SELECT tweet_id, array_to_string(CASE WHEN len(w) <= 1 THEN w ELSE list_transform(w, lambda t, k: CASE WHEN k - 1 = si THEN w[sj + 1] WHEN k - 1 = sj THEN w[si + 1] ELSE t END) END, ' ') AS augmented
            FROM (SELECT *, {i} AS si, {j} AS sj FROM pos_rows WHERE len(w) > 1 UNION ALL SELECT *, 0, 0 FROM pos_rows WHERE len(w) <= 1)""",
        syn,
    )
    at = f"CAST({_draw(_key(_q('ri-pos'), 'tweet_id'), 'len(w) + 1')} + 1 AS BIGINT)"
    q["h4_random_insert"] = _with(
        f"""SELECT p.tweet_id, array_to_string(CASE WHEN c.synonym IS NULL THEN p.w ELSE list_concat(p.w[1:{at.replace('tweet_id', 'p.tweet_id').replace('len(w)', 'len(p.w)')} - 1], [c.synonym], p.w[{at.replace('tweet_id', 'p.tweet_id').replace('len(w)', 'len(p.w)')}:]) END, ' ') AS augmented
            FROM pos_rows p LEFT JOIN (SELECT tweet_id, arg_min(synonym, ({_key(_q('ri-pick'), 'tweet_id', 'word')}, word)) AS synonym FROM ch_ri GROUP BY tweet_id) c USING (tweet_id)""",
        syn + "," + choices("ri"),
    )
    q["h5_lexical_replace"] = _with(
        f"""SELECT p.tweet_id, array_to_string(list_transform(p.w, lambda t, i: CASE WHEN {_unit(_key(_q('wn'), 'p.tweet_id', 'CAST(i - 1 AS VARCHAR)'))} < 0.5::DOUBLE
                   AND len(list_filter(coalesce(c.m, []), lambda e: e.word = t)) > 0 THEN list_filter(c.m, lambda e: e.word = t)[1].synonym ELSE t END), ' ') AS augmented
            FROM pos_rows p LEFT JOIN (SELECT tweet_id, list({{'word': word, 'synonym': synonym}}) AS m FROM ch_wn GROUP BY tweet_id) c USING (tweet_id)""",
        syn + "," + choices("wn", "v"),
    )
    q["d5_drop_known"] = _with(
        f"""SELECT tweet_id, augmented AS input_text FROM (
              SELECT tweet_id, CASE WHEN substr(md5('keep:' || tweet_id), 1, 1) < '8' THEN input_text ELSE
                array_to_string(CASE WHEN len(w) <= 1 THEN w WHEN len({kept}) = 0 THEN {keep_one} ELSE {kept} END, ' ') END AS augmented FROM pos_rows)
            WHERE augmented NOT IN (SELECT input_text FROM pos_rows WHERE input_text IS NOT NULL)""",
        syn,
    )
    q["f3_last_k"] = _with(
        """SELECT tweet_id FROM (SELECT tweet_id, row_number() OVER (ORDER BY md5('25:' || tweet_id) DESC, tweet_id) AS rn,
                  count(*) OVER () AS n FROM pos_rows) WHERE rn <= n // 2""",
        syn,
    )
    def rd(rid: str) -> str:
        k = f"list_filter(w, lambda t, i: {_unit(_key(_q('rd'), rid, 'CAST(i - 1 AS VARCHAR)'))} >= 0.2::DOUBLE)"
        one = f"[w[{_draw(_key(_q('rd-keep'), rid), 'len(w)')} + 1]]"
        return f"array_to_string(CASE WHEN len(w) <= 1 THEN w WHEN len({k}) = 0 THEN {one} ELSE {k} END, ' ')"

    quota = f"""
q_stats AS (SELECT (SELECT count(*) FROM pos_rows) AS size,
                   greatest(0, (SELECT count(*) FROM prepared_class) // 5
                               - (SELECT count(*) FROM prepared_class WHERE target_text = {_q(T.POSITIVE_CLASS_TEXT)})) AS n),
q_plan AS (SELECT size, n, CASE WHEN n <= 0 OR size <= 0 THEN 0 ELSE (n - 1) // size END AS nfull FROM q_stats),
q_plan2 AS (SELECT size, n, nfull, CASE WHEN n <= 0 OR size <= 0 THEN 0 WHEN n - nfull * size = size THEN 0 ELSE n - nfull * size END AS rem FROM q_plan)"""
    h6 = f"""{quota},
h6_ranked AS (SELECT *, row_number() OVER (ORDER BY md5('25:' || tweet_id), tweet_id) AS rn_asc,
                        row_number() OVER (ORDER BY md5('25:' || tweet_id) DESC, tweet_id) AS rn_desc FROM pos_rows),
h6_in AS (SELECT r.tweet_id, r.w, g.rnd FROM h6_ranked r, (SELECT unnest(range(0, (SELECT nfull FROM q_plan2))) AS rnd) g
          UNION ALL SELECT r.tweet_id, r.w, p.nfull FROM h6_ranked r, q_plan2 p WHERE r.rn_asc <= p.rem),
h6_aug AS (SELECT DISTINCT {rd("(tweet_id || '#' || CAST(rnd AS VARCHAR))")} AS augmented FROM h6_in),
h6_have AS (SELECT count(*) AS have FROM h6_aug),
h6_top AS (SELECT DISTINCT {rd("(r.tweet_id || '#' || CAST(p.nfull + 1 AS VARCHAR))")} AS augmented
           FROM h6_ranked r, q_plan2 p, h6_have h WHERE h.have < p.n AND r.rn_desc <= least(p.n - h.have, p.size))"""
    q["h6_augment_to"] = _with("SELECT augmented FROM h6_aug UNION SELECT augmented FROM h6_top", syn + "," + h6)
    def edited(kind: str, src: str, out: str) -> str:
        """``out(rid, augmented)``: one edit of kind ``kind`` of each row of ``src(rid, w)``."""
        tag = {"sr": "sr", "ri": "ri", "Wordnet": "wn"}[kind]
        lex = "WHERE pos = 'v'" if kind == "Wordnet" else ""
        ch = f"""
{out}_ch AS (SELECT d.rid, d.word, arg_min(s.synonym, {_key(_q(tag), 'd.rid', 'd.word', 's.synonym')}) AS synonym
             FROM (SELECT DISTINCT rid, unnest(w) AS word FROM {src}) d JOIN (SELECT DISTINCT word, synonym FROM synonyms {lex}) s USING (word) GROUP BY ALL)"""
        if kind == "sr":
            body = f"""SELECT p.rid, array_to_string(list_transform(p.w, lambda t: CASE WHEN t = c.word THEN c.synonym ELSE t END), ' ') AS augmented
  FROM {src} p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY {_key(_q('sr-pick'), 'rid', 'word')}, word) AS rn FROM {out}_ch) WHERE rn = 1) c USING (rid)"""
        elif kind == "ri":
            at = f"CAST({_draw(_key(_q('ri-pos'), 'p.rid'), 'len(p.w) + 1')} + 1 AS BIGINT)"
            body = f"""SELECT p.rid, array_to_string(CASE WHEN c.synonym IS NULL THEN p.w ELSE list_concat(p.w[1:{at} - 1], [c.synonym], p.w[{at}:]) END, ' ') AS augmented
  FROM {src} p LEFT JOIN (SELECT rid, arg_min(synonym, ({_key(_q('ri-pick'), 'rid', 'word')}, word)) AS synonym FROM {out}_ch GROUP BY rid) c USING (rid)"""
        else:
            body = f"""SELECT p.rid, array_to_string(list_transform(p.w, lambda t, i: CASE WHEN {_unit(_key(_q('wn'), 'p.rid', 'CAST(i - 1 AS VARCHAR)'))} < 0.5::DOUBLE
                   AND len(list_filter(coalesce(c.m, []), lambda e: e.word = t)) > 0 THEN list_filter(c.m, lambda e: e.word = t)[1].synonym ELSE t END), ' ') AS augmented
  FROM {src} p LEFT JOIN (SELECT rid, list({{'word': word, 'synonym': synonym}}) AS m FROM {out}_ch GROUP BY rid) c USING (rid)"""
        return f"{ch},\n{out} AS ({body})"

    for kind, name in (("sr", "sr"), ("ri", "ri"), ("Wordnet", "wordnet")):
        ctes = f"""{quota},
h6_ranked AS (SELECT *, row_number() OVER (ORDER BY md5('25:' || tweet_id), tweet_id) AS rn_asc,
                        row_number() OVER (ORDER BY md5('25:' || tweet_id) DESC, tweet_id) AS rn_desc FROM pos_rows),
h6_in AS (SELECT r.tweet_id || '#' || CAST(g.rnd AS VARCHAR) AS rid, r.w FROM h6_ranked r, (SELECT unnest(range(0, (SELECT nfull FROM q_plan2))) AS rnd) g
          UNION ALL SELECT r.tweet_id || '#' || CAST(p.nfull AS VARCHAR), r.w FROM h6_ranked r, q_plan2 p WHERE r.rn_asc <= p.rem),
{edited(kind, 'h6_in', 'h6_loop')},
h6_have AS (SELECT count(DISTINCT augmented) AS have FROM h6_loop),
h6_last AS (SELECT r.tweet_id || '#' || CAST(p.nfull + 1 AS VARCHAR) AS rid, r.w
            FROM h6_ranked r, q_plan2 p, h6_have h WHERE h.have < p.n AND r.rn_desc <= least(p.n - h.have, p.size)),
{edited(kind, 'h6_last', 'h6_top')},
h6_all AS (SELECT augmented FROM h6_loop UNION SELECT augmented FROM h6_top)"""
        q[f"h6_augment_to_{name}"] = _with("SELECT augmented FROM h6_all", syn + "," + ctes)
        q[f"h7_append_{name}"] = _with(_appended_sql(kind, "h6_all"), syn + "," + ctes)
    q["h7_append_markov"] = h9_sql(_appended_sql("markov", "(SELECT text AS augmented FROM first0 UNION SELECT text FROM first1)"))
    h10 = f"""{quota},
h10_pos AS (SELECT tweet_id, input_text, lower(input_text) AS lt, lower(target_text) AS ls FROM prepared_spans WHERE target_text IS DISTINCT FROM 'none'),
h10_m AS (SELECT tweet_id, ls AS span, CASE WHEN ls = '' THEN lt ELSE replace(lt, ls, '@@span@@') END AS masked, r.rnd
          FROM h10_pos, (SELECT unnest(range(0, 12)) AS rnd) r),
h10_w AS (SELECT *, tweet_id || '#' || CAST(rnd AS VARCHAR) AS rid, string_split(trim(regexp_replace(masked, {ws}, ' ', 'g')), ' ') AS w FROM h10_m),
h10_cw AS (SELECT DISTINCT rid, unnest(w) AS word FROM h10_w),
h10_s AS (SELECT DISTINCT word, synonym FROM synonyms WHERE pos = 'v'),
h10_ch AS (SELECT d.rid, d.word, arg_min(s.synonym, {_key(_q('wn'), 'd.rid', 'd.word', 's.synonym')}) AS synonym FROM h10_cw d JOIN h10_s s USING (word) GROUP BY ALL),
h10_new AS (SELECT w0.*, array_to_string(list_transform(w0.w, lambda t, i: CASE WHEN {_unit(_key(_q('wn'), 'w0.rid', 'CAST(i - 1 AS VARCHAR)'))} < 0.5::DOUBLE
                   AND len(list_filter(coalesce(c.m, []), lambda e: e.word = t)) > 0 THEN list_filter(c.m, lambda e: e.word = t)[1].synonym ELSE t END), ' ') AS new
            FROM h10_w w0 LEFT JOIN (SELECT rid, list({{'word': word, 'synonym': synonym}}) AS m FROM h10_ch GROUP BY rid) c USING (rid)),
h10_ok AS (SELECT tweet_id, rnd, span, replace(new, '@@span@@', span) AS text FROM h10_new WHERE trim(masked) <> trim(new)),
h10_ok2 AS (SELECT * FROM h10_ok WHERE text NOT IN (SELECT input_text FROM h10_pos WHERE input_text IS NOT NULL)),
h10_rank AS (SELECT *, row_number() OVER (ORDER BY rnd, md5('25:' || tweet_id), tweet_id) - 1 AS i FROM h10_ok2)"""
    q["h10_augment_spans"] = _with(
        "SELECT tweet_id, tweet, prefix, input_text, target_text FROM prepared_spans UNION ALL "
        f"SELECT 'wnet_augmented_' || CAST(i AS VARCHAR) AS tweet_id, text AS tweet, {_q(T.SPAN_PREFIX)}, text AS input_text, span AS target_text "
        "FROM h10_rank WHERE i < (SELECT n FROM q_plan2)",
        syn + "," + h10,
    )
    q["h7_append_augmented"] = _with(
        f"""SELECT tweet_id, tweet, prefix, input_text, target_text FROM prepared_class
            UNION ALL SELECT 'rd_augmented_' || CAST(row_number() OVER (ORDER BY md5('25:' || augmented), augmented) - 1 AS VARCHAR), augmented,
                   {_q(T.CLASS_PREFIX)}, augmented, {_q(T.POSITIVE_CLASS_TEXT)}
            FROM (SELECT DISTINCT array_to_string(CASE WHEN len(w) <= 1 THEN w WHEN len({kept}) = 0 THEN {keep_one} ELSE {kept} END, ' ') AS augmented FROM pos_rows)""",
        syn,
    )
    lines = f"string_split(trim(regexp_replace(l, {ws}, ' ', 'g')), ' ')"
    q["h8_markov_table"] = _with(
        f"""SELECT state, nxt AS next, count(*) AS count FROM (
              SELECT array_to_string(p[k - 2:k - 1], ' ') AS state, p[k] AS nxt FROM (
                SELECT p, unnest(range(3, len(p) + 1)) AS k FROM (
                  SELECT ['___BEGIN__', '___BEGIN__'] || lw || ['___END__'] AS p FROM (
                    SELECT {lines} AS lw FROM (SELECT unnest(string_split({SENTENCES}, chr(10))) AS l FROM pos_rows)) WHERE lw[1] <> '')))
            GROUP BY ALL""",
        syn,
    )


def _appended_sql(kind: str, src: str) -> str:
    """H7: the class corpus and the rows of ``src(augmented)`` numbered in md5 order."""
    return f"""SELECT tweet_id, tweet, prefix, input_text, target_text FROM prepared_class
            UNION ALL SELECT '{kind}_augmented_' || CAST(row_number() OVER (ORDER BY md5('25:' || augmented), augmented) - 1 AS VARCHAR), augmented,
                   {_q(T.CLASS_PREFIX)}, augmented, {_q(T.POSITIVE_CLASS_TEXT)} FROM {src}"""


def _over_sql(src: str, label: str, out: str, seed: int = 25) -> str:
    """Oversampling of ``src(tweet_id, <label>)`` → ``out(tweet_id, <label>, draw)``."""
    return f"""
{out}_sizes AS (SELECT {label}, count(*) AS n FROM {src} GROUP BY 1),
{out}_need AS (SELECT {label}, n, (SELECT max(n) FROM {out}_sizes) - n AS d FROM {out}_sizes),
{out}_draws AS (SELECT {label}, n, unnest(range(0, d)) AS draw FROM {out}_need WHERE d > 0),
{out}_d2 AS (SELECT {label}, draw, ('0x' || substr(md5('{seed}:draw:' || {label} || ':' || CAST(draw AS VARCHAR)), 1, 15))::BIGINT % n AS idx FROM {out}_draws),
{out}_idx AS (SELECT tweet_id, {label}, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || tweet_id), tweet_id) - 1 AS idx FROM {src}),
{out} AS (SELECT tweet_id, {label}, NULL::BIGINT AS draw FROM {src}
          UNION ALL SELECT i.tweet_id, i.{label}, d.draw FROM {out}_idx i JOIN {out}_d2 d USING ({label}, idx))"""


def _under_sql(src: str, label: str, out: str, seed: int = 25) -> str:
    """Undersampling of ``src(tweet_id, <label>, draw)`` → ``out`` (same columns)."""
    return f"""
{out}_k AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM {src} GROUP BY {label})),
{out} AS (SELECT tweet_id, {label}, draw FROM (
    SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:under:' || tweet_id || ':' || coalesce(CAST(draw AS VARCHAR), '-1')), tweet_id, draw) AS rn
    FROM {src}) WHERE rn <= (SELECT k FROM {out}_k))"""


def _balance_queries(q: dict) -> None:
    q["g1_split_exact"] = _with(
        "SELECT tweet_id, CASE WHEN row_number() OVER (ORDER BY md5('25:' || tweet_id), tweet_id) <= "
        "(SELECT ceil(0.2::DOUBLE * count(*)) FROM prepared_class) THEN 'val' ELSE 'train' END AS split FROM prepared_class"
    )
    lab = "lab AS (SELECT tweet_id, CASE WHEN target_text IS DISTINCT FROM 'none' THEN 'ade' ELSE 'none' END AS label FROM prepared_spans)"
    q["f2_first_half"] = _with(
        "SELECT tweet_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('25:' || tweet_id), tweet_id) "
        "<= (count(*) OVER (PARTITION BY label)) // 2 AS _first FROM lab",
        lab,
    )
    q["w3_dense_index"] = _with(
        "SELECT tweet_id, target_text, row_number() OVER (PARTITION BY target_text ORDER BY md5('25:' || tweet_id), tweet_id) - 1 AS idx FROM prepared_class"
    )
    pc = "pc AS (SELECT tweet_id, target_text FROM prepared_class)"
    q["g2_oversample"] = _with("SELECT * FROM over1", pc + "," + _over_sql("pc", "target_text", "over1"))
    pcd = "pcd AS (SELECT tweet_id, target_text, NULL::BIGINT AS draw FROM prepared_class)"
    q["g3_undersample"] = _with("SELECT tweet_id, target_text FROM under1", pcd + "," + _under_sql("pcd", "target_text", "under1"))
    two = (
        lab
        + """,
neg_r AS (SELECT *, row_number() OVER (ORDER BY md5('25:' || tweet_id), tweet_id) AS rn, count(*) OVER () AS nn FROM lab WHERE label = 'none'),
stage1 AS (SELECT tweet_id, label FROM lab WHERE label IS DISTINCT FROM 'none' UNION ALL SELECT tweet_id, label FROM neg_r WHERE rn <= nn // 2),"""
        + _over_sql("stage1", "label", "over2")
        + """,
stage2 AS (SELECT * FROM over2 UNION ALL SELECT tweet_id, label, NULL::BIGINT FROM neg_r WHERE rn > nn // 2),"""
        + _under_sql("stage2", "label", "bal")
    )
    q["g4_balance_two_stage"] = _with("SELECT * FROM bal", two)
    lab_class = "lab AS (SELECT tweet_id, target_text AS label FROM prepared_class)"
    two_class = two.replace(lab, lab_class, 1).replace("label = 'none'", f"label = {_q(T.NEGATIVE_CLASS_TEXT)}").replace(
        "label IS DISTINCT FROM 'none'", f"label IS DISTINCT FROM {_q(T.NEGATIVE_CLASS_TEXT)}"
    )
    q["g4_balance_class"] = _with("SELECT * FROM bal", two_class)
    q["g4_balanced_sizes"] = _with("SELECT label, count(*) AS n FROM bal GROUP BY 1", two)
