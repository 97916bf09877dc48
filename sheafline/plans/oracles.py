"""Independent DuckDB SQL for the queries in ``queries.py``."""

from __future__ import annotations

from sheafline.plans.catalogue import DEFAULT_MODELS, PROMPTS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rnd(x: str, digits: int) -> str:
    """Rounding of the binary value, ties to even (two-product with Dekker's split)."""
    s = f"{10**digits}e0"
    hi = f"((({x})*134217729e0)-((({x})*134217729e0)-({x})))"
    lo = f"(({x})-{hi})"
    p = f"(({x})*{s})"
    e = f"(({hi}*{s}-{p})+{lo}*{s})"
    f = f"floor({p})"
    r = f"({p}-{f})"
    up = f"({r}>5e-1 OR ({r}=5e-1 AND {e}>0e0) OR ({r}=5e-1 AND {e}=0e0 AND fmod({f},2e0)<>0e0))"
    return f"(({f}+CASE WHEN {up} THEN 1e0 ELSE 0e0 END)/{s})"


KEYS = "keys AS (SELECT d.doc_id, d.source AS sheet, d.lang, l.quality AS label, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
MARK = (
    r"CASE WHEN doc_id % 17 = 0 THEN regexp_replace(text, '^(\S+)(\s+)(\S+)', '<\1>\2<\3>') "
    r"ELSE regexp_replace(text, '^(\S+\s+)(\S+)', '\1<\2>') END"
)
DOCS = f"docs AS (SELECT doc_id, source AS sheet, lang, {MARK} AS text FROM documents)"
NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY doc_id) - 1 AS row_idx FROM {0})"
SHEETS = "sheets AS (SELECT sheet, row_number() OVER (ORDER BY sheet) AS sheet_ord, n FROM (SELECT source AS sheet, count(*) AS n FROM documents GROUP BY 1))"


def reply(flip: int = 5) -> str:
    q = "coalesce(toxic, doc_id % 2)"
    return (
        f"CASE WHEN doc_id % 7 = 0 THEN '0 Error' WHEN doc_id % {flip} = 0 THEN 'answer: ' || (1 - {q}) "
        f"WHEN doc_id % 11 = 0 THEN 'unsure' ELSE {q} || ' …' END"
    )


def parsed(r: str) -> str:
    return f"CAST(coalesce(nullif(regexp_extract({r}, '[01]'), ''), '0') AS INT)"


SCORED = f"{KEYS}, scored AS (SELECT *, {parsed('(' + reply() + ')')} AS ai_label FROM keys)"


def counts(source: str, by: str, label: str = "label", pred: str = "ai_label") -> str:
    known = f"{label} IS NOT NULL AND {pred} IS NOT NULL"
    cells = {
        "n": "true", "lp": f"{label}=1", "ln": f"{label}=0", "pp": f"{pred}=1", "pn": f"{pred}=0",
        "tp": f"{label}=1 AND {pred}=1", "fp": f"{label}=0 AND {pred}=1",
        "tn": f"{label}=0 AND {pred}=0", "fn": f"{label}=1 AND {pred}=0",
    }
    aggs = ", ".join(f"count(*) FILTER (WHERE {known} AND {c}) AS {n}" for n, c in cells.items())
    return f"SELECT {by}, {aggs} FROM {source} GROUP BY {by}"


SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in "n lp ln pp pn tp fp tn fn".split())


def total(source: str, within: str = "") -> str:
    extra, group = (f"{within}, ", f"GROUP BY {within}") if within else ("", "")
    return (
        f"SELECT {extra}sheet, 0 AS is_total, n, lp, ln, pp, pn, tp, fp, tn, fn FROM {source} UNION ALL "
        f"SELECT {extra}'TOTAL', 1, {SUMS} FROM {source} {group}"
    )


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0e0 END)"


def f1(p: str, r: str) -> str:
    return f"(CASE WHEN {p} + {r} > 0 THEN 2e0 * {p} * {r} / ({p} + {r}) ELSE 0e0 END)"


def rates(source: str, digits: int | None = 3, f1_from: str = "exact", denominators: str = "margins") -> str:
    """Adds the four rates, step by step in subqueries to keep the text short."""
    pd, rd = ("pp", "lp") if denominators == "margins" else ("tp + fp", "tp + fn")

    def out(x: str) -> str:
        return x if digits is None else rnd(x, digits)

    raw = f"SELECT *, {div('tp + tn', 'n')} AS a0, {div('tp', pd)} AS p0, {div('tp', rd)} AS r0 FROM ({source})"
    mid = f"SELECT *, {out('a0')} AS accuracy, {out('p0')} AS precision, {out('r0')} AS recall FROM ({raw})"
    p, r = ("precision", "recall") if f1_from == "rounded" else ("p0", "r0")
    top = f"SELECT *, {f1(p, r)} AS f0 FROM ({mid})"
    return f"SELECT * EXCLUDE (a0, p0, r0, f0), {out('f0')} AS f1 FROM ({top})"


REGR = (
    "regr AS (SELECT vec_id, 'c' || (vec_id % 11) AS sheet, label % 2 AS y_true, "
    "CAST(round(0.5 + CAST(embedding[1] AS DOUBLE), 3) AS DECIMAL(9,3)) AS y_pred, "
    "CAST(label % 2 AS DOUBLE) AS y, CAST(CAST(round(0.5 + CAST(embedding[1] AS DOUBLE), 3) AS DECIMAL(9,3)) AS DOUBLE) AS p FROM embeddings)"
)
MSE = "avg((y-p)*(y-p))"
R2 = (
    f"CASE WHEN count(*) < 2 THEN 'NaN'::DOUBLE WHEN min(y) = max(y) THEN (CASE WHEN {MSE} = 0 THEN 1e0 ELSE 0e0 END) "
    f"ELSE 1e0 - {MSE} / var_pop(y) END"
)


def r9(x: str) -> str:
    return f"round({x}, 9)"


def regr_cols(r=r9) -> str:
    return f"{r(MSE)} AS mse, {r('sqrt(' + MSE + ')')} AS rmse, {r('avg(abs(y-p))')} AS mae, {r(R2)} AS r2_score"


def dist_cols(r=r9) -> str:
    return f"{r('avg(p)')} AS pred_mean, {r('stddev_pop(p)')} AS pred_std, {r('min(p)')} AS pred_min, {r('max(p)')} AS pred_max"


REGR_COLS, DIST_COLS = regr_cols(), dist_cols()


def report(group: str, name: str, r9=r9) -> str:
    c = {
        "tp": "count(*) FILTER (WHERE p>=0.5 AND y=1)", "tn": "count(*) FILTER (WHERE p<0.5 AND y=0)",
        "fp": "count(*) FILTER (WHERE p>=0.5 AND y=0)", "fn": "count(*) FILTER (WHERE p<0.5 AND y=1)",
    }
    p, r = div(c["tp"], f"{c['tp']}+{c['fp']}"), div(c["tp"], f"{c['tp']}+{c['fn']}")
    acc = div(f"{c['tp']}+{c['tn']}", "count(*)")
    return (
        f"SELECT {name} AS sheet, count(*) AS n_samples, count(*) FILTER (WHERE y=0) AS n_label_0, "
        f"count(*) FILTER (WHERE y=1) AS n_label_1, {regr_cols(r9)}, {r9(acc)} AS accuracy, {r9(p)} AS precision, "
        f"{r9(r)} AS recall, {r9(f1(p, r))} AS f1_score, {c['tp']} AS true_positives, {c['tn']} AS true_negatives, "
        f"{c['fp']} AS false_positives, {c['fn']} AS false_negatives, {dist_cols(r9)} FROM regr {group}"
    )


def report_total(r=r9) -> str:
    sheets, everything = report("GROUP BY regr.sheet", "regr.sheet", r), report("", "'TOTAL'", r)
    return f"SELECT *, 0 AS is_total FROM ({sheets}) UNION ALL SELECT *, 1 FROM ({everything})"


REPORT_TOTAL = report_total()

STATS = """
SELECT sheet, is_total, rows, positive, negative,
       CASE WHEN positive + negative > 0 THEN CAST(positive AS DOUBLE) / (positive + negative) ELSE 0e0 END AS positive_ratio,
       printf('%.2f%%', 100e0 * CASE WHEN positive + negative > 0 THEN CAST(positive AS DOUBLE) / (positive + negative) ELSE 0e0 END) AS positive_percent
FROM (SELECT coalesce({0}, 'TOTAL') AS sheet, CAST(grouping({0}) AS INT) AS is_total, count(*) AS rows,
             count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative
      FROM keys GROUP BY GROUPING SETS (({0}), ()))
"""

# Labels with every kind of bad value, and the issue of each row.
BROKEN = (
    f"{KEYS}, {SHEETS}, broken AS (SELECT k.* EXCLUDE (label), row_number() OVER (PARTITION BY sheet ORDER BY doc_id) - 1 AS row_idx, "
    "CASE WHEN doc_id % 29 = 0 THEN 2.0 WHEN doc_id % 31 = 0 THEN -1.5 WHEN doc_id % 37 = 0 THEN 0.5 ELSE CAST(label AS DOUBLE) END AS label FROM keys k), "
    "label_issue AS (SELECT *, CASE WHEN label IS NULL THEN 'missing' WHEN trunc(label) NOT IN (0, 1) THEN 'invalid_label' END AS code FROM broken)"
)
STRIPPED = r"regexp_replace(regexp_replace(text, '^[\s\v\x1c-\x1f\x{85}\x{a0}\p{Z}]+', ''), '[\s\v\x1c-\x1f\x{85}\x{a0}\p{Z}]+$', '')"
TEXT_ISSUE = (
    f"{DOCS}, stripped AS (SELECT *, {STRIPPED} AS t FROM docs), "
    "grouped AS (SELECT *, regexp_extract_all(t, '<([^<>]+)>', 1) AS g FROM stripped), "
    "text_issue AS (SELECT *, CASE WHEN text IS NULL THEN 'missing' WHEN t = '' THEN 'empty' WHEN len(g) = 0 THEN 'no_group' "
    "WHEN len(g) > 1 THEN 'multiple_groups' WHEN trim(g[1]) = '' THEN 'blank_group' "
    r"WHEN len(list_filter(regexp_split_to_array(g[1], '\s+'), lambda x: x <> '')) > 5 THEN 'long_group' END AS code, "
    r"len(list_filter(regexp_split_to_array(g[1], '\s+'), lambda x: x <> '')) AS nw FROM grouped)"
)


def where(column: str) -> str:
    return f"'Sheet ''' || sheet || ''', Column ''{column}'', Row ' || (row_idx + 2) || ': '"


SEVERITY = "CASE WHEN code IN ('blank_group', 'long_group') THEN 'warning' ELSE 'error' END"
QUOTED = (
    "'[' || array_to_string(list_transform(g, lambda x: CASE WHEN contains(x, '''') AND NOT contains(x, '\"') THEN '\"' || x || '\"' "
    "ELSE '''' || replace(x, '''', '\\''') || '''' END), ', ') || ']'"
)
TEXT_MESSAGE = (
    f"CASE code WHEN 'missing' THEN 'Missing/null value' WHEN 'empty' THEN 'Empty text value' WHEN 'no_group' THEN 'No angular bracket group found - ''' || CASE WHEN length(t) > 50 THEN substring(t, 1, 50) || '...' ELSE t END || '''' WHEN 'multiple_groups' THEN 'Multiple angular bracket groups found (' || len(g) || '): ' || {QUOTED} WHEN 'blank_group' THEN 'Empty angular bracket group ''<>''' ELSE 'Long angular bracket group (' || nw || ' words) ''<' || trim(g[1]) || '>''' END"
)
# first and text issues of every row, numbered in report order
ALL_ISSUES = (
    f"{BROKEN}, {TEXT_ISSUE}, issues AS ("
    "SELECT 'error' AS severity, sheet, 'label' AS \"column\", row_idx + 2 AS excel_row, code, CASE WHEN code = 'missing' THEN 1 ELSE 2 END AS section FROM label_issue WHERE code IS NOT NULL "
    f"UNION ALL SELECT {SEVERITY}, b.sheet, 'text', b.row_idx + 2, t.code, CASE WHEN t.code = 'missing' THEN 3 ELSE 4 END FROM text_issue t JOIN broken b USING (doc_id) WHERE t.code IS NOT NULL)"
)

# The sheets as files: labels as text, src3 without a label column, src4 without a header.
FILES = (
    f"{TEXT_ISSUE}, {NUMBERED.format('text_issue')}, v AS (SELECT *, CASE WHEN doc_id % 29 = 0 THEN '2' WHEN doc_id % 31 = 0 THEN 'yes' "
    "WHEN doc_id % 37 = 0 THEN NULL ELSE CAST(doc_id % 2 AS VARCHAR) END AS lab FROM numbered WHERE sheet NOT IN ('src3', 'src4')), "
    "found AS (SELECT 'error' AS severity, sheet, row_idx, 'label' AS \"column\", CASE WHEN lab IS NULL THEN 'missing' ELSE 'invalid_label' END AS code, "
    f"CASE WHEN lab IS NULL THEN 1 ELSE 2 END AS section, {where('label')} || CASE WHEN lab IS NULL THEN 'Missing/null value' "
    "ELSE 'Invalid value ''' || lab || ''' (should be 0 or 1)' END AS message FROM v WHERE lab IS NULL OR lab NOT IN ('0', '1') "
    f"UNION ALL SELECT {SEVERITY}, sheet, row_idx, 'text', code, CASE WHEN code = 'missing' THEN 3 ELSE 4 END, {where('text')} || {TEXT_MESSAGE} FROM v WHERE code IS NOT NULL "
    "UNION ALL VALUES ('error', 'src3', NULL, 'label', 'missing_column', 0, 'Sheet ''src3'': Missing required column ''label'''), "
    "('warning', 'src3', NULL, NULL, 'available_columns', 0, 'Sheet ''src3'': Available columns: [''doc_id'', ''text'']'), "
    "('error', 'src4', NULL, NULL, 'unreadable', 0, 'Error reading sheet src4: no header'))"
)

HASH = "md5('42:' || CAST(doc_id AS VARCHAR))"


def balanced(sheet: str) -> str:
    return (
        f"WITH {KEYS}, q AS (SELECT {sheet} AS sheet, least(count(*) FILTER (WHERE label=1), count(*) FILTER (WHERE label=0)) // 2 AS half FROM keys GROUP BY 1), "
        f"r AS (SELECT doc_id, {sheet} AS sheet, label, row_number() OVER (PARTITION BY {sheet}, label ORDER BY {HASH}, doc_id) AS rk FROM keys) "
        "SELECT doc_id, sheet, label, CASE WHEN label IN (0,1) AND rk <= half THEN 'train' WHEN label IN (0,1) AND rk <= 2*half THEN 'test' ELSE 'dropped' END AS split "
        "FROM r JOIN q USING (sheet)"
    )


HELD = (
    f"held AS (SELECT doc_id, sheet, CASE WHEN rk <= CAST(ceil(0.2 * n) AS BIGINT) THEN 'validation' ELSE 'train' END AS split FROM "
    f"(SELECT doc_id, sheet, row_number() OVER (PARTITION BY sheet ORDER BY {HASH}, doc_id) AS rk, count(*) OVER (PARTITION BY sheet) AS n FROM keys))"
)
LEAK = (
    f"{DOCS}, ranked AS (SELECT lang AS sheet, text, row_number() OVER (PARTITION BY lang ORDER BY {HASH}, doc_id) AS rk, count(*) OVER (PARTITION BY lang) AS n FROM docs), "
    "both_sides AS (SELECT sheet, text FROM ranked GROUP BY ALL HAVING bool_or(rk <= CAST(ceil(0.2 * n) AS BIGINT)) AND bool_or(rk > CAST(ceil(0.2 * n) AS BIGINT)))"
)

TOKENS = (
    f"toks AS (SELECT conv_id, turn, role, list_slice(list_transform(list_filter(regexp_split_to_array({lit(PROMPTS[1])} || chr(10) || chr(10) || 'User: Text: ' || text || chr(10) || 'Assistant: ' || (turn % 2), "
    r"'[\s\v\x1c-\x1f\x{85}\x{a0}\p{Z}]+'), lambda x: x <> ''), lambda x: length(x)), 1, 512) AS ids FROM conversations)"
)

RUNS = (
    "runs AS (SELECT o_orderkey, ['openai','gemini','qwen','groq'][o_custkey % 4 + 1] AS provider, "
    "['gpt-5.4','gemini-3.1-flash-lite','Qwen/Qwen2.5-7B-Instruct',''][o_custkey % 4 + 1] AS model, o_custkey % 5 + 1 AS prompt_no, "
    "CASE WHEN o_custkey % 3 = 0 THEN 'base' END AS label, CAST(o_orderkey % 97 + o_orderkey % 13 + 1 AS INT) AS experiment FROM orders), "
    "named AS (SELECT *, 'Result-' || CASE WHEN label IS NOT NULL THEN label || '-' ELSE '' END || provider || '-' || replace(replace(model, '/', '-'), '.', '-') || '-prompt' || prompt_no || '-m5-n50' AS run_id FROM runs)"
)
LEDGER = "led AS (SELECT 'mode' || (o_custkey % 9) AS mode, CAST(o_orderkey AS BIGINT) AS iteration, o_custkey % 4 + 1 AS epochs, 'finetune-' || o_orderkey AS path FROM orders)"

STRIP_EDGE = r"regexp_replace(regexp_replace({0}, '^[\s\v\x1c-\x1f\x{{85}}\x{{a0}}\p{{Z}}]+', ''), '[\s\v\x1c-\x1f\x{{85}}\x{{a0}}\p{{Z}}]+$', '')"


def _weighted() -> str:
    p1, r1 = div("tp", "tp + fp"), div("tp", "tp + fn")
    p0, r0 = div("tn", "tn + fn"), div("tn", "tn + fp")

    def mean(one: str, zero: str) -> str:
        return f"(CASE WHEN tp + fn + tn + fp > 0 THEN ({one} * (tp + fn) + {zero} * (tn + fp)) / CAST(tp + fn + tn + fp AS DOUBLE) ELSE 0e0 END)"

    return (
        f"WITH {SCORED}, c AS ({counts('scored', 'sheet')}), x AS (SELECT *, {p1} AS p1, {r1} AS r1, {p0} AS p0, {r0} AS r0 FROM c) "
        f"SELECT * EXCLUDE (p1, r1, p0, r0), {mean('p1', 'p0')} AS precision, {mean('r1', 'r0')} AS recall, {mean(f1('p1', 'r1'), f1('p0', 'r0'))} AS f1 FROM x"
    )


def _percent() -> str:
    cells = {"true_positives": "tp", "true_negatives": "tn", "false_positives": "fp", "false_negatives": "fn"}
    raw = ", ".join(f"{div(f'{c} * 100', 'tp + tn + fp + fn')} AS _{c}" for c in cells.values())
    shown = ", ".join(f"{rnd('_' + c, 2)} AS {n}" for n, c in cells.items())
    return f"WITH {SCORED}, c AS ({counts('scored', 'sheet')}), x AS (SELECT *, {raw} FROM c) SELECT * EXCLUDE (_tp, _tn, _fp, _fn), {shown} FROM x"


def _fallbacks() -> str:
    c = f"c AS ({counts('scored', 'sheet')}), s AS (SELECT sheet, count(ai_label) AS n_all, CAST(sum(ai_label) AS BIGINT) AS ones FROM scored GROUP BY sheet)"
    cols = []
    for k in "n lp ln pp pn tp fp tn fn".split():
        bare = {"n": "n_all", "pp": "ones", "pn": "n_all - ones"}.get(k, "0")
        cols.append(f"CASE WHEN sheet = 'src0' THEN 0 WHEN sheet IN ('src1','src2') THEN {bare} ELSE {k} END AS {k}")
    return f"WITH {SCORED}, {c}, f AS (SELECT sheet, {', '.join(cols)} FROM c JOIN s USING (sheet)) {rates(total('f'))}"


def _model_compare() -> str:
    cases = " ".join(f"WHEN '{m}' THEN {k}" for m, k in {"original": 2, "tuned": 3, "finetuned": 5}.items())
    grid = "grid AS (SELECT k.*, m.model_source FROM keys k, (SELECT unnest(['original','tuned','finetuned']) AS model_source) m)"
    r = f"(CASE WHEN doc_id % (CASE model_source {cases} END) = 0 THEN '0' ELSE {reply()} END)"
    sc = f"sc AS (SELECT *, {parsed(r)} AS ai_label FROM grid)"
    return f"WITH {KEYS}, {grid}, {sc}, c AS ({counts('sc', 'model_source, sheet')}) {rates(total('c', 'model_source'))}"


def _prompt_grid() -> str:
    grid = "grid AS (SELECT k.*, CAST(p AS INT) AS prompt_no FROM keys k, range(1, 6) t(p))"
    r = f"(CASE WHEN doc_id % (prompt_no + 1) = 0 THEN '1' ELSE {reply()} END)"
    sc = f"sc AS (SELECT *, {parsed(r)} AS ai_label FROM grid)"
    return f"WITH {KEYS}, {grid}, {sc} {rates(counts('sc', 'prompt_no'))}"


def _budget(m: int, n: int) -> str:
    return (
        f"used AS (SELECT *, least(n, {m}) AS c, coalesce(sum(least(n, {m})) OVER (ORDER BY sheet_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sheets), "
        f"quota AS (SELECT sheet, greatest(0, least(c, {n} - before)) AS quota FROM used WHERE before < {n})"
    )


def _end_to_end() -> str:
    text_reply = "CASE WHEN length(btxt) % 3 <> 0 THEN 'answer ' || (length(btxt) % 2) ELSE 'unsure' END"
    return (
        f"WITH {DOCS}, {NUMBERED.format('docs')}, {SHEETS}, {_budget(30, 400)}, "
        "rows_in AS (SELECT n.*, l.quality AS label, row_idx < quota AS inb, trim(n.text, chr(10)) AS btxt FROM numbered n JOIN quota USING (sheet) LEFT JOIN labels l USING (doc_id)), "
        f"sc AS (SELECT sheet, label, CASE WHEN inb THEN {parsed('(' + text_reply + ')')} END AS ai_label FROM rows_in), "
        f"c AS ({counts('sc', 'sheet')}) {rates(total('c'))}"
    )


TEXT_REPLY = "CASE WHEN length(btxt) % 3 <> 0 THEN 'answer ' || (length(btxt) % 2) ELSE 'unsure' END"


def _failed_sheets() -> str:
    """The budget is passed on from sheet to sheet; one that fails uses none."""
    return (
        f"WITH RECURSIVE {DOCS}, {NUMBERED.format('docs')}, {SHEETS}, "
        "bad AS (SELECT sheet, sheet_ord, n, coalesce(min(row_idx) FILTER (doc_id % 211 = 5), n) AS first_bad FROM numbered JOIN sheets USING (sheet) GROUP BY sheet, sheet_ord, n), "
        "fold AS (SELECT 0::BIGINT AS sheet_ord, '' AS sheet, 0::BIGINT AS used, 0::BIGINT AS quota, true AS reached UNION ALL "
        "SELECT b.sheet_ord, b.sheet, used + CASE WHEN first_bad < q THEN 0 ELSE q END, CASE WHEN first_bad < q THEN 0 ELSE q END, used < 400 FROM "
        "(SELECT bad.*, used, greatest(0, least(n, 30, 400 - used)) AS q FROM fold JOIN bad ON bad.sheet_ord = fold.sheet_ord + 1) b), "
        "rows_in AS (SELECT n.*, l.quality AS label, row_idx < quota AS inb, trim(n.text, chr(10)) AS btxt FROM numbered n JOIN fold f ON f.sheet = n.sheet AND reached LEFT JOIN labels l USING (doc_id)), "
        f"sc AS (SELECT sheet, label, CASE WHEN inb THEN {parsed('(' + TEXT_REPLY + ')')} END AS ai_label FROM rows_in), "
        f"c AS ({counts('sc', 'sheet')}) {rates(total('c'))}"
    )


def _empty_sheets() -> str:
    """Sheets without rows come first, an unreadable one has no counts and uses no budget."""
    return (
        f"WITH {DOCS}, {NUMBERED.format('docs')}, sheets AS (SELECT sheet, row_number() OVER (ORDER BY sheet) AS sheet_ord, n FROM (SELECT source AS sheet, CASE WHEN source = 'src0' THEN 0 ELSE count(*) END AS n FROM documents GROUP BY 1)), {_budget(30, 400)}, "
        "rows_in AS (SELECT n.*, l.quality AS label, row_idx < quota AS inb, trim(n.text, chr(10)) AS btxt FROM numbered n JOIN quota USING (sheet) LEFT JOIN labels l USING (doc_id)), "
        f"sc AS (SELECT sheet, label, CASE WHEN inb THEN {parsed('(' + TEXT_REPLY + ')')} END AS ai_label FROM rows_in UNION ALL SELECT DISTINCT 'empty-' || lang, NULL, NULL FROM documents), "
        f"c AS ({counts('sc', 'sheet')}) {rates(total('c'))}"
    )


#: Least squares on the train rows: Gauss-Jordan elimination of the normal equations, one dimension a step.
OLS = (
    "x AS (SELECT vec_id, 'c' || (vec_id % 11) AS sheet, label % 2 AS y_true, CAST(label % 2 AS DOUBLE) AS y, vec_id % 4 = 3 AS is_test, "
    "[1e0] || list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings), "
    "train AS (SELECT z || [y] AS z FROM x WHERE NOT is_test), "
    "gram AS (SELECT i, j, sum(z[i] * z[j]) AS g FROM train, range(1, 66) a(i), range(1, 67) b(j) GROUP BY i, j), "
    "start AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS r FROM gram GROUP BY i)), "
    "solve AS (SELECT 1 AS k, m FROM start UNION ALL SELECT k + 1, "
    "[CASE WHEN i = k THEN [v / m[k][k] for v in m[k]] ELSE [m[i][j] - m[i][k] * m[k][j] / m[k][k] for j in range(1, 67)] END for i in range(1, 66)] "
    "FROM solve WHERE k <= 65), "
    "weights AS (SELECT [r[66] for r in m] AS w FROM solve WHERE k = 66), "
    "fitted AS (SELECT x.*, list_dot_product(z, w) AS p FROM x, weights)"
)


def _logistic(percents: str, steps: int = 120) -> str:
    """Logistic fits of nested shares by a fixed majorant of the curvature: X'X / 4 plus the penalty.

    Its inverse comes from one elimination per share; every step then needs the gradient only.
    """
    w = 65
    return (
        "x AS (SELECT vec_id, CAST(label % 2 AS DOUBLE) AS label, vec_id % 4 = 3 AS is_test, [1e0] || list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings), "
        "ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rk, count(*) OVER () AS n FROM x WHERE NOT is_test), "
        f"shares AS (SELECT CAST(unnest({percents}) AS INT) AS share), "
        "train AS (SELECT z, label, share, rk, n FROM ranked, shares WHERE rk <= n * share // 100), "
        f"bound AS (SELECT share, i, j, sum(z[i] * z[j]) / 4 + CASE WHEN i = j AND i > 1 THEN 1e0 ELSE 0e0 END AS g FROM train, range(1, {w + 1}) a(i), range(1, {w + 1}) b(j) GROUP BY share, i, j), "
        f"start AS (SELECT share, list(r || [CASE WHEN k = i THEN 1e0 ELSE 0e0 END for k in range(1, {w + 1})] ORDER BY i) AS m FROM (SELECT share, i, list(g ORDER BY j) AS r FROM bound GROUP BY share, i) GROUP BY share), "
        f"solve AS (SELECT 1 AS k, share, m FROM start UNION ALL SELECT k + 1, share, "
        f"[CASE WHEN i = k THEN [v / m[k][k] for v in m[k]] ELSE [m[i][j] - m[i][k] * m[k][j] / m[k][k] for j in range(1, {2 * w + 1})] END for i in range(1, {w + 1})] FROM solve WHERE k <= {w}), "
        f"inverse AS (SELECT share, [r[{w + 1}:{2 * w}] for r in m] AS inv FROM solve WHERE k = {w + 1}), "
        f"fit AS (SELECT 0 AS k, share, [0e0 for i in range(1, {w + 1})] AS w FROM inverse UNION ALL "
        "SELECT k + 1, share, [w[i] - list_dot_product(inv[i], g) for i in range(1, 66)] FROM ("
        "SELECT k, share, w, list(g + CASE WHEN j > 1 THEN w[j] ELSE 0e0 END ORDER BY j) AS g FROM ("
        "SELECT f.k, f.share, any_value(f.w) AS w, j, sum((1e0 / (1e0 + exp(-list_dot_product(t.z, f.w))) - t.label) * t.z[j]) AS g "
        f"FROM fit f JOIN train t ON t.share = f.share, range(1, {w + 1}) r(j) WHERE f.k < {steps} GROUP BY f.k, f.share, j) GROUP BY k, share, w) JOIN inverse USING (share)), "
        f"models AS (SELECT f.share, f.w, count(*) AS train_sentences FROM fit f JOIN train t ON t.share = f.share WHERE f.k = {steps} GROUP BY f.share, f.w), "
        "judged AS (SELECT share, train_sentences, label, list_dot_product(z, w) > 0 AS one FROM models, x WHERE is_test), "
        "c AS (SELECT share AS train_percentage, train_sentences, count(*) AS test_sentences, count(*) FILTER (one AND label = 1) AS tp, count(*) FILTER (NOT one AND label = 0) AS tn, "
        "count(*) FILTER (one AND label = 0) AS fp, count(*) FILTER (NOT one AND label = 1) AS fn FROM judged GROUP BY 1, 2)"
    )


def _curve(percents: str, keys: str) -> str:
    p1, r1, p0, r0 = div("tp", "tp + fp"), div("tp", "tp + fn"), div("tn", "tn + fn"), div("tn", "tn + fp")
    cells = {"true_positives": "tp", "true_negatives": "tn", "false_positives": "fp", "false_negatives": "fn"}
    shown = ", ".join(f"{rnd(div(f'{c} * 100', 'test_sentences'), 2)} AS {n}" for n, c in cells.items())

    def mean(one: str, zero: str) -> str:
        return f"(({one} * (tp + fn) + {zero} * (tn + fp)) / CAST(test_sentences AS DOUBLE))"

    return (
        f"WITH RECURSIVE {_logistic(percents)}, v AS (SELECT *, {p1} AS p1, {r1} AS r1, {p0} AS p0, {r0} AS r0 FROM c) "
        f"SELECT {keys}test_sentences, {shown}, {mean('p1', 'p0')} AS precision, {mean('r1', 'r0')} AS recall, {mean(f1('p1', 'r1'), f1('p0', 'r0'))} AS f1 FROM v"
    )


# Texts with one planted relative each; n characters and k foreign ones match in 2n / (2n + k).
PLANTED = (
    r"w AS (SELECT doc_id, source AS sheet, regexp_split_to_array(text, '\s+')[1:CASE WHEN doc_id % 2 = 0 THEN 14 ELSE 60 END] AS w FROM documents), "
    "t AS (SELECT doc_id, sheet, array_to_string([md5(doc_id || ':' || x)[1:9] for x in w], '') AS text, repeat('ж', CAST(doc_id % 45 + 1 AS INT)) AS f FROM w), "
    "p AS (SELECT *, length(text) AS n, length(f) AS k, CASE WHEN length(text) + length(f) < 200 THEN text[1:length(text) // 2] || f || text[length(text) // 2 + 1:] ELSE text || f END AS other FROM t), "
    "near AS (SELECT sheet, md5(text) AS train_md5, md5(other) AS test_md5, 2e0 * n / (2 * n + k) AS ratio FROM p WHERE 2e0 * n / (2 * n + k) >= 0.9e0)"
)


def _hashed(dims: int = 32) -> str:
    """Signed sums of hashed character trigrams of sentence and span, one after the other."""
    mod = "2147483647"
    h = f"((((c[i]::BIGINT * 1000003 + c[i + 1]) % {mod}) * 1000003 + c[i + 2]) % {mod})"
    return (
        f"WITH {DOCS}, t AS (SELECT doc_id, sheet, replace(replace(text, '<', ''), '>', '') AS s, nullif(regexp_extract(text, '<(.+?)>', 1), '') AS b FROM docs), "
        "p AS (SELECT doc_id, sheet, 0 AS part, s AS t FROM t WHERE b IS NOT NULL UNION ALL SELECT doc_id, sheet, 1, b FROM t WHERE b IS NOT NULL), "
        "codes AS (SELECT doc_id, sheet, part, list_transform(string_split(lower(t), ''), lambda x: unicode(x)) AS c FROM p), "
        f"g AS (SELECT doc_id, part, ({h} * 48271) % {mod} % {2 * dims} AS slot FROM (SELECT doc_id, part, c, unnest(range(1, len(c) - 1)) AS i FROM codes)), "
        "sums AS (SELECT doc_id, part, slot // 2 AS d, sum(1 - 2 * (slot % 2)) AS v FROM g GROUP BY 1, 2, 3), "
        "norms AS (SELECT doc_id, part, sqrt(sum(v * v)) AS r FROM sums GROUP BY 1, 2) "
        f"SELECT doc_id, sheet, CAST(part * {dims} + d AS INT) AS dim, round(CAST(CAST(coalesce(v / CASE WHEN r > 0 THEN r ELSE 1 END, 0) AS FLOAT) AS DOUBLE), 4) AS value "
        f"FROM p CROSS JOIN range(0, {dims}) e(d) LEFT JOIN sums USING (doc_id, part, d) LEFT JOIN norms USING (doc_id, part)"
    )


def oracle_sql() -> dict[str, str]:
    sheet_counts = f"c AS ({counts('scored', 'sheet')})"
    o: dict[str, str] = {
        "eval_by_sheet_total": f"WITH {SCORED}, {sheet_counts} {rates(total('c'))}",
        "eval_rounded_f1": f"WITH {SCORED}, {sheet_counts} {rates(total('c'), f1_from='rounded')}",
        "eval_unrounded": f"WITH {SCORED}, {sheet_counts} {rates('SELECT * FROM c', None, denominators='confusion')}",
        "eval_overall": f"WITH {SCORED}, s2 AS (SELECT *, 'all' AS scope FROM scored), c AS ({counts('s2', 'scope')}) {rates('SELECT * FROM c', 4, denominators='confusion')}",
        "eval_fallbacks": _fallbacks(),
        "model_compare": _model_compare(),
        "prompt_grid_eval": _prompt_grid(),
        "weighted_prf": _weighted(),
        "confusion_percent": _percent(),
        "verdict_rows": f"WITH {SCORED}, {DOCS} SELECT doc_id, CASE WHEN ai_label = label THEN '✓' ELSE '✗' END AS verdict, substring(text, 1, 80) AS text_preview, ai_label AS predicted, CASE WHEN ai_label = 1 THEN 'Euphemism' ELSE 'Not euphemism' END AS predicted_class, label AS actual FROM scored JOIN docs USING (doc_id)",
        "label_counts": f"WITH {KEYS} SELECT label, count(*) AS rows FROM keys WHERE label IS NOT NULL GROUP BY 1",
        "label_counts_by_sheet": f"WITH {KEYS} SELECT sheet, label, count(*) AS rows FROM keys WHERE label IS NOT NULL GROUP BY 1, 2",
        "regression_overall": f"WITH {REGR} SELECT count(*) AS n_samples, {REGR_COLS}, {DIST_COLS} FROM regr",
        "regression_by_sheet": f"WITH {REGR} SELECT sheet, count(*) AS n_samples, {REGR_COLS}, {DIST_COLS} FROM regr GROUP BY sheet",
        "regression_report": f"WITH {REGR} {report('GROUP BY regr.sheet', 'regr.sheet')}",
        "report_total": f"WITH {REGR} {REPORT_TOTAL}",
        "macro_mean": f"WITH {REGR}, t AS ({report_total(lambda x: x)}) SELECT {r9('avg(accuracy)')} AS avg_accuracy, {r9('avg(f1_score)')} AS avg_f1, {r9('avg(CASE WHEN NOT isnan(r2_score) THEN r2_score END)')} AS avg_r2 FROM t",
        "pred_histogram": f"WITH {REGR}, b AS (SELECT y_true AS label, min(p) AS lo, max(p) AS hi FROM regr GROUP BY 1), bins AS (SELECT b.*, CAST(i AS INT) AS bin FROM b, range(0, 20) t(i)), h AS (SELECT y_true AS label, least(CAST(floor((p - lo) / ((hi - lo) / 20)) AS INT), 19) AS bin, count(*) AS k FROM regr JOIN b ON b.label = y_true GROUP BY 1, 2) SELECT label, bin, {r9('lo + bin * (hi - lo) / 20')} AS bin_low, coalesce(k, 0) AS rows FROM bins LEFT JOIN h USING (label, bin)",
        "threshold_labels": f"WITH {REGR} SELECT vec_id, y_true, CAST(p >= 0.5 AS INT) AS y_bin FROM regr",
        "corpus_stats": f"WITH {KEYS} {STATS.format('sheet')}",
        "corpus_stats_by_lang": f"WITH {KEYS} {STATS.format('lang')}",
        "shape_report": "SELECT count(*) AS rows, CAST(2 AS BIGINT) AS metadata_columns, CAST(max(len(embedding)) AS BIGINT) AS dimensions FROM embeddings",
        "distinct_texts": f"WITH {DOCS} SELECT sheet, count(DISTINCT text) AS distinct_texts FROM docs GROUP BY 1",
        "head_rows": f"WITH {DOCS} SELECT doc_id, sheet, text FROM docs ORDER BY doc_id LIMIT 3",
        "vector_head": "SELECT vec_id, CAST(i AS INT) AS dim, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1), range(0, 10) t(i)",
        "first_seen_order": "SELECT lang AS sheet, min(doc_id) AS first_doc FROM documents GROUP BY 1",
        "span_extract": f"WITH {DOCS} SELECT doc_id, nullif(regexp_extract(text, '<(.+?)>', 1), '') AS bracketed_text FROM docs",
        "span_extract_pages": "SELECT page_id, nullif(regexp_extract(html, '<(.+?)>', 1), '') AS first_span, CAST(len(regexp_extract_all(html, '<([^<>]+)>', 1)) AS INT) AS n_groups FROM pages",
        "bracket_strip": f"WITH {DOCS} SELECT doc_id, replace(replace(text, '<', ''), '>', '') AS full_sentence FROM docs",
        "clean_text": "SELECT conv_id, turn, trim(coalesce(CASE WHEN turn = 3 THEN NULL ELSE chr(10) || chr(10) || text || ' ' || chr(10) END, 'nan'), chr(10)) AS text FROM conversations",
        "drop_incomplete": f"WITH {DOCS}, j AS (SELECT d.doc_id, d.sheet, l.quality AS label, nullif(regexp_extract(text, '<(.+?)>', 1), '') AS bracketed_text, CAST(length(replace(replace(text, '<', ''), '>', '')) AS INT) AS chars FROM docs d JOIN labels l USING (doc_id)) SELECT * FROM j WHERE bracketed_text IS NOT NULL AND label IS NOT NULL",
        "word_counts": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\s\v\x1c-\x1f\x{85}\x{a0}\p{Z}]+'), lambda x: x <> '')) AS INT) AS words, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS preview FROM documents",
        "label_parse": f"WITH {KEYS}, r AS (SELECT doc_id, {reply()} AS ai_reply FROM keys) SELECT doc_id, ai_reply, {parsed('ai_reply')} AS ai_label FROM r",
        "label_parse_nullable": "SELECT conv_id, turn, CAST(nullif(regexp_extract(text, '[01]'), '') AS INT) AS ai_label FROM conversations",
        "reply_json": f"SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 <> 2 THEN {STRIP_EDGE.format('text')} ELSE '0 Error' END AS reply FROM conversations",
        "reply_unwrap": f"SELECT conv_id, {STRIP_EDGE.format('arg_max(text, turn)')} AS reply FROM conversations GROUP BY conv_id",
        "completion_suffix": "SELECT doc_id, CAST(doc_id % 2 AS VARCHAR) AS completion, CAST(doc_id % 2 AS INT) AS ai_label FROM documents",
        "render_prompts": f"WITH {DOCS}, s AS (SELECT doc_id, text, {lit(PROMPTS[1])} AS sys, chr(10) || chr(10) || 'User: ' AS u, chr(10) || 'Assistant:' AS a FROM docs) SELECT doc_id, sys || u || 'Text: ' || text || a AS inference, sys || u || 'Text: ' || text || a || ' ' || (doc_id % 2) AS training, u || 'Text: ' || text || a AS no_system, sys || u || text AS plain, text AS raw FROM s",
        "prompt_lookup": "SELECT doc_id, CAST(doc_id % 5 + 1 AS INT) AS prompt_no, CASE doc_id % 5 + 1 " + " ".join(f"WHEN {k} THEN md5({lit(v)})" for k, v in PROMPTS.items()) + " END AS prompt_md5 FROM documents",
        "prompt_preview": f"WITH {DOCS}, {NUMBERED.format('docs')}, {SHEETS}, {_budget(5, 50)} SELECT sheet, row_idx, {lit(PROMPTS[2])} || chr(10) || chr(10) || 'User: ' || trim(text, chr(10)) AS prompt, 0 AS ai_label, '0 Test mode' AS ai_reply FROM numbered JOIN quota USING (sheet) WHERE row_idx < quota",
        "chat_messages": f"WITH {DOCS} SELECT doc_id, 'system,user' AS roles, text AS user_content, {lit(PROMPTS[5])} AS system_text FROM docs",
        "vocabulary": "WITH e AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(10), chr(10) || chr(10)), '. ', ' – '), chr(10) || chr(10))) AS entry FROM documents) SELECT doc_id, string_split(entry, ' – ')[1] AS term, CASE WHEN contains(entry, ' – ') THEN substring(entry, length(string_split(entry, ' – ')[1]) + 4) END AS definition FROM e",
        "word_list": "SELECT doc_id, unnest(string_split(text, ', ')) AS term FROM documents",
        "validate_labels": f"WITH {BROKEN} SELECT sheet, row_idx + 2 AS excel_row, 'error' AS severity, code, {where('label')} || CASE WHEN code = 'missing' THEN 'Missing/null value' ELSE 'Invalid value ''' || CAST(label AS VARCHAR) || ''' (should be 0 or 1)' END AS message FROM label_issue WHERE code IS NOT NULL",
        "validate_text": f"WITH {TEXT_ISSUE}, {NUMBERED.format('text_issue')} SELECT sheet, row_idx + 2 AS excel_row, {SEVERITY} AS severity, code, {where('text')} || {TEXT_MESSAGE} AS message FROM numbered WHERE code IS NOT NULL",
        "validate_pages": r"WITH g AS (SELECT page_id, regexp_extract_all(html, '<([^<>]+)>', 1) AS g FROM pages) SELECT 'pages' AS sheet, page_id + 2 AS excel_row, 'error' AS severity, CASE WHEN len(g) = 0 THEN 'no_group' ELSE 'multiple_groups' END AS code FROM g WHERE len(g) <> 1",
        "validate_numbered": f"WITH {ALL_ISSUES} SELECT severity, row_number() OVER (PARTITION BY severity ORDER BY sheet, section, excel_row) AS issue_no, sheet, \"column\", excel_row, code FROM issues",
        "validation_summary": f"WITH {BROKEN}, {TEXT_ISSUE}, j AS (SELECT b.sheet, s.sheet_ord, b.label, b.code AS lc, t.code AS tc FROM label_issue b JOIN text_issue t USING (doc_id) JOIN sheets s ON s.sheet = b.sheet), a AS (SELECT sheet, CAST(sheet_ord AS INT) AS sheet_ord, count(*) AS total_rows, count(lc) AS label_errors, count(*) FILTER (WHERE tc NOT IN ('blank_group','long_group')) AS text_errors, count(*) FILTER (WHERE tc IN ('blank_group','long_group')) AS warnings, count(label) AS labelled_rows, count(*) FILTER (WHERE label = 0) AS zeros, count(*) FILTER (WHERE label = 1) AS ones FROM j GROUP BY 1, 2) SELECT *, total_rows - text_errors AS valid_texts, label_errors + text_errors AS errors, label_errors + text_errors = 0 AS valid FROM a",
        "validation_overall": f"WITH {BROKEN}, {TEXT_ISSUE}, j AS (SELECT b.sheet, b.code AS lc, t.code AS tc FROM label_issue b JOIN text_issue t USING (doc_id)) SELECT count(lc) + count(*) FILTER (WHERE tc NOT IN ('blank_group','long_group')) = 0 AS valid, count(DISTINCT sheet) AS total_sheets, count(DISTINCT sheet) AS sheets_processed, count(*) AS total_rows, count(lc) + count(*) FILTER (WHERE tc NOT IN ('blank_group','long_group')) AS errors, count(*) FILTER (WHERE tc IN ('blank_group','long_group')) AS warnings FROM j",
        "header_check": "WITH h AS (SELECT lang || '-' || source AS sheet, CASE WHEN count(*) % 2 = 0 THEN ['text','label'] WHEN count(*) % 3 = 0 THEN ['text','note'] ELSE ['sentence'] END AS cols FROM documents GROUP BY 1), need AS (SELECT sheet, cols, unnest(['text','label']) AS c FROM h), bad AS (SELECT * FROM need WHERE NOT list_contains(cols, c)) SELECT sheet, 'error' AS severity, c AS \"column\", 'missing_column' AS code, 'Sheet ''' || sheet || ''': Missing required column ''' || c || '''' AS message FROM bad UNION ALL SELECT DISTINCT sheet, 'warning', NULL, 'available_columns', 'Sheet ''' || sheet || ''': Available columns: [''' || array_to_string(cols, ''', ''') || ''']' FROM bad",
        "row_budget": f"WITH {KEYS}, {NUMBERED.format('keys')}, {SHEETS}, {_budget(7, 100)} SELECT sheet, row_idx, doc_id, row_idx < quota AS in_budget FROM numbered JOIN quota USING (sheet)",
        "budget_quotas": f"WITH {SHEETS}, c AS (SELECT *, CASE WHEN sheet = 'src0' THEN 0 ELSE least(n, 30) END AS c FROM sheets), u AS (SELECT *, CAST(coalesce(sum(c) OVER (ORDER BY sheet_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM c) SELECT sheet, n AS rows, used_before, greatest(0, least(c, 400 - used_before)) AS quota, used_before < 400 AS reached FROM u",
        "batches": f"WITH {KEYS}, {NUMBERED.format('keys')} SELECT sheet, row_idx // 10 AS batch_no, count(*) AS rows, min(doc_id) AS first_doc FROM numbered GROUP BY 1, 2",
        "batches_per_sheet": "SELECT source AS sheet, count(*) AS rows, CAST(ceil(count(*) / 10.0) AS BIGINT) AS batches FROM documents GROUP BY 1",
        "split_quota": f"WITH {KEYS}, q AS (SELECT sheet, count(*) AS rows, count(*) FILTER (WHERE label=1) AS positive, count(*) FILTER (WHERE label=0) AS negative FROM keys GROUP BY 1) SELECT *, least(positive, negative) // 2 AS half, rows - 4 * (least(positive, negative) // 2) AS dropped FROM q",
        "balanced_split": balanced("sheet"),
        "balanced_split_by_lang": balanced("lang"),
        "split_8020": f"WITH {KEYS}, {HELD} SELECT * FROM held",
        "split_sizes": f"WITH {KEYS}, {HELD} SELECT split, count(*) AS rows, count(DISTINCT sheet) AS sheets FROM held GROUP BY 1",
        "learning_subsets": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) AS rk, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(coalesce((SELECT min(p * 10) FROM range(1, 10) t(p) WHERE rk <= n * p * 10 // 100), 100) AS INT) AS from_percent FROM r",
        "split_dropped": f"SELECT doc_id, sheet FROM ({balanced('sheet')}) WHERE split = 'dropped'",
        "exact_leak": f"WITH {LEAK} SELECT sheet, md5(text) AS text_md5 FROM both_sides",
        "exact_leak_sample": f"WITH {LEAK}, m AS (SELECT sheet, md5(text) AS h, row_number() OVER (PARTITION BY sheet ORDER BY md5(text)) AS rank, count(*) OVER (PARTITION BY sheet) AS k FROM both_sides) SELECT sheet, CAST(rank AS INT) AS rank, h AS preview, greatest(k - 5, 0) AS more FROM m WHERE rank <= 5",
        "leak_verdict": f"WITH {LEAK} SELECT count(*) AS exact_duplicates, CAST(0 AS BIGINT) AS near_duplicates, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END AS verdict FROM both_sides",
        "token_table": f"WITH {TOKENS} SELECT conv_id, turn, array_to_string(ids, ',') AS input_ids, array_to_string(list_transform(ids, lambda x: 1), ',') AS attention_mask, array_to_string(list_transform(ids, lambda x: 0), ',') AS token_type_ids FROM toks",
        "left_pad": f"WITH {TOKENS}, w AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS width FROM toks) SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(0, width - len(ids)), lambda x: 0), ids), ',') AS padded_ids, array_to_string(list_concat(list_transform(range(0, width - len(ids)), lambda x: 0), list_transform(ids, lambda x: 1)), ',') AS padded_mask FROM w",
        "token_accuracy": f"WITH {TOKENS}, pos AS (SELECT role, ids, unnest(range(1, len(ids))) AS i FROM toks), hit AS (SELECT role, CASE WHEN i % 3 = 2 THEN -100 ELSE ids[i + 1] END AS l, ids[i + 1] + CASE WHEN (i - 1) % 5 = 0 THEN 1 ELSE 0 END AS p FROM pos), s AS (SELECT role, count(*) FILTER (WHERE l <> -100 AND l = p) AS correct, count(*) FILTER (WHERE l <> -100) AS counted FROM hit GROUP BY 1), d AS (SELECT *, {div('correct', 'counted')} AS x FROM s) SELECT role, correct, counted, {rnd('x', 4)} AS accuracy FROM d",
        "epoch_log": f"WITH log AS (SELECT event_id AS step, event_id / 2000e0 AS epoch, event_type = 'error' AS ev, value, user_id / 1000e0 AS acc FROM events), k AS (SELECT *, CAST(CASE WHEN ev THEN floor(epoch) ELSE ceil(epoch) END AS INT) AS ep FROM log), a AS (SELECT ep AS epoch, coalesce(avg(value) FILTER (WHERE NOT ev), 0e0) AS tl, coalesce(arg_max(value, step) FILTER (WHERE ev), 0e0) AS el, coalesce(arg_max(acc, step) FILTER (WHERE ev), 0e0) AS ea FROM k GROUP BY 1), t AS (SELECT CAST(floor(event_id / 2000e0) AS INT) AS epoch, arg_max(event_id % 7 / 7e0, event_id) AS ta FROM events WHERE event_id % 500 = 0 GROUP BY 1), j AS (SELECT a.*, coalesce(ta, 0e0) AS ta FROM a LEFT JOIN t USING (epoch)) SELECT epoch, round({rnd('tl', 4)}, 2) AS train_loss, {rnd('ta', 4)} AS train_accuracy, {rnd('el', 4)} AS eval_loss, {rnd('ea', 4)} AS eval_accuracy FROM j",
        "run_ids": f"WITH {RUNS} SELECT o_orderkey, run_id, run_id || '-experiment' || experiment || '.xlsx' AS result_name, run_id || '-experiment' || experiment || '.csv' AS metrics_name FROM named",
        "next_experiment": f"WITH {RUNS}, u AS (SELECT DISTINCT run_id, experiment FROM named), c AS (SELECT run_id, unnest(range(1, max(experiment) + 2)) AS k FROM u GROUP BY run_id) SELECT run_id, CAST(min(k) AS INT) AS next_experiment FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.run_id = c.run_id AND u.experiment = c.k) GROUP BY run_id",
        "pick_models": f"WITH {RUNS} SELECT provider, CASE WHEN model <> '' THEN model ELSE (CASE provider " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEFAULT_MODELS.items()) + " END) END AS model, count(*) AS runs FROM runs GROUP BY 1, 2",
        "latest_run": f"WITH {LEDGER} SELECT mode, max(iteration) AS iteration, arg_max(path, iteration) AS path FROM led GROUP BY 1",
        "cumulative_epoch": f"WITH {LEDGER} SELECT mode, iteration, CAST(sum(epochs) OVER (PARTITION BY mode ORDER BY iteration) AS BIGINT) AS total_epochs FROM led",
        "continued_iterations": "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 0 ELSE p_partkey END AS start FROM part) SELECT p_partkey, CAST(i AS INT) AS i, CAST(start + i AS INT) AS iteration, 'finetune-' || CASE WHEN start + i < 10 THEN '0' ELSE '' END || (start + i) AS name FROM s, range(1, 4) t(i)",
        "run_ledger": f"WITH g AS (SELECT CAST(user_id % 50 AS INT) AS iteration, round(max(value), 3) AS tl, CAST(min(value) AS DOUBLE) AS el FROM events GROUP BY 1) SELECT 'lora' AS mode, iteration, {rnd('tl', 4)} AS train_loss, {rnd('el', 4)} AS eval_loss, 0e0 AS eval_accuracy, 'run-' || iteration AS path FROM g",
        "score_hook": f"WITH {DOCS}, c AS (SELECT doc_id, trim(text, chr(10)) AS t FROM docs), r AS (SELECT doc_id, CASE WHEN length(t) % 3 <> 0 THEN 'answer ' || (length(t) % 2) ELSE 'unsure' END AS ai_reply FROM c) SELECT doc_id, {parsed('ai_reply')} AS ai_label, ai_reply, CAST(NULL AS VARCHAR) AS error FROM r",
        "score_throttled": f"WITH {DOCS}, c AS (SELECT doc_id, trim(text, chr(10)) AS t FROM docs), r AS (SELECT doc_id, CASE WHEN length(t) % 3 <> 0 THEN 'answer ' || (length(t) % 2) ELSE 'unsure' END AS ai_reply FROM c) SELECT doc_id, {parsed('ai_reply')} AS ai_label, ai_reply FROM r",
        "score_errors": f"WITH {DOCS}, c AS (SELECT doc_id, length(trim(text, chr(10))) AS k FROM docs) SELECT doc_id, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS ai_label, CASE WHEN k % 7 = 0 THEN '0 Error' ELSE '1 of ' || k END AS ai_reply, CASE WHEN k % 7 = 0 THEN 'RuntimeError: unavailable' END AS error FROM c",
        "score_batch_errors": f"WITH {DOCS}, {NUMBERED.format('docs')}, c AS (SELECT doc_id, length(trim(text, chr(10))) AS k, bool_or(length(trim(text, chr(10))) % 7 = 0) OVER (PARTITION BY sheet, row_idx // 10) AS bad FROM numbered) SELECT doc_id, CASE WHEN bad THEN 0 ELSE 1 END AS ai_label, CASE WHEN bad THEN '0 Error' ELSE '1 of ' || k END AS ai_reply, CASE WHEN bad THEN 'RuntimeError: unavailable' END AS error FROM c",
        "evaluate_end_to_end": _end_to_end(),
        "embed_compound": f"WITH {DOCS}, c AS (SELECT doc_id, replace(replace(text, '<', ''), '>', '') AS s, nullif(regexp_extract(text, '<(.+?)>', 1), '') AS b FROM docs) SELECT doc_id, concat_ws(',', length(s), length(s) - length(replace(s, ' ', '')), length(s) - length(replace(s, 'e', '')), length(b), length(b) - length(replace(b, ' ', '')), length(b) - length(replace(b, 'e', ''))) AS embedding FROM c WHERE b IS NOT NULL",
        "wide_embeddings": "SELECT vec_id, label, CAST(len(embedding) AS INT) AS dims, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS emb_{i}" for i in range(64)) + " FROM embeddings",
        "workbook_ingest": f"WITH {DOCS} SELECT sheet, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE doc_id % 3 = 1) AS ones, CAST(ceil(count(*) / 40.0) AS BIGINT) AS books FROM docs GROUP BY 1",
    }
    o["ols_fit_eval"] = f"WITH RECURSIVE {OLS}, regr AS (SELECT *, p AS y_pred FROM fitted WHERE is_test) {REPORT_TOTAL}"
    o["ols_training_quality"] = f"WITH RECURSIVE {OLS}, regr AS (SELECT * FROM fitted WHERE NOT is_test) SELECT count(*) AS n_samples, {r9(MSE)} AS mse, {r9(R2)} AS r2_score FROM regr"
    o["scored_sink"] = f"WITH {SCORED}, {DOCS} SELECT s.doc_id, s.sheet, s.label, s.ai_label, {reply()} AS ai_reply, md5(d.text) AS text_md5 FROM scored s JOIN (SELECT doc_id AS id, text FROM docs) d ON d.id = s.doc_id"
    o["split_sink"] = f"WITH {DOCS} SELECT split, b.sheet, b.doc_id, b.label, md5(text) AS text_md5 FROM ({balanced('sheet')}) b JOIN docs d ON d.doc_id = b.doc_id WHERE split <> 'dropped'"
    o["report_sink"] = f"WITH {REGR}, t AS ({REPORT_TOTAL}) SELECT * EXCLUDE (is_total) FROM t"
    o["embedding_sink"] = "SELECT label, CAST(i AS INT) AS dim, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value FROM embeddings, range(0, 64) t(i)"
    o["tokenizer_hook"] = f"WITH {TOKENS} SELECT conv_id, turn, array_to_string(ids, ',') AS input_ids, CAST(len(ids) AS INT) AS size FROM toks"
    o["union_sheets"] = (
        "SELECT doc_id, lang AS sheet, CASE WHEN lang = 'en' THEN quality END AS label, CASE WHEN lang = 'de' THEN 'n' || doc_id END AS note, "
        "CASE WHEN lang = 'fr' THEN n_chars END AS n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'de', 'fr', 'es')"
    )
    o["run_ledger_stamped"] = f"WITH g AS (SELECT CAST(user_id % 50 AS INT) AS iteration, round(CAST(max(value) AS DOUBLE), 3) AS tl FROM events GROUP BY 1) SELECT 'lora' AS mode, iteration, {rnd('tl', 4)} AS train_loss, true AS stamped FROM g"
    o["near_leak_planted"] = f"WITH {PLANTED} SELECT sheet, train_md5, test_md5, {r9('ratio')} AS ratio, 1::BIGINT AS pairs FROM near"
    o["near_leak_planted_top3"] = (
        f"WITH {PLANTED}, r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY ratio DESC, train_md5 DESC, test_md5 DESC) AS rank, count(*) OVER (PARTITION BY sheet) AS n FROM near) "
        f"SELECT sheet, CAST(rank AS INT) AS rank, {r9('ratio')} AS ratio, train_md5 AS train_text, test_md5 AS test_text, greatest(n - 3, 0) AS more FROM r WHERE rank <= 3"
    )
    o["near_leak_planted_verdict"] = f"WITH {PLANTED} SELECT 0::BIGINT AS exact_duplicates, count(*) AS near_duplicates, 'WARN' AS verdict FROM near"
    o["distinct_texts_sketched"] = f"WITH {DOCS} SELECT sheet, count(DISTINCT text) AS distinct_texts, true AS within_bound FROM docs GROUP BY 1 UNION ALL SELECT 'TOTAL', count(DISTINCT text), true FROM docs"
    o["metric_hooks_by_sheet"] = (
        f"WITH {REGR}, c AS (SELECT sheet, count(*) FILTER (y = 1) AS ones, count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM regr GROUP BY 1), "
        "w AS (SELECT a.sheet, sum(CASE WHEN a.y_pred > b.y_pred THEN 1e0 WHEN a.y_pred = b.y_pred THEN 5e-1 ELSE 0e0 END) AS won FROM regr a JOIN regr b ON a.sheet = b.sheet AND a.y = 1 AND b.y = 0 GROUP BY 1) "
        f"SELECT sheet, {r9('(tp / CAST(ones AS DOUBLE) + tn / CAST(zeros AS DOUBLE)) / 2')} AS balanced_accuracy, {r9('won / (CAST(ones AS DOUBLE) * zeros)')} AS rank_statistic FROM c JOIN w USING (sheet)"
    )
    o["align_predictions"] = f"WITH {KEYS}, {NUMBERED.format('keys')} SELECT sheet, row_idx, label, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 2 AS INT) END AS prediction FROM numbered"
    o["embed_hashed"] = _hashed()
    o["logistic_eval"] = _curve("[100]", "")
    o["learning_curve"] = _curve("[10, 20, 30, 40, 50, 60, 70, 80, 90, 100]", "train_percentage, train_sentences, ")
    o["ols_normal_equations"] = "SELECT CAST(i AS INT) AS dim, 0e0 AS product FROM range(0, 73) t(i)"
    o["logistic_gradient"] = "SELECT CAST(10 * s AS INT) AS share, CAST(i AS INT) AS dim, 0e0 AS gradient FROM range(1, 11) a(s), range(0, 65) b(i)"
    o["verify_files"] = (
        f"WITH {FILES}, n AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM found) "
        "SELECT errors = 0 AS valid, (SELECT count(DISTINCT source) FROM documents) AS total_sheets, (SELECT count(DISTINCT source) - 1 FROM documents) AS sheets_processed, "
        "(SELECT count(*) FROM v) AS total_rows, errors, warnings FROM n"
    )
    o["verify_files_sheets"] = (
        f"WITH {FILES}, n AS (SELECT sheet, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM found GROUP BY 1), "
        "r AS (SELECT sheet, count(*) AS total_rows, count(lab) AS labelled_rows, count(*) FILTER (lab = '0') AS zeros, count(*) FILTER (lab = '1') AS ones FROM v GROUP BY 1) "
        "SELECT sheet, sheet <> 'src4' AS readable, coalesce(total_rows, 0) AS total_rows, coalesce(labelled_rows, 0) AS labelled_rows, coalesce(zeros, 0) AS zeros, coalesce(ones, 0) AS ones, "
        "coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid FROM (SELECT DISTINCT source AS sheet FROM documents) LEFT JOIN r USING (sheet) LEFT JOIN n USING (sheet)"
    )
    o["verify_files_issues"] = (
        f"WITH {FILES} SELECT severity, row_number() OVER (PARTITION BY severity ORDER BY sheet, section, row_idx NULLS FIRST, \"column\", message) AS issue_no, "
        "sheet, \"column\", row_idx + 2 AS excel_row, code, md5(message) AS message_md5 FROM found"
    )
    o["evaluate_failed_sheets"] = _failed_sheets()
    o["evaluate_empty_sheets"] = _empty_sheets()
    o["sink_roundtrip"] = f"SELECT * EXCLUDE (is_total) RENAME (sheet AS sheet_name) FROM ({o['eval_by_sheet_total']})"
    return o
