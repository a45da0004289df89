"""SQL (DuckDB dialect) that must give the same rows as the registered queries.

Each oracle is one statement; common table expressions are shared and added as needed.
"""

import re
from string import Formatter

from secondlook import fixed
from secondlook.plans import bindings as b


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    def cell(v):
        return quoted(v) if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def bits(purpose: str, key: str = "seq") -> str:
    return f"(('0x' || substr(md5('{b.SEED}:{purpose}:' || {key}), 1, 7))::BIGINT)"


def unit(purpose: str, key: str = "seq") -> str:
    return f"({bits(purpose, key)} / 268435456.0::DOUBLE)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def filled(template: str, **columns: str) -> str:
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(quoted(literal))
        if name is not None:
            parts.append(columns[name])
    return " || ".join(parts)


def issue(template: str, *exprs: str) -> str:
    pieces = template.split("{}")
    parts = [quoted(pieces[0])]
    for e, p in zip(exprs, pieces[1:]):
        parts += [f"({e})", quoted(p)]
    return " || ".join(parts)


def any_pattern(text: str, bounded: bool = False) -> str:
    names = [r"\bdan\b" if bounded and p == "dan" else p for p in fixed.INJECTION_PATTERNS]
    return f"regexp_matches({text}, {quoted('|'.join(names))}, 'i')"


def pii(name: str, text: str = "text") -> str:
    return f"regexp_matches({text}, {quoted(dict(fixed.PII_PATTERNS)[name])}, 'i')"


PII_NAMES = [n for n, _ in fixed.PII_PATTERNS]
ANY_PII = "(" + " OR ".join(pii(n) for n in PII_NAMES) + ")"
V = ", ".join(quoted(v) for v in fixed.VERDICTS)
N_LABELS = len(fixed.DEFAULT_TAXONOMY)
LOW, HIGH = fixed.NOISY_CONFIDENCE
CLEAN_LOW, CLEAN_HIGH = fixed.CLEAN_CONFIDENCE
NOISY = f"({unit('flip')} < {fixed.NOISE_RATE}::DOUBLE)"
CONFIDENCE = (
    f"CASE WHEN {NOISY} THEN ({bits('unsure')} % {HIGH - LOW + 1} + {LOW}) / 100.0::DOUBLE "
    f"ELSE ({bits('sure')} % {CLEAN_HIGH - CLEAN_LOW + 1} + {CLEAN_LOW}) / 100.0::DOUBLE END"
)
SHAPE = f"({bits('shape')} % {b.N_SHAPES})"
FULL_BLOCK = "string_agg('- ' || name || ': ' || definition, chr(10) ORDER BY ordinal)"
SHORT_BLOCK = f"string_agg(name || ':' || definition[:{fixed.COMPACT_DEFINITION_CHARS}], '|' ORDER BY ordinal)"
MOCK = {
    "suggested": f"CASE WHEN is_misclassified THEN coalesce(ground_truth, '{fixed.UNKNOWN_LABEL}') END",
    "verdict": "CASE WHEN is_misclassified THEN 'Incorrect' ELSE 'Correct' END",
}
MOCK["reasoning"] = (
    f"CASE WHEN is_misclassified THEN {quoted(fixed.MOCK_WRONG[0])} || {MOCK['suggested']} || "
    f"{quoted(fixed.MOCK_WRONG[1])} || pred_label || {quoted(fixed.MOCK_WRONG[2])} ELSE {quoted(fixed.MOCK_OK)} END"
)
MOCK["explanation"] = (
    f"{quoted(fixed.MOCK_EXPLANATION[0])} || coalesce(nullif({MOCK['suggested']}, ''), pred_label) || "
    f"{quoted(fixed.MOCK_EXPLANATION[1])}"
)


def render(verdict, reasoning, suggested, explanation, cased=str) -> str:
    return (
        f"'{cased('VERDICT')}: ' || {verdict} || chr(10) || '{cased('REASONING')}: ' || {reasoning} || chr(10) || "
        f"'{cased('SUGGESTED_LABEL')}: ' || coalesce({suggested}, 'None') || chr(10) || "
        f"'{cased('EXPLANATION')}: ' || {explanation}"
    )


def parse_columns(raw: str = "raw_response") -> str:
    """Select list that parses an answer."""

    def value(header):
        return trim(f"regexp_extract({raw}, '{header}:\\s*([^\\n]*)', 1, 'i')")

    def lines(header):
        n = len(header) + 1
        headed = f"list_filter(list_transform(string_split({raw}, chr(10)), lambda x: {trim('x')}), lambda x: upper(x[:{n}]) = '{header}:')"
        return f"list_transform({headed}, lambda x: {trim(f'x[{n + 1}:]')})"

    word = f"regexp_extract({raw}, 'VERDICT:\\s*(\\w+)', 1, 'i')"
    word = f"(upper({word}[:1]) || lower({word}[2:]))"
    first = f"(CASE WHEN {word} IN ({V}) THEN {word} ELSE 'Uncertain' END)"
    retry = f"({first} = 'Uncertain' AND contains(upper({raw}), 'VERDICT:'))"
    exact = f"list_filter({lines('VERDICT')}, lambda v: v IN ({V}))"
    named = f"list_filter({lines('SUGGESTED_LABEL')}, lambda v: lower(v) <> 'none')"
    label = value("SUGGESTED_LABEL")
    return (
        f"CASE WHEN {retry} THEN coalesce({exact}[-1], 'Uncertain') ELSE {first} END AS verdict, "
        f"{value('REASONING')} AS reasoning, "
        f"coalesce(CASE WHEN lower({label}) <> 'none' THEN nullif({label}, '') END, "
        f"CASE WHEN {retry} THEN nullif({named}[1], '') END) AS suggested_label, "
        f"{value('EXPLANATION')} AS explanation"
    )


def too_long(x: str, limit: int, template: str) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN {issue(template, f'length({x})', str(limit))} END"


def cut(x: str, limit: int) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN {x}[:{limit}] || {quoted(fixed.TRUNCATION_MARK)} ELSE {x} END"


def listed(*items: str) -> str:
    return f"array_to_string(list_filter([{', '.join(items)}], lambda i: i IS NOT NULL), ' | ')"


def redacted(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x} WHEN length({x}) <= 20 THEN '{fixed.REDACTED_SHORT}' "
        f"ELSE {x}[:10] || '{fixed.REDACTED_MIDDLE}' || {x}[-10:] END"
    )


def label_check(label: str) -> tuple[str, str, str]:
    """Join clause, cleaned label and acceptance test of a suggested label."""
    absent = f"({label} IS NULL OR lower({label}) IN ('none', 'n/a', ''))"
    join = f"LEFT JOIN tax ON NOT {absent} AND lower(tax.name) = lower({label})"
    return join, "tax.name", f"({absent} OR tax.name IS NOT NULL)"


def validate_columns(strict: bool = True) -> str:
    """Select list of the output check over (verdict, reasoning, suggested_label, explanation, raw_response)."""
    _, clean, ok = label_check("suggested_label")
    given = "coalesce(verdict, 'Uncertain')"
    mapped = (
        f"(CASE upper({trim(given)}) WHEN 'CORRECT' THEN 'Correct' WHEN 'INCORRECT' THEN 'Incorrect' ELSE 'Uncertain' END)"
    )
    sus = any_pattern("(coalesce(reasoning, '') || ' ' || coalesce(explanation, '') || ' ' || raw_response)")
    down = f"(NOT {ok} AND {mapped} = 'Incorrect')"
    forced = f"({down} OR {sus})" if strict else down
    issues = listed(
        too_long("raw_response", fixed.MAX_RESPONSE_CHARS, fixed.ISSUE_TOO_LONG),
        f"CASE WHEN {given} NOT IN ({V}) THEN {issue(fixed.ISSUE_VERDICT, given, mapped)} END",
        f"CASE WHEN NOT {ok} THEN {issue(fixed.ISSUE_LABEL, 'suggested_label')} END",
        f"CASE WHEN {down} THEN {quoted(fixed.ISSUE_DOWNGRADE)} END",
        too_long("reasoning", fixed.MAX_REASONING_CHARS, fixed.ISSUE_REASONING),
        too_long("explanation", fixed.MAX_EXPLANATION_CHARS, fixed.ISSUE_EXPLANATION),
        f"CASE WHEN {sus} THEN {quoted(fixed.ISSUE_INJECTION)} END",
    )
    return (
        f"{issues} AS issues, CASE WHEN {forced} THEN 'Uncertain' ELSE {mapped} END AS final_verdict, "
        f"{clean} AS final_label, {cut('reasoning', fixed.MAX_REASONING_CHARS)} AS final_reasoning, "
        f"{cut('explanation', fixed.MAX_EXPLANATION_CHARS)} AS final_explanation, {sus} AS suspicious, NOT {ok} AS rejected"
    )


LABEL_JOIN = label_check("suggested_label")[0]
LIVE = (
    f"version = '{fixed.PROMPT_VERSION}' AND model = '{b.MODEL}' AND created_at >= {b.NOW} - {fixed.CACHE_TTL_SECONDS}"
)
NOT_SEEN = "row_number() OVER (PARTITION BY prompt_hash ORDER BY created_at DESC, version DESC, model DESC, " \
    "verdict DESC, reasoning DESC, suggested_label DESC NULLS LAST, explanation DESC, latency_ms DESC) = 1"


def step_over(position: str, skipped: str) -> str:
    return f"({position} + len(list_filter(list_transform({skipped}, lambda x, i: x - (i - 1)), lambda x: x <= {position})))"


def noise_ctes() -> dict[str, str]:
    other = f"({bits('other')} % {N_LABELS - 1})"
    point = f"({unit('weight')} * (listed_total + rest_total))"
    rest = f"least(floor(({point} - listed_total) / {fixed.UNLISTED_WEIGHT}::DOUBLE)::BIGINT, {N_LABELS} - 2 - len(listed))"
    hit = f"list_filter(listed, lambda s: {point} < s.hi)[1].ordinal"
    skipped = "list_sort(list_append(list_transform(listed, lambda s: s.ordinal), own))"
    return {
        "b0": f"b0 AS (SELECT doc_id AS seq, text, tax.name AS ground_truth, tax.ordinal AS own FROM documents "
        f"JOIN tax ON tax.ordinal = {bits('label', 'doc_id')} % {N_LABELS})",
        "static": "static AS (SELECT b0.seq, b0.ground_truth, coalesce(p.confused, o.name) AS confused FROM b0 "
        "LEFT JOIN (SELECT actual, arg_min(confused, ordinal) AS confused FROM pat GROUP BY actual) p ON p.actual = b0.ground_truth "
        f"LEFT JOIN tax o ON o.ordinal = {other} + CASE WHEN b0.own <= {other} THEN 1 ELSE 0 END)",
        "weights": "weights AS (SELECT actual, list({'ordinal': ordinal, 'hi': hi} ORDER BY ordinal) AS listed, max(hi) AS listed_total, "
        f"({N_LABELS} - 1 - count(*)) * {fixed.UNLISTED_WEIGHT}::DOUBLE AS rest_total FROM "
        "(SELECT s.actual, t.ordinal, sum(s.weight) OVER (PARTITION BY s.actual ORDER BY t.ordinal "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM sim s JOIN tax t ON t.name = s.candidate) GROUP BY actual)",
        "dynamic": "dynamic AS (SELECT p.seq, p.ground_truth, o.name AS confused FROM (SELECT b0.*, "
        f"coalesce({hit}, {step_over(rest, skipped)}) AS pick FROM b0 JOIN weights ON weights.actual = b0.ground_truth) p "
        "LEFT JOIN tax o ON o.ordinal = p.pick)",
        "b1": f"b1 AS (SELECT b0.seq, printf('demo_{b.SEED}_%04d', b0.seq) AS id, b0.text, "
        f"CASE WHEN {NOISY.replace('seq', 'b0.seq')} THEN s.confused ELSE b0.ground_truth END AS pred_label, "
        f"{CONFIDENCE.replace('seq', 'b0.seq')} AS confidence, b0.ground_truth, {NOISY.replace('seq', 'b0.seq')} AS is_misclassified "
        "FROM b0 JOIN static s ON s.seq = b0.seq)",
    }


def prompt(template: str, block: str) -> str:
    return filled(
        template, labels=f"(SELECT {block} FROM tax)", text="text", pred_label="pred_label", confidence="confidence::VARCHAR"
    )


SHAPED = {
    "verdict": f"CASE WHEN {SHAPE} = 4 THEN '[' || {MOCK['verdict']} || ']' ELSE {MOCK['verdict']} END",
    "reasoning": f"CASE WHEN {SHAPE} = 8 THEN repeat('x', {b.LONG_REASONING}) ELSE {MOCK['reasoning']} END",
    "suggested": f"CASE WHEN {SHAPE} = 5 THEN '{b.UNLISTED_LABEL}' ELSE {MOCK['suggested']} END",
    "explanation": MOCK["explanation"],
}
WELL = render(SHAPED["verdict"], SHAPED["reasoning"], SHAPED["suggested"], SHAPED["explanation"])
LOWER = render(SHAPED["verdict"], SHAPED["reasoning"], SHAPED["suggested"], SHAPED["explanation"], str.lower)

CTES = {
    "tax": values("tax", "ordinal, name, definition", [(i, n, d) for i, (n, d) in enumerate(fixed.DEFAULT_TAXONOMY)]),
    "pat": values("pat", "ordinal, actual, confused", [(i, *p) for i, p in enumerate(fixed.CONFUSION_PATTERNS)]),
    "sim": values("sim", "ordinal, actual, candidate, weight", [(i, *s) for i, s in enumerate(fixed.LABEL_SIMILARITY)]),
    "inj": values("inj", "ordinal, pattern", list(enumerate(fixed.INJECTION_PATTERNS, 1))),
    **noise_ctes(),
    "mock": "mock AS (SELECT id AS sample_id, seq, text, pred_label, confidence, ground_truth, "
    f"{MOCK['verdict']} AS verdict, {MOCK['reasoning']} AS reasoning, {MOCK['suggested']} AS suggested_label, "
    f"{MOCK['explanation']} AS explanation, true AS success, true AS _untrusted FROM b1)",
    "hashed": "hashed AS (SELECT *, md5('" + fixed.PROMPT_VERSION + ":' || prompt)[:16] AS prompt_hash FROM "
    f"(SELECT *, {prompt(fixed.PROMPT_TEMPLATE, FULL_BLOCK)} AS prompt FROM b1))",
    "b2": f"b2 AS (SELECT *, {SHAPE} AS shape, CASE {SHAPE} WHEN 3 THEN {LOWER} WHEN 6 THEN {WELL} || chr(10) || '{b.INJECTED_LINE}' "
    f"WHEN 7 THEN 'VERDICT: Maybe' || chr(10) || {WELL} WHEN 9 THEN text ELSE {WELL} END AS raw_response FROM b1)",
    "parsed": f"parsed AS (SELECT *, {parse_columns()} FROM b2)",
    "checked": f"checked AS (SELECT parsed.*, {validate_columns()} FROM parsed {LABEL_JOIN})",
    "res": "res AS (SELECT c.seq, c.id AS sample_id, c.text, c.pred_label, c.confidence, c.ground_truth, c.final_verdict AS verdict, "
    "c.final_reasoning AS reasoning, c.final_label AS suggested_label, c.final_explanation AS explanation, true AS success, "
    "h.prompt_hash, length(c.raw_response) AS latency_ms, false AS cache_hit, NULL::VARCHAR AS error, true AS _untrusted, "
    "nullif(c.issues, '') AS _validation_issues, c.shape FROM checked c JOIN hashed h ON h.seq = c.seq)",
    "failing": "failing AS (SELECT seq, sample_id, text, pred_label, confidence, ground_truth, "
    "CASE WHEN shape = 9 THEN 'Uncertain' ELSE verdict END AS verdict, "
    "CASE WHEN shape = 9 THEN 'Error: timeout' ELSE reasoning END AS reasoning, "
    "CASE WHEN shape <> 9 THEN suggested_label END AS suggested_label, "
    f"CASE WHEN shape = 9 THEN '{fixed.FAILED_EXPLANATION}' ELSE explanation END AS explanation, shape <> 9 AS success, "
    "CASE WHEN shape <> 9 THEN prompt_hash END AS prompt_hash, CASE WHEN shape <> 9 THEN latency_ms END AS latency_ms, "
    "cache_hit, CASE WHEN shape = 9 THEN 'timeout' END AS error, _untrusted, "
    "CASE WHEN shape <> 9 THEN _validation_issues END AS _validation_issues FROM res)",
    "chat": f"chat AS (SELECT a.conv_id, a.turn, a.text AS raw_response, u.text AS question FROM conversations a LEFT JOIN conversations u "
    "ON u.role = 'user' AND u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant')",
    "texts": "texts AS (SELECT 'answer' AS kind, seq AS key, raw_response AS body FROM b2 UNION ALL "
    "SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages UNION ALL "
    "SELECT 'chat', conv_id * 1000 + turn, raw_response FROM chat)",
    "cache": f"cache AS (SELECT * FROM (SELECT prompt_hash, CASE WHEN {bits('version')} % 5 = 0 THEN '{b.OLD_VERSION}' ELSE '{fixed.PROMPT_VERSION}' END AS version, "
    f"CASE WHEN {bits('model')} % 4 = 0 THEN '{b.OTHER_MODEL}' ELSE '{b.MODEL}' END AS model, "
    f"({b.CACHE_START} + {bits('age')} % {b.CACHE_HOURS} * 3600)::DOUBLE AS created_at, 0::BIGINT AS hit_count, "
    f"{MOCK['verdict']} AS verdict, {MOCK['reasoning']} AS reasoning, {MOCK['suggested']} AS suggested_label, "
    f"{MOCK['explanation']} AS explanation, {bits('latency')} % 900 AS latency_ms FROM hashed) QUALIFY {NOT_SEEN})",
    "live": f"live AS (SELECT * FROM cache WHERE {LIVE})",
    "requests": "requests AS (SELECT prompt_hash, count(*) AS n_rows, min(seq) AS seq, arg_min(prompt, seq) AS prompt, "
    "arg_min(pred_label, seq) AS pred_label, arg_min(ground_truth, seq) AS ground_truth, "
    "arg_min(is_misclassified, seq) AS is_misclassified FROM hashed GROUP BY prompt_hash)",
    "missed": "missed AS (SELECT * FROM requests WHERE prompt_hash NOT IN (SELECT prompt_hash FROM live))",
    "scored": f"scored AS (SELECT *, CASE WHEN length(prompt) % 11 <> 0 THEN 'VERDICT: ' || [{V}][length(prompt) % 3 + 1] || chr(10) || "
    "'REASONING: ' || length(prompt) || ' characters' END AS raw_response, CASE WHEN length(prompt) % 11 = 0 THEN 'refused' END AS error FROM requests)",
    # Mock answers and scorer answers only trip the check on a label or a pattern within a label or name.
    "mocked": f"mocked AS (SELECT m.*, {validate_columns()} FROM (SELECT *, {parse_columns()} FROM (SELECT *, "
    f"{render(MOCK['verdict'], MOCK['reasoning'], MOCK['suggested'], MOCK['explanation'])} AS raw_response FROM hashed "
    f"WHERE prompt_hash NOT IN (SELECT prompt_hash FROM live))) m {LABEL_JOIN})",
    "reviewed": "reviewed AS (SELECT h.seq, l.verdict, l.reasoning, l.suggested_label, l.explanation, l.latency_ms, true AS cache_hit, "
    "NULL::VARCHAR AS issues FROM live l JOIN hashed h USING (prompt_hash) UNION ALL SELECT seq, final_verdict, final_reasoning, final_label, final_explanation, "
    "0, false, nullif(issues, '') FROM mocked)",
    "batch": "batch AS (SELECT h.seq, h.id AS sample_id, h.text, h.pred_label, h.confidence, h.ground_truth, r.verdict, r.reasoning, "
    "r.suggested_label, r.explanation, true AS success, h.prompt_hash, r.latency_ms, r.cache_hit, NULL::VARCHAR AS error, "
    "true AS _untrusted, r.issues AS _validation_issues FROM hashed h JOIN reviewed r USING (seq))",
    "src": "src AS (SELECT source AS name, min(doc_id) AS ordinal, count(*) || ' texts from one crawl' AS definition FROM documents GROUP BY source)",
    "pairs": "pairs AS (SELECT ground_truth AS actual, pred_label AS confused, min(seq) AS ordinal, count(*) AS n_rows FROM b1 "
    "WHERE is_misclassified GROUP BY 1, 2)",
    "ltemp": f"ltemp AS (SELECT tax.name AS label, row_number() OVER (PARTITION BY tax.name ORDER BY item_id) - 1 AS ordinal, text "
    f"FROM benchmark JOIN tax ON tax.ordinal = {bits('label', 'item_id')} % {N_LABELS})",
    "expanded": "expanded AS (SELECT b0.seq, b0.ground_truth, l.text FROM b0 LEFT JOIN (SELECT label, count(*) AS n FROM ltemp GROUP BY label) s "
    f"ON s.label = b0.ground_truth LEFT JOIN ltemp l ON l.label = b0.ground_truth AND l.ordinal = {bits('template', 'b0.seq')} % s.n)",
}


def with_ctes(body: str) -> str:
    """Prefix a query with the shared tables it uses, in definition order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    used = [CTES[name] for name in sorted(needed, key=list(CTES).index)]
    return ("WITH " + ", ".join(used) + " " if used else "") + body


RESULT = (
    "seq, sample_id, text, pred_label, confidence, ground_truth, verdict, reasoning, suggested_label, explanation, "
    "success, prompt_hash, latency_ms::VARCHAR AS latency_ms, cache_hit, error, _untrusted, _validation_issues"
)
CHECKED = (
    "seq, issues = '' AS is_valid, issues, final_verdict AS verdict, final_label AS label, final_reasoning AS reasoning, "
    "final_explanation AS explanation"
)
MESSY = (
    f"CASE WHEN {SHAPE} < 3 THEN {MOCK['verdict']} WHEN {SHAPE} = 3 THEN lower({MOCK['verdict']}) WHEN {SHAPE} = 4 THEN upper({MOCK['verdict']}) "
    f"WHEN {SHAPE} = 5 THEN ' ' || {MOCK['verdict']} || chr(10) WHEN {SHAPE} = 6 THEN 'uncertain' WHEN {SHAPE} = 7 THEN '[' || {MOCK['verdict']} || ']' "
    f"WHEN {SHAPE} = 8 THEN '' END"
)
CLEAN_VERDICT = (
    "CASE upper({0}) WHEN 'CORRECT' THEN 'Correct' WHEN 'INCORRECT' THEN 'Incorrect' ELSE 'Uncertain' END"
)
DECAP = "lower(text[:1]) || text[2:]"
FORMS = {
    "plain": "text",
    "lower": "lower(text)",
    "greeting": f"'Hi, ' || {DECAP}",
    "thanks": "text || ' Thanks.'",
    "letter": f"'Hello, ' || {DECAP} || ' Best regards.'",
    "urgent": "'URGENT: ' || text",
    "exclaim": "replace(text, '.', '!')",
}


def varied(key: str = "seq") -> str:
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(FORMS.values()))
    return f"CASE {bits('variation', key)} % {len(FORMS)} {cases} END"


def metrics(table: str, extra: str = "") -> str:
    counts = ", ".join(
        f"count(*) FILTER (verdict = '{v}') AS {v.lower()}, "
        f"CASE WHEN count(*) > 0 THEN count(*) FILTER (verdict = '{v}') / count(*)::DOUBLE * 100 ELSE 0.0::DOUBLE END AS {v.lower()}_pct"
        for v in fixed.VERDICTS
    )
    return f"SELECT count(*) AS total, {counts}{extra} FROM {table}"


DIGEST = "SELECT seq, md5(p) AS prompt_md5, length(p) AS n_chars FROM (SELECT seq, {} AS p FROM b1)"
PREVIEW = (
    "SELECT tax.ordinal, tax.name AS label, coalesce(c.list, '{none}') AS confused_with, '{mode}' AS mode FROM tax LEFT JOIN ({inner}) c ON c.actual = tax.name"
)
TOP3 = (
    "SELECT actual, confused AS candidate, n_rows::DOUBLE AS weight, row_number() OVER (PARTITION BY actual ORDER BY n_rows DESC, ordinal) AS rank "
    "FROM pairs QUALIFY rank <= 3"
)
BATCH_FRESH = (
    f"fresh AS (SELECT prompt_hash, '{fixed.PROMPT_VERSION}' AS version, '{b.MODEL}' AS model, {b.NOW}::DOUBLE AS created_at, 0::BIGINT AS hit_count, "
    "final_verdict AS verdict, final_label AS suggested_label FROM scored_checked WHERE error IS NULL)"
)
CACHE_COLUMNS = "prompt_hash, version, model, created_at, hit_count, verdict, suggested_label"


def upsert(key: str) -> str:
    return (
        f"SELECT {CACHE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY new DESC) AS n FROM "
        f"(SELECT {CACHE_COLUMNS}, 0 AS new FROM cache UNION ALL SELECT {CACHE_COLUMNS}, 1 FROM fresh)) WHERE n = 1"
    )


def damaged() -> str:
    damage = f"({bits('damage', 'prompt_hash')} % 10)"
    fields = ", ".join(
        f"CASE WHEN usable THEN {f} END AS {f}" for f in ("verdict", "reasoning", "suggested_label", "explanation", "success")
    )
    fields += ", CASE WHEN usable THEN latency_ms::VARCHAR END AS latency_ms"
    return f"SELECT prompt_hash, usable, {fields} FROM (SELECT *, true AS success, {damage} > 2 AS usable FROM cache)"


LABELED = (
    "sample_id AS id, {text} AS text, pred_label AS original_label, verdict, coalesce(nullif(suggested_label, ''), pred_label) AS corrected_label, "
    "{reasoning} AS reasoning, ground_truth, true AS _untrusted"
)


def report_rows() -> str:
    """All lines of the report; part 0 and 2 of them have a fixed wording, filled with the run's figures."""
    counted = " UNION ALL ".join(
        f"SELECT '{v}' AS v, count(*) FILTER (verdict = '{v}') AS n, count(*) AS total FROM mock" for v in fixed.VERDICTS
    )
    share = "printf('%.1f%%', CASE WHEN total > 0 THEN n / total::DOUBLE * 100 ELSE 0.0::DOUBLE END)"
    plain = [
        "> **UNTRUSTED OUTPUT**",
        "> The verdicts, labels and sentences below were produced by an automatic reviewer.",
        "> Have a person check them before they are used for anything that matters.",
        *[""] * 11, "---", "---",
        "title: Classification Audit Report", "run_id: run-42", "generated: 2024-01-01 00:00:00",
        "# Classification Audit Report", "## Verdict Distribution", "| Verdict | Count | Percentage |",
        "|---------|-------|------------|", "## Label Distribution", "| Label | Count |", "|-------|-------|",
        "## Sample Corrections", "## Left for people",
    ]
    figures = {
        "Correct": "'accuracy: ' || share, 'samples_reviewed: ' || total",
        "Incorrect": "'**' || total || '** predictions were reviewed; **' || n || '** (' || share || ') need a correction.', "
        "'- ' || n || ' corrections wait for a second opinion.'",
        "Uncertain": "'- ' || n || ' predictions stayed undecided.'",
    }
    filled_in = " UNION ALL ".join(f"SELECT unnest([{lines}]) FROM counted WHERE v = '{v}'" for v, lines in figures.items())
    oneline = "regexp_replace({}, '[\\r\\n]', ' ', 'g')"
    correction = (
        f"[{oneline.format("'**' || i || '. \"' || text[:80] || '...\"**'")}, "
        f"{oneline.format("'- Predicted: `' || pred_label || '`, suggested: `' || suggested_label || '`'")}, "
        f"{oneline.format("'- Reason: ' || reasoning[:100]")}, '']"
    )
    return (
        f"SELECT unnest([{', '.join(quoted(line) for line in plain)}]) AS line "
        f"UNION ALL SELECT line FROM (WITH counted AS (SELECT *, {share} AS share FROM ({counted})) "
        f"SELECT * FROM ({filled_in}) filled_in(line) "
        "UNION ALL SELECT '| ' || v || ' | ' || n || ' | ' || share || ' |' FROM counted "
        "UNION ALL SELECT '*No corrections needed*' FROM counted WHERE v = 'Incorrect' AND n = 0) "
        f"UNION ALL SELECT unnest({correction}) FROM (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM mock "
        "WHERE verdict = 'Incorrect' ORDER BY seq LIMIT 5) "
        "UNION ALL SELECT '| ' || pred_label || ' | ' || count(*) || ' |' FROM mock GROUP BY pred_label"
    )


SPELLED = (
    f"CASE {SHAPE} WHEN 0 THEN upper(suggested_label) WHEN 1 THEN ' ' || suggested_label WHEN 2 THEN coalesce(suggested_label, 'N/A') ELSE suggested_label END"
)
SCORED_REVIEWS = (
    "SELECT prompt_hash, verdict, reasoning, suggested_label, explanation, true AS success, true AS cache_hit, NULL AS error, NULL AS issues FROM live "
    "UNION ALL SELECT prompt_hash, CASE WHEN error IS NULL THEN final_verdict ELSE 'Uncertain' END, "
    "CASE WHEN error IS NULL THEN final_reasoning ELSE 'Error: ' || error END, CASE WHEN error IS NULL THEN final_label END, "
    f"CASE WHEN error IS NULL THEN final_explanation ELSE '{fixed.FAILED_EXPLANATION}' END, error IS NULL, false, error, "
    "CASE WHEN error IS NULL THEN nullif(issues, '') END FROM scored_checked"
)
CTES["scored_checked"] = (
    f"scored_checked AS (SELECT m.*, {validate_columns()} FROM (SELECT * REPLACE (coalesce(raw_response, '') AS raw_response), {parse_columns()} FROM scored "
    f"WHERE prompt_hash NOT IN (SELECT prompt_hash FROM live)) m {LABEL_JOIN})"
)
CTES["fresh"] = BATCH_FRESH

SRC_PARTS = "SELECT *, (row_number() OVER (ORDER BY ordinal) - 1) // 8 AS part FROM src"

CTES["streamed"] = (
    f"streamed AS (SELECT m.*, {validate_columns()} FROM (SELECT * REPLACE (coalesce(raw_response, '') AS raw_response), {parse_columns()} FROM scored) m {LABEL_JOIN})"
)
STREAM_VERDICT = f"CASE WHEN error IS NULL THEN final_verdict ELSE '{fixed.UNCERTAIN}' END"

ORACLES = {
    "scan_samples": "SELECT * FROM b1",
    "scan_taxonomy": "SELECT tax.*, coalesce(n.n_rows, 0) AS n_rows FROM tax LEFT JOIN (SELECT ground_truth, count(*) AS n_rows FROM b0 GROUP BY 1) n ON n.ground_truth = tax.name",
    "sink_samples_csv": "SELECT * FROM b1",
    "sink_results_json": f"SELECT * REPLACE ({redacted('text')} AS text, {redacted('reasoning')} AS reasoning) FROM mock",
    "sink_labeled_csv": f"SELECT {LABELED.format(text=redacted('text'), reasoning=redacted('reasoning'))} FROM res",
    "sink_metrics_json": metrics(
        "res",
        ", (SELECT count(*) FILTER (suspicious) FROM checked) AS validation_failures, "
        "(SELECT count(*) FILTER (rejected) FROM checked) AS invalid_labels_rejected, "
        f"{quoted(fixed.METRICS_WARNING)} AS _warning, false AS redacted",
    ),
    "sink_run_manifest": f"SELECT count(*) AS n_samples, 'run-42' AS run_id, 42::BIGINT AS seed, false AS use_llm, '{b.MODEL}' AS model, "
    f"false AS redacted, true AS strict_validation, '2024-01-01 00:00:00' AS generated_at, {quoted(fixed.RUN_WARNING)} AS _warning FROM documents",
    "sink_report": report_rows(),
    "run_summary": metrics("mock", ", 'run-42' AS run_id"),
    "csv_read_back": " UNION ALL ".join(
        f"SELECT '{fixed.ARTIFACTS[a]}' AS artifact, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM documents" for a in ("samples", "labeled")
    ),
    "text_variations": " UNION ALL ".join(f"SELECT doc_id AS seq, '{n}' AS variant, {e} AS varied_text FROM documents" for n, e in FORMS.items()),
    "text_variation_pick": f"SELECT doc_id AS seq, {varied('doc_id')} AS text FROM documents",
    "sample_id": "SELECT doc_id AS seq, printf('demo_42_%04d', doc_id) AS id FROM documents",
    "build_prompt": DIGEST.format(prompt(fixed.PROMPT_TEMPLATE, FULL_BLOCK)),
    "build_compact_prompt": DIGEST.format(prompt(fixed.COMPACT_PROMPT_TEMPLATE, SHORT_BLOCK)),
    "prompt_hash": "SELECT seq, prompt_hash FROM hashed",
    "parse_response": "SELECT seq, verdict, reasoning, suggested_label, explanation FROM parsed",
    "parse_chat": f"SELECT conv_id, turn, question, {parse_columns()} FROM chat",
    "normalize_verdict": f"SELECT seq, raw_verdict, {CLEAN_VERDICT.format(trim('raw_verdict'))} AS verdict FROM (SELECT seq, {MESSY} AS raw_verdict FROM b1)",
    "check_lengths": "SELECT kind, seq, "
    f"{cut('reasoning', fixed.MAX_REASONING_CHARS)} AS reasoning, {cut('explanation', fixed.MAX_EXPLANATION_CHARS)} AS explanation, "
    + listed(
        too_long("raw_response", fixed.MAX_RESPONSE_CHARS, fixed.ISSUE_TOO_LONG),
        too_long("reasoning", fixed.MAX_REASONING_CHARS, fixed.ISSUE_REASONING),
        too_long("explanation", fixed.MAX_EXPLANATION_CHARS, fixed.ISSUE_EXPLANATION),
    )
    + " AS issues FROM (SELECT 'answer' AS kind, seq, raw_response, reasoning, explanation FROM parsed UNION ALL SELECT 'document', doc_id, text, text, text FROM documents)",
    "detect_injection": f"SELECT kind, key, {any_pattern('body')} AS suspicious FROM texts",
    "detect_injection_bounded": f"SELECT kind, key, {any_pattern('body', True)} AS suspicious FROM texts",
    "injection_matches": " UNION ALL ".join(
        f"SELECT kind, key, {i}::BIGINT AS pattern_ordinal FROM texts WHERE regexp_matches(body, {quoted(p)}, 'i')"
        for i, p in enumerate(fixed.INJECTION_PATTERNS, 1)
    ),
    "validate_output": f"SELECT {CHECKED} FROM checked",
    "validate_output_lenient": f"SELECT {CHECKED} FROM (SELECT parsed.*, {validate_columns(False)} FROM parsed {LABEL_JOIN})",
    "validate_preparsed": f"SELECT {CHECKED} FROM (SELECT p.*, {validate_columns()} FROM (SELECT seq, '' AS raw_response, {MESSY} AS verdict, "
    f"text AS reasoning, lower(pred_label) AS suggested_label, 'ok' AS explanation FROM b1) p {LABEL_JOIN})",
    "assemble_results": f"SELECT {RESULT} FROM res",
    "assemble_errors": f"SELECT {RESULT} FROM failing",
    "mark_untrusted": "SELECT true AS _untrusted, count(*) AS n_rows FROM documents",
    "mock_review": "SELECT * FROM mock",
    "redact_text": f"SELECT doc_id AS seq, {redacted('text')} AS text FROM documents",
    "redact_results": f"SELECT seq, {redacted('text')} AS text, {redacted('reasoning')} AS reasoning, explanation, suggested_label FROM res",
    "redact_results_full": f"SELECT seq, {redacted('text')} AS text, {redacted('reasoning')} AS reasoning, {redacted('explanation')} AS explanation, suggested_label FROM res",
    "pii_flags": "SELECT doc_id AS seq, " + ", ".join(f"{pii(n)} AS {n}" for n in PII_NAMES) + " FROM documents",
    "is_synthetic_id": f"SELECT id, starts_with(id, 'demo_') OR starts_with(id, 'synth_') AS is_synthetic FROM (SELECT CASE WHEN {SHAPE} < 3 "
    f"THEN printf('demo_42_%04d', seq) WHEN {SHAPE} < 6 THEN 'synth_' || seq ELSE 'row_' || seq END AS id FROM b0)",
    "corrected_label": "SELECT seq, coalesce(nullif(suggested_label, ''), pred_label) AS any_verdict, "
    "coalesce(CASE WHEN verdict = 'Incorrect' THEN nullif(suggested_label, '') END, pred_label) AS only_incorrect FROM res",
    "labeled_dataset": f"SELECT {LABELED.format(text='text', reasoning='reasoning')} FROM res",
    "correction_snippets": "SELECT seq, text[:80] AS text, pred_label AS predicted, suggested_label AS suggested, reasoning[:100] AS reasoning FROM res WHERE verdict = 'Incorrect'",
    "word_count": "SELECT doc_id AS seq, len(regexp_extract_all(text, '\\S+')) AS n_words FROM documents",
    "response_json": damaged(),
    "filter_incorrect": "SELECT seq, sample_id, verdict, suggested_label FROM res WHERE verdict = 'Incorrect'",
    "filter_pii_rows": f"SELECT doc_id AS seq, text FROM documents WHERE {ANY_PII}",
    "ttl_filter": f"SELECT prompt_hash, created_at FROM cache WHERE NOT ({b.NOW} - created_at > {fixed.CACHE_TTL_SECONDS})",
    "cache_identity": f"SELECT prompt_hash, version, model FROM cache WHERE version = '{fixed.PROMPT_VERSION}' AND model = '{b.MODEL}'",
    "failed_rows": "SELECT seq, reasoning, error, success FROM failing WHERE NOT success",
    "validate_label": f"SELECT l.seq, l.suggested_label, {label_check('l.suggested_label')[1]} AS valid_label, {label_check('l.suggested_label')[2]} AS label_ok "
    f"FROM (SELECT seq, {SPELLED} AS suggested_label FROM parsed) l {label_check('l.suggested_label')[0]}",
    "cache_lookup": "SELECT h.seq, h.prompt_hash, l.prompt_hash IS NOT NULL AS cache_hit, l.verdict, l.reasoning, l.suggested_label, l.explanation, l.latency_ms::VARCHAR AS latency_ms "
    "FROM hashed h LEFT JOIN live l USING (prompt_hash)",
    "cache_misses": "SELECT seq, prompt_hash FROM hashed WHERE prompt_hash NOT IN (SELECT prompt_hash FROM live)",
    "miss_prompts_distinct": "SELECT prompt_hash, n_rows, seq, md5(prompt) AS prompt_md5 FROM missed",
    "review_join_back": "SELECT h.seq, h.id AS sample_id, h.prompt_hash, r.final_verdict AS verdict, r.final_label AS suggested_label, h.ground_truth "
    f"FROM hashed h JOIN (SELECT m.*, {validate_columns()} FROM (SELECT *, {parse_columns()} FROM (SELECT *, "
    f"{render(MOCK['verdict'], MOCK['reasoning'], MOCK['suggested'], MOCK['explanation'])} AS raw_response FROM hashed)) m {LABEL_JOIN}) r USING (seq)",
    "static_confusion": "SELECT seq, ground_truth, confused FROM static",
    "label_membership": "SELECT seq, suggested_label AS label, coalesce(suggested_label IN (SELECT name FROM tax), false) AS known FROM parsed",
    "verdict_metrics": metrics("res"),
    "verdict_distribution": f"SELECT coalesce({MESSY}, 'Uncertain') AS verdict, count(*) AS n_rows FROM b1 GROUP BY 1",
    "label_distribution": "SELECT pred_label AS label, count(*) AS n_rows, min(seq) AS first_seq FROM b1 GROUP BY 1",
    "pii_summary": "SELECT n > 0 AS has_potential_pii, true AS is_synthetic, (SELECT string_agg(name, ',' ORDER BY first_at, ordinal) FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, {i} AS ordinal, min(doc_id) AS first_at FROM documents WHERE {pii(n)} HAVING min(doc_id) IS NOT NULL" for i, n in enumerate(PII_NAMES))
    + f")) AS detected_patterns, n AS samples_with_pii, total AS total_samples FROM (SELECT count(*) FILTER ({ANY_PII}) AS n, count(*) AS total FROM documents)",
    "pii_pattern_counts": " UNION ALL ".join(f"SELECT '{n}' AS pattern, count(*) AS n_rows FROM documents WHERE {pii(n)}" for n in PII_NAMES),
    "validation_stats": "SELECT count(*) FILTER (suspicious) AS validation_failures, count(*) FILTER (rejected) AS invalid_labels_rejected FROM checked",
    "cache_stats": "SELECT hits, misses, persistent_hits, cached_prompts, CASE WHEN hits + misses > 0 THEN hits / (hits + misses)::DOUBLE * 100 ELSE 0.0::DOUBLE END AS hit_rate FROM "
    "(SELECT count(l.prompt_hash) AS hits, count(*) - count(l.prompt_hash) AS misses, count(DISTINCT l.prompt_hash) AS persistent_hits, "
    "count(DISTINCT h.prompt_hash) AS cached_prompts FROM hashed h LEFT JOIN live l USING (prompt_hash))",
    "success_count": "SELECT count(*) FILTER (success) AS succeeded, count(*) AS total FROM failing",
    "taxonomy_block": f"SELECT part, {FULL_BLOCK} AS block, 'full' AS style FROM ({SRC_PARTS}) GROUP BY part UNION ALL "
    f"SELECT part, {SHORT_BLOCK}, 'compact' FROM ({SRC_PARTS}) GROUP BY part",
    "valid_labels": "SELECT DISTINCT source AS name FROM documents",
    "generator_metadata": "SELECT 42::BIGINT AS seed, tax.ordinal AS label_ordinal, tax.name AS label, false AS use_dynamic_confusion, "
    "coalesce(string_agg(confused, '|' ORDER BY pairs.ordinal), '') AS confusion_patterns FROM tax LEFT JOIN pairs ON pairs.actual = tax.name GROUP BY tax.ordinal, tax.name "
    "UNION ALL SELECT 42, ordinal, name, true, 'dynamic' FROM tax",
    "normalize_results": "SELECT seq, CASE WHEN shape = 0 THEN 'Uncertain' ELSE verdict END AS verdict, CASE WHEN shape = 1 THEN 'Unknown' ELSE pred_label END AS pred_label, "
    "CASE WHEN shape = 2 THEN '' ELSE text END AS text, CASE WHEN shape = 3 THEN '' ELSE reasoning END AS reasoning FROM res",
    "confusion_preview": PREVIEW.format(none=fixed.NO_PATTERN, mode="static", inner="SELECT actual, string_agg(confused, ' | ' ORDER BY ordinal) AS list FROM pairs GROUP BY actual")
    + " UNION ALL "
    + PREVIEW.format(none=fixed.NO_PATTERN, mode="dynamic", inner=f"SELECT actual, string_agg(candidate, ' | ' ORDER BY rank) AS list FROM ({TOP3}) GROUP BY actual"),
    "dynamic_confusion": "SELECT seq, ground_truth, confused FROM dynamic",
    "first_pattern": "SELECT actual, arg_min(confused, ordinal) AS confused FROM pairs GROUP BY actual",
    "similar_labels_topk": TOP3,
    "top_corrections": "SELECT seq, text[:80] AS text, pred_label AS predicted, suggested_label AS suggested, reasoning[:100] AS reasoning FROM res "
    "WHERE verdict = 'Incorrect' ORDER BY seq LIMIT 5",
    "labels_by_first_seen": "SELECT pred_label AS label, count(*) AS n_rows, min(seq) AS first_seq FROM b1 GROUP BY 1 ORDER BY 3",
    "merge_templates": "SELECT source AS label, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal, text FROM documents UNION ALL "
    "SELECT c.label, c.ordinal + coalesce(n.n, 0), c.text FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY item_id) - 1 AS ordinal, text FROM "
    f"(SELECT 'src' || ({bits('source', 'item_id')} % 25) AS label, item_id, text FROM benchmark)) c LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) n ON n.source = c.label",
    "cache_upsert": upsert("prompt_hash"),
    "cache_upsert_side_by_side": upsert("prompt_hash, version, model"),
    "cache_expire": f"SELECT {CACHE_COLUMNS} FROM cache WHERE NOT ({b.NOW} - created_at > {fixed.CACHE_TTL_SECONDS})",
    "cache_touch": f"SELECT * REPLACE (hit_count + CASE WHEN prompt_hash IN (SELECT prompt_hash FROM live) THEN 1 ELSE 0 END AS hit_count) FROM (SELECT {CACHE_COLUMNS} FROM cache)",
    "cache_upkeep": f"SELECT * REPLACE (hit_count + CASE WHEN prompt_hash IN (SELECT prompt_hash FROM live) THEN 1 ELSE 0 END AS hit_count) "
    f"FROM (SELECT {CACHE_COLUMNS} FROM cache WHERE NOT ({b.NOW} - created_at > {fixed.CACHE_TTL_SECONDS}))",
    "cache_clear": "SELECT count(*) AS n_before, 0::BIGINT AS n_after FROM cache",
    "cache_versions": f"SELECT version, count(*) AS n_rows, count(*) FILTER (model = '{b.MODEL}' AND created_at >= {b.NOW} - {fixed.CACHE_TTL_SECONDS}) AS n_usable FROM cache GROUP BY version",
    "union_results": "SELECT h.seq, h.id AS sample_id, true AS cache_hit, true AS success, l.verdict, l.reasoning, l.suggested_label, NULL::VARCHAR AS error FROM hashed h JOIN live l USING (prompt_hash) "
    "UNION ALL SELECT f.seq, f.sample_id, false, f.success, f.verdict, f.reasoning, f.suggested_label, f.error FROM failing f JOIN hashed h ON h.seq = f.seq "
    "WHERE h.prompt_hash NOT IN (SELECT prompt_hash FROM live)",
    "inject_label_noise": "SELECT seq, pred_label, confidence, ground_truth, is_misclassified FROM b1",
    "inject_label_noise_dynamic": "SELECT b1.seq, CASE WHEN is_misclassified THEN d.confused ELSE b1.ground_truth END AS pred_label, confidence, b1.ground_truth, is_misclassified "
    "FROM b1 JOIN dynamic d ON d.seq = b1.seq",
    "confidence_draw": f"SELECT seq, {CONFIDENCE} AS confidence FROM b0",
    "assign_labels": "SELECT seq, ground_truth FROM b0",
    "expand_templates": "SELECT seq, ground_truth, text FROM expanded",
    "generate_samples": f"SELECT b1.seq, b1.id, {varied('e.seq').replace('text', 'e.text')} AS text, b1.pred_label, b1.confidence, b1.ground_truth, b1.is_misclassified FROM b1 JOIN expanded e ON e.seq = b1.seq",
    "score_prompts": "SELECT prompt_hash, n_rows, raw_response, error FROM scored",
    "review_batch": f"SELECT {RESULT} FROM batch",
    "review_batch_scored": "SELECT h.seq, h.id AS sample_id, h.text, h.pred_label, h.confidence, h.ground_truth, r.verdict, r.reasoning, r.suggested_label, r.explanation, r.success, "
    f"CASE WHEN r.success THEN h.prompt_hash END AS prompt_hash, r.cache_hit, r.error, true AS _untrusted, r.issues AS _validation_issues FROM hashed h JOIN ({SCORED_REVIEWS}) r USING (prompt_hash)",
    "audit_run": "SELECT pred_label, verdict, count(*) AS n_rows FROM batch GROUP BY 1, 2",
    "audit_pipeline": f"SELECT h.pred_label, r.verdict, count(*) AS n_rows FROM hashed h JOIN ({SCORED_REVIEWS}) r USING (prompt_hash) GROUP BY 1, 2",
    "audit_next_cache": f"SELECT prompt_hash, version, model, created_at, (prompt_hash IN (SELECT prompt_hash FROM live))::BIGINT AS hit_count, verdict, suggested_label FROM cache "
    f"WHERE NOT ({b.NOW} - created_at > {fixed.CACHE_TTL_SECONDS}) AND prompt_hash NOT IN (SELECT prompt_hash FROM fresh) "
    f"UNION ALL SELECT {CACHE_COLUMNS} FROM fresh",
    "confusion_matrix": "SELECT pred_label, coalesce(nullif(suggested_label, ''), pred_label) AS corrected_label, count(*) AS n_rows FROM res GROUP BY 1, 2",
    "worst_labels": "SELECT *, dense_rank() OVER (ORDER BY incorrect_rate DESC)::INTEGER AS rank FROM (SELECT pred_label, count(*) AS n_rows, "
    "count(*) FILTER (verdict = 'Incorrect') AS incorrect, incorrect / n_rows::DOUBLE AS incorrect_rate FROM res GROUP BY 1)",
    "escalation_queue": "SELECT seq, sample_id, pred_label, confidence, verdict FROM res WHERE verdict = 'Uncertain' OR confidence < 0.7",
    "reviewer_agreement": "SELECT *, CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives)::DOUBLE ELSE 0.0::DOUBLE END AS precision, "
    "CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives)::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM ("
    "SELECT count(*) AS total, count(*) FILTER (w AND f) AS true_positives, count(*) FILTER (NOT w AND f) AS false_positives, "
    "count(*) FILTER (w AND NOT f) AS false_negatives, count(*) FILTER (f AND suggested_label = ground_truth) AS right_suggestions "
    "FROM (SELECT *, pred_label <> ground_truth AS w, coalesce(verdict = 'Incorrect', false) AS f FROM res WHERE ground_truth IS NOT NULL AND pred_label IS NOT NULL))",
    "latency_summary": "SELECT count(*) AS n_rows, avg(latency_ms) AS mean_ms, quantile_disc(latency_ms, 0.5) AS median_ms, "
    "quantile_disc(latency_ms, 0.95) AS p95_ms, max(latency_ms) AS max_ms FROM failing WHERE success",
    "stream_audit": f"SELECT lang, {any_pattern('text')} AS suspicious, {ANY_PII} AS has_pii, count(*) AS n_rows FROM documents GROUP BY 1, 2, 3",
    "stream_cached_review": f"SELECT batch, {STREAM_VERDICT} AS verdict, batch = 1 AND error IS NULL AS cache_hit, error IS NULL AS success, sum(n_rows)::BIGINT AS n_rows "
    "FROM streamed, (VALUES (0), (1)) x(batch) GROUP BY 1, 2, 3, 4",
    "stream_running_verdicts": f"SELECT step, h.pred_label, {STREAM_VERDICT} AS verdict, (step + 1) * count(*) AS n_rows "
    "FROM hashed h JOIN streamed s USING (prompt_hash), (VALUES (0), (1)) x(step) GROUP BY 1, 2, 3",
    "run_counters": "SELECT m.*, x.*, CASE WHEN x.hits + x.misses > 0 THEN x.hits / (x.hits + x.misses)::DOUBLE * 100 ELSE 0.0::DOUBLE END AS hit_rate, v.* FROM "
    f"(SELECT total, correct, incorrect, uncertain FROM ({metrics(f'(SELECT r.verdict FROM hashed h JOIN ({SCORED_REVIEWS}) r USING (prompt_hash))')})) m, "
    "(SELECT count(l.prompt_hash) AS hits, count(*) - count(l.prompt_hash) AS misses, count(DISTINCT l.prompt_hash) AS persistent_hits, "
    "count(DISTINCT CASE WHEN l.prompt_hash IS NOT NULL OR s.error IS NULL THEN h.prompt_hash END) AS cached_prompts, "
    "count(*) FILTER (l.prompt_hash IS NOT NULL OR s.error IS NULL) AS rows_done "
    "FROM hashed h LEFT JOIN live l USING (prompt_hash) LEFT JOIN scored_checked s USING (prompt_hash)) x, "
    "(SELECT count(*) FILTER (suspicious) AS validation_failures, count(*) FILTER (rejected) AS invalid_labels_rejected FROM scored_checked WHERE error IS NULL) v",
}


def all_oracles() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
