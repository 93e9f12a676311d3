"""Plans on a document model and on decisions about its blocks (survey sections 2.9, 2.11, 2.12).

The model is a relation of blocks, one row each, given by the caller (plans.apply) or made from
the blocks of documents; decisions are given or made from events, as test scaffolding.
"""

from __future__ import annotations

from docstrata.functions import text as fn
from docstrata.operators import blocks as b

# The values that a patch may use.
BLOCK_TYPES = "('heading', 'body', 'list_item', 'caption', 'table', 'image', 'appendix', 'unknown')"
LIST_TYPES = "('lower_letter_paren', 'decimal_paren', 'bullet_dot', 'dash')"
TABLE_TYPES = "('data', 'code_sample', 'callout', 'layout', 'unknown')"
CAPTION_TYPES = "('table', 'figure', 'unknown')"
OPERATIONS = "('retype', 'adjust_level', 'set_restart', 'set_table_type', 'set_header_rows', 'set_caption_type', 'set_caption_text')"
RETYPE_FIELDS = {"heading": ("block_type", "level"), "body": ("block_type",), "list_item": ("block_type", "level", "list_type"), "caption": ("block_type", "caption_type", "label")}
ONE_FIELD = {"adjust_level": "level", "set_restart": "restart", "set_table_type": "table_type", "set_header_rows": "header_rows", "set_caption_type": "caption_type", "set_caption_text": "text"}
LOWEST_CONFIDENCE = "7e-1"
DEEPEST_LIST = 8
NO_HINT = r"[^一-鿿　-〿＀-￯\p{L}\p{N}_\s,.!?;:\x27\x22()（）+=\[\]-]"


def n(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def model(d) -> str:
    """WITH ... model (doc_id, pos, block_id, block_type, role, level, list_type, restart, text, raw, style, source_role, status, ilvl, num_list_type, unordered, group_id, family, family_source, table_type, header_rows, n_rows, caption_type, auto_generated, original_type, group_status, inferred_role)."""
    if d.has("model"):
        return f"WITH model AS (SELECT * FROM {d.table('model')})"
    return (
        b.units(d) + ", model AS (SELECT doc_id, pos, concat('b', CAST(i AS VARCHAR(20))) AS block_id, block_type, role, level, list_type, CASE WHEN block_type = 'list_item' THEN (i % 3 = 0) END AS restart, CASE WHEN block_type = 'caption' AND i % 2 = 0 THEN '' ELSE t END AS text, t AS raw, "
        "CASE i % 9 WHEN 1 THEN 'Heading 2' WHEN 4 THEN '附录标题' ELSE 'Normal' END AS style, CASE WHEN i % 17 = 0 THEN 'formula' END AS source_role, CASE i % 8 WHEN 1 THEN 'ignored' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'detected' END AS status, CAST(i % 2 AS INT) AS ilvl, 'decimal_paren' AS num_list_type, (i % 10 = 5) AS unordered, "
        "CASE WHEN block_type = 'body' THEN concat('g', CAST(CAST(floor(i / 4e0) AS BIGINT) AS VARCHAR(20))) END AS group_id, CASE WHEN floor(i / 4e0) % 2 = 0 THEN 'ordered' ELSE 'unordered' END AS family, CASE WHEN floor(i / 4e0) % 3 = 0 THEN 'visible_ordered_marker' ELSE 'semantic_default_ordered' END AS family_source, "
        "CASE WHEN block_type = 'table' THEN CASE i % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'layout' ELSE 'code_sample' END END AS table_type, CAST(CASE WHEN block_type = 'table' THEN 1 END AS INT) AS header_rows, CAST(CASE WHEN block_type = 'table' THEN 3 END AS INT) AS n_rows, caption_type, (block_type = 'caption' AND i % 2 = 0) AS auto_generated, CASE WHEN i % 19 = 0 THEN 'body' END AS original_type, CASE i % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' END AS group_status, CASE i % 7 WHEN 0 THEN 'list' WHEN 1 THEN 'body' END AS inferred_role FROM units)"
    )


def decisions(d) -> str:
    """, decisions (doc_id, idx, block_id, operation, confidence, fields, to_type, to_level, to_list_type, to_restart, to_table_type, to_header_rows, to_caption_type, to_text)."""
    if d.has("decisions"):
        return f", decisions AS (SELECT * FROM {d.table('decisions')})"
    ops = ["retype", "adjust_level", "set_restart", "set_table_type", "set_header_rows", "set_caption_type", "set_caption_text", "retype", "rename"]
    op = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(ops))
    fields = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ONE_FIELD.items())
    return (
        f", drawn AS (SELECT event_id, event_id % 211 AS doc_id, CASE event_id % 9 {op} END AS operation, CASE (event_id * 7) % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' WHEN 2 THEN 'caption' WHEN 3 THEN 'body' WHEN 4 THEN 'list_item' ELSE 'footer' END AS to_type FROM {d.table('events')}), "
        "decisions AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY event_id) - 1 AS INT) AS idx, CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('b', CAST(event_id % 7 AS VARCHAR(20))) END AS block_id, operation, (event_id % 20) / 20e0 AS confidence, "
        f"CASE WHEN operation = 'retype' THEN CASE WHEN event_id % 5 = 0 THEN 'block_type,style' WHEN to_type = 'list_item' THEN 'block_type,level,list_type' WHEN to_type = 'heading' THEN 'block_type,level' ELSE 'block_type' END WHEN event_id % 31 = 0 THEN 'id' ELSE CASE operation {fields} END END AS fields, to_type, "
        "CAST(event_id % 10 AS INT) AS to_level, CASE event_id % 4 WHEN 0 THEN 'dash' WHEN 1 THEN 'decimal_paren' WHEN 2 THEN 'lower_letter_paren' ELSE 'star' END AS to_list_type, (event_id % 2 = 0) AS to_restart, CASE event_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'layout' ELSE 'grid' END AS to_table_type, "
        "CAST(event_id % 5 AS INT) AS to_header_rows, CASE event_id % 2 WHEN 0 THEN 'figure' ELSE 'chart' END AS to_caption_type, concat('text ', CAST(event_id AS VARCHAR(20))) AS to_text FROM drawn)"
    )


def _without(x: str, names: tuple[str, ...]) -> str:
    out = f"concat(',', replace({x}, ',', ',,'), ',')"
    for name in names:
        out = f"replace({out}, ',{name},', '')"
    return out


def _checked(d) -> str:
    """model and decisions with errors (doc_id, idx, block_id, error): each rule that a decision breaks (V3, V4)."""
    unexpected = " ".join(f"WHEN '{k}' THEN {_without('fields', v)} <> ''" for k, v in RETYPE_FIELDS.items())
    one = " ".join(f"WHEN '{k}' THEN fields <> '{v}'" for k, v in ONE_FIELD.items())
    unordered = "to_list_type IN ('dash', 'bullet_dot')"
    known = f"present AND operation IN {OPERATIONS}"
    retype, single = f"{known} AND operation = 'retype'", f"{known} AND CASE operation {one.replace('<>', '=')} ELSE false END"
    as_list = f"{retype} AND to_type = 'list_item'"
    rules = {
        "missing_block_id": "block_id IS NULL OR block_id = ''",
        "unknown_block": "block_id <> '' AND NOT present",
        "operation_not_allowed": f"present AND operation NOT IN {OPERATIONS}",
        "invalid_block_type": f"{retype} AND to_type NOT IN {BLOCK_TYPES}",
        "heading_style_to_list": f"{as_list} AND style LIKE 'Heading%'",
        "ignored_numbering_to_list": f"{as_list} AND status = 'ignored'",
        "ambiguous_numbering_changed": f"{as_list} AND status = 'ambiguous' AND (to_level <> ilvl OR to_list_type <> num_list_type)",
        "unordered_marker_lost": f"{as_list} AND unordered AND NOT {unordered}",
        "list_family_changed": f"{as_list} AND group_id IS NOT NULL AND family_source <> 'semantic_default_ordered' AND CASE WHEN {unordered} THEN 'unordered' ELSE 'ordered' END <> family",
        "unexpected_fields": f"{retype} AND CASE to_type {unexpected} ELSE {_without('fields', ('block_type',))} <> '' END",
        "heading_level_out_of_range": f"{retype} AND to_type = 'heading' AND to_level NOT BETWEEN 1 AND 6",
        "list_level_out_of_range": f"{as_list} AND to_level NOT BETWEEN 0 AND {DEEPEST_LIST}",
        "invalid_list_type": f"{as_list} AND to_list_type NOT IN {LIST_TYPES}",
        "invalid_caption_type": f"{retype} AND to_type = 'caption' AND coalesce(to_caption_type, 'table') NOT IN {CAPTION_TYPES}",
        "fields_not_exact": f"{known} AND CASE operation {one} ELSE false END",
        "level_out_of_range": f"{single} AND operation = 'adjust_level' AND (to_level < CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END OR to_level > CASE WHEN block_type = 'heading' THEN 6 ELSE {DEEPEST_LIST} END)",
        "invalid_table_type": f"{single} AND operation = 'set_table_type' AND to_table_type NOT IN {TABLE_TYPES}",
        "header_rows_out_of_range": f"{single} AND operation = 'set_header_rows' AND to_header_rows NOT BETWEEN 0 AND coalesce(n_rows, 0)",
        "caption_type_unknown": f"{single} AND operation = 'set_caption_type' AND to_caption_type NOT IN {CAPTION_TYPES}",
        "caption_text_too_long": f"{single} AND operation = 'set_caption_text' AND length(to_text) > 100",
        "caption_not_generated": f"{known} AND operation = 'set_caption_text' AND NOT coalesce(auto_generated, false)",
        "caption_not_empty": f"{known} AND operation = 'set_caption_text' AND coalesce(text, '') <> ''",
        "caption_of_no_data_table": f"{known} AND operation = 'set_caption_text' AND coalesce(owner_type, 'unknown') <> 'data'",
    }
    ahead = " ".join(f"WHEN lead(block_type, {k}) OVER w = 'table' THEN lead(table_type, {k}) OVER w WHEN coalesce(lead(block_type, {k}) OVER w, 'end') NOT IN ('body', 'list_item') THEN NULL" for k in (1, 2, 3, 4))
    return (
        f"{model(d)}{decisions(d)}, owners AS (SELECT *, CASE {ahead} ELSE NULL END AS owner_type FROM model WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
        "matched AS (SELECT x.*, (m.block_id IS NOT NULL) AS present, m.block_type, m.style, m.status, m.ilvl, m.num_list_type, m.unordered, m.group_id, m.family, m.family_source, m.n_rows, m.auto_generated, m.text, m.owner_type FROM decisions x LEFT JOIN owners m ON m.doc_id = x.doc_id AND m.block_id = x.block_id), "
        f"broken AS ({d.each('doc_id, idx, block_id', [f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items()], 'matched')}), "
        "joined_groups AS (SELECT doc_id, group_id, count(DISTINCT block_id) AS named, count(DISTINCT CASE WHEN to_list_type IN ('dash', 'bullet_dot') THEN 'unordered' ELSE 'ordered' END) AS families, count(DISTINCT to_level) AS levels, min(idx) AS idx FROM matched WHERE operation = 'retype' AND to_type = 'list_item' AND group_id IS NOT NULL GROUP BY doc_id, group_id), "
        "group_sizes AS (SELECT doc_id, group_id, count(*) AS size FROM model WHERE group_id IS NOT NULL AND block_type = 'body' GROUP BY doc_id, group_id), "
        "group_checks AS (SELECT j.doc_id, j.group_id, j.idx, j.named, coalesce(s.size, 0) AS size, (j.named = coalesce(s.size, 0)) AS atomic, (j.families = 1 AND j.levels = 1) AS uniform FROM joined_groups j LEFT JOIN group_sizes s ON s.doc_id = j.doc_id AND s.group_id = j.group_id), "
        "errors AS (SELECT doc_id, idx, block_id, item AS error FROM broken UNION ALL SELECT doc_id, idx, group_id AS block_id, 'group_not_atomic' AS error FROM group_checks WHERE NOT atomic UNION ALL SELECT doc_id, idx, group_id AS block_id, 'group_mixed' AS error FROM group_checks WHERE NOT uniform)"
    )


def validate_patch(d):
    """Every rule that a decision breaks (V3, V4, J2); one error rejects a document's whole patch."""
    return f"{_checked(d)} SELECT doc_id, {n('idx', 'idx')}, block_id, error FROM errors"


def patch_status(d):
    """Whether a document's patch is taken: only without errors (V4)."""
    return f"{_checked(d)} SELECT x.doc_id, {n('count(*)', 'n_decisions')}, {n('max(coalesce(e.n, 0))', 'n_errors')}, (max(coalesce(e.n, 0)) = 0) AS valid FROM decisions x LEFT JOIN (SELECT doc_id, count(*) AS n FROM errors GROUP BY doc_id) e ON e.doc_id = x.doc_id GROUP BY x.doc_id"


def group_atomicity(d):
    """Groups that decisions retype, whether all their blocks are named, and alike."""
    return f"{_checked(d)} SELECT doc_id, group_id, {n('named', 'named')}, {n('size', 'size')}, atomic, uniform FROM group_checks"


def unexpected_fields(d):
    """Fields of a retyping that its target has no use for (U4)."""
    known = " ".join(f"WHEN '{k}' THEN {_without('fields', v)}" for k, v in RETYPE_FIELDS.items())
    left = f"CASE to_type {known} ELSE {_without('fields', ('block_type',))} END"
    return f"{model(d)}{decisions(d)} SELECT doc_id, {n('idx', 'idx')}, {d.replace(d.replace(left, '^,+|,+$'), ',+', chr(39) + ',' + chr(39))} AS unexpected FROM decisions WHERE operation = 'retype' AND {left} <> ''"


def _outcomes(d) -> str:
    return (
        f"{model(d)}{decisions(d)}, outcomes AS (SELECT x.*, CASE WHEN coalesce(x.confidence, 0e0) < {LOWEST_CONFIDENCE} THEN 'skipped' WHEN m.block_id IS NULL THEN 'error' ELSE 'applied' END AS outcome FROM decisions x LEFT JOIN model m ON m.doc_id = x.doc_id AND m.block_id = x.block_id)"
    )


def applied_rate(d):
    """The share of a document's decisions that were applied and not skipped."""
    one = lambda o: f"sum(CASE WHEN outcome = '{o}' THEN 1 ELSE 0 END)"
    return f"{_outcomes(d)} SELECT doc_id, {n(one('applied'), 'applied')}, {n(one('skipped'), 'skipped')}, {n(one('error'), 'errors')}, {one('applied')} / (1e0 * nullif({one('applied')} + {one('skipped')}, 0)) AS rate FROM outcomes GROUP BY doc_id"


def apply_patch(d):
    """The model after its decisions, one after the other (M6): the last to set a field wins, a retyping clears the others."""
    level = "CASE to_type WHEN 'heading' THEN CAST(coalesce(to_level, 1) AS VARCHAR(9)) WHEN 'list_item' THEN CAST(coalesce(to_level, 0) AS VARCHAR(9)) ELSE '' END"
    retyped = {
        "block_type": "to_type", "level": level, "role": "CASE WHEN to_type IN ('heading', 'body', 'list_item', 'caption') THEN to_type END", "list_type": "CASE WHEN to_type = 'list_item' THEN coalesce(to_list_type, 'lower_letter_paren') ELSE '' END",
        "restart": "CASE WHEN to_type = 'list_item' THEN 'false' ELSE '' END", "caption_type": "CASE WHEN to_type = 'caption' THEN coalesce(to_caption_type, 'table') ELSE '' END", "header_rows": "''", "table_type": "''",
    }
    items = [f"CASE WHEN operation = 'retype' THEN concat('{field}=', {value}) END" for field, value in retyped.items()]
    single = {"adjust_level": "CAST(to_level AS VARCHAR(9))", "set_restart": "CASE WHEN to_restart THEN 'true' ELSE 'false' END", "set_table_type": "to_table_type", "set_header_rows": "CAST(to_header_rows AS VARCHAR(9))", "set_caption_type": "to_caption_type", "set_caption_text": "to_text"}
    items += [f"CASE WHEN operation = '{op}' THEN concat('{ONE_FIELD[op]}=', {value}) END" for op, value in single.items()]
    final = lambda field, own: f"CASE WHEN max(CASE WHEN s.field = '{field}' THEN 1 ELSE 0 END) = 1 THEN nullif(max(CASE WHEN s.field = '{field}' THEN s.value END), '') ELSE max({own}) END AS {field}"
    own = {"block_type": "m.block_type", "role": "m.role", "level": "CAST(m.level AS VARCHAR(9))", "list_type": "m.list_type", "restart": "CASE WHEN m.restart THEN 'true' WHEN NOT m.restart THEN 'false' END", "table_type": "m.table_type", "header_rows": "CAST(m.header_rows AS VARCHAR(9))", "caption_type": "m.caption_type", "text": "m.text"}
    return (
        f"{_outcomes(d)}, assigned AS ({d.each('doc_id, block_id, idx', items, "(SELECT * FROM outcomes WHERE outcome = 'applied') o")}), "
        f"spelt AS (SELECT doc_id, block_id, idx, {d.extract('item', '^([a-z_]+)=', 1)} AS field, {d.replace('item', '^[a-z_]+=')} AS value FROM assigned), "
        "latest AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id, field ORDER BY idx DESC) AS k FROM spelt), sets AS (SELECT doc_id, block_id, field, value FROM latest WHERE k = 1) "
        f"SELECT m.doc_id, m.block_id, {', '.join(final(f, x) for f, x in own.items())}, (count(s.field) > 0) AS changed FROM model m LEFT JOIN sets s ON s.doc_id = m.doc_id AND s.block_id = m.block_id GROUP BY m.doc_id, m.block_id"
    )


def hint_texts(d):
    """Hints as a prompt may hold them (F28): 500 characters, known signs, single blanks."""
    clean = fn.strip(d, d.replace(d.replace("substring(hint, 1, 500)", NO_HINT), r"\s+", "' '"))
    source = d.table("hints") if d.has("hints") else f"(SELECT conv_id, turn, text AS hint FROM {d.table('conversations')})"
    return f"SELECT conv_id, {n('turn', 'turn')}, {clean} AS hint, (length(hint) > 500) AS truncated FROM {source} h WHERE hint IS NOT NULL"


def source_join(d):
    """Each block with the line that it comes from (J14): by place, lines without a block left out."""
    return f"{b.blocks(d)} SELECT x.doc_id, x.pos, x.block_type, (l.line = x.raw) AS same FROM blocks x LEFT JOIN deco_lines l ON l.doc_id = x.doc_id AND l.pos = x.pos"


# Audits of lists (A5, V9, J9) and small relations (PF1, SC20)

# The styles that the template has for items of each kind.
ITEM_STYLES = {"lower_letter_paren": "1.1一级列项-编号", "dash": "1.2一级列项-无编号", "decimal_paren": "2.1二级列项-有编号", "bullet_dot": "2.2二级列项-无编号"}


def origin_counts(d):
    """Where the items of a document come from (A5): the first origin that fits, zeros left out."""
    origin = (
        "CASE WHEN original_type IS NOT NULL AND original_type <> 'list_item' THEN 'llm' WHEN status = 'detected' THEN 'rules' WHEN group_status = 'auto' THEN 'semantic_group_rules' WHEN kind IS NOT NULL THEN 'text_marker' WHEN inferred_role IS NOT NULL AND inferred_role <> 'list' THEN 'normalization_fallback' ELSE 'rules' END"
    )
    return f"{model(d)}, items AS (SELECT *, {fn.list_kind(d, "coalesce(raw, text, '')")} AS kind FROM model WHERE block_type = 'list_item') SELECT doc_id, {origin} AS origin, {n('count(*)', 'n')} FROM items GROUP BY doc_id, {origin}"


def list_preservation(d):
    """Items of the model and of the rendered document, by order where both have as many (V9, J9), and what numbering says against the model."""
    expected = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ITEM_STYLES.items())
    wanted = "CASE WHEN list_type IN ('dash', 'bullet_dot') THEN CASE WHEN coalesce(level, 0) = 0 THEN 'dash' ELSE 'bullet_dot' END ELSE CASE WHEN coalesce(level, 0) = 0 THEN 'lower_letter_paren' ELSE 'decimal_paren' END END"
    rendered = (
        f"rendered AS (SELECT doc_id, style, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM {d.table('rendered')})"
        if d.has("rendered")
        else f"rendered AS (SELECT doc_id, CASE WHEN k % 6 = 0 THEN 'List Number' ELSE CASE {wanted} {expected} END END AS style, k, count(*) OVER (PARTITION BY doc_id) AS total FROM items WHERE doc_id % 3 <> 0 OR k > 1)"
    )
    return (
        f"{model(d)}, items AS (SELECT doc_id, level, list_type, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM model WHERE block_type = 'list_item'), {rendered}, "
        f"zipped AS (SELECT i.doc_id, i.total, r.total AS shown, CASE WHEN i.total = r.total AND r.style <> CASE {wanted.replace('list_type', 'i.list_type').replace('(level', '(i.level')} {expected} END THEN 1 ELSE 0 END AS wrong FROM items i LEFT JOIN rendered r ON r.doc_id = i.doc_id AND r.k = i.k), "
        "sums AS (SELECT doc_id, max(total) AS items_, coalesce(max(shown), 0) AS shown, sum(wrong) AS mismatches FROM zipped GROUP BY doc_id), "
        "sides AS (SELECT doc_id, sum(CASE WHEN block_type = 'list_item' AND status = 'ignored' THEN 1 ELSE 0 END) AS conflicts, sum(CASE WHEN block_type <> 'list_item' AND status = 'detected' THEN 1 ELSE 0 END) AS residue FROM model GROUP BY doc_id) "
        f"SELECT x.doc_id, {n('coalesce(s.items_, 0)', 'model_n')}, {n('coalesce(s.shown, 0)', 'rendered_n')}, {n('coalesce(s.mismatches, 0)', 'mismatches')}, {n('x.conflicts', 'conflicts')}, {n('x.residue', 'residue')} FROM sides x LEFT JOIN sums s ON s.doc_id = x.doc_id"
    )


def source_records(d):
    """What is known of a block's source as JSON, without what is empty (PF1)."""
    fields = {"raw_text": "raw", "role": "source_role", "style": "style", "status": "status"}
    parts = [f"CASE WHEN coalesce({x}, '') <> '' THEN concat('\"{name}\":', {d.quoted(x)}) END" for name, x in fields.items()]
    return f"{model(d)} SELECT doc_id, {n('pos', 'pos')}, concat('{{', concat_ws(',', {', '.join(parts)}), '}}') AS source FROM model"


# Requests and responses

PROTOCOL = "1.0"  # fixed value: the version of the protocol


def input_hash(d) -> str:
    """The hash of what a request asks (F26): its canonical JSON, names sorted."""
    named = ["capability", "phase", "prompt", "protocol_version", "request_id", "run_id"]
    parts = ", ".join(f"'{chr(44) if k else '{'}\"{name}\":', {d.quoted(name)}" for k, name in enumerate(named))
    return f"concat('sha256:', {d.sha256(f"concat({parts}, '}}')")})"


def _exchange(d) -> str:
    """WITH requests and responses, given or made from conversations: a turn of a user and the next of the assistant."""
    if d.has("requests"):
        return f"WITH requests AS (SELECT * FROM {d.table('requests')}), responses AS (SELECT * FROM {d.table('responses')})"
    key = "concat(CAST(conv_id AS VARCHAR(20)), '-', CAST(turn AS VARCHAR(20)))"
    return (
        f"WITH turns AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS nth FROM {d.table('conversations')}), "
        f"asked AS (SELECT '{PROTOCOL}' AS protocol_version, concat('run', CAST(conv_id % 3 AS VARCHAR(9))) AS run_id, concat({key}, '-', CAST(nth AS VARCHAR(9))) AS request_id, 'A' AS phase, 'list_detect' AS capability, text AS prompt, answer, conv_id, nth FROM turns), "
        f"hashed AS (SELECT *, {input_hash(d)} AS made FROM asked), requests AS (SELECT protocol_version, run_id, request_id, phase, capability, prompt, CASE WHEN conv_id % 13 = 5 THEN 'sha256:0' ELSE made END AS input_hash FROM hashed), "
        "responses AS (SELECT nth AS seq, CASE WHEN conv_id % 11 = 3 THEN '0.9' ELSE protocol_version END AS protocol_version, request_id, answer AS raw_response, CASE WHEN nth % 5 = 0 THEN 'sha256:1' ELSE made END AS input_hash FROM hashed WHERE conv_id % 7 <> 2 "
        "UNION ALL SELECT nth + 100 AS seq, protocol_version, request_id, concat('{', CAST(nth AS VARCHAR(9)), '}') AS raw_response, made AS input_hash FROM hashed WHERE nth % 10 = 0)"
    )


def request_hash(d):
    """The recomputed hash of each request, and whether the recorded one is the same."""
    return f"{_exchange(d)} SELECT request_id, {input_hash(d)} AS input_hash, (input_hash = {input_hash(d)}) AS same FROM requests"


def response_status(d):
    """What became of each request (J12, V6): the last response to it counts, and must answer what was asked."""
    return (
        f"{_exchange(d)}, checked AS (SELECT request_id, input_hash AS recorded, {input_hash(d)} AS expected FROM requests), latest AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq DESC) AS k FROM responses) "
        f"SELECT q.request_id, CASE WHEN r.request_id IS NULL THEN 'missing_response' WHEN r.protocol_version IS NULL OR r.protocol_version <> '{PROTOCOL}' OR r.raw_response IS NULL OR coalesce(r.input_hash, '') = '' THEN 'verification_error' WHEN q.recorded <> q.expected OR r.input_hash <> q.expected THEN 'verification_error' "
        f"WHEN NOT {d.matches('r.raw_response', '[{]')} THEN 'parse_error' ELSE 'ok' END AS status FROM checked q LEFT JOIN latest r ON r.request_id = q.request_id AND r.k = 1"
    )


# Tables of cells (SC3, SC4, PF12 to PF17, A8, A11)

# What the first 240 characters of a code sample hold.
CODE_MARKS = "(?i)POST |GET |PUT |DELETE |PATCH |HTTP/1[.]|<<HEADER>>|CONTENT-TYPE:|CONTENT-MD5|<[?]XML|PLAIN TEXT|REQUEST BODY|RESPONSE BODY"


def _payload(d, x: str) -> str:
    probe = f"substring({x}, 1, 240)"
    return f"({d.matches(x, r'^[{\[<]')} OR {d.matches(probe, CODE_MARKS)} OR ({probe} LIKE '%{{%' AND ({probe} LIKE '%\"%' OR {probe} LIKE '%:%')) OR ({probe} LIKE '%<%' AND {probe} LIKE '%>%' AND {probe} LIKE '%</%'))"


def table_parts(d) -> str:
    """, table_cells (doc_id, tid, r, n, text) of the rows behind the separator, and semantics (table_type and its evidence)."""
    bare = d.replace(d.replace("t", "^[|]+"), "[|]+$")
    return (
        ", table_lines AS (SELECT doc_id, pos, t, sum(CASE WHEN table_start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS tid FROM blocks WHERE block_type = 'table'), "
        "ordered_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tid ORDER BY pos) AS nth FROM table_lines), "
        f"table_rows AS (SELECT doc_id, tid, nth - 3 AS r, concat({bare}, '|') AS cells FROM ordered_lines WHERE nth > 2), raw_cells AS ({d.matches_all('table_rows', 'doc_id, tid, r', 'cells', '([^|]*)[|]')}), "
        f"table_cells AS (SELECT doc_id, tid, r, n, {fn.strip(d, 'item')} AS text FROM raw_cells), "
        f"cell_facts AS (SELECT x.doc_id, x.tid, count(c.n) AS n_cells, sum(CASE WHEN c.text <> '' THEN 1 ELSE 0 END) AS n_texts, coalesce(sum(CASE WHEN {_payload(d, 'c.text')} THEN 1 ELSE 0 END), 0) AS n_payload, max(CASE WHEN {_payload(d, 'c.text')} THEN length(c.text) END) AS longest "
        "FROM (SELECT DISTINCT doc_id, tid FROM table_lines) x LEFT JOIN table_cells c ON c.doc_id = x.doc_id AND c.tid = x.tid GROUP BY x.doc_id, x.tid), "
        "semantics AS (SELECT *, CASE WHEN n_cells = 1 AND n_texts = 0 THEN 'layout' WHEN n_cells = 1 AND n_payload = 1 THEN 'code_sample' WHEN n_cells = 1 THEN 'callout' WHEN n_payload > 0 AND (n_payload >= 25e-2 * n_texts OR longest >= 80) THEN 'code_sample' ELSE 'data' END AS table_type FROM cell_facts)"
    )


def _table_cells(d) -> str:
    return b.blocks(d) + table_parts(d)


def table_class(d):
    """The kind of each table by its cells (PF12 to PF14, PF16, A11), whether it takes a caption (PF17)."""
    return f"{_table_cells(d)} SELECT doc_id, {n('tid', 'tid')}, {n('n_cells', 'n_cells')}, {n('n_payload', 'n_payload')}, table_type, (table_type = 'data') AS caption_eligible, {n('CASE WHEN table_type = ' + chr(39) + 'data' + chr(39) + ' THEN 1 ELSE 0 END', 'header_rows')} FROM semantics"


def table_cells(d):
    """Cells of tables with their role (SC3, SC4): code, header or body."""
    return f"{_table_cells(d)} SELECT c.doc_id, {n('c.tid', 'tid')}, {n('c.r', 'r')}, {n('c.n', 'c')}, c.text, CASE WHEN s.table_type = 'code_sample' THEN 'code' WHEN s.table_type = 'data' AND c.r < 1 THEN 'header' ELSE 'body' END AS cell_role FROM table_cells c JOIN semantics s ON s.doc_id = c.doc_id AND s.tid = c.tid"


def table_type_counts(d):
    """Tables of a document by kind (A8), and those whose kind and caption do not fit."""
    return (
        f"{_table_cells(d)}{b.neighbours(d)}, starts AS (SELECT doc_id, pos, before, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS tid FROM neighbours WHERE table_start) "
        f"SELECT s.doc_id, s.table_type, {n('count(*)', 'n')}, {n("sum(CASE WHEN (s.table_type = 'data') <> (coalesce(x.before, '') = 'caption') THEN 1 ELSE 0 END)", 'n_issues')} FROM semantics s JOIN starts x ON x.doc_id = s.doc_id AND x.tid = s.tid GROUP BY s.doc_id, s.table_type"
    )


# Markers of no known list

KNOWN_MARKERS = "[-–—－•·●○■□▪▫◆◇▶▷►▻※★☆✓✔]"
EXCLUDED_MARKERS = r"[#*_~`@$%^&+=|\\/:;,.?!，。：；？！、“”‘’《》【】()\[\]{}<>]"
ORDERED_PREFIX = r"^([A-Za-z]\)|[0-9]+[.．]{1,2}([^.．0-9]|$)|[0-9]+\)|（[0-9]+）|\([0-9]+\))"


def unordered_candidates(d):
    """Lines that begin with a sign that may mark an item (F14), with what stands behind it, and how often the section has it (A4)."""
    first = "substring(t, 1, 1)"
    size = f"CASE WHEN substring(t, 2, 1) <> {first} THEN 1 WHEN substring(t, 3, 1) <> {first} THEN 2 WHEN length(t) >= 3 THEN 3 ELSE 2 END"
    rest = "substring(t, k + 1)"
    content = fn.strip(d, rest)
    spaced, line = d.matches(rest, r"^\s"), d.matches("first_", "^[-–—－]$")
    return (
        f"{b.sections(d)}, led AS (SELECT doc_id, pos, sid, t, {first} AS first_, {size} AS k FROM sections WHERE block_type = 'body' AND length(t) >= 2 AND NOT {d.matches('t', ORDERED_PREFIX)} AND {d.matches('t', r'^[\p{P}\p{S}\p{Co}]')} AND NOT {d.matches('t', '^' + EXCLUDED_MARKERS)}), "
        f"held AS (SELECT doc_id, pos, sid, first_, k, substring(t, 1, k) AS marker, {content} AS content, {spaced} AS spaced, {line} AS line_ FROM led) "
        f"SELECT doc_id, pos, marker, content, {d.matches('first_', '^' + KNOWN_MARKERS + '$')} AS known, spaced, {n('count(*) OVER (PARTITION BY doc_id, sid, marker)', 'n_in_section')} FROM held "
        f"WHERE {d.matches('content', r'[\p{L}\p{N}]')} AND NOT (line_ AND (k >= 3 OR ({d.matches('content', '^[0-9]')} AND NOT spaced))) AND ({d.matches('first_', '^' + KNOWN_MARKERS + '$')} OR spaced OR {d.matches('first_', r'^\p{So}$')})"
    )


# Normalization


def normalize_model(d):
    """The model in its normal form, and the repairs that lead there, in order (M1 but for cells of tables)."""
    raw = fn.strip(d, "coalesce(raw, text, '')")
    hier = lambda x, num: fn.hierarchical_level(d, x, num)
    shallow = lambda x: f"CASE WHEN {x} IN ('dash', 'bullet_dot') THEN CASE WHEN level2 = 0 THEN 'dash' ELSE 'bullet_dot' END ELSE CASE WHEN level2 = 0 THEN 'lower_letter_paren' ELSE 'decimal_paren' END END"
    of_kind = lambda k: f"CASE {k} WHEN 'decimal' THEN 'decimal_paren' WHEN 'dash' THEN 'dash' WHEN 'bullet2' THEN 'bullet_dot' ELSE 'lower_letter_paren' END"
    note = fn.strip(d, d.replace("text", fn.NOTE))
    repairs = [
        "CASE WHEN to_appendix_style THEN 'source_style_retyped_as_appendix' END",
        "CASE WHEN rule = 'list_heading' THEN 'list_item_retyped_as_hierarchical_heading' WHEN rule = 'list_body' THEN 'invalid_list_style_retyped_as_body' END",
        "CASE WHEN was_body AND promoted THEN 'body_role_promoted' END", "CASE WHEN was_body AND text_note <> text0 THEN 'note_prefix_normalized' END",
        "CASE rule WHEN 'appendix' THEN 'body_retyped_as_appendix' WHEN 'heading' THEN 'body_retyped_as_heading' WHEN 'numbered' THEN 'body_retyped_from_source_numbering' WHEN 'list' THEN 'body_retyped_as_list_item' WHEN 'caption' THEN 'body_retyped_as_caption' END",
        "CASE WHEN final_type = 'heading' AND rule = 'keep' AND level2 > 0 AND text2 <> text0 THEN 'heading_manual_number_removed' END",
        "CASE WHEN final_type = 'list_item' AND rule IN ('keep', 'numbered') AND text2 <> text0 THEN 'list_manual_marker_removed' END",
        f"CASE WHEN final_type = 'list_item' AND coalesce(given_list_type, '') NOT IN {LIST_TYPES} THEN 'list_type_normalized' END", "CASE WHEN final_type = 'list_item' AND list_type1 <> list_type2 THEN 'list_type_aligned_to_wx_level' END",
        "CASE WHEN final_type = 'list_item' AND coalesce(restart1, false) <> restart2 THEN 'list_restart_normalized' END",
        "CASE WHEN final_type = 'table' AND table_type IN ('code_sample', 'callout', 'layout') AND coalesce(header_rows, 0) <> 0 THEN 'non_data_table_header_rows_zero' END",
    ]
    return (
        f"{model(d)}, read_ AS (SELECT *, coalesce(text, '') AS text0, {raw} AS raw0, {fn.dotted_number(d, raw)} AS raw_num, {fn.dotted_number(d, 'coalesce(text, ' + chr(39) * 2 + ')')} AS num FROM model), "
        f"asked AS (SELECT *, {hier('raw0', 'raw_num')} AS raw_hier, {hier('text0', 'num')} AS hier, {fn.list_kind(d, 'raw0')} AS raw_kind, {fn.list_kind(d, 'text0')} AS kind, {fn.is_formula(d, 'text0')} AS formula, {d.matches('text0', fn.APPENDIX)} AS titled, {d.matches('text0', '^[图表]')} AS captioned, "
        f"(replace(style, ' ', '') = '附录标题' AND block_type <> 'appendix') AS to_appendix_style, (source_role IN ('note', 'numbered_note', 'formula') AND coalesce(role, '') <> source_role AND block_type = 'body') AS promoted0, CASE WHEN block_type = 'body' THEN {note} ELSE text END AS text_note0 FROM read_), "
        f"ranked AS (SELECT *, {fn.heading_level(d, 'text0')} AS text_level, coalesce(text_note0, '') AS text_note, (promoted0 OR (block_type = 'body' AND formula AND coalesce(role, '') NOT IN ('formula', 'note', 'numbered_note'))) AS promoted, CASE WHEN promoted0 THEN source_role WHEN formula AND block_type = 'body' AND coalesce(role, '') NOT IN ('note', 'numbered_note') THEN 'formula' ELSE role END AS role1 FROM asked), "
        "ruled AS (SELECT *, CASE WHEN to_appendix_style THEN 'style' WHEN block_type = 'list_item' AND raw_hier IS NOT NULL THEN 'list_heading' WHEN block_type = 'list_item' AND status = 'ignored' AND raw_kind IS NULL THEN 'list_body' WHEN block_type <> 'body' THEN 'keep' WHEN role1 IN ('note', 'numbered_note') THEN 'note' WHEN titled THEN 'appendix' WHEN hier IS NOT NULL THEN 'heading' "
        "WHEN status = 'detected' THEN 'numbered' WHEN kind IS NOT NULL THEN 'list' WHEN text_level IS NOT NULL THEN 'heading' WHEN captioned THEN 'caption' ELSE 'keep' END AS rule FROM ranked), "
        "typed_ AS (SELECT *, (block_type = 'body' AND NOT to_appendix_style) AS was_body, CASE rule WHEN 'style' THEN 'appendix' WHEN 'appendix' THEN 'appendix' WHEN 'list_heading' THEN 'heading' WHEN 'heading' THEN 'heading' WHEN 'list_body' THEN 'body' WHEN 'numbered' THEN 'list_item' WHEN 'list' THEN 'list_item' WHEN 'caption' THEN 'caption' ELSE block_type END AS final_type, "
        "CASE rule WHEN 'list_heading' THEN raw_hier WHEN 'heading' THEN coalesce(hier, text_level) WHEN 'numbered' THEN coalesce(ilvl, 0) WHEN 'list' THEN CASE WHEN kind IN ('decimal', 'bullet2') THEN 1 ELSE 0 END WHEN 'list_body' THEN NULL ELSE coalesce(level, 0) END AS level2, "
        f"CASE rule WHEN 'numbered' THEN num_list_type WHEN 'list' THEN {of_kind('kind')} ELSE list_type END AS given_list_type, CASE rule WHEN 'numbered' THEN false WHEN 'list' THEN false ELSE restart END AS restart1 FROM ruled), "
        f"texted AS (SELECT *, CASE WHEN coalesce(given_list_type, '') IN {LIST_TYPES} THEN given_list_type ELSE {of_kind('kind')} END AS list_type1, CASE WHEN rule = 'list_heading' THEN {fn.strip_heading(d, 'raw0', 'CASE WHEN raw_hier IS NOT NULL THEN raw_num ELSE ' + chr(39) * 2 + ' END')} "
        f"WHEN final_type = 'heading' AND level2 > 0 THEN {fn.strip_heading(d, 'text0', fn.OWN_NUMBER)} WHEN rule = 'list_body' THEN raw0 WHEN final_type = 'list_item' THEN {fn.strip_list(d, 'text0')} WHEN was_body THEN text_note ELSE text0 END AS text2 FROM typed_), "
        f"aligned AS (SELECT *, {shallow('list_type1')} AS list_type2, sum(CASE WHEN final_type = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM texted), "
        "started AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run, final_type, level2, list_type2 ORDER BY pos) = 1) AS restart2 FROM aligned), "
        f"told AS (SELECT *, concat_ws(',', {', '.join(repairs)}) AS repairs FROM started) "
        f"SELECT doc_id, {n('pos', 'pos')}, final_type AS block_type, CASE WHEN final_type = 'heading' AND rule <> 'keep' THEN 'heading' WHEN final_type = 'appendix' THEN NULL ELSE role1 END AS role, {n('CASE WHEN final_type IN (' + chr(39) + 'heading' + chr(39) + ', ' + chr(39) + 'list_item' + chr(39) + ') THEN level2 END', 'level')}, CASE WHEN final_type = 'list_item' THEN list_type2 END AS list_type, CASE WHEN final_type = 'list_item' THEN restart2 END AS restart, text2 AS text, repairs FROM told"
    )


PLANS = {f.__name__: f for f in (validate_patch, patch_status, group_atomicity, unexpected_fields, applied_rate, apply_patch, hint_texts, source_join, normalize_model, request_hash, response_status, table_class, table_cells, table_type_counts, unordered_candidates, origin_counts, list_preservation, source_records)}
