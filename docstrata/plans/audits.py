"""Normalization, audits and reports over the blocks relation (survey sections 2.9, 2.10 and parts of 2.1, 2.3, 2.7, 2.12).

Rendered output is simulated: a block's style is what its role maps to, and blocks whose
place is divisible by seven take a style that no template knows, so that audits have findings.
"""

from __future__ import annotations

from docstrata.functions import text as fn
from docstrata.operators import blocks as b

STYLE = (
    "CASE WHEN block_type = 'heading' THEN concat('Heading ', CAST(greatest(level, 1) AS VARCHAR(4))) WHEN block_type = 'list_item' AND list_type IN ('lower_letter_paren', 'decimal_paren') THEN '1.1一级列项-编号' "
    "WHEN block_type = 'list_item' THEN '1.2一级列项-无编号' WHEN block_type = 'caption' THEN 'Caption' WHEN block_type = 'table' THEN 'Table' WHEN block_type = 'appendix' THEN '附录标题' WHEN role IN ('note', 'numbered_note') THEN '注释' WHEN role = 'formula' THEN '公式' ELSE 'Normal' END"
)


def n(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def _normal(d) -> str:
    """blocks with their normalized text and the repair that made it."""
    return (
        b.blocks(d) + f", normal AS (SELECT *, CASE WHEN block_type = 'heading' THEN {fn.strip_heading(d, 't', fn.OWN_NUMBER)} WHEN block_type = 'list_item' THEN {fn.strip_list(d, 't')} "
        f"WHEN role = 'note' THEN {fn.strip(d, d.replace('t', fn.NOTE))} ELSE t END AS t2, CASE WHEN block_type = 'heading' THEN 'heading_number_removed' WHEN block_type = 'list_item' THEN 'list_marker_removed' WHEN role = 'note' THEN 'note_prefix_removed' END AS repair FROM blocks)"
    )


def _rendered(d) -> str:
    return b.blocks(d) + f", rendered AS (SELECT *, CASE WHEN pos % 7 = 0 THEN 'Loose' ELSE {STYLE} END AS style FROM blocks)"


def repairs(d):
    """Before and after of each block that normalization changes (M1)."""
    return f"{_normal(d)} SELECT doc_id, pos, repair AS type, t AS before, t2 AS after FROM normal WHERE repair IS NOT NULL AND t2 <> t"


def repair_counts(d):
    return f"{_normal(d)} SELECT repair AS type, {n('count(*)', 'n')}, {n('count(DISTINCT doc_id)', 'n_docs')} FROM normal WHERE repair IS NOT NULL AND t2 <> t GROUP BY repair"


def style_usage(d):
    """Styles in use that the template does not allow (A21, V15): an anti join."""
    allowed = " UNION ALL ".join(f"SELECT '{s}' AS style" for s in ("Heading 1", "Heading 2", "Heading 3", "Heading 4", "Heading 5", "Normal", "Caption", "Table", "附录标题", "注释", "公式", "1.1一级列项-编号", "1.2一级列项-无编号"))
    return f"{_rendered(d)}, allowed AS ({allowed}) SELECT r.doc_id, r.style, {n('count(*)', 'n')} FROM rendered r WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.style = r.style) GROUP BY r.doc_id, r.style"


def style_roles(d):
    """Role of a style by its normalized name, else null (PF20, F4, F20)."""
    name = "lower(replace(style, ' ', ''))"
    return f"{_rendered(d)} SELECT style, CASE WHEN {name} LIKE 'heading%' THEN 'heading' WHEN {name} = '附录标题' THEN 'appendix_title' WHEN {name} = 'caption' THEN 'caption' END AS role, {n('CASE WHEN ' + d.matches('style', '^Heading [0-9]+$') + ' THEN ' + d.extract('style', '([0-9]+)$', 1) + ' END', 'level')}, {n('count(*)', 'n')} FROM rendered GROUP BY style"


def note_preservation(d):
    """The k-th note of a text against the k-th rendered block with that text."""
    return (
        f"{_rendered(d)}, m AS (SELECT doc_id, t, role, row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS k FROM rendered WHERE role IN ('note', 'numbered_note')), o AS (SELECT doc_id, t, style, row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS k FROM rendered WHERE style <> 'Loose') "
        f"SELECT m.doc_id, {n('count(*)', 'n_notes')}, {n('sum(CASE WHEN o.k IS NULL THEN 1 ELSE 0 END)', 'n_missing')}, {n('sum(CASE WHEN o.style <> ' + chr(39) + '注释' + chr(39) + ' THEN 1 ELSE 0 END)', 'n_mismatched')} FROM m LEFT JOIN o ON o.doc_id = m.doc_id AND o.t = m.t AND o.k = m.k GROUP BY m.doc_id"
    )


def caption_counts(d):
    """Captions expected and rendered, by type, with zeros."""
    return (
        f"{_rendered(d)}, kinds AS (SELECT 'table' AS caption_type UNION ALL SELECT 'figure' AS caption_type), e AS (SELECT caption_type, count(*) AS n FROM rendered WHERE block_type = 'caption' GROUP BY caption_type), a AS (SELECT caption_type, count(*) AS n FROM rendered WHERE style = 'Caption' GROUP BY caption_type) "
        f"SELECT k.caption_type, {n('coalesce(e.n, 0)', 'expected')}, {n('coalesce(a.n, 0)', 'rendered')}, {n('greatest(coalesce(e.n, 0) - coalesce(a.n, 0), 0)', 'missing')} FROM kinds k LEFT JOIN e ON e.caption_type = k.caption_type LEFT JOIN a ON a.caption_type = k.caption_type"
    )


def output_structure(d):
    """First block, titles and headings of a document against the output contract."""
    return (
        f"{_rendered(d)}, f AS (SELECT doc_id, block_type, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(CASE WHEN role = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS titles FROM rendered) "
        f"SELECT doc_id, (block_type = 'heading') AS heading_first, {n('titles', 'titles')}, (titles = 1) AS one_title FROM f WHERE k = 1"
    )


def residue(d):
    """Markers that rendered text still shows (V8, V1)."""
    return f"{_rendered(d)} SELECT doc_id, pos, CASE WHEN block_type = 'heading' THEN 'heading_residue' ELSE 'list_residue' END AS issue, substring(t, 1, 45) AS text FROM rendered WHERE (block_type = 'heading' AND {fn.residual_number(d, 't')}) OR (block_type = 'list_item' AND kind IS NOT NULL)"


def appendix_header_merge(d):
    """An appendix line and the caption or body after it as one title."""
    return f"{b.blocks(d)}{b.neighbours(d)}, nx AS (SELECT doc_id, pos, t, block_type, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS nt, after FROM neighbours) SELECT doc_id, pos, CASE WHEN after = 'body' THEN concat(t, ' ', nt) ELSE t END AS title FROM nx WHERE block_type = 'appendix'"


def excluded_positions(d):
    """Contents entries and front matter, which later stages do not see (U1, J7, PF2)."""
    return (
        f"{b.blocks(d)}, first_head AS (SELECT doc_id, min(pos) AS p FROM blocks WHERE block_type = 'heading' GROUP BY doc_id), gone AS (SELECT doc_id, pos FROM blocks WHERE length(t) < 200 AND {d.matches('t', fn.TOC_ENTRY)} "
        "UNION SELECT x.doc_id, x.pos FROM blocks x JOIN first_head h ON h.doc_id = x.doc_id AND x.pos < h.p) "
        f"SELECT x.doc_id, {n('count(*)', 'left_n')} FROM blocks x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.pos = x.pos) GROUP BY x.doc_id"
    )


def title_injection(d):
    """The first heading prepended as title, headings of level 0 left out (M4)."""
    return (
        f"{b.blocks(d)}, heads AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM blocks WHERE block_type = 'heading') "
        f"SELECT doc_id, {n('-1', 'pos')}, 'title' AS role, t FROM heads WHERE k = 1 UNION ALL SELECT doc_id, {n('pos', 'pos')}, role, t FROM blocks WHERE NOT (block_type = 'heading' AND level <= 0)"
    )


def template_roles(d):
    """The first alias of each role that the styles in use hold."""
    aliases = " UNION ALL ".join(f"SELECT '{r}' AS role, '{s}' AS style, {k} AS priority" for r, s, k in (("body", "正文", 1), ("body", "Normal", 2), ("caption", "题注", 1), ("caption", "Caption", 2), ("toc", "TOC 1", 1)))
    return f"{_rendered(d)}, aliases AS ({aliases}), found AS (SELECT a.role, a.style, row_number() OVER (PARTITION BY a.role ORDER BY a.priority) AS k FROM aliases a WHERE EXISTS (SELECT 1 FROM rendered r WHERE r.style = a.style)) SELECT x.role, f.style, (f.style IS NULL) AS missing FROM (SELECT DISTINCT role FROM aliases) x LEFT JOIN found f ON f.role = x.role AND f.k = 1"


def prompt_texts(d):
    """Caption targets in batches of 15 with their texts, cut to 12,000 characters, 40 % of them from the head."""
    return (
        f"{b.blocks(d)}, c AS (SELECT doc_id, pos, t, floor((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) / 15e0) AS batch FROM blocks WHERE block_type IN ('caption', 'heading')), "
        f"p AS (SELECT doc_id, batch, count(*) AS members, {d.listed('substring(t, 1, 120)', 'pos')} AS body FROM c GROUP BY doc_id, batch) "
        f"SELECT doc_id, {n('batch', 'batch')}, {n('members', 'members')}, CASE WHEN length(body) <= 12000 THEN body ELSE concat(substring(body, 1, 4800), right(body, 7200)) END AS prompt, concat('sha256:', {d.sha256('body')}) AS input_hash, {n('ceil(length(body) / 4e0)', 'tokens')} FROM p"
    )


def report_rows(d):
    """The report: up to 20 rows of each kind of repair, and their number (SC17, S4)."""
    changed = "repair IS NOT NULL AND t2 <> t"  # the rank is limited before the exchange, the totals are combined there
    return (
        f"{_normal(d)}, totals AS (SELECT repair, count(*) AS total FROM normal WHERE {changed} GROUP BY repair), "
        f"r AS (SELECT repair, doc_id, pos, substring(t, 1, 120) AS text, row_number() OVER (PARTITION BY repair ORDER BY doc_id, pos) AS k FROM normal WHERE {changed}), top AS (SELECT * FROM r WHERE k <= 20) "
        f"SELECT x.repair, {n('x.k', 'k')}, {n('y.total', 'total')}, x.doc_id, x.pos, x.text FROM top x JOIN totals y ON y.repair = x.repair"
    )


def review_validation(d):
    """Decisions that a review rejects, with the first reason (V5): target, duplicate, stale value, confidence."""
    return (
        f"WITH targets AS (SELECT event_id AS target, event_type AS kind, value FROM {d.table('events')} WHERE event_id % 3 = 0), "
        f"decisions AS (SELECT event_id, event_id - event_id % 3 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS target, event_type AS kind, value, row_number() OVER (PARTITION BY event_id - event_id % 3 ORDER BY event_id) AS nth FROM {d.table('events')} WHERE event_id % 3 <> 0) "
        "SELECT x.event_id, CASE WHEN t.target IS NULL THEN 'unknown_target' WHEN x.nth > 1 THEN 'duplicate' WHEN x.kind <> t.kind THEN 'stale_from' ELSE 'low_confidence' END AS error FROM decisions x LEFT JOIN targets t ON t.target = x.target WHERE t.target IS NULL OR x.nth > 1 OR x.kind <> t.kind OR x.value < 10"
    )


def _decided(d) -> str:
    """Blocks with idx, their place from 0 among all, and decisions that were applied to them, simulated from events."""
    return (
        f"{b.blocks(d)}, placed AS (SELECT doc_id, pos, block_type, level, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx FROM blocks), "
        "applied AS (SELECT user_id AS doc_id, event_id % 40 AS pos, event_id AS nth, CASE event_id % 3 WHEN 0 THEN 'adjust_level' ELSE 'retype' END AS op, "
        "CASE event_id % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' WHEN 2 THEN 'caption' ELSE 'body' END AS to_type, "
        f"CASE WHEN event_id % 7 < 4 THEN 'body' ELSE 'list_item' END AS from_type FROM {d.table('events')})"
    )


def level_overrides(d):
    """Levels of headings that a decision levelled or made headings, by place (M8, J18): a semi join."""
    return f"{_decided(d)} SELECT doc_id, {n('idx', 'idx')}, {n('level', 'level')} FROM placed p WHERE block_type = 'heading' AND EXISTS (SELECT 1 FROM applied x WHERE x.doc_id = p.doc_id AND x.pos = p.pos AND (x.op = 'adjust_level' OR x.to_type = 'heading'))"


def role_overrides(d):
    """The type that the last decision to change one gave a block, by place."""
    return (
        f"{_decided(d)}, last AS (SELECT doc_id, pos, to_type, row_number() OVER (PARTITION BY doc_id, pos ORDER BY nth DESC) AS k FROM applied WHERE op = 'retype' AND to_type <> from_type) "
        f"SELECT p.doc_id, {n('p.idx', 'idx')}, x.to_type AS role FROM placed p JOIN last x ON x.doc_id = p.doc_id AND x.pos = p.pos WHERE x.k = 1"
    )


PLANS = {
    f.__name__: f
    for f in (
        repairs, repair_counts, style_usage, style_roles, note_preservation, caption_counts, output_structure, residue,
        appendix_header_merge, excluded_positions, title_injection, template_roles, prompt_texts, report_rows, review_validation,
        level_overrides, role_overrides,
    )
}
