"""Every query of the engine with its oracle.

A plan is a function of a dialect (plans.dialect). Spark runs the one spelling, the oracle the
other, on another engine; the expected values of the text rules are tested on literals too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstrata.functions import text as fn
from docstrata.operators import blocks as b
from docstrata.plans import audits, models, records
from docstrata.plans.dialect import Ansi, Spark

PLANS: dict[str, Callable] = {}


def plan(f: Callable) -> Callable:
    PLANS[f.__name__] = f
    return f


def n(x: str, name: str) -> str:
    """A count or integer as BIGINT, the same in both engines."""
    return f"CAST({x} AS BIGINT) AS {name}"


# Scalars and classification (F1-F22, PF3-PF21, A1)


@plan
def block_type_counts(d):
    return f"{b.blocks(d)} SELECT x.lang, b.block_type, b.role, {n('count(*)', 'n')} FROM blocks b JOIN {d.table('documents')} x ON x.doc_id = b.doc_id GROUP BY x.lang, b.block_type, b.role"


@plan
def block_counts(d):
    """Blocks of a document by type, a table being one (A1)."""
    return f"{b.units(d)} SELECT doc_id, block_type, {n('count(*)', 'n')} FROM units GROUP BY doc_id, block_type"


@plan
def hier_heading_levels(d):
    return f"{b.blocks(d)} SELECT doc_id, pos, num, {n('hier', 'level')} FROM blocks WHERE num <> ''"


@plan
def heading_levels(d):
    return f"{b.blocks(d)} SELECT doc_id, pos, {n('level', 'level')}, role FROM blocks WHERE block_type = 'heading'"


@plan
def strip_heading(d):
    return f"{b.blocks(d)} SELECT doc_id, pos, {fn.strip_heading(d, 't', fn.OWN_NUMBER)} AS text FROM blocks WHERE block_type = 'heading'"


@plan
def residual_numbers(d):
    return f"{b.blocks(d)} SELECT doc_id, pos, {fn.residual_number(d, 't')} AS residual FROM blocks"


@plan
def list_markers(d):
    return f"{b.blocks(d)} SELECT kind, list_type, {n('level', 'level')}, {n('count(*)', 'n')} FROM blocks WHERE kind IS NOT NULL GROUP BY kind, list_type, level"


@plan
def list_strip(d):
    return f"{b.blocks(d)} SELECT doc_id, pos, {fn.strip_list(d, 't')} AS text FROM blocks WHERE block_type = 'list_item'"


@plan
def list_style_map(d):
    style = "CASE WHEN kind IN ('letter', 'decimal') THEN '1.1一级列项-编号' WHEN kind = 'dash' THEN '1.2一级列项-无编号' ELSE '2.2二级列项-无编号' END"
    shaped = "CASE WHEN list_type = 'dash' AND level > 0 THEN 'bullet_dot' WHEN list_type = 'bullet_dot' AND level = 0 THEN 'dash' WHEN list_type = 'decimal_paren' AND level = 0 THEN 'lower_letter_paren' WHEN list_type = 'lower_letter_paren' AND level > 0 THEN 'decimal_paren' ELSE list_type END"
    return f"{b.blocks(d)} SELECT doc_id, pos, {style} AS style, {shaped} AS list_type FROM blocks WHERE block_type = 'list_item'"


@plan
def caption_parts(d):
    text = fn.strip(d, d.extract("t", fn.CAPTION, 6))
    return f"{b.blocks(d)} SELECT doc_id, pos, caption_type, {d.extract('t', fn.CAPTION, 1)} AS label, CASE WHEN {text} LIKE '图%' OR {text} LIKE '表%' THEN '' ELSE {text} END AS text FROM blocks WHERE block_type = 'caption'"


@plan
def note_roles(d):
    return f"{b.blocks(d)} SELECT doc_id, pos, role, {fn.strip(d, d.replace('t', fn.NOTE))} AS text FROM blocks WHERE role IN ('note', 'numbered_note')"


@plan
def formula_flags(d):
    return f"{b.blocks(d)} SELECT doc_id, pos, {fn.is_formula(d, 't')} AS formula, {d.matches('t', fn.DATE)} AS dated, (length(t) < 200 AND {d.matches('t', fn.TOC_ENTRY)}) AS toc_entry, (t IN ('目次', '目录', '目  次')) AS toc_title FROM blocks"


@plan
def appendix_markers(d):
    return f"{b.blocks(d)} SELECT doc_id, pos, {d.extract('t', '^附录([A-Z])', 1)} AS appendix_id, {fn.strip(d, d.replace('t', '^附录[A-Z]'))} AS title FROM blocks WHERE block_type = 'appendix'"


# Tables (SC2-SC4, PF12-PF16, A8, A11)


def _table_rows(d) -> str:
    """rows_, kept and cells of the tables in blocks; separator rows are left out."""
    return (
        "rows_ AS (SELECT doc_id, pos, t, table_start, sum(CASE WHEN table_start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS tid FROM blocks WHERE block_type = 'table'), "
        f"kept AS (SELECT doc_id, tid, pos, t, row_number() OVER (PARTITION BY doc_id, tid ORDER BY pos) - 1 AS r FROM rows_ WHERE NOT {d.matches('t', '^[-| ]+$')}), "
        f"cells AS ({d.matches_all('kept', 'doc_id, tid, r', 't', '[|]([^|]+)')})"
    )


def _tables(d) -> str:
    return f"{b.blocks(d)}, {_table_rows(d)}"


@plan
def md_tables(d):
    return f"{_tables(d)} SELECT doc_id, {n('tid', 'tid')}, {n('min(pos)', 'start_pos')}, {n('count(*)', 'n_rows')} FROM kept GROUP BY doc_id, tid"


# Windows over sections, lists and headings


@plan
def section_fill(d):
    return f"{b.sections(d)} SELECT doc_id, pos, {n('sid', 'sid')}, heading FROM sections"


@plan
def section_sizes(d):
    return f"{b.sections(d)} SELECT doc_id, {n('sid', 'sid')}, {n('count(*)', 'n_blocks')}, {n('sum(length(t))', 'n_chars')} FROM sections GROUP BY doc_id, sid"


@plan
def section_marker_counts(d):
    marker = d.extract("t", "^([■□▪▫◆◇▶▷※★☆])", 1)
    return f"{b.sections(d)}, m AS (SELECT doc_id, sid, pos, {marker} AS marker FROM sections) SELECT doc_id, pos, marker, {n('count(*) OVER (PARTITION BY doc_id, sid, marker)', 'n')} FROM m WHERE marker <> ''"


@plan
def list_restart(d):
    return f"{b.list_runs(d)} SELECT doc_id, pos, {n('run', 'run')}, {n('level', 'level')}, list_type, (nth = 1) AS restart FROM items"


@plan
def list_runs(d):
    return f"{b.list_runs(d)} SELECT doc_id, {n('run', 'run')}, {n('count(*)', 'n_items')}, {n('max(level)', 'max_level')}, {n('sum(CASE WHEN level > prev_level + 1 THEN 1 ELSE 0 END)', 'jumps')} FROM items GROUP BY doc_id, run"


@plan
def isolated_items(d):
    return f"{b.list_runs(d)} SELECT doc_id, pos, t FROM items WHERE run_length = 1"


@plan
def heading_jumps(d):
    return (
        f"{b.blocks(d)}, heads AS (SELECT doc_id, pos, level, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM blocks WHERE block_type = 'heading' AND level > 0) "
        f"SELECT doc_id, pos, CASE WHEN prev IS NULL THEN 'first_below_one' ELSE 'level_jump' END AS issue, {n('prev', 'prev')}, {n('level', 'level')} FROM heads WHERE (prev IS NULL AND level > 1) OR level > prev + 1"
    )


@plan
def heading_shift(d):
    return f"{b.blocks(d)}, heads AS (SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM blocks WHERE block_type = 'heading' AND level > 0) SELECT doc_id, {n('level - 1', 'shift')} FROM heads WHERE k = 1"


@plan
def body_runs(d):
    return (
        f"{b.blocks(d)}, marked AS (SELECT doc_id, pos, (block_type = 'body' AND role = 'body') AS open_body, sum(CASE WHEN block_type = 'body' AND role = 'body' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM blocks) "
        f"SELECT doc_id, {n('run', 'run')}, {n('min(pos)', 'start_pos')}, {n('count(*)', 'size')} FROM marked WHERE open_body GROUP BY doc_id, run"
    )


@plan
def group_scores(d):
    return f"{b.body_groups(d)} SELECT doc_id, {n('run', 'run')}, {n('start_i', 'start_i')}, {n('end_i', 'end_i')}, confidence, CASE WHEN confidence >= 85e-2 THEN 'auto' ELSE 'review' END AS status FROM grouped WHERE confidence >= 65e-2"


FAMILY = "CASE WHEN ordered >= 6e-1 THEN 'visible_ordered_marker' WHEN markers >= 6e-1 THEN 'visible_unordered_marker' ELSE 'semantic_default_ordered' END"


@plan
def group_families(d):
    """Whether a group of lines is an ordered or an unordered list, and why."""
    return f"{b.body_groups(d)} SELECT doc_id, {n('run', 'run')}, {n('start_i', 'start_i')}, {n('end_i', 'end_i')}, {FAMILY} AS source, CASE {FAMILY} WHEN 'visible_unordered_marker' THEN 'unordered' ELSE 'ordered' END AS family, CASE {FAMILY} WHEN 'semantic_default_ordered' THEN 5e-1 ELSE 92e-2 END AS confidence FROM grouped WHERE confidence >= 65e-2"


# Numbering


@plan
def num_groups_physical(d):
    return f"{b.deco_num(d)} SELECT doc_id, {n('gid', 'gid')}, num_id, {n('min(pos)', 'first_pos')}, {n('count(*)', 'size')} FROM physical GROUP BY doc_id, gid, num_id"


@plan
def num_groups_logical(d):
    return (
        f"{b.deco_num(d)}, groups AS (SELECT doc_id, gid, min(num_id) AS num_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS size, min(ilvl) AS lo, max(ilvl) AS hi, min(start) AS start FROM physical GROUP BY doc_id, gid), "
        "stepped2 AS (SELECT *, CASE WHEN lag(last_pos) OVER w = first_pos - 1 AND lo = hi AND lag(lo) OVER w = lag(hi) OVER w AND lag(lo) OVER w = lo AND start = lag(start) OVER w + lag(size) OVER w THEN 0 ELSE 1 END AS opens2 FROM groups WINDOW w AS (PARTITION BY doc_id ORDER BY gid)), "
        "logical AS (SELECT *, sum(opens2) OVER (PARTITION BY doc_id ORDER BY gid) AS lid FROM stepped2) "
        f"SELECT doc_id, {n('lid', 'lid')}, {n('count(*)', 'n_physical')}, {n('sum(size)', 'size')}, {n('count(DISTINCT num_id)', 'n_num_ids')} FROM logical GROUP BY doc_id, lid"
    )


@plan
def list_level_jumps(d):
    return f"{b.deco_num(d)}, s AS (SELECT doc_id, gid, pos, level, lag(level) OVER (PARTITION BY doc_id, gid ORDER BY pos) AS prev FROM physical) SELECT doc_id, pos, {n('prev', 'prev')}, {n('level', 'level')} FROM s WHERE level > prev + 1"


@plan
def list_start_overrides(d):
    return f"{b.deco_num(d)}, s AS (SELECT doc_id, num_id, pos, start, row_number() OVER (PARTITION BY doc_id, num_id ORDER BY pos) AS k FROM deco_num) SELECT doc_id, num_id, pos, (start > 1) AS has_override FROM s WHERE k = 1"


# Captions (J3, J4, M5, W8, W9, W16, W19, W20)


@plan
def caption_adjacency(d):
    """Captions with the object that they are associated with, or why with none."""
    return f"{b.captions(d)} SELECT doc_id, pos, caption_type, status, {n('CASE WHEN status = ' + chr(39) + 'associated' + chr(39) + ' THEN object_i END', 'object_i')}, CASE WHEN a = 1 AND b = 0 THEN 'before' WHEN b = 1 AND a = 0 THEN 'after' END AS placement, moved FROM judged_captions"


@plan
def caption_missing(d):
    """Tables without a caption (W20), and whether an ambiguous one keeps them from getting one."""
    return f"{b.captions(d)} SELECT u.doc_id, u.pos AS table_pos, (x.i IS NOT NULL) AS blocked FROM units u LEFT JOIN owned o ON o.doc_id = u.doc_id AND o.i = u.i LEFT JOIN blocked x ON x.doc_id = u.doc_id AND x.i = u.i WHERE u.block_type = 'table' AND o.i IS NULL"


def _rebuilt(d) -> str:
    """captions with rebuilt: the order in which a table follows, and a figure precedes, its caption."""
    return (
        b.captions(d) + ", rebuilt AS (SELECT u.doc_id, u.pos, u.i, u.block_type, u.t, CASE WHEN c.object_i IS NOT NULL THEN c.object_i * 4 + CASE WHEN c.caption_type = 'table' THEN 0 ELSE 3 END ELSE u.i * 4 + 2 END AS o "
        "FROM units u LEFT JOIN (SELECT doc_id, pos, object_i, caption_type FROM judged_captions WHERE status = 'associated') c ON c.doc_id = u.doc_id AND c.pos = u.pos)"
    )


@plan
def caption_order(d):
    """The place of each block when captions stand where they belong."""
    return f"{_rebuilt(d)} SELECT doc_id, pos, {n('i', 'old_ord')}, {n('row_number() OVER (PARTITION BY doc_id ORDER BY o)', 'new_ord')} FROM rebuilt"


@plan
def caption_placement(d):
    """Blocks with captions where they belong, and one with a new id for each data table that can have one."""
    return (
        f"{_rebuilt(d)}{models.table_parts(d)}, bare AS (SELECT u.doc_id, u.i, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.i) AS serial FROM units u JOIN semantics f ON f.doc_id = u.doc_id AND f.tid = u.tid WHERE u.block_type = 'table' AND f.table_type = 'data' "
        "AND NOT EXISTS (SELECT 1 FROM owned o WHERE o.doc_id = u.doc_id AND o.i = u.i) AND NOT EXISTS (SELECT 1 FROM blocked x WHERE x.doc_id = u.doc_id AND x.i = u.i)), "
        "placed AS (SELECT doc_id, o, block_type, t, CAST(NULL AS VARCHAR(40)) AS caption_id FROM rebuilt UNION ALL SELECT doc_id, i * 4 + 1 AS o, 'caption' AS block_type, '' AS t, concat('caption-auto-', CAST(serial AS VARCHAR(20))) AS caption_id FROM bare) "
        f"SELECT doc_id, {n('row_number() OVER (PARTITION BY doc_id ORDER BY o)', 'ord')}, block_type, t, caption_id FROM placed"
    )


@plan
def caption_lookahead(d):
    far = " ".join(f"WHEN lead(block_type, {k}) OVER w = 'table' THEN {k} WHEN coalesce(lead(block_type, {k}) OVER w, 'end') NOT IN ('body', 'list_item') THEN NULL" for k in (1, 2, 3, 4))
    return f"{b.blocks(d)}, looked AS (SELECT doc_id, pos, block_type, CASE {far} ELSE NULL END AS ahead FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, {n('ahead', 'ahead')} FROM looked WHERE block_type = 'caption'"


@plan
def caption_context(d):
    reset = "CASE WHEN block_type IN ('heading', 'table', 'caption', 'appendix') THEN 1 ELSE 0 END"
    return (
        f"{b.blocks(d)}, g AS (SELECT *, sum({reset}) OVER (PARTITION BY doc_id ORDER BY pos) - {reset} AS grp FROM blocks), "
        "near AS (SELECT c.doc_id, c.pos, x.pos AS xpos, substring(x.t, 1, 40) AS t, row_number() OVER (PARTITION BY c.doc_id, c.pos ORDER BY x.pos DESC) AS back "
        "FROM g c JOIN g x ON x.doc_id = c.doc_id AND x.grp = c.grp AND x.pos < c.pos WHERE c.block_type = 'caption' AND x.block_type IN ('body', 'list_item')) "
        f"SELECT doc_id, pos, {n('count(*)', 'n_context')}, {d.listed('t', 'xpos')} AS context FROM near WHERE back <= 3 GROUP BY doc_id, pos"
    )


@plan
def review_context(d):
    return f"{b.blocks(d)}, r AS (SELECT doc_id, pos, block_type, lag(t, 2) OVER w AS p2, lag(t) OVER w AS p1, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2 FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, p2, p1, n1, n2 FROM r WHERE block_type = 'appendix'"


# Appendices


def _letters(k: str) -> str:
    """A to Z, AA to ZZ and so on for 1, 2, ... (F18), up to three letters."""
    digit = lambda x: f"chr(CAST(65 + {x} AS INT))"
    one, two, three = f"({k} - 1) % 26", f"floor(({k} - 27) / 26e0) % 26", f"floor(({k} - 703) / 676e0) % 26"
    return f"CASE WHEN {k} <= 26 THEN {digit(one)} WHEN {k} <= 702 THEN concat({digit(two)}, {digit(one)}) ELSE concat({digit(three)}, {digit(two)}, {digit(one)}) END"


def _ranges(d) -> str:
    """blocks with k, the appendix they lie in, and ids, its id: that of its title, else by its number."""
    return (
        f"{b.blocks(d)}, a AS (SELECT *, sum(CASE WHEN block_type = 'appendix' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM blocks), "
        f"ids AS (SELECT doc_id, k, CASE WHEN {d.extract('t', fn.APPENDIX_ID, 1)} <> '' THEN upper({d.extract('t', fn.APPENDIX_ID, 1)}) ELSE {_letters('k')} END AS appendix_id, t FROM a WHERE block_type = 'appendix')"
    )


@plan
def appendix_ids(d):
    """The id of each appendix by its number (F18), and the one that its title names."""
    return f"{_ranges(d)} SELECT doc_id, {n('k', 'ordinal')}, {_letters('k')} AS by_number, appendix_id FROM ids"


@plan
def appendix_ranges(d):
    return (
        f"{_ranges(d)} SELECT a.doc_id, {n('a.k', 'ordinal')}, max(i.appendix_id) AS appendix_id, {n('min(a.pos)', 'start_pos')}, {n('max(a.pos) + 1', 'end_pos')}, {n('count(*)', 'n_blocks')}, {n('min(CASE WHEN a.block_type = ' + chr(39) + 'heading' + chr(39) + ' AND a.level > 0 THEN a.level END)', 'base_level')} "
        "FROM a JOIN ids i ON i.doc_id = a.doc_id AND i.k = a.k WHERE a.k > 0 GROUP BY a.doc_id, a.k"
    )


@plan
def appendix_headings(d):
    """Headings inside an appendix with their level in it (W21): by their visible number, else by the hierarchy."""
    visible = lambda g: d.extract("t", fn.APPENDIX_HEADING, g)
    return (
        f"{_ranges(d)}, inside AS (SELECT a.*, i.appendix_id, min(CASE WHEN a.block_type = 'heading' AND a.level > 0 THEN a.level END) OVER (PARTITION BY a.doc_id, a.k) AS base FROM a JOIN ids i ON i.doc_id = a.doc_id AND i.k = a.k WHERE a.block_type <> 'appendix'), "
        f"seen AS (SELECT *, CASE WHEN upper({visible(1)}) = appendix_id THEN length({visible(2)}) - length(replace(replace({visible(2)}, '．', '.'), '.', '')) END AS shown, {visible(4)} AS rest FROM inside), "
        "related AS (SELECT doc_id, pos, appendix_id, shown, CASE WHEN shown IS NOT NULL THEN rest ELSE t END AS text, coalesce(shown, CASE WHEN block_type = 'heading' AND level > 0 THEN level - base + 1 END) AS relative FROM seen) "
        f"SELECT doc_id, {n('pos', 'pos')}, appendix_id, {n('relative', 'level')}, {fn.strip(d, 'text')} AS text, CASE WHEN shown IS NOT NULL THEN 'visible_appendix_number' ELSE 'relative_heading_hierarchy' END AS source FROM related WHERE relative BETWEEN 1 AND 3"
    )


def _appendix_candidates(d) -> str:
    bare = d.replace("t", "^#+ ")
    return (
        f"{b.blocks(d)}, placed AS (SELECT *, {bare} AS mark, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS total, lag(page_before) OVER (PARTITION BY doc_id ORDER BY pos) AS page_last, sum(CASE WHEN block_type = 'appendix' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k, "
        "max(CASE WHEN block_type IN ('heading', 'body', 'table', 'image', 'caption', 'list_item') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS content FROM blocks), "
        f"marked AS (SELECT *, upper({d.extract('mark', fn.APPENDIX_CANDIDATE, 1)}) AS own_id, CASE WHEN block_type = 'heading' AND level > 0 THEN level END AS own_level FROM placed WHERE block_type = 'appendix' OR (block_type IN ('body', 'heading') AND {d.matches('mark', fn.APPENDIX_CANDIDATE)})), "
        "peers AS (SELECT m.doc_id, m.pos FROM marked m JOIN placed h ON h.doc_id = m.doc_id AND h.k = m.k AND h.pos > m.pos AND h.block_type = 'heading' AND h.level > 0 AND h.level <= m.own_level GROUP BY m.doc_id, m.pos), "
        "weighed AS (SELECT m.doc_id, m.pos, m.mark, m.own_id, m.block_type, CASE WHEN m.block_type = 'appendix' THEN 1e0 ELSE 6e-1 + CASE WHEN m.own_id <> '' THEN 3e-1 ELSE 0e0 END + CASE WHEN m.i >= 7e-1 * greatest(1, m.total - 1) THEN 15e-2 ELSE 0e0 END + CASE WHEN m.page_before THEN 2e-1 ELSE 0e0 END + CASE WHEN m.content = 1 THEN 1e-1 ELSE 0e0 END "
        "+ CASE m.own_level WHEN 1 THEN 15e-2 WHEN 2 THEN 5e-2 ELSE 0e0 END + CASE WHEN m.own_level IS NOT NULL AND p.pos IS NULL THEN 1e-1 ELSE 0e0 END - CASE WHEN m.own_level >= 3 AND m.num_fmt = 'decimal' AND m.lvl_text LIKE '%\\%%' THEN 4e-1 ELSE 0e0 END END AS score FROM marked m LEFT JOIN peers p ON p.doc_id = m.doc_id AND p.pos = m.pos)"
    ).replace("LIKE '%\\%%'", "IS NOT NULL")


@plan
def appendix_scores(d):
    """How sure a block is to begin an appendix (W13); 0.70 is enough."""
    return f"{_appendix_candidates(d)} SELECT doc_id, {n('pos', 'pos')}, round(greatest(0e0, least(1e0, score)), 3) AS confidence, (block_type = 'appendix' OR score >= 7e-1 - 1e-9) AS accepted FROM weighed"


@plan
def appendix_titles(d):
    """Accepted candidates as appendices, with the id they name or that of their number, title and classification."""
    text = fn.strip(d, d.replace("mark", r"(?i)^附\s*录(\s*[A-Z])?\s*[：:]?"))
    kind = d.extract("title", "^[（(](规范性|资料性)[)）]", 1)
    return (
        f"{_appendix_candidates(d)}, accepted AS (SELECT doc_id, pos, own_id, {text} AS title, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM weighed WHERE block_type = 'appendix' OR score >= 7e-1 - 1e-9) "
        f"SELECT doc_id, {n('pos', 'pos')}, CASE WHEN own_id <> '' THEN own_id ELSE {_letters('k')} END AS appendix_id, {kind} AS classification, {fn.strip(d, d.replace('title', '^[（(](规范性|资料性)[)）]'))} AS title FROM accepted"
    )


# Front matter over pages (S3, A14, W18, W22, SC5)


def _page_rows(d) -> str:
    return (
        f"WITH title AS (SELECT page_id, -1 AS pos, 'title' AS style, {d.extract('html', '<title>([^<]*)</title>', 1)} AS t FROM {d.table('pages')}), "
        f"h1 AS (SELECT page_id, 0 AS pos, 'h1' AS style, {d.extract('html', '<h1>([^<]*)</h1>', 1)} AS t FROM {d.table('pages')}), "
        f"li AS ({d.matches_all(d.table('pages'), 'page_id', 'html', '<li>(?:<a[^>]*>)?([^<]*)')}), "
        "records AS (SELECT page_id, pos, style, t FROM title UNION ALL SELECT page_id, pos, style, t FROM h1 UNION ALL SELECT page_id, n + 1 AS pos, 'li' AS style, item AS t FROM li)"
    )


@plan
def html_blocks(d):
    return f"{_page_rows(d)} SELECT page_id, {n('pos', 'pos')}, style, {fn.strip(d, 't')} AS text FROM records WHERE t <> ''"


# Comparison of models


def _signatures(d) -> str:
    return b.blocks(d) + f", signed AS (SELECT doc_id, pos, block_type, t, {d.sha256('concat(block_type, chr(31), role, chr(31), coalesce(CAST(level AS VARCHAR(10)), ' + chr(39) * 2 + '), chr(31), t)')} AS signature FROM blocks)"


@plan
def model_diff(d):
    return (
        f"{b.blocks(d)}, raw_counts AS (SELECT doc_id, 'body' AS block_type, count(*) AS n FROM lines WHERE line <> '' GROUP BY doc_id), new_counts AS (SELECT doc_id, block_type, count(*) AS n FROM blocks GROUP BY doc_id, block_type) "
        f"SELECT coalesce(a.doc_id, c.doc_id) AS doc_id, coalesce(a.block_type, c.block_type) AS block_type, {n('coalesce(a.n, 0)', 'source_n')}, {n('coalesce(c.n, 0)', 'final_n')}, {n('coalesce(c.n, 0) - coalesce(a.n, 0)', 'delta')} FROM raw_counts a FULL OUTER JOIN new_counts c ON a.doc_id = c.doc_id AND a.block_type = c.block_type"
    )


@plan
def unmatched_ordinals(d):
    return (
        f"{b.blocks(d)}, m AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS k FROM blocks WHERE role = 'body'), r AS (SELECT doc_id, line AS t, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM lines) "
        f"SELECT m.doc_id, {n('count(*)', 'n_model')}, {n('sum(CASE WHEN r.k IS NULL THEN 1 ELSE 0 END)', 'n_missing')} FROM m LEFT JOIN r ON r.doc_id = m.doc_id AND r.t = m.t AND r.k = m.k GROUP BY m.doc_id"
    )


@plan
def unique_text_match(d):
    return f"{b.blocks(d)} SELECT doc_id, t, {n('min(pos)', 'pos')} FROM blocks WHERE block_type = 'heading' GROUP BY doc_id, t HAVING count(*) = 1"


@plan
def fingerprint(d):
    return f"{_signatures(d)} SELECT doc_id, {n('count(*)', 'n_blocks')}, {d.sha256(d.listed('signature', 'pos'))} AS fingerprint FROM signed GROUP BY doc_id"


def _candidate(d) -> str:
    """blocks with candidate: the same after normalization, markers taken off and kinds asked anew."""
    mark = f"CASE WHEN block_type = 'heading' THEN {fn.strip_heading(d, 't', fn.OWN_NUMBER)} WHEN block_type = 'list_item' THEN {fn.strip_list(d, 't')} WHEN role = 'note' THEN {fn.strip(d, d.replace('t', fn.NOTE))} ELSE t END"
    return (
        f"{b.blocks(d)}, cleaned AS (SELECT doc_id, pos, {mark} AS t, table_start, block_type, role, level, list_type FROM blocks), dotted AS (SELECT *, {fn.dotted_number(d, 't')} AS num FROM cleaned), "
        f"candidate AS (SELECT *, {fn.hierarchical_level(d, 't')} AS hier, CASE WHEN block_type = 'list_item' THEN {fn.list_kind(d, 't')} END AS kind FROM dotted)"
    )


SIGNATURE = "concat_ws(chr(31), block_type, role, coalesce(CAST(level AS VARCHAR(10)), ''), coalesce(list_type, ''), t)"


@plan
def signature_diff(d):
    """Blocks that a candidate changes though no decision names them (U6): here decisions name headings."""
    return (
        f"{_candidate(d)}, x AS (SELECT doc_id, pos, {d.sha256(SIGNATURE)} AS signature, block_type FROM blocks), y AS (SELECT doc_id, pos, {d.sha256(SIGNATURE)} AS signature FROM candidate) "
        "SELECT x.doc_id, x.pos, x.block_type FROM x LEFT JOIN y ON y.doc_id = x.doc_id AND y.pos = x.pos WHERE x.block_type <> 'heading' AND (y.signature IS NULL OR y.signature <> x.signature)"
    )


# Findings, scores and decisions (U2, U5, A6, A7, F29, V1, V7, PF22, PF23, PF25, PF26)

# What the audits find, and how severe it is.
SEVERITY = {
    "heading_jump": "medium", "first_below_one": "high", "heading_manual_number": "high", "list_manual_marker": "medium", "caption_orphan": "medium", "table_without_caption": "low",
    "invariant:appendix_title_empty": "critical", "invariant:heading_empty": "critical", "invariant:list_text_empty": "high", "heading_too_deep": "low",
}


def _findings(d, relation: str = "blocks", name: str = "findings") -> str:
    """, findings AS (doc_id, pos, category, severity) of a relation, in one pass over it."""
    rules = {
        "heading_jump": "block_type = 'heading' AND level > prev + 1",
        "first_below_one": "block_type = 'heading' AND level > 1 AND prev IS NULL",
        "heading_manual_number": f"block_type = 'heading' AND {fn.residual_number(d, 't')}",
        "list_manual_marker": "block_type = 'list_item' AND kind IS NOT NULL",
        "caption_orphan": "block_type = 'caption' AND coalesce(before, '') NOT IN ('table', 'image') AND coalesce(after, '') NOT IN ('table', 'image')",
        "table_without_caption": "table_start AND coalesce(before, '') <> 'caption'",
        "invariant:appendix_title_empty": "block_type = 'appendix' AND length(t) < 5",
        "invariant:heading_empty": f"block_type = 'heading' AND {d.replace('t', '^#+')} = ''",
        "invariant:list_text_empty": "block_type = 'list_item' AND t = ''",
        "heading_too_deep": "block_type = 'heading' AND level >= 5",
    }
    items = [f"CASE WHEN {rule} THEN '{category}' END" for category, rule in rules.items()]
    severity = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in SEVERITY.items())
    return f"{b.neighbours(d, relation, name + '_near')}, {name}_found AS ({d.each('doc_id, pos', items, name + '_near')}), {name} AS (SELECT doc_id, pos, item AS category, CASE item {severity} END AS severity FROM {name}_found)"


@plan
def findings_union(d):
    return f"{b.blocks(d)}{_findings(d)} SELECT doc_id, pos, category, severity FROM findings"


@plan
def validate_model(d):
    return f"{b.blocks(d)}{_findings(d)} SELECT category, severity, {n('count(*)', 'n')}, {n('count(DISTINCT doc_id)', 'n_docs')} FROM findings GROUP BY category, severity"


def _scores(d, findings: str = "findings", name: str = "scores") -> str:
    one = lambda s: f"sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END)"
    return f", {name} AS (SELECT doc_id, sum(CASE WHEN category LIKE 'invariant:%' THEN 1 ELSE 0 END) AS invariant, {one('critical')} AS critical, {one('high')} AS high, {one('medium')} AS medium, {one('low')} AS low FROM {findings} GROUP BY doc_id)"


@plan
def audit_score(d):
    return f"{b.blocks(d)}{_findings(d)}{_scores(d)} SELECT doc_id, {n('critical', 'critical')}, {n('high', 'high')}, {n('medium', 'medium')}, {n('low', 'low')}, {n('1000 * (critical + invariant) + 100 * high + 10 * medium + low', 'score')} FROM scores"


def _two_models(d) -> str:
    return f"{_candidate(d)}{_findings(d)}{_findings(d, 'candidate', 'left_over')}"


@plan
def unresolved_targets(d):
    """Findings of headings and list items that the candidate still has (U5): an intersection."""
    pick = "SELECT f.doc_id, f.pos, f.category FROM {} f JOIN blocks x ON x.doc_id = f.doc_id AND x.pos = f.pos WHERE x.block_type IN ('heading', 'list_item')"
    return f"{_two_models(d)}, unsolved AS ({pick.format('findings')} INTERSECT SELECT doc_id, pos, category FROM left_over) SELECT doc_id, pos, category FROM unsolved"


@plan
def accept_decision(d):
    """Whether the candidate is taken (V7, F29): no new risk, and better in the first severity where the two differ."""
    score = ["invariant", "critical", "high", "medium", "low"]
    pairs = ", ".join(f"coalesce(x.{c}, 0) AS {c}, coalesce(y.{c}, 0) AS {c}2" for c in score)
    better = "CASE " + " ".join(f"WHEN {c}2 <> {c} THEN {c}2 < {c}" for c in score) + " ELSE false END"
    return (
        f"{_two_models(d)}{_scores(d)}{_scores(d, 'left_over', 'scores2')}, every AS (SELECT DISTINCT doc_id FROM blocks), both_ AS (SELECT e.doc_id, {pairs} FROM every e LEFT JOIN scores x ON x.doc_id = e.doc_id LEFT JOIN scores2 y ON y.doc_id = e.doc_id), "
        f"judged_ AS (SELECT *, CASE WHEN critical2 > critical OR high2 > high THEN 'new_or_increased_high_risk_findings' WHEN NOT ({better}) THEN 'audit_score_did_not_improve' ELSE 'audit_score_improved' END AS reason FROM both_) "
        "SELECT doc_id, (reason = 'audit_score_improved') AS accepted, reason FROM judged_"
    )


@plan
def review_packet(d):
    """Findings that a review can repair, with the two blocks on either side (PF23, W9)."""
    w = "OVER (PARTITION BY doc_id ORDER BY pos)"
    around = ", ".join(f"{f}(t, {k}) {w} AS {name}" for f, k, name in (("lag", 2, "p2"), ("lag", 1, "p1"), ("lead", 1, "n1"), ("lead", 2, "n2")))
    return f"{b.blocks(d)}{_findings(d)}, around AS (SELECT doc_id, pos, t, {around} FROM blocks) SELECT f.doc_id, f.pos, f.category, f.severity, a.t, a.p2, a.p1, a.n1, a.n2 FROM findings f JOIN around a ON a.doc_id = f.doc_id AND a.pos = f.pos WHERE f.category NOT LIKE 'invariant:%' AND f.severity <> 'low'"


SHORT = "block_type = 'body' AND role = 'body' AND length(t) <= 30 AND "


def _suspicion(d) -> str:
    """suspicion (doc_id, total, score): the seven signals of a Markdown text; it has no visual headings, so one is 0."""
    one = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
    short = SHORT + f"NOT {d.matches('t', '[。；;，,]$')}"
    part = lambda x, y: f"least({x} / (1e0 * greatest({y}, 1)), 1e0)"
    return (
        f"{b.body_groups(d)}, sized AS (SELECT doc_id, count(*) AS total, {one("block_type = 'body'")} AS n_body, {one("block_type = 'heading'")} AS n_heading, {one("block_type = 'list_item'")} AS n_list, {one(short)} AS n_short, {one('kind IS NULL AND ' + d.matches('t', fn.UNORDERED))} AS n_unordered, "
        f"{one("block_type = 'heading' AND hashes = 0")} AS inferred_headings, {one("block_type = 'list_item'")} AS inferred_lists, {one("block_type = 'body'")} AS unstyled, {one('table_start')} AS n_table, {one("block_type = 'image'")} AS n_image FROM blocks WHERE block_type <> 'table' OR table_start GROUP BY doc_id), "
        "suspicion AS (SELECT doc_id, total, round(least(1e0, "
        f"2e-1 * {part('greatest(n_short, n_unordered)', 'n_body')} + 15e-2 * {part('inferred_headings', 'n_heading')} + 1e-1 * {part('inferred_lists', 'n_list')} + 15e-2 * {part('unstyled', 'n_body')} + 1e-1 * {part('n_table', 'total')} + 5e-2 * {part('n_image', 'total')}), 4) AS score FROM sized)"
    )


@plan
def suspicion_score(d):
    """How unsure the structure of a document is."""
    return f"{_suspicion(d)} SELECT doc_id, score FROM suspicion"


@plan
def auto_gate_lists(d):
    """Whether the list phase runs by itself (PF27): five blocks or more, with a template, and a suspicion of 0.15."""
    return f"{_suspicion(d)} SELECT doc_id, score, (total >= 5 AND score >= 15e-2) AS runs FROM suspicion"


@plan
def suspicious_sections(d):
    """Sections with a block that needs a second look, all of a document's where none has one (PF22, PF24)."""
    doubt = f"CASE WHEN ({SHORT}NOT {d.matches('t', '[。；;，,]$')}) OR (block_type = 'heading' AND hashes = 0) OR (kind IS NULL AND {d.matches('t', fn.UNORDERED)}) THEN 1 ELSE 0 END"
    return (
        f"{b.sections(d)}, doubted AS (SELECT doc_id, sid, max({doubt}) AS doubt, count(*) AS n_blocks, min(pos) AS start_pos FROM sections GROUP BY doc_id, sid), every AS (SELECT *, max(doubt) OVER (PARTITION BY doc_id) AS any_doubt FROM doubted) "
        f"SELECT doc_id, {n('sid', 'sid')}, {n('start_pos', 'start_pos')}, {n('n_blocks', 'n_blocks')}, (doubt = 1) AS suspicious FROM every WHERE doubt = 1 OR any_doubt = 0"
    )


@plan
def mode_gates(d):
    """The phases that each mode given by hand runs (PF27): its letters, or those of its name; abc means ab."""
    # The names of modes, each with its letters.
    names = {"toc_region_review": "s", "list_detect": "a", "caption_gen": "b", "document_review": "c", "all": "sabc"}
    letters = ["".join(c for k, c in enumerate("sabc") if bits >> k & 1) for bits in range(1, 16)]
    given = ["off", "unknown", "ba", *names, *letters, *(f"force-{x}" for x in letters)]
    modes = " UNION ALL ".join(f"SELECT '{m}' AS mode" for m in given)
    told = " UNION ALL ".join(f"SELECT mode, '{x}' AS phase, (letters LIKE '%{x.lower()}%') AS runs FROM known" for x in "SABC")
    named = " ".join(f"WHEN '{m}' THEN '{x}'" for m, x in names.items())
    return (
        f"WITH modes AS ({modes}), spelt AS (SELECT mode, {d.replace(f'CASE mode {named} ELSE mode END', '^force-')} AS letters FROM modes), "
        f"known AS (SELECT mode, CASE WHEN letters = 'abc' THEN 'ab' WHEN {d.matches('letters', '^s?a?b?c?$')} THEN letters ELSE '' END AS letters FROM spelt) {told}"
    )


@plan
def content_warnings(d):
    has = lambda p: f"max(CASE WHEN {d.matches('t', p)} THEN 1 ELSE 0 END)"
    rules = [("toc", "^(目次|目录)$"), ("references", "引用文件|依据文件"), ("terms", "术语|缩略语"), ("formula", r"公式|^\(?[0-9]+\)?$"), ("appendix", "^附录|^（?(资料性|规范性)）?$"), ("figure_table_notes", "图.*注|注.*图|脚注")]
    facts = ", ".join(f"{has(p)} AS has_{name}" for name, p in rules)
    items = [f"CASE WHEN has_{name} = 1 THEN '{name}' END" for name, _ in rules]
    return f"{b.blocks(d)}, facts AS (SELECT doc_id, {facts} FROM blocks GROUP BY doc_id), told AS ({d.each('doc_id', items, 'facts')}) SELECT doc_id, item AS warning FROM told"


@plan
def risk_warnings(d):
    """Risks of a document by what its audits found (PF26, in part): one pass, one aggregate."""
    risks = [("residual_markers", "medium", 3), ("manual_numbers", "high", 1), ("invariants", "invariant", 1), ("critical_findings", "critical", 1), ("minor_findings", "low", 5)]
    items = [f"CASE WHEN {c} >= {k} THEN concat('{name}|', CAST({c} AS VARCHAR(20))) END" for name, c, k in risks]
    return f"{b.blocks(d)}{_findings(d)}{_scores(d)}, told AS ({d.each('doc_id', items, 'scores')}) SELECT doc_id, {d.extract('item', '^([a-z_]+)', 1)} AS risk, CAST({d.extract('item', '([0-9]+)$', 1)} AS BIGINT) AS n FROM told"


@plan
def model_summary(d):
    return f"{b.blocks(d)} SELECT doc_id, {n('count(*)', 'blocks')}, {n('count(DISTINCT block_type)', 'types')}, {n('sum(CASE WHEN block_type = ' + chr(39) + 'heading' + chr(39) + ' THEN 1 ELSE 0 END)', 'headings')}, {n('ceil(sum(length(t)) / 4e0)', 'token_estimate')} FROM blocks GROUP BY doc_id"


# Requests, responses and patches over events


def _requests(d) -> str:
    key = "concat(CAST(event_id AS VARCHAR(20)), '|', event_type, '|', CAST(user_id AS VARCHAR(20)))"
    return (
        f"WITH requests AS (SELECT event_id AS request_id, user_id AS doc_id, event_type AS operation, value, concat('sha256:', {d.sha256(key)}) AS input_hash FROM {d.table('events')} WHERE event_id % 2 = 0), "
        f"responses AS (SELECT event_id - event_id % 2 AS request_id, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'stale' ELSE 'ok' END AS claim, value FROM {d.table('events')} WHERE event_id % 2 = 1 AND event_id % 5 <> 0)"
    )


@plan
def batches(d):
    return f"{_requests(d)} SELECT doc_id, request_id, {n('floor((row_number() OVER (PARTITION BY doc_id ORDER BY request_id) - 1) / 12e0)', 'batch')} FROM requests"


@plan
def phase_deltas(d):
    return f"{_requests(d)}, p AS (SELECT operation, doc_id % 4 AS phase, count(*) AS total FROM requests GROUP BY operation, doc_id % 4) SELECT operation, {n('phase', 'phase')}, {n('total - coalesce(lag(total) OVER (PARTITION BY operation ORDER BY phase), 0)', 'delta')} FROM p"


# Orders that need what lies before (W10, W11): a fold in Spark, a recursion in the oracle


@plan
def level_fold(d):
    """Unordered items by level (W11): less the least level of an all-unordered run, first at 0, none more than one below the item before; ordered items stay."""
    rows = f"{b.deco_num(d)}, typed AS (SELECT doc_id, gid, pos, level, (pos % 5 = 3) AS ordered FROM physical), based AS (SELECT *, CASE WHEN max(CASE WHEN ordered THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, gid) = 1 THEN 0 ELSE min(level) OVER (PARTITION BY doc_id, gid) END AS base FROM typed)"
    if d.has("items"):
        rows = f"WITH given AS (SELECT * FROM {d.table('items')}), based AS (SELECT *, CASE WHEN max(CASE WHEN ordered THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, gid) = 1 THEN 0 ELSE min(level) OVER (PARTITION BY doc_id, gid) END AS base FROM given)"
    columns = f"{n('gid', 'gid')}, {n('pos', 'pos')}, {n('level', 'level')}, CASE WHEN ordered THEN 'ordered' WHEN level = 0 THEN 'dash' ELSE 'bullet_dot' END AS list_type"
    if isinstance(d, Spark):
        return (
            f"{rows}, g AS (SELECT doc_id, gid, sort_array(collect_list(struct(pos, ordered, greatest(level - base, 0) AS want, level))) AS xs FROM based GROUP BY doc_id, gid), "
            "told AS (SELECT doc_id, gid, e.pos, e.ordered, e.level FROM (SELECT doc_id, gid, explode(aggregate(xs, CAST(array() AS array<struct<pos:int,ordered:boolean,level:int>>), "
            "(acc, x) -> array_append(acc, named_struct('pos', x.pos, 'ordered', x.ordered, 'level', CASE WHEN x.ordered THEN x.level WHEN size(acc) = 0 THEN 0 ELSE least(x.want, element_at(acc, -1).level + 1) END)))) AS e FROM g)) "
            f"SELECT doc_id, {columns} FROM told"
        )
    return (
        f"{rows.replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS (SELECT *, greatest(level - base, 0) AS want, row_number() OVER (PARTITION BY doc_id, gid ORDER BY pos) AS k FROM based), "
        "f AS (SELECT doc_id, gid, pos, ordered, CASE WHEN ordered THEN level ELSE 0 END AS level, k FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.gid, o.pos, o.ordered, CASE WHEN o.ordered THEN o.level ELSE least(o.want, f.level + 1) END, o.k FROM f JOIN o ON o.doc_id = f.doc_id AND o.gid = f.gid AND o.k = f.k + 1) "
        f"SELECT doc_id, {columns} FROM f"
    )


def _runner(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(f(Spark(sf_dir)))

    run.__name__ = f.__name__
    return run


PLANS |= audits.PLANS | records.PLANS | models.PLANS
QUERIES = {name: _runner(f) for name, f in PLANS.items()}
ORACLE_SQL = {name: f(Ansi()) for name, f in PLANS.items()}


def group_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disjoint groups that a greedy choice takes (S2): sequential, so without an oracle."""
    from docstrata.operators.sequential import select_disjoint_groups

    scored = spark.sql(f"{b.body_groups(Spark(sf_dir))} SELECT doc_id, {n('run', 'run')}, {n('start_i', 'start_i')}, {n('end_i', 'end_i')}, {n('size', 'size')}, ordered, markers, confidence FROM grouped WHERE confidence >= 65e-2")
    return select_disjoint_groups(scored)


def semantic_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the chosen groups make items of a list (M2): those of groups that are sure enough."""
    from docstrata.operators.sequential import retyped_items

    return retyped_items(group_select(spark, sf_dir), spark.sql(f"{b.body_groups(Spark(sf_dir))} SELECT doc_id, {n('run', 'run')}, {n('i', 'i')}, {n('pos', 'pos')}, t FROM featured"))


def layout_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indents that begin a level in each physical list group (W10): a fold, so without an oracle."""
    from docstrata.operators.sequential import layout_levels

    return layout_levels(spark.sql(f"{b.deco_num(Spark(sf_dir))} SELECT doc_id, gid AS run, left_twips FROM physical"))


QUERIES |= {"group_select": group_select, "layout_clusters": layout_clusters, "semantic_lists": semantic_lists}
