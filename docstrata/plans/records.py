"""Plans on records: the paragraphs and tables of Word documents in order (survey sections 2.1, 2.2, 2.6).

Records are given by the caller (plans.apply, sources.files.docx_records), else made from the
lines of documents by a fixed rule: a cover, a table of contents and styles, as test scaffolding.
"""

from __future__ import annotations

from docstrata.functions import text as fn

# Names of styles, words of covers and labels that documents use.
TITLE_STYLES = "('title', 'documenttitle', '文档标题', '文件标题', '主标题')"
METADATA = "(?i)^(版本|version|文档编号|文件编号|密级|状态|作者|编制|日期|修订|审核|批准|文档属性|编制单位)"
COVER = "(?i)^(内部(技术)?文件|内部资料|仅供内部使用|机密|秘密|公开)$"
COVER_DATE = r"^([0-9]{4}[./年-][0-9]{1,2}([./月-][0-9]{1,2}日?)?|二〇?二\S+年)"
DOCUMENT_KIND = "(方案|报告|说明|规范|手册|设计|计划|总结|纪要|指南|需求|标准|办法|制度|细则|规程|建议书|可研|初设|详设)$"
FILE_SUFFIX = r"(?i)([-_\s](重构稿|修订稿|最终稿|正式稿|定稿|初稿|final|draft|v?[0-9]+([.][0-9]+)*))+$"
FRONT_LABEL = r"^(版本|Version|文档编号|文件编号|密级|状态|作者|日期|修订|审核|批准|修订记录)\s*[：:]"
HEADING_LABEL = r"^(版本|Version|文档编号|文件编号|密级|状态|作者|日期|修订|审核|批准)\s*[：:]"
REMARK = "[（(][^）)]*(仅供参考|示例|待补充|待定)[）)]"
API_LABELS = "('请求参数', '请求示例', '返回参数', '返回示例', '接口说明', '请求体', '响应体', '成功响应', '失败响应')"
TOC_TITLES = "('目录', '目次', '目  次', '目  录')"
NUMBERED_ENTRY = r"^\s*[0-9]+([.][0-9]+)*[\s、.．]+\S+"
LEADING_NUMBER = r"^\s*[0-9]+([.][0-9]+)*[\s、.．]+"
TRAILING_PAGE = r"[\t.·… ]+[0-9]{1,4}\s*$"
FUNCTION_WORDS = "^(支持|要求|依据|基础属性|权限属性|联系属性|组织属性|岗位属性)"
LIST_FORMATS = "('decimal', 'decimalZero', 'lowerLetter', 'upperLetter', 'lowerRoman', 'upperRoman', 'bullet')"


def n(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def _fixture(d) -> str:
    paragraph = "'paragraph' AS kind"
    return (
        f"lines AS ({d.lines()}), l AS (SELECT doc_id, pos, line, (pos + doc_id) % 16 AS k FROM lines), docs AS (SELECT DISTINCT doc_id FROM l), "
        "heads AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY doc_id) AS of_ FROM l WHERE k IN (1, 9)), "
        f"parts AS (SELECT doc_id, -3000 AS o, {paragraph}, CASE WHEN doc_id % 3 = 0 THEN 'Title' ELSE 'Normal' END AS style, concat('文件', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 2 = 0 THEN '技术方案' ELSE '' END) AS t, CAST(NULL AS VARCHAR(99)) AS items, false AS page FROM docs "
        f"UNION ALL SELECT doc_id, -2999 AS o, {paragraph}, 'Normal' AS style, CASE WHEN doc_id % 4 = 0 THEN '版本：1.0' ELSE '' END AS t, NULL AS items, false AS page FROM docs "
        f"UNION ALL SELECT doc_id, -2998 AS o, {paragraph}, 'Normal' AS style, '' AS t, NULL AS items, (doc_id % 5 = 0) AS page FROM docs "
        "UNION ALL SELECT doc_id, -2997 AS o, 'table' AS kind, '' AS style, '编制：甲 日期：乙' AS t, '编制：甲|日期：乙' AS items, false AS page FROM docs WHERE doc_id % 4 = 1 "
        f"UNION ALL SELECT doc_id, -2001 AS o, {paragraph}, 'Normal' AS style, '目录' AS t, NULL AS items, false AS page FROM docs WHERE doc_id % 4 <> 3 "
        f"UNION ALL SELECT doc_id, nth - 2000 AS o, {paragraph}, CASE WHEN doc_id % 2 = 0 THEN 'TOC 1' ELSE 'Normal' END AS style, concat(line, chr(9), CAST(nth AS VARCHAR(10))) AS t, NULL AS items, (nth = of_ AND doc_id % 3 = 0) AS page FROM heads WHERE doc_id % 4 <> 3 "
        f"UNION ALL SELECT doc_id, pos AS o, {paragraph}, CASE k WHEN 1 THEN 'Heading 1' WHEN 9 THEN 'Heading 2' WHEN 3 THEN 'List Number' WHEN 5 THEN '列项样式' WHEN 7 THEN 'Caption' WHEN 13 THEN '附录标题' ELSE 'Normal' END AS style, "
        "CASE k WHEN 4 THEN concat('1.2 ', line) WHEN 6 THEN concat('a) ', line) WHEN 8 THEN concat('备注：', line) WHEN 10 THEN '返回示例：' ELSE line END AS t, NULL AS items, (pos % 13 = 12) AS page FROM l), "
        "given AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INT) AS pos, kind, style, t, items, ((o = -3000 AND doc_id % 2 = 0) OR (o + doc_id) % 16 = 11) AS is_centered, ((o = -3000 AND doc_id % 5 < 3) OR (o + doc_id) % 16 = 12) AS mostly_bold, "
        "CASE WHEN o = -3000 THEN 10e0 + doc_id % 12 WHEN (o + doc_id) % 16 = 14 THEN 16e0 END AS max_size, page AS has_page_boundary, (o = -2001 AND doc_id % 7 = 0) AS has_toc_field, (o > -2001 AND o < 0 AND doc_id % 6 = 0) AS has_pageref, "
        "CAST(CASE WHEN o >= 0 AND (o + doc_id) % 16 BETWEEN 3 AND 6 THEN 1 + (o + doc_id) % 3 END AS INT) AS num_id, CAST(CASE WHEN o >= 0 AND (o + doc_id) % 16 BETWEEN 3 AND 6 THEN o % 2 END AS INT) AS ilvl, "
        "CAST(CASE WHEN style = 'List Number' THEN 2 END AS INT) AS style_num_id, CAST((abs(o) % 4) * 60 AS INT) AS left_twips FROM parts)"
    )


def records(d) -> str:
    """WITH ... records: position from 0, trimmed text, and what its style and text say (SC6, SC7, PF6 to PF9)."""
    source = f"given AS (SELECT * FROM {d.table('records')})" if d.has("records") else _fixture(d)
    style = "lower(replace(style, ' ', ''))"
    protected = (
        f"({style} LIKE 'heading%' OR {style} LIKE 'toc%' OR {style} IN ('caption', '题注', '文档标题', 'title') OR style LIKE '%附录%标题%' OR {d.matches('style', '目录|题注|注释|公式|附录标题')})"
    )
    blank = d.matches("t", r"^\s*$")
    return (
        f"WITH {source}, trimmed AS (SELECT doc_id, pos, kind, coalesce(style, '') AS style, {fn.strip(d, 't')} AS t, items, is_centered, mostly_bold, max_size, has_page_boundary, has_toc_field, has_pageref, num_id, ilvl, style_num_id, left_twips FROM given), "
        f"records AS (SELECT *, ({style} IN {TITLE_STYLES}) AS is_title_style, (lower(style) LIKE 'heading%') AS is_heading_style, {d.matches('style', '(?i)^heading *1$')} AS is_heading_one, (lower(style) LIKE 'toc%') AS is_toc_style, (t IN {TOC_TITLES}) AS is_toc_title, "
        f"({style} LIKE 'listnumber%' OR {style} LIKE 'listbullet%' OR {style} = 'listparagraph' OR style LIKE '%列项%') AS is_list_style, {protected} AS is_protected, "
        f"({blank} OR {d.matches('t', METADATA)} OR {d.matches('t', COVER_DATE)} OR {d.matches('t', COVER)}) AS is_metadata, "
        f"(lower(style) LIKE 'toc%' OR has_pageref OR {d.matches('t', TRAILING_PAGE)} OR (length(t) <= 100 AND {d.matches('t', NUMBERED_ENTRY)})) AND t <> '' AS is_entry FROM trimmed)"
    )


def record_flags(d):
    """What each record is by style and text (SC6, SC7, PF6, PF7, PF8)."""
    return f"{records(d)} SELECT doc_id, {n('pos', 'pos')}, is_title_style, is_heading_style, is_heading_one, is_toc_style, is_toc_title, is_list_style, is_protected, is_metadata, is_entry FROM records"


def _items(d) -> str:
    """, items: the cells of table records, numbered."""
    return f", items AS ({d.matches_all('(SELECT * FROM records WHERE items IS NOT NULL) r', 'doc_id, pos', 'items', '([^|]+)')})"


def metadata_tables(d):
    """Tables of a cover (PF9): a cell that names metadata, or four short cells or more."""
    return (
        f"{records(d)}{_items(d)} SELECT doc_id, {n('pos', 'pos')}, {n('count(*)', 'n_items')}, (max(CASE WHEN {d.matches('item', METADATA)} THEN 1 ELSE 0 END) = 1 OR (count(*) >= 4 AND max(length(item)) <= 40)) AS is_metadata FROM items GROUP BY doc_id, pos"
    )


def front_matter_flags(d):
    """Paragraphs that only a cover holds (PF10)."""
    return (
        f"{records(d)} SELECT doc_id, {n('pos', 'pos')}, (style LIKE 'Heading%' OR {d.matches('t', fn.DATE)} OR t IN ('目次', '目录', '目  次') OR {d.matches('t', FRONT_LABEL)} OR (is_centered AND length(t) <= 80)) AS front_matter FROM records WHERE kind = 'paragraph'"
    )


def _visual(d) -> str:
    return (
        f"(t <> '' AND length(t) <= 30 AND NOT {d.matches('t', '[。；;]$')} AND NOT {d.matches('t', fn.DATE)} AND NOT is_toc_title AND NOT {d.matches('t', HEADING_LABEL)} AND NOT {d.matches('t', REMARK)} "
        f"AND NOT {d.matches('t', '[：:].+[，,、]')} AND {d.replace('t', '[：:]+$')} NOT IN {API_LABELS} AND {d.matches('t', r'^[\p{L}\p{N}]')} AND (mostly_bold OR is_centered OR coalesce(max_size, 0) >= 14))"
    )


def visual_headings(d):
    """Paragraphs that look like a heading without its style (PF11)."""
    return f"{records(d)} SELECT doc_id, {n('pos', 'pos')}, t FROM records WHERE kind = 'paragraph' AND NOT is_heading_style AND {_visual(d)}"


def _numbered(d, relation: str = "records") -> str:
    """, levelled: records with num and hier, the level of a dotted number, style_level and text_level."""
    return (
        f", dotted AS (SELECT *, {fn.dotted_number(d, 't')} AS num FROM {relation}), hiers AS (SELECT *, {fn.hierarchical_level(d, 't')} AS hier FROM dotted), "
        f"levelled AS (SELECT *, {fn.heading_level(d, 't')} AS text_level, TRY_CAST({d.extract('style', '(?i)^heading *([0-9]+)', 1)} AS INT) AS style_level, coalesce(num_id, style_num_id) AS any_num, CASE WHEN num_id IS NOT NULL THEN coalesce(ilvl, 0) WHEN style_num_id IS NOT NULL THEN 0 END AS any_ilvl FROM hiers)"
    )


def heading_sources(d):
    """Level of a heading and where its number comes from (F5, F32): style, numbering, text, else 1."""
    return (
        f"{records(d)}{_numbered(d)} SELECT doc_id, {n('pos', 'pos')}, {n('coalesce(style_level, any_ilvl + 1, text_level, 1)', 'level')}, "
        "CASE WHEN any_num IS NOT NULL THEN 'docx-numbering' WHEN text_level IS NOT NULL THEN 'docx-text' ELSE 'assumed' END AS source FROM levelled WHERE kind = 'paragraph' AND t <> ''"
    )


def num_info(d):
    """Effective numbering of a paragraph (F32) and its indent (F31): its own, else that of its style."""
    return (
        f"{records(d)}{_numbered(d)} SELECT doc_id, {n('pos', 'pos')}, {n('any_num', 'num_id')}, {n('any_ilvl', 'ilvl')}, CASE WHEN num_id IS NOT NULL THEN 'direct' ELSE 'style' END AS source, {n('coalesce(left_twips, 0)', 'left_twips')} FROM levelled WHERE any_num IS NOT NULL"
    )


def compact_headings(d):
    """Short numbered headings that name a function."""
    bare = fn.strip(d, d.replace(fn.strip_heading(d, "t"), "^▲+"))
    return (
        f"{records(d)}{_numbered(d)}, bared AS (SELECT doc_id, pos, hier, {d.replace(bare, '[。．.]+$')} AS text FROM levelled WHERE hier IS NOT NULL) "
        f"SELECT doc_id, {n('pos', 'pos')}, text, (text <> '' AND length(text) <= 24 AND NOT {d.matches('text', '[，,；;：:]')} AND NOT {d.matches('text', FUNCTION_WORDS)}) AS compact FROM bared"
    )


def docx_roles(d):
    """The role of each paragraph (PF18): the first rule that fits, with the rules for strict mode."""
    word = d.replace("t", "[：:]+$")
    note = f"coalesce({fn.note_role(d, 't')}, CASE WHEN lower(replace(style, ' ', '')) IN ('注释', 'note') THEN 'note' END)"
    return (
        f"{records(d)}{_numbered(d)}, noted AS (SELECT *, {note} AS note, {fn.list_kind(d, 't')} AS list_kind FROM levelled WHERE kind = 'paragraph') "
        f"SELECT doc_id, {n('pos', 'pos')}, CASE WHEN length(t) < 200 AND {d.matches('t', fn.TOC_ENTRY)} THEN 'skip' WHEN replace(style, ' ', '') = '附录标题' OR {d.matches('t', fn.APPENDIX_MARK)} THEN 'appendix_title' "
        f"WHEN note = 'numbered_note' OR style = '注释' THEN note WHEN {d.matches('t', '^[图表]')} THEN 'caption' WHEN {d.matches('t', fn.DATE)} THEN 'body' WHEN style = '文档标题' THEN 'title' WHEN style LIKE 'Heading%' AND {word} IN {API_LABELS} THEN 'body' WHEN style LIKE 'Heading%' THEN 'heading' "
        f"WHEN t IN ('目次', '目录', '目  次') THEN 'body' WHEN hier IS NOT NULL THEN 'heading' WHEN style = 'List Paragraph' OR style LIKE '%列项%' THEN 'list' WHEN list_kind IS NOT NULL THEN 'list' WHEN text_level IS NOT NULL THEN 'heading' "
        f"WHEN {_visual(d)} THEN 'heading' WHEN note = 'note' THEN 'note' WHEN {fn.is_formula(d, 't')} THEN 'formula' WHEN {d.matches('t', fn.APPENDIX)} THEN 'appendix_title' ELSE 'body' END AS role FROM noted"
    )


def output_blocks(d):
    """Blocks of a rendered document by the styles it shows (SC11): paragraphs first, then tables."""
    style = "replace(style, ' ', '')"
    kind = (
        f"CASE WHEN kind = 'table' THEN 'table' WHEN {style} = '附录标题' THEN 'appendix' WHEN {d.matches(style, '^附录.*[1-3]$')} OR style LIKE 'Heading%' THEN 'heading' WHEN style LIKE '%列项%' THEN 'list_item' WHEN style LIKE '%文档标题%' THEN 'heading' WHEN {d.matches('t', fn.CAPTION_START)} OR style IN ('Caption', '题注') THEN 'caption' ELSE 'body' END"
    )
    role = f"CASE WHEN {d.matches(style, '^附录.*[1-3]$')} THEN 'appendix_heading' WHEN style LIKE '%文档标题%' THEN 'title' WHEN style LIKE '%注-%' THEN 'note' END"
    level = f"CASE WHEN style LIKE '%文档标题%' THEN 0 ELSE coalesce(TRY_CAST({d.extract('style', '([0-9]+)$', 1)} AS INT), 1) END"
    return (
        f"{records(d)}, shown AS (SELECT doc_id, pos, t, {kind} AS block_type, {role} AS role, {level} AS own_level, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN kind = 'table' THEN 1 ELSE 0 END, pos) AS nth FROM records) "
        f"SELECT doc_id, {n('nth', 'ord')}, concat('b', lpad(CAST(nth AS VARCHAR(10)), 4, '0')) AS block_id, block_type, role, {n("CASE WHEN block_type = 'heading' THEN own_level END", 'level')}, t AS text FROM shown"
    )


# Table of contents (W14, S1, PF24, F19, J6)


def _normal_entry(d, x: str) -> str:
    return d.replace(d.replace(d.replace(x, TRAILING_PAGE), LEADING_NUMBER), r"\s+")


def _toc(d) -> str:
    entry = f"({d.matches('item', TRAILING_PAGE)} OR (length(item) <= 100 AND {d.matches('item', NUMBERED_ENTRY)}))"
    return (
        f"{records(d)}{_items(d)}, entries AS (SELECT doc_id, pos, t AS entry, has_pageref FROM records WHERE kind <> 'table' AND is_entry UNION ALL SELECT doc_id, pos, item AS entry, false AS has_pageref FROM items WHERE {entry}), "
        f"normal_entries AS (SELECT doc_id, pos, has_pageref, {_normal_entry(d, 'entry')} AS norm FROM entries), later AS (SELECT doc_id, pos, {_normal_entry(d, 't')} AS norm FROM records WHERE is_heading_style), "
        "sizes AS (SELECT doc_id, count(*) AS total, min(CASE WHEN is_toc_title OR has_toc_field OR is_toc_style THEN pos END) AS first_start FROM records GROUP BY doc_id), "
        "starts AS (SELECT r.doc_id, r.pos AS start_pos, r.is_toc_title, r.has_toc_field, r.is_toc_style, r.has_page_boundary, s.total, CASE WHEN s.total < r.pos + 100 THEN s.total ELSE r.pos + 100 END AS scan_limit FROM records r JOIN sizes s ON s.doc_id = r.doc_id WHERE r.is_toc_title OR r.has_toc_field OR (r.is_toc_style AND r.pos = s.first_start)), "
        "bounded AS (SELECT s.doc_id, s.start_pos, min(b.pos) AS boundary FROM starts s JOIN records b ON b.doc_id = s.doc_id AND b.has_page_boundary AND b.pos >= s.start_pos AND b.pos < s.scan_limit GROUP BY s.doc_id, s.start_pos), "
        "spans AS (SELECT s.*, b.boundary, coalesce(b.boundary, s.scan_limit - 1) AS end_pos, s.start_pos + CASE WHEN s.is_toc_style THEN 0 ELSE 1 END AS entry_start FROM starts s LEFT JOIN bounded b ON b.doc_id = s.doc_id AND b.start_pos = s.start_pos), "
        "inside AS (SELECT s.doc_id, s.start_pos, s.end_pos, e.norm, e.has_pageref FROM spans s JOIN normal_entries e ON e.doc_id = s.doc_id AND e.pos >= s.entry_start AND e.pos <= s.end_pos), "
        "counted AS (SELECT doc_id, start_pos, count(*) AS n_entries, max(CASE WHEN has_pageref THEN 1 ELSE 0 END) AS linked FROM inside GROUP BY doc_id, start_pos), "
        "repeated AS (SELECT i.doc_id, i.start_pos, count(DISTINCT i.norm) AS repeats FROM inside i JOIN later h ON h.doc_id = i.doc_id AND h.norm = i.norm AND h.pos > i.end_pos WHERE i.norm <> '' GROUP BY i.doc_id, i.start_pos), "
        "cut AS (SELECT i.doc_id, i.start_pos, min(h.pos) AS first_head FROM inside i JOIN later h ON h.doc_id = i.doc_id AND h.norm = i.norm AND h.pos > i.start_pos AND h.pos <= i.end_pos GROUP BY i.doc_id, i.start_pos), "
        "toc_scores AS (SELECT s.doc_id, s.start_pos, CASE WHEN s.boundary IS NULL THEN coalesce(x.first_head - 1, s.end_pos) ELSE s.end_pos END AS end_pos, coalesce(c.n_entries, 0) AS n_entries, coalesce(r.repeats, 0) AS repeats, "
        "round(least(1e0, CASE WHEN s.is_toc_title THEN 25e-2 ELSE 0e0 END + CASE WHEN s.has_toc_field THEN 65e-2 ELSE 0e0 END + CASE WHEN s.is_toc_style THEN 35e-2 ELSE 0e0 END + CASE WHEN s.start_pos <= least(120, greatest(12, floor(s.total / 3e0))) THEN 1e-1 ELSE 0e0 END "
        "+ CASE WHEN c.n_entries >= 2 THEN 2e-1 ELSE 0e0 END + CASE WHEN c.n_entries >= 5 THEN 1e-1 ELSE 0e0 END + CASE WHEN s.boundary IS NOT NULL THEN 2e-1 ELSE 0e0 END + CASE WHEN r.repeats >= 2 THEN 25e-2 ELSE 0e0 END + CASE WHEN c.linked = 1 THEN 2e-1 ELSE 0e0 END), 3) AS confidence "
        "FROM spans s LEFT JOIN counted c ON c.doc_id = s.doc_id AND c.start_pos = s.start_pos LEFT JOIN repeated r ON r.doc_id = s.doc_id AND r.start_pos = s.start_pos LEFT JOIN cut x ON x.doc_id = s.doc_id AND x.start_pos = s.start_pos), "
        "toc_ranked AS (SELECT *, row_number() OVER w AS k, lead(confidence) OVER w AS next FROM toc_scores WHERE confidence >= 4e-1 WINDOW w AS (PARTITION BY doc_id ORDER BY confidence DESC, start_pos)), "
        "toc_chosen AS (SELECT doc_id, start_pos, end_pos, confidence, CASE WHEN confidence >= 75e-2 AND confidence - coalesce(next, confidence - 1e0) >= 15e-2 - 1e-9 THEN 'detected' ELSE 'ambiguous' END AS status FROM toc_ranked WHERE k = 1)"
    )


def toc_candidates(d):
    return f"{_toc(d)} SELECT doc_id, {n('start_pos', 'start_pos')}, {n('end_pos', 'end_pos')}, {n('n_entries', 'n_entries')}, {n('repeats', 'repeats')}, confidence FROM toc_scores WHERE confidence >= 4e-1"


def toc_select(d):
    """The best region, and whether it is sure enough to be taken."""
    return f"{_toc(d)} SELECT doc_id, {n('start_pos', 'start_pos')}, {n('end_pos', 'end_pos')}, confidence, status FROM toc_chosen"


def toc_entry_overlap(d):
    """Entries that come back as headings behind their region."""
    return f"{_toc(d)} SELECT doc_id, {n('start_pos', 'start_pos')}, {n('repeats', 'repeats')} FROM repeated"


def toc_review(d):
    """Candidates that a review decides on (PF24): those of documents without a sure region."""
    return f"{_toc(d)} SELECT r.doc_id, {n('r.start_pos', 'start_pos')}, r.confidence FROM toc_ranked r JOIN toc_chosen c ON c.doc_id = r.doc_id WHERE c.status = 'ambiguous'"


def auto_gate_toc(d):
    """Documents whose table of contents is reviewed by itself (PF27): those where the choice is ambiguous."""
    return f"{_toc(d)} SELECT x.doc_id, (c.status IS NOT NULL AND c.status = 'ambiguous') AS runs FROM (SELECT DISTINCT doc_id FROM records) x LEFT JOIN toc_chosen c ON c.doc_id = x.doc_id"


# Front matter


def _front(d) -> str:
    score = (
        f"CASE WHEN kind <> 'paragraph' OR is_metadata OR length(t) > 100 OR {d.matches('t', '[。；;]$')} THEN -1000e0 ELSE CASE WHEN is_title_style THEN 100e0 ELSE 0e0 END + CASE WHEN is_centered THEN 25e0 ELSE 0e0 END + CASE WHEN mostly_bold THEN 20e0 ELSE 0e0 END "
        f"+ CASE WHEN max_size >= 14 THEN least(35e0, max_size) ELSE 0e0 END + CASE WHEN length(t) BETWEEN 4 AND 60 THEN 12e0 ELSE 0e0 END + CASE WHEN {d.matches('t', DOCUMENT_KIND)} THEN 30e0 ELSE 0e0 END + CASE WHEN is_heading_style THEN 10e0 ELSE 0e0 END + greatest(0e0, 8e0 - pos * 5e-1) END"
    )
    until = lambda x, e: f"CASE WHEN r.pos <= {e} AND {x} THEN 1 ELSE 0 END"
    points = lambda e: (
        f"2 * max({until('r.has_page_boundary', e)}) + 2 * max({until('r.meta_table', e)}) + 2 * max({until('r.score >= 40', e)}) + CASE WHEN sum({until("(r.kind = 'paragraph' AND r.t = '')", e)}) >= 2 THEN 1 ELSE 0 END "
        f"- 3 * max({until("(r.kind = 'paragraph' AND length(r.t) > 120 AND NOT r.is_metadata)", e)})"
    )
    return (
        f"{_toc(d)}, metas AS (SELECT doc_id, pos, (max(CASE WHEN {d.matches('item', METADATA)} THEN 1 ELSE 0 END) = 1 OR (count(*) >= 4 AND max(length(item)) <= 40)) AS meta FROM items GROUP BY doc_id, pos), "
        f"scored AS (SELECT r.*, coalesce(m.meta, false) AS meta_table, {score} AS score FROM (SELECT * FROM records) r LEFT JOIN (SELECT doc_id AS m_doc, pos AS m_pos, meta FROM metas) m ON m.m_doc = r.doc_id AND m.m_pos = r.pos), "
        "regions AS (SELECT x.doc_id, x.total, c.start_pos AS toc_start, c.end_pos AS toc_end FROM sizes x LEFT JOIN (SELECT * FROM toc_chosen WHERE status = 'detected') c ON c.doc_id = x.doc_id), "
        "structure AS (SELECT g.doc_id, g.total, g.toc_start, g.toc_end, coalesce(min(CASE WHEN r.is_heading_one THEN r.pos END), min(CASE WHEN r.is_heading_style THEN r.pos END)) AS structural FROM regions g LEFT JOIN records r ON r.doc_id = g.doc_id AND r.pos >= coalesce(g.toc_end + 1, 0) GROUP BY g.doc_id, g.total, g.toc_start, g.toc_end), "
        "edges AS (SELECT s.doc_id, s.total, s.toc_start, s.toc_end, s.structural, min(CASE WHEN r.has_page_boundary AND r.pos < coalesce(s.structural, least(s.total, 30)) THEN r.pos END) AS edge FROM structure s JOIN records r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.total, s.toc_start, s.toc_end, s.structural), "
        f"covers AS (SELECT e.doc_id, e.total, e.toc_start, e.toc_end, e.structural, e.edge, {points('coalesce(e.edge, -1)')} AS edge_score, {points('coalesce(e.structural, 0) - 1')} AS prefix_score, min(CASE WHEN r.t <> '' THEN r.pos END) AS first_text FROM edges e JOIN scored r ON r.doc_id = e.doc_id GROUP BY e.doc_id, e.total, e.toc_start, e.toc_end, e.structural, e.edge), "
        "ended AS (SELECT *, CASE WHEN toc_start > 0 THEN toc_start - 1 WHEN toc_start IS NOT NULL THEN NULL WHEN edge IS NOT NULL AND edge_score >= 4 THEN edge WHEN structural > 0 AND prefix_score >= 4 THEN structural - 1 END AS cover_end FROM covers), "
        "titles AS (SELECT r.doc_id, r.pos, r.t, r.score, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.score DESC, r.pos) AS k FROM scored r JOIN ended e ON e.doc_id = r.doc_id WHERE r.score >= 40 AND (r.pos <= e.cover_end OR (r.is_title_style AND r.pos < coalesce(e.structural, least(e.total, 8)))))"
    )


def filename_title(d, x: str) -> str:
    """The title that a file's name tells."""
    bare = d.replace(d.replace(x, FILE_SUFFIX), "^[- _]+|[- _]+$")
    return f"CASE WHEN {bare} <> '' THEN {bare} WHEN {x} <> '' THEN {x} ELSE '文档' END"


def title_top1(d):
    """The best title of each document (S3); those without one are named by their file."""
    return f"{_front(d)} SELECT doc_id, {n('pos', 'pos')}, t AS title, score FROM titles WHERE k = 1"


def cover_score(d):
    """How much the records before the first page border, and before the first heading, look like a cover."""
    return f"{_front(d)} SELECT doc_id, {n('edge', 'edge')}, {n('CASE WHEN edge IS NOT NULL THEN edge_score END', 'edge_score')}, {n('structural', 'structural')}, {n('CASE WHEN structural > 0 THEN prefix_score END', 'prefix_score')} FROM covers"


def front_matter(d):
    """Cover, title and begin of the body."""
    name = filename_title(d, "concat('file_', CAST(e.doc_id AS VARCHAR(99)), '-draft_v1.2')")
    return (
        f"{_front(d)} SELECT e.doc_id, CASE WHEN e.cover_end IS NOT NULL THEN 'cover_detected' WHEN x.pos IS NOT NULL THEN 'title_normalized' ELSE 'no_cover' END AS status, {n('e.cover_end', 'cover_end')}, {n('e.structural', 'first_heading')}, "
        f"coalesce(x.t, {name}) AS title, CASE WHEN x.pos IS NOT NULL THEN 'source' ELSE 'filename' END AS title_source, {n('x.pos', 'title_pos')}, {n('coalesce(e.toc_end + 1, e.cover_end + 1, e.first_text, 0)', 'body_start')} FROM ended e LEFT JOIN titles x ON x.doc_id = e.doc_id AND x.k = 1"
    )


# Numbering (J1, SC8, F16, W3, W4, U7, A13)


def _definitions(d) -> str:
    """definitions ([doc_id,] num_id, ilvl, num_fmt, lvl_text, p_style, start), by the caller or as scaffolding."""
    if d.has("definitions"):
        return f"definitions AS (SELECT * FROM {d.table('definitions')})"
    rows = [(1, 0, "decimal", "%1)", "", 1), (1, 1, "decimal", "%2)", "", 1), (2, 0, "decimal", "%1)", "", 2), (2, 1, "bullet", "●", "", 1), (3, 0, "lowerLetter", "%1.", "heading 3", 1)]
    spelt = " UNION ALL ".join(f"SELECT {a} AS num_id, {b} AS ilvl, '{c}' AS num_fmt, '{e}' AS lvl_text, '{s}' AS p_style, {v} AS start" for a, b, c, e, s, v in rows)
    return f"definitions AS ({spelt})"


def marker_family(x: str) -> str:
    return f"CASE WHEN {x} IN ('•', '·', '●', '○', '◦', '∙') THEN 'round' WHEN {x} IN ('■', '□', '▪', '▫', '◆', '◇') THEN 'geometric' WHEN {x} IN ('-', '–', '—', '－') THEN 'line' ELSE {x} END"


def _described(d) -> str:
    """Numbered paragraphs with their definition (J1), physical (W2) and logical groups."""
    w = "OVER (PARTITION BY doc_id ORDER BY pos)"
    same_style = "lower(lag_style) = lower(style)"
    own = " AND x.doc_id = r.doc_id" if d.has("definitions") else ""
    return (
        f"{records(d)}{_numbered(d)}, {_definitions(d)}, numbered AS (SELECT r.doc_id, r.pos, r.t, r.style, r.is_list_style, r.is_protected, r.left_twips, r.num_id AS own_num, r.any_num AS num_id, r.any_ilvl AS ilvl, x.num_fmt, x.lvl_text, coalesce(x.p_style, '') AS p_style, coalesce(x.start, 1) AS start, "
        f"(x.num_fmt IS NOT NULL AND x.num_fmt IN {LIST_FORMATS}) AS valid, {d.replace('x.lvl_text', '%[0-9]+', chr(39) + '%n' + chr(39))} AS template, {marker_family('x.lvl_text')} AS family, {fn.list_kind(d, 'r.t')} AS list_kind, {fn.note_role(d, 'r.t')} AS note "
        f"FROM levelled r LEFT JOIN definitions x ON x.num_id = r.any_num AND x.ilvl = r.any_ilvl{own} WHERE r.kind = 'paragraph' AND r.any_num IS NOT NULL), "
        f"opened AS (SELECT *, CASE WHEN lag(num_id) {w} = num_id AND lag(pos) {w} = pos - 1 THEN 0 ELSE 1 END AS opens FROM numbered), physical AS (SELECT *, sum(opens) {w} AS gid FROM opened), "
        "firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gid ORDER BY pos) AS nth, count(*) OVER (PARTITION BY doc_id, gid) AS size FROM physical), "
        "groups AS (SELECT doc_id, gid, max(size) AS size, min(pos) AS first_pos, max(pos) AS last_pos, min(ilvl) AS lo, max(ilvl) AS hi, max(CASE WHEN is_protected THEN 1 ELSE 0 END) AS guarded, max(CASE WHEN nth = 1 THEN num_fmt END) AS num_fmt, max(CASE WHEN nth = 1 THEN template END) AS template, max(CASE WHEN nth = 1 THEN family END) AS family, "
        "max(CASE WHEN nth = 1 THEN style END) AS style, max(CASE WHEN nth = 1 THEN start END) AS start, max(CASE WHEN nth = 1 THEN left_twips END) AS first_left, max(CASE WHEN nth = size THEN left_twips END) AS last_left FROM firsts GROUP BY doc_id, gid), "
        "paired AS (SELECT *, lag(last_pos) OVER w AS lag_pos, lag(lo) OVER w AS lag_lo, lag(hi) OVER w AS lag_hi, lag(guarded) OVER w AS lag_guarded, lag(num_fmt) OVER w AS lag_fmt, lag(template) OVER w AS lag_template, lag(family) OVER w AS lag_family, lag(style) OVER w AS lag_style, lag(start) OVER w AS lag_start, lag(size) OVER w AS lag_size, lag(last_left) OVER w AS lag_left FROM groups WINDOW w AS (PARTITION BY doc_id ORDER BY gid)), "
        f"joined AS (SELECT doc_id, gid, CASE WHEN lag_pos = first_pos - 1 AND guarded = 0 AND lag_guarded = 0 AND lo = hi AND lag_lo = lag_hi AND lag_lo = lo AND {same_style} AND ((num_fmt = 'bullet' AND lag_fmt = 'bullet' AND family = lag_family AND abs(coalesce(first_left - lag_left, 0)) <= 120) "
        f"OR (num_fmt <> 'bullet' AND num_fmt = lag_fmt AND num_fmt IN {LIST_FORMATS} AND template = lag_template AND start = lag_start + lag_size)) THEN 0 ELSE 1 END AS opens FROM paired), "
        "logical AS (SELECT doc_id, gid, sum(opens) OVER (PARTITION BY doc_id ORDER BY gid) AS lid FROM joined), "
        "described AS (SELECT f.*, l.lid, count(*) OVER (PARTITION BY f.doc_id, l.lid) AS group_size, row_number() OVER (PARTITION BY f.doc_id, l.lid ORDER BY f.pos) - 1 AS group_index, min(f.num_id) OVER (PARTITION BY f.doc_id, l.lid) <> max(f.num_id) OVER (PARTITION BY f.doc_id, l.lid) AS continued FROM firsts f JOIN logical l ON l.doc_id = f.doc_id AND l.gid = f.gid), "
        "told AS (SELECT *, (is_protected OR p_style LIKE 'heading%' OR note IS NOT NULL) AS guarded, (is_list_style OR group_size >= 2 OR list_kind IS NOT NULL) AS strong FROM described)"
    )


STATUS = "CASE WHEN guarded OR NOT valid OR t = '' THEN 'ignored' WHEN strong THEN 'detected' ELSE 'ambiguous' END"


def numbering_join(d):
    """Numbered paragraphs with the level that their definition gives (J1): an equi join on number and level."""
    return f"{_described(d)} SELECT doc_id, {n('pos', 'pos')}, {n('num_id', 'num_id')}, {n('ilvl', 'ilvl')}, num_fmt, lvl_text, {n('start', 'start')} FROM numbered"


def marker_templates(d):
    """Level texts with their numbers made alike, and the family of bullets (F16)."""
    return f"{_described(d)} SELECT DISTINCT lvl_text, template, family FROM numbered WHERE lvl_text IS NOT NULL"


def list_descriptors(d):
    """Group, evidence and status of each numbered paragraph."""
    evidence = [
        "CASE WHEN valid THEN 'valid_numbering_definition' END", "CASE WHEN is_list_style THEN 'list_style' END", "CASE WHEN size >= 2 THEN 'consecutive_num_id_group' END", "CASE WHEN group_size >= 2 THEN 'consecutive_numbering_sequence' END",
        "CASE WHEN continued THEN 'continued_across_num_id' END", "CASE WHEN continued AND num_fmt = 'bullet' THEN 'structural_bullet_continuity' END", "CASE WHEN list_kind IS NOT NULL THEN 'visible_list_marker' END", "CASE WHEN own_num IS NOT NULL THEN 'direct_num_pr' END",
        f"CASE WHEN {STATUS} = 'ignored' AND guarded THEN 'protected_role' WHEN {STATUS} = 'ignored' AND NOT valid THEN 'invalid_numbering_definition' WHEN {STATUS} = 'ambiguous' THEN 'isolated_generic_numbering' END",
    ]
    return (
        f"{_described(d)} SELECT doc_id, {n('pos', 'pos')}, {n('lid', 'group_id')}, {n('group_size', 'group_size')}, {n('group_index', 'group_index')}, (group_index = 0) AS restart, {STATUS} AS status, "
        f"CASE {STATUS} WHEN 'ignored' THEN 0e0 WHEN 'detected' THEN CASE WHEN is_list_style AND group_size >= 2 THEN 98e-2 ELSE 9e-1 END ELSE 55e-2 END AS confidence, concat_ws(',', {', '.join(evidence)}) AS evidence FROM told"
    )


def list_status(d):
    """List paragraphs by status (A3)."""
    return f"{_described(d)} SELECT {STATUS} AS status, {n('count(*)', 'n')}, {n('count(DISTINCT doc_id)', 'n_docs')} FROM told GROUP BY {STATUS}"


PLANS = {
    f.__name__: f
    for f in (
        record_flags, metadata_tables, front_matter_flags, visual_headings, heading_sources, num_info, compact_headings, docx_roles, output_blocks, toc_candidates, toc_select, toc_entry_overlap, toc_review, auto_gate_toc,
        title_top1, cover_score, front_matter, numbering_join, marker_templates, list_descriptors, list_status,
    )
}
