"""The blocks relation: lines of a text classified in order, and what is asked of it.

Each function returns a WITH prefix in either spelling. Structure is decided by windows over
(doc_id, pos), which share one exchange on doc_id. Lines are those that the caller gives
(plans.apply), else those of documents behind test scaffolding: the raw fixture text holds no
structure, so markers are put before its lines by a fixed rule.
"""

from __future__ import annotations

from docstrata.functions import text as fn


def deco_lines(d) -> str:
    if d.has("lines"):
        return f"lines AS (SELECT doc_id, pos, line FROM {d.table('lines')}), deco_lines AS (SELECT doc_id, pos, line, page_before, num_fmt, lvl_text FROM {d.table('lines')})"
    x = "x"
    cases = [
        (0, "concat('## ', x)"), (1, "concat(x, '：')"), (2, "concat('Alpha：', x)"), (3, "concat('Beta：', x)"), (4, "concat('Gamma：', x)"),
        (5, "concat('Delta：', x)"), (6, "concat('1.2 ', x)"), (7, "concat('a) ', x)"), (8, "concat('b) ', x)"), (9, "concat('1) ', x)"),
        (10, "concat('• ', x)"), (11, "concat('表1 ', x)"), (12, "'| h1 | h2 |'"), (13, "'| --- | --- |'"), (14, "concat('| ', substring(x, 1, 8), ' | v |')"),
        (15, "concat('注1：', x)"), (16, "concat('备注：', x)"), (17, "concat('(3.1)：', x)"), (18, "concat('附录A ', x)"), (19, "concat('图2 ', x)"),
        (20, "concat('![](', x, ')')"), (21, "concat('10.0.0.1 ', x)"), (22, "concat('###### ', x)"), (23, "concat('■ ', x)"),
    ]
    chain = " ".join(f"WHEN {k} THEN {v}" for k, v in cases)
    return (
        f"lines AS ({d.lines()}), deco_lines AS (SELECT doc_id, pos, CASE k {chain} ELSE {x} END AS line, (pos % 11 = 0) AS page_before, "
        f"CASE WHEN k IN (0, 6) AND pos % 2 = 0 THEN 'decimal' END AS num_fmt, CASE WHEN k = 0 THEN '%1.%2' END AS lvl_text FROM ("
        f"SELECT doc_id, pos, (pos + doc_id) % 24 AS k, {d.replace('line', r'[.\s]+$')} AS x FROM lines) b)"
    )


def blocks(d, source: str | None = None) -> str:
    """WITH ... blocks (doc_id, pos, t, raw, num, hier, block_type, role, level, list_type, caption_type)."""
    x = "t"
    bare = fn.strip(d, "line")
    hash_level = f"length({d.extract(bare, '^(#{1,6}) ', 1)})"
    head = f"WITH {source or deco_lines(d)}"
    table_start = (
        f"(t LIKE '|%' AND {d.matches('after', '^[-| ]*[|][-| ]*$')} AND after LIKE '%-%')"
    )
    return (
        f"{head}, shaped AS (SELECT doc_id, pos, line AS raw, {fn.strip(d, d.replace(bare, '^#{1,6} '))} AS t, {hash_level} AS hashes, page_before, num_fmt, lvl_text FROM deco_lines), "
        f"probed AS (SELECT doc_id, pos, raw, t, hashes, page_before, num_fmt, lvl_text, {fn.dotted_number(d, 't')} AS num, "
        "coalesce(lead(t) OVER (PARTITION BY doc_id ORDER BY pos), '') AS after, "
        "coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY pos), '') AS before FROM shaped WHERE t <> ''), "
        f"levelled AS (SELECT doc_id, pos, raw, t, hashes, page_before, num_fmt, lvl_text, num, {fn.hierarchical_level(d, x)} AS hier, "
        f"(t LIKE '|%' AND (before LIKE '|%' OR {table_start})) AS in_table, {table_start} AS table_start FROM probed), "
        f"judged AS (SELECT doc_id, pos, raw, t, hashes, page_before, num_fmt, lvl_text, num, hier, in_table, table_start, {fn.heading_level(d, x)} AS text_level, "
        f"{fn.list_kind(d, x)} AS kind, {fn.note_role(d, x)} AS note, {fn.is_formula(d, x)} AS formula, "
        f"{d.matches(x, fn.APPENDIX)} AS is_appendix, {d.matches(x, '^[图表]')} AS is_caption, {d.matches(x, fn.IMAGE)} AS is_image FROM levelled), "
        "typed AS (SELECT *, CASE WHEN in_table THEN 'table' WHEN is_image THEN 'image' WHEN hashes > 0 THEN 'heading' WHEN text_level IS NOT NULL AND kind IS NULL AND NOT formula THEN 'heading' "
        "WHEN note IS NOT NULL OR formula THEN 'body' WHEN is_appendix THEN 'appendix' WHEN is_caption THEN 'caption' WHEN kind IS NOT NULL THEN 'list_item' ELSE 'body' END AS block_type FROM judged), "
        "blocks AS (SELECT doc_id, pos, raw, t, page_before, num_fmt, lvl_text, hashes, num, hier, table_start, kind, block_type, "
        "CASE WHEN block_type = 'body' THEN CASE WHEN note IS NOT NULL THEN note WHEN formula THEN 'formula' ELSE 'body' END WHEN block_type = 'heading' AND hashes = 1 THEN 'title' ELSE block_type END AS role, "
        "CAST(CASE WHEN block_type = 'heading' THEN CASE WHEN hashes > 0 THEN least(hashes - 1, 5) ELSE text_level END "
        "WHEN block_type = 'list_item' THEN CASE WHEN kind IN ('decimal', 'bullet2') THEN 1 ELSE 0 END ELSE NULL END AS INT) AS level, "
        "CASE WHEN block_type <> 'list_item' THEN NULL WHEN kind = 'letter' THEN 'lower_letter_paren' WHEN kind = 'decimal' THEN 'decimal_paren' WHEN kind = 'dash' THEN 'dash' ELSE 'bullet_dot' END AS list_type, "
        "CASE WHEN block_type <> 'caption' THEN NULL WHEN t LIKE '图%' THEN 'figure' ELSE 'table' END AS caption_type FROM typed)"
    )


def sections(d) -> str:
    """blocks with sid, the number of headings so far, and heading, the text of the last one."""
    return (
        blocks(d) + ", sections AS (SELECT *, sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sid, "
        f"{d.last_known('CASE WHEN block_type = ' + chr(39) + 'heading' + chr(39) + ' THEN t END')} OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM blocks)"
    )


def list_runs(d) -> str:
    """List items with run, the number of other blocks before them."""
    return (
        blocks(d) + ", numbered AS (SELECT *, sum(CASE WHEN block_type <> 'list_item' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM blocks), "
        "items AS (SELECT doc_id, pos, t, run, level, list_type, row_number() OVER (PARTITION BY doc_id, run, level, list_type ORDER BY pos) AS nth, "
        "lag(level) OVER (PARTITION BY doc_id, run ORDER BY pos) AS prev_level, count(*) OVER (PARTITION BY doc_id, run) AS run_length FROM numbered WHERE block_type = 'list_item')"
    )


def neighbours(d, relation: str = "blocks", name: str = "neighbours") -> str:
    """, neighbours AS: the relation with the type of the block before and after, and the level of the heading before."""
    w = "OVER (PARTITION BY doc_id ORDER BY pos)"
    level = "CASE WHEN block_type = 'heading' AND level > 0 THEN level END"
    return (
        f", {name} AS (SELECT *, lag(block_type) {w} AS before, lead(block_type) {w} AS after, lead(table_start) {w} AS after_starts, "
        f"{d.last_known(level)} OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {relation})"
    )


def units(d) -> str:
    """blocks with i, its place, where a table is one block, tid its number, and kind_of, what a caption can belong to."""
    return (
        blocks(d) + ", counted AS (SELECT *, sum(CASE WHEN table_start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS tid FROM blocks), "
        "units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, CASE block_type WHEN 'table' THEN 'table' WHEN 'image' THEN 'figure' END AS kind_of FROM counted WHERE block_type <> 'table' OR table_start)"
    )


def captions(d) -> str:
    """units with judged: the captions, their object (J3) where just one neighbour fits, and the first claim of each object."""
    w = "OVER (PARTITION BY doc_id ORDER BY pos)"
    return (
        units(d) + f", beside AS (SELECT *, lag(kind_of) {w} AS kind_before, lead(kind_of) {w} AS kind_after FROM units), "
        "fits AS (SELECT doc_id, pos, i, caption_type, CASE WHEN kind_before = caption_type THEN 1 ELSE 0 END AS b, CASE WHEN kind_after = caption_type THEN 1 ELSE 0 END AS a FROM beside WHERE block_type = 'caption'), "
        "claims AS (SELECT *, CASE WHEN a + b = 1 THEN i + a - b END AS object_i FROM fits), numbered_claims AS (SELECT *, row_number() OVER (PARTITION BY doc_id, object_i ORDER BY i) AS nth FROM claims), "
        "judged_captions AS (SELECT *, CASE WHEN a + b = 0 THEN 'orphan_caption' WHEN a + b = 2 THEN 'ambiguous_caption_association' WHEN nth > 1 THEN 'duplicate_caption_association' ELSE 'associated' END AS status, "
        "(a + b = 1 AND nth = 1 AND ((caption_type = 'table' AND b = 1) OR (caption_type = 'figure' AND a = 1))) AS moved FROM numbered_claims), "
        "owned AS (SELECT doc_id, object_i AS i, pos AS caption_pos FROM judged_captions WHERE status = 'associated'), "
        "blocked AS (SELECT doc_id, i - 1 AS i FROM judged_captions WHERE status = 'ambiguous_caption_association' UNION SELECT doc_id, i + 1 AS i FROM judged_captions WHERE status = 'ambiguous_caption_association')"
    )


def deco_num(d) -> str:
    """events as numbering rows, with physical groups (W2): same num_id, next position."""
    return (
        "WITH deco_num AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) - 1 AS pos, event_type AS num_id, "
        "CAST(event_id % 2 AS INT) AS ilvl, CAST(event_id % 4 AS INT) AS level, CAST(1 + event_id % 3 AS INT) AS start, CAST((event_id % 5) * 60 AS INT) AS left_twips "
        f"FROM {d.table('events')}), stepped AS (SELECT *, CASE WHEN lag(num_id) OVER (PARTITION BY doc_id ORDER BY pos) = num_id AND lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = pos - 1 THEN 0 ELSE 1 END AS opens FROM deco_num), "
        "physical AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS gid FROM stepped)"
    )


def body_groups(d) -> str:
    """Candidate groups: a colon-ended anchor and the 3 to 12 body lines that follow in its run."""
    label = d.extract("t", "^([^：:。.；;]{1,32})[：:]", 1)
    return (
        blocks(d) + ", marked AS (SELECT doc_id, pos, t, sum(CASE WHEN block_type = 'body' AND role = 'body' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run, "
        f"(block_type = 'body' AND role = 'body') AS open_body FROM blocks), bodies AS (SELECT doc_id, run, pos, t FROM marked WHERE open_body), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS i FROM bodies), "
        f"featured AS (SELECT *, {label} AS label, {d.matches('t', '[：:]$')} AS anchor, {d.matches('t', '[，,；;]$')} AS open_end, {d.matches('t', '[。.!！?？]$')} AS closed_end, "
        f"{d.matches('t', fn.ORDERED)} AS ordered FROM ranked), "
        "candidates AS (SELECT a.doc_id, a.run, a.i AS start_i, b.i AS end_i, b.i - a.i AS size FROM featured a JOIN featured b ON a.doc_id = b.doc_id AND a.run = b.run AND b.i BETWEEN a.i + 3 AND a.i + 12), "
        "measured AS (SELECT c.doc_id, c.run, c.start_i, c.end_i, c.size, avg(CASE WHEN m.label <> '' THEN 1e0 ELSE 0e0 END) AS labels, "
        f"avg(CASE WHEN {d.matches('m.t', fn.UNORDERED)} THEN 1e0 ELSE 0e0 END) AS markers, "
        f"greatest(sum(CASE WHEN {d.matches('m.t', '[；;]$')} THEN 1 ELSE 0 END), sum(CASE WHEN {d.matches('m.t', '[。.]$')} THEN 1 ELSE 0 END), "
        f"sum(CASE WHEN {d.matches('m.t', '[，,]$')} THEN 1 ELSE 0 END), sum(CASE WHEN {d.matches('m.t', '[；;。.，,]$')} THEN 0 ELSE 1 END)) / (1e0 * c.size) AS terminals, "
        "avg(CASE WHEN m.ordered THEN 1e0 ELSE 0e0 END) AS ordered, greatest(0e0, 1e0 - (max(length(m.t)) - min(length(m.t))) / greatest(2e0 * avg(length(m.t)), 1e0)) AS lengths "
        "FROM candidates c JOIN featured m ON m.doc_id = c.doc_id AND m.run = c.run AND m.i > c.start_i AND m.i <= c.end_i GROUP BY c.doc_id, c.run, c.start_i, c.end_i, c.size), "
        "grouped AS (SELECT c.doc_id, c.run, c.start_i, c.end_i, c.size, c.ordered, c.markers, round(greatest(0e0, least(99e-2, 2e-1 + least(4e-2, (c.size - 3) * 1e-2) "
        "+ CASE WHEN a.anchor THEN 22e-2 WHEN a.open_end OR (length(a.t) <= 90 AND NOT a.closed_end) THEN 1e-1 ELSE 0e0 END + CASE WHEN length(a.t) <= 50 THEN 4e-2 ELSE 0e0 END "
        "+ 28e-2 * c.labels + 12e-2 + 8e-2 * c.terminals + 8e-2 * c.lengths + CASE WHEN c.labels >= 6e-1 THEN 8e-2 ELSE 0e0 END + CASE WHEN c.markers >= 6e-1 THEN 18e-2 ELSE 0e0 END "
        "+ CASE WHEN c.labels >= 6e-1 AND f.i IS NOT NULL THEN CASE WHEN f.label <> '' THEN -12e-2 ELSE 3e-2 END ELSE 0e0 END)), 4) AS confidence "
        "FROM measured c JOIN featured a ON a.doc_id = c.doc_id AND a.run = c.run AND a.i = c.start_i "
        "LEFT JOIN featured f ON f.doc_id = c.doc_id AND f.run = c.run AND f.i = c.end_i + 1)"
    )
