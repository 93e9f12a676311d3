"""Oracles in SQL for the corpus queries that it can express."""

from __future__ import annotations

import math
import re

from docstrata.llm.licenses import PHRASES, TEMPLATES
from docstrata.llm.quality import RULES, STOP_WORDS, STOP_WORDS_FROM

_LINES = (
    "SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line "
    "FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) q"
)


def line_dedup() -> str:
    blanks = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return (
        f"WITH lines AS ({_LINES}), "
        f"keyed AS (SELECT *, translate(trim(line, {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines), "
        "often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10), "
        "marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON often.k = keyed.k) "
        "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, "
        "sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"
    )


def quality_rules() -> str:
    blank = r"[\x20\x09-\x0D]"
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    failed = ", ".join(f"CASE WHEN {m} {op} CAST({limit} AS DOUBLE) THEN '{name}' END" for name, m, op, limit in RULES)
    ratio = lambda x, y: f"CAST({x} AS DOUBLE) / nullif({y}, 0)"
    return (
        "WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
        f"w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS ws FROM docs), "
        "w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w0), "
        "t AS (SELECT doc_id, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
        "r AS (SELECT doc_id, i, word, CASE WHEN c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c) > 1 THEN 1 ELSE 0 END AS rep FROM t), "
        "v AS (SELECT doc_id, word, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM r), "
        f"words AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(hit) AS n_repeat_words, count(*) FILTER (WHERE lower(word) IN ({stop})) AS stops FROM v GROUP BY doc_id), "
        f"l AS (SELECT doc_id, line FROM ({_LINES}) q WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')), "
        f"lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE regexp_matches(line, '^{blank}*[-*+•]')) AS bullets, "
        f"count(*) FILTER (WHERE regexp_matches(line, '([.][.][.]|…){blank}*$')) AS ellipses FROM l GROUP BY doc_id), "
        "facts AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, "
        "coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stops, 0) AS stops, coalesce(n_lines, 0) AS n_lines, coalesce(bullets, 0) AS bullets, "
        r"coalesce(ellipses, 0) AS ellipses, length(regexp_replace(text, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(regexp_replace(text, '\P{L}+', '', 'g'), '[^\x00-\x{24F}]+', '', 'g')) AS latin FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)), "
        f"ratios AS (SELECT *, {ratio('word_chars', 'n_words')} AS mean_word, {ratio('n_symbols', 'word_chars')} AS symbol_ratio, CASE WHEN n_words >= {STOP_WORDS_FROM} AND 2 * latin >= letters THEN {ratio('stops', 'n_words')} END AS stop_ratio, "
        f"{ratio('letters', 'word_chars')} AS alpha_ratio, {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio, {ratio('bullets', 'n_lines')} AS bullet_ratio, {ratio('ellipses', 'n_lines')} AS ellipsis_ratio FROM facts), "
        f"judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM ratios) "
        "SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, "
        "CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM judged"
    )


def license_scan(threshold: float = 0.9) -> str:
    """Places by comparing neighbouring words, notices by counting template words in every window of a text."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda x: f"list_filter(regexp_split_to_array(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{gap}'), lambda x: x <> '')"
    said = {label: [w for w in re.split(gap, text.lower()) if w] for label, text in TEMPLATES.items()}
    templates = " UNION ALL ".join(
        f"SELECT '{k}' AS label, {math.ceil(threshold * len(set(v)) - 1e-9)} AS need, {max(len(v), math.floor(len(v) / threshold + 1e-9))} AS span, {sorted(set(v))!r} AS ws" for k, v in said.items()
    )
    at = []
    for phrase, label in PHRASES:
        same = " AND ".join(f"lead(word, {k}) OVER o = '{w}'" if k else f"word = '{w}'" for k, w in enumerate(phrase.split()))
        at.append(f"WHEN {same} THEN '{label}'")
    return (
        f"WITH docs AS (SELECT doc_id, {split("coalesce(text, '')")} AS ws FROM documents), w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM docs), "
        f"p AS (SELECT doc_id, i, CASE {' '.join(at)} END AS label FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
        "base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY doc_id), "
        f"t AS ({templates}), tw AS (SELECT label, unnest(ws) AS word FROM t), m AS (SELECT w.doc_id, w.i, w.word, tw.label FROM w JOIN tw ON tw.word = w.word), "
        "able AS (SELECT m.doc_id, m.label FROM m JOIN t ON t.label = m.label GROUP BY m.doc_id, m.label, t.need HAVING count(DISTINCT m.word) >= t.need), "
        "near AS (SELECT m.* FROM m JOIN able ON able.doc_id = m.doc_id AND able.label = m.label), "
        "spans AS (SELECT a.doc_id, a.label, a.i, count(DISTINCT b.word) AS n FROM near a JOIN t ON t.label = a.label JOIN near b ON b.doc_id = a.doc_id AND b.label = a.label AND b.i BETWEEN a.i AND a.i + t.span - 1 GROUP BY a.doc_id, a.label, a.i), "
        "h AS (SELECT s.doc_id, s.label, max(s.n) / len(t.ws) AS score FROM spans s JOIN t ON t.label = s.label WHERE s.n >= t.need GROUP BY s.doc_id, s.label, len(t.ws)), "
        "every AS (SELECT doc_id, label FROM p WHERE label IS NOT NULL UNION SELECT doc_id, label FROM h), told AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id), best AS (SELECT doc_id, max(score) AS score FROM h GROUP BY doc_id) "
        "SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.z AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels, "
        "coalesce(e.labels, '') AS labels, CASE WHEN b.n > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(coalesce(s.score, 0) AS DOUBLE) END AS score "
        "FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN told e USING (doc_id) LEFT JOIN best s USING (doc_id)"
    )


def embedding_near_dedup() -> str:
    dot = lambda x, y: f"list_dot_product({x}, {y})"
    return (
        "WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), "
        f"links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {dot('a.e', 'b.e')} / sqrt({dot('a.e', 'a.e')} * {dot('b.e', 'b.e')}) >= 0.98), "
        "reach AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT l.b AS n, x.r FROM reach x JOIN links l ON l.a = x.n), "
        "low AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n), degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a) "
        "SELECT low.n AS vec_id, CAST(coalesce(degree.n_links, 0) AS BIGINT) AS n_links, low.component_id, (low.component_id = low.n) AS kept FROM low LEFT JOIN degree ON degree.a = low.n"
    )


ORACLE_SQL = {"op3_embedding_near_dedup": embedding_near_dedup(), "op7_license_scan": license_scan(), "op4_quality_rules": quality_rules(), "op8_line_dedup": line_dedup()}
