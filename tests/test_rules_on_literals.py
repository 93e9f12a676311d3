"""Rules of the plans on small documents, with results worked out by hand from the rules as published, not from the plans."""

import pytest

from docstrata.operators.sequential import retyped_items, select_disjoint_groups
from docstrata.plans.apply import run_plan
from docstrata.plans.catalog import _letters

TABLE = ["| a | b |", "| - | - |", "| 1 | 2 |"]
RECORD = "doc_id string, pos int, kind string, t string, style string, is_centered boolean, mostly_bold boolean, max_size double, has_page_boundary boolean, items string, num_id int, ilvl int, style_num_id int"


def ask(spark, name, lines, *columns, **more):
    held = [("d", k, x, *(v[k] for v in more.values())) for k, x in enumerate(lines)]
    schema = "doc_id string, pos int, line string" + "".join(f", {c} {'boolean' if c == 'page_before' else 'string'}" for c in more)
    return [tuple(r[c] for c in columns) for r in run_plan(name, lines=spark.createDataFrame(held, schema)).collect()]


def rec(pos, t, style="Normal", kind="paragraph", centered=False, bold=False, size=None, page=False, items=None, num=None, ilvl=None, style_num=None):
    return ("d", pos, kind, t, style, centered, bold, size, page, items, num, ilvl, style_num)


def ask_records(spark, name, held, *columns, **more):
    return [tuple(r[c] for c in columns) for r in run_plan(name, records=spark.createDataFrame(held, RECORD), **more).collect()]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["表1 A", *TABLE, "表2 B", "x"], {(0, "associated", "before", False), (4, "duplicate_caption_association", "after", False)}),
        (["图1 A", *TABLE], {(0, "orphan_caption", None, False)}),
        ([*TABLE, "表1 A", "| c | d |", "| - | - |", "| 3 | 4 |"], {(3, "ambiguous_caption_association", None, False)}),
        (["![](a.png)", "图1 A"], {(1, "associated", "after", False)}),
        (["图1 A", "![](a.png)"], {(0, "associated", "before", True)}),
        ([*TABLE, "表1 A", "x"], {(3, "associated", "after", True)}),
    ],
)
def test_captions_are_claimed_by_one_fitting_neighbour(spark, lines, want):
    assert set(ask(spark, "caption_adjacency", lines, "pos", "status", "placement", "moved")) == want


def test_captions_move_to_their_place(spark):
    assert sorted(ask(spark, "caption_order", [*TABLE, "表1 A", "x"], "new_ord", "pos")) == [(1, 3), (2, 0), (3, 4)]
    assert sorted(ask(spark, "caption_order", ["图1 A", "![](a.png)", "x"], "new_ord", "pos")) == [(1, 1), (2, 0), (3, 2)]


def test_tables_without_a_caption_get_one_unless_an_ambiguous_one_blocks_it(spark):
    got = sorted(ask(spark, "caption_placement", ["x", *TABLE], "ord", "block_type", "caption_id"))
    assert got == [(1, "body", None), (2, "caption", "caption-auto-1"), (3, "table", None)]
    both = [*TABLE, "表1 A", "| c | d |", "| - | - |", "| 3 | 4 |"]
    assert [x for x in ask(spark, "caption_placement", both, "caption_id") if x[0]] == []
    assert sorted(ask(spark, "caption_missing", both, "table_pos", "blocked")) == [(0, True), (4, True)]
    assert [x for x in ask(spark, "caption_placement", ["x", "| a |", "| - |", "| GET /x |"], "caption_id") if x[0]] == []  # a code sample


def test_appendix_ids(spark):
    frame = spark.createDataFrame([(k,) for k in (1, 26, 27, 52, 53, 702, 703, 729)], "k int")
    assert [r.x for r in frame.selectExpr(f"{_letters('k')} AS x").collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ABA"]
    assert ask(spark, "appendix_ids", ["附录C 标题", "x"], "by_number", "appendix_id") == [("A", "C")]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["附录A 标题", "x"], [(0, 1.0, True)]),
        (["附录：说明"], [(0, 0.6, False)]),
        (["附录：说明", "x"], [(0, 0.7, True)]),
        (["## 附录", "x", "## B"], [(0, 0.85, True)]),  # a heading of its level follows
        (["a", "b", "c", "d", "e", "f", "g", "## 附录", "x"], [(7, 1.0, True)]),
        (["参见附录A", "x"], []),
    ],
)
def test_appendix_candidates(spark, lines, want):
    assert ask(spark, "appendix_scores", lines, "pos", "confidence", "accepted") == want


def test_a_page_border_before_a_candidate_counts(spark):
    got = ask(spark, "appendix_scores", ["附录：说明"], "confidence", "accepted", page_before=[True])
    assert got == [(0.8, True)]


def test_appendix_titles_and_headings(spark):
    lines = ["附录A （资料性）数据", "A.1 概述", "A.1.2 细节", "B.1 其他", "## 范围", "### 细则"]
    assert ask(spark, "appendix_titles", lines, "appendix_id", "classification", "title") == [("A", "资料性", "数据")]
    want = [(1, 1, "概述"), (2, 2, "细节"), (4, 1, "范围"), (5, 2, "细则")]
    assert sorted(ask(spark, "appendix_headings", lines, "pos", "level", "text")) == want


def test_group_scores_heed_the_end_of_the_anchor(spark):
    items = ["Alp：aa", "Bet：bb", "Gam：cc"]
    for anchor, want in (("内容：", 0.99), ("完成", 0.98), ("完成。", 0.88), ("完成，", 0.98)):
        assert ask(spark, "group_scores", [anchor, *items], "start_i", "end_i", "confidence") == [(1, 4, want)]
    assert ask(spark, "group_scores", ["完成。", "one", "two", "six"], "confidence") == []


def test_group_families_and_retyped_lines(spark):
    lines = ["内容：", "■ Alp：aa", "■ Bet：bb", "■ Gam：cc"]
    assert ask(spark, "group_families", lines, "family", "source") == [("unordered", "visible_unordered_marker")]
    assert ask(spark, "group_families", ["内容：", "Alp：aa", "Bet：bb", "Gam：cc"], "family", "confidence") == [("ordered", 0.5)]
    groups = spark.createDataFrame([("d", 0, 1, 4, 3, 0.0, 1.0, 0.9), ("d", 0, 4, 7, 3, 0.0, 0.0, 0.7), ("e", 0, 1, 4, 3, 0.0, 0.0, 0.99)], "doc_id string, run long, start_i long, end_i long, size long, ordered double, markers double, confidence double")
    places = spark.createDataFrame([(x, 0, i, 10 + i) for x in "de" for i in range(1, 9)], "doc_id string, run long, i long, pos long")
    got = sorted(map(tuple, retyped_items(select_disjoint_groups(groups), places).collect()))
    assert got == [("d", 12, "dash", 0, True), ("d", 13, "dash", 0, False), ("d", 14, "dash", 0, False), *[("e", 11 + k, "lower_letter_paren", 0, k == 1) for k in (1, 2, 3)]]


def test_suspicion_sums_the_signals(spark):
    lines = ["## T", "short", "a long body line that certainly has more than thirty characters.", "a) item", *TABLE]
    assert ask(spark, "suspicion_score", lines, "score") == [(0.37,)]  # 0.2/2 + 0.1 + 0.15 + 0.1/5
    assert ask(spark, "auto_gate_lists", lines, "runs") == [(True,)]
    assert ask(spark, "suspicion_score", ["## T", "### U"], "score") == [(0.0,)]


def test_findings_and_decisions(spark):
    lines = ["### T", "1.2 Numbered", "##### Deep", "a) item", "表1 x", "y", *TABLE]
    want = {(0, "first_below_one"), (1, "heading_manual_number"), (2, "heading_jump"), (3, "list_manual_marker"), (4, "caption_orphan"), (6, "table_without_caption")}
    assert set(ask(spark, "findings_union", lines, "pos", "category")) == want
    assert ask(spark, "audit_score", lines, "critical", "high", "medium", "low", "score") == [(0, 2, 3, 1, 231)]
    assert set(ask(spark, "unresolved_targets", lines, "pos", "category")) == {(0, "first_below_one"), (2, "heading_jump")}
    assert ask(spark, "accept_decision", lines, "accepted", "reason") == [(True, "audit_score_improved")]
    assert ask(spark, "accept_decision", ["## T", "x"], "accepted", "reason") == [(False, "audit_score_did_not_improve")]
    assert ask(spark, "signature_diff", ["## 1.2 T", "a) item", "备注：x", "y"], "pos") == [(1,), (2,)]


def test_sections_in_doubt(spark):
    lines = ["## A", "A long line of prose that ends with a full stop and is clear.。", "## B", "short"]
    assert ask(spark, "suspicious_sections", lines, "start_pos", "suspicious") == [(2, True)]
    assert sorted(ask(spark, "suspicious_sections", lines[:2], "start_pos", "suspicious")) == [(0, False)]


def test_contents_region(spark):
    held = [rec(0, "目录"), rec(1, "概述\t1"), rec(2, "1.2 范围\t2"), rec(3, "总结\t3", page=True), rec(4, "概述", "Heading 1"), rec(5, "x"), rec(6, "范围", "Heading 1")]
    assert ask_records(spark, "toc_select", held, "start_pos", "end_pos", "confidence", "status") == [(0, 3, 1.0, "detected")]
    assert ask_records(spark, "toc_entry_overlap", held, "repeats") == [(2,)]
    assert ask_records(spark, "toc_candidates", [rec(0, "目录"), rec(1, "abc\t1"), rec(2, "x")], "confidence") == []  # 0.25 + 0.10
    # Without a page border the region ends before the first heading that an entry names; 0.25 + 0.10 + 0.20.
    open_end = [rec(0, "目录"), rec(1, "概述\t1"), rec(2, "范围\t2"), rec(3, "概述", "Heading 1")]
    assert ask_records(spark, "toc_select", open_end, "end_pos", "confidence", "status") == [(2, 0.55, "ambiguous")]
    assert ask_records(spark, "toc_review", open_end, "start_pos") == [(0,)]


def test_front_matter(spark):
    held = [rec(0, "X技术方案", centered=True, bold=True, size=22.0), rec(1, "版本：1.0"), rec(2, "", page=True), rec(3, "概述", "Heading 1"), rec(4, "x")]
    assert ask_records(spark, "front_matter", held, "status", "cover_end", "title", "title_source", "body_start") == [("cover_detected", 2, "X技术方案", "source", 3)]
    assert ask_records(spark, "title_top1", held, "title", "score") == [("X技术方案", 117.0)]  # 25 + 20 + 22 + 12 + 30 + 8
    assert ask_records(spark, "cover_score", held, "edge_score") == [(4,)]
    plain = [rec(0, "hello"), rec(1, "概述", "Heading 1")]
    assert ask_records(spark, "front_matter", plain, "status", "cover_end", "title", "title_source", "body_start") == [("no_cover", None, "file_d", "filename", 0)]
    long = [rec(0, "词" * 121), rec(1, "", page=True), rec(2, "", page=True), rec(3, "概述", "Heading 1")]
    assert ask_records(spark, "cover_score", long, "edge_score", "prefix_score") == [(-1, 0)]
    table = [rec(0, "版本：1 日期：2", kind="table", items="版本：1|日期：2"), rec(1, "概述", "Heading 1")]
    assert ask_records(spark, "cover_score", table, "prefix_score") == [(2,)]
    assert ask_records(spark, "metadata_tables", table, "is_metadata") == [(True,)]


def test_paragraph_rules(spark):
    held = [
        rec(0, "返回示例：", "Heading 2"), rec(1, "概要", bold=True), rec(2, "状态：在职、离职", bold=True), rec(3, "编制（示例）", bold=True), rec(4, "说明。", bold=True),
        rec(5, "6.3 配置管理"), rec(6, "a) x"), rec(7, "注1：y"), rec(8, "附录A"), rec(9, "x", "列项 1"), rec(10, "引言\t3"), rec(11, "表1 t"), rec(12, "z", "文档标题"),
    ]
    roles = dict(ask_records(spark, "docx_roles", held, "pos", "role"))
    assert roles == {0: "body", 1: "heading", 2: "body", 3: "body", 4: "body", 5: "heading", 6: "list", 7: "numbered_note", 8: "appendix_title", 9: "list", 10: "skip", 11: "caption", 12: "title"}
    assert ask_records(spark, "visual_headings", held, "pos") == [(1,)]
    assert ask_records(spark, "compact_headings", held, "text", "compact") == [("配置管理", True)]
    flags = {r[0]: r[1:] for r in ask_records(spark, "record_flags", [rec(0, "版本 2"), rec(1, "x", "List Bullet 2"), rec(2, "y", "TOC 1"), rec(3, "机密", "Title")], "pos", "is_metadata", "is_list_style", "is_protected", "is_title_style", "is_toc_style")}
    assert flags == {0: (True, False, False, False, False), 1: (False, True, False, False, False), 2: (False, False, True, False, True), 3: (True, False, True, True, False)}


def test_heading_levels_by_style_numbering_and_text(spark):
    held = [rec(0, "x", "Heading 3", num=1, ilvl=0), rec(1, "x", num=1, ilvl=1), rec(2, "6.3 x"), rec(3, "x"), rec(4, "x", style_num=4)]
    got = sorted(ask_records(spark, "heading_sources", held, "pos", "level", "source"))
    assert got == [(0, 3, "docx-numbering"), (1, 2, "docx-numbering"), (2, 2, "docx-text"), (3, 1, "assumed"), (4, 1, "docx-numbering")]
    assert sorted(ask_records(spark, "num_info", held, "pos", "num_id", "ilvl", "source")) == [(0, 1, 0, "direct"), (1, 1, 1, "direct"), (4, 4, 0, "style")]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (["| 1 | 2 |"], "data"), (["| |"], "layout"), (["| note |"], "callout"), (["| {1} |"], "code_sample"), (["| GET /x |", "| b |"], "code_sample"), (["| a | b |", "| c | d |", "| e | {1} |"], "data"),
        (["| a | b | c | d |", "| e | f | g | {\"" + "x" * 80 + "\"} |"], "code_sample"),
    ],
)
def test_kinds_of_tables(spark, rows, want):
    lines = ["| h | i |", "| --- | --- |", *rows]
    assert ask(spark, "table_class", lines, "table_type") == [(want,)]
    roles = {r for (r,) in ask(spark, "table_cells", lines, "cell_role")}
    assert roles == {"data": {"header", "body"} if len(rows) > 1 else {"header"}, "code_sample": {"code"}}.get(want, {"body"})


def test_markers_of_no_known_list(spark):
    lines = ["## A", "■ x", "■ y", "➤ z", "➤z", "§ a", "§a", "-1", "- 1", "--- x", "# x", "(a) x", "1) x", "■"]
    got = sorted(ask(spark, "unordered_candidates", lines, "pos", "marker", "known", "n_in_section"))
    assert got == [(1, "■", True, 2), (2, "■", True, 2), (3, "➤", False, 2), (4, "➤", False, 2), (5, "§", False, 1), (8, "-", True, 1)]


def test_levels_of_unordered_items(spark):
    rows = lambda levels, ordered=(): spark.createDataFrame([("d", 1, k, v, k in ordered) for k, v in enumerate(levels)], "doc_id string, gid int, pos int, level int, ordered boolean")
    fold = lambda *a: [(r.level, r.list_type) for r in sorted(run_plan("level_fold", items=rows(*a)).collect(), key=lambda r: r.pos)]
    assert [x for x, _ in fold([0, 3, 1, 3])] == [0, 1, 1, 2]
    assert fold([2, 3, 2]) == [(0, "dash"), (1, "bullet_dot"), (0, "dash")]
    assert fold([2, 3, 5], (0,)) == [(2, "ordered"), (3, "bullet_dot"), (4, "bullet_dot")]


def test_responses_must_answer_what_was_asked(spark):
    import hashlib
    import json

    def request(key, prompt, **more):
        asked = {"protocol_version": "1.0", "run_id": "r", "request_id": key, "phase": "A", "capability": "list_detect", "prompt": prompt}
        told = "sha256:" + hashlib.sha256(json.dumps(asked, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        return tuple((asked | {"input_hash": told} | more).values())

    asked = [request("q1", 'a "quoted"\nline 中文'), request("q2", "x"), request("q3", "x", input_hash="sha256:0"), request("q4", "x"), request("q5", "x"), request("q6", "x")]
    requests = spark.createDataFrame(asked, "protocol_version string, run_id string, request_id string, phase string, capability string, prompt string, input_hash string")
    told = [(1, "1.0", "q1", "{}", "sha256:0"), (2, "1.0", "q1", "{}", asked[0][-1]), (3, "1.0", "q2", "no patch", asked[1][-1]), (4, "1.0", "q3", "{}", "sha256:0"), (5, "0.9", "q4", "{}", asked[3][-1]), (6, "1.0", "q6", "{}", asked[5][-1]), (7, "1.0", "q6", "{}", "sha256:1")]
    responses = spark.createDataFrame(told, "seq int, protocol_version string, request_id string, raw_response string, input_hash string")
    got = {r.request_id: r.status for r in run_plan("response_status", requests=requests, responses=responses).collect()}
    assert got == {"q1": "ok", "q2": "parse_error", "q3": "verification_error", "q4": "verification_error", "q5": "missing_response", "q6": "verification_error"}
    assert {r.request_id: r.same for r in run_plan("request_hash", requests=requests, responses=responses).collect()} == {f"q{k}": k != 3 for k in range(1, 7)}


def test_list_descriptors(spark):
    rows = [(1, 0, "decimal", "%1)", "", 1), (2, 0, "decimal", "%2)", "", 3), (3, 0, "none", "", "", 1), (4, 0, "bullet", "●", "", 1), (5, 0, "bullet", "•", "", 1)]
    definitions = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, num_id int, ilvl int, num_fmt string, lvl_text string, p_style string, start int")
    held = [rec(0, "a", num=1, ilvl=0), rec(1, "b", num=1, ilvl=0), rec(2, "c", num=2, ilvl=0), rec(3, "x"), rec(4, "d", num=1, ilvl=0), rec(5, "x"), rec(6, "e", num=3, ilvl=0), rec(7, "f", num=4, ilvl=0), rec(8, "g", num=5, ilvl=0), rec(9, "h", "Heading 1", num=1, ilvl=0)]
    got = {r[0]: r[1:] for r in ask_records(spark, "list_descriptors", held, "pos", "group_size", "restart", "status", "confidence", definitions=definitions)}
    assert got == {0: (3, True, "detected", 0.9), 1: (3, False, "detected", 0.9), 2: (3, False, "detected", 0.9), 4: (1, True, "ambiguous", 0.55), 6: (1, True, "ignored", 0.0), 7: (2, True, "detected", 0.9), 8: (2, False, "detected", 0.9), 9: (1, True, "ignored", 0.0)}
    assert set(ask_records(spark, "marker_templates", held, "lvl_text", "template", "family", definitions=definitions)) >= {("%1)", "%n)", "%1)"), ("●", "●", "round"), ("•", "•", "round")}


def test_markdown_files_reach_the_plans(spark, tmp_path):
    from docstrata.sources.files import markdown_documents

    (tmp_path / "a.md").write_text("# 标题\n\n## 1.1 概述\n\n- x\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")
    (tmp_path / "b.md").write_text("text only\n")
    lines = markdown_documents(spark, str(tmp_path))
    got = {(r.doc_id.rsplit("/", 1)[-1], r.block_type): r.n for r in run_plan("block_counts", lines=lines).collect()}
    assert got[("a.md", "heading")] == 2 and got[("a.md", "table")] == 1 and got[("b.md", "body")] == 1


def test_word_files_reach_the_plans(spark, tmp_path):
    import io
    import zipfile

    from docstrata.sources.files import docx_records

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    par = lambda t, extra="", run="": f"<w:p><w:pPr>{extra}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    body = par("X技术方案", '<w:jc w:val="center"/>', '<w:b/><w:sz w:val="44"/>') + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>版本：1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>日期：2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body += '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br w:type="page"/></w:r></w:p>' + par("概述", '<w:pStyle w:val="Heading1"/>') + par("x", '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr>')
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {space}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>')
    (tmp_path / "a.docx").write_bytes(held.getvalue())
    rows = docx_records(spark, str(tmp_path))
    got = [(r.pos, r.kind, r.style, r.t, r.items, r.is_centered, r.mostly_bold, r.max_size, r.has_page_boundary, r.num_id, r.ilvl) for r in rows.orderBy("pos").collect()]
    assert got[0] == (0, "paragraph", "", "X技术方案", None, True, True, 22.0, False, None, None)
    assert got[1][1:5] == ("table", "", "版本：1 日期：2", "版本：1|日期：2")
    assert got[2][3] == "a\tb\n" and got[2][8]
    assert got[3][2] == "heading 1" and got[4][9:] == (7, 1)
    told = run_plan("front_matter", records=rows).first()
    assert (told.status, told.title, told.cover_end) == ("cover_detected", "X技术方案", 2)
