"""Patches and normalization on small models, with results worked out by hand from the rules."""

import pytest

from docstrata.plans.apply import run_plan

MODEL = {
    "doc_id": ("string", "d"), "pos": ("int", 0), "block_id": ("string", None), "block_type": ("string", "body"), "role": ("string", None), "level": ("int", None), "list_type": ("string", None), "restart": ("boolean", None), "text": ("string", "x"), "raw": ("string", None),
    "style": ("string", "Normal"), "source_role": ("string", None), "status": ("string", None), "ilvl": ("int", None), "num_list_type": ("string", None), "unordered": ("boolean", False), "group_id": ("string", None), "family": ("string", None), "family_source": ("string", None),
    "table_type": ("string", None), "header_rows": ("int", None), "n_rows": ("int", None), "caption_type": ("string", None), "auto_generated": ("boolean", False), "original_type": ("string", None), "group_status": ("string", None), "inferred_role": ("string", None),
}
DECISION = {
    "doc_id": ("string", "d"), "idx": ("int", 0), "block_id": ("string", "b0"), "operation": ("string", "retype"), "confidence": ("double", 0.9), "fields": ("string", None), "to_type": ("string", None), "to_level": ("int", None), "to_list_type": ("string", None), "to_restart": ("boolean", None),
    "to_table_type": ("string", None), "to_header_rows": ("int", None), "to_caption_type": ("string", None), "to_text": ("string", None),
}


def relation(spark, shape, rows):
    held = []
    for k, row in enumerate(rows):
        own = {c: v for c, (_, v) in shape.items()} | ({"pos": k, "block_id": f"b{k}"} if shape is MODEL else {"idx": k}) | row
        assert set(own) == set(shape)
        held.append(tuple(own.values()))
    return spark.createDataFrame(held, ", ".join(f"{c} {t}" for c, (t, _) in shape.items()))


def ask(spark, name, blocks, decisions, *columns):
    made = run_plan(name, model=relation(spark, MODEL, blocks), decisions=relation(spark, DECISION, decisions))
    return [tuple(r[c] for c in columns) for r in made.collect()]


RETYPE = {"operation": "retype", "fields": "block_type,level", "to_type": "heading", "to_level": 2}
LIST = {"operation": "retype", "fields": "block_type,level,list_type", "to_type": "list_item", "to_level": 0, "to_list_type": "dash"}


@pytest.mark.parametrize(
    ("block", "decision", "errors"),
    [
        ({}, RETYPE, set()),
        ({}, RETYPE | {"block_id": None}, {"missing_block_id"}),
        ({}, RETYPE | {"block_id": "zz"}, {"unknown_block"}),
        ({}, RETYPE | {"operation": "rename"}, {"operation_not_allowed"}),
        ({}, RETYPE | {"to_type": "footer", "fields": "block_type"}, {"invalid_block_type"}),
        ({}, RETYPE | {"to_level": 7}, {"heading_level_out_of_range"}),
        ({}, RETYPE | {"fields": "block_type,level,style"}, {"unexpected_fields"}),
        ({}, LIST, set()),
        ({"style": "Heading 1"}, LIST, {"heading_style_to_list"}),
        ({"status": "ignored"}, LIST, {"ignored_numbering_to_list"}),
        ({"status": "ambiguous", "ilvl": 0, "num_list_type": "dash"}, LIST, set()),
        ({"status": "ambiguous", "ilvl": 1, "num_list_type": "dash"}, LIST, {"ambiguous_numbering_changed"}),
        ({"unordered": True}, LIST, set()),
        ({"unordered": True}, LIST | {"to_list_type": "decimal_paren"}, {"unordered_marker_lost"}),
        ({"group_id": "g", "family": "ordered", "family_source": "visible_ordered_marker"}, LIST, {"list_family_changed"}),
        ({"group_id": "g", "family": "ordered", "family_source": "semantic_default_ordered"}, LIST, set()),
        ({}, LIST | {"to_level": 9}, {"list_level_out_of_range"}),
        ({}, LIST | {"to_list_type": "star"}, {"invalid_list_type"}),
        ({}, {"operation": "adjust_level", "fields": "level", "to_level": 0}, set()),
        ({"block_type": "heading"}, {"operation": "adjust_level", "fields": "level", "to_level": 0}, {"level_out_of_range"}),
        ({}, {"operation": "adjust_level", "fields": "level,role", "to_level": 1}, {"fields_not_exact"}),
        ({"block_type": "table", "n_rows": 3}, {"operation": "set_header_rows", "fields": "header_rows", "to_header_rows": 3}, set()),
        ({"block_type": "table", "n_rows": 3}, {"operation": "set_header_rows", "fields": "header_rows", "to_header_rows": 4}, {"header_rows_out_of_range"}),
        ({"block_type": "table"}, {"operation": "set_table_type", "fields": "table_type", "to_table_type": "grid"}, {"invalid_table_type"}),
        ({"block_type": "caption"}, {"operation": "set_caption_type", "fields": "caption_type", "to_caption_type": "chart"}, {"caption_type_unknown"}),
        ({"block_type": "caption", "text": "a"}, {"operation": "set_caption_text", "fields": "text", "to_text": "t" * 101}, {"caption_text_too_long", "caption_not_generated", "caption_not_empty", "caption_of_no_data_table"}),
    ],
)
def test_rules_of_a_decision(spark, block, decision, errors):
    assert {e for (e,) in ask(spark, "validate_patch", [block], [decision], "error")} == errors
    assert ask(spark, "patch_status", [block], [decision], "valid") == [(not errors,)]


def test_caption_text_goes_to_the_table_behind(spark):
    caption = {"block_type": "caption", "text": "", "auto_generated": True}
    text = {"operation": "set_caption_text", "fields": "text", "to_text": "t"}
    for kind, want in (("data", []), ("layout", [("caption_of_no_data_table",)])):
        assert ask(spark, "validate_patch", [caption, {}, {"block_type": "table", "table_type": kind}], [text], "error") == want
    assert ask(spark, "validate_patch", [caption, {"block_type": "heading"}, {"block_type": "table", "table_type": "data"}], [text], "error") == [("caption_of_no_data_table",)]


def test_groups_are_retyped_whole_and_alike(spark):
    member = {"group_id": "g", "family": "ordered", "family_source": "semantic_default_ordered"}
    both = [LIST | {"block_id": "b0"}, LIST | {"block_id": "b1"}]
    assert ask(spark, "group_atomicity", [member, member], both, "named", "size", "atomic", "uniform") == [(2, 2, True, True)]
    assert ask(spark, "group_atomicity", [member, member], both[:1], "atomic", "uniform") == [(False, True)]
    assert ask(spark, "group_atomicity", [member, member], [both[0], both[1] | {"to_level": 1}], "atomic", "uniform") == [(True, False)]
    assert ask(spark, "validate_patch", [member, member], both[:1], "error") == [("group_not_atomic",)]
    assert ask(spark, "unexpected_fields", [{}], [RETYPE | {"fields": "block_type,color,level,style"}], "unexpected") == [("color,style",)]


def test_decisions_are_applied_in_order(spark):
    blocks = [{"block_type": "list_item", "role": "list_item", "level": 2, "list_type": "dash", "restart": True, "text": "t"}, {"block_type": "table", "header_rows": 1, "table_type": "data"}, {}]
    steps = [
        {"operation": "adjust_level", "fields": "level", "to_level": 5}, RETYPE, {"operation": "adjust_level", "fields": "level", "to_level": 3}, RETYPE | {"confidence": 0.69, "to_level": 6},
        {"block_id": "b1", "operation": "set_header_rows", "fields": "header_rows", "to_header_rows": 2}, {"block_id": "zz", "operation": "set_restart", "fields": "restart", "to_restart": True},
    ]
    columns = ("block_id", "block_type", "role", "level", "list_type", "restart", "header_rows", "table_type", "changed")
    assert sorted(ask(spark, "apply_patch", blocks, steps, *columns)) == [
        ("b0", "heading", "heading", "3", None, None, None, None, True), ("b1", "table", None, None, None, None, "2", "data", True), ("b2", "body", None, None, None, None, None, None, False),
    ]
    assert ask(spark, "applied_rate", blocks, steps, "applied", "skipped", "errors", "rate") == [(4, 1, 1, 0.8)]


@pytest.mark.parametrize(
    ("block", "want"),
    [
        ({"text": "1.2 概述"}, ("heading", "heading", 2, None, "概述", "body_retyped_as_heading")),
        ({"text": "a) x"}, ("list_item", None, 0, "lower_letter_paren", "x", "body_retyped_as_list_item,list_restart_normalized")),
        ({"text": "1) x"}, ("list_item", None, 1, "decimal_paren", "x", "body_retyped_as_list_item,list_restart_normalized")),
        ({"text": "表1 x"}, ("caption", None, None, None, "表1 x", "body_retyped_as_caption")),
        ({"text": "附录A x"}, ("appendix", None, None, None, "附录A x", "body_retyped_as_appendix")),
        ({"text": "备注：x", "role": "note"}, ("body", "note", None, None, "x", "note_prefix_normalized")),
        ({"text": "1.2 x", "source_role": "note"}, ("body", "note", None, None, "1.2 x", "body_role_promoted")),
        ({"text": "x", "status": "detected", "ilvl": 0, "num_list_type": "decimal_paren"}, ("list_item", None, 0, "lower_letter_paren", "x", "body_retyped_from_source_numbering,list_type_aligned_to_wx_level,list_restart_normalized")),
        ({"block_type": "list_item", "text": "6.3 Title", "raw": "6.3 Title", "list_type": "dash", "level": 0}, ("heading", "heading", 2, None, "Title", "list_item_retyped_as_hierarchical_heading")),
        ({"block_type": "list_item", "text": "x", "raw": "x", "status": "ignored", "list_type": "dash", "level": 0}, ("body", None, None, None, "x", "invalid_list_style_retyped_as_body")),
        ({"block_type": "list_item", "text": "—— x", "list_type": "dash", "level": 1, "restart": True}, ("list_item", None, 1, "bullet_dot", "x", "list_manual_marker_removed,list_type_aligned_to_wx_level")),
        ({"block_type": "list_item", "text": "x", "list_type": "star", "level": 0, "restart": True}, ("list_item", None, 0, "lower_letter_paren", "x", "list_type_normalized")),
        ({"block_type": "heading", "role": "heading", "level": 1, "text": "第一章 总则"}, ("heading", "heading", 1, None, "总则", "heading_manual_number_removed")),
        ({"block_type": "heading", "role": "title", "level": 0, "text": "1.2 T"}, ("heading", "title", 0, None, "1.2 T", "")),
        ({"block_type": "table", "table_type": "layout", "header_rows": 1}, ("table", None, None, None, "x", "non_data_table_header_rows_zero")),
        ({"text": "x", "style": "附录标题"}, ("appendix", None, None, None, "x", "source_style_retyped_as_appendix")),
        ({"text": "plain"}, ("body", None, None, None, "plain", "")),
    ],
)
def test_normal_form(spark, block, want):
    made = run_plan("normalize_model", model=relation(spark, MODEL, [block])).collect()
    assert [(r.block_type, r.role, r.level, r.list_type, r.text, r.repairs) for r in made] == [want]


def test_lists_restart_after_other_blocks(spark):
    item = {"block_type": "list_item", "list_type": "dash", "level": 0, "restart": False}
    made = run_plan("normalize_model", model=relation(spark, MODEL, [item, item, {}, item])).collect()
    assert [r.restart for r in sorted(made, key=lambda r: r.pos)] == [True, False, None, True]


def test_hints(spark):
    hints = spark.createDataFrame([(1, 1, " a\t\tb#$%中文，c "), (2, 1, "x" * 600)], "conv_id long, turn int, hint string")
    got = {r.conv_id: (r.hint, r.truncated) for r in run_plan("hint_texts", hints=hints).collect()}
    assert got == {1: ("a b中文，c", False), 2: ("x" * 500, True)}


def test_origins_and_preservation_of_lists(spark):
    item = {"block_type": "list_item", "list_type": "dash", "level": 0}
    blocks = [item | {"original_type": "body", "status": "detected"}, item | {"status": "detected"}, item | {"group_status": "auto"}, item | {"raw": "a) x"}, item | {"inferred_role": "body"}, item | {"inferred_role": "list"}, {"status": "detected"}, item | {"status": "ignored"}]
    got = {r.origin: r.n for r in run_plan("origin_counts", model=relation(spark, MODEL, blocks)).collect()}
    assert got == {"llm": 1, "rules": 3, "semantic_group_rules": 1, "text_marker": 1, "normalization_fallback": 1}
    shown = spark.createDataFrame([("d", k, "1.2一级列项-无编号" if k else "List Number") for k in range(7)], "doc_id string, pos int, style string")
    ask_lists = lambda rows: [tuple(r)[1:] for r in run_plan("list_preservation", model=relation(spark, MODEL, blocks), rendered=rows).collect()]
    assert ask_lists(shown) == [(7, 7, 1, 1, 1)]
    assert ask_lists(shown.where("pos > 0")) == [(7, 6, 0, 1, 1)]  # other numbers: styles are not compared


def test_model_rows_and_source_records(spark):
    from docstrata.operators.model import model_rows

    rows = spark.createDataFrame([("d", 0, "heading", "T", None), ("d", 1, "list_item", "x", 2), ("d", 2, "table", None, None)], "doc_id string, pos int, block_type string, text string, level int")
    made = model_rows(rows).collect()
    assert [(r.block_id, r.level, r.list_type, r.role, r.table_type, r.header_rows, r.text) for r in made] == [
        ("b0001", 1, None, "heading", None, None, "T"), ("b0002", 2, "lower_letter_paren", "list_item", None, None, "x"), ("b0003", None, None, None, "data", 1, ""),
    ]
    block = relation(spark, MODEL, [{"raw": 'a "b"', "status": "", "style": "S"}])
    assert run_plan("source_records", model=block).first().source == '{"raw_text":"a \\"b\\"","style":"S"}'


def test_output_blocks(spark):
    held = [("d", 0, "paragraph", "T", "文档标题"), ("d", 1, "table", "c", ""), ("d", 2, "paragraph", "A", "Heading 2"), ("d", 3, "paragraph", "表1 x", "Normal"), ("d", 4, "paragraph", "i", "1.2一级列项-无编号"), ("d", 5, "paragraph", "n", "3.1注-无编号注")]
    made = run_plan("output_blocks", records=spark.createDataFrame(held, "doc_id string, pos int, kind string, t string, style string")).collect()
    assert [(r.block_id, r.block_type, r.role, r.level) for r in sorted(made, key=lambda r: r.ord)] == [
        ("b0001", "heading", "title", 0), ("b0002", "heading", None, 2), ("b0003", "caption", None, None), ("b0004", "list_item", None, None), ("b0005", "body", "note", None), ("b0006", "table", None, None),
    ]
