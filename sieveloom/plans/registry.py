"""Queries of the question-bank operators, by the ids of the operator inventory."""

from __future__ import annotations

from ..operators import clean, export, geometry, layout, parse, pipeline, requests, resolve, spans, validate
from . import views as v
from .dialect import Plan


def _lines(d):
    return d.lines("@docs", "doc_id", "text")


DOC_LINES = Plan(_lines, docs=v.DIRTY)

PLANS: dict[str, Plan] = {
    "c02_quotes": Plan(clean.c02_quotes, docs=v.DIRTY),
    "c03_unmarked_correct": Plan(clean.c03_unmarked_correct, lines=v.DASH),
    "c04_dashes": Plan(clean.c04_dashes, lines=v.DASH),
    "c05_whitespace": Plan(clean.c05_whitespace, lines=DOC_LINES),
    "c06_arabic_marks": Plan(clean.c06_arabic_marks, lines=DOC_LINES),
    "c07_super_subscripts": Plan(clean.c07_super_subscripts, docs=v.DIRTY),
    "c08_orphan_numerators": Plan(clean.c08_orphan_numerators, lines=v.DASH),
    "c10_inline_fractions": Plan(clean.c10_inline_fractions, docs=v.DIRTY),
    "c11_bom": Plan(clean.c11_bom, docs=v.DIRTY),
    "c12_page_numbers": Plan(clean.c12_page_numbers, lines=v.DASH),
    "g01_spaced_rules": Plan(parse.g01_spaced_rules, lines=v.RULED),
    "g02_classic_parse": Plan(parse.g02_classic, lines=v.CLASSIC),
    "g03_no_markers": Plan(parse.g03_no_markers, lines=v.BARE),
    "g05_detect_format": Plan(parse.g05_detect, lines=v.GIFT),
    "g06_images": Plan(parse.g06_images, docs=v.DIRTY),
    "g07_abc_parse": Plan(parse.g07_abc, lines=v.ABC),
    "g08_blocks_parse": Plan(parse.g08_blocks, lines=v.BLOCKS),
    "g09_gift_parse": Plan(parse.g09_gift, lines=v.GIFT),
    "g10_quiz_parse": Plan(parse.g10_quiz, lines=v.CLASSIC),
}

for _name in ("v01_dedup", "v02_removed", "v03_validate", "v03_issues", "v04_truncate", "v05_option_dedup", "v06_correct_index", "v07_post_dedup", "v08_correct_count", "v09_valid", "v10_potentially_valid", "v11_split", "w09_best_per_key", "a01_stats", "a02_success_rate", "a18_summary"):
    PLANS[_name] = Plan(getattr(validate, _name), opt=v.OPT)
for _name in ("j01_merge", "j03_retry_merge", "w17_retry_chunks", "a03_statistics", "a05_merge_counts", "a06_recount"):
    PLANS[_name] = Plan(getattr(resolve, _name), opt=v.OPT, answers=v.ANSWERS)
for _name in ("j02_resolved", "w20_unresolved", "w15_chunks", "w16_chunks_with_images"):
    PLANS[_name] = Plan(getattr(resolve, _name), opt=v.OPT)
for _name in ("v12_confidence", "v13_tier", "v14_descriptions", "v15_clean_json", "a08_tool_uses"):
    PLANS[_name] = Plan(getattr(resolve, _name), answers=v.ANSWERS)
for _name in ("a07_tokens", "a09_refusals", "j04_prices", "r10_latest"):
    PLANS[_name] = Plan(getattr(resolve, _name), log=v.LOG)
PLANS["r07_allowed"] = Plan(resolve.r07_allowed, log=v.LOG, customers="customer")

for _name in ("x01_strong", "x02_fully_bold", "x04_blocks", "x05_block_answer", "x11_bold_chunks", "x12_bold_option", "s15_table_bold", "s16_bold_to_marks"):
    PLANS[_name] = Plan(getattr(layout, _name), runs=v.RUNS)
for _name in ("x06_mark_highlighted", "x07_mark_numbered", "x08_mark_before_dash", "x15_all_correct", "x16_header_lines", "g04_split_merged", "x14_explicit_correct"):
    PLANS[_name] = Plan(getattr(layout, _name), lines=v.CLASSIC)
for _name in ("x17_leading_headers", "x18_trailing_footers"):
    PLANS[_name] = Plan(getattr(layout, _name), lines=v.BLOCKS)
PLANS["x09_number_unnumbered"] = Plan(layout.x09_number_unnumbered, lines=v.LETTERED)
for _name in ("t01_layout", "t02_star_marker", "t03_header_rows", "t04_merged_header", "t05_to_lines", "t07_first_valid_row", "t08_trailing_trim", "t10_column_a", "t12_projection", "t13_complete", "a14_ratios"):
    PLANS[_name] = Plan(getattr(layout, _name), cells=v.CELLS)
for _name in ("p02_highlights", "p09_image_places", "p12_glyphs", "p13_rows", "p14_tokens", "p15_matrix_elements", "p16_matrix_rows", "p17_brackets", "p19_orphan_arrows", "p20_fix_arrows", "a15_span_statistics", "a16_bbox"):
    PLANS[_name] = Plan(getattr(geometry, _name), glyphs=v.GLYPHS)
PLANS["p11_wrapped"] = Plan(geometry.p11_wrapped, lines=DOC_LINES)
for _name in ("k01_json", "k08_classic_text", "a13_mode", "w08_exactly_one", "w13_head", "a21_collect"):
    PLANS[_name] = Plan(getattr(export, _name), opt=v.OPT)
PLANS["k04_math_letters"] = Plan(export.k04_math_letters, docs=v.DIRTY)

for _names, _inputs in (
    (("p01_script_marks", "p03_highlight_rects", "w12_sorted", "a17_size_range", "j07_bracket_pairs"), {"glyphs": v.GLYPHS}),
    (("p04_split_glued", "p05_drop_glued"), {"lines": v.GLUED}),
    (("w02_next_line", "w03_previous_line", "w04_beside", "w19_common_words"), {"lines": DOC_LINES}),
    (("p06_bold_options", "p07_highlight_marks", "s11_inline_paragraphs", "s17_numbered_bold", "x13_bold_paragraph", "j08_zip"), {"runs": v.RUNS}),
    (("s13_table_blocks", "s35_raw_questions", "g02a_letter_key", "w06_last_four", "w07_first_match", "w10_all_of_group", "k07_lines", "j10_images_of_questions"), {"opt": v.OPT}),
    (("s19_columns_qa", "s21_unique_columns", "w05_consecutive", "w18_union", "a20_distinct", "t09_header_drop", "t11_numeric_column"), {"cells": v.CELLS}),
    (("g06b_image_token", "w14_truncate"), {"docs": v.DIRTY}),
    (("g11_states", "x10_split_inline", "a11_features", "a12_markers"), {"lines": v.CLASSIC}),
    (("w11_sessions",), {"log": v.LOG}),
    (("s26_stem",), {"docs": "documents"}),
    (("s05_pages",), {"lines": DOC_LINES, "pages": v.PAGES}),
):
    for _name in _names:
        PLANS[_name] = Plan(getattr(spans, _name), **_inputs)

for _names, _inputs in (
    (("k15_prompt", "k16_blocks", "k17_envelope", "k14_summary", "v17_media", "v21_unresolved", "j09_bold_options", "j12_image_parts"), {"opt": v.OPT}),
    (("k05_compact", "k06_full_json", "k10_report", "a19_resolver_summary"), {"opt": v.OPT, "answers": v.ANSWERS}),
    (("a10_progress", "r01_ended", "r11_model", "k13_duration", "j11_models"), {"log": v.LOG}),
    (("v18_suffix", "v19_admitted"), {"pages": "pages"}),
    (("v16_answers",), {"answers": v.ANSWERS}),
    (("v20_allowed",), {"log": v.LOG, "customers": "customer"}),
    (("g03b_twice",), {"lines": v.BARE}),
    (("t06_table_questions",), {"cells": v.CELLS}),
):
    for _name in _names:
        PLANS[_name] = Plan(getattr(requests, _name), **_inputs)

PLANS["c00_clean"] = Plan(pipeline.c00_clean, lines=v.DASH)
PLANS["g00_route"] = Plan(pipeline.g00_route, lines=v.MIXED)
PLANS["e1_documents"] = Plan(pipeline.e1_documents, lines=v.MIXED)


FLAGSHIP = Plan(pipeline.e1_flagship, lines=v.MIXED)
PLANS["e1_flagship"] = FLAGSHIP
