"""A part of the registered queries beside their SQL; ``python tests/oracle.py`` runs all."""

import pytest

from quire.plans import registry
from tests.oracle import connection, difference

NAMES = [
    "t2_split_lines", "t4_infer_title", "t8_is_all_caps_heading", "t10_extract_chapter_num", "t17_is_rate_limit_error", "t18_response_text", "l2_assemble_lines", "p4_running_headers", "p5_every_page_lines", "c1_page_lines", "c3_score_styled_lines",
    "c4_multi_line_headings", "c8_score_pages_relaxed", "g4_annotate_numbers", "g7_merge_around_sequence", "g14_detect_with_outline", "g14_detect_styled", "k2_group_chapters", "k5_build_chunks", "k6_prepare_chapters", "w3_parse_chapter_knowledge", "w8_aggregate_knowledge",
    "v5_reset_for_reprocess", "r1_rolling_call_counts", "r3_call_outcomes", "r5_stream_responses", "a10_decision_log", "a11_recommendations", "q2_score_books", "s5_export_archive", "s7_audit_report",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf, name):
    assert difference(spark, connection(sf), sf, registry.queries()[name], registry.oracle_sql()[name]) == ""
