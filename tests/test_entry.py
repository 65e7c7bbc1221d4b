import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from bomloom import queries

REPO = Path(__file__).resolve().parents[1]
QUICK = ["fleet_query_merge", "diff_components", "diff_summary", "timeline_history", "multi_divergent", "fn_soundex", "fn_purl", "graph_degrees", "e_kev_sla", "p4_found", "p5_found", "q_completeness", "src_openvex", "er_candidates", "stream_windows",
         "l_info", "l_report", "fn_downgrade", "matrix_similar", "p3_found", "src_spdx_packages", "src_spdx_tag_value", "src_cyclonedx_xml", "u_json_flatten", "multi_deviation", "timeline_cumulative", "graph_cyclic", "e_osv", "er_multifield", "diff_sections"]


@pytest.mark.parametrize("name", QUICK)
def test_oracle(compare, name):
    compare(queries.queries()[name], queries.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['bomloom.llm'] = None; import __spark_entry__ as e; assert 'p4_found' in e.queries() and 'p2_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
