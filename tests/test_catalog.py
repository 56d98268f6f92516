import os

import pytest

import __spark_entry__ as entry
import check_oracle

FOLDER = "/root/testdata/sf0.001"
SOME = ["page_lines_p1", "headings_p3", "masked_documents_m14", "chunks_c5", "packed_windows_c4", "loan_cost_f7", "risk_candidates_k3", "cheaper_offer_o2", "hybrid_search_r10", "parsed_answers_a5"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    connection = check_oracle.connect(FOLDER)
    rows, problem, _, _ = check_oracle.compare(spark, connection, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and rows > 0
