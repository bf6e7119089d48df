"""Registered queries against their checking SQL. All of them with HAVENLENS_ALL=1, else one per area."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from havenlens.plans import registry

FOLDER = "/root/testdata/sf0.001"
SOME = ("key_checks", "interaction_insights", "customer_360", "churn_risk", "next_best_actions", "source_health",
        "renewal_pipeline", "risk_histogram", "ask_health_renewals", "keyword_search", "hybrid_search",
        "cohort_with_evidence", "semantic_by_call_intent", "action_status", "governed_select",
        "append_action_log", "ask_batch_drivers", "ask_batch_plays", "ask_batch_policies", "hybrid_search_index",
        "semantic_by_segment_stored", "semantic_by_call_intent_stored")
NAMES = list(registry.QUERIES) if os.environ.get("HAVENLENS_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_check():
    assert set(registry.CHECKS) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_check(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("gone", ["corpus_pipeline", "havenlens.llm", "ahocorasick"])
def test_the_rest_is_registered_whatever_the_corpus_operators_lack(gone):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name.startswith({gone!r}):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "from havenlens.plans import registry\n"
        "assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.CHECKS)\n")
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
