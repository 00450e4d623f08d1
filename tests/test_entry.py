import os
import subprocess
import sys

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_every_twin_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_core_does_not_need_the_training_data_operators():
    code = "import sys; sys.modules['captionmill.llm'] = None; import __spark_entry__ as e; assert 'box_lines' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
