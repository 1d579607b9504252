import subprocess
import sys

import pytest

from verdance.sources import tables


def test_registry_needs_no_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 100, len(e.oracle_sql()) > 100)"], capture_output=True, text=True, check=False)
    assert done.stdout.split() == ["True", "True"], done.stderr


def test_csv_with_other_columns_is_refused(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("item,final_label,confidence,note\n1,true_correct,high,x\n")
    bad.write_text("final_label,item,confidence,note\ntrue_correct,1,high,x\n")
    assert tables.read_csv(spark, str(good), tables.AUDIT_SHEET).first()["item"] == 1
    with pytest.raises(Exception):  # noqa: B017
        tables.read_csv(spark, str(bad), tables.AUDIT_SHEET).collect()


def test_log_lines_that_do_not_parse_stay(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"item_id": 1, "raw_samples": ["a"]}\n{"item_id": \n')
    rows = tables.read_log(spark, str(log), tables.SAMPLE_LOG).collect()
    assert [r["item_id"] for r in rows] == [1, None] and rows[1]["_corrupt"] is not None
