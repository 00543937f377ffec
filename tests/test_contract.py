"""Every registered query against its DuckDB oracle, and the properties of the published tables."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from termtrail import fixed_values as fv
from termtrail.plans import catalog
from termtrail.sources.store import shared_folder
from tests.conftest import ROOT, SMALL

sys.path.insert(0, f"{ROOT}/tools")
import compare  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_oracle(spark, duck, name):
    assert compare.compare(spark, duck, SMALL, name) is None


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) <= set(contract.oracle_sql()) & set(contract.queries())
    assert set(catalog.LAYER_QUERIES) <= set(contract.queries())


def test_entry_is_suppressed(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(r.students == fv.SUPPRESSED or int(r.students) == 0 or int(r.students) >= 11
                        for r in rows)


def test_sequence_lengths(spark):
    j = catalog.journey(spark, SMALL)
    terms = j.per_term_info.groupBy("student_uuid").agg(F.count("*").alias("rows"))
    both = j.history.join(terms, "student_uuid")
    grid = j.terms_adjusted.where("gi03 BETWEEN 175 AND 299").select("gi03").distinct().count()
    assert both.where("length(any_esl_enrollment_by_terms) <> rows").count() == 0
    assert both.where(f"length(any_esl_enrollment_abs_by_terms) <> {grid}").count() == 0


def test_entry_registers_without_optional_packages():
    code = ("import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), len(e.oracle_sql()))")
    done = subprocess.run([sys.executable, "-W", "always", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(catalog.queries()))] * 2
    if os.path.exists(f"{ROOT}/termtrail/llm/registry.py"):
        assert "zstandard" in done.stderr


def test_storage_is_never_a_folder_of_one_machine():
    def session(master, **conf):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: conf.get(k.rsplit(".", 2)[-2], *d)), sparkContext=context)
    assert shared_folder(session("yarn", checkpoint="hdfs://x/shared")) == "hdfs://x/shared"
    assert shared_folder(session("local[4]", warehouse="file:/tmp/w")) == "file:/tmp/w/_tables"
    assert shared_folder(session("spark://h:7077", warehouse="s3a://bucket/w")) == "s3a://bucket/w/_tables"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(session(master, warehouse="file:/tmp/w"))
