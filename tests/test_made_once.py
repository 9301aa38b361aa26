"""Parsers make what they name several times once."""

import pytest
from pyspark.sql import functions as F

from quarrylens import registry
from quarrylens.operators import context
from quarrylens.sources import coverage


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("parse", "mark"), [(coverage.lcov, "end_of_record"), (coverage.istanbul, "source_files"), (coverage.istanbul, "statementMap")])
def test_reports_are_parsed_once(spark, parse, mark):
    reports = spark.createDataFrame([("a", "SF:x\nDA:1,1\n DA:2,0 \nDA:3\nend_of_record\nSF: y \nend_of_record")], "path string, text string").where("path <> ''").repartition(1)
    # the reader as it stands names the statements of lists and of maps
    assert plan(parse(reports)).count(mark) <= (2 if mark == "statementMap" else 1)


def test_lcov_counts(spark):
    text = "TN:\n SF: a.py \nDA:1,1\n\tDA:2,0 \nDA:3\nXDA:4,1\nDA:5,x\nend_of_record\nDA:9,1\nSF:b.py\r\nDA:1,2\r\nend_of_record\nSF:\nDA:1,1\nend_of_record\nSF:c.py"
    row = coverage.lcov(spark.createDataFrame([("r", text), ("none", None)], "path string, text string")).where("raw_report_path = 'r'").first()
    assert (row.lines_covered, row.lines_total, row.files_covered, row.files_total, row.uncovered_files) == (2, 4, 1 + 1, 3, ["c.py"])


def test_guidance_lines_are_made_once(spark):
    texts = spark.createDataFrame([("# T\n" + "\n".join(f"- line {k // 2}" for k in range(4000)),)], "text string").repartition(1)
    made = texts.select(context.guidance_summary(F.col("text"), F.lit("docs/A.md")).alias("g")).select("g.title", "g.summary", "g.excerpt")
    assert plan(made).count("[-*]+") == 1
    assert tuple(made.first()) == ("T", "line 0 line 1 line 2", "line 0\nline 1\nline 2\nline 3")


def test_guidance_rows_are_dealt_out(spark):
    import quarrylens.plans  # noqa: F401

    made = registry.QUERIES["u27_guidance_summaries"](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() > 4
