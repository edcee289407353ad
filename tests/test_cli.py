import json

import pytest

from pagegrain import cli
from pagegrain.functions import tokenizer
from pagegrain.operators import checks
from pagegrain.sources import records


def test_analyze_writes_its_tables(spark, sf, tmp_path):
    paths = cli.main(["analyze", f"{sf}/documents.parquet", "--out", str(tmp_path), "--profile", "dense", "--set", "gap_rounding=0.25"], spark)
    assert {"lines", "rules", "paragraphs", "blocks", "boundaries", "summary"} == set(paths)
    assert spark.read.parquet(paths["summary"]).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert spark.read.parquet(paths["lines"]).columns.count("gap_before") == 1


@pytest.mark.parametrize("command", ["scan", "report"])
def test_scan_and_report(spark, sf, tmp_path, command):
    for path in cli.main([command, f"{sf}/documents.parquet", "--out", str(tmp_path), "--pages", "1-2"], spark).values():
        assert spark.read.parquet(path).count() > 0


def test_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"pages": [{"page": 1, "lines": [{"text": "x"}, {"text": "y"}]}, {"text": "p\nq"}]}))
    paths = cli.main(["pages", str(tmp_path / "a.json"), "--out", str(tmp_path / "out")], spark)
    assert sorted((r.page, r.item) for r in spark.read.parquet(paths["items"]).collect()) == [(1, "x"), (1, "y"), (2, "p"), (2, "q")]


def test_parameters_override_profiles(monkeypatch):
    monkeypatch.setenv("PAGEGRAIN_X_TOLERANCE", "9")
    p = cli.parameters("manual", ["y_tolerance=1"])
    assert (p.x_tolerance, p.y_tolerance, p.large_gap_multiplier) == (3.5, 1.0, 2.0)
    with pytest.raises(TypeError):
        cli.parameters(None, ["nothing=1"])


def test_exact_tokens_and_contexts(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    rows = df.select(tokenizer.exact_tokens(df["t"], lambda: lambda t: len(t.split()))).collect()
    assert sorted(r[0] if r[0] is not None else -1 for r in rows) == [-1, 0, 3]
    assert tokenizer.context_of("gpt-4o-mini") == 128000
    with pytest.raises(ValueError):
        tokenizer.context_of("other")


def test_missing_pages_are_refused(spark):
    have, want = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page int"), spark.createDataFrame([(1, 2), (1, 9)], "doc_id long, page int")
    with pytest.raises(Exception, match="pages are missing"):
        records.require_all(have, want)
    records.require_all(have, have)


def test_fixture_pages_follow_contents(spark):
    contents = spark.createDataFrame([(1, 1, "c"), (2, 1, "c")], "page int, line_number int, text string")
    body = spark.createDataFrame([(1, 1, "b")], "page int, line_number int, text string")
    assert sorted((r.page, r.text) for r in records.comprehensive_fixture(contents, body).collect()) == [(1, "c"), (2, "c"), (3, "b")]


def test_rounding_is_half_to_even(spark):
    df = checks.rounded(spark.createDataFrame([(0.25, 1)], "v double, n int"), 1)
    assert df.first().v == 0.2 and df.first().n == 1
