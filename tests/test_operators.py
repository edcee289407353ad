"""Operators on small tables against expectations written out or plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagegrain import errors
from pagegrain.functions import scalar
from pagegrain.operators import answers, boundaries, layout, patterns, sampling, spacing, words
from pagegrain.params import DEFAULTS, LayoutParams
from pagegrain.plans import provider, workflow
from pagegrain.sources import adapters, sinks
from pagegrain.streaming import scan

WORD = "doc_id long, page int, word_seq long, text string, x0 double, x1 double, top double, bottom double, fontname string, size double, upright boolean"


def word(seq, top, text="w", x0=0.0, x1=5.0, font="A", size=10.0, upright=True, page=1):
    return (1, page, seq, text, x0, x1, top, top + 10, font, size, upright)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_lines_are_anchored_at_their_first_word(spark):
    df = spark.createDataFrame([word(i, t) for i, t in enumerate([0.0, 2.0, 4.0, 6.0, 7.5])], WORD)
    assert [r.line_number for r in words.grouped_lines(df).orderBy("word_seq").collect()] == [1, 1, 2, 2, 3]


def test_lines_match_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [word(i, rng.randrange(0, 400) / 4) for i in range(300)]
    got = {r.word_seq: r.line_number for r in words.grouped_lines(spark.createDataFrame(rows, WORD)).collect()}
    line, anchor = 0, None
    for r in sorted(rows, key=lambda r: (r[6], r[2])):
        if anchor is None or abs(r[6] - anchor) > 3:
            line, anchor = line + 1, r[6]
        assert got[r[2]] == line


def test_lines_in_flow_order_compare_with_the_anchor(spark):
    df = spark.createDataFrame([word(i, t) for i, t in enumerate([50.0, 10.0, 12.0, 50.0])], WORD)
    assert [r.line_number for r in words.grouped_lines(df, flow_order=True).orderBy("word_seq").collect()] == [1, 2, 2, 3]


def test_words_without_rows_stay_empty(spark):
    empty = spark.createDataFrame([], WORD)
    assert words.grouped_lines(empty).count() == 0
    assert words.segments(words.grouped_lines(empty)).count() == 0


SPACING = [
    # segments as (text, x0, x1, size), then the two texts
    ([("Hello", 0, 20, 10.0)], "Hello", "Hello"),
    ([("Hello", 0, 20, 10.0), ("World", 23, 40, 10.0)], "Hello World", "Hello World"),
    ([("1.", 0, 10, 10.0), ("Scope", 40, 60, 10.0)], "1. Scope", "1." + " " * 10 + "Scope"),
    ([("a", 0, 10, 12.0), ("b", 9, 20, 12.0)], "a b", "a b"),
    ([("a", 0, 10, 10.0), (" ", 10, 30, 10.0), ("b", 40, 50, 10.0)], "a b", "a" + " " * 10 + "b"),
    ([("x", 0, 10, 0.0), ("y", 25, 30, 10.0)], "x y", "x" + " " * 5 + "y"),
    ([("n", 0, 10, 20.0), ("m", 25, 30, 10.0), ("k", 36, 40, 10.0)], "n m k", "n" + " " * 2 + "m" + " " * 2 + "k"),
]


@pytest.mark.parametrize("segs, text, proportional", SPACING)
def test_proportional_text(spark, segs, text, proportional):
    rows = [(1, 1, 1, i, t, float(a), float(b), s, 10.0) for i, (t, a, b, s) in enumerate(segs)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_number int, seg_no int, text string, x0 double, x1 double, rounded_size double, reported_size double")
    row = words.proportional_text(df).first()
    assert (row.text, row.text_proportional) == (text, proportional)
    for info in row.spacing_info:
        assert row.text[info.normalized_text_index] == " "


def test_modes_go_to_the_value_seen_first(spark):
    rows = [(1, 1, i, "t", 10.0, float(i * 20), float(i * 20 + 10), g) for i, g in enumerate([0.0, 3.0, 1.0, 1.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_number int, text string, predominant_size double, top double, bottom double, gap_before double")
    rule = spacing.spacing_rules(spacing.gap_histogram(spacing.gap_samples(df))).first()
    assert rule.most_common_gap == 3.0 and rule.total_gaps == 4


@pytest.mark.parametrize("gap, kind", [(6.0, "Line"), (12.0, "Paragraph"), (18.0, "Section")])
def test_gap_classes(spark, gap, kind):
    assert one(spark, spacing.gap_class(F.lit(gap), F.lit(7.2), F.lit(13.2))) == kind


def test_gap_without_rules_is_a_line_gap(spark):
    assert one(spark, spacing.gap_class(F.lit(50.0), F.lit(None).cast("double"), F.lit(None).cast("double"))) == "Line"


@pytest.mark.parametrize("value, step", [(v / 8, s) for v in range(-9, 30, 3) for s in (0.5, 0.25, 1.0)])
def test_rounding_is_half_to_even(spark, value, step):
    assert one(spark, scalar.round_to(F.lit(value), step)) == round(value / step) * step


@pytest.mark.parametrize("text", ["  a\t b\n", " x ", "", "a  b"])
def test_white_space_of_any_kind(spark, text):
    assert one(spark, scalar.normalize_line(F.lit(text))) == re.sub(r"\s+", " ", text).strip()
    assert one(spark, scalar.is_blank(F.lit(text))) == (not text.strip())


@pytest.mark.parametrize("path, name", [("/x/a_lines.json", "a"), ("b_full_lines.json", "b_full"), ("c_words.json", "c"), ("d.pdf", "d"), (".rc", ".rc"), ("e_info", "e")])
def test_base_names(spark, path, name):
    assert one(spark, scalar.base_name(F.lit(path))) == name


TEXTS = ["1.1 Introduction", "A.1 Overview", "9.3.4.6Byte stream", "B2Overview", "IV Results", "(iv) see", "Annex B", "Chapter 12", "Table of Contents", "3.2 Scope ..... 17", "Figure 9-11 – View", "Table 7-2: Codes", "42", "Page 3", "12 of 90", " ", "٣ Introduction"]


def test_patterns_match_like_python(spark):
    df = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(TEXTS)], "doc_id long, page int, line_number int, text string")
    got = sorted((r.pattern_name, r.line_number, r.match_no, r.match, r.number) for r in patterns.scan(df).collect())
    want = sorted((n, i, k, m.group(0), m.group(1)) for n, rx, *_ in patterns.PATTERNS for i, t in enumerate(TEXTS) for k, m in enumerate(re.finditer(rx, t)))
    assert got == want


def test_catalogue_is_whole(spark):
    assert len(patterns.PATTERNS) == 32 and not patterns.validate(patterns.PATTERNS)
    names = {p[0] for p in patterns.PATTERNS}
    assert all(n in names for s in patterns.SETS.values() for n in s)
    with pytest.raises(errors.PatternError):
        patterns.pattern_set("nothing")
    with pytest.raises(errors.PatternError):
        patterns.scan(spark.range(1).selectExpr("id AS doc_id", "1 AS page", "1 AS line_number", "'a' AS text"), [("bad", "(", "x", None)])
    assert dict((p[0], p[1]) for p in patterns.merged(patterns.PATTERNS, [("letter_dot", "(x)", "section", None)]))["letter_dot"] == "(x)"


@pytest.mark.parametrize("total", [1, 5, 16, 17, 40, 300])
def test_groups_and_singles(total):
    runs, singles = sampling.groups_and_singles(total)
    pages = [p for r in runs for p in r] + singles
    assert len(pages) == len(set(pages)) and set(pages) <= set(range(1, total + 1))
    assert (runs, singles) == sampling.groups_and_singles(total)
    if total <= 16:
        assert not runs and len(singles) == total
    else:
        assert [len(r) for r in runs] == [4, 4, 4] and len(singles) == 4 and all(r == list(range(r[0], r[0] + 4)) for r in runs)
    assert sampling.group_ranges(runs) == [f"{r[0]}-{r[-1]}" for r in runs]


def test_ranges_with_open_ends():
    assert layout.parse_ranges("-3, 4-6.5,9,20-") == [(1, None, 3.0), (2, 4.0, 6.5), (3, 9.0, 9.0), (4, 20.0, None)]
    assert len(layout.line_styles()) == 77 and len(layout.COLORS) == 46


def test_no_ranges_mean_every_positive_gap(spark):
    df = spark.createDataFrame([(0.0,), (1.5,)], "gap double")
    assert [r.range_no for r in layout.matched_range(df, "gap", []).orderBy("gap").collect()] == [None, 1]


def test_page_sets(spark):
    assert sorted(r.page for r in adapters.page_set(spark, "1-3,5", 9, "2").collect()) == [1, 3, 5]
    assert sorted(r.page for r in adapters.page_set(spark, "", 4).collect()) == [1, 2, 3, 4]


def test_shapes_that_are_not_known_are_refused(spark):
    rows = spark.createDataFrame([('{"other": 1}',), ("no json",), (None,)], "json string")
    with pytest.raises(errors.ShapeError):
        adapters.require_pages(adapters.page_records(rows))


def test_answers_of_all_kinds(spark):
    contents = ['x ```json\n{"per_page_analysis": []}\n``` y', 'so {"per_page_analysis": [{"page_index": 3}]} ok', "{", None, '{"per_page_analysis": null}', "// note\n{}"]
    rows = answers.parsed(spark.createDataFrame(list(enumerate(contents)), "answer_id int, content string")).orderBy("answer_id").collect()
    assert [bool(r.problems) for r in rows] == [False, False, True, True, True, True]
    assert rows[1].answer.per_page_analysis[0].page_index == 3


def test_profiles_and_environment(monkeypatch):
    assert DEFAULTS.with_profile("manual").y_tolerance == 4.0 and DEFAULTS.y_tolerance == 3.0
    with pytest.raises(ValueError):
        DEFAULTS.with_profile("other")
    monkeypatch.setenv("PAGEGRAIN_X_TOLERANCE", "1.5")
    assert LayoutParams.from_env().x_tolerance == 1.5


def test_errors_tell_context():
    told = str(errors.SourceError("can't read", {"path": "a"}, "try b"))
    assert "path=a" in told and "try b" in told


def registry():
    return workflow.Registry((
        workflow.State("scan", lambda c: {"n": c["n"] + 1}, ("n",), {"more": "scan", "ok": "end"}, lambda r: "more" if r["n"] < 4 else "ok"),
        workflow.State("end", lambda c: {"sum": c["n"] * 10}),
    ))


def test_workflow_runs_and_logs(spark):
    done = workflow.run(registry(), "scan", {"n": 1})
    assert done.path == ["scan", "scan", "scan", "end"] and done.results["end"] == {"sum": 40} and done.error is None
    assert done.log(spark).count() == 4


def test_workflow_limits_and_errors():
    assert workflow.run(registry(), "scan", {"n": -1000}).error == "too many states"
    assert "needs n" in workflow.run(registry(), "scan", {}).error
    with pytest.raises(errors.WorkflowError):
        workflow.run(registry(), "nowhere", {})
    bad = workflow.Registry((workflow.State("x", lambda c: 1 / 0),))
    assert "division" in workflow.run(bad, "x", {}).error


def test_workflow_graph(spark):
    states, edges = registry().frames(spark)
    assert {r.problem for r in workflow.problems(states, edges).collect()} == {"leads to itself", "no entry"}


def test_recorded_provider(spark):
    asked = spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    known = provider.Recorded({provider.Recorded.key("p1"): "a1", provider.Recorded.key("p2"): "a2"})
    assert sorted(r.content for r in provider.completed(asked, known).collect()) == ["a1", "a2"]
    with pytest.raises(errors.ProviderError):
        known.complete("p3")


def test_scan_edges_of_a_page(spark):
    # base gap 4: a gap of 10 is large (>= 7.2), so the header ends at the first line
    tops = [(10.0, 20.0), (30.0, 40.0), (44.0, 54.0), (58.0, 68.0), (72.0, 82.0), (86.0, 96.0), (770.0, 780.0)]
    rows = [(1, 1, i, "t", 10.0, a, b, 600.0, 792.0) for i, (a, b) in enumerate(tops, 1)]
    df = spacing.with_gaps(spark.createDataFrame(rows, "doc_id long, page int, line_number int, text string, predominant_size double, top double, bottom double, page_width double, page_height double"))
    row = boundaries.scanned(df).first()
    assert (row.header_bottom, row.footer_top) == (20.0, 770.0)


def test_stages_and_streams(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, 1, "1.1 Scope"), (1, 1, 2, "text"), (2, 1, 1, "Annex A")], "doc_id long, page int, line_number int, text string")
    path = sinks.write_stage(lines, str(tmp_path), "doc", "lines")
    assert path.endswith("doc_lines")
    stream = spark.readStream.schema(lines.schema).parquet(path)
    q = scan.each_batch(stream, lambda d: patterns.scan(d), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == patterns.scan(lines).count()
    assert scan.scan_stream(stream).isStreaming


def test_nulls_blank_and_empty_lines(spark):
    schema = "doc_id long, page int, line_number int, text string, predominant_size double, top double, bottom double, page_width double, page_height double"
    rows = [(1, 1, 1, None, None, None, None, None, None), (1, 1, 2, " ", 10.0, 5.0, 15.0, 600.0, 792.0), (1, 1, 3, "x", None, 20.0, 30.0, 600.0, 792.0), (None, None, None, "y", 10.0, 1.0, 2.0, 600.0, 792.0)]
    df = spark.createDataFrame(rows, schema)
    assert spacing.with_gaps(df).count() == 4
    assert spacing.drop_blank(df).count() == 2
    empty = spacing.with_gaps(spark.createDataFrame([], schema))
    assert spacing.gap_samples(empty).count() == 0 and spacing.line_spacing(empty)[1].count() == 0
