"""From a file to a written report, as a user would do it."""

import insight_spark as ins


def test_file_to_report(spark, tmp_path):
    source = tmp_path / "sales.csv"
    lines = ["day,shop,amount,note"]
    lines += [f"2024-01-{d:02d},{'ab'[d % 2]},{d // 2 * 1.5},{'' if d % 3 else 'x'}" for d in range(1, 29)]
    source.write_text("\n".join(lines) + "\n")

    df = ins.load_table(spark, str(source))
    p = ins.table_profile(df, "sales")
    assert (p.with_role("datetime"), p.with_role("categorical")) == (["day"], ["shop", "note"])
    out = ins.run_packs(p)
    assert {r.status for r in out["run_log"].collect()} == {"done"}
    assert out["timeseries"]["rolling"].count() == 28
    assert out["timeseries"]["insights"].first().direction == "increased"
    listed = ins.charts_cap(ins.charts_normalize(ins.chart_entries(p)))
    assert {r.pack for r in listed.collect()} >= {"snapshot", "categorical", "timeseries"}

    errors, found = ins.run_errors(out["run_log"]), ins.insights_table(p)
    assert [r.severity for r in ins.insights_sort(found, "severity").collect()][0] == "risk"
    overview = ins.overview_metrics(p, found, errors)
    lines = ins.report_lines(overview, found, ins.data_quality_notes(p), errors)
    ins.write_report_lines(lines, str(tmp_path / "report"))
    text = "".join(f.read_text() for f in (tmp_path / "report").glob("dataset=sales/*.txt"))
    assert text.startswith("# Analytics Report\n") and "Column 'note' has missing values." in text


def test_packs_straight_from_a_table(spark):
    out = ins.run_packs(spark.range(5))
    assert out["snapshot"]["shape"].first().rows == 5


def test_hypotheses_from_json_text(spark):
    good = '[{"kind": "missingness", "col": "id"}, {"kind": "correlation", "x": "id", "y": "id"}]'
    texts = spark.createDataFrame([(good,), ("not json",)], "json string")
    hyps = ins.hypotheses_from_json(texts)
    assert sorted((r.hyp_id, r.kind) for r in hyps.collect()) == [(1, "missingness"), (2, "correlation")]
    checked = ins.verify_hypotheses(spark.range(20), hyps).orderBy("hyp_id").collect()
    assert [r.verified for r in checked] == [True, True] and checked[1].pearson_corr == 1.0
