"""Question packs and contracts on literals."""

import hashlib

from macrotide.operators import contracts

JOBS = "job int, treatment string, outcome string, horizons array<int>, mode string"


def test_packs_by_hand(spark):
    jobs = [
        (1, " Oil price ", "GDP", [0, 4], "raw"),
        (2, "oil-price", "gdp", None, None),  # its name meets that of the first
        (3, "Oil price", "GDP", [12], "shock"),
        (4, "", "GDP", [1], "raw"),
        (5, "Oil price", None, [1], "raw"),
        (6, "Rates", "GDP", [2], "raw"),
        (7, "Oil price", "Jobs", [2], " "),
        (8, "!!", "GDP", [], "raw"),
    ]
    packs = contracts.question_packs(spark.createDataFrame(jobs, JOBS), horizon_end=8, enabled_limit=2, exclude={"treatment": ["Rates"]}, settings={"alpha": 0.05})
    made = {r.question_id: r for r in packs.filter("skip_reason is null").collect()}
    assert list(sorted(made)) == ["auto_item_gdp", "auto_oil_price_gdp", "auto_oil_price_gdp_2", "auto_oil_price_jobs"]
    first = made["auto_oil_price_gdp"]
    assert (first.treatment, first.outcome, first.horizon_start, first.horizon_end, first.modes, first.enabled, first.alpha, first.label) == ("Oil price", "GDP", -4, 12, "raw,shock", True, 0.05, "Auto: Oil price -> GDP")
    assert made["auto_oil_price_gdp_2"].treatment == "oil-price" and made["auto_oil_price_gdp_2"].enabled and made["auto_oil_price_gdp_2"].modes == "unknown"
    assert not made["auto_oil_price_jobs"].enabled and made["auto_oil_price_jobs"].modes == "unknown" and made["auto_item_gdp"].horizon_end == 8
    assert {r.job: r.skip_reason for r in packs.filter("skip_reason is not null").collect()} == {4: "no_treatment", 5: "no_outcome", 6: "excluded"}
    asked = contracts.pack_questions(packs, [-5, 0, 12], ["did"]).collect()
    assert sorted((r.question_id, r.horizon) for r in asked) == [("auto_oil_price_gdp", 0), ("auto_oil_price_gdp", 12), ("auto_oil_price_gdp_2", 0)]
    some = contracts.question_packs(spark.createDataFrame(jobs, JOBS), enabled_ids=["auto_item_gdp"], include={"outcome": ["GDP"]}, use_job_horizons=False)
    assert [r.question_id for r in some.filter("enabled").collect()] == ["auto_item_gdp"]
    assert {r.job for r in some.filter("skip_reason = 'not_included'").collect()} == {2, 7} and {r.horizon_end for r in some.filter("skip_reason is null").collect()} == {8}
    every = contracts.question_packs(spark.createDataFrame(jobs, JOBS), enabled_limit=-1).filter("skip_reason is null")
    assert every.filter("not enabled").count() == 0 and contracts.question_packs(spark.createDataFrame([], JOBS)).count() == 0


IV = "treatment string, candidate string, transform string, lag int, selected boolean"
NC = "treatment string, target_outcome string, nc_outcome string, rank int, score double, selected boolean"
FIELDS = {"sample_split_id": "full", "resid_mode": "r", "fold_spec": "f", "seed": 7}


def tables(spark):
    iv = [("t1", " z1", " Diff", 2, True), ("t1", "z2", None, -1, False), ("gone", "z3", "diff", 0, True), (None, "z4", "diff", 0, True)]
    nc = [
        ("t1", "y1", "n1", 2, 0.5, True),
        (None, "y1", "n2", 1, 0.1, True),  # for every treatment that asks for y1
        ("t2", "y1", "n3", 1, 0.9, True),
        ("t9", "y2", "n4", None, 0.9, True),  # unknown: for all that ask for y2
        ("t1", "y3", "n5", 1, 0.9, True),
        ("t1", "", "n6", 1, 0.9, True),
        ("t1", "y1", "n7", 0, 0.9, False),
        ("t1", "y2", " ", 0, 0.9, True),
    ]
    questions = [("t1", "y1", 0), ("t1", "y1", 4), ("t1", "y1", 4), ("t1", "y1", -1), ("t1", "y2", 1), ("t2", "y1", 0)]
    return spark.createDataFrame(iv, IV), spark.createDataFrame(nc, NC), spark.createDataFrame(questions, "treatment string, outcome string, horizon int")


def test_contracts_by_hand(spark):
    rows = contracts.contracts(*tables(spark), FIELDS).collect()
    got = {}
    for r in rows:
        got.setdefault(r.contract_type, []).append((r.treatment, r.outcome, r.instrument, r.nc_outcome, r.force_w_series, r.w_spec, r.horizon))
    iv = [("t1", y, "z1", "", "", "diff_lag2", h) for y, h in (("y1", 0), ("y1", 4), ("y2", 1))]
    assert sorted(got["iv_lp"]) == sorted(got["iv_dml"]) == sorted(iv)
    tests = [("t1", "y1", h, n) for n in ("n1", "n2") for h in (0, 4)] + [("t2", "y1", 0, "n2"), ("t2", "y1", 0, "n3"), ("t1", "y2", 1, "n4"), ("t1", "y2", 1, "")]
    assert sorted((t, y, h, n) for t, y, _, n, _, w, h in got["nc_test"]) == sorted(tests) and {x[5] for x in got["nc_test"]} == {"default"}
    # the best control: lowest rank, then score; a missing rank is last but is all there is for y2
    assert sorted((t, y, n, f, h) for t, y, _, n, f, _, h in got["nc_adjust_main"]) == [("t1", "y1", "n2", "n2", 0), ("t1", "y1", "n2", "n2", 4), ("t1", "y2", "n4", "n4", 1), ("t2", "y1", "n3", "n3", 0)]
    one = next(r for r in rows if r.contract_type == "iv_lp" and r.outcome == "y2")
    assert one.contract_id == "iv_lp_" + hashlib.sha1(b"iv_lp|t1|y2|z1|||diff_lag2|1|full|r|f|7").hexdigest()[:16]
    targets = contracts.permutation_targets(contracts.contracts(*tables(spark), FIELDS)).collect()
    assert sorted(map(tuple, targets)) == [("t1", "y1", 0, "default"), ("t1", "y1", 0, "diff_lag2"), ("t1", "y1", 4, "default"), ("t1", "y1", 4, "diff_lag2"), ("t1", "y2", 1, "default"), ("t1", "y2", 1, "diff_lag2"), ("t2", "y1", 0, "default")]


def test_skips_by_hand(spark):
    iv, nc, questions = tables(spark)
    got = sorted((r.kind, r.name, r.reason) for r in contracts.contract_skips(iv, nc, questions).collect())
    assert got == [("control", "n5", "no_question"), ("control", "n6", "no_outcome"), ("control", "n7", "not_selected"), ("instrument", "z2", "not_selected"), ("instrument", "z3", "no_question"), ("instrument", "z4", "no_treatment")]
    assert contracts.contracts(iv, nc, questions.limit(0), FIELDS).count() == 0
    assert contracts.contracts(iv.limit(0), nc.limit(0), questions, FIELDS).count() == 0
