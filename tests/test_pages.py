"""Page-level API: each page returns its tables, with the dashboard's scoping."""

from canvass.plans import pages


def test_pages_smoke(responses_small):
    df = responses_small
    ex = pages.executive_summary(df, segments=["AUTOMOBILE", "BUILDING"], emirates=None)
    c = ex["counts"].first()
    assert c["n_total"] == 1500 and 0 < c["n_shown"] < 1500
    assert ex["kpi"].first()["respondents"] == c["n_shown"]
    view = pages.global_view(df)
    en = pages.energy_landscape(view)
    assert en["bill_histogram"].count() == 50
    seg = pages.segmentation(view, [])
    assert seg["median_wtp"].count() == 5
    r = pages.rules(df)
    assert r["top"].count() == 20 and r["summary"].first()["n_rules"] == 20
