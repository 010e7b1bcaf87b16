"""Print, per registered query, the shuffle/broadcast/sort/window counts of its
executed plan and each scan's ReadSchema and PushedFilters (over the written
survey table at sf0.01). Usage: python tools/plan_report.py kpi_row lead_table ..."""

import sys, re; sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))
from canvass.session import get_session
from canvass.plans import catalog
spark = get_session("local[8]", 16)
sf = __import__("os").environ.get("SF_DIR", "/root/testdata/sf0.01")
catalog.materialize(spark, sf)
for q in sys.argv[1:]:
    df = catalog.QUERIES[q](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    print("=====", q, "exchanges:", plan.count("Exchange"), "broadcasts:", plan.count("BroadcastExchange"),
          "sorts:", len(re.findall(r"\bSort\b", plan)), "windows:", plan.count("Window"))
    for line in plan.splitlines():
        if "FileScan" in line or "Scan parquet" in line:
            m = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", line)
            print("   scan", m.group(1)[:160] if m else "", pf.group(1)[:120] if pf else "")
        if "TakeOrderedAndProject" in line:
            print("   ", line.strip()[:100])
