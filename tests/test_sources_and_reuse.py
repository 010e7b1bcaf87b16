"""CSV files bound by header, rows set apart, tables kept across sessions, rules of long itemsets."""
import itertools
import os

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.operators import basket
from canvass.plans import reuse
from canvass.sources import io

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("bill", T.DoubleType()), T.StructField("score", T.IntegerType()),
                       T.StructField("name", T.StringType())])


def csv(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_columns_are_found_by_name(spark, tmp_path):
    a = csv(tmp_path, "a.csv", "note,name,score,bill,id\nx,ann,3,2.5,1\ny,NA,4.0,nan,2\n")
    b = csv(tmp_path, "b.csv", "id,bill,score,name\n3,1,,bob\n")
    got = io.read_responses(spark, a, "csv", schema=SCHEMA)
    assert got.columns == SCHEMA.names and sorted(map(tuple, got.collect())) == [(1, 2.5, 3, "ann"), (2, None, 4, None)]
    both = io.read_responses(spark, [a, b], "csv", schema=SCHEMA)
    assert sorted(map(tuple, both.collect())) == [(1, 2.5, 3, "ann"), (2, None, 4, None), (3, 1.0, None, "bob")]
    bare = csv(tmp_path, "c.csv", "5,2,1,z\n")
    assert list(map(tuple, io.read_responses(spark, bare, "csv", header=False, schema=SCHEMA).collect())) == [(5, 2.0, 1, "z")]


def test_what_cannot_be_bound_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="bill"):
        io.read_responses(spark, csv(tmp_path, "a.csv", "id,score,name\n1,2,x\n"), "csv", schema=SCHEMA)
    folder = tmp_path / "mixed"
    folder.mkdir()
    csv(folder, "a.csv", "id,bill,score,name\n1,2,3,x\n")
    csv(folder, "b.csv", "bill,id,score,name\n9,8,3,y\n")  # another order in one folder: no silent swap
    with pytest.raises((PySparkException, Py4JError)):
        io.read_responses(spark, str(folder), "csv", schema=SCHEMA).collect()
    for k, bad in enumerate(("1,2,3\n", "1,2,3,x,y\n", "1,much,3,x\n", "1,2,3.5,x\n")):
        with pytest.raises((PySparkException, Py4JError)):
            io.read_responses(spark, csv(tmp_path, f"bad{k}.csv", "id,bill,score,name\n" + bad), "csv", schema=SCHEMA).collect()


def test_bad_rows_are_set_apart(spark, tmp_path):
    text = "name,id,bill,score,note\nann,1,2.5,3,q\nbob,two,much,3,q\ncat,3,1\ndan,4,1,2,q,z\n,5,,,\n\"e,e\",6,1,2.5,q\nfay,99999999999999999999,1,1,q\n"
    good, bad = io.read_quarantined(spark, csv(tmp_path, "a.csv", text), schema=SCHEMA)
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, 3, "ann"), (5, None, None, None)]
    found = {r.record: r.reasons for r in bad.collect()}
    assert found == {"bob,two,much,3,q": ["id", "bill"], "cat,3,1": ["record"], "dan,4,1,2,q,z": ["record"], '"e,e",6,1,2.5,q': ["score"],
                     "fay,99999999999999999999,1,1,q": ["id"]}
    assert all(r.source_file.endswith("a.csv") for r in bad.collect())
    empty, none = io.read_quarantined(spark, csv(tmp_path, "b.csv", "id,bill,score,name\n"), schema=SCHEMA)
    assert empty.count() == none.count() == 0 and empty.columns == SCHEMA.names


def test_tables_are_kept_until_their_input_changes(spark, tmp_path):
    name, source, built = f"t{os.getpid()}", str(tmp_path / "in.parquet"), []

    def write(n):
        spark.range(n).write.mode("overwrite").parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).withColumn("twice", F.col("id") * 2)

    def kept(params=None):
        table, values = reuse.keep(spark, name, [source], build, lambda t: {"n": t.count()}, params)
        return table.count(), values
    write(5)
    assert reuse.find(spark, name, [source]) is None
    assert kept() == (5, {"n": 5}) and kept() == (5, {"n": 5}) and len(built) == 1
    assert reuse.find(spark, name, [source])[1] == {"n": 5}
    write(7)  # rewritten: never the old table
    assert reuse.find(spark, name, [source]) is None and kept() == (7, {"n": 7}) and len(built) == 2
    assert kept({"k": 1}) == (7, {"n": 7}) and len(built) == 3
    assert len(reuse.entries(spark, name)) == 3
    assert reuse.clear(spark, name) == []  # all are recent
    gone = reuse.clear(spark, name, keep_entries=2, keep_seconds=-60)
    assert len(gone) == 1 and len(reuse.entries(spark, name)) == 2


def test_a_lost_session_leaves_no_entry(spark, tmp_path):
    name, source = f"lost{os.getpid()}", str(tmp_path / "in.parquet")
    spark.range(3).write.parquet(source)

    def fails(table):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        reuse.keep(spark, name, [source], lambda: spark.range(3).toDF("id"), fails)
    assert reuse.find(spark, name, [source]) is None and reuse.entries(spark, name) == []
    assert len(reuse.clear(spark, name, keep_seconds=-60)) == 1  # its draft
    assert reuse.keep(spark, name, [source], lambda: spark.range(3).toDF("id"))[0].count() == 3


def all_rules(support):
    out = set()
    for whole in support:
        for n in range(1, len(whole)):
            for side in itertools.combinations(whole, n):
                rest = tuple(x for x in whole if x not in side)
                if side in support and rest in support:
                    out.add((side, rest, round(support[whole] / (support[side] * support[rest]), 9)))
    return out


def itemset_table(spark, support):
    rows = [(list(k), ", ".join(k), len(k), 1, v) for k, v in support.items()]
    return spark.createDataFrame(rows, "items array<string>, itemset string, size int, freq long, support double")


def test_rules_are_all_splits(spark):
    items = "abcdef"
    support = {c: 1 / (1 + len(c) + i % 3) for n in range(1, 7) for i, c in enumerate(itertools.combinations(items, n))}
    got = [(tuple(r.antecedent_items), tuple(r.consequent_items), round(r.lift, 9)) for r in basket.association_rules(itemset_table(spark, support), 0).collect()]
    assert len(got) == len(set(got)) and set(got) == all_rules(support)
    assert basket.association_rules(itemset_table(spark, support).where("size = 1"), 0).count() == 0
    assert basket.association_rules(itemset_table(spark, support).where("false"), 0).count() == 0


def test_a_long_itemset_makes_no_long_row(spark):
    items = tuple(f"i{k:02}" for k in range(24))
    sizes = (1, 2, 22, 23, 24)
    support = {c: 0.9 / len(c) for n in sizes for c in itertools.combinations(items, n)}
    table = itemset_table(spark, support).where("size in (1, 2, 22, 23, 24)")
    whole = table.where("size = 24 or size < 3 or size > 21")
    sides = basket.rule_sides(whole.where("size < 3 or size = 24")).where("size(items) = 24")
    assert sides.count() == 24 + 276
    got = basket.association_rules(whole, 0).where("size(antecedent_items) + size(consequent_items) = 24")
    assert got.count() == 2 * (24 + 276)
