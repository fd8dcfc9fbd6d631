import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from servops.operators.ids import assign_dense_ids
from servops.operators.ordering import ordered_index, prefix_sum


def test_ordered_index_and_prefix_sum_match_windows(spark):
    random.seed(7)
    rows = [(g, n, random.randint(0, 3)) for g in range(4) for n in random.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "g long, n long, v int")
    w = Window.partitionBy("g").orderBy("n")
    exp = {(r.g, r.n): (r.i, r.s) for r in df.select("g", "n", (F.row_number().over(w) - 1).alias("i"),
                                                    F.sum("v").over(w).alias("s")).collect()}
    got_i = {(r.g, r.n): r.idx for r in ordered_index(df, ["g"], "n", "idx", block=16).collect()}
    got_s = {(r.g, r.n): r.ps for r in prefix_sum(df, ["g"], "n", "v", "ps", block=16).collect()}
    assert got_i == {k: v[0] for k, v in exp.items()}
    assert got_s == {k: v[1] for k, v in exp.items()}


def test_dense_ids(spark):
    df = spark.createDataFrame([(k,) for k in random.sample(range(10_000), 300)], "k long").repartition(5)
    got = sorted((r.k, r.id) for r in assign_dense_ids(df, ["k"], "id", start=100).collect())
    assert [i for _, i in got] == list(range(101, 401))


def test_with_neighbour_matches_lead_and_lag(spark):
    from servops.operators.ordering import with_neighbour
    random.seed(11)
    # sparse order values: many empty blocks and rows on block edges; null values must pass through
    rows = [(g, n, random.choice([None, "a", "b"])) for g in range(3) for n in random.sample(range(2000), 80)]
    df = spark.createDataFrame(rows, "g long, n long, v string")
    w = Window.partitionBy("g").orderBy("n")
    exp = {(r.g, r.n): (r.nx, r.pv) for r in df.select("g", "n", F.lead("v").over(w).alias("nx"),
                                                      F.lag("v").over(w).alias("pv")).collect()}
    nxt = {(r.g, r.n): r.next_v for r in with_neighbour(df, ["g"], "n", ["v"], True, block=16).collect()}
    prv = {(r.g, r.n): r.prev_v for r in with_neighbour(df, ["g"], "n", ["v"], False, block=16).collect()}
    assert nxt == {k: v[0] for k, v in exp.items()}
    assert prv == {k: v[1] for k, v in exp.items()}
