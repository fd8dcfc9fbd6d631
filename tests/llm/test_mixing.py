import random

from pyspark.sql import functions as F

from servops.llm import mixing
from . import common


def levels():
    return {"domain": F.substring("source", 1, 1), "lang": F.col("lang"), "source": F.col("source")}


def divide(children, given):
    """Water filling with whole numbers: (held, weight, name) -> budget."""
    order = sorted(children, key=lambda c: (c[0] / c[1], (c[2] is not None, c[2] or "")))
    out, left, weights = {}, given, sum(c[1] for c in children)
    full = True
    for k, (held, w, name) in enumerate(order):
        full = full and (held == 0 or held * weights <= max(left, 0) * w)
        if held == 0 or full:
            out[name] = held
            left -= held
            weights -= w
        else:
            rest = order[k:]
            total = sum(c[1] for c in rest if c[0])
            return out | {c[2]: left * c[1] // total if c[0] else 0 for c in rest}
    return out


def test_divide(spark):
    random.seed(1)
    rows, want = [], {}
    for p in range(60):
        children = [(random.choice([0, 5, 40, random.randint(1, 1000)]), random.randint(1, 5), f"c{k}") for k in range(random.randint(1, 7))]
        given = random.randint(0, sum(c[0] for c in children))
        rows += [(p, n, w, h, given) for h, w, n in children]
        want |= {(p, n): b for n, b in divide(children, given).items()}
    got = mixing.divide(spark.createDataFrame(rows, "p int, name string, weight long, held long, given long"), ["p"], "name").collect()
    assert {(r["p"], r["name"]): r["budget"] for r in got} == want
    for p in range(60):
        mine = [r for r in got if r["p"] == p]
        assert all(0 <= r["budget"] <= r["held"] for r in mine)
        assert 0 <= mine[0]["given"] - sum(r["budget"] for r in mine) < len(mine)  # rounding only


def test_shortage_stays_among_siblings_first(spark):
    rows = [("a", "en", "a1", 10), ("a", "en", "a2", 1000), ("b", "en", "b1", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, ["domain", "lang", "source"], F.lit(800).cast("long"), 1, {}).collect()}
    assert got == {"a1": 10, "a2": 390, "b1": 400}  # a1's shortage goes to a2, not to b1
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves.where("source != 'a2'"), ["domain", "lang", "source"],
                                                                 F.lit(800).cast("long"), 1, {}).collect()}
    assert got == {"a1": 10, "b1": 790}  # nothing left in domain a: the ancestor passes it on


def test_weights(spark):
    leaves = spark.createDataFrame([("a", "x", 10_000), ("a", "y", 10_000), ("b", "x", 10_000)], "d string, s string, tokens long")
    got = {(r["d"], r["s"]): r["budget"] for r in mixing.leaf_budgets(
        leaves, ["d", "s"], F.lit(9000).cast("long"), 1, {("a",): 2, (None, "y"): 3, ("b", "x"): 7}).collect()}
    assert got == {("a", "x"): 1500, ("a", "y"): 4500, ("b", "x"): 3000}


def run(df, **kw):
    return mixing.mix(df, levels(), id_col="doc_id", **kw)


def test_prefix_in_seeded_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 20)
    rows = [(i, "x" * (4 * (1 + i * 37 % 19)), ["en", "de"][i % 3 == 0], f"s{i % 2}", 1) for i in range(900)]
    df = common.docs(spark, rows)
    for share, epochs in ((0.3, 1), (0.9, 1), (1.7, 2), (5.0, 2)):
        got = run(df, budget_share=share, epochs=epochs, seed=3, weights={(None, "en"): 2})
        assert [c for c in got.columns if not c.startswith("mix_")] == [c for c in df.columns if not c.startswith("mix_")]
        got = got.withColumn("o", mixing.seeded_order(3, F.floor(F.col("mix_copies")) * 0 + F.lit(0), F.col("doc_id"), F.col("text"))).collect()
        total = sum(r["mix_tokens"] for r in got)
        used = sum(r["mix_tokens"] * r["mix_copies"] for r in got)
        assert used <= int(total * share) and all(0 <= r["mix_copies"] <= epochs for r in got)
        assert used >= min(int(total * share), total * epochs) - 4 * 20 * 2
        if epochs == 1:  # what is taken is a prefix of the leaf's order
            for leaf in {(r["lang"], r["source"]) for r in got}:
                mine = sorted((r["o"], r["mix_copies"]) for r in got if (r["lang"], r["source"]) == leaf)
                taken = [c for _, c in mine]
                assert taken == sorted(taken, reverse=True)


def test_edges(spark):
    got = run(common.docs(spark), budget_share=0.5, epochs=1).collect()
    assert len(got) == len(common.ROWS)
    assert sum(r["mix_tokens"] * r["mix_copies"] for r in got) <= sum(r["mix_tokens"] for r in got) // 2
    assert {r["mix_copies"] for r in got} <= {0, 1}
    whole = run(common.docs(spark), budget_share=1.0, epochs=1).collect()
    assert {r["mix_copies"] for r in whole if r["mix_tokens"]} == {1}
    assert run(common.empty(spark)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = run(common.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
