import bisect
import random

from civiclink.operators import quantiles as q


def rank_error(values, quantile, rank):
    """How far the rank of a value lies from the one asked for, as a share of the count."""
    values = sorted(values)
    low, high = bisect.bisect_left(values, quantile) / len(values), bisect.bisect_right(values, quantile) / len(values)
    return 0 if low <= rank <= high else min(abs(low - rank), abs(high - rank))


def test_merged_sketches_against_exact_ranks(spark):
    r = random.Random(4)
    rows = [(i % 3, i % 10, r.expovariate(0.01) if i % 2 else float(r.randrange(20))) for i in range(30_000)]
    stored = q.sketches(spark.createDataFrame(rows, "source int, day int, value double").repartition(7), ["source", "day"], "value")
    assert stored.count() == 30
    got = q.quantiles(q.merged(stored, ["source"])).collect()
    for row in got:
        values = [v for s, _, v in rows if s == row["source"]]
        assert (row["n"], row["low"], row["high"]) == (len(values), min(values), max(values))
        assert abs(row["mean"] - sum(values) / len(values)) < 1e-6
        for rank in q.RANKS:
            assert rank_error(values, row[f"q{round(100 * rank):02d}"], rank) < 0.01


def test_small_groups_are_exact_and_nulls_do_not_count(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 9.0), ("a", None), ("b", None), ("c", 5.0)]
    got = {r["g"]: r for r in q.quantiles(q.sketches(spark.createDataFrame(rows, "g string, value double"), ["g"], "value"), (0.5,)).collect()}
    assert (got["a"]["n"], got["a"]["q50"], got["a"]["mean"]) == (3, 2.0, 4.0)
    assert (got["b"]["n"], got["b"]["q50"], got["b"]["mean"]) == (0, None, None)
    assert got["c"]["q50"] == 5.0
    assert q.quantiles(q.sketches(spark.createDataFrame([], "g string, value double"), ["g"], "value")).count() == 0


def test_usage_of_responses_by_day_then_by_model(spark):
    rows = [("m", d, 10 * d, 5, float(100 * i + d)) for d in range(1, 4) for i in range(1, 101)] + [("m", 1, None, None, None), ("k", 1, None, None, None), ("k", 2, 7, None, 3.0)]
    rollup = q.response_rollup(spark.createDataFrame(rows, "model_id string, day int, prompt_tokens long, output_tokens long, latency_ms double"))
    assert rollup.count() == 5
    got = {r["model_id"]: r for r in q.response_usage(rollup, ["model_id"]).collect()}
    m = got["m"]
    assert (m["responses"], m["prompt_tokens"], m["output_tokens"], m["longest_ms"]) == (301, 6000, 1500, 10003.0)
    latencies = [x[4] for x in rows if x[0] == "m" and x[4]]
    assert rank_error(latencies, m["latency_q95"], 0.95) < 0.01 and m["tokens_q50"] == 25.0
    assert (got["k"]["responses"], got["k"]["tokens_q50"], got["k"]["latency_q50"]) == (2, 7.0, 3.0)
