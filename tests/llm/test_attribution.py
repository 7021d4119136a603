import datetime as dt
import random
import zlib

import pytest

from lodestone.llm import attribution as at
from lodestone.llm import queries

EPOCH = dt.datetime(1970, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, sale_id string, at long, row string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, kind string, day int"


def us(t):
    return None if t is None else (t - EPOCH) // dt.timedelta(microseconds=1)


def brute(clicks, sales, batches):
    """The stream as its contract words it, row by row."""

    def hour(i, came, own):
        return (own if came is None else came) // at.HOUR + (240 if zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 0 else 0)

    single = {}
    for i, t, came, client, *_ in clicks:
        if t is not None and client is not None:
            row = (us(came) if came else us(t), us(t), client)
            single[i] = min(single.get(i, row), row)
    c = [(i, t, client, hour(i, came, t)) for i, (came, t, client) in single.items()]
    s = [(i, us(t), client, hour(i, us(came), us(t))) for i, client, t, came, *_ in sales if t is not None and client is not None]
    lo, hi = (min(x[3] for x in c), max(x[3] for x in c)) if c else (0, 0)
    batch = lambda h: max(0, min(batches - 1, batches * (h - lo) // (hi - lo + 1))) if c else 0
    held_c, held_s, out, top_c, top_s = [], [], [], None, None

    def close(sale, number):
        i, t, client, _ = sale
        own = [(x[1], -x[0] if x[0] is not None else 0, x[0]) for x in held_c if x[2] == client and t - at.WINDOW <= x[1] <= t]
        out.append((i, number, False, max(own)[2] if own else None, len(own)))

    for number in range(batches):
        w = None if top_c is None or top_s is None else min(top_c, top_s) - at.LATENESS
        for x in (x for x in c if batch(x[3]) == number):
            if w is None or x[1] >= w:
                held_c.append(x)
        for x in (x for x in s if batch(x[3]) == number):
            if w is not None and x[1] < w:
                out.append((x[0], number, True, None, 0))
            else:
                held_s.append(x)
        if w is not None:
            for x in [x for x in held_s if x[1] < w]:
                close(x, number)
            held_s = [x for x in held_s if x[1] >= w]
            held_c = [x for x in held_c if x[1] >= w - at.WINDOW]
        top_c = max([x[1] for x in c if batch(x[3]) == number] + ([top_c] if top_c is not None else []), default=None)
        top_s = max([x[1] for x in s if batch(x[3]) == number] + ([top_s] if top_s is not None else []), default=None)
    for x in held_s:
        close(x, batches)
    return sorted(out, key=str)


def got(spark, clicks, sales, batches):
    found = at.attribute_stream(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), batches)
    return sorted(map(tuple, found.collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(microseconds=rng.randrange(20 * at.DAY))
    late = lambda t: t + dt.timedelta(seconds=rng.choice([0, 1, 3600, 86400, 3 * 86400]))
    clicks, sales = [], []
    for i in range(300):
        t = when()
        clicks.append((i, t, late(t), rng.choice([1, 1, 1, 2, 3]), "x", 5, "clash"))
    for i in range(200):
        t = when()
        sales.append((i, rng.choice([1, 1, 2, 3, 4]), t, late(t), "sale", 7))
    # the window's edges to the microsecond, ties on time, midnight
    t = dt.datetime(2024, 1, 12)
    one, week = dt.timedelta(microseconds=1), dt.timedelta(days=7)
    for k, own in enumerate([t - week - one, t - week, t - week + one, t - one, t, t, t + one]):
        clicks.append((1000 - k, own, late(own), 9, None, None, None))
    sales += [(500, 9, t, t, None, None), (500, 9, t, t, None, None), (501, 9, t + one, None, None, None), (502, 8, t, t, None, None)]
    clicks += [clicks[0], (2000, None, t, 1, None, None, None), (2001, t, t, None, None, None, None), (2002, t, None, 9, None, None, None), (-3, t, t, 9, None, None, None), (None, t, t, 8, None, None, None)]
    sales += [(503, None, t, t, None, None), (504, 1, None, t, None, None), (None, 9, t, t, None, None)]
    return clicks, sales


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_brute_force(spark, batches):
    clicks, sales = made(batches)
    assert got(spark, clicks, sales, batches) == brute(clicks, sales, batches)


def test_empty_tables(spark):
    clicks, sales = made(7)
    assert got(spark, [], [], 2) == []
    assert got(spark, clicks, [], 2) == []
    assert got(spark, [], sales, 2) == brute([], sales, 2)


def test_hot_client_makes_no_pairs(spark):
    """2,000 clicks and 2,000 sales of one client within one week: 2 million pairs, but nine probes a sale."""
    start = us(dt.datetime(2024, 1, 1))
    rows = lambda n, step: spark.range(n).selectExpr("id as row", "id", "1L as client_id", f"{start} + id * {step} as at")
    found = at.attribute(rows(2000, 200_000_000), rows(2000, 200_000_000))
    assert found.where("click_id = sale_id and n_clicks = least(sale_id, 3024) + 1").count() == 2000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    work = at.Attribution(spark, str(tmp_path))
    day = us(dt.datetime(2024, 1, 1))
    rows = lambda data: spark.createDataFrame(data, at.ROW)
    first = rows([("click", 1, 11, 1, day), ("sale", 2, 21, 1, day + 5), ("click", 3, 12, 2, day + 9 * at.DAY), ("sale", 4, 22, 2, day + 9 * at.DAY)])
    second = rows([("click", 5, 13, 1, day + 1), ("sale", 6, 23, 1, day), ("click", 7, 14, 2, day + 9 * at.DAY + 1)])
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        work.step(batch, number)
    assert sorted(map(tuple, work.finish(1).collect())) == [(21, 1, False, 11, 1), (22, 2, False, 12, 1), (23, 1, True, None, 0)]


def test_query_and_sql_name_the_same_columns():
    assert "op13_attribution" in queries.QUERIES and "op13_attribution" in queries.ORACLES
