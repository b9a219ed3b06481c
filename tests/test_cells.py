"""Threshold cells against plain counting, and what their plans contain."""

import random

import pytest

from panelspark.plans import rules as R
from panelspark.plans.cells import DOWN, PRODUCTS, UP, Boxes, Side
from pyspark.sql import functions as F
from tests.test_rules import panel_frame

NAMES = ["a", "b", "c"]


def made_up(seed, rows=400):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.1 else float(rng.randint(-5, 5))
    return [(rng.randint(0, 6), value(), value(), value(), rng.getrandbits(62)) for _ in range(rows)]


def boxes_of(seed):
    rng = random.Random(seed + 100)
    side = lambda: Side(rng.choice(NAMES), rng.choice([UP, DOWN]), rng.choice([None, -7.0, -2.0, 0.0, 0.5, 3.0, 9.0]))
    found = [tuple(s if s.threshold is not None else Side(s.axis) for s in (side(), side())) for _ in range(40)]
    found += [(Side(n),) for n in NAMES] + [(Side("a", UP, 1.0),), (Side("a", DOWN, -1.0), Side("a", UP, 2.0))]
    return [(10 + i, sides) for i, sides in enumerate(found)]


def holds(side, row):
    value = row[1 + NAMES.index(side.axis)]
    if value is None or side.threshold is None:
        return value is not None
    return value <= side.threshold if side.direction == UP else value >= side.threshold


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_of_boxes(spark, seed):
    rows, tagged = made_up(seed), boxes_of(seed)
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, x long").repartition(3)
    boxes = Boxes({n: F.col(n) for n in NAMES})
    for tag, sides in tagged:
        boxes.add(tag, *sides)
    stats = [F.count(F.lit(1)).alias("n"), F.sum("a").alias("s"), F.bit_xor("x").alias("x")]
    got = {
        (r.tag, r.k): (r.n, r.s, r.x)
        for r in boxes.sums(boxes.cells(df, "k", ["a", "x"], stats), "k", ["n", "s"], ["x"]).collect()
    }
    want = {}
    for tag, sides in tagged:
        for row in rows:
            if all(holds(s, row) for s in sides):
                n, s, x = want.get((tag, row[0]), (0, None, 0))
                s = s if row[1] is None else row[1] + (s or 0.0)
                want[tag, row[0]] = n + 1, s, x ^ row[4]
    assert got == want and len(want) > 100


@pytest.mark.parametrize("seed", [4, 5])
def test_products_over_keys(spark, seed):
    """Sums over keys of products of counts, from rows in order: keys that go on in the next
    batch, a null key, and boxes with a base of their own."""
    rows, tagged = made_up(seed), boxes_of(seed)
    rows = [(None if r[0] == 6 else r[0], *r[1:4], r[4] % 2) for r in rows]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, hit int").repartition(3)
    boxes = Boxes({n: F.col(n) for n in NAMES})
    for tag, sides in tagged:
        boxes.add(tag, *sides)
    bases = {tag: tagged[i - 1][0] for i, (tag, _) in enumerate(tagged) if i % 2}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {r.tag: tuple(r) for r in boxes.products(df, "k", "hit", bases).select("tag", "keys", "most", *PRODUCTS).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = [None, *range(6)]
    n, h = (
        {tag: [sum(all(holds(s, r) for s in sides) and r[0] == k and r[4] >= least for r in rows) for k in keys] for tag, sides in tagged}
        for least in (0, 1)
    )
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {}
    for tag, _ in tagged:
        a, b, base = n[tag], h[tag], bases.get(tag, tag)
        found = dot(a, a), dot(a, b), dot(b, b), dot(a, n[base]), dot(a, h[base]), dot(b, n[base]), dot(b, h[base])
        if sum(a):
            want[tag] = tag, sum(x > 0 for x in a), max(a), *found
    assert got == want and len(want) > 30


def test_no_row_per_entity_and_rule(spark):
    """What an evidence run writes does not grow with entities times rules."""
    panel = spark.createDataFrame(panel_frame())
    rules = list(enumerate(R.make_rule(f"fa >= {i / 10}", panel.columns) for i in range(10)))
    clean = R.clean_panel(panel, ["fa"], 0.0)
    boxes = R.rule_boxes(rules, [("fa",)])
    over = R.sums_over_entities(clean, boxes, {tag: -1 for tag, _ in rules})
    assert clean.select("entity").distinct().count() > 1
    assert over.count() == over.select("tag").distinct().count() <= 11


def test_cells_that_a_box_holds(spark):
    rows, tagged = made_up(3), boxes_of(3)
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, x long")
    boxes = Boxes({n: F.col(n) for n in NAMES})
    for tag, sides in tagged:
        boxes.add(tag, *sides)
    cells = boxes.cells(df, "k", [], [F.count(F.lit(1)).alias("n")])
    wanted = spark.createDataFrame([(tag, k) for tag, _ in tagged[::3] for k in (1, 4)], "tag long, k int")
    got = {(r.tag, r.k): r.n for r in boxes.met(cells, wanted).groupBy("tag", "k").agg(F.sum("n").alias("n")).collect()}
    want = {}
    for tag, sides in tagged[::3]:
        for k in (1, 4):
            n = sum(row[0] == k and all(holds(s, row) for s in sides) for row in rows)
            if n:
                want[tag, k] = n
    assert got == want


def test_no_row_per_rule_and_no_percentile(spark):
    """A hundred rules on one factor pair: the panel pass makes one row per grid, not per rule."""
    panel = spark.createDataFrame(panel_frame())
    texts = [f"(fa >= {i / 10}) and (fb <= {j / 10})" for i in range(10) for j in range(10)]
    rules = list(enumerate(R.make_rule(t, panel.columns) for t in texts))
    assert all(len(rule.conditions) == 2 for _, rule in rules)
    clean = R.clean_panel(panel, ["fa", "fb"], 0.0)
    boxes = R.rule_boxes(rules, [("fa", "fb")])
    assert boxes.placed(clean, ["entity"]).count() <= clean.count()
    plan = R.sums_by_session(clean, boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    # Each of a hundred rules and the baseline, on each session on which it holds rows.
    assert R.sums_by_session(clean, boxes).select("tag").distinct().count() == 101


def test_formulas_that_are_no_boxes(spark):
    df = panel_frame(seed=5)
    panel = spark.createDataFrame(df)
    texts = {
        "fa > 0.5": lambda d: d.fa > 0.5,
        "fa >= 0.5 or fb <= -1": lambda d: (d.fa >= 0.5) | (d.fb <= -1),
        "not (fa >= 0.1) and fb <= 0": lambda d: ~(d.fa >= 0.1) & d.fa.notna() & (d.fb <= 0),
        "fa >= fb": lambda d: d.fa >= d.fb,
    }
    got = {r.formula: r for r in R.evaluate_rules(panel.where("NOT isnan(fa) AND NOT isnan(fb)"), list(texts), lag=2).collect()}
    both = df[df.fa.notna() & df.fb.notna()]
    for text, mask in texts.items():
        assert got[text].matched_sample_count == int(mask(both).sum()), text
        assert got[text].eligible_sample_count == len(both)
        chosen = both[mask(both) & both.forward_return.notna()]
        assert got[text].median_return == pytest.approx(chosen.forward_return.median(), rel=1e-12)


def test_more_factors_than_bits(spark):
    """Seventy factors: patterns of known factors once had to fit one long."""
    n = 70
    df = spark.range(300).select(
        (F.col("id") % 10).alias("entity"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 10).cast("int")).alias("session"),
        ((F.col("id") % 7) - 3.0).alias("forward_return"),
        *[F.when((F.col("id") + i) % 11 != 0, (F.col("id") * (i + 1) % 13).cast("double")).alias(f"f{i}") for i in range(n)],
    )
    rows = df.collect()
    got = R.evaluate_rules(df, [f"f{i} >= 6" for i in range(n)]).collect()
    for r in got:
        name = r.formula.split()[0]
        known = [x for x in rows if x[name] is not None]
        assert r.eligible_sample_count == len(known)
        assert r.matched_sample_count == sum(x[name] >= 6 for x in known)
