"""Card payments, contained names and names within a few edits, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.card_payments import settled_payments, trailing_windows
from tallyloom.operators.contained import longest_contained
from tallyloom.operators.edit_join import similar_pairs


def test_payments_meet_windows_of_their_own_card(spark):
    charges = [("c1", "a", 10, 500), ("c2", "a", 12, 250), ("c3", "a", 12, 50), ("c4", "b", 12, 700), ("c5", "b", 3, 100), ("c6", None, 12, 800), ("c7", "a", None, 5), ("c8", "z", 12, 40), ("c9", "z", 11, 0)]
    payments = [("p1", "a", 13, 300), ("p2", "a", 13, 800), ("p3", "b", 12, 700), ("p4", "b", 12, 300), ("p5", "a", 12, 700), ("p6", "b", 9, 100), ("p7", "b", 8, 100), ("p8", None, 12, 800), ("p9", "z", 12, 40), ("p10", "a", 13, None)]
    left = spark.createDataFrame(charges, "tx_id string, card string, day long, cents long")
    right = spark.createDataFrame(payments, "tx_id string, card string, day long, cents long")
    for kw in ({}, {"share": 0.001, "floor": 1}):
        got = {r.tx_id: (r.windows, r.days_back, r.charges, r.first_id) for r in settled_payments(right, left, ["card"], 5, **kw).collect()}
        assert got == {"p1": (1, 1, 2, "c2"), "p2": (1, 3, 3, "c1"), "p3": (1, 0, 1, "c4"), "p7": (1, 5, 1, "c5"), "p9": (2, 0, 1, "c8")}
    # Without a card all charges are of one: those of day 12 add up to 1840, with the day before as well.
    pooled = spark.createDataFrame([("q1", 12, 1840), ("q2", 12, 700), ("q3", 3, 100)], "tx_id string, day long, cents long")
    assert {r.tx_id: r.windows for r in settled_payments(pooled, left, [], 1).collect()} == {"q1": 2, "q3": 1}
    assert trailing_windows(left.limit(0), ["card"], 5).count() == 0


def test_payments_are_worked_out_once(spark, monkeypatch):
    from tallyloom.operators import card_payments

    kept, made = card_payments.materialise, {}
    monkeypatch.setattr(card_payments, "materialise", lambda frame, label: made.setdefault(label, kept(frame, label)))
    charges = spark.createDataFrame([("c1", "a", 10, 500), ("c2", "a", 12, 250)], "tx_id string, card string, day long, cents long")
    payments = spark.range(3).selectExpr("concat('p', id) AS tx_id", "'a' AS card", "12L AS day", "250L * id AS cents")
    found = settled_payments(payments, charges, ["card"], 5)
    assert made["payments"].columns == ["tx_id", "card", "day", "cents"] and "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.tx_id, r.windows) for r in found.collect()] == [("p1", 1)]


@pytest.mark.parametrize("reach", [0, 5])
def test_windows_are_made_for_days_asked_about(spark, reach):
    """Days below zero and on both sides of every stretch; without ``on`` all days up to ``reach`` after a charge."""
    r = random.Random(5)
    charges = [(f"c{i:03d}", r.choice("abc"), r.randrange(-110, 110), r.randrange(1, 50)) for i in range(250)]
    left = spark.createDataFrame(charges, "tx_id string, card string, day long, cents long")
    asked = {(r.choice("abcd"), r.randrange(-115, 115)) for _ in range(60)}
    on = spark.createDataFrame([*asked, *asked, (None, 3), ("a", None)], "card string, day long")

    def brute(days):
        out = []
        for card, day in days:
            for back in range(reach + 1):
                inside = [c for c in charges if c[1] == card and day - back <= c[2] <= day]
                if any(c[2] == day - back for c in inside):
                    out.append((card, day, back, sum(c[3] for c in inside), len(inside), min(c[0] for c in inside)))
        return sorted(out)

    assert sorted(map(tuple, trailing_windows(left, ["card"], reach, on).collect())) == brute(asked)
    assert sorted(map(tuple, trailing_windows(left, ["card"], reach).collect())) == brute({(c[1], c[2] + k) for c in charges for k in range(reach + 1)})


def brute_inside(texts, names):
    out = {}
    for text in texts:
        hits = sorted((-len(n), o, n) for n, o in names.items() if text and n and o is not None and n in text)
        if hits:
            out[text] = (hits[0][2], hits[0][1])
    return out


@pytest.mark.parametrize("kw", [{}, {"limit": 400, "per_task": 7}, {"limit": 25, "per_task": 3}])
def test_longest_contained_equals_brute_force(spark, kw):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcé 😀") for _ in range(n))
    names = {word(r.choice([1, 2, 3, 4, 5, 8, 40, 200])): r.choice(["x", "y", "z"]) + str(i) for i in range(80)}
    # A hot beginning, names inside names, and repeated characters.
    names |= {"shop " + word(4): f"s{i}" for i in range(60)} | {"a" * n: f"a{n}" for n in (1, 2, 3, 50)}
    names |= {"": "empty", "no owner": None}
    long = [n for n in names if len(n) >= 40]
    texts = {word(r.randint(0, 30)) for _ in range(120)} | {word(3) + n + word(2) for n in r.sample(sorted(names), 60)} | set(long) | {"a" * 120, "", "zzz", "no owner"}
    frame = spark.createDataFrame([(t,) for t in sorted(texts)] + [(None,)], "text string")
    held = spark.createDataFrame(list(names.items()) + [(None, "null")], "name string, owner string")
    got = {row.text: (row.name, row.owner) for row in longest_contained(frame, held, **kw).collect()}
    assert got == brute_inside(texts, names)
    assert longest_contained(frame.limit(0), held, **kw).count() == 0 and longest_contained(frame, held.limit(0), **kw).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("limit, crowd, per_task", [(1, 1000, 1000), (2, 2, 1), (3, 1000, 1000), (3, 2, 1), (4, 3, 2)])
def test_similar_pairs_equal_brute_force(spark, limit, crowd, per_task):
    r = random.Random(limit)
    names = {"", "a", "ab", "abc"}
    for _ in range(12):
        base = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        for _ in range(6):
            s = list(base)
            for _ in range(r.randint(0, limit + 2)):
                i = r.randrange(len(s) + 1)
                s[i : i + r.randint(0, 1)] = r.choice(["", "é", "b", "c"])
            names.add("".join(s))
    names = sorted(names)
    rows = [(g, n, i) for g in (1, 2) for i, n in enumerate(names) if g == 1 or i % 2]
    pairs = similar_pairs(spark.createDataFrame(rows, "g int, n string, i int"), ["g"], "n", limit, ["i"], crowd, per_task)
    got = sorted((p.g, p.a.name, p.b.name, p.a.i) for p in pairs.collect())
    want = sorted((g, a, b, names.index(a)) for g in (1, 2) for _, a, _ in (x for x in rows if x[0] == g) for _, b, _ in (x for x in rows if x[0] == g)
                  if (len(a), a) > (len(b), b) and edits(a, b) <= limit)
    assert got == want and len(want) > 50


def test_a_crowded_segment_is_no_product(spark):
    """Names that share their beginning and differ behind it are not all compared."""
    r = random.Random(3)
    names = ["shop " + "".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(24)) for _ in range(4000)]
    names += [names[0][:-1] + "A", names[1][:9] + "A" + names[1][10:], names[2] + "AAA"]
    frame = spark.createDataFrame([(1, n) for n in names], "g int, n string").withColumn("n", F.col("n"))
    pairs = similar_pairs(frame, ["g"], "n", 3, crowd=50)
    assert sorted((p.a.name, p.b.name) for p in pairs.collect()) == sorted([(max(names[0], names[-3]), min(names[0], names[-3])), (max(names[1], names[-2]), min(names[1], names[-2])), (names[-1], names[2])])


def test_names_of_small_groups_are_compared_as_they_are(spark):
    """Few short names a group all share segments, so cutting them up finds most pairs many times."""
    from tallyloom.operators import duplicates

    names = [f"shop {i}" for i in range(40)]
    frame = spark.createDataFrame([(g, n) for g in range(3) for n in names], "g int, n string")
    pairs = similar_pairs(frame, ["g"], "n", 3)
    assert "Generate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 3 * 40 * 39 // 2
    rows = spark.createDataFrame([(f"t{i:02}", "2024-01-01", 5.0, n) for i, n in enumerate([*names, names[0], "another name"])], "tx_id string, date string, amount double, merchant string")
    rule = next(r for r in duplicates.load_duplicate_rules() if r["id"] == "fuzzy-merchant-levenshtein")
    got = {r.tx_id: (r.match_id, r.matches) for r in duplicates.rule_links(rows.withColumn("date", F.col("date").cast("date")), rule).collect()}
    assert got == {f"t{i:02}": ("t00", 40) for i in range(1, 41)}


def test_frames_of_a_time_window_are_summed_and_not_gathered(spark):
    import datetime as dt
    import random

    from tallyloom.operators import duplicates

    r = random.Random(3)
    day = dt.date(2024, 1, 1)
    rows = [(f"t{i:03d}", day + dt.timedelta(days=r.randrange(60)), r.choice([1.0, 2.0]), r.choice([1, -1]), r.choice(["m", "n"])) for i in range(200)]
    frame = spark.createDataFrame(rows, "tx_id string, date date, amount double, sign int, merchant string")
    rules = {x["id"]: x for x in duplicates.load_duplicate_rules()}
    refund, transfer = rules["refund-detection"], rules["transfer-matching"]
    tests = {
        "refund-detection": lambda a, b: a[4] == b[4] and a[2] == b[2] and a[3] > 0 > b[3] and 0 <= (a[1] - b[1]).days <= 30,
        "transfer-matching": lambda a, b: a[2] == b[2] and a[3] != b[3] and abs((a[1] - b[1]).days) <= 1,
    }
    made = []
    kept = duplicates.materialise
    duplicates.materialise = lambda df, label: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, label)
    try:
        for rule in (refund, transfer):
            got = {(x.tx_id, x.match_id, x.matches) for x in duplicates.rule_links(frame, rule).collect()}
            hits = {a[0]: [b[0] for b in rows if tests[rule["id"]](a, b)] for a in rows}
            assert got == {(i, min(h), len(h)) for i, h in hits.items() if h}
    finally:
        duplicates.materialise = kept
    assert len(made) == 2 and not any("collect_list" in plan for plan in made)


def test_texts_visit_only_shards_of_names_that_may_be_in_them(spark):
    from tallyloom.operators import contained

    texts = spark.createDataFrame([("xxabcyy",), ("q" * 50,), ("\u00e9\u00e9bc",)], "text string")
    got = contained._visits(texts, {"abc": 1, "b": 2, "zz": 3, "\u00e9b": 2}).collect()
    assert sorted((r.text, r.shard) for r in got) == sorted([("xxabcyy", 1), ("xxabcyy", 2), ("\u00e9\u00e9bc", 2)])


def test_names_that_begin_alike_are_cut_behind_their_beginning(spark, monkeypatch):
    """A text need not visit each cut of a hot beginning: groups of names fit the limit, but for names that nothing but their ends tells apart."""
    from tallyloom.operators import contained

    names = {str(i): f"k{i}" for i in range(3000)} | {"shop " + str(i): f"s{i}" for i in range(500)} | {"x" * 300: "long", "aéb": "e", "aéc": "e"}
    seen, kept = [], contained._visits
    monkeypatch.setattr(contained, "_visits", lambda texts, heads: seen.append(heads) or kept(texts, heads))
    texts = {"ref 10012345 shop 49", "shop 4999", "7", "xx", "x" * 301, "aé", "baébc 29999", "29"}
    frame, held = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(list(names.items()), "name string, owner string")
    got = {r.text: (r.name, r.owner) for r in contained.longest_contained(frame, held, limit=60, per_task=2).collect()}
    assert got == brute_inside(texts, names)
    heads = list(seen[0])
    assert all(sum(len(n) for n in names if n.startswith(h)) <= 60 or h[0] == "x" for h in heads)
    assert not any(a != b and a.startswith(b) for a in heads for b in heads)
    every = contained.all_contained(frame, held, limit=60, per_task=2).collect()
    assert sorted((r.text, r.name, r.owner) for r in every) == sorted((t, n, o) for t in texts for n, o in names.items() if n in t)
    # Beginnings that stay alike however often they are cut.
    monkeypatch.setattr(contained, "ROUNDS", 2)
    got = {r.text: (r.name, r.owner) for r in contained.longest_contained(frame, held, limit=60, per_task=2).collect()}
    assert got == brute_inside(texts, names)
