import random

from termloom.llm.splits import assign_splits, hash_to_min, matter_number, related_groups

SCHEMA = "item_id string, stratum_id string, ancestor_path array<string>, flags array<string>, node string"


def test_matter_marks(spark):
    from pyspark.sql import functions as F

    marks = {"matter:M-01": "1", "matter/530999": "530999", "MATTER NO. 0048": "48", "Matter M0012": "12", "mtr#07": "7", "matter=m-5": "5", "see matter M 003": "3", "matter:": None, "matter:unknown": None, "matter: 000": None, "docket:12": None, "bates:3": None, "notes": None, None: None}
    df = spark.createDataFrame([(k,) for k in marks], "f string").select("f", matter_number(F.col("f")).alias("n"))
    assert {r.f: r.n for r in df.collect()} == marks


def brute(rows):
    import re

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    loose = lambda s: re.sub(r"[\s–‐-]", "", s).lower()
    for item, stratum, path, flags, _ in rows:
        if item is None:
            continue
        find(("i", item))
        tokens = []
        if stratum and path and len(path) > 1 and path[1]:
            tokens.append(("s", loose(stratum), loose(path[1])))
        tokens += [("m", int(m.group(1))) for f in flags or [] if f and (m := re.search(r"^matter\D*0*([1-9]\d*)$", f))]
        for t in tokens:
            parent[find(("i", item))] = find(t)
    groups = {}
    for item in {r[0] for r in rows if r[0] is not None}:
        groups.setdefault(find(("i", item)), []).append(item)
    return {i: min(g) for g in groups.values() for i in g}


def test_groups_against_union_find(spark):
    rng = random.Random(3)
    rows = []
    for n in range(400):
        path = rng.choice([None, [], ["a"], ["a", None], ["a", f"Head – {rng.randrange(60)}"], ["b", f"head - {rng.randrange(60)}"]])
        flags = rng.choice([None, [], ["matter:unknown"], [f"matter:M-{rng.randrange(150):05d}", "docket:9"], [f"matter/{rng.randrange(150)}"]])
        rows.append((rng.choice([f"i{n:03d}", f"i{n // 3:03d}"]), rng.choice(["S-1", " s-1 ", "S-2", None, ""]), path, flags, "x"))
    rows.append((None, "S-1", ["a", "b"], None, None))
    rows += [(f"chain{n}", None, None, [f"matter:{1000 + n}", f"matter:{1001 + n}"], "") for n in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.item_id: r.group_id for r in related_groups(df).collect()} == brute(rows)
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("never", 0.0), ("null", None)], "slice_name string, proportion double")
    got = assign_splits(df, shares).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r.group_id, set()).add(r.split)
    assert len(got) == len(brute(rows)) and all(len(s) == 1 for s in by_group.values())
    assert {r.split for r in got} <= {"train", "validation", "test"}


def test_rendezvous_shares(spark):
    from pyspark.sql import functions as F

    from termloom.llm.splits import rendezvous

    df = spark.range(20_000).select(rendezvous(F.col("id").cast("string"), [("a", 0.8), ("b", 0.2)]).alias("s")).groupBy("s").count()
    got = {r.s: r["count"] for r in df.collect()}
    assert abs(got["a"] / 20_000 - 0.8) < 0.02


def test_empty_and_long_path(spark):
    assert related_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    edges = spark.createDataFrame([(f"{n:03d}", f"{n + 1:03d}") for n in range(70)], "a string, b string")
    assert {r.component for r in hash_to_min(edges).collect()} == {"000"}
