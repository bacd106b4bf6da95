import os

import pytest
from pyspark.sql import functions as F

from termloom.llm import encode
from termloom.llm.packing import Packer, capacities_of, fill_report, hilbert, pack, sizes

pytestmark = pytest.mark.skipif(not os.path.exists(encode.DEFAULT_PATH), reason="no vocabulary files")

TEXTS = [
    None, "", " ", "   \n\n  x", "Hello world, it's 2024!!  don't", "a  b   c\t\td\r\n\r\ne \n f", "naïve Größe 北京 👩‍⚖️ ​ x", "<|endoftext|> ordinary", "x" * 5000, "aaaaaaaaaaaaaaab aaaa aaab",
    "\x00\x1f \x85 \xa0 end ", "The sum of €1,234.56 was paid. " * 400, "l'article n° 3 ; “quoted” – dash—dash",
]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.DEFAULT_PATH)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_same_ids_as_the_public_library(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df).collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference()
    assert encode.encode_corpus(df.filter("false")).count() == 0


def test_memory_bound_keeps_ids():
    tight = encode.PieceIds(encode.DEFAULT_PATH, held=3)
    for t, want in zip(TEXTS, reference()):
        flat, bounds = tight.encode([t or ""])
        assert flat.tolist() == want and bounds.tolist() == [0, len(want)]


def test_packing_is_whole_and_within_capacity(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 5)], "doc_id long, text string")
    sized = sizes(df)
    want = {r.doc_id: r.tokens for r in sized.collect()}
    caps = [("big", 700), ("small", 50)]
    got = pack(sized, caps, block=7).collect()
    for name, cap in caps:
        rows = [r for r in got if r.container_name == name]
        fill, per = {}, {}
        for r in rows:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            per.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.tokens))
        assert max(fill.values()) <= cap
        assert {k: sum(t for *_, t in v) for k, v in per.items()} == want
        for k, v in per.items():
            assert len(v) == max(1, -(-want[k] // cap))
            assert sorted(f for _, f, _ in v) == [i * cap for i in range(len(v))]
    sizes_df = spark.createDataFrame([("big", 700), ("small", 50), (None, 3), ("bad", 0)], "container_name string, capacity_tokens int")
    assert capacities_of(sizes_df) == [("big", 700), ("small", 50)]
    assert fill_report(pack(sized, caps), sizes_df).filter(F.col("containers") < F.col("least")).count() == 0


def test_best_fit_and_curve():
    import numpy as np

    p = Packer("n", 10, 0)
    used = {c for _, c, *_ in p.block([(i, t, 0) for i, t in enumerate([6, 4, 7, 3, 5, 5, 10, 23])])}
    assert len(used) == 4 + 2 + 1
    g = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    h = hilbert(g, 3)
    assert sorted(h) == list(range(512)) and set(np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(axis=1)) == {1}


def test_containers_hold_neighbours_on_the_curve(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.randrange(20, 60), rng.randrange(1 << 30)) for i in range(8000)]
    sized = spark.createDataFrame(rows, "doc_id long, tokens long, place long")
    caps = spark.createDataFrame([("c", 400)], "container_name string, capacity_tokens int")
    r = fill_report(pack(sized, [("c", 400)]), caps).first()
    assert r.documents == 8000 and r.tokens == sum(t for _, t, _ in rows) and r.unused_share < 0.03 and r.curve_spread < 0.1
