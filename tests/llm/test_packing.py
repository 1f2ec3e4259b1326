import random

import pytest

pytest.importorskip("tapewright.llm")

from tapewright.llm.packing import container_summary, difference_partition, pack, pack_items  # noqa: E402

SIZES = "size_name string, capacity_tokens int"


def test_partition_keeps_items_and_balances():
    r = random.Random(1)
    for _ in range(40):
        sizes = [r.randrange(1, 100) for _ in range(r.randrange(1, 80))]
        m = r.randrange(1, 12)
        parts = difference_partition(sizes, m)
        assert sorted(i for _, items in parts for i in items) == list(range(len(sizes)))
        assert len(parts) <= m and all(t == sum(sizes[i] for i in items) for t, items in parts)
        if len(sizes) > 8 * m:
            assert max(t for t, _ in parts) - min(t for t, _ in parts) <= max(sizes)
    assert sorted(t for t, _ in difference_partition([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_pack_respects_capacity():
    r = random.Random(2)
    for _ in range(30):
        cap = r.randrange(50, 300)
        sizes = [min(cap - 1, int(r.lognormvariate(3, 1))) for _ in range(300)]
        bins = pack(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins)
        assert len(bins) <= 1.1 * sum(sizes) / cap + 2
    assert pack([], 10) == []
    assert pack([0, 0], 10) == [[0, 1]]


def test_items_cut_only_beyond_capacity(spark):
    items = [(1, 1200), (2, 512), (3, 0), (4, None), (None, 30), (5, 511), (5, 511)] + [(100 + i, 1 + i % 90) for i in range(400)]
    df = spark.createDataFrame(items, "item long, n_tokens long")
    caps = spark.createDataFrame([("small", 512), ("large", 4096)], SIZES)
    rows = pack_items(df, caps, shard_containers=8).collect()
    for name, cap in (("small", 512), ("large", 4096)):
        mine = [r for r in rows if r["size_name"] == name]
        load, per = {}, {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
            per.setdefault(r["item"], []).append((r["start_token"], r["n_tokens"]))
        assert max(load.values()) <= cap
        assert len(per) == len({i for i, _ in items})
        assert sum(load.values()) == sum(n or 0 for _, n in items)
        assert sorted(per[1]) == ([(0, 512), (512, 512), (1024, 176)] if cap == 512 else [(0, 1200)])
        assert len(per[5]) == 2
    fill = {r["size_name"]: r["fill"] for r in container_summary(pack_items(df, caps), caps).collect()}
    assert fill["small"] > 0.9
    assert pack_items(df.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        pack_items(df, spark.createDataFrame([("x", 0)], SIZES))


def test_whole_table(spark, sf):
    import os

    from tapewright.llm.queries import REGISTRY
    from tapewright.llm.tokens import TOKENIZER, TOKENIZER_DIR

    if not os.path.exists(os.path.join(TOKENIZER_DIR, TOKENIZER)):
        pytest.skip("no vocabulary here")
    for r in REGISTRY.queries["p8_fill"](spark, sf).collect():
        assert r["fullest"] <= r["capacity_tokens"] and r["fill"] > 0.8


def test_same_containers_however_partitioned(spark):
    df = spark.createDataFrame([(None, 100)] * 500 + [(7, 3000)] * 3 + [(i, 40 + i % 300) for i in range(500)], "item long, n_tokens long")
    caps = spark.createDataFrame([("small", 512)], SIZES)
    got = [sorted((r["container_id"], str(r["item"]), r["piece_no"], r["n_tokens"]) for r in pack_items(df.repartition(n), caps, shard_containers=8).collect()) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 1000 + 3 * 6
    shards = {c.rsplit("-", 1)[0] for c, item, _, _ in got[0] if item == "None"}
    assert len(shards) > 10  # items without an id are spread


def test_tokens_of_any_text():
    import os

    from tapewright.llm.tokens import BLANKS, TOKENIZER, TOKENIZER_DIR, count_text, load_encoding

    path = os.path.join(TOKENIZER_DIR, TOKENIZER)
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    e = load_encoding(path)
    whole = lambda t: len(e.encode_ordinary(t))
    for text in ("a\tb" * 30_000, "x" * 100_000, "word " * 50_000, "", " ", "a" + " " * (BLANKS + 5) + "b c", " " * (2 * BLANKS), "\n" * BLANKS + "b" + " " * BLANKS, "a" + " " * BLANKS + "\n"):
        assert count_text(e, text) == whole(text)
    assert count_text(e, None) == 0
    assert count_text(e, "a" + " " * 3_000_000 + "b") == count_text(e, "a" + " " * 1_000_000 + "b") + len(e._encode_single_piece(" " * 2_999_999)) - len(e._encode_single_piece(" " * 999_999))
