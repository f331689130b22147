import zlib
import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.llm import catalog, chat, sharding
from quillframe.llm.bitmap import Bitmap, bitmap
from quillframe.llm.components import components, joined


def test_chat_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    told = c.execute(catalog.oracle_sql()["op7_chat_formatting"])
    names = [x[0] for x in told.description]
    assert sorted(told.fetchall()) == sorted(tuple(r) for r in catalog.op7_chat_formatting(spark, sf).select(*names).collect())


CONVERSATIONS = [
    (1, 0, "system", "be\nkind"), (1, 1, "user", "<|im_end|> hi"), (1, 2, "assistant", "<|\\ <\\| <\\\\|x<"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "<|im_start|>assistant\nno"),
    (2, 0, "user", "alone"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, None, "first"), (None, 0, "assistant", "x"), (4, 0, "a%0A\n<b", "t"), (5, 0, "assistant", "y" * 50_000),
]


def test_chat_edges(spark):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digest(chat.expand(rows)).collect()}
    for i in {r[0] for r in CONVERSATIONS}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in CONVERSATIONS if k == i))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        told = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        r = found[i]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)), i
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (told, loss)), i
    examples = chat.expand(rows).filter("conv_id = 1").orderBy("example").collect()
    assert [e.example for e in examples] == [3, 5, 6] and [e.loss_chars for e in examples][2] == 0
    assert all(later.formatted.startswith(e.formatted) for e, later in zip(examples, examples[1:], strict=False))
    assert chat.digest(chat.expand(rows.limit(0))).collect() == []


def test_chat_runs_no_python(spark, sf):
    plan = catalog.op7_chat_formatting(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def check_shards(rows, shards=16):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for of in by.values():
        assert sorted(r.slot for r in of) == list(range(len(of)))
    return np.array([sum(r["size"] for r in by.get(k, [])) for k in range(shards)])


def test_sharding(spark, sf, table, docs, no_docs):
    rows = catalog.op10_sharding(spark, sf).collect()
    assert len(rows) == len(table) and {r.doc_id: r["size"] for r in rows} == {i: len(t.encode()) + 1 for i, t, _ in table}
    assert {r.doc_id: r.text_crc32 for r in rows} == {i: zlib.crc32(t.encode()) for i, t, _ in table}
    load = check_shards(rows)
    assert load.max() - load.min() <= 0.02 * load.mean()
    odd = sharding.shard_documents(docs).collect()
    check_shards(odd)
    assert len(odd) == docs.count() and next(r for r in odd if r.doc_id == 3)["size"] == 1
    assert sharding.shard_documents(no_docs).collect() == []


def test_a_hot_doc_id_is_dealt_over_slots(spark):
    rows = [(None if i % 2 else 5, f"text {i} " * (i % 7)) for i in range(4000)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = check_shards(placed)
    assert len({r.virtual_slot for r in placed}) > 1500 and load.max() - load.min() <= 0.02 * load.mean()


def test_growing_moves_slots_to_the_new_shard_alone(spark, sf, tmp_path):
    """An edit of the stored map: records of slots that it doesn't name stay where they are."""
    path = f"file://{tmp_path}/map"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    placed = sharding.shard_documents(docs, map_path=path).collect()
    used = placed[0].map_version
    weight = np.zeros(sharding.SLOTS)
    for r in placed:
        weight[r.virtual_slot] += r["size"]
    shard = np.zeros(sharding.SLOTS, np.int64)
    for r in sharding.load_map(spark, path, used).collect():
        shard[r.virtual_slot] = r.shard
    more = sharding.SlotMap(shard, 16, used).grown(weight)
    more.save(spark, path, np.zeros(sharding.SLOTS, np.int64))
    now = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, used + 1).collect()}
    moved = [r for r in placed if now[r.virtual_slot] != r.shard]
    assert moved and {now[r.virtual_slot] for r in moved} == {16}
    assert sum(r["size"] for r in moved) == pytest.approx(weight.sum() / 17, rel=0.1)


@given(st.lists(st.integers(0, 1000), min_size=16, max_size=200))
@settings(max_examples=60, deadline=None)
def test_slot_map_edits(weights):
    w = np.array(weights, float)
    first = sharding.SlotMap.uniform(len(w), 4)
    made = first.rebalanced(w)
    load = lambda m: np.bincount(m.shard, w, m.shards)
    assert (load(made) ** 2).sum() <= (load(first) ** 2).sum() and made.version in (1, 2)
    more = made.grown(w)
    moved = more.shard != made.shard
    assert (more.shard[moved] == 4).all() and more.version == made.version + 1


def test_map_versions_stay(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    first = sharding.SlotMap.uniform(64, 4)
    first.save(spark, path, np.ones(64, int))
    first.grown(np.ones(64)).save(spark, path, np.ones(64, int))
    assert sharding.load_map(spark, path, 1).select("shard").distinct().count() == 4
    assert sharding.load_map(spark, path, 2).select("shard").distinct().count() == 5


def test_bitmap_finds_all(spark):
    values = spark.range(5000).selectExpr("xxhash64(id) AS h")
    found = bitmap(values, "h")
    h = np.array([r.h for r in values.collect()]).view(np.uint64)
    assert found.has(h).all()
    others = np.array([r.h for r in spark.range(5000, 10_000).selectExpr("xxhash64(id) AS h").collect()]).view(np.uint64)
    assert found.has(others).mean() < 0.05
    assert not bitmap(values.limit(0), "h").has(h).any() and isinstance(found, Bitmap)


@pytest.mark.parametrize("edges", [[(1, 2), (3, 2), (3, 4), (8, 9), (5, 6), (6, 7), (7, 5)], [(i, i + 1) for i in range(40)], []])
def test_components(spark, edges):
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {x: x for e in edges for x in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert found == of


@pytest.mark.parametrize("cut", [0, 3, 20, 60])
def test_joined_components(spark, cut):
    edges = [tuple(map(int, e)) for e in np.random.default_rng(cut).integers(0, 50, (60, 2))]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    whole = {r.node: r.label for r in components(frame(edges)).collect()}
    found = {r.node: r.label for r in joined(components(frame(edges[:cut])), frame(edges[cut:])).collect()}
    assert {k: found.get(k, k) for k in whole} == whole
