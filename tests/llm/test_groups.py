"""SimHash groups, shards, chats, the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format, sharding, simhash
from tidemark.llm.common import shared_path
from tidemark.llm.graph import components

from .conftest import HARD


def plain_fingerprint(text):
    import re

    import xxhash

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    """Least id of each row's component, all pairs compared."""
    fp = np.array(fps, np.uint64)
    label = np.arange(len(fp))
    while True:
        new = np.array([label[np.bitwise_count(fp ^ f) <= 4].min() for f in fp])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, k in zip(ids, label.tolist()):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [least.get(k) for k in label.tolist()]


def test_bits_of_all_fingerprints_are_correlated(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 50, raising=False)
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**62, 3000).astype(np.uint64) & rng.integers(0, 2**62, 3000).astype(np.uint64)
    fps |= (fps & np.uint64(0xFF)) << np.uint64(8)
    bits = (fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    df = spark.createDataFrame([(int(f),) for f in fps], "_tm_fp long")
    asked = []
    monkeypatch.setattr(simhash, "group_bits", lambda rho, m, to=simhash.group_bits: (asked.append(rho), to(rho, m))[1])
    simhash.plan_for(df, len(fps), 4, 5)
    with np.errstate(invalid="ignore"):
        want = np.nan_to_num(np.abs(np.corrcoef(bits.T.astype(float))))
    varies = bits.std(axis=0) > 0
    assert np.allclose(asked[0][np.ix_(varies, varies)], want[np.ix_(varies, varies)], atol=1e-6)


@settings(max_examples=100, deadline=None)
@given(text=st.text("ab C\n\t\x1c éZ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_engines_hash_alike(spark):
    import xxhash

    texts = ["a b c d", "é ü", "", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [g % 2**64 for g in got] == [xxhash.xxh64(t.encode(), seed=42).intdigest() for t in texts]


def near_copies(rng, n):
    """Groups of fingerprints within a few bits, chains of them, and strangers."""
    out = [0]
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 2, 30])):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            out.append(f)
    return [x - 2**64 if x >= 2**63 else x for x in dict.fromkeys(out)]


@pytest.mark.parametrize("m,block", [(None, 8192), (3, 8192), (4, 7), (5, 3)])
def test_links_against_all_pairs(spark, monkeypatch, m, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(m or 0)
    # a dense cloud shares most bits, so that buckets split
    cloud = [rng.getrandbits(64)]
    cloud += [cloud[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(10)) for _ in range(150)]
    fps = list(dict.fromkeys(near_copies(rng, 500) + [x - 2**64 if x >= 2**63 else x for x in cloud]))
    df = spark.createDataFrame([(f,) for f in fps], "_tm_fp long")
    found = components(simhash.links(df, simhash.plan_for(df, len(fps), 4, m)))
    root = {r.u: r.v for r in found.collect()}
    ids = list(range(len(fps)))
    want = plain_components(ids, [f % 2**64 for f in fps])
    groups = {}
    for i, f in zip(ids, fps):
        groups.setdefault(root.get(f, f), []).append(i)
    least = {i: min(xs) for xs in groups.values() for i in xs}
    assert [least[i] for i in ids] == want


def test_thresholds_add_up():
    rng = np.random.default_rng(0)
    groups = simhash.group_bits(np.abs(rng.normal(size=(64, 64))), 5)
    assert sorted(b for g in groups for b in g) == list(range(64))
    # the first partition's values are crowded: it is skipped, and another has a wider threshold
    near = [[simhash.coded(x) for x in simhash.near_counts(rng.integers(0, 50, 1 << len(g)) * (1 if i else 10_000), len(g), 2)] for i, g in enumerate(groups)]
    fp = rng.integers(0, 2**63, 200).astype(np.uint64)
    t = simhash.Plan(groups, near, 4).thresholds(simhash.part_values(fp, groups))
    assert (t.sum(axis=1) == 4 - 5 + 1).all() and (t[:, 0] == -1).any() and len(set(map(tuple, t))) > 1


def test_counts_in_a_byte():
    counts = np.concatenate([np.arange(5000), 10 ** np.arange(18)])
    found = simhash.MOST[simhash.coded(counts)]
    assert (found[:3] == [0, 1, 2]).all() and (found >= counts).all() and (found <= np.maximum(2, counts * simhash.GROWTH)).all()
    assert all(simhash.plan_bytes(m) <= simhash.PLAN_BYTES for m in (3, 4, 5)) and simhash.number_of_partitions(10**10) == 3


def test_counts_of_a_plan(spark):
    """What the executors count and send is no less than what is there, and exact up to 2."""
    rng = random.Random(11)
    fps = [rng.getrandbits(64) for _ in range(300)] + [rng.getrandbits(64) & 0xFF for _ in range(200)]
    fps = list({x - 2**64 if x >= 2**63 else x for x in fps})
    plan = simhash.plan_for(spark.createDataFrame([(f,) for f in fps], "_tm_fp long"), len(fps), 4, 5)
    values = simhash.part_values(np.array(fps, np.int64).view(np.uint64), plan.groups)
    for i, v in enumerate(values):
        count = Counter(v.tolist())
        want = np.array([count[x] for x in range(1 << len(plan.groups[i]))])
        for radius, near in enumerate(simhash.near_counts(want, len(plan.groups[i]), 2)):
            got = plan.count(i, radius, np.arange(len(near)))
            assert (got >= near).all() and ((got == near) | (near > 1)).all() and (got <= near * simhash.GROWTH**2 + 1).all()


def test_a_heavy_group_is_not_gathered(spark):
    """With most rows in one group, no task of the join reads more than its share."""
    from tidemark.llm import graph

    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = graph.with_group(rows, "k", 60_000, least=F.min("x"), n=F.count("x"))
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = {r.k: (r.least, r.n) for r in out.select("k", "least", "n").distinct().collect()}
    assert out.count() == 60_000 and got[7][1] > 40_000 and got[7][0] == 1 and len(got) == rows.select("k").distinct().count()
    assert max(sizes) < 20_000


def test_near_counts():
    hist = np.random.default_rng(1).integers(0, 9, 1 << 6)
    for r, got in enumerate(simhash.near_counts(hist, 6, 2)):
        assert got.tolist() == [sum(int(hist[u]) for u in range(64) if bin(u ^ v).count("1") <= r) for v in range(64)]


def test_components_of_paths_and_stars(spark):
    rng, edges = random.Random(7), []
    for a, b in ((0, 200), (1000, 1500)):
        edges += [(i + 1, i) for i in range(a, b)]
    edges += [(5000 + i, 3000) for i in range(300)]
    edges += [(100_000 + i, 50_000) for i in range(25_000)]  # a hub beyond what is joined by key
    rng.shuffle(edges)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges + edges[:9], "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1001, 1501)) and all(got[5000 + i] == 3000 for i in range(300)) and all(got[100_000 + i] == 50_000 for i in range(25_000))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_clusters_of_hard_rows(hard, empty):
    rows = hard.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], plain_components([r.doc_id for r in rows], fps)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.clustered(hard).collect()) == want
    assert simhash.clustered(empty).count() == 0


def test_one_of_each_component_stays(hard, empty):
    out = simhash.deduplicated(hard)
    got, rows = out.collect(), hard.select("doc_id", "text").collect()
    roots = plain_components(list(range(len(rows))), [plain_fingerprint(r.text) for r in rows])
    assert out.columns == hard.columns and len(got) == len(set(roots))
    root_of = {plain_fingerprint(r.text): k for r, k in zip(rows, roots)}
    assert len({root_of[plain_fingerprint(r.text)] for r in got}) == len(got)
    assert simhash.deduplicated(empty).count() == 0


def test_shards(spark, hard, empty):
    rng = random.Random(8)
    docs = hard.unionByName(spark.createDataFrame([(100 + i, "x" * rng.randint(0, 5000)) for i in range(2000)], "doc_id long, text string"), allowMissingColumns=True).filter("length(coalesce(text, '')) < 100000")
    rows, got = docs.select("doc_id", "text").collect(), sharding.sharded(docs).collect()
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == Counter((g.doc_id, g.size, g.text_crc32) for g in got)
    places, sizes = {}, Counter()
    for g in got:
        places.setdefault(g.shard, []).append(g.slot)
        sizes[g.shard] += g.size
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and set(places) == set(range(16))
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    assert sharding.sharded(empty).count() == 0


def test_map_versions(spark):
    rng = random.Random(9)
    sizes = [rng.randint(1, 1000) for _ in range(4096)]
    load = lambda m: [sum(s for s, k in zip(sizes, m.shard_of) if k == i) for i in range(m.shards)]
    one = sharding.SlotMap.new(sizes, 16)
    more, less = one.rebalanced(sizes, 20), one.rebalanced(sizes, 12)
    for m in (one, more, less):
        assert max(load(m)) < 1.03 * min(load(m))
    moved = sum(a != b for a, b in zip(one.shard_of, more.shard_of))
    assert moved < 0.3 * len(sizes) and more.version == 2 and all(b >= 16 for a, b in zip(one.shard_of, more.shard_of) if a != b)
    assert all(a >= 12 or a == b for a, b in zip(one.shard_of, less.shard_of))
    folder = shared_path(spark, "maps")
    more.save(spark, folder, [3] * 4096)
    assert sharding.SlotMap.load(spark, folder, 2) == more == sharding.SlotMap.newest(spark, folder)


def test_a_folder_is_sharded_again(spark, hard):
    """The second call edits the first one's map; each version places all rows without gaps."""
    rng = random.Random(10)
    ids = [None] * 400 + [7] * 400 + list(range(3000))
    docs = spark.createDataFrame([(i, "x" * rng.randint(0, 900)) for i in ids], "doc_id long, text string")
    folder = shared_path(spark, "again")
    found = []
    for n in (4, 5, 5):
        rows = sharding.sharded(docs, n, 512, folder).collect()
        places = {}
        for r in rows:
            places.setdefault(r.shard, []).append(r.slot)
        assert len(rows) == len(ids) and set(places) == set(range(n)) and all(sorted(x) == list(range(len(x))) for x in places.values())
        assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})
        found.append({r.virtual_slot: r.shard for r in rows})
    assert sharding.SlotMap.newest(spark, folder).version == 3 and found[1] == found[2]
    moved = [k for k in found[0] if found[0][k] != found[1][k]]
    assert 0 < len(moved) < 0.3 * len(found[0]) and all(found[1][k] == 4 for k in moved)
    assert sharding.resharded(docs, 3, 5, 512).select("shard").distinct().count() == 5


CHAT = st.text("ab\\|<>-n\nim_end é", max_size=30)


def test_escapes(spark):
    texts = ["<|im_end|>\n", "\\", "\\-", "|", "<\\|", "\\n", "<", "<|", "||", "\\\\|<|<|", "", "a\nb"] + ["".join(random.Random(i).choice("\\|<-n\n") for _ in range(12)) for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e")).select("t", "e", chat_format.unescaped(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and "<|" not in r.e and not r.e.startswith("|")


def test_chats(spark):
    turns = [(i % 40, i // 40, ["user", "assistant", None, "sys\ntem|"][i % 4 if i % 7 else 1], t) for i, t in enumerate(HARD[:8] * 30)] + [(3, 0, "user", "again"), (3, 0, "user", "again"), (None, 1, "assistant", "x"), (50, None, "assistant", "<|im_end|>\n<|im_start|>user"), (60, 0, "user", "<|a"), (60, 0, "user", "<a"), (60, 0, "user", "|"), (60, 0, "user", "z")]
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    out = chat_format.formatted(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in chat_format.digested(out).collect()}
    by = {}
    for c, n, role, text in turns:
        by.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, xs in by.items():
        said = [x[2:] for x in sorted(xs)]
        r, loss = got[c], "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in said).encode()).hexdigest()
    for r in out.collect():
        assert all(r.formatted[s.base:].startswith(chat_format.START) for s in r.loss_spans)
    assert chat_format.formatted(df.limit(0).withColumn("parts", chat_format.text_parts(F.col("text")))).count() == 0


def test_content_parts(spark):
    kind = f"conv_id long, turn long, role string, parts {chat_format.PARTS}"
    parts = [("text", "see <", None, None), ("text", "|image|>", None, None), ("image", None, "s3://a.png", 300), ("audio", None, "b.wav", None), (None, None, "c.pdf", None), ("text", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", [])], kind)
    r = chat_format.formatted(df).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "s3://a.png", 300), ("audio", "b.wav", 128), ("document", "c.pdf", 512)] and r.expanded_tokens == 940
    (s,) = r.loss_spans
    assert r.formatted[s.start:s.end] == "ok"
