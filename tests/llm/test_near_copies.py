"""The pipeline's near-duplicate stage against brute force."""

import random
from collections import Counter

import pytest

from tidemark.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def least_of_components(texts):
    """Of each row the least row that it is linked to, all pairs compared by Jaccard >= 0.8."""
    found, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(found):
        for j in range(i):
            same = len(a & found[j])
            if 5 * same >= 4 * (len(a) + len(found[j]) - same) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def copies(rng):
    """Texts, and copies of them with words changed, inserted or gone, some just on either side of the limit; a shared passage."""
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(30)]
    out = []
    for _ in range(25):
        body = [word() for _ in range(rng.choice([3, 20, 80, 300]))] + (common if rng.random() < 0.4 else [])
        out.append(body)
        for _ in range(rng.choice([1, 3, 8])):
            new = list(body)
            for _ in range(rng.randint(0, max(1, len(new) // 40))):
                k = rng.randrange(len(new))
                new[k:k + 1] = rng.choice([[word()], [new[k], word()], []]) or [word()]
            out.append(new)
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("often, block", [(5, 8192), (2, 8192), (10**6, 3), (5, 2)])
def test_near_copies_against_all_pairs(spark, monkeypatch, often, block):
    """With a sample that misses all hashes crowds are counted; small blocks deal most of them."""
    monkeypatch.setattr(near_copies, "OFTEN", often)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = copies(random.Random(often))
    want = least_of_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.clustered(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts)


def test_crowds_that_the_sample_missed_are_dealt_by_their_count(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    rows = [(k, 8, [7, 100 + k], [0, 0]) for k in range(11)] + [(k, 8, [9], [0]) for k in range(4)]
    nodes = spark.createDataFrame(rows, "_tm_key long, _tm_size int, _tm_prefix array<long>, _tm_blocks array<int>")
    assert {(r._tm_h, r._tm_n) for r in near_copies.crowds(nodes).collect()} == {(7, 3), (9, 0)}


def test_the_stage_takes_a_near_copy_beyond_four_bits(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    body = [f"w{rng.randrange(900)}" for _ in range(400)]
    near = [*body]
    for k in range(20, 400, 60):
        near[k] = "changed"  # 7 words, 35 of 396 shingles
    far = [w if k % 20 else "other" for k, w in enumerate(body)]
    df = spark.createDataFrame([(5, " ".join(body)), (7, " ".join(near)), (9, " ".join(far))], "doc_id long, text string")
    assert [r.doc_id for r in pipeline.near_dedup(spark, df, "").orderBy("doc_id").collect()] == [5, 9]


def test_hard_rows(hard, empty):
    rows = hard.select("doc_id", "text").collect()
    label = least_of_components([r.text for r in rows])
    out = near_copies.deduplicated(hard)
    got = out.collect()
    assert out.columns == hard.columns and len(got) == len(set(label))
    assert {frozenset(shingles(r.text)) for r in got} == {frozenset(shingles(rows[k].text)) for k in set(label)}
    assert near_copies.deduplicated(empty).count() == 0


def test_hashes_are_counted_in_every_distinct_text(spark, monkeypatch):
    """The counts that order hashes and deal crowds are those of a plain loop over all texts, copies once; the most frequent are kept by whole levels."""
    for limit, value in (("SAMPLE", 20), ("HELD", 500), ("OFTEN", 3)):
        monkeypatch.setattr(near_copies, limit, value, raising=False)
    texts = copies(random.Random(9))
    want = Counter(h for t in set(texts) for h in near_copies.shingle_set(t).tolist())
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:40], None, "", ""]], "text string")
    for broadcast in (near_copies.BROADCAST_ROWS, 0):
        monkeypatch.setattr(near_copies, "BROADCAST_ROWS", broadcast)
        h, n = near_copies.often(df, 5)
        assert dict(zip(h.tolist(), n.tolist())) == {k: c for k, c in want.items() if c >= 3} and (h[1:] > h[:-1]).all()
    levels = Counter(c for c in want.values() if c >= 3)
    top = sorted(levels)[-3:]
    monkeypatch.setattr(near_copies, "MOST_OFTEN", sum(levels[c] for c in top))
    h, n = near_copies.often(df, 5)
    assert dict(zip(h.tolist(), n.tolist())) == {k: c for k, c in want.items() if c >= top[0]}
    monkeypatch.setattr(near_copies, "MOST_OFTEN", 0)
    assert len(near_copies.often(df, 5)[0]) == 0
