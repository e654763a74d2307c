"""Tokenizing, Arrow files and packing."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing, token_files
from tidemark.llm.common import shared_path
from tidemark.llm.tokenize import WordIds

from .conftest import HARD


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words(tokenizer):
    return WordIds(tokenizer)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aé'# \t\nst1,.<|>_²", max_size=40)), max_size=6))
def test_encode_is_the_librarys(words, library, texts):
    ids, at = words.encode(texts, 7)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library(t) + [7] for t in texts]


def test_hard_texts(words, library):
    ids, at = words.encode(HARD, 1)
    assert all(ids[at[i]:at[i + 1]].tolist() == library(t) + [1] for i, t in enumerate(HARD))


def test_files_round_trip(hard, tokenizer, library):
    rows = hard.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    got = token_files.round_trip(hard, tokenizer, 2).collect()
    want = sorted(((r.doc_id is not None, r.doc_id, r.h, r.text or "") for r in rows), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    got.sort(key=lambda r: r.start)
    start = 0
    for g, (_, doc_id, _, text) in zip(got, want, strict=True):
        ids = library(text) + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_sequences_are_views_of_the_file(spark, hard, tokenizer, library):
    manifest = token_files.write(hard.filter("doc_id = 7"), tokenizer, 2, shared_path(spark, "t"), seq_len=16).collect()
    reader = token_files.ShardReader(manifest[0].tokens_path)
    before = pa.total_allocated_bytes()
    all_ids = library(HARD[7]) + [2]
    for i in (0, 300, len(all_ids) // 16):
        ids, mask = reader.sequence(i)
        n = int(mask.sum())
        assert len(ids) == 16 and ids[:n].tolist() == all_ids[16 * i:16 * i + 16] and not ids.flags.owndata
    assert pa.total_allocated_bytes() - before < 10_000


def test_no_documents(empty, tokenizer):
    assert token_files.round_trip(empty, tokenizer, 2).count() == 0
    assert packing.packed(empty, tokenizer).count() == 0


@pytest.mark.parametrize("capacity", [8, 4096])
def test_packing(hard, tokenizer, library, capacity):
    docs = hard if capacity > 8 else hard.filter("length(coalesce(text, '')) < 1000")
    got = packing.packed(docs.repartition(5), tokenizer, capacity, 1).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library(r.text) + [1]
        for k in range(0, len(ids), capacity):
            want[r.doc_id, k // capacity, k, len(ids[k:k + capacity]), crc(ids[k:k + capacity])] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for xs in by.values():
        xs.sort()
        assert [o for o, _ in xs] == np.concatenate([[0], np.cumsum([n for _, n in xs])[:-1]]).tolist() and sum(n for _, n in xs) <= capacity
    loads = sorted(sum(n for _, n in xs) for xs in by.values())
    assert len(loads) < 2 or loads[0] + loads[1] > capacity  # no two sequences would fit in one


def test_bins_handed_up(spark, tokenizer):
    """A bound on what a node hands up costs next to nothing: 8 bins of a node, or all."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "a " * int(n)) for i, n in enumerate(rng.integers(1, 90, 1200))], "doc_id long, text string").repartition(40)
    counts = []
    for forward in (None, 8):
        got = packing.packed(docs, tokenizer, 128, 1, forward=forward).collect()
        assert len({r.doc_id for r in got}) == 1200
        counts.append(len({r.sequence_id for r in got}))
    least = -(-sum(r.length for r in got) // 128)
    assert least <= counts[0] <= counts[1] <= 1.01 * counts[0] + 1 and counts[0] < 1.06 * least


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    bins, offsets, loads = packing.best_fit(np.array(lengths, np.int64), 50)
    assert sum(loads) == sum(lengths) and all(n <= 50 for n in loads)
    for b in range(len(loads)):
        own = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert sum(n for _, n in own) == loads[b] and [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist()
    assert sum(2 * n <= 50 for n in loads) <= 1  # at most one bin is half empty


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 50), max_size=120))
def test_counts_are_packed_as_items_are(lengths):
    """Each item is in one run, its sequence has no gap, and there are as many sequences as best fit decreasing opens."""
    runs = packing.fit_counts(np.bincount(np.array(lengths, np.int64), minlength=51), 50)
    items = Counter()
    by = {}
    for n, rank, many, sequence, offset in runs.tolist():
        for i in range(many):
            items[n, rank + i] += 1
            by.setdefault(sequence + i, []).append((offset, n))
    assert items == Counter((n, i) for n, many in Counter(lengths).items() for i in range(many))
    for own in by.values():
        own.sort()
        assert sum(n for _, n in own) <= 50 and [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist()
    assert sorted(sum(n for _, n in own) for own in by.values()) == sorted(packing.best_fit(np.array(lengths, np.int64), 50)[2])


def test_every_bin_takes_part(spark, tokenizer, monkeypatch):
    """1,600 bins of some 60 of 64 tokens in 16 partitions, more than a node of a tree would hand up, and 600 small ones in another that fit into their room."""
    monkeypatch.setattr(packing, "CHUNK", 1)
    monkeypatch.setattr(packing, "BATCH", 1)
    docs = spark.createDataFrame([(i, "a " * (60 if i < 1600 else 2)) for i in range(2200)], "doc_id long, text string")
    got = packing.packed(docs.filter("doc_id < 1600").repartition(16).union(docs.filter("doc_id >= 1600").coalesce(1)), tokenizer, 64, 1).collect()
    lengths = {r.length for r in got}
    assert len(got) == 2200 and max(lengths) + min(lengths) <= 64
    assert len({r.sequence_id for r in got}) == 1600
