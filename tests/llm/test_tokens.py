import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortwire.llm import bpe_count, packing, token_files, tokens

VOCABULARY = tokens.default_vocabulary()
ODD = ["", "a<|endoftext|>b <|startoftext|>", "ΑΣ. ΑΣ Σ İstanbul. ſ. ŉ! ǅ, it's we'll DON'T 12 3.4 x_y", "é a ́ a\x1cb\x1f c\x85d\xa0e f​g", "日本語 テスト。 한국어 🙂🙂 'll's", "ﬁne. Straße! ÀÉ, Ǆ.", "x" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_and_ids_are_the_librarys(spark, documents, library):
    count, ids = bpe_count.WordCounter(VOCABULARY), tokens.ChunkIds(VOCABULARY)
    for t in [*ODD, *[r.text for r in documents.collect()]]:
        want = ids_of(library, t)
        assert count(t) == len(want) and np.frombuffer(ids(t), "<u4").tolist() == want, t[:80]


def test_every_space_character(library):
    ids = tokens.ChunkIds(VOCABULARY)
    for code in [*range(0, 0x30), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]:
        t = f"ab{chr(code)}cd"
        assert np.frombuffer(ids(t), "<u4").tolist() == ids_of(library, t), hex(code)


def test_count_query_odd_rows(spark, odd, empty, library):
    got = bpe_count.count_tokens(odd, VOCABULARY).collect()
    texts = [r.text for r in odd.collect()]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 2048) for t in texts)
    assert bpe_count.count_tokens(empty, VOCABULARY).count() == 0


def test_bounded_cache_forgets_and_stays_right(library):
    from cohortwire.llm.common import BoundedCache

    made = BoundedCache(len, limit=3)
    assert [made["a" * (i % 7)] for i in range(40)] == [i % 7 for i in range(40)] and len(made) <= 3


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 20, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    docs = [(i, rng.integers(0, 2**bits, n, dtype=np.uint64).astype("<u4")) for i, n in enumerate([0, 1, 5, 100, 33, 257])]
    shard = token_files.Shard(token_files.shard_bytes(docs, bits, block_ids=16))
    whole = np.concatenate([d for _, d in docs])
    assert shard.ids == len(whole) and shard.bits == bits
    for i, (_, d) in enumerate(docs):
        assert shard.document(i).tolist() == d.tolist()
    for a, b in [(0, 1), (15, 17), (30, 200), (395, 396)]:
        assert shard.slice(a, b).tolist() == whole[a:b].tolist()
    assert token_files.id_bits(49_408) == 16 and token_files.id_bits(1) == 1 and token_files.id_bits(65_537) == 17


def test_files_hold_every_document_in_order(spark, documents, library):
    got = sorted(token_files.token_file_round_trip(documents, VOCABULARY).collect())
    at = 0
    for r, d in zip(got, sorted(documents.collect(), key=lambda d: d.doc_id), strict=True):
        ids = np.array([*ids_of(library, d.text), 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_files_odd_rows(spark, odd, empty):
    got = token_files.token_file_round_trip(odd, VOCABULARY).collect()
    assert len(got) == odd.count() and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)][0] is None
    assert token_files.token_file_round_trip(empty, VOCABULARY).count() == 0


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_places_every_piece(spark, documents, library, capacity):
    got = packing.pack(documents, VOCABULARY, capacity).collect()
    pieces = {(r.doc_id, r.piece): r for r in got}
    total = 0
    for d in documents.collect():
        ids = np.array([*ids_of(library, d.text), 1], "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part, r = ids[at : at + capacity], pieces.pop((d.doc_id, k))
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    assert check_packing(got, capacity) <= -(-total // capacity) * 1.02 + 1


def test_plans_come_close_to_the_bound():
    rng = random.Random(4)
    for spread in [(1, 100), (30, 60), (34, 49), (51, 99)]:
        counts = defaultdict(int)
        for _ in range(20_000):
            counts[rng.randint(*spread)] += 1
        plan = packing.plan_packing(dict(counts), 100)
        assert all(plan.taken[n] == k for n, k in counts.items())
        large = sum(k for n, k in counts.items() if n > 50)
        bound = max(-(-sum(n * k for n, k in counts.items()) // 100), large, -(-sum(k for n, k in counts.items() if n > 33) // 2))
        assert plan.sequences <= 1.04 * bound + 5, (spread, plan.sequences, bound)


def test_packing_odd_rows(spark, odd, empty):
    got = packing.pack(odd, VOCABULARY, 4096).collect()
    check_packing(got, 4096)
    assert {(r.length, r.start) for r in got if r.doc_id in (1, 2)} == {(1, 0)} and any(r.doc_id is None for r in got)
    assert packing.pack(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("many", [1, 50, 5_000, 1_000_000])
def test_most_tokens_follow_the_program(many):
    rng = np.random.default_rng(3)
    counts = defaultdict(int)
    for length in np.minimum(rng.lognormal(5.5, 1.0, 6000).astype(int) + 1, 4096).tolist():
        counts[length] += many
    plan = packing.plan_packing(dict(counts), 4096)
    assert plan.tokens_by_program > 0.9 and plan.by_program > 0.9 * sum(counts.values())
    assert plan.taken == counts
    assert packing.least_sequences(counts, 4096) <= plan.bound <= plan.sequences and plan.gap < 0.01


@pytest.mark.parametrize(("least", "most", "sequences"), [(900, 2000, 7_400), (1100, 1900, 7_950), (1366, 2100, 10_000)])
def test_lengths_that_seldom_fill_a_sequence(least, most, sequences):
    lengths, n = np.unique(np.random.default_rng(0).integers(least, most + 1, 20_000), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    plan = packing.plan_packing(counts, 4096)
    assert plan.taken == counts and plan.sequences <= sequences
    assert plan.tokens_by_program > 0.9 and plan.gap < 0.03


def test_the_knapsack_is_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(3, 25), 5, replace=False))
        weights = np.full(41, -np.inf)
        weights[lengths] = rng.random(5)
        most = [0.0] * 41
        for c in range(1, 41):
            most[c] = max([most[c - 1], *(weights[k] + most[c - k] for k in lengths.tolist() if k <= c)])
        assert packing.knapsack(weights, 40, int(lengths[0]))[0].tolist() == pytest.approx(most)


def test_the_dual_bounds_lengths_that_fill_no_sequence():
    counts = {40: 1000, 70: 10}  # two of 40 and nothing beside them, one of 70 alone
    demand = np.zeros(101)
    demand[[40, 70]] = 1000, 10
    assert packing.dual_bound(demand, np.arange(101) / 100.0, 100) == pytest.approx((400 + 7) / 0.8)
    plan = packing.plan_packing(counts, 100)
    assert plan.sequences == 510 and plan.bound >= 508


def test_shared_doc_ids_are_dealt_over_parts_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 200)
    rows = [(5, f"word number {n}") for n in range(60)] + [(n, "other words") for n in range(30)] + [(None, "no id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from cohortwire.llm.common import new_path

    path = new_path(spark, "files")
    manifest = token_files.write_token_files(docs, VOCABULARY, path)
    assert manifest.count() > 5
    got = sorted(token_files.read_token_files(spark, path, manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[:3] == [None] * 3 and ids[3:] == sorted(ids[3:]) and ids.count(5) == 61
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
