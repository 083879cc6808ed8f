import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortwire.llm import exact_dedup, links, queries, simhash


def test_exact_dedup_is_the_sql(spark, documents):
    from .conftest import SF

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op5_exact_dedup"]).fetchall()
    got = queries.op5_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_index_persists_over_batches(spark):
    index = exact_dedup.temporary_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (8, ""), (7, "new"), (6, "new")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.add(first).collect()} == {1: (2, False), 2: (2, True), 3: (3, True)}
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.add(second).collect()}
    assert got == {9: (2, False), 8: (3, False), 7: (7, True), 6: (7, False)}
    assert index.table().count() == 3


def test_exact_dedup_odd_rows(spark, odd, empty):
    got = exact_dedup.temporary_index(spark).add(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[2].kept and not by[1].kept and by[1].keep_id == 2 and by[5].kept and by[None].keep_id == 5
    assert exact_dedup.temporary_index(spark).add(empty).count() == 0
    kept = exact_dedup.distinct_documents(odd, exact_dedup.temporary_index(spark))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]


def slow_keepers(rows):
    """doc ids that stay: for each text the largest, one row of it."""
    best = {}
    for d, t in rows:
        best[t or ""] = max(best.get(t or "", -1), d)
    return best


def test_repeated_rows_and_shared_ids(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(12), rng.choice(["a", "b", "", None, "c", "d e"])) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_digest", F.lit("clash")).withColumn("n", F.lit(3))
    want = slow_keepers(rows)
    got = exact_dedup.temporary_index(spark).add(docs).collect()
    assert sorted((r.doc_id, r.text_sha256) for r in got) == sorted((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(kept) == sorted((d, hashlib.sha256(t.encode()).hexdigest()) for t, d in want.items())
    assert all(r.group_size == sum((t or "") == (u or "") for _, u in rows for t in [next(t for d, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256)]) for r in got)
    stay = exact_dedup.distinct_documents(docs, exact_dedup.temporary_index(spark))
    assert stay.columns == docs.columns and sorted((r.text or "", r.doc_id) for r in stay.collect()) == sorted(want.items())


def test_a_batch_that_is_run_again_gives_the_same(spark):
    index = exact_dedup.temporary_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "b"), (4, "c"), (4, "c")], "doc_id long, text string")
    index.add(first, "one")
    answers = [sorted(map(tuple, index.add(second, "two").collect())) for _ in range(3)]
    assert answers[0] == answers[1] == answers[2] and sum(r[3] for r in answers[0]) == 1
    assert index.table().count() == 3
    assert sorted(r.doc_id for r in exact_dedup.distinct_documents(second, index, "two").collect()) == [4]
    index.drop()


def slow_fingerprint(text, size=3):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=2):
    name = {d: d for d in prints}

    def root(d):
        while name[d] != d:
            d = name[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {d: root(d) for d in ids}


def test_simhash_is_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rng = random.Random(5)
    for k in range(40):  # edits of one text, so that fingerprints lie close
        words = rows[3][1].split()
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((1000 + k, " ".join(words)))
    prints = {d: slow_fingerprint(t) for d, t in rows}
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == slow_components(prints)
    assert len({r.component_id for r in got}) < len(rows) - 5


def test_spark_has_the_same_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("the cat sat"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"the cat sat", 42)


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_links_in_a_hot_key(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 3, dtype=np.int64)
    prints = sorted({int(c) ^ (1 << int(rng.integers(0, 12))) ^ (1 << int(rng.integers(0, 12))) for c in centres for _ in range(40)})
    nodes = spark.createDataFrame([(p, bytes(x)) for p, x in zip(prints, simhash.pivot_payload(np.array(prints, np.int64).view(np.uint64)))], "fp long, payload binary")
    found = simhash.links_of_fingerprints(nodes, 2, block=block)
    names = {r.node: r.component for r in links.components(found, nodes.select(F.col("fp").alias("node"))).collect()}
    assert names == slow_components({p: p for p in prints})


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = links.components(spark.createDataFrame(chain, "a long, b long"), None).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.component].add(r.node)
    assert dict(groups) == {0: set(range(61)), 100: {100, 101}}
    assert links.components(spark.createDataFrame([], "a long, b long"), None).count() == 0


def test_simhash_odd_rows(spark, odd, empty):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == odd.count() and {r.fingerprint for r in got if r.doc_id in (1, 2)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (None, 5)} == {5}
    assert simhash.simhash_groups(empty).count() == 0


def test_similar_groups_find_edited_copies(spark, documents):
    base = [(r.doc_id, r.text) for r in documents.where("length(text) > 1500").limit(20).collect()]
    rng = random.Random(2)
    copies = []
    for n, (d, t) in enumerate(base):
        words = t.split()
        for _ in range(max(1, len(words) // 80)):
            words[rng.randrange(len(words))] = "changed"
        copies.append((5000 + n, " ".join(words)))
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(base + copies, "doc_id long, text string")).collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for (d, t), (c, u) in zip(base, copies, strict=True):
        a, b = shingles(t), shingles(u)
        if len(a & b) / len(a | b) >= 0.82:
            assert got[c] == got[d], (d, len(a & b) / len(a | b))
    assert len(set(got.values())) >= 15


def test_one_of_each_group_odd_rows(spark, odd, empty):
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect())) == [1, 3, 4, 4, 5]
    assert simhash.one_of_each_group(empty).count() == 0


def _jaccard(t, u, size=5):
    a, b = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (t.split(), u.split()))
    return len(a & b) / len(a | b)


def test_similar_groups_are_brute_force_at_the_threshold(spark):
    rows, want = [], {}
    for n in range(80):  # long texts, of which a part of growing size is replaced at the end
        words = [f"w{n}x{i}" for i in range(404)]
        same = 332 + n
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:same] + [f"z{n}x{i}" for i in range(404 - same)]))]
        want[2 * n + 1] = 2 * n if _jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else 2 * n + 1
    values = [_jaccard(rows[2 * n][1], rows[2 * n + 1][1]) for n in range(80)]
    assert min(values) < 0.75 and any(0.77 < v < 0.8 for v in values) and any(0.8 <= v < 0.82 for v in values)
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d] for d in want} == want


def test_repeated_passages_do_not_hide_near_copies(spark):
    rows = []
    for n in range(12):
        words = [f"w{n}x{i}" for i in range(304)]
        for side, at in enumerate((20, 200)):  # one passage many times over, another one in the copy
            rows.append((2 * n + side, " ".join(words[:at] + words[at : at + 16] * 20 + words[at + 16 :])))
    assert all(_jaccard(rows[2 * n][1], rows[2 * n + 1][1]) >= 0.8 for n in range(12))
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_near_groups_are_those_of_all_pairs(spark):
    """Recall and precision against every pair of texts that share a shingle: both are 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rng = random.Random(8)
    for n, (_, text) in enumerate([r for r in rows if 60 < len(r[1].split()) < 400][:60]):  # copies with more and more edits
        words = text.split()
        for _ in range(n // 4):
            words[rng.randrange(len(words))] = f"edit{n}"
        rows.append((50_000 + n, " ".join(words)))
    sets, where = {}, defaultdict(list)
    for d, t in rows:
        words = t.lower().split()
        sets[d] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for shingle in sets[d]:
            where[shingle].append(d)
    name = {d: d for d in sets}

    def root(d):
        while name[d] != d:
            d = name[d]
        return d

    common = defaultdict(int)
    for members in where.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        name[y] = x
    empty = [d for d in sets if not sets[d]]
    for d in empty:
        name[d] = min(empty)
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) > 40 and got == {d: root(d) for d in sets}


def test_columns_named_like_the_stages_own_stay(spark):
    from cohortwire.llm import simhash

    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a", 7), (2, text + " more", "b", 8), (3, "other words here", "c", 9)], "doc_id long, text string, lang string, n_chars long")
    names = ["_kept_id", "kept_id", "keep_id", "id", "whole", "node", "a.b"]
    got = simhash.one_of_each_group(df.withColumns({name: F.lit("mine") for name in names}), shingle=5, least_similarity=0.8)
    assert {(r["doc_id"], *(r[n] for n in names)) for r in got.collect()} == {(i, *["mine"] * 7) for i in (1, 3)} and got.columns == [*df.columns, *names]


def test_edited_copies_of_one_text_cost_in_proportion(spark, monkeypatch):
    """Copies that are less than 0.8 alike, with some that are more: the pairs that are compared don't grow with their square."""
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(160)], []
    for n in range(300):
        words = list(base)
        for k in rng.sample(range(160), 8 if n % 10 else 2):
            words[k] = f"edit{n}x{k}"
        rows.append((n, " ".join(words)))
    compared, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    name = {d: d for d, _ in rows}
    for i, (d, t) in enumerate(rows):  # components of all pairs
        for e, u in rows[:i]:
            if name[d] != name[e] and _jaccard(t, u) >= 0.8 - 1e-9:
                least, most = sorted((name[d], name[e]))
                name = {x: least if y == most else y for x, y in name.items()}
    assert got == name and 100 < len(set(got.values())) < 295
    assert sum(compared) < 6 * len(rows)


def test_similar_sets_share_a_rare_key():
    rng, met = np.random.default_rng(3), 0
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a, b = rng.integers(0, 2**63, (2, n + 40), dtype=np.uint64)
        a, b = a[:n], np.concatenate([a[: n - int(rng.integers(0, n // 6 + 1))], b[: int(rng.integers(0, n // 6 + 1))]])
        if simhash.similarity(a, b) < 0.8:
            continue
        x, y = sorted((a, b), key=len)
        shared = [np.sort(z[np.isin(z, np.intersect1d(a, b)) | (z % 3 == 0)]) for z in (x, y)]  # a third of the others are in other sets
        least, keys = simhash.least_overlap(len(x), len(y), 0.8), []
        for z, h, one in ((x, shared[0], True), (y, shared[1], False)):
            key, place, smaller = simhash.prefix_keys(h, len(z), 0.8)
            keys.append(set(key[(smaller == one) & (place <= len(z) - least)].tolist()))
        assert keys[0] & keys[1]
        met += 1
    assert met > 200


def test_fingerprints_and_pivots_pair_near_copies(spark):
    words = [f"w{i}" for i in range(800)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"z{i}" for i in range(500)), ""]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    rows = [(n, len(h), int(np.uint64(simhash.fingerprint(h)).astype(np.int64))) for n, h in enumerate(sets)]
    assert bin((rows[0][2] ^ rows[1][2]) & (2**64 - 1)).count("1") <= 2
    pairs = simhash.fingerprint_pairs(spark.createDataFrame(rows, "node long, n long, fp long"), 0.8).collect()
    assert {(r.a, r.b) for r in pairs} == {(0, 1)}
