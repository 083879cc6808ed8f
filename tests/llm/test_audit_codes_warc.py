"""The filter audit, vector codes and WARC files against brute force."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwire.llm import filter_audit, vector_codes, warc
from cohortwire.llm.common import new_path

WORDS = " ".join(f"word{i}" for i in range(120))


# Filter audit


def brute_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    masks = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]
        failed.append(doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs))
        masks.append((lang or "", {c for c, f in zip("ABCDE", failed) if f}, doc_id in good, doc_id in toxic))
    removed_by, rows = Counter(), {}
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                here = [m for m in left if x in m[0]]
                left = [m for m in left if x not in m[0]]
                redundant = sum(x in m[0] for m in own) - len(here)
                rows[part, order, step] = (len(left), len(here), redundant, sum(m[0] == {x} for m in own), sum(m[1] for m in here), sum(m[2] for m in here))
                removed_by[part, x] += len(here)
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


DOCS = [
    (50, WORDS, "en"), (40, WORDS, "de"), (30, WORDS, "en"), (30, WORDS, "en"), (30, WORDS, None), (20, "SHOUT # again again", "en"), (10, "SHOUT # again again", "fr"),
    (5, None, "en"), (6, "", None), (None, WORDS, "en"), (None, WORDS, "en"), (None, None, "de"), (7, "same " * 5000, "de"), (8, "same " * 5000, "de"), (9, WORDS + " more & more", "es"),
]
LABELS = [(50, 1, 0), (30, 1, 1), (30, 0, None), (20, 0, 1), (None, 1, 1), (5, None, None), (8, 1, 0)]


def as_files(spark, rows, path, each):
    """Parquet files of `each` rows in the order given, one after the other in time."""
    for i in range(0, len(rows), each):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows[i : i + each]], "doc_id long, text string, lang string, part string, mask int")
        df.coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("each,bytes_per_batch", [(1, 1), (4, 1), (100, None)])
def test_audit_is_the_same_however_files_arrive(spark, each, bytes_per_batch):
    path = new_path(spark, "audit-docs")
    as_files(spark, DOCS, path, each)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(spark, path, labels, bytes_per_batch)
    assert {tuple(r) for r in got.collect()} == brute_audit(DOCS, LABELS)
    assert got.count() == 5 * 600


def test_audit_takes_in_new_files_and_retracts(spark):
    path, folder = new_path(spark, "audit-docs"), new_path(spark, "audit-state")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    as_files(spark, DOCS[:2], path, 100)
    first = {tuple(r) for r in filter_audit.mask_counts(spark, path, labels, folder).collect()}
    assert first == {("en", filter_audit.COPY, True, False, 1), ("de", 0, False, False, 1)}
    as_files(spark, DOCS[2:], path, 3)
    counts = filter_audit.mask_counts(spark, path, labels, folder, 1)
    changes = spark.read.schema(filter_audit.COUNTS).parquet(f"{folder}/counters")
    assert changes.filter("change < 0").count() > 0
    assert counts.filter("n < 0").isEmpty()
    assert {tuple(r) for r in filter_audit.audit_orders(counts).collect()} == brute_audit(DOCS, LABELS)


def test_audit_of_the_given_table(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = filter_audit.audit_filters(spark, "/root/testdata/sf0.001/documents.parquet", labels)
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_audit_of_nothing(spark, empty):
    path = new_path(spark, "audit-docs")
    empty.write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(spark, path, labels).isEmpty()


def test_state_of_a_hot_text_stays_small(spark):
    path, folder = new_path(spark, "audit-docs"), new_path(spark, "audit-state")
    rows = [(i, "hot", "en") for i in range(400, 0, -1)]
    as_files(spark, rows, path, 100)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    counts = filter_audit.mask_counts(spark, path, labels, folder, 1)
    assert {(r.mask, r.good, r.toxic, r.n) for r in counts.collect()} == {(1, False, False, 1), (17, False, False, 395), (17, True, False, 2), (17, False, True, 1), (17, True, True, 1)}
    state = spark.read.schema(filter_audit.STATE + ", batch int").parquet(f"{folder}/state")
    assert state.count() == 4 and state.agg(F.min("least")).first()[0] == 1
    assert state.filter(F.size("holders") > 1).isEmpty()


# Vector codes


def brute_codes(rows, entries=256, rounds=4, parts=4):
    """rows: (vec_id, components), kept ones; plain integers.  [(code, error)] in the order given, and the codebooks."""
    points = [[int(np.floor(np.float64(x) * 1024)) for x in v] for _, v in rows]
    d = len(points[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, points[i]))[:entries]
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        own = [tuple(x[p * d : (p + 1) * d]) for x in points]
        book = [own[i] for i in order]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            groups = {}
            for x in own:
                groups.setdefault(near(x, book)[1], []).append(x)
            book = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e])) if e in groups else b for e, b in enumerate(book)]
        for i, x in enumerate(own):
            error, e = near(x, book)
            codes[i] += f"{e:02x}"
            errors[i] += error
        books.append(book)
    return list(zip(codes, errors)), books


def check_codes(spark, rows, kept, labels, entries=256):
    """kept: indexes of the rows that are coded."""
    df = spark.createDataFrame([(i, v, lab, 1, 2.0) for (i, v), lab in zip(rows, labels)], "vec_id long, embedding array<double>, label int, row int, error double").repartition(3)
    got, books = vector_codes.compress(df, entries=entries)
    want, want_books = brute_codes([rows[i] for i in kept], entries)
    flat = ",".join(str(x) for book in want_books for c in book for x in c)
    by_label = Counter()
    for i, (_, error) in zip(kept, want):
        by_label[labels[i]] += error
    fits = lambda x: x if x < 1 << 63 else None
    rows_want = sorted(((rows[i][0], c, fits(e), fits(by_label[labels[i]]), hashlib.sha256(flat.encode()).hexdigest()) for i, (c, e) in zip(kept, want)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == rows_want
    return books


def test_codes_equal_plain_integers(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in rng.permutation(400)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(150)]  # very many copies
    labels = [None if i % 7 == 0 else i % 3 for i in range(len(rows))]
    check_codes(spark, rows, range(len(rows)), labels, entries=16)


def test_codes_of_odd_vectors(spark):
    good = [(3, [0.5, -0.25, 1e-9, -1e-9]), (1, [2.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]), (2, [2.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0])]
    bad = [(0, None), (0, []), (0, [1.0, None, 1.0, 1.0]), (0, [float("nan"), 0.0, 0.0, 0.0]), (0, [float("inf"), 0.0, 0.0, 0.0]), (0, [1.0, 2.0]), (9, [1.0] * 8), (5, [1e300, 0.0, 0.0, 0.0])]
    rows = good + bad
    check_codes(spark, rows, range(len(good)), [None, 1, 1, None, 2, 2] + [1] * len(bad))


@pytest.mark.parametrize("scale", [1e5, 1e7, 5e12])
def test_codes_stay_exact_for_large_components(spark, scale):
    rng = np.random.default_rng(int(scale) % 97)
    rows = [(i, (scale * rng.uniform(-1, 1, 8)).tolist()) for i in range(150)]
    check_codes(spark, rows, range(150), [0] * 150, entries=5)


def test_no_vectors_no_codes(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    out, books = vector_codes.compress(empty)
    assert out.isEmpty() and books is None and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = vector_codes.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(1)
    left = 0
    for _ in range(200):
        points, entries = rng.integers(-40, 40, (20, 3)) // rng.integers(1, 5), rng.integers(-60, 60, (30, 3))
        chosen = vector_codes.shortlist(points.min(0), points.max(0), entries)
        at, error = vector_codes.nearest(points, entries)
        own, own_error = vector_codes.nearest(points, entries[chosen])
        assert (chosen[own] == at).all() and (own_error == error).all()
        left += len(chosen)
    assert left < 200 * 25


# WARC


def check_archive(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, sha string, copies int").repartition(3)
    path = new_path(spark, "warc-test")
    index = warc.write_archives(df, path, date="2024-01-01T00:00:00Z", **how)
    records = warc.read_records(spark, path, index, with_payload=True)
    got = warc.with_targets(records).collect()
    shared = {}
    for page_id, url, html in rows:
        if len((html or "").encode()) >= 1000:
            shared.setdefault(html, []).append(page_id)
    want = Counter()
    for html, ids in shared.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            want[i, len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), "revisit" if n else "response", keep if n else None] += 1
    for page_id, url, html in rows:
        if len((html or "").encode()) < 1000:
            want[page_id, len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest(), "response", None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    texts = Counter(h.encode() for _, _, h in rows if len((h or "").encode()) < 1000 and h is not None) + Counter({b"": sum(h is None for *_, h in rows)}) + Counter(h.encode() for h in shared)
    assert Counter(bytes(r.payload) for r in got if r.record_type == "response") == texts
    assert len({r.record_id for r in got}) == len(rows)
    return path, index


PAGES = [
    (1, "http://a.example/1", "é" * 500), (2, "http://a.example/2", "é" * 500), (9, "http://a.example/3", "é" * 500), (9, "http://a.example/3", "é" * 500), (4, None, "é" * 499 + "x"), (5, "http://b.example/", "é" * 499 + "x"),
    (6, "http://c.example/", "x" * 999), (7, "http://c.example/", "x" * 999), (8, "http://d.example/a b\r\nX-Evil: 1/é", None), (None, "http://d.example/", ""), (None, None, "z" * 5000), (None, "http://e.example/", "z" * 5000), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 900),
]


def test_archives_round_trip(spark):
    check_archive(spark, PAGES)
    path, index = check_archive(spark, PAGES * 3, file_bytes=700, level=1)
    assert index.select("file").distinct().count() > 6


def test_hot_page_and_repeated_rows(spark):
    hot = [(i, f"http://h.example/{i}", "h" * 3000) for i in range(300)] + [(299, "http://h.example/299", "h" * 3000)] * 40
    check_archive(spark, hot + PAGES)


def test_chosen_records_alone_are_read(spark):
    path, index = check_archive(spark, [(i, f"http://x.example/{i}", f"{i} " * 400) for i in range(60)])
    some = index.filter(F.col("url").endswith("7"))
    assert {r.url for r in warc.read_records(spark, path, some).collect()} == {f"http://x.example/{i}" for i in range(7, 60, 10)}
    assert warc.read_records(spark, path, index.limit(0)).isEmpty()


def test_a_url_cannot_add_headers(spark):
    path, index = check_archive(spark, PAGES[8:9])
    assert warc.read_records(spark, path, index).first()["url"] == "http://d.example/a%20b%0D%0AX-Evil:%201/%C3%A9"


def test_neighbouring_ranges_are_one_read():
    places = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 200, 10), ("b", 200, 50), ("b", 250, 60)]
    got = list(warc.ranges(iter(places), most=100, gap=5))
    assert [r[:3] for r in got] == [("a", 0, 30), ("a", 200, 210), ("b", 200, 250), ("b", 250, 310)]
    assert [m for *_, members in got for m in members] == [(o, n) for _, o, n in places]


def test_damage_is_found():
    good, _ = warc.page_record(1, "u", b"content", None, warc.record_id(1, b"d"), "2024-01-01T00:00:00Z")
    headers, http, payload = warc.parse_record(good)
    assert (headers["warc-type"], http["content-length"], payload) == ("response", "7", b"content")
    with pytest.raises(ValueError):
        warc.parse_record(good + good)
    with pytest.raises(ValueError):
        warc.parse_record(good[:-9])
    headers = [("WARC-Payload-Digest", "sha1:" + "A" * 32), ("Content-Type", warc.HTTP_TYPE)]
    with pytest.raises(ValueError, match="damaged"):
        warc._described(warc.record("response", "<urn:uuid:1>", "2024-01-01T00:00:00Z", headers, b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\ncontent"), False)


def test_no_pages_no_files(spark):
    out = warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.isEmpty() and out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
