"""SimHash near-dedup with pivot distance tables.

Fingerprints are 64-bit majorities of shingle hashes.  Each different fingerprint is stored with its Hamming
distances to fixed reference fingerprints (the pivots).  Two fingerprints within k bits differ by k at most in every
coordinate of that table, so pairs of larger coordinate difference are discarded without looking at the fingerprints,
and the survivors are verified.  Pairs are formed within keys only: fingerprints within 2 bits agree on two of four
16-bit quarters, so six keys of 32 bits miss none; keys that many share are refined the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shuffle_files_dropped, texts, written
from .links import BLOCK, components, links_within_keys

PIVOTS = 16
QUARTERS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 0) for i in range(n)], np.uint64)


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `size` words (the whole sequence if there are fewer, none without a word)."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes, repeats included; 0 without a hash."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ _BIT_TABLE
        out |= int(np.packbits(2 * ones > len(hashes), bitorder="little")[0]) << (8 * k)
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def pivot_payload(fingerprints: np.ndarray) -> list[bytes]:
    """8 bytes of fingerprint and one for each distance to a pivot."""
    distances = hamming(fingerprints[:, None], pivot_fingerprints()[None, :]).astype(np.uint8)
    rows = np.concatenate([fingerprints.astype("<u8").view(np.uint8).reshape(-1, 8), distances], axis=1)
    return [r.tobytes() for r in rows]


def surviving_pairs(table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows (fingerprint bytes, distances) within `bits`: by the pivots first, then verified."""
    prints = np.ascontiguousarray(table[:, :8]).view("<u8").reshape(-1)
    coordinates = table[:, 8 : 8 + PIVOTS].astype(np.int16)
    near = np.triu(np.ones((len(table), len(table)), bool), 1)
    for k in range(coordinates.shape[1]):
        near &= np.abs(coordinates[:, k][:, None] - coordinates[:, k][None, :]) <= bits
    i, j = np.nonzero(near)
    good = hamming(prints[i], prints[j]) <= bits
    return i[good], j[good]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """(fp, payload): the fingerprints (nodes: fp, each once) with their distances to the pivots."""

    @F.pandas_udf("binary")
    def payload(fp: pd.Series) -> pd.Series:
        return pd.Series(pivot_payload(fp.to_numpy().view(np.uint64)))

    return nodes.select("fp", payload("fp").alias("payload"))


def _within_bits(bits: int):
    def like(payloads):
        table = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1)
        i, j = surviving_pairs(table, bits)
        return zip(i.tolist(), j.tolist(), strict=True)

    return like


def _finer_keys(width: int):
    """members(key, id, payload, rest) with keys of half of the `width` bits in rest: rest is cut into four pieces, of
    which two fingerprints within 2 bits share at least two; the other two pieces are the new rest."""
    size = width // 4
    piece = lambda k: F.shiftrightunsigned("rest", size * k).bitwiseAND(F.lit((1 << size) - 1))

    def split(members: DataFrame) -> DataFrame:
        made = []
        for n, (i, j) in enumerate(QUARTERS):
            p, q = (k for k in range(4) if k not in (i, j))
            rest = F.shiftleft(piece(q), size).bitwiseOR(piece(p))
            made.append(F.struct(F.xxhash64("key", F.lit(n), piece(i), piece(j)).alias("key"), rest.alias("rest")))
        return members.select("id", "payload", F.explode(F.array(*made)).alias("m")).select("m.key", "id", "payload", "m.rest")

    return split


def links_of_fingerprints(nodes: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints (nodes: fp, payload; each once) within `bits`.

    Keys are two of four quarters of the fingerprint; a key that many share is refined by the bits left, to 48 and then
    56 equal bits, where at most 256 different fingerprints are left.
    """
    start = nodes.select(F.lit(0).alias("key"), F.col("fp").alias("id"), "payload", F.col("fp").alias("rest"))
    return links_within_keys(_finer_keys(64)(start), _within_bits(bits), [_finer_keys(32), _finer_keys(16)], block)


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, a row per row of docs.

    Fingerprints at `bits` (0 to 2) differing bits or fewer are linked; component_id is the smallest doc_id reachable,
    itself included.  A text without a word (null: empty) has fingerprint zero and is linked like any other; rows
    that repeat a doc_id are separate nodes with the same id; a null doc_id counts as larger than any other and names
    a component only where there is no other; an empty table gives no rows; other columns are ignored.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the quarters' keys find pairs of at most 2 differing bits")

    @F.pandas_udf("long")
    def prints(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(shingle_hashes(t, shingle)) for t in text], np.uint64).view(np.int64))

    rows = written(texts(docs).select("doc_id", prints("text").alias("fp")), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    named = components(links_of_fingerprints(pivot_table(nodes), bits), None)
    of_node = _named_by_least(nodes, named, "fp")
    out = rows.join(of_node.hint("merge"), "fp")
    out = out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    out = written(out, "simhash-groups")
    for x in (rows, nodes, of_node):
        dropped(x)
    return out


def _named_by_least(nodes: DataFrame, named: DataFrame, node: str) -> DataFrame:
    """(node, component_id): the smallest `least` of the nodes in the same component."""
    roots = nodes.join(named.hint("merge"), nodes[node] == named["node"], "left")
    roots = written(roots.select(node, "least", F.coalesce("component", node).alias("root")), "roots")
    least = written(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root-names")
    out = written(roots.join(least.hint("merge"), "root").select(node, "component_id"), "named")
    for x in (roots, least):
        dropped(x)
    return out


# ------------------------------------------------------------------ near duplicates by similarity of shingles

#: Against rounding of products with the least similarity.
TINY = 1e-9


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of different hashes, 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Sizes of sets go to buckets this much apart.
BUCKET = 1.25
#: Parts that a bucket's sets are cut into, for each element that two similar sets of it may differ in.
PARTS = 1.25


def size_bucket(n: int) -> tuple[int, int]:
    """(number, largest size) of the bucket of sets of n > 0 elements."""
    number, most = 0, 1
    while most < n:
        number, most = number + 1, max(most + 1, int(most * BUCKET))
    return number, most


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def part_keys(hashes: np.ndarray, least_similarity: float) -> np.ndarray:
    """Keys of a set of different hashes; two sets of the similarity share one.

    Sets of nx <= ny elements meet in the bucket of ny, in which each is cut into `parts` by hash; a key is a part
    with all its elements.  Similar sets differ in d = (1 - s) / (1 + s) * (nx + ny) elements at most, so all but d of
    their parts are equal.  A set may therefore do without its smallest parts, as long as these are fewer than
    parts - d: of the equal parts, one is larger than what either set left out.  What texts of a shared passage have in
    common makes up a whole large part only by chance, so they seldom share a key.
    """
    n = len(hashes)
    if not n:
        return hashes
    share = (1 - least_similarity) / (1 + least_similarity)
    largest = int(n / least_similarity + TINY)  # the largest set that can be similar
    bucket, most = size_bucket(n)
    keys, mixed = [], _mixed(hashes)
    while True:
        parts = int(PARTS * int(2 * most * share + TINY)) + 1
        differ = int((n + min(most, largest)) * share + TINY)
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        size = np.bincount(part, minlength=parts)
        held = np.flatnonzero(size)
        total = np.zeros(parts, np.uint64)
        total[held] = np.add.reduceat(mixed[order], (np.cumsum(size) - size)[held])
        # The largest size of which all parts up to it can be left out.
        upto = np.cumsum(np.bincount(size))
        left_out = int(np.searchsorted(upto, parts - differ - 1, side="right")) - 1
        chosen = np.flatnonzero(size > left_out)
        keys.append(_mixed(total[chosen] ^ _mixed(chosen.astype(np.uint64) * np.uint64(4096) + np.uint64(bucket))))
        if most >= largest:
            return np.concatenate(keys)
        bucket, most = bucket + 1, max(most + 1, int(most * BUCKET))


#: Least sizes of the classes of sets that the prefixes of larger ones meet.
CLASSES = [1]
while CLASSES[-1] < 1 << 40:
    CLASSES.append(max(CLASSES[-1] + 1, int(CLASSES[-1] * 1.05)))


def least_overlap(x, y, least_similarity: float):
    """Elements that sets of x and y elements have in common at least if they have the similarity."""
    least = least_similarity - TINY
    return np.ceil(least / (1 + least) * (x + y) - TINY).astype(np.int64)


def prefix_keys(shared: np.ndarray, n: int, least_similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, smaller) of a set of n > 0 hashes, of which `shared` are those that other sets hold too, rarest
    first in an order that is the same for all sets; those that no other holds come before them.

    Sets of nx <= ny elements with k in common have the first of these at a place of nx - k and ny - k at most (from 0).
    So the smaller needs its first places only, in its own class of sizes, and the larger those up to the smallest size
    of each class that it may meet.  The places leave a test to pairs that share a key: both must leave room for the
    least overlap.
    """
    places = np.arange(n - len(shared), n)
    least = max(1, int(np.ceil(n * (least_similarity - TINY) - TINY)))
    own, first = (int(np.searchsorted(CLASSES, m, side="right")) - 1 for m in (n, least))
    found = []
    for c, size, smaller in [(own, n, True), *((c, max(least, CLASSES[c]), False) for c in range(first, own + 1))]:
        few = int(np.searchsorted(places, n - least_overlap(size, n, least_similarity), side="right"))
        keys = _mixed(shared[:few] ^ _mixed(np.array([c + 1], np.uint64)))
        found.append((keys, places[:few], np.full(few, smaller)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _verified(pairs: DataFrame, sets_of, least_similarity: float) -> DataFrame:
    """Those of the different pairs (a, b) whose full sets of hashes have the similarity.  sets_of(nodes) gives (node,
    hashes) of the nodes that are in a pair; sets are made for these alone."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (np.frombuffer(h.as_buffer(), np.uint64) for h in (x, y))
                good.append(similarity(x, y) >= least_similarity - TINY)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = written(pairs, "candidate-pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidate-nodes")
    of_node = written(sets_of(wanted), "candidate-sets")
    both = pairs.join(of_node.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(of_node.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    found = written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "similar-pairs")
    for x in (pairs, wanted, of_node):
        dropped(x)
    return found


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _alike(x, y, least_similarity: float):
    return F.least(x, y) >= F.lit(least_similarity) * F.greatest(x, y) - F.lit(TINY)


def fingerprint_pairs(nodes: DataFrame, least_similarity: float, bits: int = 2) -> DataFrame:
    """Pairs (a, b) of nodes (node, n, fp) whose fingerprints the pivot tables link, not more than a few a node: of one
    fingerprint each node and the smallest, and the smallest ones of linked fingerprints."""
    prints = written(nodes.filter("n > 0").groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "prints")
    same = nodes.join(prints, "fp").select("node", "n", "first").filter("node <> first.node")
    links = links_of_fingerprints(pivot_table(prints), bits)
    ends = [prints.select(F.col("fp").alias(end), F.struct(F.col("first.node").alias("node"), F.col("first.n").alias("n")).alias(f"first_{end}")) for end in "ab"]
    linked = links.join(ends[0], "a").join(ends[1], "b").select(F.col("first_a.node").alias("node"), F.col("first_a.n").alias("n"), F.col("first_b").alias("first"))
    pairs = same.unionByName(linked).filter(_alike(F.col("n"), F.col("first.n"), least_similarity))
    pairs = written(pairs.select(*_pair(F.col("node"), F.col("first.node"))), "print-pairs")
    for x in (prints, links):
        dropped(x)
    return pairs


def similar_links(nodes: DataFrame, sets_of, least_similarity: float) -> DataFrame:
    """Links (a, b) that connect all nodes of the similarity.  nodes: node, n, fp, keys; sets_of as in _verified().

    Nodes are compared first as their fingerprints and pivot tables say, and each with one other, the hub of most of
    its keys: of a key's members, the one that shares its keys with most others, as the text does that others were made
    from.  The nodes of keys whose members that left unconnected are compared by rare_pairs().  So a group of
    copies costs in proportion to its size, and near copies that are not similar enough share no key.
    """
    members = nodes.select(F.explode("keys").alias("key"), F.col("node").alias("id"), "n")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = written(sizes, "key-sizes")
    shared = written(members.join(sizes, "key"), "shared-keys")
    dropped(sizes)

    degree = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    hubs = shared.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id", "n")).alias("hub"))
    hubs = written(hubs, "key-hubs")
    with_hub = shared.join(hubs, "key").filter("id <> hub.id").filter(_alike(F.col("n"), F.col("hub.n"), least_similarity)).groupBy("id", F.col("hub.id").alias("hub"))
    met = with_hub.agg(F.count(F.lit(1)).alias("keys")).groupBy("id").agg(F.max_by("hub", F.struct("keys", "hub")).alias("hub"))
    by_print = fingerprint_pairs(nodes, least_similarity)
    found = _verified(by_print.unionByName(met.select(*_pair(F.col("id"), F.col("hub")))).distinct(), sets_of, least_similarity)
    for x in (by_print, hubs):
        dropped(x)
    left = _unconnected(shared.select("key", "id", "n"), found)
    dropped(shared)

    sets = written(sets_of(left.select("node")), "left-sets")
    rare = rare_pairs(left, sets, least_similarity)
    more = _verified(rare, lambda wanted: sets.join(wanted, "node", "left_semi"), least_similarity)
    for x in (left, sets, rare):
        dropped(x)
    return found.unionByName(more)


def rare_pairs(nodes: DataFrame, sets: DataFrame, least_similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, n, name) of different names among which are all of the similarity; sets: node, hashes.

    Hashes are ordered by how many of these nodes hold them, so what many near copies have in common comes last and is
    no key of theirs; see prefix_keys().
    """

    @F.pandas_udf("array<long>")
    def longs(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: np.frombuffer(h, np.int64))

    def run(batches):
        for batch in batches:
            found = [prefix_keys(np.asarray(h, np.int64).view(np.uint64), n, least_similarity) for h, n in zip(batch["shared"], batch["n"], strict=True)]
            if found:
                keys, places, smaller = (np.concatenate(x) for x in zip(*found, strict=True))
                own = np.repeat(np.arange(len(batch)), [len(k) for k, _, _ in found])
                yield batch[["node", "n", "name"]].iloc[own].assign(key=keys.view(np.int64), place=places, smaller=smaller)

    each = sets.select("node", F.explode(longs("hashes")).alias("hash"))
    held = written(each.groupBy("hash").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "held")
    order = F.sort_array(F.collect_list(F.struct("held", "hash")))["hash"]
    of_node = each.join(held, "hash").groupBy("node").agg(order.alias("shared")).join(nodes, "node").select("node", "n", "name", "shared")
    keys = written(of_node.mapInPandas(run, "node long, n long, name long, key long, place long, smaller boolean"), "rare-keys")
    dropped(held)
    x, y = (keys.filter(F.col("smaller") == one).select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "name", "place")]) for end, one in (("x", True), ("y", False)))
    least = least_similarity - TINY
    overlap = F.ceil(F.lit(least / (1 + least)) * (F.col("n_x") + F.col("n_y")) - F.lit(TINY))
    both = x.join(y, "key").filter("name_x <> name_y AND (n_x < n_y OR n_x = n_y AND node_x < node_y)")
    both = both.filter((F.col("place_x") <= F.col("n_x") - overlap) & (F.col("place_y") <= F.col("n_y") - overlap))
    pairs = written(both.select(*_pair(F.col("node_x"), F.col("node_y"))).distinct(), "rare-pairs")
    dropped(keys)
    return pairs


def _unconnected(members: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes (node, n, name) of members (key, id, n) whose keys hold several components of the links; name is theirs."""
    named = components(links, None)
    named = members.join(named, members["id"] == named["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("name"))
    named = written(named, "named-members")
    split = named.groupBy("key").agg(F.min("name").alias("least"), F.max("name").alias("most")).filter("least < most")
    out = named.join(split.select("key"), "key", "left_semi").select(F.col("id").alias("node"), "n", "name").distinct()
    out = written(out, "nodes-left")
    dropped(named)
    return out


def similar_groups(docs: DataFrame, shingle: int = 5, least_similarity: float = 0.8) -> DataFrame:
    """doc_id, keep_id: texts whose `shingle`-word sets have the given similarity are linked; of a component the
    smallest doc_id stays.

    The fingerprints of the sets are linked by their pivot tables first.  Two bits of 64 can't find all texts that are
    only 0.8 alike, so the rest is found by parts of the sets, of which similar texts share one, and by their rarest
    shingles; the full sets verify every pair.  Texts without a word are linked
    with nothing but equal texts.  Repeated rows and null ids are treated as in simhash_groups().
    """
    with shuffle_files_dropped(docs.sparkSession):
        return _similar_groups(docs, shingle, least_similarity)


def _similar_groups(docs: DataFrame, shingle: int, least_similarity: float) -> DataFrame:
    @F.pandas_udf("node long, n long, fp long, keys array<long>")
    def features(text: pd.Series) -> pd.DataFrame:
        nodes, counts, prints, keys = [], [], [], []
        for t in text:
            h = np.unique(shingle_hashes(t, shingle))
            nodes.append(xxhash.xxh64_intdigest(b" ".join(t.encode().lower().split()), 5))
            counts.append(len(h))
            prints.append(fingerprint(h))
            keys.append(part_keys(h, least_similarity).view(np.int64))
        return pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "n": np.array(counts, np.int64), "fp": np.array(prints, np.uint64).view(np.int64), "keys": keys})

    @F.pandas_udf("binary")
    def hashes(text: pd.Series) -> pd.Series:
        return text.map(lambda t: np.unique(shingle_hashes(t, shingle)).tobytes())

    text_hash = F.xxhash64("text").alias("text_hash")
    found = texts(docs).select("doc_id", text_hash, features("text").alias("f")).select("doc_id", "text_hash", "f.*")
    found = written(found, "shingle-keys")
    rows = written(found.select("doc_id", "node"), "shingle-rows")
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("text_hash").alias("text_hash"), F.first("keys").alias("keys"))
    nodes = written(nodes, "shingle-nodes")
    dropped(found)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Sets are made again from the texts of these nodes, so that those of all texts are never stored."""
        of_text = nodes.join(wanted, "node", "left_semi").select("node", "text_hash")
        one = texts(docs).select(text_hash, "text").join(of_text, "text_hash").groupBy("node").agg(F.first("text").alias("text"))
        return one.select("node", hashes("text").alias("hashes"))

    named = components(similar_links(nodes, sets_of, least_similarity), None)
    by_node = nodes.select("node", "least").withColumnRenamed("node", "id")
    of_node = _named_by_least(by_node, named, "id").withColumnRenamed("id", "node")
    dropped(nodes)
    out = rows.join(of_node.hint("merge"), "node").select("doc_id", F.col("component_id").alias("keep_id"))
    out = written(out, "similar-groups")
    for x in (rows, of_node):
        dropped(x)
    return out


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of near duplicates, by doc_id."""
    keep = similar_groups(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = keep.select(F.col("doc_id").alias("kept_id")).distinct()
    # Rows are kept whole in one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").alias("id"))
    return rows.join(keep.hint("merge"), F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("whole.*")
