"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 bits over hashed word shingles.  Two that differ in at most
``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks,
so every distinct fingerprint is dealt under every choice of that many blocks
and meets each of its neighbours in some bucket.  Only distinct fingerprints
take part: copies cost one row.

A task sorts its rows by bucket and stores their bits vertically, one vector of
lanes per bit.  Comparing every row with the one ``s`` places on takes a shift
of the vectors by s, an exclusive or per bit, and carry-save counters held as
bit vectors; 64 rows advance per machine word.  Words of lanes in which all
distances exceed the radius, or whose buckets ended, are abandoned.

Buckets above ``tile`` rows are dealt as pairs of tiles, so none is one task's.
Links within a task's bucket are reduced to a spanning forest, and a bucket that
has become one tree is compared no further; pairs aren't emitted.  The links'
components give every document the smallest id reachable.

``similar_documents`` links texts whose sets of word shingles have a given
Jaccard similarity.  The same comparison only gathers candidates: fingerprints
of 256 bits over the sets, with a radius of the distance expected at that
similarity and some three standard deviations.  Buckets are bands of minima of
hashed shingles: a band of ``rows`` minima is shared with the probability of the
similarity to the power of ``rows``, and there are enough bands that a pair at
the similarity shares one with the probability ``recall``.  Texts that share no
shingle share no band, so the comparisons of a text don't grow with the table.

The candidates' components then meet as texts, and only pairs that reach the
similarity become links.  A component above ``text_tile`` texts is first dealt
once, tile by tile, each tile with a few pivots of the component.  That connects
most of a family of copies; afterwards only the texts outside the largest group
so connected meet all others, as pairs of tiles, so that every pair not yet
connected is compared set with set.

Defined results: a null or empty text has fingerprint 0 and an empty set, and is
linked to its like only (by the fingerprint in ``near_duplicates``); rows may
repeat; rows with a null id get the component of their fingerprint's or set's
other rows, or null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tradewind.llm.components import Forest, connected_components
from tradewind.llm.hashing import RunHashes, mix, words_of
from tradewind.llm.storage import partitions, stored

BITS = 64
#: About as many dealt fingerprints (as a power of two) lie in one task, whatever the table's size.
ROWS_LOG2 = 19


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """The majority of each bit over the hashes of all shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    some = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) > shingle else (words,)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, some)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(bytes(b), shingle) if (b := v.as_buffer()) is not None else 0 for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(made, f"doc_id {kind}, fp bigint")


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; texts in lower case (A-Z), those too short are one shingle."""
    values, counts = words_of(texts, lower=True)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        own = values[a:b]
        if 0 < len(own) < shingle:
            yield RunHashes(own).of(np.zeros(1, np.int64), np.array([len(own)]))
        else:
            yield np.unique(RunHashes(own).fixed(shingle))


def band_keys(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key per row of factors: a hash of the minima of hashes multiplied by each of the row's odd factors."""
    flat = factors.ravel()
    least = np.full(len(flat), ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * flat).min(axis=0), out=least)
    key = np.arange(1, len(factors) + 1, dtype=np.uint64)
    for column in least.reshape(factors.shape).T:
        key = mix(key ^ mix(column))
    return key


def band_factors(similarity: float, rows: int, recall: float, seed: int = 5) -> np.ndarray:
    """Odd factors, a row for each band of so many minima that a pair of the similarity shares one with the probability recall."""
    bands = math.ceil(math.log(1 - recall) / math.log(max(1 - similarity**rows, 1e-12)))
    return np.random.default_rng(seed).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprints(docs: DataFrame, bits: int, shingle: int, factors: np.ndarray) -> DataFrame:
    """The columns of docs(text binary, ...), f0, f1, ... with fingerprints of any multiple of 64 bits, node, a hash of the set of shingles, and its bands."""
    n_words = bits // BITS
    names = [*docs.columns, *_names(n_words), "node", "bands"]
    at_text = docs.columns.index("text")
    seeds = np.random.default_rng(77).integers(1, 1 << 63, n_words, dtype=np.uint64)

    def of(hashes: np.ndarray) -> list:
        ones = np.zeros(bits, np.int64)
        for at in range(0, len(hashes), 1024):
            wide = mix(hashes[at : at + 1024, None] ^ seeds)
            ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        node = np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)
        return [*np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64).tolist(), int(node[0]), band_keys(hashes, factors).view(np.int64)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            fps = [of(h) for h in shingle_sets([v or b"" for v in batch.column(at_text).to_pylist()], shingle)]
            wide = [pa.array([f[k] for f in fps], pa.int64()) for k in range(n_words + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *wide, pa.array([f[-1] for f in fps], pa.list_(pa.int64()))], names)

    schema = StructType(list(docs.schema.fields))
    for name in names[len(docs.columns) : -1]:
        schema = schema.add(name, LongType())
    return docs.mapInArrow(made, schema.add("bands", ArrayType(LongType())))


def _names(n_words: int) -> list[str]:
    return [f"f{k}" for k in range(n_words)]


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of the bits on which two fingerprints must agree, one for each choice of blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(block, blocks - radius)]


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, one row of lanes per bit, packed to 64-bit words with a word to spare."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").T
    wide = np.zeros((len(bits), (len(fps) + 63) // 64 * 64 + 64), np.uint8)
    wide[:, : len(fps)] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _shifted(rows: np.ndarray, s: int) -> np.ndarray:
    """Lane i of the result is lane i + s; lanes behind the end are 0."""
    words, bits = divmod(s, 64)
    out = np.zeros_like(rows)
    n = rows.shape[1] - words
    if n > 0:
        out[:, :n] = rows[:, words:] >> np.uint64(bits)
        if bits and n > 1:
            out[:, : n - 1] |= rows[:, words + 1 :] << np.uint64(64 - bits)
    return out


def _within(a: np.ndarray, b: np.ndarray, alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of alive in which a and b differ in at most radius bits, by bit-sliced counters."""
    depth = radius.bit_length()
    result = np.zeros_like(alive)
    words = np.flatnonzero(alive)
    a, b, live = a[:, words], b[:, words], alive[words]
    counters = [np.zeros_like(live) for _ in range(depth)]
    over = ~live
    for k in range(len(a)):
        carry = a[k] ^ b[k]
        for c in counters:
            c ^= carry
            carry = carry & ~c  # where the counter's bit went from 1 to 0
        over |= carry
        if k % 8 == 7 or k == len(a) - 1:
            # a counter above the radius: radius + 1 up to 2 ** depth - 1
            above = np.zeros_like(live)
            equal = ~above
            for d in reversed(range(depth)):
                if radius >> d & 1:
                    equal &= counters[d]
                else:
                    above |= equal & counters[d]
                    equal &= ~counters[d]
            over |= above
            stay = over != ~np.uint64(0)
            if not stay.all():  # abandon words of lanes that all exceed the radius
                if not stay.any():
                    return result
                a, b, over, words = a[:, stay], b[:, stay], over[stay], words[stay]
                live = live[stay]
                counters = [c[stay] for c in counters]
    result[words] = ~over
    return result


def bucket_links(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs of equal bucket numbers; fps are sorted by bucket."""
    n = len(fps)
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, n) if n else np.zeros(0, np.int64)
    begins = np.append(0, ends[:-1]) if n else ends
    left = np.repeat(ends, ends - begins) - np.arange(n)  # rows of the bucket from here on
    keep = np.flatnonzero(np.repeat(ends - begins, ends - begins) > 1)
    fps, left = fps[keep], left[keep]
    forest = Forest(len(fps))
    ids = np.arange(len(fps))
    store, s = planes(fps) if len(fps) else None, 1
    while len(ids):
        alive = left > s
        if not alive.any():
            break
        if s & (s - 1) == 0 and s > 1:  # now and then, only the rows of buckets that go on stay
            runs = _run_sizes(left)
            begins = np.cumsum(runs) - runs
            root = forest.roots()[ids]
            open_ = np.minimum.reduceat(root, begins) != np.maximum.reduceat(root, begins)
            on = np.flatnonzero(np.repeat((runs > s) & open_, runs))
            if not len(on):
                break
            if len(on) < len(ids):
                fps, left, ids = fps[on], left[on], ids[on]
                store, alive = planes(fps), left > s
        lanes = np.zeros(store.shape[1] * 64, np.uint8)
        lanes[: len(alive)] = alive
        near = _within(store, _shifted(store, s), np.packbits(lanes, bitorder="little").view(np.uint64), radius)
        if near.any():
            hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(ids)])
            forest.add(ids[hit], ids[hit + s])
        s += 1
    pairs = keep[np.array(forest.edges, np.int64).reshape(-1, 2)]
    return pairs[:, 0], pairs[:, 1]


def _run_sizes(left: np.ndarray) -> np.ndarray:
    """Sizes of the buckets out of the number of rows left in each row's bucket."""
    starts = np.append(True, left[1:] >= left[:-1]) if len(left) else np.zeros(0, bool)
    return left[starts]


def mask_keys(masks: list[int], word: str) -> Column:
    """(choice, value) for each mask: a hash of the word's bits under it."""
    return F.array(*(F.struct(F.lit(i).alias("choice"), F.xxhash64(F.col(word).bitwiseAND(F.lit(_signed(m)))).alias("value")) for i, m in enumerate(masks)))


def near_links(distinct: DataFrame, words: list[str], keys: Column, radius: int, tile: int, tasks: int, one_in: int = 1) -> DataFrame:
    """Links (a, b) that connect all nodes of distinct(node, *words, ...) within the radius that share one of keys, an array of (choice, value).

    Buckets to be tiled are counted over one in ``one_in`` nodes; that shifts only where work is done.
    """
    deal = lambda nodes: nodes.select("node", *words, F.explode(keys).alias("k")).select("node", *words, "k.choice", "k.value")
    dealt = deal(distinct)
    counted = dealt if one_in == 1 else deal(distinct.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(one_in)) == 0))
    # how many tiles a large bucket is cut into; Spark broadcasts this only if it is small
    large = counted.groupBy("choice", "value").agg((F.count("*") * one_in).alias("n")).where(F.col("n") > tile)
    large = large.select("choice", "value", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    large = large if one_in == 1 else F.broadcast(large)  # few, and the dealt rows aren't shuffled for them
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    pair = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.transform(other, lambda o: F.least(o, own) * F.col("tiles") + F.greatest(o, own))))
    tiled = dealt.join(large, ["choice", "value"], "left").withColumn("pair", pair)
    rows = tiled.select("node", *(w for w in words if w != "node"), F.xxhash64("choice", "value", "pair").alias("bucket")).repartition(tasks, "bucket")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [*batches]) else None
        if table is None:
            return
        bucket, node = table["bucket"].to_numpy(), table["node"].to_numpy()
        order = np.lexsort((node, bucket))
        fps = np.stack([table[w].to_numpy()[order] for w in words], axis=1)
        a, b = bucket_links(np.ascontiguousarray(fps).view(np.uint64), bucket[order], radius)
        node = node[order]
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return rows.mapInArrow(linked, "a bigint, b bigint").distinct()


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _grouped(prints: DataFrame, masks: list[int], radius: int, tile: int, tasks: int) -> DataFrame:
    """The rows of prints(doc_id, node) with their component's smallest doc_id; node is the fingerprint."""
    classes = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    component = connected_components(near_links(classes.select("node"), ["node"], mask_keys(masks, "node"), radius, tile, tasks))
    placed = classes.join(component, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = placed.join(smallest, "component").select("node", "component_id").distinct()
    return prints.join(by_print, "node")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    radius: int = 4,
    blocks: int = 6,
    tile: int = 1 << 15,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = stored(fingerprints(docs, doc_id, text, shingle).withColumnRenamed("fp", "node"), "fingerprints")
    masks = block_masks(radius, blocks)
    tasks = max(partitions(docs.sparkSession), prints.count() * len(masks) >> ROWS_LOG2)
    found = _grouped(prints, masks, radius, tile, tasks)
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def expected_distance(similarity: float) -> float:
    """The share of bits in which two texts differ whose sets of shingles have that Jaccard similarity, if of like size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def exact_links(sets: list[np.ndarray], similarity: float, known: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sorted sets whose Jaccard similarity is reached; sets of one known group are connected already."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(which, kind="stable")
    holders, starts = owner[order], np.searchsorted(which[order], np.arange(len(values) + 1))
    begins = np.cumsum(sizes) - sizes
    forest = Forest(n)
    if known is not None:
        first, group = np.unique(np.array(known, np.int64), return_index=True, return_inverse=True)[1:]
        forest.add(first[group], np.arange(n))
    given = len(forest.edges)
    for i in range(n - 1):
        root = forest.roots()
        if (root == root[0]).all():
            break
        apart = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        least, most = np.minimum(sizes[apart], sizes[i]), np.maximum(sizes[apart], sizes[i])
        apart = apart[least >= similarity * most * (1 - 1e-9)]
        if not len(apart):
            continue
        if len(apart) <= 8:
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in apart.tolist()])
        else:
            own = which[begins[i] : begins[i] + sizes[i]]
            k = starts[own + 1] - starts[own]
            at = np.repeat(starts[own], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            both = np.bincount(holders[at], minlength=n)[apart]
        union = sizes[apart] + sizes[i] - both
        near = apart[both / np.maximum(union, 1) >= similarity]
        forest.add(np.full(len(near), i), near)
    return forest.edges[given:]


def dealt_links(dealt: DataFrame, texts: DataFrame, shingle: int, similarity: float, tasks: int) -> DataFrame:
    """Links (a, b) that connect all nodes of that similarity within each bucket of dealt(bucket, node, known).

    Nodes of one known group count as connected.  A task holds one bucket at a time.
    """
    rows = dealt.join(texts.select("node", "text"), "node").select("bucket", "node", "text", "known").repartition(tasks, "bucket").sortWithinPartitions("bucket", "node")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, sets, known = None, [], [], []

        def done() -> pa.RecordBatch:
            edges = exact_links(sets, similarity, known) if len(sets) > 1 else []
            a, b = ([nodes[e[k]] for e in edges] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            given = shingle_sets([v or b"" for v in batch.column(2).to_pylist()], shingle)
            for of, node, group, own in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), given, strict=True):
                if of != bucket:
                    yield done()
                    bucket, nodes, sets, known = of, [], [], []
                nodes.append(node)
                sets.append(own)
                known.append(group)
        yield done()

    return rows.mapInArrow(linked, "a bigint, b bigint").distinct()


def verified_links(texts: DataFrame, shingle: int, similarity: float, tile: int, tasks: int, pivots: int = 16) -> DataFrame:
    """Links (a, b) that connect all nodes of texts(node, component, text) of that similarity within each component.

    Only ids are dealt here; the texts follow them.  Components above ``tile`` texts are dealt in two passes (see above).
    """
    members = texts.select("node", "component")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    whole = members.join(sizes.where(F.col("n") <= tile), "component").select(F.xxhash64("component").alias("bucket"), "node", F.col("node").alias("known"))
    small = dealt_links(whole, texts, shingle, similarity, tasks)
    large = sizes.where(F.col("n") > tile).select("component", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    placed = stored(members.join(large, "component").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")), "large")
    if placed.isEmpty():
        return small
    # every tile once, with some pivots of its component
    leads = placed.groupBy("component", "tiles", F.pmod(F.xxhash64("node", F.lit(13)), F.lit(pivots)).alias("lead")).agg(F.min("node").alias("node"))
    leads = leads.select("component", "node", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    once = placed.select("component", "node", "tile").unionByName(leads).distinct()
    bucket = F.xxhash64("component", "tile").alias("bucket")
    first = stored(dealt_links(once.select(bucket, "node", F.col("node").alias("known")), texts, shingle, similarity, tasks), "first-links")
    # the largest group of each component is settled inside; the rest meets everything
    roots = connected_components(first).withColumnRenamed("component", "root")
    grouped = placed.join(roots, "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root")
    counted = grouped.groupBy("component", "known").agg(F.count("*").alias("n"))
    main = counted.groupBy("component").agg(F.max(F.struct("n", "known"))["known"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    main = main.select("component", "main", F.ceil((F.col("n") - F.col("most")) / tile).cast("int").alias("rests")).where(F.col("rests") > 0)
    apart = stored(grouped.join(main, "component").withColumn("rest", F.pmod(F.xxhash64("node", F.lit(17)), F.col("rests")).cast("int")), "apart")
    pair = lambda rest, tile_: F.struct(rest.alias("rest"), tile_.alias("tile"))
    met = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: pair(r, F.col("tile")))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: pair(F.col("rest"), t))
    pairs = F.when(F.col("known") == F.col("main"), met).otherwise(F.array_union(met, meets))
    dealt = apart.select("component", "node", "known", F.explode(pairs).alias("p"))
    second = dealt_links(dealt.select(F.xxhash64("component", "p.rest", "p.tile").alias("bucket"), "node", "known"), texts, shingle, similarity, tasks)
    return small.unionByName(first).unionByName(second).distinct()


def similar_rows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    margin: float = 0.07,
    bits: int = 256,
    rows: int = 5,
    recall: float = 0.99,
    tile: int = 1 << 14,
    text_tile: int = 512,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, text, *keep, component_id, is_first) of every row; of each component one row is the first, that of the smallest id.

    ``margin`` is the share of bits added to the expected distance: some three
    standard deviations, for the spread of a fingerprint's distances.
    """
    words = _names(bits // BITS)
    radius = round((expected_distance(similarity) + margin) * bits)
    factors = band_factors(similarity, rows, recall)
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.struct(F.lit(0), *keep).alias("kept"))
    # numbered once, as they are written
    prints = stored(wide_fingerprints(given, bits, shingle, factors).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    tasks = max(partitions(docs.sparkSession), prints.count() * len(factors) >> ROWS_LOG2)
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")).alias("first")
    classes = stored(prints.groupBy("node", *words).agg(first, F.first("bands").alias("bands")), "sets")
    keys = F.transform("bands", lambda value, i: F.struct(i.alias("choice"), value.alias("value")))
    near = connected_components(near_links(classes.select("node", *words, "bands"), words, keys, radius, tile, tasks, one_in=64))
    chosen = classes.join(near, "node").select(F.col("first.row").alias("row"), "node", "component")
    texts = stored(chosen.join(prints.select("row", "text"), "row").select("node", "component", "text"), "candidates")
    component = connected_components(verified_links(texts, shingle, similarity, text_tile, partitions(docs.sparkSession)))
    placed = classes.join(component, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("least"))
    by_set = placed.join(smallest, "component").select("node", "least")
    found = prints.join(by_set, "node")
    return found.select("doc_id", F.col("text").cast(docs.schema[text].dataType).alias("text"), *(F.col(f"kept.`{c}`") for c in keep), F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("is_first"))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row, linked at a Jaccard similarity of the sets of word shingles."""
    return similar_rows(docs, doc_id, text, shingle, similarity).select("doc_id", "component_id")
