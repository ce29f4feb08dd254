"""Every operator against a brute-force version, on real and planted documents."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def by_id(frame) -> dict:
    got = {r.doc_id: r for r in frame.collect()}
    return got


def roots(n: int, pairs) -> list[int]:
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scoring(docs, rows, none, order):
    from tradewind.llm.lm_scoring import score

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: [*WORD.findall(lower(t or "")), None] for i, t, *_ in rows}
    grams = [Counter() for _ in range(order + 1)]
    for i, own in tokens.items():
        if not held[i]:
            framed = ["<begin>"] * (order > 1) + own
            for k in range(1, order + 1):
                grams[k].update(tuple(framed[max(0, a - k + 1) : a + 1]) for a in range(len(framed) - len(own), len(framed)) if k == 1 or a - k + 1 >= 0)
    n, v = sum(grams[1].values()), len(grams[1])
    got = by_id(score(docs, order=order, lane=16))
    assert len(got) == len(rows)
    for i, own in tokens.items():
        c = [grams[1][(t,)] for t in own]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(x > 0 for x in c), n)
        assert r.base_score == pytest.approx(sum(math.log10((x + 1) / (n + v + 1)) for x in c), rel=1e-9)
        assert r.score < 0
    there = [i for i in tokens if held[i] and i < 900_000]
    if order > 1:
        assert sum(got[i].score for i in there) > sum(got[i].base_score for i in there)
    assert score(none).count() == 0


def test_lm_direct_formula(spark):
    """The automaton's sum is the interpolated model's, word by word, in lanes of any size."""
    from tradewind.llm.lm_scoring import score

    texts = ["a b a b c", "b a", "c c c a b", None, "a b z"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:4] + [next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)]
    table = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    train = [["^", *(t or "").split(), "$"] for t in texts[:4]]
    one, two, history = Counter(), Counter(), Counter()
    for t in train:
        one.update(t[1:])
        two.update(zip(t, t[1:]))
        history.update(t[:-1])
    n, v = sum(one.values()), len(one)
    ones, twos = (sum(c == k for c in one.values()) for k in (1, 2))
    d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
    for lane in (2, 512):
        got = by_id(score(table, order=2, prior=(10.0,), lane=lane))
        for i, t in zip(ids, texts):
            seq, total = ["^", *(t or "").split(), "$"], 0.0
            for a, b in zip(seq, seq[1:]):
                p = (one[b] - d) / n if one[b] else d * v / n
                h = one[a] if a != "^" else history["^"]
                total += math.log10((two[a, b] + 10 * p) / (h + 10)) if h else math.log10(p)
            assert got[i].score == pytest.approx(total, abs=1e-9)


def test_license_scan(docs, rows, none):
    from tradewind.llm.license_scan import BASE, license_digest, scan_licenses

    got = by_id(license_digest(scan_licenses(docs)))
    for i, t, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        places = []
        for b in BASE:
            p = b.phrase.split()
            places += [(k, b.label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        r = got[i]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[900_014].labels == "apache,apache-2,cc-by,gpl,gpl-3,mit"
    assert license_digest(scan_licenses(none)).count() == 0


def test_license_clauses(spark):
    """Every clause is found whole, inside other text and with some words changed; brute force agrees on every place."""
    from tradewind.llm.license_scan import MORE, PositionalIndex, Template, license_digest, scan_licenses
    from tradewind.llm.license_texts import CLAUSES

    rng = np.random.default_rng(8)
    texts, want = [], []
    for label, text, keys in CLAUSES:
        words = text.split()
        texts.append("Header line. " + " ".join(words).capitalize() + ", and the rest.")
        want.append(label)
        inside = {k for key in keys for k in range(len(words) - len(key.split()) + 1) if words[k : k + len(key.split())] == key.split() for k in range(k, k + len(key.split()))}
        free = [k for k in range(len(words)) if k not in inside and len(words[k]) < 5]
        for k in rng.choice(free, max(1, len(words) // 25), replace=False) if len(words) > 20 else []:
            words[k] = "xxx"
        texts.append("one two " + " ".join(words).upper())
        want.append(label)
    got = {r.doc_id: r for r in license_digest(scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()}
    assert all(w in got[i].labels.split(",") for i, w in enumerate(want))
    index = PositionalIndex((), MORE, 0.8)
    for t in texts:
        words = t.lower().replace(",", "").replace(".", "").encode().split()
        every = {(i, s) for i, (_, own, _) in enumerate(index.templates) for s in range(1 - len(own), len(words)) if index._coverage(i, s, words)}
        assert {(i, s) for i, s, _ in index.scan(words)} == every
    assert isinstance(MORE[0], Template) and len(CLAUSES) >= 30


def test_sentence_pieces(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    from tradewind.llm.sentence_pieces import decode, encode

    there = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = encode(docs)
    got, back = by_id(encoded), by_id(decode(encoded))
    for i, t, *_ in rows:
        ids = there.encode(t or "")
        assert got[i].ids == ids and got[i].same_ids and got[i].n_tokens == len(ids)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert back[i].text == there.decode(ids)
    assert decode(encode(none)).count() == 0


def test_token_counts(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tradewind.llm.token_counts import count_tokens

    there = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for chunk in (1 << 14, 17, 3):
        got = by_id(count_tokens(docs, chunk_chars=chunk))
        for i, t, *_ in rows:
            assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(there.encode(t or "", add_special_tokens=False).ids)), (i, chunk)
    assert count_tokens(none).count() == 0


@pytest.mark.parametrize("max_open", [4096, 2])
def test_packing(docs, rows, none, max_open):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tradewind.llm.packing import pack

    there = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs, max_open=max_open).collect():
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t, *_ in rows:
        ids = there.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
    total = padded = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        n = sum(r.length for r in own)
        assert n <= 2048
        total, padded = total + n, padded + (n if n & (n - 1) == 0 else 2048)
    assert padded <= 1.001 * total
    assert pack(none).count() == 0


def brute_fingerprint(text: str) -> int:
    import xxhash

    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, none):
    from tradewind.llm.simhash import near_duplicates

    fps = [brute_fingerprint(t or "") for _, t, *_ in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    least: dict[int, int] = {}
    root = roots(len(rows), links)
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    for tile in (1 << 15, 5):
        got = by_id(near_duplicates(docs, tile=tile))
        for k, (i, *_) in enumerate(rows):
            assert (got[i].fingerprint, got[i].component_id) == (f"{fps[k]:016x}", least[root[k]])
    assert near_duplicates(none).count() == 0


def test_simhash_distances():
    from tradewind.llm.simhash import bucket_links

    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.array([int(f) ^ sum(1 << int(b) for b in rng.choice(64, k % 7, replace=False)) for k, f in enumerate(np.repeat(fps, 5))], np.uint64)
    for radius in (0, 1, 3, 4, 6):
        bucket = np.arange(len(near)) // 50
        a, b = bucket_links(near[:, None], bucket, radius)
        want = roots(len(near), [(i, j) for i, j in itertools.combinations(range(len(near)), 2) if bucket[i] == bucket[j] and (int(near[i]) ^ int(near[j])).bit_count() <= radius])
        assert roots(len(near), zip(a.tolist(), b.tolist())) == want


def test_similar_documents(spark, docs, rows, none):
    """Texts of similarity 0.85 and more are found, different ones are left alone."""
    from tradewind.llm.simhash import similar_documents

    rng = np.random.default_rng(9)
    texts = []
    for g in range(150):
        words = [f"v{x}" for x in rng.integers(0, 5000, 300)]
        texts.append((2 * g, " ".join(words)))
        for _ in range(3):  # a run of five changed shingles each: 270 of 300 or so stay
            words[int(rng.integers(0, 300))] = f"u{rng.integers(0, 9**9)}"
        texts.append((2 * g + 1, " ".join(words)))
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert all(got[2 * g] == 2 * g for g in range(150))
    assert sum(got[2 * g + 1] == 2 * g for g in range(150)) >= 0.95 * 150
    own = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    assert len(own) == len(rows) and own[900_006] == 900_005 == own[900_007]
    assert similar_documents(none).count() == 0


def test_similar_documents_at_the_threshold(spark):
    """Pairs at 0.8 and a little over are linked, those a little under are not, by the sets themselves."""
    from tradewind.llm.simhash import similar_documents

    rng = np.random.default_rng(21)
    texts, want = [], {}
    for g in range(200):
        words = [f"v{x}" for x in rng.integers(0, 10**9, 184)]  # 180 shingles
        end = 20 if g % 2 else 22  # another end changes as many shingles: 160 / 200 = 0.8, or 158 / 202
        texts += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:-end] + [f"u{g}x{k}" for k in range(end)]))]
        want[2 * g], want[2 * g + 1] = 2 * g, 2 * g + (g + 1) % 2
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert all(got[2 * g + 1] == 2 * g + 1 for g in range(0, 200, 2))  # exact: never under 0.8
    assert sum(got[i] == want[i] for i in want) >= len(want) - 4  # a pair at 0.8 is a candidate with probability over 0.99


@pytest.mark.parametrize("text_tile", [512, 3])
def test_verified_links(spark, text_tile):
    """Links within a component are exact, also where it is cut into tiles."""
    from tradewind.llm.components import connected_components
    from tradewind.llm.simhash import verified_links

    rng = np.random.default_rng(4)
    words = [f"v{x}" for x in range(40)]
    texts = []
    for _ in range(40):
        own = words.copy()
        for at in rng.integers(0, 40, int(rng.integers(0, 4))):
            own[at] = f"u{rng.integers(0, 3)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(36)} for t in texts]
    want = roots(40, [(a, b) for a, b in itertools.combinations(range(40), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    rows = spark.createDataFrame([(i, 0, t.encode()) for i, t in enumerate(texts)], "node bigint, component bigint, text binary")
    got = {r.node: r.component for r in connected_components(verified_links(rows, 5, 0.8, text_tile, 4)).collect()}
    assert 1 < len(set(want)) < 40 and [got.get(i, i) for i in range(40)] == want


@pytest.mark.parametrize("pivots", [1, 4])
def test_verified_links_of_a_large_family(spark, pivots):
    """A component of which most texts are one family, some chains reach it over others, and the rest are apart: the same links as all pairs give."""
    from tradewind.llm.components import connected_components
    from tradewind.llm.simhash import verified_links

    rng = np.random.default_rng(8)
    base = [f"v{x}" for x in range(60)]
    texts = [" ".join([*base[:-1], f"last{i}"]) for i in range(70)]
    for i in range(50):  # longer and longer ends of their own: linked to the family, to each other, or to nothing
        own = base.copy()
        own[int(rng.integers(20, 60)) :] = [f"w{i // 5}x{k}" for k in range(int(rng.integers(1, 30)))]
        texts.append(" ".join(own))
    n, sets = len(texts), [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    want = roots(n, [(a, b) for a, b in itertools.combinations(range(n), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    rows = spark.createDataFrame([(i, 0, t.encode()) for i, t in enumerate(texts)] + [(n, 1, b"two words")], "node bigint, component bigint, text binary")
    got = {r.node: r.component for r in connected_components(verified_links(rows, 5, 0.8, 6, 4, pivots)).collect()}
    assert 2 < len(set(want)) < 50 and [got.get(i, i) for i in range(n)] == want


def test_bands_of_unlike_texts(spark):
    """Texts without a common shingle share no band, whatever their number; pairs at the similarity share one as often as stated."""
    from tradewind.llm.simhash import band_factors, band_keys

    factors, rng = band_factors(0.8, 5, 0.99), np.random.default_rng(2)
    apart = [band_keys(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2), factors) for _ in range(5000)]
    keys = np.stack(apart)
    assert all(len(np.unique(keys[:, k])) == 5000 for k in range(len(factors))) and len(np.unique(keys)) == keys.size
    met = 0
    for _ in range(1000):
        all_ = rng.integers(0, 1 << 63, 100, dtype=np.uint64)  # 80 of 100 in common
        met += bool((band_keys(all_[:90], factors) == band_keys(all_[10:], factors)).any())
    assert met >= 980


def brute_strings(rows, size: int = 50) -> dict:
    first: dict[bytes, int] = {}
    bodies = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in bodies:
        for a in range(len(b) - size + 1):
            s = b[a : a + size]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, np.int64)
        for a in range(len(b) - size + 1):
            if first[b[a : a + size]] < i:
                gone[a] += 1
                gone[a + size if a + size < len(gone) else -1] -= 1
        mark = np.cumsum(gone[:-1]) > 0 if len(b) else np.zeros(0, bool)
        out[i] = len(b), int(mark.sum()), int((np.diff(mark.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest()
    return out


@pytest.mark.parametrize("sort_classes", [4096, 0])
def test_suffix_dedup(docs, rows, none, sort_classes):
    from tradewind.llm.suffix_dedup import repeated_strings

    want = brute_strings(rows)
    got = by_id(repeated_strings(docs, sort_classes=sort_classes, keep=("lang", "fp")))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert all(r.fp == "extra" for r in got.values())
    assert repeated_strings(none).count() == 0


@pytest.mark.parametrize("length", [8, 30, 100, 200])
def test_suffix_dedup_of_other_lengths(docs, rows, length):
    from tradewind.llm.suffix_dedup import repeated_strings

    got = by_id(repeated_strings(docs, length=length))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_strings(rows, length)


def test_deep_shallow_order():
    from tradewind.llm.deep_shallow import sort_suffixes

    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 99, 300, dtype=np.uint8)) + b"ab" * 90
    suffixes = [text[i:] for i in range(len(text))]
    group = np.arange(len(text)) % 2
    for shallow in (8, 64):
        for skip in (0, 3):
            assert sort_suffixes(suffixes, group, skip, shallow)[0].tolist() == sort_suffixes(suffixes, group)[0].tolist()
    some = [b"same" + t for t in suffixes[:200]]
    order, _ = sort_suffixes(some, np.zeros(200, int), skip=4)
    assert [some[i] for i in order] == sorted(some)
    order, common = sort_suffixes(suffixes, group)
    assert [(int(group[i]), suffixes[i]) for i in order] == sorted((int(g), s) for g, s in zip(group, suffixes))
    for a, b, n in zip(order, order[1:], common[1:]):
        same = next((k for k, (x, y) in enumerate(zip(suffixes[a], suffixes[b])) if x != y), min(len(suffixes[a]), len(suffixes[b])))
        assert n == (same if group[a] == group[b] else -1)


def test_debruijn_dedup(docs, rows, none):
    from tradewind.llm.debruijn_dedup import repeated_passages

    counts = Counter()
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    for w in words.values():
        counts.update(tuple(w[a : a + 35]) for a in range(len(w) - 34))
    got = by_id(repeated_passages(docs))
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - 34):
            if counts[tuple(w[a : a + 35])] > 1:
                gone.update(range(a, a + 35))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()), i
    assert repeated_passages(none).count() == 0


def test_embedding_dedup(spark, sf_dir):
    from tradewind.llm.embedding_dedup import near_vectors

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    dims = len(rows[0][1])
    some = rows[0][1]
    odd = [None, [], [0.0] * dims, [*some[:-1], None], [*some[:-1], float("nan")], [*some[:-1], float("inf")], some, [x * 1e20 for x in some], [1.0, 2.0], [2.0, 4.0]]
    rows += [(10_000 + k, v) for k, v in enumerate(odd)]
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = x / np.sqrt((x * x).sum())
    pairs = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    n = Counter(x for p in pairs for x in p)
    root = roots(len(rows), pairs)
    least: dict[int, int] = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, block string")
    for tile, per_cell in ((16384, 2000), (7, 20)):
        got = {r.vec_id: r for r in near_vectors(table, tile=tile, rows_per_cell=per_cell).collect()}
        assert len(got) == len(rows)
        for k, (i, _) in enumerate(rows):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[k], least[root[k]], i == least[root[k]]), i
    assert near_vectors(table.limit(0)).count() == 0


def test_embedding_precision_ties_and_repeated_rows(spark):
    """Doubles beyond single precision, tiny and huge ones, copies of rows, equal ids, and a cosine of exactly the limit."""
    from tradewind.llm.embedding_dedup import near_vectors

    one = [1e300, 1e300, 0.0, 0.0]
    close = [1.0, 1e-10, 0.0, 0.0]
    given = [(1, one), (2, one), (3, [1e-300, 1e-300, 0.0, 0.0]), (4, close), (5, [1.0, 0.0, 0.0, 0.0]), (6, [0.0, 0.0, 3.0, 4.0]), (6, [0.0, 0.0, 3.0, 4.0]), (7, [0.0, 0.0, 1.0, 0.0])]
    table = spark.createDataFrame(given, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(table, cosine=0.6).collect())
    # every pair of the first five has cosine 1 or 0.707, and 3 / 5 is the limit itself
    assert got == [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False), (5, 4, 1, False), (6, 2, 6, True), (6, 2, 6, True), (7, 2, 6, False)]
    assert [r.n_links for r in near_vectors(table, cosine=0.8).orderBy("vec_id").collect()] == [2, 2, 2, 1, 1, 1, 1, 0]


def test_quality_rules(docs, rows, none):
    from tradewind.llm.quality_rules import quality

    got = by_id(quality(docs))
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        windows = Counter(tuple(words[a : a + 3]) for a in range(len(words) - 2))
        repeat = {k for a in range(len(words) - 2) if windows[tuple(words[a : a + 3])] > 1 for k in (a, a + 1, a + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality(none).count() == 0


def test_boilerplate_lines(spark):
    from tradewind.llm.quality_rules import quality

    body = lambda i: "\n".join(" ".join(f"{chr(97 + (i + k) % 26)}{chr(97 + i % 7)}x{chr(97 + j)}{chr(97 + i // 26)}" for j in range(10)) for k in range(6))
    rows = [(i, f"Copyright {i}  ALL pages\n{body(i)}\ncopyright 77 all PAGES", "host") for i in range(30)]
    got = quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert all(r.n_removed_lines == 2 and r.kept and r.clean_text == body(r.doc_id) for r in got)


def test_boilerplate_lines_of_null_ids(spark):
    """Rows with a null id lose boilerplate lines like all others."""
    from tradewind.llm.quality_rules import quality

    given = [(None if k < 2 else k, "the same footer here\n" + " ".join(f"{chr(97 + k)}y{i}" for i in range(60)), "h") for k in range(12)]
    got = quality(spark.createDataFrame(given, "doc_id bigint, text string, source string")).collect()
    assert sum(r.doc_id is None for r in got) == 2 and [(r.n_removed_words, r.n_removed_lines) for r in got] == [(4, 1)] * 12
    assert all("footer" not in r.clean_text for r in got)


def test_components(spark):
    from tradewind.llm.components import connected_components

    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 5), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}


def test_pipeline(spark, sf_dir):
    """Stage by stage on what the stage before it kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = now.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(spark, before, sf_dir).cache()
        if k < 3:
            assert now.columns == columns
            kept.append([tuple(r) for r in now.collect()])
    from tradewind.llm.quality_rules import quality

    assert {r[0] for r in kept[0]} == {r.doc_id for r in quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").collect()}
    shingles = {}
    for i, t, *_ in kept[0]:
        w = lower(t).split()
        shingles[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))}
    stays = {r[0] for r in kept[1]}
    near = [(a, b) for a, b in itertools.combinations(sorted(shingles), 2) if len(shingles[a] & shingles[b]) >= 0.85 * len(shingles[a] | shingles[b])]
    assert sum(b in stays and a in stays for a, b in near) <= 0.05 * len(near)
    for gone in set(shingles) - stays:
        assert max(len(shingles[gone] & s) / len(shingles[gone] | s) for i, s in shingles.items() if i != gone) > 0.5
    want = brute_strings([(r[0], r[1]) for r in kept[1]])
    for i, t, *_ in kept[2]:
        assert len(t.encode()) <= want[i][0] - want[i][1]
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == {r[0] for r in kept[2]}


def test_near_duplicates_stage_by_row(spark, sf_dir):
    """One row of each group stays where ids repeat or are null, and no clean row goes because of its id."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    given = [(1, a), (1, a), (2, b), (1, b), (None, c), (None, c), (None, a), (3, "alone " + c[::-1])]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates_stage(spark, rows.repartition(3), sf_dir)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [(1, a), (1, b), (None, c), (3, "alone " + c[::-1])]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_quality_oracle(spark, sf_dir):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op8_quality_rules"]).fetch_df()
    got = entry.queries()["op8_quality_rules"](spark, sf_dir).toPandas()[want.columns.tolist()]
    assert got.sort_values("doc_id").reset_index(drop=True).astype(want.dtypes).equals(want.sort_values("doc_id").reset_index(drop=True))


def test_null_ids(spark):
    from tradewind.llm.simhash import near_duplicates
    from tradewind.llm.suffix_dedup import repeated_strings

    text = " ".join(f"q{i}" for i in range(60))
    table = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_removed > 0) for r in repeated_strings(table).collect())
    assert got == [(0, True), (5, False), (5, False), (9, True)]
    assert [r.component_id for r in near_duplicates(table).collect()] == [5] * 4


@pytest.mark.parametrize("sort_classes", [4096, 0])
def test_repeated_ids_in_several_chunks(spark, sort_classes):
    """Every row of an id loses what a smaller id holds, in whichever chunk it lies; null ids come last."""
    from tradewind.llm.suffix_dedup import repeated_strings

    own = lambda x: " ".join(f"{x}{i * 37 % 101}" for i in range(60))
    for shared in (60, 75, 200):
        passage = "|" + "".join(chr(97 + i * i * 31 % 23) + str(i) for i in range(shared))[:shared] + "|"
        given = [(1, own("a") + "<" + passage + ">" + own("b"))] + [(5, own("c") + passage + own("d"))] * 3 + [(None, own("e") + "!" + passage + "!" + own("f"))] * 3
        rows = spark.createDataFrame(spark.sparkContext.parallelize(given, 7), "doc_id bigint, text string")
        got = sorted((r.doc_id or 9, r.n_removed) for r in repeated_strings(rows, sort_classes=sort_classes).collect())
        assert got == [(1, 0)] + [(5, len(passage))] * 3 + [(9, len(passage))] * 3
