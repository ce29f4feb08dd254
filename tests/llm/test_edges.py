"""Repeated rows, null ids, nulls in other columns, ties, very long texts and clashing columns, for every operator and stage."""

import hashlib
from collections import Counter

import pytest

WORDS = [f"w{i * 7919 % 1009}" for i in range(400)]
BASE = " ".join(WORDS[:120])
LONG = " ".join(WORDS[(i * 31) % 400] + str(i % 97) for i in range(30_000))
#: Rows that repeat an id and a text, an id with two texts, null ids, nulls, and a long text twice.
GIVEN = [(1, BASE), (1, BASE), (1, "other words here " * 20), (None, BASE), (None, None), (2, None), (2, ""), (3, LONG), (4, LONG), (5, " \n\t")]


def signature(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows.collect())


@pytest.fixture(scope="module")
def table(spark):
    clash = "_id string, _host int, _text string, _body string, _gone int, key string, bucket string, node string, tiles int, pair int, kind string, words int"
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "src", None, *["c"] * 1, 1, "c", "c", 1, "c", "c", "c", 1, 1, "c", 1) for k, (i, t) in enumerate(GIVEN)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {clash}").repartition(4).cache()


def test_license_rows(table):
    from tradewind.llm.license_scan import license_digest, scan_licenses

    got = signature(license_digest(scan_licenses(table)), "doc_id", "n_words", "labels", "score")
    assert got == Counter((i, len((t or "").split()), "", 0.0) for i, t in GIVEN)


def test_piece_and_token_rows(table):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from tradewind.llm.sentence_pieces import round_trip
    from tradewind.llm.token_counts import count_tokens

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert signature(round_trip(table), "doc_id", "n_tokens", "same_ids") == Counter((i, len(pieces.encode(t or "")), True) for i, t in GIVEN)
    assert signature(count_tokens(table), "doc_id", "n_tokens") == Counter((i, len(tokens.encode(t or "", add_special_tokens=False).ids)) for i, t in GIVEN)


def test_packed_rows(table):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tradewind.llm.packing import pack

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = Counter()
    for r in pack(table).collect():
        sizes[r.doc_id, r.doc_tokens] += r.length
    want = Counter()
    for i, t in GIVEN:
        n = len(tokens.encode(t or "", add_special_tokens=False).ids) + 1
        want[i, n] += n
    assert sizes == want


def test_fingerprint_rows(table):
    from tradewind.llm.simhash import near_duplicates, similar_documents

    got = signature(near_duplicates(table), "doc_id", "component_id")
    assert got == Counter({(1, 1): 3, (None, 1): 1, (None, 2): 1, (2, 2): 2, (3, 3): 1, (4, 3): 1, (5, 2): 1})
    assert signature(similar_documents(table), "doc_id", "component_id") == got


def test_repeated_passage_rows(table):
    from tradewind.llm.debruijn_dedup import repeated_passages

    words = [(i, (t or "").split()) for i, t in GIVEN]
    seen = Counter(tuple(w[a : a + 35]) for _, w in words for a in range(len(w) - 34))
    want = Counter()
    for i, w in words:
        gone = {k for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for k in range(a, a + 35)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert signature(repeated_passages(table), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_quality_rows_and_columns(table):
    from tradewind.llm.quality_rules import STATS, quality

    got = quality(table)
    assert set(got.columns) == {*table.columns, *STATS, "clean_text"}
    assert signature(got, *table.columns) == signature(table, *table.columns)
    assert signature(got, "doc_id", "n_words", "kept") == Counter((i, len((t or "").split()), len((t or "").split()) >= 50 and t != GIVEN[2][1]) for i, t in GIVEN)


def test_line_at_the_limit_stays(spark):
    from tradewind.llm.quality_rules import quality

    body = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(26)) * 3
    for holders, gone in ((10, 0), (11, 1)):
        rows = [(k, ("the same line of text\n" if k < holders else "") + body(k), "h") for k in range(30)]
        got = quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where(f"doc_id < {holders}")
        assert {r.n_removed_lines for r in got.collect()} == {gone}


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, table, k):
    """Nulls, repeated rows, extra columns and an empty table go through every stage alone."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = pipeline.STAGES[k][1]
    got = stage(spark, table, "")
    rows = got.collect()
    if k < 3:
        assert got.columns == list(pipeline.COLUMNS) and all(r.n_chars == len(r.text) for r in rows if k != 1)
        ids = Counter(r.doc_id for r in rows)
        # too few words, or a triple that repeats; one row of each near-duplicate group; copies of what a smaller id holds
        assert ids == [Counter({1: 2, None: 1, 3: 1, 4: 1}), Counter({1: 2, 3: 1, 2: 1}), Counter({1: 3, None: 1, 2: 2, 3: 1, 5: 1})][k]
    else:
        assert {r.doc_id for r in rows} == {i for i, _ in GIVEN} and sum(r.length for r in rows if r.start == 0) > 0
    assert stage(spark, table.limit(0), "").count() == 0
