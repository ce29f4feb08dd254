"""Toxicity, vector codes and fill-in-middle against brute force, their SQL and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.1"


# fill-in-middle


def filled(doc_id, text):
    """The contract, character by character."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs, rows, none, monkeypatch):
    from pyspark.sql import functions as F

    from tradewind.llm import fill_in_middle as fim

    got = {r.doc_id: r for r in fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == filled(i, t) and r.back == (t or "")
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(none).count() == 0


def test_fill_in_middle_blocks_and_odd_rows(spark, monkeypatch):
    """Sentinels and letters across block borders, unlike code points, repeated rows, null ids, ids of text."""
    import pyarrow as pa

    from tradewind.llm import fill_in_middle as fim

    texts = ["ab<P>cd", "<", "<P", "<P>", "a<Px>b<S >", "<<M>>", "x<S", "é日😀b" * 50, "word " * 300, "\0\n<p>", "PSM<PSM>", "ñ<" * 40 + "M>"]
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(fim, "BLOCK", block)
        for k, t in enumerate(texts):
            h = hashlib.sha256(f"1:{k}".encode()).hexdigest()
            some = fim._some(pa.array([k]), [t.encode()], [[int(h[8 * g : 8 * g + 8], 16)] for g in range(4)]).to_pylist()[0]
            assert (some["n"], some["form"], some["prefix_chars"], some["middle_chars"], some["output"].decode()) == filled(k, t), (block, t)
    monkeypatch.undo()
    given = [(None, "some words here"), (None, "some words here"), ("a1", "zwölf Boxkämpfer"), ("a1", None), ("a2", "x" * 3_000_000 + " é " * 100)]
    got = fim.fill_in_middle(spark.createDataFrame(given, "doc_id string, text string")).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *filled(i, t)) for i, t in given)


def test_sql(spark):
    from tradewind.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name in ("op12_vector_codes", "op13_fill_in_middle"):
        got, want = QUERIES[name](spark, "/root/testdata/sf0.01"), con.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)


# vector codes


def coded(rows, entries, rounds=4, parts=4, scale=1024):
    """Every vector against every entry, in Python's integers."""
    kept = [(i, [max(-(1 << 26), min(1 << 26, math.floor(scale * float(np.float64(x))))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [(i, [(v + [0] * (size * parts - len(v)))[p * size : (p + 1) * size] for p in range(parts)], lab) for i, v, lab in kept]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = defaultdict(list)
            for r in cut:
                groups[nearest(p, r[1][p])[1]].append(r[1][p])
            new.append([[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else c for e, c in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, ps, lab in cut:
        got = [nearest(p, x) for p, x in enumerate(ps)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), lab))
        by_label[lab] += out[-1][2]
    return Counter((i, c, e, by_label[lab], sha) for i, c, e, lab in out)


def same_codes(table, rows, entries):
    from tradewind.llm.vector_codes import vector_codes

    got = vector_codes(table, entries=entries)
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == coded(rows, entries)


def test_vector_codes(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(150).collect()]
    some = rows[3][1]
    odd = [None, [], [*some[:-1], None], [*some[:-1], float("nan")], [*some[:-1], float("-inf")], some, some, some[:5], [3e38] * 64, [-3e38] * 64, [7e4] * 64]
    rows += [(10_000 + k, v, None if k % 2 else 3) for k, v in enumerate(odd)] + [(None, some, 1), (rows[0][0], some, 2), (rows[0][0], some, 2)]
    schema = "vec_id bigint, embedding array<float>, label int"
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema + ", part string, row int, code int").repartition(3)
    same_codes(table, rows, 16)
    from tradewind.llm.vector_codes import vector_codes

    assert vector_codes(table.limit(0)).count() == 0


def test_vector_codes_with_few_rows_ties_and_a_hot_part(spark):
    rows = [(k, [1.0, 2.0, 0.0, float(k % 3)] if k % 3 else [0.0] * 4, k % 2) for k in range(60)]
    same_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), rows, 5)
    same_codes(spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>, label int"), rows[:3], 256)


# toxicity


def test_toxicity_held_out(spark):
    """Labels are learned from three folds; the fourth is predicted, as in the whole table of documents."""
    from tradewind.llm.toxicity import toxicity

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity(docs, labels).drop("offending").collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    seen = Counter((truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth)
    assert seen[1, 1] >= 0.8 * (seen[1, 1] + seen[1, 0]) and seen[0, 1] <= 0.03 * (seen[0, 1] + seen[0, 0])


@pytest.fixture(scope="module")
def trained(spark):
    """Bags of five sentences of 40 words; those with "grzk" or a word that begins with "blurp" are toxic."""
    from tradewind.llm.toxicity import train

    word = lambda k: f"w{k * 7919 % 211}"
    rows, labels = [], []
    for i in range(600):
        said = [" ".join(word(i * 31 + s * 7 + j) for j in range(8)) for s in range(5)]
        if i % 6 == 0:
            said[i % 5] += " grzk" if i % 12 else f" blurp{word(i)}"
        rows.append((i, ". ".join(said) + "."))
        labels.append((i, int(i % 6 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return train(docs, labels), docs, labels


def test_offending_sentences(spark, trained):
    from tradewind.llm.toxicity import toxic_sentences

    texts = [None, "", "w1 w2 w3.", "Clean wörds first. Then GRZK, here! And é blurpish? w5", "x" * 50 + "\n" + "w1 " * 2000 + "grzk。w2", "w1 w2. " * 400]
    table = spark.createDataFrame([(k, t, 1, "s") for k, t in enumerate(texts)] + [(3, texts[3], 1, "s"), (None, texts[3], 1, "s")], "doc_id bigint, text string, score int, toxic string")
    got = toxic_sentences(table, trained[0]).collect()
    assert len(got) == 8 and sum(r.doc_id == 3 for r in got) == 2
    by = {r.doc_id: r for r in got}
    spans = lambda k: [texts[k][p.start : p.start + p.length] for p in by[k].offending]
    assert [by[k].score for k in (0, 1)] == [0, 0] and by[2].score < 0.3 and not by[2].offending and by[5].score < 0.5
    assert spans(3) == ["Then GRZK, here", "And é blurpish"] and by[3].score > 0.5 and by[3].n_sentences == 4
    assert by[4].score > 0.5 and len(spans(4)) == 1 and spans(4)[0].endswith("grzk")
    assert toxic_sentences(table.limit(0), trained[0]).count() == 0
    # noisy-or: a document's doubt is the sum of its sentences'
    assert by[3].score >= max(p.score for p in by[3].offending)


def test_toxicity_blocks(spark, trained, monkeypatch):
    """Texts that are read in blocks give the sentences of the whole."""
    from tradewind.llm import toxicity

    texts = [b"", ("ä w1 w2. grzk w3! " * 50).encode(), b"\xe6\x97\xa5 blurpx", b"no end " * 30]
    whole = [(b.text[s], b.begin[s], b.end[s], round(z, 9)) for b in toxicity.blocks(texts) for s, z in enumerate(trained[0].logits(b))]
    monkeypatch.setattr(toxicity, "BLOCK", 300)
    parts = [(b.text[s], b.begin[s], b.end[s], round(z, 9)) for b in toxicity.blocks(texts) for s, z in enumerate(trained[0].logits(b))]
    assert sorted(parts) == sorted(whole)


def test_toxicity_without_labels(spark, trained):
    from tradewind.llm.toxicity import held_out, toxicity, train

    _, docs, labels = trained
    for some in (labels.limit(0), labels.where("toxic = 0"), spark.createDataFrame([(None, 1), (2, None)], "doc_id bigint, toxic int")):
        assert {r.score for r in toxicity(docs.limit(20), some).collect()} == {0.0}
    from pyspark.sql import functions as F

    held = labels.where(held_out(F.col("doc_id"), 4, 2))
    # what the held-out fold says changes nothing, and repeated labels count once
    turned = labels.join(held.select("doc_id", F.lit(1).alias("h")), "doc_id", "left").select("doc_id", F.when(F.col("h").isNull(), F.col("toxic")).otherwise(1 - F.col("toxic")).alias("toxic"))
    again = train(docs, turned.unionByName(turned))
    assert np.array_equal(again.features, trained[0].features) and np.allclose(again.weights, trained[0].weights)
