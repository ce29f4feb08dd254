"""Documents with all that the operators must bear: a small real table and planted cases."""

import pytest


def planted() -> list[tuple]:
    words = [f"w{i * 7919 % 1009}" for i in range(400)]
    base = " ".join(words[:200])
    near = words[:200].copy()
    near[100] = "other"
    passage = "the quick brown fox jumps over the lazy dog and then walks home along the river bank " * 3
    long = " ".join(words[(i * 31) % 400] + str(i % 97) for i in range(20_000))
    special = "a <|endoftext|> b <s> </s> <unk> <0x0A>  two  spaces \t tab\r\n日本語 テスト 😀 ▁ naïve ﬁ"
    license_text = "Licensed under the Apache License, Version 2.0 (the License). MIT License. CC-BY GNU General Public License version 3"
    texts = [None, "", " ", "\n\n", "x", base, base, " ".join(near), "One. " + passage, "Two. " + passage, passage + passage, long, long[:5000] + " end", special, license_text, "ab " * 500, "a\0b", "A B C d e f g h"]
    return [(900_000 + i, t, "en", None if i % 3 else "src0", 0, "extra", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows(spark, sf_dir):
    got = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "extra", 1) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return got + planted()


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, chunk int"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with columns whose names the operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
