"""Empty tables, very long inputs, repeated rows and clashing columns of operators and pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm import bpe, html_extract, quality, secrets, unigram
from tracewright.llm.queries import byte_vocabulary, piece_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(n, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("th", "en", "er", "on", "ti")) for _ in range(r.randint(1, 4)))
    return [" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(n)]


def test_token_counts_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert unigram.count_column(df, piece_model()).count() == 0


def test_encoding_of_repeated_rows_and_of_nothing(spark):
    text = "the same text\n\nwith  blanks 12345 é"
    rows = [(1, text), (1, text), (1, text), (2, None), (2, None), (None, text)]
    out = bpe.encode_column(spark.createDataFrame(rows, "doc_id long, text string"), byte_vocabulary(), digests=True).collect()
    assert len(out) == 6 and len({(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out if r.text}) == 1
    assert {(r.n_tokens, r.decoded_sha256) for r in out if r.text is None} == {(0, hashlib.sha256(b"").hexdigest())}
    assert bpe.encode_column(spark.createDataFrame([], DOCS), byte_vocabulary()).count() == 0


@pytest.fixture(scope="module")
def labeller():
    return html_extract.train()


def test_extraction_of_nothing_and_of_a_very_long_page(spark, labeller):
    schema = "page_id long, url string, html string"
    assert html_extract.extract_column(spark.createDataFrame([], schema), labeller).count() == 0
    paragraphs = sentences(20_000)
    page = "<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article><footer>&copy; all</footer></body>"
    row = html_extract.extract_column(spark.createDataFrame([(1, "u", page)], schema), labeller).first()
    kept = row.text.split("\n")
    assert len(page) > 4_000_000 and row.n_chars == len(row.text) and len(kept) > 0.99 * len(paragraphs) and set(kept) <= {*paragraphs, "Home", "© all"}


def test_quality_with_repeated_ids(spark):
    texts = sentences(160)
    docs = [(i // 2, t if i % 4 < 2 else t.replace(" ", " %%% "), "en", "s", len(t)) for i, t in enumerate(texts)]
    docs += docs[:20]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(60)] + [(3, 0, 0)] * 5, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, DOCS)
    rows = quality.score_column(df, quality.train(df, labels)).collect()
    assert len(rows) == len(docs)
    assert len({(r.doc_id, r.text): r.quality for r in rows}) == 160 and all(len({x.quality for x in rows if (x.doc_id, x.text) == (r.doc_id, r.text)}) == 1 for r in rows[:20])
    assert sum(r.keep == ("%%%" not in r.text) for r in rows) > 0.9 * len(rows)


IDENTIFIERS = """
getUserAccountByEmailAddress DEFAULT_CONNECTION_TIMEOUT_SECONDS org.apache.commons.collections.MapUtils max_number_of_retries_per_host
internationalization_settings_page XMLHttpRequestUpgradeInsecure kubernetes-cluster-autoscaler application/vnd.openxmlformats
SpringBootApplicationContextLoader test_that_empty_tables_give_no_rows numpy.testing.assert_allclose_with_message handleWindowResizeAndScrollEvents
projects/website/templates/registration CMAKE_RUNTIME_OUTPUT_DIRECTORY_RELEASE background-position-percentage electroencephalographically
""".split()


def test_identifiers_of_other_words_are_no_secrets(spark):
    """Names from programs, none of them made by the generator of samples."""
    ratios = secrets.fit(secrets.labelled_samples(spark))
    df = spark.createDataFrame([(i, f"see {name} there") for i, name in enumerate(IDENTIFIERS)], "doc_id long, text string")
    clean = secrets.redact(df, ratios).where("text not like '%[%]%'").count()
    assert clean >= 0.8 * len(IDENTIFIERS)


def write_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    write_tables(spark, str(tmp_path / "t"), spark.createDataFrame([], DOCS))
    assert corpus_pipeline.run(spark, str(tmp_path / "t")).count() == 0


def test_pipeline_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    docs = [(i, t if i % 2 else t.replace(" ", " %%% "), "en", f"s{i % 2}", len(t), i, "own", -1) for i, t in enumerate(sentences(80, 3))]
    docs += [(None, docs[1][1] + " with a different end that no other text has at all today", "en", "s1", 1, 7, None, None)]
    df = spark.createDataFrame(docs, DOCS + ", component_id long, n_tokens string, keep int")
    write_tables(spark, str(tmp_path / "t"), df)
    out = corpus_pipeline.run(spark, str(tmp_path / "t"))
    assert set(df.columns) <= set(out.columns) and "_n_tokens" in out.columns
    rows = out.collect()
    assert len(rows) >= 30 and all(r.n_tokens == "own" and r.component_id == r.doc_id and r["_n_tokens"] > 0 for r in rows if r.doc_id is not None)
    assert out.where(F.col("doc_id").isNull()).count() == 1
