"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from lintmill.llm import decontaminate, html_text, media, mixing, near_texts, ngram, quality, secrets, simhash, substrings, transcripts

LONG = "word salad " * 30_000
ROWS = [
    (1, "plain words that say something here", "en", "a", 35, 7, "x"),
    (2, "plain words that say something here", "en", "a", 35, 7, "x"),
    (2, "plain words that say something here", "en", "a", 35, 7, "x"),
    (3, None, "en", None, None, None, None),
    (4, "", None, "b", 0, 1, ""),
    (None, "a row without an id", "en", "b", 19, 1, "y"),
    (5, LONG, "de", "a", len(LONG), 2, "z"),
    (6, "   \t\n ", "en", "c", 6, 2, "z"),
    (7, "tschüß – naïve façade 😀 <b>bold</b>", "de", "c", 36, 3, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string"
#: Names that the operators use within.
CLASHES = "copy mix_size mix_twin repeats k_size k_source quality_score row_key kept high low group key node n target row_ taken".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 0), (7, None, 0), (None, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


def test_quality(spark, docs, none, labels):
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == 1
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == by_id[6]["fingerprint"] == "0" * 16
    assert by_id[6]["component_id"] == 3
    assert simhash.near_duplicates(none).count() == 0
    kept = near_texts.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 7]
    assert kept.where("doc_id is null").count() == 1


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string"
    talks = spark.createDataFrame([(1, 0, "user", "hi?"), (1, 1, "assistant", "hello\nthere"), (2, None, None, None), (None, 0, "user", ""), (2, 3, "odd", "x" * 5000), (1, 1, "assistant", "hello\nthere")], schema)
    out = transcripts.format_conversations(talks).collect()
    assert {(r["conv_id"], r["turn"]) for r in out} == {(1, 0), (1, 1), (2, None), (None, 0), (2, 3)}
    assert transcripts.format_conversations(talks.limit(0)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a<b>b"), (3, "u", "no markup at all"), (3, "u", "<script>only</script>"), (4, "u", "<article><p>One &amp; two</p></article>" + "<div>" * 3000)], "page_id long, url string, html string")
    out = html_text.extract(pages).collect()
    assert len(out) == 6
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] == 4] == ["One & two"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_lm(docs, none):
    rows = ngram.score(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["n_known"] <= r["n_tokens"] and r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 6)} == {1}
    assert ngram.score(none).count() == 0


def test_decontamination(docs, none, benchmark):
    assert decontaminate.overlaps(docs, benchmark).count() == 0
    assert decontaminate.overlaps(none, benchmark).count() == 0
    assert decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.keep_clean(docs, benchmark).columns == docs.columns
    assert decontaminate.keep_clean(docs, benchmark).count() == len(ROWS)


def test_media(docs, none):
    rows = media.documents_as_media(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["n_bytes"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 for r in rows)
    assert media.documents_as_media(none).count() == 0


def test_secrets(docs, none):
    assert secrets.findings(docs).where("is_secret").count() == 0
    assert secrets.findings(none).count() == 0
    redacted = secrets.redact(docs)
    assert redacted.schema.names == docs.schema.names
    assert redacted.count() == len(ROWS)


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0
    out = mixing.mix_rows(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert mixing.mix_rows(none).count() == 0


def test_substrings(docs, none):
    rows = substrings.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["n_removed"] == len(LONG) and by_id[5]["n_spans"] == 1
    assert by_id[1]["n_removed"] == 0
    assert substrings.remove_repeats(none).count() == 0


def test_stages_with_clashing_names(spark, docs, labels, benchmark):
    from pyspark.sql import functions as F

    wide = docs.select("*", *[F.lit(c).alias(c) for c in CLASHES])
    for out, extra in (
        (quality.keep_good(wide, labels), []),
        (near_texts.keep_representatives(wide), []),
        (decontaminate.keep_clean(wide, benchmark), []),
        (secrets.redact(wide), []),
        (mixing.mix_rows(wide), ["copy_"]),
    ):
        assert out.columns == [*wide.columns, *extra]
        assert all(r[c] == c for r in out.collect() for c in CLASHES)


def test_one_id_with_two_texts(spark):
    rows = [(1, "first text of this id is about boats and harbours"), (1, "second text speaks of mountains in winter snow"), (2, "first text of this id is about boats and harbours")]
    kept = near_texts.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted(rows[:2])


def test_short_benchmark_items(spark):
    docs = spark.createDataFrame([(1, "he said too short and left the room"), (2, "nothing of that kind")], "doc_id long, text string")
    bench = spark.createDataFrame([(4, "too short")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["compared"]) for r in decontaminate.overlaps(docs, bench).collect()] == [(1, 4, 2)]
    assert decontaminate.keep_clean(docs, bench).count() == 2
    with pytest.raises(ValueError):
        decontaminate.overlaps(docs, bench, agreement=0.5).count()
