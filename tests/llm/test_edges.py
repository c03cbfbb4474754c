"""Every dealt operator and pipeline stage on nulls, empties, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from rasterloom.llm import decontaminate, languages, line_dedup, near_dup, neighbours, packing, pii, quality, samples, token_files, warc
from rasterloom.llm.shared import new_path

LONG = "word " * 60_000 + "end"
DOCS = [
    (1, None, "en"), (2, "", None), (3, "   \n\t ", "en"), (4, "a", "en"), (5, LONG, "en"), (6, LONG, "en"), (7, "same text in both rows", "fr"), (7, "same text in both rows", "fr"),
    (None, "no id here at all", None), (8, "1234 5678 !!", "en"), (9, "é" * 50 + "\n" + "ü ö ä", "fr"),
]
#: Extra columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, row string, id string, lines string, component_id string, kept string, bucket string, n_removed_ string, ids string, spans string, c string, a string, b string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*d, *["x"] * 12) for d in DOCS], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pii(docs, none):
    out = pii.find_spans(docs).collect()
    assert len(out) == len(DOCS) and all(not r.spans for r in out)
    assert pii.find_spans(none).count() == 0


def test_near_duplicates(docs, none):
    out = near_dup.near_duplicates(docs, size=3, percent=85).collect()
    assert len(out) == len(DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True)
    assert got[5][1:] == (5, True) and got[6][1:] == (5, False)
    assert got[7] == (3, 7, True) and sum(r.doc_id == 7 for r in out) == 2
    assert got[None][1:] == (None, True)
    assert near_dup.near_duplicates(none).count() == 0


def test_lines(docs, none):
    out = line_dedup.drop_lines(docs)
    assert out.columns == [*docs.columns, "n_removed"]
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[3] == ("   \n\t ", 0)
    assert got[5][1] == 0 and got[6] == ("", 1)
    assert got[7] == ("same text in both rows", 0)
    assert out.count() == len(DOCS)
    assert line_dedup.drop_lines(none).count() == 0
    clashing = docs.withColumnRenamed("c", "N_removed").withColumnRenamed("a", "Row").drop("row")
    again = line_dedup.drop_lines(clashing)
    assert again.columns == [*clashing.columns, "n_removed_" if "n_removed_" not in docs.columns else "n_removed__"]
    assert again.count() == len(DOCS) and line_dedup.drop_lines(clashing, counted=None).columns == clashing.columns


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "same text in both rows"), (2, None), (3, ""), (None, "no id here at all"), (1, "same text in both rows")], "item_id long, text string")
    got = rows(decontaminate.find_overlaps(docs, bench).select("doc_id", "item_id", "length", "matches"))
    assert got == [(7, 1, 5, 5), (7, 1, 5, 5), (None, None, 5, 5)]
    assert decontaminate.find_overlaps(none, bench).count() == 0
    assert decontaminate.find_overlaps(docs, bench.limit(0)).count() == 0
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 2


def test_languages(docs, none):
    model = languages.train(["the cat and the dog " * 5] * 30 + ["le chat et le chien " * 5] * 30, ["en"] * 30 + ["fr"] * 30)
    got = {r.doc_id: r for r in languages.identify(docs, model).collect()}
    assert {k: got[k].lang_pred for k in (1, 2, 3, 8)} == dict.fromkeys((1, 2, 3, 8), "und") and got[8].score == 0 and got[8].rejected
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].lang_pred in ("en", "fr")
    assert languages.identify(none, model).count() == 0
    assert languages.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert languages.fit(none) is None
    assert languages.accepted(docs, model).columns == docs.columns
    assert languages.learn_and_identify(docs).count() == len(DOCS)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (4, 0, 0), (7, 1, 1), (None, 1, 1), (99, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.learn_and_score(docs, labels).collect()
    assert len(out) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in out)
    assert quality.learn_and_score(none, labels).count() == 0
    assert {r.score for r in quality.learn_and_score(docs, labels.limit(0)).collect()} == {0.5}


def test_samples_are_bounded(spark):
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, id, 7) doc_id", "concat('text ', id % 40) text", "'en' lang", "cast(id % 2 as int) quality")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(languages, "train", lambda texts, langs: seen.append(texts))
        patch.setattr(quality, "train", lambda texts, labels: seen.append(texts))
        languages.fit(hot)
        quality.fit(hot, hot)
        quality.fit(hot, hot, sample_bytes=2000)
    assert [len(x) for x in seen[:2]] == [1001, 1002]  # id 7 has both labels
    assert 0 < len(seen[2]) < 500 and set(seen[2]) <= set(seen[1])
    assert samples.thinned(hot, ["doc_id"], 5000, "text", 2000).where("doc_id <> 7").count() < 200
    assert samples.thinned(hot, ["doc_id"], 5000, "text").count() == 3000


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(docs, path).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 1 and sum(r.length for r in out if r.doc_id == 7) == 12
    assert packing.pack_documents(none, path).count() == 0


def test_token_files(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_files.read_token_files(token_files.write_token_files(docs, new_path(spark, "t"), path)).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))
    assert out[1].n_tokens == out[2].n_tokens == 1
    assert token_files.read_token_files(token_files.write_token_files(none, new_path(spark, "t"), path)).count() == 0


def test_warc(spark):
    schema = "page_id long, url string, html string, refers_to string, digest string"
    pages = [(1, "u", None, "", ""), (2, None, "", "", ""), (3, "u\r\nx: y", "é" * 9, "", ""), (4, "u", "é" * 9, "", ""), (None, "u", "é" * 9, "", ""), (5, "u", "x" * 100_000, "", ""), (4, "u", "é" * 9, "", "")]
    out = warc.read_archives(warc.write_archives(spark.createDataFrame(pages, schema), new_path(spark, "w")))
    got = rows(out.select("page_id", "payload_bytes", "record_type", "refers_to"))
    assert got == sorted([(1, 0, "revisit", 2), (2, 0, "response", None), (3, 18, "revisit", 4), (4, 18, "response", None), (4, 18, "response", None), (None, 18, "response", None), (5, 100_000, "response", None)], key=repr)
    nothing = warc.read_archives(warc.write_archives(spark.createDataFrame([], schema), new_path(spark, "w")))
    assert nothing.count() == 0


def test_neighbours(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [(i, [float(i % 7 + 1), float(i % 5), 1.0, 0.0], "x") for i in range(40)] + [(100, None, "x"), (101, [], "x"), (102, [0.0] * 4, "x"), (103, [1.0, None, 0.0, 0.0], "x"), (104, [inf, 0.0, 0.0, 1.0], "x"), (105, [nan] * 4, "x"), (106, [1.0], "x"), (None, [1.0] * 4, "x"), (0, [1.0, 0.0, 1.0, 0.0], "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank string")
    out = neighbours.search(df, df.where("vec_id % 10 = 0 and vec_id is not null"), k=5).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {0, 10, 20, 30}
    for q, found in by.items():
        assert len(found) == 5 and q not in [v for v, _ in found] and all(v < 40 for v, _ in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert by[0][0][0] == 35  # the same vector
    few = df.where("vec_id < 3")
    assert neighbours.search(few, few.where("vec_id = 0"), k=5).count() == 2
    assert neighbours.search(df.limit(0), df, k=5).count() == 0


def test_neighbours_among_many_unusable(spark):
    """Three usable vectors among thousands that aren't: the sample holds them."""
    nan = float("nan")
    bad = [None, [], [0.0, 0.0], [None, 1.0], [nan, 1.0], [float("inf"), 1.0], [float("-inf"), 0.0], [None, None]]
    vectors = [(i, bad[i % len(bad)]) for i in range(20_000)] + [(20_001, [1.0, 0.0]), (20_002, [1.0, 1.0]), (20_003, [-1.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    out = neighbours.search(df, df.where("vec_id = 20001"), k=2, sample=100).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(20_001, 1, 20_002), (20_001, 2, 20_003)]
    assert neighbours.search(df.where("vec_id < 20000"), df, k=2, sample=100).count() == 0
    assert {r.vec_id for r in df.where(neighbours._fit("embedding")).collect()} == {20_001, 20_002, 20_003}


#: What stays of DOCS after each stage: doc_id and the words that are left.
STAYS = {
    "language_id": [4, 5, 6, 7, 7, 9, None],
    "line_dedup": [1, 2, 3, 4, 5, 7, 7, 8, 9, None],
    "near_dedup": [1, 2, 3, 4, 5, 7, 7, 8, 9, None],
    "decontamination": [1, 2, 3, 4, 5, 6, 8, 9, None],
}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, stage, tmp_path):
    """Nulls, empties, long texts, repeated rows, no doc_id, extra columns of clashing names, empty tables."""
    name, function = stage
    spark.createDataFrame([(1, "same text in both rows"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = "doc_id long, text string, lang string, source string, n_chars long, N_removed string, kept string, component_id string, Row string, score string"
    docs = spark.createDataFrame([(*d, "s", len(d[1] or ""), *"vwxyz") for d in DOCS], columns)
    out = function(spark, docs, str(tmp_path))
    if name == "packing":
        sizes = {r.doc_id: r.doc_tokens for r in out.collect()}
        assert set(sizes) == {d for d, *_ in DOCS} and sizes[1] == sizes[2] == 1
    else:
        assert out.columns == docs.columns
        found = out.collect()
        assert sorted((r.doc_id for r in found), key=repr) == sorted(STAYS[name], key=repr)
        texts = {d: t for d, t, _ in DOCS}
        assert all(r.text == texts[r.doc_id] and r.N_removed == "v" and r.score == "z" for r in found)
    assert function(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_every_text_survives_once(spark, tmp_path):
    """Of exact and near copies, also in rows of one doc_id, one document stays; others stay whole."""
    own = {i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(4)) for i in range(12)}
    rows = [(i, own[i % 8]) for i in range(20)] + [(30, own[8] + " more"), (31, own[8]), (40, own[9]), (40, own[10]), (41, own[10]), (50, own[11])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in once.collect()) == [*range(8), 30, 40, 40, 50]
    for first in (docs, once):
        left = corpus_pipeline.drop_repeated_lines(spark, first, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in left) == [*range(8), 30, 40, 40, 50]
        assert all(len(r.text) == r.n_chars and r.text.split() for r in left)


def test_decontaminated_rows(spark, tmp_path):
    """Rows of one doc_id, and rows without one, are decided each by its own text."""
    passage = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, passage), (2, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, "x " + passage), (1, "nothing of it"), (None, passage + " y"), (None, "nothing here"), (2, None), (3, "so one two three four five six seven")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    want = [texts[1], texts[3], texts[4]]
    out = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert rows(out.select("doc_id", "text")) == sorted(want, key=repr)
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(decontaminate.clean_documents(docs, bench, block_items=1, keep_without_id=False).select("doc_id", "text")) == sorted(want, key=repr)
    assert rows(decontaminate.clean_documents(docs, bench).select("doc_id", "text")) == sorted([*want, texts[2]], key=repr)
