"""The stages one by one, each on its own input."""

import hashlib

import corpus_pipeline
import public_tokenizers


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").persist()
        sizes.append(docs.count())
        if name != "encode":
            assert docs.columns == columns
    assert sizes[1] >= 0.95 * sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]
    assert all(len(r.ids) == r.n_tokens for r in docs.limit(20).collect())


def test_run_equals_brute_force(spark, tmp_path):
    """No languages are known and one source is due each document once, so what is left is one of each, redacted, encoded and decoded."""
    from tokenizers import Tokenizer

    word = [f"w{i}" for i in range(60)]
    texts = [" ".join(word), " ".join(word) + " end", "mail a@b.co of é 漢字 now", "mail a@b.co of é 漢字 now", "12 34", None, "another one"]
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in {0: texts[0], 2: "mail [EMAIL] of é 漢字 now", 6: texts[6]}.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (ids, len(ids), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == 3 and {r.doc_id: (list(r.ids), r.n_tokens, r.decoded_sha256) for r in got} == want


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, a column that stages use inside, and an empty table."""
    odd = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, None), (1, "the cat sat on the mat", "en", "s", 22, "y"), (1, "the cat sat on the mat", "en", "s", 22, "y"), (2, "der Hund und die Katze", "de", "s", 22, "z"), (None, "wo ist das Haus der Frau", "de", None, 24, "z"), (3, "long words " * 20_000, "en", "t", 220_000, "w"), (4, "a b c d", None, "t", 7, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, node string")
    for start in (docs, docs.where("false")):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, "").persist()
            n, before = after.count(), now.count()
            assert n <= before if name in ("language", "near_duplicates") else n == before if name != "mix" else n <= 3 * before
            assert name == "encode" or after.columns == start.columns
            now = after
        assert (now.count() > 0) == (start.count() > 0)
