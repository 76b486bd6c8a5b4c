import json

from lexmill.sources import readers, writers
from lexmill.streaming import counts


def test_lines_and_lexicons(spark, tmp_path):
    (tmp_path / "en_train.txt").write_text("a b\n\n  c d  \n")
    r = readers.corpus_lines(spark, str(tmp_path / "en_train.txt")).collect()
    assert [(x["lang"], x["split"], x["text"]) for x in r] == [("en", "train", "a b"), ("en", "train", "c d")]
    assert readers.words_of_first_lines(spark, str(tmp_path / "en_train.txt"), 2).count() == 2
    (tmp_path / "f.tsv").write_text("ev\t5.1\nbad\nok\t3\n", encoding="utf-8")
    assert {x["word"] for x in readers.frequency_lexicon(spark, str(tmp_path / "f.tsv")).collect()} == {"ev", "ok"}
    (tmp_path / "w.txt").write_text("Cat\ncat\n\ndog\n")
    assert readers.word_list(spark, str(tmp_path / "w.txt")).count() == 2


def test_conllu_and_unihan(spark, tmp_path):
    row = lambda i, w: "\t".join([i, w, w, "NOUN", "_", "Gender=Fem", "_", "_", "_", "_"])
    (tmp_path / "x.conllu").write_text("# c\n" + "\n".join([row("1-2", "ab"), row("1", "a"), row("2", "b"), row("2.1", "e"), row("3", "c")]) + "\n\n" + row("1", "d") + "\n")
    got = sorted((r["sent"], r["id"], r["form"]) for r in readers.conllu(spark, str(tmp_path / "x.conllu")).collect())
    assert got == [(0, 3, "c"), (1, 1, "d")]
    (tmp_path / "u.txt").write_text("U+4E00\tkRSUnicode\t1.0\nU+4E01\tkOther\tx\n")
    assert [(r["char"], r["radical"]) for r in readers.unihan_radicals(spark, str(tmp_path / "u.txt")).collect()] == [("一", 1)]


def test_runs_tex_and_sinks(spark, tmp_path):
    for name in ("r1_en_morph", "notes"):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "result.json").write_text(json.dumps({"loss": 1.5}))
    got = readers.run_results(spark, str(tmp_path / "runs/*/result.json"), "loss double").collect()
    assert [(r["rung"], r["run_lang"], r["regime"], r["loss"]) for r in got] == [("r1", "en", "morph", 1.5)]
    (tmp_path / "a.tex").write_text(r"\citep{x, y} \ref{s} \label{s}")
    assert sorted((r["kind"], r["key"]) for r in readers.tex_keys(spark, str(tmp_path / "a.tex")).collect()) == [("cite", "x"), ("cite", "y"), ("label", "s"), ("ref", "s")]
    d = spark.createDataFrame([("en", "train", "x y", 1)], "lang string, split string, text string, id int")
    writers.streams(d, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    writers.json_log(d, str(tmp_path / "log"))
    writers.json_log(d, str(tmp_path / "log"))
    assert readers.json_lines(spark, str(tmp_path / "log")).count() == 2
    assert "| en |" in writers.markdown(d)


def test_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = counts.running_counts(counts.document_stream(spark, str(tmp_path / "in"), src.schema)).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {r["lang"]: r["n"] for r in spark.table("running").collect()} == {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
