"""Files as rows."""

from wayset.sources import files


def test_a_file_is_one_row(spark, tmp_path):
    texts = [("a", "one\ntwo\n\nthree"), ("b", ""), ("c d", "tail\n")]
    files.write_texts(spark.createDataFrame(texts, "name string, text string"), str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_texts(spark, str(tmp_path / "out")).collect())) == texts


def test_a_folder_is_read_by_pattern(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "x.toml").write_text("[tasks.a]\nrun = 1\n")
    (tmp_path / "in" / "deep" / "y.toml").write_text("")
    (tmp_path / "in" / "z.md").write_text("no")
    found = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_folder(spark, str(tmp_path / "in"), "*.toml").collect()}
    assert found["x.toml"] == "[tasks.a]\nrun = 1\n" and "z.md" not in found
