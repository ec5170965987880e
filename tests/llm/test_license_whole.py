"""A file is a licence by the cosine of its whole text, however long it is."""

from tidemill.llm import license


def test_repeated_notice_is_a_licence_file(spark):
    notice = "\n".join(["Released under the MIT License."] * 10)
    files = spark.createDataFrame([("a/x.txt", notice), ("a/y.txt", "plain words"), ("b/z.txt", "plain words")], "path string, text string")
    got = {r["path"]: (r["license"], r["origin"], r["evidence"]) for r in license.scan(files).collect()}
    assert got["a/y.txt"] == ("MIT", "directory", "a/x.txt")
    assert got["b/z.txt"] == (None, None, None)
