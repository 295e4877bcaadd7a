from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import diff

from .samples import DIFF

TWO = """diff --git a/m.ts b/m.ts
--- a/m.ts
+++ b/m.ts
@@ -1,4 +1,5 @@
 one
-two
+2
+2b
 three
 four
@@ -9,2 +10,3 @@ head
 nine
+  ten
 eleven
"""


def shape(file):
    return [(x["type"], x["old_line"], x["new_line"]) for h in file["hunks"] for x in h["lines"]]


def test_numbers_over_hunks():
    (file,) = diff.parse(TWO)
    assert (file["old_path"], file["new_path"], file["status"], len(file["hunks"])) == ("m.ts", "m.ts", "modified", 2)
    assert shape(file)[:6] == [("context", 1, 1), ("del", 2, None), ("add", None, 2), ("add", None, 3), ("context", 3, 4), ("context", 4, 5)]
    assert file["hunks"][1]["lines"][1] == {"type": "add", "content": "  ten", "old_line": None, "new_line": 11}


def test_line_ends_of_either_kind():
    assert shape(diff.parse(TWO.replace("\n", "\r\n"))[0]) == shape(diff.parse(TWO)[0])


def test_added_deleted_renamed():
    text = "diff --git a/n.ts b/n.ts\nnew file mode 100644\n--- /dev/null\n+++ b/n.ts\n@@ -0,0 +1,2 @@\n+x\n+y\ndiff --git a/o.ts b/o.ts\ndeleted file mode 100644\n--- a/o.ts\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\ndiff --git a/p.ts b/q.ts\nsimilarity index 100%\nrename from p.ts\nrename to q.ts\n"
    files = diff.parse(text)
    assert [(f["status"], f["old_path"], f["new_path"]) for f in files] == [("added", None, "n.ts"), ("deleted", "o.ts", None), ("renamed", "p.ts", "q.ts")]
    assert [x["new_line"] for x in files[0]["hunks"][0]["lines"]] == [1, 2] and files[1]["hunks"][0]["old_lines"] == 1


def test_binary_and_missing_line_end():
    text = "diff --git a/l.png b/l.png\nBinary files a/l.png and b/l.png differ\ndiff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -1 +1 @@\n-old\n\\ No newline at end of file\n+new\n\\ No newline at end of file\n"
    png, ts = diff.parse(text)
    assert png["binary"] and not ts["binary"] and [x["type"] for x in ts["hunks"][0]["lines"]] == ["del", "add"]


def test_counts_decide_what_a_line_is():
    (file,) = diff.parse("diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,3 @@\n--- a note\n+++ another\n select 1;\n\n")
    assert file["old_path"] == "q.sql"
    assert [(x["type"], x["content"]) for x in file["hunks"][0]["lines"]] == [("del", "-- a note"), ("add", "++ another"), ("context", "select 1;"), ("context", "")]


def test_quoted_paths():
    (file,) = diff.parse('diff --git "a/my \\"f\\".ts" "b/my \\"f\\".ts"\n--- "a/my \\"f\\".ts"\n+++ "b/my \\"f\\".ts"\n@@ -0,0 +1 @@\n+x\n')
    assert file["new_path"] == 'my "f".ts'
    assert diff.clean_path("/dev/null") is None and diff.clean_path("b/a/c.ts") == "a/c.ts"


def test_nothing_to_parse():
    assert diff.parse(None) == [] and diff.parse("") == [] and diff.parse("@@ -1 +1 @@\n+x") == []


def test_tables(spark):
    changes = spark.createDataFrame([(1, DIFF), (2, TWO), (3, None), (4, "")], "review_id int, diff string")
    files = diff.diff_files(changes)
    assert {(r["review_id"], r["file_seq"], r["new_path"]) for r in files.collect()} == {(1, 0, "dist/board.js"), (1, 1, "app/booking.ts"), (2, 0, "m.ts")}
    lines = diff.diff_lines(files)
    assert {(r["review_id"], r["n"]) for r in lines.groupBy("review_id").agg(F.count("*").alias("n")).collect()} == {(1, 16), (2, 9)}
    assert {tuple(r) for r in diff.first_added(lines).collect()} == {(1, "dist/board.js", 2), (2, "m.ts", 2)}
