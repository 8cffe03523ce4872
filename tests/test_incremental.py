"""Byte scans of folders and tables, and the stored file table: arrivals, snapshots, deletions, torn versions."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourcegrain.sources import filebytes
from sourcegrain.sources.keyed import FileTable

FILES = "repo_id string, path string, language string, kind string, content string"
WORDS = StructType().add("word", "string").add("n", "long")


def count_words(files):
    words = files.select("repo_id", "path", F.explode(F.split("content", " ")).alias("word")).where("word <> ''")
    return words.groupBy("repo_id", "path", "word").agg(F.count("*").alias("n"))


@pytest.fixture
def words(spark):
    return FileTable(spark, tempfile.mkdtemp(prefix="sourcegrain-") + "/t", count_words, WORDS, buckets=4)


def give(spark, *rows):
    return spark.createDataFrame([(r, p, "text", "doc", c) for r, p, c in rows], FILES)


def content(table):
    return sorted(((r.repo_id, r.path, r.word, r.n) for r in table.entries().collect()), key=repr)


def test_arrivals_replace_their_file_only(spark, words):
    words.apply(give(spark, ("r", "a", "x y x"), ("r", "b", "z")), whole=False)
    assert content(words) == [("r", "a", "x", 2), ("r", "a", "y", 1), ("r", "b", "z", 1)]
    words.apply(give(spark, ("r", "a", "w")), whole=False)
    assert content(words) == [("r", "a", "w", 1), ("r", "b", "z", 1)]
    words.apply(give(spark, ("r", "b", None)), whole=False)
    assert content(words) == [("r", "a", "w", 1)]
    assert {(r.path, r.sha256 is None) for r in words.heads().collect()} == {("a", False), ("b", True)}


def test_a_snapshot_deletes_what_it_lacks_and_returns_bring_back(spark, words):
    words.apply(give(spark, ("r", "a", "x"), ("s", "a", "y")), whole=True)
    words.apply(give(spark, ("s", "a", "y")), whole=True)
    assert content(words) == [("s", "a", "y", 1)]
    words.apply(give(spark, ("s", "a", "y"), ("r", "a", "x")), whole=True)
    assert content(words) == [("r", "a", "x", 1), ("s", "a", "y", 1)]
    words.apply(give(spark), whole=True)
    assert content(words) == []


def test_unchanged_files_write_nothing_and_changes_their_bucket_only(spark, words):
    rows = [("r", str(i), f"t{i}") for i in range(40)]
    words.apply(give(spark, *rows), whole=True)
    words.apply(give(spark, *rows), whole=True)
    assert words.versions() == [1]
    words.apply(give(spark, ("r", "7", "new")), whole=False)
    folders = [d for d in os.listdir(f"{words.path}/version=2") if d.startswith("bucket=")]
    assert words.versions() == [1, 2] and len(folders) == 1
    assert content(words) == sorted([("r", str(i), "new" if i == 7 else f"t{i}", 1) for i in range(40)], key=repr)


def test_a_version_without_its_mark_is_not_seen_and_written_anew(spark, words):
    words.apply(give(spark, ("r", "a", "x")), whole=True)
    words.apply(give(spark, ("r", "a", "y")), whole=True)
    os.remove(f"{words.path}/version=2/_SUCCESS")
    assert content(words) == [("r", "a", "x", 1)]
    words.apply(give(spark, ("r", "a", "z")), whole=True)
    assert words.versions() == [1, 2] and content(words) == [("r", "a", "z", 1)]


def test_nulls_ties_repeats_and_empty_files(spark, words):
    words.apply(give(spark, (None, None, "n"), (None, "a", "m"), ("r", "e", ""), ("r", "d", "k"), ("r", "d", "k"), ("r", "u", None)), whole=True)
    assert content(words) == sorted([(None, None, "n", 1), (None, "a", "m", 1), ("r", "d", "k", 1)], key=repr)
    assert ("r", "u") not in {(r.repo_id, r.path) for r in words.heads().collect()}
    words.apply(give(spark, (None, None, "o"), ("r", "d", "k"), ("r", "d", "l")), whole=False)
    best = max("kl", key=lambda c: hashlib.sha256(c.encode()).hexdigest())
    assert content(words) == sorted([(None, None, "o", 1), (None, "a", "m", 1), ("r", "d", best, 1)], key=repr)


def test_extra_columns_are_left_out(spark, words):
    words.apply(give(spark, ("r", "a", "x")).withColumn("sha256", F.lit("no")).withColumn("bucket", F.lit(9)), whole=True)
    assert content(words) == [("r", "a", "x", 1)]


CASES = {"r/a.py": b"one\r\ntwo\n", "r/sub dir/b.txt": b"\xef\xbb\xbfmarked\n", "r/c.js": b"bad \xff byte", "r/n.py": b"x\x00y", "r/e.md": b"\n",
         "r/.env": b"KEY=1", "r/__init__.py": b"x = 1", "r/empty.py": b"", "r/credentials.json": b"{}", "r/node_modules/x.js": b"1", "r/app.min.js": b"1", "r/pic.png": b"\x89PNG",
         "r/big.py": b"#" * 3000, "top.py": b"pass"}
UNLISTED = {"r/.env", "r/__init__.py", "r/empty.py"}


@pytest.fixture
def folder():
    root = tempfile.mkdtemp(prefix="sourcegrain it's ")
    for path, data in CASES.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as out:
            out.write(data)
    return root


def test_a_folder_is_scanned_by_its_bytes(spark, folder):
    rows = {f"{r.repo_id}/{r.path}".lstrip("/"): r for r in filebytes.scan(filebytes.read_folder(spark, folder, 2000), 2000).collect()}
    assert sorted(rows) == sorted(["r/a.py", "r/sub dir/b.txt", "r/c.js", "r/n.py", "r/e.md", "top.py"])
    assert all(r.sha256 == hashlib.sha256(CASES[p]).hexdigest() and r.size == len(CASES[p]) for p, r in rows.items())
    assert rows["r/a.py"].lines == ["one", "two"] and rows["r/e.md"].lines == [""] and rows["r/e.md"].line_count == 1
    assert rows["r/sub dir/b.txt"].content == "marked\n" and rows["r/c.js"].content == "bad � byte"
    assert rows["r/n.py"].skip_reason == "binary" and rows["r/n.py"].content is None and rows["r/n.py"].line_count is None
    assert rows["top.py"].repo_id == ""


def test_refused_files_are_not_opened(spark, folder):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # a longer file fails where it is opened
    try:
        assert filebytes.folder_entries(spark, folder).count() == len(CASES) - len(UNLISTED)
        assert filebytes.unlisted(spark, folder) == len(UNLISTED)
        with open(f"{folder}/r/credentials.json", "wb") as out:
            out.write(b"A" * 500)
        assert len(filebytes.read_folder(spark, folder, 2000).collect()) == 6
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_reasons_of_a_table_of_bytes(spark):
    rows = [("r", p, bytearray(b)) for p, b in CASES.items()] + [("r", None, bytearray(b"x")), ("r", "gone.py", None), (None, "a.py", bytearray(b"y"))]
    rows = filebytes.scan(spark.createDataFrame(rows, "repo_id string, path string, content binary"), 2000).collect()
    told = {r.path: r.skip_reason for r in rows}
    assert len(rows) == len(CASES) + 3 and [(r.lines, r.line_count) for r in rows if r.path == "r/empty.py"] == [([], 0)]
    assert {p: s for p, s in told.items() if s} == {"r/n.py": "binary", "r/.env": "sensitive", "r/credentials.json": "sensitive", "r/node_modules/x.js": "ignored",
                                                    "r/app.min.js": "generated", "r/pic.png": "unsupported", "r/big.py": "large", None: "unsupported", "gone.py": "unreadable"}
